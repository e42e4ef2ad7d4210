"""Added spans: sentences in no way made by the generator that teaches the trees, boundaries, order of overlaps, and
work that grows with the number of matches."""

import time

from tidewise.llm.pii import find_pii

#: Marked by « and »: personal data that no base pattern covers.
GOOD = [
    "You may reach «j.smith [at] posteo [dot] de» until Monday.", "Kontakt: «erika (at) beispiel (dot) org» oder Fax.", "send it to «sales(at)acme.co» please", "questions? «maria_lopez[at]correo[dot]es»!",
    "Please call «415-555-0132» after six.", "My mobile is «(212) 555-0187», evenings only.", "Tel. «030 1234 5678» in Berlin", "phone «303.555.0199» or come by", "fax «0221/457812»",
    "Visa «5500/0000/0000/0004» was charged.", "credit card «4012.8888.8888.1881», expires soon", "she paid with card «6011  1111  1111  1117» today",
    "The server «2001:0db8:85a3:0000:0000:8a2e:0370:7334» is down.", "packets from «2001:db8:44::7» were dropped",
]
BAD = [
    "token = \"dafbac99949115180e7593aa\" was revoked", "sha256 e3b0c44298fc1c149afbf4c8996fb92427ae41e4", "Pi is 3.14159265358979 or so.", "At 12:33:10.123456 on 2021-03-04 it broke.", "There were 1,234,567,890 rows.",
    "ISBN 978-3-16-148410-0 is out of print.", "In C, a[1] @ b[2] is no expression.", "user@host said hello", "released v1.2.3-4567890 yesterday", "It cost $1000000000 in total.", "see id=12345678901 in the log", "std::vector<int>::iterator it",
    "12:34:56:78 is a timecode", "uuid 550e8400-e29b-41d4-a716-446655440000", "commit 4821937 fixed it", "pages 1024-1088", "Born 12.11.1987 in Wien.", "due 2024/05/17 10:30", "build 20240517103000", "x1234567890y", "ticket_5551234567", "The ratio was 0.6666666666667.",
    "lat 48.8583701, lon 2.2944813", "he scored 10 9 8 7 6 5 4 points", "meet @ the.park at nine", "16 bytes: 0f:1e:2d:3c:4b:5a:69:78", "model A1234567 and B7654321", "order no. 12345678901234",
]
GROUPS = ("(at) [at]", "number", "::")


def added(row, text):
    out = []
    for span in filter(None, row.spans.split(",")):
        kind, a, b = span.split(":")
        out.append((kind, text[int(a) : int(b)]))
    return out


def test_precision_and_recall_on_other_sentences(spark):
    texts = [t.replace("«", "").replace("»", "") for t in GOOD] + BAD
    want = [t[t.index("«") + 1 : t.index("»")] for t in GOOD] + [None] * len(BAD)
    rows = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = [[x for _, x in added(rows[i], t)] for i, t in enumerate(texts)]
    hit = sum(w in f for w, f in zip(want, found, strict=True) if w)
    wrong = [(t, x) for t, w, f in zip(texts, want, found, strict=True) for x in f if x != w]
    missed = [t for t, w, f in zip(texts, want, found, strict=True) if w and w not in f]
    assert hit / len(GOOD) >= 0.85, missed
    assert hit / (hit + len(wrong)) >= 0.9, wrong


def test_nothing_inside_longer_tokens(spark):
    texts = ["token = \"dafbac[99949115180]e7593\"", "a2125550187", "2125550187b", "_212-555-0187", "x(at)y.org_z 1", "tel 212-555-0187x"]
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_added for r in rows if r.doc_id != 0} == {i: 0 for i in range(1, len(texts))}


def test_many_spans_in_one_text(spark):
    piece = "a{0}@b{0}.org, call (212) 555-{0:04d}; write to c{0}(at)d{0}(dot)com. "
    took = {}
    for n in (10, 1000, 9000):
        docs = spark.createDataFrame([(1, "".join(piece.format(i % 10_000) for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        row = find_pii(docs).first()
        took[n] = time.perf_counter() - began
        assert (row.n_email, row.n_added) == (n, 2 * n)
        starts = [int(s.split(":")[1]) for s in row.spans.split(",")]
        assert len(starts) == 3 * n and starts == sorted(starts)
    assert took[9000] - took[10] < 30 * (took[1000] - took[10] + 0.5)
