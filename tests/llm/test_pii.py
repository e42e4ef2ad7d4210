import hashlib
import random
import re

from tidewise.llm.pii import find_pii, redact

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, lambda: all(int(x) <= 255 for x in m[0].split(".")), lambda: 14 <= len(d) <= 19 and luhn(d), lambda: 10 <= len(d) <= 15)[k]
            if ok is True or ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None, "", "no data here", "a@b.c%d@e.f x@y.z", "mail a.b+c@mail.example.com, or fakol.33@mail7.example.com!", "é🙂 x@y.org 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4207051279108084 4111 1111 1111 1111 4111 1111", "+1 (543) 555-1435 +44.20.7946.0958 +12 +1234567890123456 ++1-234-567-8901",
    "1.1.1.1@host.com +1.1.1.1.1.1.1.1.1.1", "a@b a@b. @x.y a@-.- _%@a.b..c", "5" * 5000, "a" * 20_000 + "@b.c", "1." * 4000 + "1", "+1" + "2 " * 5000, "x@" + "y." * 9000 + "z", "@" * 3000, "+" * 3000 + "1 2345 67890", "10.0.0.1\n10.0.0.2\t+49 30 1234567\r\n",
    "write to jane.doe(at)example(dot)com, tel (543) 555-1435 or 2001:db8:12::1", "order 123456789 on 2020-10-12, version 1.22.33.444",
]


def test_base_spans_match_python(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "@", ".", "1", "12", "255", "+", "-", " ", "(", ")", "4111111111111111", "x", "é", "%", "\n", "+1234567890"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    rows = {r.doc_id: r for r in find_pii(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want, r = base(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (t, r.spans, joined(want))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))


def test_added_spans_and_edges(spark):
    docs = spark.createDataFrame([(1, TEXTS[-2]), (2, TEXTS[-1]), (None, "x@y.org"), (3, None), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in find_pii(docs).collect()}
    assert rows[1].n_added == 3 and rows[2].n_added == 0 and rows[None].n_email == 1 and rows[3].spans == ""
    assert find_pii(docs.where("false")).count() == 0 and find_pii(docs).count() == 5
    assert redact(docs.where("doc_id = 1")).first().text == "write to [EMAIL], tel [PHONE] or [IP]"
