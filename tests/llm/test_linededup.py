import hashlib
import random

from tidewise.llm.linededup import dedup_lines, report


def brute(rows, long_words=50):
    """Kept texts; rows (id, text) in input order."""
    lines = [(t or "").split("\n") for _, t in rows]
    first, marks = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    for r in order:
        live = [(i, x.strip(" \t\r")) for i, x in enumerate(lines[r]) if x.strip(" \t\r")]
        found = [(live[k][0], 3, "\n".join(x for _, x in live[k : k + 3]), [i for i, _ in live[k : k + 3]]) for k in range(len(live) - 2)]
        found += [(i, 1, x, [i]) for i, x in live if len(x.replace("\t", " ").split()) >= long_words]
        for at, n, body, places in sorted(found, key=lambda f: f[:2]):
            if first.setdefault(body, (r, at, n)) != (r, at, n):
                marks[r] |= set(places)
    return [(i, t, len(m), None if t is None else "\n".join(x for k, x in enumerate(lines[r]) if k not in m)) for r, ((i, t), m) in enumerate(zip(rows, marks, strict=True))]


LONG = " ".join(f"w{i}" for i in range(60))


def fixture():
    rng = random.Random(7)
    pool = [f"line {i} of the pool" for i in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  ", "\t" + pool[0] + " ", LONG, f"own {i}"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a\na\na\na\na\na"), (503, "a\nb\na\nb\na\nb"), (503, "a\nb\na\nb\na\nb"), (None, "n1\nn2\nn3"), (504, "n1\nn2\nn3\nn4"), (505, f"x\n{LONG}\ny"), (506, LONG), (507, "only\ntwo"), (508, "only\ntwo"), (509, "\n".join(["hot"] * 3000))]
    return rows


def test_matches_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, n, "clash") for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int, places string").coalesce(1)
    got = dedup_lines(docs).orderBy("row").collect()
    want = brute(rows)
    assert [(r.doc_id, r._removed, r.text) for r in got] == [(i, n, kept) for i, _, n, kept in want]
    assert [r._lines for r in got] == [0 if t is None else len(t.split("\n")) for _, t in rows]
    assert got[0].places == "clash"
    shas = sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in report(docs).collect())
    assert shas == sorted((str(i), n, hashlib.sha256((kept or "").encode()).hexdigest()) for i, _, n, kept in want)


def test_copies_keep_one_whole_text_and_empty_tables(spark):
    text = "one line\nanother line\nand a third\nlast"
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(7)
    kept = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert kept[0] == text and {t for i, t in kept.items() if i} == {""}
    assert dedup_lines(docs.where("false")).count() == 0
