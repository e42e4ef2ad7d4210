import hashlib
import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tidewise.llm.imatch import CLASS_BITS, LEVELS, SUBSETS, fingerprint_documents, likeness, with_next


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
    return out


def texts(n):
    import random

    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    return [(i * 7 - 100, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 200, 900]))) + "é🙂" * (i % 3)) for i in range(n)]


def test_edits_follow_descending_ids(spark):
    rows = [*texts(200), (10_000, None), (10_001, ""), (10_002, "ab"), (-9_000, "the last one has words too")]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, print string").repartition(5)
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = edited(rows)
    assert len(got) == len(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    order = sorted(got, reverse=True)
    long_ = [i for i, t in rows if t and len(t) > 1000]
    assert sum(got[i].near_edited for i in long_) / len(long_) > 0.2 > 0.05 > sum(got[i].near_next for i in long_) / len(long_)
    assert got[10_000].fingerprint == got[10_001].fingerprint and got[10_001].near_edited == 1.0 and order[0] == 10_002


def test_equal_texts_equal_prints_ties_and_empty_tables(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "Alpha  BETA gamma!"), (3, "alpha beta gamma"), (None, "delta"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint_documents(docs).collect()
    assert len(got) == 6
    assert len({r.fingerprint for r in got if r.doc_id in (1, 3)}) == 1
    assert fingerprint_documents(docs.where("false")).count() == 0
    one = fingerprint_documents(docs.where("doc_id = 2")).first()
    assert one.near_next == 1.0


def test_likeness_of_common_levels(spark):
    a, b = [f"{i:x}" for i in range(8)], [f"{i:x}{i:x}" for i in range(8)]
    rows = [
        ("3." + ".".join(a + b), "3." + ".".join(a + b), 1.0), ("3." + ".".join(a + b), "4." + ".".join(b + a), 1.0), ("4." + ".".join(b + a), "3." + ".".join(a + b), 1.0), ("3." + ".".join(a + b), "5." + ".".join(a + b), 0.0),
        ("3." + ".".join(a + ["-"] * 8), "3." + ".".join(a[:4] + ["z"] * 4 + ["-"] * 8), 0.5), ("-1.ab", "-1.ac", 0.0), ("-1.ab", "-1.ab", 1.0), ("-1.ab", "0." + ".".join(a + b), 0.0), ("3." + ".".join(["-"] * 16), "4." + ".".join(["-"] * 16), 0.0),
    ]
    frame = spark.createDataFrame(rows, "a string, b string, want double").withColumn("got", likeness(F.col("a"), F.col("b")))
    assert [r.got for r in frame.collect()] == [r[2] for r in rows]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(hashes):
    """xxhash64 of an array, as the engine folds it: each element's hash is the next one's seed."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest((h % (1 << 64)).to_bytes(8, "little"), seed)
    return f"{seed:x}"


def brute_prints(texts):
    """Fingerprints of the texts, with the lexicon of the first `len(texts)` of them."""
    words = [{signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\W_]+", t.lower()) if w} for t in texts]
    df = Counter(c for terms in words for c in {h % (1 << CLASS_BITS) for h in terms})
    band = {c for c, n in df.items() if math.log(10) <= math.log(len(texts) / n) <= math.log(2000)}

    def one(terms):
        inside = sorted(h for h in terms if h % (1 << CLASS_BITS) in band)
        if not inside:
            return "-1." + chained(sorted(terms))
        level, parts = 1 + int(math.log2(len(inside))), []
        for k in range(LEVELS):
            for r in range(SUBSETS):
                own = [h for h in inside if (h % (1 << 64) >> CLASS_BITS) % (1 << level + k) == r]
                parts.append(chained(own) if own else "-")
        return ".".join([str(level), *parts])

    return [one(t) for t in words], one


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(17)
    words = [f"word{i}" for i in range(900)]
    rows = [(i, " ".join(rng.choice(words[: 30 if i % 3 else 900]) for _ in range(rng.choice([2, 40, 400]))) + " the") for i in range(120)] + [(500, ""), (501, "THE the"), (502, "only-here_once 12")]
    got = {r.doc_id: r for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints, _ = brute_prints([t for _, t in rows])
    assert [got[i].fingerprint for i, _ in rows] == prints
    levels = {p.split(".")[0] for p in prints}
    assert "-1" in levels and len(levels) >= 4
    assert got[501].fingerprint.startswith("-1.")  # a term of all texts is outside the band


def test_an_id_of_most_rows_goes_to_several_ranges(spark):
    rng = random.Random(19)
    rows = [(None if i % 3 else 7, f"text {rng.random()}", "p") for i in range(600)] + [(i + 10, f"text {i}", "p") for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got = with_next(spark.createDataFrame(rows, "doc_id long, text string, print string").repartition(5))
    ranges = got.groupBy(F.spark_partition_id()).count().collect()
    found = Counter((r.doc_id, r.text, r.next_text) for r in got.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    assert found == Counter((a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert max(r["count"] for r in ranges) < 700
