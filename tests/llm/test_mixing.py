import hashlib
import math
from collections import Counter

from tidewise.llm.mixing import mix, report


def brute_count(doc_id, mean, seed=10):
    draws = max(1, math.ceil(mean / 64))
    n = 0
    for d in range(1, draws + 1):
        u = (int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = cdf = math.exp(-mean / draws)
        k = 0
        while cdf < u and k < 400:
            k += 1
            p *= mean / draws / k
            cdf += p
        n += k
    return n


def test_counts_are_inverted_poisson(spark):
    rows = [(i, f"text {i}", ("hot" if i % 3 else "cold") if i % 50 else None) for i in range(600)]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, _n int")
    held = Counter(s for _, _, s in rows)
    total = sum(n**0.7 for n in held.values())
    want = Counter({i: brute_count(i, held[s] ** 0.7 / total * 600 / held[s]) for i, _, s in rows})
    got = mix(docs.drop("_n")).collect()
    assert Counter(r.doc_id for r in got) == +want
    assert all(sorted(r._copy for r in got if r.doc_id == i) == list(range(want[i])) for i in (1, 2, 3, 50))
    assert len(report(docs).collect()) == len(got)


def test_weights_large_means_and_edges(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, "x"), (3, "c", "y"), (4, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mix(docs, weights={"x": 3.0, "y": 1.0}, total=1200).collect())
    assert got == Counter({1: 2 * brute_count(1, 300.0), None: brute_count(None, 300.0), 3: brute_count(3, 300.0)})
    assert 800 < sum(got.values()) < 1700
    assert mix(docs.where("false")).count() == 0 and mix(docs, weights={}).count() == 0


def test_order_is_global_and_repeats_itself(spark):
    docs = spark.createDataFrame([(i, "t", f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    a, b = ([r.doc_id for r in mix(docs).collect()] for _ in range(2))
    assert a == b and a != sorted(a)
    half = a[: len(a) // 2]
    assert 0.4 < sum(i < 1000 for i in half) / len(half) < 0.6
