import math
import random

import numpy as np

from tidewise.llm.topk import BitSlicedIndex, top_k


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), j) for b, (j, w) in enumerate(ok) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_index_holds_the_best_rows():
    rng = np.random.default_rng(1)
    for n, d, k, coarse in ((300, 16, 10, 4), (64, 3, 5, 0), (65, 8, 10, 9), (5, 4, 10, 2)):
        rows = rng.integers(-1024, 1025, (n, d))
        rows[n // 2 :] = rows[n // 2]
        index = BitSlicedIndex(rows, coarse)
        for i in range(0, n, 7):
            near = index.top(rows[i], k, i)
            s = rows @ rows[i]
            s[i] = -(10**15)
            best = np.lexsort((np.arange(n), -s))[: min(k, n - 1)]
            assert set(best) <= set(near) and i not in near


def test_query_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(420)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]  # a very common vector
    rows += [(5000, None), (5001, [None] * 8), (5002, [float("nan")] * 8), (5100, [float("inf")] + [0.0] * 7), (5200, [0.25] * 3), (5300, []), (None, [0.1] * 8)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, row int")
    got = sorted(map(tuple, top_k(frame, query_block=3, block=100).collect()))
    assert got == brute(rows)


def test_few_rows_ties_and_repeats(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(frame).collect()))
    want = [(0, 1, 0, 1048576), (0, 2, 3, 1048576), (0, 3, 7, 1048576)]
    assert got == sorted(want * 2)
    assert top_k(frame.where("false")).count() == 0 and top_k(frame.where("vec_id = 7")).count() == 0
