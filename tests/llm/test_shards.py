"""Keys, slices of very large shards, contraction of links, and recall of the near-dedup stage by similarity."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_near_copies import edited, jaccard, words
from test_simhash import brute_components, clustered, partition
from tidewise.llm.components import connected_components
from tidewise.llm.simhash import block_pairs, blocks_that_agree, keep_one, links_within, tables_for


def test_keys_grow_with_the_table():
    assert [blocks_that_agree(n) for n in (0, 10**9, 10**11, 10**13)] == [2, 2, 3, 4]
    sizes = [tables_for(n, 0.1515) for n in (0, 10**8, 10**9, 10**10, 10**12)]
    assert sizes[0] == (4, 70) and sizes == sorted(sizes) and sizes[-1][0] >= 7


@pytest.mark.parametrize("agree", [3, 4])
def test_longer_block_keys_lose_no_link(spark, agree):
    fps = clustered(250, 20 + agree)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x, x) for x in signed], "node long, f0 long")
    found = {r.node: r.root for r in connected_components(links_within(frame, block_pairs(F.col("f0"), 4, agree), 1, 4)).collect()}
    assert partition([found.get(x, x) for x in signed]) == partition(brute_components(fps, 4))


def test_one_hot_shard_in_slices(spark):
    fps = clustered(500, 31)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x, x) for x in signed], "node long, f0 long").repartition(3)
    for hot in (64, 1000):
        found = {r.node: r.root for r in connected_components(links_within(frame, F.array(F.lit(1).cast("long")), 1, 4, hot, False)).collect()}
        assert partition([found.get(x, x) for x in signed]) == partition(brute_components(fps, 4))


@pytest.mark.parametrize("last", [10_000, 40, 0])
@pytest.mark.parametrize("shape", ["star with the largest as hub", "chain", "circle and pairs"])
def test_contraction(spark, shape, last):
    n = 300
    if shape == "star with the largest as hub":
        links, want = [(n, i) for i in range(n)], [0] * (n + 1)
    elif shape == "chain":
        order = list(range(n))
        random.Random(1).shuffle(order)
        links, want = list(zip(order, order[1:], strict=False)), [0] * n
    else:
        links = [(i, (i + 1) % 50) for i in range(50)] + [(i, i + 1) for i in range(50, n, 2)] + [(7, 7), (None, 3)]
        want = [0] * 50 + [1 + (i - 50) // 2 for i in range(50, n)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), last).collect()}
    assert partition([found[i] for i in sorted(found)]) == partition(want) and len(found) == len(want)


def test_recall_by_similarity(spark):
    rng, rows = random.Random(41), []
    for g in range(500):
        base = words(rng, rng.randint(40, 250))
        copy = edited(rng, base, rng.randint(1, max(1, len(base) // 45)))
        if g % 4 == 0:  # a line that repeats in one text only would hide what both share, if it counted each time
            copy += ["again and again"] * 40
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(copy))]
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    caught = defaultdict(list)
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        s = jaccard(a, b)
        caught["below" if s < 0.8 else "0.80" if s < 0.85 else "0.85" if s < 0.9 else "0.9"].append(j not in kept)
        assert i in kept
    share = {k: sum(v) / len(v) for k, v in caught.items()}
    assert all(len(v) >= 30 for v in caught.values()), {k: len(v) for k, v in caught.items()}
    assert share["below"] == 0 and share["0.80"] >= 0.93 and share["0.85"] >= 0.97 and share["0.9"] >= 0.99, share
