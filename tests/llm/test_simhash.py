import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from tidewise.llm.simhash import block_pairs, distance, fingerprint, keep_one, links_within, near_duplicates, shard_links


def brute_components(fps, radius):
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def clustered(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.choice(out) if out and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


def partition(labels):
    seen = {}
    return [seen.setdefault(x, len(seen)) for x in labels]


def test_tree_search_finds_every_link():
    for seed in range(5):
        fps = np.array(clustered(300, seed), np.uint64)
        a, b = shard_links(np.zeros(len(fps), int), fps[:, None], np.ones(len(fps), bool), 4)
        up = dict(zip(a.tolist(), b.tolist(), strict=True))
        assert partition([up.get(x, x) for x in range(len(fps))]) == partition(brute_components(fps.tolist(), 4))


def test_links_over_shards_match_all_pairs(spark):
    from tidewise.llm.components import connected_components

    fps = clustered(400, 9)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x, x) for x in signed], "node long, f0 long")
    for hot, prune in ((4096, True), (8, True), (8, False), (4096, False)):
        found = {r.node: r.root for r in connected_components(links_within(frame, block_pairs(F.col("f0"), 4), 1, 4, hot, prune)).collect()}
        assert partition([found.get(x, x) for x in signed]) == partition(brute_components(fps, 4))


def expected(rows):
    fps = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    classes = brute_components(fps, 4)
    ids = {}
    for (i, _), c in zip(rows, classes, strict=True):
        if i is not None:
            ids[c] = min(i, ids.get(c, i))
    return sorted(((i, f"{f:016x}", ids.get(c)) for (i, _), f, c in zip(rows, fps, classes, strict=True)), key=str)


def test_whole_query_on_edge_cases(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:399], "changed"]
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, " ".join(words)), (5, " ".join(near)), (6, "One TWO"), (7, "one two"), (7, "one two"), (None, "one two"), (8, "Ä b c d e"), (9, "x " * 30_000), (10, "a b c d"), (None, "alone in here")]
    docs = spark.createDataFrame([(i, t, "en", 0, "clash") for i, t in rows], "doc_id long, text string, fp string, shard int, component_id string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == expected(rows)
    assert near_duplicates(docs.where("false")).count() == 0


def test_hot_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(300)] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == expected(rows)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_of_similar_texts_stays(spark):
    rng = random.Random(8)
    rows, caught, near = [], 0, 0
    for g in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 400))]
        rows.append((1000 * g, " ".join(base)))
        for c in range(1, 4):
            w = [f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else a for a in base]
            rows.append((1000 * g + c, " ".join(w)))
    rows += [(10**6 + i, f"short text number {i} alone") for i in range(40)] + [(None, "short text number 1 alone"), (None, None), (10**7, ""), (1000, rows[4][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, f0 string").repartition(3)
    out = keep_one(docs)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and len(kept) == len(set(kept))
    assert {1000 * g for g in range(120)} | {10**6 + i for i in range(40)} | {10**7} <= set(kept) and None not in kept
    text = dict(rows)
    for g in range(120):
        for c in range(1, 4):
            a, b = shingles(text[1000 * g]), shingles(text[1000 * g + c])
            if len(a & b) / len(a | b) >= 0.8:
                near, caught = near + 1, caught + (1000 * g + c not in kept)
    assert near > 150 and caught / near >= 0.9
    assert keep_one(docs.where("false")).count() == 0


def test_wide_distance_counts_bits():
    a, b = (np.array([fingerprint(t, 5, 4)], np.int64).view(np.uint64) for t in (b"one two three four five six", b"one two three four five seven"))
    assert distance(a, b)[0] == sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[0], b[0], strict=True)) > 0
    assert fingerprint(b"a b c", 5, 4)[0] == fingerprint(b"a b c", 5)[0]
