"""keep_one goes by the similarity of shingle sets, not by fingerprints alone."""

import random

from tidewise.llm.simhash import distance, fingerprint, keep_one

import numpy as np


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def first_of_components(rows):
    """Ids that stay of rows (id, text), by all pairs."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if root(i) == i]


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in keep_one(docs, **more).collect())


def edited(rng, base, n):
    """n words exchanged, six apart at least, so that five shingles go with each."""
    out = list(base)
    for k in rng.sample(range(1, len(base) // 6), n):
        out[6 * k] = f"x{rng.randrange(10**6)}"
    return out


def test_texts_below_the_similarity_stay_though_fingerprints_are_near(spark):
    rng, rows, linked = random.Random(5), [], 0
    for g in range(60):
        base = words(rng, 300)
        copy = edited(rng, base, rng.randint(8, 14))
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(copy))]
        assert 0.6 <= jaccard(rows[-1][1], rows[-2][1]) <= 0.78
        a, b = (np.array([fingerprint(t.encode(), 5, 4)], np.int64).view(np.uint64) for _, t in rows[-2:])
        linked += int(distance(a, b)[0]) <= 48
    assert linked >= 20
    assert kept(spark, rows) == [i for i, _ in rows]


def test_equal_fingerprints_of_unlike_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([*words(rng, 80), *["word"] * 500])) for i in range(6)]
    assert len({tuple(fingerprint(t.encode(), 5, 4)) for _, t in rows}) == 1
    rows += [(10 + i, rows[i][1].upper() + " word" * i) for i in range(3)] + [(20, ""), (21, " \n"), (22, None)]
    assert kept(spark, rows) == [0, 1, 2, 3, 4, 5, 20]


def test_chains_and_large_groups_in_blocks(spark):
    rng = random.Random(7)
    rows = []
    for g in range(3):
        base = words(rng, 300)
        for c in range(40):
            rows.append((100 * g + c, " ".join(edited(rng, base, rng.randint(0, 7) if g else 5))))
    link = words(rng, 400)
    for i in range(6):  # each has 0.8 with the next only
        rows.append((1000 + i, " ".join([*link[30 * i : 30 * i + 280]])))
    want = first_of_components(sorted(rows))
    assert 3 <= len(want) < len(rows) and [i for i in want if i >= 1000] == [1000]
    for block in (256, 4):
        assert kept(spark, rows, block=block) == want
