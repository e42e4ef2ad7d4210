"""Connected components of a link table by repeated contraction, all on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: So many links are put together in one task; more are contracted first.
LAST = 10_000


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a few links (a, b), LAST at most: the smallest node of a set is its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], names=["node", "root"])


def connected_components(links: DataFrame, last: int = LAST) -> DataFrame:
    """links (a, b) of longs -> (node, root): one root for all nodes that links connect.

    Each round puts the nodes in an order, the first round by number and later ones at random (by a hash
    of node and round); every node takes the first of its neighbours and itself as its parent, parents
    are followed once more, and links are rewritten to the parents.  In a random order a node of d
    neighbours stays with a probability of 1 / (d + 1), so half of the nodes at most are expected to
    stay, whatever the links, and rounds grow with the logarithm of the largest component.  Rounds are
    checkpointed; once at most `last` links are left, one task follows them, and all is put together
    from there to the first round.  Minima are partial aggregates and joins are plain equi-joins, which
    adaptive execution splits where a node has very many links.  Self links and null ends are dropped; no links give no rows.
    """
    links = checkpointed(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    rounds: list[DataFrame] = []

    def ranked(node: str) -> Column:
        return F.struct((F.xxhash64(node, F.lit(len(rounds))) if rounds else F.lit(0)).alias("rank"), F.col(node).alias("node"))

    while links.count() > last:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = both.groupBy("node").agg(F.min(ranked("other")).alias("first")).select("node", F.least("first", ranked("node"))["node"].alias("parent"))
        # Keyed by a struct, both sides are dealt anew for the join, so that a parent of very many can be split.
        up = parents.select(F.struct(F.col("node").alias("at")).alias("key"), F.col("parent").alias("grand"))
        own = parents.withColumn("key", F.struct(F.col("parent").alias("at")))
        parents = checkpointed(own.join(up, "key", "left").select("node", F.coalesce("grand", "parent").alias("parent")))
        rounds.append(parents)
        links = links.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        links = checkpointed(links.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    found = links.select("a", "b").coalesce(1).mapInArrow(united, "node long, root long")
    while rounds:
        later = checkpointed(found).select(F.col("node").alias("parent"), F.col("root").alias("next"))
        found = rounds.pop().join(later, "parent", "left").select("node", F.coalesce("next", "parent").alias("root"))
    return checkpointed(found)
