"""Exact top-k inner products with a bit-sliced index.

Vectors are dealt once, by a hash of their row, into blocks of bounded size; the stated queries go to
every block, where they follow the vectors and stream past the block's index.  In a block, the
leading bits of every component (quantised: the low `coarse` bits are left off) are bit slices, one
bitmap over the block's rows for each component and bit.  A query adds the slices, shifted by the set
bits of its own components, with bitmap arithmetic: carry-save adders first, then one ripple.  That
gives the coarse score of all rows in bit-sliced form.  Rows are selected from the most significant
slice downward; those that the bits left off might still lift to the k-th place are the boundary
rows, and their exact integer scores decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, shuffle_partitions

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


class BitSlicedIndex:
    """Rows of int64 components (rows x dims)."""

    def __init__(self, rows: np.ndarray, coarse: int):
        self.rows, self.n, self.coarse = rows, len(rows), coarse
        high = rows >> coarse
        self.low = high.min(axis=0)
        high = high - self.low
        self.bits = max(1, int(high.max(initial=0)).bit_length())
        self.words = -(-self.n // 64)
        padded = np.zeros((self.bits, rows.shape[1], self.words * 64), np.uint8)
        for b in range(self.bits):
            padded[b, :, : self.n] = (high >> b & 1).T
        self.slices = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)  # bit, dim, word
        live = np.zeros(self.words * 64, np.uint8)
        live[: self.n] = 1
        self.live = np.packbits(live, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over dims of |q| times u, or of |q| times
        (all ones - u) where q is negative; u: the components' leading bits above their least."""
        size = np.abs(query)
        flip = np.where(query < 0, ONES, np.uint64(0))
        heap: list[list[np.ndarray]] = [[] for _ in range(int(size.max(initial=0)).bit_length() + self.bits + 1)]
        for j in range(int(size.max(initial=0)).bit_length()):
            dims = np.flatnonzero(size >> j & 1)
            if len(dims):
                for b in range(self.bits):
                    heap[j + b].append(self.slices[b, dims] ^ flip[dims, None])
        out, w = [], 0
        while w < len(heap):
            maps = np.concatenate(heap[w]) if heap[w] else np.zeros((1, self.words), np.uint64)
            while len(maps) > 1:
                if w + 1 == len(heap):
                    heap.append([])
                third = len(maps) // 3
                if third:
                    a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                    x = a ^ b
                    heap[w + 1].append((a & b) | (c & x))
                    maps = np.concatenate([x ^ c, maps[3 * third :]])
                else:
                    heap[w + 1].append(maps[:1] & maps[1:])
                    maps = maps[:1] ^ maps[1:]
            out.append(maps[0])
            heap[w] = []
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int = -1) -> np.ndarray:
        """Row numbers among which the k best are; own: a row that takes no part."""
        live = self.live.copy()
        if own >= 0:
            live[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        if self.n - (own >= 0) <= k:
            return self.unpacked(live)
        slices = self.sums(query)
        above, equal, kth = np.zeros_like(live), live, 0
        for w in range(len(slices) - 1, -1, -1):  # the k-th largest coarse score
            take = above | (equal & slices[w])
            if int(np.bitwise_count(take).sum()) >= k:
                equal = equal & slices[w]
                kth |= 1 << w
            else:
                above, equal = take, equal & ~slices[w]
        slack = int(np.abs(query).sum()) * ((1 << self.coarse) - 1) >> self.coarse
        least = kth - slack
        if least <= 0:
            return self.unpacked(live)
        above, equal = np.zeros_like(live), live
        for w in range(len(slices) - 1, -1, -1):
            if least >> w & 1:
                equal = equal & slices[w]
            else:
                above, equal = above | (equal & slices[w]), equal & ~slices[w]
        return self.unpacked(above | equal)

    def unpacked(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(column: pa.ListArray, dims: int = 0) -> np.ndarray:
    """floor(1024 * x) of the components (rows x dims), padded with zeros; dims: 0 for as many as the
    longest row has, else as many as the result has."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 1024).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), max(width, dims)), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out[:, : dims or width]


class Block:
    """A block of vectors: takes parts until the first query, then answers queries."""

    def __init__(self, k: int, coarse: int):
        self.k, self.coarse, self.parts, self.index = k, coarse, [], None

    def add(self, vec_id: np.ndarray, row: np.ndarray, vectors: pa.ListArray) -> None:
        self.parts.append((vec_id, row, quantised(vectors)))

    def best(self, query: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_id and score of the k best rows, the query's own left out."""
        near = self.index.top(query, self.k, self.at.get(row, -1))
        scores = self.rows[near] @ query
        first = np.lexsort((self.vec_id[near], -scores))[: self.k]
        return self.vec_id[near[first]], scores[first]

    def answers(self, query_id: np.ndarray, row: np.ndarray, queries: pa.ListArray) -> pa.RecordBatch | None:
        if self.index is None:
            if not self.parts:
                return None
            dims = max(p[2].shape[1] for p in self.parts)
            self.rows = np.concatenate([np.pad(p[2], ((0, 0), (0, dims - p[2].shape[1]))) for p in self.parts])
            self.vec_id = np.concatenate([p[0] for p in self.parts])
            self.at = {int(r): i for i, r in enumerate(np.concatenate([p[1] for p in self.parts]))}
            self.index, self.parts = BitSlicedIndex(self.rows, self.coarse), []
        asked = quantised(queries, self.rows.shape[1]) if self.rows.shape[1] else np.zeros((len(row), 0), np.int64)
        found = [self.best(q, int(r)) for q, r in zip(asked, row, strict=True)]
        sizes = [len(v) for v, _ in found]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(row, sizes), np.repeat(query_id, sizes), np.concatenate([v for v, _ in found]), np.concatenate([s for _, s in found]))], names=["query_row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, block: int = 65_536, query_block: int = 512, least_blocks: int = 10, coarse: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each stated query.

    Components become floor(1024 * x).  Queries are the rows whose vec_id is divisible by `every`,
    candidates all rows but the query's own; fewer than k candidates are all returned.  Ties go to the
    smaller vec_id.  Vectors that are null, or hold a null or non-finite component, take no part; nor
    do rows without a vec_id.  Shorter vectors count as padded with zeros.  Rows that repeat a vec_id are candidates
    and queries of their own.  Scores must fit 64 bits.  An empty table gives an empty result.

    A block has at most about `block` rows and 2**22 components; `query_block` queries are unpacked at a
    time.  The exchange carries each vector once and each query once for each block.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = numbered(vectors.select("vec_id", "embedding"), "row")
    rows = rows.where(x.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long"), "row", "embedding")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(least_blocks, -(-n // max(1, min(block, (1 << 22) // max(1, dims)))))

    own, every_block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    columns = ["vec_id", "row", "embedding"]
    held = rows.select(own.alias("block"), F.lit(False).alias("asks"), *columns)
    asked = rows.where(F.col("vec_id") % every == 0).select(every_block.alias("block"), F.lit(True).alias("asks"), *columns)
    dealt = held.unionByName(asked).repartitionById(max(blocks, shuffle_partitions(spark)), F.col("block")).sortWithinPartitions("block", "asks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = -1, Block(k, coarse)
        for batch in batches:
            part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if lo == hi:
                    continue
                if part[lo] != number:
                    number, now = part[lo], Block(k, coarse)
                for at in range(lo, hi, query_block if asks[lo] else hi):
                    run = batch.slice(at, min(query_block, hi - at) if asks[lo] else hi - lo)
                    ids, own_row, values = run.column(2).to_numpy(), run.column(3).to_numpy(), pa.array(run.column(4))
                    if not asks[lo]:
                        now.add(ids, own_row, values)
                    elif (out := now.answers(ids, own_row, values)) is not None:
                        yield out

    parts = dealt.mapInArrow(searched, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
