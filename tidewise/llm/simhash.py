"""SimHash near-duplicates with BK-trees over shards of the fingerprints.

Fingerprints of 64 bits that differ in at most r agree on at least g of r + g blocks of bits, so each
distinct one goes to one shard per choice of g blocks, keyed by the bits of those; no link is lost.  g
grows with the number of fingerprints (2, 3 or 4: keys of 21, 27 or 32 bits), so that shards stay small.
A task builds a BK-tree for every shard it holds (children keyed by their integer Hamming distance to
the parent) and looks each fingerprint up in it, following only edges within the radius of the
distance just measured.  Trees of all of a task's shards are built and searched level by level as
numpy arrays.

A shard's tree stays where its fingerprints were shuffled to.  A row takes 32 bytes in each of 15
trees, so trees of a million fingerprints are 480 MB: they grow with the corpus, and are not broadcast.
A shard over `hot` rows is cut into slices, and each pair of slices is a task's work: one slice is the
tree, the other asks; a task never holds more than two slices.  A shard gives links of its members to
one root per connected set, never all pairs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, shuffle_partitions, sliced, text_or_empty
from .components import connected_components

FRONTIER, FEW = 1_000_000, 10_000
#: Rows of a shard that are searched in one piece, and to which the keys' length holds the usual shard.
HOT, USUAL = 8192, 2048
#: Rows of each side of a block of pairs, and how many row numbers may be broadcast (16 bytes each).
BLOCK, SEVERAL = 256, 200_000
#: Texts are near copies if they share at least this part (numerator, denominator) of their shingles.
SIMILAR = (4, 5)


MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15)


def lane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits that a hash stands for: itself, then splitmix64 of it and k."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * MIX[2] & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """A 64-bit hash of each run of `shingle` words; a shorter text is one shingle, no words are none."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[shingle - 1 :] - 1).tolist()
    starts = [0, *ends[:-shingle].tolist()]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def folded(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """The fingerprint of a text's shingle hashes, as signed 64-bit integers, one for each lane."""
    if len(hashes) <= 1:
        return [int(lane(hashes, k).view(np.int64)[0]) if len(hashes) else 0 for k in range(lanes)]
    counts, n = np.zeros((lanes, 64), np.int64), len(hashes)
    for at in range(0, n, 65_536):
        for k in range(lanes):
            bits = np.unpackbits(lane(hashes[at : at + 65_536], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel().tolist()


def fingerprint(text: bytes, shingle: int, lanes: int = 1, seed: int = 42) -> list[int]:
    """The fingerprint as signed 64-bit integers, one for each lane."""
    return folded(shingle_hashes(text, shingle, seed), lanes)


def set_digest(members: np.ndarray) -> list[int]:
    """128 bits of a set (sorted hashes), as two signed 64-bit integers."""
    import xxhash

    held = members.tobytes()
    return np.array([xxhash.xxh64_intdigest(held, k) for k in (1, 2)], np.uint64).view(np.int64).tolist()


def columns_of(lanes: int) -> list[str]:
    return [f"f{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, sets: bool = False) -> DataFrame:
    """(_row, doc_id, f0, ...) for every row of docs (_row, doc_id, text); a null text counts as empty
    (fingerprint 0).  With `sets`, a repeated shingle counts once, and s0 and s1 identify the set."""
    more = ["s0", "s1"] if sets else []
    names = ["_row", "doc_id", *columns_of(lanes), *more]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in names])
        for batch in sliced(batches):
            found = (shingle_hashes(t, shingle) for t in batch.column(2).to_pylist())
            if sets:
                found = (np.unique(h) for h in found)
            fps = np.array([folded(h, lanes) + (set_digest(h) if sets else []) for h in found], np.int64).reshape(-1, lanes + len(more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(fps[:, k]) for k in range(fps.shape[1]))], schema=schema)

    rows = docs.select("_row", F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(hashed, ", ".join(f"{n} long" for n in names))


def blocks_that_agree(n: int) -> int:
    """The least g from 2 to 4 whose keys leave shards of n fingerprints at their usual size."""
    return next((g for g, bits in ((2, 21), (3, 27)) if n <= USUAL << bits), 4)


def block_pairs(fp: Column, radius: int, agree: int = 2) -> Column:
    """For one lane, one key per choice of `agree` of the radius + agree blocks: the choice's number and its
    bits."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)]
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(number).cast("long")
        for i in chosen:
            out = F.shiftleft(out, width).bitwiseOR(block[i])
        return out

    return F.array(*[key(k, chosen) for k, chosen in enumerate(combinations(range(n), agree))])


def tables_for(n: int, share: float) -> tuple[int, int]:
    """(hex digits of a key, number of tables) for n fingerprints: keys grow with the logarithm of n, so
    that a shard has USUAL rows at most, and tables so that rows with `share` of their bits different
    meet in five of them on average, and in one at least with a probability of 99 %."""
    digits = next((g for g in range(4, 12) if n <= USUAL << (4 * g)), 12)
    return digits, math.ceil(5 / (1 - share) ** (4 * digits))


def digit_keys(lanes: int, digits: int, tables: int, seed: int = 7) -> Column:
    """For wide fingerprints, one key per table: its number and `digits` of the fingerprint's hexadecimal
    digits, drawn at random once and for all."""
    rng = random.Random(seed)
    digit = [F.shiftrightunsigned(F.col(f"f{i // 16}"), 4 * (i % 16)).bitwiseAND(F.lit(15)) for i in range(16 * lanes)]

    def key(number: int) -> Column:
        out = F.lit(number).cast("long")
        for i in rng.sample(range(16 * lanes), digits):
            out = F.shiftleft(out, 4).bitwiseOR(digit[i])
        return out

    return F.array(*[key(k) for k in range(tables)])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (rows x lanes)."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def bk_forest(first: np.ndarray, fps: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees of the fingerprints (rows x lanes) that are held; first: the index of each one's root.
    (parent * base + distance, child), sorted; base is the number of possible distances."""
    base = 64 * fps.shape[1] + 1
    at, pending = first.copy(), np.flatnonzero(held & (first != np.arange(len(fps))))
    edges, children = [], []
    while len(pending):
        slot = at[pending] * base + distance(fps[pending], fps[at[pending]])
        slots, lead, which = np.unique(slot, return_index=True, return_inverse=True)
        child = pending[lead]
        edges.append(slots)
        children.append(child)
        at[pending] = child[which]
        pending = pending[at[pending] != pending]
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edge, kind="stable")
    return edge[order], child[order]


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a and b; a label is the smallest index of its set."""
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def shard_links(shard: np.ndarray, fps: np.ndarray, asks: np.ndarray, radius: int, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows that are linked, each with the root of its set; rows are sorted by shard, those
    that are held (default: all) first, and fingerprints (rows x lanes) are distinct within one."""
    n, most = len(fps), 64 * fps.shape[1]
    new = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    first = np.repeat(starts, np.diff(np.r_[starts, n]))
    edge, child = bk_forest(first, fps, np.ones(n, bool) if held is None else held)
    label = np.arange(n)
    largest = int(np.diff(np.r_[starts, n]).max(initial=1))
    askers = np.flatnonzero(asks)
    step = max(64, FRONTIER // largest)
    for lo in range(0, len(askers), step):
        q = askers[lo : lo + step]
        node = first[q]
        while len(q):
            d = distance(fps[q], fps[node])
            near = (d <= radius) & (q != node)
            label = united(label, q[near], node[near])
            left = np.searchsorted(edge, node * (most + 1) + np.maximum(d - radius, 0))
            count = np.searchsorted(edge, node * (most + 1) + np.minimum(d + radius, most), side="right") - left
            q, base = np.repeat(q, count), np.repeat(left - np.cumsum(count) + count, count)
            node = child[base + np.arange(len(q))]
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def links_within(distinct: DataFrame, keys: Column, lanes: int, radius: int, hot: int = HOT, prune: bool = True) -> DataFrame:
    """(a, b): links among the nodes of `distinct` (node, f0, ...), enough of them that their components
    are those of all pairs that share a key and differ in at most `radius` bits.

    prune: shards of one row, where they are most, are left out before rows are dealt to their tasks;
    it costs an exchange of its own.
    """
    spark = distinct.sparkSession
    lane_names = columns_of(lanes)
    keyed = distinct.select("node", *lane_names, F.explode(keys).alias("shard"))
    sizes = keyed.groupBy("shard").count().where(F.col("count") > (1 if prune else hot))
    if prune:
        # Keyed by a struct, both sides are dealt anew for the join, so that a very large shard can be split.
        sizes = sizes.select(F.struct("shard").alias("key"), "count")
        rows = keyed.withColumn("key", F.struct("shard")).join(sizes, "key")
    else:
        sizes = checkpointed(sizes)
        rows = keyed.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, "shard", "left")  # 16 bytes each
    # Of n slices, a row's own meets each other one once: the lower of the two is the tree, the higher asks.
    rows = rows.withColumn("slices", F.ceil(F.coalesce("count", F.lit(1)) / hot).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    rows = rows.select("shard", "own", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"), "node", *lane_names)
    rows = rows.select("shard", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asker"), (F.col("own") <= F.col("other")).alias("held"), (F.col("own") >= F.col("other")).alias("asks"), "node", *lane_names)
    order = ["shard", "tree", "asker"]
    rows = rows.repartition(shuffle_partitions(spark), *order).sortWithinPartitions(*order, F.desc("held"), "node")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        waiting: list[list[np.ndarray]] = []

        def changes(columns: list[np.ndarray]) -> np.ndarray:
            """Whether a row begins a new piece of work."""
            return np.r_[True, np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)]

        def flush(columns: list[np.ndarray]) -> pa.RecordBatch:
            node = columns[5]
            a, b = shard_links(np.cumsum(changes(columns)), np.stack(columns[6:], axis=1).view(np.uint64), columns[4], radius, columns[3])
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], schema=schema)

        for batch in batches:
            if batch.num_rows:
                waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in waiting) >= 100_000:  # what is before the last piece is complete
                columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                cut = int(np.flatnonzero(changes(columns))[-1])
                if cut:
                    yield flush([c[:cut] for c in columns])
                waiting = [[c[cut:] for c in columns]]
        if waiting:
            yield flush([np.concatenate(c) for c in zip(*waiting, strict=True)])

    return rows.mapInArrow(searched, "a long, b long")


def rooted(distinct: DataFrame, keys: Column, lanes: int, radius: int, prune: bool = True) -> DataFrame:
    """`distinct` (node, f0, ... and more) with the root of each node's component."""
    links = links_within(distinct.select("node", *columns_of(lanes)), keys, lanes, radius, prune=prune)
    return checkpointed(distinct.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    Rows are linked if their fingerprints differ in at most `radius` bits; component_id is the
    smallest doc_id reachable.  A null text counts as empty; texts without words have fingerprint
    zero and are linked like any others.  Null ids give rows, but are never a component_id unless
    all ids of a component are null.  Equal texts are searched once.  Columns other than doc_id and
    text are ignored; an empty table gives an empty result.
    """
    hashed = checkpointed(fingerprints(docs.select("doc_id", "text", F.lit(0).cast("long").alias("_row")), shingle))
    distinct = checkpointed(hashed.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("f0")))
    classes = rooted(distinct, block_pairs(F.col("f0"), radius, blocks_that_agree(distinct.count())), 1, radius)
    # Keyed by a struct, both sides are dealt anew for the join, so that a very large component can be split.
    least = classes.groupBy("root").agg(F.min("least").alias("component_id")).select(F.struct("root").alias("of"), "component_id")
    classes = classes.select("f0", F.struct("root").alias("of")).join(least, "of").select(F.struct("f0").alias("key"), "component_id")
    found = hashed.withColumn("key", F.struct("f0")).join(classes, "key")
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members that share so many are near copies; two empty sets are."""
    top, bottom = SIMILAR
    return (top + bottom) * shared >= top * (a + b)


def block_links(sets: list[np.ndarray], asks: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links by similarity between the sets that ask and all others, enough to join what they join; sets
    of one label are joined before, and are not compared."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    held, sums = np.zeros(len(codes) + 1, bool), np.zeros(len(codes) + 1, np.int64)
    label, links = label.copy(), []
    for q in np.flatnonzero(asks).tolist():
        own = codes[ends[q] - sizes[q] : ends[q]]
        held[own] = True
        np.cumsum(held[codes], out=sums[1:])
        held[own] = False
        near = similar(sums[ends] - sums[ends - sizes], sizes[q], sizes) & (label != label[q])
        for x in np.flatnonzero(near).tolist():
            if label[x] != label[q]:
                links.append((q, x))
                label[label == label[x]] = label[q]
    return links


def shingle_sets(rows: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """members (node, root, pivot) with the sorted hashes of the distinct shingles of the text of row
    `node` of rows (_row, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("pivot", pa.int64()), ("shingles", pa.binary())])
        for batch in sliced(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], schema=schema)

    texts = rows.select(F.col("_row").alias("node"), text_or_empty().cast("binary").alias("text"))
    found = texts.join(F.broadcast(members) if members.count() <= SEVERAL else members.hint("shuffle_hash"), "node")
    return checkpointed(found.select("node", "root", "pivot", "text").mapInArrow(hashed, "node long, root long, pivot long, shingles binary"))


def verified_links(sets: DataFrame, block: int) -> DataFrame:
    """(a, b): links among sets (node, root, pivot, shingles), enough of them that their components are
    those of all pairs with one root whose similarity reaches SIMILAR.

    First all sets of a root are compared with its pivot's: what is similar is joined by that, and needs
    no comparison among itself.  The others are compared with all of their root, in blocks of about
    `block` times `block` rows, so that a very large root is dealt to many tasks.
    """
    spark = sets.sparkSession

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("near", pa.bool_())])
        for batch in sliced(batches, 64):
            near = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                near.append(bool(similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.bool_())], schema=schema)

    # Keyed by a struct, both sides are dealt anew for the join, so that a very large root can be split.
    pivots = sets.where("node = pivot").select(F.struct("root").alias("key"), F.col("shingles").alias("other"))
    others = sets.where("node <> pivot").withColumn("key", F.struct("root"))
    near = checkpointed(others.join(pivots, "key").select("node", "shingles", "other").mapInArrow(compared, "node long, near boolean"))
    near = checkpointed(sets.select("node", "root", "pivot").join(near, "node"))
    stars = near.where("near").select(F.col("node").alias("a"), F.col("pivot").alias("b"))

    left = near.groupBy("root").agg(F.count("*").alias("n"), F.sum((~F.col("near")).cast("long")).alias("n_asks")).where("n_asks > 0 and n > 1")
    left = left.select(F.struct("root").alias("key"), F.ceil(F.col("n_asks") / block).cast("int").alias("high"), F.ceil(F.col("n") / block).cast("int").alias("wide"))
    left = near.withColumn("key", F.struct("root")).join(left, "key").select("node", "near", "high", "wide")
    left = checkpointed(sets.select("node", "root", "shingles").join(left, "node"))

    def dealt(rows: DataFrame, asks: bool, own: str, other: str) -> DataFrame:
        part, every = F.pmod(F.xxhash64("node"), F.col(own)), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.select("root", part.cast("int").alias("i" if asks else "j"), every.alias("j" if asks else "i"), F.lit(asks).alias("asks"), "node", "near", "shingles", "wide")

    columns = ["root", "i", "j", "asks", "node", "near", "shingles"]
    rows = dealt(left.where("not near"), True, "high", "wide").unionByName(dealt(left, False, "wide", "high"))
    # The blocks of a root are dealt to tasks in turn, so that none gets many of a very large one.
    n = shuffle_partitions(spark)
    turn = F.pmod(F.xxhash64("root") % n + F.col("i") * F.col("wide") + F.col("j"), F.lit(n)).cast("int")
    rows = rows.repartitionById(n, turn).sortWithinPartitions("root", "i", "j", "node", "asks").select(columns)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def flush(held: list[tuple]) -> pa.RecordBatch:
            node, start = np.unique(np.array([h[4] for h in held], np.int64), return_index=True)
            asks, near = np.zeros(len(node), bool), np.array([held[k][5] for k in start])
            asks[np.searchsorted(node, [h[4] for h in held if h[3]])] = True
            label = np.where(near, -1, np.arange(len(node)))
            links = block_links([np.frombuffer(held[k][6], np.uint64) for k in start], asks, label)
            return pa.RecordBatch.from_arrays([pa.array(node[[x[k] for x in links]] if links else node[:0]) for k in (0, 1)], schema=schema)

        held: list[tuple] = []
        for batch in sliced(batches, 64):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[-1][:3]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return checkpointed(stars.unionByName(rows.mapInArrow(searched, "a long, b long")))


def keep_one(docs: DataFrame, shingle: int = 5, lanes: int = 4, radius: int = 60, share: float = 0.1515, block: int = BLOCK) -> DataFrame:
    """The first row of each group of near copies, by doc_id (null ids last), with the columns it had.

    Near copies have a Jaccard similarity of at least 0.8 on the sets of their word shingles (hashed to
    64 bits), and groups are the components of such links.  Fingerprints only say which pairs may be
    links.  They are taken of the sets, so that what is repeated within a text can't hide what texts
    share: sets of a similarity of 0.8 have a cosine of 0.889 at least, which leaves a share of 0.1515
    of a SimHash's bits different.  In 64 bits that can't be told from chance among very many texts, so
    fingerprints are `lanes` times as wide: in 256 bits, 60 are more than three deviations above the
    mean of such copies (39) and eight below that of unrelated texts.  Two rows meet in a shard if they
    agree on one of the keys of `tables_for`, and in a shard the search is exact.

    What fingerprints connect, equal ones too, is then compared by its shingles: a link of fingerprints
    lies inside such a set, so none that is true is lost.
    """
    rows, names = numbered(docs, "_row"), columns_of(lanes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first")
    texts = checkpointed(fingerprints(rows, shingle, lanes, sets=True).groupBy(*names, "s0", "s1").agg(first).select(*names, "first", F.col("first._row").alias("node")))
    distinct = checkpointed(texts.groupBy(*names).agg(F.min("node").alias("node"), F.count("*").alias("n")))
    classes = rooted(distinct, digit_keys(lanes, *tables_for(distinct.count(), share)), lanes, radius, prune=False)
    wide = classes.groupBy("root").agg(F.sum("n").alias("n"), F.min("node").alias("pivot")).where("n > 1").select(F.struct("root").alias("key"), "pivot")
    wide = classes.withColumn("key", F.struct("root")).join(wide, "key").select(F.struct(*names).alias("key"), "root", "pivot")
    members = checkpointed(texts.select(F.struct(*names).alias("key"), "node").join(wide, "key").select("node", "root", "pivot"))
    links = verified_links(shingle_sets(rows, members, shingle), block)
    kept = texts.select("node", "first").join(connected_components(links), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first._row").alias("_row"))
    return rows.join(kept.hint("shuffle_hash"), "_row", "left_semi").select(*docs.columns)
