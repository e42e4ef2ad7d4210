"""Token counts by a map-side two-tier lookup (byte-level BPE, no pre-token shuffle).

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, broadcast to all
workers; its size is bounded by `table_size`.  Tier two is a cache in each Python worker that
encodes the misses with the tokenizer's own merges.  Pre-tokens never leave the task that read them.

Frequent words come from Misra-Gries summaries of whole partitions: every text is covered, each
summary holds at most `table_size` counters, and summaries are merged in a tree of bounded fan-in.
The table only saves encoding work; results do not depend on it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_or_empty, worker_cache

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_LIMIT = 600_000
FAN_IN = 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Counts tokens of whole texts exactly as the tokenizers library does for a byte-level BPE file.

    Pre-tokens are split by the library's pattern and encoded by the same merges through a rank
    table.  Texts with code points that this Python's Unicode tables don't assign go to the library
    whole, as the two may class them differently.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        flags = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PATTERN).findall
        letters = byte_alphabet()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in self.special and all(c in letters for c in word)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ordered = [vocab[a + b] for a, b in merges]
        self.exact = not flags and ordered == sorted(ordered) and spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece if self.exact else None
        self.frequent = frequent
        self.cache = Lengths(self)

    def length(self, pretoken: str) -> int:
        return len(self.encode(pretoken.encode("utf-8")))

    def count_by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.exact or not text.isascii() and has_unassigned(text):
            return self.count_by_library(text)
        if self.split_special is None or not self.split_special.search(text):
            return sum(map(self.cache.__getitem__, self.find(text)))
        total = len(self.split_special.findall(text))
        for part in self.split_special.split(text):
            total += sum(map(self.cache.__getitem__, self.find(part)))
        return total


class Lengths(dict):
    """Pre-token -> tokens: the broadcast table first, then what this worker has encoded.  Bounded."""

    def __init__(self, owner: ByteBpe):
        super().__init__(owner.frequent)
        self.owner = owner

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
            self.update(self.owner.frequent)
        n = self.owner.length(pretoken)
        if len(pretoken) <= 64:
            self[pretoken] = n
        return n


def has_unassigned(text: str) -> bool:
    import unicodedata

    return any(c > "ɏ" and unicodedata.category(c) == "Cn" for c in set(text))


def pruned(counts: Counter, size: int) -> Counter:
    """The Misra-Gries step: keeps at most `size` counters, taking the next count off each."""
    if len(counts) <= size:
        return counts
    ranked = counts.most_common(size + 1)
    off = ranked[-1][1]
    return Counter({w: n - off for w, n in ranked[:-1] if n > off} or dict(ranked[: size // 2]))


def frequent_words(docs: DataFrame, table_size: int) -> list[str]:
    """At most `table_size` white-space-led words that are frequent in the whole table."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                counts.update(text.split(" "))
                if len(counts) > 16 * table_size:
                    counts = pruned(counts, table_size)
        counts = pruned(counts, table_size)
        counts.pop("", None)
        yield pa.RecordBatch.from_pydict({"summary": [json.dumps(counts)]}, schema=pa.schema([("summary", pa.string())]))

    def merge(key: tuple, frame: Any) -> Any:
        import pandas as pd

        counts: Counter = Counter()
        for text in frame["summary"]:
            counts.update(json.loads(text))
        return pd.DataFrame({"summary": [json.dumps(pruned(counts, table_size))]})

    n = docs.rdd.getNumPartitions()
    summaries = docs.select(text_or_empty().alias("text")).mapInArrow(summarise, "summary string")
    while n > 1:
        n = -(-n // FAN_IN)
        summaries = summaries.groupBy((F.spark_partition_id() % n).alias("node")).applyInPandas(merge, "summary string")
    total: Counter = Counter()
    for row in summaries.collect():  # one row
        total.update(json.loads(row["summary"]))
    return [w for w, _ in total.most_common(table_size)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, table_size: int = 16_384) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to (doc_id) for every row of docs.

    A null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows each give a row;
    columns other than doc_id and text are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, table_size)
    local = ByteBpe(path, {})
    table: dict[str, int] = {}
    if local.exact:
        for word in words:
            for pretoken in local.find(" " + word):
                table.setdefault(pretoken, local.length(pretoken))
            if len(table) >= table_size:
                break
    shared = spark.sparkContext.broadcast(table)
    version = (path, shared._jbroadcast.id())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_cache("byte_bpe", version, lambda: ByteBpe(path, shared.value))
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            tokens = [bpe.count(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
