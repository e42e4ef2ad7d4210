"""Sequence packing by Karmarkar-Karp multiway differencing.

A text's ids and its closing id are cut at multiples of the window; full pieces are windows of their
own.  A remainder longer than `longest` is cut into equal pieces, and pieces are taken in groups of
`group_size` as a task reads them (the last one has up to twice as many).  Every piece starts as a partition of m windows with one item; the
two partitions with the largest spread (fullest minus emptiest) are merged, fullest window onto
emptiest, until one is left.  m starts with what the sum needs, and rises while any window exceeds the
capacity; nothing is cut after that.

Packing needs no shuffle: groups are formed inside the task that tokenised the texts, a retried task
reads the same split and gives the same windows, and nothing a task holds grows beyond one group.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_or_empty, worker_cache
from .tokens import byte_alphabet

CACHE_LIMIT = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balanced(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp differencing of the items into `windows` lists of item numbers, some of them empty
    where there are fewer items.

    One heap holds all partitions by spread, single items first; a partition is the sorted list of its
    windows that are not empty, (sum, node), and a node is an item or a pair of nodes.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    heap = [(-lengths[i], tick, [(lengths[i], i)]) for tick, i in enumerate(order)]
    pairs: list[tuple[int, int]] = []
    for tick in range(len(heap), 2 * len(heap) - 1):
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        both = max(0, len(a) + len(b) - windows)  # windows of a that get one of b's: the emptiest, fullest first
        low, a = a[:both], a[both:]
        for x in b[: len(b) - both]:
            insort(a, x)
        for (s, i), (t, j) in zip(low, reversed(b), strict=False):
            insort(a, (s + t, len(lengths) + len(pairs)))
            pairs.append((i, j))
        heapq.heappush(heap, ((a[0][0] if len(a) == windows else 0) - a[-1][0], tick, a))

    def items(node: int) -> list[int]:
        out, open_nodes = [], [node]
        while open_nodes:
            n = open_nodes.pop()
            if n < len(lengths):
                out.append(n)
            else:
                open_nodes += pairs[n - len(lengths)]
        return out

    found = [items(node) for _, node in heap[0][2]] if heap else []
    return found + [[] for _ in range(windows - len(found))]


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by near-equal window, none over capacity: from as few windows as the sum needs, one
    more while a window exceeds it."""
    m = -(-sum(lengths) // capacity)
    while True:
        found = balanced(lengths, m)
        if all(sum(lengths[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        m += 1


class WordBpe:
    """Ids of whole texts as the tokenizers library gives them for a word-end BPE file.

    White space only separates words here, so each is encoded once per worker and cached as its ids'
    bytes.  Words of Latin-1 letters go through a rank table with the same merges (a word's last
    byte and its end mark form one symbol first); all others through the library.
    """

    def __init__(self, path: str):
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
        model, letters = spec["model"], byte_alphabet()
        end = model.get("end_of_word_suffix")
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.marker = os.path.commonprefix(self.special)  # empty: in every word
        self.exact = end == "</w>" and bool(self.marker) and not self.marker[0].isalpha()
        if self.exact:
            vocab = model["vocab"]

            def raw(symbol: str) -> bytes:
                body = symbol.removesuffix(end)
                return bytes(letters[c] for c in body) + (b"\xff" if body != symbol else b"")

            ranks = {bytes([b, 255]): b for b in range(255)} | {bytes([b]): 256 + b for b in range(256)}
            ids = np.zeros(512 + len(model["merges"]), np.uint32)
            for c, b in letters.items():
                ids[256 + b] = vocab.get(c, 0)
                if b < 255:
                    ids[b] = vocab.get(c + end, 0)
            for i, m in enumerate(model["merges"]):
                a, b = m.split(" ") if isinstance(m, str) else m
                ranks[raw(a) + raw(b)] = 512 + i
                ids[512 + i] = vocab[a + b]
            self.encode, self.ids = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece, [n.tobytes() for n in ids]
        self.pieces = WordIds(self.piece)
        self.cache = WordIds(self.word)

    def piece(self, piece: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.encode(piece.encode("utf-8") + b"\xff")))

    def word(self, word: str) -> bytes:
        if self.exact and (word.isascii() or max(word) < "Ā"):
            pieces = self.pieces
            if word.isascii() and word[:-1].isalpha():  # letters, then a letter or mark
                return pieces[word.lower()] if word[-1].isalpha() else pieces[word[:-1].lower()] + (b"" if word[-1] in "\t\n\r\v\f" else pieces[word[-1]])
            if self.marker not in word:
                return b"".join(map(pieces.__getitem__, self.find(word.lower())))
        return np.array(self.library.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def text(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.exact:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


class WordIds(dict):
    """A bounded cache of words, or of pieces of words, and their ids' bytes."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_LIMIT:
            self.clear()
            self[""] = b""
        ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group_size: int = 1024, longest: int | None = None) -> DataFrame:
    """Packs all docs into sequences of at most `capacity` ids; one row per piece.

    `longest` (default: a third of the capacity) is the longest remainder that stays in one piece:
    shorter items are easier to level, for more pieces.  A null text counts as empty, and
    every document ends with `end_id`, so an empty one is a piece of length 1.  Null ids and repeated
    rows are packed like any other row; an empty table gives no pieces; columns other than doc_id and
    text are ignored.  sequence_id is the task's number times 2**40 plus a count, so ids are unique
    without any exchange.
    """
    longest = longest or max(1, capacity // 3)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = worker_cache("word_bpe", path, lambda: WordBpe(path))
        task, used = TaskContext.get().partitionId() << 40, 0
        closing = np.array([end_id], np.uint32).tobytes()
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        rest: list[tuple] = []  # doc_id, start, ids' bytes, tokens of the document

        def grouped(group: list[tuple]) -> list[tuple]:
            nonlocal used
            out = []
            for window in windows_of([len(r[2]) // 4 for r in group], capacity):
                at = 0
                for doc_id, start, ids, n in sorted((group[i] for i in window), key=lambda r: -len(r[2])):
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, task + used, at))
                    at += len(ids) // 4
                used += 1
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for batch in sliced(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.text(text) + closing
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    if size == capacity:
                        out.append((doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), n, task + used, 0))
                        used += 1
                        continue
                    cuts = -(-size // longest)
                    edges = [start + size * i // cuts for i in range(cuts + 1)]
                    rest += [(doc_id, a, ids[4 * a : 4 * b], n) for a, b in zip(edges, edges[1:], strict=False)]
                if len(rest) >= 2 * group_size:  # so that the last group is no small one
                    out += grouped(rest[:group_size])
                    del rest[:group_size]
            if out:
                yield batch_of(out)
        if rest:
            yield batch_of(grouped(rest))

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(packed, SCHEMA)
