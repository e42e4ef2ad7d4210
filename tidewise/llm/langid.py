"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point).  A letter n-gram is the
product of its letters' vectors, each rotated by its place (binding); a text is the sum of its
n-grams' vectors (bundling), and a language's prototype the sum of its texts.  A text gets the
language whose prototype has the largest cosine with it.

Words are bounded by any non-letter, which binds as one more letter, so n-grams also see word ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sliced, text_or_empty, worker_cache

DIMS, GRAM, BLOCK = 1024, 3, 128


def letter_classes() -> np.ndarray:
    """For every code point: 0 if it is no letter, else the code point of its lower case."""
    import unicodedata

    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Letters(dict):
    """Code point -> its +-1 vector; bounded by the letters there are."""

    def __missing__(self, c: int) -> np.ndarray:
        self[c] = (np.random.default_rng(np.random.SeedSequence([8, c])).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self[c]


class Encoder:
    def __init__(self) -> None:
        self.classes, self.letters = letter_classes(), Letters()

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """The bound vectors (float32) of n-grams packed 21 bits a letter."""
        out = np.ones((len(grams), DIMS), np.int8)
        for place in range(GRAM):
            codes, which = np.unique(grams >> np.uint64(21 * place) & np.uint64((1 << 21) - 1), return_inverse=True)
            out *= np.stack([np.roll(self.letters[int(c)], place) for c in codes])[which]
        return out.astype(np.float32)

    def grams(self, text: str) -> np.ndarray:
        """The packed n-grams of one whole text; none if it has no letter."""
        letters = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = letters != 0
        if not keep.any():
            return np.zeros(0, np.uint64)
        keep[1:] |= keep[:-1]  # of a run of others, the first stays
        keep[0] = True
        runs = np.concatenate([[0], letters[keep], [0]]).astype(np.uint64)
        packed = runs[: len(runs) - GRAM + 1].copy()
        for place in range(1, GRAM):
            packed |= runs[place : len(runs) - GRAM + 1 + place] << np.uint64(21 * place)
        return packed

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the texts, n-grams of each)."""
        import pandas as pd

        found = [self.counted(t) for t in texts]
        sizes = np.array([len(g) for g, _ in found])
        totals = np.array([int(n.sum()) for _, n in found])
        codes, distinct = pd.factorize(np.concatenate([g for g, _ in found])) if sizes.sum() else (np.zeros(0, int), np.zeros(0, np.uint64))
        out = np.zeros((len(texts), DIMS), np.float32)
        rows, counts = np.repeat(np.arange(len(texts)), sizes), np.concatenate([n for _, n in found]) if sizes.sum() else np.zeros(0)
        order = np.argsort(codes, kind="stable")
        rows, counts, codes = rows[order], counts[order], codes[order]
        for at in range(0, len(distinct), 8192):  # bounds the matrices whatever the texts hold
            lo, hi = np.searchsorted(codes, [at, at + 8192])
            part = distinct[at : at + 8192]
            table = np.bincount(rows[lo:hi] * len(part) + codes[lo:hi] - at, counts[lo:hi], len(texts) * len(part)).reshape(len(texts), len(part)).astype(np.float32)
            out += table @ self.vectors(part)
        return out, totals

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        codes, distinct = pd.factorize(self.grams(text))
        return distinct.astype(np.uint64), np.bincount(codes, minlength=len(distinct)).astype(np.float64)


def prototypes(docs: DataFrame, sample: int = 20_000, seed: int = 8) -> tuple[list[str], np.ndarray]:
    """The languages and their unit prototypes, from at most about `sample` taught rows.

    Taught are rows with a language and text whose crc32(doc_id) mod 3 is not 1; the sample is cut by
    a hash of id and length, a document counts with its share of n-grams, and sums come per partition.
    """
    taught = docs.where("lang is not null and text is not null").where(fold(3) != 1)
    n = taught.select("lang").count()
    if n > sample:
        taught = taught.where(F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache("langid", DIMS, Encoder)
        schema = pa.schema([("lang", pa.string()), ("dim", pa.int32()), ("value", pa.float64())])
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for at in range(0, len(texts), BLOCK):
                vectors, grams = encoder.bundles(texts[at : at + BLOCK])
                vectors = vectors / np.maximum(grams, 1)[:, None]
                for lang in set(langs[at : at + BLOCK]):
                    total[lang] = total.get(lang, 0) + vectors[langs[at : at + BLOCK] == lang].sum(axis=0, dtype=np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(vector)], schema=schema)

    sums = taught.select("lang", "text").mapInArrow(summed, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    langs = sorted(sums["lang"].unique())
    matrix = np.zeros((len(langs), DIMS))
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        matrix[i, own["dim"]] = own["value"]
    norms = np.linalg.norm(matrix, axis=1)
    return [x for x, n in zip(langs, norms, strict=True) if n], (matrix[norms > 0] / norms[norms > 0, None]).astype(np.float32)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, from 0) for every row of docs.

    A text that is null or has no letter gets `und` and score 0, as does every text where nothing was
    taught.  A null id counts as the empty text for the fold.  Repeated rows give the same row again;
    further columns are ignored; an empty table gives an empty result.
    """
    langs, matrix = prototypes(docs.select("doc_id", "lang", "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache("langid", DIMS, Encoder)
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for at in range(0, len(texts), BLOCK):
                vectors, grams = encoder.bundles(texts[at : at + BLOCK])
                if not langs:
                    names += ["und"] * len(grams)
                    scores += [0.0] * len(grams)
                    continue
                cosine = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                names += [langs[b] if n else "und" for b, n in zip(best, grams, strict=True)]
                scores += [float(min(1.0, max(0.0, c))) if n else 0.0 for c, n in zip(cosine[np.arange(len(best)), best], grams, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(named, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")
