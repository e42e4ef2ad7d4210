"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from the statistics of at most `sample` labelled documents (some
two dozen numbers each), chosen by a hash of their ids; the flat arrays go to the workers with the
scoring function, which computes the same statistics for every whole text and walks the trees.
Scoring is one map over the documents, without any exchange.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import fold, sliced, text_or_empty

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_dev", "letters", "upper", "digits", "space", "marks", "shouts", "pipes",
    "distinct_words", "top_word", "repeats_next", "distinct_lines", "top_line", "line_words", "short_lines",
    "ends_sentence", "brackets", "slashes", "long_words", "compressed", "non_ascii", "entropy",
)


def statistics(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    data = text.encode("utf-8")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.zeros(256)
    for at in range(0, n, 1 << 20):
        hist += np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, n - at), at), minlength=256)
    words, lines = text.split(), text.split("\n")
    w = len(words) or 1
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    line_counts = Counter(lines)
    share = hist / n
    ascii_upper, ascii_lower = hist[65:91].sum(), hist[97:123].sum()
    high = hist[128:].sum()
    letters = ascii_upper + ascii_lower + high
    digits, space = hist[48:58].sum(), hist[[9, 10, 13, 32]].sum()
    p = share[share > 0]
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), letters / n, ascii_upper / max(1.0, ascii_upper + ascii_lower), digits / n, space / n,
        (n - letters - digits - space) / n, share[33], share[124], len(counts) / w, max(counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w,
        len(line_counts) / len(lines), max(line_counts.values()) / len(lines), len(words) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / len(lines), hist[[40, 41, 60, 62, 91, 93, 123, 125]].sum() / n, hist[[47, 92, 95, 64, 35, 61]].sum() / n, float((lengths > 20).mean()),
        len(zlib.compress(data, 1)) / n, high / n, float(-(p * np.log2(p)).sum()),
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and an array of the text's statistics."""
    kept = docs.select(*keep, text_or_empty().alias("_text"))
    schema = kept.drop("_text").schema

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [statistics(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "_stats"])

    return kept.mapInArrow(measured, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _stats array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 4) -> gbt.Trees:
    """Fits on at most about `sample` labelled rows whose crc32(doc_id) mod 5 is not 0.

    Labels are taken once per doc_id (the largest where a label repeats); null labels and null ids
    teach nothing.  No usable label: the model scores one half.
    """
    known = labels.where("doc_id is not null and quality is not null").where(fold(5) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    # Bounded by `sample` rows of 12 bytes; a document that repeats its id gives several rows.
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = with_statistics(taught, "doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).toPandas()
    if not len(rows):
        return gbt.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return gbt.fit(np.array(rows["_stats"].tolist()), rows["quality"].to_numpy(float))


def score(docs: DataFrame, trees: gbt.Trees, name: str = "score") -> DataFrame:
    """docs with the probability of label 1 for every row; an old column of that name goes."""
    docs = docs.drop(name)
    text = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(text).to_pylist()
            x = np.array([statistics(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.probability(x))], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns they had."""
    return score(docs, train(docs, labels), "_score").where(F.col("_score") >= threshold).select(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    A null text counts as empty and gets the score of an empty text.  A null id counts as the empty
    text for the fold.  Repeated rows give the same row again; columns other than doc_id and text are
    ignored; an empty table gives an empty result.
    """
    trees = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trees).drop("text")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
