"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the wanted total over what it holds.  Each
document draws its number of copies from a Poisson distribution with that mean: a uniform number
seeded by a hash of its id is put through the inverse of the distribution function.  The document is
exploded by the count, and copies are dealt to partitions, and sorted there, by a hash of id, copy, row
and seed: a global shuffle that any retry repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, shuffle_partitions

SMALL = 10_000
PART = 64.0  # a mean above this is drawn as a sum of draws with means up to it


def uniform(seed: int, draw: Column) -> Column:
    """A number above 0 and below 1 from 52 bits of an md5 of seed, doc_id and the draw's number."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), draw.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_count(u: str, mean: str) -> str:
    """SQL: the least n with P(Poisson(mean) <= n) >= u, for a mean up to PART."""
    steps = f"sequence(1, int({mean} + 12 * sqrt({mean}) + 30))"
    return f"""aggregate({steps}, struct(exp(-{mean}) as p, exp(-{mean}) as cdf, 0 as n), (a, k) ->
      struct(a.p * {mean} / k as p, a.cdf + a.p * {mean} / k as cdf, case when a.cdf < {u} then k else a.n end as n), a -> a.n)"""


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: int | None) -> DataFrame:
    """(source, rate): target share * total / documents held.  A null source is a source."""
    held = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        held = held.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        held = held.withColumn("weight", F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0))
    sums = held.agg(F.sum("n").alias("all"), F.sum("weight").alias("weights"))
    all_n, all_w = sums.first()
    wanted = total if total is not None else (all_n or 0)
    return held.select("source", (F.col("weight") / F.lit(float(all_w or 1)) * wanted / F.col("n")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: int | None = None, seed: int = 10) -> DataFrame:
    """docs with each row repeated as often as drawn, and _copy from 0, in a global random order.

    Without weights, a source's share is its number of documents to the power `temperature`; `total`
    is the expected number of rows (default: as many as docs has).  Sources that weights lack get none.
    Rows with the same id and source draw the same count; null ids draw as the id "null", null
    sources are a source of their own.  An empty table gives an empty result.
    """
    docs = numbered(docs, "_row")
    by = rates(docs, weights, temperature, total).withColumnRenamed("source", "_source")
    by = by.withColumnRenamed("rate", "_rate")
    if by.count() <= SMALL:  # a source's name and a number each
        by = F.broadcast(by)
    drawn = docs.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    drawn = drawn.withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART).cast("int")))
    one = drawn.withColumn("_us", F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: uniform(seed, i)))
    counted = one.withColumn("_n", F.expr(f"aggregate(_us, 0, (s, u) -> s + {poisson_count('u', '(_rate / _draws)')})"))
    copies = counted.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_rate", "_draws", "_us", "_n")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_copy"), F.col("_row"))  # also spreads rows that repeat
    return copies.withColumn("_order", key).repartition(shuffle_partitions(docs.sparkSession), "_order").sortWithinPartitions("_order").drop("_order", "_row")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy_no and n_chars of every row of the mix."""
    mixed = mix(docs)
    return mixed.select(F.col("doc_id").cast("long"), "source", F.col("_copy").cast("long").alias("copy_no"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


#: For means up to PART, which the default parameters never exceed where no source is tiny.
MIX_SQL = """
held AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (SELECT source, pow(n, 0.7) / (SELECT sum(pow(n, 0.7)) FROM held) * (SELECT sum(n) FROM held) / n AS rate FROM held),
steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM rates, (SELECT unnest(range(0, 150)) AS k)
), draws AS (
  SELECT *, (CAST('0x' || substr(md5('10:' || doc_id || ':1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM {docs}
), mixed AS (
  SELECT d.*, unnest(range(0, (SELECT count(*) FROM steps s WHERE s.source = d.source AND s.cdf < d.u))) AS copy_no FROM draws d
)"""
REPORT_SQL = f"""
WITH {MIX_SQL.replace("{docs}", "documents")}
SELECT doc_id, source, copy_no, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM mixed
"""
