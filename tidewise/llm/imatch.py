"""I-Match fingerprints, with DataFrame functions only.

A text's terms are its distinct lower-case runs of letters and digits.  Only terms within a band of
inverse document frequency count: neither those of many documents nor those of very few.  Document
frequencies are counted over all documents for 2**22 hashed term classes, so that the lexicon is a
bit set of fixed size (65,536 longs, a literal in the plan) whatever the corpus holds.

A fingerprint hashes the sorted terms of several randomised subsets of the lexicon.  At level l a hash
of the terms deals the lexicon into 2**l disjoint subsets, of which the first SUBSETS (or all) count.
The level follows the number of terms, so that a subset has one half to one of them on average; this
level and the next three are kept, so that texts of up to eight times the terms have one in common.  The likeness of two
fingerprints is the share of equal hashes among the subsets of their common levels in which either
has a term.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_or_empty

CLASS_BITS = 22
SUBSETS, LEVELS = 32, 4
LEAST = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """xxhash64 of every term, repeats included; nothing for the empty term at either end."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def term_class(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << CLASS_BITS) - 1))


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def lexicon(docs: DataFrame, idf_low: float = math.log(10), idf_high: float = math.log(2000)) -> list[int]:
    """The bit set of term classes whose idf, ln(documents / documents with it), is in the band."""
    classes = docs.select(F.explode(F.array_distinct(F.transform(term_hashes(text_or_empty()), term_class))).alias("class"))
    n = docs.count()
    idf = F.log(F.lit(float(max(n, 1))) / F.col("n"))
    inside = classes.groupBy("class").agg(F.count("*").alias("n")).where((idf >= idf_low) & (idf <= idf_high))
    bits = inside.groupBy(F.shiftright("class", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(class & 63 as int))")).alias("bits"))
    out = [0] * (1 << (CLASS_BITS - 6))
    for row in bits.collect():  # at most 2**16 rows
        out[row["slot"]] = row["bits"]
    return out


def fingerprint(text: str, bits: Column, name: str) -> Callable[[DataFrame], DataFrame]:
    """Adds `name`: level '.' hashes of the subsets at that level and the next ones ('-': no term); without
    any term in the band, '-1.' and a hash of all terms.

    What several expressions use, or a lambda uses for each of its elements, is named by a transform over
    a one-element array, so that it is computed once.
    """
    words = f"split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+')"
    everything = f"lower(hex(xxhash64(sort_array(array_distinct(transform(filter({words}, w -> w <> ''), w -> xxhash64(w)))))))"
    # The terms of the first subsets at a level; a subset at the next one is half of the one with its number here.
    first = f"filter(terms, h -> (shiftrightunsigned(h, {CLASS_BITS}) & (shiftleft(1L, level) - 1L)) < {SUBSETS})"
    own = f"filter(some, h -> (shiftrightunsigned(h, {CLASS_BITS}) & mask) = r)"
    hashes = f"transform(sequence(0L, {SUBSETS - 1}L), r -> element_at(transform(array({own}), s -> case when size(s) > 0 then lower(hex(xxhash64(s))) else '-' end), 1))"
    left = f"filter(some, h -> (shiftrightunsigned(h, {CLASS_BITS}) & mask) < {SUBSETS})"  # half as many at each level
    at_level = f"element_at(transform(array(shiftleft(1L, level + k) - 1L), mask -> element_at(transform(array({left}), some -> {hashes}), 1)), 1)"
    signed = f"""element_at(transform(array(1 + cast(floor(log2(cast(size(terms) as double))) as int)), level ->
      element_at(transform(array({first}), some -> concat(cast(level as string), '.', array_join(flatten(transform(sequence(0, {LEVELS - 1}), k -> {at_level})), '.'))), 1)), 1)"""
    whole = f"element_at(transform(_terms_in, terms -> case when size(terms) > 0 then {signed} else concat('-1.', {everything}) end), 1)"

    def add(df: DataFrame) -> DataFrame:
        banded = F.filter(F.transform(F.expr(words), lambda w: F.xxhash64(w)), lambda h: in_band(h, bits))
        terms = F.array(F.sort_array(F.array_distinct(banded)))
        return df.withColumn("_terms_in", terms).withColumn(name, F.expr(whole)).drop("_terms_in")

    return add


def in_band(h: Column, bits: Column) -> Column:
    return F.getbit(F.element_at(bits, (F.shiftright(term_class(h), 6) + 1).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def likeness(a: Column, b: Column, levels: int = 2) -> Column:
    """0 to 1; 1 for equal fingerprints; both hold so many levels."""
    pa, pb = F.split(a, r"\."), F.split(b, r"\.")
    n = F.floor((F.size(pa) - 1) / levels).cast("int")  # subsets at a level
    shift = F.element_at(pa, 1).cast("int") - F.element_at(pb, 1).cast("int")
    common = F.greatest(levels - F.abs(shift), F.lit(0)) * n
    ours = F.slice(pa, 2 + n * F.greatest(-shift, F.lit(0)), common)
    theirs = F.slice(pb, 2 + n * F.greatest(shift, F.lit(0)), common)
    pairs = F.arrays_zip(ours.alias("x"), theirs.alias("y"))
    live = F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.filter(live, lambda p: p["x"] == p["y"])
    score = F.coalesce(F.try_divide(F.size(same).cast("double"), F.size(live).cast("double")), F.lit(0.0))
    both = F.least(F.element_at(pa, 1).cast("int"), F.element_at(pb, 1).cast("int")) >= 0
    return F.when(a == b, 1.0).when(both & (F.abs(shift) < levels), score).otherwise(0.0)


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text and next_print of the row that follows by descending doc_id (after the last: the
    first), for rows (doc_id, text, print), with one exchange of the texts.

    Rows are dealt by ranges of doc_id (null: below all) whose bounds are approximate quantiles; the
    first row of each range also goes, as a guest, to the end of the range before it.  An id that is
    several bounds at once has too many rows for one range: they are dealt to as many by a hash of their
    texts, which also orders rows of one id.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(LEAST))).withColumn("tie", F.bitwise_not(F.xxhash64("text")))
    n = docs.count()
    wanted = max(1, min(65_536, 8 * shuffle_partitions(spark), n // 16))
    size = 1 << (wanted - 1).bit_length()
    shares = F.array(*[F.lit(i / size) for i in range(1, size)]) if size > 1 else F.array(F.lit(0.5))
    bounds = docs.agg(F.percentile_approx("id", shares, 10 * size)).first()[0] or []  # at most 65,535 longs
    bounds = bounds[: size - 1]
    if not bounds:
        of = F.lit(0)
    else:
        # A binary search: the number of bounds that are not above id, or that are below it.
        steps = F.array(*[F.lit(size >> i) for i in range(1, size.bit_length())])
        table = long_array(bounds)
        high = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.element_at(table, i + s) <= F.col("id"), i + s).otherwise(i))
        low = F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.element_at(table, i + s) < F.col("id"), i + s).otherwise(i))
        places = F.greatest(F.col("high") - F.col("low"), F.lit(1))
        share = F.shiftrightunsigned("tie", 33).bitwiseXOR(F.lit(1 << 30))  # in the order of tie, below 2**31
        of = F.col("high") - places + 1 + F.shiftright(share * places, 31).cast("int")
        docs = docs.withColumn("high", high).withColumn("low", low)
    placed = docs.withColumn("range", of)
    heads = {r["range"]: r["head"] for r in placed.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head")).collect()}  # one per range
    filled = sorted(heads)
    before = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    at = F.col("range") + 1
    head_id, head_tie = (F.element_at(long_array([heads[i][k] if i in heads else 0 for i in range(size)]), at) for k in (0, 1))
    guest_of = F.element_at(long_array([before.get(i, 0) for i in range(size)]), at).cast("int")
    none = F.struct(F.lit(-1).alias("range"), F.lit(True).alias("guest"))
    guest = F.when((F.col("id") == head_id) & (F.col("tie") == head_tie), F.struct(guest_of.alias("range"), F.lit(True).alias("guest"))).otherwise(none)
    places = F.filter(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), guest), lambda p: p["range"] >= 0)
    dealt = placed.withColumn("place", F.explode(places)).select("doc_id", "id", "tie", "text", "print", "place.range", "place.guest")
    order = Window.partitionBy("range").orderBy("guest", F.col("id").desc(), F.col("tie").desc(), "text")
    return dealt.select("doc_id", "text", "print", "guest", F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print")).where(~F.col("guest")).drop("guest")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third of code points replaced by the first as many (or all) of the
    next document's, by descending doc_id; after the last comes the first.  A null text counts as
    empty (n_chars 0; its edited text is empty too).  Null ids come last in the order, rows that
    repeat an id follow each other by a hash of their texts.  Columns other than doc_id and text are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bits = long_array(lexicon(rows))
    joined = with_next(fingerprint("text", bits, "print")(rows))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = joined.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    edited = fingerprint("edited", bits, "edited_print")(edited)
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), LEVELS).alias("near_edited"), likeness(F.col("print"), F.col("next_print"), LEVELS).alias("near_next"),
    )
