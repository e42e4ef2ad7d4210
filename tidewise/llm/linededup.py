"""Line dedup over overlapping windows of three lines.

Every three consecutive non-blank lines of a text are hashed (128 bits); windows that occur more than
once are found globally by a partial aggregate; every occurrence but the first, by (doc_id, place),
marks its three lines, and marks of overlapping windows merge.  What is marked goes.  A single line
of at least `long_words` words counts as a window of its own, so that a long passage which fills one
line is found whatever stands around it.  With `pairs`, so do two consecutive lines of that many words
together; the report is without them, as its SQL is.  A passage that starts or ends within a line is
beyond line windows.

Texts are not shuffled with the windows: the exchanges carry hashes, row numbers and places.  Texts
cross the network once, to meet their marks, and only where there are any is a text rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, text_or_empty

WINDOW = 3
#: SQL: non-blank lines (white space at both ends ignored) with their places, from 0.
LINES = "filter(transform(split(_text, '\\n', -1), (x, i) -> struct(i as at, trim(both ' \\t\\r' from x) as line)), x -> x.line <> '')"


def windows(rows: DataFrame, long_words: int, pairs: bool = False) -> DataFrame:
    """(row, doc_id, h1, h2, places) of every window of rows (row, doc_id, _text)."""
    lines = rows.select("row", "doc_id", F.expr(LINES).alias("lines"))

    def hashes(text: Column) -> list[Column]:
        return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(6)).alias("h2")]

    triple = F.expr("""case when size(lines) >= 3 then transform(sequence(0, size(lines) - 3), i ->
        struct(concat_ws('\\n', lines[i].line, lines[i + 1].line, lines[i + 2].line) as body, array(lines[i].at, lines[i + 1].at, lines[i + 2].at) as places))
        else array() end""")
    single = F.expr(f"transform(filter(lines, x -> length(x.line) >= {2 * long_words - 1} and size(split(x.line, '[ \\t]+')) >= {long_words}), x -> struct(x.line as body, array(x.at) as places))")
    double = F.expr(f"""case when size(lines) >= 2 then transform(filter(sequence(0, size(lines) - 2), i -> length(lines[i].line) + length(lines[i + 1].line) >= {2 * long_words - 2}
        and size(split(lines[i].line, '[ \\t]+')) + size(split(lines[i + 1].line, '[ \\t]+')) >= {long_words}),
        i -> struct(concat_ws('\\n', lines[i].line, lines[i + 1].line) as body, array(lines[i].at, lines[i + 1].at) as places)) else array() end""")
    found = lines.select("row", "doc_id", F.explode(F.concat(triple, *([double] if pairs else []), single)).alias("w"))
    return found.select("row", "doc_id", *hashes(F.col("w.body")), F.col("w.places").alias("places"))


def marked(rows: DataFrame, long_words: int, pairs: bool = False) -> DataFrame:
    """(row, places): the sorted places of the lines of each row that later occurrences cover."""
    found = windows(rows, long_words, pairs)
    key = F.struct("doc_id", "row", F.col("places")[0].alias("place"), F.size("places").alias("n"))
    found = found.select("row", F.struct("h1", "h2").alias("window"), "places", key.alias("key"))
    repeated = found.groupBy(F.col("window.h1"), F.col("window.h2")).agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Keyed by a struct, both sides are dealt anew for the join, so that a very common window can be split.
    repeated = repeated.select(F.struct("h1", "h2").alias("window"), "first")
    later = found.join(repeated, "window").where(~F.col("key").eqNullSafe(F.col("first")))
    return later.select("row", F.explode("places").alias("place")).groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, long_words: int = 50, pairs: bool = False) -> DataFrame:
    """docs, every column kept, with the marked lines taken out of text, and _lines and _removed, the
    numbers of lines it had and lost.

    The first occurrence is the one of the smallest (doc_id, row, place); null ids come first.  Lines
    compare without white space at their ends; blank lines never count and stay.  A null text has no
    lines and stays null; a text may become empty.  Rows that repeat lose what the first of them
    keeps.  An empty table gives an empty result.
    """
    rows = numbered(docs, "_row")
    base = rows.select(F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    marks = checkpointed(marked(base, long_words, pairs).withColumnRenamed("row", "_row").withColumnRenamed("places", "_places"))
    joined = rows.join(marks.hint("shuffle_hash"), "_row", "left")
    lines = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))
    kept = F.expr("array_join(transform(_kept, i -> _split[i]), '\n')")
    out = joined.withColumn("_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("_removed", F.coalesce(F.size("_places"), F.lit(0)))
    out = out.withColumn("_split", F.when(F.col("_places").isNotNull(), lines)).withColumn("_kept", F.when(F.col("_places").isNotNull(), places))
    return out.withColumn("text", F.when(F.col("_kept").isNotNull(), kept).otherwise(F.col("text"))).drop("_row", "_places", "_split", "_kept")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of the text that is left, for every row of docs."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long"), F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs})
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows AS (
  SELECT a.doc_id, a.pos AS place, 3 AS n, a.line || chr(10) || b.line || chr(10) || c.line AS body, [a.pos, b.pos, c.pos] AS places
  FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.rn = a.rn + 1 JOIN lines c ON c.doc_id = a.doc_id AND c.rn = a.rn + 2
  UNION ALL
  SELECT doc_id, pos, 1, line, [pos] FROM lines WHERE len(string_split_regex(line, '[ \t]+')) >= 50
), occurrences AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, place, n) AS seen FROM windows
), marks AS (
  SELECT DISTINCT doc_id, unnest(places) AS pos FROM occurrences WHERE seen > 1
), cut AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}) l
  ANTI JOIN marks USING (doc_id, pos)
  GROUP BY doc_id
)"""
REPORT_SQL = f"""
WITH {LINES_SQL.replace("{docs}", "documents")}
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
       coalesce(m.n, 0) AS n_removed, sha256(coalesce(c.text, '')) AS kept_sha256
FROM documents d LEFT JOIN cut c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM marks GROUP BY doc_id) m USING (doc_id)
"""
