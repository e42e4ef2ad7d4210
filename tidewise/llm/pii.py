"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay.  High-recall
generators propose further, overlapping spans: written-out addresses, colon-separated hexadecimal
groups and grouped digits, none of them with a letter or digit glued to either end.  Boosted trees
score them by their format and context; a span is added if its score reaches the threshold calibrated
for its generator and it overlaps no base span.  Of candidates that overlap each other, read from the
left, the one with the higher score stays.

Spans are read off a text in order by folds in chunks (`fold`), so that the work grows with the number
of matches, not with its square.

The trees are fitted when the operator starts, on spans of generated sentences (`examples`) that run
through the same generators and features; half of them calibrate the thresholds.  They become one SQL
expression, so documents are scanned once, without any exchange and without Python.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
# A greedy run is possessive where nothing after it could give back, and a match starts where its
# first run does, or right after the last match: else long runs cost quadratic time or the stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
GENERATORS = {
    "email": (r"@|\((?:at|AT)\)|\[(?:at|AT)\]", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\((?:at|AT)\)|\[(?:at|AT)\]) ?[A-Za-z0-9-]++(?:(?:\.| ?\((?:dot|DOT)\) ?| ?\[(?:dot|DOT)\] ?)[A-Za-z0-9-]++){0,8}+(?![A-Za-z0-9_@])"),
    "ip": (r":[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Za-z_:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z_:])"),
    "number": (r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}", r"(?<![0-9A-Za-z_])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z_])"),
}

LUHN = """aggregate(split(concat(
  translate(regexp_replace(lpad({d}, 20, '0'), '(.)(.)', '$1'), '0123456789', '0246813579'),
  regexp_replace(lpad({d}, 20, '0'), '(.)(.)', '$2')), ''), 0, (a, x) -> a + coalesce(try_cast(x as int), 0)) % 10 = 0"""
DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
#: Numbers by name; c is a candidate (m, before, after, generator).
FEATURES = {
    "generator": "c.generator",
    "length": "length(c.m)",
    "digits": f"length({DIGITS})",
    "letters": "length(regexp_replace(c.m, '[^A-Za-z]', ''))",
    "groups": "size(split(c.m, '[^0-9A-Za-z]+'))",
    "colons": "size(split(c.m, ':'))",
    "first": "case when c.m rlike '^[(]' then 2 when c.m rlike '^0' then 1 else 0 end",
    "luhn": f"case when length({DIGITS}) between 13 and 19 then int({LUHN.format(d=DIGITS)}) else -1 end",
    "dots": "length(regexp_replace(c.m, '[^.]', ''))",
    "slashes": "length(regexp_replace(c.m, '[^/]', ''))",
    "says_phone": "int(c.before rlike '(?:tel|phone|call|fax|mobil|cell|whatsapp|sms|handy|ruf|número|numéro)')",
    "says_card": "int(c.before rlike '(?:card|visa|credit|mastercard|amex|payment|karte|carte|tarjeta)')",
    "says_mail": "int(c.before rlike '(?:mail|contact|write|reach)')",
    "says_host": "int(c.before rlike '(?:ip|host|addr|server|client|from)')",
    "says_number": "int(c.before rlike '(?:order|invoice|id|no\\\\.|isbn|version|ref|serial|page|token|hash|sha|row|key|code|number|nr|line|build|commit|bestellung|factura|commande)[^a-z]*$')",
    "glued_before": "int(c.before rlike '[a-z0-9#$€£_/.-]$')",
    "glued_after": "int(c.after rlike '^[A-Za-z0-9%_]')",
    "national": "int(c.m rlike '^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$')",
    "pairs": "int(c.m rlike '^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+$')",
    "decimal": "int(c.m rlike '^[0-9]+[.][0-9]+$')",
    "run": "int(c.m rlike '^[0-9]+$')",
    "dated": "int(c.m rlike '^(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]|^[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}(?![0-9])')",
    "domain": "int(c.m rlike '(?:[.]|[(]dot[)]|[\\\\[]dot[]]) ?[A-Za-z]{2,6}$')",
    "fours": "int(c.m rlike '^[0-9]{4}[ .-]{1,2}[0-9]{4}[ .-]{1,2}[0-9]{4}[ .-]{1,2}[0-9]{4}$')",
}
PRECISION = 0.99


SPAN = "struct<start:int,end:int,m:string,before:string,after:string>"


def quoted(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


CHUNK = 256


def fold(items: str, state: str, step: str, kind: str) -> str:
    """SQL: the array<kind> of what a fold over the array `items` (x: the item, s: the state so far) gives
    out; `step` is a struct of the new state and `out`, an array.

    Results are gathered in chunks, so that what is copied to append them is small beside the rest.
    """
    none = f"cast(array() as array<{kind}>)"
    inner = f"aggregate(slice(items, k * {CHUNK} + 1, {CHUNK}), struct(acc.s as s, {none} as out), (a, x) -> element_at(transform(array(struct(a.s as s)), b -> element_at(transform(array({step.replace('s.', 'b.s.')}), r -> struct(r.s as s, concat(a.out, r.out) as out)), 1)), 1))"
    return f"""element_at(transform(array({items}), items -> case when size(items) > 0 then aggregate(sequence(0, int((size(items) - 1) / {CHUNK})), struct({state} as s, {none} as out),
      (acc, k) -> element_at(transform(array({inner}), c -> struct(c.s as s, concat(acc.out, c.out) as out)), 1), acc -> acc.out) else {none} end), 1)"""


def matches(text: str, pattern: str) -> str:
    """SQL: leftmost non-overlapping matches as SPAN, in code points, with what stands around them."""
    gaps, found = f"split({text}, {quoted(pattern)}, -1)", f"regexp_extract_all({text}, {quoted(pattern)}, 0)"
    # One-element arrays name a value, so that it is computed once for all that use it.
    zipped = "transform(p.f, (m, i) -> struct(m, length(m) as size, length(p.g[i]) as gap, lower(right(p.g[i], 24)) as before, left(p.g[i + 1], 1) as after))"
    step = "struct(struct(s.at + x.gap + x.size as at) as s, array(struct(s.at + x.gap as start, s.at + x.gap + x.size as end, x.m as m, x.before as before, x.after as after)) as out)"
    return f"element_at(transform(array(struct({gaps} as g, {found} as f)), p -> {fold(zipped, 'struct(0 as at)', step, SPAN)}), 1)"


def guarded(text: str, may: str, pattern: str) -> str:
    """SQL: the matches, or none at once where a cheap look finds no sign of any."""
    seen = f"contains({text}, {quoted(may)})" if len(may) == 1 else f"{text} rlike {quoted(may)}"
    return f"""case when {seen} then element_at(transform(array(regexp_count({text}, {quoted(pattern)})), n ->
      case when n > 0 then {matches(text, pattern)} else cast(array() as array<{SPAN}>) end), 1) else cast(array() as array<{SPAN}>) end"""


def valid(kind: str) -> str:
    """The check that a base match must pass, as SQL on c.m."""
    return {
        "email": "true",
        "ip": f"c.m rlike '^{BYTE}(?:[.]{BYTE}){{3}}$'",
        "card": f"case when length({DIGITS}) between 14 and 19 then {LUHN.format(d=DIGITS)} else false end",
        "phone": f"length({DIGITS}) between 10 and 15",
    }[kind]


def base_spans(text: str) -> str:
    """SQL: all valid base spans (start, ord, end), sorted; ord is the kind's place in KINDS."""
    parts = [f"transform(filter({guarded(text, MAY[kind], BASE[kind])}, c -> {valid(kind)}), c -> struct(c.start as start, {i} as ord, c.end as end))" for i, kind in enumerate(KINDS)]
    return f"sort_array(concat({', '.join(parts)}))"


def candidates(text: str) -> str:
    """SQL: the generators' spans with generator, ord and features x."""
    parts = [f"transform({guarded(text, may, pattern)}, c -> named_struct('start', c.start, 'end', c.end, 'm', c.m, 'before', c.before, 'after', c.after, 'generator', {i}))" for i, (may, pattern) in enumerate(GENERATORS.values())]
    kind = f"case c.generator when 0 then 0 when 1 then 1 else case when length({DIGITS}) >= 13 then 2 else 3 end end"
    numbers = ", ".join(f"cast({e} as double)" for e in FEATURES.values())
    return f"transform(concat({', '.join(parts)}), c -> struct(c.start as start, {kind} as ord, c.end as end, c.generator as generator, array({numbers}) as x))"


CANDIDATE = "struct<start:int,ord:int,end:int,generator:int,x:array<double>>"
PLAIN = "struct(s.start as start, s.ord as ord, s.end as end)"


def clear_of(spans: str, base: str) -> str:
    """SQL: the spans that overlap none of base.  One pass from the left knows how far base spans that
    start before reach, one from the right where the next one starts."""
    none = "cast(null as " + CANDIDATE + ")"
    merged = "sort_array(concat(transform({base}, b -> struct({sign}b.start as at, 0 as candidate, {edge} as edge, {none} as c)), transform({spans}, c -> struct({sign}c.start as at, 1 as candidate, 0 as edge, c as c))))"
    left = fold(merged.format(base=base, spans=spans, sign="", edge="b.end", none=none), "struct(0 as edge)", "struct(struct(case when x.candidate = 0 then greatest(s.edge, x.edge) else s.edge end as edge) as s, filter(array(x.c), c -> c is not null and c.start >= s.edge) as out)", CANDIDATE)
    right = fold(merged.format(base=base, spans="spans", sign="-", edge="b.start", none=none), "struct(2147483647 as edge)", "struct(struct(case when x.candidate = 0 then x.edge else s.edge end as edge) as s, filter(array(x.c), c -> c is not null and c.end <= s.edge) as out)", CANDIDATE)
    return f"element_at(transform(array({left}), spans -> {right}), 1)"


def best_of(spans: str) -> str:
    """SQL: of the sorted spans that overlap, read from the left, the one with the higher score (the
    earlier of equal ones), as (start, ord, end)."""
    kind = "struct<start:int,ord:int,end:int>"
    last = "struct(2147483647 as start, 0 as ord, 2147483647 as end, 0 as generator, 0D as score)"
    x = "struct(x.start as start, x.ord as ord, x.end as end, x.score as score)"
    held = "struct(s.start as start, s.ord as ord, s.end as end)"
    step = f"struct(case when s.end is null or s.end <= x.start or s.score < x.score then {x} else struct(s.start as start, s.ord as ord, s.end as end, s.score as score) end as s, case when s.end <= x.start then array({held}) else cast(array() as array<{kind}>) end as out)"
    state = "struct(cast(null as int) as start, cast(null as int) as ord, cast(null as int) as end, cast(null as double) as score)"
    return fold(f"concat({spans}, array({last}))", state, step, kind)


def examples(n: int = 6000, seed: int = 1) -> list[tuple[str, int]]:
    """Generated sentences with one candidate each, and whether it is personal data."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = "the of and report total from with page section over value list item table result about after entry".split()

    def filler() -> str:
        return " ".join(pick(words) for _ in range(rng.randint(2, 6)))

    def luhn(k: int) -> str:
        body = pick("3456") + digits(k - 2)
        s = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(body)))
        return body + str(-s % 10)

    def grouped(s: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(x for x in [*out, s[at:]] if x)

    def name() -> str:
        return "".join(pick("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))

    out = []
    for i in range(n):
        good = i % 2 == 0
        what = rng.randrange(4)
        if what == 0 and good:
            at, dot = pick([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), ("(AT)", "(DOT)"), ("@", "(dot)")])
            text = f"{pick(['mail', 'contact', 'write to', ''])} {name()}{pick(['.', '_', ''])}{name()}{at}{name()}{dot}{pick(['com', 'org', 'net', 'de', 'io'])}"
        elif what == 0:
            text = pick([f"{name()}@{digits(rng.randint(1, 3))}", f"{name()} (at) {name()}", f"{digits(1)}@{digits(2)}", f"{name()}@{name()}", f"{name()} [at] {digits(2)}", f"@{name()}", f"a @ b.{name()}", f"{name()} @ {name()}", f"{digits(3)}@{digits(2)}.{digits(2)}", f"{name()} (at) the.{name()}"])
        elif what == 1 and good:
            text = f"{pick(['host', 'ip', 'from', 'server', ''])} " + ":".join("".join(pick("0123456789abcdef") for _ in range(rng.randint(1, 4))) for _ in range(8)) if rng.random() < 0.6 else f"{pick(['addr', 'from', ''])} 2001:db8:{digits(2)}::{digits(1)}"
        elif what == 1:
            text = pick([f"{digits(2)}:{digits(2)}:{digits(2)}", f"a::b::{digits(1)}", f"{digits(1)}:{digits(1)}:{digits(1)}", f"at {digits(2)}:{digits(2)}:{digits(2)}:{digits(3)}", f"{digits(1)}::{digits(2)}", "::".join(["", pick("abcdef")]), ":".join(digits(2) for _ in range(6)), ":".join("".join(pick("0123456789abcdef") for _ in range(2)) for _ in range(rng.choice([5, 7, 8])))])
        elif what == 2 and good:
            text = f"{pick(['card', 'visa', 'credit card no', 'payment', ''])} {grouped(luhn(16), [4, 4, 4], pick(['.', '/', '  ', ' - ']))}"
        elif what == 2:
            text = pick([f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"serial {digits(16)}", f"order no. {digits(14)}", f"{digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}",
                f"0.{digits(rng.randint(13, 17))}", f"{digits(rng.randint(13, 19))}", f"key {luhn(16)}", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)} {digits(2)}.{digits(2)}.{digits(2)} {digits(3)}", f"{digits(8)}-{digits(4)}-{digits(4)}-{digits(4)}-{digits(12)}"])
        elif good:
            text = f"{pick(['tel', 'phone', 'call', 'fax:', 'mobile', '', ''])} " + pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)}/{digits(6)}"])
        else:
            text = pick([f"{pick(['19', '20'])}{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/20{digits(2)}", f"invoice {digits(9)}", f"{digits(3)} {digits(2)} {digits(3)}", f"version {digits(1)}.{digits(2)}.{digits(2)}.{digits(3)}", f"#{digits(8)}", f"{digits(10)}", f"ref {digits(4)}-{digits(4)}", f"{digits(2)}.{digits(2)}.19{digits(2)}", f"${digits(4)}.{digits(3)}.{digits(2)}",
                f"{digits(1)}.{digits(rng.randint(7, 15))}", f"x = {digits(rng.randint(7, 12))}", f"rows: {digits(rng.randint(7, 12))}", f"{digits(2)}:{digits(2)}:{digits(2)}.{digits(7)}", f"20{digits(2)}0{digits(1)}1{digits(1)}", f"20{digits(2)}{pick('-/.')}0{digits(1)}{pick('-/.')}1{digits(1)} {digits(2)}:{digits(2)}",
                f"({digits(3)}, {digits(3)}) ({digits(4)})({digits(4)})", f"{digits(4)}-{digits(4)}", f"pp. {digits(4)}-{digits(4)}", f"id={digits(rng.randint(8, 14))}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)}", f"{digits(5)} {digits(5)}", f"{digits(5)}/{digits(5)}"])
        out.append((f"{filler()} {text} {filler()}", int(good)))
    return out


def fitted(spark: SparkSession) -> tuple[gbt.Trees, list[float]]:
    """The trees, and for each generator the least score at which the held-out half of the examples
    has the wanted precision."""
    made = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(examples())], "i int, text string, y int")
    rows = made.select("i", "y", F.explode(F.expr(candidates("text"))).alias("c")).select("i", "y", "c.generator", "c.x").toPandas()
    x, y, half = np.array(rows["x"].tolist()), rows["y"].to_numpy(float), rows["i"].to_numpy() // 2 % 2 == 0
    trees = gbt.fit(x[half], y[half], trees=40, depth=3, rate=0.3, least=5)
    scores = trees.margin(x)
    least = []
    for g in range(len(GENERATORS)):
        own = ~half & (rows["generator"].to_numpy() == g)
        order = np.argsort(-scores[own], kind="stable")
        s, hit = scores[own][order], y[own][order]
        precision = np.cumsum(hit) / np.arange(1, len(hit) + 1)
        last = np.r_[s[1:] != s[:-1], True][: len(s)]
        fine = np.flatnonzero((precision >= PRECISION) & last)
        least.append(float(s[fine[-1]]) - 1e-9 if len(fine) else float("inf"))
    return trees, least


def margin_sql(trees: gbt.Trees, x: str) -> str:
    """The trees' summed margin as one SQL expression over the array x."""

    def node(i: int) -> str:
        if trees.left[i] == i:
            return f"{trees.value[i]!r}D".replace("np.float64(", "").replace(")", "")
        return f"case when {x}[{trees.feature[i]}] <= {float(trees.threshold[i])!r}D then {node(trees.left[i])} else {node(trees.right[i])} end"

    return " + ".join([f"{trees.base!r}D", *(node(r) for r in trees.roots)])


def joined(spans: str) -> str:
    names = "array(" + ", ".join(map(quoted, KINDS)) + ")"
    return f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.ord], s.start, s.end)), ',')"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added for every row of docs.

    The counts and base_sha256 are of base spans; `spans` also has the added ones.  Offsets are code
    points from 0, ends exclusive; spans are sorted by start, then kind, and of the same kind by end.
    A null text counts as empty (no spans); null ids and repeated rows give rows of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    trees, least = fitted(docs.sparkSession)
    limits = "case s.generator " + " ".join(f"when {g} then {v!r}D" if np.isfinite(v) else f"when {g} then double('inf')" for g, v in enumerate(least)) + " end"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.expr(base_spans("text")).alias("base"), F.expr(candidates("text")).alias("proposed"))
    rows = rows.select("doc_id", "base", F.expr(f"case when size(proposed) > 0 then {clear_of('proposed', 'base')} else proposed end").alias("free"))
    scored = f"transform(free, c -> struct(c.start as start, c.ord as ord, c.end as end, c.generator as generator, {margin_sql(trees, 'c.x')} as score))"
    rows = rows.select("doc_id", "base", F.expr(f"array_sort(filter({scored}, s -> s.score >= {limits}))").alias("accepted"))
    rows = rows.select("doc_id", "base", F.expr(f"case when size(accepted) > 1 then {best_of('accepted')} else transform(accepted, s -> {PLAIN}) end").alias("added"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.ord = {i})) as long)").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("sort_array(concat(base, added))")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `find_pii` in text replaced by [KIND]; ids must be unique."""
    found = find_pii(docs).select("doc_id", "spans")
    parts = """aggregate(filter(split(spans, ','), s -> s <> ''), struct(0 as at, '' as out), (a, s) ->
      case when int(split(s, ':')[1]) < a.at then struct(greatest(a.at, int(split(s, ':')[2])) as at, a.out as out)
      else struct(int(split(s, ':')[2]) as at, concat(a.out, substring(text, a.at + 1, int(split(s, ':')[1]) - a.at), '[', upper(split(s, ':')[0]), ']') as out) end,
      a -> concat(a.out, substring(text, a.at + 1)))"""
    return docs.join(found, "doc_id").withColumn("text", F.expr(parts)).drop("spans")
