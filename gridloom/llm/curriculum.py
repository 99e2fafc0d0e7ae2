"""Mixing sources to target weights along a time-varying curriculum.

Main path: DataFrame functions only.

Each source has a weight curve over training time 0..1, linear between knots. A source's target divides its
curve's integral, so demand(t) = target * integral(0..t) / integral(0..1). Documents of a source stand in a
fixed pseudo-random order; the words before a document are a demand, and the curve's inverse gives the time at
which training reaches it. Sorting by that time interleaves the sources as their curves say.

Running sums over a source are taken in two or more levels of hash buckets (about ``BUCKET_ROWS`` rows each), so a
source that holds most documents is spread over all tasks.

Edge cases: a null text has no words; the null source is a source of its own, last in order; documents without
words are taken 0 words (copies 1: they cost nothing); null and repeated ids stand by their texts' hashes like any other;
repeated rows are documents of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, lookup, prefix_sums, row_key, shuffle_partitions

#: Rows that a bucket holds on average; a bucket is the unit of the row-level window.
BUCKET_ROWS = 1024
#: Weights by a source's place in code point order, repeating; share of all words that the mix takes; cap on reuse.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Knots (time, relative weight) of the curves, by a source's place, repeating: level, fading out, fading in.
CURVES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t..\\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(id_col: Column, text: Column) -> Column:
    """A 60-bit pseudo-random number of the id and the text, so that rows that share an id, or have none, are spread too."""
    named = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, curves=CURVES) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target and curve.

    The places of sources come from a range sort with per-partition offsets, and the sharing is one aggregate a
    round: sources whose share exceeds ``cap`` times their size stop there and the rest is shared again.
    """
    ordered = sizes.repartitionByRange(shuffle_partitions(sizes), F.col("source").asc_nulls_last())
    ordered = cut(ordered.withColumn("__pid", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ordered.groupBy("__pid").count().collect()}  # a row for each partition
    start, offsets = 0, []
    for pid in sorted(counts):
        offsets += [F.lit(pid), F.lit(start)]
        start += counts[pid]
    w = Window.partitionBy("__pid").orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(w) - 1 + (F.element_at(F.create_map(*offsets), F.col("__pid")) if offsets else F.lit(0))
    pick = lambda values: F.element_at(F.array(*values), (F.col("__place") % len(values) + 1).cast("int"))
    knots = [F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(v)).alias("w")) for t, v in c]) for c in curves]
    planned = cut(
        ordered.withColumn("__place", place)
        .withColumn("__weight", pick([F.lit(float(x)) for x in weights]))
        .withColumn("__knots", pick(knots))
        .drop("__pid")
    )
    total = planned.agg(F.sum("source_size")).first()[0] or 0
    room, level = share * total, -1.0
    while True:
        stopped = F.col("__weight") * level > cap * F.col("source_size") if level >= 0 else F.lit(False)
        r = planned.agg(F.sum(F.when(stopped, cap * F.col("source_size"))), F.sum(F.when(~stopped, F.col("__weight")))).first()
        fixed, weight = r[0] or 0.0, r[1] or 0.0
        now = (room - fixed) / weight if weight else math.inf
        if now <= level or not weight:
            break
        level = now
    target = F.least(F.col("__weight") * level, cap * F.col("source_size")) if level >= 0 else cap * F.col("source_size")
    return planned.withColumn("target", target.cast("double")).drop("__weight", "__place")


def curve_inverse(knots: Column, share: Column) -> Column:
    """The time at which ``share`` (0..1) of the area under the piecewise linear curve has passed."""
    pairs = F.zip_with(F.slice(knots, 1, F.size(knots) - 1), F.slice(knots, 2, F.size(knots) - 1), lambda a, b: F.struct(a.t.alias("t"), a.w.alias("w"), (b.t - a.t).alias("dt"), ((b.w - a.w) / (b.t - a.t)).alias("slope"), ((a.w + b.w) / 2 * (b.t - a.t)).alias("area")))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x.area)
    start = F.struct(F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("at"))

    def step(state, seg):
        need = share * total - state.before
        at = seg.t + 2 * need / (seg.w + F.sqrt(F.greatest(seg.w * seg.w + 2 * seg.slope * need, F.lit(0.0))))
        inside = state["at"].isNull() & (need <= seg.area)
        return F.struct((state.before + seg.area).alias("before"), F.when(inside, at).otherwise(state["at"]).alias("at"))

    return F.least(F.coalesce(F.aggregate(pairs, start, step, lambda s: s["at"]), F.element_at(knots, -1).t), F.element_at(knots, -1).t)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, curves=CURVES) -> DataFrame:
    """One row for each document: ``id_col``, size, source_size, target, taken, position (of its first use), again
    (of its second pass), range-sorted by position; documents that the mix leaves out come last."""
    out = _plan(docs, id_col, text_col, source_col, weights, share, cap, curves)
    out = out.select(F.col("__id").alias(id_col), "size", "source_size", "target", "taken", "position", "again")
    return out.orderBy(F.col("position").asc_nulls_last(), id_col)


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, curves=CURVES, key_of_row: Column | None = None) -> DataFrame:
    """The rows of :func:`mix` in no order, the id as __id; with ``key_of_row`` that value stands for the id."""
    text = F.col(text_col).cast("string")
    named = F.col(id_col) if key_of_row is None else key_of_row
    base = docs.select(named.alias("__id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), order_key(F.col(id_col), text).alias("__u"))
    base = cut(base)
    n = base.count()
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS, min(n / 16, 4 * shuffle_partitions(base))))))
    base = base.withColumn("__bucket", F.shiftright(F.col("__u"), 60 - bits))
    buckets = cut(base.groupBy("source", "__bucket").agg(F.sum("size").alias("__words")))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, cap, curves)

    # Key columns without nulls, so that a plain equality join finds the null source.
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    starts = prefix_sums(buckets, ["source"], "__bucket", "__words", "__start", bits)
    starts = starts.select(F.struct(key.alias("s"), F.col("__bucket").alias("b")).alias("__sb"), "__start")
    keyed = base.withColumn("__sb", F.struct(key.alias("s"), F.col("__bucket").alias("b")))
    w = Window.partitionBy("__sb").orderBy("__u", F.col("__id").asc_nulls_first(), "size")
    keyed = keyed.withColumn("__within", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = keyed.join(starts, "__sb").withColumn("__before", F.col("__start") + F.col("__within"))
    placed = placed.withColumn("__key", key).select("__key", "__id", "size", "__before")
    by_source = targets.select(key.alias("__key"), "source_size", "target", "__knots")
    placed = cut(placed)
    hot = hot_keys(placed, "__key", n)
    placed = lookup(placed, by_source, "__key", [F.struct(F.lit(k["n"]).alias("n"), F.lit(k["s"]).alias("s")) for k in hot], "inner")
    goal = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - passes * F.col("source_size") - F.col("__before")
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size")))
    at = lambda words: F.when(F.col("target") > 0, curve_inverse(F.col("__knots"), F.least(words / F.col("target"), F.lit(1.0))))
    out = placed.withColumn("taken", taken.cast("long"))
    out = out.withColumn("position", F.when((F.col("taken") > 0) | (F.col("size") == 0), at(F.col("__before"))))
    out = out.withColumn("again", F.when(F.col("taken") > F.col("size"), at(F.col("__before") + F.col("source_size"))))
    return out


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents that the mix takes, all columns, a row for each whole use.

    A document is used round(taken / size) times; one without words once. Rows are matched to the plan by a hash of id,
    source and text; rows that agree in all three are used as often together as the plan says of them together, and what
    other columns of theirs hold is taken from one of them.
    """
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    key = row_key(F.col(id_col), F.concat(F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    plan = _plan(docs, id_col, text_col, source_col, **options, key_of_row=key)
    uses = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("long")
    plan = cut(plan.groupBy(F.col("__id").alias(name)).agg(F.sum(uses).alias("__uses"), F.count(F.lit(1)).alias("__n")).filter("__uses > 0"))
    keyed = docs.withColumn(name, key)
    out = keyed.join(plan.filter("__n = 1").select(name, "__uses"), name)
    again = plan.filter("__n > 1").select(name, "__uses")
    if not again.isEmpty():
        once = keyed.join(again.select(name), name, "left_semi").dropDuplicates([name])
        out = out.unionByName(once.join(again, name))
    return out.withColumn("__use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__uses")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS u FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(place % 3 + 1)::INT]::DOUBLE AS weight, [1.0, 1.5, 0.5][(place % 3 + 1)::INT]::DOUBLE AS a, [0.0, -1.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS slope FROM s
), r AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER o, 0)::DOUBLE AS fixed, coalesce(sum(weight) OVER o, 0)::DOUBLE AS used, 1.5::DOUBLE * sum(source_size) OVER () AS room, sum(weight) OVER ()::DOUBLE AS weights
  FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (room - fixed) / (weights - used) AS level FROM r WHERE (room - fixed) / (weights - used) <= 2.0 * source_size / weight
  ORDER BY 2.0 * source_size / weight, place LIMIT 1
), t AS (
  SELECT w.*, least(weight * level, 2.0::DOUBLE * source_size)::DOUBLE AS target FROM w, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.slope, floor(t.target)::BIGINT AS goal,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p
), q AS (
  SELECT *, (passes * size + greatest(0, least(goal - passes * source_size - before, size)))::BIGINT AS taken, least(before / target, 1.0) AS y FROM k
)
SELECT doc_id, size, source_size, target, taken,
       round(CASE WHEN target > 0 AND (taken > 0 OR size = 0) THEN least(2 * y / (a + sqrt(greatest(a * a + 2 * slope * y, 0.0))), 1.0) END, 6) AS position
FROM q
"""
