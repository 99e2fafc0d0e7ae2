"""Shared pieces: skew-proof lookups, row keys, bounded prefix sums. Lineage is cut as everywhere in the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut, ready, shuffle_partitions, table

__all__ = ["cut", "hot_keys", "lookup", "lower_ascii", "prefix_sums", "ready", "row_key", "shuffle_partitions", "table", "without_rows"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 512


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def row_key(id_col: Column | str, text: Column | str) -> Column:
    """128 bits that name a row's id and text together; rows with the same key are copies of each other in both."""
    number, text = (F.col(c) if isinstance(c, str) else c for c in (id_col, text))
    return F.unhex(F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("-")), F.when(text.isNull(), F.lit("n")).otherwise(F.lit(":")), F.coalesce(text, F.lit("")))))


def without_rows(docs: DataFrame, key: Column, verdict: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``verdict`` (row_key, stays, n) sends away: those whose row_key does not
    stay, and all but one of the n rows with a row_key that does. Row keys of which the only row stays need not be listed."""
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, key)
    out = keyed.join(verdict.select(F.col("row_key").alias(name)), name, "left_anti")
    again = verdict.filter("stays AND n > 1").select(F.col("row_key").alias(name))
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, name, "left_semi").dropDuplicates([name]))
    return out.drop(name).select(*[F.col(f"`{c}`") for c in docs.columns])


def hot_keys(df: DataFrame, key: str, total: int | None = None, share: int = HOT_SHARE) -> list:
    """The keys of ``df`` that hold more than 1/share of its rows: fewer than ``share`` values.

    The counts are combined before the shuffle, so a hot key costs one row from each task.
    """
    total = df.count() if total is None else total
    if not total:
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return [r[0] for r in counts.filter((F.col("__n") > total / share) & F.col(key).isNotNull()).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right``, which has one row a key, without meeting a hot key in one task.

    Rows of hot keys (fewer than HOT_SHARE keys, found by :func:`hot_keys`) are joined where they lie
    against a broadcast of those keys' right rows alone; the others by a shuffle on the key.
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how)
    far = left.filter(~is_hot).join(right.filter(~F.col(key).isin(hot)), key, how)
    return near.unionByName(far)


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, value: str, out: str, bits: int, step: int = 10) -> DataFrame:
    """Exclusive running sum of ``value`` over the integer ``bucket`` (``bits`` wide) within ``keys``.

    ``df`` has one row for each (keys, bucket). Beyond 2**12 buckets the sum is taken level by level,
    so no window holds more than 2**12 rows however many buckets a key has.
    """
    if bits <= 12:
        w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    top = f"__top{bits}"
    df = df.withColumn(top, F.shiftright(F.col(bucket), step))
    coarse = df.groupBy(*keys, top).agg(F.sum(value).alias(value))
    coarse = prefix_sums(coarse, keys, top, value, "__before", bits - step, step).select(*keys, top, "__before")
    w = Window.partitionBy(*keys, top).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__within", F.coalesce(F.sum(value).over(w), F.lit(0)))
    same = [inner[k].eqNullSafe(coarse[k]) for k in (*keys, top)]
    joined = inner.join(coarse, same, "left").select(*[inner[c] for c in inner.columns], coarse["__before"])
    return joined.withColumn(out, F.col("__before") + F.col("__within")).drop("__before", "__within", top)
