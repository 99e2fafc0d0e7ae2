"""Differential comparison of two sets of cells: outer joins by position and conditional counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import schema
from gridloom.functions.formula import without_spaces
from gridloom.operators.store import last_wins

VALUES = ["t", "vn", "vs", "vb", "d", "f", "fmt"]


@F.pandas_udf(T.StringType())
def _squeeze(texts: pd.Series) -> pd.Series:
    return texts.map(without_spaces, na_action="ignore")


def squeezed(f: Column) -> Column:
    """White space outside quotes and brackets removed. Texts without either need no function of ours."""
    plain = ~f.rlike(r"[\"'\[]")
    return F.when(plain, F.regexp_replace(f, r"\s+", "")).otherwise(_squeeze(F.when(~plain, f)))


def paired(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Full outer join by position: columns a_* and b_*, ``in_a`` and ``in_b``. With ``order``, duplicates are last-wins first."""
    keys, sides = keys or schema.key(a, b), []
    for df, p in ((a, "a_"), (b, "b_")):
        df = last_wins(df, keys, order) if order else df
        own = [c for c in VALUES if c in df.columns]
        sides.append(df.select(*keys, F.lit(True).alias(f"in_{p[0]}"), *[F.col(c).alias(p + c) for c in own]))
    joined = sides[0].join(sides[1], keys, "full_outer")
    return joined.withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn("in_b", F.coalesce("in_b", F.lit(False)))


def value_match() -> Column:
    return F.col("in_a") & F.col("in_b") & schema.same_value("a_", "b_")


def compare(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of one pass: cells and matches of values, displays (where both have one), formula texts and cached results
    (where either has a formula), and how many cells of each side have a display."""
    both_d = F.col("a_d").isNotNull() & F.col("b_d").isNotNull()
    any_f = F.col("a_f").isNotNull() | F.col("b_f").isNotNull()
    same_f = squeezed(F.col("a_f")).eqNullSafe(squeezed(F.col("b_f")))
    hit = F.coalesce(value_match(), F.lit(False))
    counts = {
        "cells": F.count(F.lit(1)),
        "value_matched": F.count_if(hit),
        "display_total": F.count_if(both_d),
        "display_matched": F.count_if(both_d & (F.col("a_d") == F.col("b_d"))),
        "formula_total": F.count_if(any_f),
        "formula_matched": F.count_if(any_f & same_f),
        "cached_matched": F.count_if(any_f & hit),
        "a_cells": F.count_if("in_a"),
        "b_cells": F.count_if("in_b"),
        "a_covered": F.count("a_d"),
        "b_covered": F.count("b_d"),
    }
    return pairs.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in counts.items()])


def mismatch_buckets(pairs: DataFrame) -> DataFrame:
    """(bucket, n): unequal cells by their pair of types, "-" for a side without the cell."""
    kind = F.concat_ws("/", F.coalesce("a_t", F.lit("-")), F.coalesce("b_t", F.lit("-")))
    return pairs.filter(~F.coalesce(value_match(), F.lit(False))).groupBy(kind.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def display_buckets(pairs: DataFrame) -> DataFrame:
    """(fmt, n): cells that both sides display, but not alike, by the format code of the second, "General" without one."""
    both = F.col("a_d").isNotNull() & F.col("b_d").isNotNull()
    return pairs.filter(both & (F.col("a_d") != F.col("b_d"))).groupBy(F.coalesce("b_fmt", F.lit("General")).alias("fmt")).agg(F.count(F.lit(1)).alias("n"))


def format_metrics(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(fmt, cells, covered, display_total, display_matched) of the cells of ``b`` that have a format, left-joined to ``a``."""
    keys = keys or schema.key(a, b)
    left = b.filter("fmt IS NOT NULL").select(*keys, "fmt", F.col("d").alias("bd"))
    joined = left.join(a.select(*keys, F.col("d").alias("ad")), keys, "left")
    both = F.col("ad").isNotNull() & F.col("bd").isNotNull()
    return joined.groupBy("fmt").agg(
        F.count(F.lit(1)).alias("cells"), F.count("ad").alias("covered"), F.count_if(both).alias("display_total"), F.count_if(both & (F.col("ad") == F.col("bd"))).alias("display_matched")
    )


def round_trip(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: source cells with equal values and displays in the target, and target cells that the source lacks."""
    pairs = paired(source, target, keys)
    hit = F.coalesce(value_match(), F.lit(False))
    return pairs.agg(
        F.count_if("in_a").alias("total"),
        F.count_if(F.col("in_a") & hit).alias("value_matched"),
        F.count_if(F.col("in_a") & F.col("in_b") & F.col("a_d").eqNullSafe(F.col("b_d"))).alias("display_matched"),
        F.count_if(~F.col("in_a")).alias("extra"),
    )


def extra_cells(source: DataFrame, target: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or schema.key(source, target)
    return target.join(source.select(*keys), keys, "left_anti")


def sets_equal(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(only_a, only_b, equal) of two sets of rows, by counting sides of each distinct row."""
    both = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = both.groupBy(*keys).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    out = per.agg(F.count_if(F.col("y") == 0).alias("only_a"), F.count_if(F.col("x") == 0).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def formula_agreement(evaluated: DataFrame, cached: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(covered, evaluated, compared, agreed): results against the file's cached values, within 1e-9 absolute or relative."""
    keys = keys or schema.key(evaluated, cached)
    e = evaluated.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("t", "vn", "vs", "vb")], F.lit(True).alias("done"))
    c = cached.filter("f IS NOT NULL").select(*keys, *[F.col(x).alias(f"b_{x}") for x in ("t", "vn", "vs", "vb")])
    joined = c.join(e, keys, "left")
    has = F.col("b_vn").isNotNull() | F.col("b_vs").isNotNull() | F.col("b_vb").isNotNull()
    close = F.abs(F.col("a_vn") - F.col("b_vn")) <= F.greatest(F.lit(1e-9), F.lit(1e-9) * F.greatest(F.abs("a_vn"), F.abs("b_vn")))
    same = F.when(F.col("a_vn").isNotNull() & F.col("b_vn").isNotNull(), close).otherwise(F.col("a_vs").eqNullSafe(F.col("b_vs")) & F.col("a_vb").eqNullSafe(F.col("b_vb")))
    seen = F.col("done") & has
    return joined.agg(F.count(F.lit(1)).alias("covered"), F.count("done").alias("evaluated"), F.count_if(seen).alias("compared"), F.count_if(seen & same).alias("agreed"))


def probe_offsets(rows: int, cols: int, nr: int = 64, nc: int = 24) -> list[tuple[int, int]]:
    """Corners and centre at which windows of nr by nc are read, without repeats."""
    r, c = max(0, rows - nr), max(0, cols - nc)
    return list(dict.fromkeys([(0, 0), (0, c), (r, 0), (r, c), (r // 2, c // 2)]))
