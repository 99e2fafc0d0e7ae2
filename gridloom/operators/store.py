"""The cell store: de-duplication, clipped windows, point reads, merges, extents and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.a1 import decode_range


def last_wins(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Of rows with equal keys the one that came last; partial aggregation, so a repeated key costs a row a task."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__x"))
    return last.select(*keys, "__x.*")


def build(cells: DataFrame, sheets: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Row-major cells, last duplicate kept, those outside their sheet's extent dropped."""
    key = schema.key(cells)
    if order:
        cells = last_wins(cells, key, order).drop(order)
    if sheets is not None:
        on = schema.key(cells, sheets, of=["sheet"])
        cells = cells.join(sheets.select(*on, "rows", "cols"), on).filter("r < rows AND c < cols").drop("rows", "cols")
    return cells.repartitionByRange(*key).sortWithinPartitions(*key)


def save(cells: DataFrame, path: str, row_group_bytes: int = 8 << 20) -> None:
    """Range-sorted Parquet: row groups then prune by (sheet, r, c), and strings are dictionary-encoded."""
    key = schema.key(cells)
    cells.repartitionByRange(*key).sortWithinPartitions(*key).write.option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(path)


def extent(cells: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(sheet, rows, cols), by workbook where there are several: the far corner of the cells, or the declared one where that
    is larger."""
    on = schema.key(cells, *([] if declared is None else [declared]), of=["sheet"])
    seen = cells.groupBy(*on).agg((F.max("r") + 1).cast("long").alias("rows"), (F.max("c") + 1).cast("long").alias("cols"))
    if declared is None:
        return seen
    d = declared.select(*on, F.col("rows").alias("dr"), F.col("cols").alias("dc"))
    both = seen.join(d, on, "full_outer")
    zero = F.lit(0).cast("long")
    return both.select(*on, *[F.greatest(F.coalesce(a, zero), F.coalesce(b, zero)).alias(a) for a, b in (("rows", "dr"), ("cols", "dc"))])


def check_window(nr: int, nc: int) -> None:
    if nr < 1 or nc < 1 or nr * nc > schema.MAX_WINDOW_CELLS:
        raise ValueError(f"a window has 1 to {schema.MAX_WINDOW_CELLS} cells")


def clip(rows: int, cols: int, r0: int, c0: int, nr: int, nc: int) -> tuple[int, int]:
    """How much of the window lies in the extent; (0, 0) if none."""
    hr, hc = max(0, min(rows, r0 + nr) - r0), max(0, min(cols, c0 + nc) - c0)
    return (hr, hc) if hr and hc else (0, 0)


def window(cells: DataFrame, sheet: int, r0: int, c0: int, nr: int, nc: int) -> DataFrame:
    """The sparse cells of a rectangle. Plain comparisons, so that they reach a Parquet scan."""
    check_window(nr, nc)
    inside = (F.col("sheet") == sheet) & (F.col("r") >= r0) & (F.col("r") < r0 + nr) & (F.col("c") >= c0) & (F.col("c") < c0 + nc)
    return cells.filter(inside)


def dense_window(cells: DataFrame, rows: int, cols: int, sheet: int, r0: int, c0: int, nr: int, nc: int) -> DataFrame:
    """Every (r, c) of the clipped rectangle, with the cell's columns where there is one."""
    hr, hc = clip(rows, cols, r0, c0, nr, nc)
    spark = cells.sparkSession
    part = window(cells, sheet, r0, c0, nr, nc).drop("sheet")
    grid = spark.range(hr * hc).select(F.floor(F.col("id") / max(1, hc) + r0).alias("r"), (F.col("id") % max(1, hc) + c0).cast("int").alias("c"))
    return grid.join(F.broadcast(part), ["r", "c"], "left")  # a window is at most MAX_WINDOW_CELLS


def point(cells: DataFrame, sheet: int, r: int, c: int, order: str | None = None) -> DataFrame:
    found = cells.filter((F.col("sheet") == sheet) & (F.col("r") == r) & (F.col("c") == c))
    return last_wins(found, schema.key(cells), order) if order else found


def parse_merges(a1: DataFrame, column: str = "a1") -> DataFrame:
    """``a1`` with r0, c0, r1, c1; ranges that cannot be read are dropped."""
    r0, c0, r1, c1 = decode_range(F.col(column))
    return a1.select("*", r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1")).filter("r0 IS NOT NULL")


def overlaps(r0: int, c0: int, nr: int, nc: int) -> Column:
    return (F.col("r0") < r0 + nr) & (F.col("r1") >= r0) & (F.col("c0") < c0 + nc) & (F.col("c1") >= c0)


def merges_in(merges: DataFrame, sheet: int, r0: int, c0: int, nr: int, nc: int) -> DataFrame:
    """Merged ranges that touch the window, not clipped to it."""
    return merges.filter((F.col("sheet") == sheet) & overlaps(r0, c0, nr, nc))


def cap(cells: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` cells of each workbook in (sheet, r, c) order, and (sheet, truncated) of every sheet.

    Spark's group limit takes the first rows in each task before they meet; the flag compares counts.
    """
    on, key = schema.key(cells, of=["sheet"]), schema.key(cells)
    if "workbook" in cells.columns:
        place = F.row_number().over(Window.partitionBy("workbook").orderBy(*schema.KEY))
        kept = cells.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place")
    else:
        kept = cells.orderBy(*key).limit(limit)
    have = cells.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    held = kept.groupBy(*on).agg(F.count(F.lit(1)).alias("k"))
    flags = have.join(held, on, "left").select(*on, (F.coalesce("k", F.lit(0)) < F.col("n")).alias("truncated"))
    return kept, flags


def meta(sheets: DataFrame) -> DataFrame:
    """What a viewer needs of each sheet, with default sizes filled in."""
    return sheets.select(
        "sheet", "name", "rows", "cols", "truncated",
        F.coalesce("frozen_rows", F.lit(0)).alias("frozen_rows"),
        F.coalesce("frozen_cols", F.lit(0)).alias("frozen_cols"),
        F.coalesce("default_row_height", F.lit(schema.DEFAULT_ROW_HEIGHT)).alias("default_row_height"),
        F.coalesce("default_col_width", F.lit(schema.DEFAULT_COL_WIDTH)).alias("default_col_width"),
    )


def overlay(part: DataFrame, evaluated: DataFrame) -> DataFrame:
    """``part`` with t, value and display of evaluated cells in place, flagged ``e``. A null display also overwrites."""
    names = ["t", "vn", "vs", "vb", "d"]
    key = schema.key(part, evaluated)
    over = evaluated.select(*key, F.lit(True).alias("e"), *[F.col(n).alias(f"__{n}") for n in names])
    joined = part.join(over, key, "left")
    keep = [c for c in part.columns if c not in names]
    return joined.select(*keep, *[F.when(F.col("e"), F.col(f"__{n}")).otherwise(F.col(n)).alias(n) for n in names], F.coalesce("e", F.lit(False)).alias("e"))


def scan_sheet(cells: DataFrame, sheet: int) -> DataFrame:
    return cells.filter(F.col("sheet") == sheet).orderBy("r", "c")


def intern_styles(cells: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Style fields of cells as a numbered table, numbers by first use in row-major order, the default style null.

    The first uses are one row a style; only they are numbered, those of each workbook in a window of its own.
    """
    book = schema.key(cells, of=[])
    default = F.lit(True)
    for f in fields:
        default = default & F.coalesce(~F.col(f).cast("boolean") if dict(cells.dtypes)[f] == "boolean" else F.col(f).isNull(), F.lit(True))
    key = F.struct(*fields)
    used = cells.filter(~default).groupBy(*book, *fields).agg(F.min(F.struct(*schema.KEY)).alias("__at"))
    styles = used.withColumn("style_id", (F.row_number().over(Window.partitionBy(*book).orderBy("__at")) - 1).cast("int")).drop("__at")
    named = styles.select("style_id", *[F.col(f).alias(f"__{f}") for f in [*book, *fields]])
    same = [F.col(f).eqNullSafe(F.col(f"__{f}")) for f in [*book, *fields]]
    joined = cells.join(named, same, "left").select(*[F.col(c) for c in cells.columns if c not in fields], F.col("style_id").alias("s"))
    return joined, styles.select(*book, "style_id", *fields)


def expand_ranges(declared: DataFrame, used: int, spare: int = 256) -> DataFrame:
    """(at, size) of declarations (ord, lo, hi, size): the last one wins, columns from used + spare on are left out.

    Ranges are cut before they are exploded, so a declaration over all columns costs no more than the sheet has.
    """
    end = used + spare - 1
    cut = declared.filter(F.col("lo") <= end).withColumn("hi", F.least("hi", F.lit(end)))
    each = cut.select("ord", "size", F.explode(F.sequence("lo", "hi")).alias("at"))
    return each.groupBy("at").agg(F.max_by("size", "ord").alias("size"))
