"""Tables as sheets: a row of the table is a row of the grid, a column a column, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import cut, shuffle_partitions

#: Places within a range take so many bits of a row's number while it is made.
PLACE_BITS = 33


def with_row_number(df: DataFrame, order: list[str], out: str = "r", ranges: int | None = None) -> DataFrame:
    """``df`` with its zero-based place (long) in the order of the columns ``order``, nulls first.

    Rows are range-partitioned and sorted by the whole order, so equal first columns and text are spread too; a row's number
    is its place in its range plus the rows of the ranges before it. The rows are written once, in the checkpoint folder,
    so that ranges stay what they were when they were counted; what the driver learns is a count for each range.
    """
    n = ranges or shuffle_partitions(df)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", PLACE_BITS), F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())  # a row for each range
    starts, start = [], 0
    for p, rows in counts:
        starts.append((p, start))
        start += rows
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(out, F.col("__start") + place).drop("__part", "__start", "__at")


def _cell(df: DataFrame, name: str, c: int):
    kind, col = df.schema[name].dataType, F.col(name)
    none = {"vn": F.lit(None).cast("double"), "vs": F.lit(None).cast("string"), "vb": F.lit(None).cast("boolean")}
    if isinstance(kind, T.BooleanType):
        t, none["vb"] = "b", col
    elif isinstance(kind, T.NumericType):
        t, none["vn"] = "n", col.cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        full = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        t, none["vs"] = "d", F.regexp_replace(F.regexp_replace(full, r"\.000$", ""), "T00:00:00$", "")
    else:
        t, none["vs"] = "s", col.cast("string")
    return F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), *[v.alias(k) for k, v in none.items()])


def to_cells(df: DataFrame, order: list[str], columns: list[str] | None = None, sheet: int = 0) -> DataFrame:
    """(sheet, r, c, t, vn, vs, vb), null values left out. Columns that are not asked for are not read."""
    columns = columns or df.columns
    numbered = with_row_number(df.select(*dict.fromkeys([*order, *columns])), order)
    cells = F.explode(F.array(*[_cell(df, n, c) for c, n in enumerate(columns)]))
    out = numbered.select(F.lit(sheet).alias("sheet"), "r", cells.alias("x")).select("sheet", "r", "x.*")
    return out.filter("vn IS NOT NULL OR vs IS NOT NULL OR vb IS NOT NULL")


def from_cells(cells: DataFrame, names: list[str]) -> DataFrame:
    """A row for each (sheet, r), a column for each name, values as strings."""
    shown = F.coalesce(F.col("vs"), F.col("vn").cast("string"), F.col("vb").cast("string"))
    wide = cells.withColumn("v", shown).groupBy("sheet", "r").pivot("c", list(range(len(names)))).agg(F.first("v"))
    return wide.select("sheet", "r", *[F.col(str(k)).alias(n) for k, n in enumerate(names)])
