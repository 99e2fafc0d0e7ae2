"""CSV export of one sheet: every row and column of its extent, CRLF, quoted only where needed."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numfmt import shortest

#: What a CSV file cannot hold of a workbook.
DROPPED = ("formulas (values are exported)", "number formats (displays are exported)", "styles", "merged ranges", "column widths and row heights", "other sheets")


@F.pandas_udf(T.StringType())
def _shortest(numbers: pd.Series) -> pd.Series:
    return numbers.map(shortest, na_action="ignore").astype(object)


def number_text(v: Column) -> Column:
    """The shortest text of a number without exponent. Whole numbers and short decimals stay in generated code."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    plain = v.cast("string")
    short = (F.abs(v) >= 1e-3) & (F.abs(v) < 1e7)
    exact = _shortest(F.when(~whole & ~short, v))
    return F.when(whole, F.floor(v).cast("string")).when(short, plain).otherwise(exact)


def shown(cells: DataFrame) -> Column:
    """A cell's display, else its raw value."""
    raw = F.coalesce(F.col("vs"), F.when(F.col("vb").isNotNull(), F.upper(F.col("vb").cast("string"))), number_text(F.col("vn")))
    return F.coalesce(F.col("d"), raw) if "d" in cells.columns else raw


def quoted(text: Column) -> Column:
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lines(cells: DataFrame, cols: int, rows: int | None = None, order: str | None = None) -> DataFrame:
    """(r, line): a row of the grid as text, blank cells empty. With ``rows``, rows without cells are there too. Of a cell
    that is repeated the last by ``order`` counts, without an order the greatest text.

    A row's cells meet in one task; a grid has at most 16,384 columns, which bounds a group.
    """
    fields = cells.filter(F.col("c") < cols).select("r", "c", quoted(shown(cells)).alias("x"), (F.col(order) if order else F.lit(0)).alias("o"))
    fields = fields.repartition("r").groupBy("r", "c").agg(F.max(F.struct("o", "x")).alias("m")).select("r", "c", "m.x")
    got = fields.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(""))), ",")
    out = got.select("r", line.alias("line"))
    if rows is None:
        return out
    every = cells.sparkSession.range(rows).select(F.col("id").alias("r"))
    return every.join(out, "r", "left").select("r", F.coalesce("line", F.lit("," * (cols - 1))).alias("line"))


def write(cells: DataFrame, path: str, rows: int, cols: int) -> None:
    """A folder of text parts in row order, lines ended by CRLF; Spark's commit makes it all or nothing."""
    ordered = lines(cells, cols, rows).repartitionByRange("r").sortWithinPartitions("r").select("line")
    ordered.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_file(cells: DataFrame, path: str, rows: int, cols: int) -> int:
    """One file on the driver, streamed partition by partition and renamed when complete. Returns its bytes."""
    ordered = lines(cells, cols, rows).orderBy("r")
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as out:
            for row in ordered.toLocalIterator():
                out.write(row["line"] + "\r\n")
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise
    return os.path.getsize(path)
