"""The data model: one sparse, typed cell table and its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
MAX_ROWS, MAX_COLS = 1_048_576, 16_384
MAX_EXTENT_CELLS = 8_000_000
MAX_OVERRIDES = 100_000
MAX_WINDOW_CELLS = 262_144
MAX_CHANGED = 50_000
DEFAULT_ROW_HEIGHT, DEFAULT_COL_WIDTH = 15.0, 8.43
TYPES = ("n", "s", "b", "e", "d")
ERROR_CODES = ("unsupported", "bad_zip", "encrypted", "too_large", "bomb", "timeout", "cancelled", "io", "internal")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

CELLS = _struct(workbook=S, sheet=I, r=I, c=I, t=S, vn=D, vs=S, vb=B, d=S, f=S, fmt=S, s=I)
SHEETS = _struct(workbook=S, sheet=I, name=S, rows=L, cols=L, truncated=B, frozen_rows=I, frozen_cols=I, default_row_height=D, default_col_width=D)
MERGES = _struct(workbook=S, sheet=I, a1=S, r0=I, c0=I, r1=I, c1=I)
STYLES = _struct(workbook=S, style_id=I, bold=B, italic=B, underline=B, strike=B, font_size=D, font_name=S, font_color=S, fill_color=S)
OVERRIDES = _struct(ord=I, sheet=I, r=I, c=I, t=S, vn=D, vs=S, vb=B, f=S)
SIZES = _struct(workbook=S, sheet=I, axis=S, at=I, size=D)
WORKBOOKS = _struct(workbook=S, sha256=S, ok=B, code=S, msg=S, truncated=B, date_1904=B, warnings=T.ArrayType(S))

KEY = ["sheet", "r", "c"]


def key(*frames: DataFrame, of: list[str] = KEY) -> list[str]:
    """The columns that name a cell (or ``of``) in all ``frames``: with the workbook where every one of them has it, so that
    cells of several files are never taken for each other. An edit layer without workbooks holds for each."""
    return [*(["workbook"] if all("workbook" in f.columns for f in frames) else []), *of]


def value_type(vn: Column, vs: Column, vb: Column) -> Column:
    """The type tag of a literal: number, bool, else text (also for null)."""
    return F.when(vn.isNotNull(), "n").when(vb.isNotNull(), "b").otherwise("s")


def same_value(a: str, b: str, tolerance: float = 1e-9) -> Column:
    """Equality of the typed values with column prefixes ``a`` and ``b``: types equal, numbers within a relative
    tolerance, anything else null-safe equal."""
    x, y = F.col(f"{a}vn"), F.col(f"{b}vn")
    close = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
    numbers = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise((x == y) | close)
    others = F.col(f"{a}vs").eqNullSafe(F.col(f"{b}vs")) & F.col(f"{a}vb").eqNullSafe(F.col(f"{b}vb"))
    return F.col(f"{a}t").eqNullSafe(F.col(f"{b}t")) & F.when(F.col(f"{a}t") == "n", numbers).otherwise(others)
