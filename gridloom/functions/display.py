"""Displays of columns: distinct codes compiled to Column expressions where they can be, one Arrow function else."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numfmt


def round_half_away(x: Column, places: int) -> Column:
    """Nearest multiple of 10**-places of a magnitude, exact halves up."""
    factor = 10.0**places
    scaled = x * factor
    low = F.floor(scaled).cast("double")
    return F.when(scaled - low >= 0.5, low + 1).otherwise(low) / factor


def fixed(x: Column, places: int, grouped: bool) -> Column:
    """Sign, digits and ``places`` decimals of a number under 1e15."""
    size = round_half_away(F.abs(x), places)
    body = F.format_number(size, places) if grouped else F.format_string(f"%.{places}f", size)
    return F.concat(F.when(x < 0, "-").otherwise(""), body)


def _decimal_shape(section: numfmt.Section) -> tuple[str, int, bool, int, str] | None:
    """(prefix, places, grouped, percents, suffix) of codes like 0.00, #,##0.0 and 0%, else None."""
    tokens = section.tokens
    slots = [k for k, (kind, _) in enumerate(tokens) if kind == "slot"]
    if not slots or section.condition or section.is_date or section.is_general or section.has_text:
        return None
    a, b = slots[0], slots[-1]
    middle = "".join(t for _, t in tokens[a : b + 1])
    import re

    m = re.fullmatch(r"(#,##0|0)(?:\.(0+))?", middle)
    rest = tokens[b + 1 :]
    if not m or any(k not in ("lit", "pct") and not (k == "raw" and t not in ",.eE/") for k, t in (*tokens[:a], *rest)):
        return None
    text = lambda part: "".join(t for _, t in part)
    places = len(m[2] or "")
    return (text(tokens[:a]), places, "," in m[1], sum(k == "pct" for k, _ in tokens), text(rest)) if places <= 9 else None


def _compiled(code: str, v: Column) -> Column | None:
    """The display of a number as a Column, if the code is one of the common shapes. Large numbers are left out (null)."""
    try:
        sections = numfmt.parse(code)
    except numfmt.Unsupported:
        return None
    if len(sections) > 2 or any(s.condition for s in sections):
        return None
    if len(sections) == 1 and not sections[0].is_general and sections[0].is_date:
        return _compiled_date(sections[0], v)
    shapes = [_decimal_shape(s) for s in sections]
    if None in shapes:
        return None

    def one(shape, x):
        prefix, places, grouped, percents, suffix = shape
        x = x * 100.0**percents if percents else x
        body = fixed(F.abs(x), places, grouped)
        return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(prefix), body, F.lit(suffix))

    positive = one(shapes[0], v)
    out = positive if len(shapes) == 1 else F.when(v < 0, one(shapes[1], F.abs(v))).otherwise(positive)
    return F.when(F.abs(v) < 1e11, out)


_PIECES = {"y": {4: "yyyy", 2: "yy"}, "o": {1: "M", 2: "MM", 3: "MMM", 4: "MMMM"}, "d": {1: "d", 2: "dd", 3: "EEE", 4: "EEEE"}}


def _compiled_date(section: numfmt.Section, v: Column) -> Column | None:
    """Date-only codes, from 1 March 1900 on, in the 1900 epoch."""
    pattern = ""
    for f, t, w in numfmt._date_fields(section.tokens):
        if f == "lit":
            pattern += "'" + t.replace("'", "''") + "'"
        elif f in _PIECES and w in _PIECES[f]:
            pattern += _PIECES[f][w]
        else:
            return None
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(v).cast("int"))
    return F.when((v >= 61) & (v < 2_900_000), F.date_format(day, pattern))


@F.pandas_udf(T.StringType())
def _render(code: pd.Series, t: pd.Series, vn: pd.Series, vs: pd.Series, vb: pd.Series, epoch: pd.Series) -> pd.Series:
    out = []
    for c, k, n, s, b, e in zip(code, t, vn, vs, vb, epoch):
        if c is None:
            out.append(None)
        elif k == "n":
            out.append(numfmt.render(c, None if n is None or pd.isna(n) else float(n), bool(e)))
        elif k == "b":
            out.append(None if b is None else numfmt.render(c, bool(b)))
        else:
            out.append(None if s is None else numfmt.render(c, s, error=k == "e"))
    return pd.Series(out, dtype=object)


def render_column(code: Column, t: Column, vn: Column, vs: Column, vb: Column, epoch_1904: Column | None = None) -> Column:
    """The exact display of any code, in Arrow batches."""
    return _render(code, t, vn, vs, vb, F.lit(False) if epoch_1904 is None else epoch_1904)


def display(df: DataFrame, codes: list[str], out: str = "d", code_col: str = "fmt") -> DataFrame:
    """``df`` (t, vn, vs, vb and a code column) with displays. ``codes``: the distinct codes, of which a workbook has few.

    Numbers under common codes stay in generated code; only rows that are left without a display, and whose code
    needs it, go through the Arrow function.
    """
    native = F.lit(None).cast("string")
    for code in codes:
        if (made := _compiled(code, F.col("vn"))) is not None:
            native = F.when((F.col(code_col) == code) & (F.col("t") == "n"), made).otherwise(native)
    staged = df.withColumn("__native", native)
    slow = F.when(F.col("__native").isNull(), F.col(code_col))
    exact = render_column(slow, F.col("t"), F.col("vn"), F.col("vs"), F.col("vb"))
    return staged.withColumn(out, F.coalesce("__native", exact)).drop("__native")


def format_column(code: str, v: Column) -> Column:
    """The display of a numeric Column under one code: an expression if the code allows, with the exact function only
    for values outside the expression's range."""
    none = F.lit(None)
    exact = render_column(F.lit(code), F.lit("n"), v, none.cast("string"), none.cast("boolean"))
    made = _compiled(code, v)
    return exact if made is None else F.coalesce(made, exact)
