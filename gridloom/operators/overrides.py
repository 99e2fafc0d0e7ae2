"""The edit layer: validated, collapsed overrides over an immutable base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.operators.store import last_wins
from gridloom.session import cut


class OverrideError(ValueError):
    """A rejected edit layer; ``code`` says which rule."""

    def __init__(self, code: str, msg: str):
        super().__init__(msg)
        self.code = code


def validate(overrides: DataFrame, sheets: DataFrame) -> None:
    """Count, sheet range, finite numbers, grid limits, and growth beyond both the cell limit and the base. One job."""
    known = sheets.agg(F.max("sheet")).first()[0]
    bad_number = F.col("vn").isNotNull() & (F.isnan("vn") | (F.abs("vn") == float("inf")))
    r = overrides.agg(
        F.count(F.lit(1)),
        F.count_if((F.col("sheet") < 0) | (F.col("sheet") > (-1 if known is None else known))),
        F.count_if(bad_number),
        F.count_if((F.col("r") < 0) | (F.col("c") < 0) | (F.col("r") >= schema.MAX_ROWS) | (F.col("c") >= schema.MAX_COLS)),
    ).first()
    if r[0] > schema.MAX_OVERRIDES:
        raise OverrideError("too_large", f"more than {schema.MAX_OVERRIDES} overrides")
    if r[1]:
        raise OverrideError("unsupported", "an override names a sheet that is not there")
    if r[2]:
        raise OverrideError("unsupported", "an override's number is not finite")
    if r[3]:
        raise OverrideError("too_large", "an override lies outside the grid")
    on = schema.key(sheets, of=["sheet"])
    grown = grow_extent(sheets, overrides).join(sheets.select(*on, (F.col("rows") * F.col("cols")).alias("was")), on)
    if not grown.filter((F.col("rows") * F.col("cols") > schema.MAX_EXTENT_CELLS) & (F.col("rows") * F.col("cols") > F.col("was"))).isEmpty():
        raise OverrideError("bomb", "an override makes a sheet too large")


def collapse(overrides: DataFrame) -> DataFrame:
    """One row for each cell: the last in array order."""
    return last_wins(overrides, schema.key(overrides))


def small(layer: DataFrame) -> tuple[DataFrame, bool]:
    """The layer, computed once, and whether its rows are counted to be few enough (MAX_OVERRIDES) to broadcast."""
    layer = cut(layer)
    return layer, layer.count() <= schema.MAX_OVERRIDES


def grow_extent(sheets: DataFrame, overrides: DataFrame) -> DataFrame:
    """(sheet, rows, cols): the base extent or the far corner of the overrides, whichever is larger."""
    on = schema.key(sheets, overrides, of=["sheet"])
    far = overrides.groupBy(*on).agg((F.max("r") + 1).alias("orow"), (F.max("c") + 1).alias("ocol"))
    names = schema.key(sheets, of=["sheet"])
    joined = sheets.select(*names, "rows", "cols").join(far, on, "left")
    return joined.select(*names, F.greatest("rows", F.coalesce("orow", F.lit(0))).cast("long").alias("rows"), F.greatest("cols", F.coalesce("ocol", F.lit(0))).cast("long").alias("cols"))


def apply(cells: DataFrame, overrides: DataFrame, display=None) -> DataFrame:
    """The base with literal overrides over it: value and type replaced, format and style kept, the formula gone,
    and the display made anew by ``display(t, vn, vs, vb, fmt)`` (null without a format). A number never becomes a
    date, a text that starts with = stays text, and a null clears the cell.

    The layer is counted: up to MAX_OVERRIDES rows it is broadcast, so that cells it does not name are not shuffled; a
    larger one meets the cells in a shuffle.
    """
    over, few = small(collapse(overrides.filter("f IS NULL")))
    send, key = F.broadcast if few else (lambda df: df), schema.key(cells, over)
    o = send(over.select(*key, *[F.col(n).alias(f"o_{n}") for n in ("t", "vn", "vs", "vb")], F.lit(True).alias("hit")))
    base = cells.join(o, key, "left")
    fresh = over.join(send(cells.join(o, key, "left_semi").select(*key)), key, "left_anti")
    new_t = schema.value_type(F.col("o_vn"), F.col("o_vs"), F.col("o_vb"))
    fmt = F.col("fmt") if "fmt" in cells.columns else F.lit(None).cast("string")
    shown = display(new_t, F.col("o_vn"), F.col("o_vs"), F.col("o_vb"), fmt) if display else F.lit(None).cast("string")
    put = {"t": new_t, "vn": F.col("o_vn"), "vs": F.col("o_vs"), "vb": F.col("o_vb"), "d": shown, "f": F.lit(None).cast("string")}
    changed = base.select(*[F.when(F.col("hit"), put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in cells.columns])
    kind = dict(cells.dtypes)
    made = {"t": schema.value_type(F.col("vn"), F.col("vs"), F.col("vb")), **{k: F.col(k) for k in (*key, "vn", "vs", "vb")}}
    added = fresh.select(*[(made[c] if c in made else F.lit(None)).cast(kind[c]).alias(c) for c in cells.columns])
    return changed.unionByName(added)


def replaced_formulas(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """(n): literal edits that land on formula cells."""
    literal, few = small(collapse(overrides.filter("f IS NULL")))
    key = schema.key(cells, literal)
    places = literal.select(*key)
    return cells.filter("f IS NOT NULL").join(F.broadcast(places) if few else places, key, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def scoped(overrides: DataFrame, sheet: int) -> DataFrame:
    """What an export of one sheet sees; check :func:`validate` first, for edits of sheets that are not there."""
    return overrides.filter(F.col("sheet") == sheet)


def collapse_sizes(sizes: DataFrame) -> DataFrame:
    """(sheet, axis, at, size, clamped) of (ord, sheet, axis, at, size): the last wins, sizes clamped to the grid's limits."""
    on = schema.key(sizes, of=["sheet", "axis", "at"])
    last = last_wins(sizes, on)
    top = F.when(F.col("axis") == "col", F.lit(255.0)).otherwise(F.lit(409.5))
    held = F.when(F.isnan("size"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.col("size"), top)))
    return last.select(*on, held.alias("size"), (~held.eqNullSafe(F.col("size"))).alias("clamped"))
