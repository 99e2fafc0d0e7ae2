"""What every reader produces, and the steps that all of them share."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from gridloom.functions import formula, numfmt
from gridloom.sources.rails import Limits, check_extent

#: Errors by the byte that binary files store.
ERROR_BYTES = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}


@dataclass
class Sheet:
    name: str
    cells: list[tuple] = field(default_factory=list)  # (r, c, t, value, d, f, fmt, style key or None)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    rows: int = 0
    cols: int = 0
    truncated: bool = False
    frozen: tuple[int, int] = (0, 0)
    default_height: float | None = None
    default_width: float | None = None
    columns: list[tuple[int, int, float]] = field(default_factory=list)  # (first, last, width), in order
    heights: dict[int, float] = field(default_factory=dict)


@dataclass
class Book:
    sheets: list[Sheet] = field(default_factory=list)
    styles: list[tuple] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    date_1904: bool = False


STYLE_FIELDS = ("bold", "italic", "underline", "strike", "font_size", "font_name", "font_color", "fill_color")
DEFAULT_STYLE = (False, False, False, False, None, None, None, None)


def explicit(code: str | None) -> str | None:
    return None if code is None or code.lower() == "general" else code


def normal_cell(r: int, c: int, kind: str, value, f: str | None, code: str | None, epoch_1904: bool, style=None) -> tuple | None:
    """A cell of the model. ``kind``: n, s, b, e, iso (a date as text) or the declared type of a formula without a value.
    Numbers under a date format become dates, unless negative; non-finite numbers go unless a formula made them."""
    f = formula.normalize_text(f)
    if isinstance(value, float) and not math.isfinite(value):
        value, kind = None, "n"
    if value is None:
        if f is None:
            return None
        return r, c, kind if kind in ("n", "s", "b", "e", "d") else "s", None, None, f, explicit(code), style
    d = numfmt.render(code or "General", value, epoch_1904, error=kind == "e")
    t = kind
    if kind == "iso":
        t, value = "d", value.removesuffix("T00:00:00.000").removesuffix("T00:00:00").removesuffix("Z")
    elif kind == "n" and value >= 0 and code and numfmt.date_kind(code) == "date":
        iso = numfmt.serial_to_iso(value, epoch_1904)
        if iso is not None:
            t, value = "d", iso
    return r, c, t, value, d, f, explicit(code), style


def finish(book: Book, limits: Limits) -> Book:
    """Cells in row-major order, the cap over all sheets in order, extents, and styles numbered by first use."""
    left, order = limits.max_cells, {}
    for sheet in book.sheets:
        unique = {(x[0], x[1]): x for x in sheet.cells}
        cells = [unique[k] for k in sorted(unique)]
        sheet.rows = max(sheet.rows, cells[-1][0] + 1 if cells else 0)
        sheet.cols = max(sheet.cols, max((x[1] for x in cells), default=-1) + 1)
        check_extent(sheet.rows, sheet.cols, limits)
        sheet.truncated = len(cells) > left
        kept = cells[:left]
        left -= len(kept)
        out = []
        for x in kept:
            key = x[7]
            number = None if key is None or key == DEFAULT_STYLE else order.setdefault(key, len(order))
            out.append((*x[:7], number))
        sheet.cells = out
    book.styles = list(order)
    return book


def spread(columns: list[tuple[int, int, float]], used: int, spare: int = 256) -> dict[int, float]:
    """Width of each column below used + spare, the last declaration winning."""
    end, out = used + spare, {}
    for first, last, width in reversed(columns):
        for c in range(first, min(last, end - 1) + 1):
            out.setdefault(c, width)
        if len(out) >= end:
            break
    return out
