"""Cell references: letters and digits to zero-based (row, column) and back, as Columns and in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})\Z")


def col_name(c: int) -> str:
    out = ""
    c += 1
    while c:
        c, k = divmod(c - 1, 26)
        out = LETTERS[k] + out
    return out


def cell_name(r: int, c: int) -> str:
    return f"{col_name(c)}{r + 1}"


def col_index(name: str) -> int:
    out = 0
    for ch in name.upper():
        out = out * 26 + LETTERS.index(ch) + 1
    return out - 1


def parse_cell(text: str, dollars: bool = True) -> tuple[int, int] | None:
    m = _CELL.match(text)
    if not m or (not dollars and "$" in text):
        return None
    r, c = int(m[2]) - 1, col_index(m[1])
    return (r, c) if r < 1_048_576 and c < 16_384 else None


def parse_range(text: str, dollars: bool = False) -> tuple[int, int, int, int] | None:
    """(r0, c0, r1, c1), corners in order; a lone cell is a range of one."""
    a, _, b = text.partition(":")
    p, q = parse_cell(a, dollars), parse_cell(b or a, dollars)
    if p is None or q is None:
        return None
    return min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])


def range_name(r0: int, c0: int, r1: int, c1: int) -> str:
    return cell_name(r0, c0) if (r0, c0) == (r1, c1) else f"{cell_name(r0, c0)}:{cell_name(r1, c1)}"


def col_letters(c: Column) -> Column:
    """Letters of a zero-based column number under 16,384: at most three."""
    letter = lambda k: F.substring(F.lit(LETTERS), (k + 1).cast("int"), F.lit(1))
    c = c.cast("int")
    two, three = F.floor((c - 26) / 26), F.floor((c - 702) / 676)
    return (
        F.when(c < 26, letter(c))
        .when(c < 702, F.concat(letter(two), letter(F.pmod(c - 26, F.lit(26)))))
        .otherwise(F.concat(letter(three), letter(F.pmod(F.floor((c - 702) / 26), F.lit(26))), letter(F.pmod(c - 702, F.lit(26)))))
    )


def encode(r: Column, c: Column) -> Column:
    return F.concat(col_letters(c), (r + 1).cast("string"))


def decode(ref: Column) -> tuple[Column, Column]:
    """(row, column) of a reference with or without dollars; null where it is none."""
    ok = ref.rlike(r"^\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}$")
    letters = F.upper(F.regexp_extract(ref, r"([A-Za-z]+)", 1))
    value = F.aggregate(F.split(letters, ""), F.lit(0), lambda s, x: F.when(x == "", s).otherwise(s * 26 + F.ascii(x) - 64))
    row = F.regexp_extract(ref, r"([0-9]+)$", 1)
    r, c = row.try_cast("int") - 1, value - 1
    fits = ok & (r < 1_048_576) & (c < 16_384)
    return F.when(fits, r), F.when(fits, c)


def decode_range(text: Column) -> tuple[Column, Column, Column, Column]:
    """(r0, c0, r1, c1) with corners in order; nulls where it is no range."""
    a, b = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(2))
    b = F.when(b == "", a).otherwise(b)
    (ra, ca), (rb, cb) = decode(a), decode(b)
    both = ra.isNotNull() & rb.isNotNull()
    return tuple(F.when(both, f(x, y)) for f, x, y in ((F.least, ra, rb), (F.least, ca, cb), (F.greatest, ra, rb), (F.greatest, ca, cb)))
