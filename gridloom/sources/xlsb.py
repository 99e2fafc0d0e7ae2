"""XLSB: binary records in an OOXML package."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from gridloom.functions.numfmt import BUILT_IN
from gridloom.sources.binary_strings import Unreadable, decode
from gridloom.sources.book import DEFAULT_STYLE, ERROR_BYTES, Book, Sheet, finish, normal_cell
from gridloom.sources.rails import Limits, Refused, check_extent
from gridloom.sources.xls import packed_number
from gridloom.sources.xlsx import _Package


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, payload): a kind of one or two bytes, a length of one to four bytes of seven bits."""
    at = 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind & 0x80:
            if at >= len(data):
                raise Refused("unsupported", "a record is cut short")
            kind = kind & 0x7F | (data[at] & 0x7F) << 7
            at += 1
        size = 0
        for k in range(4):
            if at >= len(data):
                raise Refused("unsupported", "a record is cut short")
            size |= (data[at] & 0x7F) << 7 * k
            at += 1
            if not data[at - 1] & 0x80:
                break
        if at + size > len(data):
            raise Refused("unsupported", "a record is cut short")
        yield kind, data[at : at + size]
        at += size


def wide_text(data: bytes, at: int) -> tuple[str, int]:
    if at + 4 > len(data):
        raise Refused("unsupported", "a string is cut short")
    n = struct.unpack_from("<I", data, at)[0]
    if n == 0xFFFFFFFF:
        return "", at + 4
    if at + 4 + 2 * n > len(data):
        raise Refused("unsupported", "a string is cut short")
    return data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def _formats(data: bytes | None) -> list[str | None]:
    codes, out, inside = dict(BUILT_IN), [], False
    for kind, x in records(data or b""):
        if kind == 44 and len(x) >= 2:
            codes[struct.unpack_from("<H", x)[0]] = wide_text(x, 2)[0]
        elif kind in (617, 618):
            inside = kind == 617
        elif kind == 47 and inside and len(x) >= 4:
            out.append(codes.get(struct.unpack_from("<H", x, 2)[0]))
    return out


def _bundle(x: bytes) -> tuple[str, str]:
    """(relation id, name); the strings start at byte 8, or at 12 in files of the second beta."""
    for at in (8, 12):
        try:
            rid, end = wide_text(x, at)
            name, _ = wide_text(x, end)
            if rid.startswith("rId"):
                return rid, name
        except Refused:
            continue
    raise Refused("unsupported", "a sheet entry cannot be read")


def read(content: bytes, limits: Limits) -> Book:
    package = _Package(content, limits)
    where = next((t for kind, t in package.relations("").values() if kind == "officeDocument"), "xl/workbook.bin")
    data = package.part(where)
    if data is None:
        raise Refused("unsupported", "there is no workbook part")
    book, listed, relations = Book(), [], package.relations(where)
    for kind, x in records(data):
        if kind == 153 and x:
            book.date_1904 = bool(x[0] & 1)
        elif kind == 156:
            listed.append(_bundle(x))
    by_kind = {kind: t for kind, t in relations.values()}
    strings = [wide_text(x, 1)[0] for kind, x in records(package.part(by_kind.get("sharedStrings", "xl/sharedStrings.bin")) or b"") if kind == 19]
    codes = _formats(package.part(by_kind.get("styles", "xl/styles.bin")))
    for rid, name in listed:
        sheet = Sheet(name)
        kind, part = relations.get(rid, ("", ""))
        data = package.part(part) if kind == "worksheet" else None
        if data is None:
            book.warnings.append(f"sheet {name!r} is not a worksheet and is empty here")
        else:
            _sheet(package, data, sheet, strings, codes, book, limits)
        book.sheets.append(sheet)
    return finish(book, limits)


def _sheet(package: _Package, data: bytes, sheet: Sheet, strings: list[str], codes: list, book: Book, limits: Limits) -> None:
    row = 0
    unreadable = 0
    for kind, x in records(data):
        package.clock.tick()
        try:
            if kind == 0:
                row = struct.unpack_from("<I", x)[0]
                if len(x) >= 12 and x[11] & 0x20:
                    sheet.heights[row] = struct.unpack_from("<H", x, 8)[0] / 20
            elif 1 <= kind <= 11:
                c, xf = struct.unpack_from("<II", x)
                xf &= 0xFFFFFF
                t, value, f, end = "s", None, None, len(x)
                if kind == 2:
                    t, value = "n", packed_number(struct.unpack_from("<I", x, 8)[0])
                elif kind in (3, 11):
                    t, value, end = "e", ERROR_BYTES.get(x[8], "#N/A"), 9
                elif kind in (4, 10):
                    t, value, end = "b", bool(x[8]), 9
                elif kind in (5, 9):
                    t, value, end = "n", struct.unpack_from("<d", x, 8)[0], 16
                elif kind in (6, 8):
                    value, end = wide_text(x, 8)
                elif kind == 7:
                    k = struct.unpack_from("<I", x, 8)[0]
                    value = strings[k] if k < len(strings) else None
                if kind >= 8:
                    size = struct.unpack_from("<I", x, end + 2)[0]
                    try:
                        f = decode(x[end + 6 : end + 6 + size], True)
                    except Unreadable:
                        unreadable += 1
                elif value == "":
                    value = None
                check_extent(row + 1, c + 1, limits)
                if len(sheet.cells) <= limits.max_cells and (made := normal_cell(row, c, t, value, f, codes[xf] if xf < len(codes) else None, book.date_1904, DEFAULT_STYLE)):
                    sheet.cells.append(made)
            elif kind == 60:
                lo, hi, width = struct.unpack_from("<III", x)
                sheet.columns.append((lo, min(hi, 16_383), width / 256))
            elif kind == 485:
                packed = struct.unpack_from("<IHH", x)
                sheet.default_height = packed[2] / 20
                sheet.default_width = packed[0] / 256 if packed[0] != 0xFFFFFFFF else packed[1] + 5 / 7
            elif kind == 151:
                xs, ys = struct.unpack_from("<dd", x)
                if len(x) >= 29 and x[28] & 1:
                    sheet.frozen = (int(ys), int(xs))
        except (struct.error, IndexError):
            raise Refused("unsupported", f"record {kind} is too short") from None
    if unreadable:
        book.warnings.append(f"{unreadable} formulas of sheet {sheet.name!r} cannot be read; their values are kept")
