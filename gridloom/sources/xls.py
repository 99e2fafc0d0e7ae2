"""XLS: the BIFF8 workbook stream of a compound file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from gridloom.functions.numfmt import BUILT_IN
from gridloom.sources.binary_strings import Unreadable, decode
from gridloom.sources.book import DEFAULT_STYLE, ERROR_BYTES, Book, Sheet, finish, normal_cell
from gridloom.sources.rails import Clock, Compound, Limits, Refused, check_extent

MAX_RECORDS = 5_000_000


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes, int]]:
    """(kind, data, start) of each record; a record that is cut short is an error."""
    n = 0
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        if kind == 0 and size == 0:
            return
        if at + 4 + size > len(stream):
            raise Refused("bad_zip", "a record is cut short")
        n += 1
        if n > MAX_RECORDS:
            raise Refused("bomb", "too many records")
        yield kind, stream[at + 4 : at + 4 + size], at
        at += 4 + size


def need(data: bytes, n: int) -> None:
    if len(data) < n:
        raise Refused("bad_zip", "a record is too short")


def text16(data: bytes, at: int, count: int) -> tuple[str, int]:
    """A flagged string of ``count`` characters at its flag byte, and where it ends."""
    need(data, at + 1)
    flag = data[at]
    at += 1
    runs = struct.unpack_from("<H", data, at)[0] if flag & 8 else 0
    at += 2 * bool(flag & 8)
    extra = struct.unpack_from("<I", data, at)[0] if flag & 4 else 0
    at += 4 * bool(flag & 4)
    size = count * (1 + (flag & 1))
    need(data, at + size)
    return data[at : at + size].decode("utf-16-le" if flag & 1 else "latin-1", "replace"), at + size + 4 * runs + extra


def shared_strings(parts: list[bytes]) -> list[str]:
    """Strings of a table that may run on over continuation records, each of which repeats the width flag."""
    need(parts[0], 8)
    total = min(struct.unpack_from("<I", parts[0], 4)[0], sum(map(len, parts)))
    part, at, out = 0, 8, []

    def data() -> bytes:
        return parts[part]

    def more() -> bool:
        nonlocal part, at
        while at >= len(data()):
            if part + 1 >= len(parts):
                return False
            part, at = part + 1, at - len(data())
        return True

    while len(out) < total and more():
        need(data(), at + 3)
        count, flag = struct.unpack_from("<HB", data(), at)
        at += 3
        runs = struct.unpack_from("<H", data(), at)[0] if flag & 8 else 0
        at += 2 * bool(flag & 8)
        extra = struct.unpack_from("<I", data(), at)[0] if flag & 4 else 0
        at += 4 * bool(flag & 4)
        text = []
        while count:
            width = 1 + (flag & 1)
            n = min(count, (len(data()) - at) // width)
            text.append(data()[at : at + n * width].decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            at, count = at + n * width, count - n
            if count:
                if part + 1 >= len(parts) or not parts[part + 1]:
                    break
                part, at = part + 1, 1
                flag = data()[0]
        at += 4 * runs + extra
        out.append("".join(text))
    return out


def packed_number(rk: int) -> float:
    value = float(rk >> 2 if rk < 1 << 31 else (rk >> 2) - (1 << 30)) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def read(content: bytes, limits: Limits) -> Book:
    stream = Compound(content).stream("Workbook", "Book")
    book, clock = Book(), Clock(limits.timeout_s)
    codes, formats, sheets, strings, version = dict(BUILT_IN), [], [], [], 0x0600
    table: list[bytes] = []
    in_table = False
    for kind, data, _ in records(stream):
        clock.tick()
        if kind == 0x003C and in_table:
            table.append(data)
            continue
        in_table = kind == 0x00FC
        if kind == 0x0809:
            need(data, 4)
            version = struct.unpack_from("<H", data)[0]
        elif kind == 0x002F:
            raise Refused("encrypted", "the workbook is encrypted")
        elif kind == 0x0022:
            need(data, 2)
            book.date_1904 = data[0] == 1
        elif kind == 0x041E:
            need(data, 3)
            k = struct.unpack_from("<H", data)[0]
            codes[k] = text16(data, 4, struct.unpack_from("<H", data, 2)[0])[0] if version >= 0x0600 else data[3 : 3 + data[2]].decode("latin-1")
        elif kind == 0x00E0:
            need(data, 4)
            formats.append(struct.unpack_from("<H", data, 2)[0])
        elif kind == 0x0085:
            need(data, 8)
            name = text16(data, 7, data[6])[0] if version >= 0x0600 else data[7 : 7 + data[6]].decode("latin-1")
            sheets.append((struct.unpack_from("<I", data)[0], data[5], name))
        elif kind == 0x0018:
            need(data, 6)
            if struct.unpack_from("<H", data, 4)[0] > len(data):
                raise Refused("bad_zip", "a name's formula is longer than its record")
        elif kind == 0x00FC:
            table = [data]
        elif kind == 0x000A:
            break
    if table:
        strings = shared_strings(table)
    for start, kind, name in sheets:
        sheet = Sheet(name)
        if kind:
            book.warnings.append(f"sheet {name!r} is not a worksheet and is empty here")
        elif start >= len(stream):
            raise Refused("bad_zip", "a sheet lies outside the stream")
        else:
            _sheet(stream, start, sheet, strings, [codes.get(k) for k in formats], book.date_1904, limits, clock)
        book.sheets.append(sheet)
    return finish(book, limits)


def _sheet(stream: bytes, start: int, sheet: Sheet, strings: list[str], codes: list, epoch_1904: bool, limits: Limits, clock: Clock) -> None:
    waiting: tuple | None = None  # a formula whose text result follows
    depth = 0
    panes_frozen = False

    def put(r, c, xf, kind, value, f=None):
        check_extent(r + 1, c + 1, limits)
        if len(sheet.cells) <= limits.max_cells and (made := normal_cell(r, c, kind, value, f, codes[xf] if xf < len(codes) else None, epoch_1904, DEFAULT_STYLE)):
            sheet.cells.append(made)

    for kind, data, _ in records(stream, start):
        clock.tick()
        if kind == 0x0809:
            depth += 1
        elif kind == 0x000A:
            depth -= 1
            if not depth:
                return
        if depth != 1:
            continue  # an embedded chart
        if kind in (0x0203, 0x00FD, 0x027E, 0x0205, 0x0006, 0x0204):
            need(data, {0x0203: 14, 0x00FD: 10, 0x027E: 10, 0x0205: 8, 0x0006: 22, 0x0204: 8}[kind])
            r, c, xf = struct.unpack_from("<HHH", data)
            if kind == 0x0203:
                put(r, c, xf, "n", struct.unpack_from("<d", data, 6)[0])
            elif kind == 0x00FD:
                k = struct.unpack_from("<I", data, 6)[0]
                put(r, c, xf, "s", strings[k] or None if k < len(strings) else None)
            elif kind == 0x027E:
                put(r, c, xf, "n", packed_number(struct.unpack_from("<I", data, 6)[0]))
            elif kind == 0x0205:
                put(r, c, xf, *(("e", ERROR_BYTES.get(data[6], "#N/A")) if data[7] else ("b", bool(data[6]))))
            elif kind == 0x0204:
                put(r, c, xf, "s", text16(data, 8, struct.unpack_from("<H", data, 6)[0])[0] or None)
            else:
                size = struct.unpack_from("<H", data, 20)[0]
                try:
                    f = decode(data[22 : 22 + size], False)
                except Unreadable:
                    f = None
                if data[12:14] == b"\xff\xff":
                    tag = data[6]
                    if tag == 0:
                        waiting = (r, c, xf, f)
                    elif tag == 1:
                        put(r, c, xf, "b", bool(data[8]), f)
                    elif tag == 2:
                        put(r, c, xf, "e", ERROR_BYTES.get(data[8], "#N/A"), f)
                    else:
                        put(r, c, xf, "s", "", f)
                else:
                    put(r, c, xf, "n", struct.unpack_from("<d", data, 6)[0], f)
        elif kind == 0x0207 and waiting:
            need(data, 3)
            r, c, xf, f = waiting
            put(r, c, xf, "s", text16(data, 2, struct.unpack_from("<H", data)[0])[0], f)
            waiting = None
        elif kind == 0x0200:
            need(data, 12)
            _, rows, _, cols = struct.unpack_from("<IIHH", data)
            check_extent(rows, cols, limits)
        elif kind == 0x00BE:
            need(data, 6)
            check_extent(struct.unpack_from("<H", data)[0] + 1, struct.unpack_from("<H", data, len(data) - 2)[0] + 1, limits)
        elif kind == 0x00BD:
            need(data, 6)
            r, c = struct.unpack_from("<HH", data)
            last = struct.unpack_from("<H", data, len(data) - 2)[0]
            if last < c or len(data) != 6 + 6 * (last - c + 1):
                raise Refused("bad_zip", "a row of numbers does not have as many as it says")
            for k in range((len(data) - 6) // 6):
                xf, rk = struct.unpack_from("<HI", data, 4 + 6 * k)
                put(r, c + k, xf, "n", packed_number(rk))
        elif kind == 0x00E5:
            need(data, 2)
            n = struct.unpack_from("<H", data)[0]
            need(data, 2 + 8 * n)
            for k in range(n):
                r0, r1, c0, c1 = struct.unpack_from("<HHHH", data, 2 + 8 * k)
                sheet.merges.append((r0, c0, r1, c1))
        elif kind == 0x0208:
            need(data, 16)
            r, height = struct.unpack_from("<H4xH", data)
            if not height & 0x8000 and data[12] & 0x40:
                sheet.heights[r] = height / 20
        elif kind == 0x007D:
            need(data, 6)
            lo, hi, width = struct.unpack_from("<HHH", data)
            sheet.columns.append((lo, min(hi, 255), width / 256))
        elif kind == 0x0225:
            need(data, 4)
            sheet.default_height = struct.unpack_from("<H", data, 2)[0] / 20
        elif kind == 0x0055:
            need(data, 2)
            sheet.default_width = float(struct.unpack_from("<H", data)[0])
        elif kind == 0x023E:
            need(data, 2)
            panes_frozen = bool(struct.unpack_from("<H", data)[0] & 8)
        elif kind == 0x0041 and panes_frozen:
            need(data, 4)
            x, y = struct.unpack_from("<HH", data)
            sheet.frozen = (y, x)
    sheet.merges = sorted(set(sheet.merges))
