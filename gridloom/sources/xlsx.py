"""XLSX and XLSM: parts found through relationships, sheets read in one pass each."""

from __future__ import annotations

import posixpath

from gridloom.a1 import cell_name, parse_cell, parse_range
from gridloom.functions.formula import translate
from gridloom.functions.numfmt import BUILT_IN
from gridloom.sources.book import DEFAULT_STYLE, Book, Sheet, finish, normal_cell
from gridloom.sources.rails import Clock, Limits, Refused, check_extent, open_zip, read_part, walk_xml

_DECLARED = {"n": "n", "s": "s", "str": "s", "inlineStr": "s", "b": "b", "e": "e", "d": "d"}


def _number(text: str | None, kind=float):
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


def _flag(text: str | None, absent: bool = False) -> bool:
    return absent if text is None else text.strip().lower() in ("1", "true", "on")


class _Package:
    def __init__(self, content: bytes, limits: Limits):
        self.zip, self.limits, self.clock = open_zip(content, limits), limits, Clock(limits.timeout_s)
        self.names = {n.replace("\\", "/").lstrip("/").lower(): n for n in self.zip.namelist()}

    def part(self, name: str) -> bytes | None:
        real = self.names.get(name.lstrip("/").lower())
        return None if real is None else read_part(self.zip, real, self.limits)

    def walk(self, data: bytes, **handlers) -> None:
        walk_xml(data, self.limits, self.clock, **handlers)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Id to (last word of the type, target part)."""
        base, name = posixpath.split(part)
        out: dict[str, tuple[str, str]] = {}
        data = self.part(posixpath.join(base, "_rels", name + ".rels"))

        def start(tag, a):
            if tag == "Relationship" and a.get("TargetMode") != "External":
                target = a.get("Target", "").replace("\\", "/")
                full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))
                out[a.get("Id", "")] = (a.get("Type", "").rpartition("/")[2], full)

        if data:
            self.walk(data, start=start)
        return out


def _shared_strings(package: _Package, data: bytes) -> list[str]:
    out, state = [], {"in": False, "skip": 0, "t": False}

    def start(tag, a):
        if tag == "si":
            out.append("")
        elif tag == "rPh":
            state["skip"] += 1
        elif tag == "t":
            state["t"] = not state["skip"]

    def end(tag):
        if tag == "rPh":
            state["skip"] -= 1
        elif tag == "t":
            state["t"] = False

    def text(chunk):
        if state["t"] and out:
            out[-1] += chunk

    package.walk(data, start=start, end=end, text=text)
    return out


def _colour(a: dict) -> str | None:
    """#RRGGBB of an rgb or indexed colour; theme colours and tints have none."""
    rgb = a.get("rgb", "")
    if "theme" in a or _number(a.get("tint")) not in (None, 0.0):
        return None
    if len(rgb) in (6, 8) and all(ch in "0123456789abcdefABCDEF" for ch in rgb):
        return "#" + rgb[-6:].upper()
    k = _number(a.get("indexed"), int)
    return PALETTE[k] if k is not None and 0 <= k < len(PALETTE) else None


# The indexed colours; the first eight repeat.
_EIGHT = ("#000000", "#FFFFFF", "#FF0000", "#00FF00", "#0000FF", "#FFFF00", "#FF00FF", "#00FFFF")
PALETTE = (
    *_EIGHT, *_EIGHT, "#800000", "#008000", "#000080", "#808000", "#800080", "#008080", "#C0C0C0", "#808080", "#9999FF", "#993366", "#FFFFCC",
    "#CCFFFF", "#660066", "#FF8080", "#0066CC", "#CCCCFF", "#000080", "#FF00FF", "#FFFF00", "#00FFFF", "#800080", "#800000", "#008080", "#0000FF",
    "#00CCFF", "#CCFFFF", "#CCFFCC", "#FFFF99", "#99CCFF", "#FF99CC", "#CC99FF", "#FFCC99", "#3366FF", "#33CCCC", "#99CC00", "#FFCC00", "#FF9900",
    "#FF6600", "#666699", "#969696", "#003366", "#339966", "#003300", "#333300", "#993300", "#993366", "#333399", "#333333",
)


def _styles(package: _Package, data: bytes) -> list[tuple[str | None, tuple]]:
    """(format code, style) of each cell format."""
    codes, fonts, fills, formats = dict(BUILT_IN), [], [], []
    path: list[str] = []

    def start(tag, a):
        path.append(tag)
        inside = path[1] if len(path) > 1 else ""
        if tag == "numFmt" and inside == "numFmts":
            k = _number(a.get("numFmtId"), int)
            if k is not None:
                codes[k] = a.get("formatCode", "")
        elif inside == "fonts" and tag == "font":
            fonts.append({})
        elif inside == "fonts" and fonts and len(path) == 4:
            f = fonts[-1]
            if tag in ("b", "i", "strike"):
                f[tag] = _flag(a.get("val"), True)
            elif tag == "u":
                f["u"] = a.get("val", "single") != "none"
            elif tag == "sz":
                f["sz"] = _number(a.get("val"))
            elif tag == "name":
                f["name"] = a.get("val")
            elif tag == "color":
                f["color"] = _colour(a)
        elif inside == "fills" and tag == "fill":
            fills.append({})
        elif inside == "fills" and tag == "patternFill" and fills:
            fills[-1]["solid"] = a.get("patternType") == "solid"
        elif inside == "fills" and tag == "fgColor" and fills:
            fills[-1]["color"] = _colour(a)
        elif inside == "cellXfs" and tag == "xf":
            formats.append(a)

    def end(tag):
        path.pop()

    package.walk(data, start=start, end=end)
    base = fonts[0] if fonts else {}
    out = []
    for a in formats:
        font = fonts[k] if (k := _number(a.get("fontId"), int)) is not None and 0 <= k < len(fonts) else {}
        fill = fills[k] if (k := _number(a.get("fillId"), int)) is not None and 0 <= k < len(fills) else {}
        plain = font is base or font == base
        style = (
            font.get("b", False), font.get("i", False), font.get("u", False), font.get("strike", False),
            None if plain else font.get("sz"), None if plain else font.get("name"), font.get("color"), fill.get("color") if fill.get("solid") else None,
        )
        out.append((codes.get(_number(a.get("numFmtId"), int) or 0), style))
    return out or [("General", DEFAULT_STYLE)]


def _sheet(package: _Package, data: bytes, sheet: Sheet, strings: list[str], formats: list, epoch_1904: bool, budget: int) -> None:
    """One pass over a worksheet. Cells beyond ``budget`` + 1 only count for the extent."""
    shared: dict[str, tuple[int, int, str]] = {}
    cell: dict = {}
    state = {"row": -1, "col": -1, "text": None, "skip": 0}
    seen = {"rows": 0, "cols": 0}

    def start(tag, a):
        if tag == "c":
            at = parse_cell(a.get("r", "")) or (state["row"], state["col"] + 1)
            state["row"], state["col"] = at
            cell.clear()
            cell.update(at=at, declared="t" in a, t=a.get("t", "n"), s=_number(a.get("s"), int) or 0, v=None, f=None, inline=None)
        elif tag == "row":
            r = _number(a.get("r"), int)
            state["row"], state["col"] = (r - 1 if r else state["row"] + 1), -1
            height = _number(a.get("ht"))
            if height is not None and height >= 0:
                sheet.heights[state["row"]] = height
        elif tag == "v" and cell:
            state["text"] = "v"
            cell["v"] = ""
        elif tag == "f" and cell:
            state["text"] = "f"
            cell["f"], cell["fa"] = "", a
        elif tag == "is" and cell:
            cell["inline"] = ""
        elif tag == "rPh":
            state["skip"] += 1
        elif tag == "t" and cell and cell.get("inline") is not None:
            state["text"] = None if state["skip"] else "inline"
        elif tag == "mergeCell":
            box = parse_range(a.get("ref", ""))
            if box:
                sheet.merges.append(box)
        elif tag == "dimension":
            box = parse_range(a.get("ref", ""))
            if box and box != (0, 0, 0, 0):
                check_extent(box[2] + 1, box[3] + 1, package.limits)
                sheet.rows, sheet.cols = box[2] + 1, box[3] + 1
        elif tag == "sheetFormatPr":
            sheet.default_height = _number(a.get("defaultRowHeight"))
            base = _number(a.get("baseColWidth"))
            width = _number(a.get("defaultColWidth"))
            sheet.default_width = width if width is not None else None if base is None else base + 5 / 7
        elif tag == "col":
            lo, hi, width = _number(a.get("min"), int), _number(a.get("max"), int), _number(a.get("width"))
            if lo and hi and width is not None and width >= 0 and lo <= hi:
                sheet.columns.append((lo - 1, min(hi, 16_384) - 1, width))
        elif tag == "pane" and a.get("state") in ("frozen", "frozenSplit"):
            sheet.frozen = (int(_number(a.get("ySplit")) or 0), int(_number(a.get("xSplit")) or 0))

    def text(chunk):
        if state["text"]:
            cell[state["text"]] += chunk

    def formula_of() -> str | None:
        a, own = cell.get("fa", {}), cell["f"]
        if own is None:
            return None
        if a.get("t") == "shared" and a.get("si") is not None:
            if own:
                shared[a["si"]] = (*cell["at"], own)
            elif a["si"] in shared:
                r, c, anchor = shared[a["si"]]
                return translate(anchor, cell["at"][0] - r, cell["at"][1] - c)
        return own or None

    def end(tag):
        if tag in ("v", "f", "t"):
            state["text"] = None
        elif tag == "rPh":
            state["skip"] -= 1
        elif tag == "c" and cell:
            (r, c), raw, t, f = cell["at"], cell["v"], cell["t"], formula_of()
            seen["rows"], seen["cols"] = max(seen["rows"], r + 1), max(seen["cols"], c + 1)
            code, style = formats[cell["s"]] if 0 <= cell["s"] < len(formats) else ("General", DEFAULT_STYLE)
            kind, value = "n", None
            if t == "s":
                k = _number(raw, int)
                kind, value = "s", strings[k] if k is not None and 0 <= k < len(strings) else None
            elif t == "inlineStr":
                kind, value = "s", cell["inline"]
            elif t == "str":
                kind, value = "s", raw
            elif t == "b":
                kind, value = "b", None if raw in (None, "") else _flag(raw)
            elif t == "e":
                kind, value = "e", raw or None
            elif t == "d":
                kind, value = "iso", raw or None
            else:
                value = _number(raw) if raw else None
            if value == "" and f is None:
                value = None
            if value is None and f is not None:
                kind = _DECLARED.get(t, "s") if cell["declared"] else "s" if raw is None else kind
            made = normal_cell(r, c, kind, value, f, code, epoch_1904, style)
            if made and len(sheet.cells) <= budget:
                sheet.cells.append(made)
            cell.clear()

    package.walk(data, start=start, end=end, text=text)
    sheet.rows, sheet.cols = max(sheet.rows, seen["rows"]), max(sheet.cols, seen["cols"])
    check_extent(sheet.rows, sheet.cols, package.limits)
    sheet.merges = sorted(set(sheet.merges))


def read(content: bytes, limits: Limits) -> Book:
    package = _Package(content, limits)
    book = Book()
    office = [t for kind, t in package.relations("").values() if kind == "officeDocument"]
    where = office[0] if office and package.part(office[0]) is not None else "xl/workbook.xml"
    data = package.part(where)
    if data is None:
        raise Refused("unsupported", "there is no workbook part")
    if where.lower() != "xl/workbook.xml":
        book.warnings.append(f"the workbook part is {where}")
    relations = package.relations(where)
    listed: list[tuple[str, str]] = []

    def start(tag, a):
        if tag == "sheet":
            listed.append((a.get("name", ""), a.get("id", "")))
        elif tag == "workbookPr":
            book.date_1904 = _flag(a.get("date1904"))

    package.walk(data, start=start)
    by_kind = {kind: t for kind, t in relations.values()}
    raw = package.part(by_kind.get("sharedStrings", "xl/sharedStrings.xml"))
    strings = _shared_strings(package, raw) if raw else []
    raw = package.part(by_kind.get("styles", "xl/styles.xml"))
    formats = _styles(package, raw) if raw else [("General", DEFAULT_STYLE)]
    left = limits.max_cells
    for name, rid in listed:
        sheet = Sheet(name)
        kind, part = relations.get(rid, ("", ""))
        data = package.part(part) if kind == "worksheet" else None
        if data is None:
            book.warnings.append(f"sheet {name!r} is not a worksheet and is empty here")
        else:
            _sheet(package, data, sheet, strings, formats, book.date_1904, left)
            left = max(0, left - len(sheet.cells))
        book.sheets.append(sheet)
    return finish(book, limits)


def where(sheet: Sheet) -> list[str]:
    """A1 names of the sheet's cells."""
    return [cell_name(x[0], x[1]) for x in sheet.cells]
