"""ODS: values and formulas of content.xml; formats and merges are not read, which a warning says."""

from __future__ import annotations

from gridloom.sources.book import Book, Sheet, finish, normal_cell
from gridloom.sources.rails import Clock, Limits, Refused, check_extent, open_zip, read_part, walk_xml

WARNING = "number formats, styles and merged ranges of ODS files are not read"


def read(content: bytes, limits: Limits) -> Book:
    archive = open_zip(content, limits)
    if "content.xml" not in archive.namelist():
        raise Refused("unsupported", "there is no content part")
    book = Book(warnings=[WARNING])
    at = {"r": 0, "c": 0, "rows": 1, "depth": 0}
    cell: dict = {}
    row: list = []

    def start(tag, a):
        if tag == "table" and at["depth"] == 0:
            book.sheets.append(Sheet(a.get("name", "")))
            at.update(r=0)
        at["depth"] += tag == "table"
        if not book.sheets:
            return
        if tag == "table-row":
            at.update(c=0, rows=max(1, int(a.get("number-rows-repeated", "1"))))
            row.clear()
        elif tag in ("table-cell", "covered-table-cell"):
            cell.clear()
            cell.update(a=a, n=max(1, int(a.get("number-columns-repeated", "1"))), text=[], on=False)
        elif tag == "p" and cell:
            if cell["text"]:
                cell["text"].append("\n")
            cell["on"] = True
        elif tag == "s" and cell:
            cell["text"].append(" " * int(a.get("c", "1")))
        elif tag == "tab" and cell:
            cell["text"].append("\t")
        elif tag == "annotation":
            cell["on"] = False

    def text(chunk):
        if cell and cell.get("on"):
            cell["text"].append(chunk)

    def value() -> tuple[str, object]:
        a, shown = cell["a"], "".join(cell["text"])
        kind = a.get("value-type", "")
        if kind in ("float", "percentage", "currency"):
            return "n", float(a.get("value", "nan"))
        if kind == "boolean":
            return "b", a.get("boolean-value") == "true"
        if kind == "date":
            return "iso", a.get("date-value", "")
        if kind == "time":
            return "s", a.get("time-value", "")
        if kind == "string" or shown:
            return "s", a.get("string-value", shown) or None
        return "s", None

    def end(tag):
        if tag == "table":
            at["depth"] -= 1
        elif tag == "p" and cell:
            cell["on"] = False
        elif tag in ("table-cell", "covered-table-cell") and cell:
            kind, v = value()
            f = cell["a"].get("formula")
            if v is not None or f is not None:
                row.extend((at["c"] + k, kind, v, f) for k in range(min(cell["n"], 16_384)))
            at["c"] += cell["n"]
            cell.clear()
        elif tag == "table-row" and book.sheets:
            sheet = book.sheets[-1]
            for r in range(at["r"], at["r"] + at["rows"]) if row else ():
                if len(sheet.cells) > limits.max_cells:
                    break
                for c, kind, v, f in row:
                    check_extent(r + 1, c + 1, limits)
                    made = normal_cell(r, c, kind, v, f, None, False)
                    if made:
                        sheet.cells.append(made)
            at["r"] += at["rows"]

    walk_xml(read_part(archive, "content.xml", limits), limits, Clock(limits.timeout_s), start, end, text)
    return finish(book, limits)
