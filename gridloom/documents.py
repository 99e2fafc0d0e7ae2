"""The normalised document of one workbook, as a tool prints it: strict checks of its fields and order."""

from __future__ import annotations

import json
import re

from gridloom import schema
from gridloom.a1 import parse_range

# The fields of a document and its parts; those in the second set may be absent.
DOCUMENT = ({"schema", "tool", "toolVersion", "file", "sha256", "ok", "error", "wallMs", "peakRssBytes", "truncated", "sheets", "warnings"}, {"styles"})
SHEET = ({"name", "index", "rows", "cols", "truncated", "merges", "cells"}, {"frozenRows", "frozenCols", "colInfos", "rowInfos", "defaultRowHeight", "defaultColWidth"})
CELL = ({"r", "c", "t", "v", "d", "f", "fmt"}, {"s"})


def strictly_sorted(values: list) -> bool:
    return all(a < b for a, b in zip(values, values[1:]))


def field_faults(value, where: str, fields: tuple[set, set]) -> list[str]:
    """Fields that ``value`` lacks or has beyond those that it may have."""
    if not isinstance(value, dict):
        return [f"{where}: no object"]
    needed, optional = fields
    out = [f"{where}: {n} is missing" for n in sorted(needed - value.keys())]
    return out + [f"{where}: {n} is unknown" for n in sorted(value.keys() - needed - optional)]


def _fits(t, v) -> bool:
    if v is None:
        return True
    if t == "n":
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    return isinstance(v, bool) if t == "b" else isinstance(v, str)


def faults(document, sha256: str | None = None, tool: str | None = None) -> list[str]:
    """What is wrong with a document, empty for a sound one."""
    out = field_faults(document, "document", DOCUMENT)
    if out:
        return out
    if document["schema"] != schema.SCHEMA_VERSION:
        out.append("document: unknown schema")
    if tool is not None and document["tool"] != tool:
        out.append("document: another tool's")
    if document["sha256"] is not None and not re.fullmatch(r"[0-9a-f]{64}", str(document["sha256"])) or sha256 not in (None, document["sha256"]):
        out.append("document: sha256 does not fit")
    if document["ok"] != (document["error"] is None):
        out.append("document: ok and error disagree")
    if document["truncated"] != any(s.get("truncated") for s in document["sheets"] if isinstance(s, dict)):
        out.append("document: truncated is not what its sheets say")
    styles = len(document.get("styles") or [])
    for k, sheet in enumerate(document["sheets"]):
        where = f"sheet {k}"
        if wrong := field_faults(sheet, where, SHEET):
            out += wrong
            continue
        if sheet["index"] != k:
            out.append(f"{where}: index is {sheet['index']}")
        boxes = [parse_range(m) for m in sheet["merges"]]
        if None in boxes or not strictly_sorted(sheet["merges"]):
            out.append(f"{where}: merges are not sorted ranges")
        if wrong := [x for j, c in enumerate(sheet["cells"]) for x in field_faults(c, f"{where}, cell {j}", CELL)]:
            out += wrong
            continue
        if not strictly_sorted([(c["r"], c["c"]) for c in sheet["cells"]]):
            out.append(f"{where}: cells are not in order")
        for c in sheet["cells"]:
            at = f"{where}, cell ({c['r']}, {c['c']})"
            if not (0 <= c["r"] < sheet["rows"] and 0 <= c["c"] < sheet["cols"]):
                out.append(f"{at}: outside the extent")
            if c["t"] not in schema.TYPES or not _fits(c["t"], c["v"]):
                out.append(f"{at}: value does not fit its type")
            if c.get("s") is not None and not 0 <= c["s"] < styles:
                out.append(f"{at}: no such style")
    return out


def parse(text: str | bytes, sha256: str | None = None, tool: str | None = None) -> tuple[dict | None, list[str]]:
    """(the document or null, what is wrong)."""
    try:
        document = json.loads(text)
    except ValueError as problem:
        return None, [f"document: {problem}"]
    wrong = faults(document, sha256, tool)
    return (None if wrong else document), wrong
