import io
import json
import struct
import zipfile

import pytest

from gridloom.serve import serve
from gridloom.sinks import xlsx as sink
from gridloom.sources import rails, workbooks, xls, xlsb
from gridloom.workbook import Refusal, Session, open_workbook

LIMITS = rails.Limits()


def cell(sheet, r, c, t, v, f=None, fmt=None, s=None):
    return {"sheet": sheet, "r": r, "c": c, "t": t, "v": v, "f": f, "fmt": fmt, "s": s}


@pytest.fixture(scope="module")
def book_path(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("book") / "one.xlsx")
    cells = [
        cell(0, 0, 0, "n", 2.0, None, "0.00"), cell(0, 0, 1, "n", 4.0, "A1*2", "0.00"), cell(0, 0, 2, "n", 5.0, "B1+1"),
        cell(0, 1, 0, "s", 'a,"b"'), cell(0, 1, 1, "b", True), cell(0, 2, 0, "d", "2024-02-29"), cell(0, 2, 1, "n", 1234.5, None, "#,##0.0", 0),
        cell(0, 3, 0, "n", 0.0, "VLOOKUP(1,A1:B2,1)"), cell(1, 4, 2, "s", "far"),
    ]
    sheets = [{"name": "Main", "merges": [(4, 0, 5, 1)], "cols": {1: 22.5}, "rows": {0: 30.6}, "frozen": (1, 0)}, {"name": "Second"}]
    sink.write(path, sheets, iter(cells), {0: (True, False, False, False, None, None, "#FF0000", None)})
    return path


def test_open_meta_window(spark, book_path):
    book = open_workbook(spark, book_path)
    meta = book.meta()
    assert [(s["name"], s["rows"], s["cols"]) for s in meta["sheets"]] == [("Main", 4, 3), ("Second", 5, 3)]
    assert meta["sheets"][0]["frozenRows"] == 1
    w = book.window(0, 0, 0, 10, 10)
    assert (w["nr"], w["nc"]) == (4, 3)
    first = w["rows"][0]
    assert first[0]["d"] == "2.00" and first[1] == {"t": "n", "v": 4.0, "d": "4.00", "f": "A1*2", "fmt": "0.00", "s": None, "e": True}
    assert w["rows"][2][0]["t"] == "d" and w["rows"][2][0]["v"] == "2024-02-29"
    assert w["rows"][3][0]["e"] is False
    assert book.window(0, 3, 0, 9, 9)["merges"] == [] and book.window(0, 100, 0, 5, 5)["nr"] == 0
    with pytest.raises(Refusal):
        book.window(7, 0, 0, 1, 1)
    book.close()


def test_recalc_and_exports(spark, book_path, tmp_path):
    book = open_workbook(spark, book_path)
    got = book.recalc([{"sheet": 0, "r": 0, "c": 0, "v": 3}, {"sheet": 0, "r": 0, "c": 0, "v": 4}])
    assert [(x["r"], x["c"], x["v"], x["d"], x["e"]) for x in got["changed"]] == [(0, 0, 4.0, "4.00", False), (0, 1, 8.0, "8.00", True), (0, 2, 9.0, None, True)]
    assert got["evaluated"] == 2 and book.recalc()["changed"] == []
    out = str(tmp_path / "o.csv")
    said = book.export_csv(out, 0, [{"sheet": 0, "r": 0, "c": 0, "v": 4}, {"sheet": 1, "r": 0, "c": 0, "v": 1}])
    text = open(out, newline="").read()
    assert said["applied"] == 1 and text.startswith('4.00,8.00,9\r\n"a,""b""",TRUE,\r\n') and text.count("\r\n") == 4
    out = str(tmp_path / "o.xlsx")
    book.export_xlsx(out, [{"sheet": 0, "r": 0, "c": 0, "v": 10}, {"sheet": 0, "r": 9, "c": 0, "f": "=SUM(A1:B1)"}], [(0, "col", 0, 400.0)])
    again = open_workbook(spark, out)
    rows = again.window(0, 0, 0, 20, 5)["rows"]
    assert rows[0][0]["v"] == 10.0 and rows[0][1]["v"] == 20.0 and rows[9][0]["v"] == 30.0 and rows[9][0]["f"] == "SUM(A1:B1)"
    sizes = {(r.axis, r.at): r["size"] for r in again.tables.sizes.collect() if r.sheet == 0}
    assert sizes[("col", 0)] == 255.0 and sizes[("col", 1)] == 22.5 and sizes[("row", 0)] == 30.6
    assert {r.a1 for r in again.tables.merges.collect()} == {"A5:B6"}
    assert again.tables.styles.first().font_color == "#FF0000"
    again.close()
    book.close()


def test_session_lines(spark, book_path, tmp_path):
    session = Session(spark)
    ask = [
        {"id": 1, "op": "version"}, {"id": 2, "op": "open", "path": book_path}, {"id": 3, "op": "window", "handle": 1, "sheet": 0, "r0": 0, "c0": 0, "nr": 1, "nc": 1},
        {"id": 4, "op": "nope"}, {"id": 5, "op": "close", "handle": 1}, {"id": 6, "op": "meta", "handle": 1}, {"id": 7, "op": "stats"},
    ]
    got = [json.loads(x) for x in serve(session, [*map(json.dumps, ask), "not json"])]
    assert [x["ok"] for x in got] == [True, True, True, False, True, False, True, False]
    assert got[2]["rows"][0][0]["v"] == 2.0


def test_refusals_are_rows(spark, tmp_path, book_path):
    (tmp_path / "corrupt.xlsx").write_bytes(b"this is not a zip archive, not at all..")
    (tmp_path / "what.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "doctype.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<!DOCTYPE x [<!ENTITY a "b">]><workbook/>')
    rows = {r.workbook.rpartition("/")[2]: r for r in workbooks.read(spark, str(tmp_path)).workbooks.collect()}
    assert {k: (r.ok, r.code) for k, r in rows.items()} == {"corrupt.xlsx": (False, "bad_zip"), "what.txt": (False, "unsupported"), "doctype.xlsx": (False, "bomb")}
    capped = workbooks.read(spark, book_path, rails.Limits(max_cells=4))
    assert capped.cells.count() == 4 and [r.truncated for r in capped.sheets.orderBy("sheet").collect()] == [True, True]


def biff(kind, data):
    return struct.pack("<HH", kind, len(data)) + data


def compound(stream: bytes) -> bytes:
    """The smallest compound file with a Workbook stream of at least 4096 bytes."""
    stream = stream.ljust(4096, b"\0")
    n = -(-len(stream) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [k + 3 for k in range(n - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(name, kind, first, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", first, size)

    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<IIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * 432
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(stream))).ljust(512, b"\0")
    return head[:512].ljust(512, b"\xff") + struct.pack("<128I", *fat) + directory + stream.ljust(n * 512, b"\0")


def test_xls():
    glob = biff(0x0809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    glob += biff(0x041E, struct.pack("<HHB", 164, 4, 0) + b"0.00") + biff(0x00E0, struct.pack("<HH", 0, 164) + b"\0" * 16)
    sst = biff(0x00FC, struct.pack("<II", 1, 1) + struct.pack("<HB", 2, 0) + b"hi")
    name = lambda at: biff(0x0085, struct.pack("<IHBB", at, 0, 2, 0) + b"S1")
    start = len(glob + sst + name(0) + biff(0x000A, b""))
    sheet = biff(0x0809, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + biff(0x0203, struct.pack("<HHHd", 0, 0, 0, 1.5))
    code = b"\x44" + struct.pack("<HH", 0, 0xC000) + b"\x1e\x02\x00\x05"
    sheet += biff(0x0006, struct.pack("<HHHdHIH", 0, 1, 0, 3.0, 0, 0, len(code)) + code)
    sheet += biff(0x00FD, struct.pack("<HHHI", 1, 0, 0, 0)) + biff(0x0205, struct.pack("<HHHBB", 1, 1, 0, 7, 1)) + biff(0x027E, struct.pack("<HHHI", 2, 0, 0, 5 << 2 | 2))
    sheet += biff(0x00E5, struct.pack("<HHHHH", 1, 3, 4, 0, 1)) + biff(0x000A, b"")
    book = xls.read(compound(glob + sst + name(start) + biff(0x000A, b"") + sheet), LIMITS)
    cells = {(x[0], x[1]): x[2:7] for x in book.sheets[0].cells}
    assert cells[0, 0] == ("n", 1.5, "1.50", None, "0.00") and cells[0, 1] == ("n", 3.0, "3.00", "A1*2", "0.00")
    assert cells[1, 0][:2] == ("s", "hi") and cells[1, 1][:2] == ("e", "#DIV/0!") and cells[2, 0][1] == 5.0
    assert book.sheets[0].merges == [(3, 0, 4, 1)]
    with pytest.raises(rails.Refused):
        xls.read(compound(glob)[:600], LIMITS)


def rec(kind, data):
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size = len(data)
    return head + (bytes([size]) if size < 128 else bytes([size & 0x7F | 0x80, size >> 7])) + data


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def test_xlsb():
    sheet = rec(0, struct.pack("<IIHHB", 0, 0, 0, 0, 0)) + rec(5, struct.pack("<IId", 0, 0, 2.5)) + rec(6, struct.pack("<II", 1, 0) + wide("txt"))
    code = b"\x44" + struct.pack("<IH", 0, 0xC000) + b"\x1e\x03\x00\x03"
    sheet += rec(9, struct.pack("<IId", 2, 0, 5.5) + b"\0\0" + struct.pack("<I", len(code)) + code + struct.pack("<I", 0))
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="r" Type="{rel}/officeDocument" Target="xl/workbook.bin"/></Relationships>')
        z.writestr("xl/workbook.bin", rec(156, struct.pack("<II", 0, 1) + wide("rId1") + wide("Bin")))
        z.writestr("xl/_rels/workbook.bin.rels", f'<Relationships><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.bin"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.bin", sheet)
    book = xlsb.read(out.getvalue(), LIMITS)
    assert book.sheets[0].name == "Bin"
    assert [x[1:4] + x[5:6] for x in book.sheets[0].cells] == [(0, "n", 2.5, None), (1, "s", "txt", None), (2, "n", 5.5, "A1+3")]


def test_ods():
    content = """<d:document-content xmlns:d="o" xmlns:t="t" xmlns:x="x" xmlns:v="v"><d:spreadsheet><t:table t:name="T">
      <t:table-row><t:table-cell v:value-type="float" v:value="3"/><t:table-cell t:number-columns-repeated="2" v:value-type="string"><x:p>ab</x:p></t:table-cell></t:table-row>
      <t:table-row t:number-rows-repeated="3"><t:table-cell/></t:table-row>
      <t:table-row><t:table-cell v:value-type="date" v:date-value="2020-01-02T00:00:00"/><t:table-cell t:formula="of:=[.A1]+1" v:value-type="float" v:value="4"/></t:table-row>
    </t:table></d:spreadsheet></d:document-content>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", content)
    book = workbooks.parse("x.ods", out.getvalue(), LIMITS)
    assert [x[:4] for x in book.sheets[0].cells] == [(0, 0, "n", 3.0), (0, 1, "s", "ab"), (0, 2, "s", "ab"), (4, 0, "d", "2020-01-02"), (4, 1, "n", 4.0)]
    assert book.sheets[0].cells[-1][5] == "[.A1]+1" and book.warnings
