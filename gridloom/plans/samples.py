"""Small workbooks in memory, for queries and tests of the readers: what a byte layout says is stated here in full."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def relations(*targets: tuple[str, str]) -> str:
    """Relationships rId1, rId2, ... of (kind, target)."""
    return "<Relationships>" + "".join(f'<Relationship Id="rId{k + 1}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(targets)) + "</Relationships>"


def xlsx(sheets: dict[str, str], strings: str = "", styles: str = "", properties: str = "", workbook: str = "xl/workbook.xml", folder: str = "worksheets") -> bytes:
    """``sheets``: name to the inside of its worksheet element."""
    base, file = workbook.rsplit("/", 1)
    listed = [("worksheet", f"{folder}/s{k + 1}.xml") for k in range(len(sheets))] + [("sharedStrings", "words.xml"), ("styles", "looks.xml")]
    parts = {
        "_rels/.rels": relations(("officeDocument", workbook)),
        f"{base}/_rels/{file}.rels": relations(*listed),
        workbook: f'<workbook xmlns:r="r"><workbookPr {properties}/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>",
        f"{base}/words.xml": f"<sst>{strings}</sst>",
        f"{base}/looks.xml": f"<styleSheet>{styles}</styleSheet>",
    }
    return package(parts | {f"{base}/{folder}/s{k + 1}.xml": f"<worksheet>{inside}</worksheet>" for k, inside in enumerate(sheets.values())})


def reader_book() -> bytes:
    """Every kind of cell on one sheet, dates from 1904, shared and rich texts, formats, styles, merges and widths."""
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="0.0000 &quot;widgets&quot;"/></numFmts>'
        '<fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="14"/><name val="Arial"/><color rgb="FFFF0000"/></font></fonts>'
        '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill></fills>'
        '<cellXfs><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="14" fontId="1" fillId="0"/><xf numFmtId="164" fontId="1" fillId="0"/><xf numFmtId="4" fontId="0" fillId="1"/><xf numFmtId="165" fontId="0" fillId="0"/></cellXfs>'
    )
    strings = "<si><t>Hello shared</t></si><si><r><t>Rich</t></r><r><t xml:space=\"preserve\"> text</t></r><rPh><t>no</t></rPh></si>"
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c><c r="C1" t="e"><v>#DIV/0!</v></c><c r="D1" s="2"><v>0</v></c><c r="E1" s="1"><v>1</v></c><c r="F1" t="s"><v>1</v></c><c r="G1" s="3"><v>1234.5</v></c></row>'
        '<row r="2" ht="30.5"><c r="A2"><v>2</v></c><c r="B2"><v>3</v></c><c r="C2"><f>SUM(A2:B2)</f><v>5</v></c><c r="D2" t="str"><f>CONCAT("x","y")</f><v>xy</v></c><c r="E2" t="n"><f>A2/0</f></c><c r="F2"><f>UNSUPPORTED()</f></c><c r="G2" s="4"><v>12.3456</v></c></row>'
        '<row r="3"><c r="A3" t="inlineStr"><is><t>Merged</t></is></c></row>'
    )
    inside = (
        '<dimension ref="A1:G4"/><sheetViews><sheetView><pane xSplit="1" ySplit="2" state="frozen"/></sheetView></sheetViews><sheetFormatPr defaultRowHeight="14.4" defaultColWidth="9.14"/>'
        '<cols><col min="1" max="1" width="12.5"/><col min="2" max="4" width="20"/><col min="7" max="7" width="15.25"/></cols>'
        f'<sheetData>{rows}</sheetData><mergeCells><mergeCell ref="D3:F4"/><mergeCell ref="A3:B3"/></mergeCells>'
    )
    return xlsx({"Reader": inside}, strings, styles, 'date1904="1"')


def shared_formula_book() -> bytes:
    """A shared formula at its anchor and below, one with absolute parts, and two sheets; parts under unusual names."""
    first = (
        '<sheetData><row r="1"><c r="A1"><v>4</v></c><c r="B1"><v>3</v></c><c r="C1"><f t="shared" si="0" ref="C1:C3">A1*2+$B$1</f><v>11</v></c></row>'
        '<row r="2"><c r="A2"><v>5</v></c><c r="C2"><f t="shared" si="0"/><v>13</v></c></row><row r="3"><c r="A3"><v>6</v></c><c r="C3"><f t="shared" si="0"/><v>15</v></c></row></sheetData>'
    )
    second = '<sheetData><row r="1"><c r="A1"><f>First!C3+1</f><v>16</v></c><c r="B1" t="b"><f>A1&gt;10</f><v>1</v></c></row></sheetData>'
    return xlsx({"First": first, "Second": second}, workbook="content/book.xml", folder="pages")


def record(kind: int, data: bytes) -> bytes:
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


def xls(extra: bytes = b"", globals_extra: bytes = b"") -> bytes:
    """Numbers, a formula, shared text, an error, a packed number, a row of packed numbers, a merge, sizes and a frozen pane.
    ``extra`` are records added to the sheet, ``globals_extra`` to the globals."""
    glob = record(0x0809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)) + globals_extra
    glob += record(0x041E, struct.pack("<HHB", 164, 4, 0) + b"0.00") + record(0x00E0, struct.pack("<HH", 0, 164) + b"\0" * 16)
    table = record(0x00FC, struct.pack("<II", 1, 1) + struct.pack("<HB", 2, 0) + b"hi")
    name = lambda at: record(0x0085, struct.pack("<IHBB", at, 0, 2, 0) + b"S1")
    start = len(glob + table + name(0) + record(0x000A, b""))
    sheet = record(0x0809, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + record(0x0203, struct.pack("<HHHd", 0, 0, 0, 1.5))
    code = b"\x44" + struct.pack("<HH", 0, 0xC000) + b"\x1e\x02\x00\x05"
    sheet += record(0x0006, struct.pack("<HHHdHIH", 0, 1, 0, 3.0, 0, 0, len(code)) + code)
    sheet += record(0x00FD, struct.pack("<HHHI", 1, 0, 0, 0)) + record(0x0205, struct.pack("<HHHBB", 1, 1, 0, 7, 1)) + record(0x027E, struct.pack("<HHHI", 2, 0, 0, 5 << 2 | 2))
    sheet += record(0x00BD, struct.pack("<HH", 3, 0) + struct.pack("<HI", 0, 7 << 2 | 2) + struct.pack("<HI", 0, 8 << 2 | 2) + struct.pack("<H", 1))
    sheet += record(0x00E5, struct.pack("<HHHHH", 1, 4, 5, 0, 1)) + record(0x007D, struct.pack("<HHHHHH", 1, 2, 2560, 0, 0, 0))
    sheet += record(0x0208, struct.pack("<HHHHHHBBH", 2, 0, 2, 600, 0, 0, 0x40, 1, 0)) + record(0x023E, struct.pack("<H", 8)) + record(0x0041, struct.pack("<HHHHH", 1, 2, 0, 0, 0))
    return compound(glob + table + name(start) + record(0x000A, b"") + sheet + extra + record(0x000A, b""))


def wide(text: str) -> bytes:
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def part_record(kind: int, data: bytes) -> bytes:
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size = len(data)
    return head + (bytes([size]) if size < 128 else bytes([size & 0x7F | 0x80, size >> 7])) + data


def xlsb() -> bytes:
    sheet = part_record(0, struct.pack("<IIHHB", 0, 0, 0, 0, 0)) + part_record(5, struct.pack("<IId", 0, 0, 2.5)) + part_record(6, struct.pack("<II", 1, 0) + wide("txt"))
    code = b"\x44" + struct.pack("<IH", 0, 0xC000) + b"\x1e\x03\x00\x03"
    sheet += part_record(9, struct.pack("<IId", 2, 0, 5.5) + b"\0\0" + struct.pack("<I", len(code)) + code + struct.pack("<I", 0))
    sheet += part_record(0, struct.pack("<IIHHB", 1, 0, 0, 0, 0)) + part_record(3, struct.pack("<IIB", 0, 0, 7)) + part_record(4, struct.pack("<IIB", 1, 0, 1))
    bundle = part_record(156, struct.pack("<II", 0, 1) + wide("rId1") + wide("Bin"))
    return package({"_rels/.rels": relations(("officeDocument", "xl/workbook.bin")), "xl/workbook.bin": bundle, "xl/_rels/workbook.bin.rels": relations(("worksheet", "worksheets/sheet1.bin")), "xl/worksheets/sheet1.bin": sheet})


def ods() -> bytes:
    content = """<d:document-content xmlns:d="o" xmlns:t="t" xmlns:x="x" xmlns:v="v"><d:spreadsheet><t:table t:name="T">
      <t:table-row><t:table-cell v:value-type="float" v:value="3"/><t:table-cell t:number-columns-repeated="2" v:value-type="string"><x:p>ab</x:p></t:table-cell></t:table-row>
      <t:table-row t:number-rows-repeated="3"><t:table-cell/></t:table-row>
      <t:table-row><t:table-cell v:value-type="date" v:date-value="2020-01-02T00:00:00"/><t:table-cell t:formula="of:=[.A1]+1" v:value-type="float" v:value="4"/><t:table-cell v:value-type="boolean" v:boolean-value="true"/></t:table-row>
    </t:table></d:spreadsheet></d:document-content>"""
    return package({"content.xml": content})


def formula_book() -> bytes:
    """What-ifs: a literal, a formula under a format, one on that, one that no evaluator here knows, and a date."""
    styles = '<numFmts><numFmt numFmtId="164" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs>'
    rows = (
        '<row r="1"><c r="A1" s="1"><v>2</v></c><c r="B1" s="1"><f>A1*2</f><v>4</v></c><c r="C1"><f>B1+1</f><v>5</v></c></row>'
        '<row r="2"><c r="A2" t="inlineStr"><is><t>a,"b"</t></is></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="2"><v>45351</v></c></row>'
        '<row r="3"><c r="A3"><f>VLOOKUP(1,A1:B2,1)</f><v>7</v></c></row>'
    )
    return xlsx({"Main": f"<sheetData>{rows}</sheetData>", "Second": '<sheetData><row r="5"><c r="C5" t="inlineStr"><is><t>far</t></is></c></row></sheetData>'}, styles=styles)


def files(spark: SparkSession, contents: dict[str, bytes]) -> DataFrame:
    """(path, length, content) as Spark's file source gives them."""
    return spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in contents.items()], "path string, length long, content binary")
