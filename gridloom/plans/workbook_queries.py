"""Queries of the readers, rails, stores and sinks over small workbooks that are built in memory."""

from __future__ import annotations

import os
import struct
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions import numfmt
from gridloom.operators import diff, formulas, overrides, scoreboard, store, validate
from gridloom.plans import samples
from gridloom.plans.twins import expects
from gridloom.session import ready, shared_path
from gridloom.sinks import csv as csv_sink
from gridloom.sinks import xlsx as xlsx_sink
from gridloom.sources import manifests, rails, workbooks

CELL = "r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string, s int"
VALUE = "r int, c int, t string, vn double, vs string, vb boolean, f string"


def tables(spark: SparkSession, contents: dict[str, bytes], limits: rails.Limits = rails.Limits()) -> workbooks.Workbooks:
    ready(spark)
    return workbooks.from_files(samples.files(spark, contents), limits)


def text_files(spark: SparkSession, name: str, lines: list[str]) -> str:
    """A folder of one text file in the shared folder."""
    ready(spark)
    path = shared_path(spark, name, *lines)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


# Readers.


@expects(
    "read_xlsx_cells", CELL,
    [
        (0, 0, "s", None, "Hello shared", None, "Hello shared", None, None, None), (0, 1, "b", None, None, True, "TRUE", None, None, None), (0, 2, "e", None, "#DIV/0!", None, "#DIV/0!", None, None, None),
        (0, 3, "d", None, "1904-01-01", None, "1904-01-01", None, "yyyy-mm-dd", 0), (0, 4, "d", None, "1904-01-02", None, "01-02-04", None, "mm-dd-yy", 0), (0, 5, "s", None, "Rich text", None, "Rich text", None, None, None),
        (0, 6, "n", 1234.5, None, None, "1,234.50", None, "#,##0.00", 1), (1, 0, "n", 2.0, None, None, "2", None, None, None), (1, 1, "n", 3.0, None, None, "3", None, None, None),
        (1, 2, "n", 5.0, None, None, "5", "SUM(A2:B2)", None, None), (1, 3, "s", None, "xy", None, "xy", 'CONCAT("x","y")', None, None), (1, 4, "n", None, None, None, None, "A2/0", None, None),
        (1, 5, "s", None, None, None, None, "UNSUPPORTED()", None, None), (1, 6, "n", 12.3456, None, None, "12.3456 widgets", None, '0.0000 "widgets"', None), (2, 0, "s", None, "Merged", None, "Merged", None, None, None),
    ],
)
def read_xlsx_cells(spark):
    return tables(spark, {"reader.xlsx": samples.reader_book()}).cells


@expects("read_xlsx_sheets", "name string, rows long, cols long, truncated boolean, frozen_rows int, frozen_cols int, default_row_height double, default_col_width double", [("Reader", 4, 7, False, 2, 1, 14.4, 9.14)])
def read_xlsx_sheets(spark):
    return tables(spark, {"reader.xlsx": samples.reader_book()}).sheets


@expects("read_xlsx_merges", "a1 string, r0 int, c0 int, r1 int, c1 int", [("A3:B3", 2, 0, 2, 1), ("D3:F4", 2, 3, 3, 5)])
def read_xlsx_merges(spark):
    return tables(spark, {"reader.xlsx": samples.reader_book()}).merges


@expects("read_xlsx_sizes", "axis string, at int, size double", [("col", 0, 12.5), ("col", 1, 20.0), ("col", 2, 20.0), ("col", 3, 20.0), ("col", 6, 15.25), ("row", 1, 30.5)])
def read_xlsx_sizes(spark):
    return tables(spark, {"reader.xlsx": samples.reader_book()}).sizes


@expects(
    "read_xlsx_styles", "style_id int, bold boolean, italic boolean, underline boolean, strike boolean, font_size double, font_name string, font_color string, fill_color string",
    [(0, True, False, False, False, 14.0, "Arial", "#FF0000", None), (1, False, False, False, False, None, None, None, "#00FF00")],
)
def read_xlsx_styles(spark):
    return tables(spark, {"reader.xlsx": samples.reader_book()}).styles


@expects("read_xlsx_book", "workbook string, ok boolean, code string, truncated boolean, date_1904 boolean, warnings string", [("reader.xlsx", True, None, False, True, ""), ("shared.xlsm", True, None, False, False, "the workbook part is content/book.xml")])
def read_xlsx_book(spark):
    books = tables(spark, {"reader.xlsx": samples.reader_book(), "shared.xlsm": samples.shared_formula_book()}).workbooks
    return books.withColumn("warnings", F.array_join("warnings", "; "))


@expects("read_shared_formulas", "sheet int, r int, c int, vn double, f string", [(0, 0, 2, 11.0, "A1*2+$B$1"), (0, 1, 2, 13.0, "A2*2+$B$1"), (0, 2, 2, 15.0, "A3*2+$B$1"), (1, 0, 0, 16.0, "First!C3+1"), (1, 0, 1, None, "A1>10")])
def read_shared_formulas(spark):
    """Also a package whose parts have unusual names: they are found through their relations."""
    return tables(spark, {"shared.xlsx": samples.shared_formula_book()}).cells.filter("f IS NOT NULL")


@expects("read_capped", "r int, c int, truncated boolean, rows long, cols long", [(0, 0, True, 4, 7), (0, 1, True, 4, 7), (0, 2, True, 4, 7), (0, 3, True, 4, 7)])
def read_capped(spark):
    """The first four cells; the extent stays the sheet's."""
    got = tables(spark, {"reader.xlsx": samples.reader_book()}, rails.Limits(max_cells=4))
    return got.cells.join(got.sheets, ["workbook", "sheet"])


@expects(
    "read_xls_cells", VALUE,
    [
        (0, 0, "n", 1.5, None, None, None), (0, 1, "n", 3.0, None, None, "A1*2"), (1, 0, "s", None, "hi", None, None), (1, 1, "e", None, "#DIV/0!", None, None), (2, 0, "n", 5.0, None, None, None),
        (3, 0, "n", 7.0, None, None, None), (3, 1, "n", 8.0, None, None, None),
    ],
)
def read_xls_cells(spark):
    return tables(spark, {"old.xls": samples.xls()}).cells


@expects("read_xls_layout", "what string, at string, size double", [("merge", "A5:B6", None), ("col", "1", 10.0), ("col", "2", 10.0), ("row", "2", 30.0), ("frozen", "2,1", None), ("format", "0.00", None)])
def read_xls_layout(spark):
    got, none = tables(spark, {"old.xls": samples.xls()}), F.lit(None).cast("double")
    parts = [
        got.merges.select(F.lit("merge").alias("what"), F.col("a1").alias("at"), none.alias("size")), got.sizes.select(F.col("axis").alias("what"), F.col("at").cast("string").alias("at"), "size"),
        got.sheets.select(F.lit("frozen").alias("what"), F.concat_ws(",", "frozen_rows", "frozen_cols").alias("at"), none.alias("size")), got.cells.filter("fmt IS NOT NULL").select(F.lit("format").alias("what"), F.col("fmt").alias("at"), none.alias("size")).distinct(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@expects(
    "read_xlsb_cells", VALUE,
    [(0, 0, "n", 2.5, None, None, None), (0, 1, "s", None, "txt", None, None), (0, 2, "n", 5.5, None, None, "A1+3"), (1, 0, "e", None, "#DIV/0!", None, None), (1, 1, "b", None, None, True, None)],
)
def read_xlsb_cells(spark):
    return tables(spark, {"binary.xlsb": samples.xlsb()}).cells


@expects(
    "read_ods_cells", VALUE,
    [(0, 0, "n", 3.0, None, None, None), (0, 1, "s", None, "ab", None, None), (0, 2, "s", None, "ab", None, None), (4, 0, "d", None, "2020-01-02", None, None), (4, 1, "n", 4.0, None, None, "[.A1]+1"), (4, 2, "b", None, None, True, None)],
)
def read_ods_cells(spark):
    return tables(spark, {"open.ods": samples.ods()}).cells


@expects("read_dispatch", "workbook string, ok boolean, cells long", [("a.XLSX", True, 15), ("b.xlsm", True, 9), ("c.xls", True, 7), ("d.xlsb", True, 5), ("e.ods", True, 6), ("f.txt", False, 0), ("g", False, 0)])
def read_dispatch(spark):
    """The reader goes by the extension, whatever its case; other files are refused as rows."""
    got = tables(spark, {"a.XLSX": samples.reader_book(), "b.xlsm": samples.shared_formula_book(), "c.xls": samples.xls(), "d.xlsb": samples.xlsb(), "e.ods": samples.ods(), "f.txt": b"x", "g": b"y"})
    counts = got.cells.groupBy("workbook").agg(F.count(F.lit(1)).alias("n"))
    return got.workbooks.join(counts, "workbook", "left").withColumn("cells", F.coalesce("n", F.lit(0)))


@expects("cell_kinds", "kind string, value double, t string, shown string, iso string", [("General", 45351.0, "n", "45351", None), ("yyyy-mm-dd", 45351.0, "d", "2024-02-29", "2024-02-29"), ("yyyy-mm-dd", -1.0, "n", None, None), ("[h]:mm", 1.5, "n", "36:00", None), ("0.00", 1.5, "n", "1.50", None), ('yyyy-mm-dd"T"hh:mm:ss', 45351.5, "d", "2024-02-29T12:00:00", "2024-02-29T12:00:00")])
def cell_kinds(spark):
    """Which numbers are dates: by their format, unless negative; elapsed times are none."""
    from gridloom.sources.book import normal_cell

    out = []
    for code, v in (("General", 45351.0), ("yyyy-mm-dd", 45351.0), ("yyyy-mm-dd", -1.0), ("[h]:mm", 1.5), ("0.00", 1.5), ('yyyy-mm-dd"T"hh:mm:ss', 45351.5)):
        x = normal_cell(0, 0, "n", v, None, code, False)
        out.append((code, v, x[2], x[4], x[3] if x[2] == "d" else None))
    return out


@expects("iso_dates", "text string, serial double, back string", [("2024-02-29", 45351.0, "2024-02-29"), ("1900-01-01", 1.0, "1900-01-01"), ("1900-02-29", 60.0, "1900-02-29"), ("1900-03-01", 61.0, "1900-03-01"), ("2024-02-29T12:00:00", 45351.5, "2024-02-29T12:00:00"), ("nonsense", None, None)])
def iso_dates(spark):
    serial = [(t, numfmt.iso_to_serial(t)) for t in ("2024-02-29", "1900-01-01", "1900-02-29", "1900-03-01", "2024-02-29T12:00:00", "nonsense")]
    return [(t, s, None if s is None else numfmt.serial_to_iso(s)) for t, s in serial]


@expects("read_overrides_json", "ord int, sheet int, r int, c int, t string, vn double, vs string, vb boolean, f string", [(0, 0, 1, 2, "n", 1.5, None, None, None), (1, 0, 1, 3, "s", None, "1.5", None, None), (2, 1, 0, 0, "b", None, None, True, None), (3, 0, 4, 4, "s", None, None, None, None), (4, 0, 5, 5, "s", None, None, None, "=A1+1")])
def read_overrides_json(spark):
    path = text_files(spark, "overrides", ['[{"sheet":0,"r":1,"c":2,"v":1.5},{"sheet":0,"r":1,"c":3,"v":"1.5"},{"sheet":1,"r":0,"c":0,"v":true},{"sheet":0,"r":4,"c":4,"v":null},{"sheet":0,"r":5,"c":5,"f":"=A1+1"}]'])
    return manifests.overrides(spark, path)


_ENTRY = '{"id":"a.xlsx","path":"corpus/files/a.xlsx","sha256":"00","bytes":3,"ext":"xlsx","collection":"k","source":"https://x","licence":"l","fetchedAt":"2024-01-02T03:04:05Z","private":false}'


@expects("read_manifest", "id string, bytes long, private boolean", [("a.xlsx", 3, False), ("b.xlsx", 4, True)])
def read_manifest(spark):
    return manifests.manifest(spark, text_files(spark, "manifest", [_ENTRY, _ENTRY.replace("a.xlsx", "b.xlsx").replace(":3", ":4").replace("false", "true")]))


@expects("manifest_line_faults", "rule string, n long", [("blank", 1), ("no object", 2), ("missing: bytes, licence", 1), ("unknown: colour", 1)])
def manifest_line_faults(spark):
    lines = [_ENTRY, "", "[1]", "{broken", _ENTRY.replace('"bytes":3,', "").replace('"licence":"l",', ""), _ENTRY.replace("}", ',"colour":1}')]
    return manifests.manifest_faults(spark, text_files(spark, "faults", lines)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@expects("read_filing_index", "form string, url string", [("10-K", "https://www.sec.gov/Archives/edgar/a.txt"), ("10-Q", "https://www.sec.gov/Archives/edgar/c.txt")])
def read_filing_index(spark):
    return manifests.filings(spark, text_files(spark, "filings", ["1|A Company|10-K|2024-01-01|edgar/a.txt", "2|B|8-K|2024-01-02|edgar/b.txt", "3|C \"quoted|10-Q|2024-01-03|edgar/c.txt", "header"]))


@expects("file_sha256", "name string, length long, sha256 string", [("a", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("b", 0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")])
def file_sha256(spark):
    """Hashes of files as the file source gives them."""
    found = samples.files(spark, {"a": b"abc", "b": b""})
    return validate.hashed(found).withColumnRenamed("path", "name")


# Rails.


def refusals(spark, contents: dict[str, bytes], **limits) -> DataFrame:
    return tables(spark, contents, rails.Limits(**limits)).workbooks.select("workbook", "ok", "code")


REFUSED = "workbook string, ok boolean, code string"


@expects("rail_file_size", REFUSED, [("big.xlsx", False, "too_large"), ("small.ods", True, None)])
def rail_file_size(spark):
    small = samples.ods()
    return refusals(spark, {"big.xlsx": samples.reader_book(), "small.ods": small}, max_bytes=len(small))


@expects("rail_zip", REFUSED, [("broken.xlsx", False, "bad_zip"), ("cut.xlsx", False, "bad_zip"), ("many.xlsx", False, "bomb"), ("sealed.xlsx", False, "encrypted"), ("wide.xlsx", False, "bomb")])
def rail_zip(spark):
    book = samples.reader_book()
    many = samples.package({f"p{k}.xml": "<x/>" for k in range(40)})
    wide = samples.package({"xl/workbook.xml": " " * 300_000})
    return refusals(spark, {"broken.xlsx": b"this is not a zip archive, not at all..", "cut.xlsx": book[: len(book) // 2], "many.xlsx": many, "sealed.xlsx": samples.compound(b"x"), "wide.xlsx": wide}, max_entries=30, max_part_bytes=200_000)


def _workbook_part(xml: str) -> bytes:
    return samples.package({"xl/workbook.xml": xml})


@expects("rail_xml", REFUSED, [("deep.xlsx", False, "bomb"), ("doctype.xlsx", False, "bomb"), ("malformed.xlsx", False, "unsupported"), ("none.xlsx", False, "unsupported"), ("tokens.xlsx", False, "bomb")])
def rail_xml(spark):
    contents = {
        "deep.xlsx": _workbook_part("<a>" * 300 + "</a>" * 300), "doctype.xlsx": _workbook_part('<!DOCTYPE x [<!ENTITY a "b">]><workbook/>'), "malformed.xlsx": _workbook_part("<workbook><sheets>"),
        "none.xlsx": samples.package({"other.xml": "<x/>"}), "tokens.xlsx": _workbook_part("<workbook>" + "<x/>" * 3000 + "</workbook>"),
    }
    return refusals(spark, contents, max_tokens=2000)


@expects("rail_references", REFUSED, [("cell.xlsx", False, "bomb"), ("merge.xlsx", False, "bomb"), ("plain.xlsx", True, None)])
def rail_references(spark):
    sheet = lambda inside: samples.xlsx({"S": inside})
    return refusals(spark, {"cell.xlsx": sheet('<sheetData><row><c r="AAAAAAA1"><v>1</v></c></row></sheetData>'), "merge.xlsx": sheet('<mergeCells><mergeCell ref="A1:ZZZZZ9"/></mergeCells>'), "plain.xlsx": sheet('<mergeCells><mergeCell ref="A1:B2"/></mergeCells>')})


@expects("rail_extent", REFUSED, [("corners.xls", False, "bomb"), ("declared.xlsx", False, "bomb"), ("far.xlsx", False, "bomb")])
def rail_extent(spark):
    """A declared extent, one far cell, and two cells at opposite corners, none of which may be laid out."""
    sheet = lambda inside: samples.xlsx({"S": inside})
    corner = samples.record(0x0203, struct.pack("<HHHd", 65_535, 0, 0, 1.0)) + samples.record(0x0203, struct.pack("<HHHd", 0, 255, 0, 1.0))
    return refusals(spark, {"declared.xlsx": sheet('<dimension ref="A1:XFD1048576"/>'), "far.xlsx": sheet('<sheetData><row r="1048576"><c r="XFD1048576"><v>1</v></c></row></sheetData>'), "corners.xls": samples.xls(corner)})


@expects("rail_compound", REFUSED, [("cycle.xls", False, "bomb"), ("header.xls", False, "bad_zip"), ("no_stream.xls", False, "bad_zip")])
def rail_compound(spark):
    """A chain of sectors that loops, a header alone, a file without the workbook's stream."""
    sound = samples.xls()
    cycle = bytearray(sound)
    struct.pack_into("<I", cycle, 512 + 4 * 3, 2)  # sector 3 leads back to sector 2, where the stream begins
    return refusals(spark, {"cycle.xls": bytes(cycle), "header.xls": sound[:100], "no_stream.xls": sound.replace("Workbook".encode("utf-16-le"), "Wookbork".encode("utf-16-le"))})


@expects("rail_records", REFUSED, [("merge.xls", False, "bad_zip"), ("name.xls", False, "bad_zip"), ("numbers.xls", False, "bad_zip"), ("sheet.xls", False, "bad_zip"), ("short.xls", False, "bad_zip"), ("sound.xls", True, None)])
def rail_records(spark):
    """Records shorter than their kind, and those that say they hold more than they do."""
    record = samples.record
    contents = {
        "sound.xls": samples.xls(), "short.xls": samples.xls(record(0x0203, b"\0" * 6)), "merge.xls": samples.xls(record(0x00E5, struct.pack("<H", 9))), "numbers.xls": samples.xls(record(0x00BD, struct.pack("<HHHIH", 9, 0, 0, 0, 5))),
        "name.xls": samples.xls(globals_extra=record(0x0018, struct.pack("<HBBH", 0, 0, 0, 900) + b"\0" * 10)), "sheet.xls": samples.xls(globals_extra=record(0x0085, struct.pack("<IHBB", 1 << 30, 0, 2, 0) + b"S0")),
    }
    return refusals(spark, contents)


@expects("rail_codes", "code string", [(c,) for c in ("unsupported", "bad_zip", "encrypted", "too_large", "bomb", "timeout", "cancelled", "io", "internal")])
def rail_codes(spark):
    return [(c,) for c in schema.ERROR_CODES]


@expects("rail_timeout", REFUSED, [("slow.xlsx", False, "timeout")])
def rail_timeout(spark):
    many = "<sheetData>" + "".join(f'<row r="{k}"><c r="A{k}"><v>1</v></c></row>' for k in range(1, 4000)) + "</sheetData>"
    return refusals(spark, {"slow.xlsx": samples.xlsx({"S": many})}, timeout_s=-1.0)


# Stores.


@expects("sheet_meta", "name string, frozen_rows int, frozen_cols int, default_row_height double, default_col_width double", [("Main", 0, 0, 15.0, 8.43), ("Reader", 2, 1, 14.4, 9.14), ("Second", 0, 0, 15.0, 8.43)])
def sheet_meta(spark):
    return store.meta(tables(spark, {"reader.xlsx": samples.reader_book(), "formulas.xlsx": samples.formula_book()}).sheets)


@expects("style_intern", "r int, s int", [(0, None), (1, 0), (2, 1), (3, 0)])
def style_intern(spark):
    cells = spark.createDataFrame([("w", 0, 0, 0, False, None), ("w", 0, 1, 0, True, None), ("w", 0, 2, 0, False, "Arial"), ("w", 0, 3, 0, True, None)], "workbook string, sheet int, r int, c int, bold boolean, font string")
    return store.intern_styles(cells, ["bold", "font"])[0]


@expects("string_intern", "encoding string, smaller boolean", [("dictionary", True)])
def string_intern(spark):
    """Repeated text is stored once: the saved store's size with three texts against that with all texts different."""
    ready(spark)
    sizes = []
    for n, text in enumerate((F.concat(F.lit("a repeated text of some length, number "), (F.col("id") % 3).cast("string")), F.concat(F.lit("a repeated text of some length, number "), F.sha2(F.col("id").cast("string"), 256)))):
        path = shared_path(spark, "intern", str(n))
        store.save(spark.range(20_000).select(F.lit(0).alias("sheet"), F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), text.alias("vs")).coalesce(1), path)
        sizes.append(spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0])
    return [("dictionary", sizes[0] * 5 < sizes[1])]


@expects("store_overlay", "r int, t string, vn double, vs string, d string, e boolean", [(0, "n", 5.0, None, "5.00", True), (1, "s", None, "kept", "kept", False), (2, "e", None, "#DIV/0!", None, True)])
def store_overlay(spark):
    """Evaluated results in place of the file's, a null display too; other cells stay."""
    cells = spark.createDataFrame([(0, 0, 0, "n", 4.0, None, None, "4.00"), (0, 1, 0, "s", None, "kept", None, "kept"), (0, 2, 0, "n", 1.0, None, None, "1")], "sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string")
    done = spark.createDataFrame([(0, 0, 0, "n", 5.0, None, None, "5.00"), (0, 2, 0, "e", None, "#DIV/0!", None, None), (0, 9, 9, "n", 1.0, None, None, None)], cells.schema)
    return store.overlay(cells, done)


@expects("window_caps", "nr int, nc int, allowed boolean", [(1, 1, True), (16, 16_384, True), (16, 16_385, False), (0, 5, False), (5, -1, False), (512, 512, True), (513, 512, False)])
def window_caps(spark):
    def allowed(nr, nc):
        try:
            store.check_window(nr, nc)
            return True
        except ValueError:
            return False

    return [(nr, nc, allowed(nr, nc)) for nr, nc in ((1, 1), (16, 16_384), (16, 16_385), (0, 5), (5, -1), (512, 512), (513, 512))]


@expects("projections", "part string, n long", [("cells", 15), ("sheets", 1), ("merges", 2), ("sizes", 6), ("styles", 2), ("workbooks", 1)])
def projections(spark):
    """Every table of one read, from the rows that the one parsing pass gave."""
    got = tables(spark, {"reader.xlsx": samples.reader_book()})
    parts = [getattr(got, n).agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n in ("cells", "sheets", "merges", "sizes", "styles", "workbooks")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@expects("two_books_apart", "workbook string, sheet int, rows long, cols long, cells long", [("a.xlsx", 0, 3, 3, 7), ("a.xlsx", 1, 5, 3, 1), ("b.xlsx", 0, 3, 3, 7), ("b.xlsx", 1, 5, 3, 1)])
def two_books_apart(spark):
    """Cells of two files with the same places: built, measured and counted by workbook."""
    got = tables(spark, {"a.xlsx": samples.formula_book(), "b.xlsx": samples.formula_book()})
    built = store.build(got.cells.withColumn("ord", F.lit(0)), got.sheets, "ord")
    counts = built.groupBy("workbook", "sheet").agg(F.count(F.lit(1)).alias("cells"))
    return store.extent(built).join(counts, ["workbook", "sheet"])


# Edits.


@expects("replaced_formulas", "n long", [(1,)])
def replaced_formulas(spark):
    """Literal edits that land on formulas: an authored one and one on a plain cell do not count."""
    cells = tables(spark, {"formulas.xlsx": samples.formula_book()}).cells
    edits = spark.createDataFrame([(0, 0, 0, 1, "n", 9.0, None, None, None), (1, 0, 0, 0, "n", 9.0, None, None, None), (2, 0, 0, 2, "s", None, None, None, "=1")], schema.OVERRIDES)
    return overrides.replaced_formulas(cells, edits)


@expects("override_refusals", "edit string, code string", [("sheet", "unsupported"), ("number", "unsupported"), ("outside", "too_large"), ("growth", "bomb"), ("sound", None)])
def override_refusals(spark):
    sheets = spark.createDataFrame([(0, 2, 2)], "sheet int, rows long, cols long")
    edits = {"sheet": (7, 0, 0, 1.0), "number": (0, 0, 0, float("inf")), "outside": (0, 0, 16_384, 1.0), "growth": (0, 1_000_000, 100, 1.0), "sound": (0, 9, 9, 1.0)}

    def code(sheet, r, c, v):
        try:
            overrides.validate(spark.createDataFrame([(0, sheet, r, c, "n", v, None, None, None)], schema.OVERRIDES), sheets)
        except overrides.OverrideError as problem:
            return problem.code

    return [(name, code(*e)) for name, e in edits.items()]


# Sinks.


def written(write) -> bytes:
    """What a sink writes to a path on the driver."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "out")
        write(path)
        with open(path, "rb") as f:
            return f.read()


def _cell(sheet, r, c, t, v, f=None, fmt=None, s=None):
    return {"sheet": sheet, "r": r, "c": c, "t": t, "v": v, "f": f, "fmt": fmt, "s": s}


EXPORTED = [
    _cell(0, 0, 0, "n", 2.0, None, "0.00"), _cell(0, 0, 1, "n", 4.0, "A1*2", "0.00"), _cell(0, 1, 0, "s", 'a,"b" <&>'), _cell(0, 1, 1, "b", True), _cell(0, 2, 0, "d", "2024-02-29"),
    _cell(0, 2, 1, "n", 1234.5, None, "#,##0.0", 0), _cell(0, 3, 0, "s", "text", 'A2&"!"'), _cell(0, 3, 1, "b", False, "1>2"), _cell(0, 3, 2, "e", "#DIV/0!", "1/0"), _cell(1, 4, 2, "s", "far"),
]


def exported(spark, cells=EXPORTED, **sheet) -> workbooks.Workbooks:
    sheets = [{"name": "Main", "merges": [(4, 0, 5, 1)], "cols": {1: 22.5}, "rows": {0: 30.6}, "frozen": (1, 0)} | sheet, {"name": "Second"}]
    data = written(lambda path: xlsx_sink.write(path, sheets, iter(cells), {0: (True, False, False, False, None, None, "#FF0000", None)}))
    return tables(spark, {"out.xlsx": data})


@expects(
    "xlsx_export", "sheet int, " + VALUE + ", fmt string",
    [
        (0, 0, 0, "n", 2.0, None, None, None, "0.00"), (0, 0, 1, "n", 4.0, None, None, "A1*2", "0.00"), (0, 1, 0, "s", None, 'a,"b" <&>', None, None, None), (0, 1, 1, "b", None, None, True, None, None),
        (0, 2, 0, "d", None, "2024-02-29", None, None, "yyyy-mm-dd"), (0, 2, 1, "n", 1234.5, None, None, None, "#,##0.0"), (0, 3, 0, "s", None, "text", None, 'A2&"!"', None), (0, 3, 1, "b", None, None, False, "1>2", None),
        (0, 3, 2, "e", None, "#DIV/0!", None, "1/0", None), (1, 4, 2, "s", None, "far", None, None, None),
    ],
)
def xlsx_export(spark):
    """Written and read again: values, formulas with results of every type, formats."""
    return exported(spark).cells


@expects("xlsx_exact_sizes", "axis string, at int, size double, height double, width double", [("col", 1, 22.5, 14.4, 9.14), ("col", 2, 8.7109375, 14.4, 9.14), ("row", 0, 30.6, 14.4, 9.14), ("row", 7, 0.0, 14.4, 9.14)])
def xlsx_exact_sizes(spark):
    """Sizes come back as they were, not rounded to what a screen shows; rows without cells keep theirs."""
    got = exported(spark, cols={1: 22.5, 2: 8.7109375}, rows={0: 30.6, 7: 0.0}, default_height=14.4, default_width=9.14)
    first = got.sheets.filter("sheet = 0").select("workbook", "sheet", F.col("default_row_height").alias("height"), F.col("default_col_width").alias("width"))
    return got.sizes.join(first, ["workbook", "sheet"])


@expects("xlsx_styles_intern", "what string, n long", [("styles", 1), ("formats", 3)])
def xlsx_styles_intern(spark):
    """Equal formats and styles are written once, however many cells have them."""
    cells = [_cell(0, r, 0, "n", float(r), None, ("0.00", "#,##0.0", None)[r % 3], 0 if r % 2 else None) for r in range(300)]
    got = exported(spark, cells)
    return got.styles.agg(F.lit("styles").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(got.cells.agg(F.lit("formats").alias("what"), F.countDistinct(F.coalesce("fmt", F.lit("General"))).alias("n")))


@expects("sheet_names", "name string, made string", [("A/B", "A_B"), ("a_b", "a_b (2)"), ("", "Sheet"), ("x" * 40, "x" * 31), ("X" * 31, "X" * 27 + " (2)"), ("'quoted'", "quoted")])
def sheet_names(spark):
    names = ["A/B", "a_b", "", "x" * 40, "X" * 31, "'quoted'"]
    return list(zip(names, xlsx_sink.sheet_names(names)))


@expects("export_drops", "dropped string", [("date of Main!A2 written as text",), ("text of Main!A1 cut at 32767 characters",), ("control characters of Main!A3",), ("empty text of Main!A4",), ("error of Main!A5 written as text",)])
def export_drops(spark):
    """What the file cannot hold, each thing once."""
    cells = [_cell(0, 0, 0, "s", "x" * 40_000), _cell(0, 1, 0, "d", "2024-01-01T00:00:00Z"), _cell(0, 2, 0, "s", "a\x01b"), _cell(0, 3, 0, "s", ""), _cell(0, 4, 0, "e", "#REF!")]
    said: list[str] = []
    written(lambda path: said.extend(xlsx_sink.write(path, [{"name": "Main"}], iter(cells))))
    return [(x,) for x in said]


@expects("drops_are_bounded", "n long, last string", [(101, "and 50 more")])
def drops_are_bounded(spark):
    drops = xlsx_sink.Drops()
    for k in range(150):
        drops.add(f"item {k}")
        drops.add(f"item {k % 7}")
    return [(len(drops.report()), drops.report()[-1])]


@expects("atomic_sinks", "sink string, left string", [("csv", "old"), ("json", "old"), ("xlsx", "old")])
def atomic_sinks(spark):
    """A sink that fails on its way leaves the file that was there, and nothing beside it."""
    from gridloom.sinks import files

    def failing():
        yield _cell(0, 0, 0, "n", 1.0)
        raise RuntimeError("on its way")

    def parts():
        yield b"new"
        raise RuntimeError("on its way")

    broken = spark.range(1).select(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(None).cast("double").alias("vn"), F.raise_error(F.lit("on its way")).cast("string").alias("vs"), F.lit(None).cast("boolean").alias("vb"))
    out = []
    for name, write in (("csv", lambda p: csv_sink.write_file(broken, p, 1, 1)), ("json", lambda p: files.write_parts(p, parts())), ("xlsx", lambda p: xlsx_sink.write(p, [{"name": "S"}], failing()))):
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "file")
            with open(path, "w") as f:
                f.write("old")
            try:
                write(path)
            except Exception:  # whatever it was, the file is looked at
                pass
            with open(path) as f:
                out.append((name, f.read() if os.listdir(folder) == ["file"] else "something beside it"))
    return out


# Comparison of what readers say.


@expects("formula_agreement", "covered long, evaluated long, compared long, agreed long", [(5, 5, 5, 4)])
def formula_agreement(spark):
    """Results against the file's: of the five formulas of two sheets one has a result that the file has otherwise."""
    book = tables(spark, {"shared.xlsx": samples.shared_formula_book()})
    wrong = book.cells.withColumn("vn", F.when((F.col("sheet") == 0) & (F.col("r") == 1) & (F.col("c") == 2), F.col("vn") + 1).otherwise(F.col("vn")))
    return diff.formula_agreement(formulas.evaluate_books(book.cells, book.sheets, book.workbooks), wrong)


@expects("probe_offsets", "rows int, cols int, r int, c int", [(10, 10, 0, 0), (1000, 100, 0, 0), (1000, 100, 0, 76), (1000, 100, 936, 0), (1000, 100, 936, 76), (1000, 100, 468, 38)])
def probe_offsets(spark):
    return [(rows, cols, r, c) for rows, cols in ((10, 10), (1000, 100)) for r, c in diff.probe_offsets(rows, cols)]


@expects("display_buckets", "fmt string, n long", [("0.00", 2), ("General", 1)])
def display_buckets(spark):
    kind = "sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string"
    a = spark.createDataFrame([(0, r, 0, "n", 1.0, None, None, d, None, fmt) for r, (d, fmt) in enumerate((("1.0", "0.00"), ("1", "0.00"), ("1", None), ("1.00", "0.00"), (None, "0.00")))], kind)
    b = spark.createDataFrame([(0, r, 0, "n", 1.0, None, None, "1.00", None, fmt) for r, fmt in enumerate(("0.00", "0.00", None, "0.00", "0.00"))], kind)
    return diff.display_buckets(diff.paired(a, b))


@expects("manifest_limit", "id string", [("a.xlsx",), ("b.xlsx",)])
def manifest_limit(spark):
    entries = spark.createDataFrame([("c.xlsx", "xlsx"), ("b.xlsx", "XLSX"), ("a.ods", "ods"), ("a.xlsx", "xlsx")], "id string, ext string")
    return scoreboard.first_entries(entries, 2, "xlsx")
