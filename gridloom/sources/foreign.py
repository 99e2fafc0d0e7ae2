"""Raw cells of another reader, brought into the cell model by column expressions, and its failures as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.a1 import decode, decode_range, encode
from gridloom.sources.book import ERROR_BYTES

#: A raw cell: its kind, value by type, shown text w, formula f, format code z.
RAW = "workbook string, sheet int, address string, t string, vn double, vs string, vb boolean, vd timestamp_ntz, w string, f string, z string"


def formula_text(f: Column) -> Column:
    """Without one leading =; null for nothing."""
    return F.nullif(F.regexp_replace(f, r"\A=", ""), F.lit(""))


def format_code(z: Column) -> Column:
    code = F.trim(z)
    return F.when((code != "") & (F.lower(code) != "general"), code)


def error_text(w: Column, number: Column, other: Column) -> Column:
    """The shown text, else the name of the error's number, else the value as it is."""
    names = F.create_map(*[F.lit(x) for k, v in ERROR_BYTES.items() for x in (float(k), v)])
    return F.coalesce(F.nullif(w, F.lit("")), F.when(number.isNotNull(), F.coalesce(F.element_at(names, number), number.cast("string"))), other)


def date_text(d: Column) -> Column:
    """A day without time, or a time without milliseconds that are 0."""
    full = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.regexp_replace(F.regexp_replace(full, r"\.000\z", ""), r"T00:00:00\z", "")


def normalised(raw: DataFrame) -> DataFrame:
    """Cells of the model from raw ones. Addresses that are none and cells without value and formula go; an empty text is no value.
    A number that is not finite and a flag that is none are null; a date that is none, and an unknown kind, is text."""
    r, c = decode(F.col("address"))
    known = raw.filter(F.col("address").rlike(r"\A[A-Z]+[1-9][0-9]*\z")).withColumns({"r": r, "c": c, "f": formula_text(F.col("f"))}).filter("r IS NOT NULL")
    text = F.coalesce("vs", F.when(F.col("vb").isNotNull(), F.col("vb").cast("string")), F.col("vn").cast("string"), F.col("vd").cast("string"))
    held = known.filter(F.col("f").isNotNull() | (F.coalesce(text, F.lit("")) != ""))
    t = F.when(F.col("t").isin("n", "b", "e"), F.col("t")).when((F.col("t") == "d") & F.col("vd").isNotNull(), "d").otherwise("s")
    finite = F.col("vn").isNotNull() & ~F.isnan("vn") & (F.abs("vn") < float("inf"))
    vs = F.when(t == "e", error_text(F.col("w"), F.col("vn"), F.col("vs"))).when(t == "d", date_text(F.col("vd"))).when(t == "s", text)
    return held.select(
        "workbook", "sheet", "r", "c", t.alias("t"), F.when((t == "n") & finite, F.col("vn")).alias("vn"), vs.alias("vs"), F.when(t == "b", F.col("vb")).alias("vb"),
        F.col("w").alias("d"), "f", format_code(F.col("z")).alias("fmt"), F.lit(None).cast("int").alias("s"),
    )


def sheet_extents(sheets: DataFrame) -> DataFrame:
    """(workbook, sheet, rows, cols) of sheets that say their range (``ref``); none is 0 by 0."""
    r0, c0, r1, c1 = decode_range(F.col("ref"))
    size = lambda last: F.coalesce(last + 1, F.lit(0)).cast("long")
    return sheets.select("workbook", "sheet", size(r1).alias("rows"), size(c1).alias("cols"))


def merge_names(merges: DataFrame) -> DataFrame:
    """(workbook, sheet, names): the sorted range names of merges given by their corners."""
    name = F.concat(encode(F.col("r0"), F.col("c0")), F.lit(":"), encode(F.col("r1"), F.col("c1")))
    return merges.groupBy("workbook", "sheet").agg(F.array_sort(F.collect_set(name)).alias("names"))


# Failure codes by the name of the operating system's error.
ERROR_CODES = {"ENOENT": "not_found", "EACCES": "permission_denied", "EPERM": "permission_denied", "EISDIR": "invalid_file"}


def error_code(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv])
    return F.coalesce(F.element_at(codes, name), F.lit("unreadable"))


def failure_documents(failures: DataFrame, tool: str, version: str) -> DataFrame:
    """(file, document): the document of each file that could not be read. ``failures``: (file, error, msg, wall_ms, sha256, code),
    ``error`` the system's name of it, ``code`` one that is known already."""
    code = F.coalesce("code", error_code(F.col("error")))
    msg = F.coalesce(F.nullif("msg", F.lit("")), F.lit("the file cannot be read"))
    none = F.array().cast("array<string>")
    body = F.struct(
        F.lit(schema.SCHEMA_VERSION).alias("schema"), F.lit(tool).alias("tool"), F.lit(version).alias("toolVersion"), "file", "sha256", F.lit(False).alias("ok"),
        F.struct(code.alias("code"), msg.alias("msg")).alias("error"), F.col("wall_ms").alias("wallMs"), F.lit(None).cast("long").alias("peakRssBytes"),
        F.lit(False).alias("truncated"), none.alias("sheets"), none.alias("warnings"),
    )
    return failures.select("file", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
