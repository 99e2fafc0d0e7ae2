"""Workbook files as DataFrames: one task a file, any path that Spark reads, refusals as rows.

Files are listed by Spark's binaryFile source, which gives lengths before contents, so files that are too large are
refused unread. A parser yields small batches of rows, so a task holds one workbook at most.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import a1, schema
from gridloom.session import ready
from gridloom.sources import ods, xls, xlsb, xlsx
from gridloom.sources.book import STYLE_FIELDS, Book, spread
from gridloom.sources.rails import Limits, Refused, check_size

READERS = {"xlsx": xlsx.read, "xlsm": xlsx.read, "xlsb": xlsb.read, "xls": xls.read, "ods": ods.read}

_ROW = (
    "part string, workbook string, sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string, s int, name string, "
    "n_rows long, n_cols long, truncated boolean, frozen_rows int, frozen_cols int, default_row_height double, default_col_width double, r1 int, c1 int, axis string, size double, "
    "flags array<boolean>, texts array<string>, ok boolean, code string, msg string, date_1904 boolean"
)
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def parse(name: str, content: bytes, limits: Limits) -> Book:
    """The workbook in ``content``; the reader goes by the name's extension. Raises Refused."""
    check_size(len(content), limits)
    reader = READERS.get(os.path.splitext(name)[1].lower().lstrip("."))
    if reader is None:
        raise Refused("unsupported", "this kind of file is not read")
    try:
        return reader(content, limits)
    except Refused:
        raise
    except (MemoryError, RecursionError) as problem:
        raise Refused("bomb", type(problem).__name__) from None
    except Exception as problem:  # a parser's fault is that file's refusal, never the job's failure
        raise Refused("internal", f"{type(problem).__name__}: {problem}") from None


def book_rows(path: str, book: Book, sha: str) -> Iterator[dict]:
    for k, sheet in enumerate(book.sheets):
        base = {"workbook": path, "sheet": k}
        yield base | {
            "part": "sheet", "name": sheet.name, "n_rows": sheet.rows, "n_cols": sheet.cols, "truncated": sheet.truncated, "frozen_rows": sheet.frozen[0],
            "frozen_cols": sheet.frozen[1], "default_row_height": sheet.default_height, "default_col_width": sheet.default_width,
        }
        for r, c, t, v, d, f, fmt, style in sheet.cells:
            number = v if isinstance(v, float) and not isinstance(v, bool) else None
            yield base | {"part": "cell", "r": r, "c": c, "t": t, "vn": number, "vs": v if isinstance(v, str) else None, "vb": v if isinstance(v, bool) else None, "d": d, "f": f, "fmt": fmt, "s": style}
        for r0, c0, r1, c1 in sheet.merges:
            yield base | {"part": "merge", "r": r0, "c": c0, "r1": r1, "c1": c1, "name": a1.range_name(r0, c0, r1, c1)}
        for c, width in sorted(spread(sheet.columns, sheet.cols).items()):
            yield base | {"part": "size", "axis": "col", "c": c, "size": width}
        for r, height in sorted(sheet.heights.items()):
            if r < sheet.rows + 256:
                yield base | {"part": "size", "axis": "row", "r": r, "size": height}
    for k, style in enumerate(book.styles):
        yield {"part": "style", "workbook": path, "s": k, "flags": list(style[:4]), "size": style[4], "texts": list(style[5:])}
    yield {"part": "book", "workbook": path, "ok": True, "vs": sha, "truncated": any(s.truncated for s in book.sheets), "date_1904": book.date_1904, "texts": book.warnings}


def _frames(rows: Iterator[dict], size: int = 20_000) -> Iterator[pd.DataFrame]:
    batch: list[dict] = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield pd.DataFrame(batch, columns=_NAMES)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=_NAMES)


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    kinds = {"int": "Int32", "long": "Int64", "boolean": "boolean", "double": "Float64"}
    for n, k in (x.split() for x in _ROW.split(", ")):
        if k in kinds:
            frame[n] = frame[n].astype(kinds[k])
        else:
            frame[n] = pd.Series([None if isinstance(v, float) else v for v in frame[n]], dtype=object)
    return frame


def _parser(limits: Limits):
    def rows(batches) -> Iterator[dict]:
        for batch in batches:
            for path, length, content in zip(batch["path"], batch["length"], batch["content"]):
                sha = hashlib.sha256(content).hexdigest() if content is not None else None
                try:
                    check_size(int(length), limits)
                    yield from book_rows(path, parse(path, content, limits), sha)
                except Refused as problem:
                    yield {"part": "book", "workbook": path, "ok": False, "vs": sha, "code": problem.code, "msg": problem.msg, "truncated": False, "date_1904": False, "texts": []}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _frames(rows(batches)):
            yield _typed(frame)

    return run


@dataclass
class Workbooks:
    """The cell model of a set of files."""

    cells: DataFrame
    sheets: DataFrame
    merges: DataFrame
    sizes: DataFrame
    styles: DataFrame
    workbooks: DataFrame
    rows: DataFrame

    def close(self) -> None:
        self.rows.unpersist()


def read(spark: SparkSession, path: str | list[str], limits: Limits = Limits(), pattern: str | None = None) -> Workbooks:
    """Every file at ``path`` (a file, folder or glob)."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    source = source.option("pathGlobFilter", pattern) if pattern else source
    return from_files(source.load(path), limits)


def from_files(files: DataFrame, limits: Limits = Limits()) -> Workbooks:
    """Every file of ``files`` (path, length, content)."""
    ready(files.sparkSession)
    small = files.select("path", "length", F.when(F.col("length") <= limits.max_bytes, F.col("content")).alias("content"))
    # The Arrow batch of a task holds one file's bytes at a time.
    rows = small.repartition("path").mapInPandas(_parser(limits), _ROW).persist()
    part = lambda name: rows.filter(F.col("part") == name)
    flag = lambda k: F.element_at("flags", k)
    text = lambda k: F.element_at("texts", k)
    return Workbooks(
        part("cell").select(*schema.CELLS.names),
        part("sheet").select("workbook", "sheet", "name", F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), "truncated", "frozen_rows", "frozen_cols", "default_row_height", "default_col_width"),
        part("merge").select("workbook", "sheet", F.col("name").alias("a1"), F.col("r").alias("r0"), F.col("c").alias("c0"), "r1", "c1"),
        part("size").select("workbook", "sheet", "axis", F.coalesce("c", "r").alias("at"), "size"),
        part("style").select("workbook", F.col("s").alias("style_id"), *[flag(k + 1).alias(n) for k, n in enumerate(STYLE_FIELDS[:4])], F.col("size").alias("font_size"), *[text(k + 1).alias(n) for k, n in enumerate(STYLE_FIELDS[5:])]),
        part("book").select("workbook", F.col("vs").alias("sha256"), "ok", "code", "msg", "truncated", "date_1904", F.col("texts").alias("warnings")),
        rows,
    )
