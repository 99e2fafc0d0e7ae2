"""Checks of documents, cells and manifests: each rule is a query for its violations."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import schema, sheetify

# The extensions that a manifest may name.
EXTENSIONS = ("xlsx", "xlsm", "xlsb", "xls", "ods", "csv", "tsv")
MAX_FILE_BYTES = 30 * 1024 * 1024
MAX_CORPUS_BYTES = 4 * 1024 * 1024 * 1024
PUBLIC = "corpus/files/"


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unsorted(df: DataFrame, key: str, order: str) -> DataFrame:
    """Neighbours by ``order`` whose key does not rise. Neighbours come from a self-join on the row's place, so nothing is
    sorted in one task; ``order`` may have gaps, and rows that share it follow by key."""
    placed = sheetify.with_row_number(df.select(order, key), [order, key], "__place")
    nxt = placed.select((F.col("__place") - 1).alias("__place"), F.col(key).alias("next"))
    return placed.join(nxt, "__place").filter(F.col("next") <= F.col(key)).drop("__place")


def missing_keys(child: DataFrame, parent: DataFrame, on: str, parent_key: str) -> DataFrame:
    """Children whose non-null key no parent has."""
    return child.filter(F.col(on).isNotNull()).join(parent.select(F.col(parent_key).alias(on)), on, "left_anti")


def cell_violations(cells: DataFrame, sheets: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """(sheet, r, c, rule), with the workbook where cells have one: outside the extent, no known type, a value that does not
    fit its type, twice the same place, a style that is not there."""
    key, on = schema.key(cells), schema.key(cells, sheets, of=["sheet"])
    tag = lambda df, rule: df.select(*key, F.lit(rule).alias("rule"))
    held = cells.join(sheets.select(*on, "rows", "cols"), on, "left")
    number, text, flag = F.col("vn").isNotNull(), F.col("vs").isNotNull(), F.col("vb").isNotNull()
    fits = F.when(F.col("t") == "n", ~text & ~flag).when(F.col("t") == "b", ~text & ~number).otherwise(~number & ~flag)
    parts = [
        tag(held.filter("rows IS NULL OR r >= rows OR c >= cols OR r < 0 OR c < 0"), "extent"),
        tag(cells.filter(~F.coalesce(F.col("t").isin(*schema.TYPES), F.lit(False))), "type"),
        tag(cells.filter(F.col("t").isin(*schema.TYPES) & ~fits), "value"),
        tag(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate"),
    ]
    if styles is not None:
        own = schema.key(cells, styles, of=["s"])
        known = styles.withColumnRenamed("style_id", "s").select(*own).distinct()
        parts.append(tag(cells.filter("s IS NOT NULL").join(known, own, "left_anti"), "style"))
    return reduce(DataFrame.unionByName, parts)


def sheet_violations(sheets: DataFrame, workbooks: DataFrame) -> DataFrame:
    """(workbook, rule): indices that do not count from 0, and a truncation flag that is not its sheets' OR."""
    per = sheets.groupBy("workbook").agg(F.count(F.lit(1)).alias("n"), F.max("sheet").alias("hi"), F.min("sheet").alias("lo"), F.countDistinct("sheet").alias("k"), F.bool_or("truncated").alias("cut"))
    gaps = per.filter("lo <> 0 OR hi <> n - 1 OR k <> n").select("workbook", F.lit("index").alias("rule"))
    joined = workbooks.select("workbook", F.col("truncated").alias("said"), "ok", "code").join(per, "workbook", "left")
    flags = joined.filter(F.col("said") != F.coalesce("cut", F.lit(False))).select("workbook", F.lit("truncated").alias("rule"))
    errors = workbooks.filter(F.col("ok") != F.col("code").isNull()).select("workbook", F.lit("error").alias("rule"))
    return gaps.unionByName(flags).unionByName(errors)


def merge_order(merges: DataFrame) -> DataFrame:
    """Merges that do not stand in strict order within their sheet (``ord`` is the place)."""
    w = Window.partitionBy("workbook", "sheet").orderBy("ord")
    key = F.struct("r0", "c0", "r1", "c1")
    return merges.withColumn("before", F.lag(key).over(w)).filter(F.col("before").isNotNull() & (F.col("before") >= key)).drop("before")


def path_extension(path: Column) -> Column:
    """The lower-case extension of a path's last component, empty where there is none."""
    name = F.substring_index(F.regexp_replace(path, r"(/+\.?)+\z", ""), "/", -1)
    return F.lower(F.regexp_extract(name, r"\A[^/]+\.([^./]+)\z", 1))


def plain_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` components; links are not followed."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    held = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(held, "/"))


def manifest_violations(entries: DataFrame, root: str = ".") -> DataFrame:
    """(id, rule) of manifest rows; ``root`` is the folder that holds corpus/files. A repeated id is reported once, and a
    total of public bytes over the limit with a null id. That lines are in the order of ids is for :func:`unsorted`."""
    true = lambda c: F.coalesce(c, F.lit(False))
    held = lambda name: true(F.col(name) != "")
    climbs = lambda name: F.col(name).rlike(r"(^|/)\.\.(/|\z)")
    path, private, own = F.col("path"), F.col("private"), os.path.realpath(os.path.join(root, PUBLIC))
    inside = F.startswith(F.concat(plain_path(path), F.lit("/")), F.lit(own + "/"))
    path_fits = F.when(private, F.startswith(path, F.lit("/")) & ~inside).when(~private, F.startswith(path, F.lit(PUBLIC)) & ~climbs("path")).otherwise(True)
    source_fits = F.when(private, F.col("source").rlike("^file://")).when(~private, F.col("source").rlike("^https?://")).otherwise(True)
    rules = {
        "id": ~(held("id") & true(~F.startswith("id", F.lit("/")) & ~climbs("id"))),
        "id_ext": true(path_extension(F.col("id")) != F.col("ext")),
        "path": ~(held("path") & true(path_fits)),
        "path_ext": true(path_extension(path) != F.col("ext")),
        "sha256": ~true(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z")),
        "bytes": ~true(F.col("bytes").between(0, MAX_FILE_BYTES)),
        "ext": ~true(F.col("ext").isin(*EXTENSIONS)),
        "collection": ~held("collection"),
        "source": ~(held("source") & true(source_fits)),
        "licence": ~held("licence"),
        "fetchedAt": ~true(F.col("fetchedAt").rlike(r"\A\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}Z\z")),
        "private": private.isNull(),
    }
    broken = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]), lambda x: x.isNotNull())
    each = entries.select("id", F.explode(broken).alias("rule"))
    twice = duplicate_ids(entries.filter("id IS NOT NULL"), "id").select("id", F.lit("duplicate").alias("rule"))
    total = entries.filter(~private).agg(F.sum("bytes").alias("n")).filter(F.col("n") > MAX_CORPUS_BYTES)
    return each.unionByName(twice).unionByName(total.select(F.lit(None).cast("string").alias("id"), F.lit("total").alias("rule")))


def payload_defects(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(id, defect) of manifest rows against files (path, length, sha256): missing, size, hash."""
    held = files.select("path", F.col("length").alias("have_bytes"), F.col("sha256").alias("have_sha"))
    joined = entries.join(held, "path", "left")
    defect = F.when(F.col("have_bytes").isNull(), "missing").when(F.col("have_bytes") != F.col("bytes"), "size").when(F.col("have_sha") != F.col("sha256"), "hash")
    return joined.select("id", defect.alias("defect")).filter("defect IS NOT NULL")


def file_hashes(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below ``path``."""
    return hashed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def hashed(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of ``files`` (path, length, content)."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def admit(found: DataFrame, before: DataFrame, max_bytes: int = 30 * 1024 * 1024) -> DataFrame:
    """Files that a manifest takes in: known extension, within the size limit; one row an id (the first path); an unchanged
    hash keeps the date on which it was fetched."""
    ok = found.filter(F.col("ext").isin(*EXTENSIONS) & (F.col("bytes") <= max_bytes))
    rest = [c for c in ok.columns if c not in ("id", "path")]
    one = ok.groupBy("id").agg(F.min_by(F.struct("path", *rest), "path").alias("x")).select("id", "x.*")
    old = before.select("id", F.col("sha256").alias("old_sha"), F.col("fetchedAt").alias("old_at"))
    joined = one.join(old, "id", "left")
    at = F.when(F.col("old_sha") == F.col("sha256"), F.coalesce("old_at", "fetchedAt")).otherwise(F.col("fetchedAt"))
    return joined.withColumn("fetchedAt", at).drop("old_sha", "old_at")
