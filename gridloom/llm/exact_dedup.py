"""Exact de-duplication: 128-bit content hash groups, byte comparison inside them.

Main path: DataFrame functions only.

1. ``classes``: group on (hash, whole normalised text). The exchange is by both, the aggregation's hash map
   compares the bytes of the text for rows whose hash agrees, and equal rows are combined before the shuffle,
   so a group of any size sends one row from each task.
2. Each document finds its class by the 16-byte hash alone; classes that hold more than 1/512 of all
   documents are looked up by broadcast, so no task meets a hot group.
3. Where two different texts share a hash (a collision), the documents of that hash are matched by text.

Edge cases: a null text is an empty text; a null id loses against any id (it stays only where all ids of its
group are null); rows that repeat an id and its text share one verdict, and one of them stays in the drop stage; an empty table gives an empty result;
columns of the input other than the two named ones are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, lookup, lower_ascii, row_key, without_rows


def content_hash(text: Column, hash_bytes: int = 16) -> Column:
    return F.substring(F.unhex(F.md5(text)), 1, hash_bytes)


def _verdicts(docs: DataFrame, id_col: str, text_col: str, keep: str, hash_bytes: int, *more: Column) -> DataFrame:
    """(__id, keep_id, group_size, text_sha256) and ``more`` columns of each row."""
    pick = {"min": F.min, "max": F.max}[keep]
    text = docs.select(F.col(id_col).alias("__id"), lower_ascii(F.col(text_col).cast("string")).alias("__t"), *more)
    text = text.withColumn("__h", content_hash(F.col("__t"), hash_bytes))
    ids = cut(text.drop("__t"))
    grouped = text.groupBy("__h", "__t").agg(pick("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = cut(grouped.select("__h", "keep_id", "group_size", F.sha2(F.col("__t").cast("binary"), 256).alias("text_sha256")))

    collided = cut(classes.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__h"))
    clashes = not collided.isEmpty()
    plain, clean = ids, classes
    if clashes:
        plain = ids.join(collided, "__h", "left_anti")
        clean = classes.join(collided, "__h", "left_anti")
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    hot = [r[0] for r in clean.filter(F.col("group_size") > total / HOT_SHARE).select("__h").collect()]  # < HOT_SHARE
    out = lookup(plain, clean, "__h", hot)
    if clashes:
        rest = text.join(collided, "__h", "left_semi")
        by_text = rest.groupBy("__h", "__t").agg(pick("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.withColumn("text_sha256", F.sha2(F.col("__t").cast("binary"), 256))
        out = out.unionByName(rest.join(by_text, ["__h", "__t"], "left").drop("__t"))
    return out.drop("__h")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_bytes: int = 16) -> DataFrame:
    """One row for each document: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``keep`` says which id of a group stays, "min" or "max". ``hash_bytes`` under 16 shortens the hash,
    for tests of the collision path.
    """
    kept = F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept")
    return _verdicts(docs, id_col, text_col, keep, hash_bytes).select(F.col("__id").alias(id_col), "keep_id", "group_size", kept, "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of each group of equal texts, all columns.

    It has the id that stays (null only where all ids of the group are null); of several such rows the one with the smallest
    hash of id and text. Rows are matched by that hash, so a row that goes takes no other row of its id, or without id, along.
    """
    key = row_key(F.col(id_col), F.col(text_col).cast("string"))
    rows = _verdicts(docs, id_col, text_col, keep, 16, key.alias("row_key")).filter("group_size > 1")
    rows = cut(rows.select("row_key", "text_sha256", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept")))
    firsts = rows.filter("kept").groupBy("text_sha256").agg(F.min("row_key").alias("row_key")).select("row_key", F.lit(True).alias("stays"))
    counts = rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))
    verdict = counts.join(firsts, "row_key", "left").select("row_key", F.coalesce("stays", F.lit(False)).alias("stays"), "n")
    return without_rows(docs, key, cut(verdict.filter("NOT stays OR n > 1")))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
