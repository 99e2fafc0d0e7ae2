"""Queries of the differential comparison, the scoreboard, set operations and validation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import diff, scoreboard, validate
from gridloom.plans.registry import query
from gridloom.session import table

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The quantities of line items as cells, and a copy with every 13th shifted, every 17th retyped, every 19th gone and
    a display on some."""
    line = table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_returnflag")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")
    none = F.lit(None)
    base = line.select(*KEYS, F.lit("n").alias("t"), F.col("l_quantity").alias("vn"), none.cast("string").alias("vs"), none.cast("boolean").alias("vb"),
                       F.when(k % 3 == 0, F.col("l_quantity").cast("string")).alias("d"), F.when(k % 5 == 0, F.concat(F.lit("SUM( A1 , "), F.col("l_linenumber").cast("string"), F.lit(")"))).alias("f"), F.col("l_returnflag").alias("fmt"))
    moved = F.when(k % 13 == 0, F.col("vn") + 1).otherwise(F.col("vn") * (1 + 1e-12))
    copy = base.filter(k % 19 != 0).withColumns({
        "t": F.when(k % 17 == 0, "s").otherwise("n"), "vs": F.when(k % 17 == 0, F.lit("x")), "vn": F.when(k % 17 != 0, moved),
        "d": F.when(k % 6 == 0, F.concat("d", F.lit("!"))).otherwise(F.col("d")), "f": F.replace("f", F.lit(" "), F.lit("")),
    })
    return base, copy


_SIDES = """
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_orderkey * 7 + l_linenumber * 3 + l_partkey AS k, l_quantity AS q, l_returnflag AS fmt FROM lineitem),
p AS (SELECT *, k % 19 <> 0 AS in_b, k % 17 = 0 AS retyped, k % 13 = 0 AS moved, k % 3 = 0 AS a_d, k % 5 = 0 AS has_f FROM a),
h AS (SELECT *, in_b AND NOT retyped AND NOT moved AS hit, a_d AND in_b AS both_d FROM p)
"""


@query(
    "diff_full_outer",
    f"""WITH {_SIDES} SELECT count(*) AS cells, count_if(hit)::BIGINT AS value_matched, count_if(both_d)::BIGINT AS display_total, count_if(both_d AND k % 6 <> 0)::BIGINT AS display_matched,
        count_if(has_f)::BIGINT AS formula_total, count_if(has_f AND in_b)::BIGINT AS formula_matched, count_if(has_f AND hit)::BIGINT AS cached_matched, count(*) AS a_cells,
        count_if(in_b)::BIGINT AS b_cells, count_if(a_d)::BIGINT AS a_covered, count_if(both_d)::BIGINT AS b_covered FROM h""",
)
def diff_full_outer(spark, sf_dir):
    return diff.compare(diff.paired(*_sides(spark, sf_dir), KEYS))


@query("diff_mismatch_buckets", f"WITH {_SIDES} SELECT 'n/' || CASE WHEN NOT in_b THEN '-' WHEN retyped THEN 's' ELSE 'n' END AS bucket, count(*) AS n FROM h WHERE NOT hit GROUP BY 1")
def diff_mismatch_buckets(spark, sf_dir):
    return diff.mismatch_buckets(diff.paired(*_sides(spark, sf_dir), KEYS))


@query("diff_by_format", f"WITH {_SIDES} SELECT fmt, count(*) AS cells, count_if(a_d)::BIGINT AS covered, count_if(both_d)::BIGINT AS display_total, count_if(both_d AND k % 6 <> 0)::BIGINT AS display_matched FROM h WHERE in_b GROUP BY fmt")
def diff_by_format(spark, sf_dir):
    return diff.format_metrics(*_sides(spark, sf_dir), KEYS)


@query("roundtrip_compare", f"WITH {_SIDES} SELECT count(*) AS total, count_if(hit)::BIGINT AS value_matched, count_if(in_b AND (NOT a_d OR k % 6 <> 0))::BIGINT AS display_matched, 0::BIGINT AS extra FROM h")
def roundtrip_compare(spark, sf_dir):
    return diff.round_trip(*_sides(spark, sf_dir), KEYS)


@query("roundtrip_extra_cells", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 19 = 0")
def roundtrip_extra_cells(spark, sf_dir):
    base, copy = _sides(spark, sf_dir)
    return diff.extra_cells(copy, base, KEYS).select(*KEYS)


@query("merge_set_equal", "SELECT (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS only_a, (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS only_b, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) = 0 AND (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)) = 0 AS equal")
def merge_set_equal(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return diff.sets_equal(a, b, ["k"])


@query("set_union_keys", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)")
def set_union_keys(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return a.union(b).distinct().agg(F.count(F.lit(1)).alias("n"))


def _metrics(spark, sf_dir) -> DataFrame:
    """Documents as files: language for extension, lengths for counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    n = F.col("n_chars")
    return docs.select("doc_id", F.upper("lang").alias("ext"), "source", n.alias("bytes"), F.floor(n / 3).alias("matched"), F.floor(n / 2).alias("total"), (n - 50).alias("covered"), n.alias("cells"))


_METRICS = "m AS (SELECT lower(lang) AS ext, source, n_chars AS bytes, n_chars // 3 AS matched, n_chars // 2 AS total, n_chars - 50 AS covered, n_chars AS cells FROM documents)"
_PAIRS = {"values": ("matched", "total"), "display": ("covered", "cells")}


@query("scoreboard_ratio", f"WITH {_METRICS} SELECT sum(matched)::BIGINT AS values_matched, sum(total)::BIGINT AS values_total, sum(covered)::BIGINT AS display_matched, sum(cells)::BIGINT AS display_total, sum(matched)::DOUBLE * 100 / sum(total) AS values_percent, sum(covered)::DOUBLE * 100 / sum(cells) AS display_percent FROM m")
def scoreboard_ratio(spark, sf_dir):
    return scoreboard.ratios(_metrics(spark, sf_dir), _PAIRS)


@query("per_extension", f"WITH {_METRICS} SELECT ext, sum(matched)::BIGINT AS values_matched, sum(total)::BIGINT AS values_total, sum(covered)::BIGINT AS display_matched, sum(cells)::BIGINT AS display_total, CASE WHEN sum(total) > 0 THEN sum(matched)::DOUBLE * 100 / sum(total) END AS values_percent, sum(covered)::DOUBLE * 100 / sum(cells) AS display_percent FROM m GROUP BY ext")
def per_extension(spark, sf_dir):
    return scoreboard.ratios(_metrics(spark, sf_dir), _PAIRS, [scoreboard.extension().alias("ext")])


@query("nearest_rank_latency", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS \"max\" FROM events GROUP BY event_type")
def nearest_rank_latency(spark, sf_dir):
    return scoreboard.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("format_mining", "SELECT l_shipmode AS code, count(*) AS cells, count(DISTINCT l_suppkey) AS files FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_suppkey FROM lineitem) GROUP BY 1")
def format_mining(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("fmt"), F.col("l_suppkey").alias("file"))
    return scoreboard.mine_formats(cells)


@query("format_coverage_rank", "SELECT source AS code, sum(n_chars)::BIGINT AS cells, count(DISTINCT lang) AS files, sum(n_chars - 50)::BIGINT AS covered, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN (substr(source, 4)::INT * 10)::BIGINT END AS corpus_count, sum(n_chars - 50)::DOUBLE * 100 / sum(n_chars) AS percent FROM documents WHERE source IS NOT NULL GROUP BY source")
def format_coverage_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    per_file = docs.groupBy(F.col("lang").alias("file"), F.col("source").alias("code")).agg(F.sum("n_chars").alias("cells"), F.sum(F.col("n_chars") - 50).alias("covered"))
    number = F.substring("source", 4, 9).cast("long")
    ranking = docs.select("source").distinct().filter(number % 2 == 0).select(F.col("source").alias("code"), (number * 10).alias("count"))
    return scoreboard.format_coverage(per_file, ranking)


@query(
    "manifest_summary",
    """WITH e AS (SELECT source AS collection, lower(lang) AS ext, n_chars AS bytes, sha256(text) AS sha, doc_id % 5 = 0 AS private, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS stamp FROM documents)
       SELECT 'total' AS kind, '' AS name, count(*) AS files, sum(bytes)::BIGINT AS bytes, count(DISTINCT CASE WHEN NOT private THEN sha END) AS distinct_sha, max(stamp) AS newest FROM e
       UNION ALL SELECT 'collection', collection, count(*), sum(bytes)::BIGINT, count(DISTINCT CASE WHEN NOT private THEN sha END), max(stamp) FROM e GROUP BY collection
       UNION ALL SELECT 'extension', ext, count(*), sum(bytes)::BIGINT, count(DISTINCT CASE WHEN NOT private THEN sha END), max(stamp) FROM e GROUP BY ext""",
)
def manifest_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    entries = docs.select(F.col("source").alias("collection"), F.col("lang").alias("ext"), F.col("n_chars").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), (F.col("doc_id") % 5 == 0).alias("private"),
                          F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("fetchedAt"))
    return scoreboard.manifest_summary(entries)


@query("distinct_sha", "SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def distinct_sha(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)).alias("n"))


@query(
    "triage_top20",
    """WITH m AS (SELECT event_type || '/' || (user_id % 9) AS category, event_id % 4 + 1 AS n, 'file-' || (event_id % 50) AS path, event_id % 50 < 10 AS private FROM events),
       b AS (SELECT category, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (private), 0)::BIGINT AS private_n FROM m GROUP BY category ORDER BY n DESC, category LIMIT 20)
       SELECT b.category, b.n, private_n, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT DISTINCT path FROM m WHERE m.category = b.category AND NOT private ORDER BY path LIMIT 5)) AS examples FROM b""",
)
def triage_top20(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 9).cast("string")).alias("category"), (F.col("event_id") % 4 + 1).alias("n"),
                    F.concat(F.lit("file-"), (F.col("event_id") % 50).cast("string")).alias("path"), (F.col("event_id") % 50 < 10).alias("private"))
    return scoreboard.triage(rows).withColumn("examples", F.array_join("examples", ","))


@query(
    "stratified_sample",
    """WITH r AS (SELECT doc_id AS id, lang AS ext, row_number() OVER (PARTITION BY lang ORDER BY list_reduce(
         list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, xor(14695981039346656037::HUGEINT, 2024::HUGEINT)), doc_id) AS turn FROM documents)
       SELECT id, ext, turn::INT AS turn FROM r ORDER BY turn, ext LIMIT 40""",
)
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("ext"))
    return scoreboard.stratified_sample(docs, 40, 2024).select("id", "ext", "turn")


@query("validate_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_duplicates(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return validate.duplicate_ids(line, "k").select("k.*", "n")


@query("validate_sorted", "SELECT event_id AS ord, user_id AS key, next FROM (SELECT event_id, user_id, lead(user_id) OVER (ORDER BY event_id) AS next FROM events) WHERE next <= user_id")
def validate_sorted(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("key"))
    return validate.unsorted(events, "key", "ord").select("ord", "key", "next")


@query("validate_fk", "SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 <> 0)")
def validate_fk(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 1000 <> 0")
    return validate.missing_keys(table(spark, sf_dir, "lineitem").select("l_orderkey"), parents, "l_orderkey", "o_orderkey").select("l_orderkey")


@query(
    "validate_cells",
    """WITH n AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS r, * FROM orders)
       SELECT 0 AS sheet, r, 0 AS c, 'extent' AS rule FROM n WHERE r >= 900 UNION ALL SELECT 0, r, 0, 'value' FROM n WHERE r % 100 = 3""",
)
def validate_cells(spark, sf_dir):
    from gridloom import sheetify

    cells = sheetify.to_cells(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"])
    cells = cells.withColumn("t", F.when(F.col("r") % 100 == 3, "s").otherwise(F.col("t")))
    sheets = spark.createDataFrame([(0, 900, 1)], "sheet int, rows long, cols long")
    return validate.cell_violations(cells, sheets)


@query("validate_manifest", "SELECT doc_id::VARCHAR AS id, unnest(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'path' END, CASE WHEN lang NOT IN ('en', 'xls') THEN 'ext' END], lambda x: x IS NOT NULL)) AS rule FROM documents")
def validate_manifest(spark, sf_dir):
    ext = F.when(F.col("lang") == "en", "xlsx").otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").withColumn("ext", ext).withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit("."), "ext"))
    entries = docs.select(
        "id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("../up/"), "id")).otherwise(F.concat(F.lit("corpus/files/"), "id")).alias("path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("n_chars").cast("long").alias("bytes"), "ext", F.lit("documents").alias("collection"),
        F.lit("https://example.org/").alias("source"), F.lit("CC0").alias("licence"), F.lit("2024-01-01T00:00:00Z").alias("fetchedAt"), F.lit(False).alias("private"),
    )
    return validate.manifest_violations(entries).withColumn("id", F.substring_index("id", ".", 1))


@query("manifest_admission", "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS \"fetchedAt\" FROM documents WHERE n_chars <= 5000 AND lang IN ('en', 'de')")
def manifest_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("path"), F.md5("text").alias("sha256"), F.col("n_chars").alias("bytes"), F.when(F.col("lang").isin("en", "de"), "xlsx").otherwise("doc").alias("ext"), F.lit("new").alias("fetchedAt"))
    before = found.select("id", F.when(F.col("id").cast("long") % 2 == 0, F.col("sha256")).otherwise("x").alias("sha256"), F.lit("old").alias("fetchedAt"))
    return validate.admit(found, before, 5000).select("id", "fetchedAt")


@query("payload_defects", "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 11 = 1 THEN 'size' ELSE 'hash' END AS defect FROM documents WHERE doc_id % 11 < 3")
def payload_defects(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("sha256"), F.col("n_chars").alias("bytes"))
    k = F.col("id") % 11
    files = docs.filter(k != 0).select("path", (F.col("bytes") + F.when(k == 1, 1).otherwise(0)).alias("length"), F.when(k == 2, F.lit("no")).otherwise(F.col("sha256")).alias("sha256"))
    return validate.payload_defects(docs, files)
