"""Queries of the cell model, store, edit layer, formulas, formats and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import a1, sheetify
from gridloom.functions import display
from gridloom.operators import formulas, overrides, store
from gridloom.plans.registry import query
from gridloom.session import table
from gridloom.sinks import csv as csv_sink

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_COLS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def line_cells(spark, sf_dir) -> DataFrame:
    return sheetify.to_cells(table(spark, sf_dir, "lineitem"), LINE_KEY, LINE_COLS)


def order_cells(spark, sf_dir) -> DataFrame:
    return sheetify.to_cells(table(spark, sf_dir, "orders"), ["o_orderkey"], ORDER_COLS)


# What the oracles share: a table as typed cells.
LINE_SQL = """
n AS (SELECT *, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::BIGINT AS r FROM lineitem),
cells AS (
  SELECT r, 0 AS c, 'n' AS t, l_orderkey::DOUBLE AS vn, NULL::VARCHAR AS vs FROM n
  UNION ALL SELECT r, 1, 'n', l_partkey::DOUBLE, NULL FROM n
  UNION ALL SELECT r, 2, 'n', l_quantity, NULL FROM n
  UNION ALL SELECT r, 3, 'n', l_extendedprice, NULL FROM n
  UNION ALL SELECT r, 4, 'n', l_discount, NULL FROM n
  UNION ALL SELECT r, 5, 's', NULL, l_returnflag FROM n
  UNION ALL SELECT r, 6, 'd', NULL, strftime(l_shipdate, '%Y-%m-%d') FROM n
)"""
ORDER_SQL = """
n AS (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS r FROM orders),
cells AS (
  SELECT r, 0 AS c, 'n' AS t, o_orderkey::DOUBLE AS vn, NULL::VARCHAR AS vs FROM n
  UNION ALL SELECT r, 1, 'n', o_custkey::DOUBLE, NULL FROM n
  UNION ALL SELECT r, 2, 's', NULL, o_orderstatus FROM n
  UNION ALL SELECT r, 3, 'n', o_totalprice, NULL FROM n
  UNION ALL SELECT r, 4, 'd', NULL, strftime(o_orderdate, '%Y-%m-%d') FROM n
)"""


@query("window_lineitem", f"WITH {LINE_SQL} SELECT r, c, t, vn, vs FROM cells WHERE r BETWEEN 100 AND 163 AND c BETWEEN 2 AND 6")
def window_lineitem(spark, sf_dir):
    return store.window(line_cells(spark, sf_dir), 0, 100, 2, 64, 5).select("r", "c", "t", "vn", "vs")


def saved_lines(spark, sf_dir) -> DataFrame:
    """The line items' sheet as a saved store, range-sorted Parquet; written once for each input and code version."""
    from gridloom.session import shared_path

    path = shared_path(spark, "store", sf_dir, *LINE_KEY, *LINE_COLS)
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        store.save(line_cells(spark, sf_dir), path)
        return spark.read.parquet(path)


@query("window_saved_store", f"WITH {LINE_SQL} SELECT r, c, t, vn, vs FROM cells WHERE r BETWEEN 500 AND 563 AND c BETWEEN 1 AND 6")
def window_saved_store(spark, sf_dir):
    return store.window(saved_lines(spark, sf_dir), 0, 500, 1, 64, 6).select("r", "c", "t", "vn", "vs")


@query("window_clip_edge", f"WITH {ORDER_SQL}, m AS (SELECT max(r) + 1 AS rows FROM n) SELECT r, c, t, vn, vs FROM cells, m WHERE r >= rows - 10 AND c >= 3")
def window_clip_edge(spark, sf_dir):
    cells = order_cells(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").count()
    hr, hc = store.clip(rows, len(ORDER_COLS), rows - 10, 3, 64, 24)
    return store.window(cells, 0, rows - 10, 3, hr, hc).select("r", "c", "t", "vn", "vs")


@query("window_outside_empty", f"WITH {ORDER_SQL} SELECT r, c, t, vn, vs FROM cells WHERE r >= 2000000000")
def window_outside_empty(spark, sf_dir):
    return store.window(order_cells(spark, sf_dir), 0, 2_000_000_000, 0, 64, 24).select("r", "c", "t", "vn", "vs")


@query("window_dense", f"WITH {ORDER_SQL}, g AS (SELECT (i // 4 + 5)::BIGINT AS r, (i % 4 + 1)::INT AS c FROM range(24) x(i)) SELECT g.r, g.c, t, vn, vs FROM g LEFT JOIN cells USING (r, c)")
def window_dense(spark, sf_dir):
    cells = order_cells(spark, sf_dir)
    return store.dense_window(cells, 1_000, 5, 0, 5, 1, 6, 9).select("r", "c", "t", "vn", "vs")


@query("point_lookup_orders", f"WITH {ORDER_SQL} SELECT r, c, t, vn, vs FROM cells WHERE r = 42 AND c = 3")
def point_lookup_orders(spark, sf_dir):
    return store.point(order_cells(spark, sf_dir), 0, 42, 3).select("r", "c", "t", "vn", "vs")


@query("sheet_scan_region", "SELECT r_regionkey::BIGINT AS r, 1 AS c, r_name AS vs FROM region")
def sheet_scan_region(spark, sf_dir):
    cells = sheetify.to_cells(table(spark, sf_dir, "region"), ["r_regionkey"])
    return store.scan_sheet(cells.filter("c = 1"), 0).select("r", "c", "vs")


@query(
    "merges_intersect",
    """WITH m AS (SELECT n_nationkey AS k, chr((65 + n_nationkey % 20)::INT) || (n_nationkey + 1) || ':' || chr((66 + n_nationkey % 20)::INT) || (n_nationkey + 3) AS a1 FROM nation)
       SELECT a1, k::INT AS r0, (k % 20)::INT AS c0, (k + 2)::INT AS r1, (k % 20 + 1)::INT AS c1 FROM m WHERE k < 10 AND k + 2 >= 4 AND k % 20 < 12 AND k % 20 + 1 >= 5""",
)
def merges_intersect(spark, sf_dir):
    k = F.col("n_nationkey")
    start = a1.encode(k, F.pmod(k, F.lit(20)))
    end = a1.encode(k + 2, F.pmod(k, F.lit(20)) + 1)
    merges = store.parse_merges(table(spark, sf_dir, "nation").select(F.lit(0).alias("sheet"), F.concat(start, F.lit(":"), end).alias("a1")))
    return store.merges_in(merges, 0, 4, 5, 6, 7).select("a1", "r0", "c0", "r1", "c1")


@query("sheet_extent", f"WITH {ORDER_SQL} SELECT (max(r) + 1)::BIGINT AS rows, (max(c) + 1)::BIGINT AS cols FROM cells")
def sheet_extent(spark, sf_dir):
    return store.extent(order_cells(spark, sf_dir)).select("rows", "cols")


@query("cap_truncate_orders", f"WITH {ORDER_SQL} SELECT r, c, t, vn, vs FROM cells ORDER BY r, c LIMIT 500")
def cap_truncate_orders(spark, sf_dir):
    kept, _ = store.cap(order_cells(spark, sf_dir), 500)
    return kept.select("r", "c", "t", "vn", "vs")


@query("cap_flags", f"WITH {ORDER_SQL} SELECT 0 AS sheet, count(*) > 500 AS truncated FROM cells")
def cap_flags(spark, sf_dir):
    return store.cap(order_cells(spark, sf_dir), 500)[1]


@query("dedup_last_wins", "SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def dedup_last_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("ord"))
    return store.last_wins(events, ["user_id"]).drop("ord")


@query("a1_encode", "SELECT DISTINCT l_partkey AS k, CASE WHEN k < 26 THEN '' WHEN k < 702 THEN chr((64 + k // 26)::INT) ELSE chr((65 + (k - 702) // 676)::INT) || chr((65 + (k - 702) // 26 % 26)::INT) END || chr((65 + k % 26)::INT) || (l_orderkey % 1000 + 1) AS a1 FROM (SELECT l_partkey % 16384 AS l_partkey, l_orderkey, l_partkey % 16384 AS k FROM lineitem)")
def a1_encode(spark, sf_dir):
    k = F.pmod("l_partkey", F.lit(16384))
    return table(spark, sf_dir, "lineitem").select(k.alias("k"), a1.encode(F.pmod("l_orderkey", F.lit(1000)), k).alias("a1")).distinct()


@query("a1_decode", "SELECT DISTINCT ('$' || chr((65 + l_partkey % 26)::INT) || '$' || (l_suppkey + 1)) AS a1, l_suppkey::INT AS r, (l_partkey % 26)::INT AS c FROM lineitem")
def a1_decode(spark, sf_dir):
    ref = F.concat(F.lit("$"), F.substring(F.lit(a1.LETTERS), (F.pmod("l_partkey", F.lit(26)) + 1).cast("int"), F.lit(1)), F.lit("$"), (F.col("l_suppkey") + 1).cast("string"))
    refs = table(spark, sf_dir, "lineitem").select(ref.alias("a1")).distinct()
    r, c = a1.decode(F.col("a1"))
    return refs.select("a1", r.alias("r"), c.alias("c"))


# Edits.


def order_edits(spark, sf_dir) -> DataFrame:
    """Every seventh order's price is set, then every fourteenth's cleared; one edit lies beyond the last row."""
    rows = sheetify.with_row_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    edits = rows.filter("r % 7 = 0").select((F.col("r") * 2).alias("ord"), "r", (F.col("o_totalprice") * 2).alias("vn"))
    cleared = rows.filter("r % 14 = 0").select((F.col("r") * 2 + 1).alias("ord"), "r", F.lit(None).cast("double").alias("vn"))
    beyond = rows.agg((F.max("r") + 10).alias("r")).select(F.lit(0).alias("ord"), F.col("r"), F.lit(1.5).alias("vn"))
    none = [F.lit(None).cast("string").alias("vs"), F.lit(None).cast("boolean").alias("vb"), F.lit(None).cast("string").alias("f")]
    typed = edits.unionByName(cleared).unionByName(beyond).withColumn("c", F.lit(3)).withColumn("sheet", F.lit(0))
    return typed.select("ord", "sheet", "r", "c", F.when(F.col("vn").isNull(), "s").otherwise("n").alias("t"), "vn", *none)


@query(
    "override_apply_orders",
    f"""WITH {ORDER_SQL}, e AS (SELECT r, CASE WHEN r % 14 = 0 THEN NULL ELSE o_totalprice * 2 END AS v FROM n WHERE r % 7 = 0 UNION ALL SELECT max(r) + 10, 1.5 FROM n)
        SELECT coalesce(cells.r, e.r)::BIGINT AS r, coalesce(cells.c, 3)::INT AS c, CASE WHEN e.r IS NULL THEN t WHEN e.v IS NULL THEN 's' ELSE 'n' END AS t, CASE WHEN e.r IS NULL THEN vn ELSE e.v END AS vn, vs
        FROM cells FULL JOIN e ON cells.r = e.r AND cells.c = 3""",
)
def override_apply_orders(spark, sf_dir):
    return overrides.apply(order_cells(spark, sf_dir), order_edits(spark, sf_dir)).select("r", "c", "t", "vn", "vs")


@query("override_applied_count", "WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) SELECT (count_if(r % 7 = 0) + 1)::BIGINT AS applied FROM n")
def override_applied_count(spark, sf_dir):
    return overrides.scoped(overrides.collapse(order_edits(spark, sf_dir)), 0).agg(F.count(F.lit(1)).alias("applied"))


@query("override_extent_growth", "SELECT 0 AS sheet, (count(*) + 10)::BIGINT AS rows, 5::BIGINT AS cols FROM orders")
def override_extent_growth(spark, sf_dir):
    sheets = store.extent(order_cells(spark, sf_dir))
    return overrides.grow_extent(sheets, order_edits(spark, sf_dir))


@query("override_sizes", "SELECT 'col' AS axis, (event_id % 50)::INT AS \"at\", greatest(0, least(255, max_by(value, event_id)))::DOUBLE AS size FROM events GROUP BY event_id % 50")
def override_sizes(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.lit(0).alias("sheet"), F.lit("col").alias("axis"), F.pmod("event_id", F.lit(50)).cast("int").alias("at"), F.col("value").alias("size"))
    return overrides.collapse_sizes(sizes).select("axis", "at", "size")


@query("size_ranges", "WITH d AS (SELECT s_suppkey AS ord, (s_suppkey * 7 % 300)::INT AS lo, (s_suppkey * 7 % 300 + s_suppkey % 40)::INT AS hi, (s_suppkey % 90 + 1)::DOUBLE AS size FROM supplier), x AS (SELECT ord, size, unnest(generate_series(lo, least(hi, 275))) AS k FROM d WHERE lo <= 275) SELECT k::INT AS \"at\", max_by(size, ord) AS size FROM x GROUP BY k")
def size_ranges(spark, sf_dir):
    k = F.col("s_suppkey")
    declared = table(spark, sf_dir, "supplier").select(k.alias("ord"), F.pmod(k * 7, F.lit(300)).cast("int").alias("lo"), (F.pmod(k * 7, F.lit(300)) + F.pmod(k, F.lit(40))).cast("int").alias("hi"), (F.pmod(k, F.lit(90)) + 1).cast("double").alias("size"))
    return store.expand_ranges(declared, 20)


# Formulas.


def _line_points(spark, sf_dir) -> DataFrame:
    """One numeric column of the line items as cells, with the order as group; some cells are text or errors."""
    line = table(spark, sf_dir, "lineitem")
    odd = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(97))
    t = F.when(odd == 0, "s").when((odd == 1) & (F.pmod("l_suppkey", F.lit(50)) == 0), "e").otherwise("n")
    return line.select(
        "l_orderkey", F.col("l_orderkey").cast("int").alias("r"), F.col("l_linenumber").alias("c"), t.alias("t"), F.when(t == "n", F.col("l_quantity")).alias("vn"),
        F.when(t == "s", F.lit("text")).when(t == "e", F.lit("#N/A")).alias("vs"), F.lit(None).cast("boolean").alias("vb"),
    )


_POINTS_SQL = """p AS (SELECT l_orderkey, l_quantity AS q, CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 's' WHEN (l_orderkey + l_linenumber) % 97 = 1 AND l_suppkey % 50 = 0 THEN 'e' ELSE 'n' END AS t FROM lineitem)"""


@query(
    "formula_range_aggregates",
    f"""WITH {_POINTS_SQL} SELECT l_orderkey, max(CASE WHEN t = 'e' THEN '#N/A' END) AS error, coalesce(sum(q) FILTER (t = 'n'), 0)::DOUBLE AS "sum", count(*) FILTER (t = 'n') AS "count",
        count(*) AS counta, coalesce(min(q) FILTER (t = 'n'), 0)::DOUBLE AS "min", coalesce(max(q) FILTER (t = 'n'), 0)::DOUBLE AS "max", bool_and(q <> 0) FILTER (t = 'n') AS "and", bool_or(q <> 0) FILTER (t = 'n') AS "or",
        CASE WHEN count(*) FILTER (t = 'n') = 0 THEN '#VALUE!' END AS and_error, CASE WHEN count(*) FILTER (t = 'n') = 0 THEN '#VALUE!' END AS or_error
        FROM p GROUP BY l_orderkey""",
)
def formula_range_aggregates(spark, sf_dir):
    return formulas.range_aggregate(_line_points(spark, sf_dir), ["l_orderkey"], ["sum", "count", "counta", "min", "max", "and", "or"])


@query("formula_average", f"WITH {_POINTS_SQL} SELECT l_orderkey, round(avg(q) FILTER (t = 'n'), 9) AS average, CASE WHEN count(*) FILTER (t = 'n') = 0 THEN '#DIV/0!' END AS average_error FROM p GROUP BY l_orderkey")
def formula_average(spark, sf_dir):
    out = formulas.range_aggregate(_line_points(spark, sf_dir), ["l_orderkey"], ["average"])
    return out.select("l_orderkey", F.round("average", 9).alias("average"), "average_error")


@query("formula_range_join", f"WITH {ORDER_SQL}, x AS (SELECT n_nationkey AS id, n_nationkey * 30 AS r0, n_nationkey * 30 + 200 AS r1 FROM nation) SELECT id, count(*) AS cells, round(sum(vn), 2) AS total FROM x JOIN cells ON r BETWEEN r0 AND r1 AND c BETWEEN 1 AND 3 GROUP BY id")
def formula_range_join(spark, sf_dir):
    k = F.col("n_nationkey")
    rects = table(spark, sf_dir, "nation").select(k.alias("id"), F.lit(0).alias("sheet"), (k * 30).alias("r0"), F.lit(1).alias("c0"), (k * 30 + 200).alias("r1"), F.lit(3).alias("c1"))
    joined = formulas.range_join(order_cells(spark, sf_dir), rects)
    return joined.groupBy("id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("vn"), 2).alias("total"))


@query(
    "formula_round_excel",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       sign(x) * floor(abs(x) * 10 + 8.881784197001252e-16 * greatest(abs(x) * 10, 1) + 0.5) / 10 AS rounded FROM (SELECT *, l_extendedprice * l_discount AS x FROM lineitem)""",
)
def formula_round_excel(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, formulas.excel_round(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("rounded"))


@query("formula_concat_range", "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def formula_concat_range(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(items, lambda x: x.n_name), "").alias("text"))


@query("formula_filldown_margin", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS margin FROM lineitem")
def formula_filldown_margin(spark, sf_dir):
    from gridloom.functions.compile import compile_row

    line = table(spark, sf_dir, "lineitem")
    names = {0: "l_extendedprice", 1: "l_discount", 2: "l_tax"}
    return line.select(*LINE_KEY, compile_row("A1*(1-B1)*(1+C1)", {c: ("n", F.col(n)) for c, n in names.items()})["vn"].alias("margin"))


@query("formula_guarded_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS vn, CASE WHEN l_tax = 0 THEN '#DIV/0!' END AS vs FROM lineitem")
def formula_guarded_ratio(spark, sf_dir):
    from gridloom.functions.compile import compile_row

    out = compile_row("A1/B1", {0: ("n", F.col("l_discount")), 1: ("n", F.col("l_tax"))})
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, out["vn"].alias("vn"), out["vs"].alias("vs"))


@query("formula_compare_rank", "SELECT p_partkey, p_size < 20 AND lower(p_brand) < 'brand#3' AS small FROM part")
def formula_compare_rank(spark, sf_dir):
    from gridloom.functions.compile import compile_row

    out = compile_row('AND(A1<20,B1<"Brand#3")', {0: ("n", F.col("p_size").cast("double")), 1: ("s", F.col("p_brand"))})
    return table(spark, sf_dir, "part").select("p_partkey", out["vb"].alias("small"))


_CHAIN_SQL = """e AS (SELECT s_suppkey // 2 AS src, s_suppkey AS dst FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 90, 91 UNION ALL SELECT 91, 90)"""


def _chain(spark, sf_dir) -> DataFrame:
    """Each supplier reads the one at half its number; 90 and 91 read each other."""
    k = F.col("s_suppkey")
    tree = table(spark, sf_dir, "supplier").filter("s_suppkey > 1").select(F.floor(k / 2).alias("src"), k.alias("dst"))
    return tree.unionByName(spark.createDataFrame([(90, 91), (91, 90)], "src long, dst long"))


@query("recalc_reachable", f"WITH RECURSIVE {_CHAIN_SQL}, c AS (SELECT 5::BIGINT AS node UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c")
def recalc_reachable(spark, sf_dir):
    return formulas.reachable(_chain(spark, sf_dir), spark.createDataFrame([(5,)], "node long"))


@query(
    "formula_levels",
    f"""WITH RECURSIVE {_CHAIN_SQL}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), bad AS (SELECT 90::BIGINT AS node UNION SELECT e.dst FROM bad JOIN e ON e.src = bad.node),
        l AS (SELECT n.node, 0 AS level FROM n WHERE n.node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node WHERE l.level < 64 AND e.dst NOT IN (SELECT node FROM bad))
        SELECT n.node, max(l.level)::INT AS level FROM n LEFT JOIN l ON n.node = l.node AND n.node NOT IN (SELECT node FROM bad) GROUP BY n.node""",
)
def formula_levels(spark, sf_dir):
    edges = _chain(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return formulas.levels(nodes, edges)


# Formats.

_CENTS = "floor(abs(x) * 100) + CASE WHEN abs(x) * 100 - floor(abs(x) * 100) >= 0.5 THEN 1 ELSE 0 END"


@query("fmt_grouped", f"SELECT o_orderkey, CASE WHEN x < 0 THEN '-' ELSE '' END || format('{{:,d}}', ({_CENTS})::BIGINT // 100) || '.' || lpad(((({_CENTS})::BIGINT) % 100)::VARCHAR, 2, '0') AS d FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)")
def fmt_grouped(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", display.format_column("#,##0.00", F.col("o_totalprice")).alias("d"))


@query("fmt_percent", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (floor(l_discount * 100) + CASE WHEN l_discount * 100 - floor(l_discount * 100) >= 0.5 THEN 1 ELSE 0 END)::INT || '%' AS d FROM lineitem")
def fmt_percent(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, display.format_column("0%", F.col("l_discount")).alias("d"))


@query("fmt_accounting", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '(' || k || ')' ELSE k || ' ' END AS d FROM (SELECT c_custkey, c_acctbal, format('{:,d}', (floor(abs(c_acctbal)) + CASE WHEN abs(c_acctbal) - floor(abs(c_acctbal)) >= 0.5 THEN 1 ELSE 0 END)::BIGINT) AS k FROM customer)")
def fmt_accounting(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", display.format_column("#,##0 ;(#,##0)", F.col("c_acctbal")).alias("d"))


_SERIAL = "datediff('day', DATE '1899-12-30', o_orderdate::DATE)"


@query("fmt_date_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%d-%b-%y') AS short FROM orders")
def fmt_date_iso(spark, sf_dir):
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", display.format_column("yyyy-mm-dd", serial).alias("d"), display.format_column("dd-mmm-yy", serial).alias("short"))


@query("fmt_elapsed_hours", "SELECT s_suppkey, (m // 60) || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS d FROM (SELECT s_suppkey, s_suppkey * 37 AS m FROM supplier)")
def fmt_elapsed_hours(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", display.format_column("[h]:mm", F.col("s_suppkey") * 37 / 1440.0).alias("d"))


@query("fmt_general", "SELECT p_partkey, p_size::VARCHAR AS d, CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE (p_size // 4) || substr(((p_size % 4) / 4.0)::DECIMAL(3, 2)::VARCHAR, 2, CASE WHEN p_size % 4 = 2 THEN 2 ELSE 3 END) END AS quarter FROM part")
def fmt_general(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", display.format_column("General", F.col("p_size").cast("double")).alias("d"), display.format_column("General", F.col("p_size") / 4.0).alias("quarter"))


@query(
    "fmt_fraction",
    """WITH x AS (SELECT p_partkey, floor(p_retailprice)::BIGINT AS whole, round(p_retailprice * 100)::BIGINT % 100 AS k FROM part),
       f AS (SELECT k, d, (k * d + 50) // 100 AS n, abs(k * d - 100 * ((k * d + 50) // 100))::DOUBLE / d AS off FROM (SELECT unnest(range(100)) AS k), (SELECT unnest(range(1, 100)) AS d)),
       b AS (SELECT k, min_by(n, (off, d)) AS n, min_by(d, (off, d)) AS d FROM f GROUP BY k)
       SELECT p_partkey, CASE WHEN n = 0 THEN whole || '      ' WHEN n = d THEN (whole + 1) || '      ' ELSE whole || ' ' || lpad(n::VARCHAR, 2, ' ') || '/' || rpad(d::VARCHAR, 2, ' ') END AS d FROM x JOIN b USING (k)""",
)
def fmt_fraction(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", display.format_column("# ??/??", F.col("p_retailprice")).alias("d"))


@query("fmt_scientific", "SELECT p_partkey, (p_partkey % 9 + 1) || '.00E+03' AS d FROM part")
def fmt_scientific(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", display.format_column("0.00E+00", (F.pmod("p_partkey", F.lit(9)) + 1) * 1000.0).alias("d"))


# Sinks.


@query(
    "csv_line_orders",
    """SELECT r, k::VARCHAR || ',' || s || ',"' || replace(o, '"', '""') || '"' AS line FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS r, o_orderkey AS k, o_orderstatus AS s, o_orderpriority || ', "x"' AS o FROM orders)""",
)
def csv_line_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.concat("o_orderpriority", F.lit(', "x"')).alias("o"))
    cells = sheetify.to_cells(orders, ["o_orderkey"])
    return csv_sink.lines(cells, 3)
