import random

import pytest
from pyspark.sql import functions as F

from gridloom import a1, schema, sheetify
from gridloom.operators import diff, formulas, overrides, scoreboard, store, validate
from gridloom.session import ready
from gridloom.sinks import csv as csv_sink

CELL = "sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string, ord int"


def cell(sheet, r, c, v, order=0, fmt=None):
    t = "b" if isinstance(v, bool) else "n" if isinstance(v, float) else "s"
    return (sheet, r, c, t, v if t == "n" else None, v if t == "s" else None, v if t == "b" else None, None, None, fmt, order)


def test_a1_round_trip(spark):
    places = [(0, 0), (9, 25), (99, 26), (5, 701), (6, 702), (1_048_575, 16_383)]
    df = spark.createDataFrame([(r, c, a1.cell_name(r, c)) for r, c in places], "r int, c int, ref string")
    r, c = a1.decode(F.col("ref"))
    for row in df.select("*", a1.encode(F.col("r"), F.col("c")).alias("e"), r.alias("r2"), c.alias("c2")).collect():
        assert (row.e, row.r2, row.c2) == (row.ref, row.r, row.c) and a1.parse_cell(row.ref) == (row.r, row.c)
    bad = spark.createDataFrame([("XFE1",), ("A0",), ("1A",), ("A1048577",), (None,), ("AAAA1",)], "ref string")
    r, c = a1.decode(F.col("ref"))
    assert all(x[0] is None for x in bad.select(r).collect())
    assert a1.parse_range("D6:B4") == (3, 1, 5, 3) and a1.parse_cell("$A$1", dollars=False) is None


def test_windows_against_brute_force(spark):
    """Random sheets with duplicates and cells outside the extent, as a store test of the kind that finds off-by-ones."""
    rng = random.Random(0x5EED)
    cells, extents = [], []
    for sheet in range(12):
        rows, cols = rng.randint(1, 30), rng.randint(1, 20)
        extents.append((sheet, rows, cols))
        cells += [cell(sheet, rng.randint(0, rows + 2), rng.randint(0, cols + 2), float(k), k) for k in range(rng.randint(0, 100))]
    sheets = spark.createDataFrame(extents, "sheet int, rows long, cols long")
    built = store.build(spark.createDataFrame(cells, CELL), sheets, "ord").cache()
    want = {}
    for x in cells:
        if x[1] < extents[x[0]][1] and x[2] < extents[x[0]][2]:
            want[x[:3]] = x[4]
    for sheet, rows, cols in extents:
        r0, c0, nr, nc = rng.randint(0, rows), rng.randint(0, cols), rng.randint(1, 40), rng.randint(1, 30)
        got = {(x.sheet, x.r, x.c): x.vn for x in store.window(built, sheet, r0, c0, nr, nc).collect()}
        assert got == {k: v for k, v in want.items() if k[0] == sheet and r0 <= k[1] < r0 + nr and c0 <= k[2] < c0 + nc}
    assert store.clip(10, 5, 8, 0, 64, 24) == (2, 5) and store.clip(10, 5, 10, 0, 1, 1) == (0, 0)
    with pytest.raises(ValueError):
        store.check_window(0, 5)


def test_overrides(spark):
    cells = spark.createDataFrame([cell(0, 0, 0, 1.0, 0, "0.0"), cell(0, 0, 1, "x"), cell(0, 1, 0, 2.0)], CELL).drop("ord")
    edits = spark.createDataFrame([(0, 0, 0, 0, "n", 5.0, None, None, None), (1, 0, 0, 0, "n", 6.0, None, None, None), (2, 0, 0, 1, "s", None, None, None, None), (3, 0, 9, 9, "s", None, "=1+1", None, None)], schema.OVERRIDES)
    sheets = spark.createDataFrame([(0, 2, 2)], "sheet int, rows long, cols long")
    overrides.validate(edits, sheets)
    got = {(x.r, x.c): (x.t, x.vn, x.vs, x.fmt) for x in overrides.apply(cells, edits).collect()}
    assert got == {(0, 0): ("n", 6.0, None, "0.0"), (0, 1): ("s", None, None, None), (1, 0): ("n", 2.0, None, None), (9, 9): ("s", None, "=1+1", None)}
    assert tuple(overrides.grow_extent(sheets, edits).first()) == (0, 10, 10)
    far = spark.createDataFrame([(0, 0, 1_000_000, 100, "n", 1.0, None, None, None)], schema.OVERRIDES)
    with pytest.raises(overrides.OverrideError) as e:
        overrides.validate(far, sheets)
    assert e.value.code == "bomb"


@pytest.mark.parametrize("n", [0, 1, 500])
def test_row_numbers(spark, n):
    df = spark.range(n).select(((F.col("id") * 7919) % 1009).alias("k"), "id")
    got = sheetify.with_row_number(df, ["k", "id"], ranges=8).collect()
    assert [x.r for x in sorted(got, key=lambda x: (x.k, x.id))] == list(range(n))


def test_row_numbers_of_text_and_equal_first_keys(spark):
    rows = [(None if k % 50 == 0 else "same" if k % 3 else f"t{k * 7919 % 1009:04d}", k) for k in range(800)]
    got = sheetify.with_row_number(spark.createDataFrame(rows, "k string, id long").repartition(5), ["k", "id"], ranges=6).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert [(x.k, x.id) for x in sorted(got, key=lambda x: x.r)] == want and dict(spark.createDataFrame(rows[:1], "k string, id long").transform(lambda d: sheetify.with_row_number(d, ["k"])).dtypes)["r"] == "bigint"


def two_books(spark):
    rows = [("a.xlsx", *cell(0, 0, 0, 1.0, 0)), ("a.xlsx", *cell(0, 0, 0, 2.0, 1)), ("b.xlsx", *cell(0, 0, 0, 3.0, 2)), ("b.xlsx", *cell(0, 4, 2, 4.0, 3)), ("a.xlsx", *cell(1, 1, 1, True, 4))]
    return spark.createDataFrame(rows, "workbook string, " + CELL)


def test_cells_of_two_workbooks_stay_apart(spark):
    ready(spark)
    cells = two_books(spark)
    built = store.build(cells, order="ord")
    assert {(x.workbook, x.sheet, x.r, x.c): x.vn for x in built.collect()} == {("a.xlsx", 0, 0, 0): 2.0, ("b.xlsx", 0, 0, 0): 3.0, ("b.xlsx", 0, 4, 2): 4.0, ("a.xlsx", 1, 1, 1): None}
    sheets = spark.createDataFrame([("a.xlsx", 0, 1, 1), ("a.xlsx", 1, 2, 2), ("b.xlsx", 0, 1, 1)], "workbook string, sheet int, rows long, cols long")
    assert store.build(cells, sheets, "ord").count() == 3
    assert {(x.workbook, x.sheet): (x.rows, x.cols) for x in store.extent(built).collect()} == {("a.xlsx", 0): (1, 1), ("a.xlsx", 1): (2, 2), ("b.xlsx", 0): (5, 3)}
    kept, flags = store.cap(built, 1)
    assert sorted((x.workbook, x.vn) for x in kept.collect()) == [("a.xlsx", 2.0), ("b.xlsx", 3.0)]
    assert {(x.workbook, x.sheet): x.truncated for x in flags.collect()} == {("a.xlsx", 0): False, ("a.xlsx", 1): True, ("b.xlsx", 0): True}
    assert sorted((x.workbook, x.r, x.rule) for x in validate.cell_violations(cells, sheets).collect()) == [("a.xlsx", 0, "duplicate"), ("b.xlsx", 4, "extent")]
    other = built.withColumn("vn", F.when(F.col("workbook") == "a.xlsx", F.col("vn") + 1).otherwise(F.col("vn")))
    r = diff.round_trip(built, other).first()
    assert (r.total, r.value_matched, r.extra) == (4, 3, 0)
    styled = built.select("workbook", "sheet", "r", "c", (F.col("vn") > 1).alias("bold"))
    _, styles = store.intern_styles(styled, ["bold"])
    assert sorted((x.workbook, x.style_id) for x in styles.collect()) == [("a.xlsx", 0), ("b.xlsx", 0)]


def test_books_by_their_own_names_and_dates(spark):
    ready(spark)
    none = (None,) * 3
    rows = [("a", 0, 0, 0, "n", 1.0, *none[:2], None, "First!B1+1", "yyyy"), ("a", 0, 0, 1, "n", 2.0, *none[:2], None, None, None), ("b", 0, 0, 0, "n", 1.0, *none[:2], None, "Second!A1+1", "yyyy"), ("b", 1, 0, 0, "n", 9.0, *none[:2], None, None, None), ("c", 0, 0, 0, "n", 0.0, *none[:2], None, "First!A2", None)]
    cells = spark.createDataFrame(rows, "workbook string, sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string")
    sheets = spark.createDataFrame([("a", 0, "First"), ("b", 0, "Other"), ("b", 1, "Second")], "workbook string, sheet int, name string")
    books = spark.createDataFrame([("a", False), ("b", True)], "workbook string, date_1904 boolean")
    done = formulas.evaluate_books(cells, sheets, books)
    assert sorted((x.workbook, x.vn, x.d) for x in done.collect()) == [("a", 3.0, "1900"), ("b", 10.0, "1904")]
    assert [tuple(x) for x in formulas.unevaluated(cells, done).collect()] == [("c", 0, 1)]


def test_sheetify_back(spark):
    df = spark.createDataFrame([(2, "b", True), (1, "a", None)], "k int, s string, f boolean")
    cells = sheetify.to_cells(df, ["k"])
    back = sheetify.from_cells(cells, ["k", "s", "f"]).orderBy("r").collect()
    assert [(x.k, x.s, x.f) for x in back] == [("1.0", "a", None), ("2.0", "b", "true")]


def test_sizes_and_styles(spark):
    declared = spark.createDataFrame([(0, 0, 16383, 9.0), (1, 2, 3, 20.0)], "ord int, lo int, hi int, size double")
    got = {x["at"]: x["size"] for x in store.expand_ranges(declared, 4, 2).collect()}
    assert got == {0: 9.0, 1: 9.0, 2: 20.0, 3: 20.0, 4: 9.0, 5: 9.0}
    cells = spark.createDataFrame([(0, 0, 0, False, None), (0, 0, 1, True, None), (0, 1, 0, False, "Arial"), (0, 2, 0, True, None)], "sheet int, r int, c int, bold boolean, font string")
    styled, styles = store.intern_styles(cells, ["bold", "font"])
    assert {(x.r, x.c): x.s for x in styled.collect()} == {(0, 0): None, (0, 1): 0, (1, 0): 1, (2, 0): 0} and styles.count() == 2


def test_csv_text(spark, tmp_path):
    rows = [cell(0, 0, 0, 1.0), cell(0, 0, 1, 'a"b'), cell(0, 1, 2, True), cell(0, 3, 0, 1e21), cell(0, 3, 1, 0.1), cell(0, 3, 2, "l1\r\nl2")]
    ready(spark)
    path = str(tmp_path / "a.csv")
    csv_sink.write_file(spark.createDataFrame(rows, CELL).drop("d"), path, 4, 3)
    twice = spark.createDataFrame([*rows, cell(0, 0, 0, 7.0, 1)], CELL).drop("d")
    assert csv_sink.lines(twice, 3, order="ord").filter("r = 0").first().line.startswith("7,")
    assert open(path, newline="").read() == '1,"a""b",\r\n,,TRUE\r\n,,\r\n1000000000000000000000,0.1,"l1\r\nl2"\r\n'


def test_range_join_and_graphs(spark):
    rng = random.Random(1)
    points = [(0, rng.randint(0, 300), rng.randint(0, 20), float(k)) for k in range(300)]
    rects = [(k, 0, a := rng.randint(0, 250), b := rng.randint(0, 15), a + rng.randint(0, 150), b + rng.randint(0, 8)) for k in range(30)]
    got = sorted((x.id, x.v) for x in formulas.range_join(spark.createDataFrame(points, "sheet int, r int, c int, v double"), spark.createDataFrame(rects, "id int, sheet int, r0 int, c0 int, r1 int, c1 int")).collect())
    assert got == sorted((i, v) for i, _, r0, c0, r1, c1 in rects for _, r, c, v in points if r0 <= r <= r1 and c0 <= c <= c1)
    ready(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)], "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in range(1, 8)], "node int")
    assert {x.node: x.level for x in formulas.levels(nodes, edges).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: 0}
    assert {x.node for x in formulas.reachable(edges, spark.createDataFrame([(2,)], "node int")).collect()} == {2, 3}


def test_compare_edges(spark):
    a = spark.createDataFrame([cell(0, 0, 0, 1.0), cell(0, 0, 1, "x"), cell(0, 0, 2, True)], CELL)
    b = spark.createDataFrame([cell(0, 0, 0, 1.0 + 1e-12), cell(0, 0, 1, "y"), cell(0, 5, 0, 2.0)], CELL)
    r = diff.compare(diff.paired(a, b)).first()
    assert (r.cells, r.value_matched, r.a_cells, r.b_cells) == (4, 1, 3, 3)
    assert {(x.bucket, x.n) for x in diff.mismatch_buckets(diff.paired(a, b)).collect()} == {("s/s", 1), ("b/-", 1), ("-/n", 1)}
    assert diff.probe_offsets(10, 10) == [(0, 0)] and len(diff.probe_offsets(1000, 100)) == 5


def test_scoreboard_edges(spark):
    empty = spark.createDataFrame([], "m long, t long, v double, ext string")
    r = scoreboard.ratios(empty, {"x": ("m", "t")}).first()
    assert r.x_percent is None and scoreboard.latency(empty, "v").first().p50 is None
    values = spark.createDataFrame([(float(k),) for k in range(1, 11)], "v double")
    assert tuple(scoreboard.latency(values, "v").first()) == (5.0, 10.0, 10.0)
    rng = random.Random(4)
    many = [(rng.choice(["p", "q", None]), float(rng.randint(0, 40)) if rng.random() < 0.9 else None) for _ in range(700)]
    got = {r.g: (r.a, r.b, r.max) for r in scoreboard.nearest_ranks(spark.createDataFrame(many, "g string, v double"), "v", {"a": 1, "b": 73}, ["g"]).collect()}
    for g in ("p", "q", None):
        own = sorted(v for k, v in many if k == g and v is not None)
        assert got[g] == (own[-(-len(own) // 100) - 1], own[-(-73 * len(own) // 100) - 1], own[-1])
    texts = ["", "a", "files/é.xlsx", "x" * 300]

    def hashed(seed, text):
        h = scoreboard.FNV_OFFSET ^ seed
        for b in text.encode():
            h = (h ^ b) * scoreboard.FNV_PRIME % 2**64
        return h

    for seed in (0, 7, 2**63 + 5):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoreboard.seeded_hash(F.col("t"), seed).alias("h")).collect()
        assert {r.t: (r.h.hi << 32) + r.h.lo for r in rows} == {t: hashed(seed, t) for t in texts}
    assert "| a |" in scoreboard.markdown_table(spark.createDataFrame([("a", 1.5, None)], "x string, y double, z string"))


def test_violations(spark):
    cells = spark.createDataFrame([cell(0, 0, 0, 1.0), cell(0, 0, 0, 2.0), cell(0, 9, 0, 1.0), (0, 1, 0, "q", None, None, None, None, None, None, 0)], CELL)
    sheets = spark.createDataFrame([(0, 5, 5)], "sheet int, rows long, cols long")
    assert sorted((x.r, x.rule) for x in validate.cell_violations(cells, sheets).collect()) == [(0, "duplicate"), (1, "type"), (9, "extent")]
    books = spark.createDataFrame([("a", True, True, None), ("b", False, True, "io")], "workbook string, truncated boolean, ok boolean, code string")
    own = spark.createDataFrame([("a", 0, False), ("a", 2, False), ("b", 0, False)], "workbook string, sheet int, truncated boolean")
    assert sorted(tuple(x) for x in validate.sheet_violations(own, books).collect()) == [("a", "index"), ("a", "truncated"), ("b", "error")]
    merges = spark.createDataFrame([("a", 0, 0, 0, 0, 1, 1), ("a", 0, 1, 0, 0, 1, 1)], "workbook string, sheet int, ord int, r0 int, c0 int, r1 int, c1 int")
    assert validate.merge_order(merges).count() == 1


def test_manifest_rules(spark):
    """Each rule on its own against an entry that is sound; what the reference lets pass stays unreported."""
    from gridloom.sources.manifests import MANIFEST

    sound = {"id": "A/b c.xlsx", "path": "corpus/files/A/b.XLSX", "sha256": "0" * 64, "bytes": 3, "ext": "xlsx", "collection": "k", "source": "http://x", "licence": "l", "fetchedAt": "2024-01-02T03:04:05Z", "private": False}
    own = sound | {"private": True, "path": "/data/b.xlsx", "source": "file:///data/b.xlsx"}
    cases = [
        (sound, set()), (own, set()), (sound | {"id": "/a.xlsx"}, {"id"}), (sound | {"id": "a/../b.xlsx"}, {"id"}), (sound | {"id": "a.xls"}, {"id_ext"}), (sound | {"id": ".xlsx"}, {"id_ext"}),
        (sound | {"path": "corpus/files/b"}, {"path_ext"}), (sound | {"path": "files/b.xlsx"}, {"path"}), (sound | {"path": "corpus/files/../b.xlsx"}, {"path"}), (sound | {"path": "/data/b.xlsx"}, {"path"}),
        (sound | {"sha256": "0" * 64 + "\n"}, {"sha256"}), (sound | {"bytes": 30 * 2**20 + 1}, {"bytes"}), (sound | {"bytes": 30 * 2**20}, set()), (sound | {"ext": "doc", "id": "q.doc", "path": "corpus/files/q.doc"}, {"ext"}),
        (sound | {"collection": ""}, {"collection"}), (sound | {"licence": None}, {"licence"}), (sound | {"source": "file:///x"}, {"source"}), (sound | {"fetchedAt": "2024-01-02"}, {"fetchedAt"}),
        (sound | {"private": None, "path": "anywhere.xlsx", "source": "x"}, {"private"}), (own | {"path": "b.xlsx"}, {"path"}), (own | {"path": "/repo/x/../corpus//files/b.xlsx"}, {"path"}), (own | {"source": "http://x"}, {"source"}),
    ]
    rows = [e | {"id": f"{k}/{e['id']}" if not e["id"].startswith("/") else e["id"]} for k, (e, _) in enumerate(cases)]
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    frame = lambda es: spark.createDataFrame([tuple(e[n] for n in names) for e in es], MANIFEST)
    got = [tuple(r) for r in validate.manifest_violations(frame(rows), "/repo").collect()]
    assert sorted(got) == sorted((r["id"], x) for r, (_, rules) in zip(rows, cases) for x in rules)
    many = frame([sound | {"id": f"{k}.xlsx", "bytes": 30 * 2**20} for k in range(137)] + [own, own])
    assert [tuple(r) for r in validate.manifest_violations(many.limit(136), "/repo").collect()] == []
    assert sorted(map(str, (tuple(r) for r in validate.manifest_violations(many, "/repo").collect()))) == ["('A/b c.xlsx', 'duplicate')", "(None, 'total')"]


def test_unsorted_over_gaps(spark):
    df = spark.createDataFrame([(k, v) for k, v in ((1, 1), (2, 5), (4, 3), (9, 3), (12, 8), (-3, 0))], "ord int, key int")
    assert sorted(tuple(r) for r in validate.unsorted(df, "key", "ord").select("ord", "key", "next").collect()) == [(2, 5, 3), (4, 3, 3)]
