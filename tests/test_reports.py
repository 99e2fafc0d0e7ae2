import json

import pytest

from gridloom.operators import reports
from gridloom.session import ready
from gridloom.sources import manifests

CELL = "workbook string, sheet int, r int, c int, t string, vn double, vs string, vb boolean, d string, f string, fmt string"


def test_scoreboard_of_files(spark):
    ours = spark.createDataFrame([("a", 0, 0, k, "n", float(k), None, None, str(k), None, None) for k in range(4)], CELL)
    theirs = spark.createDataFrame([("a", 0, 0, k, "n", float(k % 3), None, None, str(k), None, None) for k in range(4)], CELL)
    files = spark.createDataFrame([("a", "XLSX", False, True, True, 2.0, 1000), ("b", "", False, False, True, 9.0, 5_000_000)], "workbook string, ext string, private boolean, ok boolean, theirs_ok boolean, ms double, rss long")
    ready(spark)
    metrics = reports.file_metrics(ours, theirs, files)
    row = reports.scoreboard_row(metrics).first()
    assert (row.files, row.opened, row.value_matched, row.value_total, row.display_percent, row.ms_p95, row.rss_max) == (2, 1, 3, 4, 100.0, 9.0, 5_000_000)
    assert [r.ext for r in reports.per_extension(metrics).collect()] == ["unknown", "xlsx"]
    text = reports.scoreboard_markdown(row)
    assert "| cell values | 75.00% (3/4) |" in text and "4.77 MiB" in text and reports.show_ratio(0, 0) == "—"


def test_round_trip_and_triage(spark):
    rows = spark.createDataFrame([("compared", 4, 4, 3, 0, True, True, None), ("compared", 4, 2, 2, 1, True, False, None), ("failed", None, None, None, None, None, None, None)], "status string, total long, value_matched long, display_matched long, extra long, merges_equal boolean, reread_ok boolean, soffice_ok boolean")
    r = reports.round_trip_row(rows).first()
    assert (r.files, r.clean, r.failed, r.value_percent, r.reread_percent, r.soffice_percent) == (2, 1, 1, 75.0, 50.0, None)
    drops = spark.createDataFrame([("p1", False, ["x", "y"]), ("p2", True, ["x"]), ("p0", False, ["x"])], "path string, private boolean, dropped array<string>")
    got = [tuple(x) for x in reports.drop_sections(drops).collect()]
    assert sorted(got) == [("x", 3, 1, ["p0", "p1"]), ("y", 1, 0, ["p1"])]


def test_json_sources(spark, tmp_path):
    ready(spark)
    for k, data in enumerate(([{"code": "0", "count": 2}], {"formats": [{"code": "0", "count": 2}]}, {"entries": [{"code": "0", "count": 2}]})):
        (tmp_path / f"{k}.json").write_text(json.dumps(data))
        assert [tuple(r) for r in reports.format_index(spark, str(tmp_path / f"{k}.json")).collect()] == [("0", 2)]
    (tmp_path / "twice.json").write_text(json.dumps([{"code": "0", "count": 2}, {"code": "0", "count": 1}]))
    with pytest.raises(reports.DuplicateCode):
        reports.format_index(spark, str(tmp_path / "twice.json"))
    (tmp_path / "o.json").write_text(json.dumps([{"sheet": 0, "r": 1, "c": 2, "v": 5}, {"sheet": 0, "r": 1, "c": 2, "v": "5"}, {"sheet": 0, "r": 0, "c": 0, "v": True}, {"sheet": 0, "r": 0, "c": 1, "v": None}, {"sheet": 0, "r": 0, "c": 1, "f": "=A1"}]))
    rows = manifests.overrides(spark, str(tmp_path / "o.json")).orderBy("ord").collect()
    assert [(r.t, r.vn, r.vs, r.vb, r.f) for r in rows] == [("n", 5.0, None, None, None), ("s", None, "5", None, None), ("b", None, None, True, None), ("s", None, None, None, None), ("s", None, None, None, "=A1")]
    (tmp_path / "m.jsonl").write_text('{"id":"a","path":"p","bytes":3}\n')
    assert manifests.manifest(spark, str(tmp_path / "m.jsonl")).first().bytes == 3
    (tmp_path / "i.idx").write_bytes("1|Né|10-K|2020|x.txt\n2|B|8-K|2020|y.txt\nhead\n".encode("latin-1"))
    assert [r.url.rpartition("/")[2] for r in manifests.filings(spark, str(tmp_path / "i.idx")).collect()] == ["x.txt"]
