"""The driver's contract: names, plans without accidental cross joins, and agreement with DuckDB on a few queries."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import catalog


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) >= 190


def test_flagship(spark):
    assert entry.entry(spark).count() == 64 * 5


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["window_lineitem", "formula_range_aggregates", "formula_range_join", "diff_full_outer", "triage_top20", "override_apply_orders"])
def test_no_pair_join(spark, sf, name):
    _, physical = plan_of(catalog.QUERIES[name](spark, sf))
    assert "NestedLoop" not in physical and "Cartesian" not in physical


def test_scan_reads_what_it_needs(spark, sf):
    _, physical = plan_of(catalog.QUERIES["fmt_percent"](spark, sf))
    assert "l_tax" not in physical.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["window_lineitem", "override_apply_orders", "diff_full_outer", "per_extension", "csv_line_orders", "formula_levels", "manifest_summary", "triage_top20"])
def test_agrees_with_duckdb(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    rel = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(map(str, r)) for r in rel.fetchall()))
    got = sorted(tuple(map(str, r)) for r in catalog.QUERIES[name](spark, sf).select(*[f"`{n}`" for n in names]).collect())
    assert got == want


FIXED = ("formula_queries", "session_queries", "workbook_queries")


@pytest.mark.parametrize("module", FIXED)
def test_fixed_inputs_agree(spark, sf, module):
    """Every query over small fixed inputs gives the rows that its twin states."""
    import importlib

    con, wrong = duckdb.connect(), []
    own = vars(importlib.import_module(f"gridloom.plans.{module}"))
    names = [n for n, q in catalog.QUERIES.items() if getattr(q, "__module__", "") == "gridloom.plans.twins" and q.__closure__ and any(getattr(c.cell_contents, "__globals__", None) is own for c in q.__closure__ if callable(c.cell_contents))]
    shown = lambda v: f"{v:.12g}" if isinstance(v, float) else str(v)
    for name in names:
        rel = con.execute(catalog.ORACLES[name])
        columns = [f"`{d[0]}`" for d in rel.description]
        want = sorted(tuple(map(shown, r)) for r in rel.fetchall())
        got = sorted(tuple(map(shown, r)) for r in catalog.QUERIES[name](spark, sf).select(*columns).collect())
        if got != want:
            wrong.append(name)
    assert not wrong and len(names) > 30
