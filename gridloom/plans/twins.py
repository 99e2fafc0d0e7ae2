"""Twins of queries over small fixed inputs: the rows that must come out, stated as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.registry import query

_SQL = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """``columns``: names and types as Spark writes them."""
    named = [x.split() for x in columns.split(", ")]
    casts = ", ".join(f'"{n}"::{_SQL[t]} AS "{n}"' for n, t in named)
    names = ", ".join(f'"{n}"' for n, _ in named)
    if not rows:
        return "SELECT " + ", ".join(f'NULL::{_SQL[t]} AS "{n}"' for n, t in named) + " WHERE false"
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {body}) x({names})"


def expects(name: str, columns: str, rows: list[tuple]):
    """Register a query of a SparkSession alone that must give exactly ``rows``. It returns a DataFrame, or a list of tuples
    where what it calls runs in the driver."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = fn(spark)
            if isinstance(got, DataFrame):
                return got.select(*[f"`{x.split()[0]}`" for x in columns.split(", ")])
            return spark.createDataFrame(got, columns)

        return query(name, rows_sql(columns, rows))(run)

    return keep
