"""Registered queries run on the smallest tables, and agree with their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from glyphmill import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _sorted(frame, columns):
    def text(v):
        return "null" if v is None or v is getattr(__import__("pandas"), "NA", None) or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        numbers = [c for c in columns if str(got[c].dtype) != str(want[c].dtype)]
        for c in numbers:
            if want[c].dtype.kind in "iufI" or str(want[c].dtype).startswith("Int"):
                got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
        assert _sorted(got, columns) == _sorted(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
