"""Tables that are folders of part files, as writers of large tables leave them."""

from __future__ import annotations

import os

import duckdb
import pytest

from glyphmill import catalogue


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The smallest tables, documents and events in three part files each."""
    out = tmp_path_factory.mktemp("folders")
    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{out}/{name}.parquet")
    for name in os.listdir(sf):
        if not (out / name).exists():
            (out / name).symlink_to(f"{sf}/{name}")
    return str(out)


@pytest.mark.parametrize("name", ["stream_misspellings", "stream_event_windows"])
def test_streams_read_folders(spark, sf, folders, name):
    c = duckdb.connect()
    for t in ("documents", "events"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, folders).toPandas(), c.sql(catalogue.ORACLE_SQL[name]).df()
    columns = list(want.columns)
    text = lambda df: sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in row) for row in df[columns].itertuples(index=False))
    assert text(got) == text(want)
