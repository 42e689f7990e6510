"""Every registered query over the events table, against its SQL."""

from pathlib import Path

import pytest

from tallyloom import queries
from tallyloom.errors import BadRequest
from tallyloom.operators import terminals as T

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


def plain(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(df.select(*cols).collect()) == plain(want)


def test_nothing_is_left_out(spark):
    assert sorted(queries.QUERIES) == sorted(queries.ORACLES)
    assert queries.QUERIES["s4_scan"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_GROUPS", 2)
    with pytest.raises(BadRequest):
        queries.QUERIES["a5_variance_text"](spark, SF)
