"""Every query of the catalogue against the same in DuckDB."""

import pytest

from lodestack.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, same, name):
    same(QUERIES[name](spark, small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(QUERIES) <= set(names)


def test_rendered_sizes_beyond_a_gibibyte(spark, tmp_path):
    """Keys of larger tables: the SQL has no unit above MiB."""
    import duckdb

    at = tmp_path / "part.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k * 9973 AS p_partkey, CAST(k % 60 AS INTEGER) AS p_size FROM range(1, 400) t(k) UNION ALL SELECT 1 << k, 50 FROM range(0, 40) t(k)) TO '{at}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{at}'")
    want = con.execute(SQL["rendered_sizes"]).fetchall()
    got = [(r.p_partkey, r.shown, r.duration) for r in QUERIES["rendered_sizes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(float(s.split()[0]) >= 1024 for _, s, _ in want if s.endswith("MiB")) > 5
