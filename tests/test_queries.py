"""Each query against its SQL in another engine."""
import pytest

from rowloom.plans import described, queries  # noqa: F401

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, agree, spark, sf):
    if name in queries.SQL:
        agree(queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, sf).columns


def test_names_that_differ_in_case_only(spark, sf, duck, tmp_path):
    """The result with N and n is written and read back in a session that ignored case before."""
    key, path = "spark.sql.caseSensitive", str(tmp_path / "out")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        queries.QUERIES["run_csv_weights"](spark, sf).write.parquet(path)
        back, want = spark.read.parquet(path), duck.sql(queries.SQL["run_csv_weights"])
        assert back.columns == want.columns == ["N", "n"]
        assert rows_of(back.columns, back.collect()) == rows_of(want.columns, want.fetchall())
        spark.conf.set(key, "false")
        described.told_apart(spark.range(1).selectExpr("1 AS a", "2 AS b"))
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.set(key, before)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1000
