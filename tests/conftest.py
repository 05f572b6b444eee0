import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows as sorted texts, columns by name; numbers by their value."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            v = float(v)
            return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
        return f"{float(v):.9g}" if isinstance(v, int) and abs(v) < 2**50 else repr(v)

    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Whether a query gives the columns and rows of its SQL."""

    def check(f, sql):
        df = f(spark, sf)
        got = [tuple(r) for r in df.collect()]
        rel = duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        a, b = rows_of(df.columns, got), rows_of(rel.columns, rel.fetchall())
        assert len(a) == len(b)
        assert a == b

    return check
