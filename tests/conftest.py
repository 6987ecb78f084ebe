import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cells(df):
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
            return "NULL"
        v = v.tolist() if hasattr(v, "tolist") else v
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    """Checks a Spark result against DuckDB's."""

    def check(spark_df, con, sql):
        a, b = spark_df.toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        x, y = cells(a), cells(b)
        assert len(x) == len(y)
        assert x == y

    return check
