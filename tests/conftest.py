import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lexmill.session import local_session

    session = local_session(4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def sql(data):
    """Runs SQL over the test tables in DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in sorted(os.listdir(data)):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    return lambda text: con.execute(text).df()


@pytest.fixture(scope="session")
def agree(spark, data, sql):
    """Asserts that a registered query and its SQL give the same rows."""
    import pandas as pd

    def rows(frame):
        def show(v):
            if v is None or v is pd.NA or v != v:
                return ""
            return f"{v:.6f}" if isinstance(v, float) else str(v)

        return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))

    def check(make, text):
        mine, other = make(spark, data).toPandas(), sql(text)
        assert sorted(mine.columns) == sorted(other.columns)
        assert rows(mine) == rows(other)

    return check
