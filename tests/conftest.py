import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from weirstone.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    """The tables as DuckDB sees them."""
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    """A value in a form in which Spark's and DuckDB's can be compared."""
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, (str, int, bool)) else str(v)


def agree(spark_df, duck, sql):
    """The Spark result has the columns and rows of the SQL."""
    names = sorted(spark_df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in spark_df.collect()), key=repr)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs
