import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return repr(v)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Compare a query with its SQL over the smallest tables, columns by name and rows in any order."""
    def check(query, sql):
        df = query(spark, str(DATA))
        cols = sorted(df.columns)
        mine = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
        rel = duck.sql(sql)
        at = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert sorted(rel.columns) == cols
        key = lambda t: tuple(x or "" for x in t)
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
        assert sorted(mine, key=key) == theirs

    return check
