"""One session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
        "spark.local.dir": str(top / "local"), "spark.sql.warehouse.dir": str(top / "warehouse"), "spark.checkpoint.dir": f"file://{top}/shared",
    }
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def same_rows(spark, duck, data):
    """Asserts that a query's rows are those of its SQL."""

    def plain(v):
        return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    def check(query, sql):
        got = query(spark, data)
        names = sorted(got.columns)
        want = duck.execute(sql)
        have = [d[0] for d in want.description]
        assert names == sorted(have)
        rows = [tuple(plain(r[have.index(c)]) for c in names) for r in want.fetchall()]
        found = [tuple(plain(r[c]) for c in names) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(rows, key=repr)

    return check
