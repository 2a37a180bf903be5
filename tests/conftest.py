import collections
import datetime
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(home / "warehouse")).config("spark.checkpoint.dir", str(home / "checkpoints")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and a DuckDB query have the same columns and rows."""

    def check(df, sql):
        columns = sorted(df.columns)
        ours = collections.Counter(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        theirs = collections.Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
        assert not ours - theirs and not theirs - ours, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])

    return check
