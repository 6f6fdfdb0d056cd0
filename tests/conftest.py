import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    import __spark_entry__

    __spark_entry__.ship(s)
    yield s
    s.stop()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same_rows(df, con, sql):
    """Rows of df and of sql, columns by name, floats to six places."""
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    names = sorted(df.columns)
    mine = sorted((tuple(tidy(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    theirs = sorted((tuple(tidy(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert mine == theirs
    return len(mine)
