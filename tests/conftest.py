import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("the driver's tables are not here")
    return DATA


@pytest.fixture(scope="session")
def same_rows(spark, data):
    """Compares a registered query with its SQL on the smallest tables."""
    import duckdb
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def plain(v):
        return repr(float(v)) if isinstance(v, float) else str(v)

    def check(name):
        df = entry.queries()[name](spark, data)
        columns = sorted(df.columns)
        got = sorted("|".join(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
        q = con.sql(entry.oracle_sql()[name])
        at = [q.columns.index(c) for c in columns]
        assert got == sorted("|".join(plain(r[i]) for i in at) for r in q.fetchall())

    return check
