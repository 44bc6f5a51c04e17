import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
from small import SMALL  # noqa: E402
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])



@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base}/shared"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.fixture
def same():
    def compare(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        columns = sorted(a.columns)

        def rows(df):
            df = df[columns].copy()
            for c in columns:
                if df[c].dtype.kind == "f":
                    df[c] = df[c].round(9) + 0.0
            plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v.is_integer() else v
            return sorted(tuple(str(plain(v)) for v in row) for row in df.astype(object).where(df.notna(), None).values.tolist())

        assert rows(a) == rows(b)

    return compare
