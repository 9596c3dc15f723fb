"""Every registered query with SQL against DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tripflow.plans import queries as batch
from tripflow.streaming import queries as streams

ORACLE_SQL, QUERIES = {**batch.ORACLE_SQL, **streams.ORACLE_SQL}, {**batch.QUERIES, **streams.QUERIES}
SF = os.environ.get("TRIPFLOW_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame):
    def plain(x):
        if x is None or pd.isna(x) is True:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return round(float(x), 5) + 0.0 if math.isfinite(float(x)) else None
        return str(x)

    cols = sorted(frame.columns)
    return cols, sorted(repr([plain(x) for x in t]) for t in frame[cols].itertuples(index=False, name=None))


def test_training_matrix_matches_sql(spark, duck, tmp_path):
    """The widest result, compared in DuckDB."""
    got = QUERIES["training_matrix"](spark, SF)
    got.write.parquet(f"{tmp_path}/got")
    columns = ", ".join(f"round({c}, 5) + 0.0 AS {c}" if t == "double" else c for c, t in got.dtypes)
    pair = f"SELECT {columns} FROM read_parquet('{tmp_path}/got/*.parquet')", f"SELECT {columns} FROM want"
    duck.execute(f"CREATE TEMP TABLE want AS {ORACLE_SQL['training_matrix']}")
    assert {c for c in got.columns} == {r[0] for r in duck.execute("DESCRIBE want").fetchall()}
    assert got.count() == duck.execute("SELECT count(*) FROM want").fetchone()[0] > 0
    for a, b in (pair, pair[::-1]):
        assert duck.execute(f"SELECT count(*) FROM ({a} EXCEPT ALL {b})").fetchone()[0] == 0


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n != "training_matrix"])
def test_matches_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["zone_id", "window_end"] and df.count() > 0


def test_matrices_follow_the_contract(spark):
    from tripflow.schemas import FEATURES, FEATURES_WITHOUT_WEATHER

    assert len(FEATURES) == 80 and len(FEATURES_WITHOUT_WEATHER) == 55
    matrix = QUERIES["inference_matrix"](spark, SF)
    assert matrix.columns == ["window_end", *FEATURES]
    training = QUERIES["training_matrix"](spark, SF)
    assert set(training.columns) == {"window_end", "future_imbalance", "label_6class", *FEATURES}
    low, high = training.selectExpr("min(label_6class)", "max(label_6class)").first()
    assert low >= 0 and high <= 5
