"""Engines called from SQL."""

import pytest

from mediasift.operators import table_functions
from mediasift.operators.table_functions import register_engines

PEAK = "mediasift.operators.table_functions:PeakScore"


class Counting:
    """Notes how often it was made."""

    name, made = "Counting", 0

    def __init__(self):
        Counting.made += 1

    def available(self):
        return True, ""

    def begin(self):
        self.n = 0

    def add(self, row):
        self.n += 1

    def result(self):
        return {"n": self.n, "made": Counting.made}, {}


class Missing(Counting):
    name = "Missing"

    def available(self):
        return False, "not installed"


class Broken(Counting):
    def __init__(self):
        raise ImportError("no model")


@pytest.fixture
def frames(spark):
    register_engines(spark)
    rows = [("a", 0, "x", 0.5, 1), ("a", 1, "y", 0.75, 2), ("a", 2, "z", 0.75, 3), ("b", 0, None, 0.1, 4), ("c", 0, "x", 0.25, 5), (None, 0, "q", 1.0, 6)]
    spark.createDataFrame(rows * 1 + [(f"m{i}", j, "k", j / 8, i) for i in range(40) for j in range(3)], "media_id string, idx int, label string, confidence double, size int").repartition(4).createOrReplaceTempView("frames_of_items")
    return "TABLE(frames_of_items) PARTITION BY media_id ORDER BY idx"


def test_results_and_failures_are_rows(spark, frames):
    got = {r["media_id"]: r for r in spark.sql(f"SELECT * FROM engine_results({frames}, engine => '{PEAK}', keep => 'size, idx')").collect()}
    assert (got["a"]["status"], got["a"]["scores"], got["a"]["details"], got["a"]["size"], got["a"]["idx"]) == ("ok", {"peak": 0.75, "rows": 3.0}, {"label": "y"}, 3, 2)
    assert (got["b"]["status"], got["b"]["error"], got["b"]["scores"]) == ("error", "ValueError: row 0 has no score", {})
    assert got["c"]["status"] == got[None]["status"] == "ok" and len(got) == 44 and all(r["took_ms"] >= 0 and r["engine"] == "Peak score" for r in got.values())


def test_one_engine_a_worker(spark, frames):
    here = "tests.test_table_functions"
    rows = spark.sql(f"SELECT * FROM engine_results({frames}, engine => '{here}:Counting')").collect()
    assert all(r["scores"]["made"] == 1 for r in rows) and sum(r["scores"]["n"] for r in rows) == 126
    assert {(r["status"], r["error"]) for r in spark.sql(f"SELECT * FROM engine_results({frames}, engine => '{here}:Missing')").collect()} == {("skipped", "not installed")}
    assert {(r["status"], r["error"]) for r in spark.sql(f"SELECT * FROM engine_results({frames}, engine => '{here}:Broken')").collect()} == {("error", "ImportError: no model")}


def test_types_follow_the_table(spark, frames):
    spark.range(3).selectExpr("id AS media_id", "'l' AS label", "0.5D AS confidence", "array(id) AS more").createOrReplaceTempView("numbered")
    got = spark.sql(f"SELECT * FROM engine_results(TABLE(numbered) PARTITION BY media_id, engine => '{PEAK}', keep => 'more')")
    assert got.dtypes[:2] == [("media_id", "bigint"), ("more", "array<bigint>")] and got.count() == 3
    for call in (f"TABLE(SELECT 1 AS x), engine => '{PEAK}'", f"{frames}, engine => 'nothing'"):
        with pytest.raises(Exception, match="media_id|module:Class"):
            spark.sql(f"SELECT * FROM engine_results({call})").collect()
    assert table_functions.FUNCTION == "engine_results"
