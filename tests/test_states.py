"""Saved states: round trips, hashes, retention, export and import."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkloom.sinks.states import SavedStates, rows_hash


@pytest.fixture
def states(spark, tmp_path):
    return SavedStates(spark, str(tmp_path / "states"), keep=2)


def test_round_trip_and_retention(spark, states):
    assert states.load("run") is None and not states.exists("run") and states.info("run") is None and states.clear("run") is False
    assert states.statistics().first()["total"] == 0
    for n in (3, 5, 7):
        states.save("run", spark.range(n).withColumn("tags", F.array(F.lit("a"), F.lit(None))), f"after {n}")
    states.save("other/one", spark.range(0), "")
    assert states.load("run").count() == 7 and states.load("other/one").count() == 0
    assert states.info("run")["description"] == "after 7" and states.info("run")["row_count"] == 7
    assert [r["description"] for r in states.listed().where("name = 'run'").collect()] == ["after 7", "after 5"]
    one = states.statistics().first()
    assert (one["total"], one["by_format"], one["by_compression"]) == (3, {"parquet": 3}, {"zstd": 3}) and one["total_size_bytes"] > 0
    assert states.clear("run") and not states.exists("run") and states.exists("other/one")
    assert states.expire(30) == 0 and states.expire(30, F.current_timestamp() + F.expr("INTERVAL 31 DAYS")) == 1
    assert states.clear_all() == 0
    with pytest.raises(ValueError):
        states.save("", spark.range(1))


def test_changed_rows_are_noticed(spark, states):
    version = states.save("run", spark.range(4))
    spark.range(5).write.mode("overwrite").parquet(states._data("run", version))
    with pytest.raises(ValueError, match="aren't those"):
        states.load("run")


def test_export_and_import(spark, states, tmp_path):
    states.save("run", spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string"), "three")
    assert not states.export("none", str(tmp_path / "out")) and states.export("run", str(tmp_path / "out"))
    assert states.import_from(str(tmp_path / "nothing")) is None
    assert states.import_from(str(tmp_path / "out"), "copy") == "copy" and states.load("copy").count() == 3
    states.clear("run")
    assert states.import_from(str(tmp_path / "out")) == "run" and states.info("run")["description"] == "three"
    spark.range(2).write.mode("overwrite").parquet(str(tmp_path / "out" / "data"))
    with pytest.raises(ValueError, match="doesn't match"):
        states.import_from(str(tmp_path / "out"), "bad")
    assert not states.exists("bad")
    spark.range(2).write.parquet(str(tmp_path / "plain" / "data"))
    assert states.import_from(str(tmp_path / "plain")).startswith("imported_")


def test_hash_is_of_rows_not_of_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    assert rows_hash(a) == rows_hash(a.orderBy(F.desc("a")).repartition(3))
    assert rows_hash(a) != rows_hash(a.distinct()) and rows_hash(a.limit(0)) != rows_hash(a.select("a").limit(0))
