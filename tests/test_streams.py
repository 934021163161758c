"""Streams with state: references that wait, entries counted with timers; late rows, a restart, and equality with the table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arbora.streaming import state

START = datetime(2024, 1, 1)
minute = lambda n: START + timedelta(minutes=n)


@pytest.fixture
def folders(tmp_path):
    for name in ("in", "out", "checkpoint"):
        (tmp_path / name).mkdir()
    return tmp_path


def run(spark, folders, lots, make):
    """Feeds lots of rows one by one, with the query stopped and started again between them."""
    state.use_state(spark)
    schema = "kind string, path string, value string, at timestamp"
    for k, rows in enumerate(lots):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folders / "in"))
        stream = spark.readStream.schema(schema).parquet(str(folders / "in"))
        query = make(stream).writeStream.format("parquet").option("path", str(folders / "out")).option("checkpointLocation", str(folders / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive, k
    return spark.read.parquet(str(folders / "out"))


def test_references_wait_for_their_targets(spark, folders):
    lots = [
        [("s", "/a", "1", minute(0)), ("s", "/b", "2", minute(1)), ("s", "/null", None, minute(1)), ("t", None, "9", minute(0)), ("s", "/n", "9", minute(2))],
        [("t", None, "1", minute(8)), ("s", "/c", "1", minute(9)), ("s", "/d", "3", minute(9))],  # 1 comes in time
        [("x", None, None, minute(40))],  # moves the watermark on: 2 and 3 are lost
        [("t", None, "2", minute(41)), ("s", "/late", "4", minute(3)), ("s", "/e", "2", minute(42))],
        [("x", None, None, minute(90))],
        [("x", None, None, minute(91))],
    ]

    def make(stream):
        tick = stream.filter("kind = 'x'").select(F.lit(None).cast("string").alias("path"), F.lit("tick").alias("value"), "at")
        return state.watch_references(stream.filter("kind = 's'").select("path", "value", "at"), stream.filter("kind = 't'").select("value", "at").unionByName(tick.select("value", "at")), "5 minutes", 600, 2)

    got = sorted((r.path, r.value, r.error_tag) for r in run(spark, folders, lots, make).collect())
    # what came later than the watermark is in no table either
    targets = {v for k, _, v, _ in sum(lots, []) if k == "t"} - {"2"}
    table = sorted((p, v, "instance-required") for k, p, v, _ in sum(lots, []) if k == "s" and v and v not in targets and p not in ("/late", "/e"))
    assert got == table == [("/b", "2", "instance-required"), ("/d", "3", "instance-required")]


def test_sizes_and_keys(spark, folders):
    lots = [
        [("p", None, "one", minute(0)), ("e", "k1", "one", minute(1)), ("p", None, "none", minute(1)), *[("e", f"m{i}", "many", minute(1)) for i in range(5)]],
        [("e", "k2", "one", minute(4)), ("e", "k1", "one", minute(5))],
        [("x", None, "tick", minute(60)), ("e", "k2", "two", minute(61))],
        [("x", None, "tick", minute(120))],
        [("x", None, "tick", minute(121))],
    ]

    def sizes(stream):
        return state.watch_sizes(stream.filter("kind <> 'e'").select(F.col("value").alias("parent"), "at"), stream.filter("kind = 'e'").select(F.col("value").alias("parent"), "at"), 1, 3, "5 minutes", 600)

    got = {(r.parent, r.n, r.error_tag) for r in run(spark, folders, lots, sizes).filter("parent <> 'tick'").collect()}
    assert got == {("none", 0, "too-few-elements"), ("many", 5, "too-many-elements")}


def test_repeated_keys(spark, folders):
    lots = [
        [("e", "k1", None, minute(0)), ("e", "k2", None, minute(1)), ("e", "k2", None, minute(1))],
        [("e", "k1", None, minute(5)), ("e", "k2", None, minute(6)), ("e", "k3", None, minute(6))],
        [("e", "tick", None, minute(60))],
        [("e", "k3", None, minute(61)), ("e", "k1", None, minute(62))],
    ]
    got = run(spark, folders, lots, lambda s: state.watch_keys(s, F.col("path"), "5 minutes", 600)).collect()
    assert sorted((r.key, r.error_tag) for r in got) == [("k1", "non-unique-key"), ("k2", "non-unique-key")]
