"""Module libraries, and streams of notifications."""

import json

from pyspark.sql import functions as F

from arbora.sources import library as lib
from arbora.streaming import validate as st


def test_libraries(spark):
    new = {
        "ietf-yang-library:yang-library": {
            "module-set": [
                {"name": "one", "module": [{"name": "a", "revision": "2020-01-01", "namespace": "urn:a", "feature": ["g", "f"], "submodule": [{"name": "a-sub", "revision": "2020"}]}], "import-only-module": [{"name": "t", "revision": "", "namespace": "urn:t"}, {"name": "b", "revision": "2019", "namespace": "urn:b"}]},
                {"name": "two", "module": [{"name": "b", "revision": "2019", "namespace": "urn:b"}]},
                {"name": "unused", "module": [{"name": "z", "namespace": "urn:z"}]},
            ],
            "schema": [{"name": "s", "module-set": ["one", "two"]}, {"name": "r", "module-set": ["one"]}],
            "datastore": [{"name": "ietf-datastores:running", "schema": "s"}, {"name": "ietf-datastores:startup", "schema": "r"}],
        }
    }
    docs = spark.createDataFrame([(json.dumps(new),)], "raw string")
    modules = lib.convert_library(docs)
    got = {(r.name, r.revision): (r.conformance, sorted(r.features), [s.name for s in r.submodules]) for r in modules.collect()}
    assert got == {("a", "2020-01-01"): ("implement", ["f", "g"], ["a-sub"]), ("t", None): ("import", [], []), ("b", "2019"): ("implement", [], [])}
    startup = {r.name: r.conformance for r in lib.convert_library(docs, datastore="startup").collect()}
    assert startup == {"a": "implement", "t": "import", "b": "import"}
    old = lib.library_document(modules)
    state = json.loads(old.first().raw)["ietf-yang-library:modules-state"]
    assert [m["name"] for m in state["module"]] == ["a", "b", "t"] and len(state["module-set-id"]) == 40
    again = {(r.name, r.revision): (r.conformance, sorted(r.features), [s.name for s in r.submodules]) for r in lib.read_library(old).collect()}
    assert again == got
    assert lib.convert_library(spark.createDataFrame([("{}",)], "raw string")).count() == 0


def test_stream_counts(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00") for k in range(0, 60, 5)] + [(100, "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "n int, at string").select(F.col("at").cast("timestamp").alias("at"), (F.col("n") % 2).alias("odd"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = st.read_notifications(spark, f"{tmp_path}/in", df.schema)
    counted = st.counts(stream, "at", "30 minutes", "10 minutes", "odd")
    run = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    run.awaitTermination()
    got = {(str(r.start), r.odd): r.n for r in spark.table("counted").collect()}
    assert got == {("2024-01-01 00:00:00", 0): 3, ("2024-01-01 00:00:00", 1): 3, ("2024-01-01 00:30:00", 0): 3, ("2024-01-01 00:30:00", 1): 3, ("2024-01-01 03:00:00", 0): 1}
