"""Checks of streams that need state: references that wait for their target, and entries counted for their parent.

Both keep state by key with ``transformWithState`` and a timer in event time, so a violation is told once the watermark has
passed the time by which the target, or the last entry, was due.  Rows later than the watermark are left out, as in every
stateful query.  State is dropped when it has been answered.  ``use_state`` sets the store that these operators need.

A value that a third of all rows share is dealt to ``salts`` groups: sources go to one of them, targets to all.  Entries are
counted in the tasks that read them before they are sent to their parent's group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LOST = "path string, value string, error_tag string"
SIZED = "parent string, n long, error_tag string"


def use_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, which timers and lists of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _milliseconds(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


class _Waiting(StatefulProcessor):
    """Sources of one value wait until their time is over or the target comes; after that the value is known to be there."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "there boolean")
        self.waiting = handle.getListState("waiting", "path string, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = [f for f in rows if len(f)]
        seen = self.seen.exists()
        if not seen and any(f["target"].any() for f in frames):
            seen = True
            self.seen.update((True,))
            self.waiting.clear()
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
        if not seen:
            for f in frames:
                due = (_milliseconds(f["at"]) + self.wait).tolist()
                self.waiting.appendList(list(zip(f["path"].tolist(), due, strict=True)))
                for d in set(due):
                    self.handle.registerTimer(d)
        yield pd.DataFrame({"path": [], "value": [], "error_tag": []}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        every = list(self.waiting.get())
        lost = [p for p, due in every if due <= now]
        left = [(p, due) for p, due in every if due > now]
        self.waiting.clear()
        if left:
            self.waiting.appendList(left)
        yield pd.DataFrame({"path": lost, "value": [key[0]] * len(lost), "error_tag": ["instance-required"] * len(lost)}, dtype=object)

    def close(self) -> None:
        pass


def watch_references(sources: DataFrame, targets: DataFrame, delay: str = "10 minutes", wait_seconds: int = 600, salts: int = 8) -> DataFrame:
    """(path, value, error_tag) of sources whose value no target had when the watermark passed their time and ``wait_seconds``.

    ``sources`` has path, value and at; ``targets`` has value and at.  A NULL refers to nothing.
    """
    own = sources.select("path", F.col("value").cast("string").alias("value"), "at", F.lit(False).alias("target"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
    given = targets.select(F.lit(None).cast("string").alias("path"), F.col("value").cast("string").alias("value"), "at", F.lit(True).alias("target"))
    given = given.select("*", F.explode(F.array(*[F.lit(s) for s in range(salts)])).alias("salt"))
    both = own.unionByName(given).filter("value IS NOT NULL").withWatermark("at", delay)
    return both.groupBy("value", "salt").transformWithStateInPandas(_Waiting(1000 * wait_seconds), LOST, "Append", "EventTime")


class _Sizes(StatefulProcessor):
    """Entries of one parent are counted until its time is over."""

    def __init__(self, wait: int, least: int, most: int | None):
        self.wait, self.least, self.most = wait, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, due = self.count.get() if self.count.exists() else (0, -1)
        for f in rows:
            n += int(f["n"].sum())
            if due < 0 and len(f):
                due = int(_milliseconds(f["at"]).min()) + self.wait
                self.handle.registerTimer(due)
        self.count.update((n, due))
        yield pd.DataFrame({"parent": [], "n": [], "error_tag": []}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, _ = self.count.get() if self.count.exists() else (0, 0)
        self.count.clear()
        tag = "too-few-elements" if n < self.least else "too-many-elements" if self.most is not None and n > self.most else None
        found = [(key[0], n, tag)] if tag else []
        yield pd.DataFrame(found, columns=["parent", "n", "error_tag"], dtype=object)

    def close(self) -> None:
        pass


def watch_sizes(parents: DataFrame, entries: DataFrame, least: int = 0, most: int | None = None, delay: str = "10 minutes", wait_seconds: int = 600) -> DataFrame:
    """(parent, n, error_tag) of parents with too few or too many entries when the watermark passed their first row's time and ``wait_seconds``.

    ``parents`` has parent and at, ``entries`` the same for each entry.  Entries without a parent row count as well.
    """
    rows = parents.select(F.col("parent").cast("string").alias("parent"), "at", F.lit(0).cast("long").alias("n"))
    rows = rows.unionByName(entries.select(F.col("parent").cast("string").alias("parent"), "at", F.lit(1).cast("long").alias("n")))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby("parent", as_index=False).agg(at=("at", "min"), n=("n", "sum"))[["parent", "at", "n"]]

    partial = rows.filter("parent IS NOT NULL").mapInPandas(counted, "parent string, at timestamp, n long").withWatermark("at", delay)
    return partial.groupBy("parent").transformWithStateInPandas(_Sizes(1000 * wait_seconds, least, most), SIZED, "Append", "EventTime")


class _Keys(StatefulProcessor):
    """A key that comes a second time within its time is told once."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.count.get()[0] if self.count.exists() else 0
        n, first = before, None
        for f in rows:
            n += int(f["n"].sum())
            first = int(_milliseconds(f["at"]).min()) if len(f) and first is None else first
        if not before and first is not None:
            self.handle.registerTimer(first + self.wait)
        self.count.update((n,))
        found = [(key[0],)] if before < 2 <= n else []
        yield pd.DataFrame({"key": [k for k, in found], "error_tag": ["non-unique-key"] * len(found)}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.count.clear()
        yield pd.DataFrame({"key": [], "error_tag": []}, dtype=object)

    def close(self) -> None:
        pass


def watch_keys(entries: DataFrame, key: Column, delay: str = "10 minutes", wait_seconds: int = 600) -> DataFrame:
    """(key, error_tag) of keys that come twice or more within ``wait_seconds`` of their first row; ``entries`` has at."""
    rows = entries.select(key.cast("string").alias("key"), "at", F.lit(1).cast("long").alias("n")).filter("key IS NOT NULL")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby("key", as_index=False).agg(at=("at", "min"), n=("n", "sum"))[["key", "at", "n"]]

    partial = rows.mapInPandas(counted, "key string, at timestamp, n long").withWatermark("at", delay)
    return partial.groupBy("key").transformWithStateInPandas(_Keys(1000 * wait_seconds), "key string, error_tag string", "Append", "EventTime")
