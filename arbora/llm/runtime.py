"""Session helpers: shared scratch tables and shipping the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def scratch_root(spark: SparkSession) -> str:
    """The folder every node sees: ``spark.checkpoint.dir``; a temporary one where it is unset and there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: What this process has written: paths and catalogue tables.
_written: list[str] = []
_tables: list[str] = []
_folder: ContextVar[str | None] = ContextVar("arbora_folder", default=None)


def scratch_path(spark: SparkSession, tag: str) -> str:
    folder = _folder.get()
    path = f"{folder or scratch_root(spark)}/arbora-{tag}-{uuid.uuid4().hex[:12]}"
    if not folder:
        _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that was written so far; results that were not yet collected or written are lost with it."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def drop(spark: SparkSession, table: DataFrame) -> None:
    """Remove the files of a table that is needed no more."""
    for path in {os.path.dirname(f) for f in table.inputFiles()}:
        _delete(spark, path)


@contextmanager
def own_folder(spark: SparkSession, tag: str) -> Iterator[None]:
    """Tables that this thread materialises within go to a folder of their own, which is removed in the end.

    Runs in other threads or sessions have other folders.  What is to stay is written to a path made before.
    """
    path = scratch_path(spark, tag)
    before = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(before)
        _delete(spark, path)
        if path in _written:
            _written.remove(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (with ``__`` for dots) for what is run within."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is run within are removed as soon as each run ends: a written table needs them no more."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def small_batches(spark: SparkSession):
    """Tasks get their rows in Arrow batches of about 8 MB instead of 64."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000", spark__sql__execution__arrow__maxBytesPerBatch="8m")


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = path or scratch_path(df.sparkSession, tag)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers unless their path already has it."""
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(_ROOT) in on_path or os.path.realpath(os.getcwd()) == str(_ROOT):
        return
    sc = spark.sparkContext
    if getattr(sc, "_arbora_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="arbora-ship-")) / "arbora.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (_ROOT / "arbora").rglob("*.py"):
            z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(str(target))
    sc._arbora_shipped = True
