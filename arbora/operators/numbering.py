"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all nodes see; where it is unset, a temporary folder serves a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def with_places(df: DataFrame, order: list[str | Column], into: str = "place", start: int = 0, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with the place of each row in an order, from ``start`` on.

    Rows are dealt to ranges of the order and sorted there; a place is the size of the ranges before plus the place in
    one's own.  The sorted rows are written as a table in the shared folder, as ranges are cut at a sample and may differ when
    they are made again; what reads the places later reads only its columns and rows.
    Rows that are equal in the order get places next to each other; an empty table stays empty.
    With ``then``, a step that keeps the order of rows (as ``explode`` does), the places are those of the rows it makes.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt if then is None else then(dealt)
    # ids that increase by one within a partition, whose number is in the bits above
    dealt = dealt.select("*", F.monotonically_increasing_id().alias("_id"))
    path = f"{_shared_folder(spark)}/arbora-places-{uuid.uuid4().hex[:12]}"
    dealt.write.option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    own = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(own.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before = [start]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), own.cast("int"))
    return dealt.withColumn(into, offset + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
