"""Connected components of an edge table by contraction, as joins and aggregations with written tables in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import runtime


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    Nodes take a random order (their hashes).  Each round, every node goes to its smallest neighbour, or stays, and
    from there one step on; edges follow their ends, and those that are loops or repeated by then are gone.  So the
    edges shrink by powers, and a star is done in two rounds.  At the end the steps are followed from the last round
    to the first.  Self-loops, repeated edges and nulls change nothing.  Neighbours are never collected: minima are
    aggregated before the shuffle, and skewed joins are left to adaptive execution.
    """
    edges = runtime.materialize(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.xxhash64("node").alias("at"))
    now = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    steps = []
    while not now.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError("components did not settle")
        ends = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        up = runtime.materialize(ends.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to")).select("at", F.least("at", "to").alias("to")), "up")
        step = runtime.materialize(up.join(up.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")), "step")
        steps.append(step)
        for end in ("a", "b"):
            now = now.join(step.select(F.col("at").alias(end), F.col("to").alias(f"{end}_to")), end)
        now = now.filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        now = runtime.materialize(now, "edges")
    if not steps:
        return nodes.select("node", F.col("node").alias("component"))
    last = steps.pop()
    while steps:
        last = steps.pop().join(last.select(F.col("at").alias("to"), F.col("to").alias("next")), "to", "left").select("at", F.coalesce("next", "to").alias("to"))
    placed = runtime.materialize(nodes.join(last, "at").select("node", F.col("to").alias("top")), "placed")
    least = runtime.materialize(placed.groupBy("top").agg(F.min("node").alias("component")), "least")
    return placed.join(least, "top").select("node", "component")
