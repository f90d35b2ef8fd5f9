"""Transitive bases, with cycles allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators.tables import durable
from codefacts.schema import MAX_GRAPH_STEPS

def closure(edges: DataFrame, steps: int = MAX_GRAPH_STEPS, defined: DataFrame | None = None) -> DataFrame:
    """All (derived, base) that edges (derived, base) reach; a node is never its own base.

    With defined (derived), bases without a definition are reached but not gone on from. A round joins the pairs that the last round
    found with all pairs so far, so that the length of the paths doubles and the rounds are the logarithm of the depth; it takes away the pairs
    already seen, so cycles end, and writes the new ones alone.
    """
    seen = fresh = durable(edges.select("derived", "base").where("derived <> base").distinct())
    goes_on = None if defined is None else durable(defined.select("derived").distinct())
    for _ in range(steps):
        further = seen if goes_on is None else seen.join(goes_on, "derived", "left_semi")
        hops = further.select(F.col("derived").alias("base"), F.col("base").alias("next"))
        found = fresh.join(hops, "base").select("derived", F.col("next").alias("base")).where("derived <> base").distinct()
        fresh = durable(found.join(seen, ["derived", "base"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError(f"no fixed point after {steps} rounds")
