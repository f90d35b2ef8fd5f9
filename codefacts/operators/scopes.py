"""Scopes of nodes from links to their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators.tables import durable


def scope_paths(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """nodes (node_id, parent_id, descriptor) with `scope`: the descriptors of all enclosing nodes and of the node, outermost first.

    A null descriptor (a context that has no name) makes the scope null, of the node and of everything inside it. A parent that isn't there ends
    the path like a null one. A node that is its own ancestor is an error.

    Pointer jumping: each node knows the text from some ancestor down to itself, and that ancestor's parent. A round joins what is still open with what
    all nodes know, which doubles the steps, so the rounds are the logarithm of the depth. Each round is written: the joins are of
    two plain tables, and AQE splits the children of one large scope.
    """
    known = nodes.select(F.col("parent_id").alias("up"), F.col("node_id").alias("id"), "descriptor").where("id IS NOT NULL")
    there = nodes.select(F.col("node_id").alias("up")).distinct()
    state = known.where("up IS NOT NULL").join(there, "up", "left_semi").select("id", "up", F.col("descriptor").alias("text"))
    roots = known.join(there, "up", "left_anti").select("id", F.lit(None).cast(dict(known.dtypes)["up"]).alias("up"), F.col("descriptor").alias("text"))
    state = durable(state.unionByName(roots))
    for _ in range(rounds):
        pending = state.where("up IS NOT NULL")
        if pending.isEmpty():
            out = state.select(F.col("id").alias("node_id"), F.col("text").alias("scope"))
            return nodes.join(out, "node_id", "left")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("text").alias("before"))
        moved = pending.join(above, "up").select("id", F.col("further").alias("up"), F.concat("before", "text").alias("text"))
        state = durable(state.where("up IS NULL").unionByName(moved))
    raise ValueError(f"some nodes are their own ancestors, or deeper than 2 ** {rounds}")
