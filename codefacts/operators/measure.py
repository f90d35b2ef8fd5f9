"""Measurements of units: joins with a fallback, sums by chunk, groups under a budget, and hashes over include trees."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.operators.tables import durable, numbered, scan, written

MISSING = -999


def measured(units: DataFrame, by_path: DataFrame, by_temporary: DataFrame) -> DataFrame:
    """units (path) with a value by path, else by the path of a temporary copy, else -999."""
    second = by_temporary.withColumnRenamed("value", "second")
    return units.join(by_path.withColumnRenamed("value", "first"), "path", "left").join(second, "path", "left").withColumn("value", F.coalesce("first", "second", F.lit(MISSING)))


def chunk_sums(values: DataFrame) -> DataFrame:
    return values.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


def budget_groups(paths: DataFrame, budget: int = 900 * 1024) -> DataFrame:
    """paths (task_id, ord, path) with the number of their group: in the order of ord, a new group where the budget of bytes is passed.

    Where the group that begins at a path ends depends on sums of sizes alone, so it is found for every path at once: the last path whose sum is
    within the budget, among the paths whose sums lie in the same stretch of `budget` bytes, or else the last of the stretch before.
    Which paths do begin a group is then a walk from each unit's first one, by links to the next group's start that double in length from round to
    round. No unit is one task's: sums are scans in blocks, windows go over a stretch, and a round joins two tables.
    """
    size = (F.octet_length("path") + 1).cast("long")
    placed = numbered(paths.select("task_id", "ord", "path"), [F.col("task_id"), F.col("ord"), F.col("path")], "_place")
    sums = durable(scan(placed.withColumn("_size", size), ["task_id"], "_place", upto=("sum", F.col("_size"))))
    limit = F.col("upto") - F.col("_size") + budget
    points = sums.select("task_id", "_place", F.floor(F.col("upto") / budget).alias("stretch"), F.col("upto").alias("at"), F.lit(0).alias("asks"))
    asked = sums.select("task_id", "_place", F.floor(limit / budget).alias("stretch"), limit.alias("at"), F.lit(1).alias("asks"))
    order = Window.partitionBy("task_id", "stretch").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    within = points.unionByName(asked).withColumn("last", F.max(F.when(F.col("asks") == 0, F.col("_place"))).over(order)).where("asks = 1")
    before = points.groupBy("task_id", (F.col("stretch") + 1).alias("stretch")).agg(F.max("_place").alias("earlier"))
    ends = points.groupBy("task_id").agg(F.min("_place").alias("first"), F.max("_place").alias("end"))
    after = F.greatest("_place", F.coalesce("last", "earlier", "_place")) + 1
    links = durable(within.join(before, ["task_id", "stretch"], "left").select("task_id", "_place", after.alias("next")))
    hops = links.join(ends, "task_id").where(F.col("next") <= F.col("end")).select("_place", "next")
    starts = durable(ends.select("task_id", F.col("first").alias("_place")))
    hops = durable(hops)
    while not (found := durable(starts.join(hops, "_place").select("task_id", F.col("next").alias("_place")))).isEmpty():
        starts = starts.unionByName(found)
        further = hops.select(F.col("_place").alias("next"), F.col("next").alias("further"))
        hops = durable(hops.join(further, "next").select("_place", F.col("further").alias("next")))
    number = (F.row_number().over(Window.partitionBy("task_id").orderBy("_place")) - 1).alias("grp")  # a row per group
    groups = starts.select("task_id", "_place", number).join(links.select("_place", "next"), "_place")
    members = groups.select("grp", F.explode(F.sequence("_place", F.col("next") - 1)).alias("_place"))
    return placed.join(members, "_place").select("task_id", "ord", "path", F.col("grp").cast("int").alias("grp"))


def _mixed(before: Column, value: Column) -> Column:
    return F.substring(F.md5(F.concat(before, F.lit("|"), value).cast("binary")), 1, 16)


def _passages(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, passages) of units. A passage is what stands between the entering and the leaving of a file, without the passages in it.

    items: pid, level, place, and what is mixed in (value, context, data); for a passage inside, child is its pid and value is null. passages,
    those that are left: pid, level, task_id, path, passage (their number in the order in which they are left).

    Depths are sums of +1 and -1 that don't fall below 0: sums less the lowest one so far, both scans in blocks. The passage of an event is
    the last one entered on its level, a scan again.
    """
    kind = F.col("kind")
    delta = F.when(kind == "enter", 1).when(kind == "exit", -1).otherwise(0)
    placed = numbered(events.select("task_id", "seq", "kind", "value"), [F.col("task_id"), F.col("seq")], "place").withColumn("delta", delta)
    summed = durable(scan(placed, ["task_id"], "place", total=("sum", F.col("delta"))))
    before = F.col("total") - F.col("delta")
    low = scan(summed, ["task_id"], "place", low=("min", before))
    depth = (before - F.least(F.lit(0), F.col("low"))).cast("int")
    level = depth + F.when(kind == "enter", 1).otherwise(0)
    own = low.withColumn("level", level).where("level > 0").select("task_id", "place", "kind", "value", "level")
    left = own.where("kind = 'exit' AND level > 1").select("task_id", "place", F.lit("child").alias("kind"), "value", (F.col("level") - 1).alias("level"))
    entered = F.when(F.col("kind") == "enter", F.col("place"))
    known = scan(durable(own.unionByName(left)), ["task_id", "level"], "place", pid=("max", entered))
    known = durable(scan(known, ["task_id"], "place", passage=("sum", F.when(F.col("kind") == "exit", 1).otherwise(0))))
    ends = known.where("kind = 'exit'").select("pid", "level", "task_id", (F.col("passage") - 1).cast("int").alias("passage"), F.col("place").alias("left_at"))
    names = known.where("kind = 'enter'").select("pid", F.col("value").alias("path"))
    passages = durable(ends.join(names, "pid"))
    inside = known.where("kind = 'child'").select("pid", "level", "place").join(passages.select(F.col("left_at").alias("place"), F.col("pid").alias("child"), F.col("path").alias("data")), "place")
    none = F.lit(None)
    value = F.when(F.col("kind") == "enter", F.col("value")).otherwise(F.concat("kind", F.lit(" "), F.coalesce("value", F.lit(""))))
    items = known.where("kind NOT IN ('child', 'exit')").select("pid", "level", "place", value.alias("value"), F.when(F.col("kind") == "enter", "self path").otherwise(F.col("kind")).alias("context"), none.cast("string").alias("data"), none.cast("bigint").alias("child"))
    items = items.unionByName(inside.select("pid", "level", "place", none.cast("string").alias("value"), F.lit("hash for #include").alias("context"), "data", "child"))
    return items.join(passages.select("pid"), "pid", "left_semi"), passages


def _folded(events: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, passages): for each level, its passages (pid) with their items in order (of, an array) and their hash; and all passages.

    From the deepest level up: a level's items meet the hashes of the passages inside, which the level below has left, and are folded a passage at
    a time. Each level reads its own items only, so all rounds together read every item once; there are as many as files are nested deep,
    which compilers limit. What one task gets together is one passage's items: those of one source file.
    """
    items, passages = _passages(events)
    items = written(items, "items", "level")
    levels = [r.level for r in passages.select("level").distinct().orderBy(F.desc("level")).collect()]  # a number a level
    done = []
    for level in levels:
        own = items.where(F.col("level") == level)
        if done:
            own = own.join(done[-1].select(F.col("pid").alias("child"), F.col("hash").alias("inner")), "child", "left").withColumn("value", F.coalesce("value", "inner"))
        of = F.sort_array(F.collect_list(F.struct("place", "value", "context", "data")))
        hashes = F.aggregate("of", F.lit("0"), lambda h, x: _mixed(h, x["value"]))
        done.append(durable(own.groupBy("pid").agg(of.alias("of")).withColumn("hash", hashes)))
    return done, passages


def _all_hashes(of: Column) -> Column:
    """The hash after each item of a passage. Runs of 512 are kept apart on the way, so that adding one copies no more than a run."""
    one = lambda x: F.get(x, 0)

    def step(state: Column, item: Column) -> Column:
        def grown(h: Column) -> Column:
            full = F.size(state["run"]) >= 512
            runs = F.when(full, F.concat(state["runs"], F.array(state["run"]))).otherwise(state["runs"])
            return F.struct(h.alias("h"), runs.alias("runs"), F.when(full, F.array(h)).otherwise(F.concat(state["run"], F.array(h))).alias("run"))

        return one(F.transform(F.array(_mixed(state["h"], item["value"])), grown))

    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("0").alias("h"), F.array().cast("array<array<string>>").alias("runs"), empty.alias("run"))
    return F.aggregate(of, start, step, lambda s: F.flatten(F.concat(s["runs"], F.array(s["run"]))))


def include_hashes(events: DataFrame) -> DataFrame:
    """Per unit, the hash of each file's passage: events (task_id, seq, kind, value) of enter, exit, and other kinds.

    The hash of a file starts from its path and takes in each event and, at its exit, goes into the hash of the file that
    includes it. Events that exit more than they enter are ignored, and so are passages that aren't left.
    """
    levels, passages = _folded(events)
    hashes = [done.select("pid", "hash") for done in levels] or [passages.select("pid", F.lit("").alias("hash"))]
    return passages.join(functools.reduce(DataFrame.unionByName, hashes), "pid").select("task_id", "path", "hash")


def hash_history(events: DataFrame) -> DataFrame:
    """How the hashes of include_hashes came about: a row for each value that a passage of a file has mixed in."""
    levels, passages = _folded(events)
    none = passages.select("pid").where("false").withColumn("of", F.array(F.struct(F.lit(0).alias("place"), *[F.lit("").alias(c) for c in ("value", "context", "data")])))
    every = functools.reduce(DataFrame.unionByName, [done.select("pid", "of") for done in levels] or [none]).withColumn("after", _all_hashes(F.col("of")))
    before = F.concat(F.array(F.lit("0")), F.slice("after", F.lit(1), F.size("after") - 1))
    each = every.select("pid", F.posexplode(F.arrays_zip("of", before.alias("before"), "after")).alias("ord", "x")).select("pid", "ord", "x.of.*", "x.before", "x.after")
    named = each.select("pid", "ord", "before", F.col("value").alias("mixed_value"), F.col("context").alias("mix_context"), F.col("data").alias("context_data"), "after")
    return passages.join(named, "pid").select("task_id", "passage", "path", "ord", "before", "mixed_value", "mix_context", "context_data", "after")


def history_text(history: DataFrame) -> DataFrame:
    """Per passage, its history as a YAML document."""
    line = lambda name, column: F.concat(F.lit(f"    {name}:".ljust(21)), column)
    step = F.concat_ws("\n", F.concat(F.lit("  - before-hash:".ljust(21)), "before"), line("mixed-value", F.col("mixed_value")), line("mix-context", F.col("mix_context")), line("context-data", F.col("context_data")), line("after-hash", F.col("after")))
    own = history.withColumn("step", step).groupBy("task_id", "passage", "path").agg(F.sort_array(F.collect_list(F.struct("ord", "step", "after"))).alias("steps"))
    head = F.concat(F.lit("---\npath:            "), "path", F.lit("\nhash:            "), F.element_at("steps", -1)["after"], F.lit("\nhistory:"))
    return own.select("task_id", "passage", "path", F.concat_ws("\n", head, F.array_join(F.transform("steps", lambda s: s["step"]), "\n"), F.lit("...")).alias("text"))
