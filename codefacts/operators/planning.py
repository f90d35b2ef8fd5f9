"""Which unit emits which file: well-behaved files, multiply indexed paths, first claims, claimed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.symbols import local_symbol


def behaviour(files: DataFrame) -> DataFrame:
    """Per unit and path, the number of hashes; one hash is well-behaved."""
    return files.groupBy("task_id", "path").agg(F.count_distinct("hash").alias("n_hash")).withColumn("well_behaved", F.col("n_hash") == 1)


def path_stats(files: DataFrame) -> DataFrame:
    """Per path over all units, the number of hashes; over one is multiply indexed."""
    return files.select("path", "hash").distinct().groupBy("path").agg(F.count("*").alias("n_hash")).withColumn("is_multi", F.col("n_hash") > 1)


def in_both_plans(single: DataFrame, multi: DataFrame) -> DataFrame:
    """Paths that one plan has as singly and another one as multiply indexed; a merge needs that there are none."""
    return single.where("NOT is_multi").select("path").intersect(multi.where("is_multi").select("path"))


def claims(files: DataFrame) -> DataFrame:
    """The unit that emits each (path, hash): the smallest that reports it, whatever arrives first. One partial minimum."""
    return files.groupBy("path", "hash").agg(F.min("task_id").alias("task_id"))


def claimed(facts: DataFrame, claim: DataFrame) -> DataFrame:
    """Facts of files that their own unit has claimed."""
    return facts.join(claim, ["task_id", "path", "hash"], "left_semi")


def all_files(well: DataFrame, ill: DataFrame) -> DataFrame:
    """All files of units in direct mode, in which everything is claimed."""
    return well.unionByName(ill)


def file_order(files: DataFrame) -> DataFrame:
    """Per unit, the order in which its files are told: those with one hash by hash and path, then those with several by path, with their hashes in order."""
    each = files.groupBy("task_id", "path").agg(F.sort_array(F.collect_set("hash")).alias("hashes")).withColumn("is_multi", F.size("hashes") > 1)
    order = Window.partitionBy("task_id", "is_multi").orderBy(F.when(~F.col("is_multi"), F.get("hashes", 0)), "path", "hashes")
    return each.withColumn("place", F.row_number().over(order))


def subset(commands: DataFrame, first: int | None = None, end: int | None = None, containing: str | None = None) -> DataFrame:
    """The commands (task_id, file) with ordinals from first up to end, of files whose name contains a text. Ordinals stay."""
    out = commands if first is None else commands.where(F.col("task_id") >= first)
    out = out if end is None else out.where(F.col("task_id") < end)
    return out if containing is None else out.where(F.contains("file", F.lit(containing)))


def any_hash(files: DataFrame) -> DataFrame:
    """One hash per path, the smallest."""
    return files.groupBy("path").agg(F.min("hash").alias("hash"))


def document_plan(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """documents (task_id, path) with whether their path is multiply indexed; paths that no plan knows count as such."""
    found = documents.join(stats.select("path", "n_hash"), "path", "left")
    return found.withColumn("is_multi", F.coalesce("n_hash", F.lit(2)) > 1).withColumn("unknown", F.col("n_hash").isNull()).drop("n_hash")


def suspects(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """Units that emitted a path which no plan knows."""
    return documents.join(stats, "path", "left_anti").select("task_id").distinct()


def local_counters(uses: DataFrame) -> DataFrame:
    """uses (path, decl, seq) with a counter per file: 0 for the declaration used first, and so on, the same for later uses."""
    first = uses.groupBy("path", "decl").agg(F.min("seq").alias("first_seq"))
    numbered = first.withColumn("counter", F.row_number().over(Window.partitionBy("path").orderBy("first_seq", "decl")) - 1)
    return uses.join(numbered.drop("first_seq"), ["path", "decl"])


def local_symbols(uses: DataFrame) -> DataFrame:
    """uses (path, decl, seq) with the symbols of locals, numbered by first use in each file."""
    return local_counters(uses).withColumn("symbol", local_symbol(F.col("counter")))


def chain_breaks(history: DataFrame) -> DataFrame:
    """Rows (path, ord, before, after) that don't go on from the row before them; the first must start from "0"."""
    last = F.lag("after").over(Window.partitionBy("path").orderBy("ord"))
    return history.withColumn("expected", F.coalesce(last, F.lit("0"))).where("before <> expected")


def balance(events: DataFrame) -> DataFrame:
    """Per unit of enter and exit events (task_id, seq, delta): the lowest and the last depth; 0 and 0 is balanced."""
    depth = F.sum("delta").over(Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("depth", depth).groupBy("task_id").agg(F.min("depth").alias("lowest"), F.max_by("depth", "seq").alias("last"))


def trace_violations(events: DataFrame) -> DataFrame:
    """What is wrong in traces (task_id, seq, kind of enter, exit or end, path; previous is the file that an event says it comes from).

    * disconnected: the file on top of the stack isn't the one that the event comes from;
    * unbalanced: an exit of no file, or a file that is still open at the end (the main file is);
    * after the end: an event that follows the end.

    The stack is a depth: an event at depth d comes from the last file that has been entered to depth d.
    """
    line = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    own = events.withColumn("ended", F.coalesce(F.max((F.col("kind") == "end").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    step = F.when(F.col("ended"), 0).when(F.col("kind") == "enter", 1).when(F.col("kind") == "exit", -1).otherwise(0)
    own = own.withColumn("step", step).withColumn("sum", F.sum("step").over(line))
    floor = F.least(F.lit(0), F.min("sum").over(line))  # exits of nothing leave the stack empty
    own = own.withColumn("depth", F.col("sum") - floor).withColumn("before", F.coalesce(F.lag("depth").over(Window.partitionBy("task_id").orderBy("seq")), F.lit(0)))
    tops = own.where("step = 1").select("task_id", F.col("depth").alias("before"), "seq", F.col("path").alias("top"), F.lit(True).alias("opens"))
    asked = own.where("NOT ended AND kind <> 'end' AND before > 0 AND previous IS NOT NULL").select("task_id", "before", "seq", F.lit(None).cast("string").alias("top"), F.lit(False).alias("opens"))
    last = F.last(F.when(F.col("opens"), F.col("top")), True).over(Window.partitionBy("task_id", "before").orderBy("seq", "opens").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.unionByName(asked).withColumn("top", F.when(~F.col("opens"), last)).where("NOT opens").select("task_id", "seq", "top")
    parted = own.join(tops, ["task_id", "seq"]).where("top <> previous").select("task_id", "seq", F.lit("disconnected").alias("violation"))
    late = own.where("ended AND kind <> 'other'").select("task_id", "seq", F.lit("after the end").alias("violation"))
    none = own.where("NOT ended AND before = 0 AND kind IN ('exit', 'end')").select("task_id", "seq", F.lit("unbalanced").alias("violation"))
    left = own.where("NOT ended AND kind = 'end' AND before > 1").select("task_id", "seq", F.explode(F.sequence(F.lit(1), F.col("before") - 1)).alias("n")).select("task_id", "seq", F.lit("unbalanced").alias("violation"))
    return parted.unionByName(late).unionByName(none).unionByName(left)


def chunk_of(index, total, chunks: int):
    """The chunk of an item: contiguous blocks of the quotient, then one of the rest to each chunk from the first on."""
    q = F.floor(total / chunks)
    return F.when(index < q * chunks, F.floor(index / q)).otherwise(index - q * chunks).cast("long")
