"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target over its size is a number of copies per document. Its whole part is allocated to every document for
certain. For the fraction, each document gets an inclusion probability in proportion to its size, and a Pareto rank: the
odds of a fixed uniform number (from a digest of doc_id) divided by its inclusion odds. Documents are taken in the order
of their ranks until the words taken are as near the budget as whole documents allow; probabilities of one or more rank
first. The size that is fixed is thus the number of words.

No source is ranked as a whole: a histogram over 4096 intervals of the rank finds the interval in which the budget ends,
and only the rows of that interval are put in order. What remains is a limit per source, which is joined to the rows.

Defined results. A null text or one without words has size 0 and is never taken. A null source is a source of its own
(the last). Rows with equal doc_id share their number; rows of equal rank are taken together or not at all. Added columns
replace input columns of the same names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import SMALL_ROWS, cut, spare, without, word_count

INTERVALS = 4096
ADDED = ("size", "source_size", "target", "copies", "taken")


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on doc_id alone: 52 bits of its MD5 digest."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def pareto_rank(size: Column, scale: Column, doc_id: Column) -> Column:
    """Random odds over inclusion odds; the inclusion probability is scale * size, and 0 stands first at 1 or more."""
    chance, u = scale * size, uniform(doc_id)
    return F.when(chance >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (chance / (1 - chance)))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source of sizes (source, size): source_size, target, whole copies, budget and scale.

    Sources that would pass their cap form a prefix in the order of size over weight, so a running sum decides in one pass
    what repeated resharing would. There is one row per source here, and nothing else goes through the unkeyed window: one
    task puts the sources in order, so their number is meant to be that of sites or collections, not of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(at, F.lit(len(weights)))))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("all", F.sum("source_size").over(whole) * share).withColumn("most", cap * F.col("source_size"))
    per = per.withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("full", F.col("most") * F.col("rest") <= F.col("w") * (F.col("all") - F.col("used")))
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0.0))
    share_of = F.col("w") * left / F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    per = per.select("source", "source_size", "squares", F.when(F.col("full"), F.col("most")).otherwise(share_of).alias("target"))
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    return per.select("source", "source_size", "target", "whole", "budget", F.when(F.col("squares") > 0, F.col("budget") / F.col("squares")).otherwise(0.0).alias("scale"))


def limits(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Per source, the largest Pareto rank that is still taken (null: none)."""
    ranked = _by_source(sizes.where("size > 0"), per).where("budget > 0").select("source", "size", "budget", pareto_rank(F.col("size"), F.col("scale"), F.col("doc_id")).alias("q"))
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * INTERVALS))
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = ranked.groupBy("source", "budget", "bin").agg(F.sum("size").alias("words"), F.max("q").alias("top"))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    inside = bins.where(F.col("before") + F.col("words") <= F.col("budget")).groupBy("source").agg(F.max("top").alias("q"))
    ends = bins.where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
    last = _by_source(ranked.drop("budget"), ends.select("source", F.col("bin").alias("end_bin"), "before", "budget")).where("bin = end_bin")
    last = last.groupBy("source", "before", "budget", "q").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = last.withColumn("upto", upto).where(F.col("upto") + F.col("words") / 2 <= F.col("budget")).groupBy("source").agg(F.max("q").alias("q"))
    return inside.unionByName(fine).groupBy("source").agg(F.max("q").alias("limit"))


def _by_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of its source, which may be null. A table of few sources is broadcast, a larger one joined by AQE."""
    name = spare(rows, "source_key")
    key = per.withColumnRenamed("source", name)
    key = F.broadcast(key) if per.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else key
    return rows.join(key, rows["source"].eqNullSafe(F.col(name))).drop(name)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies times size).

    Sources in the order of code points weigh `weights`, repeating; all targets together are `share` of all sizes, and none
    is above `cap` (at most 2) times its source's size.
    """
    docs = without(docs, *ADDED)
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per = cut(targets(sizes, weights, share, cap), "targets")
    ends = limits(sizes, per).withColumnRenamed("source", "__of")
    per = cut(per.join(ends, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of"), "limits")
    size, of = spare(docs, "words"), spare(docs, "of_source")
    per = per.select("source", F.struct(*[c for c in per.columns if c != "source"]).alias(of))
    mixed = _by_source(docs.withColumn(size, word_count(F.col("text"))), per)
    own = lambda name: F.col(f"{of}.{name}")
    rank = pareto_rank(F.col(size), own("scale"), F.col("doc_id"))
    chosen = (F.col(size) > 0) & (own("scale") > 0) & F.coalesce(rank <= own("limit"), F.lit(False))
    copies = F.when(F.col(size) > 0, own("whole") + chosen.cast("long")).otherwise(0).cast("long")
    added = (F.col(size).alias("size"), own("source_size").alias("source_size"), own("target").alias("target"), copies.alias("copies"), (copies * F.col(size)).alias("taken"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix: each row as often as its copies say, without the added columns."""
    copy = spare(mixed, "copy_number")
    return without(mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), copy, *ADDED)
