"""The objects of JSON arrays in files of any size, read in blocks.

A file is read as fragments that end at a closing brace, which Spark's text reader finds in any block of a file. Whether a brace stands in a string, and
how deep it is nested, depends on all that comes before. But what a fragment does to both is known from itself: it turns the state "in a string"
around if it has an odd number of quotes, and it changes the depth by its brackets outside of strings. So the state where a fragment begins is
the parity of a sum over the fragments before it, its depth another sum, and the number of its object a third: scans in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.operators.tables import durable, numbered, scan

#: Lists this many files in an error.
SHOWN = 10


def _depth(text: Column) -> Column:
    """Opening less closing brackets."""
    opened, closed = F.translate(text, "[{", ""), F.translate(text, "]}", "")
    return F.char_length(closed) - F.char_length(opened)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file_path, place (in the order of files and of bytes), value: the text up to, and without, each closing brace and at the end."""
    rows = spark.read.option("lineSep", "}").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return numbered(rows, [F.col("file_path"), F.col("block"), F.col("at")], "place").select("file_path", "place", "value")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """file_path, ord (from 0, in the file), json: the objects of the array that each file holds.

    Raises on files whose array doesn't end. Elements that aren't objects are left out, without a number. An object is one row, so its size is
    what a task has to hold, not that of the file.
    """
    own = fragments(spark, path)
    pieces = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')  # without escapes, strings are the odd pieces of text that begins outside
    even, odd = F.array_join(F.filter(pieces, lambda x, i: i % 2 == 0), " "), F.array_join(F.filter(pieces, lambda x, i: i % 2 == 1), " ")
    last = own.groupBy("file_path").agg(F.max("place").alias("last"))
    own = own.select("file_path", "place", "value", (F.size(pieces) - 1).alias("quotes"), _depth(even).alias("if_out"), _depth(odd).alias("if_in")).join(last, "file_path")
    quoted = scan(durable(own), ["file_path"], "place", parity=("sum", F.col("quotes")))
    begins_in, ends_in = (F.col("parity") - F.col("quotes")) % 2 == 1, F.col("parity") % 2 == 1
    brace = ~ends_in & (F.col("place") < F.col("last"))  # the last fragment has no brace behind it
    change = F.when(begins_in, F.col("if_in")).otherwise(F.col("if_out")) - brace.cast("int")
    deep = scan(durable(quoted.select("file_path", "place", "value", "last", brace.alias("brace"), change.alias("change"))), ["file_path"], "place", depth=("sum", F.col("change")))
    deep = durable(deep.withColumn("closes", (F.col("brace") & (F.col("depth") == 1)).cast("int")))
    cut_off = deep.where("place = last AND depth <> 0").select("file_path").limit(SHOWN).collect()
    if cut_off:
        raise ValueError(f"arrays that don't end: {', '.join(sorted(r.file_path for r in cut_off))}")
    counted = scan(deep, ["file_path"], "place", closed=("sum", F.col("closes")))
    parts = F.sort_array(F.collect_list(F.struct("place", "value")))
    whole = counted.groupBy("file_path", (F.col("closed") - F.col("closes")).alias("ord")).agg(parts.alias("parts"), F.max("closes").alias("ends")).where("ends = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return whole.select("file_path", "ord", F.regexp_replace(text, r"^[^{]*", "").alias("json"))
