"""Readers: build-command databases, package maps, source text, directives, index shards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from codefacts.schema import COMMAND_OBJECT, PACKAGE_ENTRY
from codefacts.sources import json_arrays


def tokenize(command: str) -> list[str]:
    """Words of a command line. Spaces part words; a backslash takes the next character as it is, except in single quotes."""
    words, word, quote, i = [], None, "", 0
    while i < len(command):
        c = command[i]
        if c == quote:
            quote = ""
        elif c == "\\" and quote != "'" and i + 1 < len(command):
            i += 1
            word = (word or "") + command[i]
        elif not quote and c in "'\"":
            quote, word = c, word or ""
        elif not quote and c == " ":
            if word is not None:
                words.append(word)
            word = None
        else:
            word = (word or "") + c
        i += 1
    return words if word is None else [*words, word]


@F.pandas_udf(ArrayType(StringType()))
def _split_quoted(commands: pd.Series) -> pd.Series:
    return commands.map(lambda x: None if x is None else tokenize(x))


def split_command(command: Column | str) -> Column:
    """The words of a command line. Python sees only the lines with a quote or a backslash."""
    command = F.col(command) if isinstance(command, str) else command
    quoted = command.rlike("[\"'\\\\]")
    words = F.filter(F.split(command, " "), lambda w: w != "")
    return F.when(quoted, _split_quoted(F.when(quoted, command))).otherwise(words)


def _arguments(command: Column) -> Column:
    words = F.coalesce(split_command(command["command"]), F.array().cast("array<string>"))
    return F.concat(words, F.coalesce(command["arguments"], F.array().cast("array<string>")))


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """task_id, directory, file, arguments, file_path of databases (JSON arrays of objects, of any size). A row's number is its place in its database before any filter.

    With both a command and arguments, the words of the command come first. Files are read in blocks (json_arrays).
    """
    own = json_arrays.array_objects(spark, path).select("file_path", F.col("ord").alias("task_id"), F.from_json("json", COMMAND_OBJECT).alias("c"))
    return own.select("task_id", "c.directory", "c.file", _arguments(F.col("c")).alias("arguments"), "file_path")


def read_command_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_commands for a database with one JSON object a line, of any size: files are split, and a row's number follows from
    the rows in the blocks before it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
    blocks = lines.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("file_path", "block", "first", before.alias("before"))
    own = lines.join(F.broadcast(blocks), ["file_path", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("task_id"), F.from_json("value", COMMAND_OBJECT).alias("c"))
    return own.select("task_id", "c.directory", "c.file", _arguments(F.col("c")).alias("arguments"))


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """Each object of a database as JSON text, for the checks of keys and types."""
    return json_arrays.array_objects(spark, path).select(F.col("ord").alias("task_id"), F.to_json(F.try_parse_json("json")).alias("json"))


def require_rows(rows: DataFrame, message: str) -> DataFrame:
    """rows, or an error if there is none."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def relative_directories(commands: DataFrame) -> DataFrame:
    """Commands whose directory is not absolute."""
    return commands.where(~F.col("directory").startswith("/"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """ord, path, package, file_path of package maps."""
    own = json_arrays.array_objects(spark, path).select("file_path", F.col("ord").cast("int").alias("ord"), F.from_json("json", PACKAGE_ENTRY).alias("p"))
    return own.select("ord", "p.path", "p.package", "file_path")


def read_sources(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """relative_path, line_no, text of all files below a folder, with tabs as one space."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = f"{root.rstrip('/')}/"
    name = F.substring_index(F.input_file_name(), base, -1)
    lines = files.select(name.alias("relative_path"), F.posexplode(F.split("value", "\n", -1)).alias("at", "text"))
    return lines.select("relative_path", (F.col("at") + 1).alias("line_no"), source_text(F.col("text")).alias("text"))


def source_text(line: Column) -> Column:
    return F.replace(F.regexp_replace(line, "\r$", ""), F.lit("\t"), F.lit(" "))


def leading_lines(lines: DataFrame, prefix: str) -> DataFrame:
    """The lines at the top of each file that start with a prefix, up to the first that doesn't."""
    first_other = F.min(F.when(~F.startswith("text", F.lit(prefix)), F.col("line_no"))).over(Window.partitionBy("relative_path"))
    return lines.withColumn("other", first_other).where(F.col("other").isNull() | (F.col("line_no") < F.col("other"))).drop("other")


def extra_arguments(lines: DataFrame) -> DataFrame:
    """Words of leading "// extra-args:" lines per file, in order."""
    own = leading_lines(lines, "// extra-args:")
    words = own.select("relative_path", "line_no", F.posexplode(F.split(F.btrim(F.substr("text", F.lit(15))), " +")).alias("at", "word")).where("word <> ''")
    return words.groupBy("relative_path").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "at", "word"))), lambda w: w["word"]).alias("arguments"))


def format_options(lines: DataFrame) -> DataFrame:
    """Options of "// format-options:" lines anywhere in a file."""
    own = lines.where(F.startswith("text", F.lit("// format-options:")))
    return own.select("relative_path", F.explode(F.split(F.substr("text", F.lit(19)), "[, ]+")).alias("option")).where("option <> ''").distinct()


def _unreadable(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for t in tables:
        out = []
        for path in t["path"]:
            try:
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    pq.ParquetFile(file)
                out.append(None)
            except Exception as e:  # whatever is wrong with a shard, the others are read
                out.append(f"{type(e).__name__}: {e}"[:200])
        yield t.assign(reason=out)[["path", "reason"]]


def read_shards(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of readable shards, path and reason of the others). Shards are Parquet files of units, of any size.

    Tasks look at the footer of each shard, so a truncated one is told apart and reported; only paths go through the driver,
    as they do whenever Spark lists files. Files of no bytes hold nothing and are in neither table.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    looked = listed.mapInPandas(_unreadable, "path string, reason string").persist()
    good = [r.path for r in looked.where("reason IS NULL").select("path").collect()]
    rows = spark.read.schema(schema).parquet(*good) if good else spark.createDataFrame([], schema)
    return rows, looked.where("reason IS NOT NULL")


FORWARD = "task_id bigint, suffix string, doc string, references array<struct<relative_path: string, start_line: int, start_char: int, end_line: int, end_char: int>>"


def read_forward_shards(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Shards of forward declarations, a second pass beside the shards of documents: a row per reference; (rows, unreadable shards)."""
    rows, bad = read_shards(spark, root, FORWARD)
    each = rows.select("task_id", "suffix", "doc", F.explode("references").alias("r"))
    return each.select("task_id", "suffix", "doc", "r.*"), bad


def write_shards(rows: DataFrame, path: str) -> None:
    """Rows of units as Parquet; task_id stays a column, since a folder per unit would be a folder per source file."""
    rows.write.mode("append").parquet(path)
