"""What the operators of this subpackage share: shared storage, text constants, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table with at most this many rows of a few numbers (some 10 MB) may be broadcast.
SMALL_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a new local one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df to the shared folder, in folders by its last columns if they are named, and read it back: a short lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete(spark: SparkSession, path: str) -> None:
    at, store = _store(spark, path)
    store.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of the tables in a folder that have been written to the end."""
    at, store = _store(spark, path)
    if not store.exists(at):
        return []
    names = [x.getPath().getName() for x in store.listStatus(at) if x.isDirectory()]
    return [n for n in names if store.exists(_store(spark, f"{path}/{n}/_SUCCESS")[0])]


def discard(df: DataFrame) -> None:
    """Delete a table that cut() has written, once everything that reads it has been written itself."""
    delete(df.sparkSession, df._cut_path)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less its columns of these names in any case, which the caller is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def spare(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has in any case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def _stars(edges: DataFrame, label: str) -> list[DataFrame]:
    """The edges after a large-star and a small-star step, as a written table, and the tables that it was made from.

    The least neighbours are written, so that AQE can split the many edges of one node when they are joined.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lower = cut(down.groupBy("a").agg(F.min("b").alias("m")), label)
    moved = down.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return [cut(moved.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), label), least, lower]


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node in edges (a, b): the smallest id that can be reached.

    Alternates large-star and small-star steps until the edge set stays the same, which takes a number of
    rounds logarithmic in the longest path. All joins and aggregates are keyed; each round is written to the
    shared folder, and only a count and a checksum reach the driver.
    """
    state = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    seen = state(now)
    for _ in range(rounds):
        last, (now, *others) = now, _stars(now, label)
        for old in (last, *others):
            discard(old)
        if (new := state(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"{label}: no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
