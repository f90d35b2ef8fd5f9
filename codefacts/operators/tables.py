"""Tables that are cut off from their lineage, and dense row numbers without a window over everything."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of a scan.
BLOCK = 4096
_MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a new local folder serves a local master; else it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def durable(rows: DataFrame) -> DataFrame:
    """rows as a new table in the shared folder, compressed and by columns; as a reliable checkpoint where Parquet can't hold them.

    A join with such a table is one of two plain shuffles, whose hot keys AQE can split; a join with an aggregate isn't. The order of rows isn't kept.
    """
    names, kinds = [c.lower() for c in rows.columns], rows.schema.simpleString()
    if not names or len(set(names)) < len(names) or "void" in kinds or "interval" in kinds:
        shared_folder(rows.sparkSession)
        return rows.checkpoint()
    return written(rows, "rows")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str, *by: str) -> DataFrame:
    """rows as a new table in the shared folder, in folders by the values of columns, so that a filter on these reads its rows only."""
    path = fresh_path(rows.sparkSession, label)
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a total order: sorted by ranges, counted per range, and moved by what stands before."""
    own = durable(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    own = own.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    parts = own.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return own.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def scan(rows: DataFrame, by: list[str], place: str, block: int = BLOCK, **values: tuple[str, Column]) -> DataFrame:
    """rows with running values (name = ("sum", "min" or "max", what)) up to and with each row of its key, in the order of place.

    place numbers all rows densely in the order of the keys, as numbered() does. A window goes over a block of a key; what stands before a
    block comes from a window over its key's blocks, a row each. So no task gets all rows of a key, however many there are.
    """
    own = rows.withColumn("_block", F.floor(F.col(place) / block))
    keys = [*by, "_block"]
    inner = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys).agg(*[_MERGED[kind](what).alias(f"_{name}") for name, (kind, what) in values.items()])
    carried = durable(totals.select(*keys, *[_MERGED[kind](f"_{name}").over(earlier).alias(f"_{name}") for name, (kind, _) in values.items()]))
    out = own.select("*", *[_MERGED[kind](what).over(inner).alias(name) for name, (kind, what) in values.items()]).join(carried, keys)
    merged = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    return out.withColumns({name: merged[kind](F.col(name), F.col(f"_{name}")) for name, (kind, _) in values.items()}).drop("_block", *[f"_{n}" for n in values])
