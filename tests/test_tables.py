"""Tables that are cut off from their lineage."""

from pyspark.sql import functions as F

from codefacts.operators import render, tables


def test_durable_rows_are_compressed_columns(spark):
    rows = spark.range(1000).select("id", F.lit("the same long text in every row").alias("t"), F.array("id").alias("a"))
    own = tables.durable(rows)
    assert own.inputFiles() and own.dtypes == rows.dtypes and own.exceptAll(rows).isEmpty() and own.count() == 1000
    assert tables.durable(rows.withColumn("none", F.lit(None))).count() == 1000  # a column that Parquet hasn't


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    assert tables.numbered(rows, [F.col("x")], "n").where("n <> x + 1").isEmpty()


def test_nested_places_are_sorted_as_rows(spark):
    """Rows are ranked by a window, not by comparing long keys in lists."""
    place = "relative_path string, symbol string, start_line int, start_char int, end_line int, end_char int, roles int"
    occurrences = spark.createDataFrame([("f", f"S{i % 9}", i * 37 % 50, 0, i * 37 % 50, 2, 0) for i in range(300)], place)
    out = render.nested_documents(occurrences, spark.createDataFrame([], "relative_path string, symbol string, doc string"))
    assert "row_number" in out._jdf.queryExecution().analyzed().toString()
    got = [(o.start_line, len(o.symbol), o.symbol) for o in out.first().occurrences]
    assert len(got) == 300 and got == sorted(got)
