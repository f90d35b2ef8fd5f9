"""The facts that the stored index is made from."""

from codefacts.queries import indexing


def test_line_items_of_one_order_part_and_number(spark, tmp_path):
    """Each is a fact at its own range and at the other's; no range mixes the two."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 9, 4, 2, 28.0, "A", "F"), (1, 9, 7, 2, 19.0, "R", "O"), (1, 9, 7, 3, 5.0, "R", "O")], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = indexing._facts(spark, str(tmp_path)).select("start_line", "start_char", "end_line", "end_char", "hash", "canonical_is_definition").collect()
    twins = {(2, q, 2, q + 2, h, f) for q, h in ((28, 0), (19, 1)) for f in (True, False)}
    assert len(got) == 5 and {tuple(r) for r in got} == twins | {(3, 5, 3, 7, 1, False)}
