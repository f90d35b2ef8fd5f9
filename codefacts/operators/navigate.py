"""Navigation over a merged index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.ranges import RANGE, is_definition
from codefacts.functions.symbols import is_doc
from codefacts.operators import places as places_of


def definitions(occurrences: DataFrame) -> DataFrame:
    return occurrences.where(is_definition(F.col("roles")))


def at_position(occurrences: DataFrame, places: DataFrame) -> DataFrame:
    """Symbols under places (relative_path, line, char), with depth: 1 for the symbols of the innermost range, which may go over several lines."""
    return places_of.holding(occurrences.select("relative_path", "symbol", *RANGE), places).groupBy("relative_path", "line", "char", "symbol").agg(F.min("depth").alias("depth"))


def go_to_definition(occurrences: DataFrame, places: DataFrame) -> DataFrame:
    """Definitions of the symbols under places, with the depth of the range that names them."""
    targets = definitions(occurrences).select("symbol", F.col("relative_path").alias("def_path"), F.col("start_line").alias("def_line"), F.col("start_char").alias("def_char")).distinct()
    return at_position(occurrences, places).join(targets, "symbol")


def references(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    return occurrences.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def implementations(relations: DataFrame) -> DataFrame:
    """Per symbol, what implements it."""
    return relations.where("is_implementation").select(F.col("target").alias("symbol"), F.col("symbol").alias("implementation")).distinct()


def hover(symbols: DataFrame, external: DataFrame) -> DataFrame:
    """Documentation of symbols: from documents, else from external symbols."""
    own = symbols.select("symbol", "doc").groupBy("symbol").agg(F.min(F.when(is_doc(F.col("doc")), F.col("doc"))).alias("own"))
    other = external.select("symbol", "doc").groupBy("symbol").agg(F.min(F.when(is_doc(F.col("doc")), F.col("doc"))).alias("other"))
    return own.join(other, "symbol", "full").select("symbol", F.coalesce("own", "other").alias("doc"))


def shown_docs(occurrences: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """The documentation (the smallest text of symbols) that is shown under occurrences: definitions, and all occurrences of
    symbols that another one defines."""
    docs = symbols.groupBy("symbol").agg(F.min("doc").alias("doc"))
    other = relations.where("is_definition").select("symbol", F.lit(True).alias("elsewhere")).distinct()
    own = occurrences.join(docs, "symbol").join(other, "symbol", "left")
    return own.where(is_definition(F.col("roles")) | F.coalesce("elsewhere", F.lit(False))).drop("elsewhere")


def undocumented(symbols: DataFrame) -> DataFrame:
    """One row: symbols, those without documentation, and their ratio."""
    n, none = F.count_distinct("symbol"), F.count_distinct(F.when(~is_doc(F.col("doc")), F.col("symbol")))
    return symbols.groupBy("symbol").agg(F.max_by("doc", is_doc(F.col("doc"))).alias("doc")).agg(n.alias("n"), none.alias("n_undocumented"), (none / n).alias("ratio"))


def cross_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """Symbols of two indexes that are the same."""
    return left.select("symbol").distinct().join(right.select("symbol").distinct(), "symbol")


def unused(occurrences: DataFrame) -> DataFrame:
    """Defined symbols without a reference."""
    used = occurrences.where(~is_definition(F.col("roles"))).select("symbol").distinct()
    return definitions(occurrences).select("symbol").distinct().join(used, "symbol", "left_anti")


def fan_in(occurrences: DataFrame) -> DataFrame:
    """Per symbol, its references and the files that hold them."""
    return occurrences.where(~is_definition(F.col("roles"))).groupBy("symbol").agg(F.count("*").alias("n_references"), F.count_distinct("relative_path").alias("n_files"))
