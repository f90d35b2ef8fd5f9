"""Text forms of an index: annotated lines, external symbols, nested documents, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions import ranges
from codefacts.functions.symbols import display
from codefacts.functions.units import seconds


def _marker(carets: Column, told: Column) -> Column:
    return F.concat(F.lit("//"), F.repeat(F.lit(" "), F.col("start_char")), F.repeat(F.lit("^"), carets), F.lit(" "), told)


def _told(roles: Column, symbol: Column) -> Column:
    return F.concat(ranges.role_text(roles), F.lit(" "), display(symbol))


def occurrence_lines(occurrences: DataFrame) -> DataFrame:
    """The marker line under each occurrence: carets below its characters, its role and its symbol.

    One caret shows the start of a range over several lines: how far its first line goes isn't known here.
    """
    carets = F.when(F.col("start_line") == F.col("end_line"), F.col("end_char") - F.col("start_char")).otherwise(1)
    return occurrences.withColumn("marker", _marker(carets, _told(F.col("roles"), F.col("symbol"))))


def _doc_lines(doc: Column, start: Column) -> Column:
    lines = F.split(F.regexp_replace(doc, "\n$", ""), "\n", -1)
    return F.array_join(F.concat(F.array(F.concat(start, F.lit("documentation"))), F.transform(lines, lambda x: F.concat(start, F.lit("| "), x))), "\n")


def relation_lines(relationships: Column, start: Column) -> Column:
    """A line per relationship, in the plain order of targets: its kinds and its target."""
    kinds = lambda r: F.array_join(F.array_compact(F.array(*[F.when(r[f"is_{k}"], F.lit(k)) for k in ("implementation", "reference", "type_definition", "definition")])), "+")
    shown = F.transform(relationships, lambda r: F.struct(r["target"].alias("target"), F.concat(start, F.lit("relation "), kinds(r), F.lit(" "), display(r["target"])).alias("line")))
    return F.array_join(F.transform(F.array_sort(shown), lambda x: x["line"]), "\n")


def documented_lines(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Markers with the documentation and the relations of symbols (relative_path, symbol, doc, relationships) under them.

    They stand under definitions, and under every occurrence of a symbol that another one defines.
    """
    own = occurrence_lines(occurrences) if "marker" not in occurrences.columns else occurrences
    own = own.join(symbols.select("relative_path", "symbol", "doc", "relationships"), ["relative_path", "symbol"], "left")
    start = F.concat(F.lit("//"), F.repeat(F.lit(" "), F.col("start_char")))
    shown = ranges.is_definition(F.col("roles")) | F.exists("relationships", lambda r: r["is_definition"])
    relations = F.when(F.size("relationships") > 0, relation_lines(F.col("relationships"), start))
    more = F.when(F.coalesce(shown, F.lit(False)), F.concat_ws("\n", _doc_lines(F.col("doc"), start), relations))
    return own.withColumn("marker", F.concat_ws("\n", "marker", F.nullif(more, F.lit("")))).drop("doc", "relationships")


def snapshot(lines: DataFrame, occurrences: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Per source line, the line and the markers of its occurrences in order, as one text; with symbols, their docs and relations too.

    A range over several lines is marked under its first line, from its start to the line's end, with one caret at least.
    """
    told = occurrences.withColumn("marker", _told(F.col("roles"), F.col("symbol")))
    told = told if symbols is None else documented_lines(told, symbols)
    order = [c.alias(f"k{i}") for i, c in enumerate([*ranges.order()[1:], *ranges.by_length(F.col("symbol"))])]
    marks = F.sort_array(F.collect_list(F.struct(*order, "roles", "marker", "start_char", "end_char", (F.col("start_line") == F.col("end_line")).alias("single"))))
    own = told.groupBy("relative_path", (F.col("start_line") + 1).alias("line_no")).agg(marks.alias("marks"))
    space, line = F.lit(" "), F.char_length("text")
    carets = lambda m: F.when(m["single"], m["end_char"] - m["start_char"]).otherwise(F.greatest(line - m["start_char"], F.lit(1)))
    shown = F.transform("marks", lambda m: F.concat(F.lit("//"), F.repeat(space, m["start_char"]), F.repeat(F.lit("^"), carets(m)), space, m["marker"]))
    text = F.concat_ws("\n", F.concat(F.lit("  "), "text"), shown)
    return lines.join(own, ["relative_path", "line_no"], "left").select("relative_path", "line_no", text.alias("snapshot"))


def on_lines(lines: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Occurrences with the text of the source line that they start on."""
    own = lines.select("relative_path", (F.col("line_no") - 1).alias("start_line"), "text")
    return occurrences.join(own, ["relative_path", "start_line"])


def external_text(external: DataFrame) -> DataFrame:
    """The lines that show an external symbol, its documentation and, if there is such a column, its relationships."""
    parts = [F.concat(F.lit("// "), display(F.col("symbol"))), _doc_lines(F.col("doc"), F.lit("// "))]
    if "relationships" in external.columns:
        parts.append(F.when(F.size("relationships") > 0, relation_lines(F.col("relationships"), F.lit("// "))))
    return external.select("symbol", F.concat_ws("\n", *parts).alias("snapshot"))


def nested_documents(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per document with its occurrences and symbols in the defined order: the shape of the stored index.

    A document's rows meet here and nowhere before; a document is bounded by the size of a source file.
    """
    fields = [c for c in occurrences.columns if c != "relative_path"]
    place = F.struct("place", F.struct(*fields).alias("o"))  # rows are sorted as rows; lists of them, which are compared by interpreted code, are then in order already
    a = ranked(occurrences).groupBy("relative_path").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["o"]).alias("occurrences"))
    more = ["relationships"] if "relationships" in symbols.columns else []
    b = symbols.groupBy("relative_path").agg(F.sort_array(F.collect_list(F.struct(F.octet_length("symbol").alias("n"), "symbol", "doc", *more))).alias("symbols"))
    return a.join(b, "relative_path", "full").withColumn("language", F.lit("CPP"))


def shard_documents(documents: DataFrame) -> DataFrame:
    """The documents of each unit (task_id, relative_path) in the order of their paths, shorter ones first, with their places."""
    order = Window.partitionBy("task_id").orderBy(*ranges.by_length(F.col("relative_path")))
    return documents.withColumn("place", F.row_number().over(order))


def ranked(occurrences: DataFrame, last: list[str] | None = None) -> DataFrame:
    """occurrences with their place in the order of their document; columns of `last` decide between equals."""
    order = [*ranges.occurrence_keys(occurrences.columns), *(last or [])]
    return occurrences.withColumn("place", F.row_number().over(Window.partitionBy("relative_path").orderBy(*order)))


def stats_json(stats: DataFrame) -> DataFrame:
    """Per unit (task_id, filepath, total_time_us), its record in the statistics file."""
    body = F.to_json(F.struct("filepath", F.struct(seconds(F.col("total_time_us")).alias("total_time_s")).alias("stats")))
    return stats.select("task_id", body.alias("json"))
