"""Queries of defined orders, of shown documentation and relations, of traces and phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import jobs, merge, planning, render
from codefacts.queries import query
from codefacts.schema import MISSING_DOC
from codefacts.sources.adapters import compdb, job_event, occ_raw, rel_raw, sym_seen, table, tu_file

_FULL = """(SELECT l_orderkey, l_linenumber, concat('f', l_orderkey // 20) AS relative_path, l_linenumber AS start_line, l_partkey % 2 AS start_char, l_linenumber + l_suppkey % 2 AS end_line, 9 - l_partkey % 3 AS end_char,
    concat('S', l_partkey % 3 * 50) AS symbol, l_linenumber % 2 AS roles, l_orderkey % 2 AS syntax_kind, CASE l_suppkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [l_returnflag] ELSE [concat('d', l_suppkey), l_linestatus] END AS docs,
    CASE WHEN l_partkey % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE [concat('m', l_partkey)] END AS messages FROM lineitem)"""


@query(f"""SELECT l_orderkey, l_linenumber, relative_path, symbol, array_to_string(docs, '|') AS docs, array_to_string(messages, '|') AS messages, row_number() OVER (PARTITION BY relative_path
    ORDER BY start_line, start_char, start_line <> end_line, CASE WHEN start_line <> end_line THEN end_line ELSE end_char END, end_char, strlen(symbol), symbol, roles, syntax_kind,
    len(docs), strlen(docs[1]), docs[1], strlen(docs[2]), docs[2], len(messages), strlen(messages[1]), messages[1], l_orderkey, l_linenumber) AS place FROM {_FULL} x""")
def o03_occurrence_order(spark, sf_dir):
    """The whole order of occurrences, with the number of the row as the last resort."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    docs = F.when(s % 3 == 0, F.array().cast("array<string>")).when(s % 3 == 1, F.array("l_returnflag")).otherwise(F.array(F.concat(F.lit("d"), s), F.col("l_linestatus")))
    message = F.struct(F.lit(1).alias("severity"), F.lit("").alias("code"), F.concat(F.lit("m"), p).alias("message"), F.lit("").alias("source"), F.array().cast("array<int>").alias("tags"))
    own = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("concat('f', l_orderkey DIV 20)").alias("relative_path"), n.alias("start_line"), (p % 2).alias("start_char"), (n + s % 2).alias("end_line"), (9 - p % 3).alias("end_char"),
        F.concat(F.lit("S"), p % 3 * 50).alias("symbol"), (n % 2).alias("roles"), (F.col("l_orderkey") % 2).alias("syntax_kind"), docs.alias("override_documentation"),
        F.when(p % 2 == 1, F.array(message)).otherwise(F.array().cast("array<struct<severity: int, code: string, message: string, source: string, tags: array<int>>>")).alias("diagnostics"),
    )
    places = render.ranked(own, ["l_orderkey", "l_linenumber"])
    messages = F.array_join(F.transform("diagnostics", lambda d: d["message"]), "|")
    return places.select("l_orderkey", "l_linenumber", "relative_path", "symbol", F.array_join("override_documentation", "|").alias("docs"), messages.alias("messages"), F.col("place").cast("long").alias("place"))


@query("""SELECT task_id, path, array_to_string(hashes, ',') AS hashes, len(hashes) > 1 AS is_multi, row_number() OVER (PARTITION BY task_id, len(hashes) > 1 ORDER BY CASE WHEN len(hashes) = 1 THEN hashes[1] END, path) AS place
    FROM (SELECT task_id, path, list_sort(list(DISTINCT hash)) AS hashes FROM tu_file GROUP BY task_id, path) x""")
def o06_file_order(spark, sf_dir):
    own = planning.file_order(tu_file(spark, sf_dir))
    return own.select("task_id", "path", F.array_join(F.col("hashes").cast("array<string>"), ",").alias("hashes"), "is_multi", F.col("place").cast("long").alias("place"))


@query("SELECT task_id, relative_path, row_number() OVER (PARTITION BY task_id ORDER BY strlen(relative_path), relative_path) AS place FROM (SELECT DISTINCT task_id, relative_path FROM occ_raw) x")
def o08_shard_documents(spark, sf_dir):
    own = render.shard_documents(occ_raw(spark, sf_dir).select("task_id", "relative_path").distinct())
    return own.withColumn("place", F.col("place").cast("long"))


_LINE = "concat('//', repeat(' ', start_char))"
_SHOW = "replace(replace({0}, 'cxx . . $ ', '[..] '), 'cxx . ', '')"
_KIND = "array_to_string(list_filter([CASE WHEN is_implementation THEN 'implementation' END, CASE WHEN is_reference THEN 'reference' END, CASE WHEN is_type_definition THEN 'type_definition' END, CASE WHEN is_definition THEN 'definition' END], lambda x: x IS NOT NULL), '+')"
_KNOWN = f"""(SELECT relative_path, symbol, coalesce(arg_min(doc, (task_id, ord, line, doc)) FILTER (doc <> '' AND doc <> '{MISSING_DOC}'), '{MISSING_DOC}') AS doc FROM sym_seen GROUP BY relative_path, symbol)"""
_RELATED = f"(SELECT symbol, bool_or(is_definition) AS elsewhere, list(concat('relation ', {_KIND}, ' ', {_SHOW.format('target')}) ORDER BY target, {_KIND}) AS lines FROM rel_raw GROUP BY symbol)"


@query(f"""SELECT o.relative_path, o.symbol, start_line, start_char, end_line, end_char, roles, concat({_LINE}, repeat('^', CASE WHEN start_line = end_line THEN end_char - start_char ELSE 1 END), CASE WHEN roles = 1 THEN ' definition ' ELSE ' reference ' END, {_SHOW.format('o.symbol')},
    CASE WHEN s.symbol IS NOT NULL AND (roles = 1 OR coalesce(r.elsewhere, false)) THEN concat(chr(10), {_LINE}, 'documentation', chr(10), {_LINE}, '| ', s.doc,
      coalesce(chr(10) || array_to_string(list_transform(r.lines, lambda x: concat({_LINE}, x)), chr(10)), '')) ELSE '' END) AS marker
    FROM (SELECT DISTINCT relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM occ_raw) o LEFT JOIN {_KNOWN} s ON s.relative_path = o.relative_path AND s.symbol = o.symbol
    LEFT JOIN {_RELATED} r ON r.symbol = o.symbol""")
def k04_documented_lines(spark, sf_dir):
    """Markers with documentation and relations (in the plain order of targets) under definitions."""
    known = merge.merge_symbols(sym_seen(spark, sf_dir), ["relative_path", "symbol"], ["task_id", "ord", "line", "doc"])
    own = merge.merge_occurrences(occ_raw(spark, sf_dir))
    return render.documented_lines(own, merge.with_relationships(known, rel_raw(spark, sf_dir))).select("relative_path", "symbol", "start_line", "start_char", "end_line", "end_char", "roles", "marker")


@query("""SELECT subtask, round(epoch_us(max(ts) FILTER (event = 'finish')) / 1e6 - epoch_us(min(ts) FILTER (event = 'start')) / 1e6, 3) AS seconds, count(DISTINCT task_id) FILTER (event = 'finish') AS n_done
    FROM job_event WHERE event IN ('start', 'finish') GROUP BY subtask""")
def k07_phase_times(spark, sf_dir):
    return jobs.phase_times(job_event(spark, sf_dir))


@query("SELECT task_id, file FROM compdb WHERE task_id >= 20 AND task_id < 160 AND contains(file, '1')")
def o14_subset(spark, sf_dir):
    return planning.subset(compdb(spark, sf_dir), 20, 160, "1").select("task_id", "file")


def _trace(spark, sf_dir):
    """Traces: one per customer's orders; an order's priority and number say what happens."""
    o = F.col("o_orderkey")
    kind = F.when(o % 5 < 2, "enter").when(o % 5 < 4, "exit").when(o % 25 == 4, "end").otherwise("other")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), o.alias("seq"), kind.alias("kind"), F.concat(F.lit("p"), o % 3).alias("path"), F.when(o % 4 > 0, F.concat(F.lit("p"), o % 2)).alias("previous"))


@query()
def w05_trace_violations(spark, sf_dir):
    return planning.trace_violations(_trace(spark, sf_dir))
