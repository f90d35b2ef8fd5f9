"""Queries that a finished index answers, and its text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import graph, merge, navigate, render
from codefacts.queries import query
from codefacts.schema import MISSING_DOC
from codefacts.sources.adapters import base_edge, occ_raw, rel_raw, source_line, sym_raw, sym_seen, table

_OCC = "(SELECT DISTINCT relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM occ_raw)"


def _occurrences(spark, sf_dir):
    return merge.merge_occurrences(occ_raw(spark, sf_dir))


def _places(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.expr("concat('src/f', o_orderkey DIV 20, '.cc')").alias("relative_path"), (o % 7).cast("int").alias("line"), (o % 53).cast("int").alias("char")).distinct()


_PLACES = "(SELECT DISTINCT concat('src/f', o_orderkey // 20, '.cc') AS relative_path, CAST(o_orderkey % 7 AS INT) AS line, CAST(o_orderkey % 53 AS INT) AS char FROM orders)"


_HELD = "(p.line > o.start_line OR p.char >= o.start_char) AND (p.line < o.end_line OR p.char < o.end_char)"


@query(f"""SELECT p.relative_path, p.line, p.char, p.symbol, p.depth, d.relative_path AS def_path, d.start_line AS def_line, d.start_char AS def_char FROM
    (SELECT relative_path, line, char, symbol, min(depth) AS depth FROM (SELECT p.*, o.symbol, dense_rank() OVER (PARTITION BY p.relative_path, p.line, p.char ORDER BY o.start_line DESC, o.start_char DESC, o.end_line, o.end_char) AS depth
        FROM {_PLACES} p JOIN {_OCC} o ON o.relative_path = p.relative_path AND p.line BETWEEN o.start_line AND o.end_line AND {_HELD}) x GROUP BY relative_path, line, char, symbol) p
    JOIN (SELECT DISTINCT symbol, relative_path, start_line, start_char FROM {_OCC} x WHERE roles = 1) d ON p.symbol = d.symbol""")
def n01_definition(spark, sf_dir):
    own = navigate.go_to_definition(_occurrences(spark, sf_dir), _places(spark, sf_dir))
    return own.select("relative_path", "line", "char", "symbol", F.col("depth").cast("long").alias("depth"), "def_path", "def_line", "def_char")


@query(f"SELECT relative_path, symbol, start_line, start_char, roles FROM {_OCC} x WHERE symbol IN (SELECT symbol FROM sym_raw WHERE task_id % 10 = 1)")
def n02_references(spark, sf_dir):
    asked = sym_raw(spark, sf_dir).where("task_id % 10 = 1").select("symbol")
    return navigate.references(_occurrences(spark, sf_dir), asked).select("relative_path", "symbol", "start_line", "start_char", "roles")


@query("""WITH RECURSIVE up AS (SELECT derived, base FROM base_edge UNION ALL SELECT u.derived, e.base FROM up u JOIN base_edge e ON u.base = e.derived)
    SELECT DISTINCT concat('T', base) AS symbol, concat('T', derived) AS implementation FROM up""")
def n03_implementations(spark, sf_dir):
    own = graph.closure(base_edge(spark, sf_dir)).select(F.concat(F.lit("T"), "derived").alias("symbol"), F.concat(F.lit("T"), "base").alias("target"), F.lit(True).alias("is_implementation"))
    return navigate.implementations(own)


@query(f"""SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.doc, b.doc) AS doc FROM (SELECT symbol, min(doc) FILTER (doc <> '' AND doc <> '{MISSING_DOC}') AS doc FROM sym_seen GROUP BY symbol) a
    FULL JOIN (SELECT symbol, min(doc) FILTER (doc <> '' AND doc <> '{MISSING_DOC}') AS doc FROM sym_raw WHERE is_ext GROUP BY symbol) b ON a.symbol = b.symbol""")
def n04_hover(spark, sf_dir):
    return navigate.hover(sym_seen(spark, sf_dir), sym_raw(spark, sf_dir).where("is_ext"))


@query("SELECT concat('cxx . . .$ `<file>//proj/inc/h', l_partkey, '.h`/') AS symbol, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey")
def n05_includes(spark, sf_dir):
    from codefacts.functions.symbols import file_symbol
    from codefacts.sources.adapters import tu_file

    return tu_file(spark, sf_dir).groupBy(file_symbol(F.lit(None), F.lit("."), F.col("path")).alias("symbol")).agg(F.count_distinct("task_id").alias("n"))


@query("SELECT DISTINCT symbol FROM occ_raw WHERE task_id % 2 = 0 INTERSECT SELECT symbol FROM occ_raw WHERE task_id % 5 = 1 AND roles = 1")
def n06_cross_repo(spark, sf_dir):
    own = occ_raw(spark, sf_dir)
    return navigate.cross_links(own.where("task_id % 2 = 0"), own.where("task_id % 5 = 1 AND roles = 1"))


@query("SELECT symbol FROM occ_raw WHERE roles = 1 EXCEPT SELECT symbol FROM occ_raw WHERE roles = 0")
def n07_unused(spark, sf_dir):
    return navigate.unused(occ_raw(spark, sf_dir))


def _members(spark, sf_dir):
    """Seven members of each part, defined with it and used by its line items of their number."""
    name = lambda of, n: F.concat(of, n, F.lit("."))
    defined = sym_raw(spark, sf_dir).select("symbol", "relative_path", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n")).select(name(F.col("symbol"), F.col("n")).alias("symbol"), "relative_path", F.lit(1).alias("roles"))
    used = occ_raw(spark, sf_dir).select(name(F.col("symbol"), F.col("start_line") + 1).alias("symbol"), "relative_path", F.lit(0).alias("roles"))
    return defined.unionByName(used)


@query("""SELECT DISTINCT concat(symbol, n, '.') AS symbol FROM sym_raw, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS n) m
    EXCEPT SELECT concat(symbol, start_line + 1, '.') FROM occ_raw""")
def n07_unused_members(spark, sf_dir):
    return navigate.unused(_members(spark, sf_dir))


@query(f"""SELECT count(*) AS n, count(*) FILTER (NOT has) AS n_undocumented, count(*) FILTER (NOT has) / count(*) AS ratio
    FROM (SELECT symbol, bool_or(doc <> '' AND doc <> '{MISSING_DOC}') AS has FROM sym_raw GROUP BY symbol) x""")
def n07_undocumented(spark, sf_dir):
    return navigate.undocumented(sym_raw(spark, sf_dir))


@query("SELECT symbol, count(*) AS n_references, count(DISTINCT relative_path) AS n_files FROM occ_raw WHERE roles = 0 GROUP BY symbol")
def n07_fan_in(spark, sf_dir):
    return navigate.fan_in(occ_raw(spark, sf_dir))


def _shown(spark, sf_dir):
    """Occurrences placed on the lines of documents."""
    o = _occurrences(spark, sf_dir)
    return o.withColumn("relative_path", F.concat(F.lit("src/d"), F.regexp_extract("relative_path", "([0-9]+)", 1), F.lit(".cc")))


_SHOWN = f"(SELECT concat('src/d', regexp_extract(relative_path, '([0-9]+)', 1), '.cc') AS relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM {_OCC} x)"
_MARK = "concat('//', repeat(' ', o.start_char), repeat('^', CASE WHEN o.start_line = o.end_line THEN o.end_char - o.start_char ELSE greatest(length(t.text) - o.start_char, 1) END), CASE WHEN roles = 1 THEN ' definition ' ELSE ' reference ' END, replace(replace(symbol, 'cxx . . $ ', '[..] '), 'cxx . ', ''))"


@query(f"""SELECT l.relative_path, l.line_no, concat('  ', l.text, coalesce(chr(10) || string_agg(m.mark, chr(10) ORDER BY m.start_char, m.start_line <> m.end_line, m.end_line, m.end_char, strlen(m.symbol), m.symbol, m.roles), '')) AS snapshot
    FROM source_line l LEFT JOIN (SELECT o.*, {_MARK} AS mark FROM {_SHOWN} o JOIN source_line t ON o.relative_path = t.relative_path AND o.start_line + 1 = t.line_no) m ON l.relative_path = m.relative_path AND l.line_no = m.start_line + 1 GROUP BY l.relative_path, l.line_no, l.text""")
def k04_snapshot_lines(spark, sf_dir):
    return render.snapshot(source_line(spark, sf_dir), _shown(spark, sf_dir)).select("relative_path", F.col("line_no").cast("long").alias("line_no"), "snapshot")


@query(f"SELECT count(*) AS n, count(DISTINCT l.relative_path) AS n_files FROM source_line l JOIN {_SHOWN} o ON l.relative_path = o.relative_path AND l.line_no - 1 = o.start_line")
def j11_line_join(spark, sf_dir):
    lines, shown = source_line(spark, sf_dir), _shown(spark, sf_dir)
    return render.on_lines(lines, shown).agg(F.count("*").alias("n"), F.count_distinct("relative_path").alias("n_files"))


@query(f"""SELECT o.relative_path, o.symbol, o.start_line, o.start_char, s.doc FROM {_OCC} o JOIN (SELECT symbol, min(doc) AS doc FROM sym_raw GROUP BY symbol) s ON o.symbol = s.symbol
    WHERE o.roles = 1 OR o.symbol IN (SELECT symbol FROM rel_raw WHERE is_definition)""")
def j12_shown_docs(spark, sf_dir):
    return navigate.shown_docs(_occurrences(spark, sf_dir), sym_raw(spark, sf_dir), rel_raw(spark, sf_dir)).select("relative_path", "symbol", "start_line", "start_char", "doc")


@query("SELECT symbol, concat('// ', replace(replace(symbol, 'cxx . . $ ', '[..] '), 'cxx . ', ''), chr(10), '// documentation', chr(10), '// | ', doc) AS snapshot FROM sym_raw WHERE is_ext")
def k05_external_text(spark, sf_dir):
    return render.external_text(sym_raw(spark, sf_dir).where("is_ext"))


@query(f"""SELECT o.relative_path, o.n AS n_occurrences, coalesce(s.n, 0) AS n_symbols, o.first FROM (SELECT relative_path, count(*) AS n, arg_min(symbol, (start_line, start_char, start_line <> end_line, CASE WHEN start_line <> end_line THEN end_line ELSE end_char END, end_char, strlen(symbol), symbol, roles)) AS first FROM {_OCC} x GROUP BY relative_path) o
    LEFT JOIN (SELECT relative_path, count(DISTINCT symbol) AS n FROM sym_seen GROUP BY relative_path) s ON o.relative_path = s.relative_path""")
def k02_nested_documents(spark, sf_dir):
    documents = render.nested_documents(_occurrences(spark, sf_dir), merge.merge_symbols(sym_seen(spark, sf_dir), ["relative_path", "symbol"], ["task_id", "ord", "line", "doc"]))
    return documents.select("relative_path", F.size("occurrences").cast("long").alias("n_occurrences"), F.size("symbols").cast("long").alias("n_symbols"), F.col("occurrences")[0]["symbol"].alias("first"))
