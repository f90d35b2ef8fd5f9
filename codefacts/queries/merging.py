"""Queries of facts, of merging and of forward-declaration resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codefacts.functions import ranges
from codefacts.operators import facts, graph, measure, merge, planning, render
from codefacts.plans import index
from codefacts.queries import query
from codefacts.schema import MAX_ENUM_CASES, MISSING_DOC
from codefacts.sources.adapters import base_edge, fwd_raw, occ_raw, rel_raw, sym_raw, sym_seen, table, tu_file

_RES = """(SELECT f.suffix, coalesce(d.symbol, e.symbol, concat('cxx . . $ ', f.suffix)) AS symbol, CASE WHEN d.symbol IS NOT NULL THEN 'document' WHEN e.symbol IS NOT NULL THEN 'external' ELSE 'invented' END AS found
    FROM (SELECT DISTINCT suffix FROM fwd_raw) f LEFT JOIN (SELECT suffix, arg_min(symbol, (is_multi, task_id, relative_path, strlen(symbol), symbol)) AS symbol FROM sym_raw WHERE in_doc GROUP BY suffix) d ON f.suffix = d.suffix
    LEFT JOIN (SELECT suffix, symbol FROM sym_raw WHERE is_ext) e ON f.suffix = e.suffix AND d.symbol IS NULL)"""
_ALL = f"""(SELECT * FROM (SELECT DISTINCT relative_path, symbol, start_line, start_char, roles FROM occ_raw) o
    UNION ALL SELECT w.relative_path, r.symbol, w.start_line, w.start_char, 0 FROM fwd_raw w JOIN {_RES} r ON w.suffix = r.suffix)"""


@query(f"SELECT relative_path, count(*) AS n_occ, count(DISTINCT symbol) AS n_sym, CAST(sum(roles) AS BIGINT) AS n_def FROM {_ALL} al GROUP BY relative_path")
def flagship_merge(spark, sf_dir):
    return index.document_counts(index.merged_occurrences(occ_raw(spark, sf_dir), sym_raw(spark, sf_dir), fwd_raw(spark, sf_dir)))


@query(f"SELECT suffix, symbol, found FROM {_RES} r")
def j07_resolution(spark, sf_dir):
    s = sym_raw(spark, sf_dir)
    return merge.resolve(fwd_raw(spark, sf_dir), s.where("in_doc"), s.where("is_ext"))


@query(f"SELECT suffix, count(*) AS n FROM {_RES} r GROUP BY suffix HAVING count(*) > 1")
def j07_fanout(spark, sf_dir):
    s = sym_raw(spark, sf_dir)
    return merge.resolve(fwd_raw(spark, sf_dir), s.where("in_doc"), s.where("is_ext")).groupBy("suffix").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""SELECT s.task_id, s.symbol, CASE WHEN s.doc <> '' AND s.doc <> '{MISSING_DOC}' THEN s.doc ELSE coalesce(o.offer, s.doc) END AS doc FROM sym_raw s LEFT JOIN
    (SELECT r.symbol, arg_min(w.doc, (w.task_id, w.doc)) AS offer FROM fwd_raw w JOIN {_RES} r ON w.suffix = r.suffix WHERE w.doc <> '' AND w.doc <> '{MISSING_DOC}' GROUP BY r.symbol) o ON s.symbol = o.symbol""")
def j07_patched_docs(spark, sf_dir):
    s, w = sym_raw(spark, sf_dir), fwd_raw(spark, sf_dir)
    return merge.patched_docs(s.select("task_id", "symbol", "doc"), merge.resolve(w, s.where("in_doc"), s.where("is_ext")), w).select("task_id", "symbol", "doc")


_OFFER = f"""(SELECT r.symbol, arg_min(w.doc, (w.task_id, w.doc)) AS offer FROM fwd_raw w JOIN {_RES} r ON w.suffix = r.suffix WHERE w.doc <> '' AND w.doc <> '{MISSING_DOC}' GROUP BY r.symbol)"""
_EXTERNAL = f"""(SELECT e.symbol, CASE WHEN e.doc <> '' AND e.doc <> '{MISSING_DOC}' THEN e.doc ELSE coalesce(o.offer, e.doc) END AS doc
    FROM (SELECT * FROM sym_raw WHERE is_ext AND suffix NOT IN (SELECT suffix FROM sym_raw WHERE in_doc AND suffix IN (SELECT suffix FROM fwd_raw))) e LEFT JOIN {_OFFER} o ON o.symbol = e.symbol
    UNION ALL SELECT r.symbol, coalesce(o.offer, '{MISSING_DOC}') FROM {_RES} r LEFT JOIN {_OFFER} o ON o.symbol = r.symbol WHERE r.found = 'invented')"""


@query(f"SELECT symbol, doc FROM {_EXTERNAL} e")
def j07_external_records(spark, sf_dir):
    s, w = sym_raw(spark, sf_dir), fwd_raw(spark, sf_dir)
    resolved = merge.resolve(w, s.where("in_doc"), s.where("is_ext"))
    return merge.external_records(s.where("is_ext"), s.where("in_doc"), w, resolved).select("symbol", "doc")


def _index(spark, sf_dir):
    s = sym_raw(spark, sf_dir)
    return index.flat_index(occ_raw(spark, sf_dir), s.where("in_doc"), s.where("is_ext"), rel_raw(spark, sf_dir), fwd_raw(spark, sf_dir), "/proj")


def _part(spark, sf_dir, name):
    s = sym_raw(spark, sf_dir)
    return index.merged_parts(occ_raw(spark, sf_dir), s.where("in_doc"), s.where("is_ext"), rel_raw(spark, sf_dir), fwd_raw(spark, sf_dir), (name,))[name]


_SHOWN_RELATIONS = "coalesce((SELECT string_agg(concat(CAST(r.is_definition AS INT), CAST(r.is_reference AS INT), CAST(r.is_type_definition AS INT), CAST(r.is_implementation AS INT), ' ', r.target), ',' ORDER BY r.is_definition, r.is_reference, r.is_type_definition, r.is_implementation, strlen(r.target), r.target) FROM rel_raw r WHERE r.symbol = s.symbol), '')"


def _relations_text():
    text = lambda r: F.concat(*[r[c].cast("int").cast("string") for c in merge.FLAGS], F.lit(" "), r["target"])
    return F.array_join(F.transform("relationships", text), ",").alias("relations")


@query(f"""SELECT relative_path, row_number() OVER (PARTITION BY relative_path ORDER BY start_line, start_char, start_line <> end_line, CASE WHEN start_line <> end_line THEN end_line ELSE end_char END, end_char, strlen(symbol), symbol, roles) - 1 AS place,
    start_line, start_char, end_line, end_char, symbol, roles FROM (SELECT DISTINCT relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM occ_raw
    UNION ALL SELECT w.relative_path, r.symbol, w.start_line, w.start_char, w.end_line, w.end_char, 0 FROM fwd_raw w JOIN {_RES} r ON w.suffix = r.suffix) x""")
def k02_document_occurrences(spark, sf_dir):
    own = render.ranked(_part(spark, sf_dir, "occurrences"))
    return own.select("relative_path", (F.col("place") - 1).cast("long").alias("place"), "start_line", "start_char", "end_line", "end_char", "symbol", "roles")


@query(f"""SELECT s.relative_path, row_number() OVER (PARTITION BY s.relative_path ORDER BY strlen(s.symbol), s.symbol) - 1 AS place, s.symbol, CASE WHEN s.doc <> '{MISSING_DOC}' THEN s.doc ELSE coalesce(o.offer, s.doc) END AS doc, {_SHOWN_RELATIONS} AS relations
    FROM (SELECT relative_path, symbol, coalesce(arg_min(doc, (is_multi, task_id, doc)) FILTER (doc <> '' AND doc <> '{MISSING_DOC}'), '{MISSING_DOC}') AS doc FROM sym_raw WHERE in_doc GROUP BY relative_path, symbol) s LEFT JOIN {_OFFER} o ON o.symbol = s.symbol""")
def k02_document_symbols(spark, sf_dir):
    order = Window.partitionBy("relative_path").orderBy(*ranges.by_length(F.col("symbol")))
    own = _part(spark, sf_dir, "symbols").withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    return own.select("relative_path", "place", "symbol", "doc", _relations_text())


@query(f"SELECT s.symbol, s.doc, {_SHOWN_RELATIONS} AS relations FROM {_EXTERNAL} s")
def k02_external_symbols(spark, sf_dir):
    return _part(spark, sf_dir, "external_symbols").select("symbol", "doc", _relations_text())


@query("""SELECT o.relative_path, count(w.start_line) AS n FROM (SELECT DISTINCT relative_path FROM occ_raw WHERE roles = 1) o LEFT JOIN fwd_raw w ON o.relative_path = w.relative_path GROUP BY o.relative_path""")
def j08_forward_by_document(spark, sf_dir):
    return merge.forward_by_document(occ_raw(spark, sf_dir).where("roles = 1"), fwd_raw(spark, sf_dir))


@query("""SELECT relative_path, count(*) AS n, CAST(sum(start_char) AS BIGINT) AS chars FROM (SELECT DISTINCT relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM occ_raw) x GROUP BY relative_path""")
def a03_doc_merge(spark, sf_dir):
    return merge.merge_occurrences(occ_raw(spark, sf_dir)).groupBy("relative_path").agg(F.count("*").alias("n"), F.sum("start_char").alias("chars"))


_FIRST = f"coalesce(arg_min(doc, (task_id, ord, line, doc)) FILTER (doc <> '' AND doc <> '{MISSING_DOC}'), '{MISSING_DOC}')"
_ORDER = ["task_id", "ord", "line", "doc"]


@query(f"SELECT relative_path, symbol, {_FIRST} AS doc, count(*) AS n_seen FROM sym_seen GROUP BY relative_path, symbol")
def a04_first_doc(spark, sf_dir):
    return merge.merge_symbols(sym_seen(spark, sf_dir), ["relative_path", "symbol"], _ORDER)


def _relations(spark, sf_dir):
    """Relationships of parts to suppliers, with flags by the state of a line item."""
    p, flag = F.col("l_partkey"), F.col("l_returnflag")
    flags = ((F.col("l_linenumber") % 5 == 0).alias("is_definition"), (F.col("l_linestatus") == "F").alias("is_reference"), (flag == "R").alias("is_type_definition"), (flag == "A").alias("is_implementation"))
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), p).alias("symbol"), F.concat(F.lit("T"), "l_suppkey").alias("target"), *flags)


_RELATIONS = """(SELECT DISTINCT concat('T', l_partkey) AS symbol, concat('T', l_suppkey) AS target, l_linenumber % 5 = 0 AS is_definition, l_linestatus = 'F' AS is_reference, l_returnflag = 'R' AS is_type_definition, l_returnflag = 'A' AS is_implementation FROM lineitem)"""
_FLAG_ORDER = "is_definition, is_reference, is_type_definition, is_implementation, strlen(target), target"


@query(f"SELECT symbol, string_agg(target, ',' ORDER BY {_FLAG_ORDER}) AS targets FROM {_RELATIONS} x GROUP BY symbol")
def a05_relation_union(spark, sf_dir):
    return merge.merge_relationships(_relations(spark, sf_dir)).select("symbol", F.array_join(F.transform("relationships", lambda r: r["target"]), ",").alias("targets"))


@query(f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_FLAG_ORDER}) - 1 AS place FROM {_RELATIONS} x")
def o04_relationship_order(spark, sf_dir):
    own = merge.merge_relationships(_relations(spark, sf_dir)).select("symbol", F.posexplode("relationships").alias("place", "r"))
    return own.select("symbol", F.col("place").cast("long").alias("place"), "r.target", *[f"r.{c}" for c in merge.FLAGS])


@query(f"""SELECT s.symbol, s.doc, coalesce(string_agg(r.target, ',' ORDER BY r.is_definition, r.is_reference, r.is_type_definition, r.is_implementation, strlen(r.target), r.target), '') AS targets
    FROM (SELECT symbol, coalesce(arg_min(doc, (task_id, ord, line, doc)) FILTER (doc <> '' AND doc <> '{MISSING_DOC}'), '{MISSING_DOC}') AS doc FROM sym_seen GROUP BY symbol) s LEFT JOIN rel_raw r ON r.symbol = s.symbol GROUP BY s.symbol, s.doc""")
def a06_external_relations(spark, sf_dir):
    own = merge.with_relationships(merge.merge_symbols(sym_seen(spark, sf_dir), ["symbol"], _ORDER), rel_raw(spark, sf_dir))
    return own.select("symbol", "doc", F.array_join(F.transform("relationships", lambda r: r["target"]), ",").alias("targets"))


@query(f"SELECT symbol, {_FIRST} AS doc, count(*) AS n_seen FROM sym_seen GROUP BY symbol")
def a06_external_merge(spark, sf_dir):
    return merge.merge_symbols(sym_seen(spark, sf_dir), ["symbol"], _ORDER)


@query("""SELECT task_id, suffix, coalesce(arg_min(doc, (relative_path, start_line, start_char, end_line, end_char, doc)) FILTER (doc <> ''), '') AS doc, count(*) AS n,
    string_agg(concat(start_line, ':', start_char), ',' ORDER BY relative_path, start_line, start_char) AS places
    FROM (SELECT * REPLACE (CASE WHEN start_line % 3 = 0 THEN '' ELSE doc END AS doc) FROM fwd_raw) x GROUP BY task_id, suffix""")
def a07_forward_groups(spark, sf_dir):
    own = fwd_raw(spark, sf_dir).withColumn("doc", F.when(F.col("start_line") % 3 == 0, "").otherwise(F.col("doc")))
    places = F.array_join(F.transform("references", lambda r: F.concat(r["start_line"], F.lit(":"), r["start_char"])), ",")
    return merge.forward_groups(own).select("task_id", "suffix", "doc", F.size("references").cast("long").alias("n"), places.alias("places"))


@query("SELECT suffix, string_agg(symbol, ',' ORDER BY symbol) AS names FROM (SELECT DISTINCT suffix, symbol FROM sym_raw WHERE is_ext) x GROUP BY suffix")
def a08_external_names(spark, sf_dir):
    return merge.external_names(sym_raw(spark, sf_dir).where("is_ext")).select("suffix", F.array_join("names", ",").alias("names"))


@query(r"""SELECT suffix, arg_min(symbol, (is_multi, task_id, relative_path, strlen(symbol), symbol)) AS symbol FROM (
    SELECT regexp_extract(symbol, '^[^$]*\$ (.*)$', 1) AS suffix, symbol, ord % 2 = 0 AS is_multi, task_id, relative_path FROM (
      SELECT ord, task_id, relative_path, CASE WHEN ord % 3 = 0 THEN replace(symbol, ' v1', ' v2') ELSE symbol END AS symbol FROM sym_seen) y) x GROUP BY suffix""")
def a09_suffix_first(spark, sf_dir):
    o = F.col("ord")
    own = sym_seen(spark, sf_dir).select((o % 2 == 0).alias("is_multi"), "task_id", "relative_path", F.when(o % 3 == 0, F.replace("symbol", F.lit(" v1"), F.lit(" v2"))).otherwise(F.col("symbol")).alias("symbol"))
    return merge.first_symbols(own)


@query("""SELECT path, start_line, start_char, end_char, seq, symbol FROM (SELECT *, row_number() OVER (PARTITION BY path, start_line, start_char, end_char ORDER BY seq, symbol) AS n FROM (
    SELECT concat('f', l_orderkey // 20) AS path, l_linenumber AS start_line, CAST(l_quantity AS INT) AS start_char, CAST(l_quantity AS INT) + 3 AS end_char, l_orderkey AS seq, concat('M', l_partkey) AS symbol FROM lineitem) x) y WHERE n = 1""")
def a10_macro_dedup(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    own = table(spark, sf_dir, "lineitem").select(F.expr("concat('f', l_orderkey DIV 20)").alias("path"), F.col("l_linenumber").alias("start_line"), q.alias("start_char"), (q + 3).alias("end_char"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("M"), "l_partkey").alias("symbol"))
    return merge.dedup_macro_uses(own)


@query(f"SELECT relative_path, symbol, start_line, start_char, roles, count(*) AS n FROM {_ALL} al GROUP BY ALL")
def u03_append(spark, sf_dir):
    al = index.merged_occurrences(occ_raw(spark, sf_dir), sym_raw(spark, sf_dir), fwd_raw(spark, sf_dir))
    return al.groupBy("relative_path", "symbol", "start_line", "start_char", "roles").agg(F.count("*").alias("n"))


@query("""SELECT symbol, suffix FROM sym_raw WHERE is_ext AND suffix NOT IN (SELECT suffix FROM sym_raw WHERE in_doc AND suffix IN (SELECT suffix FROM fwd_raw))""")
def u04_external_difference(spark, sf_dir):
    s = sym_raw(spark, sf_dir)
    return merge.remaining_external(s.where("is_ext"), s.where("in_doc"), fwd_raw(spark, sf_dir)).select("symbol", "suffix")


@query("SELECT task_id, path, hash, count(*) AS n FROM (SELECT * FROM tu_file WHERE task_id % 2 = 0 UNION ALL SELECT * FROM tu_file WHERE task_id % 3 = 0) x GROUP BY task_id, path, hash")
def u05_all_files(spark, sf_dir):
    seen = tu_file(spark, sf_dir)
    return planning.all_files(seen.where("task_id % 2 = 0"), seen.where("task_id % 3 = 0")).groupBy("task_id", "path", "hash").agg(F.count("*").alias("n"))


@query("""SELECT path FROM (SELECT path FROM tu_file WHERE task_id % 3 = 0 GROUP BY path HAVING count(DISTINCT hash) = 1) a INTERSECT SELECT path FROM tu_file GROUP BY path HAVING count(DISTINCT hash) > 1""")
def u06_disjoint_plans(spark, sf_dir):
    """Paths that the plan of some units has as singly indexed and that of all units as multiply indexed."""
    seen = tu_file(spark, sf_dir)
    return planning.in_both_plans(planning.path_stats(seen.where("task_id % 3 = 0")), planning.path_stats(seen))


@query("""WITH RECURSIVE up AS (SELECT derived, base FROM base_edge UNION ALL SELECT u.derived, e.base FROM up u JOIN base_edge e ON u.base = e.derived) SELECT DISTINCT derived, base FROM up""")
def r01_closure(spark, sf_dir):
    return graph.closure(base_edge(spark, sf_dir))


@query("""WITH RECURSIVE up AS (SELECT derived, base FROM base_edge UNION ALL SELECT u.derived, e.base FROM up u JOIN base_edge e ON u.base = e.derived JOIN part p ON p.p_partkey = u.base AND p.p_size % 4 <> 0)
    SELECT DISTINCT derived, base FROM up""")
def r01_undefined_bases(spark, sf_dir):
    defined = table(spark, sf_dir, "part").where("p_size % 4 <> 0").select(F.col("p_partkey").alias("derived"))
    return graph.closure(base_edge(spark, sf_dir), defined=defined)


@query("SELECT concat('T', derived) AS symbol, concat('T', base) AS target, true AS is_implementation, true AS is_reference FROM base_edge")
def r02_overrides(spark, sf_dir):
    own = base_edge(spark, sf_dir).select(F.lit("function").alias("node_kind"), F.concat(F.lit("T"), "derived").alias("symbol"), F.array(F.concat(F.lit("T"), "base")).alias("related"))
    return facts.override_relations(own)


@query("""SELECT p_partkey, i AS depth, CASE WHEN i = 1 THEN concat(p_brand, '/') WHEN p_size % 7 = 0 THEN NULL WHEN i = 2 THEN concat(p_brand, '/', p_type, '#') ELSE concat(p_brand, '/', p_type, '#', p_name, '.') END AS scope
    FROM part, (SELECT unnest([1, 2, 3]) AS i) x""")
def r05_scopes(spark, sf_dir):
    parts = F.array(F.concat("p_brand", F.lit("/")), F.when(F.col("p_size") % 7 != 0, F.concat("p_type", F.lit("#"))), F.concat("p_name", F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(facts.scope_symbols(parts)).alias("at", "scope")).select("p_partkey", (F.col("at") + 1).alias("depth"), "scope")


@query("""SELECT concat('f', p_partkey) AS path, 0 AS at, concat(p_brand, '/') AS symbol FROM part UNION ALL SELECT concat('f', p_partkey), 1, concat(p_type, '#') FROM part WHERE p_size % 2 = 0""")
def r06_nested_names(spark, sf_dir):
    q = lambda kind, name, end: F.struct(kind.alias("kind"), F.concat(name, F.lit(end)).alias("symbol"))
    kind = F.when(F.col("p_size") % 2 == 0, "type").otherwise("function")
    own = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.array(q(F.lit("namespace"), F.col("p_brand"), "/"), q(kind, F.col("p_type"), "#")).alias("qualifiers"))
    return facts.nested_names(own)


@query(f"""SELECT enum, ordinal, CASE WHEN ordinal >= {MAX_ENUM_CASES} OR lag(b) OVER (PARTITION BY enum ORDER BY ordinal) IS NULL OR c >= lag(b) OVER (PARTITION BY enum ORDER BY ordinal) THEN doc ELSE '' END AS doc
    FROM (SELECT user_id AS enum, event_id AS ordinal, event_id * 10 AS b, event_id * 10 - (event_id % 2) * 3000 AS c, event_type AS doc FROM events) x""")
def f17_enum_comments(spark, sf_dir):
    e = F.col("event_id")
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("enum"), e.alias("ordinal"), (e * 10).alias("begin"), (e * 10 - (e % 2) * 3000).alias("comment_begin"), F.col("event_type").alias("doc"))
    return facts.enum_docs(own).select("enum", "ordinal", "doc")


#: Kinds that the facts of the queries below go through, with their rule when defined and not local, and otherwise.
_KINDS = ["binding", "class_template", "enum_constant", "record", "function", "var", "decl_ref", "member", "macro_reference", "template_parameter", "namespace", "include"]


def fact(spark, sf_dir):
    """Facts from line items: the kind by part, the file by order, flags by other columns."""
    t, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    return t.select(
        F.col("l_orderkey").alias("task_id"), (p * 10 + F.col("l_linenumber")).alias("seq"), F.get(F.array(*map(F.lit, _KINDS)), (p % 12).cast("int")).alias("node_kind"),
        F.when(F.col("l_suppkey") % 19 == 0, F.lit("")).otherwise(F.concat(F.lit("/proj/h"), p % 40, F.lit(".h"))).alias("path"), (F.col("l_orderkey") % 3).alias("hash"),
        F.when(p % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("cxx . m v$ T"), p, F.lit("#"))).alias("symbol"), (F.col("l_returnflag") == "A").alias("is_definition"), (F.col("l_returnflag") == "R").alias("is_pure_virtual"),
        (F.col("l_linestatus") == "F").alias("canonical_is_definition"), (p % 5 == 0).alias("is_local"), (F.col("l_suppkey") % 17 == 0).alias("is_implicit"), (F.col("l_suppkey") % 13 == 0).alias("is_builtin"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("d "), "l_orderkey", F.lit(" "), p, F.lit(" "), "l_linenumber")).otherwise(F.lit("")).alias("doc"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").cast("int").alias("start_char"), F.col("l_linenumber").alias("end_line"), (F.col("l_quantity").cast("int") + 2).alias("end_char"),
    )


_FACT = f"""(SELECT l_orderkey AS task_id, l_partkey * 10 + l_linenumber AS seq, {_KINDS}[1 + l_partkey % 12] AS node_kind,
    CASE WHEN l_suppkey % 19 = 0 THEN '' ELSE concat('/proj/h', l_partkey % 40, '.h') END AS path, l_orderkey % 3 AS hash, CASE WHEN l_partkey % 23 = 0 THEN '' ELSE concat('cxx . m v$ T', l_partkey, '#') END AS symbol,
    l_returnflag = 'A' AS is_definition, l_returnflag = 'R' AS is_pure, l_linestatus = 'F' AS canonical, l_partkey % 5 = 0 AS is_local, l_suppkey % 17 = 0 AS is_implicit, l_suppkey % 13 = 0 AS is_builtin,
    CASE WHEN l_linenumber % 2 = 0 THEN concat('d ', l_orderkey, ' ', l_partkey, ' ', l_linenumber) ELSE '' END AS doc, l_linenumber AS start_line, CAST(l_quantity AS INT) AS start_char FROM lineitem)"""
_RULE = """CASE WHEN node_kind IN ('binding', 'template_parameter') THEN 'local_definition' WHEN node_kind IN ('enum_constant', 'namespace') THEN 'definition'
    WHEN node_kind IN ('record', 'function') THEN CASE WHEN is_definition OR is_pure THEN 'definition' ELSE 'forward' END
    WHEN node_kind = 'var' THEN CASE WHEN is_local THEN CASE WHEN is_definition THEN 'local_definition' ELSE 'reference' END ELSE 'definition' END
    WHEN node_kind = 'class_template' THEN NULL ELSE CASE WHEN canonical OR is_local THEN 'reference' ELSE 'forward' END END"""
_EMIT = f"""(SELECT *, CASE WHEN inside THEN 'document' WHEN rule = 'definition' THEN 'external' ELSE 'dropped' END AS target FROM (
    SELECT *, {_RULE} AS rule, CAST(regexp_extract(path, 'h([0-9]+)[.]h', 1) AS INT) % 4 <> 0 AS inside FROM {_FACT} f WHERE symbol <> '' AND starts_with(path, '/') AND NOT is_implicit AND NOT is_builtin) y WHERE rule IS NOT NULL)"""


def _emitted(spark, sf_dir):
    own = facts.usable(fact(spark, sf_dir))
    number = F.regexp_extract("path", "h([0-9]+)[.]h", 1).cast("int")
    files = own.select("path").distinct().select("path", F.substr("path", F.lit(7)).alias("stable_path"), (number % 4 != 0).alias("is_in_project"))
    return facts.emit(own, files)


@query(f"SELECT node_kind, rule, target, count(*) AS n FROM {_EMIT} e GROUP BY node_kind, rule, target")
def e00_fact_rules(spark, sf_dir):
    return _emitted(spark, sf_dir).groupBy("node_kind", "rule", "target").agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) FILTER (symbol = '') AS empty_names, count(*) FILTER (path = '') AS no_file, count(*) FILTER (is_implicit) AS implicit, count(*) FILTER (is_builtin) AS builtin,
    count(*) FILTER (symbol <> '' AND path <> '' AND NOT is_implicit AND NOT is_builtin) AS usable FROM {_FACT} f""")
def f15_usable(spark, sf_dir):
    own = fact(spark, sf_dir)
    good = facts.usable(own.withColumn("n", F.lit(1))).agg(F.count("*").alias("usable"))
    zero = F.lit(0).cast("long")
    counts = own.agg(F.count_if(F.col("symbol") == "").alias("empty_names"), F.count_if(F.col("path") == "").alias("no_file"), F.count_if("is_implicit").alias("implicit"), F.count_if("is_builtin").alias("builtin"), F.first(zero).alias("usable"))
    names = ["empty_names", "no_file", "implicit", "builtin", "usable"]
    return counts.union(good.select(zero, zero, zero, zero, "usable")).agg(*[F.sum(n).alias(n) for n in names])


@query(f"SELECT rule, count(*) AS n FROM {_EMIT} e WHERE target = 'document' GROUP BY rule")
def f13_in_project(spark, sf_dir):
    return _emitted(spark, sf_dir).where("target = 'document'").groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""SELECT task_id, symbol, CASE WHEN doc <> '' THEN doc ELSE '{MISSING_DOC}' END AS doc FROM (SELECT task_id, path, symbol, arg_min(doc, (seq, CASE WHEN doc <> '' THEN doc ELSE '{MISSING_DOC}' END)) AS doc
    FROM {_EMIT} e WHERE rule = 'definition' AND target = 'document' GROUP BY task_id, path, symbol) x""")
def a11_first_symbol(spark, sf_dir):
    return facts.document_symbols(_emitted(spark, sf_dir)).select("task_id", "symbol", "doc")


@query(f"SELECT task_id, symbol, coalesce(arg_min(doc, (seq, doc)) FILTER (doc <> ''), '') AS doc FROM {_EMIT} e WHERE rule = 'definition' AND target = 'external' GROUP BY task_id, symbol")
def a12_external_symbol(spark, sf_dir):
    return facts.external_symbols(_emitted(spark, sf_dir))


@query(f"""SELECT task_id, regexp_extract(symbol, '[$] (.*)$', 1) AS suffix, coalesce(arg_min(doc, (seq, doc)) FILTER (doc <> ''), '') AS doc, count(*) AS n FROM {_EMIT} e WHERE rule = 'forward' AND target = 'document' GROUP BY task_id, 2""")
def e06_forward_declarations(spark, sf_dir):
    return facts.forward_declarations(_emitted(spark, sf_dir)).select("task_id", "suffix", "doc", F.size("references").cast("long").alias("n"))


@query(f"""SELECT task_id, symbol, seq, CASE WHEN doc <> '' THEN doc ELSE coalesce(o, '') END AS doc FROM {_FACT} f LEFT JOIN (SELECT symbol AS s, arg_min(doc, (seq, doc)) AS o FROM {_FACT} f WHERE doc <> '' GROUP BY symbol) x ON f.symbol = x.s""")
def e27_declaration_docs(spark, sf_dir):
    return facts.declaration_docs(fact(spark, sf_dir).select("task_id", "symbol", "seq", "doc"))


def _unit_events(spark, sf_dir):
    """Preprocessor events of units, a user each; clicks enter a file, views leave one."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "enter").when(F.col("event_type") == "view", "exit").otherwise("define")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("p"), F.col("event_id") % 7).alias("value"))


# One row per event: the open files (stack) after it, the step that it mixes into a file's hash, and the file that it closes.
_WALK = """WITH RECURSIVE ev AS (
    SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, concat('p', event_id % 7) AS value,
        CASE event_type WHEN 'click' THEN 'enter' WHEN 'view' THEN 'exit' ELSE 'define' END AS kind FROM events),
walk AS (
    SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, path VARCHAR, h VARCHAR)[]) AS stack, CAST(NULL AS STRUCT(id BIGINT, path VARCHAR, h VARCHAR)) AS closed,
        CAST(NULL AS STRUCT(id BIGINT, path VARCHAR, h VARCHAR)) AS step, CAST(NULL AS VARCHAR) AS mixed_value, CAST(NULL AS VARCHAR) AS mix_context, CAST(NULL AS VARCHAR) AS context_data, CAST(NULL AS VARCHAR) AS after FROM ev
    UNION ALL
    SELECT task_id, i, CASE WHEN after IS NULL THEN kept ELSE list_append(kept, {'id': step.id, 'path': step.path, 'h': after}) END, closed, step, mixed_value, mix_context, context_data, after
    FROM (SELECT *, left(md5(concat(step.h, '|', mixed_value)), 16) AS after FROM (
        SELECT task_id, i, closed, CASE WHEN kind = 'enter' THEN {'id': i, 'path': value, 'h': '0'} ELSE top END AS step,
            CASE WHEN kind = 'enter' THEN rest ELSE rest[:len(rest) - 1] END AS kept,
            CASE kind WHEN 'enter' THEN value WHEN 'exit' THEN closed.h ELSE concat(kind, ' ', value) END AS mixed_value,
            CASE kind WHEN 'enter' THEN 'self path' WHEN 'exit' THEN 'hash for #include' ELSE kind END AS mix_context, CASE WHEN kind = 'exit' THEN closed.path END AS context_data
        FROM (SELECT *, rest[len(rest)] AS top FROM (
            SELECT w.task_id, e.i, e.kind, e.value, CASE WHEN kind = 'exit' THEN w.stack[len(w.stack)] END AS closed,
                CASE WHEN kind = 'exit' THEN w.stack[:len(w.stack) - 1] ELSE w.stack END AS rest
            FROM walk w JOIN ev e ON e.task_id = w.task_id AND e.i = w.i + 1) a) b) c
        ) d)
"""


@query(_WALK + "SELECT task_id, closed.path AS path, closed.h AS hash FROM walk WHERE closed.id IS NOT NULL")
def w03_include_hashes(spark, sf_dir):
    return measure.include_hashes(_unit_events(spark, sf_dir))


@query(_WALK + """SELECT w.task_id, CAST(c.passage AS INT) AS passage, c.path, CAST(row_number() OVER (PARTITION BY w.task_id, c.id ORDER BY w.i) - 1 AS INT) AS ord, w.step.h AS before, w.mixed_value, w.mix_context, w.context_data, w.after
    FROM (SELECT * FROM walk WHERE after IS NOT NULL) w JOIN (SELECT task_id, closed.id AS id, closed.path AS path, row_number() OVER (PARTITION BY task_id ORDER BY i) - 1 AS passage FROM walk WHERE closed.id IS NOT NULL) c
    ON w.task_id = c.task_id AND w.step.id = c.id""")
def k06_history(spark, sf_dir):
    return measure.hash_history(_unit_events(spark, sf_dir))


@query("""WITH RECURSIVE p AS (
    SELECT l_orderkey // 20 AS task_id, l_orderkey * 10 + l_linenumber AS ord, concat('/proj/inc/h', l_partkey, '.h') AS path,
        row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY l_orderkey * 10 + l_linenumber) AS i FROM lineitem),
walk AS (
    SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS path, CAST(0 AS BIGINT) AS used, CAST(0 AS INT) AS grp FROM p
    UNION ALL
    SELECT p.task_id, p.i, p.ord, p.path, CASE WHEN w.used > 0 AND w.used + strlen(p.path) + 1 > 4096 THEN 0 ELSE w.used END + strlen(p.path) + 1,
        CAST(w.grp + CASE WHEN w.used > 0 AND w.used + strlen(p.path) + 1 > 4096 THEN 1 ELSE 0 END AS INT)
    FROM walk w JOIN p ON p.task_id = w.task_id AND p.i = w.i + 1)
SELECT task_id, ord, path, grp FROM walk WHERE i > 0""")
def w08_budget_groups(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return measure.budget_groups(d.select(F.expr("l_orderkey DIV 20").alias("task_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("/proj/inc/h"), "l_partkey", F.lit(".h")).alias("path")), 4096)
