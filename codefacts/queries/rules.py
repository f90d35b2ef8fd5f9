"""Queries of the fact rules one by one, over facts of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.functions import symbols
from codefacts.operators import facts
from codefacts.queries import query
from codefacts.sources.adapters import table

KINDS = [*facts.LOCAL_DEFINITIONS, *facts.IGNORED, *facts.DEFINITIONS, *facts.DEFINED_OR_FORWARD, "var", *facts.REFERENCES]
_STATES = ["defined", "undefined", "ambiguous", "builtin"]
_PLACE = ["task_id", "seq", "node_kind", "symbol"]


def every_fact(spark, sf_dir, items=None, *more):
    """Facts of all kinds from line items: the kind by order and line, the file by part, flags and related symbols by other columns; with more columns of items, if asked."""
    t = table(spark, sf_dir, "lineitem") if items is None else items
    p, s, o, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    name = lambda k: F.concat(F.lit("cxx . m v$ T"), k, F.lit("#"))
    return t.select(
        o.alias("task_id"), (p * 10 + n).alias("seq"), F.get(F.array(*map(F.lit, KINDS)), ((o * 7 + n) % len(KINDS)).cast("int")).alias("node_kind"),
        F.when(s % 19 == 0, F.lit("")).otherwise(F.expr("concat('/proj/h', l_partkey DIV 4, '.h')")).alias("path"), F.when(p % 23 == 0, F.lit("")).otherwise(name(p)).alias("symbol"),
        F.when(s % 3 == 0, F.array().cast("array<string>")).when(s % 3 == 1, F.array(name(s))).otherwise(F.array(name(s), name(o), F.lit(""))).alias("related"),
        (F.col("l_returnflag") == "A").alias("is_definition"), (F.col("l_returnflag") == "R").alias("is_pure_virtual"), (F.col("l_linestatus") == "F").alias("canonical_is_definition"),
        (p % 5 == 0).alias("is_local"), (s % 17 == 0).alias("is_implicit"), F.lit(False).alias("is_builtin"), F.get(F.array(*map(F.lit, _STATES)), (p % 4).cast("int")).alias("macro_state"),
        (p % 7 != 0).alias("is_identifier"), (s % 4 == 0).alias("is_structured"), (s % 5 == 0).alias("is_own_definition"), F.lit("").alias("doc"), n.alias("start_line"), F.col("l_quantity").cast("int").alias("start_char"), *more,
    )


_EVERY = f"""(SELECT l_orderkey AS task_id, l_partkey * 10 + l_linenumber AS seq, {KINDS}[1 + (l_orderkey * 7 + l_linenumber) % {len(KINDS)}] AS node_kind,
    CASE WHEN l_suppkey % 19 = 0 THEN '' ELSE concat('/proj/h', l_partkey // 4, '.h') END AS path, CASE WHEN l_partkey % 23 = 0 THEN '' ELSE concat('cxx . m v$ T', l_partkey, '#') END AS symbol,
    CASE l_suppkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [concat('cxx . m v$ T', l_suppkey, '#')] ELSE [concat('cxx . m v$ T', l_suppkey, '#'), concat('cxx . m v$ T', l_orderkey, '#'), ''] END AS related,
    l_returnflag = 'A' AS is_definition, l_returnflag = 'R' AS is_pure, l_linestatus = 'F' AS canonical, l_partkey % 5 = 0 AS is_local, l_suppkey % 17 = 0 AS is_implicit, {_STATES}[1 + l_partkey % 4] AS macro_state,
    l_partkey % 7 <> 0 AS is_identifier, l_suppkey % 4 = 0 AS is_structured, l_suppkey % 5 = 0 AS is_own_definition FROM lineitem)"""
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_USABLE = """symbol <> '' AND starts_with(path, '/') AND NOT is_implicit AND (node_kind <> 'macro_reference' OR macro_state = 'defined') AND (node_kind NOT IN ('member', 'dependent_member', 'unresolved_member') OR is_identifier)"""
_RULE = f"""CASE WHEN node_kind IN {_IN(facts.IGNORED)} OR node_kind = 'var' AND is_structured OR node_kind IN ('enum_type', 'record_type') AND is_own_definition THEN NULL
    WHEN node_kind IN {_IN(facts.LOCAL_DEFINITIONS)} THEN 'local_definition' WHEN node_kind IN {_IN(facts.DEFINITIONS)} THEN 'definition'
    WHEN node_kind IN {_IN(facts.DEFINED_OR_FORWARD)} THEN CASE WHEN is_definition OR is_pure THEN 'definition' ELSE 'forward' END
    WHEN node_kind = 'var' THEN CASE WHEN NOT is_local THEN 'definition' WHEN is_definition THEN 'local_definition' ELSE 'reference' END
    WHEN canonical OR is_local THEN 'reference' ELSE 'forward' END"""
_RULED = f"(SELECT task_id, seq, node_kind, symbol, {_RULE} AS rule FROM {_EVERY} f WHERE {_USABLE})"


def _ruled(spark, sf_dir):
    own = facts.usable(every_fact(spark, sf_dir))
    files = own.select("path", F.substr("path", F.lit(7)).alias("stable_path"), F.lit(True).alias("is_in_project")).distinct()
    return facts.emit(own, files).select(*_PLACE, "rule")


def _rule_query(name: str, kinds: tuple[str, ...], doc: str) -> None:
    """Register a query of the rule that facts of some kinds follow."""

    def run(spark, sf_dir):
        return _ruled(spark, sf_dir).where(F.col("node_kind").isin(*kinds))

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT * FROM {_RULED} r WHERE rule IS NOT NULL AND node_kind IN {_IN(kinds)}")(run)


_rule_query("e05_fields", ("field",), "Fields are definitions.")
_rule_query("e08_template_parameters", ("template_parameter", "template_template_parameter", "non_type_template_parameter"), "Template parameters are local definitions.")
_rule_query("e09_typedefs", ("typedef_name",), "Typedef names are definitions.")
_rule_query("e11_variables", ("var", "binding"), "Variables by their scope; a structured binding counts by its bindings only.")
_rule_query("e12_kernel_calls", ("cuda_kernel_call",), "Kernel calls are references.")
_rule_query("e13_constructor_calls", ("constructor_call",), "Constructor calls are references unless they are implicit.")
_rule_query("e18_type_locations", ("enum_type", "record_type", "template_specialization_type", "typedef_type", "using_type", "template_parameter_type"), "Locations of types are references, but for the definition of the type itself.")
_rule_query("e20_initializers", ("initializer", "constructor_initializer"), "Initializers are references to fields.")
_rule_query("e21_macros", ("macro_definition", "macro_reference"), "Macros: definitions, and references to those that are defined.")
_rule_query("f16_identifiers", ("member", "dependent_member", "unresolved_member"), "Members count if their names are identifiers.")


@query(f"SELECT node_kind, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM {_RULED} r WHERE rule IS NOT NULL GROUP BY node_kind")
def e00_every_kind(spark, sf_dir):
    return _ruled(spark, sf_dir).groupBy("node_kind").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("n_symbols"))


def _related_query(name: str, kinds: tuple[str, ...], doc: str) -> None:
    def run(spark, sf_dir):
        own = facts.related_references(facts.usable(every_fact(spark, sf_dir))).where(F.col("node_kind").isin(*kinds))
        return own.select(*_PLACE, "rule")

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT task_id, seq, node_kind, other AS symbol, 'reference' AS rule FROM (SELECT *, unnest(related) AS other FROM {_EVERY} f WHERE {_USABLE} AND node_kind IN {_IN(kinds)}) x WHERE other <> ''")(run)


_related_query("e04_specializations", ("enum", "record", "function"), "A specialization refers to what it specializes.")
_related_query("e10_using_targets", ("using", "using_shadow"), "A using declaration refers to its targets.")
_related_query("e17_candidates", ("dependent_member", "unresolved_member"), "A dependent member refers to each candidate.")


@query(f"SELECT DISTINCT task_id, symbol, '' AS doc FROM {_EVERY} f WHERE node_kind = 'macro_definition' AND path = '' AND symbol <> ''")
def e22_macros_without_file(spark, sf_dir):
    return facts.macros_without_file(every_fact(spark, sf_dir))


@query("""SELECT page_id, concat('/', page_id, '.h') AS path, concat('cxx . . .$ `<file>/', page_id, '.h`/') AS symbol, concat('File: ', page_id, '.h') AS doc,
    CASE WHEN page_id % 5 = 0 THEN 0 ELSE page_id % 9 END AS start_line, CASE WHEN page_id % 5 = 0 THEN 0 ELSE page_id % 9 + 3 END AS end_char FROM pages WHERE page_id % 4 <> 1 AND page_id % 3 <> 1""")
def e23_files(spark, sf_dir):
    p = F.col("page_id")
    at = F.when(p % 5 != 0, p % 9)
    own = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/"), p, F.lit(".h")).alias("path"), F.concat(p, F.lit(".h")).alias("stable_path"), (p % 4 != 1).alias("is_in_project"), (p % 3 == 1).alias("is_synthetic"),
        at.alias("start_line"), at.alias("start_char"), at.alias("end_line"), (at + 3).alias("end_char"),
    )
    return facts.file_definitions(own).select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("page_id"), "path", "symbol", "doc", "start_line", "end_char")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('cxx . m v$ ns', p_size, '/`E ', p_partkey, '`#c', p_size, '.') ELSE concat('cxx . m v$ ns', p_size, '/c', p_size, '.') END AS symbol FROM part""")
def e03_enum_scopes(spark, sf_dir):
    enum = F.concat(F.lit("cxx . m v$ ns"), "p_size", F.lit("/`E "), "p_partkey", F.lit("`#"))
    return table(spark, sf_dir, "part").select("p_partkey", symbols.enum_constant(enum, F.concat(F.lit("c"), "p_size"), F.col("p_size") % 2 == 0).alias("symbol"))
