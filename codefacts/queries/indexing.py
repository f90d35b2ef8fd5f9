"""Queries from facts to the stored index: one plan over facts of every kind, whose parts are read back from where it was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.functions.symbols import FAKE_PREFIX
from codefacts.operators import places
from codefacts.operators.tables import durable, fresh_path
from codefacts.plans import index
from codefacts.queries import query, rules
from codefacts.queries.rules import _IN, _RULE, _USABLE
from codefacts.schema import MISSING_DOC
from codefacts.sources.adapters import base_edge, table

_PREFIX = "cxx . m v$ T"


def _facts(spark, sf_dir):
    """Facts of every kind with content hashes, ranges, documentation, and overrides of methods."""
    raw = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    key = F.col("l_partkey") * 10 + F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(*raw).where(F.col("l_orderkey").isNotNull() & key.isNotNull())
    # Facts meet the rest of what is known of them by order and number. Both come from the same rows, so these are shuffled once, as they are in the table.
    alike = items.groupBy("l_orderkey", key.alias("_key")).agg(F.collect_list(F.struct(*raw)).alias("_of"))
    each = alike.select("_of", F.explode("_of").alias("_one")).select("_one.*", F.explode("_of").alias("_other"))
    n, s, q, o, p = F.col("_other.l_linenumber"), F.col("_other.l_suppkey"), F.col("_other.l_quantity").cast("int"), F.col("_other.l_orderkey"), F.col("_other.l_partkey")
    more = [
        (s % 2).alias("hash"), n.alias("_line"), q.alias("_char"), n.alias("end_line"), (q + 2).alias("end_char"),
        F.when(n % 2 == 0, F.concat(F.lit("d "), o, F.lit(" "), p)).otherwise(F.lit("")).alias("text"), F.when(s % 5 == 1, F.array(F.concat(F.lit(_PREFIX), s, F.lit("#")))).alias("overrides"),
    ]
    own = rules.every_fact(spark, sf_dir, each, *more)
    # Line items of one order, part and number are facts at each other's ranges, so both ends of a range come from the same one.
    own = own.withColumns({"doc": F.col("text"), "start_line": F.col("_line"), "start_char": F.col("_char")}).drop("text", "_line", "_char")
    return own.withColumn("seq", F.col("task_id") * 10 + F.col("start_line")).withColumn("task_id", F.expr("task_id DIV 50"))  # fifty orders a unit


def _files(spark, sf_dir):
    """The files that parts lie in: one in four is outside the project, and some have a first token."""
    k = F.expr("p_partkey DIV 4")
    own = table(spark, sf_dir, "part").select(k.alias("k")).distinct()
    at = lambda x: F.when(F.col("k") % 3 == 0, x).alias
    return own.select(
        F.concat(F.lit("/proj/h"), "k", F.lit(".h")).alias("path"), F.concat(F.lit("h"), "k", F.lit(".h")).alias("stable_path"), (F.col("k") % 4 != 0).alias("is_in_project"), (F.col("k") % 9 == 1).alias("is_synthetic"),
        at(F.lit(2))("start_line"), at(F.lit(1))("start_char"), at(F.lit(2))("end_line"), at(F.lit(5))("end_char"),
    )


def _includes(own):
    """Includes of units: a fact of kind include refers to the file of its own part's number, less one."""
    of = F.regexp_extract("path", "h([0-9]+)[.]h", 1).cast("long")
    return own.where("node_kind = 'include' AND path <> ''").select("task_id", "path", "hash", F.concat(F.lit("/proj/h"), of - 1, F.lit(".h")).alias("target"), *places.PLACE)


def _stored(spark, sf_dir, part):
    """A part of the index that the facts make, written and read back."""
    own = durable(_facts(spark, sf_dir))  # many steps read it
    seen = own.where("path <> ''").select("task_id", "path", "hash").distinct()
    edges = base_edge(spark, sf_dir).select(*[F.concat(F.lit(_PREFIX), c, F.lit("#")).alias(c) for c in ("derived", "base")])
    whole = index.index_from_facts(own, _files(spark, sf_dir), seen, "/proj", includes=_includes(own), bases=edges)
    path = fresh_path(spark, "index")
    index.write_index(whole, path)
    return index.read_index(spark, path)[part]


_MADE = f"""WITH RECURSIVE e AS (
    SELECT f.* REPLACE (f.task_id // 50 AS task_id, l.l_orderkey * 10 + l.l_linenumber AS seq), l.l_suppkey % 2 AS hash, l.l_linenumber AS sl, CAST(l.l_quantity AS INT) AS sc, l.l_linenumber AS el, CAST(l.l_quantity AS INT) + 2 AS ec,
        CASE WHEN l.l_linenumber % 2 = 0 THEN concat('d ', l.l_orderkey, ' ', l.l_partkey) ELSE '' END AS text, CASE WHEN l.l_suppkey % 5 = 1 THEN concat('{_PREFIX}', l.l_suppkey, '#') END AS override
    FROM {rules._EVERY} f JOIN lineitem l ON f.task_id = l.l_orderkey AND f.seq = l.l_partkey * 10 + l.l_linenumber),
files AS (SELECT DISTINCT p_partkey // 4 AS k, concat('/proj/h', p_partkey // 4, '.h') AS path, concat('h', p_partkey // 4, '.h') AS stable, (p_partkey // 4) % 4 <> 0 AS inside, (p_partkey // 4) % 9 = 1 AS synthetic FROM part),
claims AS (SELECT path, hash, min(task_id) AS task_id FROM e WHERE path <> '' GROUP BY path, hash),
good AS (SELECT e.* FROM e JOIN claims USING (task_id, path, hash) WHERE {_USABLE}),
docs AS (SELECT task_id, symbol, arg_min(text, (seq, text)) AS other FROM good WHERE text <> '' GROUP BY task_id, symbol),
g AS (SELECT good.* EXCLUDE (text), CASE WHEN text <> '' THEN text ELSE coalesce(other, '') END AS doc FROM good LEFT JOIN docs USING (task_id, symbol)),
r0 AS (SELECT g.*, stable, coalesce(inside, false) AS inside, {_RULE} AS rule FROM g LEFT JOIN files USING (path)),
r1 AS (SELECT *, CASE WHEN inside THEN 'document' WHEN rule = 'definition' THEN 'external' ELSE 'dropped' END AS target,
    row_number() OVER (PARTITION BY task_id, path, sl, sc, el, ec, node_kind IN {_IN(places.SPELT)} ORDER BY seq) AS nth FROM r0 WHERE rule IS NOT NULL),
r AS (SELECT * FROM r1 WHERE nth = 1 OR node_kind NOT IN {_IN(places.SPELT)}),
tops AS (SELECT stable, concat('cxx . . .$ `<file>/', stable, '`/') AS symbol, concat('File: ', stable) AS doc, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS sl, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS sc,
    CASE WHEN k % 3 = 0 THEN 5 ELSE 0 END AS ec, t.task_id FROM files JOIN (SELECT path, min(task_id) AS task_id FROM claims GROUP BY path) t USING (path) WHERE inside AND NOT synthetic),
inc AS (SELECT f.stable, concat('cxx . . .$ `<file>/', t.stable, '`/') AS symbol, sl, sc, el, ec FROM (SELECT * FROM e JOIN claims USING (task_id, path, hash) WHERE node_kind = 'include') x JOIN files f ON f.path = x.path AND f.inside
    JOIN files t ON t.path = concat('/proj/h', CAST(regexp_extract(x.path, 'h([0-9]+)[.]h', 1) AS BIGINT) - 1, '.h')),
occ AS (
    SELECT stable, symbol, sl, sc, el, ec, CASE WHEN rule = 'reference' THEN 0 ELSE 1 END AS roles FROM r WHERE target = 'document' AND rule <> 'forward'
    UNION SELECT f.stable, x.other, sl, sc, el, ec, 0 FROM (SELECT *, unnest(related) AS other FROM g WHERE node_kind IN ('using', 'using_shadow', 'enum', 'record', 'function', 'dependent_member', 'unresolved_member')) x JOIN files f ON f.path = x.path AND f.inside WHERE other <> ''
    UNION SELECT stable, symbol, sl, sc, sl, ec, 1 FROM tops UNION SELECT stable, symbol, sl, sc, el, ec, 0 FROM inc),
multi AS (SELECT stable, count(DISTINCT hash) > 1 AS is_multi FROM e JOIN files USING (path) GROUP BY stable),
recs AS (SELECT task_id, stable, symbol, regexp_extract(symbol, '[$] (.*)$', 1) AS suffix, doc, coalesce(is_multi, false) AS is_multi FROM (
    SELECT task_id, stable, symbol, arg_min(CASE WHEN doc <> '' THEN doc ELSE '{MISSING_DOC}' END, (seq, CASE WHEN doc <> '' THEN doc ELSE '{MISSING_DOC}' END)) AS doc FROM r WHERE rule = 'definition' AND target = 'document' GROUP BY task_id, stable, symbol
    UNION ALL SELECT task_id, stable, symbol, doc FROM tops) x LEFT JOIN multi USING (stable)),
ext0 AS (SELECT task_id, symbol, coalesce(arg_min(doc, (seq, doc)) FILTER (doc <> ''), '') AS doc FROM r WHERE rule = 'definition' AND target = 'external' GROUP BY task_id, symbol
    UNION ALL SELECT DISTINCT task_id, symbol, '' FROM e WHERE node_kind = 'macro_definition' AND path = '' AND symbol <> ''),
ext AS (SELECT symbol, regexp_extract(symbol, '[$] (.*)$', 1) AS suffix, coalesce(arg_min(doc, (task_id, doc)) FILTER (doc <> ''), '{MISSING_DOC}') AS doc FROM ext0 GROUP BY symbol),
fwd AS (SELECT r.task_id, regexp_extract(symbol, '[$] (.*)$', 1) AS suffix, stable, sl, sc, el, ec, r.doc, r.seq FROM r WHERE rule = 'forward' AND target = 'document' AND contains(symbol, '$ ')),
fdoc AS (SELECT suffix, arg_min(doc, (task_id, seq, doc)) AS offer FROM fwd WHERE doc <> '' GROUP BY suffix),
first AS (SELECT suffix, arg_min(symbol, (is_multi, task_id, stable, strlen(symbol), symbol)) AS symbol FROM recs WHERE suffix <> '' GROUP BY suffix),
found AS (SELECT s.suffix, coalesce(f.symbol, x.symbol, concat('{FAKE_PREFIX}', s.suffix)) AS symbol, f.symbol IS NULL AND x.symbol IS NULL AS invented, f.symbol IS NOT NULL AS known
    FROM (SELECT DISTINCT suffix FROM fwd) s LEFT JOIN first f USING (suffix) LEFT JOIN ext x ON x.suffix = s.suffix AND f.symbol IS NULL),
offers AS (SELECT symbol, min(offer) AS offer FROM found JOIN fdoc USING (suffix) GROUP BY symbol),
up AS (SELECT derived, base FROM base_edge UNION ALL SELECT u.derived, b.base FROM up u JOIN base_edge b ON u.base = b.derived),
rel AS (SELECT concat('{_PREFIX}', derived, '#') AS symbol, concat('{_PREFIX}', base, '#') AS target, false AS is_reference FROM up WHERE derived <> base UNION SELECT symbol, override, true FROM g WHERE node_kind = 'function' AND override IS NOT NULL)
"""


@query(_MADE + """SELECT stable AS relative_path, symbol, sl AS start_line, sc AS start_char, el AS end_line, ec AS end_char, roles FROM occ
    UNION ALL SELECT stable, symbol, sl, sc, el, ec, 0 FROM fwd JOIN found USING (suffix)""")
def i01_index_occurrences(spark, sf_dir):
    return _stored(spark, sf_dir, "documents").select("relative_path", F.explode("occurrences").alias("o")).select("relative_path", "o.*")


@query(_MADE + f"""SELECT stable AS relative_path, symbol, CASE WHEN doc <> '{MISSING_DOC}' THEN doc ELSE coalesce(offer, doc) END AS doc, coalesce(n, 0) AS n_relations FROM (
    SELECT stable, symbol, coalesce(arg_min(doc, (is_multi, task_id, doc)) FILTER (doc <> '' AND doc <> '{MISSING_DOC}'), '{MISSING_DOC}') AS doc FROM recs GROUP BY stable, symbol) x
    LEFT JOIN offers USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM rel GROUP BY symbol) y USING (symbol)""")
def i01_index_symbols(spark, sf_dir):
    own = _stored(spark, sf_dir, "documents").select("relative_path", F.explode("symbols").alias("s"))
    return own.select("relative_path", "s.symbol", "s.doc", F.size("s.relationships").cast("long").alias("n_relations"))


@query(_MADE + f"""SELECT symbol, doc, coalesce(n, 0) AS n_relations FROM (
    SELECT symbol, CASE WHEN doc <> '{MISSING_DOC}' THEN doc ELSE coalesce(offer, doc) END AS doc FROM ext LEFT JOIN offers USING (symbol) WHERE suffix NOT IN (SELECT suffix FROM found WHERE known)
    UNION ALL SELECT symbol, coalesce(offer, '{MISSING_DOC}') FROM found LEFT JOIN offers USING (symbol) WHERE invented) x LEFT JOIN (SELECT symbol, count(*) AS n FROM rel GROUP BY symbol) y USING (symbol)""")
def i01_index_external(spark, sf_dir):
    return _stored(spark, sf_dir, "external_symbols").select("symbol", "doc", F.size("relationships").cast("long").alias("n_relations"))
