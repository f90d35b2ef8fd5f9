"""Queries of places and scopes: `#line` directives, ranges over several lines, scopes from parent links."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators import places, scopes
from codefacts.queries import query
from codefacts.sources.adapters import table


def _located(spark, sf_dir):
    """Facts of line items, a thousand lines an order; one in three is a macro, whose token is spelt 500 lines further down."""
    n, o, q = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_quantity").cast("int")
    line = (o % 20) * 1000 + n * 90
    own = {"start_line": line, "start_char": q, "end_line": line + F.col("l_suppkey") % 40, "end_char": q + 5}
    moved = {f"spelling_{c}": x + (500 if c.endswith("line") else 0) for c, x in own.items()}
    kind = F.when(F.col("l_partkey") % 3 == 0, "macro_reference").otherwise("decl_ref")
    cols = {"path": F.expr("concat('src/f', l_orderkey DIV 20, '.cc')"), "task_id": o, "seq": n, "node_kind": kind, **own, **moved}
    return table(spark, sf_dir, "lineitem").select(*[c.alias(name) for name, c in cols.items()])


def _directives(spark, sf_dir):
    """`#line` directives: one an order whose number isn't divisible by three, in its thousand lines."""
    o = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").where(o % 3 != 0)
    return own.select(F.expr("concat('src/f', o_orderkey DIV 20, '.cc')").alias("path"), ((o % 20) * 1000 + F.col("o_custkey") % 700).alias("line"), (F.col("o_custkey") % 3000 + 1).alias("says"))


@query("""WITH f AS (
    SELECT concat('src/f', l_orderkey // 20, '.cc') AS path, l_orderkey AS task_id, l_linenumber AS seq, CASE WHEN l_partkey % 3 = 0 THEN 'macro_reference' ELSE 'decl_ref' END AS node_kind,
        (l_orderkey % 20) * 1000 + l_linenumber * 90 + CASE WHEN l_partkey % 3 = 0 THEN 500 ELSE 0 END AS line, l_suppkey % 40 AS more, CAST(l_quantity AS INT) AS start_char FROM lineitem),
d AS (SELECT concat('src/f', o_orderkey // 20, '.cc') AS path, (o_orderkey % 20) * 1000 + o_custkey % 700 AS at, max(o_custkey % 3000 + 1) AS says FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2)
SELECT f.task_id, f.seq, f.node_kind, f.path, coalesce(a.says + f.line - a.at - 1, f.line) AS start_line, f.start_char, coalesce(b.says + f.line + f.more - b.at - 1, f.line + f.more) AS end_line
FROM f ASOF LEFT JOIN d a ON f.path = a.path AND f.line > a.at ASOF LEFT JOIN d b ON f.path = b.path AND f.line + f.more > b.at""")
def e26_presumed(spark, sf_dir):
    own = places.presumed(places.located(_located(spark, sf_dir)), _directives(spark, sf_dir))
    return own.select("task_id", "seq", "node_kind", "path", "start_line", "start_char", "end_line")


@query("""WITH r AS (SELECT DISTINCT concat('src/f', l_orderkey // 20, '.cc') AS relative_path, l_linenumber * 3 AS sl, CAST(l_quantity AS INT) AS sc, l_linenumber * 3 + l_suppkey % 11 AS el,
        CAST(l_quantity AS INT) + 1 + l_partkey % 30 AS ec, concat('T', l_partkey) AS symbol FROM lineitem),
p AS (SELECT DISTINCT concat('src/f', o_orderkey // 20, '.cc') AS relative_path, CAST(o_orderkey % 31 AS INT) AS line, CAST(o_custkey % 53 AS INT) AS char FROM orders)
SELECT p.*, r.symbol, r.sl AS start_line, r.sc AS start_char, r.el AS end_line, r.ec AS end_char, dense_rank() OVER (PARTITION BY p.relative_path, p.line, p.char ORDER BY r.sl DESC, r.sc DESC, r.el, r.ec) AS depth
FROM p JOIN r ON r.relative_path = p.relative_path AND p.line BETWEEN r.sl AND r.el AND (p.line > r.sl OR p.char >= r.sc) AND (p.line < r.el OR p.char < r.ec)""")
def n01_enclosing(spark, sf_dir):
    """All ranges, over up to eleven lines, that hold a place, innermost first."""
    n, q, o = F.col("l_linenumber") * 3, F.col("l_quantity").cast("int"), F.col("o_orderkey")
    path = lambda key: F.expr(f"concat('src/f', {key} DIV 20, '.cc')").alias("relative_path")
    spans = table(spark, sf_dir, "lineitem").select(
        path("l_orderkey"), F.concat(F.lit("T"), "l_partkey").alias("symbol"), n.alias("start_line"), q.alias("start_char"), (n + F.col("l_suppkey") % 11).alias("end_line"), (q + 1 + F.col("l_partkey") % 30).alias("end_char"),
    )
    asked = table(spark, sf_dir, "orders").select(path("o_orderkey"), (o % 31).cast("int").alias("line"), (F.col("o_custkey") % 53).cast("int").alias("char"))
    return places.holding(spans, asked).withColumn("depth", F.col("depth").cast("long"))


@query("""WITH RECURSIVE n AS (
    SELECT p_partkey AS node_id, CASE WHEN p_partkey % 40 <> 1 AND p_partkey > 0 THEN p_partkey - 1 WHEN p_partkey > 1 THEN p_partkey // 80 + 1 END AS parent_id,
        CASE WHEN p_size % 50 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN concat(p_brand, '/') WHEN p_partkey % 3 = 1 THEN concat('T', p_partkey, '#') ELSE concat('f', p_size, '(', p_partkey, ').') END AS descriptor FROM part),
down AS (SELECT node_id, descriptor AS scope FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, d.scope || n.descriptor FROM down d JOIN n ON n.parent_id = d.node_id)
SELECT node_id, scope FROM down""")
def r05_parents(spark, sf_dir):
    """Scopes of parts: chains of forty, each of which hangs on a node of an earlier chain; some nodes are contexts without a name."""
    p = F.col("p_partkey")
    parent = F.when((p % 40 != 1) & (p > 0), p - 1).when(p > 1, F.expr("p_partkey DIV 80") + 1)
    name = F.when(p % 3 == 0, F.concat("p_brand", F.lit("/"))).when(p % 3 == 1, F.concat(F.lit("T"), p, F.lit("#"))).otherwise(F.concat(F.lit("f"), "p_size", F.lit("("), p, F.lit(").")))
    nodes = table(spark, sf_dir, "part").select(p.alias("node_id"), parent.alias("parent_id"), F.when(F.col("p_size") % 50 != 0, name).alias("descriptor"))
    return scopes.scope_paths(nodes).select("node_id", "scope")
