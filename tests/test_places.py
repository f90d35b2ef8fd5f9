"""Places: directives in blocks, ranges over several lines, scopes from parents, scans in blocks, all against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codefacts.operators import facts, navigate, places, render, scopes, tables

RANGE = "start_line int, start_char int, end_line int, end_char int"


def test_presumed_lines(spark):
    """Directives before, between and after ranges, over many blocks, two on one line, files without any."""
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(4)}", a := rng.randrange(1, 300), 1, a + rng.choice((0, 0, 3, 90)), 5) for _ in range(300)]
    said = [(f"p{rng.randrange(3)}", rng.randrange(1, 260), rng.randrange(1, 999)) for _ in range(40)] + [("p0", 7, 5), ("p0", 7, 9), ("p9", 1, 1), (None, 1, 2), ("p0", None, 3)]

    def want(path, line):
        before = [(at, says) for p, at, says in said if p == path and at is not None and at < line]
        if not before:
            return line
        at, says = max(before)
        return says + line - at - 1

    table, directives = spark.createDataFrame(rows, f"path string, {RANGE}"), spark.createDataFrame(said, "path string, line int, says int")
    for block in (16, 1024):
        got = sorted(tuple(r) for r in places.presumed(table, directives, block).select("path", *places.PLACE).collect())
        assert got == sorted((p, want(p, a), b, want(p, c), d) for p, a, b, c, d in rows)
    assert places.presumed(table, directives.limit(0)).count() == len(rows)


def test_macros_stand_where_they_are_spelt(spark):
    rows = [("macro_reference", 1, 1, 1, 4, 9, 2, 9, 5), ("decl_ref", 1, 1, 1, 4, 9, 2, 9, 5), ("macro_definition", 1, 1, 1, 4, None, None, None, None)]
    spelt = ", ".join(f"spelling_{c} int" for c in places.PLACE)
    order = [f"{p}{c}" for p in ("", "spelling_") for c in places.PLACE]
    table = spark.createDataFrame(rows, "node_kind string, " + RANGE.replace("end_line", "end_line") + ", " + spelt.replace("spelling_start_line", "spelling_start_line"))
    table = table.toDF("node_kind", "start_line", "start_char", "end_line", "end_char", *[f"spelling_{c}" for c in ("start_line", "start_char", "end_line", "end_char")])
    assert len(order) == 8
    assert [tuple(r) for r in places.located(table).select("start_line", "start_char", "end_line", "end_char").collect()] == [(9, 2, 9, 5), (1, 1, 1, 4), (1, 1, 1, 4)]


def test_line_intervals(spark):
    """The intervals of any range of lines are disjoint, cover it, and are at most two of a length."""
    ends = [(a, b) for a in range(0, 70, 3) for b in range(a, 200, 7)] + [(0, 2**29), (5, 2**30 - 1)]
    got = spark.createDataFrame(ends, "a long, b long").select("a", "b", places.line_intervals(F.col("a"), F.col("b")).alias("of")).collect()
    for a, b, of in got:
        spans = sorted((n << k, (n + 1) << k) for k, n in of)
        assert spans[0][0] == a and spans[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert max(sum(k == x.level for x in of) for k in {x.level for x in of}) <= 2


def test_ranges_that_hold_a_place(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b = sorted((rng.randrange(60), rng.randrange(60))) if i % 2 else [rng.randrange(60)] * 2
        c, d = rng.randrange(20), rng.randrange(20)
        rows.append((f"f{i % 3}", f"s{i % 50}", a, min(c, d) if a == b else c, b, max(c, d) if a == b else d, i % 2))
    asked = [(f"f{rng.randrange(4)}", rng.randrange(64), rng.randrange(22)) for _ in range(200)]
    table = spark.createDataFrame(rows, f"relative_path string, symbol string, {RANGE}, roles int")
    points = spark.createDataFrame(asked, "relative_path string, line int, char int")
    want = {}
    for path, line, char in set(asked):
        hits = {r for r in rows if r[0] == path and (r[2], r[3]) <= (line, char) < (r[4], r[5])}
        keys = sorted({(-r[2], -r[3], r[4], r[5]) for r in hits})
        for r in hits:
            k = (path, line, char, r[1])
            want[k] = min(want.get(k, 999), keys.index((-r[2], -r[3], r[4], r[5])) + 1)
    assert {(r.relative_path, r.line, r.char, r.symbol): r.depth for r in navigate.at_position(table, points).collect()} == want
    assert navigate.at_position(table.limit(0), points).count() == 0 and navigate.at_position(table, points.limit(0)).count() == 0


def test_rows_are_made_different_before_they_meet(spark):
    """What holds a place is many times the ranges, so it isn't shuffled once more to find equal rows."""
    table = spark.createDataFrame([("f", "s#", 0, 2, 5, 1)] * 3 + [("f", "t#", 1, 0, 1, 9)], f"relative_path string, symbol string, {RANGE}")
    out = places.holding(table, spark.createDataFrame([("f", 1, 4), ("f", 1, 4), ("f", 3, 0)], "relative_path string, line int, char int"))
    assert sorted((r.line, r.symbol, r.depth) for r in out.collect()) == [(1, "s#", 2), (1, "t#", 1), (3, "s#", 1)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "Window" in above and "Aggregate" not in above


def test_snapshot_of_several_lines(spark):
    lines = spark.createDataFrame([("f", 1, "abcdef"), ("f", 2, "gh"), ("f", 3, "")], "relative_path string, line_no int, text string")
    occ = spark.createDataFrame([("f", "s#", 0, 2, 2, 1, 1), ("f", "s#", 0, 2, 0, 3, 0), ("f", "t#", 2, 0, 4, 1, 0)], f"relative_path string, symbol string, {RANGE}, roles int")
    got = {r.line_no: r.snapshot.split("\n")[1:] for r in render.snapshot(lines, occ).collect()}
    assert [x.split()[0] for x in got[1]] == ["//", "//"] and [x.count("^") for x in got[1]] == [1, 4] and got[2] == [] and got[3][0].count("^") == 1


def test_scopes_from_parents(spark):
    rng = random.Random(3)
    parent = {i: (None if i == 0 else rng.randrange(max(0, i - 3), i)) for i in range(300)} | {400: 399, 401: 400}
    name = {i: None if i % 37 == 5 else f"n{i}/" for i in parent}

    def want(i):
        if name[i] is None:
            return None
        p = parent[i]
        above = "" if p not in parent else want(p)
        return None if above is None else above + name[i]

    nodes = spark.createDataFrame([(i, p, name[i]) for i, p in parent.items()] + [(None, 3, "x")], "node_id int, parent_id int, descriptor string")
    got = scopes.scope_paths(nodes).collect()
    assert {r.node_id: r.scope for r in got if r.node_id is not None} == {i: want(i) for i in parent} and len(got) == len(parent) + 1
    loop = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "node_id int, parent_id int, descriptor string")
    with pytest.raises(ValueError):
        scopes.scope_paths(loop, rounds=5)
    row = spark.sql("SELECT array('a/', null, 'b#') AS d, array('a/') AS e").select(facts.scope_symbols(F.col("d")), facts.scope_symbols(F.col("e"))).first()
    assert list(row) == [["a/", None, None], ["a/"]]


def test_scans_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(-3, 4)) for k in ("a", "b", None) for i in range(rng.randrange(1, 60))]
    placed = tables.numbered(spark.createDataFrame(rows, "k string, i int, x int"), [F.col("k"), F.col("i")], "place").where("k IS NOT NULL")
    got = {(r.k, r.i): (r.total, r.low) for r in tables.scan(placed, ["k"], "place", 7, total=("sum", F.col("x")), low=("min", F.col("x"))).collect()}
    for k in "ab":
        own = [x for key, _, x in rows if key == k]
        assert [got[k, i] for i in range(len(own))] == [(sum(own[: i + 1]), min(own[: i + 1])) for i in range(len(own))]
