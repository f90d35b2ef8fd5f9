"""The whole index, written and read back; readers of shards and lines; traces and histories against brute force."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codefacts.functions import symbols
from codefacts.operators import facts, measure, merge, packages, planning, render, tables
from codefacts.plans import index
from codefacts.schema import MISSING_DOC
from codefacts.sources import files

OCCURRENCE = "relative_path string, symbol string, start_line int, start_char int, end_line int, end_char int, roles int"
SYMBOL = "task_id long, relative_path string, symbol string, suffix string, doc string, is_multi boolean"
RELATION = "symbol string, target string, is_definition boolean, is_reference boolean, is_type_definition boolean, is_implementation boolean"
REFERENCE = "task_id long, suffix string, doc string, relative_path string, start_line int, start_char int, end_line int, end_char int"


def c(suffix, package="p v1"):
    return f"cxx . {package}$ {suffix}"


@pytest.fixture(scope="module")
def parts(spark):
    occurrences = [("a.h", c("F#"), 3, 6, 3, 7, 1), ("a.h", c("F#"), 3, 6, 3, 7, 1), ("a.h", c("G#"), 3, 6, 5, 1, 1), ("a.h", c("F#"), 1, 0, 1, 1, 0), ("b.cc", c("G#"), 0, 0, 0, 1, 0)]
    own = [(1, "a.h", c("F#"), "F#", "Doc of F", False), (2, "a.h", c("G#"), "G#", MISSING_DOC, True), (1, "c.h", c("G#", "twin v2"), "G#", MISSING_DOC, True)]
    external = [(c("E#", "x v1"), "E#", MISSING_DOC), (c("E#", "y v2"), "E#", "Doc of E"), (c("F#", "old v0"), "F#", "hidden")]
    relations = [(c("G#"), c("F#"), False, False, False, True), (c("G#"), c("LongName#"), False, False, False, True), (c("G#"), c("B#"), True, False, False, False)]
    references = [(3, "F#", "not used", "b.cc", 1, 0, 1, 1), (3, "E#", "Offer", "b.cc", 2, 0, 2, 1), (4, "G#", "From forward", "b.cc", 0, 0, 0, 1), (4, "magic(1).", "Abracadabra!", "b.cc", 3, 0, 3, 5), (5, "magic(1).", "late", "b.cc", 4, 0, 4, 5)]
    make = spark.createDataFrame
    return make(occurrences, OCCURRENCE), make(own, SYMBOL), make(external, "symbol string, suffix string, doc string"), make(relations, RELATION), make(references, REFERENCE)


def test_index_is_written_and_read_back(spark, parts, tmp_path):
    index.write_index(index.merged_index(*parts, "/proj"), f"file://{tmp_path}/index")
    got = index.read_index(spark, f"file://{tmp_path}/index")
    assert got["metadata"].first().project_root == "file:///proj"
    documents = {r.relative_path: r for r in got["documents"].collect()}
    assert set(documents) == {"a.h", "b.cc", "c.h"} and documents["c.h"].occurrences is None
    assert [(o.start_line, o.start_char, o.symbol, o.roles) for o in documents["a.h"].occurrences] == [(1, 0, c("F#"), 0), (3, 6, c("F#"), 1), (3, 6, c("G#"), 1)]
    want = [(0, c("G#", "twin v2")), (0, c("G#")), (1, c("F#")), (2, c("E#", "x v1")), (2, c("E#", "y v2")), (3, "cxx . . $ magic(1)."), (4, "cxx . . $ magic(1).")]
    assert [(o.start_line, o.symbol) for o in documents["b.cc"].occurrences] == sorted(want, key=lambda x: (x[0], len(x[1]), x[1]))
    assert [(s.symbol, s.doc) for s in documents["a.h"].symbols] == [(c("F#"), "Doc of F"), (c("G#"), MISSING_DOC)]
    assert documents["c.h"].symbols[0].doc == "From forward"
    assert [r.target for r in documents["a.h"].symbols[1].relationships] == [c("F#"), c("LongName#"), c("B#")]
    external = [(r.symbol, r.doc) for r in got["external_symbols"].collect()]
    assert external == [(c("E#", "x v1"), "Offer"), (c("E#", "y v2"), "Doc of E"), ("cxx . . $ magic(1).", "Abracadabra!")]


def test_shown_documentation_and_relations(spark, parts):
    occurrences, own, _, relations, _ = parts
    lines = spark.createDataFrame([("a.h", i + 1, f"line {i}") for i in range(5)], "relative_path string, line_no int, text string")
    known = merge.with_relationships(own.select("relative_path", "symbol", F.concat("doc", F.lit("\nmore\n")).alias("doc")), relations)
    shown = occurrences.where("relative_path = 'a.h'").distinct().withColumn("end_line", F.col("start_line"))
    got = {r.line_no: r.snapshot for r in render.snapshot(lines, shown.withColumn("end_char", F.col("start_char") + 1), known).collect()}
    head = "//      "
    assert got[1] == "  line 0" and got[2] == "  line 1\n//^ reference p v1$ F#"
    assert got[4] == "\n".join([
        "  line 3", f"{head}^ definition p v1$ F#", f"{head}documentation", f"{head}| Doc of F", f"{head}| more",
        f"{head}^ definition p v1$ G#", f"{head}documentation", f"{head}| {MISSING_DOC}", f"{head}| more",
        f"{head}relation definition p v1$ B#", f"{head}relation implementation p v1$ F#", f"{head}relation implementation p v1$ LongName#",
    ])


def test_truncated_shards_are_reported(spark, tmp_path):
    files.write_shards(spark.range(100).repartition(2), f"{tmp_path}/s")
    one = sorted((tmp_path / "s").glob("*.parquet"))[0]
    kept = spark.read.parquet(str(sorted((tmp_path / "s").glob("*.parquet"))[1])).count()
    one.write_bytes(one.read_bytes()[: one.stat().st_size // 2])
    (tmp_path / "s" / "other.parquet").write_bytes(b"no shard")
    (tmp_path / "s" / "empty.parquet").write_bytes(b"")
    rows, bad = files.read_shards(spark, f"{tmp_path}/s", "id bigint")
    assert rows.count() == kept and {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {one.name, "other.parquet"}


def test_forward_shards(spark, parts, tmp_path):
    references = parts[4]
    files.write_shards(merge.forward_groups(references), f"{tmp_path}/forward")
    rows, bad = files.read_forward_shards(spark, f"{tmp_path}/forward")
    place = ["task_id", "suffix", "relative_path", "start_line"]
    assert bad.count() == 0 and sorted(rows.select(place).collect()) == sorted(references.select(place).collect())


def test_command_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for part, first in (("a.jsonl", 0), ("b.jsonl", 900)):
        (tmp_path / "c" / part).write_text("".join(json.dumps({"directory": "/d", "file": f"f{i}.c", "command": f"cc 'a b' f{i}.c" if i % 2 else f"cc  f{i}.c"}) + "\n" for i in range(first, first + 900)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = files.read_command_lines(spark, f"{tmp_path}/c").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.task_id, r.file) for r in got) == [(i, f"f{i}.c") for i in range(1800)]
    assert all(r.arguments == (["cc", "a b", r.file] if r.task_id % 2 else ["cc", r.file]) for r in got)


def test_numbered_is_dense(spark):
    words = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("w"))
    got = tables.numbered(words, [F.col("w")], "place").collect()
    assert [r.place for r in sorted(got, key=lambda r: r.w)] == list(range(1, 501))


def test_invalid_utf8_is_replaced(spark):
    got = spark.range(1).select(symbols.clean_doc(F.lit(bytearray(b" a\xffb\n")).cast("string")).alias("d")).first().d
    assert got == "a�b"


def test_project_root_is_required(spark):
    known = spark.createDataFrame([("/proj", "a", "1")], "root string, name string, version string")
    assert packages.require_root(known, "/proj").count() == 1
    with pytest.raises(ValueError, match="/other"):
        packages.require_root(known, "/other")


def brute_violations(events):
    """The same with a stack, event by event."""
    stack, ended, out = [], False, []
    for seq, kind, path, previous in events:
        if ended:
            out += [(seq, "after the end")] * (kind != "other")
            continue
        if kind != "end" and stack and previous is not None and stack[-1] != previous:
            out.append((seq, "disconnected"))
        if kind == "enter":
            stack.append(path)
        elif kind == "exit":
            if stack:
                stack.pop()
            else:
                out.append((seq, "unbalanced"))
        elif kind == "end":
            ended = True
            out += [(seq, "unbalanced")] * (len(stack) - 1 if stack else 1)
    return out


def test_trace_violations(spark):
    r = random.Random(1)
    rows = [(t, i, r.choice(["enter", "enter", "exit", "other"] if i < 18 else ["exit", "end"]), f"p{r.randrange(3)}", r.choice([None, "p0", "p1", "p2"])) for t in range(60) for i in range(r.randrange(1, 22))]
    got = planning.trace_violations(spark.createDataFrame(rows, "task_id long, seq long, kind string, path string, previous string")).collect()
    want = [(t, *v) for t in range(60) for v in brute_violations([x[1:] for x in rows if x[0] == t])]
    assert Counter(map(tuple, got)) == Counter(want) and len({v[2] for v in want}) == 3


def test_hash_history(spark):
    events = [(1, i, k, v) for i, (k, v) in enumerate([("enter", "m"), ("define", "X"), ("enter", "h"), ("exit", "h"), ("enter", "h"), ("exit", "h"), ("exit", "m")])]
    events = spark.createDataFrame(events, "task_id long, seq long, kind string, value string")
    history = measure.hash_history(events)
    rows = sorted(history.collect(), key=lambda r: (r.passage, r.ord))
    assert [(r.path, r.mix_context) for r in rows] == [("h", "self path"), ("h", "self path"), ("m", "self path"), ("m", "define"), ("m", "hash for #include"), ("m", "hash for #include")]
    assert rows[4].mixed_value == rows[0].after and rows[4].context_data == "h" and rows[0].before == "0"
    chains = history.select(F.concat("passage", F.lit(" "), "path").alias("path"), "ord", "before", "after")
    assert planning.chain_breaks(chains).count() == 0
    last = {(r.path, r.after) for r in rows if r.ord == max(x.ord for x in rows if x.passage == r.passage)}
    assert last == {tuple(r) for r in measure.include_hashes(events).select("path", "hash").collect()}
    text = measure.history_text(history).where("path = 'm'").first().text
    assert text.startswith("---\npath:            m\nhash:            ") and text.count("before-hash") == 4 and "    context-data:    h\n" in text and text.endswith("\n...")


def test_one_symbol_per_suffix(spark):
    """A suffix that two documents define is one occurrence: the singly indexed document's symbol."""
    own = spark.createDataFrame([(2, "b.h", c("F#", "b v1"), "F#", "", False), (1, "a.h", c("F#", "a v1"), "F#", "", True)], SYMBOL)
    got = merge.resolve(spark.createDataFrame([("F#",)], "suffix string"), own, own.where("false")).collect()
    assert [tuple(r) for r in got] == [("F#", c("F#", "b v1"), "document")]


def test_units_from_facts(spark):
    fields = "task_id long, seq long, node_kind string, path string, hash long, symbol string, is_definition boolean, is_pure_virtual boolean, canonical_is_definition boolean, is_local boolean, is_implicit boolean, is_builtin boolean, doc string, start_line int, start_char int, end_line int, end_char int"
    row = lambda seq, kind, path, symbol, defines, doc="": (1, seq, kind, path, 1, symbol, defines, False, False, False, False, False, doc, seq, 0, seq, 4)
    own = [row(1, "record", "/p/a.h", c("F#"), True, "Doc"), row(2, "function", "/p/a.h", c("g()."), False, "Fwd"), row(3, "decl_ref", "/p/a.h", c("g()."), False), row(4, "record", "/x/b.h", c("X#"), True), row(5, "decl_ref", "/x/b.h", c("F#"), False)]
    table = spark.createDataFrame(own, fields)
    known = spark.createDataFrame([("/p/a.h", "a.h", True, False, 0), ("/x/b.h", "b.h", False, False, None)], "path string, stable_path string, is_in_project boolean, is_synthetic boolean, start_line int")
    known = known.withColumns({x: F.when(F.col("start_line") == 0, F.lit(0)) for x in ("start_char", "end_line", "end_char")})
    out = index.unit_outputs(table, known, table.select("task_id", "path", "hash").distinct())
    file = "cxx . . .$ `<file>/a.h`/"
    assert sorted((r.symbol, r.start_line, r.roles) for r in out["occurrences"].collect()) == [(file, 0, 1), (c("F#"), 1, 1)]
    assert sorted((r.symbol, r.doc) for r in out["symbols"].collect()) == [(file, "File: a.h"), (c("F#"), "Doc")] and [r.symbol for r in out["external"].collect()] == [c("X#")]
    assert [(r.suffix, r.doc, r.start_line) for r in sorted(out["references"].collect())] == [("g().", "Fwd", 2), ("g().", "Fwd", 3)]
    whole = index.index_from_facts(table, known, table.select("task_id", "path", "hash").distinct(), "/p")
    (document,) = whole["documents"].collect()
    assert [(o.symbol[-4:], o.start_line) for o in document.occurrences] == [("a.h`/"[-4:], 0), ("$ F#", 1), ("g().", 2), ("g().", 3)]
    assert sorted((r.symbol[-4:], r.doc) for r in whole["external_symbols"].collect()) == [("$ X#", MISSING_DOC), ("g().", "Fwd")]
    assert facts.related_references(table.withColumn("related", F.array(F.lit("t")))).count() == 3


def test_a_hot_suffix_is_split(spark):
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        references = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, "std/string#").otherwise(F.concat(F.lit("s"), "id")).alias("suffix"), F.col("id"))
        resolved = tables.durable(merge.resolve(references, spark.createDataFrame([], SYMBOL), spark.createDataFrame([], SYMBOL)))
        out = merge.forward_occurrences(references, resolved)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
