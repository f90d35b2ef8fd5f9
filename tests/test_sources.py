"""Readers on small files, and operators that have no SQL."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codefacts.operators import commands, graph, measure, merge, packages
from codefacts.sources import files
from codefacts.streaming import jobs


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('arg1 arg2 -X="arg3"', ["arg1", "arg2", "-X=arg3"]),
        ("-Y=\"dq\\\"dq\" -Z='blah' '-W=ww'", ['-Y=dq"dq', "-Z=blah", "-W=ww"]),
        ("  a   b ", ["a", "b"]),
        ("a\\ b '\\' \"\"", ["a b", "\\", ""]),
        ("a\tb", ["a\tb"]),
        ("", []),
    ],
)
def test_tokenize(text, want):
    assert files.tokenize(text) == want


def test_commands_keep_their_place(spark, tmp_path):
    names = ["a.c", "b.h", "c.cpp", "d.hpp", "e.cc", "f.S", "g.cxx", "h.def", "i.hxx"]
    rows = [{"directory": "/d", "file": n, "command": f"cc {n}"} for n in names]
    rows[2] = {"directory": "/d", "file": "c.cpp", "arguments": ["cc", '-X="arg3"'], "output": "x"}
    rows[4] = {"directory": "/d", "file": "e.cc", "command": "cc e.cc", "arguments": ["more"]}
    path = tmp_path / "commands.json"
    path.write_text(json.dumps(rows))
    got = files.read_commands(spark, str(path)).where(commands.is_main_file(F.col("file"))).orderBy("task_id").collect()
    assert [(r.task_id, r.file) for r in got] == [(0, "a.c"), (2, "c.cpp"), (4, "e.cc"), (6, "g.cxx")]
    assert got[1].arguments == ["cc", '-X="arg3"'] and got[2].arguments == ["cc", "e.cc", "more"]


def test_arrays_are_read_in_blocks(spark, tmp_path):
    """Braces, brackets, quotes and backslashes in strings, nested values, any block size: the same objects as a JSON parser finds."""
    texts = ['}{][', '\\"}', 'a\\\\', '"', "{\"x\": [1, {}]}", "é\n}", "", "\\\\}\\"]
    rows = [{"file": f"{i}{t}", "arguments": [t, texts[i % 3]], "n": {"a": [[{"b": t}]], "c": {}}} for i, t in enumerate(texts * 6)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps(rows[:3], indent=2) + "\n")
    (tmp_path / "c.json").write_text("[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("37b", "1000b", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            own = files.json_arrays.array_objects(spark, str(tmp_path))
            got = {name: [json.loads(r.json) for r in own.where(F.col("file_path").endswith(name)).orderBy("ord").collect()] for name in ("a.json", "b.json", "c.json")}
            assert got == {"a.json": rows, "b.json": rows[:3], "c.json": []}
        assert files.json_arrays.fragments(spark, str(tmp_path / "a.json")).count() > 100
        (tmp_path / "d.json").write_text('[{"file": "x"}, {"file": "y}')
        with pytest.raises(ValueError, match="d.json"):
            files.json_arrays.array_objects(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bad_types_and_unknown_keys(spark, tmp_path):
    path = tmp_path / "commands.json"
    path.write_text(json.dumps([{"file": "a", "n": 5}, {"file": "b", "list": ["x"]}, {"file": True}, {"file": None}]))
    raw = files.raw_objects(spark, str(path))
    assert {r.task_id for r in commands.badly_typed(raw).collect()} == {0, 2, 3}
    assert [r.key for r in commands.unknown_keys(raw).collect()] == ["list", "n"]
    with pytest.raises(ValueError, match="empty"):
        files.require_rows(raw.where("false"), "empty")


def test_package_map_file(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps([{"path": "/p", "package": "main@v0"}, {"path": "/p/dep", "package": "dep1@v1"}, {"path": "/p", "package": "late@v1"}, {"path": "/q", "package": "bad"}]))
    known = packages.load_map(files.read_packages(spark, str(path)))
    got = packages.longest_prefix(spark.createDataFrame([("/p/dep/x.c",), ("/p/depth.c",), ("/r",)], "path string"), known).collect()
    assert {r.path: r.name for r in got} == {"/p/dep/x.c": "dep1", "/p/depth.c": "main", "/r": None}


def test_directives(spark, tmp_path):
    (tmp_path / "a.cc").write_text("// extra-args: -x c\n// extra-args: -O\ncode\n// extra-args: late\n// format-options: showDocs\n")
    lines = files.read_sources(spark, str(tmp_path), "*.cc")
    assert files.extra_arguments(lines).first().arguments == ["-x", "c", "-O"]
    assert files.format_options(lines).first().option == "showDocs"


def test_shards_pass_over_bad_files(spark, tmp_path):
    files.write_shards(spark.range(3), str(tmp_path / "s"))
    (tmp_path / "s" / "broken.parquet").write_bytes(b"no parquet here, at all")
    rows, bad = files.read_shards(spark, str(tmp_path / "s"), "id bigint")
    assert rows.count() == 3 and bad.count() == 1


GOLDEN = [("F#", "Doc comment on definition"), ("UndocumentedClass#", "From forward decl")]


def test_forward_declarations(spark):
    """A declaration documents what its definition leaves undocumented; without any definition a symbol is invented."""
    symbols = spark.createDataFrame([("F#", "cxx . . $ F#", "Doc comment on definition"), ("UndocumentedClass#", "cxx . . $ UndocumentedClass#", "No documentation available.")], "suffix string, symbol string, doc string")
    decls = spark.createDataFrame([(1, "F#", "Doc comment on forward decl"), (1, "UndocumentedClass#", "From forward decl"), (1, "perform_magic(1).", "Abracadabra!"), (1, "undo_magic(1).", "")], "task_id int, suffix string, doc string")
    found = merge.resolve(decls, symbols, symbols.where("false"))
    assert {r.suffix: (r.symbol, r.found) for r in found.collect()}["undo_magic(1)."] == ("cxx . . $ undo_magic(1).", "invented")
    docs = merge.patched_docs(symbols.select("symbol", "doc"), found, decls)
    assert {r.symbol[8:].strip(): r.doc for r in docs.collect()} == {f"$ {k}": v for k, v in GOLDEN}


def test_order_of_input_does_not_matter(spark):
    rows = [(t, f"p{t % 3}", f"s{t % 4}", "" if t % 2 else f"d{t}") for t in range(20)]
    schema = "task_id int, relative_path string, symbol string, doc string"
    a, b = (merge.merge_symbols(spark.createDataFrame(x, schema), ["symbol"], ["task_id", "doc"]).collect() for x in (rows, rows[::-1]))
    assert sorted(a) == sorted(b)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 1)], "derived int, base int")
    assert sorted(map(tuple, graph.closure(edges).collect())) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (5, 1), (5, 2), (5, 3)]


def test_include_hashes(spark):
    """A header that is entered twice with the same events has one hash; other events change it, and its includer."""
    def unit(task, inner):
        return [(task, i, k, v) for i, (k, v) in enumerate([("enter", "main"), ("enter", "h"), *inner, ("exit", "h"), ("enter", "h"), ("exit", "h"), ("exit", "main"), ("exit", "none")])]

    got = measure.include_hashes(spark.createDataFrame(unit(1, []) + unit(2, [("define", "X")]), "task_id long, seq long, kind string, value string")).toPandas()
    first, second = got[got.task_id == 1], got[got.task_id == 2]
    assert first[first.path == "h"].hash.nunique() == 1 and second[second.path == "h"].hash.nunique() == 2
    assert set(first[first.path == "main"].hash) != set(second[second.path == "main"].hash)


def test_budget_groups(spark):
    rows = spark.createDataFrame([(1, i, "x" * 9) for i in range(7)], "task_id long, ord long, path string")
    assert measure.budget_groups(rows, 30).toPandas().sort_values("ord").grp.tolist() == [0, 0, 0, 1, 1, 1, 2]


def test_job_states_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 1, 0, "start"), ("2024-01-01 00:01:00", 2, 1, 0, "finish"), ("2024-01-01 00:02:00", 3, 2, 0, "start")]
    schema = "ts string, seq long, task_id long, subtask int, event string"
    data = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
    data.write.parquet(str(tmp_path / "events"))
    stream = jobs.read_events(spark, str(tmp_path / "events"), data.schema)
    jobs.write_states(jobs.states(stream), str(tmp_path / "check"), "job_states").awaitTermination(120)
    assert {r.task_id: r.state for r in spark.table("job_states").collect()} == {1: "done", 2: "wip"}


def test_tokenizer_in_spark(spark):
    got = spark.createDataFrame(pd.DataFrame({"c": ["a 'b c'", None]})).select(files.split_command("c").alias("x")).collect()
    assert [r.x for r in got] == [["a", "b c"], None]
