"""Wire format, shards that are bad, and fragments whose concatenation is one index."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.operators.tables import durable
from codefacts.plans import index
from codefacts.queries import reading
from codefacts.sources import index_files, wire, wire_columns


def test_messages_by_hand():
    """Bytes as the format's public description has them."""
    assert wire.encode({1: ("a", wire.INT)}, {"a": 150}) == b"\x08\x96\x01"
    assert wire.encode({2: ("b", wire.TEXT)}, {"b": "testing"}) == b"\x12\x07testing"
    assert wire.encode({3: ("c", {1: ("a", wire.INT)})}, {"c": {"a": 150}}) == b"\x1a\x03\x08\x96\x01"
    assert wire.encode({6: ("e", wire.INTS)}, {"e": [3, 270, 86942]}) == b"\x32\x06\x03\x8e\x02\x9e\xa7\x05"
    assert wire.decode({4: ("d", wire.INTS)}, b"\x22\x06\x03\x8e\x02\x9e\xa7\x05\x20\x07") == {"d": [3, 270, 86942, 7]}
    assert wire.decode({1: ("a", wire.INT), 2: ("t", [wire.TEXT])}, wire.encode({1: ("a", wire.INT)}, {"a": -2}) + b"\x18\x05\x25abcd\x29abcdefgh\x12\x01x\x12\x00") == {"a": -2, "t": ["x", ""]}


def test_round_trips_and_truncations():
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("aé\U0001f600 #") for _ in range(rng.randrange(6)))
    related = lambda: {"symbol": text(), **{f"is_{k}": rng.random() < 0.5 for k in ("reference", "implementation", "type_definition", "definition")}}
    symbol = lambda: {"symbol": text(), "documentation": [text() for _ in range(rng.randrange(3))], "relationships": [related() for _ in range(rng.randrange(3))]}
    for _ in range(50):
        whole = {"metadata": None, "documents": [{"relative_path": text(), "language": "CPP", "occurrences": [{"range": [rng.randrange(-3, 999) for _ in range(3)], "symbol": text(), "roles": rng.randrange(9)} for _ in range(3)], "symbols": [symbol()]}], "external_symbols": [symbol(), symbol()]}
        data = wire.encode(wire.INDEX, whole)
        assert wire.decode(wire.INDEX, data) == whole
        one, two = wire.encode(wire.INDEX, {"documents": whole["documents"]}), wire.encode(wire.INDEX, {"external_symbols": whole["external_symbols"]})
        assert wire.decode(wire.INDEX, one + two) == whole
    for cut in range(1, 12):
        with pytest.raises(ValueError):
            wire.decode(wire.INDEX, wire.encode(wire.INDEX, {"documents": [{"relative_path": "abcdefghij"}]})[:cut])
    for bad in (b"\x00", b"\x0b", b"\x0d1234", b"\xff" * 12, b"\x12\x02\x0a\xff"):
        with pytest.raises(ValueError):
            wire.decode(wire.INDEX, bad)


def test_index_files(spark, tmp_path):
    place = "relative_path string, symbol string, start_line int, start_char int, end_line int, end_char int, roles int"
    occurrences = spark.createDataFrame([(f"f{i % 7}.cc", f"cxx . p v$ S{i}#", i, 0, i + i % 2, 5, i % 2) for i in range(60)], place)
    symbols = spark.createDataFrame([(f"f{i % 7}.cc", f"cxx . p v$ S{i}#", f"S{i}#", f"doc {i}", i, False) for i in range(40)], "relative_path string, symbol string, suffix string, doc string, task_id int, is_multi boolean")
    external = spark.range(2500).select(F.concat(F.lit("cxx . x v$ X"), "id", F.lit("#")).alias("symbol"), F.concat(F.lit("X"), "id", F.lit("#")).alias("suffix"), F.lit("e").alias("doc"))
    relations = spark.createDataFrame([("cxx . p v$ S1#", "t", True, False, True, False), ("cxx . x v$ X7#", "u", False, True, False, True)], "symbol string, target string, is_definition boolean, is_reference boolean, is_type_definition boolean, is_implementation boolean")
    references = spark.createDataFrame([(1, "S3#", "fwd", "f1.cc", 9, 1, 9, 3)], "task_id int, suffix string, doc string, relative_path string, start_line int, start_char int, end_line int, end_char int")
    whole = index.merged_index(occurrences, symbols, external, relations, references, "/proj")
    path = tmp_path / "index"
    index_files.write_index_files(whole, f"file://{path}")
    parts = sorted(p for p in path.iterdir() if not p.name.startswith("."))
    assert all(p.name.startswith("index-") for p in parts)
    one = wire.decode(wire.INDEX, b"".join(p.read_bytes() for p in parts))
    assert one["metadata"]["project_root"] and [d["relative_path"] for d in one["documents"]] == [f"f{i}.cc" for i in range(7)] and len(one["external_symbols"]) == 2500
    names = [s["symbol"] for s in one["external_symbols"]]
    assert names == sorted(names, key=lambda s: (len(s), s))
    assert sum(len(d["occurrences"]) for d in one["documents"]) == 61 and one["documents"][0]["occurrences"][0]["range"] == [0, 0, 5]
    (path / "index-broken").write_bytes(parts[-1].read_bytes()[:-3])
    (path / "index-other").write_bytes(b"no index at all")
    got = index_files.read_index_files(spark, f"file://{path}")
    assert {r.shard.rsplit("/", 1)[1] for r in got["bad"].collect()} == {"index-broken", "index-other"}
    assert got["occurrences"].count() == 61 and got["external"].count() == 2500 and got["metadata"].count() == 1
    assert {(r.symbol, r.relationships[0]["symbol"]) for r in got["symbols"].where("size(relationships) > 0").collect()} == {("cxx . p v$ S1#", "t")}


def test_flat_documents(spark, tmp_path):
    """Flat rows make the same files as nested documents: rows of a document in many batches, repeated rows, ranges over lines, lone symbols."""
    place = "relative_path string, symbol string, start_line int, start_char int, end_line int, end_char int, roles int"
    rng = random.Random(5)
    rows = [(f"{'d/' * (i % 3)}f{i % 11}.cc", f"S{'x' * rng.randrange(3)}é{rng.randrange(9)}#", line := rng.randrange(4), rng.randrange(3), line + rng.randrange(2), rng.randrange(4), rng.randrange(2)) for i in range(900)]
    occurrences = spark.createDataFrame([*rows, *rows[:300]], place)
    symbols = spark.createDataFrame([(f"f{i % 13}.cc", f"S{i}#", f"S{i}#", f"doc {i}", i, False) for i in range(60)], "relative_path string, symbol string, suffix string, doc string, task_id int, is_multi boolean")
    external = spark.createDataFrame([("X1#", "X1#", "e")], "symbol string, suffix string, doc string")
    relations = spark.createDataFrame([(f"S{i}#", t, True, False, True, False) for i in range(9) for t in ("u", "t")], "symbol string, target string, is_definition boolean, is_reference boolean, is_type_definition boolean, is_implementation boolean")
    references = spark.createDataFrame([(1, "S3#", "fwd", "f1.cc", 9, 1, 9, 3)] * 2 + [(2, "S4#", "", "only/forward.cc", 2, 1, 3, 0)], "task_id int, suffix string, doc string, relative_path string, start_line int, start_char int, end_line int, end_char int")
    inputs = (occurrences, symbols, external, relations, references, "/proj")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for name, whole in (("nested", index.merged_index(*inputs)), ("flat", index.flat_index(*inputs))):
            index_files.write_index_files(whole, f"file://{tmp_path}/{name}")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nested, flat = (b"".join(p.read_bytes() for p in sorted((tmp_path / name).iterdir()) if p.name.startswith("index-")) for name in ("nested", "flat"))
    assert nested == flat and len(wire.decode(wire.INDEX, flat)["documents"]) > 11


def test_groups_of_rows_that_hold_two_documents():
    """Paths whose hashes are equal meet in one group; their rows still make two documents."""
    rows = {"relative_path": pa.array(["b", "a", "b", "aa"]), "symbol": pa.array(["t", "s", "t", "s"]), "start": pa.array([1 << 32, 5, 1 << 32, -1]), "extent": pa.array([4, 2, 4, 1 << 32]), "what": pa.array([index_files.KINDS_OF_ROWS, 0, index_files.KINDS_OF_ROWS, 1]), "told": pa.array([None] * 4, pa.binary())}
    paths, of = index_files._flat_documents(rows)
    own = of["documents"][0]
    (o, counts), (numbers, sizes) = own["occurrences"], own["occurrences"][0]["range"]
    assert paths.to_pylist() == ["a", "b", "aa"] and counts.tolist() == [1, 1, 1] and o["roles"].tolist() == [0, 1, 0]
    assert numbers.tolist() == [0, 5, 7, 1, 0, 4, -1, -1, 0, -1] and sizes.tolist() == [3, 3, 4]


def test_documents_are_written_once(spark, sf_dir, monkeypatch):
    """Besides the files, occurrences take the disk of one shuffle: no table of documents, and none of what the files hold."""
    tables, plans, write, save = [], [], index_files.written, index_files._save
    monkeypatch.setattr(index_files, "durable", lambda rows: tables.append(set(rows.columns)) or durable(rows))
    monkeypatch.setattr(index_files, "written", lambda rows, *a: tables.append(set(rows.columns)) or write(rows, *a))
    monkeypatch.setattr(index_files, "_save", lambda rows, path: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or save(rows, path))
    assert reading.k02_protobuf_occurrences(spark, sf_dir).count() > 10_000
    assert not any("occurrences" in columns for columns in tables) and plans[0].count("RepartitionByExpression") == 1


def _columns(fields, messages):
    """Messages as the columns that wire_columns takes."""
    out = {}
    for name, kind in fields.values():
        values = [m[name] for m in messages]
        if kind in (wire.INT, wire.BOOL):
            out[name] = np.array(values)
        elif kind == wire.TEXT:
            out[name] = pa.array(values, pa.string())
        else:
            each = [v if isinstance(v, list) else [] if v is None else [v] for v in values]
            flat, one = [x for own in each for x in own], kind[0] if isinstance(kind, list) else kind
            of = np.array(flat, np.int64) if kind == wire.INTS else pa.array(flat, pa.string()) if one == wire.TEXT else _columns(one, flat)
            out[name] = of, np.array([len(own) for own in each], np.int64)
    return out


def test_many_messages_at_once(spark):
    """Columns of messages and single messages have the same bytes; damaged bytes are refused by both, or read the same."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("aé\U0001f600 #") for _ in range(rng.randrange(6)))
    place = lambda: {"range": [rng.choice([rng.randrange(-3, 999), 2**31 - 1, -(2**31)]) for _ in range(rng.randrange(5))], "symbol": text(), "roles": rng.randrange(300)}
    symbol = lambda: {"symbol": text(), "documentation": [text() for _ in range(rng.randrange(3))], "relationships": [dict.fromkeys(("is_reference", "is_implementation", "is_type_definition", "is_definition"), True) | {"symbol": text()}]}
    document = lambda: {"relative_path": text(), "language": "CPP", "occurrences": [place() for _ in range(rng.randrange(40))], "symbols": [symbol() for _ in range(rng.randrange(4))]}
    for n in (1, 5, 40):
        about = [None if rng.random() < 0.5 else {"tool_info": None, "project_root": text(), "text_document_encoding": 1} for _ in range(n)]
        whole = [{"metadata": a, "documents": [document() for _ in range(rng.randrange(30))], "external_symbols": [symbol()]} for a in about]
        want = [wire.encode(wire.INDEX, m) for m in whole]
        data, lengths = wire_columns.encode(wire.INDEX, _columns(wire.INDEX, whole), n)
        ends = np.cumsum(lengths)
        assert [data[e - k : e].tobytes() for e, k in zip(ends, lengths, strict=True)] == want
        again = wire_columns.encode(wire.INDEX, wire_columns.decode(wire.INDEX, data, ends - lengths, ends), n)
        assert again[0].tobytes() == data.tobytes()
        for _ in range(40):
            damaged = bytearray(want[-1][:3000])
            damaged[rng.randrange(len(damaged))] = rng.randrange(256)
            try:
                one = wire.encode(wire.INDEX, wire.decode(wire.INDEX, bytes(damaged)))
            except ValueError:
                with pytest.raises(ValueError):
                    wire_columns.decode(wire.INDEX, np.frombuffer(bytes(damaged), np.uint8), np.array([0]), np.array([len(damaged)]))
            else:
                column = wire_columns.decode(wire.INDEX, np.frombuffer(bytes(damaged), np.uint8), np.array([0]), np.array([len(damaged)]))
                if not column["metadata"][1][0] > 1:
                    assert wire_columns.encode(wire.INDEX, column, 1)[0].tobytes() == one


def test_files_are_bounded(spark, tmp_path):
    """A task that has more than MOST bytes begins another file, and what one task reads stays small; nothing is lost."""
    place = F.struct(F.concat(F.lit("f"), "id").alias("relative_path"), *[F.lit(i).alias(c) for i, c in enumerate(("start_line", "start_char", "end_line", "end_char"))])
    groups = spark.range(40_000).coalesce(1).select(F.lit(1).alias("task_id"), F.concat(F.lit("S"), "id").alias("suffix"), F.repeat(F.lit("d"), 1000).alias("doc"), F.array(place).alias("references"))
    index_files.write_forward_files(groups.coalesce(1), f"file://{tmp_path}/forward")
    sizes = [p.stat().st_size for p in (tmp_path / "forward").iterdir() if p.name.startswith("index-")]
    assert sum(sizes) > 40e6 and max(sizes) < index_files.MOST + 1e6
    got, bad = index_files.read_forward_files(spark, f"file://{tmp_path}/forward")
    assert got.count() == 40_000 and bad.count() == 0
