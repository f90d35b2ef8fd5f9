"""Indexes as protobuf files: shards of units in, and the whole index out as fragments whose concatenation is one message.

Reading: a shard is one row of Spark's binary reader and is decoded whole by the task that has it, so a bad one gives a row that says why, and nothing
else; the others are read. Writing: each document, each 1024 external symbols and the metadata are a fragment. Fragments are sorted
by ranges, and each task writes its range as files of bounded size; they get their names when all tasks have ended. In the order of names they are, one after
another, a valid index. Both ways, messages are read and written many at a time, as columns (wire_columns). Documents of flat rows are shuffled once, as
rows, and what a query reads of one part isn't written again: besides the files, an index takes the disk of that shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from codefacts.functions import ranges
from codefacts.operators.tables import durable, numbered, written
from codefacts.schema import MISSING_DOC
from codefacts.sources import wire, wire_columns

EXTERNALS = 1024
PREFIX = "index-"
#: Bytes of a file, beyond which a task begins another one: what one task of the reader holds at once doesn't grow with the index.
MOST = 1 << 24
_RELATED = "array<struct<symbol: string, is_reference: boolean, is_implementation: boolean, is_type_definition: boolean, is_definition: boolean>>"
_SYMBOL = f"symbol: string, documentation: array<string>, relationships: {_RELATED}"
_READ = f"""shard string, kind string, reason string, relative_path string, language string,
    occurrences array<struct<range: array<int>, symbol: string, roles: int>>, symbols array<struct<{_SYMBOL}>>, project_root string"""
_FORWARD = "shard string, kind string, reason string, suffix string, doc string, references array<struct<range: array<int>, relative_path: string>>"


Rows = list[tuple[int, dict[str, pa.Array]]]


def _filled(shard: str, n: int, columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    columns = {"shard": pa.array([shard] * n, pa.string()), **columns}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _decoded(rows: Callable[[np.ndarray], Rows], schema: pa.Schema, kinds: Container[str] | None = None):
    """A function over batches of (path, content): what rows makes of each message, or a row with a reason; those of kinds only.

    A shard's rows are kept as columns until all of it has been read, so a task holds a few times the bytes of one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    out = [_filled(path.as_py(), n, columns, schema) for n, columns in rows(np.frombuffer(content.as_buffer(), np.uint8))]
                except ValueError as e:  # whatever is wrong with a shard, the others are read
                    out = [_filled(path.as_py(), 1, {"kind": pa.array(["bad"]), "reason": pa.array([str(e)[:200]])}, schema)]
                for own in out:
                    if kinds is not None and own.num_rows and own.column("kind")[0].as_py() not in kinds:
                        continue
                    for i in range(0, own.num_rows, 1000):
                        yield own.slice(i, 1000)

    return run


def _kind(name: str, n: int) -> pa.Array:
    return pa.array([name] * n, pa.string())


def _message(fields: wire.Fields, data: np.ndarray) -> dict:
    return wire_columns.decode(fields, data, np.array([0]), np.array([len(data)]))


def _read_symbols(s: dict) -> pa.Array:
    related, counts = s["relationships"]
    names = ["symbol", "is_reference", "is_implementation", "is_type_definition", "is_definition"]
    relations = wire_columns.lists(pa.StructArray.from_arrays([pa.array(related[c]) for c in names], names), counts)
    return pa.StructArray.from_arrays([s["symbol"], wire_columns.lists(*s["documentation"]), relations], ["symbol", "documentation", "relationships"])


def _read_ranges(numbers: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    return wire_columns.lists(pa.array(numbers[0]), numbers[1])


def _rows_of_index(data: np.ndarray) -> Rows:
    index = _message(wire.INDEX, data)
    (about, n_about), (documents, n_documents), (external, n_external) = index["metadata"], index["documents"], index["external_symbols"]
    out: Rows = []
    if n_about[0]:
        out.append((1, {"kind": _kind("metadata", 1), "project_root": about["project_root"][-1:]}))
    n = int(n_documents[0])
    occurrences, counts = documents["occurrences"]
    places = pa.StructArray.from_arrays([_read_ranges(occurrences["range"]), occurrences["symbol"], pa.array(occurrences["roles"])], ["range", "symbol", "roles"])
    symbols = wire_columns.lists(_read_symbols(documents["symbols"][0]), documents["symbols"][1])
    out.append((n, {"kind": _kind("document", n), "relative_path": documents["relative_path"], "language": documents["language"], "occurrences": wire_columns.lists(places, counts), "symbols": symbols}))
    m = int(n_external[0])
    out.append((m, {"kind": _kind("external", m), "symbols": wire_columns.lists(_read_symbols(external), np.ones(m, np.int64))}))
    return out


def _rows_of_forward(data: np.ndarray) -> Rows:
    forward, counts = _message(wire.FORWARD_INDEX, data)["forward_decls"]
    (references, each), n = forward["references"], int(counts[0])
    places = pa.StructArray.from_arrays([_read_ranges(references["range"]), references["relative_path"]], ["range", "relative_path"])
    return [(n, {"kind": _kind("forward", n), "suffix": forward["suffix"], "doc": forward["documentation"], "references": wire_columns.lists(places, each)})]


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _content(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")


#: The kind of rows that a part comes from.
KINDS = {"occurrences": "document", "symbols": "document", "external": "external", "metadata": "metadata", "bad": "bad"}


def read_index_files(spark: SparkSession, root: str, names: Container[str] = tuple(KINDS)) -> dict[str, DataFrame]:
    """The parts of all shards below a folder: occurrences, symbols, external, metadata, and bad (shard, reason); those of names only.

    A single part is read from the shards whenever it is used. For several, what the shards hold is written once, as columns.
    """
    own = [name for name in KINDS if name in names]
    decoded = _decoded(_rows_of_index, _arrow(spark, _READ), {KINDS[name] for name in own})
    rows = _content(spark, root).mapInArrow(decoded, _READ)
    rows = rows if len(own) == 1 else written(rows, "shards", "kind")
    documents = rows.where("kind = 'document'")
    occurrences = documents.select("shard", "relative_path", F.posexplode("occurrences").alias("place", "o")).select("shard", "relative_path", "place", "o.symbol", ranges.decode(F.col("o.range")).alias("r"), "o.roles")
    told = lambda s: [F.col(f"{s}.symbol"), F.coalesce(F.get(f"{s}.documentation", 0), F.lit("")).alias("doc"), F.col(f"{s}.relationships")]
    parts = {
        "occurrences": occurrences.select("shard", "relative_path", "place", "symbol", *[(F.col(f"r.{c}") - 1).alias(c) for c in ranges.RANGE], "roles"),
        "symbols": documents.select("shard", "relative_path", F.posexplode("symbols").alias("place", "s")).select("shard", "relative_path", "place", *told("s")),
        "external": rows.where("kind = 'external'").select("shard", F.get("symbols", 0).alias("s")).select("shard", *told("s")),
        "metadata": rows.where("kind = 'metadata'").select("shard", "project_root"),
        "bad": rows.where("kind = 'bad'").select("shard", "reason"),
    }
    return {name: parts[name] for name in own}


def read_forward_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Shards of forward declarations: (a row per reference, bad shards)."""
    rows = written(_content(spark, root).mapInArrow(_decoded(_rows_of_forward, _arrow(spark, _FORWARD)), _FORWARD), "forward", "kind")
    each = rows.where("reason IS NULL").select("shard", "suffix", "doc", F.explode("references").alias("r")).select("shard", "suffix", "doc", "r.relative_path", ranges.decode(F.col("r.range")).alias("p"))
    return each.select("shard", "suffix", "doc", "relative_path", *[(F.col(f"p.{c}") - 1).alias(c) for c in ranges.RANGE]), rows.where("reason IS NOT NULL").select("shard", "reason")


Columns = dict[str, pa.Array]


def _parts(rows: pa.Array) -> Columns:
    return dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))


def _each(rows: pa.Array) -> tuple[Columns, np.ndarray]:
    """The elements of lists of structs, and how many each list has; a null list has none."""
    return _parts(rows.flatten()), _numbers(pc.list_value_length(rows))


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranges(o: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers of a range on one line, four of others."""
    sl, sc, el, ec = (_numbers(o[c]) for c in ranges.RANGE)
    four = np.stack([sl, sc, el, ec], axis=1)
    kept = np.ones(four.shape, bool)
    kept[:, 2] = sl != el
    return four[kept], kept.sum(axis=1)


def _symbols(s: Columns) -> dict:
    n = len(s["symbol"])
    out = {"symbol": s["symbol"], "documentation": (s["doc"], np.ones(n, np.int64))}
    if "relationships" in s:
        related, counts = _each(s["relationships"])
        flags = {c: pc.fill_null(related[c], False).to_numpy(zero_copy_only=False) for c in ("is_reference", "is_implementation", "is_type_definition", "is_definition")}
        out["relationships"] = {"symbol": related["target"], **flags}, counts
    return out


def _documents(rows: Columns) -> dict:
    (o, n_occurrences), (s, n_symbols) = _each(rows["occurrences"]), _each(rows["symbols"])
    occurrences = {"range": _ranges(o), "symbol": o["symbol"], "roles": _numbers(o["roles"])}
    return {"documents": {"relative_path": rows["relative_path"], "language": rows["language"], "occurrences": (occurrences, n_occurrences), "symbols": (_symbols(s), n_symbols)}}


#: What a row of a document is: an occurrence, one through a forward declaration, or a symbol.
OCCURRENCE, FORWARD, SYMBOL, KINDS_OF_ROWS = range(4)
#: Documents whose symbols are messages already: such a field is written as a text is.
_DOCUMENT = {n: (name, [wire.TEXT] if name == "symbols" else kind) for n, (name, kind) in wire.DOCUMENT.items()}
_OF_DOCUMENTS = {n: (name, [_DOCUMENT]) for n, (name, _) in wire.INDEX.items() if name == "documents"}


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
    """Columns of whole documents: batches parted where the group changes. A document may stand in many batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group").to_numpy()
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        if held and held[-1].column("group")[-1].as_py() != group[0]:
            cuts = np.append(0, cuts)
        if len(cuts):
            held.append(batch.slice(0, cuts[-1]))
            yield _together(held)
            held.clear()
        held.append(batch.slice(cuts[-1] if len(cuts) else 0))
    if held:
        yield _together(held)


def _together(batches: list[pa.RecordBatch]) -> Columns:
    rows = pa.Table.from_batches(batches).combine_chunks()
    return {name: rows.column(name).chunk(0) for name in rows.schema.names}


def _by_length(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each text among the different ones, in the order of ranges.by_length, and these; a null is an empty text."""
    own = pc.dictionary_encode(pc.fill_null(texts.cast(pa.large_string()), ""))
    each = own.dictionary.cast(pa.large_binary())
    order = pc.sort_indices(pa.table({"n": pc.binary_length(each), "t": each}), sort_keys=[("n", "ascending"), ("t", "ascending")])
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[own.indices.to_numpy(zero_copy_only=False)], own.dictionary.take(order)


def _pair(numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower half of numbers that _halves() has made."""
    both = _numbers(numbers).view("<i4").reshape(-1, 2).astype(np.int64)
    return both[:, 1], both[:, 0]


def _flat_documents(rows: Columns) -> tuple[pa.Array, dict]:
    """The paths of documents, and the documents from their rows in any order. Occurrences of units are there once, those through forward declarations as often as they are."""
    (document, paths), (symbol, symbols) = _by_length(rows["relative_path"]), _by_length(rows["symbol"])
    n, (what, kind) = len(paths), np.divmod(_numbers(rows["what"]), KINDS_OF_ROWS)
    (sl, sc), (lines, chars) = _pair(rows["start"]), _pair(rows["extent"])
    el, ec = ((first + more).astype(np.int32).astype(np.int64) for first, more in ((sl, lines), (sc, chars)))
    many = sl != el
    keys = [document * 2 + (kind == SYMBOL), sl << 32 | sc + 2**31, many * 2**33 + np.where(many, el, ec), ec, symbol, what, kind]  # as ranges.occurrence_keys has them
    order = np.lexsort(keys[::-1])
    again = kind[order] == OCCURRENCE
    again[:1] = False
    for key in keys:
        own = key[order]
        again[1:] &= own[1:] == own[:-1]
    told = kind[order] == SYMBOL
    placed, told = order[~told & ~again], order[told]
    four = np.stack([sl, sc, el, ec], axis=1)[placed]
    kept = np.ones(four.shape, bool)
    kept[:, 2] = many[placed]
    occurrences = {"range": (four[kept], kept.sum(axis=1)), "symbol": symbols.take(pa.array(symbol[placed])), "roles": what[placed]}
    each = lambda at: np.bincount(document[at], minlength=n)
    own = {"relative_path": paths, "language": pa.array(["CPP"] * n), "occurrences": (occurrences, each(placed)), "symbols": (rows["told"].take(pa.array(told)), each(told))}
    return paths, {"documents": (own, np.ones(n, np.int64))}


def _externals(rows: Columns) -> dict:
    s, counts = _each(rows["of"])
    return {"external_symbols": (_symbols(s), counts)}


def _about(rows: Columns) -> dict:
    n = len(rows["tool"])
    one = np.ones(n, np.int64)
    tool = {"name": rows["tool"], "version": rows["version"]}, one
    return {"metadata": {"tool_info": tool, "project_root": rows["project_root"], "text_document_encoding": one}}


def _forward(rows: Columns) -> dict:
    r, counts = _each(rows["references"])
    return {"forward_decls": {"suffix": rows["suffix"], "documentation": rows["doc"], "references": ({"range": _ranges(r), "relative_path": r["relative_path"]}, counts)}}


_FRAGMENT = "fragment binary"
#: Rows that are encoded at once.
AT_ONCE = 512


def fragments(rows: DataFrame, fields: wire.Fields, make: Callable[[Columns], dict]) -> DataFrame:
    """A message for each row, in the order of rows. A field for which make has no counts is there once in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                own = batch.slice(i, AT_ONCE)
                one = np.ones(own.num_rows, np.int64)
                message = {k: v if isinstance(v, tuple) else (v, one) for k, v in make(dict(zip(own.schema.names, own.columns, strict=True))).items()}
                yield pa.RecordBatch.from_arrays([wire_columns.binary(*wire_columns.encode(fields, message, own.num_rows))], ["fragment"])

    return rows.mapInArrow(run, _FRAGMENT)


def _halves(upper: Column, lower: Column) -> Column:
    """Two numbers as one, which takes fewer bytes in a shuffle."""
    return F.shiftleft(upper, 32).bitwiseOR(lower.bitwiseAND(F.lit(2**32 - 1)))


def document_fragments(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """A message for each document of flat rows, in the order of paths. occurrences has is_forward.

    Rows are shuffled once, by ranges of paths, and never nested: nested documents would be shuffled again to be put in order. A partition's
    rows are sorted by one number, so that those of a document meet, and then its documents by their paths. Symbols are messages before
    that: Spark looks at the size of a batch for Python after each row, which takes long where columns are nested.
    """
    path, kind = F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.when(F.col("is_forward"), FORWARD).otherwise(OCCURRENCE)
    sl, sc, el, ec = (F.coalesce(c, F.lit(0)).cast("long") for c in ranges.RANGE)
    what = F.coalesce("roles", F.lit(0)).cast("long") * KINDS_OF_ROWS + kind
    o = occurrences.select(path, "symbol", _halves(sl, sc).alias("start"), _halves(el - sl, ec - sc).alias("extent"), what.alias("what"), F.lit(None).cast("binary").alias("told"))
    none = F.lit(0).cast("long")
    own = symbols.select(path, "symbol", "doc", *[c for c in symbols.columns if c == "relationships"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = _symbols(dict(zip(batch.schema.names, batch.columns, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], wire_columns.binary(*wire_columns.encode(wire.SYMBOL, told, batch.num_rows))], ["relative_path", "symbol", "told"])

    s = own.mapInArrow(encoded, "relative_path string, symbol string, told binary").select("relative_path", "symbol", none.alias("start"), none.alias("extent"), F.lit(SYMBOL).cast("long").alias("what"), "told")
    by_path = ranges.by_length(F.col("relative_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_documents(batches):
            paths, documents = _flat_documents(own)
            fragment = wire_columns.binary(*wire_columns.encode(_OF_DOCUMENTS, documents, len(paths)))
            yield pa.RecordBatch.from_arrays([paths.cast(pa.string()), fragment], ["relative_path", "fragment"])

    rows = o.unionByName(s).repartitionByRange(*by_path).withColumn("group", F.xxhash64("relative_path")).sortWithinPartitions("group")
    return rows.mapInArrow(run, f"relative_path string, {_FRAGMENT}").sortWithinPartitions(*by_path).select("fragment")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    at: int


class FragmentWriter(DataSourceArrowWriter):
    """Each task writes its fragments, in files of about MOST bytes; they get the names that the next reader sees when all of them are whole."""

    def __init__(self, path: str):
        self._path, self._run = path.rstrip("/"), uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self._path if ":" in self._path else f"file://{self._path}")

    def write(self, iterator) -> Written:
        task = TaskContext.get()
        store, folder = self._store()
        names, out, size = [], None, 0
        store.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                data, ends = wire_columns.own_bytes(batch.column("fragment"))
                at = 0
                while at < len(ends) - 1:
                    if out is None or size >= MOST:
                        if out is not None:
                            out.close()
                        names.append(f"_{self._run}-{task.partitionId()}-{task.taskAttemptId()}-{len(names)}")
                        out, size = store.open_output_stream(f"{folder}/{names[-1]}"), 0
                    to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + MOST - size))), len(ends) - 1)
                    out.write(data[ends[at] : ends[to]])
                    size += int(ends[to] - ends[at])
                    at = to
        finally:
            if out is not None:
                out.close()
        return Written(names, task.partitionId())

    def _move(self, messages, to: Callable[[fs.FileSystem, str, str], None]) -> None:
        store, folder = self._store()
        for m in messages:
            for i, name in enumerate(m.names if m is not None else []):
                to(store, f"{folder}/{name}", f"{folder}/{PREFIX}{m.at:08d}-{i:06d}")

    def commit(self, messages) -> None:
        self._move(messages, lambda store, old, new: store.move(old, new))

    def abort(self, messages) -> None:
        self._move(messages, lambda store, old, new: store.delete_file(old))


class FragmentSink(DataSource):
    """A sink of the format index_fragments: rows of one column fragment, in their order, into a new folder that pyarrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "index_fragments"

    def schema(self) -> str:
        return _FRAGMENT

    def writer(self, schema, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options["path"])


def _save(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(FragmentSink)
    rows.write.format("index_fragments").option("path", path).mode("append").save()


def write_index_files(index: dict[str, DataFrame], path: str) -> None:
    """The whole index (plans.index) as files: metadata, a fragment a document in the order of paths, external symbols by 1024 in their order.

    Documents are nested ones, which are written before they are sorted (sorting by ranges looks at its rows twice), or flat parts (index.flat_index).
    """
    external = numbered(index["external_symbols"], ranges.by_length(F.col("symbol")), "place")
    groups = external.groupBy(F.floor((F.col("place") - 1) / EXTERNALS).alias("nr")).agg(F.sort_array(F.collect_list(F.struct("place", "symbol", F.coalesce("doc", F.lit(MISSING_DOC)).alias("doc"), "relationships"))).alias("of"))
    if "documents" in index:
        documents = fragments(durable(index["documents"]).orderBy(*ranges.by_length(F.col("relative_path"))), wire.INDEX, _documents)
    else:
        documents = document_fragments(index["placed"], index["symbols"])
    parts = [fragments(index["metadata"], wire.INDEX, _about), documents, fragments(groups.orderBy("nr"), wire.INDEX, _externals)]
    _save(parts[0].unionByName(parts[1]).unionByName(parts[2]), path)


def write_forward_files(groups: DataFrame, path: str) -> None:
    """Forward declarations (merge.forward_groups: task_id, suffix, doc, references) as files, a fragment a suffix and unit."""
    _save(fragments(groups.orderBy(*ranges.by_length(F.col("suffix"))), wire.FORWARD_INDEX, _forward), path)
