"""Suffix-array dedup with a logarithmic family of indexes.

Which suffixes. A suffix array over every byte would be several times the size of the corpus, so suffixes are sampled by
content: in each run of 200 bytes, the suffix whose first 80 bytes have the smallest hash (leftmost of equals) stands for
the run. Equal runs choose alike, wherever they are, so no long match is lost, and about one suffix in 61 bytes remains.
An array holds the places of its suffixes in suffix order: by their first eight bytes, then by a 64-bit fingerprint of
their first 80, so that those with 80 bytes in common are neighbours. (A match takes 200 bytes, so the order of suffixes that
part between byte 8 and byte 80 is of no use to it; the bytes themselves would make an array larger than its text.)

The family. Documents come in batches. Each batch gets an array of its own. Arrays of equal rank are merged with it, as in a
binary counter, so that a suffix is rewritten a logarithmic number of times, and neighbours in the merged array that agree in
80 bytes are matches, also within a batch. The arrays of other ranks are scanned side by side with the new one. Only suffixes
that these scans have found go on.

From suffixes to bytes. A matching suffix stands for up to 121 runs of 200 bytes. If another suffix of its kind stands for
the very same bytes, all its runs repeat. Where matches begin or end, its runs are looked at by eights: eight neighbours share
193 bytes, and if these don't repeat, none of the eight does; if all their bytes repeat, all eight do; otherwise each run is
hashed and counted by itself. At each step one copy of every kind stays in to compare with. Fingerprints and further hashes
are compared together, 128 bits.

Defined results. Every row is a document of its own, repeated rows included. A null text is empty; texts under 200 bytes
lose nothing. Matches never cross rows. Added columns replace input columns of the same names.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm.buffers import Spans, chunks, mix, utf8
from codefacts.llm.common import children, cut, delete, discard, fresh_path, spare, without

PREFIX, LENGTH, EIGHT = 80, 200, 8
ADDED = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
SEGMENT = 8 << 20
_LOW = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n, step = len(x) - width + 1, 1
    x = x.copy()
    while step * 2 <= width:
        np.minimum(x[: len(x) - step], x[step:], out=x[: len(x) - step])
        x = x[: len(x) - step]
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n]) if step < width else x[:n]


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that sorts like them."""
    eight = data[at[:, None] + np.arange(8)].astype(np.uint64)
    return (eight << np.arange(56, -8, -8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)


def sampled(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """The sampled suffixes of a buffer of texts: row, first run's start in the row, further runs, start of the suffix after that of the first run, first bytes, fingerprint, hash of all bytes of its runs."""
    parts = []
    for base in range(0, max(len(data) - length + 1, 0), SEGMENT):
        piece = data[base : base + SEGMENT + length - 1]
        spans, n = Spans(piece), len(piece) - length + 1
        prefixes = spans.windows(prefix)
        at = (_sliding_min((prefixes & ~_LOW) | np.arange(len(prefixes), dtype=np.uint64), length - prefix + 1) & _LOW).astype(np.int64)
        run = np.arange(base, base + n)
        row = np.searchsorted(offsets, run, "right") - 1
        good = run + length <= offsets[row + 1]
        first = np.flatnonzero(good & np.concatenate(([True], (at[1:] != at[:-1]) | ~good[:-1])))
        last = np.flatnonzero(good & np.concatenate(((at[1:] != at[:-1]) | ~good[1:], [True])))
        parts.append((row[first], run[first] - offsets[row[first]], last - first, at[first] - first, _leading(piece, at[first]), prefixes[at[first]], spans.hash(first, last + length)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_PLACE = "k bigint, at int, more smallint, rel smallint"
#: A suffix in an array: its first bytes, the fingerprint of its prefix, its text and its place there.
SUFFIX = "p bigint, fp bigint, k bigint, at int"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for start, _, data, offsets in chunks(batch.column(0)):
            row, at, _, rel, leading, prints, _ = sampled(data, offsets)
            same = np.flatnonzero((row[1:] == row[:-1]) & ((at + rel)[1:] == (at + rel)[:-1])) + 1
            row, at, leading, prints = (np.delete(x, same) for x in (row, at + rel, leading, prints))
            yield pa.RecordBatch.from_arrays([_signed(leading), _signed(prints), pa.array(key[start + row]), pa.array(at.astype(np.int32)), pa.array(part[start + row], pa.int32())], ["p", "fp", "k", "at", "part"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column(1).to_numpy(zero_copy_only=False)
        for start, _, data, offsets in chunks(batch.column(0)):
            row, at, more, rel, _, prints, whole = sampled(data, offsets)
            own = [pa.array(at.astype(np.int32)), pa.array(more.astype(np.int16)), pa.array(rel.astype(np.int16))]
            yield pa.RecordBatch.from_arrays([_signed(prints), _signed(whole), pa.array(key[start + row]), *own], ["fp", "whole", "k", "at", "more", "rel"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted part of an array with `twice`, whether a row agrees with one of its neighbours, and `edge`, whether it is the first or the last."""
    last, held, first = None, None, True

    def marked(batch: pa.RecordBatch, following: tuple | None) -> pa.RecordBatch:
        nonlocal last, first
        keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
        equal = (keys[:, 1:] == keys[:, :-1]).all(axis=0)
        twice, edge = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        twice[0] |= last == tuple(keys[:, 0])
        twice[-1] |= following == tuple(keys[:, -1])
        edge[0], edge[-1] = first, following is None
        last, first = tuple(keys[:, -1]), False
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(twice), pa.array(edge)], [*batch.schema.names, "twice", "edge"])

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield marked(held, (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()))
            held = batch
    if held is not None:
        yield marked(held, None)


def _opened(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The groups of `width` neighbouring runs of the suffixes `edges` of each text, counted back from the suffix: what all runs of
    the group share (core), and the bytes of those that the suffix stands for (whole)."""
    for batch in batches:
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        for start, end, data, offsets in chunks(batch.column(0)):
            own = batch.column(2).slice(start, end - start)
            sizes, flat = np.diff(own.offsets.to_numpy()), own.flatten()
            fp = flat.field(0).to_numpy()
            at, more, rel = (flat.field(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            row = np.repeat(np.arange(end - start), sizes)
            suffix = at + rel
            low, high = (rel - more) // width, rel // width
            n = high - low + 1
            one = np.repeat(np.arange(len(n)), n)
            group = low[one] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.maximum(at[one], suffix[one] - width * group - width + 1)
            last = np.minimum((at + more)[one], suffix[one] - width * group)
            base, spans = offsets[row[one]], Spans(data)
            core_start = base + suffix[one] - width * group
            core = spans.hash(core_start, core_start - width + 1 + LENGTH) if width > 1 else spans.hash(base + first, base + first + LENGTH)
            core = mix(core + group.astype(np.uint64))
            whole = mix(spans.hash(base + first, base + last + LENGTH) + (suffix[one] - first).astype(np.uint64))
            place = [pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int16)), pa.array((suffix[one] - first).astype(np.int16))]
            yield pa.RecordBatch.from_arrays([pa.array(fp[one]), _signed(core), _signed(whole), pa.array(keys[start + row[one]]), *place], ["fp", "core", "whole", "k", "at", "more", "rel"])


def _cut_out(batches: Iterator[pa.RecordBatch], text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their spans (last column: lists of start and end)."""
    for batch in batches:
        out, spans = {c: [] for c in ADDED}, batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            data, _ = utf8(batch.column(text).slice(i, 1))
            edge = np.zeros(len(data) + 1, np.int64)
            own = spans[i].values
            if own is not None and len(own):
                np.add.at(edge, own.field(0).to_numpy(), 1)
                np.add.at(edge, own.field(1).to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(turn) // 2)
            out["spans"].append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
            out["kept"].append(data[~gone].tobytes())
        kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(out[c], k) for c, k in zip(ADDED, kinds, strict=True)]], [*names, *ADDED])


class SuffixFamily:
    """A logarithmic family of suffix arrays in a folder, which may hold one from earlier batches.

    An array of rank r holds the sampled suffixes of 2**r batches (SUFFIX rows), range-partitioned and sorted in suffix order,
    each with whether it has 80 bytes in common with a neighbour. A manifest names the arrays and the matches found so far;
    it is written last, so a family that a lost driver leaves behind is the one before its last batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = max((int(x.removeprefix("manifest-")) for x in children(spark, self.path) if x.startswith("manifest-")), default=0)
        rows = spark.read.schema("rank int, name string").parquet(f"{self.path}/manifest-{self.version}").collect() if self.version else []
        self.levels = sorted(((r.rank, r.name) for r in rows if r.rank >= 0), reverse=True)
        self.matches = [r.name for r in rows if r.rank < 0]

    def table(self, name: str) -> DataFrame:
        kind = f"{SUFFIX}, twice boolean, edge boolean" if name.startswith("array") else "p bigint, fp bigint"
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _array(self, rows: DataFrame) -> str:
        """rows in suffix order. Equal suffixes are dealt on by their places, so that a hot one isn't a task's alone."""
        order = ["p", "fp", "k", "at"]
        return self._write(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"{SUFFIX}, twice boolean, edge boolean"), "array")

    def _scan(self, array: str) -> DataFrame:
        """The suffixes (p, fp) that an array holds twice or more: neighbours that agree, in a part of it or over its edge."""
        rows = self.table(array)
        over = rows.where("edge").groupBy("p", "fp").count().where("count > 1").select("p", "fp")
        return rows.where("twice").select("p", "fp").union(over).distinct()

    def add(self, suffixes: DataFrame) -> None:
        """Put in the array of a new batch (SUFFIX rows).

        Arrays of the ranks that it fills up are merged with it, and the merged array is scanned; the others are scanned side
        by side with it, and stay as they are.
        """
        new, rank, merged = self._array(suffixes), 0, []
        while self.levels and self.levels[-1][0] == rank:
            merged.append(self.levels.pop()[1])
            rank += 1
        found, own = None, cut(self.table(new).select("p", "fp").distinct(), "keys") if self.levels else None
        for _, other in self.levels:
            both = self.table(other).select("p", "fp").distinct().join(own, ["p", "fp"], "left_semi")  # a hot suffix is one row a part before the shuffle
            found = both if found is None else found.union(both)
        if merged:
            old = [*merged, new]
            new = self._array(functools.reduce(DataFrame.union, [self.table(name) for name in old]))
        else:
            old = []
        found = self._scan(new) if found is None else found.union(self._scan(new))
        self.matches.append(self._write(found, "matches"))
        if own is not None:
            discard(own)
        self.levels.append((rank, new))
        self.version += 1
        rows = [*self.levels, *((-1, name) for name in self.matches)]
        self.spark.createDataFrame(rows, "rank int, name string").coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")
        for name in [*old, f"manifest-{self.version - 1}"]:
            delete(self.spark, f"{self.path}/{name}")

    def matched(self) -> DataFrame:
        """The suffixes (p, fp) that stand in the batches so far twice or more."""
        return functools.reduce(DataFrame.union, [self.table(name) for name in self.matches]).distinct()

    def drop(self) -> None:
        """Delete the family."""
        delete(self.spark, self.path)


def _settle(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pieces that repeat as they are, one copy of each kind of rows that agree in `by` but not in all their bytes), both written."""
    kinds = cut(rows.groupBy(*by, "whole").agg(F.count("*").alias("n"), F.min(F.struct("k", "at", "more", "rel")).alias("one")), "kinds")
    many = rows.join(kinds.where("n > 1").select(*by, "whole"), [*by, "whole"], "left_semi")
    mixed = cut(kinds.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1").select(*by), "mixed")
    pieces = cut(many.select("k", F.col("at").alias("start"), (F.col("at") + F.col("more") + LENGTH).alias("end")), "pieces")
    edges = cut(kinds.join(mixed, by, "left_semi").select("fp", "one.*"), "edges")
    discard(kinds)
    discard(mixed)
    discard(rows)
    return pieces, edges


def _open(keyed: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    lists = edges.groupBy("k").agg(F.collect_list(F.struct("fp", "at", "more", "rel")).alias("edges"))
    texts = keyed.join(lists, "k").select("text", "k", "edges")
    return texts.mapInArrow(lambda b: _opened(b, width), f"fp bigint, core bigint, whole bigint, {_PLACE}")


def suffixes_of(keyed: DataFrame, batches: int = 1) -> DataFrame:
    """The sampled suffixes of keyed (text, k) as SUFFIX rows and part, the number of their batch."""
    part = F.pmod(F.xxhash64("k"), F.lit(batches)).cast("int")
    return keyed.select("text", "k", part.alias("part")).mapInArrow(_places, f"{SUFFIX}, part int")


def repeated_spans(docs: DataFrame, batches: int = 4) -> DataFrame:
    """Per document key k, the pieces [start, end) of it that repeated runs of 200 bytes cover (they may overlap), as a written table."""
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("k"))
    rows, family = cut(suffixes_of(keyed, batches), "places", "part"), SuffixFamily(docs.sparkSession, fresh_path(docs.sparkSession, "family"))
    for i in range(batches):
        family.add(rows.where(F.col("part") == i).drop("part"))
    discard(rows)
    matched = cut(family.matched().select("fp").distinct(), "matched")
    family.drop()
    suffixes = cut(keyed.mapInArrow(_suffixes, f"fp bigint, whole bigint, {_PLACE}").join(matched, "fp", "left_semi"), "suffixes")
    discard(matched)
    pieces, edges = _settle(suffixes, ["fp"])
    eights = cut(_open(keyed, edges, EIGHT), "eights")
    discard(edges)
    more, edges = _settle(eights, ["fp", "core"])
    runs = cut(_open(keyed, edges, 1), "runs")
    discard(edges)
    twice = cut(runs.groupBy("fp", "core").count().where("count > 1").select("fp", "core"), "twice")
    single = runs.join(twice, ["fp", "core"], "left_semi").select("k", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    found = cut(pieces.union(more).union(single).groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("pieces")), "found")
    for table in (runs, twice, pieces, more):
        discard(table)
    return found


def remove_repeats(docs: DataFrame, batches: int = 4) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (maximal, in bytes) and kept (the other bytes, joined).

    Every byte of a run of 200 bytes that starts anywhere else too is removed.
    """
    docs = without(docs, *ADDED)
    key, own = spare(docs, "key"), spare(docs, "own_spans")
    pieces = repeated_spans(docs, batches).select(F.col("k").alias(key), F.col("pieces").alias(own))
    whole = docs.join(pieces, F.xxhash64("doc_id", "text") == F.col(key), "left").drop(key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds += ", n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    at, names = docs.columns.index("text"), docs.columns
    return whole.mapInArrow(lambda batches: _cut_out(batches, at, names), kinds)
