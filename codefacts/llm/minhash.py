"""MinHash near-dedup with tensored bands.

A table key would take ten minhashes; 1600 tables of them 16,000 minhashes a document. Tensoring forms each key as a pair:
one of 40 half-keys of five minhashes from collection A with one of 40 from collection B, so 400 minhashes a document serve
all 1600 tables. Two documents share a table when they share a half-key of A and one of B. At a similarity of 0.75 a pair
shares none with a chance of about 4e-5, and less above; texts that share a fifth of their shingles meet in one pair of
6000.

Confirmation is on whole shingle sets (64-bit hashes of shingles), and no row is a pair of members of a bucket:

1. Documents with equal sets are one class, which its smallest doc_id stands for. Copies go no further.
2. Each class is confirmed against one other, the smallest class that most of its A buckets have, if both share a table. The
   links give components.
3. Rows of A buckets that still hold several components form their table keys, pairs of half-keys of A and B. A bucket with a
   table in which two components meet stays open.
4. Components that meet in open buckets form families: each takes the smallest component that it meets, some times over.
   Where all components of a bucket agree, their members are compared as one family, else the bucket is a family itself.
5. A family is cut into blocks, and each pair of blocks that can join components is one group: an inverted index of the
   shingles of one block, which every member of the other looks up. A group returns a spanning forest of its links.

No pair that shares a table and could join two components is left out.

Defined results. Null, empty and wordless texts have no shingles, link with nothing and are kept. A text of fewer than five
words is one shingle. Rows that share a doc_id are one node; a row without doc_id links with nothing, and its
component_id is null. Added columns replace input columns of the same names, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.buffers import ASCII_LOWER, Spans, chunks, mix, words
from codefacts.llm.common import components, cut, discard, spare, without

SHINGLE, ROWS, HALVES = 5, 5, 40
#: A block of a family holds about so many documents, or so many shingles if that is less. HOPS: how far families reach.
BLOCK, BLOCK_ITEMS, HOPS = 512, 1 << 20, 2
_RNG = np.random.default_rng(75)
_STEPS = _RNG.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 31, (2 * HALVES * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIPS = _RNG.integers(0, 1 << 32, (2 * HALVES * ROWS, 1), dtype=np.uint32)
_JOIN = _RNG.integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDED = ("n_shingles", "component_id", "kept")
SET = ("n_shingles", "set_low", "set_high")
SIGNATURE = "doc_id bigint, text_key bigint, n_shingles bigint, set_low bigint, set_high bigint, a array<bigint>, b array<int>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a buffer."""
    data = ASCII_LOWER[data]
    first, last, row = words(data, offsets)
    hashes, n = Spans(data).hash(first, last), len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(n + 1))
    m = len(hashes) - SHINGLE + 1
    grams = np.zeros(max(m, 0), np.uint64)
    for i, step in enumerate(_STEPS):
        grams += hashes[i : i + max(m, 0)] * step
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            short = (hashes[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short] if b > a else [], np.uint64)))
    return out


def half_keys(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, B): the 64-bit half-keys of one set for either collection; each depends on its position."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, ((x[at : at + 1024] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    joined = (least.reshape(2 * HALVES, ROWS).astype(np.uint64) * _JOIN).sum(axis=1, dtype=np.uint64)
    keys = mix(joined + np.arange(2 * HALVES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys[:HALVES], keys[HALVES:]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            halves = [half_keys(s) if len(s) else (np.zeros(0, np.uint64),) * 2 for s in sets]
            low = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            high = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            lists = [_lists([h[k] for h in halves], kind) for k, kind in ((0, np.int64), (1, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(2).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), *lists], ["doc_id", "text_key", "n_shingles", "set_low", "set_high", "a", "b"])


def _lists(values: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([*values, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64) if kind is np.int64 else flat.astype(np.uint32).view(np.int32)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in chunks(batch.column(1)):
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), _lists([s.view(np.uint64) for s in sets], np.int64)], ["doc_id", "items"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and shingle set (items) of the documents in ids (doc_id), built again from their texts."""
    return docs.select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, items array<bigint>")


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets have 100 * intersection >= percent * union. Only sets of documents in a pair are shuffled."""
    sets = cut(sets_of(docs, pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y"))), "sets")
    both = pairs.join(sets.withColumnsRenamed({"doc_id": "x", "items": "of_x"}), "x").join(sets.withColumnsRenamed({"doc_id": "y", "items": "of_y"}), "y")
    shared = F.size(F.array_intersect("of_x", "of_y"))
    out = cut(both.where(100 * shared >= percent * (F.size("of_x") + F.size("of_y") - shared)).select("x", "y").distinct(), "confirmed")
    discard(sets)
    return out


def linked(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (x, y) that join the components c of rows (x, c, side, items) as far as similar members do, without cycles.

    Rows of side 1 look up those of side 2, rows of side 0 do both: an inverted index over the items.
    """
    base, queries = rows[rows["side"] != 1], rows[rows["side"] != 2]
    found: list[tuple[int, int]] = []
    if len(base) and len(queries):
        sizes = base["items"].map(len).to_numpy()
        items, owner = np.concatenate(base["items"].to_list()), np.repeat(np.arange(len(base)), sizes)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        names, of = np.unique(np.concatenate((base["c"].to_numpy(), queries["c"].to_numpy())), return_inverse=True)
        root, of_base, y = np.arange(len(names)), of[: len(base)], base["x"].to_numpy()
        for x, own, c in zip(queries["x"], queries["items"], of[len(base) :], strict=True):
            low, high = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
            n = high - low
            places = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.bincount(owner[places], minlength=len(base))
            good = np.flatnonzero((100 * shared >= percent * (sizes + len(own) - shared)) & (root[of_base] != root[c]))
            for j in good:
                a, b = root[of_base[j]], root[c]
                if a != b:
                    found.append((x, y[j]))
                    root[root == max(a, b)] = min(a, b)
    return pd.DataFrame(found, columns=["x", "y"], dtype="int64")


def _sharing(pairs: DataFrame, halves: DataFrame) -> DataFrame:
    """The pairs (x, y), whose half-keys of A meet, that share a half-key of B too, and so a table."""
    both = pairs.join(halves, "x").join(halves.withColumnsRenamed({"x": "y", "b": "b2"}), "y")
    return both.where(F.arrays_overlap("b", "b2")).select("x", "y")


def open_buckets(placed: DataFrame, halves: DataFrame) -> DataFrame:
    """The buckets (key) of placed (key, x, c) with a table in which two components meet.

    Table keys are counted by partial aggregates: the smallest and the largest component of each.
    """
    several = cut(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "several")
    rows = placed.join(several, "key", "left_semi").groupBy("x", "c").agg(F.collect_set("key").alias("keys")).join(halves, "x")
    tables = rows.select("c", F.explode("keys").alias("key"), "b").select("c", "key", F.explode("b").alias("b"))
    met = tables.groupBy("key", "b").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    return cut(met.select("key").distinct(), "open")


def families(members: DataFrame, hops: int = HOPS) -> DataFrame:
    """kind, family, x, c: the families of members (key, x, c) of open buckets. Any two members of a bucket share a family.

    A component takes the smallest label of its buckets, `hops` times. A bucket whose components have one label then is
    part of that family (kind 0), any other is one by itself (kind 1).
    """
    places = cut(members.select("key", "c").distinct(), "places")
    labels = places.groupBy("c").agg(F.min("c").alias("label"))
    for hop in range(hops):
        least = cut(places.join(labels, "c").groupBy("key").agg(F.min("label").alias("label")), "least")
        labels = cut(places.join(least, "key").groupBy("c").agg(F.min("label").alias("label")), f"labels-{hop}")
    agreed = places.join(labels, "c").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    of = F.when(F.col("label") == F.col("other"), F.struct(F.lit(0).alias("kind"), F.col("label").alias("family"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("key").alias("family")))
    agreed = cut(agreed.select("key", of.alias("of")), "agreed")
    return members.join(agreed, "key").select("of.kind", "of.family", "x", "c", "n").distinct()


def block_pairs(rows: DataFrame) -> DataFrame:
    """cell, side, x, c: members (kind, family, x, c, n) once for each pair of blocks that theirs is in.

    A large component has blocks of its own, which aren't compared with each other; the small ones share blocks.
    """
    by = ["kind", "family"]
    parts = lambda rows, items: F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("int")
    per = rows.groupBy(*by, "c").agg(F.count("*").alias("rows"), F.sum("n").alias("items"))
    per = per.withColumn("own", F.when((2 * F.col("rows") > BLOCK) | (2 * F.col("items") > BLOCK_ITEMS), F.col("c")))
    whole = per.groupBy(*by, "own").agg(F.sum("rows").alias("rows"), F.sum("items").alias("items"), F.count("*").alias("components"))
    whole = cut(whole.select(*by, "own", parts(F.col("rows"), F.col("items")).alias("blocks"), (F.col("components") > 1).alias("several")), "blocks")
    each = whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p, q = each.select(*by, F.col("own").alias("p"), F.col("i").alias("pi"), "several"), each.select(*by, F.col("own").alias("q"), F.col("i").alias("qi"))
    same_c = F.col("p").eqNullSafe(F.col("q"))
    order = F.struct(F.col("p").isNotNull(), F.coalesce("p", F.lit(0)), "pi") <= F.struct(F.col("q").isNotNull(), F.coalesce("q", F.lit(0)), "qi")
    cells = p.join(q, by).where(order & (~same_c | F.col("several"))).withColumn("cell", F.xxhash64(*by, "p", "pi", "q", "qi"))
    alone = same_c & (F.col("pi") == F.col("qi"))
    sides = F.when(alone, F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("own"), F.col("pi").alias("i"))))
    sides = sides.otherwise(F.array(F.struct(F.lit(1).alias("side"), F.col("p").alias("own"), F.col("pi").alias("i")), F.struct(F.lit(2).alias("side"), F.col("q").alias("own"), F.col("qi").alias("i"))))
    cells = cells.select(*by, "cell", F.explode(sides).alias("s")).select(*by, "cell", "s.side", F.coalesce("s.own", F.lit(0)).alias("own"), F.col("s.own").isNull().alias("mixed"), "s.i")
    at = cut(per.join(whole.withColumnRenamed("own", "w"), [*[per[c] == whole[c] for c in by], F.col("own").eqNullSafe(F.col("w"))]).select(*[per[c] for c in by], "c", "own", "blocks"), "at")
    placed = rows.join(at, [*by, "c"]).select(*by, "x", "c", F.coalesce("own", F.lit(0)).alias("own"), F.col("own").isNull().alias("mixed"), F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("i"))
    return placed.join(cells, [*by, "own", "mixed", "i"]).select("cell", "side", "x", "c")


def family_links(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between the components of members (key, x, c, n) that have similar members, enough to join them."""
    pairs = cut(block_pairs(cut(families(members), "families")), "cells")
    sets = cut(sets_of(docs, pairs.select(F.col("x").alias("doc_id"))), "sets").withColumnRenamed("doc_id", "x")
    return cut(pairs.join(sets, "x").groupBy("cell").applyInPandas(lambda rows: linked(rows, percent), "x bigint, y bigint"), "links")


def classes_of(signed: DataFrame) -> DataFrame:
    """n_shingles, set_low, set_high, x (the smallest doc_id), a, b of each set. A partial aggregate: copies don't meet in a task."""
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = some.groupBy(*SET).agg(F.min(F.struct("doc_id", "a", "b")).alias("one"))
    return cut(one.select(*SET, F.col("one.doc_id").alias("x"), "one.a", "one.b"), "classes")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id = component_id)."""
    docs = without(docs, *ADDED)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(whole.withColumn("text_key", F.xxhash64("text")).mapInArrow(_signatures, SIGNATURE), "signatures")
    classes = classes_of(signed)
    halves = classes.select("x", "b")
    posting = classes.select(F.explode("a").alias("key"), "x", F.col("n_shingles").alias("n"))
    buckets = cut(posting.groupBy("key").agg(F.min("x").alias("y"), F.max("x").alias("z")).where("y < z").select("key", "y"), "buckets")
    posting = cut(posting.join(buckets, "key"), "postings")
    chosen = posting.where("x <> y").groupBy("x", "y").count().groupBy("x").agg(F.max(F.struct("count", (-F.col("y")).alias("y"))).alias("m"))
    tried = cut(_sharing(chosen.select((-F.col("m.y")).alias("x"), F.col("x").alias("y")), halves), "pairs")
    links = confirmed(whole, tried, percent)
    found = components(links.select(F.col("y").alias("a"), F.col("x").alias("b")), "first").withColumnRenamed("id", "x")
    placed = cut(posting.join(found, "x", "left").select("key", "x", "n", F.coalesce("component_id", "x").alias("c")), "placed")
    more = family_links(whole, placed.join(open_buckets(placed, halves), "key", "left_semi"), percent)
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("low"), F.max(F.struct(*SET)).alias("high")).where("low <> high")
    repeated = cut(signed.select("doc_id", *SET).join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select(*SET, "x"), [*SET]).select("doc_id", "x").distinct(), "repeated")
    edges = links.union(more).union(repeated.select("x", F.col("doc_id").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(edges, "near").withColumnRenamed("id", "x")
    known = cut(classes.select(*SET, "x").join(joined, "x", "left").select(*SET, F.coalesce("component_id", "x").alias("component_id")), "known")
    other = repeated.select(F.col("doc_id").alias("x")).distinct().join(joined, "x").toDF("doc_id", "of_id")
    found = signed.select("doc_id", "text_key", *SET).distinct().join(known, [*SET], "left").join(other, "doc_id", "left")
    key, n, of = spare(docs, "text_key"), spare(docs, "size_of"), spare(docs, "component_of")
    found = found.select(F.struct("doc_id", "text_key").alias(key), F.col("n_shingles").alias(n), F.coalesce("component_id", "of_id").alias(of))
    own = F.col("doc_id").cast("long")
    keyed = docs.select("*", F.struct(own.alias("doc_id"), F.xxhash64("text").alias("text_key")).alias(f"{key}_"))
    out = keyed.join(found, F.col(f"{key}_").eqNullSafe(F.col(key)), "left")
    component = F.when(own.isNotNull(), F.coalesce(of, own))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(n).alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(own).alias("kept"))
