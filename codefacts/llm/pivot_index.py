"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its nearest pivots in order (pivots are a bounded, spread sample of the vectors; their number follows
the square root of the number of different vectors). Each pivot has an inverted list of the vectors that name it. Vectors on
a list are compared by the number of pivots that they share; those that share enough are verified by cosine in double
precision. A pair that shares several lists is verified on the one with the smallest pivot only.

A list of over `long_list` vectors is taken apart by a second, larger pivot of its vectors, if they name more than one (where all
vectors are close to one another, there is one pivot, and its list stays whole). Since a pair shares two pivots at
least, it meets in the list of its two smallest common ones, and only there. So lists grow with the vectors over the square
of the number of pivots, and work stays in proportion where the pivots have reached their bound.

Lists are cut into blocks of a bounded number of vectors, and each pair of blocks is a group of its own, so a hot list is
spread over many tasks. A group returns, per vector, how many links it has there and the smallest vector of its part of the
links; pairs themselves are never rows. Vectors with equal components are one class from the start, with a count.

Defined results. Vectors link only within a label and a number of components. A null label, vector or component, a
component that isn't finite, a zero vector, or a null vec_id: no links, component_id = vec_id, kept. Every row is a vector
of its own, so rows that repeat a vector link with each other. Added columns replace input columns of the same names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import components, cut, discard, spare, without

ADDED = ("n_links", "component_id", "kept")
DESCRIBED = "vec_id bigint, label string, dims int, n bigint, unit array<double>, near array<int>"


def spread(units: np.ndarray, most: int, apart: float = 0.95) -> np.ndarray:
    """At most `most` of the unit vectors, each the farthest from those before it, while one has a cosine below `apart` to them all."""
    chosen, near = [0], units @ units[0]
    while len(chosen) < most and near.min() < apart:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def choose_pivots(classes: DataFrame, most: int, kinds: int = 64) -> dict[int, np.ndarray]:
    """Unit pivots by number of components: up to m = 2 * sqrt(vectors of that number) (at most `most`) from 4 * m of them in the order of a hash.

    Pivots stand apart, so the vectors of a tight cluster have the same pivots in nearly the same order. The `kinds` most
    frequent numbers of components have pivots; vectors of others are one list each, in blocks.
    """
    counts = classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(kinds).collect()
    out = {}
    for dims, n in counts:
        m = max(16, min(most, math.ceil(2 * math.sqrt(n))))
        rows = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id"), "vec_id", "label").select("vector").limit(4 * m).collect()
        x = np.array([v for (v,) in rows], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        out[dims] = spread(x / np.linalg.norm(x, axis=1, keepdims=True), m)
    return out


def nearest(units: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` nearest pivots of each unit vector, nearest first; equals in the order of pivots."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int32)


def _describe(tables, pivots: dict[int, np.ndarray], depth: int):
    for t in tables:
        for dims, own in t.groupby("dims"):
            x = np.stack(own["vector"].to_numpy()).astype(np.float64)
            x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
            near = nearest(x, pivots[dims], depth) if dims in pivots else np.full((len(x), 1), -1, np.int32)
            yield pd.DataFrame({"vec_id": own["vec_id"], "label": own["label"], "dims": own["dims"], "n": own["n"], "unit": list(x), "near": list(near)})


def links(rows: pd.DataFrame, pivot: int, next_pivot: int, first: int, second: int, least: float, shared: int) -> pd.DataFrame:
    """Of two blocks of a list (or one, if first == second): per linked vector, its links and the smallest vec_id joined to it.

    The list is that of a pivot, or of two (next_pivot >= 0), which are then the smallest that a pair shares.
    """
    rows = rows.sort_values("vec_id", kind="stable", ignore_index=True)
    ids, n, block = rows["vec_id"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    units, near = np.stack(rows["unit"].to_numpy()), np.stack(rows["near"].to_numpy())
    names, place = np.unique(near, return_inverse=True)
    held = np.zeros((len(rows), len(names)), np.float32)
    np.put_along_axis(held, place.reshape(near.shape), 1, axis=1)
    common = held[a] @ held[b].T
    last = int(np.searchsorted(names, max(pivot, next_pivot), "right"))
    upto = held[a, :last] @ held[b, :last].T
    good = (common >= min(shared, near.shape[1])) & (upto == (1 if next_pivot < 0 else 2)) & (units[a] @ units[b].T >= least)
    if first == second:
        good &= a[:, None] < b[None, :]
    i, j = np.nonzero(good)
    i, j = a[i], b[j]
    count, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    np.add.at(count, i, n[j])
    np.add.at(count, j, n[i])
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(count)
    return pd.DataFrame({"vec_id": ids[some], "links": count[some], "root": ids[root[some]]})


def near_vectors(vectors: DataFrame, least: float = 0.98, depth: int = 12, shared: int = 2, most_pivots: int = 4096, block_rows: int = 512, long_list: int = 4096) -> DataFrame:
    """vectors with n_links (rows linked directly), component_id and kept, for links of cosine >= least within a label."""
    if shared < 2:
        raise ValueError("a pair has to share two pivots at least")
    vectors = without(vectors, *ADDED)
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    key = [F.col("label").cast("string").alias("label"), F.size(v).alias("dims"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("vector"), v).alias("h2")]
    rows = vectors.where(usable).select(F.col("vec_id").cast("long"), *key, v.cast("array<double>").alias("vector"))
    by = ["label", "dims", "h1", "h2"]
    classes = cut(rows.groupBy(*by).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    pivots = choose_pivots(classes, most_pivots)
    described = cut(classes.select("vec_id", "label", "dims", "n", "vector").mapInPandas(lambda t: _describe(t, pivots, depth), DESCRIBED), "described")
    posting = described.withColumn("pivot", F.explode("near"))
    lists = ["label", "dims", "pivot"]
    size = cut(posting.groupBy(*lists).agg(F.count("*").alias("size")), "sizes")
    longer = F.explode(F.filter("near", lambda q: q > F.col("pivot")))
    posting = posting.join(size, lists)
    short = (F.col("size") <= long_list) | (F.size("near") < 2)  # with one pivot in all there is no second one to take a list apart by
    few, many = posting.where(short), posting.where(~short)
    posting = few.withColumn("next_pivot", F.lit(-1)).unionByName(many.withColumn("next_pivot", longer)).drop("size")
    lists = [*lists, "next_pivot"]
    sizes = cut(posting.groupBy(*lists).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks")
    posting = posting.join(sizes, lists).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = posting.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.select(*lists, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "n", "unit", "near")

    def of(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return links(own, key[2], key[3], key[4], key[5], least, shared)

    found = cut(paired.groupBy(*lists, "i", "j").applyInPandas(of, "vec_id bigint, links bigint, root bigint"), "links")
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vectors").withColumnRenamed("id", "vec_id")
    degree = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    result = classes.select(*by, "vec_id", "n").join(degree, "vec_id", "left").join(joined, "vec_id", "left")
    result = cut(result.select(*by, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "vec_id").alias("component")), "result")
    for table in (classes, described, size, sizes, found):
        discard(table)
    wanted, of = spare(vectors, "class_key"), spare(vectors, "of_class")
    keyed = vectors.select("*", F.when(usable, F.struct(*key)).alias(wanted))
    out = keyed.join(result.select(F.struct(*by).alias(of), "links", "component").select(F.struct(of, "links", "component").alias(of)), F.col(wanted) == F.col(f"{of}.{of}"), "left")
    own = F.col("vec_id").cast("long")
    component = F.coalesce(f"{of}.component", own)
    return out.select(*[F.col(f"`{c}`") for c in vectors.columns], F.coalesce(f"{of}.links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(own).alias("kept"))
