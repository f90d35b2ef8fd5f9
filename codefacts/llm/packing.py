"""Best-fit packing with conflicts: sequences of a fixed number of words from whole documents.

Rows are dealt evenly over shards of a bounded number of rows, and each shard is packed by itself: documents in falling
size, each into the tightest bin that it fits and may join. A bin carries bitmaps of the sources and of the duplicate
clusters in it; the successor search by residual goes on past bins whose bitmaps conflict until the tightest compatible
one is found, or a new bin is opened. Shards are dealt by round-robin, so a hot source or cluster is spread evenly.

A bin takes `per_source` documents of a source. By default that is 2 with eight sources or more, and otherwise as many as make
16 documents a bin possible, so that few sources don't leave bins half empty.

Defined results. A document longer than the capacity fills bins of its own and its rest is packed. A document without words
(or a null text) is returned once with a null bin. Equal sizes go in the order of doc_id (nulls first). A null source or
text is never in conflict. Every row is packed, repeated rows included, and rows of one cluster never share a bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut, word_count

SCHEMA = "doc_id bigint, piece int, first_word bigint, n_words bigint, bin_id bigint, bin_offset bigint"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, of sizes 1 to capacity. Sources and clusters are bit numbers, -1 for none.

    A bin holds at most per_source items of a source (one bitmap per level) and one item of a cluster.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    levels: list[list[int]] = []
    taken: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (levels[order[at][1]][-1] & s or taken[order[at][1]] & c):
            at += 1
        if at == len(order):
            left, b = capacity, len(levels)
            levels.append([0] * per_source)
            taken.append(0)
        else:
            left, b = order.pop(at)
        carry = s
        for i, level in enumerate(levels[b]):
            levels[b][i], carry = level | carry, level & carry
        taken[b] |= c
        out.append((b, capacity - left))
        if left > size:
            insort(order, (left - size, b))
    return out


def _pack_shard(frames: Iterator[pd.DataFrame], capacity: int, per_source: int) -> Iterator[pd.DataFrame]:
    own = [f for f in frames if len(f)]
    if not own:
        return
    d = pd.concat(own, ignore_index=True)
    rest = (d["size"] % capacity).where(d["size"] % capacity > 0, d["size"].clip(upper=capacity))
    d["rest"], d["full"] = rest, (d["size"] - rest) // capacity
    d = d.sort_values(["rest", "known", "doc_id", "cluster"], ascending=[False, True, True, True], na_position="first", kind="stable", ignore_index=True)
    shard = int(d["shard"].iloc[0]) << 32
    items = d[d["rest"] > 0]
    source = pd.factorize(items["source"])[0]
    many = items["cluster"].duplicated(keep=False) & items["cluster"].notna()
    cluster = pd.factorize(items["cluster"].where(many))[0]
    bins = best_fit(items["rest"].tolist(), source.tolist(), cluster.tolist(), capacity, per_source)
    rows, fresh = [], max((b for b, _ in bins), default=-1) + 1
    placed = iter(bins)
    for doc_id, last, full in zip(d["doc_id"].astype("object").where(d["known"], None), d["rest"], d["full"], strict=True):
        for i in range(full):
            rows.append((doc_id, i, i * capacity, capacity, shard | fresh, 0))
            fresh += 1
        b, offset = next(placed) if last else (None, None)
        rows.append((doc_id, full, full * capacity, last, None if b is None else shard | b, offset))
    table = pd.DataFrame(rows, columns=["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_offset"], dtype=object)
    yield table.astype({"doc_id": "Int64", "piece": "int32", "first_word": "int64", "n_words": "int64", "bin_id": "Int64", "bin_offset": "Int64"})


def pack(docs: DataFrame, capacity: int = 2048, per_source: int | None = None, shard_rows: int = 16_384, cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin_id, bin_offset. Bins hold at most `capacity` words.

    Rows with equal texts are a duplicate cluster, or rows with equal values of `cluster` (as of near_duplicates) if it is
    given. Only ids, sizes, sources and digests are shuffled. A shard of
    shard_rows rows is packed in one task whose memory that parameter bounds.
    """
    of = F.when(F.col("text").isNotNull(), F.xxhash64("text").cast("string")) if cluster is None else cluster.cast("string")
    narrow = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), of.alias("cluster"))
    narrow = narrow.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    narrow = cut(narrow, "sizes")
    shards = max(1, math.ceil(narrow.count() / shard_rows))
    if per_source is None:
        per_source = max(2, math.ceil(16 / max(1, narrow.select("source").distinct().limit(8).count())))
    dealt = narrow.repartition(shards).withColumn("shard", F.spark_partition_id())
    return dealt.mapInPandas(lambda frames: _pack_shard(frames, capacity, per_source), SCHEMA)
