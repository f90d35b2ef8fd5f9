"""Line dedup: lines that many documents share go, the rest stay in their places.

Normalised lines are exploded and hashed (128 bits), the documents of each hash are counted, and each document is put
together again from the lines whose positions are not on the list of frequent ones. The frequent keys are a written table,
so that the join that marks lines is one of two plain shuffles, which AQE splits at a key that very many lines have.

Defined results. Every row is a document of its own, repeated rows and repeated ids included: a line in ten rows of one
doc_id is in ten documents. A null text stays null and counts as one empty line. A line that is empty after stripping never
goes (its key is shorter than min_chars). Output columns `n_lines` and `n_dropped` replace columns of these names in any
case; all other columns pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import SPACES, ascii_lower, cut, spare, without


def line_key(line: Column) -> Column:
    """128 bits of a line without outer white space and with A-Z lower-cased; null below one code point."""
    plain = ascii_lower(F.btrim(line, F.lit(SPACES)))
    return F.struct(F.char_length(plain).alias("n"), F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit("line"), plain).alias("k2"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without(lines: Column, gone: Column) -> Column:
    """The lines but those at the ascending positions `gone`, joined: the slices between neighbours of the list."""
    edge = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edge) - 1),
        lambda i: F.slice(lines, F.get(edge, i - 1) + 2, F.get(edge, i) - F.get(edge, i - 1) - 1),
    )
    return F.array_join(F.flatten(runs), "\n")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with frequent lines taken out of `text`, and with n_lines and n_dropped (long).

    A key of at least min_chars code points that at least min_docs rows hold is frequent. The counting shuffle carries one
    row per key and task after partial aggregation; the join that marks lines carries keys and positions, not text.
    """
    docs = without(docs, "n_lines", "n_dropped")
    seen = docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col("text")), line_key))).alias("k"))
    counts = seen.where(F.col("k.n") >= min_chars).groupBy("k.k1", "k.k2").count()
    frequent = cut(counts.where(F.col("count") >= min_docs).select("k1", "k2"), "frequent")
    placed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    placed = placed.select("doc_id", "text_key", "at", line_key(F.col("line")).alias("k")).where(F.col("k.n") >= min_chars)
    placed = placed.select("doc_id", "text_key", "at", "k.k1", "k.k2").join(frequent, ["k1", "k2"])
    gone = placed.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    key, at = spare(docs, "key"), spare(docs, "gone")
    gone = gone.select(F.struct("doc_id", "text_key").alias(key), F.col("gone").alias(at))
    kept = docs.join(gone, F.struct(docs["doc_id"], F.xxhash64("text").alias("text_key")).eqNullSafe(F.col(key)), "left")
    lines = _lines(F.col("text"))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(_without(lines, F.col(at))).alias("text")
    return kept.select(
        *[text if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
    )
