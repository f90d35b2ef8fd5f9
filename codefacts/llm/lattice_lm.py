"""Language-model scoring over a subword lattice.

The probability of a text is the sum over all its segmentations into pieces of a given vocabulary, each the product of the
probabilities of its pieces and of the end. Pieces of this vocabulary never cross words (a word starts with the mark "▁"), so
the sum factors into words, and a forward recursion in log space runs once for each different word of the corpus, not once
for each token; a word is then looked up for each document that holds it.

The vocabulary is that of a public tokenizer file. The file's scores are ranks of merges, not log-probabilities, so
they serve as the start (a power law of the rank) of two rounds of expectation-maximisation over the words of the training
rows, weighted by their counts: expected uses of each piece by forward and backward sums over the lattice. A character
that is no piece costs its UTF-8 bytes, which share one probability.

Word counts and lattice values are tables. The 65,536 most frequent training words, a fixed bound, are broadcast and
summed inside the tasks; all other words are joined by their 64-bit hash, so the vocabulary may be of any size.

Defined results. A null text is empty: one token, the end. Repeated rows are scored alike, each with a row of its own. A
null doc_id counts as the text "" for the choice of training rows. With no training rows, every count is 0 and pieces
keep their starting probabilities. The result has doc_id and the figures only, so extra columns can't clash.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.buffers import ASCII_LOWER, Spans, chunks, words
from codefacts.llm.common import cut

MARK, HOT_WORDS, LONG_WORD = "▁", 65_536, 48
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model in the order of its scores; those with capitals A-Z can't occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    good = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    return [p for p in (model.id_to_piece(i) for i in sorted(good, key=lambda i: (-model.get_score(i), i))) if not any("A" <= c <= "Z" for c in p) and MARK not in p[1:]]


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


class Lattice:
    """Segmentations of words into pieces. Ids 0 to n - 1 are pieces, n is any byte, n + 1 the end of a text."""

    def __init__(self, pieces: list[str], counts: np.ndarray | None = None):
        n = len(pieces)
        weights = 1.0 / (np.arange(n) + 10.0) if counts is None else counts[:n] + 0.01
        rest = [weights.min() * 256, weights.max()] if counts is None else [counts[n] + 0.01 * 256, counts[n + 1] + 0.01]
        self.pieces, self.log = pieces, np.log(np.concatenate((weights, rest)) / (weights.sum() + sum(rest)))
        self.byte, self._scores = float(self.log[n] - math.log(256)), self.log.tolist()
        self.ids, self.longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
        self.power = np.cumprod(np.full(self.longest + 1, _BASE, np.uint64)) * pow(int(_BASE), -1, 1 << 64)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        self.slot_bits = 20
        starts = np.searchsorted(self.keys >> np.uint64(64 - self.slot_bits), np.arange((1 << self.slot_bits) + 1, dtype=np.uint64))
        self.first = starts[:-1].astype(np.int32)
        sizes = np.diff(starts)
        self.used, self.deepest = sizes > 0, int(sizes.max())

    def _key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return (h + len(piece)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)

    def _find(self, raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in raw, piece ids) of the spans that are pieces."""
        keys = (raw + np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
        slots = (keys >> np.uint64(64 - self.slot_bits)).view(np.int64)
        rows = self.used.take(slots).nonzero()[0]  # most spans are no pieces, and most of these fall into empty slots
        keys, at = keys.take(rows), self.first.take(slots.take(rows))
        ids = np.full(len(rows), -1)
        for step in range(self.deepest):
            place = np.minimum(at + step, len(self.keys) - 1)
            hit = ((self.keys.take(place) == keys) & (ids < 0)).nonzero()[0]
            ids[hit] = self.order.take(place.take(hit))
        found = (ids >= 0).nonzero()[0]
        return rows.take(found), ids.take(found)

    def _edges(self, own: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, rows, ids, log scores) over words of equal length, in the order of `from`."""
        n, length = len(self.pieces), len(own[0])
        codes = np.array(own, f"U{length}").view(np.uint32).reshape(len(own), length)
        sums = np.zeros((length + 1, len(own)), np.uint64)
        for i in range(length):
            sums[i + 1] = sums[i] * _BASE + codes[:, i] + np.uint64(1)
        for i in range(length):
            for size in range(1, min(self.longest, length - i) + 1):
                rows, ids = self._find(sums[i + size] - sums[i] * self.power[size], size)
                if len(rows):
                    yield i, i + size, rows, ids, self.log[ids]
                if size == 1 and len(rows) < len(own):
                    other = np.setdiff1d(np.arange(len(own)), rows, assume_unique=True)
                    c = codes[other, i]
                    yield i, i + 1, other, np.full(len(other), n), self.byte * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))

    def _from(self, word: str, i: int) -> Iterator[tuple[int, int, float, int]]:
        """(to, id, log score, uses) of the edges from a place of a word."""
        for j in range(i + 1, min(len(word), i + self.longest) + 1):
            p = self.ids.get(word[i:j])
            if p is not None:
                yield j, p, self._scores[p], 1
            elif j == i + 1:
                n = len(word[i].encode("utf-8", "surrogatepass"))
                yield j, len(self.pieces), self.byte * n, n

    def _long(self, word: str, weight: float | None, uses: np.ndarray) -> float:
        """As run() for one long word: edges are found again for each pass, so a character takes the two sums of its place and nothing more."""
        n, none = len(word), array("d", [-math.inf])
        forward = none * (n + 1)
        forward[0] = 0
        for i in range(n):
            for j, _, s, _ in self._from(word, i):
                forward[j] = _log_add(forward[j], forward[i] + s)
        if weight is not None:
            backward = none * (n + 1)
            backward[n] = 0
            for i in reversed(range(n)):
                for j, p, s, times in self._from(word, i):
                    backward[i] = _log_add(backward[i], s + backward[j])
                    uses[p] += math.exp(forward[i] + s + backward[j] - forward[n]) * weight * times
        return forward[n]

    def run(self, texts: list[str], weights: np.ndarray | None = None) -> np.ndarray:
        """ln of the marginal probability of each word; with weights, the expected uses of all ids instead."""
        marked = [MARK + t for t in texts]
        sizes, out = np.array([len(t) for t in marked]), np.zeros(len(texts))
        uses = np.zeros(len(self.log))
        for size in np.unique(sizes):
            group = np.flatnonzero(sizes == size)
            step = max(1, 1_000_000 // size) if size <= LONG_WORD else 1
            for at in range(0, len(group), step):
                rows = group[at : at + step]
                if size > LONG_WORD:
                    out[rows[0]] = self._long(marked[rows[0]], None if weights is None else float(weights[rows[0]]), uses)
                    continue
                edges = list(self._edges([marked[r] for r in rows]))
                forward = np.full((size + 1, len(rows)), -np.inf)
                forward[0] = 0
                for i, j, r, _, s in edges:
                    forward[j, r] = np.logaddexp(forward[j, r], forward[i, r] + s)
                out[rows] = forward[size]
                if weights is not None:
                    backward = np.full((size + 1, len(rows)), -np.inf)
                    backward[size] = 0
                    own, shares = weights[rows], []
                    for i, j, r, ids, s in reversed(edges):
                        after = backward[j, r] + s
                        backward[i, r] = np.logaddexp(backward[i, r], after)
                        share = np.exp(forward[i, r] + after - forward[size, r]) * own[r]
                        shares.append(share if ids[0] < len(self.pieces) else share * np.round(s / self.byte))  # bytes are edges of their own
                    uses += np.bincount(np.concatenate([e[3] for e in reversed(edges)]), np.concatenate(shares), len(uses))
        return out if weights is None else uses


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each run of texts, their hashes, and their uses in training rows."""
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for start, _, data, offsets in chunks(batch.column(0)):
            data = ASCII_LOWER[data]
            first, last, row = words(data, offsets)
            if not len(first):
                continue
            prints, one, back = np.unique(Spans(data).hash(first, last), return_index=True, return_inverse=True)
            used = np.bincount(back, train[start + row], len(prints)).astype(np.int64)
            edges = np.column_stack((first, last)).ravel().astype(np.int64)
            both = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([both.take(pa.array(one * 2)).cast(pa.string()), pa.array(prints.view(np.int64)), pa.array(used)], ["word", "h", "c"])


def _expect(tables: Iterator[pd.DataFrame], lattice: Lattice) -> Iterator[pd.DataFrame]:
    for t in tables:
        uses = lattice.run(t["word"].tolist(), t["c"].to_numpy(np.float64))
        some = np.flatnonzero(uses)
        yield pd.DataFrame({"id": some, "uses": uses[some]})


def _value(tables: Iterator[pd.DataFrame], lattice: Lattice) -> Iterator[pd.DataFrame]:
    for t in tables:
        yield t[["word", "h", "c"]].assign(value=lattice.run(t["word"].tolist()) / math.log(10))


def _score(batches: Iterator[pa.RecordBatch], hot: tuple[np.ndarray, ...], end: tuple[int, float, float], unit: float) -> Iterator[pa.RecordBatch]:
    """A row per text with its sums over hot words, and a row per text and other word."""
    keys, known, base, value = hot
    names = ["k", "k2", "h", "tf", "n_tokens", "n_known", "base", "value"]
    for batch in batches:
        own_k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
        for start, stop, data, offsets in chunks(batch.column(0)):
            data, n = ASCII_LOWER[data], stop - start
            first, last, row = words(data, offsets)
            prints = Spans(data).hash(first, last)
            at = np.minimum(np.searchsorted(keys, prints), max(len(keys) - 1, 0))
            hit = keys[at] == prints if len(keys) else np.zeros(len(prints), bool)
            r, a = row[hit], at[hit]
            k = own_k[:, start:stop]
            sums = [np.bincount(row, minlength=n) + 1, np.bincount(r, known[a], n) + end[0], np.bincount(r, base[a], n) + end[1], np.bincount(r, value[a], n) + end[2]]
            yield pa.RecordBatch.from_arrays([pa.array(k[0]), pa.array(k[1]), pa.array(k[0]), pa.array(np.zeros(n, np.int64)), *[pa.array(x.astype(np.int64)) for x in sums[:2]], *[pa.array(x) for x in sums[2:]]], names)
            r, h = row[~hit], prints[~hit]
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))[: len(r)])
            tf, zero = np.diff(np.append(new, len(r))), np.zeros(len(new), np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[r[new]]) for x in k), pa.array(h[new].view(np.int64)), pa.array(tf), pa.array(zero), pa.array(zero), pa.array(zero.astype(float)), pa.array(zero.astype(float))], names)


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def score_texts(docs: DataFrame, pieces: str = "/opt/tokenizers/piece_bpe_32k.model", rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("out"))
    counted = text.select("text", (~F.col("out")).alias("train")).mapInArrow(_count, "word string, h bigint, c bigint")
    vocabulary = cut(counted.groupBy("word").agg(F.min("h").alias("h"), F.sum("c").alias("c")), "vocabulary")
    n_train = text.where(~F.col("out")).count()
    tokens, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, types = tokens + n_train, types + (n_train > 0)
    names = load_pieces(pieces)
    lattice = Lattice(names)
    for _ in range(rounds if n_train else 0):
        expected = vocabulary.where("c > 0").select("word", "c").mapInPandas(lambda t, own=lattice: _expect(t, own), "id int, uses double")
        uses = np.zeros(len(names) + 2)
        for i, x in expected.groupBy("id").agg(F.sum("uses")).collect():  # a row per piece of the file at most
            uses[i] = x
        uses[-1] = n_train
        lattice = Lattice(names, uses)
    unit = -math.log10(tokens + types + 1)
    table = cut(vocabulary.mapInPandas(lambda t: _value(t, lattice), "word string, h bigint, c bigint, value double"), "values")
    hot = table.where("c > 0").orderBy(F.desc("c"), "h").limit(HOT_WORDS).select("h", "c", "value").toPandas()
    hot = hot.assign(h=hot["h"].to_numpy(np.int64).view(np.uint64)).sort_values("h")
    hot = (hot["h"].to_numpy(np.uint64), np.ones(len(hot)), np.log10(hot["c"].to_numpy(float) + 1) + unit, hot["value"].to_numpy(float))
    end = (int(n_train > 0), math.log10(n_train + 1) + unit, float(lattice.log[-1]) / math.log(10))
    both = [F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2")]
    keyed = text.select("text", *both)
    rows = keyed.mapInArrow(lambda b: _score(b, hot, end, unit), "k bigint, k2 bigint, h bigint, tf bigint, n_tokens bigint, n_known bigint, base double, value double")
    own = table.select("h", "c", F.col("value").alias("of_word"))
    rare = F.when(F.col("tf") > 0, F.col("tf")).otherwise(0)
    scored = rows.join(own, "h", "left").groupBy("k", "k2").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, rare).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare * F.coalesce(F.log10(F.col("c") + 1) + unit, F.lit(0.0))).alias("base"),
        F.sum(F.col("value") + rare * F.coalesce("of_word", F.lit(0.0))).alias("value"),
        F.count_if(F.col("tf") == 0).alias("copies"),
    )
    ids = text.select("doc_id", "out", *both)
    one = F.col("copies")
    return ids.join(scored, ["k", "k2"]).select(
        "doc_id", F.col("out").alias("held_out"), (F.col("n_tokens") / one).cast("long").alias("n_tokens"), (F.col("n_known") / one).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") / one).alias("base_score"), (F.col("value") / one).alias("score"),
    )
