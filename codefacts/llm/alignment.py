"""Cross-tokenizer alignment by galloping intersection.

A text has two token sequences: A of a byte-level tokenizer and B of a piece tokenizer. Each is a rising list of byte offsets where its tokens end. The
offsets that both lists have cut the text into groups; within a group, the bytes of A's tokens and of B's overlap. They are
found by galloping: the shorter list drives, each of its ends is searched for in the longer list from where the last one was found, by steps
that double and then by bisection between the last two steps. Their places in both lists are ranks, and the differences of ranks
are the ranges of tokens that a group holds. The shorter list is walked in lanes of 32 ends, all lanes of a run of texts in step, so a search
costs the logarithm of the distance that it moves, and no Python loop goes over tokens.

Link counts. In a document, the links (all pairs of an A and a B token of a group) are counted by id pair before anything else, group by group and in
slices of bounded size; pairs of tokens are never rows. The different pairs of a document are written with their numbers; from them Spark
counts the documents of each pair, and the highest count of each A id (an aggregate of one row an id, the size of A's vocabulary). Counts
come back to the documents in two ways, which together serve every pair. The most frequent pairs, at most `most_sent` of them,
go to the tasks as sorted arrays; where the counts are cut off is read from a histogram of at most 512 rows. All other pairs are joined
with the written counts, row by row, in a shuffle that AQE can split. A few frequent pairs make up nearly all links, so what is joined is the long tail.

Defined results. Null and empty texts have no tokens, and neither have those whose tokens' bytes, joined, differ from a space and the
text, in A or B (a U+2581 in the text, or a normalising tokenizer): zeros, an empty list and empty groups. Rows count as documents,
rows with equal doc_id too. Strings of special tokens inside texts are plain text. Added columns replace input columns of the same names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.buffers import chunks
from codefacts.llm.common import cut, spare, without

TOKENIZERS = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
LANE = 32
CHUNK = 1 << 19
SLICE = 1 << 21
ADDED = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
COUNTED = ("n_best", "count_sum")
#: The pattern of the byte-level pre-tokenizer (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters, without long runs of white space, are encoded by the faster of two encoders, which agree on them.
_PLAIN, _LONG_SPACE = re.compile(r"[\x00-\u024f\u2010-\u2026]*"), re.compile(r"\s{256}")


@lru_cache(maxsize=2)
def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: itself if it is printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """A: byte-level BPE of a tokenizers file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        special = {t["content"] for t in whole["added_tokens"]}
        of = _bytes_of_characters()
        vocabulary = {t: i for t, i in whole["model"]["vocab"].items() if t not in special}
        self.tokens = {i: bytes(map(of.__getitem__, t)) for t, i in vocabulary.items()}
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.sizes[i] = len(t)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in whole["model"]["merges"]]
        by_rank = merged == sorted(merged) and whole["pre_tokenizer"]["type"] == "ByteLevel" and not whole["normalizer"]
        self._fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks={t: i for i, t in self.tokens.items()}, special_tokens={}) if by_rank else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        fast = self._fast
        plain = [fast is not None and _PLAIN.fullmatch(t) and not _LONG_SPACE.search(t) for t in texts]
        return [fast.encode_ordinary(f" {t}") if p else self._tokenizer.encode(f" {t}", add_special_tokens=False).ids for t, p in zip(texts, plain, strict=True)]


class PieceTokenizer:
    """B: pieces of a sentencepiece model, which sets the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.tokens = {i: bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.sizes = np.array([len(self.tokens[i]) for i in range(len(pieces))], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(folder: str, a: str, b: str) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(f"{folder}/{a}"), PieceTokenizer(f"{folder}/{b}")


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising lists of the numbers that both have. The first list drives and should be the shorter."""
    n, m = len(short), len(long)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = np.arange(0, n, LANE)
    cursor = np.searchsorted(long, short[lanes])  # first end that isn't smaller, where a lane begins
    found = np.full(n, m, np.int64)
    for i in range(LANE):
        at = lanes + i
        live = at < n
        at, low = at[live], cursor[live]
        want = short[at]
        step = np.ones(len(at), np.int64)
        high = low.copy()
        open_ = np.flatnonzero((high < m) & (long[np.minimum(high, m - 1)] < want))
        while len(open_):  # long[low] < want, so the place is after low
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(high[open_] + step[open_], m)
            step[open_] *= 2
            open_ = open_[(high[open_] < m) & (long[np.minimum(high[open_], m - 1)] < want[open_])]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = long[mid] < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        found[at] = low
        cursor[live] = low
    same = (found < m) & (long[np.minimum(found, m - 1)] == short)
    return np.flatnonzero(same), found[same]


class Tokens:
    """Token ids of a run of texts, one after another; `until` has each text's last token's end, by number of tokens."""

    def __init__(self, ids: list[list[int]], sizes: np.ndarray):
        self.until = np.cumsum([0, *map(len, ids)])
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, self.until[-1])
        self.ends = np.cumsum(sizes[self.ids])


def _joined(tokens: dict[int, bytes], ids: list[int]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def common_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that end together, in order. In each text the shorter list drives."""
    fewer = np.diff(a.until) <= np.diff(b.until)
    found = []
    for side in (True, False):
        own_a, own_b = np.flatnonzero(np.repeat(fewer == side, np.diff(a.until))), np.flatnonzero(np.repeat(fewer == side, np.diff(b.until)))
        x, y = gallop(a.ends[own_a], b.ends[own_b]) if side else gallop(b.ends[own_b], a.ends[own_a])[::-1]
        found.append((own_a[x], own_b[y]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _folded(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (text, pair) together, by text and pair, with their times added."""
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(head)
    return text[at], pair[at], np.add.reduceat(times, at) if len(at) else times[:0]


def _of_large_group(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pair, times) of a group by itself: its different ids first, some A ids at a time."""
    (x, nx), (y, ny) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    rows = max(1, SLICE // len(y))
    for i in range(0, len(x), rows):
        yield (x[i : i + rows, None] * width + y).ravel(), (nx[i : i + rows, None] * ny).ravel()


def pair_counts(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of all links, pair = A id * width + B id. ends_*: a group's end in the tokens; text: its text."""
    first_a, first_b = (np.concatenate(([0], e[:-1])) if len(e) else e for e in (ends_a, ends_b))
    na, nb = ends_a - first_a, ends_b - first_b
    links = na * nb
    parts = []
    for g in np.flatnonzero(links > SLICE):
        for pair, times in _of_large_group(a[first_a[g] : ends_a[g]], b[first_b[g] : ends_b[g]], width):
            parts.append((np.full(len(pair), text[g]), pair, times))
    small = np.flatnonzero(links <= SLICE)
    upto = np.cumsum(links[small])
    at = 0
    while at < len(small):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        g = np.repeat(small[at:end], links[small[at:end]])
        k = np.arange(len(g)) - np.repeat(np.cumsum(links[small[at:end]]) - links[small[at:end]], links[small[at:end]])
        pair = a[first_a[g] + k // nb[g]] * width + b[first_b[g] + k % nb[g]]
        parts.append(_folded(text[g], pair, np.ones(len(g), np.int64)))
        at = end
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return _folded(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def group_texts(a: Tokens, b: Tokens, ends_a: np.ndarray, ends_b: np.ndarray, written: np.ndarray) -> list[str]:
    """Per text `a1,a2|b1;a3|b2,b3`: groups by semicolons, A's ids before B's. written: the ids as text with each of three endings."""
    na, nb = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    place_a = np.arange(len(a.ids)) + np.repeat(ends_b - nb, na)
    place_b = np.arange(len(b.ids)) + np.repeat(ends_a, nb)
    kind = np.zeros(len(a.ids) + len(b.ids), np.int64)
    ids = np.empty(len(kind), np.int64)
    ids[place_a], ids[place_b] = a.ids, b.ids
    kind[place_a[ends_a - 1]] = 1
    kind[place_b[ends_b - 1]] = 2
    parts = written[kind, ids].tolist()
    until = a.until + b.until
    return ["".join(parts[i:j])[:-1] for i, j in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]


def _written(most: int) -> np.ndarray:
    return np.array([[f"{i}{end}" for i in range(most)] for end in ",|;"], object)


def _aligned(batches: Iterator[pa.RecordBatch], at: int, folder: str, files: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    ta, tb = tokenizers(folder, *files)
    written = _written(max(len(ta.sizes), len(tb.sizes)))
    for batch in batches:
        for start, stop, data, offsets in chunks(batch.column(at), CHUNK):
            raw = [data[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            texts = [r.decode("utf-8", "replace") for r in raw]
            ids = [[own if t else [] for own, t in zip(tok.encode(texts), texts, strict=True)] for tok in (ta, tb)]
            good = np.array([bool(r) and _joined(ta.tokens, x) == _joined(tb.tokens, y) == b" " + r for r, x, y in zip(raw, *ids, strict=True)], bool)
            a, b = (Tokens([own if g else [] for own, g in zip(x, good.tolist(), strict=True)], t.sizes) for x, t in zip(ids, (ta, tb), strict=True))
            i, j = common_ends(a, b)
            text = np.searchsorted(a.until, i, "right") - 1
            rows = stop - start
            n_groups = np.bincount(text, minlength=rows)
            n_links = np.zeros(rows, np.int64)
            np.add.at(n_links, text, np.diff(i + 1, prepend=0) * np.diff(j + 1, prepend=0))
            of, pair, times = pair_counts(a.ids, b.ids, i + 1, j + 1, text, len(tb.sizes))
            lists = pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32))
            added = [
                pa.array(np.diff(a.until)), pa.array(np.diff(b.until)), pa.array(n_groups), pa.array(n_links), pa.array(group_texts(a, b, i + 1, j + 1, written), pa.string()),
                pa.ListArray.from_arrays(lists, pa.array(pair)), pa.ListArray.from_arrays(lists, pa.array(times)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.slice(start, rows).columns, *added], [*batch.schema.names, *ADDED])


def align(docs: DataFrame, folder: str = TOKENIZERS, files: tuple[str, str] = FILES) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, groups (text), and pairs and times: the different id pairs linked in the text, and how often.

    A pair is A id * (size of B's vocabulary) + B id. The tokenizer files are read by the tasks, from a folder that each machine has.
    """
    docs = without(docs, *ADDED)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")
    added = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    return docs.mapInArrow(lambda b: _aligned(b, at, folder, files), f"{kinds}, {added}")


def _cutoff(counts: DataFrame, most: int) -> int:
    """The smallest count at and above which there are at most `most` pairs, to an eighth of a doubling."""
    step = F.floor(F.log2("n_docs") * 8).cast("int")
    found = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total = 0
    for r in found:
        total += r.n
        if total > most:
            return math.ceil(2 ** ((r.step + 1) / 8))
    return 0


def _looked_up(batches: Iterator[pa.RecordBatch], pair: np.ndarray, n_docs: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The last two columns of a batch are pairs and times; of them come back the sums over the known pairs."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            pairs, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            own, n = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            sums = np.zeros((2, batch.num_rows), np.int64)
            if len(pair) and len(own):
                at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                known = pair[at] == own
                np.add.at(sums[0], row[known], n[known] * best[at[known]])
                np.add.at(sums[1], row[known], n[known] * n_docs[at[known]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sums[0]), pa.array(sums[1])], [*batch.schema.names[:-2], *COUNTED])


def add_link_counts(aligned: DataFrame, width: int, most_sent: int = 1_000_000) -> DataFrame:
    """What align() returns, less pairs and times, with n_best and count_sum: sums over a row's links, each with the documents that hold its id pair.

    width: the size of B's vocabulary. most_sent: how many pairs are sent to every task (24 bytes each); all others are joined.
    """
    aligned = without(aligned, *COUNTED)
    key = spare(aligned, "row_key")
    rows = cut(aligned.withColumn(key, F.monotonically_increasing_id()), "aligned")
    counts = cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "pair_counts")
    highest = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n_docs").alias("highest"))  # a row an id of A
    counts = counts.join(F.broadcast(highest), F.floor(F.col("pair") / width) == F.col("a"))
    counts = cut(counts.select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).cast("long").alias("best")), "best_counts")
    least = _cutoff(counts, most_sent)
    sent: pd.DataFrame = counts.where(F.col("n_docs") >= least).toPandas().sort_values("pair")
    pair, n_docs, best = (sent[c].to_numpy(np.int64) for c in ("pair", "n_docs", "best"))
    names = [c for c in rows.columns if c not in ("pairs", "times")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    picked = rows.select(*[F.col(f"`{c}`") for c in names], "pairs", "times")
    out = picked.mapInArrow(lambda b: _looked_up(b, pair, n_docs, best), f"{kinds}, n_best bigint, count_sum bigint")
    if least:
        each = rows.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(key, F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
        rare = counts.where(F.col("n_docs") < least)
        tail = each.join(rare, "pair").groupBy(key).agg(F.sum(F.col("n") * F.col("best")).alias("tail_best"), F.sum(F.col("n") * F.col("n_docs")).alias("tail_sum"))
        tail = cut(tail.withColumnRenamed(key, "tail_key"), "tail")
        out = out.join(tail, F.col(key) == F.col("tail_key"), "left")
        for name, more in zip(COUNTED, ("tail_best", "tail_sum"), strict=True):
            out = out.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return out.select(*[F.col(f"`{c}`") for c in aligned.columns if c not in ("pairs", "times")], *COUNTED)


def piece_count(folder: str = TOKENIZERS, file: str = FILES[1]) -> int:
    """The size of B's vocabulary, as the driver reads it."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{file}").get_piece_size()
