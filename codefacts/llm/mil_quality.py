"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded (character classes, word shapes, repetition, and a hashed
sketch of its words, then a learned layer). Gated attention, tanh times sigmoid, gives each passage a weight; the weighted
passage representation is scored by a logistic unit. Only documents carry labels: the weights of passages are learned
from them by gradient descent through the attention.

The network is fitted on a bounded sample of labelled rows of the training folds, in the order of a hash of doc_id: at most
`most_labelled` of them, each with a tenth of `most_passages` passages at most, and all together with that number. A row that
doesn't fit is passed over and the next ones are looked at, so neither can a few huge texts fill the driver nor one of them end
the sample; what is left out is said in a warning. Their passages, encoded by Spark tasks, reach the driver, and the fitted parameters (some 20 kB) go back to the tasks. Every passage of every document is encoded and scored, in one map without a shuffle.

Defined results. Null and wordless texts are a bag of one empty passage. A null label is no label; rows of labels that
repeat or contradict count as they stand. Without any label the score is 0.5 throughout. Added columns replace input
columns of the same names.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.buffers import Spans, chunks, words
from codefacts.llm.common import cut, without

PASSAGE, SKETCH = 64, 64
ADDED = ("held_out", "score", "predicted", "n_passages")
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>=~^_@\\{}", ".,;:", "!?", "\n", "\"'()[]-/")
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = len(_CLASSES) + 1
SHAPES = len(_CLASSES) + 2
WIDTH = SHAPES + 7 + SKETCH


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, its WIDTH raw features) for a buffer of texts; every row has a passage at least."""
    rows = len(offsets) - 1
    first, last, row = words(data, offsets)
    counts = np.bincount(row, minlength=rows)
    per = np.maximum(1, -(-counts // PASSAGE))
    owner, base = np.repeat(np.arange(rows), per), np.cumsum(per) - per
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = base[row] + place // PASSAGE
    n = len(owner)
    size = np.bincount(passage, minlength=n)
    out, safe = np.zeros((n, WIDTH), np.float32), np.maximum(size, 1)
    if not len(first):
        return owner, out
    head = np.concatenate(([True], passage[1:] != passage[:-1]))
    start, full = first[head], np.flatnonzero(size)
    length = np.zeros(n)
    length[full] = np.add.reduceat(last - first, np.flatnonzero(head))
    kinds = _CLASS[data]
    edge = np.append(start, len(data))
    for c in range(SHAPES):
        total = np.concatenate(([0], np.cumsum(kinds == c, dtype=np.int32)))
        out[full, c] = np.diff(total[edge]) / np.maximum(length[full], 1)
    hashes = Spans(data).hash(first, last)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & ~head[1:]))
    order = np.lexsort((hashes, passage))
    fresh = np.concatenate(([True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])))
    top = kinds[first] == 0
    end = kinds[last - 1]
    stats = (length / safe / 10, np.bincount(passage, same, n) / safe, np.bincount(passage[order], fresh, n) / safe, np.log1p(size) / 4, np.bincount(passage, top, n) / safe, np.bincount(passage, end == 3, n) / safe, np.bincount(passage, end == 5, n) / safe)
    for i, x in enumerate(stats):
        out[:, SHAPES + i] = x
    slot, sign = (hashes >> np.uint64(40)).astype(np.int64) % SKETCH, np.where(hashes & np.uint64(1), 1.0, -1.0)
    out[:, SHAPES + 7 :] = np.bincount(passage * SKETCH + slot, sign, n * SKETCH).reshape(n, SKETCH) / np.sqrt(safe)[:, None]
    return owner, out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMil:
    """h = relu(x W + b); attention over a bag: softmax of w . (tanh(h V) * sigmoid(h U)); score: sigmoid(c . sum(a h) + d)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 8):
        r = np.random.default_rng(seed)
        self.p = {"W": r.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate), "c": np.zeros(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x: np.ndarray, bounds: np.ndarray):
        p, sizes = self.p, np.diff(np.append(bounds, len(x)))
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bounds), sizes))
        a = e / np.repeat(np.add.reduceat(e, bounds), sizes)
        z = np.add.reduceat(a[:, None] * h, bounds)
        return h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"]), sizes

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, bounds)[5]

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.005) -> AttentionMil:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.01)
        x, r, step = (x - self.mean) / self.scale, np.random.default_rng(1), 0
        sizes = np.diff(np.append(bounds, len(x)))
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                own = order[at : at + batch]
                n = sizes[own]
                start = np.cumsum(n) - n
                rows = np.repeat(bounds[own] - start, n) + np.arange(n.sum())
                step += 1
                for k, g in self._gradients(x[rows], start, y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, a, z, score, sizes = self._forward(x, bounds)
        out = (score - y) / len(y)
        dz = np.repeat(out[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, bounds), sizes))
        gate = de[:, None] * p["w"]
        dv, du = gate * s * (1 - t * t), gate * t * s * (1 - s)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (h > 0)
        g = {"c": z.T @ out, "d": np.array([out.sum()]), "w": (t * s).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dh, "b": dh.sum(axis=0)}
        return {k: v + 1e-4 * p[k] for k, v in g.items()}


def in_fold(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the held-out part."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in chunks(batch.column(1)):
            owner, x = encode(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))
            at = np.searchsorted(owner, np.arange(end - start + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(2).slice(start, end - start), pa.ListArray.from_arrays(pa.array(at), flat)], ["rank", "y", "x"])


def fitting(sizes: list[int], most: int) -> list[int]:
    """Which of the sizes are taken, in order, if each may be a tenth of `most` at most and all together no more than that."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        if n <= most // 10 and total + n <= most:
            out.append(i)
            total += n
    return out


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, most_passages: int = 100_000) -> AttentionMil:
    """Fit on labelled documents outside the held-out fold, within both bounds, the first of which also bounds what is broadcast."""
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y"))
    own = own.where(~in_fold(F.col("__id"))).withColumn("rank", F.xxhash64("__id")).orderBy("rank", "__id", "y").limit(most_labelled)
    bags = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select("rank", "text", "y")
    bags = bags.mapInArrow(_encoded, "rank bigint, y int, x array<array<float>>").withColumn("n", F.size("x")).withColumn("bag", F.monotonically_increasing_id())
    bags = cut(bags, "bags")
    order = ["rank", "y", "n", "bag"]
    sizes = bags.select(*order).orderBy(*order).limit(2 * most_labelled).collect()
    picked = fitting([r.n for r in sizes], most_passages)
    if len(picked) < len(sizes):
        warnings.warn(f"{len(sizes) - len(picked)} of {len(sizes)} labelled texts have too many passages for the sample", stacklevel=2)
    chosen = docs.sparkSession.createDataFrame([(sizes[i].bag,) for i in picked], "bag bigint")
    rows = bags.join(F.broadcast(chosen), "bag").select(*order, "x").orderBy(*order).drop("n", "bag").toArrow()
    y = rows["y"].to_numpy().astype(float)
    model = AttentionMil()
    if len(set(y)) < 2:
        model.p["d"][:] = 0 if not len(y) else 6 * (2 * y[0] - 1)
        return model
    bag = rows["x"].combine_chunks()
    x = bag.flatten().flatten().to_numpy().reshape(-1, WIDTH).astype(float)
    return model.fit(x, bag.offsets.to_numpy()[:-1].astype(np.int64) - bag.offsets[0].as_py(), y)


def _scored(batches: Iterator[pa.RecordBatch], at: int, model: AttentionMil) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, data, offsets in chunks(batch.column(at)):
            owner, x = encode(data, offsets)
            bounds = np.searchsorted(owner, np.arange(end - start))
            score = model.score(x, bounds)
            own = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.diff(np.append(bounds, len(owner))))]
            yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, *own], [*batch.schema.names, "score", "predicted", "n_passages"])


def score_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000) -> DataFrame:
    """docs with held_out, score (0 to 1), predicted (0 or 1) and n_passages. Scores depend on texts alone."""
    docs = without(docs, *ADDED)
    model, at = train(docs, labels, most_labelled), docs.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(lambda b: _scored(b, at, model), f"{kinds}, score double, predicted int, n_passages bigint")
    return out.withColumn("held_out", in_fold(F.col("doc_id")))
