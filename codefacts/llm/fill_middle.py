"""Fill-in-the-middle transformation, with cuts found in a wavelet matrix over character classes.

A text is a sequence of units: tokens (a run of A-Z and a-z, or one other character) or characters. Two cuts at unit boundaries
part it into prefix, middle and suffix, which are written again in another order behind markers. Cuts are drawn from the sha256 of a
seed and doc_id, so they are the same on every run and don't depend on how rows are dealt out.

One map without a shuffle. Texts go through in runs of some 2 MB (a longer text is a run of its own): their bytes get classes, the
classes a wavelet matrix, and the cuts of all texts of a run are found at once, by bisection on sums of ranks. The numbers of
characters are ranks too. No text is copied but into its output.

Defined results. A null text is an empty one; empty texts and texts that hold a marker stay as they are, as do those that the draw leaves
plain. A null doc_id is drawn as an empty one. Rows with equal doc_id have equal draws. Added columns replace input columns of
the same names. Texts are valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.buffers import chunks
from codefacts.llm.common import spare, without
from codefacts.llm.wavelet import CHARACTERS, TOKENS, WaveletMatrix, classes

ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: The order of the parts of a form, each behind its marker.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
UNITS = {"token": TOKENS, "character": CHARACTERS}


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2 ** 32 from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def find_cuts(data: np.ndarray, offsets: np.ndarray, draw: np.ndarray, kinds: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(units, place of the first cut, place of the second, characters before the first, characters between them) of each text.

    The cuts come after draw % (units + 1) units, for both of a text's draws.
    """
    matrix = WaveletMatrix(classes(data, offsets))
    first, end = offsets[:-1], offsets[1:]
    n = matrix.count(kinds, first, end)
    at = np.sort(draw % (n + 1)[:, None], axis=1)
    a = matrix.cut(kinds, first, end, at[:, 0])
    b = matrix.cut(kinds, first, end, at[:, 1])
    return n, a, b, matrix.count(CHARACTERS, first, a), matrix.count(CHARACTERS, a, b)


def _written(data: np.ndarray, parts: dict[str, tuple[int, int]], form: str) -> bytes:
    return b"".join(x for part in FORMS[form] for x in (MARKERS[part].encode(), data[slice(*parts[part])].tobytes()))


def _transformed(batches: Iterator[pa.RecordBatch], at: int, kinds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The last three columns of a batch are the form and two draws."""
    for batch in batches:
        form = batch.column(batch.num_columns - 3).to_pylist()
        draw = np.stack([batch.column(batch.num_columns - i).to_numpy() for i in (2, 1)], axis=1)
        for start, stop, data, offsets in chunks(batch.column(at)):
            n, a, b, before, between = find_cuts(data, offsets, draw[start:stop], kinds)
            own = np.array(form[start:stop], object)
            plain = own == "plain"
            out = []
            for i in range(stop - start):
                first, end = int(offsets[i]), int(offsets[i + 1])
                parts = {"prefix": (first, int(a[i])), "middle": (int(a[i]), int(b[i])), "suffix": (int(b[i]), end)}
                out.append(data[first:end].tobytes() if plain[i] else _written(data, parts, own[i]))
            added = [pa.array(n), pa.array(before, mask=plain), pa.array(between, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns[:-2], *added], [*batch.schema.names[:-2], "n", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, unit: str = "token") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    docs = without(docs, *ADDED)
    h = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(MARKERS["prefix"]) | text.contains(MARKERS["suffix"]) | text.contains(MARKERS["middle"])
    plain = (text == "") | marked | (h[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    names = [spare(docs, f"draw{i}") for i in range(2)]
    drawn = docs.select("*", form.alias("form"), h[0].alias(names[0]), h[1].alias(names[1]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at, units = docs.columns.index("text"), UNITS[unit]
    return drawn.mapInArrow(lambda b: _transformed(b, at, units), f"{kinds}, form string, n bigint, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again. No part holds a marker, and no marker's end is another's beginning, so outputs come apart in one way only."""
    parts = F.split(output, f"{MARKERS['prefix']}|{MARKERS['suffix']}|{MARKERS['middle']}")
    place = {f: {part: i + 1 for i, part in enumerate(order)} for f, order in FORMS.items()}
    whole = {f: F.concat(*[F.get(parts, F.lit(place[f][part])) for part in ("prefix", "middle", "suffix")]) for f in FORMS}
    return F.when(form == "plain", output).when(form == "psm", whole["psm"]).otherwise(whole["spm"])
