"""Quality rules, line first: each line is judged by itself, failing lines go, and a document that loses too much goes.

A line of words fails as
* navigation, when separator words make up a fifth of its words, or it is one short menu phrase;
* boilerplate, when it holds a phrase of notices and page furniture, in English, German, French or Spanish;
* punctuation, when it ends without a sentence end or closing mark and has too few words to be a cut-off sentence,
  or when marks that prose doesn't use end a third of its words;
* shouting, when a line of several words is in capitals throughout;
* repetition, when few of its words are different, or it equals an earlier line.
Lines without words are neither kept nor lost text.

The base measures of a document are plain counts over the whole text. Defined results: a null text has no words, so
its base check fails. Rows are judged one by one, so repeated rows, ties and empty tables need no rule. Columns of the
result's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.buffers import Spans, chunks, words
from codefacts.llm.common import WORD, without

SYMBOLS = "#*$%&|<>"
WORDS = re.compile(WORD)
SEPARATORS = frozenset("| » › · • / > :: –".split())
#: Words of menus and phrases of notices, in four languages.
MENU = frozenset(
    "home menu login search contact about sitemap next previous back subscribe share print help faq top register archive "
    "startseite suche kontakt weiter zurück hilfe anmelden drucken impressum "
    "accueil rechercher contacter suivant précédent retour aide imprimer connexion "
    "inicio buscar contacto siguiente anterior volver ayuda imprimir acceder".split()
)
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "use cookies", "javascript",
    "lorem ipsum", "click here", "read more", "sign up", "log in", "login", "licensed under", "newsletter", "powered by", "copyright (c)",
    "copyright ©", "copyright 1", "copyright 2", "{{", "}}", "function(", "function (",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "hier klicken", "mehr lesen", "weiterlesen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "utiliza cookies", "haga clic aquí", "leer más",
)
ENDS = tuple(".!?…:;\"'”’»)]。！？」")
ODD_ENDS = (*"#*$%&|<>=~^_@\\", "!!", "??")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "lost_chars", "kept", "clean_text")


def line_fails(own: list[str], line: str) -> str | None:
    """Name of the first rule that a line with these words (one at least) fails, or None."""
    n = len(own)
    separators = 0 if SEPARATORS.isdisjoint(own) else sum(w in SEPARATORS for w in own)
    if separators and separators * 5 >= n or n <= 4 and all(w.strip(".,:").lower() in MENU for w in own):
        return "navigation"
    low = line.lower()
    if any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    odd = sum(w.endswith(ODD_ENDS) for w in own)
    if odd * 3 >= n or n < 4 and not own[-1].endswith(ENDS) and not own[-1].isalnum():
        return "punctuation"
    if n >= 6 and line.isupper():
        return "shouting"
    if n >= 12 and len(set(own)) * 5 <= n:
        return "repetition"
    return None


def judge(text: str) -> tuple[int, int, str]:
    """(characters of lines with words, characters of those lost, the text of the others)."""
    lines, seen, whole, lost, keep = text.split("\n"), set(), 0, 0, []
    for line in lines:
        own = WORDS.findall(line)
        if not own:
            keep.append(line)
            continue
        whole += len(line)
        if line in seen or line_fails(own, line):
            lost += len(line)
        else:
            keep.append(line)
        seen.add(line)
    return whole, lost, "\n".join(keep)


def repeat_words(hashes: np.ndarray) -> int:
    """Number of words that lie in a 3-word window that the text holds twice or more."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    grams = hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(n + 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int((twice | np.roll(twice, 1) | np.roll(twice, 2)).sum())


def _measure(batches: Iterator[pa.RecordBatch], at: int, most_lost: float, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(at)
        for start, end, data, offsets in chunks(column):
            first, last, row = words(data, offsets)
            hashes = Spans(data).hash(first, last)
            bounds = np.searchsorted(row, np.arange(end - start + 1))
            continuation = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
            sizes = (last - first) - (continuation[last] - continuation[first])
            word_chars = np.diff(np.concatenate(([0], np.cumsum(sizes)))[bounds])
            out = {name: [] for name in RESULT}
            for i, text in enumerate(column[start:end].to_pylist()):
                text = text or ""
                n, own = int(bounds[i + 1] - bounds[i]), hashes[bounds[i] : bounds[i + 1]]
                repeats = repeat_words(own)
                lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if "\n" in text else []
                whole, lost, clean = judge(text)
                failed = n < min_words or 100 * repeats > 50 * n
                values = (n, int(word_chars[i]), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, whole, lost, not failed and lost <= most_lost * whole, clean)
                for name, value in zip(RESULT, values, strict=True):
                    out[name].append(value)
            own = {name: pa.array(v, pa.string() if name == "clean_text" else pa.bool_() if name in ("base_failed", "kept") else pa.int64()) for name, v in out.items()}
            yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, *own.values()], [*batch.schema.names, *own])


def judge_documents(docs: DataFrame, most_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """docs with the base measures, base_failed, line_chars, lost_chars, kept, and clean_text (the lines that passed).

    kept is false for a document that fails the base check or loses over most_lost of the characters of its lines.
    A map over Arrow batches: no shuffle, and a task holds one batch at a time.
    """
    docs = without(docs, *RESULT)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = ", ".join(f"{c} {'string' if c == 'clean_text' else 'boolean' if c in ('base_failed', 'kept') else 'bigint'}" for c in RESULT)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _measure(batches, at, most_lost, min_words), f"{kinds}, {added}")
