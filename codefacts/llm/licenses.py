"""License scan by template-markup matching.

A template is wording with two kinds of markup: optional regions, which may be left out, and replaceable regions, which stand for a
bounded number of any words. Templates and the base phrases are compiled into one automaton over word symbols; a text matches a template
where the automaton, started at one of its words, reaches the template's end, so every word outside the marked regions is there, in order
and with nothing between. Regions at the very beginning may be left out as well, so a search needs no lead-in.

The automaton is deterministic: a table of states by symbols (each word that a template holds, and one symbol for all other words). It is
run from all words of a run of texts at once, step by step; nearly all starts die at the first or second word, and none lives for longer
than the longest template. So a text costs time in proportion to its length, and templates as many table rows as they have words.

One map without a shuffle. Texts go through in runs of some 2 MB (a longer text is a run of its own). Words are compared whole, by
their bytes: no hash decides.

Defined results. A null text is an empty one: no words, no labels (empty strings), null places, a score of 0. Copies of a wording in
one text are matches each; of the matches of one template that overlap, the first is taken, and of those with one start the longest.
Score: the largest share of a text's words that the matches of one template or phrase cover together. Added columns replace input
columns of the same names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codefacts.llm.buffers import ASCII_LOWER, chunks, mix
from codefacts.llm.buffers import words as find_words
from codefacts.llm.common import LOWER, UPPER, without
from codefacts.llm.license_texts import PHRASES, TEMPLATES

ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = np.zeros(256, bool)
NO_WORD[[i for i in range(128) if not chr(i).isalnum()]] = True
LONGEST_WORD = 24
_MARKUP = re.compile(r"<<(opt|end|any (\d+)-(\d+))>>")
_KINDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<label: string, first_word: bigint, n_words: bigint>>"
Node = tuple  # ("word", w), ("any", least, most) or ("opt", nodes)


def word_list(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def parse(template: str) -> list[Node]:
    """The nodes of a template. Raises on regions that don't close, or that could match without an end."""
    stack: list[list[Node]] = [[]]
    at = 0
    for m in [*_MARKUP.finditer(template), None]:
        stack[-1] += [("word", w) for w in word_list(template[at : m.start() if m else None])]
        if m is None:
            break
        at = m.end()
        if m[1] == "opt":
            stack.append([])
        elif m[1] == "end":
            if len(stack) == 1:
                raise ValueError(f"a region ends that hasn't begun: {template[:60]}")
            nodes = stack.pop()
            stack[-1].append(("opt", nodes))
        else:
            stack[-1].append(("any", int(m[2]), int(m[3])))
    if len(stack) > 1:
        raise ValueError(f"a region doesn't end: {template[:60]}")
    if not any(kind[0] == "word" for kind in stack[0]):
        raise ValueError(f"no mandatory word: {template[:60]}")
    return stack[0]


class Automaton:
    """One table for all templates: step[state, symbol] is the next state, 0 none; 1 is the start. ends[state]: bits of the templates that end there."""

    def __init__(self, templates: list[str], most_states: int = 50_000):
        if len(templates) > 63:
            raise ValueError("63 templates at most")
        self._moves: list[dict[str | None, list[int]]] = []  # by word; None: any word
        self._free: list[list[int]] = []
        final, begin = {}, self._node()
        for i, t in enumerate(templates):
            nodes = parse(t)
            while nodes[0][0] == "any":  # any words before the wording say nothing
                nodes = nodes[1:]
            while nodes[-1][0] == "any":
                nodes = nodes[:-1]
            first = self._node()
            self._free[begin].append(first)
            final[self._chain(first, nodes)] = 1 << i
        vocabulary = sorted({w for m in self._moves for w in m if w})
        if any(len(w.encode()) > LONGEST_WORD for w in vocabulary):
            raise ValueError(f"words of templates have {LONGEST_WORD} bytes at most")
        self.words = np.array([w.encode() for w in vocabulary], object)
        self._determine(begin, final, {w: i + 1 for i, w in enumerate(vocabulary)}, most_states)
        table, own = _keys(np.frombuffer(b"".join(self.words), np.uint8), *_ends(self.words))
        order = np.argsort(own, kind="stable")
        self._known, self._table, self._symbol = own[order], table[order], order + 1

    def _node(self) -> int:
        self._moves.append(defaultdict(list))
        self._free.append([])
        return len(self._moves) - 1

    def _chain(self, at: int, nodes: list[Node]) -> int:
        for kind, *rest in nodes:
            if kind == "word":
                last, at = at, self._node()
                self._moves[last][rest[0]].append(at)
            elif kind == "opt":
                inner = self._chain(at, rest[0])
                last, at = at, self._node()
                self._free[inner].append(at)
                self._free[last].append(at)
            else:
                end = self._node()
                for i in range(rest[1] + 1):
                    if i >= rest[0]:
                        self._free[at].append(end)
                    if i < rest[1]:
                        last, at = at, self._node()
                        self._moves[last][None].append(at)
                at = end
        return at

    def _closed(self, nodes: list[int]) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self._free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def _determine(self, begin: int, final: dict[int, int], symbols: dict[str, int], most: int) -> None:
        sets = {frozenset(): 0, self._closed([begin]): 1}
        todo, rows = [s for s, i in sets.items() if i], [np.zeros(len(symbols) + 1, np.int32)]
        for own in todo:
            free = [n for s in own for n in self._moves[s].get(None, ())]
            by_word = defaultdict(list)
            for s in own:
                for w, n in self._moves[s].items():
                    if w:
                        by_word[w] += n
            row = np.zeros(len(symbols) + 1, np.int32)
            for w, n in [(None, []), *by_word.items()]:
                new = self._closed(n + free)
                if new not in sets:
                    if len(sets) >= most:
                        raise ValueError(f"over {most} states: the templates are too ambiguous")
                    sets[new] = len(sets)
                    todo.append(new)
                if w is None:
                    row[:] = sets[new]
                else:
                    row[symbols[w]] = sets[new]
            rows.append(row)
        self.step = np.stack(rows)
        self.ends = np.array([sum(final.get(n, 0) for n in s) for s in sets], np.int64)

    def symbols(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The symbol of each word of a lower-cased buffer, 0 for words that no template holds."""
        table, own = _keys(data, first, last)
        at = np.minimum(np.searchsorted(self._known, own), len(self._known) - 1)
        same = (self._table[at] == table).all(axis=1)
        return np.where(same, self._symbol[at], 0)

    def run(self, symbols: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, first word, end word) of the longest match of each template at each word, by template and first word. limit: the end of each word's text."""
        state = self.step[1][symbols]
        start = np.flatnonzero(state)
        state, at, found = state[start], start + 1, []
        while len(start):
            done = self.ends[state]
            some = np.flatnonzero(done)
            if len(some):
                found.append((done[some], start[some], at[some]))
            go = at < limit[start]
            state, start, at = state[go], start[go], at[go]
            state = self.step[state, symbols[at]]
            go = state > 0
            state, start, at = state[go], start[go], at[go] + 1
        if not found:
            return (np.zeros(0, np.int64),) * 3
        done, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        bit, row = np.nonzero((done[None, :] >> np.arange(int(self.ends.max()).bit_length())[:, None]) & 1)
        order = np.lexsort((-end[row], start[row], bit))
        bit, start, end = bit[order], start[row][order], end[row][order]
        head = np.ones(len(bit), bool)
        head[1:] = (bit[1:] != bit[:-1]) | (start[1:] != start[:-1])
        return bit[head], start[head], end[head]


def _ends(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    last = np.cumsum(sizes)
    return last - sizes, last


def _keys(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first 24 bytes as three numbers and the length, one number made of them) of each word."""
    whole = np.concatenate((data, np.zeros(LONGEST_WORD + 8, np.uint8)))
    eight = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    size = last - first
    out, key = np.empty((len(first), 4), np.uint64), size.astype(np.uint64)
    out[:, 3] = key
    for i in range(3):
        bits = np.clip(size - 8 * i, 0, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
        out[:, i] = eight[np.minimum(first + 8 * i, len(eight) - 1)] & mask
        key = mix(key ^ out[:, i])
    return out, key


@lru_cache(maxsize=4)
def compiled(wordings: tuple[str, ...]) -> Automaton:
    return Automaton(list(wordings))


def _apart(bit: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the matches, by template and first word, are taken when each one may begin only after the last one taken of its template."""
    taken = np.ones(len(bit), bool)
    taken[1:] = (bit[1:] != bit[:-1]) | (start[1:] >= end[:-1])
    if taken.all():
        return taken
    last, template = -1, -1
    for i, (b, s, e) in enumerate(zip(bit.tolist(), start.tolist(), end.tolist(), strict=True)):
        last = -1 if b != template else last
        template = b
        taken[i] = s >= last
        last = e if taken[i] else last
    return taken


def _scanned(batches: Iterator[pa.RecordBatch], at: int, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    labels = [label for label, _ in (*phrases, *templates)]
    automaton = compiled(tuple(t for _, t in (*phrases, *templates)))
    kinds = [pa.field("label", pa.string()), pa.field("first_word", pa.int64()), pa.field("n_words", pa.int64())]
    for batch in batches:
        for begin, stop, raw, offsets in chunks(batch.column(at)):
            data, rows = ASCII_LOWER[raw], stop - begin
            first, last, row = find_words(data, offsets, NO_WORD)
            until = np.searchsorted(row, np.arange(rows + 1))
            n_words = np.diff(until)
            bit, start, end = automaton.run(automaton.symbols(data, first, last), until[row + 1])
            of = row[start]
            base = bit < len(phrases)
            n_base = np.bincount(of[base], minlength=rows)
            low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1, np.int64)
            np.minimum.at(low, of[base], start[base])
            np.maximum.at(high, of[base], start[base])
            keep = _apart(bit, start, end)
            bit, start, end, of = bit[keep], start[keep], end[keep], of[keep]
            covered = np.zeros((rows, 0 if not len(bit) else int(bit.max()) + 1))
            np.add.at(covered, (of, bit), end - start)
            share = covered.max(axis=1, initial=0) / np.maximum(n_words, 1)
            names = [[set(), set()] for _ in range(rows)]
            for r, b in set(zip(of.tolist(), bit.tolist(), strict=True)):
                names[r][1].add(labels[b])
                if b < len(phrases):
                    names[r][0].add(labels[b])
            order = np.lexsort((bit, start, of))
            bit, start, end, of = bit[order], start[order], end[order], of[order]
            own = pa.StructArray.from_arrays([pa.array([labels[b] for b in bit.tolist()], pa.string()), pa.array(start - until[of]), pa.array(end - start)], fields=kinds)
            matches = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), own)
            none = n_base == 0
            added = [
                pa.array(n_words), pa.array(n_base), pa.array(low - until[:-1], mask=none), pa.array(high - until[:-1], mask=none),
                *(pa.array([",".join(sorted(x[i])) for x in names], pa.string()) for i in range(2)), pa.array(share), matches,
            ]
            yield pa.RecordBatch.from_arrays([*batch.slice(begin, rows).columns, *added], [*batch.schema.names, *ADDED])


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """docs with n_words; n_base, first_word and last_word of the places of phrases; base_labels, labels, score and matches (the phrases' too)."""
    docs = without(docs, *ADDED)
    compiled(tuple(t for _, t in (*phrases, *templates)))  # errors in templates are raised here
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda b: _scanned(b, at, templates, phrases), f"{kinds}, {_KINDS}")


def _regex(nodes: list[Node]) -> str:
    out = {"word": lambda w: rf"\|{w}\|", "any": lambda a, b: rf"(?:\|[^|]*\|){{{a},{b}}}", "opt": lambda n: f"(?:{_regex(n)})?"}
    return "".join(out[kind](*rest) for kind, *rest in nodes)


def template_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> str:
    """The same scan in DuckDB SQL: words between bars, and a regular expression a template."""
    rules = []
    for label, t in (*phrases, *templates):
        nodes = parse(t)
        while nodes[0][0] == "any":
            nodes = nodes[1:]
        rules.append((label, _regex(nodes)))
    found = ",\n".join(f"regexp_extract_all(line, '{rule}') AS m{i}" for i, (_, rule) in enumerate(rules))
    bars = lambda i: f"list_sum(list_transform(m{i}, lambda x: length(x) - length(replace(x, '|', ''))))"
    shares = ", ".join(f"coalesce({bars(i)}, 0)" for i in range(len(rules)))
    kept = lambda upto: ", ".join(f"CASE WHEN len(m{i}) > 0 THEN '{label}' END" for i, (label, _) in enumerate(rules[:upto]))
    joined = lambda upto: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{kept(upto)}], lambda x: x IS NOT NULL))), ','), '')"
    places = " + ".join(f"len(m{i})" for i in range(len(phrases)))
    either = "|".join(rule for _, rule in rules[: len(phrases)])
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
l AS (SELECT doc_id, len(words) AS n, CASE WHEN len(words) > 0 THEN '|' || array_to_string(words, '||') || '|' ELSE '' END AS line FROM w),
f AS (SELECT doc_id, n, line, {found} FROM l),
g AS (SELECT *, {places} AS places, regexp_extract(line, '^(.*?)(?:{either})', 1) AS head, regexp_extract(line, '^(.*)(?:{either})', 1) AS lead FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(places AS BIGINT) AS n_base,
       CASE WHEN places > 0 THEN CAST((length(head) - length(replace(head, '|', ''))) // 2 AS BIGINT) END AS first_word,
       CASE WHEN places > 0 THEN CAST((length(lead) - length(replace(lead, '|', ''))) // 2 AS BIGINT) END AS last_word,
       {joined(len(phrases))} AS base_labels, {joined(len(rules))} AS labels,
       CASE WHEN n > 0 THEN CAST(greatest({shares}) AS DOUBLE) / 2 / n ELSE 0 END AS score
FROM g
"""
