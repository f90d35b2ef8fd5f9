"""License scan, alignment and fill-in-the-middle: brute force, edge cases, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import alignment, fill_middle, licenses, queries
from codefacts.llm.wavelet import CHARACTERS, TOKENS, WaveletMatrix, classes

DOCS = "doc_id bigint, text string, N bigint, Labels string, groups string, `a b` int"
LONG = " ".join(f"w{i % 997} é{i % 31}\n" for i in range(40_000))
TEXTS = [None, "", " ", "one", "a<P>b", "Ab1 é\n\U0001f600 x" * 9, "  \n\t ", "x" * 9000, LONG, "7" * 50, "\x00\x1f", "é", "ÀÉ a", "<|endoftext|> <s> x", "a▁b", " " * 3000 + "z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "l", "g", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, "no id here", None, None, None, 0)], DOCS).cache()


def fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (doc_id, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out, text)


def test_fill_middle(docs):
    got = fill_middle.fill_in_middle(docs).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [fim(i, t) for i, t in enumerate(TEXTS)] + [fim(5, TEXTS[5])] * 2 + [fim(None, "no id here")]
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got) == Counter(want)
    assert got[0]["a b"] == 0 and "N" not in got[0].asDict() and fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_every_form_is_restored(spark):
    rows = [(i, "".join(random.Random(i).choice("aB<>PSM é\n") for _ in range(i % 60))) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for unit in ("token", "character"):
        got = fill_middle.fill_in_middle(table, seed="s", unit=unit).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.again == r.text for r in got)
        assert unit == "token" or all(r.n == len(r.text) for r in got)


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 8, 1000).astype(np.uint8)
    matrix, at = WaveletMatrix(kinds), np.sort(rng.integers(0, 1001, (300, 2)), axis=1)
    for k in range(8):
        assert (matrix.rank(k, at[:, 0], at[:, 1]) == [(kinds[a:b] == k).sum() for a, b in at]).all()
    data = np.frombuffer("ab".encode() + "cé1".encode(), np.uint8)
    own = classes(data, np.array([0, 2, 2, 6]))
    matrix = WaveletMatrix(own)
    assert matrix.count(TOKENS, np.array([0, 2]), np.array([2, 6])).tolist() == [1, 3] and matrix.count(CHARACTERS, np.array([2]), np.array([6])).tolist() == [3]


def test_cuts_at_the_end_of_a_buffer():
    """Whatever the size of a buffer is, a cut may be at its end, while cuts of other texts are still looked for; its last texts may be empty."""
    for size in range(140):
        for texts in (["a " * (size // 2) + "b" * (size % 2), ""], ["a " * 40, "b" * size], ["é1", "c" * size, "", ""]):
            data = "".join(texts).encode()
            offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
            units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
            draw = np.array([[len(u) // 2, len(u)] for u in units])
            n, a, b, before, between = fill_middle.find_cuts(np.frombuffer(data, np.uint8), offsets, draw, TOKENS)
            assert n.tolist() == [len(u) for u in units] and b.tolist() == offsets[1:].tolist()
            assert before.tolist() == [len("".join(u[: len(u) // 2])) for u in units] and [data[i:j].decode() for i, j in zip(a, b, strict=True)] == ["".join(u[len(u) // 2 :]) for u in units]


def phrase_places(text):
    words = licenses.word_list(text or "")
    return words, [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


def test_licenses(docs, spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and "Permission" in t)
    whole = re.sub(r"<<any [^>]*>>", "Copyright 2020 Some Holders", re.sub(r"<<(opt|end)>>", "", mit))
    texts = [*TEXTS, f"x {whole} y", whole.replace("to deal in", "to dealt in"), re.sub(r"<<opt>>.*?<<end>>", "", mit.replace("<<opt>>(MIT)<<end>>", "")).replace("<<any 1-12>>", "the authors").replace("<<end>>", ""),
             "Apache-licenſe APACHE\nlicense. mit mit license mit license", "Licensed under the MIT License " * 500, "Licensed under the Apache License, 2.0", "licensed under the apache license version the 2.0", "cc-by"]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, SCORE string")
    got = {r.doc_id: r for r in licenses.scan_licenses(table).collect()}
    for i, t in enumerate(texts):
        words, places = phrase_places(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    n = len(TEXTS)
    assert [got[n + i].labels for i in range(8)] == ["mit", "mit", "mit", "apache,mit", "mit", "apache,apache-2.0", "apache", "cc-by"]
    assert got[n].score > 0.9 and got[n + 1].score < 0.1 and got[n + 2].score > 0.9 and got[n + 4].score == 1 and got[n + 5].score == 1 and got[n + 6].score < 0.5
    assert [m.label for m in got[n + 4].matches] == ["mit", "mit"] * 500
    assert licenses.scan_licenses(docs).count() == len(TEXTS) + 3 and licenses.scan_licenses(docs.limit(0)).count() == 0


def test_templates_against_regular_expressions():
    """Random templates over few words: the automaton finds what a backtracking search finds."""
    rng = random.Random(4)
    for _ in range(150):
        parts = [rng.choice("abc")] + [rng.choice(["a", "b", "c", "<<opt>>a b<<end>>", "<<opt>>c <<opt>>b<<end>><<end>>", "<<any 0-2>>", "<<any 1-3>>"]) for _ in range(rng.randint(1, 5))] + [rng.choice("abc")]
        text = [rng.choice("abcd") for _ in range(40)]
        machine = licenses.Automaton([" ".join(parts)])
        raw = np.frombuffer("".join(text).encode(), np.uint8)
        _, start, end = machine.run(machine.symbols(raw, np.arange(40), np.arange(1, 41)), np.full(40, 40))
        line, rule = "".join(f"|{w}|" for w in text), licenses._regex(licenses.parse(" ".join(parts)))
        want = {}
        for i in range(40):
            ends = [j for j in range(i + 1, 41) if re.fullmatch(rule, line[3 * i : 3 * j])]
            if ends:
                want[i] = max(ends)
        assert dict(zip(start.tolist(), end.tolist(), strict=True)) == want
    for bad in ("<<opt>>a", "a<<end>>", "<<any 0-3>>", "<<opt>>a<<end>>"):
        with pytest.raises(ValueError):
            licenses.parse(bad)


def aligned(text, ta, tb):
    """(A ids, B ids, groups as pairs of lists) by going through both lists."""
    a, b = ta._tokenizer.encode(f" {text or ''}", add_special_tokens=False).ids, tb.encode([text or ""])[0]
    if not text or b"".join(ta.tokens[i] for i in a) != f" {text}".encode() or b"".join(tb.tokens[i] for i in b) != f" {text}".encode():
        return [], [], []
    ends_a, ends_b = np.cumsum([len(ta.tokens[i]) for i in a]).tolist(), np.cumsum([len(tb.tokens[i]) for i in b]).tolist()
    groups, i, j = [], 0, 0
    both = set(ends_a) & set(ends_b)
    while i < len(a):
        x, y = i, j
        while ends_a[i] not in both:
            i += 1
        while ends_b[j] not in both:
            j += 1
        i, j = i + 1, j + 1
        groups.append((a[x:i], b[y:j]))
    return a, b, groups


def expected(texts):
    ta, tb = alignment.tokenizers(alignment.TOKENIZERS, *alignment.FILES)
    whole = [aligned(t, ta, tb) for t in texts]
    links = [Counter((p, q) for x, y in groups for p in x for q in y) for *_, groups in whole]
    counts = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for (a, b, groups), own in zip(whole, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(own.values()), text, sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items())))
    return out


@pytest.mark.parametrize("most_sent", [1_000_000, 200, 0])
def test_alignment(docs, most_sent):
    got = alignment.add_link_counts(alignment.align(docs), alignment.piece_count(), most_sent).collect()
    want = expected([*TEXTS, TEXTS[5], TEXTS[5], "no id here"])
    ids = [*range(len(TEXTS)), 5, 5, None]
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in got) == Counter((i, *w) for i, w in zip(ids, want, strict=True))
    assert got[0]["a b"] is not None and got[0].asDict().keys().isdisjoint({"pairs", "times", "row_key"})
    assert next(r for r in got if r.doc_id == 14).n_a == 0  # U+2581 in the text
    assert alignment.add_link_counts(alignment.align(docs.limit(0)), alignment.piece_count()).count() == 0


def test_alignment_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(table, expected([r.text for r in table]), strict=True)}
    got = queries.op12_alignment(spark, sf_dir).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got} == {i: (*w[:4], digest(w[4]), *w[5:]) for i, w in want.items()}


def test_alignment_of_many_rows(spark):
    """More rows in one batch than are looked up at a time."""
    texts = [f"row {i} of many, word{i % 7}" for i in range(700)]
    got = alignment.add_link_counts(alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)), alignment.piece_count()).collect()
    assert {r.doc_id: (r.n_links, r.n_best, r.count_sum) for r in got} == {i: (w[3], *w[5:]) for i, w in enumerate(expected(texts))} and len(got) == 700


def test_gallop_and_slices():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (1, 1), (40, 4000), (300, 300), (5, 100_000)):
        short, long = (np.unique(rng.integers(0, 3 * max(n, m), k)) for k in (n, m))
        i, j = alignment.gallop(short, long)
        assert short[i].tolist() == long[j].tolist() == sorted(set(short.tolist()) & set(long.tolist()))
    a, b = rng.integers(0, 50, 3000), rng.integers(0, 40, 2000)
    ends_a, ends_b, text = np.array([2, 2600, 2601, 3000]), np.array([1, 1500, 1700, 2000]), np.array([0, 0, 1, 1])
    want = Counter()
    for g in range(4):
        for x in a[0 if not g else ends_a[g - 1] : ends_a[g]]:
            for y in b[0 if not g else ends_b[g - 1] : ends_b[g]]:
                want[int(text[g]), int(x * 40 + y)] += 1
    got = alignment.pair_counts(a, b, ends_a, ends_b, text, 40)
    assert Counter({(t, p): n for t, p, n in zip(*(x.tolist() for x in got), strict=True)}) == want
