"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from codefacts.llm import lattice_lm, line_dedup, mil_quality, minhash, mixing, packing, pivot_index, quality_rules, suffix_index, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept string, score string, `a b` int"
PROSE = "the quick brown fox jumps over a lazy dog near the old river bank while seven small birds sing in tall trees. "


def rows():
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "Same line\nother", "same LINE \nthird", PROSE * 4, PROSE * 4, long, "éè \U0001f600 x" * 50, "a" * 5000]
    out = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 1, "k", "s", i) for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, "no id\nSame line", "en", "s1", 3, 1, "k", "s", 0), (20, PROSE * 4 + "more", None, None, None, 1, "k", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(docs, empty):
    got = line_dedup.drop_repeated_lines(docs.withColumn("n_lines", F.lit("x")), min_docs=3).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].text is None and by[0].n_lines == 1 and by[0].n_dropped == 0
    assert by[4].text == "other" and by[5].text == "third" and by[None].text == "no id"
    assert by[2].text == " \n\t " and by[6].text == "" and by[6].n_dropped == 1
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.orderBy(F.desc("doc_id"))).collect()
    assert len(got) == len(rows()) and Counter(map(str, got)) == Counter(map(str, again))
    for r in got:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.kept == "k"
        assert r.target <= 2 * r.source_size
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.repeated(mixing.mix_sources(docs)).count() == sum(r.copies for r in got)


def test_mixing_hits_targets(spark):
    many = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 97 AS INT)) AS text", "concat('s', CAST(pow(id % 10, 0.5) AS INT)) AS source")
    for r in mixing.mix_sources(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 97


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=100, per_source=1).collect()
    sizes = {r[0]: len((r[1] or "").split()) for r in rows()}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    assert {r.doc_id for r in bins.pop(None)} == {0, 1, 2}
    for own in bins.values():
        assert sum(r.n_words for r in own) <= 100
        assert len({(r.doc_id, r.piece) for r in own if sizes[r.doc_id] == 88}) <= 1  # one of the four equal texts
        assert sorted(r.bin_offset for r in own) == [sum(x.n_words for x in own if x.bin_offset < r.bin_offset) for r in sorted(own, key=lambda r: r.bin_offset)]
    assert sum(r.n_words for r in got) == sum(len((r[1] or "").split()) for r in rows())
    assert packing.pack(empty).count() == 0


def test_best_fit_is_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    n = 400
    sizes, sources, clusters = np.sort(rng.integers(1, 100, n))[::-1].tolist(), rng.integers(-1, 4, n).tolist(), rng.integers(-1, 60, n).tolist()
    bins = []
    for (b, offset), size, s, c in zip(packing.best_fit(sizes, sources, clusters, 100, 2), sizes, sources, clusters, strict=True):
        def fits(own):
            return own["left"] >= size and (s < 0 or own["s"].count(s) < 2) and (c < 0 or c not in own["c"])

        good = [x["left"] for x in bins if fits(x)]
        if b == len(bins):
            assert not good
            bins.append({"left": 100, "s": [], "c": []})
        assert fits(bins[b]) and (not good or bins[b]["left"] == min(good)) and offset == 100 - bins[b]["left"]
        bins[b]["left"] -= size
        bins[b]["s"].append(s)
        bins[b]["c"].append(c)


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[6].n_words == 88 and got[6].n_repeat_words == 88 and got[6].base_failed
    assert got[9].word_chars == 200 and got[4].n_dup_lines == 0
    assert quality_rules.judge_documents(empty).count() == 0


def test_quality_verdict(spark):
    prose = [" ".join(f"word{(i * j) % 83}{'.' if j % 9 == 0 else ''}" for j in range(1, 81)) + "." for i in range(1, 4)]
    bad = ["\n".join(f"Item{i} | Other{i} | Third{i} |" for i in range(20)), "SHOUT".join(f" W{i}!! " for i in range(90)), " ".join(f"word{i}###" for i in range(80))]
    table = spark.createDataFrame(list(enumerate(prose + bad)), "doc_id long, text string")
    assert [r.kept for r in quality_rules.judge_documents(table).orderBy("doc_id").collect()] == [True] * 3 + [False] * 3


def test_minhash(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == 0 and by[0].component_id == 0 and by[1].kept
    assert by[3].n_shingles == 1 and by[7].component_id == 6 and not by[7].kept and by[20].component_id == 6
    assert by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(empty).count() == 0


def test_lattice(docs, empty):
    got = lattice_lm.score_texts(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == 1 and by[0].base_score == by[1].base_score and by[0].score == by[2].score < 0
    assert by[8].n_tokens == 60_001 and len([r for r in got if r.doc_id == 6]) == 3
    assert lattice_lm.score_texts(empty).count() == 0


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.Lattice(["▁a", "b", "▁", "a", "ab", "▁ab", "bb"])

    def brute(text):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            piece = text[:n]
            p = np.exp(lattice.log[lattice.ids[piece]]) if piece in lattice.ids else np.exp(lattice.byte * len(piece.encode())) if n == 1 else 0.0
            total += p * brute(text[n:]) if p else 0.0
        return total

    words = ["ab", "abb", "", "é", "ba€b", "abbabb", "b" * 60]
    got = lattice.run(words)
    for w, x in zip(words[:-1], got, strict=False):
        assert np.isclose(np.exp(x), brute("▁" + w))
    assert np.isfinite(got[-1])
    uses = lattice.run(["ab"], np.array([3.0]))
    paths = {("▁ab",): 0, ("▁", "ab"): 0, ("▁a", "b"): 0, ("▁", "a", "b"): 0}
    paths = {k: np.exp(sum(lattice.log[lattice.ids[p]] for p in k)) for k in paths}
    want = 3 * sum(v for k, v in paths.items() if "b" in k) / sum(paths.values())
    assert np.isclose(uses[lattice.ids["b"]], want)


def test_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, None), (7, None, 0), (None, 1, 0), (8, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = mil_quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = mil_quality.score_quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert mil_quality.score_quality(empty, labels).count() == 0


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    x, bounds, y = rng.normal(size=(9, mil_quality.WIDTH)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    model = mil_quality.AttentionMil()
    model.p["c"] = rng.normal(size=24)

    def loss():
        p = model._forward(x, bounds)[5]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    own = model._gradients(x, bounds, y)
    for k, w in model.p.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        keep = w[at]
        w[at] = keep + 1e-6
        up = loss()
        w[at] = keep - 1e-6
        down = loss()
        w[at] = keep
        assert np.isclose((up - down) / 2e-6, own[k][at] - 1e-4 * keep, atol=1e-5)


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        yield int(gone.sum()), np.frombuffer(d, np.uint8)[~gone].tobytes()


def test_suffix_index(spark, docs, empty):
    got = suffix_index.remove_repeats(docs.withColumn("n_bytes", F.lit(None)), batches=3).withColumnRenamed("kept", "kept_bytes").collect()
    order = lambda x: (x[0] if x[0] is not None else -1, *x[1:])
    want = [(r[0], *x) for r, x in zip(rows(), brute_repeats([r[1] for r in rows()]), strict=True)]
    assert sorted(((r.doc_id, r.n_removed, bytes(r.kept_bytes)) for r in got), key=order) == sorted(want, key=order)
    assert suffix_index.remove_repeats(empty).count() == 0


def test_suffix_index_finds_every_repeat(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = [word(n) for n in (199, 200, 201, 260, 450, 900)]
    texts = [word(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 6))] + word(int(rng.integers(0, 120))) + shared[int(rng.integers(0, 6))] for _ in range(60)]
    texts += ["xy" * 300, "z" * 199, "é" * 150, shared[4][:230], None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_index.remove_repeats(table).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_pivot_index(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = [(base[i % 40] + rng.normal(0, 0.08 * (i % 3), 16)).astype(float).tolist() for i in range(400)]
    table = [(i, v, i % 2, 5, "x") for i, v in enumerate(vectors)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [None] + [1.0] * 15, 1), (503, [float("nan")] * 16, 1), (504, vectors[0], None), (None, vectors[0], 0), (505, [1.0, 2.0], 1), (506, [1.0, 2.0], 1), (506, [1.0, 2.0], 1), (507, [], 1)]
    table = spark.createDataFrame(table + [(*x, 5, "x") for x in odd], "vec_id long, embedding array<float>, label int, n_links int, kept string")
    got = {r.vec_id: r for r in pivot_index.near_vectors(table, block_rows=16).collect()}
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.98) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2) & ~np.eye(400, dtype=bool)
    found = np.array([got[i].n_links for i in range(400)])
    assert (found <= close.sum(axis=1)).all() and found.sum() >= 0.95 * close.sum()
    for i in (500, 501, 502, 503, 504, None, 507):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[505].n_links == 2 and got[506].component_id == 505
    assert pivot_index.near_vectors(table.where("false")).count() == 0


def test_pivot_index_counts_each_link_once(spark):
    rng = np.random.default_rng(2)
    v = [(i, (np.ones(8) + rng.normal(0, 0.02, 8)).tolist(), 1) for i in range(200)]
    got = pivot_index.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>, label int"), block_rows=32).collect()
    x = np.array([r[1] for r in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert [r.n_links for r in sorted(got)] == want.tolist()


def test_warc(spark, tmp_path):
    big = "x" * 1500
    pages = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (7, "u", "é" * 200_000), (7, "u", "é" * 200_000)]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    index, uri = warc.archive(table, uri=f"file://{tmp_path}/w")
    got = warc.read_records(index, uri, payloads=True).collect()
    assert len(got) == len(pages)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "response", None)]
    for r in got:
        html = next(p[2] for p in pages if p[0] == r.page_id) or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()
    for r in index.collect():
        plain = warc.Bundle(fs.LocalFileSystem(), str(tmp_path / "w" / r.file)).frame(r.frame)
        record = plain[r.record_offset : r.record_offset + r.record_bytes]
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{'none' if r.page_id is None else r.page_id}>".encode() in record
    index, uri = warc.archive(table.where("false"), uri=f"file://{tmp_path}/none")
    assert index.count() == 0 and warc.read_records(index, uri).count() == 0


CLASHES = "KEY text_key size_of component_of GONE AT line words of_source source_key copy_number own_spans K class_key of_class N_LINES Size TARGET n_Bytes SPANS x c".split()


@pytest.mark.parametrize("name", ["line_dedup", "mixing", "repeated", "minhash", "suffix_index", "quality_rules", "mil_quality"])
def test_clashing_names(spark, docs, name):
    """Columns that carry an operator's helper names pass through, and those of its results are replaced in any case."""
    own = docs.drop("size", "kept", "score").select("*", *[F.lit(c).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(3, 1), (6, 0)], "doc_id long, quality int")
    run, added = {
        "line_dedup": (line_dedup.drop_repeated_lines, ("n_lines", "n_dropped")),
        "mixing": (mixing.mix_sources, mixing.ADDED),
        "repeated": (lambda d: mixing.repeated(mixing.mix_sources(d)), mixing.ADDED),
        "minhash": (minhash.near_duplicates, minhash.ADDED),
        "suffix_index": (suffix_index.remove_repeats, suffix_index.ADDED),
        "quality_rules": (quality_rules.judge_documents, quality_rules.RESULT),
        "mil_quality": (lambda d: mil_quality.score_quality(d, labels), mil_quality.ADDED),
    }[name]
    got = run(own)
    kept = [c for c in own.columns if c.lower() not in added]
    assert got.columns[: len(kept)] == kept and set(got.columns[len(kept) :]) == (set() if name == "repeated" else set(added))
    assert all(r[c] == c for r in got.collect() for c in CLASHES if c in kept)


def test_clashing_names_of_vectors(spark):
    own = spark.createDataFrame([(1, [1.0, 2.0], 1, "u", "v"), (2, [1.0, 2.0], 1, "u", "v")], "vec_id long, embedding array<double>, label int, OF_class string, class_key string")
    assert sorted(pivot_index.near_vectors(own).collect()) == [(1, [1.0, 2.0], 1, "u", "v", 1, 1, True), (2, [1.0, 2.0], 1, "u", "v", 1, 1, False)]


def test_ties_of_ranks_and_sizes(spark):
    """Rows of equal Pareto rank are taken together, and equal sizes are packed in the order of doc_id."""
    same = spark.createDataFrame([(7, "a b", "s")] * 4 + [(i, "a b", "s") for i in range(8)], "doc_id long, text string, source string")
    assert {len({x.copies for x in mixing.mix_sources(same).where("doc_id = 7").collect()})} == {1}
    bins = [(r.doc_id, r.bin_id, r.bin_offset) for r in packing.pack(same.where("doc_id <> 7").withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"))), capacity=6).orderBy("bin_id", "bin_offset").collect()]
    assert [b[0] for b in bins] == sorted(b[0] for b in bins) and Counter(b[1] for b in bins) == {0: 2, 1: 2, 2: 2, 3: 1}


def test_clusters_of_near_copies_part(spark):
    own = spark.createDataFrame([(i, f"a b {i}", "s", i // 3) for i in range(9)], "doc_id long, text string, source string, component_id long")
    bins = packing.pack(own, capacity=9, cluster=F.col("component_id")).collect()
    assert len({r.bin_id for r in bins}) == 3 and all(len({r.bin_id for r in bins if r.doc_id // 3 == c}) == 3 for c in range(3))


def test_long_pivot_lists_are_taken_apart(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 12))
    vectors = [(i, (base[i % 60] + rng.normal(0, 0.05, 12)).tolist(), 1) for i in range(600)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    whole, apart = (sorted(pivot_index.near_vectors(table, block_rows=64, long_list=n).collect()) for n in (10_000, 20))
    assert whole == apart and sum(r.n_links for r in whole) > 1000


def test_suffix_family_goes_on_from_earlier_batches(spark, tmp_path):
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = [word(300) for _ in range(3)]
    texts = [word(250) + shared[i % 3] + word(80) if i % 4 else word(300) for i in range(40)]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, k long")
    path, ranks, names = f"file://{tmp_path}/family", [], []
    for first in range(0, 40, 10):
        family = suffix_index.SuffixFamily(spark, path)
        family.add(suffix_index.suffixes_of(table.where(F.col("k").between(first, first + 9))).drop("part"))
        ranks.append([r for r, _ in family.levels])
        names.append({a for _, a in family.levels})
    assert ranks == [[0], [1], [1, 0], [2]] and names[1] < names[2]
    family = suffix_index.SuffixFamily(spark, path)
    ((_, array),) = family.levels
    parts = [[(r.p, r.fp, r.k, r.at) for r in rows] for rows in family.table(array).rdd.glom().collect()]
    whole = suffix_index.suffixes_of(table).drop("part").collect()
    assert all(rows == sorted(rows) for rows in parts) and sorted(x for rows in parts for x in rows) == sorted(map(tuple, whole))
    seen = Counter((r.p, r.fp) for r in whole)
    assert {tuple(r) for r in family.matched().collect()} == {k for k, n in seen.items() if n > 1}
    assert all(r.p == int.from_bytes(texts[r.k][r.at : r.at + 8].encode(), "big") - (1 << 63) for r in whole)


def test_driver_gets_no_more_passages_than_stated(spark):
    rows = [(i, ("good words here " if i % 2 else "# # $ % ") * (3000 if i == 4 else 40), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    sizes = []
    fit = mil_quality.AttentionMil.fit
    try:
        mil_quality.AttentionMil.fit = lambda self, x, bounds, y: sizes.append(len(x)) or fit(self, x, bounds, y)
        mil_quality.train(docs, labels, most_passages=50)
    finally:
        mil_quality.AttentionMil.fit = fit
    assert 20 < sizes[0] <= 50


def test_attention_score_by_hand(spark):
    """The forward pass over bags equals the formula written out passage by passage."""
    rng = np.random.default_rng(3)
    model = mil_quality.AttentionMil()
    model.p = {k: rng.normal(size=v.shape) for k, v in model.p.items()}
    x, bounds = rng.normal(size=(7, mil_quality.WIDTH)), [0, 1, 5]
    p, sigmoid = model.p, lambda v: 1 / (1 + np.exp(-v))
    for got, (a, b) in zip(model.score(x, np.array(bounds)), [(0, 1), (1, 5), (5, 7)], strict=True):
        h = [np.maximum(row @ p["W"] + p["b"], 0) for row in x[a:b]]
        gates = np.array([sum(p["w"][j] * np.tanh(v @ p["V"][:, j]) * sigmoid(v @ p["U"][:, j]) for j in range(len(p["w"]))) for v in h])
        weights = np.exp(gates) / np.exp(gates).sum()
        assert np.isclose(got, sigmoid(sum(w * v for w, v in zip(weights, h, strict=True)) @ p["c"] + p["d"][0]))
