"""Inputs that once broke an operator: tight clusters, rare dimensions, one huge text, words that weak hashes confuse, long words."""

import re
import tracemalloc
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import lattice_lm, mil_quality, minhash, pivot_index, quality_rules, warc
from codefacts.llm.buffers import Spans


def brute_links(x, least=0.98):
    """(links of each row, smallest row that it reaches) by blocks of a product with itself."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T) >= least
    np.fill_diagonal(near, True)
    root = np.arange(len(x))
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            return near.sum(axis=1) - 1, root
        root = new


def compare(spark, x, **options):
    table = spark.createDataFrame([(i, "a", row.tolist()) for i, row in enumerate(x)], "vec_id bigint, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(table, **options).collect()}
    n, root = brute_links(x)
    assert got == {i: (n[i], root[i]) for i in range(len(x))}


def test_one_tight_cluster(spark):
    """All vectors have one pivot, whose list is longer than the bound for lists."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=8) + rng.normal(scale=0.06, size=(5000, 8))
    compare(spark, x)
    compare(spark, x[:400], long_list=100, block_rows=64)


def test_two_pivots(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=6) + rng.normal(scale=0.05, size=(600, 6)) for _ in range(2)])
    compare(spark, x, long_list=100, block_rows=128)


def test_rare_dimension(spark):
    rng = np.random.default_rng(3)
    many = [(i, "a", row.tolist()) for i, row in enumerate(rng.normal(size=(4000, 4)))]
    base = rng.normal(size=9)
    rare = base + rng.normal(scale=0.08, size=(700, 9))
    table = spark.createDataFrame(many + [(10_000 + i, "a", row.tolist()) for i, row in enumerate(rare)], "vec_id bigint, label string, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivot_index.near_vectors(table, long_list=200, most_pivots=64).where("vec_id >= 10000").collect()}
    assert got == {10_000 + i: n for i, n in enumerate(brute_links(rare)[0])} and sum(got.values()) > 0
    one = pivot_index.choose_pivots(table.selectExpr("*", "size(embedding) AS dims", "embedding AS vector"), 64, kinds=1)
    assert set(one) == {4}


def test_recall_of_planted_pairs(spark):
    """Pairs planted at cosines of 0.98 to 0.99 among random vectors are found."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(3000, 64))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.98, 0.99, (3000, 1))
    both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * side])
    table = spark.createDataFrame([(i, "a", row.tolist()) for i, row in enumerate(both)], "vec_id bigint, label string, embedding array<double>")
    found = pivot_index.near_vectors(table).agg({"n_links": "sum"}).first()[0]
    assert found >= 0.99 * brute_links(both)[0].sum()


def test_one_huge_labelled_text(spark):
    """A text that exceeds the bound is passed over, wherever it stands; the rest is learnt from."""
    good, bad = "a calm and well made sentence about rivers. ", "$$$ CLICK HERE %% BUY NOW ||| "
    own = range(900)
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in own]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = docs.where(~mil_quality.in_fold(docs.doc_id)).orderBy(mil_quality.F.xxhash64("doc_id")).first().doc_id
    docs = spark.createDataFrame([(i, t * 4000 if i == first else t) for i, t in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        model = mil_quality.train(docs, labels, most_passages=2000)
    assert any("passages" in str(w.message) for w in told) and abs(model.p["c"]).max() > 0.01
    assert mil_quality.fitting([5, 200, 1, 101, 100], 1000) == [0, 2, 4]
    again = docs.unionByName(docs)
    assert abs(mil_quality.train(again, labels, most_passages=2000).p["c"]).max() > 0.01


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate({97: 98, 98: 97})
    return x[:n], x[:n].translate({97: 98, 98: 97})


def test_words_that_sums_modulo_a_power_of_two_confuse(spark):
    for n in (512, 1024, 2048, 4096):
        a, b = (np.frombuffer(w.encode(), np.uint8) for w in thue_morse(n))
        both = Spans(np.concatenate([a, b, a])).hash(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert both[0] == both[2] != both[1]
    a, b = thue_morse(1024)
    texts = [f"{a} x y z u v", f"{b} x y z u v", f"{a} x y {b} x y", f"{a} x y {a} x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_repeat_words for r in quality_rules.judge_documents(docs).orderBy("doc_id").collect()] == [0, 0, 0, 6]
    assert {r.component_id for r in minhash.near_duplicates(docs).collect()} == {0, 1, 2, 3}
    scored = {r.doc_id: r.n_known for r in lattice_lm.score_texts(spark.createDataFrame([(0, a), (16, b)], "doc_id bigint, text string")).collect()}
    assert scored[0] == 2 or scored[16] == 2


def test_long_words_by_the_recursion_of_short_ones(monkeypatch):
    pieces = lattice_lm.load_pieces("/opt/tokenizers/piece_bpe_32k.model")
    lattice, texts, weights = lattice_lm.Lattice(pieces), ["thequickbrown", "é\U0001f600x", "a" * 30], np.array([1.0, 2.0, 3.0])
    plain, uses = lattice.run(texts), lattice.run(texts, weights)
    monkeypatch.setattr(lattice_lm, "LONG_WORD", 0)
    assert lattice.run(texts) == pytest.approx(plain, rel=1e-9) and lattice.run(texts, weights) == pytest.approx(uses, rel=1e-6, abs=1e-12)
    tracemalloc.start()
    lattice.run(["ab1" * 30_000], np.ones(1))
    assert tracemalloc.get_traced_memory()[1] < 40 * 90_000
    tracemalloc.stop()


def test_payloads_that_share_a_bit_of_the_bitmap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "WORDS", 2)
    rows = [(i, "u", f"{i % 40 if i % 3 else i}" * 1200) for i in range(1200)] + [(None, "u", "7" * 1200), (None, None, "n" * 1200), (5, "u", "5" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, uri = warc.archive(pages, uri=f"file://{tmp_path}/w")
    got = warc.read_records(index, uri, payloads=True).collect()
    largest = {}
    for page_id, _, html in rows:
        largest[html] = max((x for x in (largest.get(html), page_id) if x is not None), default=None)
    want = [(p, len(h), None if largest[h] == p else largest[h], h if largest[h] == p else None) for p, _, h in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.refers_to, r.payload and bytes(r.payload).decode())) for r in got)


def test_payloads_are_not_shuffled(spark):
    pages = spark.range(0, 3000, 1, 4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("y"), 1200), F.col("id") % 2000).alias("html"))
    records = warc.plan_records(pages)
    assert records.where("payload IS NOT NULL").count() == 2000
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(records.select("*")._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffled = re.findall(r"\) Exchange *\nInput \[\d+\]: \[(.*?)\]", plan)
    assert shuffled and sum("payload" in columns for columns in shuffled) <= 1  # those that share a bit by chance
