"""The registered queries against SQL or brute force at the smallest scale."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from codefacts.llm import queries

TABLES = ("documents", "pages", "embeddings", "labels")


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    text = lambda x: "NULL" if x is None or x is pd.NA or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)]
    df = df.astype({c: float for c in df.columns if df[c].dtype.kind == "i" and c in ("refers_to", "first_word", "last_word", "prefix_chars", "middle_chars")})
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, con, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def texts(con):
    return con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_near_duplicates(spark, sf_dir, con):
    own = texts(con)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in own}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = queries.op6_minhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_base_score(spark, sf_dir, con):
    tokens = {i: [*words(t), "\n"] for i, t in texts(con)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in queries.op7_lattice_lm(spark, sf_dir).collect()}
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9) and r.score < 0


def test_held_out_accuracy(spark, con):
    """Trained on the training folds of a larger scale, the classifier is right on the held-out fold."""
    large = "/root/testdata/sf0.01"
    got = queries.op8_mil_quality(spark, large).where("held_out").join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    right = defaultdict(list)
    for r in got:
        right[r.quality].append(r.predicted == r.quality)
    assert len(got) > 80 and all(sum(x) >= 0.9 * len(x) for x in right.values())


def test_pipeline(spark, sf_dir, con):
    import corpus_pipeline
    from codefacts.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, last = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        last = cut(stage(spark, last, sf_dir), name)
        seen[name] = last.toPandas()
    ids = {name: Counter(t["doc_id"]) for name, t in seen.items()}
    whole = docs.toPandas()
    good = {r[0] for r in con.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    assert set(ids["quality"]) <= set(whole["doc_id"]) and len(set(ids["quality"]) & good) >= 0.95 * len(good)
    assert ids["line_dedup"] == ids["quality"] and set(ids["near_dedup"]) <= set(ids["line_dedup"])
    assert all(list(seen[n].columns) == list(whole.columns) for n in list(seen)[:-1])
    words_in = sum(len(words(t)) for t in seen["near_dedup"]["text"])
    assert abs(sum(len(words(t)) for t in seen["mixture"]["text"]) / words_in - 1.5) < 0.2
    assert seen["packing"]["n_words"].sum() == sum(len(words(t)) for t in seen["mixture"]["text"])
    assert seen["packing"].groupby("bin_id")["n_words"].sum().max() <= 2048
