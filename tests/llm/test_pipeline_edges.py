"""The stages of the pipeline on nulls, ties, repeats, empty tables and columns with clashing names; hot keys; quality rules by hand."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codefacts.llm import line_dedup, quality_rules, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("n_lines", "SIZE", "kept", "component_id", "taken", "text_key", "score")
PROSE = "the quick brown fox jumps over a lazy dog near the old river bank while seven small birds sing in tall trees"


def rows():
    texts = [None, "", " \n ", f"{PROSE}\nshared line", f"{PROSE}\nshared line", f"{PROSE} indeed\nshared line", *(f"text number {i} {i * 7} {i * 11} more words here\nShared Line " for i in range(12)), "only"]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[6], out[6], (None, "no id at all here\nshared line", None, None, None)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit(7).alias(c) for c in EXTRA]).cache()


def test_quality_keeps_all_without_labels(spark, docs, sf):
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS) and Counter(map(tuple, got.collect())) == Counter(rows())


def test_line_dedup_stage(spark, docs, sf):
    got = corpus_pipeline.line_dedup_stage(spark, docs, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip().lower() != "shared line"), lang, source, n) for i, t, lang, source, n in rows()]
    want = [(*w[:4], len(w[1]) if w[1] != r[1] else r[4]) for w, r in zip(want, rows(), strict=True)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_near_dedup_stage(spark, docs, sf):
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    ids = Counter(r.doc_id for r in got.collect())
    assert ids == {**{i: 1 for i in range(len(rows()) - 3) if i not in (4, 5)}, 6: 3, None: 1}


def test_mixture_stage(spark, docs, sf):
    got = corpus_pipeline.mixture(spark, docs, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    taken = Counter(map(tuple, got.collect()))
    have = Counter(rows())
    assert all(n <= 2 * have[r] and r[1] and r[1].split() for r, n in taken.items()) and sum(taken.values()) > len(rows()) - 3


def test_packing_stage(spark, docs, sf):
    got = corpus_pipeline.packed(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in got if r.bin_id is None) == {0: 1, 1: 1, 2: 1} and len(got) == len(rows())
    bins = {r.doc_id: r.bin_id for r in got}
    assert bins[3] != bins[4] and len({r.bin_id for r in got if r.doc_id == 6}) == 3


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_empty_tables(spark, docs, sf, name, stage):
    assert stage(spark, docs.where("false"), sf).count() == 0


@pytest.fixture
def skewed(spark):
    """A session that splits skewed partitions of any size and broadcasts nothing."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_of_every_document_is_split(skewed):
    docs = skewed.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot line\nown "), "id").alias("text"))
    assert "skew=true" in plan_of(line_dedup.drop_repeated_lines(docs))


def test_a_payload_of_every_page_is_split(skewed):
    pages = skewed.range(0, 6000, 1, 8).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 8 > 0, F.repeat(F.lit("x"), 1200)).otherwise(F.concat(F.repeat(F.lit("y"), 1200), F.col("id") % 100)).alias("html"))
    assert "skew=true" in plan_of(warc.plan_records(pages).select("page_id", "refers_to"))


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def fails(line):
    """The rules of a line as they are told, one after the other."""
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    marks = [w for w in words if w in quality_rules.SEPARATORS]
    if marks and len(marks) / len(words) >= 0.2:
        return True
    if len(words) <= 4 and {w.strip(".,:").lower() for w in words} <= quality_rules.MENU:
        return True
    if [p for p in quality_rules.BOILERPLATE if p in line.lower()]:
        return True
    if len([w for w in words if any(w.endswith(x) for x in quality_rules.ODD_ENDS)]) / len(words) >= 1 / 3:
        return True
    if len(words) < 4 and line.split()[-1][-1] not in quality_rules.ENDS and not words[-1].isalnum():
        return True
    return len(words) >= 6 and line.isupper() or len(words) >= 12 and len(set(words)) / len(words) <= 0.2


def test_quality_rules_by_hand(spark, sf_dir):
    """The base measures and the verdict of every document against plain Python."""
    own = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own |= {-1: "Startseite Kontakt\n" + "Guten Tag, das ist ein ganzer Satz mit Worten darin. " * 12, -2: "tous droits réservés " * 20, -3: None, -4: ("word " * 30 + "\n") * 3}
    table = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    for r in quality_rules.judge_documents(table).collect():
        text = own[r.doc_id]
        n, chars, symbols, dups, repeats = base_of(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        seen, whole, lost = set(), 0, 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                whole += len(line)
                lost += len(line) * (line in seen or bool(fails(line)))
                seen.add(line)
        assert (r.line_chars, r.lost_chars, r.kept) == (whole, lost, not r.base_failed and lost <= whole / 2)
