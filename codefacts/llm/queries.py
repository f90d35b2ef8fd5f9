"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import alignment, fill_middle, lattice_lm, licenses, line_dedup, mil_quality, minhash, mixing, packing, pivot_index, quality_rules, suffix_index, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, uri = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "lost_chars")


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(_table(spark, sf_dir, "documents"))


def op8_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mil_quality.score_quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_index.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return alignment.add_link_counts(out.withColumn("groups_sha256", digest).drop("groups"), alignment.piece_count())


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_warc, op3_quality_rules, op4_pivot_index, op5_mixing, op6_minhash, op7_lattice_lm, op8_mil_quality, op9_suffix_index, op10_packing, op11_license_templates, op12_alignment, op13_fill_middle, pipeline)
}

_OP1 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND first <> page_id THEN first END AS refers_to
FROM f
"""

_OP5 = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(CAST(size AS DOUBLE) * size) AS squares FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM src),
ordered AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, 2.0::DOUBLE * source_size AS most,
         coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
  FROM weighed WINDOW o AS (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, most * rest <= w * (total - used) AS is_full FROM ordered),
aimed AS (
  SELECT source, source_size, squares,
         CASE WHEN is_full THEN most ELSE w * (total - coalesce(sum(most) FILTER (is_full) OVER (), 0)) / sum(w) FILTER (NOT is_full) OVER () END AS target
  FROM capped),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) * source_size AS budget
  FROM aimed),
scaled AS (SELECT *, CASE WHEN squares > 0 THEN budget / squares ELSE 0 END AS scale FROM budgets),
chances AS (
  SELECT d.doc_id, d.size, s.source, s.source_size, s.target, s.whole, s.budget, s.scale * d.size AS chance,
         (CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN scaled s ON d.source IS NOT DISTINCT FROM s.source),
ranks AS (SELECT *, CASE WHEN chance >= 1 THEN 0 ELSE (u / (1 - u)) / (chance / (1 - chance)) END AS q FROM chances WHERE size > 0 AND budget > 0),
steps AS (SELECT source, budget, q, sum(size) AS words FROM ranks GROUP BY source, budget, q),
runs AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM steps),
ends AS (SELECT source, max(q) AS q_end FROM runs WHERE upto + words / 2.0::DOUBLE <= budget GROUP BY source)
SELECT c.doc_id, c.size, c.source_size, c.target,
       CAST(c.size * (c.whole + CASE WHEN c.size > 0 AND c.budget > 0 AND
            (CASE WHEN c.chance >= 1 THEN 0 ELSE (c.u / (1 - c.u)) / (c.chance / (1 - c.chance)) END) <= e.q_end THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM chances c LEFT JOIN ends e ON c.source IS NOT DISTINCT FROM e.source
"""

_OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS draws FROM t),
c AS (
  SELECT *, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS i, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS j,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 90 THEN 'plain'
              WHEN draws[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, coalesce(array_to_string(units[1:i], ''), '') AS head, coalesce(array_to_string(units[i + 1:j], ''), '') AS mid,
         coalesce(array_to_string(units[j + 1:], ''), '') AS tail
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                        ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _OP1, "op2_warc": _OP2, "op5_mixing": _OP5, "op11_license_templates": licenses.template_sql(), "op13_fill_middle": _OP13}
