"""A corpus from raw documents in five stages, each of which reads what the one before it has written.

Defined results of all stages. An empty table gives an empty table. Rows are taken as they are: repeated rows stay repeated unless
a stage says otherwise. All stages but the last return the columns of documents and no others, whatever else a table holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codefacts.llm import line_dedup, mil_quality, minhash, mixing, packing
from codefacts.llm.common import cut, discard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (a score of 0.5 or more).

    A null or wordless text is scored like any other, as one empty passage. Rows with equal texts are accepted or rejected
    together. Without any label every score is 0.5, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mil_quality.score_quality(docs, labels).where("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows the text.

    Every row stays, with a null text as it is, and with an empty text if all its lines go. n_chars changes only where a line
    has gone, so a null n_chars stays null elsewhere.
    """
    return line_dedup.drop_repeated_lines(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(CASE WHEN n_dropped > 0 THEN char_length(text) ELSE n_chars END AS BIGINT) AS n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, and all rows of that id.

    Texts without words, null ones included, aren't duplicates of anything and stay. So do rows without doc_id: nothing can be
    told to be their copy.
    """
    return minhash.near_duplicates(docs).where("kept").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice.

    Texts without words, null ones included, count for no target and are not taken. A null source is a source of its own.
    Documents of equal rank are taken together or not at all.
    """
    return mixing.repeated(mixing.mix_sources(docs)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bin.

    A text without words has one piece without a bin. Copies of a text never share a bin. Equal sizes go in the order of doc_id.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("mixture", mixture), ("packing", packed)]

#: The classifier, the signatures and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        last, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if i:
            discard(last)
    return docs
