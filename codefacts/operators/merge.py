"""Merging what units emit: documents, symbols, external symbols, and forward declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.symbols import fake_symbol, is_doc, suffix
from codefacts.operators.tables import durable
from codefacts.schema import MISSING_DOC

#: The flags of a relationship in the order in which they are compared.
FLAGS = ["is_definition", "is_reference", "is_type_definition", "is_implementation"]
OCCURRENCE = ["relative_path", "symbol", "start_line", "start_char", "end_line", "end_char", "roles"]


def first_doc(doc: Column, order: Column) -> Column:
    """The first text that documents, in the given order; the placeholder if there is none. A partial aggregate."""
    return F.coalesce(F.min_by(doc, F.when(is_doc(doc), order)), F.lit(MISSING_DOC))


def merge_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences of all units, each once per document."""
    return occurrences.select(*OCCURRENCE).distinct()


def merge_symbols(symbols: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One record per key with its first documentation; order must be total up to equal docs."""
    return symbols.groupBy(*by).agg(first_doc(F.col("doc"), F.struct(*order)).alias("doc"), F.count("*").alias("n_seen"))


def merge_relationships(relations: DataFrame) -> DataFrame:
    """Relationships (symbol, target, four flags) as a set per symbol, ordered by their flags, then by target: shorter ones first."""
    one = F.struct(*FLAGS, F.octet_length("target").alias("n"), "target")
    return relations.select("symbol", "target", *FLAGS).distinct().groupBy("symbol").agg(F.sort_array(F.collect_list(one)).alias("relationships"))


def with_relationships(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """symbols with their relationships, an empty array where there are none."""
    own = symbols.join(merge_relationships(relations), "symbol", "left")
    kind = f"array<struct<{', '.join(f'{f}: boolean' for f in FLAGS)}, n: int, target: string>>"
    return own.withColumn("relationships", F.coalesce("relationships", F.array().cast(kind)))


def forward_groups(references: DataFrame) -> DataFrame:
    """Per unit and suffix, the ranges of its forward references in order, and the first documentation among them (else an empty text)."""
    place = F.struct("relative_path", "start_line", "start_char", "end_line", "end_char")
    doc = F.min_by("doc", F.when(is_doc(F.col("doc")), F.struct(place, "doc")))
    return references.groupBy("task_id", "suffix").agg(F.coalesce(doc, F.lit("")).alias("doc"), F.sort_array(F.collect_list(place)).alias("references"))


def external_names(external: DataFrame) -> DataFrame:
    """The set of external symbols of each suffix."""
    return external.groupBy("suffix").agg(F.sort_array(F.collect_set("symbol")).alias("names"))


def forward_by_document(documents: DataFrame, references: DataFrame) -> DataFrame:
    """Per document, the number of its forward references. Those of paths without a document are lost."""
    counts = references.groupBy("relative_path").agg(F.count("*").alias("n"))
    return documents.select("relative_path").distinct().join(counts, "relative_path", "left").select("relative_path", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def first_symbols(symbols: DataFrame) -> DataFrame:
    """The one in-document symbol of each suffix: singly indexed documents first, then by unit, path and symbol, as far as these are given."""
    known = [c for c in ("is_multi", "task_id", "relative_path") if c in symbols.columns]
    order = F.struct(*known, F.octet_length("symbol"), "symbol")
    return symbols.withColumn("suffix", suffix(F.col("symbol"))).where("suffix IS NOT NULL").groupBy("suffix").agg(F.min_by("symbol", order).alias("symbol"))


def resolve(suffixes: DataFrame, in_documents: DataFrame, external: DataFrame) -> DataFrame:
    """suffix, symbol and how it was found: the first in a document, else under every external name, else invented.

    External names are joined to suffixes without an in-document symbol only, so others don't fan out. Suffixes are read once.
    """
    keys = suffixes.select("suffix").distinct()
    d = first_symbols(in_documents).select("suffix", F.col("symbol").alias("d"))
    names = external.select(F.col("suffix").alias("_of"), F.col("symbol").alias("e")).distinct()
    found = keys.join(d, "suffix", "left").join(names, (F.col("suffix") == F.col("_of")) & F.col("d").isNull(), "left")
    how = F.when(F.col("d").isNotNull(), "document").when(F.col("e").isNull(), "invented").otherwise("external")
    return found.select("suffix", F.coalesce("d", "e", fake_symbol(F.col("suffix"))).alias("symbol"), how.alias("found"))


def forward_occurrences(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """References of forward declarations under their resolved symbols (one per external name), as plain references."""
    return references.join(resolved.select("suffix", "symbol"), "suffix").withColumn("roles", F.lit(0))


def append_forward(occurrences: DataFrame, forward: DataFrame, columns: list[str]) -> DataFrame:
    """Merged occurrences and, after that, all forward references: the latter aren't deduplicated against the former."""
    return occurrences.select(*columns).unionByName(forward.select(*columns))


def remaining_external(external: DataFrame, in_documents: DataFrame, suffixes: DataFrame) -> DataFrame:
    """External symbols but those whose suffix a forward declaration mentions and a document defines."""
    defined = in_documents.select("suffix").join(suffixes.select("suffix").distinct(), "suffix", "left_semi")
    return external.join(defined.distinct(), "suffix", "left_anti")


def mentions(references: DataFrame) -> DataFrame:
    """Each suffix that references have, with their first documentation of it (task_id, doc); nulls where there is none."""
    first = F.min(F.when(is_doc(F.col("doc")), F.struct("task_id", "doc")))
    return references.groupBy("suffix").agg(first.alias("first")).select("suffix", "first.task_id", "first.doc")


def offered_docs(resolved: DataFrame, references: DataFrame) -> DataFrame:
    """The first documentation (offer) that forward declarations have for each symbol. References are reduced to one a suffix first."""
    first = references.where(is_doc(F.col("doc"))).groupBy("suffix").agg(F.min(F.struct("task_id", "doc")).alias("first"))
    return resolved.select("suffix", "symbol").join(first, "suffix").groupBy("symbol").agg(F.min("first").alias("first")).select("symbol", F.col("first.doc").alias("offer"))


def external_records(external: DataFrame, in_documents: DataFrame, references: DataFrame, resolved: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """symbol, suffix, doc of the external symbols of an index: those that remain, with their documentation patched, and the invented ones.

    offers: offered_docs() as a written table, where there is one.
    """
    offers = durable(offered_docs(resolved, references)) if offers is None else offers
    left = patched_docs(remaining_external(external, in_documents, references).select("symbol", "suffix", "doc"), resolved, references, offers)
    new = resolved.where("found = 'invented'").join(offers, "symbol", "left")
    return left.select("symbol", "suffix", "doc").unionByName(new.select("symbol", "suffix", F.coalesce("offer", F.lit(MISSING_DOC)).alias("doc")))


def patched_docs(symbols: DataFrame, resolved: DataFrame, references: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """symbols (symbol, doc) where forward declarations document those that have no documentation themselves; offers as in external_records()."""
    offers = durable(offered_docs(resolved, references)) if offers is None else offers
    doc = F.when(is_doc(F.col("doc")), F.col("doc")).otherwise(F.coalesce("offer", "doc"))
    return symbols.join(offers, "symbol", "left").withColumn("doc", doc).drop("offer")


def dedup_macro_uses(uses: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Macro occurrences, one per file and range: the first by seq."""
    keys = [*by, "start_line", "start_char", "end_char"]
    columns = [c for c in uses.columns if c not in keys]
    kept = uses.groupBy(*keys).agg(F.min(F.struct("seq", *[c for c in columns if c != "seq"])).alias("k"))
    return kept.select(*keys, *[F.col(f"k.{c}").alias(c) for c in columns])


def top_overloads(candidates: DataFrame, most: int) -> DataFrame:
    """The first resolvable candidates (call, ord, symbol) of each call, `most` at most: the rule of a call, not a sample."""
    n = F.row_number().over(Window.partitionBy("call").orderBy("ord", "symbol"))
    return candidates.where("symbol IS NOT NULL").withColumn("n", n).where(F.col("n") <= most)
