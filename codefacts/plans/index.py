"""From merged relations to an index, and from facts to relations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions.paths import root_uri
from codefacts.functions.symbols import file_symbol, suffix
from codefacts.operators import facts, graph, merge, places, planning, render
from codefacts.operators.tables import durable

PLACED = ["relative_path", "symbol", "start_line", "start_char", "roles"]
PARTS = ("metadata", "documents", "external_symbols")


def merged_occurrences(occurrences: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """All occurrences of an index: those of documents once, then every forward reference under its resolved symbol."""
    resolved = durable(merge.resolve(references, symbols.where("in_doc"), symbols.where("is_ext")))
    return merge.append_forward(occurrences.select(*PLACED).distinct(), merge.forward_occurrences(references, resolved), PLACED)


def document_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("relative_path").agg(F.count("*").alias("n_occ"), F.count_distinct("symbol").alias("n_sym"), F.sum("roles").cast("long").alias("n_def"))


FLAT = ("occurrences", "symbols", "external_symbols")


def merged_parts(occurrences: DataFrame, symbols: DataFrame, external: DataFrame, relations: DataFrame, references: DataFrame, names: tuple[str, ...] = FLAT) -> dict[str, DataFrame]:
    """What merged_index() nests, as flat rows: occurrences, symbols of documents, and external symbols; those of names only.

    placed: occurrences with is_forward, those of units as often as they are reported, for writers that merge them themselves.
    What forward declarations document is written once for all parts that need it, after references are reduced to one a suffix. Occurrences don't.
    """
    documented = bool({"symbols", "external_symbols"} & set(names))
    mentions = durable(merge.mentions(references)) if documented else references
    resolved = durable(merge.resolve(mentions, symbols, external))
    out, flag = {}, "is_forward"
    if "occurrences" in names:
        out["occurrences"] = merge.append_forward(merge.merge_occurrences(occurrences), merge.forward_occurrences(references, resolved), merge.OCCURRENCE)
    if "placed" in names:
        out["placed"] = merge.append_forward(occurrences.withColumn(flag, F.lit(False)), merge.forward_occurrences(references, resolved).withColumn(flag, F.lit(True)), [*merge.OCCURRENCE, flag])
    if not documented:
        return out
    offers = durable(merge.offered_docs(resolved, mentions))
    if "symbols" in names:
        own = merge.merge_symbols(symbols, ["relative_path", "symbol"], ["is_multi", "task_id", "doc"])
        out["symbols"] = merge.with_relationships(merge.patched_docs(own.drop("n_seen"), resolved, mentions, offers), relations)
    if "external_symbols" in names:
        out["external_symbols"] = merge.with_relationships(merge.external_records(external, symbols, mentions, resolved, offers), relations).drop("suffix")
    return out


def _about(spark: SparkSession, project_root: str) -> DataFrame:
    return spark.range(1).select(F.lit("0.4").alias("version"), F.lit("codefacts").alias("tool"), root_uri(F.lit(project_root)).alias("project_root"), F.lit("UTF8").alias("text_encoding"))


def flat_index(occurrences: DataFrame, symbols: DataFrame, external: DataFrame, relations: DataFrame, references: DataFrame, project_root: str) -> dict[str, DataFrame]:
    """The whole index as merged_index() has it, but with flat rows (placed, symbols) in place of nested documents."""
    parts = merged_parts(occurrences, symbols, external, relations, references, ("placed", "symbols", "external_symbols"))
    return {"metadata": _about(occurrences.sparkSession, project_root), **parts}


def merged_index(occurrences: DataFrame, symbols: DataFrame, external: DataFrame, relations: DataFrame, references: DataFrame, project_root: str) -> dict[str, DataFrame]:
    """The whole index of a project from what its units have written: metadata, nested documents and external symbols.

    occurrences: merge.OCCURRENCE columns; symbols: relative_path, symbol, suffix, doc, task_id, is_multi; external: symbol,
    suffix, doc; relations: symbol, target and four flags; references (through forward declarations): task_id, suffix, doc,
    and a range in relative_path.
    """
    parts = merged_parts(occurrences, symbols, external, relations, references)
    return {"metadata": _about(occurrences.sparkSession, project_root), "documents": render.nested_documents(parts["occurrences"], parts["symbols"]), "external_symbols": parts["external_symbols"]}


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """Write the parts of an index: metadata first, then documents, then external symbols in their order."""
    for name in PARTS:
        rows = index[name].sort(F.octet_length("symbol"), "symbol") if name == "external_symbols" else index[name]
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}


_RANGE = ["start_line", "start_char", "end_line", "end_char"]


def prepared_facts(all_facts: DataFrame, seen: DataFrame, directives: DataFrame | None = None) -> DataFrame:
    """The facts that units emit: placed, usable, of claimed files, with the documentation that belongs to them.

    As far as there are such columns: spelling_start_line and so on, the place of a macro's token; enum, ordinal, begin and comment_begin of the
    cases of enums. directives (path, line, says) move places to the lines that they presume.
    """
    own = places.located(all_facts) if "spelling_start_line" in all_facts.columns else all_facts
    own = planning.claimed(facts.usable(own), durable(planning.claims(seen)))
    own = own if directives is None else places.presumed(own, directives)
    if {"enum", "ordinal", "begin", "comment_begin"} <= set(own.columns):
        cases = F.col("node_kind") == "enum_constant"
        own = own.where(~cases).unionByName(facts.enum_docs(own.where(cases), ("task_id", "path", "enum")))
    return durable(facts.declaration_docs(own, ("task_id", "symbol")))


def _file_rows(files: DataFrame, seen: DataFrame, includes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(definitions of the files that units claim, with task_id; references to included files that are known)."""
    claims = planning.claims(seen)
    defined = facts.file_definitions(files).join(claims.groupBy("path").agg(F.min("task_id").alias("task_id")), "path")
    if includes is None:
        return defined, defined.where("false")
    target = files.select(F.col("path").alias("target"), file_symbol(F.lit(None), F.lit("."), F.col("stable_path")).alias("symbol"))
    project = files.where("is_in_project").select("path", "stable_path")
    own = planning.claimed(includes, claims).join(project, "path").join(target, "target")
    return defined, own.select("stable_path", "symbol", *_RANGE)


def _occurrences(rows: DataFrame, is_definition: Column) -> DataFrame:
    return rows.select(F.col("stable_path").alias("relative_path"), "symbol", *[F.col(c).cast("int").alias(c) for c in _RANGE], F.when(is_definition, 1).otherwise(0).alias("roles"))


def unit_outputs(all_facts: DataFrame, files: DataFrame, seen: DataFrame, includes: DataFrame | None = None, bases: DataFrame | None = None, directives: DataFrame | None = None) -> dict[str, DataFrame]:
    """What units emit, as merged_index() takes it: occurrences, symbols, external, relations and references.

    files: path, stable_path, is_in_project, is_synthetic, and the range of the first token (null if there is none); seen: task_id, path, hash;
    includes: task_id, path, hash, target (a path) and a range; bases: derived, base (symbols). The rules, in their order: macros
    that stand in no file become external symbols; usable facts of claimed files are ruled and sent to documents or to external symbols; macros
    count once a place; a node's related symbols are references at its place; files are defined at their first token, and
    included files referred to; overrides and the closure of bases are relations.
    """
    own = prepared_facts(all_facts, seen, directives)
    ruled = facts.emit(own, files.select("path", "stable_path", "is_in_project"))
    macro = F.col("node_kind").isin(*places.SPELT)
    ruled = durable(ruled.where(~macro).unionByName(merge.dedup_macro_uses(ruled.where(macro), ("task_id", "path"))))
    inside = files.where("is_in_project").select("path", "stable_path")
    related = facts.related_references(own).join(inside, "path") if "related" in own.columns else ruled.where("false")
    defined_files, included = _file_rows(files, seen, includes)
    placed = ruled.where("target = 'document' AND rule IN ('definition', 'local_definition', 'reference')")
    occurrences = [_occurrences(placed, F.col("rule") != "reference"), _occurrences(related, F.lit(False)), _occurrences(defined_files, F.lit(True)), _occurrences(included, F.lit(False))]

    multiple = planning.path_stats(seen).join(files.select("path", "stable_path"), "path").groupBy("stable_path").agg(F.max("is_multi").alias("is_multi"))
    records = facts.document_symbols(ruled).unionByName(defined_files.select("task_id", "stable_path", "symbol", "doc"))
    records = records.join(multiple, "stable_path", "left").select("task_id", F.col("stable_path").alias("relative_path"), "symbol", suffix(F.col("symbol")).alias("suffix"), "doc", F.coalesce("is_multi", F.lit(False)).alias("is_multi"))
    external = facts.external_symbols(ruled).unionByName(facts.macros_without_file(all_facts))
    external = merge.merge_symbols(external, ["symbol"], ["task_id", "doc"]).select("symbol", suffix(F.col("symbol")).alias("suffix"), "doc")
    forward = facts.forward_declarations(ruled).where("suffix IS NOT NULL").select("task_id", "suffix", "doc", F.explode("references").alias("r"))
    references = forward.select("task_id", "suffix", "doc", F.col("r.stable_path").alias("relative_path"), *[F.col(f"r.{c}").cast("int").alias(c) for c in _RANGE])

    none = own.sparkSession.createDataFrame([], "symbol string, target string, is_implementation boolean, is_reference boolean")
    overrides = facts.override_relations(own, "overrides") if "overrides" in own.columns else none
    above = graph.closure(bases).select(F.col("derived").alias("symbol"), F.col("base").alias("target"), F.lit(True).alias("is_implementation"), F.lit(False).alias("is_reference")) if bases is not None else none
    relations = overrides.unionByName(above).withColumns({"is_definition": F.lit(False), "is_type_definition": F.lit(False)}).distinct()
    return {"occurrences": functools.reduce(DataFrame.unionByName, occurrences), "symbols": durable(records), "external": durable(external), "relations": relations, "references": durable(references)}


def index_from_facts(all_facts: DataFrame, files: DataFrame, seen: DataFrame, project_root: str, **more: DataFrame | None) -> dict[str, DataFrame]:
    """The whole index of a project from the facts of its units, in one plan: unit_outputs(), then merged_index()."""
    out = unit_outputs(all_facts, files, seen, **more)
    return merged_index(out["occurrences"], out["symbols"], out["external"], out["relations"], out["references"], project_root)
