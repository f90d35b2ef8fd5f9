"""What a fact of the front end contributes to the index.

A fact (task_id, seq, node_kind, path, hash, range, symbol, flags, doc, related) becomes rows of one of five kinds: a
definition, a reference, a reference through a forward declaration, a relation or an external symbol. The rules are one
projection; the claim and project filters come before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.symbols import file_doc, file_symbol, is_doc, suffix
from codefacts.operators.tables import durable
from codefacts.schema import MAX_ENUM_CASES, MISSING_DOC

#: Nodes by rule. Local definitions carry no symbol record.
LOCAL_DEFINITIONS = ("binding", "template_parameter")
IGNORED = ("class_template", "function_template", "type_alias_template", "var_template")
DEFINITIONS = ("enum_constant", "field", "namespace", "typedef_name", "using", "using_shadow", "macro_definition", "file")
DEFINED_OR_FORWARD = ("enum", "record", "function")
REFERENCES = (
    "cuda_kernel_call", "constructor_call", "decl_ref", "member", "unresolved_lookup", "dependent_member", "nested_name", "initializer",
    "enum_type", "record_type", "template_specialization_type", "typedef_type", "using_type", "template_parameter_type", "macro_reference", "include", "constructor_initializer", "unresolved_member",
)


def contributes(kind: Column, is_definition: Column, canonical_is_definition: Column, is_local: Column, is_pure: Column) -> Column:
    """definition, local_definition, reference, forward, or null for nodes that contribute nothing by themselves."""
    reference = F.when(canonical_is_definition | is_local, "reference").otherwise("forward")
    return (
        F.when(kind.isin(*IGNORED), F.lit(None))
        .when(kind.isin(*LOCAL_DEFINITIONS), "local_definition")
        .when(kind.isin(*DEFINITIONS), "definition")
        .when(kind.isin(*DEFINED_OR_FORWARD), F.when(is_definition | is_pure, "definition").otherwise("forward"))
        .when((kind == "var") & is_local, F.when(is_definition, "local_definition").otherwise("reference"))
        .when(kind == "var", "definition")
        .when(kind.isin(*REFERENCES), reference)
    )


def usable(facts: DataFrame) -> DataFrame:
    """Facts with a symbol and a real place: no empty names, implicit calls, built-in macros, or files without an absolute path.

    As far as there are such columns, macros count only if they are defined (macro_state: undefined, ambiguous and builtin
    ones don't), and members only if their names are identifiers.
    """
    good = (F.col("symbol") != "") & F.col("path").startswith("/") & ~F.col("is_implicit") & ~F.col("is_builtin")
    if "macro_state" in facts.columns:
        good = good & ((F.col("node_kind") != "macro_reference") | (F.col("macro_state") == "defined"))
    if "is_identifier" in facts.columns:
        good = good & (~F.col("node_kind").isin("member", "dependent_member", "unresolved_member") | F.col("is_identifier"))
    return facts.where(F.coalesce(good, F.lit(False)))


def ignored(facts: DataFrame) -> Column:
    """Nodes that contribute nothing by what they are: structured bindings as a whole, and the location of a type that is its own definition."""
    out = F.lit(False)
    if "is_structured" in facts.columns:
        out = out | ((F.col("node_kind") == "var") & F.col("is_structured"))
    if "is_own_definition" in facts.columns:
        out = out | (F.col("node_kind").isin("enum_type", "record_type") & F.col("is_own_definition"))
    return F.coalesce(out, F.lit(False))


def related_references(facts: DataFrame) -> DataFrame:
    """References that a node makes at its own range besides its rule, one for each symbol in `related`: the targets of a
    using declaration, the template that a specialization specializes, the candidates of a dependent member."""
    pairs = F.col("node_kind").isin("using", "using_shadow", "enum", "record", "function", "dependent_member", "unresolved_member")
    each = facts.where(pairs).withColumn("symbol", F.explode("related"))
    return each.withColumn("rule", F.lit("reference")).where("symbol <> ''")


def macros_without_file(facts: DataFrame) -> DataFrame:
    """External symbols, without documentation, of defined macros that stand in no file (the command line or the compiler)."""
    own = facts.where((F.col("node_kind") == "macro_definition") & (F.coalesce("path", F.lit("")) == "") & (F.col("symbol") != ""))
    return own.select("task_id", "symbol", F.lit("").alias("doc")).distinct()


def file_definitions(files: DataFrame) -> DataFrame:
    """A definition for each real file of the project (path, stable_path, is_in_project, is_synthetic, and the range of its first
    token, null if it has none): at that token, or an empty range at the start."""
    own = files.where("is_in_project AND NOT is_synthetic")
    at = [F.coalesce(c, F.lit(0)).alias(c) for c in ("start_line", "start_char", "end_line", "end_char")]
    return own.select("path", "stable_path", file_symbol(F.lit(None), F.lit("."), F.col("stable_path")).alias("symbol"), file_doc(F.col("stable_path")).alias("doc"), *at)


def emit(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with their rule and where they go: document, external or dropped.

    files has path, stable_path and is_in_project. Definitions outside the project become external symbols without an
    occurrence, references outside it are dropped.
    """
    rule = contributes(F.col("node_kind"), F.col("is_definition"), F.col("canonical_is_definition"), F.col("is_local"), F.col("is_pure_virtual"))
    own = facts.where(~ignored(facts))
    out = own.join(files.select("path", "stable_path", "is_in_project"), "path", "left").withColumn("rule", rule).where("rule IS NOT NULL")
    outside = ~F.coalesce("is_in_project", F.lit(False))
    return out.withColumn("target", F.when(~outside, "document").when(F.col("rule") == "definition", "external").otherwise("dropped"))


def document_symbols(emitted: DataFrame) -> DataFrame:
    """Symbol records of documents: the first definition of a symbol in a file by seq, with the placeholder if undocumented."""
    own = emitted.where("rule = 'definition' AND target = 'document'")
    doc = F.when(is_doc(F.col("doc")), F.col("doc")).otherwise(MISSING_DOC)
    return own.groupBy("task_id", "stable_path", "symbol").agg(F.min_by(doc, F.struct("seq", doc)).alias("doc"))


def external_symbols(emitted: DataFrame) -> DataFrame:
    """External symbols of units: the first record by seq; a later text replaces only an empty one, not the placeholder."""
    own = emitted.where("rule = 'definition' AND target = 'external'")
    return own.groupBy("task_id", "symbol").agg(F.coalesce(F.min_by("doc", F.when(F.col("doc") != "", F.struct("seq", "doc"))), F.lit("")).alias("doc"))


def forward_declarations(emitted: DataFrame) -> DataFrame:
    """Per unit and suffix, the ranges of its forward references and the first documentation among them."""
    own = emitted.where("rule = 'forward' AND target = 'document'").withColumn("suffix", suffix(F.col("symbol")))
    doc = F.min_by("doc", F.when(is_doc(F.col("doc")), F.struct("seq", "doc")))
    place = F.struct("stable_path", "start_line", "start_char", "end_line", "end_char")
    return own.groupBy("task_id", "suffix").agg(F.coalesce(doc, F.lit("")).alias("doc"), F.sort_array(F.collect_list(place)).alias("references"))


def override_relations(facts: DataFrame, column: str = "related") -> DataFrame:
    """Direct overrides of methods, which an array column names: implementation and reference, one hop."""
    own = facts.where("node_kind = 'function'").select("symbol", F.explode(column).alias("target"))
    return own.select("symbol", "target", F.lit(True).alias("is_implementation"), F.lit(True).alias("is_reference"))


def nested_names(names: DataFrame) -> DataFrame:
    """A reference for each namespace or type in a qualified name (path, qualifiers of struct(kind, symbol))."""
    return names.select("path", F.posexplode("qualifiers").alias("at", "q")).where("q.kind IN ('namespace', 'type')").select("path", "at", "q.symbol")


def scope_symbols(descriptors: Column) -> Column:
    """The descriptors of each enclosing scope and of the node, outermost first; null inside scopes that name nothing."""
    upto = lambda i: F.slice(descriptors, 1, i)
    return F.transform(F.sequence(F.lit(1), F.size(descriptors)), lambda i: F.when(~F.exists(upto(i), F.isnull), F.array_join(upto(i), "")))


def enum_docs(cases: DataFrame, by: tuple[str, ...] = ("enum",)) -> DataFrame:
    """cases (enum, ordinal, begin, comment_begin, doc) without comments that stand before the previous case, for the first cases only."""
    last = F.lag("begin").over(Window.partitionBy(*by).orderBy("ordinal"))
    belongs = (F.col("ordinal") >= MAX_ENUM_CASES) | last.isNull() | (F.col("comment_begin") >= last)
    return cases.withColumn("doc", F.when(belongs, F.col("doc")).otherwise(F.lit("")))


def declaration_docs(declarations: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """declarations (symbol, seq, doc) with their own documentation, or that of the first other declaration that has one."""
    other = declarations.where(is_doc(F.col("doc"))).groupBy(*by).agg(F.min_by("doc", F.struct("seq", "doc")).alias("other"))
    doc = F.when(is_doc(F.col("doc")), F.col("doc")).otherwise(F.coalesce("other", F.lit("")))
    return declarations.join(durable(other), list(by), "left").withColumn("doc", doc).drop("other")
