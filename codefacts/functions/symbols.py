"""Symbol text: escaping, descriptors, whole symbols, suffixes, and the names of nodes that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.schema import MISSING_DOC, SCHEME

SIMPLE_NAME = r"^[A-Za-z0-9+$_-]*$"
SUFFIX = r"(?s)^[^$]*\$( .*)$"
FAKE_PREFIX = f"{SCHEME} . . $ "


def escape_name(name: Column) -> Column:
    """A descriptor name: as it is if plain, else in backticks with inner ones doubled."""
    return F.when(name.rlike(SIMPLE_NAME), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def escape_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("  "))


def descriptor(name: Column, kind: Column, disambiguator: Column | None = None) -> Column:
    """One descriptor; kinds are namespace, type, term, meta, method, type_parameter, parameter and macro."""
    n, d = escape_name(name), F.coalesce(disambiguator if disambiguator is not None else F.lit(None), F.lit(""))
    ends = {"namespace": "/", "type": "#", "term": ".", "meta": ":", "macro": "!"}
    out = F.when(kind == "method", F.concat(n, F.lit("("), d, F.lit(").")))
    out = out.when(kind == "type_parameter", F.concat(F.lit("["), n, F.lit("]"))).when(kind == "parameter", F.concat(F.lit("("), n, F.lit(")")))
    for k, end in ends.items():
        out = out.when(kind == k, F.concat(n, F.lit(end)))
    return out


def symbol(package: Column, version: Column, descriptors: Column) -> Column:
    """A whole symbol from a package (null or empty: none), a version and joined descriptors."""
    name = F.when(F.coalesce(package, F.lit("")) == "", F.lit(". ")).otherwise(F.concat(escape_spaces(package), F.lit(" ")))
    return F.concat(F.lit(f"{SCHEME} . "), name, escape_spaces(F.coalesce(version, F.lit("."))), F.lit("$ "), descriptors)


def join_descriptors(descriptors: Column) -> Column:
    """The text of an array of structs (name, kind, disambiguator)."""
    return F.array_join(F.transform(descriptors, lambda d: descriptor(d["name"], d["kind"], d["disambiguator"])), "")


def suffix(of: Column) -> Column:
    """What follows the first "$" and its space, or null if that "$" has no space after it."""
    return F.when(of.rlike(SUFFIX), F.substr(F.regexp_extract(of, SUFFIX, 1), F.lit(2)))


def fake_symbol(of: Column) -> Column:
    """The symbol of a suffix whose package is unknown."""
    return F.concat(F.lit(FAKE_PREFIX), of)


def text_hash(text: Column) -> Column:
    """16 hex digits that depend on the text alone; the values are opaque, their stability is what counts."""
    return F.substring(F.md5(text), 1, 16)


def short_hash(text: Column) -> Column:
    """A text hash without leading zeros, as in method disambiguators."""
    return F.ltrim(text_hash(text), F.lit("0"))


def hash_chain(parts: Column) -> Column:
    """The hash of an ordered array: each part is mixed into the hash of those before it."""
    return F.aggregate(parts, F.lit("0"), lambda acc, x: F.md5(F.concat_ws("|", acc, x)))


def macro_name(path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", path, line, column)


def macro_symbol(path: Column, line: Column, column: Column) -> Column:
    return symbol(F.lit(None), F.lit("."), descriptor(macro_name(path, line, column), F.lit("macro")))


def file_symbol(package: Column, version: Column, path: Column) -> Column:
    return symbol(package, version, descriptor(F.concat(F.lit("<file>/"), path), F.lit("namespace")))


def anonymous_namespace(main_file: Column) -> Column:
    return F.concat(F.lit("$anonymous_namespace_"), main_file)


def anonymous_type(path: Column, counter: Column, at_top: Column, hashed: Callable[[Column], Column] = short_hash) -> Column:
    """The name of a type without one. hashed: short_hash stays in the JVM, hashing.exact_hash gives the values that other tools' names have."""
    return F.concat(F.lit("$anonymous_type_"), F.when(at_top, F.concat(hashed(path), F.lit("_"))).otherwise(F.lit("")), counter)


def local_symbol(counter: Column) -> Column:
    return F.concat(F.lit("local "), counter)


def enum_constant(enum: Column, name: Column, is_scoped: Column) -> Column:
    """The symbol of an enum's case: below the enum if that is scoped, else in the scope that encloses the enum."""
    outer = F.regexp_replace(enum, r"(`([^`]|``)*`|[A-Za-z0-9+$_-]+)#$", "")
    return F.concat(F.when(is_scoped, enum).otherwise(outer), escape_name(name), F.lit("."))


def clean_doc(comment: Column) -> Column:
    """A comment without outer ASCII white space and with invalid UTF-8 replaced; one of white space alone becomes an empty text."""
    return F.btrim(F.make_valid_utf8(comment), F.lit(" \t\n\x0b\x0c\r"))


def has_doc(documentation: Column, strict: bool = False) -> Column:
    """Whether a list documents: not empty and not the placeholder. An empty text documents only in strict mode."""
    first = F.get(documentation, 0)
    some = (F.size(documentation) > 0) & (first != MISSING_DOC)
    return F.coalesce(some if strict else some & (first != ""), F.lit(False))


def is_doc(doc: Column) -> Column:
    """has_doc for a single text."""
    return F.coalesce((doc != "") & (doc != MISSING_DOC), F.lit(False))


def namespace_doc(name: Column, inline: Column) -> Column:
    return F.when(name == "", F.lit("anonymous namespace")).otherwise(F.concat(F.when(inline, F.lit("inline ")).otherwise(F.lit("")), F.lit("namespace "), name))


def file_doc(path: Column) -> Column:
    return F.concat(F.lit("File: "), path)


def display(of: Column) -> Column:
    """A symbol as snapshots show it, with its repeating parts shortened."""
    for old, new in ((FAKE_PREFIX, "[..] "), (f"{SCHEME} . ", ""), ("todo-pkg todo-version", "[..]"), ("test-pkg test-version $", "[..] ")):
        of = F.replace(of, F.lit(old), F.lit(new))
    return of
