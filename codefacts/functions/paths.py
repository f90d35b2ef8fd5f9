"""Path algebra on columns; paths have forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"), b)


def relative(path: Column, root: Column) -> Column:
    """The path below a root, or null: component by component, so /a/b isn't above /a/bc."""
    base = F.regexp_replace(root, "/+$", "")
    below = F.regexp_replace(F.substr(path, F.length(base) + 1), "^/+", "")
    return F.when(path == base, F.lit("")).when(F.startswith(path, F.concat(base, F.lit("/"))), below)


def file_name(path: Column) -> Column:
    """The text after the last slash; null without a slash or after a closing one."""
    return F.when(path.contains("/") & ~path.endswith("/"), F.substring_index(path, "/", -1))


def is_normalized(path: Column) -> Column:
    return ~path.rlike("//|(^|/)[.][.]?(/|$)")


def normalize(path: Column) -> Column:
    """The path without its "." components."""
    return F.array_join(F.array_remove(F.split(path, "/"), "."), "/")


def extension(path: Column) -> Column:
    """From the last dot of the name on; empty without one."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def replace_extension(path: Column, new: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"([^/])\.[^./]*$", "$1"), new)


def prefixes(path: Column) -> Column:
    """All ancestors of an absolute path and itself, longest first, down to the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def external_path(path: Column) -> Column:
    """The stand-in for a file outside all roots."""
    return F.concat(F.lit("<external>/"), F.conv(F.substring(F.md5(path), 1, 15), 16, 10), F.lit("/"), file_name(path))


def root_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def shard_task(name: Column) -> Column:
    """The task of a shard file name job-<task>-worker-…, or null."""
    found = F.regexp_extract(name, r"^job-(\d+)-worker", 1)
    return F.when(found != "", F.try_to_number(found, F.lit("9" * 18)).cast("long"))
