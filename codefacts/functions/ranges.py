"""Source ranges: 0-based lines and characters, three numbers on one line and four over several."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.schema import DEFINITION, READ_ACCESS, WRITE_ACCESS

RANGE = ("start_line", "start_char", "end_line", "end_char")


def encode(sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    """The stored form of a 1-based range."""
    return F.when(sl == el, F.array(sl - 1, sc - 1, ec - 1)).otherwise(F.array(sl - 1, sc - 1, el - 1, ec - 1))


def decode(r: Column) -> Column:
    """The 1-based range (start_line, start_char, end_line, end_char) of a stored one."""
    many = F.size(r) == 4
    line = F.when(many, F.get(r, 2)).otherwise(F.get(r, 0))
    end = F.when(many, F.get(r, 3)).otherwise(F.get(r, 2))
    return F.struct((F.get(r, 0) + 1).alias("start_line"), (F.get(r, 1) + 1).alias("start_char"), (line + 1).alias("end_line"), (end + 1).alias("end_char"))


def order() -> list[Column]:
    """Sort keys of a range: its start, one-line ranges first, then its end."""
    many = F.col("start_line") != F.col("end_line")
    return [F.col("start_line"), F.col("start_char"), many, F.when(many, F.col("end_line")).otherwise(F.col("end_char")), F.col("end_char")]


def by_length(text: Column) -> list[Column]:
    """Sort keys of the order of symbols: length in bytes, then bytes."""
    return [F.octet_length(text), text]


def occurrence_keys(columns: list[str]) -> list[Column]:
    """Sort keys of an occurrence: range, symbol, roles, then, as far as there are such columns, syntax kind, overriding
    documentation and diagnostics. Lists are compared by size first, texts in the order of symbols."""
    keys = [*order(), *by_length(F.col("symbol")), F.col("roles")]
    if "syntax_kind" in columns:
        keys.append(F.col("syntax_kind"))
    if "override_documentation" in columns:
        keys += [F.size("override_documentation"), F.transform("override_documentation", lambda d: F.struct(F.octet_length(d), d))]
    if "diagnostics" in columns:
        texts = lambda d: [x for name in ("code", "message", "source") for x in by_length(d[name])]
        keys += [F.size("diagnostics"), F.transform("diagnostics", lambda d: F.struct(d["severity"], *texts(d), F.size(d["tags"]), d["tags"]))]
    return keys


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(DEFINITION) != 0


def role_text(roles: Column) -> Column:
    write, read = roles.bitwiseAND(WRITE_ACCESS) != 0, roles.bitwiseAND(READ_ACCESS) != 0
    return F.when(is_definition(roles), F.lit("definition")).when(write & read, F.lit("reference (read+write)")).when(write, F.lit("reference (write)")).otherwise(F.lit("reference"))
