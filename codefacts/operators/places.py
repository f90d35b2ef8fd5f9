"""Places in files: which of a fact's ranges counts, what `#line` directives make of it, and which ranges hold a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.operators.tables import durable

#: Facts whose place is where their token is spelt; all others are placed where a macro is expanded.
SPELT = ("macro_definition", "macro_reference")
ENDS = ("start", "end")
PLACE = [f"{end}_{part}" for end in ENDS for part in ("line", "char")]
#: Lines of a block of a file: at most so many directives are looked through for one place.
BLOCK_LINES = 1024
#: Line numbers are below 2 ** LEVELS.
LEVELS = 31


def located(facts: DataFrame) -> DataFrame:
    """facts with one range: that of the spelling (spelling_start_line and so on) for macros, that of the expansion for all other nodes.

    A fact without a spelling range (nulls) stands where it is expanded.
    """
    spelt = F.col("node_kind").isin(*SPELT) & F.col("spelling_start_line").isNotNull()
    picked = {c: F.when(spelt, F.col(f"spelling_{c}")).otherwise(F.col(c)) for c in PLACE}
    return facts.withColumns(picked).drop(*[f"spelling_{c}" for c in PLACE])


def _blocks(directives: DataFrame, last_lines: DataFrame, block: int) -> DataFrame:
    """(path, block, of): the directives that hold in a block of a file's lines, in order: the last one before it and those in it."""
    own = directives.where("path IS NOT NULL AND line IS NOT NULL AND says IS NOT NULL").groupBy("path", "line").agg(F.max("says").alias("says"))
    until = F.coalesce(F.lead("line").over(Window.partitionBy("path").orderBy("line")), F.greatest("last_line", "line"))
    reach = own.join(last_lines, "path").select("path", "line", "says", until.alias("until"))
    blocks = F.sequence(F.floor(F.col("line") / block), F.floor(F.col("until") / block))
    each = reach.select("path", "line", "says", F.explode(blocks).alias("block"))
    return each.groupBy("path", "block").agg(F.sort_array(F.collect_list(F.struct("line", "says"))).alias("of"))


def _last_before(directives: Column, line: Column) -> Column:
    return F.try_element_at(F.filter(directives, lambda d: d["line"] < line), F.lit(-1))


def presumed(ranges: DataFrame, directives: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """ranges (path and PLACE columns, lines from 1) with the lines that `#line` directives (path, line, says) give them.

    A directive on line d that says n makes the line after it line n, and so on up to the next directive. Lines up to the first
    directive stay. Each end of a range is looked up by itself. Two directives on one line: the larger number counts.

    Directives are laid out once over the blocks of lines that they hold in; a place then meets one row, by equality of path and block, and
    picks the last directive before it from a list of bounded length. The laid-out rows are written, so AQE can split the
    places of a header that all units include.
    """
    lines = F.greatest(*[F.col(f"{end}_line") for end in ENDS])
    with_directives = directives.select("path").distinct()
    last_lines = ranges.join(with_directives, "path", "left_semi").groupBy("path").agg(F.max(lines).alias("last_line"))
    laid = durable(_blocks(directives, last_lines, block))
    out = ranges
    for end in ENDS:
        line = F.col(f"{end}_line")
        before = _last_before(F.col("_of"), line)
        shifted = F.when(before.isNull(), line).otherwise(before["says"] + line - before["line"] - 1)
        keyed = out.withColumn("_block", F.floor(line / block))
        held = laid.select(F.col("path").alias("_path"), F.col("block").alias("_held"), F.col("of").alias("_of"))
        joined = keyed.join(held, (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_held")), "left")
        out = joined.withColumn(f"{end}_line", shifted.cast(dict(ranges.dtypes)[f"{end}_line"])).drop("_block", "_path", "_held", "_of")
    return out


def line_intervals(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """The fewest intervals (level, at) of 2 ** level lines from at * 2 ** level on that together are the lines first to last.

    levels: above all levels that occur, so that no others are looked at.
    """

    def at_level(k: Column) -> Column:
        low, high = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1), k) - 1, k), F.call_function("shiftright", last + 1, k)
        odd = low.bitwiseAND(F.lit(1))
        left = F.when((odd == 1) & (low < high), F.struct(k.alias("level"), low.alias("at")))
        right = F.when((high.bitwiseAND(F.lit(1)) == 1) & (low + odd < high), F.struct(k.alias("level"), (high - 1).alias("at")))
        return F.array(left, right)

    several = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at_level)))
    return F.when(first == last, F.array(F.struct(F.lit(0).alias("level"), first.alias("at")))).otherwise(several)


def holding(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """places (relative_path, line, char) with every range that holds them and `depth`, 1 for the innermost.

    A range holds the characters from its start up to, and without, its end, over any number of lines. Ranges are cut into intervals of lines
    whose lengths are powers of two, at most two of a length; a place lies in one interval of each length. So both sides meet by
    equality of path, length and number, and only the two ends have to be compared. Only lengths that occur are looked for.
    Innermost first: the latest start, then the earliest end; ranges that are the same have the same depth.
    """
    own = ranges.where("end_line >= start_line").distinct()
    lines = [F.col(c).cast("long") for c in ("start_line", "end_line")]
    # Levels are those of the different pairs of lines, which are few; the other columns of the ranges aren't read for them.
    levels = own.select("start_line", "end_line").distinct().select(F.explode(line_intervals(*lines)).alias("_in")).select("_in.level").distinct()
    known = sorted(r.level for r in levels.collect())  # LEVELS numbers at most
    cut = own.withColumn("_in", F.explode(line_intervals(*lines, max(known, default=0) + 1))).withColumns({"_level": F.col("_in.level"), "_at": F.col("_in.at")}).drop("_in")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col("line").cast("long"), k).alias("at")) for k in known])) if known else None
    asked = places.select("relative_path", "line", "char").distinct()
    asked = asked.withColumn("_in", each) if known else asked.withColumn("_in", F.lit(None).cast("struct<level: int, at: bigint>")).where(F.lit(False))
    asked = asked.select(F.col("relative_path").alias("_path"), "line", "char", F.col("_in.level").alias("_of"), F.col("_in.at").alias("_nr"))
    after_start = (F.col("start_line") < F.col("line")) | ((F.col("start_line") == F.col("line")) & (F.col("start_char") <= F.col("char")))
    before_end = (F.col("line") < F.col("end_line")) | ((F.col("line") == F.col("end_line")) & (F.col("char") < F.col("end_char")))
    on = (F.col("_path") == F.col("relative_path")) & (F.col("_of") == F.col("_level")) & (F.col("_nr") == F.col("_at")) & after_start & before_end
    found = asked.join(cut, on).drop("_path", "_of", "_nr", "_level", "_at")  # different as they are: both sides are, and one interval of a range holds a place
    inner_first = Window.partitionBy("relative_path", "line", "char").orderBy(F.desc("start_line"), F.desc("start_char"), "end_line", "end_char")
    return found.withColumn("depth", F.dense_rank().over(inner_first))
