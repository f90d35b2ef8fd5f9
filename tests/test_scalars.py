"""Column functions on rows whose answers are known."""

import pytest
from pyspark.sql import functions as F

from codefacts.functions import paths, ranges, symbols
from codefacts.operators import commands


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [("abc", "abc"), ("a b", "`a b`"), ("a`b", "`a``b`"), ("", ""), ("$x_+-", "$x_+-"), ("é", "`é`")])
def test_escape(spark, name, want):
    assert one(spark, symbols.escape_name(F.lit(name))) == want


@pytest.mark.parametrize(("kind", "want"), [("namespace", "n/"), ("type", "n#"), ("term", "n."), ("meta", "n:"), ("method", "n(d)."), ("type_parameter", "[n]"), ("parameter", "(n)"), ("macro", "n!")])
def test_descriptor(spark, kind, want):
    assert one(spark, symbols.descriptor(F.lit("n"), F.lit(kind), F.lit("d"))) == want


def test_symbol(spark):
    assert one(spark, symbols.symbol(F.lit(None), F.lit("."), F.lit("a/"))) == "cxx . . .$ a/"
    assert one(spark, symbols.symbol(F.lit("my pkg"), F.lit("v1"), F.lit("a/"))) == "cxx . my  pkg v1$ a/"


@pytest.mark.parametrize(("text", "want"), [("cxx . . $ a/b#", "a/b#"), ("a$", None), ("a$b$ c", None), ("a$ ", ""), ("none", None), ("x$ y$ z", "y$ z"), ("x$ a\nb", "a\nb")])
def test_suffix(spark, text, want):
    assert one(spark, symbols.suffix(F.lit(text))) == want


@pytest.mark.parametrize(("docs", "loose", "strict"), [([], False, False), ([""], False, True), (["No documentation available."], False, False), (["x"], True, True), (["", "x"], False, True)])
def test_has_doc(spark, docs, loose, strict):
    column = F.array(*map(F.lit, docs)).cast("array<string>")
    assert one(spark, symbols.has_doc(column)) is loose
    assert one(spark, symbols.has_doc(column, strict=True)) is strict


@pytest.mark.parametrize(("path", "want"), [("/a/b/c", True), ("/a/./c", False), ("/a/../b", False), ("/a///b", False), ("/a/.b/c.", True)])
def test_is_normalized(spark, path, want):
    assert one(spark, paths.is_normalized(F.lit(path))) is want


def test_prefixes(spark):
    assert one(spark, paths.prefixes(F.lit("/a/b"))) == ["/a/b", "/a", "/"]


@pytest.mark.parametrize(("path", "root", "want"), [("/a/bc/x", "/a/b", None), ("/a/b/x", "/a/b", "x"), ("/a/b//x", "/a/b/", "x"), ("/a/b", "/a/b", ""), ("/q", "/a", None)])
def test_relative(spark, path, root, want):
    assert one(spark, paths.relative(F.lit(path), F.lit(root))) == want


@pytest.mark.parametrize(("path", "want"), [("/a/b", "b"), ("/a/", None), ("b", None)])
def test_file_name(spark, path, want):
    assert one(spark, paths.file_name(F.lit(path))) == want


def test_ranges_come_back(spark):
    for r in ((3, 4, 3, 9), (3, 4, 5, 1)):
        column = ranges.decode(ranges.encode(*map(F.lit, r)))
        assert tuple(one(spark, column)) == r
    assert one(spark, ranges.encode(*map(F.lit, (3, 4, 3, 9)))) == [2, 3, 8]


@pytest.mark.parametrize(("name", "want"), [("job-12-worker-3-docs", 12), ("job-x-worker", None), ("other", None)])
def test_shard_task(spark, name, want):
    assert one(spark, paths.shard_task(F.lit(name))) == want


CLEAN = [
    ("gcc", "gcc -mcpu=arm7tdmi -mthumb -mtune=arm7tdmi -march=armv4t tmp1.c", "gcc -mthumb tmp1.c"),
    ("gcc", "gcc -mfix-cortex-a53-843419 tmp2.c", "gcc tmp2.c"),
    ("gcc", "gcc -march x tmp.c", "gcc x tmp.c"),
    ("nvcc", "nvcc -Xcompiler -Xcompiler -G a.cu -gencode=x -t 4 -dc b.cu", "nvcc a.cu b.cu"),
    (None, "cc -march=x", "cc -march=x"),
]


@pytest.mark.parametrize(("kind", "before", "after"), CLEAN)
def test_clean_arguments(spark, kind, before, after):
    argv = F.array(*map(F.lit, before.split()))
    assert one(spark, F.array_join(commands.clean_arguments(argv, F.lit(kind).cast("string")), " ")) == after


@pytest.mark.parametrize(("pattern", "yes", "no"), [(".+\\.h.*", ["a.h", "a.hpp", "a.hxx"], ["a.c", "a.cpp", "a.cxx"]), ("foo.h", ["foo.h"], ["foo.hpp", "foo.hxx", "bar.h"]), ("(foo|bar).h", ["foo.h", "bar.h"], ["qux.h"]), ("", [], ["", "a"])])
def test_header_filter(spark, pattern, yes, no):
    for name in yes + no:
        assert one(spark, commands.matches_header_filter(F.lit(name), pattern)) is (name in yes)
