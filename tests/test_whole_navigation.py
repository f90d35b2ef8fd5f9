"""Navigation queries over every row of small fixtures, against brute force on the rows themselves."""

import pytest

from codefacts import registry


def symbol(part: int) -> str:
    return f"cxx . pkg{part % 5} v1$ ns{part % 7}/T{part}#"


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes rows of tables and returns their folder."""

    def write(**rows):
        schemas = {
            "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string",
            "orders": "o_orderkey long",
            "documents": "doc_id long, text string",
        }
        for name, own in rows.items():
            spark.createDataFrame(own, schemas[name]).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_unused_counts_references_at_any_column(spark, tables):
    d = tables(lineitem=[(1, 10, 1, 1, 2.0, "A"), (1, 10, 1, 2, 30.0, "N"), (2, 11, 1, 1, 3.0, "A"), (3, 12, 1, 1, 40.0, "A"), (4, 13, 1, 1, 1.0, "N")])
    assert {r.symbol for r in registry.QUERIES["n07_unused"](spark, d).collect()} == {symbol(11), symbol(12)}


def test_definitions_of_any_symbol(spark, tables):
    d = tables(
        lineitem=[(105, 35, 1, 1, 50.0, "A"), (200, 20, 1, 5, 40.0, "N"), (340, 20, 1, 2, 9.0, "A"), (365, 20, 1, 1, 1.0, "A"), (31, 31, 1, 4, 30.0, "A"), (206, 22, 1, 5, 40.0, "N"), (200, 20, 1, 4, 40.0, "N"), (203, 31, 3, 5, 40.0, "N")],
        orders=[(105,), (200,), (31,), (9,)],
    )
    want = {("src/f5.cc", 0, 52, symbol(35), 1, "src/f5.cc", 0, 50), ("src/f1.cc", 3, 31, symbol(31), 1, "src/f1.cc", 3, 30)}
    want |= {("src/f10.cc", 4, 41, symbol(20), 1, "src/f17.cc", 1, 9), ("src/f10.cc", 4, 41, symbol(20), 1, "src/f18.cc", 0, 1)}
    want |= {("src/f10.cc", 4, 41, symbol(31), 2, "src/f1.cc", 3, 30)}  # a range over three lines, around the other
    assert {tuple(r) for r in registry.QUERIES["n01_definition"](spark, d).collect()} == want


def test_includes_of_any_header(spark, tables):
    d = tables(lineitem=[(1, 3, 1, 1, 2.0, "A"), (1, 4, 1, 2, 2.0, "A"), (2, 4, 2, 1, 2.0, "N"), (2, 4, 3, 2, 2.0, "N"), (2, 20, 1, 3, 2.0, "N")])
    got = {r.symbol: r.n for r in registry.QUERIES["n05_includes"](spark, d).collect()}
    assert got == {f"cxx . . .$ `<file>//proj/inc/h{part}.h`/": n for part, n in ((3, 1), (4, 2), (20, 1))}


@pytest.fixture
def seven_lines(tables):
    text = "\n".join(f"line {n}" for n in range(1, 9))
    return tables(lineitem=[(40, 9, 1, n, float(n), "A" if n == 7 else "N") for n in range(1, 8)] + [(59, 8, 1, 6, 1.0, "N")], documents=[(2, text), (98, "other")])


def test_snapshot_marks_every_line(spark, seven_lines):
    got = {r.line_no: r.snapshot for r in registry.QUERIES["k04_snapshot_lines"](spark, seven_lines).where("relative_path = 'src/d2.cc'").collect()}
    mark = lambda part, at, role: f"//{' ' * at}^^^^ {role} {symbol(part)}".replace("cxx . ", "")
    want = {n: [f"  line {n}", mark(9, n, "definition" if n == 7 else "reference")] for n in range(1, 8)} | {8: ["  line 8"]}
    want[6].insert(1, mark(8, 1, "reference"))
    assert got == {n: "\n".join(lines) for n, lines in want.items()}


def test_line_join_counts_every_line(spark, seven_lines):
    assert tuple(registry.QUERIES["j11_line_join"](spark, seven_lines).first()) == (8, 1)
