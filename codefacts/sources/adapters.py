"""The benchmark tables as relations of the engine, as DataFrames and as the SQL that the checks run.

RELATIONS maps a relation's name to its SQL over the tables; each has a function of the same name here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.schema import MISSING_DOC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(key: str):
    k = F.col(key)
    return F.concat(F.lit("cxx . pkg"), k % 5, F.lit(" v1$ ns"), k % 7, F.lit("/T"), k, F.lit("#"))


def _suffix(key: str):
    k = F.col(key)
    return F.concat(F.lit("ns"), k % 7, F.lit("/T"), k, F.lit("#"))


_SQL_SYMBOL = "concat('cxx . pkg', {0} % 5, ' v1$ ns', {0} % 7, '/T', {0}, '#')"
_SQL_SUFFIX = "concat('ns', {0} % 7, '/T', {0}, '#')"


def _file(key: str = "l_orderkey"):
    """The file of an order: twenty orders each, so that files grow in number and not in size."""
    return F.expr(f"concat('src/f', {key} DIV 20, '.cc')")


def occ_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences: a line item is one, in a file by its order; some end two lines further down."""
    t = table(spark, sf_dir, "lineitem")
    line, char = F.col("l_linenumber") - 1, F.col("l_quantity").cast("int")
    end = F.when(F.col("l_suppkey") % 7 == 3, line + 2).otherwise(line)
    return t.select(
        F.col("l_suppkey").alias("task_id"), _file().alias("relative_path"), _symbol("l_partkey").alias("symbol"),
        line.alias("start_line"), char.alias("start_char"), end.alias("end_line"), (char + 4).alias("end_char"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("roles"),
    )


def sym_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol records of parts: some documented, some in documents (under two packages at times), some external, some external in a second package."""
    t = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    doc = F.when(F.col("p_size") % 3 == 0, MISSING_DOC).otherwise(F.col("p_name"))
    path = F.expr("concat('src/p', p_partkey DIV 20, '.h')").alias("relative_path")
    kinds = lambda in_doc, is_ext, is_multi: (in_doc.alias("in_doc"), is_ext.alias("is_ext"), is_multi.alias("is_multi"))
    even, no, yes = F.col("p_size") % 2 == 0, F.lit(False), F.lit(True)
    under = lambda package: F.concat(F.lit(f"cxx . {package}$ ns"), k % 7, F.lit("/T"), k, F.lit("#")).alias("symbol")
    suffix, none = _suffix("p_partkey").alias("suffix"), F.lit(MISSING_DOC).alias("doc")
    own = t.select(k.alias("task_id"), path, _symbol("p_partkey").alias("symbol"), suffix, doc.alias("doc"), *kinds(k % 3 == 0, (k % 3 == 1) | (k % 9 == 0), even))
    twin = t.where(k % 15 == 0).select((k + 1).alias("task_id"), path, under("twin v3"), suffix, none, *kinds(yes, no, ~even))
    more = t.where(k % 12 == 1).select(k.alias("task_id"), path, under("alt v2"), suffix, none, *kinds(no, yes, even))
    return own.unionByName(twin).unionByName(more)


def rel_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of parts: one to half a part's number, and a second one for some."""
    t, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    flags = lambda d, r, y, i: (d.alias("is_definition"), r.alias("is_reference"), y.alias("is_type_definition"), i.alias("is_implementation"))
    to = lambda n: t.withColumn("other", F.expr(f"p_partkey DIV {n}"))
    first = to(2).select(_symbol("p_partkey").alias("symbol"), _symbol("other").alias("target"), *flags(k % 11 == 0, k % 2 == 0, F.lit(False), F.lit(True)))
    second = to(3).where("p_size % 4 = 0").select(_symbol("p_partkey").alias("symbol"), _symbol("other").alias("target"), *flags(F.lit(False), F.lit(True), k % 3 == 0, F.lit(False)))
    return first.unionByName(second)


def fwd_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References through forward declarations."""
    t = table(spark, sf_dir, "lineitem")
    line, char = F.col("l_linenumber") - 1, F.col("l_quantity").cast("int")
    return t.select(
        F.col("l_orderkey").alias("task_id"), _suffix("l_partkey").alias("suffix"), F.concat(F.lit("fwd "), "l_partkey", F.lit(" "), "l_suppkey").alias("doc"),
        _file().alias("relative_path"), line.alias("start_line"), char.alias("start_char"), line.alias("end_line"), (char + 4).alias("end_char"),
    )


def sym_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol records as single units report them, in the order (task_id, ord, line)."""
    t = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    doc = F.when(n % 3 == 0, F.lit(MISSING_DOC)).when(n % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("doc "), "l_orderkey", F.lit(" "), n))
    return t.select(
        F.col("l_suppkey").alias("task_id"), F.col("l_orderkey").alias("ord"), n.alias("line"), _file().alias("relative_path"),
        _symbol("l_partkey").alias("symbol"), doc.alias("doc"),
    )


def tu_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that units saw, with content hashes: one, two or three hashes a path."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("/proj/inc/h"), "l_partkey", F.lit(".h")).alias("path"), (F.col("l_suppkey") % (1 + F.col("l_partkey") % 3)).alias("hash")).distinct()


def base_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct base classes."""
    return table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("derived"), F.floor(F.col("p_partkey") / 2).cast("long").alias("base"))


def job_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of workers: start, finish, kill and others. Fifteen workers share a hundred tasks."""
    t = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    event = F.when(kind == "click", "start").when(kind == "view", "finish").when(kind == "error", "kill").otherwise("other")
    return t.select("ts", F.col("user_id").alias("worker_id"), F.col("event_id").alias("seq"), (F.expr("user_id DIV 15") * 100 + F.col("event_id") % 100).alias("task_id"), (F.col("event_id") % 2).alias("subtask"), event.alias("event"))


def compdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build commands: one per document, in a directory by its source."""
    d = F.col("doc_id")
    ext = F.get(F.array(*map(F.lit, (".c", ".cc", ".h", ".cu", ".CPP", ".S"))), (d % 6).cast("int"))
    file = F.concat(F.lit("f"), d, ext)
    argv = F.array(
        F.when(d % 3 == 0, "clang++").when(d % 3 == 1, "gcc").otherwise("nvcc"), F.concat(F.lit("-march=m"), d % 4), F.lit("-o"), F.lit("-o"), F.concat(F.lit("out"), d, F.lit(".o")),
        F.when(d % 5 == 0, "-mno-fix-x").otherwise("-Wall"), F.when(d % 7 == 0, "$(FLAGS)").otherwise("-c"), F.lit("-Xcompiler"), F.lit("-fPIC"), file,
    )
    return table(spark, sf_dir, "documents").select(d.alias("task_id"), F.concat(F.lit("/proj/"), F.coalesce("source", F.lit("none"))).alias("directory"), file.alias("file"), argv.alias("arguments"))


def page_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of page addresses below their hosts."""
    t = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1))
    return t.select("page_id", path.alias("path"))


def source_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of source text, from 1, with a tab as one space and no carriage return at the end."""
    t = table(spark, sf_dir, "documents")
    lines = t.select(F.concat(F.lit("src/d"), "doc_id", F.lit(".cc")).alias("relative_path"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    text = F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\t"), F.lit(" "))
    return lines.select("relative_path", (F.col("at") + 1).alias("line_no"), text.alias("text"))


#: A package map over the directories that the relations name, longest prefix and first entry to win; more come from a table.
PACKAGES = [("/proj", "main@v0"), ("/proj/inc", "inc@v1"), ("/proj/src1", "one@v1"), ("/proj/src1", "late@v9"), ("/proj/src2", "bad"), ("/proj/src3", "a b@v1"), ("/proj/src4", "x@"), ("/", "rest@v2")]


def package_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package entries in file order: the fixed ones, and an external root per customer."""
    c = F.col("c_custkey")
    more = table(spark, sf_dir, "customer").select((F.lit(len(PACKAGES)) + c).cast("int").alias("ord"), F.concat(F.lit("/proj/src"), 10 + c).alias("path"), F.concat(F.lit("cust"), c, F.lit("@v"), "c_nationkey").alias("package"))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(PACKAGES)], "ord int, path string, package string").unionByName(more)


RELATIONS = {
    "occ_raw": f"""SELECT l_suppkey AS task_id, concat('src/f', l_orderkey // 20, '.cc') AS relative_path, {_SQL_SYMBOL.format("l_partkey")} AS symbol,
        l_linenumber - 1 AS start_line, CAST(l_quantity AS INT) AS start_char, l_linenumber - 1 + CASE WHEN l_suppkey % 7 = 3 THEN 2 ELSE 0 END AS end_line, CAST(l_quantity AS INT) + 4 AS end_char,
        CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS roles FROM lineitem""",
    "sym_raw": f"""SELECT p_partkey AS task_id, concat('src/p', p_partkey // 20, '.h') AS relative_path, {_SQL_SYMBOL.format("p_partkey")} AS symbol, {_SQL_SUFFIX.format("p_partkey")} AS suffix,
        CASE WHEN p_size % 3 = 0 THEN '{MISSING_DOC}' ELSE p_name END AS doc, p_partkey % 3 = 0 AS in_doc, (p_partkey % 3 = 1 OR p_partkey % 9 = 0) AS is_ext, p_size % 2 = 0 AS is_multi FROM part
        UNION ALL SELECT p_partkey + 1, concat('src/p', p_partkey // 20, '.h'), concat('cxx . twin v3$ ns', p_partkey % 7, '/T', p_partkey, '#'), {_SQL_SUFFIX.format("p_partkey")}, '{MISSING_DOC}', true, false, p_size % 2 <> 0
        FROM part WHERE p_partkey % 15 = 0
        UNION ALL SELECT p_partkey, concat('src/p', p_partkey // 20, '.h'), concat('cxx . alt v2$ ns', p_partkey % 7, '/T', p_partkey, '#'), {_SQL_SUFFIX.format("p_partkey")}, '{MISSING_DOC}', false, true, p_size % 2 = 0
        FROM part WHERE p_partkey % 12 = 1""",
    "rel_raw": f"""SELECT {_SQL_SYMBOL.format("p_partkey")} AS symbol, {_SQL_SYMBOL.format("(p_partkey // 2)")} AS target, p_partkey % 11 = 0 AS is_definition, p_partkey % 2 = 0 AS is_reference, false AS is_type_definition, true AS is_implementation FROM part
        UNION ALL SELECT {_SQL_SYMBOL.format("p_partkey")}, {_SQL_SYMBOL.format("(p_partkey // 3)")}, false, true, p_partkey % 3 = 0, false FROM part WHERE p_size % 4 = 0""",
    "fwd_raw": f"""SELECT l_orderkey AS task_id, {_SQL_SUFFIX.format("l_partkey")} AS suffix, concat('fwd ', l_partkey, ' ', l_suppkey) AS doc,
        concat('src/f', l_orderkey // 20, '.cc') AS relative_path, l_linenumber - 1 AS start_line, CAST(l_quantity AS INT) AS start_char,
        l_linenumber - 1 AS end_line, CAST(l_quantity AS INT) + 4 AS end_char FROM lineitem""",
    "sym_seen": f"""SELECT l_suppkey AS task_id, l_orderkey AS ord, l_linenumber AS line, concat('src/f', l_orderkey // 20, '.cc') AS relative_path,
        {_SQL_SYMBOL.format("l_partkey")} AS symbol, CASE l_linenumber % 3 WHEN 0 THEN '{MISSING_DOC}' WHEN 1 THEN '' ELSE concat('doc ', l_orderkey, ' ', l_linenumber) END AS doc FROM lineitem""",
    "tu_file": "SELECT DISTINCT l_orderkey AS task_id, concat('/proj/inc/h', l_partkey, '.h') AS path, l_suppkey % (1 + l_partkey % 3) AS hash FROM lineitem",
    "base_edge": "SELECT p_partkey AS derived, CAST(floor(p_partkey / 2) AS BIGINT) AS base FROM part WHERE p_partkey > 1",
    "job_event": """SELECT ts, user_id AS worker_id, event_id AS seq, user_id // 15 * 100 + event_id % 100 AS task_id, event_id % 2 AS subtask,
        CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'finish' WHEN 'error' THEN 'kill' ELSE 'other' END AS event FROM events""",
    "compdb": """SELECT doc_id AS task_id, concat('/proj/', coalesce(source, 'none')) AS directory, concat('f', doc_id, ['.c', '.cc', '.h', '.cu', '.CPP', '.S'][1 + doc_id % 6]) AS file,
        [CASE doc_id % 3 WHEN 0 THEN 'clang++' WHEN 1 THEN 'gcc' ELSE 'nvcc' END, concat('-march=m', doc_id % 4), '-o', '-o', concat('out', doc_id, '.o'),
         CASE WHEN doc_id % 5 = 0 THEN '-mno-fix-x' ELSE '-Wall' END, CASE WHEN doc_id % 7 = 0 THEN '$(FLAGS)' ELSE '-c' END, '-Xcompiler', '-fPIC',
         concat('f', doc_id, ['.c', '.cc', '.h', '.cu', '.CPP', '.S'][1 + doc_id % 6])] AS arguments FROM documents""",
    "page_path": "SELECT page_id, concat('/', regexp_extract(url, '^https?://([^/?#]+)', 1), regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS path FROM pages",
    "source_line": r"""SELECT relative_path, row_number() OVER (PARTITION BY relative_path ORDER BY pos) AS line_no, replace(regexp_replace(line, '\r$', ''), chr(9), ' ') AS text
        FROM (SELECT concat('src/d', doc_id, '.cc') AS relative_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
    "package_map": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(PACKAGES)) + f""") AS v(ord, path, package)
        UNION ALL SELECT {len(PACKAGES)} + c_custkey, concat('/proj/src', 10 + c_custkey), concat('cust', c_custkey, '@v', c_nationkey) FROM customer""",
}


def with_relations(sql: str) -> str:
    """sql with the relations that it names put before it as common table expressions."""
    used = [name for name in RELATIONS if name in sql]
    head = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH RECURSIVE {head},\n{body[body.index(' ') + 1 :].removeprefix('RECURSIVE ')}" if body.startswith("WITH") else f"WITH {head}\n{body}"
