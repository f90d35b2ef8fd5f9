"""Queries of readers and writers, over files that they write from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.operators.tables import fresh_path
from codefacts.operators import merge
from codefacts.queries import ORACLE_SQL, merging, query
from codefacts.sources import files, index_files
from codefacts.sources.adapters import fwd_raw, occ_raw, table

_KEPT = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('/proj/', coalesce(source, 'none')) END"


@query(f"""SELECT doc_id // 500 AS database, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS task_id, {_KEPT} AS directory, concat('f', doc_id, '.cc') AS file,
    CAST(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 2 END AS INT) AS n_arguments, md5(CASE WHEN doc_id % 3 = 0 THEN concat('cc -c cc ', text) ELSE concat('cc ', text) END) AS arguments_md5 FROM documents WHERE text IS NOT NULL""")
def s01_array_commands(spark, sf_dir):
    """Databases of 500 commands, each a JSON array on one line, whose arguments hold the documents' texts, read in blocks."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    command = F.struct(
        F.when(d % 5 != 0, F.concat(F.lit("/proj/"), F.coalesce("source", F.lit("none")))).alias("directory"), F.concat(F.lit("f"), d, F.lit(".cc")).alias("file"),
        F.when(d % 3 == 0, F.lit("cc -c")).alias("command"), F.array(F.lit("cc"), F.col("text")).alias("arguments"),
    )
    one = F.transform(F.sort_array(F.collect_list(F.struct(d, command.alias("command")))), lambda x: x["command"])
    path = fresh_path(spark, "databases")
    docs.groupBy(F.expr("doc_id DIV 500").alias("database")).agg(F.to_json(one).alias("value")).write.partitionBy("database").text(path)
    own = files.read_commands(spark, path)
    number = F.regexp_extract("file_path", "database=(-?[0-9]+)", 1).cast("long")
    return own.select(number.alias("database"), "task_id", "directory", "file", F.size("arguments").alias("n_arguments"), F.md5(F.array_join("arguments", " ").cast("binary")).alias("arguments_md5"))


def _protobuf(spark, sf_dir, part):
    """A part of an index that has been written as protobuf files and read back."""
    whole = merging._index(spark, sf_dir)
    path = fresh_path(spark, "index-files")
    index_files.write_index_files(whole, path)
    return index_files.read_index_files(spark, path, (part,))[part]


def _relations_text():
    text = lambda r: F.concat(*[r[c].cast("int").cast("string") for c in merge.FLAGS], F.lit(" "), r["symbol"])
    return F.array_join(F.transform("relationships", text), ",").alias("relations")


@query()
def k02_protobuf_occurrences(spark, sf_dir):
    return _protobuf(spark, sf_dir, "occurrences").drop("shard").withColumn("place", F.col("place").cast("long"))


@query()
def k02_protobuf_symbols(spark, sf_dir):
    own = _protobuf(spark, sf_dir, "symbols")
    return own.select("relative_path", F.col("place").cast("long").alias("place"), "symbol", "doc", _relations_text())


@query()
def k02_protobuf_external(spark, sf_dir):
    return _protobuf(spark, sf_dir, "external").select("symbol", "doc", _relations_text())


#: What the files hold is what the index holds.
ORACLE_SQL |= {f"k02_protobuf_{name}": ORACLE_SQL[f"k02_{other}"] for name, other in (("occurrences", "document_occurrences"), ("symbols", "document_symbols"), ("external", "external_symbols"))}


@query("SELECT suffix, relative_path, start_line, start_char, end_line, end_char FROM fwd_raw")
def s07_protobuf_forward(spark, sf_dir):
    """References through forward declarations, written as shards of protobuf files and read back."""
    path = fresh_path(spark, "forward-files")
    index_files.write_forward_files(merge.forward_groups(fwd_raw(spark, sf_dir)), path)
    return index_files.read_forward_files(spark, path)[0].drop("shard", "doc")


@query("SELECT task_id, relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM occ_raw")
def k01_unit_shards(spark, sf_dir):
    """Occurrences of units, written as shards and read back; shards that can't be read would be missing."""
    own, path = occ_raw(spark, sf_dir), fresh_path(spark, "unit-shards")
    files.write_shards(own, path)
    return files.read_shards(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields))[0]


@query("""SELECT c_nationkey AS map, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord, concat('/proj/{', c_custkey, '}') AS path, concat('cust', c_custkey, '@v"', c_nationkey) AS package FROM customer""")
def s05_package_files(spark, sf_dir):
    """Package maps of nations, a JSON array each, read in blocks."""
    c, path = F.col("c_custkey"), fresh_path(spark, "package-maps")
    entry = F.struct(F.concat(F.lit("/proj/{"), c, F.lit("}")).alias("path"), F.concat(F.lit("cust"), c, F.lit('@v"'), "c_nationkey").alias("package"))
    one = F.transform(F.sort_array(F.collect_list(F.struct(c, entry.alias("entry")))), lambda x: x["entry"])
    table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("map")).agg(F.to_json(one).alias("value")).write.partitionBy("map").text(path)
    own = files.read_packages(spark, path)
    return own.select(F.regexp_extract("file_path", "map=(-?[0-9]+)", 1).cast("int").alias("map"), F.col("ord").cast("long").alias("ord"), "path", "package")


@query(f"""WITH numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS task_id, {_KEPT} AS directory, concat('f', doc_id, '.cc') AS file,
    concat(CASE WHEN doc_id % 3 = 0 THEN 'cc -c ' ELSE '' END, 'cc ', coalesce(text, '')) AS arguments FROM documents)
SELECT task_id, directory, file, md5(arguments) AS arguments_md5 FROM numbered WHERE directory IS NOT NULL""")
def s02_command_lines(spark, sf_dir):
    """One command a line, in files that are split. Numbers count rows that a later filter takes away; a command's words come before its arguments."""
    d, path = F.col("doc_id"), fresh_path(spark, "command-lines")
    docs = table(spark, sf_dir, "documents")
    command = F.struct(
        F.when(d % 5 != 0, F.concat(F.lit("/proj/"), F.coalesce("source", F.lit("none")))).alias("directory"), F.concat(F.lit("f"), d, F.lit(".cc")).alias("file"),
        F.when(d % 3 == 0, F.lit("cc -c")).alias("command"), F.array(F.lit("cc"), F.coalesce("text", F.lit(""))).alias("arguments"),
    )
    docs.orderBy(d).select(F.to_json(command)).write.text(path)
    own = files.read_command_lines(spark, path).where("directory IS NOT NULL")
    return own.select("task_id", "directory", "file", F.md5(F.array_join("arguments", " ").cast("binary")).alias("arguments_md5"))


@query("""WITH whole AS (
  SELECT doc_id // 100 AS folder, concat(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), chr(10)) AS content FROM documents GROUP BY doc_id // 100),
lines AS (
  SELECT folder, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM whole)
SELECT folder, CAST(line_no AS INT) AS line_no, md5(replace(regexp_replace(line, chr(13) || '$', ''), chr(9), ' ')) AS text_md5 FROM lines""")
def s10_source_tree(spark, sf_dir):
    """A tree of folders with a source file of 100 documents in each, read recursively."""
    d, path = F.col("doc_id"), fresh_path(spark, "source-tree")
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(d, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    table(spark, sf_dir, "documents").groupBy(F.expr("doc_id DIV 100").alias("folder")).agg(one.alias("value")).write.partitionBy("folder").text(path)
    own = files.read_sources(spark, path)
    return own.select(F.regexp_extract("relative_path", "folder=(-?[0-9]+)/", 1).cast("long").alias("folder"), "line_no", F.md5(F.col("text").cast("binary")).alias("text_md5"))
