"""Queries of the column functions, over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import hashing, paths, ranges, symbols, units
from codefacts.operators import commands, planning, tables
from codefacts.queries import query
from codefacts.schema import MISSING_DOC
from codefacts.sources.adapters import base_edge, compdb, occ_raw, page_path, sym_raw, table

KINDS = ("namespace", "type", "term", "meta", "method", "type_parameter", "parameter", "macro")
_ESC = "CASE WHEN regexp_matches({0}, '^[A-Za-z0-9+$_-]*$') THEN {0} ELSE concat('`', replace({0}, '`', '``'), '`') END"
_HASH = "substr(md5({0}), 1, 16)"
_SHORT = "ltrim(substr(md5({0}), 1, 16), '0')"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _kind(key: str):
    return F.get(F.array(*map(F.lit, KINDS)), (F.col(key) % 8).cast("int"))


@query(f"SELECT p_partkey, {_ESC.format('concat(p_brand, chr(96), p_type)')} AS a, {_ESC.format('p_brand')} AS b FROM part")
def p01_escape(spark, sf_dir):
    name = F.concat("p_brand", F.lit("`"), "p_type")
    return _part(spark, sf_dir).select("p_partkey", symbols.escape_name(name).alias("a"), symbols.escape_name(F.col("p_brand")).alias("b"))


@query("SELECT p_partkey, replace(p_type, ' ', '  ') AS escaped FROM part")
def p02_space_escape(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", symbols.escape_spaces(F.col("p_type")).alias("escaped"))


_DESC = """CASE {k} % 8 WHEN 0 THEN concat({n}, '/') WHEN 1 THEN concat({n}, '#') WHEN 2 THEN concat({n}, '.') WHEN 3 THEN concat({n}, ':')
    WHEN 4 THEN concat({n}, '(', {d}, ').') WHEN 5 THEN concat('[', {n}, ']') WHEN 6 THEN concat('(', {n}, ')') ELSE concat({n}, '!') END"""


@query(f"SELECT p_partkey, {_DESC.format(k='p_partkey', n='(' + _ESC.format('p_name') + ')', d='CAST(p_size AS VARCHAR)')} AS descriptor FROM part")
def p03_descriptor(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", symbols.descriptor(F.col("p_name"), _kind("p_partkey"), F.col("p_size").cast("string")).alias("descriptor"))


@query(f"""SELECT p_partkey, concat('cxx . ', CASE WHEN p_size % 4 = 0 THEN '. ' ELSE concat(replace(p_type, ' ', '  '), ' ') END, 'v', p_size, '$ ',
    {_ESC.format('p_brand')}, '/', {_ESC.format('p_name')}, '#m(', {_SHORT.format('p_type')}, ').') AS symbol FROM part""")
def p04_symbol(spark, sf_dir):
    part = lambda name, kind, d=None: F.struct(name.alias("name"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if d is None else d).alias("disambiguator"))
    parts = F.array(part(F.col("p_brand"), "namespace"), part(F.col("p_name"), "type"), part(F.lit("m"), "method", symbols.short_hash(F.col("p_type"))))
    package = F.when(F.col("p_size") % 4 != 0, F.col("p_type"))
    return _part(spark, sf_dir).select("p_partkey", symbols.symbol(package, F.concat(F.lit("v"), "p_size"), symbols.join_descriptors(parts)).alias("symbol"))


@query(f"""SELECT e.derived, concat(concat('cxx . p v$ ', {_ESC.format('b.p_name')}, '#'), {_ESC.format('d.p_name')}, '.') AS symbol
    FROM base_edge e JOIN part b ON e.base = b.p_partkey JOIN part d ON e.derived = d.p_partkey""")
def p05_contextual(spark, sf_dir):
    part = _part(spark, sf_dir)
    parent = part.select(F.col("p_partkey").alias("base"), symbols.symbol(F.lit("p"), F.lit("v"), symbols.descriptor(F.col("p_name"), F.lit("type"))).alias("parent"))
    child = part.select(F.col("p_partkey").alias("derived"), symbols.descriptor(F.col("p_name"), F.lit("term")).alias("own"))
    return base_edge(spark, sf_dir).join(parent, "base").join(child, "derived").select("derived", F.concat("parent", "own").alias("symbol"))


_MARKED = """(SELECT task_id, symbol FROM sym_raw UNION ALL SELECT task_id, replace(symbol, '$ ', '$') FROM sym_raw WHERE task_id % 5 = 0
    UNION ALL SELECT task_id, concat(symbol, '$ x') FROM sym_raw WHERE task_id % 7 = 0)"""
_SUFFIX = r"CASE WHEN regexp_matches(symbol, '^[^$]*\$ ') THEN regexp_extract(symbol, '^[^$]*\$ (.*)$', 1, 's') END"


def _marked(spark, sf_dir):
    s = sym_raw(spark, sf_dir).select("task_id", "symbol")
    return s.union(s.where("task_id % 5 = 0").select("task_id", F.replace("symbol", F.lit("$ "), F.lit("$")))).union(s.where("task_id % 7 = 0").select("task_id", F.concat("symbol", F.lit("$ x"))))


@query(f"SELECT task_id, symbol, {_SUFFIX} AS suffix FROM {_MARKED} m")
def p06_suffix(spark, sf_dir):
    return _marked(spark, sf_dir).withColumn("suffix", symbols.suffix(F.col("symbol")))


@query("SELECT task_id, concat('cxx . . $ ', suffix) AS symbol FROM sym_raw")
def p07_fake_prefix(spark, sf_dir):
    return sym_raw(spark, sf_dir).select("task_id", symbols.fake_symbol(F.col("suffix")).alias("symbol"))


@query(f"SELECT page_id, concat('cxx . . .$ ', {_ESC.format('m')}, '!') AS symbol FROM (SELECT page_id, concat(path, ':', page_id % 50, ':', page_id % 9) AS m FROM page_path) x")
def p08_macro_symbol(spark, sf_dir):
    p = F.col("page_id")
    return page_path(spark, sf_dir).select("page_id", symbols.macro_symbol(F.col("path"), (p % 50).cast("string"), (p % 9).cast("string")).alias("symbol"))


@query(f"SELECT page_id, concat('cxx . web v1$ ', {_ESC.format('m')}, '/') AS symbol FROM (SELECT page_id, concat('<file>/', path) AS m FROM page_path) x")
def p09_file_symbol(spark, sf_dir):
    return page_path(spark, sf_dir).select("page_id", symbols.file_symbol(F.lit("web"), F.lit("v1"), F.col("path")).alias("symbol"))


@query(f"SELECT page_id, concat('$anonymous_namespace_', path) AS name, concat({_ESC.format('n')}, '/') AS inner_suffix FROM (SELECT *, concat('$anonymous_namespace_', path) AS n FROM page_path) x")
def p10_anonymous_namespace(spark, sf_dir):
    name = symbols.anonymous_namespace(F.col("path"))
    whole = symbols.symbol(F.lit("p"), F.lit("v"), symbols.descriptor(name, F.lit("namespace")))
    return page_path(spark, sf_dir).select("page_id", name.alias("name"), symbols.suffix(whole).alias("inner_suffix"))


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('$anonymous_type_', {_SHORT.format('path')}, '_', page_id % 7) ELSE concat('$anonymous_type_', page_id % 7) END AS name FROM page_path""")
def p11_anonymous_type(spark, sf_dir):
    p = F.col("page_id")
    return page_path(spark, sf_dir).select("page_id", symbols.anonymous_type(F.col("path"), (p % 7).cast("string"), p % 2 == 0).alias("name"))


_COUNTED = """(SELECT concat('f', user_id) AS path, event_id AS seq, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY f, event_type) - 1 AS BIGINT) AS counter
    FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) y)"""


def _uses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("f"), "user_id").alias("path"), F.col("event_type").alias("decl"), F.col("event_id").alias("seq"))


@query(f"SELECT path, seq, CASE WHEN seq % 2 = 0 THEN concat('$anonymous_type_', {_SHORT.format('path')}, '_', counter) ELSE concat('$anonymous_type_', counter) END AS name FROM {_COUNTED} c")
def p11_counted_types(spark, sf_dir):
    own = planning.local_counters(_uses(spark, sf_dir))
    return own.select("path", "seq", symbols.anonymous_type(F.col("path"), F.col("counter").cast("string"), F.col("seq") % 2 == 0).alias("name"))


@query(f"SELECT path, seq, concat('local ', counter) AS symbol FROM {_COUNTED} c")
def p12_local_symbol(spark, sf_dir):
    return planning.local_symbols(_uses(spark, sf_dir)).select("path", "seq", "symbol")


@query(f"SELECT p_partkey, {_SHORT.format('p_type')} AS disambiguator, {_HASH.format('p_name')} AS hash FROM part")
def p13_disambiguator(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", symbols.short_hash(F.col("p_type")).alias("disambiguator"), symbols.text_hash(F.col("p_name")).alias("hash"))


@query("SELECT p_partkey, md5(concat(md5(concat(md5(concat('0', '|', p_name)), '|', p_brand)), '|', p_size)) AS chain FROM part")
def p15_hash_chain(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", symbols.hash_chain(F.array("p_name", "p_brand", F.col("p_size").cast("string"))).alias("chain"))


@query("SELECT task_id, concat(directory, '/', file) AS a, concat(directory, '/', file) AS b FROM compdb")
def p16_join_path(spark, sf_dir):
    d = F.col("directory")
    return compdb(spark, sf_dir).select("task_id", paths.join(d, F.col("file")).alias("a"), paths.join(F.concat(d, F.lit("/")), F.col("file")).alias("b"))


@query("""SELECT page_id, CASE WHEN path = root THEN '' WHEN starts_with(path, concat(root, '/')) THEN regexp_replace(substr(path, length(root) + 1), '^/+', '') END AS below
    FROM (SELECT page_id, path, CASE WHEN page_id % 3 = 0 THEN regexp_extract(path, '^/[^/]+', 0) WHEN page_id % 3 = 1 THEN substr(path, 1, 4) ELSE path END AS root FROM page_path) x""")
def p17_relative(spark, sf_dir):
    p, path = F.col("page_id"), F.col("path")
    root = F.when(p % 3 == 0, F.regexp_extract(path, "^/[^/]+", 0)).when(p % 3 == 1, F.substring(path, 1, 4)).otherwise(path)
    return page_path(spark, sf_dir).select("page_id", paths.relative(path, root).alias("below"))


@query("SELECT page_id, CASE WHEN contains(path, '/') AND NOT ends_with(path, '/') THEN regexp_extract(path, '[^/]*$', 0) END AS name FROM page_path")
def p18_filename(spark, sf_dir):
    return page_path(spark, sf_dir).select("page_id", paths.file_name(F.col("path")).alias("name"))


_BENT = "CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN replace(path, '/', '/./') WHEN 2 THEN concat(path, '/../x') ELSE concat(path, '//x') END"


def _bent(spark, sf_dir):
    p, path = F.col("page_id"), F.col("path")
    bent = F.when(p % 4 == 0, path).when(p % 4 == 1, F.replace(path, F.lit("/"), F.lit("/./"))).when(p % 4 == 2, F.concat(path, F.lit("/../x"))).otherwise(F.concat(path, F.lit("//x")))
    return page_path(spark, sf_dir).select("page_id", bent.alias("path"))


@query(f"SELECT page_id, path, NOT regexp_matches(path, '//|(^|/)[.][.]?(/|$)') AS normalized FROM (SELECT page_id, {_BENT} AS path FROM page_path) x")
def p19_is_normalized(spark, sf_dir):
    return _bent(spark, sf_dir).withColumn("normalized", paths.is_normalized(F.col("path")))


@query(f"SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '.'), '/') AS normal FROM (SELECT page_id, {_BENT} AS path FROM page_path) x")
def p20_normalize(spark, sf_dir):
    return _bent(spark, sf_dir).select("page_id", paths.normalize(F.col("path")).alias("normal"))


@query(r"SELECT task_id, regexp_extract(file, '[^/](\.[^./]*)$', 1) AS extension, concat(regexp_replace(file, '([^/])\.[^./]*$', '\1'), '.o') AS object FROM compdb")
def p21_extension(spark, sf_dir):
    return compdb(spark, sf_dir).select("task_id", paths.extension(F.col("file")).alias("extension"), paths.replace_extension(F.col("file"), F.lit(".o")).alias("object"))


@query("""SELECT page_id, CAST(i AS INT) AS depth, CASE WHEN i = 1 THEN '/' ELSE array_to_string(parts[1:i], '/') END AS prefix
    FROM (SELECT page_id, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM page_path) x""")
def p22_prefixes(spark, sf_dir):
    own = page_path(spark, sf_dir).select("page_id", paths.prefixes(F.col("path")).alias("p"))
    return own.select("page_id", F.size("p").alias("n"), F.posexplode("p").alias("at", "prefix")).select("page_id", (F.col("n") - F.col("at")).alias("depth"), "prefix")


@query("""SELECT page_id, concat('<external>/', CAST(('0x' || substr(md5(path), 1, 15)) AS BIGINT), '/', regexp_extract(path, '[^/]*$', 0)) AS stand_in
    FROM page_path WHERE NOT ends_with(path, '/')""")
def p23_external_path(spark, sf_dir):
    return page_path(spark, sf_dir).where("NOT endswith(path, '/')").select("page_id", paths.external_path(F.col("path")).alias("stand_in"))


@query("SELECT DISTINCT concat('file://', directory) AS uri FROM compdb")
def p24_root_uri(spark, sf_dir):
    return compdb(spark, sf_dir).select(paths.root_uri(F.col("directory")).alias("uri")).distinct()


@query("SELECT conv_id, turn, trim(concat(chr(9), ' ', text, chr(10), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS doc, '' AS blank FROM conversations")
def p25_clean_doc(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", symbols.clean_doc(F.concat(F.lit("\t "), "text", F.lit("\n "))).alias("doc"), symbols.clean_doc(F.repeat(F.lit(" \n\t"), F.col("turn") % 3)).alias("blank"))


@query(f"SELECT task_id, symbol, doc <> '{MISSING_DOC}' AS loose, doc <> '' AND doc <> '{MISSING_DOC}' AS has FROM sym_raw")
def p26_has_doc(spark, sf_dir):
    doc = F.array("doc")
    return sym_raw(spark, sf_dir).select("task_id", "symbol", symbols.has_doc(doc, strict=True).alias("loose"), symbols.has_doc(doc).alias("has"))


@query("""SELECT p_partkey, CASE WHEN name = '' THEN 'anonymous namespace' WHEN p_size % 3 = 2 THEN concat('inline namespace ', name) ELSE concat('namespace ', name) END AS doc,
    concat('File: ', p_name, '.h') AS file_doc FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS name FROM part) x""")
def p27_namespace_doc(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return _part(spark, sf_dir).select("p_partkey", symbols.namespace_doc(name, F.col("p_size") % 3 == 2).alias("doc"), symbols.file_doc(F.concat("p_name", F.lit(".h"))).alias("file_doc"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, CASE WHEN el = sl THEN concat(sl - 1, ',', sc - 1, ',', ec - 1) ELSE concat(sl - 1, ',', sc - 1, ',', el - 1, ',', ec - 1) END AS stored,
    sl, sc, el, ec FROM (SELECT *, l_linenumber AS sl, 1 + CAST(l_quantity AS INT) AS sc, l_linenumber + CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END AS el, 9 + CAST(l_quantity AS INT) AS ec FROM lineitem) x""")
def p28_range_codec(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    el = n + F.when(F.col("l_partkey") % 2 == 0, 2).otherwise(0)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", ranges.encode(n, 1 + q, el, 9 + q).alias("r"))
    d = ranges.decode(F.col("r"))
    return own.withColumn("d", d).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", F.array_join("r", ",").alias("stored"), F.col("d.start_line").alias("sl"), F.col("d.start_char").alias("sc"), F.col("d.end_line").alias("el"), F.col("d.end_char").alias("ec"))


@query("""SELECT role, count(*) AS n FROM (SELECT CASE WHEN r & 1 <> 0 THEN 'definition' WHEN r & 4 <> 0 AND r & 8 <> 0 THEN 'reference (read+write)' WHEN r & 4 <> 0 THEN 'reference (write)' ELSE 'reference' END AS role
    FROM (SELECT l_partkey % 16 AS r FROM lineitem) y) x GROUP BY role""")
def p29_role_text(spark, sf_dir):
    role = ranges.role_text((F.col("l_partkey") % 16).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


_SHARD = "CASE WHEN o_orderkey % 3 = 0 THEN concat('forward-', o_orderkey) ELSE concat('job-', o_orderkey, '-worker-', o_custkey % 8, '-docs.parquet') END"


@query(f"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(name, '^job-([0-9]+)-worker', 1), '') AS BIGINT) AS task_id FROM (SELECT o_orderkey, {_SHARD} AS name FROM orders) x")
def p30_shard_task(spark, sf_dir):
    o = F.col("o_orderkey")
    name = F.when(o % 3 == 0, F.concat(F.lit("forward-"), o)).otherwise(F.concat(F.lit("job-"), o, F.lit("-worker-"), F.col("o_custkey") % 8, F.lit("-docs.parquet")))
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.shard_task(name).alias("task_id"))


@query("""SELECT task_id, replace(replace(replace(replace(s, 'cxx . . $ ', '[..] '), 'cxx . ', ''), 'todo-pkg todo-version', '[..]'), 'test-pkg test-version $', '[..] ') AS shown
    FROM (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN symbol ELSE concat('cxx . . $ ', suffix) END AS s FROM sym_raw) x""")
def p31_display(spark, sf_dir):
    s = F.when(F.col("task_id") % 2 == 0, F.col("symbol")).otherwise(symbols.fake_symbol(F.col("suffix")))
    return sym_raw(spark, sf_dir).select("task_id", symbols.display(s).alias("shown"))


@query("SELECT event_id, round(event_id * 1234567 / 1e6, 3) AS seconds FROM events")
def p32_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", units.seconds(F.col("event_id") * 1234567, 3).alias("seconds"))


@query("""SELECT task_id, array_to_string(CASE task_id % 3
      WHEN 0 THEN list_concat(['/usr/bin/clang'], list_filter(arguments[2:], lambda a: NOT starts_with(a, '-march') AND a <> '-mno-fix-x'), ['-resource-dir', '/res'])
      WHEN 1 THEN list_concat(list_filter(arguments, lambda a: NOT starts_with(a, '-march') AND a <> '-mno-fix-x'), ['-resource-dir', '/gcc', '-I/gcc/include-fixed'])
      ELSE list_concat(['/usr/bin/clang'], list_filter(arguments[2:], lambda a: a NOT IN ('-Xcompiler', '-fPIC')), ['-resource-dir', '/res', '-isystem/cuda/include']) END, ' ') AS command FROM compdb""")
def p34_command_line(spark, sf_dir):
    cc = compdb(spark, sf_dir)
    known = commands.toolchains(cc)
    where = F.when(F.col("kind") == "gcc", "/gcc").otherwise("/res")
    known = known.withColumn("driver", F.lit("/usr/bin/clang")).withColumn("resource_dir", where).withColumn("cuda_dir", F.lit("/cuda"))
    return commands.rewrite(cc, known).select("task_id", F.array_join("arguments", " ").alias("command"))


@query("SELECT task_id, concat(array_to_string(arguments, ' '), ' -fsyntax-only -w -working-directory ', directory, ' -ferror-limit=0') AS command FROM compdb")
def p35_front_end_flags(spark, sf_dir):
    return compdb(spark, sf_dir).select("task_id", F.array_join(commands.with_front_end_flags(F.col("arguments"), F.col("directory")), " ").alias("command"))


@query("""SELECT symbol, row_number() OVER (ORDER BY octet_length(encode(symbol)), symbol) AS place FROM (SELECT DISTINCT symbol FROM sym_raw) x""")
def o01_length_first(spark, sf_dir):
    return tables.numbered(sym_raw(spark, sf_dir).select("symbol").distinct(), ranges.by_length(F.col("symbol")), "place")


@query("""SELECT relative_path, symbol, start_line, start_char, roles, row_number() OVER (PARTITION BY relative_path ORDER BY start_line, start_char, start_line <> end_line, CASE WHEN start_line <> end_line THEN end_line ELSE end_char END, end_char, strlen(symbol), symbol, roles) AS place
    FROM (SELECT DISTINCT relative_path, symbol, start_line, start_char, end_line, end_char, roles FROM occ_raw) x""")
def o02_occurrence_order(spark, sf_dir):
    from codefacts.operators import merge, render

    return render.ranked(merge.merge_occurrences(occ_raw(spark, sf_dir))).select("relative_path", "symbol", "start_line", "start_char", "roles", F.col("place").cast("long").alias("place"))


_WORD = lambda at: "(" + " + ".join(f"CAST(ascii(substr(name, {at} + {i + 1}, 1)) AS UHUGEINT) * {256**i}" for i in range(4)) + ")"
_SECRETS = [int(x) for x in hashing.SECRET]
_FOLD = lambda p: f"xor({p} & 18446744073709551615, {p} >> 64)"


@query(f"""WITH n AS (SELECT doc_id, concat('f', doc_id, '.cc') AS name, length(concat('f', doc_id, '.cc')) AS n FROM documents),
    r AS (SELECT *, ({_WORD("0")} << 32) | {_WORD("n // 8 * 4")} AS a, ({_WORD("n - 4")} << 32) | {_WORD("n - 4 - n // 8 * 4")} AS b,
        CAST({_SECRETS[0]} AS UHUGEINT) * CAST({_SECRETS[1]} AS UHUGEINT) AS s FROM n),
    m AS (SELECT *, xor(a, {_SECRETS[1]}::UHUGEINT) * xor(b, {_FOLD("s")}) AS p FROM r),
    f AS (SELECT *, xor(xor(p & 18446744073709551615, {_SECRETS[0]}::UHUGEINT), n::UHUGEINT) * xor(p >> 64, {_SECRETS[1]}::UHUGEINT) AS q FROM m)
    SELECT doc_id, concat('$anonymous_type_', lower(hex(CAST({_FOLD("q")} AS UBIGINT))), '_', doc_id % 7) AS name FROM f""")
def p14_exact_names(spark, sf_dir):
    """Names of anonymous types with the hash that other tools' names have, for files of up to 16 bytes (tests go through all lengths)."""
    d = F.col("doc_id")
    name = symbols.anonymous_type(F.concat(F.lit("f"), d, F.lit(".cc")), (d % 7).cast("string"), F.lit(True), hashing.exact_hash)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
