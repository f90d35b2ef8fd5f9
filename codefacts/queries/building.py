"""Queries of build commands, file plans, packages, counters and job logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.operators import commands, jobs, measure, packages, planning, render
from codefacts.queries import query
from codefacts.schema import MAX_OVERLOADS
from codefacts.sources import files
from codefacts.sources.adapters import compdb, job_event, package_map, page_path, source_line, table, tu_file

_MAIN = r"regexp_matches(file, '.([.]c|[.]C|[.]cc|[.]cpp|[.]CPP|[.]cxx|[.]c[+][+]|[.]cu)$')"


@query(f"SELECT task_id, file FROM compdb WHERE {_MAIN}")
def f01_main_file(spark, sf_dir):
    return compdb(spark, sf_dir).where(commands.is_main_file(F.col("file"))).select("task_id", "file")


def _existing(spark, sf_dir):
    return compdb(spark, sf_dir).where("task_id % 10 <> 3").select(paths.join(F.col("directory"), F.col("file")).alias("path"))


@query(f"SELECT task_id, CASE WHEN NOT {_MAIN} THEN 'not-main' WHEN task_id % 10 = 3 THEN 'no-file' END AS skipped FROM compdb")
def f02_skip_reasons(spark, sf_dir):
    return commands.skip_reasons(compdb(spark, sf_dir), _existing(spark, sf_dir)).select("task_id", "skipped")


@query("SELECT event_id, 'value' AS bad FROM events WHERE event_id % 4 IN (1, 2)")
def f03_badly_typed(spark, sf_dir):
    e = F.col("event_id")
    value = F.when(e % 4 == 0, F.lit('"text"')).when(e % 4 == 1, F.lit("5")).when(e % 4 == 2, F.lit('{"a":"b"}')).otherwise(F.lit('["a","b"]'))
    json = F.concat(F.lit('{"file":"'), F.col("event_type"), F.lit('","value":'), value, F.lit("}"))
    return commands.badly_typed(table(spark, sf_dir, "events").select("event_id", json.alias("json"))).select("event_id", F.array_join("bad", ",").alias("bad"))


@query("""SELECT task_id, array_to_string(list_filter([CASE WHEN task_id % 4 = 0 THEN 'directory' END, CASE WHEN task_id % 6 = 0 THEN 'file' END, CASE WHEN task_id % 8 = 0 THEN 'command' END], lambda x: x IS NOT NULL), ',') AS missing
    FROM compdb WHERE task_id % 4 = 0 OR task_id % 6 = 0 OR task_id % 8 = 0""")
def f04_required_keys(spark, sf_dir):
    t = F.col("task_id")
    c = compdb(spark, sf_dir).select(t, F.when(t % 4 != 0, F.col("directory")).alias("directory"), F.when(t % 6 != 0, F.col("file")).alias("file"), F.when(t % 8 != 0, F.col("arguments")).alias("arguments"), F.lit(None).cast("string").alias("command"))
    return commands.missing_keys(c).select("task_id", F.array_join("missing", ",").alias("missing"))


@query("SELECT DISTINCT key FROM (SELECT unnest(json_keys(props)) AS key FROM events) x WHERE key NOT IN ('directory', 'file', 'command', 'arguments', 'output')")
def f05_unknown_keys(spark, sf_dir):
    return commands.unknown_keys(table(spark, sf_dir, "events").select(F.col("props").alias("json")))


@query("SELECT task_id FROM compdb WHERE task_id % 9 = 0")
def f06_relative_directories(spark, sf_dir):
    c = compdb(spark, sf_dir).withColumn("directory", F.when(F.col("task_id") % 9 == 0, F.substr("directory", F.lit(2))).otherwise(F.col("directory")))
    return files.relative_directories(c).select("task_id")


@query("""SELECT task_id, array_to_string(CASE WHEN task_id % 3 < 2 THEN list_filter(arguments, lambda a: NOT starts_with(a, '-march') AND a <> '-mno-fix-x')
    ELSE list_filter(arguments, lambda a: a NOT IN ('-Xcompiler', '-fPIC')) END, ' ') AS cleaned FROM compdb""")
def f08_clean_arguments(spark, sf_dir):
    cleaned = commands.clean_arguments(F.col("arguments"), commands.compiler_kind(F.get("arguments", 0)))
    return compdb(spark, sf_dir).select("task_id", F.array_join(cleaned, " ").alias("cleaned"))


@query("SELECT task_id, regexp_matches(file, '^(.+[.]h.*)$') AS header, regexp_matches(file, '^(f1.*|.*9[.]cc)$') AS chosen, false AS nothing FROM compdb")
def f11_header_filter(spark, sf_dir):
    f = F.col("file")
    return compdb(spark, sf_dir).select("task_id", commands.matches_header_filter(f, ".+[.]h.*").alias("header"), commands.matches_header_filter(f, "f1.*|.*9[.]cc").alias("chosen"), commands.matches_header_filter(f, "").alias("nothing"))


_CLAIM = "(SELECT path, hash, min(task_id) AS task_id FROM tu_file GROUP BY path, hash)"


@query(f"SELECT t.task_id, count(*) AS n FROM tu_file t WHERE EXISTS (SELECT 1 FROM {_CLAIM} c WHERE c.path = t.path AND c.hash = t.hash AND c.task_id = t.task_id) GROUP BY t.task_id")
def f12_claimed(spark, sf_dir):
    seen = tu_file(spark, sf_dir)
    return planning.claimed(seen, planning.claims(seen)).groupBy("task_id").agg(F.count("*").alias("n"))


@query(r"SELECT ord, coalesce(regexp_matches(package, '^[A-Za-z0-9._-]+@[A-Za-z0-9._-]+$'), false) AS valid FROM package_map")
def f14_package_valid(spark, sf_dir):
    return package_map(spark, sf_dir).select("ord", packages.is_valid(F.col("package")).alias("valid"))


@query("SELECT task_id FROM compdb WHERE task_id % 7 = 0")
def f18_unexpanded(spark, sf_dir):
    return compdb(spark, sf_dir).where(commands.unexpanded(F.col("arguments"))).select("task_id")


_MAP = r"(SELECT path AS root, arg_min(package, ord) AS package FROM package_map WHERE regexp_matches(package, '^[A-Za-z0-9._-]+@[A-Za-z0-9._-]+$') GROUP BY path)"
_ABOVE = "(m.root = '/' OR c.path = m.root OR starts_with(c.path, concat(m.root, '/')))"


def _files(spark, sf_dir):
    return compdb(spark, sf_dir).select("task_id", paths.join(F.col("directory"), F.col("file")).alias("path"))


_FILES = "(SELECT task_id, concat(directory, '/', file) AS path FROM compdb)"


@query(f"""SELECT task_id, path, split_part(package, '@', 1) AS name, split_part(package, '@', 2) AS version FROM (
    SELECT c.task_id, c.path, arg_max(m.package, length(m.root)) AS package FROM {_FILES} c LEFT JOIN {_MAP} m ON {_ABOVE} GROUP BY c.task_id, c.path) x""")
def j01_longest_prefix(spark, sf_dir):
    return packages.longest_prefix(_files(spark, sf_dir), packages.load_map(package_map(spark, sf_dir))).select("task_id", "path", "name", "version")


@query(f"SELECT root, split_part(package, '@', 1) AS name, split_part(package, '@', 2) AS version FROM {_MAP} m")
def j02_package_first_wins(spark, sf_dir):
    return packages.load_map(package_map(spark, sf_dir))


@query(r"SELECT path, count(DISTINCT package) AS n FROM package_map WHERE regexp_matches(package, '^[A-Za-z0-9._-]+@[A-Za-z0-9._-]+$') GROUP BY path HAVING count(DISTINCT package) > 1")
def j02_package_conflicts(spark, sf_dir):
    return packages.conflicts(package_map(spark, sf_dir))


@query("""SELECT page_id, kind, kind IN ('project', 'build') AS is_in_project, kind = 'external' AS is_synthetic,
    CASE kind WHEN 'package' THEN regexp_replace(path, '^/pkg/', '') WHEN 'build' THEN regexp_replace(path, '^/proj/build/', '') WHEN 'project' THEN regexp_replace(path, '^/proj/', '')
      ELSE concat('<external>/', CAST(('0x' || substr(md5(path), 1, 15)) AS BIGINT), '/', regexp_extract(path, '[^/]*$', 0)) END AS stable_path
    FROM (SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN 'package' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'build' ELSE 'external' END WHEN 2 THEN 'project' ELSE 'external' END AS kind
      FROM (SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '/pkg' WHEN 1 THEN '/proj/build' WHEN 2 THEN '/proj' ELSE '' END, path, 'f') AS path FROM page_path) y) x""")
def j03_classify(spark, sf_dir):
    p = F.col("page_id")
    root = F.when(p % 5 == 0, "/pkg").when(p % 5 == 1, "/proj/build").when(p % 5 == 2, "/proj").otherwise("")
    own = page_path(spark, sf_dir).select("page_id", F.concat(root, "path", F.lit("f")).alias("path"), F.when(p % 2 == 0, F.concat(F.lit("/proj"), "path", F.lit("f"))).alias("real_path"))
    known = table(spark, sf_dir, "region").limit(1).select(F.lit("/pkg").alias("root"), F.lit("pkg").alias("name"), F.lit("v1").alias("version"))
    return packages.classify(own, known, "/proj", "/proj/build").select("page_id", "kind", "is_in_project", "is_synthetic", "stable_path")


@query("SELECT path, min(hash) AS hash FROM tu_file GROUP BY path")
def j05_any_hash(spark, sf_dir):
    return planning.any_hash(tu_file(spark, sf_dir))


@query(f"""SELECT t.path, t.hash, concat('cxx . . .$ `<file>/', t.path, '`/') AS symbol, t.task_id FROM tu_file t JOIN (SELECT path, hash, min(task_id) AS task_id FROM tu_file GROUP BY path, hash) f
    ON t.path = f.path AND t.hash = f.hash""")
def j06_include_reference(spark, sf_dir):
    seen = tu_file(spark, sf_dir)
    return packages.include_references(seen, planning.claims(seen), F.lit(None), F.lit(".")).select("path", "hash", "symbol", "task_id")


_STATS = "(SELECT path, count(DISTINCT hash) AS n_hash FROM tu_file GROUP BY path)"


@query(f"""SELECT is_multi, unknown, count(*) AS n FROM (SELECT coalesce(s.n_hash, 2) > 1 AS is_multi, s.n_hash IS NULL AS unknown
    FROM (SELECT task_id, CASE WHEN task_id % 11 = 0 THEN concat(path, '.x') ELSE path END AS path FROM tu_file) d LEFT JOIN {_STATS} s ON d.path = s.path) x GROUP BY is_multi, unknown""")
def j09_plan_unknown(spark, sf_dir):
    seen = tu_file(spark, sf_dir)
    documents = seen.select("task_id", F.when(F.col("task_id") % 11 == 0, F.concat("path", F.lit(".x"))).otherwise(F.col("path")).alias("path"))
    return planning.document_plan(documents, planning.path_stats(seen)).groupBy("is_multi", "unknown").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT task_id FROM tu_file WHERE task_id % 11 = 0")
def j09_suspects(spark, sf_dir):
    seen = tu_file(spark, sf_dir)
    documents = seen.select("task_id", F.when(F.col("task_id") % 11 == 0, F.concat("path", F.lit(".x"))).otherwise(F.col("path")).alias("path"))
    return planning.suspects(documents, planning.path_stats(seen))


def _jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 2).cast("long").alias("task_id"), (F.col("o_orderkey") % 2).alias("subtask"), F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 2).cast("long"), F.lit(".cc")).alias("filepath"), (F.col("o_orderkey") * 1001).alias("total_time_us"))


@query("""SELECT a.task_id, a.total_time_us, b.filepath FROM (SELECT CAST(floor(o_orderkey / 2) AS BIGINT) AS task_id, o_orderkey * 1001 AS total_time_us FROM orders WHERE o_orderkey % 2 = 1) a
    JOIN (SELECT DISTINCT CAST(floor(o_orderkey / 2) AS BIGINT) AS task_id, concat('f', CAST(floor(o_orderkey / 2) AS BIGINT), '.cc') AS filepath FROM orders WHERE o_orderkey % 2 = 0) b ON a.task_id = b.task_id""")
def j10_stats_join(spark, sf_dir):
    own = _jobs(spark, sf_dir)
    return jobs.stats_of_jobs(own.where("subtask = 1").select("task_id", "total_time_us"), own).select("task_id", "total_time_us", "filepath")


@query("""SELECT c.task_id, coalesce(a.n, b.n, -999) AS n_lines FROM compdb c LEFT JOIN (SELECT concat('f', doc_id) AS name, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) a ON starts_with(c.file, concat(a.name, '.'))
    LEFT JOIN (SELECT concat('f', doc_id) AS name, length(text) AS n FROM documents WHERE doc_id % 3 = 1) b ON starts_with(c.file, concat(b.name, '.'))""")
def j13_measurements(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = d.where("doc_id % 3 = 0").groupBy(F.concat(F.lit("f"), "doc_id").alias("path")).agg(F.count("*").alias("value"))
    second = d.where("doc_id % 3 = 1").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.char_length("text").cast("long").alias("value"))
    own = compdb(spark, sf_dir).select("task_id", F.substring_index("file", ".", 1).alias("path"))
    return measure.measured(own, first, second).select("task_id", F.col("value").alias("n_lines"))


@query("SELECT DISTINCT arguments[1] AS compiler, CASE arguments[1] WHEN 'clang++' THEN 'clang' ELSE arguments[1] END AS kind FROM compdb")
def j14_toolchains(spark, sf_dir):
    return commands.toolchains(compdb(spark, sf_dir))


@query("SELECT task_id, path, count(DISTINCT hash) AS n_hash, count(DISTINCT hash) = 1 AS well_behaved FROM tu_file GROUP BY task_id, path")
def a01_well_behaved(spark, sf_dir):
    return planning.behaviour(tu_file(spark, sf_dir))


@query("SELECT path, count(DISTINCT hash) AS n_hash, count(DISTINCT hash) > 1 AS is_multi FROM tu_file GROUP BY path")
def a02_multiply_indexed(spark, sf_dir):
    return planning.path_stats(tu_file(spark, sf_dir))


@query(f"""SELECT count(*) AS n_commands, count(*) FILTER (NOT {_MAIN}) AS n_not_main, count(*) FILTER ({_MAIN} AND task_id % 10 = 3) AS n_no_file,
    (SELECT count(*) FROM (SELECT DISTINCT task_id, subtask FROM job_event WHERE event = 'finish') x) AS n_done,
    (SELECT count(*) FROM (SELECT task_id, subtask FROM job_event WHERE event = 'start' EXCEPT SELECT task_id, subtask FROM job_event WHERE event = 'finish') x) AS n_errored FROM compdb""")
def a13_counters(spark, sf_dir):
    return jobs.summary(commands.skip_reasons(compdb(spark, sf_dir), _existing(spark, sf_dir)), job_event(spark, sf_dir))


@query("SELECT task_id % 12 AS chunk, count(*) AS n, CAST(sum(length(file)) AS BIGINT) AS total FROM compdb GROUP BY 1")
def a14_chunk_sums(spark, sf_dir):
    own = compdb(spark, sf_dir).select((F.col("task_id") % 12).alias("chunk"), F.char_length("file").alias("value"))
    return measure.chunk_sums(own)


@query(r"SELECT regexp_extract(file, '[^/](\.[^./]*)$', 1) AS extension, count(*) AS n FROM compdb GROUP BY 1")
def a15_by_extension(spark, sf_dir):
    return compdb(spark, sf_dir).groupBy(paths.extension(F.col("file")).alias("extension")).agg(F.count("*").alias("n"))


@query("SELECT path, hash, min(task_id) AS task_id FROM tu_file GROUP BY path, hash")
def w02_first_claim(spark, sf_dir):
    return planning.claims(tu_file(spark, sf_dir))


@query("""SELECT path, decl, seq, counter FROM (SELECT path, decl, seq, CAST(dense_rank() OVER (PARTITION BY path ORDER BY f, decl) - 1 AS BIGINT) AS counter
    FROM (SELECT *, min(seq) OVER (PARTITION BY path, decl) AS f FROM (SELECT concat('f', user_id) AS path, event_type AS decl, event_id AS seq FROM events) x) y) z""")
def w01_local_counter(spark, sf_dir):
    uses = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), "user_id").alias("path"), F.col("event_type").alias("decl"), F.col("event_id").alias("seq"))
    return planning.local_counters(uses).select("path", "decl", "seq", F.col("counter").cast("long").alias("counter"))


@query("""SELECT path, ord, before, expected FROM (SELECT path, ord, before, coalesce(lag(after) OVER (PARTITION BY path ORDER BY ord), '0') AS expected FROM (
    SELECT concat('f', user_id) AS path, event_id AS ord, CAST(user_id * 7 + event_id % 3 AS VARCHAR) AS before, CAST(user_id * 7 + (event_id + user_id) % 3 AS VARCHAR) AS after FROM events) x) y WHERE before <> expected""")
def w04_chain_check(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    h = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), u).alias("path"), e.alias("ord"), (u * 7 + e % 3).cast("string").alias("before"), (u * 7 + (e + u) % 3).cast("string").alias("after"))
    return planning.chain_breaks(h).select("path", "ord", "before", "expected")


@query("""SELECT task_id, CAST(min(depth) AS BIGINT) AS lowest, CAST(arg_max(depth, seq) AS BIGINT) AS last FROM (
    SELECT user_id AS task_id, event_id AS seq, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events) x GROUP BY task_id""")
def w05_balance(spark, sf_dir):
    t = F.col("event_type")
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.when(t == "click", 1).when(t == "view", -1).otherwise(0).alias("delta"))
    return planning.balance(own)


@query("SELECT o_orderkey, CASE WHEN i < q * 7 THEN CAST(floor(i / q) AS BIGINT) ELSE CAST(i - q * 7 AS BIGINT) END AS chunk FROM (SELECT o_orderkey, o_orderkey % 1003 AS i, 143 AS q FROM orders) x")
def w07_chunks(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", planning.chunk_of(o % 1003, F.lit(1003), 7).alias("chunk"))


@query(f"""SELECT call, ord, symbol, CAST(n AS BIGINT) AS n FROM (SELECT l_orderkey // 16 AS call, l_partkey * 100 + l_linenumber AS ord, concat('s', l_partkey) AS symbol,
    row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_partkey * 100 + l_linenumber, concat('s', l_partkey)) AS n FROM lineitem WHERE l_partkey % 3 <> 0) x WHERE n <= {MAX_OVERLOADS}""")
def o10_top16(spark, sf_dir):
    from codefacts.operators import merge

    p = F.col("l_partkey")
    own = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey DIV 16").alias("call"), (p * 100 + F.col("l_linenumber")).alias("ord"), F.when(p % 3 != 0, F.concat(F.lit("s"), p)).alias("symbol"))
    return merge.top_overloads(own, MAX_OVERLOADS).withColumn("n", F.col("n").cast("long"))


@query("""SELECT task_id, subtask, event, CASE event WHEN 'start' THEN 'wip' WHEN 'finish' THEN 'done' WHEN 'kill' THEN 'maybe_errored' ELSE 'pending' END AS state
    FROM (SELECT task_id, subtask, arg_max(event, ts) AS event FROM job_event GROUP BY task_id, subtask) x""")
def t01_latest_state(spark, sf_dir):
    return jobs.latest_state(job_event(spark, sf_dir))


@query("""SELECT worker_id, seq FROM (SELECT *, lead(ts) OVER (PARTITION BY worker_id ORDER BY ts, seq) AS nts FROM job_event WHERE event IN ('start', 'finish', 'kill')) x
    WHERE event = 'start' AND (nts IS NULL OR nts > ts + INTERVAL 300 SECOND)""")
def t02_timeouts(spark, sf_dir):
    return jobs.timeouts(job_event(spark, sf_dir), 300).select("worker_id", "seq")


@query("""SELECT f.task_id, f.subtask, count(*) AS n_late FROM job_event f JOIN (SELECT task_id, subtask, min(ts) AS k FROM job_event WHERE event = 'kill' GROUP BY task_id, subtask) x
    ON f.task_id = x.task_id AND f.subtask = x.subtask WHERE f.event = 'finish' AND f.ts > x.k GROUP BY f.task_id, f.subtask""")
def t03_late(spark, sf_dir):
    return jobs.late_answers(job_event(spark, sf_dir))


@query("SELECT DISTINCT task_id, subtask FROM job_event e WHERE event = 'start' AND NOT EXISTS (SELECT 1 FROM job_event f WHERE f.event = 'finish' AND f.task_id = e.task_id AND f.subtask = e.subtask)")
def t04_errored(spark, sf_dir):
    return jobs.errored(job_event(spark, sf_dir))


@query("SELECT task_id, max(CASE WHEN subtask = 1 THEN 1 ELSE 0 END) = 1 AS emitted FROM job_event WHERE event = 'finish' GROUP BY task_id HAVING max(CASE WHEN subtask = 0 THEN 1 ELSE 0 END) = 1")
def t05_two_phases(spark, sf_dir):
    return jobs.both_phases(job_event(spark, sf_dir))


@query("""SELECT o_orderkey AS task_id, concat('{"filepath":"f', CAST(floor(o_orderkey / 2) AS BIGINT), '.cc","stats":{"total_time_s":', CAST(o_orderkey % 1000 AS BIGINT), '.5}}') AS json FROM orders""")
def k03_stats_json(spark, sf_dir):
    o = F.col("o_orderkey")
    stats = table(spark, sf_dir, "orders").select(o.alias("task_id"), F.concat(F.lit("f"), F.floor(o / 2).cast("long"), F.lit(".cc")).alias("filepath"), (o % 1000 * 1_000_000 + 500_000).alias("total_time_us"))
    return render.stats_json(stats)


@query("SELECT relative_path, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM source_line GROUP BY relative_path")
def s09_source_lines(spark, sf_dir):
    return source_line(spark, sf_dir).groupBy("relative_path").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("text")).alias("n_chars"))


@query("""SELECT relative_path, count(*) AS n FROM source_line s WHERE line_no < coalesce((SELECT min(line_no) FROM source_line o WHERE o.relative_path = s.relative_path AND length(o.text) < 40), 1000000000) GROUP BY relative_path""")
def s11_leading_lines(spark, sf_dir):
    lines = source_line(spark, sf_dir).withColumn("text", F.when(F.char_length("text") >= 40, F.concat(F.lit("// extra"), "text")).otherwise(F.concat(F.lit("-"), "text")))
    return files.leading_lines(lines, "// extra").groupBy("relative_path").agg(F.count("*").alias("n"))


@query(r"""SELECT o_orderkey, concat('a b|', o_orderkey, '|it\s|c"d') AS words FROM orders""".replace(r"\s", "''s"))
def s03_split_command(spark, sf_dir):
    text = F.concat(F.lit("'a b' "), F.col("o_orderkey"), F.lit("  it\\'s \"c\\\"d\""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(files.split_command(text), "|").alias("words"))
