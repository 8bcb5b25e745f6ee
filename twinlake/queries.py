"""The registered queries, one per operator, with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .fixtures import BENCH_SQL, CHECKSUM_SQL, CONTENTS_SQL, JOURNAL_SQL, QUICK_SQL, RUN_EVENTS_SQL, SNAPSHOTS_SQL, plan_sql
from .functions import paths
from .functions.globs import glob_match
from .operators import aggregates, blocks, compare, delta, filters, index, planning
from .plans import incremental, mirror
from .plans.options import Options
from .sources import buckets as bucketed
from .sources import listing, snapshots
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SLIM = ["path", "kind", "len", "mtime_s", "mtime_ns", "mode"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def over_snapshots(name: str, sql: str | None = None, more: str = "") -> Callable:
    """For functions of (source, destination)."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
        query(name, sql and f"WITH {SNAPSHOTS_SQL}{more and ', ' + more} {sql}")(lambda spark, d: f(fx.source(spark, d).drop("text"), fx.destination(spark, d).drop("text")))
        return f

    return add


def over_plan(name: str, sql: str | None = None, more: str = "") -> Callable:
    """For functions of the quick-check mirror plan."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        over_snapshots(name, sql, plan_sql() + (more and ", " + more))(lambda s, d: f(planning.mirror_plan(s, d)))
        return f

    return add


# Sources and sinks


@query("src1_scan_files")
def _(spark, d):
    return snapshots.scan_files(spark, d, "*.parquet", with_hash=True).select("path", "kind", "len", "hash")


_FOLDER = """coalesce(nullif({0}, ''), '__HIVE_DEFAULT_PARTITION__')"""


@query(
    "src1_listing",
    f"""WITH kept AS (SELECT 'source=' || {_FOLDER.format("source")} AS upper, 'lang=' || {_FOLDER.format("lang")} AS lower, coalesce(strlen(text), 0) + 1 AS bytes FROM documents)
SELECT upper || '/' || lower AS path, 'dir' AS kind, CAST(sum(bytes) AS BIGINT) AS bytes, true AS has_files FROM kept GROUP BY ALL
UNION ALL SELECT DISTINCT upper, 'dir', CAST(0 AS BIGINT), false FROM kept""",
)
def _(spark, d):
    """Every directory of a tree that Spark wrote, with the bytes of the files right in it; each file has a hidden one beside it, with its checksums."""
    root = f"{snapshots.shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    fx.table(spark, d, "documents").select("source", "lang", "text").write.partitionBy("source", "lang").text(root)
    found = listing.list_tree(spark, root, filters.rules_of(["- *_SUCCESS*"]))
    is_dir, hidden = F.col("kind") == "dir", F.substring_index("path", "/", -1).startswith(".")
    owner = F.when(is_dir, F.col("path")).otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
    inner = found.groupBy(owner.alias("path")).agg(
        F.max(F.when(is_dir, "dir")).alias("kind"), F.coalesce(F.sum(F.when(~is_dir & ~hidden, F.col("len"))), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(~is_dir & hidden).alias("hidden"), F.count_if(~is_dir & ~hidden).alias("files"),
    )
    return inner.where("kind IS NOT NULL").select("path", "kind", "bytes", ((F.col("files") > 0) & (F.col("files") == F.col("hidden"))).alias("has_files"))


@query("src2_normalize", f"WITH {SNAPSHOTS_SQL} SELECT replace(path, 'stale/', '') AS path, kind, CASE WHEN kind = 'file' THEN len ELSE 0 END AS len FROM dst WHERE kind IN ('file', 'dir', 'symlink')")
def _(spark, d):
    return snapshots.normalize_entries(fx.destination(spark, d), root="stale").select("path", "kind", "len")


@over_snapshots(
    "src3_directories",
    """SELECT path, kind, len(string_split(path, '/')) AS depth FROM (
  SELECT path, kind FROM src UNION ALL SELECT DISTINCT string_split(path, '/')[1], 'dir' FROM src UNION ALL SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], 'dir' FROM src) x""",
)
def _(s, d):
    return snapshots.with_directories(s).withColumn("depth", F.col("depth").cast("long"))


@query("src4_path_list", "SELECT trim(c_name) AS path FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0")
def _(spark, d):
    c = fx.table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("#"), "c_name")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return snapshots.path_list(c.select(text.alias("value")), max_lines=1_000_000_000)


@query("src5_table_entries", """SELECT CAST(o_orderkey AS VARCHAR) AS path, 'file' AS kind, sha256('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}') AS hash FROM orders""")
def _(spark, d):
    return snapshots.entries_from_table(fx.table(spark, d, "orders"), ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("src6_bench_csv", f"WITH {BENCH_SQL} SELECT 'warm' AS cache, scenario, tool, seconds, files, bytes, CASE WHEN seconds <> 0 THEN files / seconds END AS files_per_sec FROM bench")
def _(spark, d):
    """Benchmark rows written as CSV and read with their schema."""
    at = f"{snapshots.shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    rate = F.when(F.col("seconds") != 0, F.col("files") / F.col("seconds"))
    fx.bench_runs(spark, d).select(F.lit("warm").alias("cache"), "scenario", "tool", "seconds", "files", "bytes", rate.alias("files_per_sec"), F.lit(None).cast("double").alias("gib_per_sec"), F.lit("x").alias("filesystem")).write.option("header", True).csv(at)
    return snapshots.read_bench(spark, at).select("cache", "scenario", "tool", "seconds", "files", "bytes", "files_per_sec")


@over_snapshots("snk1_versions", "SELECT 1 AS number, path, len FROM dst UNION ALL SELECT 2, path, len FROM src UNION ALL SELECT 3, path, len FROM src WHERE len > 1000")
def _(s, d):
    """Three versions published one after the other, each read by its number."""
    spark, at = s.sparkSession, f"{snapshots.shared_dir(s.sparkSession)}/versions-{uuid.uuid4().hex}"
    for df in (d, s):
        snapshots.publish(df, at)
    snapshots.publish(snapshots.read_published(spark, at).where("len > 1000"), at, based_on=2)
    made = [snapshots.read_published(spark, at, n).select(F.lit(n).alias("number"), "path", "len") for n in (1, 2, 3)]
    return made[0].union(made[1]).union(made[2])


@over_snapshots("snk1_manifest", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS damaged FROM dst")
def _(s, d):
    """The manifest of a published version holds all of its rows, and none of its files is damaged."""
    spark, at = s.sparkSession, f"{snapshots.shared_dir(s.sparkSession)}/versions-{uuid.uuid4().hex}"
    version = snapshots.publish(d, at)
    return spark.read.parquet(f"{at}/m-{version}").agg(F.sum("rows").alias("rows")).withColumn("damaged", F.lit(snapshots.damaged(spark, at).count()).cast("long"))


# Filters


@over_snapshots("flt1_glob", "SELECT path, path LIKE '%1/en/%' OR path LIKE '%1/en' AS hit FROM src")
def _(s, d):
    return s.select("path", glob_match("path", "*1/en").alias("hit"))


@over_snapshots(
    "flt2_rules",
    "SELECT path FROM dst WHERE CASE WHEN path LIKE '%7.txt' THEN true WHEN path LIKE 'src1/%' OR path LIKE '%/src1/%' THEN false WHEN path LIKE '%/de/%' THEN true WHEN path LIKE '%.txt' AND path LIKE 'stale/%' THEN false ELSE true END",
)
def _(s, d):
    return filters.apply_rules(d, filters.rules_of(["+ *7.txt", "- src1"], ["de"], ["stale/*.txt"])).select("path")


#: A rule for each combination of words in `part` (at most 9,600, whatever its rows), first seen first.
_RULES_SQL = """named AS (SELECT p_brand AS brand, p_type AS type, replace(p_name, ' ', '_') AS name, min(p_partkey) AS k FROM part GROUP BY ALL), rules AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS n FROM named),
items AS (SELECT *, brand || '/' || type || '/' || name || '/' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS path FROM (
  SELECT l_orderkey, l_linenumber, p_brand AS brand, p_type AS type, replace(p_name, ' ', '_') AS name FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(paths of ordered parts, rules)"""
    words = [F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")]
    part, lines, k = fx.table(spark, d, "part"), fx.table(spark, d, "lineitem"), F.col("k")
    leaf = F.concat_ws("-", "l_orderkey", "l_linenumber")
    items = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("/", *words, leaf).alias("path"), F.lit("file").alias("kind"))
    rules = part.groupBy(*words).agg(F.min("p_partkey").alias("k")).select(
        k.alias("n"),
        F.concat(
            F.when(k % 3 == 0, "+ ").otherwise("- "),
            F.when(k % 4 == 0, F.concat_ws("/", "brand", "type", "name")).when(k % 4 == 1, F.concat(F.lit("**/"), "type", F.lit("/"), "name", F.lit("/*-"), (k % 7 + 1).cast("string")))
            .when(k % 4 == 2, F.concat("brand", F.lit("/*/"), "name", F.lit("/{?,??,???}-*"))).otherwise(F.concat("brand", F.lit("/[A-M]*/"), "name")),
        ).alias("rule"),
    )
    return items, rules


@query(
    "flt2_many_rules",
    f"""WITH {_RULES_SQL}, hits AS (
  SELECT path, min(n) AS n, arg_min(k % 3 = 0, n) AS stays FROM items i JOIN rules r ON i.name = r.name AND CASE r.k % 4
    WHEN 0 THEN i.brand = r.brand AND i.type = r.type WHEN 1 THEN i.type = r.type AND l_linenumber = r.k % 7 + 1
    WHEN 2 THEN i.brand = r.brand AND l_orderkey < 1000 ELSE i.brand = r.brand AND i.type < 'N' END GROUP BY ALL
) SELECT path, n AS rule, coalesce(stays, true) AS stays FROM items LEFT JOIN hits USING (path)""",
)
def _(spark, d):
    items, table = _items(spark, d)
    return filters.judged(items, filters.read_rules(table)).select("path", F.col("rule").cast("long").alias("rule"), "stays")


@query("flt3_allowlist", f"WITH {SNAPSHOTS_SQL} SELECT path FROM src WHERE path IN (SELECT path FROM dst WHERE mode = 33152)")
def _(spark, d):
    return filters.allowlist(fx.source(spark, d), fx.destination(spark, d).where("mode = 33152").select("path")).select("path")


@over_snapshots("flt4_reserved", "SELECT path FROM dst WHERE NOT (path = 'stale' OR path LIKE 'stale/%')")
def _(s, d):
    return filters.drop_reserved(d, "stale").select("path")


_UNSAFE_SQL = """risky AS (SELECT CASE doc_id % 5 WHEN 0 THEN '/' || source WHEN 1 THEN 'a/../' || source WHEN 2 THEN 'C:' || source ELSE source || '/x..y' END AS path,
  CASE WHEN doc_id % 10 = 3 THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN doc_id % 20 = 3 THEN '../up' WHEN doc_id % 10 = 3 THEN 'near' END AS target, doc_id FROM documents)"""


def _risky(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("doc_id"), F.col("source")
    path = F.when(n % 5 == 0, F.concat(F.lit("/"), s)).when(n % 5 == 1, F.concat(F.lit("a/../"), s)).when(n % 5 == 2, F.concat(F.lit("C:"), s)).otherwise(F.concat(s, F.lit("/x..y")))
    return fx.table(spark, d, "documents").select(path.alias("path"), F.when(n % 10 == 3, "symlink").otherwise("file").alias("kind"), F.when(n % 20 == 3, "../up").when(n % 10 == 3, "near").alias("target"), "doc_id")


@query("flt5_unsafe_paths", f"WITH {_UNSAFE_SQL} SELECT doc_id, path FROM risky WHERE doc_id % 5 IN (3, 4) AND coalesce(target, '') <> '../up'")
def _(spark, d):
    return filters.split_unsafe(_risky(spark, d))[0].select("doc_id", "path")


@query("flt6_unsafe_targets", f"WITH {_UNSAFE_SQL} SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'unsafe path' ELSE 'unsafe symlink target' END AS error FROM risky WHERE doc_id % 5 < 3 OR target = '../up'")
def _(spark, d):
    return filters.split_unsafe(_risky(spark, d))[1].select("doc_id", "error")


_LIVE_SAME = "d.path IS NOT NULL AND s.kind = d.kind AND s.dev = d.dev AND s.ino = d.ino AND (s.kind <> 'file' OR s.len = d.len) AND s.mtime_s = d.mtime_s AND s.mtime_ns = d.mtime_ns AND (s.mode & 4095) = (d.mode & 4095)"


@over_snapshots("flt7_drift", f"SELECT s.path FROM src s LEFT JOIN dst d ON s.path = d.path WHERE NOT ({_LIVE_SAME})")
def _(s, d):
    return filters.drifted(s, d).select("path")


# Planning


@over_snapshots("pln1_plan", f"SELECT path, action FROM plan WHERE action <> 'delete'", plan_sql())
def _(s, d):
    return planning.build_plan(s, d).select("path", "action")


@over_snapshots("pln2_quick_check", f"SELECT s.path, {QUICK_SQL} AS differs FROM src s JOIN dst d ON s.path = d.path WHERE d.kind = 'file'")
def _(s, d):
    both = s.alias("s").join(d.where("kind = 'file'").alias("d"), F.col("s.path") == F.col("d.path"))
    return both.select("s.path", planning.content_differs(False).alias("differs"))


@over_snapshots("pln3_checksum", "SELECT path, action FROM plan WHERE action <> 'delete'", plan_sql(CHECKSUM_SQL))
def _(s, d):
    return planning.build_plan(s, d, checksum=True).select("path", "action")


@over_snapshots("pln4_kinds", "SELECT s.path FROM src s JOIN dst d ON s.path = d.path WHERE s.kind <> d.kind")
def _(s, d):
    both = s.select("path", F.col("kind").alias("was")).join(planning.build_plan(d, s), "path")
    return both.where("action = 'update' AND was != kind").select("path")


_KINDS = f"{SNAPSHOTS_SQL}, {fx.all_kinds_sql()}"
_KINDS_PLAN = """kinds_plan AS (SELECT coalesce(s.path, d.path) AS path, coalesce(s.kind, d.kind) AS kind, CASE WHEN s.path IS NULL THEN 'delete' WHEN d.path IS NULL THEN 'copy' WHEN s.kind <> d.kind THEN 'update'
  WHEN s.kind = 'dir' THEN CASE WHEN (s.mode & 4095) <> (d.mode & 4095) OR s.mtime_s <> d.mtime_s THEN 'update' ELSE 'skip' END WHEN s.kind = 'symlink' THEN CASE WHEN s.target <> d.target OR s.mtime_s <> d.mtime_s THEN 'update' ELSE 'skip' END
  WHEN s.len <> d.len OR (s.mode & 4095) <> (d.mode & 4095) OR s.mtime_s <> d.mtime_s THEN 'update' ELSE 'skip' END AS action FROM src2 s FULL OUTER JOIN dst2 d ON s.path = d.path)"""


@query("pln4_all_kinds", f"WITH {_KINDS}, {_KINDS_PLAN} SELECT path, kind, action FROM kinds_plan")
def _(spark, d):
    return planning.mirror_plan(*fx.all_kinds(spark, d)).select("path", "kind", "action")


@query("pln10_empty_guard", f"WITH {SNAPSHOTS_SQL} SELECT string_split(path, '/')[1] AS dir, count(*) FILTER (mode <> 33188) = 0 AS refused FROM dst GROUP BY 1")
def _(spark, d):
    """For each top directory, whether a mirror with deletions of its re-moded entries alone would be refused as empty."""
    made, dst = [], fx.destination(spark, d).withColumn("dir", F.substring_index("path", "/", 1))
    for r in dst.groupBy("dir").agg(F.count_if(F.col("mode") != 33188).alias("n")).orderBy("dir").collect():  # a row for each top directory
        few = dst.where((F.col("dir") == r["dir"]) & (F.col("mode") != 33188)).limit(r["n"] and 1)
        try:
            planning.guard_empty(few, delete=True)
            made.append((r["dir"], False))
        except planning.EmptySourceError:
            made.append((r["dir"], True))
    return spark.createDataFrame(made, "dir string, refused boolean")


@over_snapshots("pln5_deletions", "SELECT path FROM dst WHERE path NOT IN (SELECT path FROM src)")
def _(s, d):
    return planning.deletions(s, d).select("path")


@over_plan("pln6_mirror_plan", "SELECT path, kind, len, action FROM plan")
def _(plan):
    return plan.select("path", "kind", "len", "action")


@over_snapshots(
    "pln7_links",
    """SELECT p.path, CASE WHEN f.first IS NOT NULL AND p.path <> f.first AND coalesce(d.ino, -1) <> coalesce(fd.ino, -1) THEN 'update' ELSE p.action END AS action
FROM plan p LEFT JOIN dst d ON p.path = d.path
LEFT JOIN (SELECT ino, array_to_string(min(string_split(path, '/')), '/') AS first FROM src GROUP BY ino HAVING count(*) > 1) f ON p.ino = f.ino
LEFT JOIN dst fd ON fd.path = f.first WHERE p.action <> 'delete'""",
    plan_sql(),
)
def _(s, d):
    return planning.enforce_links(planning.build_plan(s, d), d).select("path", "action")


_INDEX_SAME = "s.len = d.len AND s.mtime_s = d.mtime_s AND s.mtime_ns = d.mtime_ns AND (s.mode & 4095) = (d.mode & 4095) AND s.kind = d.kind"


@over_snapshots("pln8_from_index", f"SELECT s.path, CASE WHEN d.path IS NULL THEN 'copy' WHEN {_INDEX_SAME} AND s.hash = d.hash THEN 'skip' ELSE 'update' END AS action FROM src s LEFT JOIN dst d ON s.path = d.path")
def _(s, d):
    return planning.plan_from_index(s, d, live=d, checksum=True).select("path", "action")


@over_snapshots(
    "pln9_transfer",
    "SELECT s.path, CASE WHEN d.kind = 'file' AND s.len = d.len AND s.mtime_s = d.mtime_s AND s.mtime_ns = d.mtime_ns THEN 'skip' WHEN d.kind = 'file' THEN 'delta' ELSE 'whole' END AS transfer FROM src s LEFT JOIN dst d ON s.path = d.path",
)
def _(s, d):
    return planning.transfer_plan(s, d).select("path", "transfer")


@query("pln11_pull", f"WITH {SNAPSHOTS_SQL} SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'delete' WHEN s.path IS NULL THEN 'copy' WHEN s.kind <> d.kind OR {QUICK_SQL} THEN 'update' ELSE 'skip' END AS action FROM src s FULL OUTER JOIN dst d ON s.path = d.path")
def _(spark, d):
    return planning.mirror_plan(fx.destination(spark, d).drop("text"), fx.source(spark, d).drop("text")).select("path", "action")


@query(
    "pln6_table_mirror",
    """WITH dst AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 = 1)
SELECT CAST(coalesce(s.o_orderkey, d.o_orderkey) AS VARCHAR) AS path, CASE WHEN s.o_orderkey IS NULL THEN 'delete' WHEN d.o_orderkey IS NULL THEN 'copy' WHEN s.o_totalprice <> d.p THEN 'update' ELSE 'skip' END AS action
FROM orders s FULL OUTER JOIN dst d ON s.o_orderkey = d.o_orderkey""",
)
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    other = o.where("o_orderkey % 7 != 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    other = other.union(o.where("o_orderkey % 50 = 1").select(-F.col("o_orderkey"), "o_totalprice"))
    fill = {"len": "long", "mtime_s": "long", "mtime_ns": "int", "mode": "int"}
    a, b = (snapshots.entries_from_table(x, ["o_orderkey"], ["o_totalprice"]).select("*", *[F.lit(0).cast(t).alias(c) for c, t in fill.items()], F.lit(None).cast("string").alias("target")) for x in (o, other))
    return planning.mirror_plan(a, b, checksum=True).select("path", "action")


# Aggregations


@over_plan("agg1_plan_summary", "SELECT count(*) FILTER (action = 'copy') AS copies, count(*) FILTER (action = 'update') AS updates, count(*) FILTER (action = 'skip') AS skips, count(*) FILTER (action = 'delete') AS deletions, count(*) FILTER (action IN ('copy', 'update')) AS files_to_transfer, CAST(sum(CASE WHEN action IN ('copy', 'update') THEN len ELSE 0 END) AS BIGINT) AS bytes_to_transfer FROM plan")
def _(plan):
    return aggregates.plan_summary(plan)


_STATS_SQL = "count(*) FILTER (event = 'done' AND action = 'copy') AS copied, count(*) FILTER (event = 'done' AND action = 'update') AS updated, count(*) FILTER (event = 'done' AND action = 'skip') AS skipped, count(*) FILTER (event = 'done' AND action = 'delete') AS deleted, count(*) FILTER (event = 'error') AS errors"


@query("agg2_run_stats", f"WITH {RUN_EVENTS_SQL} SELECT run_id, {_STATS_SQL}, CAST(sum(CASE WHEN action IN ('copy', 'update') THEN bytes ELSE 0 END) AS BIGINT) AS bytes FROM re GROUP BY run_id")
def _(spark, d):
    return aggregates.run_stats(fx.run_events(spark, d))


@query("agg3_run_summary", f"WITH {BENCH_SQL} SELECT scenario, tool, count(*) AS runs, median(seconds) AS median, round(avg(seconds), 6) AS mean, round(stddev_pop(seconds), 6) AS pstdev, min(seconds) AS min, round(quantile_cont(seconds, 0.95), 6) AS p95 FROM bench GROUP BY scenario, tool")
def _(spark, d):
    out = aggregates.summarize_runs(fx.bench_runs(spark, d), ["scenario", "tool"], "seconds")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "pstdev", "p95")})


@query("agg4_speedup", f"WITH {BENCH_SQL}, m AS (SELECT scenario, tool, median(seconds) AS median FROM bench GROUP BY scenario, tool) SELECT a.scenario, a.tool, round(b.median / nullif(a.median, 0), 6) AS speedup FROM m a JOIN m b ON a.scenario = b.scenario WHERE b.tool = 'F' AND a.tool <> 'F'")
def _(spark, d):
    return aggregates.speedup(fx.bench_runs(spark, d), "F").withColumn("speedup", F.round("speedup", 6))


@query("agg5_throughput", f"WITH {BENCH_SQL} SELECT bytes, round(CASE WHEN seconds <> 0 THEN files / seconds ELSE 0 END, 6) AS files_per_sec, round(CASE WHEN seconds <> 0 THEN bytes / 1073741824.0 / seconds ELSE 0 END, 6) AS gib_per_sec FROM bench")
def _(spark, d):
    return aggregates.throughput(fx.bench_runs(spark, d)).select("bytes", F.round("files_per_sec", 6).alias("files_per_sec"), F.round("gib_per_sec", 6).alias("gib_per_sec"))


@over_plan("agg6_workload", "SELECT count(*) AS files, max(CASE WHEN k = n // 2 THEN len END) AS upper_median, count(*) >= 4096 AND max(CASE WHEN k = n // 2 THEN len END) < 65536 AS many_small FROM (SELECT len, row_number() OVER (ORDER BY len) - 1 AS k, count(*) OVER () AS n FROM plan WHERE action IN ('copy', 'update')) x")
def _(plan):
    return aggregates.workload_profile(plan).drop("reason")


@over_snapshots("agg7_tree_bytes", "SELECT string_split(path, '/')[1] AS dir, CAST(sum(len) AS BIGINT) AS bytes, count(*) AS files FROM src GROUP BY 1")
def _(s, d):
    return aggregates.tree_bytes(s, 1)


@over_snapshots("agg7_all_dirs", "SELECT dir, CAST(sum(len) AS BIGINT) AS bytes, count(*) AS files FROM (SELECT len, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS dir FROM dst WHERE kind = 'file') x GROUP BY dir")
def _(s, d):
    return aggregates.all_tree_bytes(d)


@over_plan("agg8_touched_dirs", "SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM plan WHERE action <> 'skip' UNION SELECT ''")
def _(plan):
    return aggregates.touched_dirs(plan)


@over_snapshots("agg9_link_groups", "SELECT dev, ino, count(*) AS members, array_to_string(min(string_split(path, '/')), '/') AS first_path FROM src GROUP BY dev, ino HAVING count(*) > 1")
def _(s, d):
    return aggregates.link_groups(s)


# Windows and sorts


@query("win2_canonical", f"WITH {SNAPSHOTS_SQL} SELECT path, first_value(path) OVER (PARTITION BY dev, ino ORDER BY string_split(path, '/')) AS canonical FROM src")
def _(spark, d):
    return planning.canonical_members(fx.source(spark, d)).select("path", "canonical")


@query("win3_latest_change", f"WITH {JOURNAL_SQL} SELECT path, seq, op, record FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM journal) x WHERE r = 1")
def _(spark, d):
    return index.latest_by_rank(fx.journal(spark, d)).select("path", "seq", "op", "record")


@query("win4_phase_timings", f"WITH {RUN_EVENTS_SQL}, p AS (SELECT run_id, phase, seq, (epoch_us(lead(ts) OVER (PARTITION BY run_id ORDER BY seq)) - epoch_us(ts)) // 1000 AS ms FROM re WHERE event = 'phase') SELECT run_id, phase, arg_max(ms, seq) AS ms FROM p WHERE ms IS NOT NULL GROUP BY run_id, phase")
def _(spark, d):
    return aggregates.phase_timings(fx.run_events(spark, d))


@query("win5_progress", f"WITH {RUN_EVENTS_SQL} SELECT run_id, seq, count(*) OVER w AS files_done, CAST(sum(bytes) OVER w AS BIGINT) AS bytes_done, round(least(1.0, CAST(count(*) OVER w AS DOUBLE) / count(*) OVER (PARTITION BY run_id)), 9) AS file_ratio, round(least(1.0, CAST(sum(bytes) OVER w AS DOUBLE) / sum(bytes) OVER (PARTITION BY run_id)), 9) AS byte_ratio FROM re WHERE event = 'done' WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return aggregates.progress(fx.run_events(spark, d)).withColumns({c: F.round(c, 9) for c in ("file_ratio", "byte_ratio")})


@over_snapshots("srt1_path_order", "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM src")
def _(s, d):
    return compare.places(s.select("path"), paths.components("path"))


@over_snapshots("srt2_deepest_first", "SELECT path, row_number() OVER (ORDER BY string_split(path, '/') DESC) AS place FROM dst WHERE path NOT IN (SELECT path FROM src)")
def _(s, d):
    return compare.places(d.select("path").join(s.select("path"), "path", "left_anti"), paths.components("path"), down=True)


@over_plan(
    "srt3_apply_order",
    """SELECT path, phase, depth, row_number() OVER (ORDER BY phase, CASE WHEN phase = 4 THEN -depth ELSE depth END, string_split(path, '/')) AS place FROM (
  SELECT p.path, CASE WHEN action = 'delete' THEN 4 WHEN g.first IS NOT NULL AND p.path <> g.first THEN 2 ELSE 1 END AS phase, len(string_split(p.path, '/')) AS depth
  FROM plan p LEFT JOIN (SELECT ino, array_to_string(min(string_split(path, '/')), '/') AS first FROM plan WHERE action <> 'delete' GROUP BY ino HAVING count(*) > 1) g ON p.ino = g.ino) x""",
)
def _(plan):
    ordered = compare.places(planning.apply_phases(plan), *planning.apply_keys())
    return ordered.select("path", F.col("phase").cast("int").alias("phase"), F.col("depth").cast("long").alias("depth"), "place")


@query("srt4_log_tail", f"WITH {RUN_EVENTS_SQL} SELECT run_id, seq, path FROM re WHERE event = 'done' AND contains(path, 'purchase') ORDER BY seq DESC LIMIT 50")
def _(spark, d):
    return aggregates.log_tail(fx.run_events(spark, d), "done", "purchase", 50).select("run_id", "seq", "path")


# Sets and verification


@over_snapshots("set1_path_diff", "SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'left' ELSE 'right' END AS side FROM src s FULL OUTER JOIN dst d ON s.path = d.path WHERE s.path IS NULL OR d.path IS NULL")
def _(s, d):
    return compare.path_diff(s, d)


def _verify_sql(time: str, owner: str = "") -> str:
    return f"""verified AS (SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing from destination' WHEN s.path IS NULL THEN 'extra in destination' WHEN s.kind <> d.kind THEN 'file kind differs'
  WHEN (s.mode & 4095) <> (d.mode & 4095) THEN 'mode differs' WHEN {time} THEN 'mtime differs' {owner} WHEN s.len <> d.len OR s.hash <> d.hash THEN 'content differs' END AS detail FROM src s FULL OUTER JOIN dst d ON s.path = d.path)"""


_EXACT = "s.mtime_s <> d.mtime_s OR s.mtime_ns <> d.mtime_ns"


@over_snapshots("set2_parity", "SELECT path, detail FROM verified WHERE detail IS NOT NULL", _verify_sql("abs((s.mtime_s - d.mtime_s) * 1000000000 + s.mtime_ns - d.mtime_ns) > 1000000000"))
def _(s, d):
    return compare.parity(s, d)


@over_snapshots("vfy1_first_difference", "SELECT path, detail FROM verified WHERE detail IS NOT NULL AND detail <> 'extra in destination'", _verify_sql(_EXACT, "WHEN s.uid <> d.uid THEN 'uid differs' WHEN s.gid <> d.gid THEN 'gid differs'"))
def _(s, d):
    return compare.verify(s, d, "source", owner=True, group=True)


@over_snapshots("vfy2_changed_scope", "SELECT v.path, v.detail FROM verified v JOIN plan p ON v.path = p.path WHERE v.detail IS NOT NULL AND p.action IN ('copy', 'update')", _verify_sql(_EXACT) + ", " + plan_sql())
def _(s, d):
    return compare.verify(s, d, "changed", planning.build_plan(s, d))


@over_snapshots("vfy3_extras", "SELECT path, detail FROM verified WHERE detail IS NOT NULL", _verify_sql(_EXACT))
def _(s, d):
    return compare.verify(s, d, "all")


@over_snapshots(
    "vfy4_links",
    """SELECT s.path, 'hard-link identity differs' AS detail FROM src s JOIN (SELECT ino, array_to_string(min(string_split(path, '/')), '/') AS first FROM src GROUP BY ino HAVING count(*) > 1) g ON s.ino = g.ino
LEFT JOIN dst d ON s.path = d.path LEFT JOIN dst f ON g.first = f.path WHERE s.path <> g.first AND coalesce(d.ino, -1) <> coalesce(f.ino, -1)""",
)
def _(s, d):
    return compare.verify_links(s, d)


@over_snapshots("vfy5_summary", "SELECT detail, count(*) AS mismatches, (SELECT count(*) FROM src) AS checked FROM verified WHERE detail IS NOT NULL GROUP BY detail", _verify_sql(_EXACT))
def _(s, d):
    return compare.verify_summary(s, compare.verify(s, d, "all"))


# Scalars


@query("scl1_block_size", "SELECT doc_id, CAST(greatest(700, least(131072, round(sqrt(strlen(text) * 1000)))) AS INTEGER) AS block FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", paths.block_size_for(F.octet_length("text") * 1000).alias("block"))


@over_snapshots("scl2_modes", "SELECT path, mode & 4095 AS bits, (mode + 3072) & 1023 AS safe FROM dst")
def _(s, d):
    return d.select("path", paths.mode_bits("mode").alias("bits"), paths.safe_mode(F.col("mode") + 3072).alias("safe"))


@over_snapshots("scl3_path_parts", "SELECT path, regexp_replace(path, '/?[^/]*$', '') AS parent, string_split(path, '/')[-1] AS base, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM dst")
def _(s, d):
    return d.select("path", paths.parent("path").alias("parent"), paths.basename("path").alias("base"), paths.depth("path").alias("depth"))


@query("scl4_strong_hash", "SELECT doc_id, substr(sha256(text), 1, 32) AS strong FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", paths.strong_hash("text").alias("strong"))


# Block delta of all files at both sides

_DELTA = f"WITH RECURSIVE {SNAPSHOTS_SQL}, {CONTENTS_SQL}, {fx.delta_sql()}"


@query("dlt1_signature", f"WITH {SNAPSHOTS_SQL}, {CONTENTS_SQL} SELECT path, CAST(b AS INTEGER) AS block_idx, substr(sha256(unhex(substr(hex(old), 1400 * b + 1, 1400))), 1, 32) AS strong FROM (SELECT path, old, unnest(range(0, CAST(ceil(strlen(old) / 700.0) AS BIGINT))) AS b FROM pairs) x")
def _(spark, d):
    return delta.signature(fx.contents(spark, d)[0]).select("path", "block_idx", "strong")


@query("dlt1_weak", f"{_DELTA} SELECT path, CAST(block_idx AS INTEGER) AS block_idx, CAST(len AS INTEGER) AS len, weak FROM blocks")
def _(spark, d):
    return delta.signature(fx.contents(spark, d)[0]).select("path", "block_idx", "len", "weak")


@query("dlt1_auto_blocks", f"WITH {SNAPSHOTS_SQL}, {CONTENTS_SQL}, sized AS (SELECT path, strlen(old) AS n, greatest(700, least(131072, CAST(round(sqrt(strlen(old))) AS BIGINT))) AS size FROM pairs) SELECT path, CAST(size AS INTEGER) AS block_size, (n + size - 1) // size AS blocks, (n - 1) % size + 1 AS last_len FROM sized WHERE n > 0")
def _(spark, d):
    sig = delta.signature(fx.contents(spark, d)[0], None)
    return sig.groupBy("path", "block_size").agg(F.count("*").alias("blocks"), F.max_by("len", "block_idx").cast("long").alias("last_len"))


@query("win1_rolling_checksum", f"{_DELTA} SELECT path, count(*) AS windows, CAST(sum(weak) AS BIGINT) AS weak_sum, CAST(sum((pos + 1) * (weak % 1009)) AS BIGINT) AS placed FROM wins GROUP BY path")
def _(spark, d):
    placed = (F.col("pos") + 1) * F.pmod("weak", F.lit(1009))
    return delta.windows(fx.contents(spark, d)[1]).groupBy("path").agg(F.count("*").alias("windows"), F.sum("weak").alias("weak_sum"), F.sum(placed).alias("placed"))


@query("dlt3_matches", f"{_DELTA} SELECT path, CAST(pos AS INTEGER) AS pos, CAST(block_idx AS INTEGER) AS block_idx FROM cand")
def _(spark, d):
    old, new = fx.contents(spark, d)
    return delta.match_blocks(new, snapshots.keep(delta.signature(old), "signature")).select("path", "pos", "block_idx")


@query("dlt4_selected", f"{_DELTA} SELECT path, CAST(pos AS INTEGER) AS pos, CAST(block_idx AS INTEGER) AS block_idx FROM chosen")
def _(spark, d):
    old, new = fx.contents(spark, d)
    return delta.select_matches(delta.match_blocks(new, snapshots.keep(delta.signature(old), "signature"))).select("path", "pos", "block_idx")


@query("dlt5_tails", f"WITH RECURSIVE {SNAPSHOTS_SQL}, {CONTENTS_SQL}, {fx.delta_sql('new', chr(39) + '12345' + chr(39) + ' || new')} SELECT path, CAST(pos AS INTEGER) AS pos, CAST(block_idx AS INTEGER) AS block_idx FROM tails")
def _(spark, d):
    old = fx.contents(spark, d)[1]
    new = old.select("path", F.concat(F.lit(b"12345"), "content").alias("content"))
    sig = snapshots.keep(delta.signature(old), "signature")
    return delta.tail_match(new, delta.select_matches(delta.match_blocks(new, sig)), sig)


@query("dlt6_ops", f"{_DELTA} SELECT path, op_seq, op, block_idx, n FROM ops")
def _(spark, d):
    return delta.encode(*fx.contents(spark, d)).select("path", "op_seq", "op", "block_idx", F.octet_length("bytes").alias("n"))


@query("dlt7_rebuilt", f"WITH {SNAPSHOTS_SQL}, {CONTENTS_SQL} SELECT path, sha256(new) AS hash FROM pairs")
def _(spark, d):
    old, new = fx.contents(spark, d)
    return delta.apply_delta(old, delta.encode(old, new, None), None).select("path", F.sha2("content", 256).alias("hash"))


@query("dlt8_rejected", f"WITH {SNAPSHOTS_SQL}, {CONTENTS_SQL}, asked AS (SELECT path, strlen(old) AS n, strlen(new) % 7 AS b FROM pairs) SELECT path, 'copy block ' || CAST(b AS VARCHAR) || ' out of range' AS error FROM asked WHERE b * 700 >= n AND NOT (b = 0 AND n = 0)")
def _(spark, d):
    old, new = fx.contents(spark, d)
    block = F.pmod(F.octet_length("content"), F.lit(7)).cast("int")
    ops = new.select("path", F.lit(0).alias("op_seq"), F.lit("copy").alias("op"), block.alias("block_idx"), F.lit(None).cast("binary").alias("bytes"))
    return delta.split_ops(old, ops)[1]


@query("dlt9_stats", f"{_DELTA} SELECT path, CAST(coalesce(sum(n), 0) AS BIGINT) AS literal_bytes, count(*) FILTER (op = 'copy') AS copies, count(*) FILTER (op = 'literal') AS literals, CAST(count(*) FILTER (op = 'copy') AS DOUBLE) / count(*) AS reuse FROM ops GROUP BY path")
def _(spark, d):
    return delta.delta_stats(delta.encode(*fx.contents(spark, d)))


# The same of long contents, in pieces: one for each source

_LONG = f"WITH RECURSIVE {fx.LONG_SQL}, {fx.delta_sql()}"


@query("dlt1_long", f"WITH {fx.LONG_SQL} SELECT path, b AS block_idx, substr(sha256(unhex(substr(hex(old), 1400 * b + 1, 1400))), 1, 32) AS strong FROM (SELECT path, old, unnest(range(0, CAST(ceil(strlen(old) / 700.0) AS BIGINT))) AS b FROM pairs) x")
def _(spark, d):
    old = fx.long_contents(spark, d)[0]
    return blocks.signature(old, blocks.sizes_of(old)).select("path", "block_idx", "strong")


@query("dlt4_long", f"{_LONG} SELECT path, pos, block_idx, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS seq FROM chosen")
def _(spark, d):
    return blocks.matches(*fx.long_contents(spark, d)).select("path", "pos", "block_idx", "seq")


@query("dlt6_long", f"{_LONG} SELECT path, CAST(coalesce(sum(n), 0) AS BIGINT) AS literal_bytes, count(*) FILTER (op = 'copy') AS copies FROM ops GROUP BY path")
def _(spark, d):
    ops = blocks.encode(*fx.long_contents(spark, d))
    return ops.groupBy("path").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).cast("long").alias("literal_bytes"), F.count_if(F.col("op") == "copy").alias("copies"))


@query("dlt7_long", f"WITH {fx.LONG_SQL}, parts AS (SELECT path, new, strlen(new) AS n, unnest(range(0, CAST(ceil(strlen(new) / 65536.0) AS BIGINT))) AS part FROM pairs) SELECT path, part, least(65536, n - 65536 * part) AS len, substr(sha256(unhex(substr(hex(new), 131072 * part + 1, 131072))), 1, 32) AS hash FROM parts")
def _(spark, d):
    old, new = fx.long_contents(spark, d)
    return blocks.digests(blocks.rebuild(old, blocks.encode(old, new, None), None))


# Index


@over_plan("idx1_build", "SELECT path, kind, len, 3 AS version FROM plan WHERE action <> 'delete'")
def _(plan):
    return index.build_index(plan).select("path", "kind", "len", "version")


@query("idx2_load", f"WITH {JOURNAL_SQL}, last AS (SELECT path, arg_max(op, seq) AS op, arg_max(record, seq) AS record FROM valid GROUP BY path) SELECT coalesce(c.c_custkey, l.path) AS path, CASE WHEN l.op = 'upsert' THEN l.record ELSE c.c_name END AS record FROM customer c FULL OUTER JOIN last l ON c.c_custkey = l.path WHERE l.op IS NULL OR l.op <> 'delete'")
def _(spark, d):
    snapshot = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("record"))
    return index.load_index(snapshot, fx.journal(spark, d))


@query("idx3_valid_prefix", f"WITH {JOURNAL_SQL} SELECT seq, op, path, record FROM valid")
def _(spark, d):
    return index.valid_prefix(fx.journal(spark, d)).select("seq", "op", "path", "record")


@over_snapshots("idx4_journal_records", "SELECT path, CASE WHEN action = 'delete' THEN 'delete' ELSE 'upsert' END AS op FROM plan WHERE action IN ('copy', 'update') OR (action = 'delete' AND path LIKE '%1.txt')", plan_sql())
def _(s, d):
    return index.journal_records(planning.mirror_plan(s, d), d.where("path LIKE '%1.txt'")).select("path", "op")


@over_snapshots("idx5_compacted", f"SELECT path, kind, len, mtime_ns, mode FROM src", plan_sql())
def _(s, d):
    """The destination's index, two rounds of changes behind it (the first is overruled), and compaction."""
    at = f"{snapshots.shared_dir(s.sparkSession)}/index-{uuid.uuid4().hex}"
    index.save_index(index.build_index(d), at)
    plan = planning.mirror_plan(s, d)
    turned = plan.where("action = 'skip'").select("path", F.lit("delete").alias("op"), F.lit("").alias("record"))
    index.append_journal(turned, at)
    index.append_journal(index.as_records(s).select("path", F.lit("upsert").alias("op"), "record"), at)
    index.append_journal(index.journal_records(plan, d).where("op = 'delete'"), at)
    index.compact(s.sparkSession, at)
    return index.try_load_index(s.sparkSession, at).select("path", "kind", "len", "mtime_ns", "mode")


_VERSIONED = "s.kind = d.kind AND s.len = d.len AND s.mtime_s = d.mtime_s AND s.mtime_ns = d.mtime_ns AND (s.mode & 4095) = (d.mode & 4095)"


@over_snapshots(
    "idx6_versions",
    f"SELECT coalesce(s.path, d.path) AS path, v.version, CASE WHEN s.path IS NULL THEN 'delete' WHEN d.path IS NULL THEN 'copy' WHEN v.version = 3 AND {_VERSIONED} THEN 'skip' WHEN v.version = 2 AND s.kind = d.kind AND NOT ({QUICK_SQL}) THEN 'skip' ELSE 'update' END AS action FROM src s FULL OUTER JOIN dst d ON s.path = d.path CROSS JOIN (VALUES (2), (3)) v(version)",
)
def _(s, d):
    """Plans by an index of another version (a full plan) and by one of this version (recorded state, in nanoseconds)."""
    spark, made = s.sparkSession, []
    for version in (2, 3):
        at = f"{snapshots.shared_dir(spark)}/index-{uuid.uuid4().hex}"
        index.save_index(index.build_index(d).withColumn("version", F.lit(version)), at)
        known = index.try_load_index(spark, at)
        plan = planning.mirror_plan(s, d) if known is None else planning.indexed_plan(s, d, known)
        made.append(plan.select("path", F.lit(version).alias("version"), "action"))
    return made[0].union(made[1])


@query("str8_merge", f"WITH {JOURNAL_SQL} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(record, seq) AS record FROM journal GROUP BY path")
def _(spark, d):
    j = fx.journal(spark, d).drop("checksum")
    return index.merge_changes(index.latest(j.where("seq % 2 = 0")), j.where("seq % 2 = 1")).select("path", "seq", "op", "record")


# Apply


def _approved() -> Options:
    return Options(delete=True, yes=True, preserve=frozenset({"mode", "mtime", "owner", "group"}))


@over_snapshots("apl1_mirror", "SELECT path, kind, len, mtime_s FROM src")
def _(s, d):
    return mirror.mirror(s, d, _approved())[1].select("path", "kind", "len", "mtime_s")


@over_snapshots("apl1_buckets", "SELECT path, kind, len, mtime_s FROM src")
def _(s, d):
    """The destination published in buckets, the plan's changes merged into those that they touch."""
    spark, at = s.sparkSession, f"{snapshots.shared_dir(s.sparkSession)}/buckets-{uuid.uuid4().hex}"
    bucketed.publish_buckets(d, at, buckets=16)
    bucketed.apply_changes(planning.mirror_plan(s, d), at, _approved())
    return bucketed.read_buckets(spark, at).select("path", "kind", "len", "mtime_s")


@query("apl4_all_kinds", f"WITH {_KINDS} SELECT path, kind, CASE WHEN kind <> 'symlink' THEN mode & 4095 END AS bits, mtime_s, target FROM src2")
def _(spark, d):
    """A mirror with directories and symlinks leaves what the source has; a plan does not look at modes of symlinks."""
    bits = F.when(F.col("kind") != "symlink", paths.mode_bits("mode"))
    return mirror.mirror(*fx.all_kinds(spark, d), _approved())[1].select("path", "kind", bits.alias("bits"), "mtime_s", "target")


@over_snapshots(
    "apl7_outcome",
    f"SELECT CASE WHEN m.n + e.n = 0 THEN 'success' ELSE 'failed' END AS status, m.n AS mismatches, e.n AS errors, false AS persist_index, (SELECT count(*) FROM plan WHERE action = 'delete') AS deletions FROM (SELECT count(*) AS n FROM verified WHERE detail IS NOT NULL) m, (SELECT count(*) AS n FROM src WHERE mtime_s % 29 = 0) e",
    _verify_sql(_EXACT) + ", " + plan_sql(),
)
def _(s, d):
    """The outcome of a run whose verification finds the two sides different and which could not read some files."""
    plan, errors = planning.mirror_plan(s, d), s.where("mtime_s % 29 = 0").select("path", F.lit("unreadable source").alias("error"))
    run = mirror.finish(plan, compare.verify(s, d, "all"), errors, _approved())
    return s.sparkSession.createDataFrame([(run.status, run.mismatches, run.errors, run.persist_index, run.stats["deletions"])], "status string, mismatches long, errors long, persist_index boolean, deletions long")


@over_snapshots("apl2_dry_run", "SELECT CASE WHEN action = 'delete' THEN 'deleted' ELSE 'planned' END AS event, path, action, CASE WHEN kind = 'file' AND action IN ('copy', 'update') THEN len ELSE 0 END AS bytes FROM plan", plan_sql())
def _(s, d):
    return mirror.dry_run(s, d, Options(delete=True, yes=True))[1].select("event", "path", "action", "bytes")


@over_snapshots("apl2_dry_stats", "SELECT count(*) FILTER (action = 'copy') AS copied, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'delete') AS deleted, CAST(sum(CASE WHEN kind = 'file' AND action IN ('copy', 'update') THEN len ELSE 0 END) AS BIGINT) AS bytes FROM plan", plan_sql())
def _(s, d):
    return mirror.dry_run(s, d, Options(delete=True, yes=True))[0]


@over_snapshots("pln11_requested", "SELECT path, 'not found at the source' AS error FROM dst WHERE path NOT IN (SELECT path FROM src)")
def _(s, d):
    return planning.requested(s, d)[1]


@over_snapshots("apl3_deletes_kept", "SELECT path FROM src UNION SELECT path FROM dst")
def _(s, d):
    return mirror.mirror(s, d, Options())[1].select("path")


@over_snapshots("apl4_attributes", "SELECT p.path, CASE WHEN p.action = 'skip' THEN d.mode WHEN d.mode IS NOT NULL THEN d.mode ELSE p.mode & 1023 END AS mode, CASE WHEN p.action = 'skip' THEN d.mtime_s ELSE p.mtime_s END AS mtime_s FROM (SELECT s.path, s.mode, s.mtime_s, q.action FROM src s JOIN plan q ON s.path = q.path) p LEFT JOIN dst d ON p.path = d.path", plan_sql())
def _(s, d):
    return mirror.mirror(s, d, Options(delete=True, yes=True, preserve=frozenset({"mtime"})))[1].select("path", "mode", "mtime_s")


@over_plan("apl5_links", "SELECT p.path, CASE WHEN p.path <> g.first THEN g.first END AS link_to, CASE WHEN p.path <> g.first OR p.kind <> 'file' THEN 0 ELSE len END AS bytes FROM plan p LEFT JOIN (SELECT ino, array_to_string(min(string_split(path, '/')), '/') AS first FROM plan WHERE action <> 'delete' GROUP BY ino HAVING count(*) > 1) g ON p.ino = g.ino AND p.action <> 'delete'")
def _(plan):
    return mirror.materialize_links(plan).select("path", "link_to", "bytes")


@over_snapshots("apl6_errors", "SELECT s.path, 'unreadable source' AS error FROM src s WHERE mtime_s % 29 = 0")
def _(s, d):
    unread = s.withColumn("len", F.when(F.col("mtime_s") % 29 != 0, F.col("len")))
    return mirror.mirror(unread, d, Options())[2]


@query(
    "snk2_report",
    f"""WITH {RUN_EVENTS_SQL}, wrong AS (SELECT 'run-' || CAST(user_id % 16 AS VARCHAR) AS run_id, count(*) AS mismatches FROM events WHERE event_type = 'error' GROUP BY 1),
log AS (SELECT run_id, seq // 10000 AS part, count(*) AS n, min(seq) AS first FROM re WHERE event <> 'done' GROUP BY 1, 2)
SELECT s.run_id, NULL AS part, CASE WHEN s.errors = 0 AND coalesce(w.mismatches, 0) = 0 THEN 'success' ELSE 'failed' END AS status, s.copied, s.errors, coalesce(w.mismatches, 0) AS mismatches, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM log l WHERE l.run_id = s.run_id), 0) AS events, (SELECT count(*) FROM log l WHERE l.run_id = s.run_id) AS parts, NULL AS first
FROM (SELECT run_id, {_STATS_SQL} FROM re GROUP BY run_id) s LEFT JOIN wrong w ON w.run_id = s.run_id
UNION ALL SELECT run_id, part, NULL, NULL, NULL, NULL, n, NULL, first FROM log""",
)
def _(spark, d):
    """The reports, their JSON read back; error events stand for mismatches found by verification."""
    wrong = fx.table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("run-"), F.pmod("user_id", F.lit(16)).cast("string")).alias("run_id"), F.lit("p").alias("path"), F.lit("content differs").alias("detail"))
    report = mirror.run_report(fx.run_events(spark, d), wrong)
    schema = "status string, summary struct<copied:long,errors:long>, mismatches long, n_events long, event_parts long, events array<struct<seq:long>>"
    r = report.select("run_id", "part", F.from_json("report", schema).alias("r"))
    events = F.coalesce("r.n_events", F.when(F.col("r.events").isNotNull(), F.size("r.events")).cast("long"))
    return r.select("run_id", "part", "r.status", "r.summary.copied", "r.summary.errors", "r.mismatches", events.alias("events"), F.col("r.event_parts").alias("parts"), F.col("r.events")[0]["seq"].alias("first"))


# Streaming operators, as batches

_BURSTS_SQL = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM e),
b AS (SELECT user_id, k, t, t AS start FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.t, CASE WHEN o.t < b.start + 1800000000 THEN b.start ELSE o.t END FROM b JOIN o ON o.user_id = b.user_id AND o.k = b.k + 1)
SELECT user_id, start, count(*) AS events FROM b GROUP BY user_id, start"""


@query("str2_anchored_bursts", _BURSTS_SQL)
def _(spark, d):
    return watch.debounce_anchored(fx.table(spark, d, "events"), "user_id", 1_800_000).select("user_id", F.unix_micros("start").alias("start"), "events")


@query(
    "str3_sessions",
    """WITH o AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
m AS (SELECT user_id, t, sum(CASE WHEN before IS NULL OR t - before >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM o)
SELECT user_id, min(t) AS start, count(*) AS events FROM m GROUP BY user_id, s""",
)
def _(spark, d):
    return watch.debounce_session(fx.table(spark, d, "events"), "user_id", "30 minutes").select("user_id", F.unix_micros("start").alias("start"), "events")


def _by_run(spark: SparkSession, d: str) -> str:
    """A folder with a change file for each run, written one after the other."""
    at, events = f"{snapshots.shared_dir(spark)}/changes-{uuid.uuid4().hex}", snapshots.keep(fx.run_events(spark, d).select("run_id", "seq", "path"), "events")
    for r in events.select("run_id").distinct().orderBy("run_id").collect():  # 16 runs
        events.where(F.col("run_id") == r["run_id"]).coalesce(1).write.mode("append").parquet(at)
    return at


@over_snapshots("str1_mirror", "SELECT path, kind, len, mtime_s FROM src")
def _(s, d):
    """A mirror that follows a stream of changed paths: first the destination's state, then, after a change, the source's."""
    spark, at = s.sparkSession, f"{snapshots.shared_dir(s.sparkSession)}/follow-{uuid.uuid4().hex}"
    a, b, changes = f"{at}/a", f"{at}/b", f"{at}/changes"
    for k, side in enumerate((d, s)):
        snapshots.publish(side, a)
        planning.mirror_plan(s, d).where("action != 'skip'").select("path").write.mode("append").parquet(changes)
        mirror.mirror_on_changes(watch.changes_stream(spark, changes, "path string"), a, b, _approved(), f"{at}/c").awaitTermination()
    return snapshots.read_published(spark, b).select("path", "kind", "len", "mtime_s")


@over_snapshots("str1_incremental", "SELECT path, kind, len, mtime_s FROM src")
def _(s, d):
    """The same in buckets: three versions of the source, the changes between them as a stream, only their buckets rewritten."""
    spark, at = s.sparkSession, f"{snapshots.shared_dir(s.sparkSession)}/follow-{uuid.uuid4().hex}"
    a, b, changes, plan = f"{at}/a", f"{at}/b", f"{at}/changes", snapshots.keep(planning.mirror_plan(s, d).where("action != 'skip'"), "plan")
    bucketed.publish_buckets(d, a, 16)
    for half in (None, 0, 1):
        some = plan.limit(0) if half is None else plan.where(F.pmod(F.xxhash64("path"), F.lit(2)) == half)
        bucketed.apply_changes(some, a, _approved())
        some.select("path").write.mode("append").parquet(changes)
        incremental.follow(watch.changes_stream(spark, changes, "path string"), a, b, _approved(), f"{at}/c").awaitTermination()
    return bucketed.read_buckets(spark, b).select("path", "kind", "len", "mtime_s")


@query("str5_failed_cycles", f"WITH {RUN_EVENTS_SQL} SELECT run_id, count(*) AS rows, CASE WHEN count(*) % 3 = 0 THEN 'ArithmeticError' END AS error FROM re GROUP BY run_id")
def _(spark, d):
    """A batch for each run; cycles of runs whose number of events is a multiple of 3 fail and are logged, the others go on."""
    at = _by_run(spark, d)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        found = batch.groupBy("run_id").agg(F.count("*").alias("rows")).first()
        if found["rows"] % 3 == 0:
            raise ArithmeticError(f"{found['run_id']} {found['rows']}")
        spark.createDataFrame([(found["run_id"], found["rows"])], "run_id string, rows long").write.mode("append").parquet(f"{at}-done")

    spark.createDataFrame([], "run_id string, rows long").write.parquet(f"{at}-done")
    spark.createDataFrame([], "batch_id long, error string, message string").write.parquet(f"{at}-errors")
    watch.watch(watch.changes_stream(spark, at, "run_id string, seq long, path string", max_files=1), cycle, f"{at}-check", errors=f"{at}-errors").awaitTermination()
    failed = spark.read.parquet(f"{at}-errors").select(F.substring_index("message", " ", 1).alias("run_id"), F.substring_index("message", " ", -1).cast("long").alias("rows"), "error")
    return spark.read.parquet(f"{at}-done").withColumn("error", F.lit(None).cast("string")).union(failed)


@query("str7_rate_caps", f"WITH {RUN_EVENTS_SQL} SELECT CAST(ceil(count(DISTINCT run_id) / 3.0) AS BIGINT) AS cycles, count(*) AS rows, CAST(3 AS BIGINT) AS most_runs FROM re")
def _(spark, d):
    """Cycles of at most three change files."""
    at, seen = _by_run(spark, d), []
    watch.watch(watch.changes_stream(spark, at, "run_id string, seq long, path string", max_files=3), lambda batch, n: seen.append(batch.agg(F.count("*"), F.count_distinct("run_id")).first()), f"{at}-check").awaitTermination()
    return spark.createDataFrame([(len(seen), sum(r[0] for r in seen), max(r[1] for r in seen))], "cycles long, rows long, most_runs long")


@query("str4_relevant", f"WITH {RUN_EVENTS_SQL} SELECT run_id, seq FROM re WHERE NOT (path = 'u/7' OR path LIKE 'u/7/%')")
def _(spark, d):
    events = fx.run_events(spark, d).select("run_id", "seq", F.array("path").alias("paths"))
    return watch.relevant(events, "u/7").select("run_id", "seq")


@query("str6_live_state", f"WITH {RUN_EVENTS_SQL} SELECT run_id, count(*) FILTER (event = 'done') AS files_done, CAST(sum(CASE WHEN event = 'done' THEN bytes ELSE 0 END) AS BIGINT) AS bytes_done, {_STATS_SQL}, arg_max(phase, seq) FILTER (event = 'phase') AS phase FROM re GROUP BY run_id")
def _(spark, d):
    return watch.live_run_state(fx.run_events(spark, d))


@query("relevant_paths", f"WITH {RUN_EVENTS_SQL} SELECT run_id, seq FROM re WHERE NOT (path = 'u/7' OR path LIKE 'u/7/%')")
def _(spark, d):
    return watch.relevant_paths(fx.run_events(spark, d), "u/7").select("run_id", "seq")
