"""Snapshots, plans and logs derived from the star-schema tables, in Spark and (as common table expressions) in SQL.

A destination is its source with documents removed, changed, touched, re-moded and re-kinded by residues of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sources.snapshots import keep

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(df: DataFrame) -> DataFrame:
    hashed = df.withColumn("hash", F.sha2("text", 256))
    first = hashed.groupBy("hash").agg(F.min("doc_id").alias("ino"))
    return hashed.join(first, "hash").select(
        "path", "kind", F.when(F.col("kind") == "file", F.octet_length("text")).otherwise(0).cast("long").alias("len"),
        F.floor(F.col("mtime_us") / 1000000).cast("long").alias("mtime_s"), (F.pmod("mtime_us", F.lit(1000000)) * 1000).cast("int").alias("mtime_ns"),
        F.col("mode").cast("int").alias("mode"), (1000 + F.pmod("doc_id", F.lit(3))).cast("int").alias("uid"), F.lit(100).alias("gid"), F.lit(1).cast("long").alias("dev"), "ino",
        F.when(F.col("kind") == "symlink", F.lit("elsewhere")).alias("target"), "hash", "text",
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return _entries(docs.select("doc_id", "text", path.alias("path"), F.lit("file").alias("kind"), (F.lit(EPOCH_US) + F.col("doc_id") * 1000003).alias("mtime_us"), F.lit(33188).alias("mode")))


def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat_ws("/", "source", "lang", F.concat(n.cast("string"), F.lit(".txt")))
    longer = F.when(n % 11 == 0, F.concat("text", F.lit(" v1"))).otherwise(F.col("text"))
    kept = docs.where(n % 7 != 0).withColumn("t", longer)
    turned = F.when(n % 13 == 0, F.concat(F.expr("substring(t, 2)"), F.substring("t", 1, 1))).otherwise(F.col("t"))
    mtime = F.lit(EPOCH_US) + n * 1000003 + F.when(n % 17 == 0, 400000).otherwise(0)
    changed = kept.select("doc_id", turned.alias("text"), path.alias("path"), F.when(n % 23 == 0, "symlink").otherwise("file").alias("kind"), mtime.alias("mtime_us"), F.when(n % 19 == 0, 33152).otherwise(33188).alias("mode"))
    stale = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.concat(F.lit("stale/"), F.col("item_id").cast("string"), F.lit(".txt")), F.lit("file"), F.lit(EPOCH_US).cast("long"), F.lit(33188))
    return _entries(changed.union(stale))


_COLUMNS = """path, kind, CAST(CASE WHEN kind = 'file' THEN strlen(text) ELSE 0 END AS BIGINT) AS len,
  CAST(floor(mtime_us / 1000000) AS BIGINT) AS mtime_s, CAST((mtime_us % 1000000) * 1000 AS INTEGER) AS mtime_ns, mode, CAST(1000 + doc_id % 3 AS INTEGER) AS uid, 100 AS gid,
  CAST(1 AS BIGINT) AS dev, min(doc_id) OVER (PARTITION BY sha256(text)) AS ino, CASE WHEN kind = 'symlink' THEN 'elsewhere' END AS target, sha256(text) AS hash, text"""
_PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
SNAPSHOTS_SQL = f"""src0 AS (
  SELECT doc_id, text, {_PATH} AS path, 'file' AS kind, {EPOCH_US} + doc_id * 1000003 AS mtime_us, 33188 AS mode FROM documents
), src AS (SELECT {_COLUMNS} FROM src0), dst1 AS (
  SELECT *, CASE WHEN doc_id % 11 = 0 THEN text || ' v1' ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0
), dst0 AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN substr(t, 2) || substr(t, 1, 1) ELSE t END AS text, {_PATH} AS path, CASE WHEN doc_id % 23 = 0 THEN 'symlink' ELSE 'file' END AS kind,
    {EPOCH_US} + doc_id * 1000003 + CASE WHEN doc_id % 17 = 0 THEN 400000 ELSE 0 END AS mtime_us, CASE WHEN doc_id % 19 = 0 THEN 33152 ELSE 33188 END AS mode FROM dst1
  UNION ALL SELECT item_id, text, 'stale/' || CAST(item_id AS VARCHAR) || '.txt', 'file', {EPOCH_US}, 33188 FROM benchmark
), dst AS (SELECT {_COLUMNS} FROM dst0)"""
_DIFFERS = "(s.mode & 4095) <> (d.mode & 4095) OR s.mtime_s <> d.mtime_s"
QUICK_SQL = f"s.len <> d.len OR {_DIFFERS}"
CHECKSUM_SQL = f"{_DIFFERS} OR coalesce(s.hash <> d.hash, true)"


def plan_sql(differs: str = QUICK_SQL, name: str = "plan") -> str:
    """A further table expression: the full mirror plan."""
    return f"""{name} AS (
  SELECT coalesce(s.path, d.path) AS path, coalesce(s.kind, d.kind) AS kind, coalesce(s.len, d.len) AS len, coalesce(s.dev, d.dev) AS dev, coalesce(s.ino, d.ino) AS ino,
    CASE WHEN s.path IS NULL THEN 'delete' WHEN d.path IS NULL THEN 'copy' WHEN s.kind <> d.kind OR {differs} THEN 'update' ELSE 'skip' END AS action
  FROM src s FULL OUTER JOIN dst d ON s.path = d.path)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from events; the record at nine tenths has a wrong checksum."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.floor(F.count("*") * 0.9).alias("bad"))  # one row
    record = F.concat_ws("|", "user_id", "event_type", "event_id")
    base = events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("user_id").alias("path"), record.alias("record"))
    return base.crossJoin(F.broadcast(n)).select("seq", "op", "path", "record", F.when(F.col("seq") == F.col("bad"), "wrong").otherwise(F.sha2(F.col("record").cast("binary"), 256)).alias("checksum"))


JOURNAL_SQL = """journal AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, user_id AS path, CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CAST(event_id AS VARCHAR) AS record,
    event_id = (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM events) AS wrong FROM events
), valid AS (SELECT * FROM journal WHERE seq < coalesce((SELECT min(seq) FROM journal WHERE wrong), 9223372036854775807))"""

PHASES = ("planning", "copying", "deleting", "verifying", "finalizing", "done")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per customer-facing event type: done events of its users' activity, errors, and phase marks by time.

    Derived from events: each event type is a run; purchases count as copies, views as skips, and so on.
    """
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.array(*map(F.lit, ("copy", "update", "skip", "delete"))), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    kind = F.when(F.col("event_id") % 97 == 0, "error").when(F.col("event_id") % 89 == 0, "phase").otherwise("done")
    phase = F.element_at(F.array(*map(F.lit, PHASES)), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    return e.select(
        F.concat(F.lit("run-"), F.pmod("user_id", F.lit(16)).cast("string")).alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event"),
        F.when(kind == "phase", phase).alias("phase"), F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("path"), F.when(kind == "done", action).alias("action"), F.pmod(F.col("event_id") * 7919, F.lit(100000)).alias("bytes"),
    )


RUN_EVENTS_SQL = """re0 AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 89 = 0 THEN 'phase' ELSE 'done' END AS event FROM events
), re AS (
  SELECT 'run-' || CAST(user_id % 16 AS VARCHAR) AS run_id, event_id AS seq, ts, event,
    CASE WHEN event = 'phase' THEN CASE event_id % 6 WHEN 0 THEN 'planning' WHEN 1 THEN 'copying' WHEN 2 THEN 'deleting' WHEN 3 THEN 'verifying' WHEN 4 THEN 'finalizing' ELSE 'done' END END AS phase,
    'u/' || CAST(user_id AS VARCHAR) || '/' || event_type AS path, CASE WHEN event = 'done' THEN CASE event_id % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'update' WHEN 2 THEN 'skip' ELSE 'delete' END END AS action,
    (event_id * 7919) % 100000 AS bytes FROM re0
)"""


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as benchmark runs: priority the scenario, status the tool, the order's cents the time."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("tool"), F.pmod("o_orderkey", F.lit(1009)).cast("double").alias("seconds"), F.col("o_custkey").alias("files"), (F.col("o_orderkey") * 4096).alias("bytes"))


BENCH_SQL = "bench AS (SELECT o_orderpriority AS scenario, o_orderstatus AS tool, CAST(o_orderkey % 1009 AS DOUBLE) AS seconds, o_custkey AS files, o_orderkey * 4096 AS bytes FROM orders)"


def contents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) contents of all files at both sides: all that transfer_plan(checksum=True) sends as delta."""
    src, dst = source(spark, sf_dir), destination(spark, sf_dir)
    both = src.alias("s").join(dst.alias("d"), "path").where("s.kind = 'file' AND d.kind = 'file'")
    both = keep(both.select("path", F.col("d.text").cast("binary").alias("old"), F.col("s.text").cast("binary").alias("new")), "contents")
    return both.select("path", F.col("old").alias("content")), both.select("path", F.col("new").alias("content"))


CONTENTS_SQL = """pairs AS (SELECT s.path, d.text AS old, s.text AS new FROM src s JOIN dst d ON s.path = d.path WHERE s.kind = 'file' AND d.kind = 'file')"""


def delta_sql(old: str = "old", new: str = "new") -> str:
    """Further table expressions, for blocks of 700 bytes: hx (contents in hex), blocks, wins (windows), cand (matches),
    chosen (greedy from the left), tails, and ops; the statement needs WITH RECURSIVE."""
    some_bytes = lambda h: f"(SELECT path, unnest(range(0, len({h}) // 2)) AS pos, CAST('0x' || unnest(regexp_extract_all({h}, '..')) AS BIGINT) AS v, len({h}) // 2 AS n FROM hx)"
    return f"""hx AS MATERIALIZED (SELECT path, hex({old}) AS oh, hex({new}) AS nh FROM pairs),
blocks AS MATERIALIZED (SELECT path, pos // 700 AS block_idx, count(*) AS len, CAST(sum(v) % 65536 + (sum((least(700, n - pos // 700 * 700) - pos % 700) * v) % 65536) * 65536 AS BIGINT) AS weak FROM {some_bytes("oh")} x GROUP BY path, pos // 700),
sums AS (SELECT path, pos, sum(v) OVER w AS s1, sum(pos * v) OVER w AS s2 FROM {some_bytes("nh")} x WINDOW w AS (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
diffs AS (SELECT path, pos, s1 - coalesce(lag(s1, 700) OVER o, 0) AS a, s2 - coalesce(lag(s2, 700) OVER o, 0) AS j FROM sums WINDOW o AS (PARTITION BY path ORDER BY pos)),
wins AS (SELECT path, pos - 699 AS pos, CAST(a % 65536 + (((pos + 1) * a - j) % 65536) * 65536 AS BIGINT) AS weak FROM diffs WHERE pos >= 699),
cand AS MATERIALIZED (SELECT w.path, w.pos, min(b.block_idx) AS block_idx FROM wins w JOIN blocks b ON w.path = b.path AND w.weak = b.weak AND b.len = 700 JOIN hx h ON h.path = w.path
  WHERE substr(h.nh, 2 * w.pos + 1, 1400) = substr(h.oh, 1400 * b.block_idx + 1, 1400) GROUP BY w.path, w.pos),
after AS (SELECT a.path, a.pos, a.block_idx, n.pos AS next FROM cand a ASOF LEFT JOIN cand n ON a.path = n.path AND a.pos + 700 <= n.pos),
chosen AS (SELECT a.path, a.pos, a.block_idx, a.next FROM after a JOIN (SELECT path, min(pos) AS pos FROM cand GROUP BY path) f ON a.path = f.path AND a.pos = f.pos
  UNION ALL SELECT a.path, a.pos, a.block_idx, a.next FROM chosen c JOIN after a ON a.path = c.path AND a.pos = c.next),
ends AS (SELECT h.path, len(h.nh) // 2 AS n, coalesce(max(c.pos) + 700, 0) AS stop FROM hx h LEFT JOIN chosen c ON c.path = h.path GROUP BY h.path, h.nh),
tails AS (SELECT e.path, e.stop AS pos, min(b.block_idx) AS block_idx FROM ends e JOIN hx h ON h.path = e.path JOIN blocks b ON b.path = e.path AND b.len < 700 AND b.len = e.n - e.stop
  WHERE substr(h.nh, 2 * e.stop + 1) = substr(h.oh, 1400 * b.block_idx + 1) GROUP BY e.path, e.stop),
marks AS (SELECT path, pos, pos + 700 AS stop, block_idx FROM chosen UNION ALL SELECT t.path, t.pos, e.n, t.block_idx FROM tails t JOIN ends e ON e.path = t.path UNION ALL SELECT path, n, n, NULL FROM ends),
gaps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY path ORDER BY pos, stop), 0) AS start FROM marks),
ops AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY place) - 1 AS INTEGER) AS op_seq, op, CAST(block_idx AS INTEGER) AS block_idx, CAST(n AS INTEGER) AS n FROM (
  SELECT path, 'literal' AS op, NULL AS block_idx, pos - start AS n, start AS place FROM gaps WHERE pos > start UNION ALL SELECT path, 'copy', block_idx, NULL, pos FROM gaps WHERE block_idx IS NOT NULL) x)"""


def long_contents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) pieces (path, offset, bytes) of one content for each source: its documents joined by id; the old one lacks
    some of them and holds longer ones."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    before = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text")
    old_size = F.when(n % 7 != 0, size + F.when(n % 11 == 0, len(" v1")).otherwise(0))
    place = lambda of: F.coalesce(F.sum(of).over(before), F.lit(0))
    at = docs.select("source", "doc_id", place(old_size).alias("old_at"), place(size).alias("new_at"))  # lengths only
    both = docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).join(at, "doc_id")
    both = keep(both.select("doc_id", F.col("source").alias("path"), "old_at", "new_at", "bytes"), "long")
    changed = F.when(n % 11 == 0, F.concat("bytes", F.lit(b" v1"))).otherwise(F.col("bytes"))
    return both.where(n % 7 != 0).select("path", F.col("old_at").alias("offset"), changed.alias("bytes")), both.select("path", F.col("new_at").alias("offset"), "bytes")


LONG_SQL = """pairs AS (SELECT source AS path, string_agg(CASE WHEN doc_id % 11 = 0 THEN text || ' v1' ELSE text END, '' ORDER BY doc_id) FILTER (doc_id % 7 <> 0) AS old, string_agg(text, '' ORDER BY doc_id) AS new FROM documents GROUP BY source)"""


def all_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(source, destination) with directories, and with symlinks on both sides: some alike, some with another target."""

    def dirs(entries: DataFrame, level: int, mode: int) -> DataFrame:
        found = entries.select(F.array_join(F.slice(F.split("path", "/"), 1, level), "/").alias("path")).distinct()
        fill = {"len": 0, "mtime_s": level, "mtime_ns": 0, "mode": mode, "uid": 1000, "gid": 100}
        kinds = entries.schema
        return found.withColumns({"kind": F.lit("dir")} | {c: F.lit(v).cast(kinds[c].dataType) for c, v in fill.items()} | {c: F.lit(None).cast(kinds[c].dataType) for c in ("dev", "ino", "target", "hash")}).select(entries.columns)

    n = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    s, d = source(spark, sf_dir).drop("text"), destination(spark, sf_dir).drop("text")
    link = n % 23 == 0
    s = s.withColumns({"kind": F.when(link, "symlink").otherwise(F.col("kind")), "len": F.when(link, 0).otherwise(F.col("len")), "target": F.when(link, F.when(n % 2 == 0, "elsewhere").otherwise("nowhere"))})
    return s.union(dirs(s, 1, 16877)).union(dirs(s, 2, 16877)), d.union(dirs(d, 1, 16877)).union(dirs(d, 2, 16832))


def all_kinds_sql() -> str:
    """Further table expressions over SNAPSHOTS_SQL: src2 and dst2."""
    columns = "path, kind, len, mtime_s, mtime_ns, mode, uid, gid, dev, ino, target, hash"
    level = lambda name, k, mode: f"SELECT DISTINCT array_to_string(string_split(path, '/')[1:{k}], '/'), 'dir', 0, {k}, 0, {mode}, 1000, 100, NULL, NULL, NULL, NULL FROM {name}"
    n = "CAST(regexp_extract(path, '([0-9]+)[.]txt$', 1) AS BIGINT)"
    linked = f"SELECT * REPLACE (CASE WHEN {n} % 23 = 0 THEN 'symlink' ELSE kind END AS kind, CASE WHEN {n} % 23 = 0 THEN 0 ELSE len END AS len, CASE WHEN {n} % 23 = 0 THEN CASE WHEN {n} % 2 = 0 THEN 'elsewhere' ELSE 'nowhere' END END AS target) FROM src"
    return f"""src1 AS ({linked}), src2 AS (SELECT {columns} FROM src1 UNION ALL {level("src1", 1, 16877)} UNION ALL {level("src1", 2, 16877)}),
dst2 AS (SELECT {columns} FROM dst UNION ALL {level("dst", 1, 16877)} UNION ALL {level("dst", 2, 16832)})"""
