"""Summaries of plans, runs, snapshots and benchmarks (AGG-1 to AGG-9, WIN-4, WIN-5, SRT-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent

MANY_FILES, SMALL_MEDIAN = 4096, 64 * 1024


def _count(action: str) -> F.Column:
    return F.count_if(F.col("action") == action)


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: entries by action, files and bytes to transfer, deletions."""
    moved = (F.col("kind") == "file") & F.col("action").isin("copy", "update")
    return plan.agg(
        _count("copy").alias("copies"), _count("update").alias("updates"), _count("skip").alias("skips"), _count("delete").alias("deletions"),
        F.count_if(moved).alias("files_to_transfer"), F.coalesce(F.sum(F.when(moved, F.col("len"))), F.lit(0)).cast("long").alias("bytes_to_transfer"),
    )


def run_stats(events: DataFrame) -> DataFrame:
    """Per run: what happened to entries, errors, and bytes of finished files."""
    done = F.col("event") == "done"
    return events.groupBy("run_id").agg(
        F.count_if(done & (F.col("action") == "copy")).alias("copied"), F.count_if(done & (F.col("action") == "update")).alias("updated"), F.count_if(done & (F.col("action") == "skip")).alias("skipped"),
        F.count_if(done & (F.col("action") == "delete")).alias("deleted"), F.count_if(F.col("event") == "error").alias("errors"),
        F.coalesce(F.sum(F.when(done & F.col("action").isin("copy", "update"), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"),
    )


def summarize_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """runs, median, mean, population standard deviation, min and interpolated 95th percentile; exact."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("pstdev"),
        F.min(value).alias("min"), F.percentile(value, 0.95).alias("p95"),
    )


def speedup(df: DataFrame, baseline: str, scenario: str = "scenario", tool: str = "tool", value: str = "seconds") -> DataFrame:
    """Per scenario and other tool: the baseline's median over its own."""
    medians = df.groupBy(F.col(scenario).alias("scenario"), F.col(tool).alias("tool")).agg(F.percentile(value, 0.5).alias("median"))
    base = medians.where(F.col("tool") == baseline).select("scenario", F.col("median").alias("base"))
    return medians.where(F.col("tool") != baseline).join(base, "scenario").select("scenario", "tool", (F.col("base") / F.when(F.col("median") != 0, F.col("median"))).alias("speedup"))


def throughput(df: DataFrame) -> DataFrame:
    """files_per_sec and gib_per_sec; 0 where no time passed."""
    per = lambda c: F.when(F.col("seconds") != 0, c / F.col("seconds")).otherwise(F.lit(0.0))
    return df.withColumn("files_per_sec", per(F.col("files"))).withColumn("gib_per_sec", per(F.col("bytes") / float(1 << 30)))


def workload_profile(plan: DataFrame) -> DataFrame:
    """One row: files to transfer, the upper median of their sizes, and whether these are many small files.

    Counts by class of length (64 to an octave, so at most some 4,000) tell in which class the median lies; only that
    class's distinct lengths are ordered.
    """
    by_len = plan.where("kind = 'file' AND action IN ('copy', 'update')").groupBy("len").agg(F.count("*").alias("n"))
    by_len = by_len.withColumn("class", F.floor(F.log2(F.col("len") + 1) * 64).cast("int"))
    classes = by_len.groupBy("class").agg(F.sum("n").alias("m"))  # a bounded number of rows
    upto, whole = Window.orderBy("class"), Window.partitionBy()
    classes = classes.select("class", (F.sum("m").over(upto) - F.col("m")).alias("before"), F.sum("m").over(upto).alias("upto"), F.sum("m").over(whole).alias("total"))
    half = F.floor(F.col("total") / 2)
    middle = classes.where((F.col("before") <= half) & (F.col("upto") > half))  # one row
    inside = by_len.join(F.broadcast(middle), "class").withColumn("run", F.col("before") + F.sum("n").over(Window.partitionBy("class").orderBy("len")))
    found = inside.agg(F.coalesce(F.max("total"), F.lit(0)).alias("files"), F.min(F.when(F.col("run") > half, F.col("len"))).alias("upper_median"))
    small = (F.col("files") >= MANY_FILES) & (F.col("upper_median") < SMALL_MEDIAN)
    return found.select("files", "upper_median", F.coalesce(small, F.lit(False)).alias("many_small"), F.when(small, "many small files (count high, median < 64 KiB)").otherwise("few or large files").alias("reason"))


def tree_bytes(entries: DataFrame, depth: int | None = None) -> DataFrame:
    """Bytes and number of files below the root, or per directory prefix of `depth` components."""
    files = entries.where("kind = 'file'")
    sums = [F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files")]
    return files.agg(*sums) if depth is None else files.groupBy(F.substring_index("path", "/", depth).alias("dir")).agg(*sums)


def all_tree_bytes(entries: DataFrame) -> DataFrame:
    """dir, bytes, files below every directory, the root ('') included.

    Files are summed up by their own directory first; then only directories, not files, meet their ancestors.
    """
    own = entries.where("kind = 'file'").groupBy(parent("path").alias("own")).agg(F.sum("len").alias("b"), F.count("*").alias("n"))
    parts = F.filter(F.split("own", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return own.select(F.explode(above).alias("dir"), "b", "n").groupBy("dir").agg(F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("bytes"), F.sum("n").cast("long").alias("files"))


def touched_dirs(plan: DataFrame) -> DataFrame:
    """Parents of changed entries, and the root ('')."""
    changed = plan.where("action != 'skip'").select(parent("path").alias("dir")).distinct()
    return changed.union(plan.sparkSession.createDataFrame([("",)], "dir string")).distinct()


def link_groups(entries: DataFrame) -> DataFrame:
    """Groups of files with one (dev, ino): members and the first path."""
    files = entries.where("kind = 'file'")
    return files.groupBy("dev", "ino").agg(F.count("*").alias("members"), F.array_join(F.min(F.split("path", "/")), "/").alias("first_path")).where("members > 1")


def phase_timings(events: DataFrame) -> DataFrame:
    """Per run and phase: milliseconds to the next phase event; a repeated phase keeps its last."""
    w = Window.partitionBy("run_id").orderBy("seq")
    phases = events.where("event = 'phase'").withColumn("next", F.lead("ts").over(w))
    ms = (F.unix_micros("next") - F.unix_micros("ts")) / 1000
    return phases.where("next IS NOT NULL").groupBy("run_id", "phase").agg(F.max_by(ms.cast("long"), "seq").alias("ms"))


def progress(events: DataFrame, part_seqs: int = 65_536) -> DataFrame:
    """Files and bytes done after each event, and the shares of the run's totals, between 0 and 1.

    A part is a range of `part_seqs` sequence numbers of a run. Sums of parts are run up over a few rows per run, and
    events only within their part, so a hot run is many groups.
    """
    done = events.where("event = 'done'").withColumn("part", F.floor(F.col("seq") / part_seqs))
    parts = done.groupBy("run_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    zero = F.lit(0)
    sums = parts.select("run_id", "part", F.coalesce(F.sum("n").over(before), zero).alias("n0"), F.coalesce(F.sum("b").over(before), zero).alias("b0"), F.sum("n").over(whole).alias("n"), F.sum("b").over(whole).alias("b"))
    upto = Window.partitionBy("run_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda part, total: F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), part / total))
    local = done.select("run_id", "part", "seq", F.count("*").over(upto).alias("ln"), F.sum("bytes").over(upto).alias("lb"))
    out = local.join(sums, ["run_id", "part"]).select("run_id", "seq", (F.col("n0") + F.col("ln")).alias("files_done"), (F.col("b0") + F.coalesce("lb", zero)).alias("bytes_done"), "n", "b")
    return out.select("run_id", "seq", "files_done", "bytes_done", share(F.col("files_done"), F.col("n")).alias("file_ratio"), share(F.col("bytes_done"), F.col("b")).alias("byte_ratio"))


def log_tail(events: DataFrame, kind: str, needle: str, n: int) -> DataFrame:
    """The last n events of a kind whose path contains the text, newest first; a top-n, not a full sort."""
    return events.where((F.col("event") == kind) & F.contains("path", F.lit(needle))).orderBy(F.desc("seq")).limit(n)
