"""Applying plans and whole runs (APL-1 to APL-7, PLN-11, SNK-2, STR-1, VFY-2)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import safe_mode
from ..operators import aggregates, compare, filters, planning
from ..operators import index as index_ops
from ..sources.snapshots import ConflictError, commits, publish, read_published, read_version
from ..streaming.watch import relevant_paths, watch
from .options import Options


class DeletesNotApprovedError(PermissionError):
    """Deletions were asked for but not approved."""


def gate_deletes(opts: Options, plan: DataFrame) -> None:
    """Before any write: deletions need delete and yes."""
    if opts.delete and not opts.yes and not plan.where("action = 'delete'").isEmpty():
        raise DeletesNotApprovedError("deletions need approval")


_CARRIED = {"mode": ("mode",), "mtime": ("mtime_s", "mtime_ns"), "owner": ("uid",), "group": ("gid",)}


def _merged(column: str, opts: Options) -> Column:
    """A column of a copied or updated entry: from the source if preserved, else as at the destination."""
    s, d = F.col(f"p.{column}"), F.col(f"d.{column}")
    attribute = next((a for a, columns in _CARRIED.items() if column in columns), None)
    if attribute is None:
        return s
    if column == "mode":
        s = safe_mode(s)
    return s if attribute in opts.preserve else F.coalesce(d, s)


def apply_plan(plan: DataFrame, dst: DataFrame, opts: Options) -> DataFrame:
    """The destination after the plan: kept rows as they are, copied and updated ones from the source, no deleted ones.

    Without approved deletions, rows to delete stay.
    """
    acts = plan.where("action IN ('copy', 'update', 'delete')")
    if not (opts.delete and opts.yes):
        acts = acts.where("action != 'delete'")
    both = acts.alias("p").join(dst.alias("d"), F.col("p.path") == F.col("d.path"), "full_outer").where("p.action IS NULL OR p.action != 'delete'")
    from_plan = F.col("p.path").isNotNull()
    return both.select(*[F.when(from_plan, _merged(c, opts) if c in plan.columns else F.lit(None)).otherwise(F.col(f"d.{c}")).alias(c) for c in dst.columns])


def split_failures(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to apply, error rows): unsafe paths or targets, and files that could not be read."""
    ok, bad = filters.split_unsafe(plan)
    unreadable = (F.col("kind") == "file") & F.col("len").isNull() & F.col("action").isin("copy", "update")
    return ok.where(~unreadable), bad.select("path", "error").union(ok.where(unreadable).select("path", F.lit("unreadable source").alias("error")))


def materialize_links(plan: DataFrame) -> DataFrame:
    """link_to and bytes: later members of a link group point at the first and carry nothing."""
    files = plan.where("kind = 'file' AND action != 'delete' AND dev IS NOT NULL AND ino IS NOT NULL")
    first = files.groupBy(F.col("dev").alias("g_dev"), F.col("ino").alias("g_ino")).agg(F.min(F.split("path", "/")).alias("f"), F.count("*").alias("members")).where("members > 1").drop("members")
    joined = plan.join(first, (F.col("dev") == F.col("g_dev")) & (F.col("ino") == F.col("g_ino")) & (F.col("kind") == "file") & (F.col("action") != "delete"), "left")
    later = F.col("f").isNotNull() & (F.split("path", "/") != F.col("f"))
    return joined.select(*plan.columns, F.when(later, F.array_join("f", "/")).alias("link_to"), F.when(later | (F.col("kind") != "file"), 0).otherwise(F.col("len")).alias("bytes"))


def plan_events(plan: DataFrame, run_id: str) -> DataFrame:
    """One 'done' event per plan row, numbered in path order within its partition."""
    return plan.select(F.lit(run_id).alias("run_id"), F.monotonically_increasing_id().alias("seq"), F.lit("done").alias("event"), "path", "action", F.col("len").alias("bytes"))


@dataclass
class Run:
    status: str
    stats: dict
    mismatches: int
    errors: int
    persist_index: bool


def mirror(src: DataFrame, dst: DataFrame, opts: Options, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, destination afterwards, error rows); nothing is written here, so a dry run stops at the plan.

    With an index, what is recorded decides about unchanged entries.
    """
    planning.guard_empty(src, opts.delete)
    rules = filters.rules_of(opts.rules)
    src, dst = (filters.apply_rules(filters.drop_reserved(x, opts.reserved), rules) for x in (src, dst))
    plan = planning.mirror_plan(src, dst, opts.checksum, opts.delete) if index is None else planning.indexed_plan(src, dst, index, opts.checksum, opts.delete)
    if opts.hard_links:
        plan = planning.enforce_links(plan, dst)
    ok, errors = split_failures(plan)
    gate_deletes(opts, ok)
    return plan, dst if opts.dry_run else apply_plan(ok, dst, opts), errors


def finish(plan: DataFrame, mismatches: DataFrame, errors: DataFrame, opts: Options) -> Run:
    """The outcome: success only without errors and mismatches; the index is persisted only then and only if no
    deletion is outstanding."""
    stats = aggregates.plan_summary(plan).first().asDict()
    wrong, failed = mismatches.count(), errors.count()
    clean = not wrong and not failed
    return Run("success" if clean else "failed", stats, wrong, failed, clean and not opts.dry_run and (stats["deletions"] == 0 or (opts.delete and opts.yes)))


def dry_run(src: DataFrame, dst: DataFrame, opts: Options, run_id: str = "dry-run") -> tuple[DataFrame, DataFrame]:
    """(statistics, events) of what a run would do, a planned event per entry and a deleted one per deletion."""
    plan, _, _ = mirror(src, dst, replace(opts, dry_run=True))
    count = lambda action: F.count_if(F.col("action") == action)
    moved = (F.col("kind") == "file") & F.col("action").isin("copy", "update")
    size = F.when(moved, F.col("len")).otherwise(0)
    stats = plan.agg(count("copy").alias("copied"), count("update").alias("updated"), count("skip").alias("skipped"), count("delete").alias("deleted"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    event = F.when(F.col("action") == "delete", "deleted").otherwise("planned")
    return stats, plan.select(F.lit(run_id).alias("run_id"), event.alias("event"), "path", "action", size.cast("long").alias("bytes"))


def sync(spark: SparkSession, source: str, target: str, opts: Options, role: str = "push", index_dir: str | None = None, attempts: int = 5) -> Run:
    """Mirrors a published snapshot into another one; role pull swaps the sides.

    With `index_dir`, a recorded state there speeds up the plan, and a run without fault brings it up to date. If another
    writer publishes at the target meanwhile, the run plans again from what stands there then.
    """
    source, target = (source, target) if role == "push" else (target, source)
    for attempt in range(attempts):
        src, known = read_published(spark, source), commits(spark, target)
        dst = read_published(spark, target, known[0]["number"]) if known else src.limit(0)
        plan, after, errors = mirror(src, dst, opts, index_ops.try_load_index(spark, index_dir) if index_dir else None)
        if opts.dry_run:
            break
        try:
            after = read_version(spark, target, publish(after, target, based_on=known[0]["number"] if known else 0))
            break
        except ConflictError:
            if attempt == attempts - 1:
                raise
    mismatches = compare.verify(src, after, "none" if opts.dry_run else opts.verify, plan, opts.tolerance_s)
    run = finish(plan, mismatches, errors, opts)
    if index_dir and run.persist_index:
        index_ops.persist_after_plan(plan, after, index_dir, opts.checksum)
    return run


def mirror_on_changes(changes: DataFrame, source: str, target: str, opts: Options, checkpoint: str, index_dir: str | None = None, errors: str | None = None, once: bool = True) -> StreamingQuery:
    """STR-1: a sync at the start, then one for each micro-batch of changes (path) outside the reserved folder.

    A micro-batch is a burst: its trigger, or the rate caps of changes_stream(), gather what comes together. A cycle
    that fails is logged in `errors`, and the stream goes on.
    """
    if opts.dry_run:
        raise ValueError("a continuous mirror cannot be a dry run")
    spark = changes.sparkSession
    sync(spark, source, target, opts, index_dir=index_dir)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sync(batch.sparkSession, source, target, opts, index_dir=index_dir)

    return watch(relevant_paths(changes, opts.reserved), cycle, checkpoint, errors, once)


def run_report(events: DataFrame, mismatches: DataFrame, part_seqs: int = 10_000) -> DataFrame:
    """JSON documents per run: a head (part is null) with statistics, phase times, mismatches and numbers of events and
    of their parts; then a document per part with all its errors and phase marks.

    A part is a range of `part_seqs` sequence numbers, which are unique in a run: it is bounded, and no run is gathered whole.
    Mismatches (path, detail) count for their run_id if they have one, else for every run.
    """
    stats = aggregates.run_stats(events)
    logged = events.where("event != 'done'").withColumn("part", F.floor(F.col("seq") / part_seqs))
    log = logged.groupBy("run_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "event", "phase", "path"))).alias("events"))
    sizes = logged.groupBy("run_id", "part").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.sum("n").alias("n_events"), F.count("*").alias("parts"))
    times = aggregates.phase_timings(events).groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "ms")))).alias("timings"))
    joined = stats.join(times, "run_id", "left").join(sizes, "run_id", "left")
    if "run_id" in mismatches.columns:
        joined = joined.join(mismatches.groupBy("run_id").agg(F.count("*").alias("mismatches")), "run_id", "left").na.fill(0, ["mismatches"])
    else:
        joined = joined.crossJoin(F.broadcast(mismatches.agg(F.count("*").alias("mismatches"))))  # one row
    status = F.when((F.col("errors") == 0) & (F.col("mismatches") == 0), "success").otherwise("failed")
    summary = F.struct("copied", "updated", "skipped", "deleted", "errors", "bytes")
    count = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    head = F.to_json(F.struct(status.alias("status"), summary.alias("summary"), "timings", "mismatches", count("n_events", "n_events"), count("parts", "event_parts")))
    heads = joined.select("run_id", F.lit(None).cast("long").alias("part"), head.alias("report"))
    return heads.union(log.select("run_id", "part", F.to_json(F.struct("events")).alias("report")))
