"""A mirror that follows changes and reads and writes no more than the buckets they fall into (STR-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import filters, planning
from ..sources.buckets import apply_changes, bucket_of, publish_buckets, read_buckets
from ..sources.snapshots import commits, current_commit
from ..streaming.watch import relevant_paths, watch
from .mirror import gate_deletes, mirror, split_failures
from .options import Options


def sync_paths(spark: SparkSession, source: str, target: str, paths: DataFrame, opts: Options) -> list[int]:
    """Makes the target equal to the source for these paths alone; both are published in buckets. Returns what was rewritten.

    A path that the source lacks is deleted, if deletions are approved. Only the buckets of the paths are read, and in them
    a semi-join leaves the paths' rows to the plan.
    """
    asked = paths.select("path").distinct()

    def rows(at: str) -> DataFrame:
        buckets = current_commit(spark, at)["buckets"]
        only = [r["b"] for r in asked.select(bucket_of("path", buckets).alias("b")).distinct().collect()]  # numbers of buckets
        return filters.drop_reserved(read_buckets(spark, at, only), opts.reserved).join(asked, "path", "left_semi")

    rules = filters.rules_of(opts.rules)
    plan, _ = split_failures(planning.mirror_plan(filters.apply_rules(rows(source), rules), filters.apply_rules(rows(target), rules), opts.checksum, opts.delete))
    gate_deletes(opts, plan)
    return apply_changes(plan, target, opts)


def follow(changes: DataFrame, source: str, target: str, opts: Options, checkpoint: str, errors: str | None = None, once: bool = True) -> StreamingQuery:
    """A whole mirror where the target does not exist yet, then one of the changed paths (path) for each micro-batch."""
    if opts.dry_run:
        raise ValueError("a continuous mirror cannot be a dry run")
    spark = changes.sparkSession
    if not commits(spark, target):
        rows = read_buckets(spark, source)
        publish_buckets(mirror(rows, rows.limit(0), opts)[1], target, current_commit(spark, source)["buckets"])

    def cycle(batch: DataFrame, batch_id: int) -> None:
        sync_paths(batch.sparkSession, source, target, batch, opts)

    return watch(relevant_paths(changes, opts.reserved), cycle, checkpoint, errors, once)
