"""A published snapshot in hash buckets of its paths: a change rewrites the buckets that it touches (APL-1, IDX-5).

A commit says for each bucket which folder holds it, so a version shares with the one before all files of untouched
buckets. Within a bucket rows are sorted by path, so that a reader of a path passes over most row groups.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.mirror import apply_plan
from ..plans.options import Options
from .snapshots import ConflictError, commit, commits, current_commit, listed, new_version


def bucket_of(path: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _write(df: DataFrame, target: str, buckets: int) -> tuple[str, dict[str, str]]:
    """(version, folder by bucket) of rows written in buckets."""
    version = new_version()
    placed = df.withColumn("bucket", bucket_of("path", buckets))
    placed.repartition("bucket").sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{target}/v-{version}")
    there = [s.getPath().getName().removeprefix("bucket=") for s in listed(df.sparkSession, f"{target}/v-{version}/bucket=*")]
    return version, {b: version for b in there}


def publish_buckets(df: DataFrame, target: str, buckets: int = 64) -> int:
    """Publishes all rows (path and any columns but `bucket`) and returns the version's number."""
    version, folders = _write(df, target, buckets)
    return commit(df.sparkSession, target, version, folders=folders, buckets=buckets, schema=df.schema.json())


def _read(spark: SparkSession, target: str, known: dict, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(known["schema"]))
    by: dict[str, list[str]] = {}
    for bucket, version in known["folders"].items():
        if only is None or int(bucket) in only:
            by.setdefault(version, []).append(f"{target}/v-{version}/bucket={bucket}")
    parts = [spark.read.schema(schema).parquet(*sorted(paths)) for _, paths in sorted(by.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, target: str, only: list[int] | None = None) -> DataFrame:
    """The rows of the newest version, or of some of its buckets."""
    return _read(spark, target, current_commit(spark, target), only)


def apply_changes(plan: DataFrame, target: str, opts: Options, attempts: int = 5) -> list[int]:
    """Applies the plan's copies, updates and approved deletions to the published rows; returns the rewritten buckets.

    Only touched buckets are read, joined with their changes, and written. Should another writer have published since,
    the changes are applied to what stands there then.
    """
    spark = plan.sparkSession
    acts = plan.where("action IN ('copy', 'update', 'delete')")
    if not (opts.delete and opts.yes):
        acts = acts.where("action != 'delete'")
    for attempt in range(attempts):
        known = current_commit(spark, target)
        buckets = known["buckets"]
        touched = sorted(r["b"] for r in acts.select(bucket_of("path", buckets).alias("b")).distinct().collect())  # numbers of buckets
        if not touched:
            return []
        version, folders = _write(apply_plan(acts, _read(spark, target, known, touched), opts), target, buckets)
        kept = {b: v for b, v in known["folders"].items() if int(b) not in touched}
        try:
            commit(spark, target, version, based_on=known["number"], folders=kept | folders, buckets=buckets, schema=known["schema"])
            return touched
        except ConflictError:
            if attempt == attempts - 1:
                raise
    return []


def changed_buckets(spark: SparkSession, target: str, older: int, newer: int) -> list[int]:
    """The buckets whose files differ between two versions."""
    by = {c["number"]: c["folders"] for c in commits(spark, target)}
    return sorted(int(b) for b in {*by[older], *by[newer]} if by[older].get(b) != by[newer].get(b))
