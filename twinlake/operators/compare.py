"""Comparing snapshots (SET-1, SET-2, VFY-1 to VFY-5, SRT-1, SRT-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import mode_bits
from ..sources.snapshots import keep


def path_order(df: DataFrame, deepest_first: bool = False) -> DataFrame:
    """Parents before children, by components; or the reverse, for deletions."""
    by = F.split("path", "/")
    return df.orderBy(by.desc() if deepest_first else by.asc())


def places(df: DataFrame, *order: Column, down: bool = False, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in a total order or, with `down`, against it (SRT-1 to SRT-3).

    Ranges of the order are sorted apart and written once; a row per range gives each range's first place. No task sees
    more than its range.
    """
    by = {f"{name}_{k}": o for k, o in enumerate(order)}
    keys = [F.desc(c) if down else F.asc(c) for c in by]
    sorted_up = df.withColumns(by).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*by)
    inner, part = F.monotonically_increasing_id(), F.spark_partition_id()
    fixed = keep(sorted_up.withColumns({f"{name}_part": part, name: F.pmod(inner, F.lit(1 << 33)) + 1}), "places")
    counts = fixed.groupBy(f"{name}_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(f"{name}_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    first = counts.select(f"{name}_part", F.coalesce(before, F.lit(0)).alias("n"))
    return fixed.join(F.broadcast(first), f"{name}_part").withColumn(name, F.col(name) + F.col("n")).select(*df.columns, name)


def path_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths on one side only: path, side (left or right)."""
    both = a.select(F.col("path").alias("l")).distinct().join(b.select(F.col("path").alias("r")).distinct(), F.col("l") == F.col("r"), "full_outer")
    return both.where("l IS NULL OR r IS NULL").select(F.coalesce("l", "r").alias("path"), F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def first_difference(tolerance_s: int | None = None, owner: bool = False, group: bool = False) -> Column:
    """What differs first between source s and destination d, or null."""
    if tolerance_s is None:
        time = (_c("s", "mtime_s") != _c("d", "mtime_s")) | (_c("s", "mtime_ns") != _c("d", "mtime_ns"))
    else:
        ns = lambda side: _c(side, "mtime_s") * 1_000_000_000 + _c(side, "mtime_ns")
        time = F.abs(ns("s") - ns("d")) > tolerance_s * 1_000_000_000
    content = (_c("s", "len") != _c("d", "len")) | ~_c("s", "hash").eqNullSafe(_c("d", "hash"))
    return (
        F.when(_c("d", "path").isNull(), "missing from destination")
        .when(_c("s", "path").isNull(), "extra in destination")
        .when(_c("s", "kind") != _c("d", "kind"), "file kind differs")
        .when(mode_bits(_c("s", "mode")) != mode_bits(_c("d", "mode")), "mode differs")
        .when(time, "mtime differs")
        .when(F.lit(owner) & ~_c("s", "uid").eqNullSafe(_c("d", "uid")), "uid differs")
        .when(F.lit(group) & ~_c("s", "gid").eqNullSafe(_c("d", "gid")), "gid differs")
        .when((_c("s", "kind") == "file") & content, "content differs")
        .when((_c("s", "kind") == "symlink") & ~_c("s", "target").eqNullSafe(_c("d", "target")), "symlink target differs")
    )


def verify(src: DataFrame, dst: DataFrame, scope: str = "all", plan: DataFrame | None = None, tolerance_s: int | None = None, owner: bool = False, group: bool = False) -> DataFrame:
    """path, detail of every mismatch. scope: none, changed (non-skip rows of the plan), or all (extras too)."""
    if scope == "changed":
        src = src.join(plan.where("action IN ('copy', 'update')").select("path"), "path", "left_semi")
    joined = src.alias("s").join(dst.alias("d"), _c("s", "path") == _c("d", "path"), "full_outer" if scope == "all" else "left")
    found = joined.select(F.coalesce(_c("s", "path"), _c("d", "path")).alias("path"), first_difference(tolerance_s, owner, group).alias("detail"))
    return found.where(F.col("detail").isNotNull() & F.lit(scope != "none"))


def parity(a: DataFrame, b: DataFrame, tolerance_s: int = 1) -> DataFrame:
    """Mismatches of two snapshots, with times allowed to differ by `tolerance_s`."""
    return verify(a, b, "all", tolerance_s=tolerance_s)


def verify_links(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Members of a source link group whose destination identity is not that of the group's first path."""
    files = src.where("kind = 'file' AND dev IS NOT NULL AND ino IS NOT NULL").select("path", "dev", "ino")
    placed = files.join(dst.select(F.col("path").alias("dst_path"), F.struct("dev", "ino").alias("id")), F.col("path") == F.col("dst_path"), "left")
    order = F.struct(F.split("path", "/").alias("p"), F.col("id"), F.col("path"))
    first = placed.groupBy(F.col("dev").alias("g_dev"), F.col("ino").alias("g_ino")).agg(F.min(order).alias("f"), F.count("*").alias("members")).where("members > 1")
    joined = placed.join(first, (F.col("dev") == F.col("g_dev")) & (F.col("ino") == F.col("g_ino")))
    wrong = (F.col("path") != F.col("f.path")) & ~F.col("id").eqNullSafe(F.col("f.id"))
    return joined.where(wrong).select("path", F.lit("hard-link identity differs").alias("detail"))


def verify_summary(checked: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Mismatches by detail, with the number of entries checked."""
    return mismatches.groupBy("detail").agg(F.count("*").alias("mismatches")).crossJoin(F.broadcast(checked.agg(F.count("*").alias("checked"))))
