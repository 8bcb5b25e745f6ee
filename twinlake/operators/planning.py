"""Plans: what must happen for a destination to mirror a source (PLN-1 to PLN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import depth, mode_bits
from .filters import live_differs


class EmptySourceError(ValueError):
    """Deleting against an empty source would empty the destination."""


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def _metadata_differs() -> Column:
    """Permission bits, or modification time in whole seconds."""
    return (mode_bits(_c("s", "mode")) != mode_bits(_c("d", "mode"))) | (_c("s", "mtime_s") != _c("d", "mtime_s"))


def content_differs(checksum: bool) -> Column:
    """For two files: by hash (an unreadable side differs), or by length; metadata counts in both."""
    if checksum:
        return _metadata_differs() | ~F.coalesce(_c("s", "hash") == _c("d", "hash"), F.lit(False))
    return (_c("s", "len") != _c("d", "len")) | _metadata_differs()


def pair_action(checksum: bool) -> Column:
    """copy, update or skip for a source entry (s) and the destination entry of its path (d), if any."""
    kind = _c("s", "kind")
    differs = (
        F.when(kind != _c("d", "kind"), True)
        .when(kind == "dir", _metadata_differs())
        .when(kind == "symlink", ~_c("s", "target").eqNullSafe(_c("d", "target")) | (_c("s", "mtime_s") != _c("d", "mtime_s")))
        .otherwise(content_differs(checksum))
    )
    return F.when(_c("d", "path").isNull(), "copy").when(F.coalesce(differs, F.lit(True)), "update").otherwise("skip")


def _joined(src: DataFrame, dst: DataFrame, how: str) -> DataFrame:
    return src.alias("s").join(dst.alias("d"), _c("s", "path") == _c("d", "path"), how)


def build_plan(src: DataFrame, dst: DataFrame, checksum: bool = False) -> DataFrame:
    """Source entries with an action; one equi-join whose strategy is Catalyst's choice."""
    return _joined(src, dst, "left").select("s.*", pair_action(checksum).alias("action"))


def deletions(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Destination entries absent from the source, deepest first."""
    return dst.join(src.select("path"), "path", "left_anti").orderBy(F.desc(F.split("path", "/")))


def mirror_plan(src: DataFrame, dst: DataFrame, checksum: bool = False, delete: bool = True) -> DataFrame:
    """Copies, updates, skips and deletions from one full outer join; entries of deletions are the destination's."""
    both = _joined(src, dst, "full_outer" if delete else "left")
    gone = _c("s", "path").isNull()
    columns = [F.when(gone, _c("d", c)).otherwise(_c("s", c)).alias(c) for c in src.columns if c in dst.columns]
    plan = both.select(*columns, F.when(gone, "delete").otherwise(pair_action(checksum)).alias("action"))
    return plan.withColumn("depth", depth("path"))


def enforce_links(plan: DataFrame, dst: DataFrame) -> DataFrame:
    """Files of one source (dev, ino) group must share the destination identity of the group's first path.

    The first member is found by a partial aggregate per group and joined back, so a group may be of any size.
    """
    identity = dst.select(F.col("path").alias("dst_path"), F.struct("dev", "ino").alias("dst_id"))
    known = plan.join(identity, F.col("path") == F.col("dst_path"), "left")
    files = known.where("kind = 'file' AND action != 'delete' AND dev IS NOT NULL AND ino IS NOT NULL")
    order = F.struct(F.split("path", "/").alias("p"), F.col("dst_id"), F.col("path"))
    first = files.groupBy(F.col("dev").alias("g_dev"), F.col("ino").alias("g_ino")).agg(F.min(order).alias("f"), F.count("*").alias("members")).where("members > 1")
    first = first.select("g_dev", "g_ino", F.col("f.dst_id").alias("first_id"), F.col("f.path").alias("first_path"))
    joined = known.join(first, (F.col("dev") == F.col("g_dev")) & (F.col("ino") == F.col("g_ino")) & (F.col("kind") == "file") & (F.col("action") != "delete"), "left")
    forced = F.col("first_path").isNotNull() & (F.col("path") != F.col("first_path")) & ~F.col("dst_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("action", F.when(forced, "update").otherwise(F.col("action"))).select(*plan.columns)


def plan_from_index(src: DataFrame, index: DataFrame, live: DataFrame | None = None, checksum: bool = False) -> DataFrame:
    """Actions from recorded state at full time precision, without listing the destination.

    live, where given, is destination state of recorded paths: drift from the record is an update.
    """
    s, r = "s", "r"
    same = (_c(s, "len") == _c(r, "len")) & (_c(s, "mtime_s") == _c(r, "mtime_s")) & (_c(s, "mtime_ns") == _c(r, "mtime_ns"))
    same &= mode_bits(_c(s, "mode")) == mode_bits(_c(r, "mode"))
    same &= _c(s, "kind") == _c(r, "kind")
    same &= (_c(s, "kind") != "symlink") | _c(s, "target").eqNullSafe(_c(r, "target"))
    if checksum:
        same &= (_c(s, "kind") != "file") | F.coalesce(_c(s, "hash") == _c(r, "hash"), F.lit(False))
    joined = src.alias(s).join(index.alias(r), _c(s, "path") == _c(r, "path"), "left")
    if live is not None:
        joined = joined.join(live.alias("d"), _c(r, "path") == _c("d", "path"), "left")
        same &= ~live_differs()
    action = F.when(_c(r, "path").isNull(), "copy").when(F.coalesce(same, F.lit(False)), "skip").otherwise("update")
    return joined.select("s.*", action.alias("action"))


def indexed_plan(src: DataFrame, dst: DataFrame, index: DataFrame, checksum: bool = False, delete: bool = True) -> DataFrame:
    """The mirror plan by recorded state: actions from the index, checked against the live destination, and deletions
    from the live destination alone."""
    columns = [c for c in src.columns if c in dst.columns]
    plan = plan_from_index(src, index, dst, checksum).select(*columns, "action")
    if delete:
        plan = plan.union(dst.join(src.select("path"), "path", "left_anti").select(*columns, F.lit("delete")))
    return plan.withColumn("depth", depth("path"))


def requested(src: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the entries that were asked for, an error row for each path asked for that the source does not have)."""
    wanted = paths.select("path").distinct()
    missing = wanted.join(src.select("path"), "path", "left_anti").select("path", F.lit("not found at the source").alias("error"))
    return src.join(wanted, "path", "left_semi"), missing


def transfer_plan(src: DataFrame, dst: DataFrame, whole_file: bool = False, checksum: bool = False) -> DataFrame:
    """How each source file is sent: skip (same length and time to the nanosecond), delta (dst has a file) or whole."""
    existing = F.coalesce(_c("d", "kind") == "file", F.lit(False))
    same = F.lit(not checksum) & existing & (_c("s", "len") == _c("d", "len")) & (_c("s", "mtime_s") == _c("d", "mtime_s")) & (_c("s", "mtime_ns") == _c("d", "mtime_ns"))
    how = F.when(same, "skip").when(existing & F.lit(not whole_file), "delta").otherwise("whole")
    return _joined(src.where("kind = 'file'"), dst, "left").select("s.*", how.alias("transfer"))


def guard_empty(src: DataFrame, delete: bool) -> None:
    if delete and src.isEmpty():
        raise EmptySourceError("the source is empty; refusing to delete everything")


def apply_phases(plan: DataFrame) -> DataFrame:
    """phase and depth columns (SRT-3): dirs 0, files 1, hard links 2, symlinks 3, deletions 4."""
    linked = plan.where("kind = 'file' AND action != 'delete' AND dev IS NOT NULL AND ino IS NOT NULL")
    first = linked.groupBy(F.col("dev").alias("g_dev"), F.col("ino").alias("g_ino")).agg(F.min(F.split("path", "/")).alias("first"), F.count("*").alias("members")).where("members > 1")
    joined = plan.join(first, (F.col("dev") == F.col("g_dev")) & (F.col("ino") == F.col("g_ino")), "left")
    later = F.col("first").isNotNull() & (F.split("path", "/") != F.col("first"))
    phase = F.when(F.col("action") == "delete", 4).when(F.col("kind") == "dir", 0).when(F.col("kind") == "symlink", 3).when(later, 2).otherwise(1)
    return joined.select(*[c for c in plan.columns if c not in ("phase", "depth")], phase.alias("phase"), depth("path").alias("depth"))


def apply_keys() -> list[Column]:
    """The order of application: phases, parents before children, deletions deepest first, then by path."""
    return [F.col("phase"), F.when(F.col("phase") == 4, -F.col("depth")).otherwise(F.col("depth")), F.split("path", "/")]


def apply_order(plan: DataFrame) -> DataFrame:
    """apply_phases() sorted by apply_keys()."""
    return apply_phases(plan).orderBy(*apply_keys())


def canonical_members(entries: DataFrame) -> DataFrame:
    """Each file with the first path of its (dev, ino) group (WIN-2): a partial aggregate joined back, so a group may be
    of any size; a file without dev or ino is its own."""
    files = entries.where("kind = 'file'")
    first = files.where("dev IS NOT NULL AND ino IS NOT NULL").groupBy(F.col("dev").alias("g_dev"), F.col("ino").alias("g_ino")).agg(F.min(F.split("path", "/")).alias("first"))
    joined = files.join(first, (F.col("dev") == F.col("g_dev")) & (F.col("ino") == F.col("g_ino")), "left")
    return joined.select(*entries.columns, F.coalesce(F.array_join("first", "/"), "path").alias("canonical"))
