"""The index: a snapshot overlaid with a journal of changes (IDX-1 to IDX-6, STR-8)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import ENTRIES, ENTRY_COLUMNS, INDEX_VERSION, JOURNAL
from ..sources.snapshots import damaged, publish, published_bytes, read_published, remove, stored_bytes

COMPACT_BYTES = 64 << 20
RECORD_COLUMNS = ENTRY_COLUMNS[1:]
_RECORD = ENTRIES.split(", ", 1)[1]


def build_index(plan: DataFrame, with_hash: bool = False) -> DataFrame:
    """The first snapshot: all entries of a plan, or of a listing, that are there afterwards; hashes only in checksum mode."""
    kept = plan.where("action != 'delete'") if "action" in plan.columns else plan
    known = [c for c in plan.columns if with_hash or c != "hash"]
    fields = [(F.col(c) if c in known else F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in ENTRIES.split(", "))]
    return kept.select(*fields, F.lit(INDEX_VERSION).alias("version"))


def valid_prefix(journal: DataFrame, key: str = "record") -> DataFrame:
    """Records before the first whose checksum is wrong or missing; replay never goes past it."""
    bad = F.coalesce(F.sha2(F.col(key).cast("binary"), 256) != F.col("checksum"), F.lit(True))
    first_bad = journal.agg(F.min(F.when(bad, F.col("seq"))).alias("first_bad"))  # one row
    return journal.crossJoin(F.broadcast(first_bad)).where("first_bad IS NULL OR seq < first_bad").drop("first_bad")


def latest(changes: DataFrame, key: str = "path") -> DataFrame:
    """The newest change per key, by partial aggregation, so a hot key is no burden."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), "seq").alias("last")).select(key, "last.*")


def latest_by_rank(changes: DataFrame, key: str = "path") -> DataFrame:
    """The same by a window (WIN-3)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return changes.withColumn("rank", rank).where("rank = 1").drop("rank")


def load_index(snapshot: DataFrame, journal: DataFrame, key: str = "path", record: str = "record") -> DataFrame:
    """key, record: the snapshot with the valid journal replayed over it."""
    last = latest(valid_prefix(journal, record), key).select(F.col(key).alias("k"), "op", F.col(record).alias("new"))
    both = snapshot.join(last, F.col(key) == F.col("k"), "full_outer")
    value = F.when(F.col("op") == "upsert", F.col("new")).otherwise(F.col(record))
    return both.where("op IS NULL OR op != 'delete'").select(F.coalesce(key, "k").alias(key), value.alias(record))


def as_records(entries: DataFrame) -> DataFrame:
    """path, record: what is known of each entry besides its path, as JSON; the one form of stored index records."""
    return entries.select("path", F.to_json(F.struct(*[c for c in RECORD_COLUMNS if c in entries.columns])).alias("record"))


def from_records(records: DataFrame) -> DataFrame:
    """The entries, with the version, of rows (path, record)."""
    return records.select("path", F.from_json("record", _RECORD).alias("r")).select("path", "r.*", F.lit(INDEX_VERSION).alias("version"))


def replayed(index: DataFrame, journal: DataFrame) -> DataFrame:
    """An index with its journal replayed: IDX-2 for entries."""
    return from_records(load_index(as_records(index), journal))


def merge_changes(state: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """State rows (key, seq, op, record) after a batch of changes in any order: the highest seq of a key wins."""
    return latest(state.unionByName(batch), key)


def journal_records(plan: DataFrame, index: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """path, op, record: upserts of changed entries (as `after`, the destination, holds them), and deletes of entries that
    were recorded."""
    changed = plan.where("action IN ('copy', 'update')")
    if after is not None:
        changed = after.join(changed.select("path"), "path", "left_semi")
    upserts = as_records(changed).select("path", F.lit("upsert").alias("op"), "record")
    deletes = plan.where("action = 'delete'").join(index.select("path"), "path", "left_semi")
    return upserts.union(deletes.select("path", F.lit("delete").alias("op"), F.lit("").alias("record")))


def sealed(records: DataFrame, first_seq: int = 0) -> DataFrame:
    """Journal rows (seq, op, path, record, checksum) of records (path, op, record) with one record for a path; numbers
    rise from `first_seq`, with gaps."""
    record = F.coalesce("record", F.lit(""))
    return records.select((F.monotonically_increasing_id() + first_seq).alias("seq"), "op", "path", record.alias("record"), F.sha2(record.cast("binary"), 256).alias("checksum"))


def read_journal(spark: SparkSession, directory: str) -> DataFrame:
    """The stored journal; no rows where there is none."""
    if stored_bytes(spark, f"{directory}/journal") == 0:
        return spark.createDataFrame([], JOURNAL)
    return spark.read.schema(JOURNAL).parquet(f"{directory}/journal")


def append_journal(records: DataFrame, directory: str) -> None:
    """Adds records behind the last number of the journal, so that later changes win. Nothing is written for no change."""
    if not records.isEmpty():
        last = read_journal(records.sparkSession, directory).agg(F.max("seq").alias("n")).first()["n"]
        sealed(records, 0 if last is None else last + 1).write.mode("append").parquet(f"{directory}/journal")


def needs_compaction(spark: SparkSession, directory: str) -> bool:
    """Journal above 64 MiB, or above a tenth of the snapshot."""
    journal, snapshot = stored_bytes(spark, f"{directory}/journal"), published_bytes(spark, f"{directory}/snapshot")
    return journal > COMPACT_BYTES or (snapshot > 0 and journal > snapshot / 10)


def save_index(index: DataFrame, directory: str) -> None:
    """Publishes a whole snapshot; the journal starts afresh.

    Should the job end between the two, the old journal is replayed over the new snapshot, which already holds its
    changes: the result is the same.
    """
    publish(index, f"{directory}/snapshot")
    remove(index.sparkSession, f"{directory}/journal")


def compact(spark: SparkSession, directory: str) -> None:
    """A new snapshot from the old one and the journal, in the form that build_index() gives."""
    save_index(replayed(read_published(spark, f"{directory}/snapshot"), read_journal(spark, directory)), directory)


def try_load_index(spark: SparkSession, directory: str) -> DataFrame | None:
    """The published index with its journal replayed, or None where it is missing, damaged or of another version: a full
    plan is due.

    The snapshot is read once against its manifest, the journal's records against their checksums in replay; a journal
    that cannot be read makes the index unusable, too.
    """
    try:
        if not damaged(spark, f"{directory}/snapshot").isEmpty():
            return None
        index = read_published(spark, f"{directory}/snapshot")
        if not index.where(~F.col("version").eqNullSafe(F.lit(INDEX_VERSION))).isEmpty():
            return None
        journal = read_journal(spark, directory)
        journal.agg(F.max(F.xxhash64(*journal.columns))).first()  # all of its pages
    except (PySparkException, Py4JJavaError, FileNotFoundError):
        return None
    return replayed(index, journal)


def persist_after_plan(plan: DataFrame, after: DataFrame, directory: str, with_hash: bool = False) -> None:
    """Once a plan was applied without fault: the first snapshot of the planned entries as the destination (`after`) holds
    them, or the plan's changes behind the journal; compacted when due."""
    spark = plan.sparkSession
    known = try_load_index(spark, directory)
    if known is None:
        save_index(build_index(after.join(plan.where("action != 'delete'").select("path"), "path", "left_semi"), with_hash), directory)
        return
    append_journal(journal_records(plan, known, after if with_hash else after.drop("hash")), directory)
    if needs_compaction(spark, directory):
        compact(spark, directory)
