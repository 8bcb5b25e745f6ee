"""Reading snapshots and publishing them (SRC-1 to SRC-6, SNK-1)."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import components
from ..functions.sha256 import Sha256
from ..schemas import BENCH_RUNS


#: Larger files of mounted trees are hashed by several tasks, one after the other; the most bytes that one of these reads.
WHOLE, STRETCH = 64 << 20, 256 << 20


def scan_files(spark: SparkSession, root: str, glob: str | None = None, with_hash: bool = False) -> DataFrame:
    """Entries of all files below a root. Contents are read only for hashes.

    Spark lists no directories, no empty files and no names that start with '.' or '_'; `listing.list_tree` lists all of a
    mounted tree. A file of a mounted tree may have any length; elsewhere, Spark reads a file as one value of at most 2 GB.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    files = _hashed(files, root) if with_hash else files.withColumn("hash", F.lit(None).cast("string"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    micros = F.unix_micros("modificationTime")
    path = F.regexp_replace("path", rf"^(?:[a-z0-9]+:)?/*\Q{base}\E/", "")
    return files.select(
        path.alias("path"), F.lit("file").alias("kind"), F.col("length").alias("len"), F.floor(micros / 1_000_000).cast("long").alias("mtime_s"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_ns"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("mode", "int"), ("uid", "int"), ("gid", "int"), ("dev", "bigint"), ("ino", "bigint"), ("target", "string"))],
        "hash",
    )


def _hashed(files: DataFrame, root: str) -> DataFrame:
    """The files (of binaryFile) with their SHA-256; those above WHOLE bytes are hashed at once, if they lie in a mounted tree."""
    whole = F.sha2("content", 256).alias("hash")
    if _fs(files.sparkSession, root)[0].getScheme() != "file":
        return files.select("path", "modificationTime", "length", whole)
    some, long = files.where(F.col("length") <= WHOLE).select("path", "modificationTime", "length", whole), files.where(F.col("length") > WHOLE).select("path", "modificationTime", "length")
    sizes = {r.path: r.length for r in long.select("path", "length").collect()}  # no more than Spark's own listing holds
    if not sizes:
        return some
    hashes = files.sparkSession.createDataFrame(list(_hash_long(files.sparkSession, sizes).items()), "path string, hash string")
    return some.union(long.join(F.broadcast(hashes), "path"))


def _hash_long(spark: SparkSession, sizes: dict[str, int]) -> dict[str, str]:
    """The SHA-256 of each file. A task takes one stretch of a file, from the state (32 bytes) that the task before it left."""
    stretch, done, open_ = STRETCH, {}, [(path, n, 0, b"") for path, n in sizes.items()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, n, at, state = work[k]
                sha, stop = Sha256(state, at), min(n, at + stretch)
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
                    f.seek(at)
                    while at < stop:
                        part = f.read(min(stop - at, 4 << 20))
                        if not part:
                            raise OSError(f"{path} became shorter than its {n} bytes while it was read")
                        sha.update(part)
                        at += len(part)
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([sha.digest() if at == n else sha.state()])], ["k", "state"])

    while open_:
        work = open_
        found = spark.range(0, len(work), 1, len(work)).mapInArrow(step, "k long, state binary").collect()
        open_ = []
        for k, state in found:
            path, n, at, _ = work[k]
            if at + stretch >= n:
                done[path] = bytes(state).hex()
            else:
                open_.append((path, n, at + stretch, bytes(state)))
    return done


def normalize_entries(df: DataFrame, root: str | None = None) -> DataFrame:
    """Known kinds only, length 0 for what is no file, paths relative to the root."""
    out = df.where(F.col("kind").isin("file", "dir", "symlink"))
    if root:
        out = out.withColumn("path", F.regexp_replace("path", rf"^\Q{root.rstrip('/')}\E/", ""))
    return out.withColumn("len", F.when(F.col("kind") == "file", F.col("len")).otherwise(0))


def with_directories(entries: DataFrame) -> DataFrame:
    """path, kind, depth of all entries and of every directory above them, once."""
    parts = components("path")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = entries.where(F.size(parts) > 1).select(F.explode(above).alias("path"), F.lit("dir").alias("kind")).distinct()
    known = entries.select("path", "kind")
    dirs = dirs.join(known.select("path"), "path", "left_anti")
    return known.union(dirs).withColumn("depth", F.size(components("path")))


class TooManyPathsError(ValueError):
    """A path list is longer than allowed."""


def path_list(lines: DataFrame, max_lines: int = 1_000_000) -> DataFrame:
    """path from value: blank lines and lines that start with '#' are skipped, the rest is trimmed."""
    if lines.limit(max_lines + 1).count() > max_lines:
        raise TooManyPathsError(f"more than {max_lines} lines")
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.trim("value").alias("path"))


def read_path_list(spark: SparkSession, file: str, max_lines: int = 1_000_000) -> DataFrame:
    return path_list(spark.read.text(file), max_lines)


def entries_from_table(df: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """A keyed table as entries: the path from its keys, the hash from its payload.

    Within a key '%' and '/' are escaped, and a null key is '%N', so different keys have different paths.
    """
    part = lambda k: F.coalesce(F.replace(F.replace(F.col(k).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("%N"))
    return df.select(F.concat_ws("/", *map(part, keys)).alias("path"), F.lit("file").alias("kind"), F.sha2(F.to_json(F.struct(*payload)), 256).alias("hash"))


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH_RUNS).csv(path, header=True)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored_bytes(spark: SparkSession, path: str) -> int:
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


class ConflictError(RuntimeError):
    """Another version was published since the one that was read."""


#: A version, and what a broken run left behind, is removed this long after it was written.
RETAIN_S = 7 * 86400


def listed(spark: SparkSession, pattern: str) -> list:
    fs, at = _fs(spark, pattern)
    return list(fs.globStatus(at) or [])


def commits(spark: SparkSession, target: str) -> list[dict]:
    """The published versions, newest first: number, version, at (epoch milliseconds), rows.

    A number whose file is still empty was taken by a writer that has not committed, and perhaps never will.
    """
    found = []
    for status in listed(spark, f"{target}/log/*.json"):
        fs, at = _fs(spark, status.getPath().toString())
        stream = fs.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("}"):
            found.append(json.loads(text))
    return sorted(found, key=lambda c: -c["number"])


def _taken(spark: SparkSession, target: str) -> int:
    """The highest number that any writer has taken; 0 without one."""
    return max([0, *(int(s.getPath().getName().removesuffix(".json")) for s in listed(spark, f"{target}/log/*.json"))])


def manifest(df: DataFrame) -> DataFrame:
    """file, bytes, rows, digest of each file that a table of files is read from; the digest is of all values."""
    name = F.col("_metadata.file_name")
    hashed = df.select(name.alias("file"), F.col("_metadata.file_size").alias("bytes"), F.xxhash64(*df.columns).alias("h"))
    return hashed.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"))


def publish(df: DataFrame, target: str, based_on: int | None = None, retain_s: float = RETAIN_S, attempts: int = 20) -> str:
    """Writes a new version beside the others, then commits it under the next number; readers see old or new.

    A commit is a file that is created only if its number is free, so of two writers one gets the number and the other
    takes the next. A writer whose rows derive from a version names its number in `based_on`: if another one was
    published since, nothing is committed and ConflictError tells to start again. Versions stay for `retain_s` seconds
    after they were replaced; so does what has not been committed yet.
    """
    spark, version = df.sparkSession, new_version()
    df.write.parquet(f"{target}/v-{version}")
    manifest(spark.read.schema(df.schema).parquet(f"{target}/v-{version}")).coalesce(1).write.parquet(f"{target}/m-{version}")
    commit(spark, target, version, based_on, retain_s, attempts)
    return version


def new_version() -> str:
    return uuid.uuid4().hex


def commit(spark: SparkSession, target: str, version: str, based_on: int | None = None, retain_s: float = RETAIN_S, attempts: int = 20, **noted: object) -> int:
    """Commits a version that was written, with what is noted of it, and returns its number; ConflictError as publish() says."""
    for _ in range(attempts):
        known = commits(spark, target)
        if based_on is not None and (known[0]["number"] if known else 0) != based_on:
            break
        number = max(_taken(spark, target), known[0]["number"] if known else 0) + 1
        if based_on is not None and number != based_on + 1 and not _stale(spark, target, based_on, number):
            time.sleep(0.2)  # another writer holds the next number
            continue
        if _claimed(spark, f"{target}/log/{number:020d}.json", json.dumps({"number": number, "version": version, "at": int(time.time() * 1000)} | noted)):
            _expire(spark, target, retain_s)
            return number
    for part in ("v", "m"):
        remove(spark, f"{target}/{part}-{version}")
    raise ConflictError(f"{target} has moved on from version {based_on}" if based_on is not None else f"no free number at {target}")


def _claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file did not exist and now holds the text."""
    fs, at = _fs(spark, path)
    if fs.getScheme() == "file":  # where Spark's own create is no single step
        file = at.toUri().getPath()
        os.makedirs(os.path.dirname(file), exist_ok=True)
        draft = f"{file}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, file)
        except FileExistsError:
            return False
        finally:
            os.remove(draft)
        return True
    try:
        stream = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _stale(spark: SparkSession, target: str, after: int, before: int, wait_s: float = 60) -> bool:
    """Whether all numbers between the two were taken so long ago that their writers must have failed."""
    held = [s for s in listed(spark, f"{target}/log/*.json") if after < int(s.getPath().getName().removesuffix(".json")) < before]
    return all(s.getModificationTime() < (time.time() - wait_s) * 1000 for s in held)


def _expire(spark: SparkSession, target: str, retain_s: float) -> None:
    """Removes versions that were replaced, and parts of uncommitted ones that were written, more than `retain_s` ago."""
    limit, known = (time.time() - retain_s) * 1000, commits(spark, target)
    replaced = {c["version"]: later["at"] for later, c in zip(known, known[1:])}
    held = {v for c in known if replaced.get(c["version"], limit) >= limit for v in c.get("folders", {}).values()}  # folders that a later version shares
    for status in listed(spark, f"{target}/[vm]-*"):
        name = status.getPath().getName()[2:]
        if name in held:
            continue
        if (replaced.get(name, limit) < limit) or (name not in {c["version"] for c in known} and status.getModificationTime() < limit):
            remove(spark, status.getPath().toString())
    for c in known[1:]:
        if replaced[c["version"]] < limit:
            remove(spark, f"{target}/log/{c['number']:020d}.json")


def current_commit(spark: SparkSession, target: str) -> dict:
    known = commits(spark, target)
    if not known:
        raise FileNotFoundError(target)
    return known[0]


def current_version(spark: SparkSession, target: str) -> str:
    return current_commit(spark, target)["version"]


def read_published(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one of a number."""
    for c in commits(spark, target):
        if number in (None, c["number"]):
            return spark.read.parquet(f"{target}/v-{c['version']}")
    raise FileNotFoundError(target if number is None else f"{target}, version {number}")


def read_version(spark: SparkSession, target: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v-{version}")


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """The files of the newest version that are missing, unknown, or differ from its manifest in length, rows or values.

    Reading it fails where a file cannot be decoded.
    """
    version = current_version(spark, target)
    there = manifest(spark.read.parquet(f"{target}/v-{version}")).alias("a")
    noted = spark.read.parquet(f"{target}/m-{version}").alias("b")
    same = F.lit(True)
    for c in ("bytes", "rows", "digest"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return there.join(noted, F.col("a.file") == F.col("b.file"), "full_outer").where(~same).select(F.coalesce("a.file", "b.file").alias("file"))


def published_bytes(spark: SparkSession, target: str) -> int:
    """Stored bytes of the current version alone; 0 where there is none."""
    try:
        return stored_bytes(spark, f"{target}/v-{current_version(spark, target)}")
    except FileNotFoundError:
        return 0


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, local sessions get one for the application; a
    cluster has no folder that all its machines share, and the job stops."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        at = _OWN[app]
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: what follows sees one fixed result."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
