"""Operator 1: near-duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

1. sketch(): per document the set's size and 128-bit fingerprint, 25 band keys of 5 minima each, and the 128
   minima cut to 4 bits, stored as 4 bit planes of 2 longs.
2. Documents with equal sets form a class; only classes go on.
3. In each band bucket every class is paired with the bucket's first class (a star, linear in the bucket's size).
   Pairs pass if sizes allow the threshold and the collision-corrected estimate, by bit counts over the planes,
   is within five standard errors of it; then full sets decide.
4. Components of these links, by alternating large-star and small-star steps over checkpointed tables.
5. Buckets that still hold several components have their remaining cross-component pairs tested too, in blocks of
   about `block` classes, each pair only in its first common band: first by sizes and estimates, then, with the texts of
   those members that may have a link, on full sets; then components again.

A link at the threshold is missed by all bands with probability (1 - 0.85^5)^25 = 4e-7. No bucket is capped.

Defined results: null or empty texts and texts of blanks have an empty set and are linked with nothing; with fewer
words than a shingle, the whole sequence is the one shingle; rows that share a doc_id each have a row; rows
with a null doc_id take part, and their component is the smallest doc_id in it (null if there is none); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

HASHES, ROWS, BANDS, BITS = 128, 5, 25, 4
_PLANES = BITS * HASHES // 64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_ODD = [np.uint64(x | 1) for x in _RNG.integers(1 << 62, 1 << 63, 8, dtype=np.uint64).tolist()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[6]
    x = (x ^ (x >> np.uint64(29))) * _ODD[7]
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sets of 64-bit shingle hashes; word hashes are kept in a bounded table."""

    def __init__(self, words: int = 5, limit: int = 500_000):
        self.words, self.limit, self.table = words, limit, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles."""
        parts = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
        if not parts:
            return np.zeros(0, np.uint64)
        if len(parts) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), len(parts))], np.uint64)
        if len(self.table) > self.limit:
            self.table = {}
        table = self.table
        new = set(parts).difference(table)
        table.update(zip(new, map(xxhash.xxh3_64_intdigest, new)))
        h = np.fromiter(map(table.__getitem__, parts), np.uint64, len(parts))
        n = len(h) - self.words + 1
        total = np.zeros(n, np.uint64)
        for k in range(self.words):
            total = total * _ODD[5] + h[k : k + n]
        return np.unique(_mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    h, low = (shingles >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(h), 2048):
        some = (h[None, at : at + 2048] * _A + _B).min(axis=1)
        low = some if low is None else np.minimum(low, some)
    return low


def signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and the packed low bits of the minima as bit planes."""
    wide = low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _ODD[0]
    for k in range(ROWS):
        key = _mix(key * _ODD[1] + wide[:, k])
    bits = ((low * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.uint8)
    planes = np.packbits((bits[None, :] >> np.arange(BITS, dtype=np.uint8)[:, None]) & 1, axis=1)
    return key.view(np.int64), planes.view(np.int64).ravel()


def sketch(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """key, text_key (of the whole text), set_key, n_shingles, bands, planes; the last two empty for empty sets."""
    src = df.select(F.col(key).alias("key"), F.md5(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, none = Shingles(words), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for whole in batches:
            for batch in slices(whole):
                found = [sets.of(t) for t in batch.column("text").to_pylist()]
                made = [signature(minima(s)) if len(s) else none for s in found]
                yield pa.record_batch(
                    [batch.column("key"), batch.column("text_key"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()), pa.array([b for b, _ in made], pa.list_(pa.int64())), pa.array([p for _, p in made], pa.list_(pa.int64()))],
                    ["key", "text_key", "set_key", "n_shingles", "bands", "planes"],
                )

    return src.mapInArrow(sketched, f"key {kind}, text_key string, set_key binary, n_shingles long, bands array<long>, planes array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of equal b-bit minima, less the chance collisions."""
    half = HASHES // 64
    differ = F.lit(0)
    for k in range(half):
        either = F.lit(0).cast("long")
        for plane in range(BITS):
            either = either.bitwiseOR(a[plane * half + k].bitwiseXOR(b[plane * half + k]))
        differ = differ + F.bit_count(either)
    chance = 2.0**-BITS
    return ((HASHES - differ) / F.lit(float(HASHES)) - chance) / (1 - chance)


def slack(percent: int, errors: float = 5.0) -> float:
    """The estimate's allowance below the threshold: `errors` standard errors."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return errors * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets meet 100 * intersection >= percent * union."""
    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, at, mine = Shingles(words), None, None
        for whole in batches:
            for batch in slices(whole, 256):
                keep = []
                for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                    if a != at:
                        at, mine = a, sets.of(ta)
                    other = sets.of(tb)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append(100 * both >= percent * (len(mine) + len(other) - both))
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(confirmed, "a binary, b binary")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """node, root: the smallest node of each node's component, for every node of the links (a, b)."""
    at, before, step = scratch.keep(links.select("a", "b").where("a != b"), f"{name}-0"), None, 0
    while True:
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(root.select("a", "m")).distinct()
        step += 1
        new = scratch.keep(small, f"{name}-{step}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if state == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        at, before = new, state


def _likely(pdf: pd.DataFrame, root: np.ndarray, percent: int, allowance: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a block those whose sizes and estimate allow a link, in a component of their own as `root` stands
    at the time; a pair is given only in its first common band, and the bucket's lead is left out."""
    lo, hi, chunk, lead = pdf["lo"].iat[0], pdf["hi"].iat[0], pdf["chunk"].to_numpy(), pdf["lead"].iat[0]
    bands, planes = np.stack(pdf["bands"].to_numpy()), np.stack(pdf["planes"].to_numpy()).astype(np.int64).view(np.uint64)  # unsigned: numpy counts the bits of absolute values
    n, key = pdf["n"].to_numpy(np.int64), pdf["set_key"].to_numpy()
    chance, half = 2.0**-BITS, HASHES // 64
    band = int(np.flatnonzero(bands[0] == pdf["bkey"].iat[0])[0])
    for i in np.flatnonzero(chunk == lo):
        if key[i] == lead:
            continue
        other = chunk == hi
        if lo == hi:
            other &= np.arange(len(n)) > i
        other &= (root != root[i]) & (key != lead) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        j = np.flatnonzero(other)
        differ = np.bitwise_or.reduce((planes[j] ^ planes[i]).reshape(len(j), BITS, half), axis=1)
        equal = 1 - np.bitwise_count(differ).sum(axis=1) / HASHES
        j = j[(equal - chance) / (1 - chance) >= percent / 100 - allowance]
        yield int(i), j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]


def _block_members(percent: int, allowance: float):
    """The members of a block that may have a link in it: only their texts are needed."""

    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = np.zeros(len(pdf), bool)
        for i, j in _likely(pdf, pd.factorize(pdf["root"])[0], percent, allowance):
            if len(j):
                wanted[i] = wanted[j] = True
        return pdf.loc[wanted, ["bkey", "lo", "hi", "set_key"]]

    return members


def _block_links(percent: int, allowance: float, words: int):
    """Confirmed links between different components within a block of a bucket.

    A pair is exactly compared only if the estimate allows it and the block's own links have not joined its components
    already; so a block gives fewer links than it has members.
    """

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        n, key, texts = pdf["n"].to_numpy(np.int64), pdf["set_key"].to_numpy(), pdf["text"].to_numpy()
        root, sets, found, known = pd.factorize(pdf["root"])[0], Shingles(words), [], {}

        def shingles(k: int) -> np.ndarray:
            if k not in known:
                known[k] = sets.of(texts[k])
            return known[k]

        for i, others in _likely(pdf, root, percent, allowance):
            for k in others:
                if root[k] != root[i]:
                    both = len(np.intersect1d(shingles(i), shingles(k), assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[k] - both):
                        found.append((key[i], key[k]))
                        root[root == root[k]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"])

    return links


def _grouped(df: DataFrame, words: int, percent: int, key: str, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows: key, text_key, n_shingles, set_key; sets: set_key, component_id, and the text_key of the row of that id)."""
    spark = df.sparkSession
    scratch, allowance = Scratch(spark, "near-dup"), slack(percent)
    docs = scratch.keep(sketch(df, key, text, words), "sketch")
    classes = docs.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    classes = scratch.keep(classes.select("set_key", F.col("first.key").alias("first_key"), F.col("first.text_key").alias("text_key"), "n", "bands", "planes"), "classes")
    rows = scratch.keep(docs.select("key", "text_key", "n_shingles", "set_key"), "rows")

    members = classes.select(F.explode("bands").alias("bkey"), "set_key", F.xxhash64("set_key").alias("h"))
    shared = members.groupBy("bkey").agg(F.count("*").alias("size"), F.min("h").alias("lead_h")).where("size > 1")
    members = scratch.keep(members.join(shared, "bkey"), "members")
    leads = members.where("h = lead_h").groupBy("bkey").agg(F.min("set_key").alias("lead"))
    star = members.join(leads, "bkey").where("set_key != lead").select(F.least("lead", "set_key").alias("a"), F.greatest("lead", "set_key").alias("b")).distinct()

    slim = classes.select("set_key", "n", "planes")
    a, b = (slim.select(*[F.col(c).alias(f"{c}_{s}") for c in slim.columns]) for s in "ab")
    tested = star.join(a, F.col("a") == F.col("set_key_a")).join(b, F.col("b") == F.col("set_key_b"))
    tested = tested.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    tested = tested.where(estimate(F.col("planes_a"), F.col("planes_b")) >= percent / 100 - allowance).select("a", "b")
    tested = scratch.keep(tested, "star")

    several = members.where("size > 2").select("set_key")
    needed = tested.select(F.col("a").alias("set_key")).union(tested.select("b")).union(several).distinct()
    needed = classes.join(needed, "set_key").select("set_key", "text_key", "first_key")
    whole = df.select(F.md5(F.col(text)).alias("whole_key"), F.col(key).alias("whole_id"), F.col(text).alias("text"))
    one = (F.col("whole_key") == F.col("text_key")) & F.col("whole_id").eqNullSafe(F.col("first_key"))  # by id too: copies are dealt out
    texts = scratch.keep(whole.join(needed, one).dropDuplicates(["set_key"]).select("set_key", "text"), "texts", "zstd")
    links = scratch.keep(confirm(tested, texts, words, percent), "links")
    roots = components(scratch, links, "first")

    placed = members.where("size > 2").join(roots, members["set_key"] == roots["node"], "left").select("bkey", "set_key", "size", F.coalesce("root", "set_key").alias("root"))
    mixed = placed.groupBy("bkey").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bkey")
    rest = placed.join(mixed, "bkey").join(leads, "bkey").join(classes.select("set_key", "n", "bands", "planes"), "set_key")
    blocks = F.ceil(F.col("size") / block).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("chunk", F.pmod(F.xxhash64("set_key", F.lit(7)), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    by = ["bkey", "lo", "hi"]
    rest = scratch.keep(rest.select(*by, "chunk", "set_key", "root", "lead", "n", "bands", "planes"), "rest")
    likely = scratch.keep(rest.groupBy(*by).applyInPandas(_block_members(percent, allowance), "bkey long, lo int, hi int, set_key binary"), "likely")
    more = rest.join(likely, [*by, "set_key"]).join(texts, "set_key").groupBy(*by).applyInPandas(_block_links(percent, allowance, words), "a binary, b binary")
    more = scratch.keep(more, "more")
    if more.isEmpty():
        final = roots
    else:
        final = components(scratch, links.union(more), "last")
    final = scratch.keep(final, "roots")
    scratch.drop("sketch", "members", "texts", "star", "rest", "likely", "more")

    labelled = classes.select("set_key", "first_key", "text_key").join(final, F.col("set_key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_key"))
    first = F.min(F.struct(F.col("first_key").isNull().alias("none"), F.col("first_key").alias("key"), "text_key"))
    smallest = labelled.groupBy("root").agg(first.alias("first")).select("root", F.col("first.key").alias("component_id"), F.col("first.text_key").alias("first_text"))
    return rows, scratch.keep(labelled.join(smallest, "root").select("set_key", "component_id", "first_text"), "sets")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 85, key: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable over links) and kept."""
    rows, sets = _grouped(df, words, percent, key, text, block)
    linked = rows.where("n_shingles > 0").join(sets, "set_key").select("key", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("key", key)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 85, key: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """The documents without those that another document of their group stands for; columns as they are.

    Each row is decided by its own id and text: of a group, one row with the smallest id stays, also where ids are null or
    repeat, or rows are equal throughout. Rows without words all stay.
    """
    rows, sets = _grouped(docs, words, percent, key, text, block)
    row_of = lambda k, t: F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(t, F.lit("null"))))
    own = row_of(F.col("key"), F.col("text_key"))
    linked = rows.where("n_shingles > 0").join(sets, "set_key").groupBy(own.alias("row_key")).agg(F.count("*").alias("n"), F.first(own == row_of(F.col("component_id"), F.col("first_text"))).alias("stays"))
    out = linked.where("NOT stays OR n > 1")
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    plain = docs.toDF(*names)
    keyed = plain.withColumn("row_key", row_of(F.col(names[docs.columns.index(key)]), F.md5(F.col(names[docs.columns.index(text)]))))
    single = keyed.join(out.select("row_key"), "row_key", "left_anti")
    repeated = keyed.join(out.where("stays").select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"])
    return single.unionByName(repeated).select(*names).toDF(*docs.columns)
