"""Block delta of all changed entries in one job (WIN-1, DLT-1 to DLT-9).

Contents are DataFrames (path, content binary) with unique paths. Blocks have one size for all, or, with block=None, one
by the length of each old content. New contents are cut into overlapping chunks, so that a long one is many rows; the
checksums of a chunk's windows are prefix sums over its bytes, and only windows whose weak checksum is that of a block of
the same path become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import block_size_for, strong_hash
from ..sources.snapshots import keep
from . import blocks
from .sums import strong_of, window_sums

#: Window starts in a chunk.
CHUNK = 1 << 18


def block_of(contents: DataFrame, block: int | None) -> Column:
    """The block size of each row: the given one, the row's own, or one by the length of its content."""
    if block is not None:
        return F.lit(block)
    return F.col("block") if "block" in contents.columns else block_size_for(F.octet_length("content"))


def signature(old: DataFrame, block: int | None = 700) -> DataFrame:
    """path, block_idx, block_size, weak, strong, len of every block; the last may be short; none for empty content.

    Contents are cut in Arrow functions here and below: a column expression copies the whole value for each part of it.
    """

    schema = "path string, block_idx int, block_size int, weak long, strong string, len int"

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, content, size in blocks.columns(batches, "path", "content", "size"):
                for k in range(0, len(content), size):
                    part = content[k : k + size]
                    yield path, k // size, size, int(window_sums(part, len(part))[0]), strong_of(part), len(part)

        yield from blocks.gathered(rows(), schema)

    sized = old.where(F.octet_length("content") > 0).select("path", "content", block_of(old, block).alias("size"))
    return sized.mapInArrow(signed, schema)


def chunks(new: DataFrame, block: int | None = 700) -> DataFrame:
    """path, start, block, part: stretches of CHUNK window starts each, overlapping by a block less one byte."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content, size in blocks.columns(batches, "path", "content", "block"):
            for start in range(0, len(content) - size + 1, CHUNK):
                part = content[start : start + CHUNK + size - 1]
                yield pa.record_batch([pa.array([path]), pa.array([start], pa.int32()), pa.array([size], pa.int32()), pa.array([part], pa.binary())], ["path", "start", "block", "part"])

    return new.select("path", "content", block_of(new, block).alias("block")).mapInArrow(cut, "path string, start int, block int, part binary")


def windows(new: DataFrame, block: int | None = 700) -> DataFrame:
    """path, pos, weak of every window: the rolling checksum."""

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, size, part in blocks.columns(batches, "path", "start", "block", "part"):
            weak = window_sums(part, size)
            yield pa.record_batch([pa.array([path] * len(weak)), pa.array(np.arange(start, start + len(weak), dtype=np.int32)), pa.array(weak)], ["path", "pos", "weak"])

    return chunks(new, block).mapInArrow(rolled, "path string, pos int, weak long")


def match_blocks(new: DataFrame, sig: DataFrame, block: int | None = 700) -> DataFrame:
    """path, pos, block_size, block_idx: the lowest block equal to the window; strong hashes only where weak ones pass a
    filter of the path's blocks. The signature is read several times and should be kept."""
    per = sig.groupBy("path").agg(F.count("*").alias("blocks"), F.first("block_size").alias("block"))
    sizes = new.select("path", F.octet_length("content").cast("long").alias("n")).join(per, "path").withColumns({"old_n": F.lit(0).cast("long"), "span": blocks.span_of(F.col("block"))})
    counted = sig.join(per.select("path", "blocks"), "path")
    found = blocks.runs(keep(blocks.hits(blocks.pieces(new), counted, sizes), "hits"), sig)
    run = found.select("path", "block", (F.col("chunk") * blocks.span_of(F.col("block"))).alias("base"), F.inline(F.arrays_zip("starts", "counts", "idx")))
    at = F.explode(F.sequence("starts", F.col("starts") + F.col("counts") - 1))
    return run.select("path", "base", "block", "idx", at.alias("at")).select("path", (F.col("base") + F.col("at")).cast("int").alias("pos"), F.col("block").alias("block_size"), F.col("idx").cast("int").alias("block_idx"))


def select_matches(candidates: DataFrame) -> DataFrame:
    """Greedy from the left: the matches (path, pos, block_size, block_idx) that do not overlap, chunk by chunk."""
    return blocks.select_rows(candidates)


def tail_match(new: DataFrame, matches: DataFrame, sig: DataFrame) -> DataFrame:
    """path, pos, block_idx where all that is left after the last match equals a short block."""
    last = matches.groupBy("path").agg(F.max(F.col("pos") + F.col("block_size")).alias("pos"))
    rest = new.join(last, "path", "left").select("path", F.coalesce("pos", F.lit(0)).alias("pos"), "content")
    rest = rest.select("path", "pos", F.substring("content", F.col("pos") + 1, F.octet_length("content")).alias("rest")).where(F.octet_length("rest") > 0)
    short = sig.where(F.col("len") < F.col("block_size")).select("path", "block_idx", "strong", "len")
    joined = rest.join(short, "path").where((F.octet_length("rest") == F.col("len")) & (strong_hash("rest") == F.col("strong")))
    return joined.groupBy("path", "pos").agg(F.min("block_idx").alias("block_idx"))


def encode(old: DataFrame, new: DataFrame, block: int | None = 700) -> DataFrame:
    """path, op_seq, op (copy or literal), block_idx, bytes: how to make `new` from `old`; with block=None for blocks whose
    size follows from each old content's length.

    The chosen matches of a path are one array, no longer than its content has blocks; its operations follow from it in a row.
    """
    sig = keep(signature(old, block), "signature")
    match = F.struct("pos", (F.col("pos") + F.col("block_size")).alias("stop"), F.col("block_idx").alias("idx"))
    chosen = select_matches(match_blocks(new, sig, block)).groupBy("path").agg(F.array_sort(F.collect_list(match)).alias("kept"))
    short = sig.where(F.col("len") < F.col("block_size")).select("path", F.struct("block_idx", "strong", "len").alias("short"))
    joined = new.select("path", "content").join(chosen, "path", "left").join(short, "path", "left")

    schema = "path string, op_seq int, op string, block_idx int, bytes binary"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, content, kept, short in blocks.columns(batches, "path", "content", "kept", "short"):
                ops, at = [], 0
                for m in kept or []:
                    if m["pos"] > at:
                        ops.append(("literal", None, content[at : m["pos"]]))
                    ops.append(("copy", m["idx"], None))
                    at = m["stop"]
                if rest := content[at:]:
                    tail = short and len(rest) == short["len"] and strong_of(rest) == short["strong"]
                    ops.append(("copy", short["block_idx"], None) if tail else ("literal", None, rest))
                for k, op in enumerate(ops):
                    yield path, k, *op

        yield from blocks.gathered(rows(), schema)

    return joined.mapInArrow(coded, schema)


def split_ops(old: DataFrame, ops: DataFrame, block: int | None = 700) -> tuple[DataFrame, DataFrame]:
    """(entries whose copies all lie within the old content, rejected paths with an error). Block 0 of an empty content is
    in range, and empty."""
    sized = ops.join(old.select("path", F.octet_length("content").alias("n"), block_of(old, block).alias("size")), "path", "left")
    start, n = F.col("block_idx").cast("long") * F.coalesce("size", F.lit(1)), F.coalesce("n", F.lit(0))
    beyond = sized.where((F.col("op") == "copy") & ((start < 0) | (start >= n) & ~((start == 0) & (n == 0))))
    rejected = beyond.groupBy("path").agg(F.concat(F.lit("copy block "), F.min("block_idx").cast("string"), F.lit(" out of range")).alias("error"))
    return ops.join(rejected.select("path"), "path", "left_anti"), rejected


def apply_delta(old: DataFrame, ops: DataFrame, block: int | None = 700) -> DataFrame:
    """path, content rebuilt for every path of `old` and `ops` but the rejected ones; a copy ends with the old content, and
    a path without operations is empty."""
    ops = keep(ops, "ops")  # read three times below
    good, rejected = split_ops(old, ops, block)
    listed = good.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("op_seq", "op", "block_idx", "bytes"))).alias("ops"))
    sized = old.select("path", "content", block_of(old, block).alias("size"))

    schema = "path string, content binary"

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, content, size, ops in blocks.columns(batches, "path", "content", "size", "ops"):
                size = size or 0
                parts = [(content or b"")[o["block_idx"] * size : (o["block_idx"] + 1) * size] if o["op"] == "copy" else o["bytes"] for o in ops]
                yield path, b"".join(parts)

        yield from blocks.gathered(rows(), schema)

    rebuilt = listed.join(sized, "path", "left").select("path", "content", "size", "ops").mapInArrow(built, schema)
    paths = old.select("path").union(ops.select("path")).distinct().join(rejected.select("path"), "path", "left_anti")
    return paths.join(rebuilt, "path", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))


def delta_stats(ops: DataFrame) -> DataFrame:
    """Per path: literal bytes, copies, literals and the share of operations that are copies."""
    copies = F.count_if(F.col("op") == "copy")
    return ops.groupBy("path").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).cast("long").alias("literal_bytes"), copies.alias("copies"), F.count_if(F.col("op") == "literal").alias("literals"), (copies / F.count("*")).alias("reuse"))
