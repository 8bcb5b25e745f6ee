"""Operator 5: training-order materialisation as fixed-stride binary shards.

1. Documents are encoded once and cut into sequences of `stride` ids; each task numbers its own, and the unpadded ids are
   kept as a table. The number of sequences is then known exactly.
2. A sequence's index is the first of its task plus its number there; a keyed Feistel network with cycle-walking permutes
   the indices 0 to n - 1, so the permuted index is the sequence's global slot, known before anything is sorted.
   On their way to the shards ids are written as ranks by frequency over the whole table, in one to three bytes each.
3. Shard s holds the slots from s * `shard_rows` on. Each task takes a range of shards, sorts by slot and writes them as
   files of fixed-width ids under temporary names, renamed when whole; a task that runs again writes the same bytes.

Slot t lies in shard t // shard_rows at byte (t % shard_rows) * stride * width. A manifest (shard, first slot, number of
sequences, stride, width) is kept beside the shards; read_from() reads byte ranges from any slot on.

Ids take two bytes where the vocabulary fits, else four. The order depends on the key, on the number of sequences and on
the order of the input's rows.

Defined results: a null or empty text is one sequence of the end id alone; repeated rows are sequences of their own;
an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices
from .tokens import ChunkIds, load, worker

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Feistel:
    """A keyed permutation of range(n): a balanced network over the next even number of bits, walked until below n."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(int.from_bytes(zlib.crc32(f"{key}:{r}:{s}".encode()).to_bytes(4, "big") * 2, "big") | 1) for r in range(rounds) for s in "a"]

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ self._mixed(right, k)
        return right << self.half | left  # swapped, so that the keys in reverse order invert it

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


# Ranks in compact form: one byte below ONE, two below ONE + TWO, else three.
ONE, LEADS = 192, 60
TWO = LEADS << 8
MOST_RANKS = ONE + TWO + ((256 - ONE - LEADS) << 16)


def compact(rank: np.ndarray) -> bytes:
    """The first bytes of all ranks, then the second bytes, then the third bytes of those that have one."""
    lead, more = rank.copy(), rank[rank >= ONE] - ONE
    three = more >= TWO
    far, first, second = more[three] - TWO, more >> 8, more & 255
    first[three], second[three] = LEADS + (far >> 16), far >> 8 & 255
    lead[rank >= ONE] = ONE + first
    return b"".join(x.astype(np.uint8).tobytes() for x in (lead, second, far & 255))


def spread(raw: bytes, n: int) -> np.ndarray:
    """The n ranks in compact form."""
    codes = np.frombuffer(raw, np.uint8).astype(np.int64)
    rank = codes[:n].copy()
    longer = rank >= ONE
    first = rank[longer] - ONE
    second, third, three = codes[n : n + len(first)], codes[n + len(first) :], first >= LEADS
    more = first << 8 | second
    more[three] = TWO + ((first[three] - LEADS) << 16 | second[three] << 8 | third)
    rank[longer] = ONE + more
    return rank


#: Most tasks that write shards.
MOST_TASKS = 20_000


def materialise(df: DataFrame, vocabulary: str, to: str, stride: int = 256, order_key: int = 1, end_id: int = 2, fill_id: int = 0, shard_rows: int = 32_768, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards into the folder `to`; a row per sequence: slot, shard, place, key, part, n_ids, ids_crc32."""
    spark = df.sparkSession
    scratch = Scratch(spark, "order")
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    known = max(load(vocabulary).get_vocab_size(), end_id + 1)
    if known > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} different ids")
    width = 2 if known <= 1 << 16 else 4
    id_type = np.dtype(f"<u{width}")
    line = stride * width

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, at = worker(ChunkIds, vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], id_type).tobytes()
        for whole in batches:
            for batch in slices(whole):
                ids = [np.frombuffer(raw, "<u4").astype(id_type).tobytes() + end for raw in table.of(batch.column("text").to_pylist())]
                n = np.array([-(-len(i) // line) for i in ids], np.int64)
                yield pa.record_batch([pa.array([task] * len(ids), pa.int32()), pa.array(at + np.cumsum(n) - n), batch.column("key"), pa.array(n), pa.array(ids, pa.binary())], ["task", "number", "key", "n", "ids"])
                at += int(n.sum())

    texts = scratch.keep(src.mapInArrow(encoded, f"task int, number long, key {kind}, n long, ids binary"), "ids", "zstd")
    sizes = {r["task"]: r["n"] for r in texts.groupBy("task").agg(F.sum("n").alias("n")).collect()}  # a row per input split

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(known, np.int64)
        for whole in batches:
            for batch in slices(whole):
                n += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), id_type), minlength=known)
        yield pa.record_batch([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["id", "n"])

    used = texts.select("ids").mapInArrow(frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id
    id_of = np.array([r["id"] for r in sorted(used, key=lambda r: (-r["n"], r["id"]))], np.int64)
    rank_of = np.zeros(known, np.int64)
    rank_of[id_of] = np.arange(len(id_of))
    base, total = {}, 0
    for task in sorted(sizes):
        base[task] = total
        total += sizes[task]
    permute, shards = Feistel(max(1, total), order_key), max(1, -(-total // shard_rows))
    per_task = -(-shards // MOST_TASKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                first = [base[t] + k for t, k in zip(batch.column("task").to_pylist(), batch.column("number").to_pylist())]
                n, ids = batch.column("n").to_numpy(), batch.column("ids").to_pylist()
                slot = permute.slot(np.concatenate([np.arange(a, a + k, dtype=np.uint64) for a, k in zip(first, n.tolist())] or [np.zeros(0, np.uint64)]))
                part = np.concatenate([np.arange(k, dtype=np.int32) for k in n.tolist()] or [np.zeros(0, np.int32)])
                keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(n)), n)))
                data = [rank[at : at + stride] for rank in (rank_of[np.frombuffer(raw, id_type)] for raw in ids) for at in range(0, len(rank), stride)]
                yield pa.record_batch([pa.array((slot // shard_rows // per_task).astype(np.int32)), pa.array(slot), keys, pa.array(part), pa.array([*map(len, data)], pa.int32()), pa.array([*map(compact, data)], pa.binary())], ["writer", "slot", "key", "part", "n", "ranks"])

    cut_up = texts.mapInArrow(cut, f"writer int, slot long, key {kind}, part int, n int, ranks binary")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(to)
        shard, out, temporary = None, None, ""
        fill = np.array([fill_id], id_type).tobytes()

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{folder}/shard-{shard:09d}.bin")

        store.create_dir(folder, recursive=True)
        for whole in batches:
            for batch in slices(whole, 4096):
                slots, number, sums = batch.column("slot").to_pylist(), batch.column("n"), []
                for slot, n, ranks in zip(slots, number.to_pylist(), batch.column("ranks").to_pylist()):
                    if slot // shard_rows != shard:
                        close()
                        shard, temporary = slot // shard_rows, f"{folder}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(temporary)
                    full = id_of[spread(ranks, n)].astype(id_type).tobytes() + fill * (stride - n)
                    out.write(full)
                    sums.append(zlib.crc32(full))
                yield pa.record_batch([batch.column("slot"), batch.column("key"), batch.column("part"), number, pa.array(sums, pa.int64())], ["slot", "key", "part", "n_ids", "ids_crc32"])
        close()

    sorted_up = cut_up.repartitionById(-(-shards // per_task), "writer").sortWithinPartitions("slot")  # a task per range of shards
    log = scratch.keep(sorted_up.mapInArrow(written, f"slot long, key {kind}, part int, n_ids int, ids_crc32 long"), "log")
    scratch.drop("ids")
    first = F.col("id") * shard_rows
    manifest = spark.range(-(-total // shard_rows)).select(F.col("id").cast("int").alias("shard"), first.alias("first"), F.least(F.lit(shard_rows), F.lit(total) - first).alias("n"), F.lit(stride).alias("stride"), F.lit(width).alias("width"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{to}/manifest")
    shard, place = F.floor(F.col("slot") / shard_rows).cast("int"), F.pmod("slot", F.lit(shard_rows))
    return log.select("slot", shard.alias("shard"), place.alias("place"), F.col("key").alias(key), "part", "n_ids", "ids_crc32")


def read_from(spark: SparkSession, folder: str, slot: int = 0, end: int | None = None, block: int = 4096) -> DataFrame:
    """slot and ids (array of long) of the slots from `slot` up to `end`, in order: partitions and their rows follow the
    training order, and each block of sequences is one read of its byte range."""
    stored = spark.read.parquet(f"{folder}/manifest").agg(F.max("n"), F.max(F.col("first") + F.col("n")), F.max("stride"), F.max("width")).first()  # a full shard's rows, all rows
    if stored[1] is None:
        return spark.createDataFrame([], "slot long, ids array<long>")
    shard_rows, total, stride, width = stored
    end = min(total, total if end is None else end)
    blocks = spark.range(slot // block, max(slot // block, -(-end // block)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for b in batch.column("id").to_pylist():
                at, stop = max(slot, b * block), min(end, (b + 1) * block)
                while at < stop:
                    shard, place = divmod(at, shard_rows)
                    n = min(stop - at, shard_rows - place)
                    with store.open_input_file(f"{path}/shard-{shard:09d}.bin") as file:
                        file.seek(place * stride * width)
                        ids = np.frombuffer(file.read(n * stride * width), f"<u{width}").reshape(n, stride).astype(np.int64)
                    yield pa.record_batch([pa.array(range(at, at + n), pa.int64()), pa.array(list(ids), pa.list_(pa.int64()))], ["slot", "ids"])
                    at += n

    return blocks.mapInArrow(read, "slot long, ids array<long>")
