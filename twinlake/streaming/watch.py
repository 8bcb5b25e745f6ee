"""Continuous mirroring (STR-1 to STR-7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..functions.paths import under
from ..operators import blocks
from ..sources.snapshots import keep


def relevant(events: DataFrame, reserved: str = ".twinlake", paths: str = "paths") -> DataFrame:
    """Events with a path outside the engine's own metadata; works on streams too."""
    return events.where(~F.forall(paths, lambda p: (p == reserved) | p.startswith(reserved + "/")))


def relevant_paths(events: DataFrame, reserved: str = ".twinlake") -> DataFrame:
    return events.where(~under("path", reserved))


#: Windows in a stretch of time that one task looks through, and distinct times that it goes through one after the other.
STRETCH, MOST_TIMES = 16, 1 << 16


class _Stretches:
    """Stretches of time in rows that stand in order of chain, k and t, worked on all at once; `apart` is longer than any."""

    def __init__(self, rows: pa.RecordBatch, starts: np.ndarray, window: int, apart: int):
        self.rows, self.window, self.apart = rows, window, apart
        self.low, self.high = starts, np.append(starts[1:], rows.num_rows)
        self.own = np.repeat(np.arange(len(starts)), self.high - self.low)
        self.t, self.n = (rows.column(c).to_numpy() for c in ("t", "n"))
        self.line = self.own * apart + self.t  # so far apart that no window reaches the next stretch
        #: The place of the next start, were a time a burst's start; the end of its stretch where there is none.
        self.after = np.searchsorted(self.line, self.line + window)

    def bursts_from(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each time, were it a burst's start: how far the last burst from there on reaches beyond `length`, and how many
        bursts start."""
        end, at, n = self.high[self.own], np.arange(len(self.t)), np.ones(len(self.t), np.int64)
        while (some := self.after[at] < end).any():
            at, n = np.where(some, self.after[at], at), n + some
        return np.maximum(0, self.t[at] + self.window - length), n

    def found(self, entry: np.ndarray) -> pa.RecordBatch:
        """path, start, events of the bursts, if the one before ends at `entry` in each stretch; its events there, too."""
        first = np.searchsorted(self.line, np.arange(len(entry)) * self.apart + entry)
        at, starts = first[first < self.high], [np.empty(0, np.int64)]
        while len(at):
            starts.append(at)
            at, end = self.after[at], self.high[self.own[at]]
            at = at[at < end]
        begin = np.sort(np.concatenate(starts))
        end = np.minimum(np.append(begin[1:], len(self.t)), self.high[self.own[begin]])
        sums = np.concatenate([[0], np.cumsum(self.n)])
        covered = np.flatnonzero((first > self.low) & (entry > 0))
        base = self.rows.column("base").to_numpy()
        start = np.concatenate([base[begin] + self.t[begin], base[self.low[covered]] + entry[covered] - self.window])
        events = np.concatenate([sums[end] - sums[begin], sums[first[covered]] - sums[self.low[covered]]])
        path = self.rows.column("path").take(pa.array(np.concatenate([begin, self.low[covered]])))
        return pa.record_batch([path, pa.array(start), pa.array(events)], ["path", "start", "events"])


def _whole_stretches(batches: Iterator[pa.RecordBatch], window: int, apart: int) -> Iterator[_Stretches]:
    most = max(1, (1 << 61) // apart)  # what numbers of 64 bits hold
    held: list[pa.RecordBatch] = []

    def made(some: list[pa.RecordBatch]) -> Iterator[_Stretches]:
        rows = pa.concat_batches(some)
        starts = np.append(0, _edges(rows))
        for k in range(0, len(starts), most):
            low, high = starts[k], starts[k + most] if k + most < len(starts) else rows.num_rows
            yield _Stretches(rows.slice(low, high - low), starts[k : k + most] - low, window, apart)

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _edges(batch)
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("chain", "k")):
            edges = np.append(0, edges)
        if len(edges):
            if some := [*held, batch.slice(0, edges[-1])] if edges[-1] else held:
                yield from made(some)
            held = []
            batch = batch.slice(edges[-1])
        held.append(batch)
    if held:
        yield from made(held)


def _edges(rows: pa.RecordBatch) -> np.ndarray:
    """Where another stretch begins than that of the row before."""
    chain, k = rows.column("chain"), rows.column("k").to_numpy()
    other = pc.not_equal(chain.slice(1), chain.slice(0, len(chain) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(other | (k[1:] != k[:-1])) + 1


def debounce_anchored(events: DataFrame, key: str, window_ms: int, ts: str = "ts") -> DataFrame:
    """key, start, events: the first event opens a window of fixed length, the next one outside opens another.

    Where a burst starts depends on the one before it, so time is cut into stretches of some windows: each is a function
    from when the burst that reaches into it ends to when its own last burst ends. The functions of stretches that follow
    on each other, a chain, are composed in a tree, then each stretch finds its bursts; a chain of up to FAN stretches with
    few times is one stretch. A stretch holds its distinct times; no task has all of a key's. Events without a time take no
    part.
    """
    window = window_ms * 1000
    length, kind = STRETCH * window, events.schema[key].dataType
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    times = events.select(F.to_json(F.struct(F.col(key).alias("key"))).alias("path"), at.alias("t")).where("t IS NOT NULL").groupBy("path", "t").agg(F.count("*").alias("n"))
    times = times.withColumn("stretch", F.floor(F.col("t") / length))
    order = Window.partitionBy("path").orderBy("stretch")  # a row for each stretch
    fresh = F.coalesce(F.col("stretch") - F.lag("stretch").over(order) != 1, F.lit(True))
    begun = F.max(F.when(F.col("fresh"), F.col("stretch"))).over(order)
    chained = times.groupBy("path", "stretch").agg(F.count("*").alias("times")).withColumn("fresh", fresh).select("path", "stretch", "times", begun.alias("begun"))
    chain = Window.partitionBy("path", "begun")
    short = (F.count("*").over(chain) <= blocks.FAN) & (F.sum("times").over(chain) <= MOST_TIMES)
    first = F.when(F.col("short"), F.col("begun")).otherwise(F.col("stretch"))
    numbered = chained.withColumn("short", short).select("path", "stretch", "short", first.alias("first"), (first - F.col("begun")).alias("k"), F.concat_ws(":", F.col("begun").cast("string"), "path").alias("chain"))
    base = F.col("first") * length
    listed = keep(times.join(numbered, ["path", "stretch"]).select("path", "chain", "k", "short", (F.col("t") - base).alias("t"), "n", base.alias("base")), "times")
    apart = (blocks.FAN + 1) * length

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[tuple]:
            for some in _whole_stretches(batches, window, apart):
                leaves, n = some.bursts_from(length)
                chain, number = (some.rows.column(c).take(pa.array(some.low)).to_pylist() for c in ("chain", "k"))
                for low, high, path, k in zip(some.low, some.high, chain, number):
                    t = some.t[low:high]
                    near = 0 if k == 0 else int(np.searchsorted(t, window - 1))  # times that an earlier burst may cover
                    table = np.zeros((4, near + 1), np.int64)
                    stop = min(low + near + 1, high)
                    table[0, 1:], table[1, : stop - low], table[3, : stop - low] = t[:near] + 1, leaves[low:stop], n[low:stop]
                    yield path, k, 0, table.tobytes()

        yield from blocks.gathered(tables(), blocks.TABLES)

    sorted_up = lambda df: df.repartition("chain", "k").sortWithinPartitions("chain", "k", "t")
    level = sorted_up(listed.where("NOT short").select("chain", "k", "t", "n")).mapInArrow(functions, blocks.TABLES)
    where = blocks.entries(level).select(F.col("path").alias("chain"), F.col("chunk").alias("k"), "entry")

    def bursts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _whole_stretches(batches, window, apart):
            yield some.found(some.rows.column("entry").to_numpy()[some.low])

    entered = listed.join(where, ["chain", "k"], "left").select("path", "chain", "k", "t", "n", "base", F.coalesce("entry", F.lit(0).cast("long")).alias("entry"))
    parts = sorted_up(entered).mapInArrow(bursts, "path string, start long, events long")
    summed = parts.groupBy("path", "start").agg(F.sum("events").alias("events"))
    own = F.from_json("path", StructType([StructField("key", kind)]))["key"]
    return summed.select(own.alias(key), F.timestamp_micros("start").alias("start"), "events")


def debounce_session(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """key, start, events: a window lasts until `gap` passes without an event; batch, or stream with a watermark."""
    at = F.col(ts).cast("timestamp") if not events.isStreaming else F.col(ts)
    sessions = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return sessions.select(key, F.col("w.start").alias("start"), "events")


class AnchoredBursts(StatefulProcessor):
    """The anchored windows of each key, for events in any order within the watermark's delay.

    Times are kept until the watermark has passed the end of the window that the earliest of them opens: then no event of
    that burst can come any more, and it is emitted with its count. State goes with it.
    """

    def __init__(self, window_ms: int):
        self.window = window_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "t long", "n long")
        self.until = handle.getValueState("until", "t long")

    def _wake(self) -> None:
        """One timer: the end of the window that the earliest time opens."""
        for at in [*self.handle.listTimers()]:
            self.handle.deleteTimer(at)
        if (first := min((k[0] for k in self.times.keys()), default=None)) is not None:
            self.handle.registerTimer(-(-(first + self.window) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        for some in rows:
            for t, n in some["t"].value_counts().items():
                if until is None or t >= until:  # a closed burst takes no more events
                    known = self.times.getValue((int(t),))[0] if self.times.containsKey((int(t),)) else 0
                    self.times.updateValue((int(t),), (known + int(n),))
        self._wake()
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "start": pd.Series([], dtype="int64"), "events": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, closed = timerValues.getCurrentWatermarkInMs() * 1000, []
        known = dict(sorted((k[0], v[0]) for k, v in self.times.iterator()))
        while known and (start := next(iter(known))) + self.window <= now:
            mine = [t for t in known if t < start + self.window]
            closed.append((key[0], start, sum(known.pop(t) for t in mine)))
            for t in mine:
                self.times.removeKey((t,))
            self.until.update((start + self.window,))
        if not known:
            self.until.clear()  # the watermark is behind it: what is older comes late anyway
        self._wake()
        yield pd.DataFrame(closed, columns=["key", "start", "events"])

    def close(self) -> None:
        pass


def stream_bursts(events: DataFrame, key: str, window_ms: int, delay: str = "10 minutes") -> DataFrame:
    """key, start (microseconds), events of every burst once it is closed; needs the RocksDB state store.

    Events may come in any order; those older than the watermark (`delay` behind the newest) are late and dropped.
    """
    at = F.col("ts").cast("timestamp")
    keyed = events.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("t")).where("t IS NOT NULL").withWatermark("ts", delay)
    return keyed.groupBy("key").transformWithStateInPandas(AnchoredBursts(window_ms), "key string, start long, events long", "Append", "EventTime")


def live_run_state(events: DataFrame) -> DataFrame:
    """Counters and the current phase of each run; the same aggregate for batches and, in update mode, streams."""
    done = lambda action: F.count_if((F.col("event") == "done") & (F.col("action") == action))
    phase = F.max(F.when(F.col("event") == "phase", F.struct("seq", "phase")))["phase"]
    return events.groupBy("run_id").agg(
        F.count_if(F.col("event") == "done").alias("files_done"), F.coalesce(F.sum(F.when(F.col("event") == "done", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_done"),
        done("copy").alias("copied"), done("update").alias("updated"), done("skip").alias("skipped"), done("delete").alias("deleted"), F.count_if(F.col("event") == "error").alias("errors"), phase.alias("phase"),
    )


def changes_stream(spark: SparkSession, source: str, schema: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A stream of change files; the caps bound what one cycle takes."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(source)


def watch(changes: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, errors: str | None = None, once: bool = True) -> StreamingQuery:
    """Runs `cycle` on each batch of changes. With `errors`, a failed cycle is logged there and the stream goes on."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        try:
            cycle(batch, batch_id)
        except Exception as error:  # a cycle may fail in any way; the stream outlives it
            if errors is None:
                raise
            batch.sparkSession.createDataFrame([(batch_id, type(error).__name__, str(error)[:1000])], "batch_id long, error string, message string").write.mode("append").parquet(errors)

    writer = changes.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_starts(events: DataFrame, key: str, gap_ms: int, ts: str = "ts") -> DataFrame:
    """Sessions by comparing with the event before; equals debounce_session on batches."""
    order = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    opens = F.coalesce(micros - F.lag(micros).over(order) >= gap_ms * 1000, F.lit(True))
    return events.select(key, F.col(ts).alias("start"), opens.alias("opens")).where("opens").drop("opens")
