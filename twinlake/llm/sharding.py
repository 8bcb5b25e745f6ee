"""Operator 3: best-fit-decreasing bin packing of indivisible groups into shards.

Groups (rows with equal texts) go, largest first, into the bin whose remaining capacity is the tightest that still
fits; a balanced search tree over (remaining capacity, bin) finds it. Packing billions of groups one by one would
need one task, so sizes are first gathered into classes (logarithmic, 64 to an octave, 4096 above `1 / pieces` of
the capacity) by a distributed count, and the driver packs runs of equal items: at most some 64 x 40 + 4096 x 4
classes, however many rows there are. Within a class, items
are numbered by two-level counts, so no task sorts a whole class, and a range of numbers goes to each bin.

Only a group above a whole shard's capacity (with `shards`: the mean shard) is broken up: its equal rows are dealt,
by hash of the key, over pieces of about `1 / pieces` of it, each an item of its own. All others stay whole.

Defined results: a null text has size 16 and forms a group of its own; an empty text likewise; rows with equal key
and text stay in one piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_bytes

#: Size classes to an octave, and those of items that fill much of a shard.
FINE, FINER = 64, 4096


@dataclass
class _Node:
    value: tuple[float, int]
    left: _Node | None = None
    right: _Node | None = None
    level: int = 1


class Tree:
    """An AA tree of distinct pairs, for the least pair not below a value."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _skew(t: _Node | None) -> _Node | None:
        if t and t.left and t.left.level == t.level:
            left = t.left
            t.left, left.right = left.right, t
            return left
        return t

    @staticmethod
    def _split(t: _Node | None) -> _Node | None:
        if t and t.right and t.right.right and t.level == t.right.right.level:
            right = t.right
            t.right, right.left = right.left, t
            right.level += 1
            return right
        return t

    def insert(self, value: tuple[float, int]) -> None:
        def into(t: _Node | None) -> _Node:
            if t is None:
                return _Node(value)
            if value < t.value:
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return self._split(self._skew(t))

        self.root = into(self.root)

    def remove(self, value: tuple[float, int]) -> None:
        def out(t: _Node | None, value: tuple[float, int]) -> _Node | None:
            if t is None:
                return None
            if value > t.value:
                t.right = out(t.right, value)
            elif value < t.value:
                t.left = out(t.left, value)
            elif t.left is None and t.right is None:
                return None
            elif t.left is None:
                next_up = t.right
                while next_up.left:
                    next_up = next_up.left
                t.right, t.value = out(t.right, next_up.value), next_up.value
            else:
                next_down = t.left
                while next_down.right:
                    next_down = next_down.right
                t.left, t.value = out(t.left, next_down.value), next_down.value
            least = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if least < t.level:
                t.level = least
                if t.right and least < t.right.level:
                    t.right.level = least
            t = self._skew(t)
            t.right = self._skew(t.right)
            if t.right:
                t.right.right = self._skew(t.right.right)
            t = self._split(t)
            t.right = self._split(t.right)
            return t

        self.root = out(self.root, value)

    def at_least(self, low: tuple[float, int]) -> tuple[float, int] | None:
        t, best = self.root, None
        while t:
            if t.value >= low:
                best, t = t.value, t.left
            else:
                t = t.right
        return best


def best_fit(classes: list[tuple[float, int]], capacity: float, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (class, first, end, bin) for classes (item size, items), largest sizes first.

    With `bins` given: exactly these are open, and None if some item does not fit. Else bins open as needed.
    """
    tree, opened, runs = Tree(), bins or 0, []
    for b in range(opened):
        tree.insert((capacity, b))
    for k, (size, items) in enumerate(classes):
        done = 0
        while done < items:
            found = tree.at_least((size, -1))
            if found is None:
                if bins is not None:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            else:
                tree.remove(found)
            room, b = found
            n = min(items - done, max(1, int(room // size)))
            runs.append((k, done, done + n, b))
            tree.insert((room - n * size, b))
            done += n
    return runs


def least_capacity(classes: list[tuple[float, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """The packing into `bins` bins of the least capacity for which best fit succeeds, to one part in 100,000."""
    total = sum(s * n for s, n in classes)
    low, high = total / bins, total / bins + (classes[0][0] if classes else 0) + 1
    while (runs := best_fit(classes, high, bins)) is None:
        high *= 1.25
    while high - low > 1e-5 * high:
        middle = (low + high) / 2
        if (found := best_fit(classes, middle, bins)) is None:
            low = middle
        else:
            high, runs = middle, found
    return runs


def assign(df: DataFrame, shards: int | None = 40, capacity: int | None = None, pieces: int = 8, subs: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot for every row.

    shards: that many of near-equal sizes; or capacity: as few bins of this capacity as best-fit decreasing needs. With
    `shards` an item counts as its class's mean, with `capacity` as its class's largest, so no bin holds more than its
    capacity, but for one that holds a single larger item.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    rows = df.select(F.col(key).alias("key"), (text_bytes(text) + 16).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.md5(F.col(text)), F.lit("null")).alias("g"))
    rows = scratch.keep(rows, "rows")
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    target = capacity or max(1.0, total / shards)
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    # Groups above the capacity: at most as many as shards, so small whatever the input.
    large = groups.where(F.col("bytes") > target).select(F.col("g").alias("large_g"), F.ceil(F.col("bytes") * pieces / target).cast("int").alias("parts"))
    large = scratch.keep(large, "large")
    rows = rows.join(large, F.col("g") == F.col("large_g"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("key", F.lit(11)), F.col("parts")), F.lit(0)).cast("int")).drop("large_g", "parts")
    items = rows.groupBy("g", "part").agg(F.sum("size").alias("bytes"))
    big = F.col("bytes") * pieces > target
    octave = F.when(big, F.floor(F.log2("bytes") * FINER) + (1 << 16)).otherwise(F.floor(F.log2("bytes") * FINE)).cast("int")
    items = scratch.keep(items.withColumn("class", octave).withColumn("sub", F.pmod(F.xxhash64("g", "part"), F.lit(subs)).cast("int")), "items")
    counts = scratch.keep(items.groupBy("class", "sub").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("bytes").alias("m")), "counts")
    found = counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("m").alias("m")).orderBy(F.desc("class")).collect()  # a row per class
    classes = [(r["b"] / r["n"] if capacity is None else float(r["m"]), r["n"]) for r in found]
    runs = least_capacity(classes, shards) if capacity is None else best_fit(classes, float(capacity))
    plan = spark.createDataFrame([(found[k]["class"], a, b, s) for k, a, b, s in runs], "class int, first long, end long, shard int")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("class", "sub", F.coalesce(before, F.lit(0)).alias("offset"))
    numbered = items.withColumn("local", F.row_number().over(Window.partitionBy("class", "sub").orderBy("g", "part")) - 1)
    numbered = numbered.join(offsets, ["class", "sub"]).withColumn("number", F.col("offset") + F.col("local"))
    placed = numbered.join(plan, (numbered["class"] == plan["class"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))).select("g", "part", "shard")
    placed = scratch.keep(placed, "placed")

    sharded = rows.join(placed, ["g", "part"]).withColumn("sub", F.pmod(F.xxhash64("key", F.lit(13)), F.lit(16 * subs)).cast("int"))
    sharded = scratch.keep(sharded, "sharded")
    sizes = sharded.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select("shard", "sub", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("key", "g")) - 1
    out = sharded.withColumn("local", local).join(ahead, ["shard", "sub"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("ahead") + F.col("local")).cast("long").alias("slot"))
