"""Operator 12: vectors as one byte for each of four parts, by Lloyd rounds with norm-of-sum bounds.

Components become integers, so sums, divisions and distances are exact. Each part of a row keeps its entry, an upper bound
of the distance to it and, for each group of near entries, a lower bound of the distance to the group's other entries. A
bound is stamped with the round it was measured in, and every codebook since is retained: what a bound has lost by now is
how far its entry lies from where it stood at the stamp (the norm of the sum of its moves), which is never more than the
sum of the moves' norms. Only where an upper bound reaches a group's lower bound are the group's entries measured again,
exactly; a tie goes to the lower index, so bounds that touch are measured too.

A round is one pass over the rows, which carry their bounds; per task and part, sums by entry leave it. Codebooks are 4 x 256
rows, known to driver and tasks; nothing else grows.

Defined results: rows whose vector is null or empty, holds null or non-finite components, or differs in length from the
most common one (the longer of two equally common) take no part; a length that is no multiple of the number of parts is cut
as evenly as it goes; the first codebook is of the smallest ids, null last, those of equal ids in order of their vectors;
repeated rows count and are returned as often; fewer rows than entries give as many entries as rows; an error beyond 64
bits is null, and so is a sum of errors; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bounds are widened by this share, far above the rounding of roots and of 32-bit storage.
_SLACK = 1e-6


def group_of(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: those nearest to one of `groups` entries that lie far from each other."""
    points = entries.astype(float)
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(groups, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return ((points[:, None] - points[chosen][None]) ** 2).sum(2).argmin(1)


@dataclass
class Book:
    """The codebooks of one part, one for each round so far (entries x width, integers)."""

    history: list[np.ndarray]
    groups: int = 8
    members: list[np.ndarray] = field(default_factory=list)
    of: np.ndarray = None
    moved: np.ndarray = None  # by stamp and entry: how far the entry is from where it stood at the stamp
    most: np.ndarray = None  # by stamp, group and entry left out: the farthest of the group's other entries

    def prepare(self) -> Book:
        now = self.history[-1].astype(float)
        self.of = group_of(self.history[0], self.groups)
        self.members = [np.flatnonzero(self.of == g) for g in range(self.of.max() + 1)]
        self.moved = np.stack([np.sqrt(((now - h.astype(float)) ** 2).sum(1)) for h in self.history]) * (1 + _SLACK)
        self.most = np.zeros((len(self.history), len(self.members), len(now)))
        for t, d in enumerate(self.moved):
            for g, m in enumerate(self.members):
                order = m[np.argsort(-d[m])]
                self.most[t, g] = d[order[0]]
                self.most[t, g, order[0]] = d[order[1]] if len(order) > 1 else 0.0
        return self


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: of doubles where all terms stay below 2^53 (the caller's choice of type), else of Python's integers."""
    if x.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(v, e)) for e in entries.tolist()] for v in x.tolist()], object).reshape(len(x), len(entries))
    e = entries.astype(float)
    return (x**2).sum(1)[:, None] - 2 * x @ e.T + (e**2).sum(1)[None]


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def assign(x: np.ndarray, book: Book, code: np.ndarray, upper: np.ndarray, stamp: np.ndarray, lower: np.ndarray, stamps: np.ndarray) -> int:
    """Brings the codes (n) and bounds up to the last codebook, in place: upper, stamp (n); lower, stamps (n x groups).

    Returns how many distances were measured. A code of -1 is a row without bounds yet.
    """
    now, t, n = book.history[-1], len(book.history) - 1, len(x)
    exact, measured, rows = np.full(n, -1, object if x.dtype == object else float), 0, np.arange(n)
    fresh = code < 0
    held = np.maximum(code, 0)
    least = lower.astype(float) - book.most[stamps, np.arange(lower.shape[1])[None], held[:, None]]
    most = upper.astype(float) + book.moved[stamp, held]
    due = fresh[:, None] | (most[:, None] >= least)
    some = due.any(1)
    known = np.flatnonzero(some & ~fresh)
    if len(known):
        if x.dtype == object:
            exact[known] = [sum((a - b) ** 2 for a, b in zip(v, now[c].tolist())) for v, c in zip(x[known].tolist(), held[known].tolist())]
        else:
            exact[known] = ((x[known] - now[held[known]]) ** 2).sum(1)
        measured += len(known)
        most[known] = _root(exact[known]) * (1 + _SLACK)
        upper[known], stamp[known] = most[known] * (1 + _SLACK), t
        due[known] = most[known][:, None] >= least[known]
    best, at = exact.copy(), code.copy()
    seen = []
    for g, members in enumerate(book.members):
        mine = np.flatnonzero(due[:, g])
        if not len(mine):
            continue
        d = distances(x[mine], now[members])
        measured += d.size
        order = np.argsort(d, axis=1, kind="stable")[:, :2] if d.dtype == object else None
        first = d.argmin(1) if order is None else order[:, 0]
        near = d[np.arange(len(mine)), first]
        if d.shape[1] > 1:
            if order is None:
                rest = d.copy()
                rest[np.arange(len(mine)), first] = np.inf
                second = rest.min(1)
            else:
                second = d[np.arange(len(mine)), order[:, 1]]
        else:
            second = np.full(len(mine), np.inf)
        entry = members[first]
        better = ((at[mine] < 0) | (near < best[mine]) | (near == best[mine]) & (entry < at[mine])).astype(bool)
        best[mine[better]], at[mine[better]] = near[better], entry[better]
        seen.append((g, mine, entry, near, second))
    for g, mine, entry, near, second in seen:
        other = np.where(entry == at[mine], second, near)
        lower[mine, g], stamps[mine, g] = _root(other) * (1 - 2 * _SLACK), t
    # An entry that was left joins what its group's bound covers, if that group was not measured.
    left = np.flatnonzero(~fresh & (at != code))
    group = book.of[held[left]]
    stale = ~due[left, group]
    left, group = left[stale], group[stale]
    lower[left, group] = np.minimum(least[left, group], _root(exact[left])) * (1 - 2 * _SLACK)
    stamps[left, group] = t
    changed = rows[(at != code) | fresh]
    upper[changed], stamp[changed], code[:] = _root(best[changed]) * (1 + 2 * _SLACK), t, at
    return measured


def cuts_of(width: int, parts: int) -> list[int]:
    return [width * p // parts for p in range(parts + 1)]


class _Coder:
    """Rows of integers and their bounds as bytes, to and from arrays."""

    def __init__(self, width: int, parts: int, books: list[Book], plain: bool, scale: int):
        self.cuts, self.books, self.plain, self.width, self.scale = cuts_of(width, parts), books, plain, width, scale
        self.groups = [len(b.members) for b in books]

    def parts_of(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """The integers of each part: whole doubles, or Python's integers."""
        if self.plain:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
        else:
            v = np.array([_whole(x, self.scale) for row in batch.column("v").to_pylist() for x in row], object)
        v = v.reshape(batch.num_rows, self.width)
        return [np.ascontiguousarray(v[:, a:b]) for a, b in zip(self.cuts, self.cuts[1:])]

    def bounds(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, ...]]:
        """code, upper, stamp, lower, stamps of each part."""
        n = batch.num_rows
        if batch.column("state").null_count:
            return [(np.full(n, -1), np.zeros(n, np.float32), np.zeros(n, np.uint8), np.zeros((n, g), np.float32), np.zeros((n, g), np.uint8)) for g in self.groups]
        raw = np.frombuffer(b"".join(batch.column("state").to_pylist()), np.uint8).reshape(n, -1)
        out, at = [], 0
        for g in self.groups:
            take = lambda size, kind: raw[:, at : at + size].copy().view(kind)  # noqa: B023, E731
            code, at = take(2, np.int16)[:, 0].astype(int), at + 2
            upper, at = take(4, np.float32)[:, 0], at + 4
            stamp, at = take(1, np.uint8)[:, 0], at + 1
            lower, at = take(4 * g, np.float32), at + 4 * g
            stamps, at = take(g, np.uint8), at + g
            out.append((code, upper, stamp, lower, stamps))
        return out

    @staticmethod
    def packed(bounds: list[tuple[np.ndarray, ...]]) -> pa.Array:
        n, columns = len(bounds[0][0]), []
        for code, upper, stamp, lower, stamps in bounds:
            columns += [code.astype(np.int16)[:, None].view(np.uint8), upper[:, None].view(np.uint8), stamp[:, None], lower.view(np.uint8).reshape(n, -1), stamps]
        raw = np.ascontiguousarray(np.concatenate(columns, 1))
        return pa.array([r.tobytes() for r in raw], pa.binary())


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(x)) for b in books for entry in b.tolist() for x in entry)


def compress(df: DataFrame, rounds: int = 4, entries: int = 256, parts: int = 4, scale: int = 1024, groups: int = 8, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(rows, codebooks of the parts, distances measured in each pass): vec_id, label, codes (one for each part), error."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "codes")
    v = F.col("v")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    made = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(fine)
    common = made.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")).schema), [], []
    width, cuts = common["width"], cuts_of(common["width"], parts)
    largest = (common["most"] * scale + 2) ** 2 * 4 * width
    plain = largest < 1 << 53  # all terms of all distances are whole doubles
    kept = made.where(F.size("v") == width)
    first = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    start = np.array([[_whole(x, scale) for x in r] for r in first], object)
    history = [[start[:, a:b].astype(np.int64) if plain else start[:, a:b]] for a, b in zip(cuts, cuts[1:])]
    # Floors beyond 64 bits are taken in the tasks, and their sums leave them as several digits.
    kind, digits = ("array<bigint>", 1) if plain else ("array<double>", len(str(_whole(common["most"], scale))) // 18 + 3)
    table = kept.select("vec_id", "label", (F.transform("v", lambda x: F.floor(x * scale)) if plain else F.col("v")).cast(kind).alias("v"), F.lit(None).cast("binary").alias("state"))
    names, label_type = table.columns, table.schema["label"].dataType.simpleString()
    before, measured = "", []

    def pass_over(some: DataFrame, books: list[Book], last: bool) -> DataFrame:
        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = _Coder(width, parts, [b.prepare() for b in books], plain, scale)
            for batch in batches:
                if not batch.num_rows:
                    continue
                xs, bounds = coder.parts_of(batch), coder.bounds(batch)
                counts = [assign(x, book, *own) for x, book, own in zip(xs, coder.books, bounds)]
                done = {"vec_id": batch.column("vec_id"), "label": batch.column("label")}
                if last:
                    error = sum(_final(x, book.history[-1], own[0]) for x, book, own in zip(xs, coder.books, bounds))
                    codes = np.stack([own[0] for own in bounds], 1).astype(np.int32)
                    done |= {"codes": pa.array(list(codes), pa.list_(pa.int32())), "error": pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())}
                else:
                    done |= {"v": batch.column("v"), "state": coder.packed(bounds)}
                done["measured"] = pa.array([sum(counts)] + [0] * (batch.num_rows - 1), pa.int64())
                yield pa.record_batch([*done.values()], [*done])

        made = "codes array<int>, error long" if last else f"v {kind}, state binary"
        return some.mapInArrow(assigned, f"vec_id long, label {label_type}, {made}, measured long")

    def sums(some: DataFrame) -> DataFrame:
        """part, entry, n and the componentwise sums: a row for each task and entry before Spark adds them up."""

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = _Coder(width, parts, [Book(h, groups).prepare() for h in history], plain, scale)
            total = [np.zeros((len(h[-1]), b - a), object) for h, a, b in zip(history, cuts, cuts[1:])]
            n = [np.zeros(len(h[-1]), np.int64) for h in history]
            for batch in batches:
                for p, (x, own) in enumerate(zip(coder.parts_of(batch), coder.bounds(batch))):
                    if plain:  # whole doubles: a batch's sums are exact
                        total[p] += np.stack([np.bincount(own[0], c, len(n[p])).astype(np.int64) for c in x.T], 1).astype(object) if x.size else 0
                    else:
                        np.add.at(total[p], own[0], x)
                    n[p] += np.bincount(own[0], minlength=len(n[p]))
            for p in range(parts):
                used = np.flatnonzero(n[p])
                split = [[d for x in row for d in _digits(x, digits)] for row in total[p][used].tolist()]
                yield pa.record_batch([pa.array([p] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(n[p][used]), pa.array([[*map(str, r)] for r in split], pa.list_(pa.string()))], ["part", "entry", "n", "total"])

        tasks = some.select("v", "state").mapInArrow(added, "part int, entry int, n long, total array<string>")
        places = range(digits * max(b - a for a, b in zip(cuts, cuts[1:])))
        totals = [F.sum(F.try_element_at("total", F.lit(k + 1)).cast("decimal(38,0)")).alias(f"t{k}") for k in places]
        return tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals)

    for r in range(rounds + 1):
        table = scratch.keep(pass_over(table, [Book(list(h), groups) for h in history], r == rounds), f"round-{r}")
        if before:
            scratch.drop(before)
        before = f"round-{r}"
        measured.append(table.agg(F.sum("measured")).first()[0])
        table = table.drop("measured")
        if r < rounds:
            found = sums(table.select(*names)).collect()  # a row for each part and entry
            for p, h in enumerate(history):
                new = h[-1].copy()
                for row in found:
                    if row["part"] == p:
                        new[row["entry"]] = [_joined([int(row[f"t{k * digits + d}"]) for d in range(digits)]) // row["n"] for k in range(new.shape[1])]
                h.append(new)
    return table, [h[-1] for h in history], measured


_DIGIT = 10**18


def _digits(x: int, n: int) -> list[int]:
    """n digits, the lowest first; the highest has the sign and what is left."""
    out = []
    for _ in range(n - 1):
        x, low = divmod(x, _DIGIT)
        out.append(low)
    return [*out, x]


def _joined(digits: list[int]) -> int:
    return sum(d * _DIGIT**k for k, d in enumerate(digits))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), of any size."""
    a, b = x.as_integer_ratio()
    return a * scale // b


def _final(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distances to the entries of the codes, as Python integers."""
    if x.dtype == object:
        return np.array([sum((a - b) ** 2 for a, b in zip(v, entries[c].tolist())) for v, c in zip(x.tolist(), code.tolist())], object)
    return ((x - entries[code]) ** 2).sum(1).astype(np.int64).astype(object)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(codebook_text(books).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """The rows with label_error: the errors summed over all rows of the same label, nulls together."""
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def _sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """The same by plain assignment: a table expression for each codebook and assignment."""
    square = lambda a, b: f"list_dot_product({a}, {a}) - 2 * list_dot_product({a}, {b}) + list_dot_product({b}, {b})"
    made = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        f"rows AS MATERIALIZED (SELECT vec_id, label, p, v[len(v) * p // {parts} + 1 : len(v) * (p + 1) // {parts}] AS x FROM kept, range({parts}) r(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS e FROM rows QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        made.append(f"codes{r} AS MATERIALIZED (SELECT vec_id, label, p, x, d[1] AS dist, d[2] AS entry FROM (SELECT r.vec_id, any_value(r.label) AS label, r.p, any_value(r.x) AS x, min([{square('x', 'e')}, CAST(entry AS DOUBLE)]) AS d FROM rows r JOIN book{r} b ON r.p = b.p GROUP BY r.vec_id, r.p) q)")
        if r < rounds:
            made.append(f"mean{r} AS (SELECT p, entry, list(m ORDER BY k) AS e FROM (SELECT p, entry, k, floor(sum(x[k]) / count(*)) AS m FROM codes{r}, range(1, 1 + (SELECT max(len(x)) FROM rows)) t(k) WHERE k <= len(x) GROUP BY p, entry, k) q GROUP BY p, entry)")
            made.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.e, b.e) AS e FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.entry = b.entry)")
    return f"""WITH {", ".join(made)},
text AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, entry)) AS h FROM book{rounds}),
done AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM codes{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM done, text"""


SQL = _sql()
