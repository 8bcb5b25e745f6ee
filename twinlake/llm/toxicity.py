"""Operator 8: severity of toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 for labelled clean, 1 and 2 for labelled toxic documents. The labels say no more than toxic or not, so
the upper grade takes evidence from outside: the sample is dealt into two folds, marked features are found in each fold
alone, and a toxic document has grade 2 if it holds more than the median number of features that the OTHER fold marks.
One weight vector serves all thresholds: P(grade > k) = logistic(w.x - cut_k), cut_0 < cut_1. The expected severity is the
sum of these probabilities; a document is rejected where P(grade > 0) >= 0.25 (two marked words of a language suffice).

Features are the lower-cased words of the whole text and the first four and five letters of longer words, each
present or absent, by 64-bit hash. Features are counted over the labelled sample by Spark; those whose log-likelihood
ratio is `least_g` at least and that are more frequent in toxic documents are marked, and the weights are regularised by
their squares; no word can excuse another. Only the sample is bounded: the `fit_rows` labelled rows of least hashed id.

Defined results: null or empty texts have no feature and severity as the cuts alone give it, and are never rejected;
without both clean and toxic labels there is no evidence: severity 0, nothing rejected; labels that are null or
for unknown documents are skipped, repeated ones count as often; extra columns stay as they are, and where one has the name
of a result, the result's name gets "_" behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, free_name, slices

_WORD = re.compile(r"[^\W\d_]+")


def names(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in (4, 5) if len(word) > n)]


def features(text: str | None) -> set[int]:
    return {xxhash.xxh3_64_intdigest(n) - (1 << 63) for w in set(_WORD.findall((text or "").lower())) for n in names(w)}


@dataclass
class Ordinal:
    """weights by feature hash, and rising cuts."""

    weights: dict[int, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=lambda: [40.0, 41.0])

    def above(self, x: float) -> list[float]:
        """P(grade > k) for each k."""
        return [float(1 / (1 + np.exp(np.clip(c - x, -40, 40)))) for c in self.cuts]


def fit(rows: list[list[int]], grades: np.ndarray, columns: list[int], cuts: int = 2, l2: float = 0.3, steps: int = 400) -> Ordinal:
    """Maximum penalised likelihood by gradient steps scaled by their running moments; rows hold positions in `columns`."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    w, cut = np.zeros(len(columns)), np.log(np.array([(grades <= k).sum() + 1.0 for k in range(cuts)]) / np.array([(grades > k).sum() + 1.0 for k in range(cuts)]))
    cut = np.maximum.accumulate(cut + 1e-3 * np.arange(cuts))
    low, high = np.arange(cuts)[:, None] == grades - 1, np.arange(cuts)[:, None] == grades
    mean, square = np.zeros(len(columns) + cuts), np.zeros(len(columns) + cuts)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col], len(rows)) if len(col) else np.zeros(len(rows))
        p = 1 / (1 + np.exp(np.clip(cut[:, None] - z, -40, 40)))  # P(grade > k)
        lower, upper = np.where(low, p, 0).sum(0) + (grades == 0), np.where(high, p, 0).sum(0)
        mass = np.maximum(lower - upper, 1e-9)
        slope = p * (1 - p)
        dz = (np.where(low, slope, 0).sum(0) - np.where(high, slope, 0).sum(0)) / mass
        dcut = (np.where(high, slope, 0) / mass - np.where(low, slope, 0) / mass).sum(1)
        gw = (np.bincount(col, dz[at], len(columns)) if len(col) else np.zeros(len(columns))) - l2 * w
        g = np.concatenate([gw, dcut])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g**2
        move = 0.2 / (1 + step / 100) * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, cut = np.maximum(w + move[: len(columns)], 0), cut + move[len(columns) :]  # marked features never speak against
        cut = np.maximum.accumulate(cut + np.array([0, *[1e-6] * (cuts - 1)]))
    return Ordinal(dict(zip(columns, w.tolist())), cut.tolist())


def _marked(seen: tuple[str, str], n: dict[int, int], least_g: float) -> F.Column:
    """Whether a feature with (rows, toxic rows) of that name speaks for toxicity, in a sample of n clean and toxic rows."""
    hits, t = (F.col(c) for c in seen)
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return F.lit(False)
    part = lambda some, n: F.when(some > 0, some * F.ln(some * float(n0 + n1) / (hits * n))).otherwise(0.0)
    return (hits > 0) & (2 * (part(t, n1) + part(hits - t, n0)) >= least_g) & (t * n0 > (hits - t) * n1)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, least_g: float = 18.0, key: str = "doc_id", text: str = "text") -> Ordinal:
    """The model of the labelled sample. Only counts of marked features and sample rows cut to them reach the driver."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    some = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("label_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, 1.2 * fit_rows / max(1, some.count()) + 1e-3)  # by hash before the sort: a few more than wanted
    some = some.where(F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40))).orderBy(F.xxhash64("label_id"), "toxic").limit(fit_rows)
    fold = F.pmod(F.xxhash64("label_id", F.lit(9)), F.lit(2)).cast("int")
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(some, F.col("id") == F.col("label_id")).select("toxic", fold.alias("fold"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.record_batch([batch.column("toxic"), batch.column("fold"), pa.array([sorted(features(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], ["toxic", "fold", "present"])

    sample = scratch.keep(found.mapInArrow(hashed, "toxic int, fold int, present array<long>"), "sample")
    n: list[dict[int, int]] = [{}, {}, {}]  # rows by label: of each fold, of both
    for r in sample.groupBy("fold", "toxic").count().collect():
        for which in (r["fold"], 2):
            n[which][r["toxic"]] = n[which].get(r["toxic"], 0) + r["count"]
    if len(n[2]) < 2:
        return Ordinal()
    in_fold = lambda k, c: F.sum(F.when(F.col("fold") == k, c).otherwise(0))
    rows = sample.select("toxic", "fold", F.explode("present").alias("feature")).groupBy("feature")
    counted = rows.agg(*[in_fold(k, F.lit(1)).alias(f"h{k}") for k in (0, 1)], *[in_fold(k, F.col("toxic")).alias(f"t{k}") for k in (0, 1)], F.count("*").alias("h2"), F.sum("toxic").alias("t2"))
    flags = counted.select("feature", *[_marked((f"h{k}", f"t{k}"), n[k], least_g).alias(f"m{k}") for k in (0, 1, 2)])
    found = flags.where("m0 OR m1 OR m2").collect()  # significant features of the sample
    columns = sorted(r["feature"] for r in found if r["m2"])
    if not columns:
        return Ordinal()
    place = {c: k for k, c in enumerate(columns)}
    by_fold = [{r["feature"] for r in found if r[f"m{k}"]} for k in (0, 1)]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present, folds = batch.column("present").to_pylist(), batch.column("fold").to_pylist()
            cut = [[place[f] for f in p if f in place] for p in present]
            outside = [len(by_fold[1 - k].intersection(p)) for k, p in zip(folds, present)]
            yield pa.record_batch([batch.column("toxic"), batch.column("fold"), pa.array(cut, pa.list_(pa.int32())), pa.array(outside, pa.int32())], ["toxic", "fold", "cut", "outside"])

    cut = sample.mapInArrow(reduced, "toxic int, fold int, cut array<int>, outside int").collect()
    cut = sorted(cut, key=lambda r: (r["toxic"], r["fold"], r["outside"], sorted(r["cut"])))  # the same order on every run
    toxic, folds, outside = (np.array([r[c] for r in cut]) for c in ("toxic", "fold", "outside"))
    median = [np.median(outside[(toxic == 1) & (folds == k)]) if ((toxic == 1) & (folds == k)).any() else 0 for k in (0, 1)]
    grades = np.where(toxic == 0, 0, 1 + (outside > np.where(folds == 0, *median)))
    return fit([r["cut"] for r in cut], grades, columns)


class _Scorer:
    """Severity and rejection of texts, with what is known of the words met."""

    def __init__(self, model: Ordinal, reject_at: float):
        self.model, self.reject_at, self.known = model, reject_at, {}

    def __call__(self, text: str | None) -> tuple[float, bool]:
        words, known, weights = set(_WORD.findall((text or "").lower())), self.known, self.model.weights
        for w in words.difference(known):
            known[w] = tuple(h for h in (xxhash.xxh3_64_intdigest(n) - (1 << 63) for n in names(w)) if h in weights)
        present = {h for w in words if known[w] for h in known[w]}
        if len(known) > 400_000:
            self.known = {}
        above = self.model.above(sum(weights[h] for h in sorted(present)))
        return sum(above), bool(words) and above[0] >= self.reject_at


def score(docs: DataFrame, model: Ordinal, text: str = "text", reject_at: float = 0.25) -> DataFrame:
    """The documents with toxic_severity (expected grade) and toxic_rejected; no shuffle."""
    place, schema = docs.columns.index(text), StructType(docs.schema.fields[:])
    for name, kind in (("toxic_severity", "double"), ("toxic_rejected", "boolean")):
        schema = schema.add(free_name(name, schema.names), kind)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Scorer(model, reject_at)
        for whole in batches:
            for batch in slices(whole):
                found = [of(t) for t in batch.column(place).to_pylist()]
                yield pa.record_batch([*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([r for _, r in found], pa.bool_())], schema.names)

    return docs.mapInArrow(scored, schema)


def accepted(docs: DataFrame, model: Ordinal, text: str = "text", reject_at: float = 0.25) -> DataFrame:
    """The documents that are not rejected; columns as they are."""
    place = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Scorer(model, reject_at)
        for whole in batches:
            for batch in slices(whole):
                yield batch.filter(pa.array([not of(t)[1] for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
