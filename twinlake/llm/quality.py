"""Operator 11: quality by votes of the nearest labelled texts in a latent-semantic space.

Terms of a text are its words in lower case, the signs at them, the shapes and lengths of words, and how many tokens repeat
the one before; each falls into one of `buckets`. Weights are tf-idf, with document frequencies
counted over all documents; the latent space is the leading singular vectors of the labelled sample's terms.

The labelled sample, at most `fit_rows` rows, is all that is broadcast besides the projection, so both have fixed bounds.
Every document's cosines with all labelled vectors are computed, a block of documents at a time, and its `k` nearest vote,
each with its similarity raised to `power`: no candidate search leaves any out. A vote of the rarer label counts as much
more as that label is rarer, up to `most_weight`.

Defined results: a null or empty text, or one without a direction in the space, has the sample's share of label 1; without
labels the score is 0.5; label rows that are null or for unknown documents are skipped; label rows count once for each
(doc_id, quality), and where several documents have the doc_id, with the first text in order; rows with a null doc_id are
scored and not held out; columns of the documents besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

_PIECE = 1 << 20
_BLANK = re.compile(r"\s")
_SIGNS = re.compile(r"[^\w\s]+|_+")
#: What a worker remembers of tokens: so many, and so many characters, besides those of one piece.
_KNOWN, _CHARS = 200_000, 8_000_000
#: Shares of tokens that repeat the one before; each is a term of its own.
_SHARES = (0.05, 0.2, 0.5)


def pieces(text: str) -> Iterator[str]:
    """Stretches of about a million characters, cut at blanks."""
    at = 0
    while len(text) - at > _PIECE:
        found = _BLANK.search(text, at + _PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class Terms:
    """How often each bucket's terms occur in texts."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.chars = buckets, {}, 0
        self.shapes = {name: self.bucket(name) for name in ("upper", "title", "digits", "lower", "signs only")}
        self.lengths = [self.bucket(f"n{k}") for k in range(7)]
        self.table = np.zeros((0, 4), np.int32)  # the terms of each known token; `buckets` stands for none

    def bucket(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) % self.buckets

    def of_token(self, token: str) -> tuple[int, int, int, int]:
        word, signs = token, self.buckets
        if not token.isalpha():
            word = _SIGNS.sub("", token)
            if len(word) < len(token):
                signs = self.bucket("s" + "".join(_SIGNS.findall(token))[:8])
            if not word:
                return signs, self.shapes["signs only"], self.buckets, self.buckets
        shape = "upper" if len(word) > 1 and word.isupper() else "title" if word[:1].isupper() else "digits" if word.isdigit() else "lower"
        return signs, self.bucket(f"w{word.lower()}"), self.shapes[shape], self.lengths[min(len(word) // 3, 6)]

    def learn(self, tokens: list[str]) -> None:
        new = set(tokens).difference(self.known)
        if new and (len(self.known) + len(new) > _KNOWN or self.chars > _CHARS):
            self.known, self.chars, new = {}, 0, set(tokens)
        if len(self.known) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.known) + len(new), 4), np.int32)])
        for token in new:
            self.table[len(self.known)] = self.of_token(token)
            self.known[token] = len(self.known)
            self.chars += len(token)

    def counts(self, text: str | None) -> np.ndarray:
        """A number for each bucket."""
        found, n, repeated, last = np.zeros(self.buckets + 1, np.int64), 0, 0, None
        for piece in pieces(text or ""):
            if tokens := piece.split():
                self.learn(tokens)
                ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
                found += np.bincount(self.table[ids].ravel(), minlength=self.buckets + 1)
                n, repeated, last = n + len(tokens), repeated + int((ids[1:] == ids[:-1]).sum()) + (tokens[0] == last), tokens[-1]
        for share in _SHARES:
            if repeated >= share * n and repeated:
                found[self.bucket(f"repeated {share}")] += repeated
        return found[:-1]


def document_frequencies(docs: DataFrame, buckets: int, text: str = "text") -> tuple[int, np.ndarray]:
    """(documents, documents by bucket) over all documents; a row for each task and bucket in the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n = Terms(buckets), np.zeros(buckets, np.int64), 0
        for whole in batches:
            for batch in slices(whole):
                for t in batch.column(0).to_pylist():
                    df += terms.counts(t) > 0
                    n += 1
        used = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], n))], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    by = {r["bucket"]: r["n"] for r in rows}
    return by.pop(-1, 0), np.array([by.get(b, 0) for b in range(buckets)], np.int64)


@dataclass
class Voters:
    """The latent space, and the labelled vectors in it."""

    weights: np.ndarray  # idf by bucket
    axes: np.ndarray  # buckets x dims
    vectors: np.ndarray  # labelled rows x dims, of length 1
    labels: np.ndarray
    prior: float
    k: int
    power: float
    most_weight: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """The unit vectors of texts by their counts (texts x buckets); zero where there is no direction."""
        return _unit(_weighted(counts, self.weights) @ self.axes)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among each vector's k nearest by exact cosine."""
        if not len(self.vectors):
            return np.full(len(vectors), self.prior)
        cosine = vectors @ self.vectors.T
        k = min(self.k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** self.power
        ones = self.labels[near] == 1
        rare = (self.labels == 1).mean()
        heavy = np.where(ones, min(self.most_weight, max(1.0, (1 - rare) / max(rare, 1e-9))), min(self.most_weight, max(1.0, rare / max(1 - rare, 1e-9))))
        total = (votes * heavy).sum(1)
        share = np.where(total > 0, (votes * heavy * ones).sum(1) / np.where(total > 0, total, 1), self.prior)
        return np.where((vectors != 0).any(1), share, self.prior)


def _weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * idf).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows.astype(float) ** 2).sum(1, keepdims=True))
    return np.divide(rows, size, out=np.zeros(rows.shape, np.float32), where=size > 1e-12, casting="unsafe").astype(np.float32)


def leading_axes(rows: np.ndarray, dims: int, seed: int = 3, steps: int = 6) -> np.ndarray:
    """The leading right singular vectors, by iterating on a random range."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rows @ rng.standard_normal((rows.shape[1], min(dims + 16, *rows.shape))).astype(np.float32))[0]
    for _ in range(steps):
        q = np.linalg.qr(rows @ (rows.T @ q))[0]
    return np.linalg.svd(q.T @ rows, full_matrices=False)[2][:dims].T.astype(np.float32)


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 3000, buckets: int = 8192, dims: int = 32, k: int = 15, power: float = 8.0, most_weight: float = 3.0, key: str = "doc_id", text: str = "text") -> Voters:
    """The labelled vectors of the `fit_rows` labels of least hashed id that are not held out."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") > 0).cast("int").alias("quality")).distinct()
    some = some.where(~held_out("label_id")).orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(fit_rows)
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), F.col("id") == F.col("label_id"))  # fit_rows rows
    n, df = document_frequencies(docs, buckets, text)
    weights = np.log((n + 1) / (df + 1)) + 0.1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(buckets)
        for whole in batches:
            for batch in slices(whole):
                made = [terms.counts(t) for t in batch.column("text").to_pylist()]
                used = [np.flatnonzero(m) for m in made]
                columns = [batch.column("label_id"), batch.column("quality"), *(pa.array(x, pa.list_(pa.int64())) for x in (used, [m[u] for m, u in zip(made, used)]))]
                yield pa.record_batch(columns, ["label_id", "quality", "bucket", "n"])

    first = found.groupBy("label_id", "quality").agg(F.min("text").alias("text"))
    rows = first.mapInArrow(counted, "label_id long, quality int, bucket array<long>, n array<long>").collect()  # fit_rows rows of at most `buckets` counts
    rows.sort(key=lambda r: (r["label_id"], r["quality"]))
    labelled = np.array([r["quality"] for r in rows], np.int8)
    prior = float(labelled.mean()) if len(rows) else 0.5
    made = np.zeros((len(rows), buckets), np.float32)
    for at, r in enumerate(rows):
        b = np.array(r["bucket"], np.int64)
        made[at, b] = _weighted(np.array(r["n"]), weights[b])
    made = _unit(made)
    if not made.any():
        return Voters(weights, np.zeros((buckets, 1), np.float32), np.zeros((0, 1), np.float32), labelled[:0], prior, k, power, most_weight)
    axes = leading_axes(made, dims)
    vectors = _unit(made @ axes)
    there = vectors.any(1)
    return Voters(weights, axes, vectors[there], labelled[there], prior, k, power, most_weight)


def score(docs: DataFrame, model: Voters, key: str = "doc_id", text: str = "text", block: int = 128) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no shuffle."""
    buckets = len(model.weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(buckets)
        for whole in batches:
            for batch in slices(whole, block):
                found = model.score(model.project(np.stack([terms.counts(t) for t in batch.column("text").to_pylist()])))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(np.round(found, 6))], ["doc_id", "held_out", "score"])

    asked = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    rows = asked.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
