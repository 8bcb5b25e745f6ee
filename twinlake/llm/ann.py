"""Operator 7: approximate nearest neighbours with an inverted multi-index.

The halves of a vector are quantised separately; a cell is a pair of centroids. A query walks the pairs in order of
summed distance, with a heap over the two sorted centroid lists, until the cells it has met hold `visit` of all
vectors (and at least k + 1); the entries of those cells are reranked by exact distance in double precision.

The walk stops early where it can: a first look at the nearest cells bounds a query's k-th distance, and a cell whose
least possible distance (from its centroids' distances and its halves' radii) lies above that bound is passed over.

Centroids are fitted on at most `fit_rows` vectors; every vector is indexed. The entries are dealt by first centroid, those
of a populous one in chunks of about `chunk` vectors, and each chunk goes to one task once; the queries that probe it
follow it in a stream of batches. So a task holds one chunk and one batch, whatever the number of queries.

Defined results: vectors that are null, all zero, of another length than the most common one, or hold null or
non-finite parts take no part, as queries or as candidates; each row of the queries has a list of its own, also where ids
repeat (the lists then share a query_id); a query never finds rows of its own id; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def k_means(points: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """At most k centroids; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centre = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(steps):
        of = nearest(points, centre)
        n = np.bincount(of, minlength=len(centre))
        for d in range(points.shape[1]):
            total = np.bincount(of, points[:, d], len(centre))
            centre[n > 0, d] = total[n > 0] / n[n > 0]
    return centre


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1)[None] - 2 * points @ centre.T).argmin(1)


def cells_in_order(one: np.ndarray, two: np.ndarray, population: np.ndarray, wanted: int, radii: tuple[np.ndarray, np.ndarray] | None = None, bound: float = np.inf) -> list[int]:
    """Cells by summed distance of their centroids until those met hold `wanted` vectors; empty cells are passed over, and
    so are cells all of whose vectors lie beyond `bound`.

    one, two: squared distances of the query's halves to the centroids; population: vectors by cell; radii: for each
    centroid of a half how far its farthest vector is.
    """
    first, second, m = np.argsort(one, kind="stable"), np.argsort(two, kind="stable"), len(two)
    a, b = one[first].tolist(), two[second].tolist()
    least = [[0.0] * len(a), [0.0] * m]
    if radii is not None:
        least = [(np.maximum(0, np.sqrt(d) - r) ** 2).tolist() for d, r in zip((one, two), radii)]
    heap, found, got = [(a[0] + b[0], 0, 0)], [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        x, y = int(first[i]), int(second[j])
        if population[x * m + y] and least[0][x] + least[1][y] <= bound * (1 + 1e-9):
            found.append(x * m + y)
            got += int(population[x * m + y])
        if j + 1 < m:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def _best(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, entry_ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray, k: int) -> Iterator[tuple[int, int, int, float]]:
    """(row, query id, entry id, distance): each query's k nearest of these vectors with another id; ties to the smaller id."""
    rough = squares[None] - 2 * queries @ vectors.T
    scale = squares.max() + (queries**2).sum(1)
    for n, q in enumerate(ids):
        row = np.where(entry_ids == q, np.inf, rough[n])
        most = np.partition(row, k - 1)[k - 1] if len(row) > k else row[row < np.inf].max(initial=-np.inf)
        near = np.flatnonzero((row <= most + 1e-9 * scale[n]) & (row < np.inf))
        exact = np.sqrt(((vectors[near] - queries[n]) ** 2).sum(1))
        for at in np.lexsort((entry_ids[near], exact))[:k]:
            yield int(rows[n]), int(q), int(entry_ids[near[at]]), float(exact[at])


def _probe(index: DataFrame, probes: DataFrame, salt_of: Column, m: int, k: int) -> DataFrame:
    """row, query_id, vec_id, score: for each query (row, id, v, i, salt, cells) and chunk of a first centroid i its k best."""
    blank = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    entries = index.select(F.floor(F.col("cell") / m).cast("int").alias("i"), F.lit(0).alias("tag"), "id", "v", "cell", *blank(("row", "long"), ("cells", "array<int>")))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), salt_of).cast("int"))
    asked = probes.select("i", F.lit(1).alias("tag"), "id", "v", *blank(("cell", "int")), "row", "cells", "salt")
    both = entries.unionByName(asked).repartition("i", "salt").sortWithinPartitions("i", "salt", "tag")

    def reranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, chunk = None, [], {}
        for pdf in batches:
            for group, some in pdf.groupby(["i", "salt"], sort=False):
                if group != at:
                    at, parts, chunk = group, [], {}
                new, queries = some[some["tag"] == 0], some[some["tag"] == 1]
                if len(new):
                    parts.append((new["id"].to_numpy(), new["cell"].to_numpy(), np.stack(new["v"].to_numpy())))
                if not len(queries) or not parts:
                    continue
                if not chunk:
                    ids, cell, v = (np.concatenate([p[x] for p in parts]) for x in range(3))
                    for c in np.unique(cell):
                        here = cell == c
                        chunk[int(c)] = ids[here], v[here], (v[here] ** 2).sum(1)
                wants: dict[int, list[int]] = {}
                for n, cells in enumerate(queries["cells"]):
                    for c in cells:
                        if int(c) in chunk:
                            wants.setdefault(int(c), []).append(n)
                row, qid, qv, found = queries["row"].to_numpy(np.int64), queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()), []
                for c, mine in wants.items():
                    found += _best(row[mine], qid[mine], qv[mine], *chunk[c], k)
                out = pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"])
                yield out.sort_values(["row", "score", "vec_id"]).groupby("row").head(k)

    return both.mapInPandas(reranked, "row long, query_id long, vec_id long, score double")


def search(df: DataFrame, queries: DataFrame, k: int = 10, centroids: int = 64, visit: float = 0.6, fit_rows: int = 20_000, chunk: int = 16_384, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (key, vector) its k nearest rows of `df`."""
    spark = df.sparkSession
    scratch, schema = Scratch(spark, "ann"), "query_id long, rank int, vec_id long, score double"

    def usable(some: DataFrame) -> DataFrame:
        v = F.col("v")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return some.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))

    common = usable(df).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim, total = common["dim"], common["count"]
    rows, asked = usable(df).where(F.size("v") == dim), usable(queries).where(F.size("v") == dim)
    asked = scratch.keep(asked.withColumn("row", F.monotonically_increasing_id()), "asked")  # fixed once written
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)) < int(min(1.0, 1.2 * fit_rows / total + 1e-3) * (1 << 40))  # before the sort: a few more than wanted
    sample = np.array([r["v"] for r in rows.where(share).orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()])
    if not len(sample):
        sample = np.array([r["v"] for r in rows.limit(fit_rows).select("v").collect()])
    half = max(1, dim // 2)
    one = k_means(sample[:, :half], centroids)
    two = k_means(sample[:, half:], centroids) if dim > 1 else np.zeros((1, 0))
    m = len(two)

    def quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                x, y = nearest(v[:, :half], one), nearest(v[:, half:], two)
                far = [np.sqrt(((w - c) ** 2).sum(1)) for w, c in ((v[:, :half], one[x]), (v[:, half:], two[y]))]
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": x * m + y, "far_1": far[0], "far_2": far[1]})

    index = scratch.keep(rows.mapInPandas(quantised, "id long, v array<double>, cell int, far_1 double, far_2 double"), "index")
    population, radii = np.zeros(len(one) * m, np.int64), (np.zeros(len(one)), np.zeros(m))
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_1").alias("a"), F.max("far_2").alias("b")).collect():  # one row per centroid pair
        population[r["cell"]] = r["n"]
        for half_radii, c, far in ((radii[0], r["cell"] // m, r["a"]), (radii[1], r["cell"] % m, r["b"])):
            half_radii[c] = max(half_radii[c], far)
    salts = np.maximum(1, -(-population.reshape(len(one), m).sum(1) // chunk)).tolist()
    salt_of = F.element_at(F.array(*map(F.lit, salts)), F.col("i") + 1)

    def probes(some: DataFrame, wanted: int) -> DataFrame:
        def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = []
                for row, q, v, bound in zip(pdf["row"], pdf["id"], pdf["v"], pdf["bound"]):
                    met: dict[int, list[int]] = {}
                    for cell in cells_in_order(((one - v[:half]) ** 2).sum(1), ((two - v[half:]) ** 2).sum(1), population, wanted, radii, bound**2):
                        met.setdefault(cell // m, []).append(cell)
                    found += [(row, q, v, i, salt, cells) for i, cells in met.items() for salt in range(salts[i])]
                yield pd.DataFrame(found, columns=["row", "id", "v", "i", "salt", "cells"])

        return some.mapInPandas(walked, "row long, id long, v array<double>, i int, salt int, cells array<int>")

    near = _probe(index, probes(asked.withColumn("bound", F.lit(float("inf"))), max(4 * k, total // 1000)), salt_of, m, k)
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    kth = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy(F.col("row").alias("near_row")).agg(F.max("score").alias("kth"), F.count("*").alias("n"))
    bounded = asked.join(kth, F.col("row") == F.col("near_row"), "left").withColumn("bound", F.when(F.col("n") == k, F.col("kth")).otherwise(float("inf")))
    best = _probe(index, probes(bounded.select("row", "id", "v", "bound"), max(k + 1, int(np.ceil(visit * total)))), salt_of, m, k)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
