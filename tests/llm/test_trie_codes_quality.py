"""Operators 11 to 13 against definitions, with nulls, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.llm import prefix_trie, quality, registry, vector_codes

SF = "/root/testdata/sf0.001"
CLASH = ("n", "part", "side", "depth", "words", "seq", "code", "v", "state", "score", "bucket", "held_out", "label_id")


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def trie_by_definition(rows):
    """The nodes of rows (conv_id, turn, role, text), as the query names them."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    members = collections.defaultdict(list)
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, turns.get(c - int(math.fmod(c, 20)), [])
        made = tuple(base[:h] + turns[c][h:])
        for d in range(len(made) + 1):
            members[made[:d]].append((c, len(made)))
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    found = {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len((node[-1][1] if node else "").split())
        below = [found[k] for k in kids[node]]
        ends = ",".join(str(c) for c in sorted(c for c, n in members[node] if n == len(node)))
        up = min(c for c, _ in members[node[:-1]]) if node else None
        found[node] = (min(c for c, _ in members[node]), len(node), up, len(members[node]), len(below), sum(b[5] for b in below) or 1, own_saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(found.values(), key=str)


def trie_of(conversations, **options):
    return prefix_trie.prefix_trie(prefix_trie.regrafted(prefix_trie.turn_sequences(conversations)), **options)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("turns_per_part", [9, 200_000])
def test_trie(spark, turns_per_part):
    rng = np.random.default_rng(turns_per_part)
    rows = []
    for c in range(0, 130):
        if c % 20 == 0 and c % 60:
            continue  # absent bases
        rows += [(c, int(t), "ab"[int(rng.integers(2))], ["one", "two  words", "three of them", None][int(rng.integers(4)) if c % 3 else 0]) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, None, "deep") for c in range(200, 210) for t in range(9)] + [(500, t, None, f"long {t}") for t in range(300)] + [(501, t, "", f"long {t}") for t in range(310)]
    rows += [(7, None, "b", "tied"), (7, None, "a", "tied"), (7, None, None, None), (9, 1, "z", "tied"), (9, 1, "y", "tied"), (9, 1, "y", "tied"), (None, 1, "a", "b"), (-5, 2, "a", "x"), (-25, 1, "a", "x"), (1 << 40, 0, "a", "one")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((tuple(r) for r in trie_of(df.repartition(5), turns_per_part=turns_per_part).select(*TRIE).collect()), key=str)
    assert got == trie_by_definition(rows)


def test_trie_of_nothing_and_of_copies(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie_of(spark.createDataFrame([], schema)).count() == 0
    assert trie_of(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    rows = [(c, t, "a", "same words here") for c in range(9000) for t in range(5)]  # over two strings of ids
    got = sorted((tuple(r) for r in trie_of(spark.createDataFrame(rows, schema), turns_per_part=2).select(*TRIE).collect()), key=str)
    assert got == trie_by_definition(rows)


def test_merge_tree():
    depth, low, high, parent = prefix_trie.merge_tree([2, 3, 3, 1], [2, 1, 0])
    assert (depth, low, high) == ([2, 3, 3, 1, 1, 0], [0, 1, 2, 3, 0, 0], [1, 1, 2, 3, 2, 3]) and parent == [4, 0, 4, 5, 5, -1]
    assert prefix_trie.merge_tree([], []) == ([], [], [], [])


def codes_by_definition(rows, entries=256, parts=4):
    """{(vec_id, place): (code, error)} and the codebooks, all in Python's integers."""
    rows = [(i, [int(x * 1024 // 1) for x in v]) for i, v in rows]
    width = len(rows[0][1])
    cuts = [width * p // parts for p in range(parts + 1)]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for a, b in zip(cuts, cuts[1:]):
        book = [v[a:b] for _, v in order[:entries]]
        for step in range(5):
            of = []
            for _, v in rows:
                d = [sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in book]
                of.append((min(d), d.index(min(d))))
            if step < 4:
                for e in range(len(book)):
                    mine = [v[a:b] for (_, v), (_, k) in zip(rows, of) if k == e]
                    if mine:
                        book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        books.append(book)
        for k, (d, e) in enumerate(of):
            codes[k].append(e)
            errors[k] += d
    return sorted((str(i), "".join(f"{c:02x}" for c in cs), e) for (i, _), cs, e in zip(rows, codes, errors)), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def codes_of(df, **options):
    rows, books, measured = vector_codes.compress(df, **options)
    got = sorted((str(r.vec_id), "".join(f"{c:02x}" for c in r.codes), r.error) for r in rows.collect())
    return got, vector_codes.digest(books), measured


def test_vector_codes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 10))
    rows = [(int(i), (centres[i % 12] + 0.1 * rng.normal(size=10)).tolist()) for i in rng.permutation(400)]
    rows += [(3, rows[0][1]), (3, rows[1][1]), (None, rows[2][1]), (900, [0.0] * 10), (901, [0.0] * 10)]
    odd = [(1000, None), (1001, [float("nan")] * 10), (1002, [None] * 10), (1003, [1.0]), (1004, []), (1005, [float("inf")] * 10)]
    df = clashing(spark.createDataFrame([(i, v, None if (i or 0) % 3 == 0 else (i or 0) % 5) for i, v in rows + odd], "vec_id long, embedding array<double>, label int"))
    got, digest, measured = codes_of(df.repartition(3), entries=40)
    want, want_digest = codes_by_definition(rows, entries=40)
    assert got == want and digest == want_digest
    assert measured[0] == len(rows) * 4 * 40 and measured[-1] < measured[0] / 2  # the bounds save most distances
    few = codes_of(spark.createDataFrame([(i, v, 0) for i, v in rows[:7]], "vec_id long, embedding array<double>, label int"))
    assert few[:2] == codes_by_definition(rows[:7])
    assert codes_of(df.limit(0)) == ([], hashlib.sha256(b"").hexdigest(), [])
    with_sums = vector_codes.with_label_errors(vector_codes.compress(df, entries=40)[0]).collect()
    sums = collections.Counter()
    for r in with_sums:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in with_sums) and len(with_sums) == len(rows)


def test_vector_codes_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 10.0 ** int(rng.integers(0, 38))).tolist()) for i in range(60)]
    got, digest, _ = codes_of(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int"), entries=8)
    want, want_digest = codes_by_definition([(i, [_Exact(x) for x in v]) for i, v in rows], entries=8)
    assert got == [(i, c, e if e < 1 << 63 else None) for i, c, e in want] and digest == want_digest


class _Exact:
    """A double whose floor of 1024 times it is exact."""

    def __init__(self, x):
        self.x = x

    def __mul__(self, n):
        a, b = self.x.as_integer_ratio()
        return _Whole(a * n, b)


class _Whole:
    def __init__(self, a, b):
        self.a, self.b = a, b

    def __floordiv__(self, one):
        return self.a // self.b


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_prefix_trie"])
def test_registered_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in found.select(sorted(found.columns)).collect()) == sorted(want) or sorted(map(str, (tuple(r) for r in found.select(sorted(found.columns)).collect()))) == sorted(map(str, want))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.QUERIES["op11_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([r for r in held if labels[r.doc_id] == q] for q in (1, 0))
    print("good lost", sum(not r.predicted for r in good), len(good), "bad caught", sum(not r.predicted for r in bad), len(bad))
    assert sum(not r.predicted for r in bad) > 0.95 * len(bad) and sum(r.predicted for r in good) > 0.99 * len(good)


def test_votes_by_definition():
    rng = np.random.default_rng(2)
    labelled, labels = quality._unit(rng.normal(size=(50, 6)).astype(np.float32)), (np.arange(50) % 4 > 0).astype(np.int8)
    model = quality.Voters(np.ones(8), np.zeros((8, 6), np.float32), labelled, labels, 0.75, 5, 2.0, 2.0)
    asked = quality._unit(np.concatenate([rng.normal(size=(7, 6)), np.zeros((1, 6))]).astype(np.float32))
    for v, got in zip(asked, model.score(asked)):
        near = sorted(((float(v @ w), int(y)) for w, y in zip(labelled, labels)), reverse=True)[:5]
        votes = [(max(s, 0) ** 2 * (1 if y else 2), y) for s, y in near]
        assert got == pytest.approx(sum(w for w, y in votes if y) / sum(w for w, _ in votes) if v.any() else 0.75, abs=1e-5)


def test_quality_of_odd_rows(spark):
    words = [f"w{k}" for k in range(40)]
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join(rng.choice(words, 30)).upper() + " !!" if bad else " ".join(rng.choice(words, 30))
    rows = [(k, text(k % 2)) for k in range(60)] + [(70, None), (71, ""), (72, " \n\t"), (None, "w1 w2"), (73, "w3 " * 600_000), (0, "w1"), (0, "w1")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(None, 1), (1, None), (999, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert {by[k].score for k in (70, 71, 72)} == {round(model.prior, 6)} and not by[None].held_out
    assert np.mean([by[k].score for k in range(4, 60, 2)]) > 0.9 > 0.1 > np.mean([by[k].score for k in range(1, 60, 2)])
    for none in (labels.limit(0), labels.where("quality IS NULL")):
        assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_terms_over_pieces(monkeypatch):
    text = " ".join(f"Word{k % 50}!! word word" for k in range(2000))
    whole = quality.Terms(512).counts(text)
    monkeypatch.setattr(quality, "_PIECE", 64)
    monkeypatch.setattr(quality, "_KNOWN", 10)
    assert (quality.Terms(512).counts(text) == whole).all() and "".join(quality.pieces(text)) == text
