"""Operator 13: the trie of conversation prefixes, by union-find over sorted neighbours.

A conversation is a sequence of turn digests (16 bytes of SHA-256 of role and text). Distinct sequences are sorted into
ranges; in a range, the edges between neighbours are weighted by the number of turns both begin with and merged in
descending weight: a merge of components whose left side ends deeper makes a branching node. Chains of nodes with one
child follow from the depths of a node and its parent.

A range holds all of a node's members unless the node lies on a path that goes on beyond the range's first or last
sequence. Of such nodes it knows partial sums only. What remains of the ranges, their edges, is a forest of its own: the
same union-find over the turns that neighbouring ranges share tells for every shared node in which range it begins, and
the partial sums of a shared node are added up under that name. Nodes that two ranges counted twice are taken off along
each edge.

Sizes: a range holds about `turns_per_part` turns of distinct sequences, equal conversations are one sequence with a
count, so no hot conversation, first turn or passage makes a range longer. The driver sees two numbers for each range. A
conversation is one row, 20 bytes a turn. The digest of a node's members reads their ids in order, so it is one stream for
each node, of strings of up to 4,096 ids that other tasks have sorted and joined.

Defined results: rows without conv_id take no part; null role or text is the empty string; turns stand in order of their
number, null first, those with equal numbers in order of role and text; repeated rows are turns of their own; a
conversation whose rebuilt form has no turns is a member of the root; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, words_count

_FAR = 1 << 60
#: So many bits of ids, 4,096 of them at most, are joined into one string.
_ID_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, digests (hex), words: the turns of each conversation in order."""
    scratch = Scratch(conversations.sparkSession, "turns")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    dated, turn = F.col("turn").isNotNull().alias("dated"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), dated, turn, digest.alias("d"), words_count(text).cast("int").alias("w"), role.alias("role"), text.alias("text"))
    rows = rows.where("conv_id IS NOT NULL")

    def gathered(some: DataFrame, place: Column) -> DataFrame:
        return some.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("dated", "turn", place.alias("place"), "d", "w"))).alias("turns"))

    own = scratch.keep(gathered(rows.drop("role", "text"), F.lit(0)), "own")
    pairs = F.zip_with(F.expr("slice(turns, 1, size(turns) - 1)"), F.expr("slice(turns, 2, size(turns) - 1)"), lambda a, b: (a["dated"] == b["dated"]) & (a["turn"] == b["turn"]) & (a["d"] != b["d"]))
    tied = F.exists(pairs, lambda x: x)
    order = Window.partitionBy("conv_id", "dated", "turn").orderBy("role", "text")
    again = rows.join(own.where(tied).select("conv_id"), "conv_id", "left_semi").withColumn("at", F.row_number().over(order))  # texts only where they decide
    both = own.where(~tied).union(gathered(again, F.col("at")))
    return both.select("conv_id", F.transform("turns", lambda t: t["d"]).alias("digests"), F.transform("turns", lambda t: t["w"]).alias("words"))


def regrafted(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The sequences with their first h turns replaced by those of conversation c - c % every; h = crc32 of the id, modulo `most`."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), *[F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("digests", "words")])
    both = sequences.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left")
    mixed = lambda c, t: F.concat(F.slice(F.coalesce(f"head_{c}", F.array().cast(f"array<{t}>")), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return both.select("conv_id", mixed("digests", "string"), mixed("words", "int"))


def merge_tree(depths: list[int], shared: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """depth, low, high, parent of the nodes of a compact trie; node k is the end of leaf k, the others branch.

    depths: of the sorted leaves; shared: the depth to which each leaf agrees with the next.
    """
    n = len(depths)
    of, top = list(range(n)), list(range(n))
    depth, low, high, parent = [*depths], list(range(n)), list(range(n)), [-1] * n

    def find(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    for e in sorted(range(n - 1), key=lambda k: -shared[k]):
        a, b = find(e), find(e + 1)
        x, y = top[a], top[b]
        if depth[x] > shared[e]:
            parent[x] = len(depth)
            depth.append(shared[e])
            low.append(low[x])
            high.append(high[x])
            parent.append(-1)
            x = parent[x]
        parent[y], high[x] = x, high[y]
        of[b], top[a] = a, x
    return depth, low, high, parent


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 16
    differs = (np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)).reshape(n, 2).any(1)
    return int(differs.argmax()) if differs.any() else n


_NODE = "part int, side int, depth long, conv_id long, parent_conv_id long, parent_side int, n long, children long, leaves long, saved long, seq string"
_EDGE = "first binary, last binary, first_words array<int>"


class Grove:
    """The trie of one range of sorted sequences."""

    def __init__(self) -> None:
        self.first = self.last = b""
        self.depths, self.shared, self.n, self.ids, self.seqs, self.sums = [], [], [], [], [], []

    def add(self, key: bytes, n: int, conv_id: int, words: list[int]) -> None:
        if self.depths:
            self.shared.append(common_turns(self.last, key))
        else:
            self.first, self.first_words = key, words
        self.last = key
        self.depths.append(len(words))
        self.n.append(n)
        self.ids.append(conv_id)
        self.seqs.append(hashlib.sha256(key).hexdigest())
        self.sums.append(np.concatenate([[0], np.cumsum(np.array(words, np.int64))]))

    def nodes(self) -> dict[str, np.ndarray]:
        """The columns of all nodes; `saved` is the subtree's (members here - 1) times words."""
        depth, low, high, parent = merge_tree(self.depths, self.shared)
        ends, size = len(self.depths), len(depth)
        n, least = self.n + [0] * (size - ends), self.ids + [None] * (size - ends)
        leaves, kids, below = [0] * size, [0] * size, [0] * size
        for v in sorted(range(size), key=lambda v: -depth[v]):
            leaves[v] = leaves[v] or 1
            if (p := parent[v]) >= 0:
                sums = self.sums[low[v]]
                below[p] += below[v] + (n[v] - 1) * int(sums[depth[v]] - sums[depth[p]])
                n[p], leaves[p], kids[p] = n[p] + n[v], leaves[p] + leaves[v], kids[p] + 1
                least[p] = least[v] if least[p] is None else min(least[p], least[v])
        depth, low, high, parent, n, least, leaves, kids, below = (np.array(x, np.int64) for x in (depth, low, high, parent, n, least, leaves, kids, below))
        up = np.where(parent >= 0, depth[parent], -1)
        side = (low == 0) + 2 * (high == ends - 1)
        v = np.repeat(np.arange(size), depth - up)  # a row for each node of the chain above v
        at = np.concatenate([np.arange(u + 1, d + 1) for u, d in zip(up.tolist(), depth.tolist())])
        begins = np.concatenate([[0], np.cumsum([len(s) for s in self.sums])])
        sums = np.concatenate(self.sums)
        rest = sums[begins[low[v]] + depth[v]] - sums[begins[low[v]] + np.maximum(at - 1, 0)]
        bottom, above = at == depth[v], at == up[v] + 1
        outer = parent[v]
        return {
            "side": side[v], "depth": at, "conv_id": least[v], "parent_conv_id": np.where(above, least[outer], least[v]), "parent_side": np.where(at == 0, -1, np.where(above, side[outer], side[v])),
            "n": n[v], "children": np.where(bottom, kids[v], 1), "leaves": leaves[v], "saved": below[v] + (n[v] - 1) * rest, "end": np.where(bottom & (v < ends), v, -1),
        }


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grove, part = Grove(), 0
    for batch in batches:
        for part, key, n, conv_id, words in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "n", "conv_id", "words"))):
            grove.add(key, n, conv_id, words)
    if not grove.depths:
        return
    kinds = {"first": pa.binary(), "last": pa.binary(), "first_words": pa.list_(pa.int32())}
    found = grove.nodes()
    for at in range(0, len(found["depth"]), 50_000):
        some = {k: v[at : at + 50_000] for k, v in found.items()}
        rows, root = len(some["depth"]), some["depth"] == 0
        columns = {"part": pa.array([part] * rows, pa.int32())}
        columns |= {k: pa.array(some[k], pa.int32()) for k in ("side", "parent_side")} | {k: pa.array(some[k]) for k in ("depth", "conv_id", "n", "children", "leaves", "saved")}
        columns |= {"parent_conv_id": pa.array(some["parent_conv_id"], mask=root), "seq": pa.array([grove.seqs[e] if e >= 0 else None for e in some["end"].tolist()], pa.string())}
        yield _row(columns | {k: pa.nulls(rows, t) for k, t in kinds.items()})
    blank = {c.split()[0]: pa.nulls(1, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _NODE.split(", ")}
    yield _row(blank | {"part": pa.array([part], pa.int32())} | {k: pa.array([x], kinds[k]) for k, x in zip(kinds, (grove.first, grove.last, grove.first_words))})


def _row(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [c.split()[0] for c in f"{_NODE}, {_EDGE}".split(", ")]
    return pa.record_batch([columns[c] for c in names], names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range shares with the next: its depth, whether the range's last sequence ends there, and the words from each depth on."""
    for batch in batches:
        for part, last, first, words in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "next_first", "next_words"))):
            b = common_turns(last, first)
            tails = np.cumsum(np.array([*words[:b][::-1]], np.int64))[::-1].tolist()
            rows = [[part], [b], [b == len(last) // 16], [[*tails[:1], *tails] or [0]]]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64())))], ["part", "b", "ended", "tails"])


def _digests(ids: DataFrame) -> DataFrame:
    """seq, ends_sha256: the digest of the ascending ids of each distinct sequence (seq, conv_id)."""
    joined = ids.groupBy("seq", F.shiftright("conv_id", _ID_BITS).alias("bucket")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for s, some in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
                if s != seq:
                    if seq is not None:
                        done.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256(some.encode())
                else:
                    digest.update(b"," + some.encode())
            yield pa.record_batch([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["seq", "ends_sha256"])
        if seq is not None:
            yield pa.record_batch([pa.array([x]) for x in (seq, digest.hexdigest())], ["seq", "ends_sha256"])

    return joined.repartition("seq").sortWithinPartitions("seq", "bucket").mapInArrow(hashed, "seq string, ends_sha256 string")


def prefix_trie(sequences: DataFrame, turns_per_part: int = 200_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    `sequences` (conv_id, digests, words; one row for a conv_id)."""
    scratch = Scratch(sequences.sparkSession, "trie")
    keyed = sequences.select("conv_id", F.unhex(F.array_join("digests", "")).alias("key"), "words")
    named = scratch.keep(keyed.withColumn("seq", F.sha2("key", 256)), "named")
    distinct = scratch.keep(named.groupBy("key", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "distinct")
    turns = distinct.agg(F.sum(F.size("words") + 1).alias("n")).first()["n"] or 0
    ranged = distinct.repartitionByRange(max(1, -(-turns // turns_per_part)), "key").sortWithinPartitions("key")
    grown = scratch.keep(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_planted, f"{_NODE}, {_EDGE}"), "grown")

    # The edges between neighbouring ranges: a row for each range, of which the driver sees two numbers.
    heads = grown.where("first IS NOT NULL").select("part", "first", "last", "first_words")
    after = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("next_part"))  # numbers of ranges only
    ahead = heads.select(F.col("part").alias("next_part"), F.col("first").alias("next_first"), F.col("first_words").alias("next_words"))
    edges = scratch.keep(heads.select("part", "last").join(after.where("next_part IS NOT NULL"), "part").join(ahead, "next_part").mapInArrow(_edges, "part int, b long, ended boolean, tails array<long>"), "edges")
    shares = {r["part"]: r["b"] for r in edges.select("part", "b").collect()}
    parts = sorted(r["part"] for r in heads.select("part").collect())
    number, right = {p: k for k, p in enumerate(parts)}, [shares[p] for p in parts[:-1]]
    depth, low, _, parent = merge_tree([_FAR] * len(parts), right)

    @F.pandas_udf("int")
    def begins(part: pd.Series, side: pd.Series, at: pd.Series) -> pd.Series:
        """The range where a node of a range's first (side 1) or last path (side 2) begins; -1 if no other range has it."""
        found, known = [], {}
        for asked in zip(part, side, at):
            if asked not in known:
                p, s, d = asked
                k = number[p]
                if (s & 1 and k and right[k - 1] >= d) or (s & 2 and k < len(right) and right[k] >= d):
                    while parent[k] >= 0 and depth[parent[k]] >= d:
                        k = parent[k]
                    known[asked] = parts[low[k]]
                else:
                    known[asked] = -1
            found.append(known[asked])
        return pd.Series(found, dtype="int32")

    nodes = grown.where("conv_id IS NOT NULL").drop("first", "last", "first_words")
    spine = scratch.keep(nodes.where("side > 0").withColumn("begin", begins("part", "side", "depth")), "spine")
    sums = ["n", "children", "leaves", "saved"]
    some = spine.where("begin >= 0").select("begin", "depth", "conv_id", *sums, "seq")
    twice = edges.select("part", "b", "ended", F.posexplode("tails").alias("depth", "tail")).withColumn("depth", F.col("depth").cast("long"))
    twice = twice.select(
        begins("part", F.lit(2), "depth").alias("begin"), "depth", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n"), (-(F.col("depth") < F.col("b")).cast("long")).alias("children"),
        (-F.col("ended").cast("long")).alias("leaves"), F.col("tail").alias("saved"), F.lit(None).cast("string").alias("seq"),
    )
    shared = scratch.keep(some.union(twice).groupBy("begin", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("seq").alias("seq")), "shared")

    # Parents: within a range by its own paths, between shared nodes by where the parent begins.
    named_shared = spine.where("begin >= 0").select("part", "side", "depth", "begin").join(shared.select("begin", "depth", "conv_id"), ["begin", "depth"]).select("part", "side", "depth", "conv_id")
    paths = named_shared.union(spine.where("begin < 0").select("part", "side", "depth", "conv_id")).select("part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    own = nodes.where("side = 0").union(spine.where("begin < 0").drop("begin"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "seq"]
    below = own.where("parent_side > 0").join(paths, ["part", "parent_side", "depth"]).withColumn("parent_conv_id", F.col("above")).select(columns)
    outer = shared.withColumn("outer", F.when(F.col("depth") > 0, begins("begin", F.lit(3), F.col("depth") - 1)))
    above = shared.select(F.col("begin").alias("outer"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    found = own.where("parent_side <= 0").select(columns).union(below).union(outer.join(above, ["outer", "depth"], "left").select(columns))

    ends = _digests(named.select("seq", "conv_id"))
    out = lambda df, digest: df.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest)
    return out(found.where("seq IS NOT NULL").join(ends, "seq"), F.col("ends_sha256")).union(out(found.where("seq IS NULL"), F.lit(EMPTY).alias("ends_sha256")))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r // 2, 3988292384::BIGINT * (r % 2))))"
SQL = rf"""WITH own AS (
  SELECT conv_id, xor({_CRC}, 4294967295::BIGINT) % 4 AS h, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
hashed AS (
  SELECT conv_id, depth, len(turns) AS n, sha256(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS node, CASE WHEN depth > 0 THEN sha256(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) END AS up,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM prefixes
), nodes AS (
  SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM hashed GROUP BY node
), families AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.up = n.node) AS n_children FROM nodes n),
lines AS (SELECT h.node AS top, f.node, f.n_children, f.saved FROM families f JOIN hashed h ON h.conv_id = f.conv_id AND h.depth <= f.depth),
subtrees AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM lines GROUP BY top)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM families f LEFT JOIN nodes p ON p.node = f.up JOIN subtrees s ON s.top = f.node"""
