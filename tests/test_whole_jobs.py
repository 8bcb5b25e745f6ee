"""Jobs that once left rows out: every pair of files, every event."""

import hashlib
import json

from pyspark.sql import functions as F

from test_delta import expected_ops
from twinlake import fixtures as fx
from twinlake import queries as core
from twinlake.operators import delta, planning
from twinlake.plans import mirror

DATA = "/root/testdata/sf0.001"
BLOCK = 700


def _pairs(spark):
    src, dst = ({r.path: r for r in side(spark, DATA).collect()} for side in (fx.source, fx.destination))
    both = [p for p in src if p in dst and src[p].kind == dst[p].kind == "file"]
    return {p: (dst[p].text.encode(), src[p].text.encode()) for p in both}


def test_delta_queries_take_every_pair_of_files(spark):
    pairs = _pairs(spark)
    plan = planning.transfer_plan(fx.source(spark, DATA).drop("text"), fx.destination(spark, DATA).drop("text"), checksum=True)
    assert {r.path for r in plan.where("transfer = 'delta'").collect()} == set(pairs)
    turned = [p for p, (old, new) in pairs.items() if old != new and len(old) == len(new)]
    assert turned
    want = {p: [(op, x if op == "copy" else len(x)) for op, x in expected_ops(old, new, BLOCK)] for p, (old, new) in pairs.items()}
    got = {}
    for r in core.QUERIES["dlt6_ops"](spark, DATA).orderBy("path", "op_seq").collect():
        got.setdefault(r.path, []).append((r.op, r.block_idx if r.op == "copy" else r.n))
    assert got == {p: ops for p, ops in want.items() if ops}
    stats = {r.path: (r.copies, r.literals, r.literal_bytes) for r in core.QUERIES["dlt9_stats"](spark, DATA).collect()}
    assert stats == {p: (sum(o == "copy" for o, _ in ops), sum(o == "literal" for o, _ in ops), sum(n for o, n in ops if o == "literal")) for p, ops in want.items() if ops}
    matches = set()
    for p, (old, new) in pairs.items():
        first = {}
        for k in range(len(old) // BLOCK):
            first.setdefault(old[k * BLOCK : (k + 1) * BLOCK], k)
        matches |= {(p, k, first[new[k : k + BLOCK]]) for k in range(len(new) - BLOCK + 1) if new[k : k + BLOCK] in first}
    assert {(r.path, r.pos, r.block_idx) for r in core.QUERIES["dlt3_matches"](spark, DATA).collect()} == matches
    chosen, ends = set(), {}
    for p, k, b in sorted(matches):
        if k >= ends.get(p, 0):
            chosen.add((p, k, b))
            ends[p] = k + BLOCK
    assert {(r.path, r.pos, r.block_idx) for r in core.QUERIES["dlt4_selected"](spark, DATA).collect()} == chosen
    tails = {r.path for r in core.QUERIES["dlt5_tails"](spark, DATA).collect()}
    ends = {p: expected_ops(new, b"12345" + new, BLOCK)[-1] for p, (_, new) in pairs.items()}
    assert tails == {p for p, (op, x) in ends.items() if op == "copy" and len(pairs[p][1]) - x * BLOCK < BLOCK}


def test_delta_operators_on_every_pair_of_files(spark):
    pairs = _pairs(spark)
    old, new = fx.contents(spark, DATA)
    assert {r.path: r["count"] for r in delta.signature(old).groupBy("path").count().collect()} == {p: -(-len(o) // BLOCK) for p, (o, _) in pairs.items() if o}
    assert {r.path: r["count"] for r in delta.windows(new).groupBy("path").count().collect()} == {p: len(n) - BLOCK + 1 for p, (_, n) in pairs.items() if len(n) >= BLOCK}
    rebuilt = delta.apply_delta(old, delta.encode(old, new)).select("path", F.sha2("content", 256).alias("h"))
    assert {r.path: r.h for r in rebuilt.collect()} == {p: hashlib.sha256(n).hexdigest() for p, (_, n) in pairs.items()}


def test_reports_hold_every_event_of_every_run(spark):
    many = spark.range(24_000).select(
        F.when(F.col("id") < 12_000, "early").otherwise("late").alias("run_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 50 == 0, "phase").otherwise("error").alias("event"), F.when(F.col("id") % 50 == 0, "copying").alias("phase"), F.concat(F.lit("p"), "id").alias("path"), F.lit(None).cast("string").alias("action"), F.lit(1).alias("bytes"),
    )
    quiet = many.limit(1).withColumns({"run_id": F.lit("quiet"), "event": F.lit("done"), "phase": F.lit(None).cast("string"), "action": F.lit("copy")})
    none = spark.createDataFrame([], "path string, detail string")
    rows = mirror.run_report(many.union(quiet), none).collect()
    heads = {r.run_id: json.loads(r.report) for r in rows if r.part is None}
    seqs = {run: sorted(e["seq"] for r in rows if r.run_id == run and r.part is not None for e in json.loads(r.report)["events"]) for run in heads}
    assert seqs == {"early": list(range(12_000)), "late": list(range(12_000, 24_000)), "quiet": []}
    assert all(len(json.loads(r.report)["events"]) <= 10_000 for r in rows if r.part is not None)
    assert {run: (h["status"], h["n_events"], h["event_parts"]) for run, h in heads.items()} == {"early": ("failed", 12_000, 2), "late": ("failed", 12_000, 2), "quiet": ("success", 0, 0)}
