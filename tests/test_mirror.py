import hashlib
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from twinlake import fixtures as fx
from twinlake.operators import blocks, compare, index, planning
from twinlake.plans import incremental, mirror
from twinlake.plans.options import Options
from twinlake.schemas import ENTRIES, INDEX_VERSION
from twinlake.sources import buckets, snapshots
from twinlake.streaming import watch

DATA = "/root/testdata/sf0.001"
ALL = Options(delete=True, yes=True, checksum=True, tolerance_s=1, preserve=frozenset({"mode", "mtime", "owner", "group"}))


@pytest.fixture(scope="module")
def sides(spark):
    return fx.source(spark, DATA).drop("text").cache(), fx.destination(spark, DATA).drop("text").cache()


def test_after_a_mirror_nothing_is_left_to_do(sides):
    src, dst = sides
    after = mirror.mirror(src, dst, ALL)[1].cache()
    assert {r.action for r in planning.mirror_plan(src, after).select("action").distinct().collect()} == {"skip"}
    assert compare.verify(src, after, "all", tolerance_s=1, owner=True, group=True).isEmpty()
    again = mirror.mirror(src, after, ALL)[1]
    assert again.exceptAll(after).isEmpty() and after.exceptAll(again).isEmpty()


def test_filters_protect_excluded_rows(sides):
    src, dst = sides
    opts = Options(delete=True, yes=True, rules=("- stale",))
    plan = mirror.mirror(src, dst, opts)[0]
    assert plan.where("path LIKE 'stale/%'").isEmpty()


def test_gates(spark, sides):
    src, dst = sides
    with pytest.raises(mirror.DeletesNotApprovedError):
        mirror.mirror(src, dst, Options(delete=True))
    with pytest.raises(planning.EmptySourceError):
        mirror.mirror(src.limit(0), dst, ALL)
    assert mirror.mirror(src, dst, Options(dry_run=True))[1].count() == dst.count()


def test_kind_change_and_nulls(spark):
    row = lambda path, kind, n, target=None, h=None: (path, kind, n, 5, 0, 0o644, 1, 1, 1, 1, target, h)
    src = spark.createDataFrame([row("a", "dir", 0), row("b", "file", 3, h="x"), row("c", "symlink", 0, "t"), row("d", "file", 1)], ENTRIES)
    dst = spark.createDataFrame([row("a", "file", 0), row("b", "file", 3), row("c", "symlink", 0, "u"), row("d", "file", 1)], ENTRIES)
    quick = {r.path: r.action for r in planning.build_plan(src, dst).collect()}
    assert quick == {"a": "update", "b": "skip", "c": "update", "d": "skip"}
    full = {r.path: r.action for r in planning.build_plan(src, dst, checksum=True).collect()}
    assert full == {"a": "update", "b": "update", "c": "update", "d": "update"}


def test_publish_sync_and_index(spark, sides, tmp_path):
    src, dst = sides
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    snapshots.publish(src, a)
    snapshots.publish(dst, b)
    run = mirror.sync(spark, a, b, replace(ALL, verify="all"))
    assert (run.status, run.mismatches, run.errors, run.persist_index) == ("success", 0, 0, True)
    assert mirror.sync(spark, a, f"file://{tmp_path}/new", Options(verify="changed")).stats["copies"] == src.count()
    home = f"file://{tmp_path}/index"
    assert index.try_load_index(spark, home) is None
    index.save_index(index.build_index(planning.build_plan(src, dst)), home)
    assert index.try_load_index(spark, home).count() == src.count()
    index.save_index(src.withColumn("version", F.lit(INDEX_VERSION - 1)), home)
    assert index.try_load_index(spark, home) is None


def _entry(path, n, mtime=5):
    return path, "file", n, mtime, 0, 0o644, 1, 1, 1, 1, None, None


def test_journal_appends_then_compaction_then_load(spark, tmp_path):
    home = f"file://{tmp_path}/j"
    index.save_index(index.build_index(spark.createDataFrame([_entry("a", 1), _entry("b", 1)], ENTRIES)), home)
    change = lambda op, *rows: index.as_records(spark.createDataFrame(rows, ENTRIES)).select("path", F.lit(op).alias("op"), "record")
    index.append_journal(change("upsert", _entry("a", 0)).limit(0), home)
    assert snapshots.stored_bytes(spark, f"{home}/journal") == 0
    for n in (2, 3, 4):
        index.append_journal(change("upsert", _entry("a", n), _entry(f"new{n}", n)), home)
    index.append_journal(change("delete", _entry("new3", 0)), home)
    seqs = [r.seq for r in index.read_journal(spark, home).collect()]
    assert len(set(seqs)) == len(seqs) == 7
    want = {("a", 4), ("b", 1), ("new2", 2), ("new4", 4)}
    load = lambda: {(r.path, r.len) for r in index.try_load_index(spark, home).collect()}
    assert load() == want and index.needs_compaction(spark, home)
    schema = index.try_load_index(spark, home).schema
    index.compact(spark, home)
    assert load() == want and not index.needs_compaction(spark, home) and index.try_load_index(spark, home).schema == schema
    index.append_journal(change("upsert", _entry("b", 9)), home)
    assert load() == want - {("b", 1)} | {("b", 9)}
    index.compact(spark, home)
    assert load() == want - {("b", 1)} | {("b", 9)}


def test_replay_stops_at_a_broken_record(spark, tmp_path):
    home = f"file://{tmp_path}/broken"
    index.save_index(index.build_index(spark.createDataFrame([_entry("a", 1)], ENTRIES)), home)
    for n in (2, 3, 4):
        rows = index.sealed(index.as_records(spark.createDataFrame([_entry("a", n)], ENTRIES)).select("path", F.lit("upsert").alias("op"), "record"), n)
        rows.withColumn("checksum", F.when(F.lit(n == 3), "torn").otherwise(F.col("checksum"))).write.mode("append").parquet(f"{home}/journal")
    assert [r.len for r in index.try_load_index(spark, home).collect()] == [2]


def test_sync_keeps_the_index_up_to_date(spark, sides, tmp_path):
    src, dst = sides
    a, b, home = (f"file://{tmp_path}/{x}" for x in ("a", "b", "i"))
    state = lambda df: {(r.path, r.kind, r.len, r.mtime_ns, r.mode & 0o777) for r in df.collect()}
    for step, source in enumerate((dst, src)):
        snapshots.publish(source, a)
        run = mirror.sync(spark, a, b, ALL, index_dir=home)
        assert run.status == "success" and run.persist_index, step
        assert state(index.try_load_index(spark, home)) == state(source) == state(snapshots.read_published(spark, b)), step
    assert mirror.sync(spark, a, b, ALL, index_dir=home).stats["skips"] == src.count()
    failed = mirror.finish(planning.mirror_plan(src, dst), spark.createDataFrame([("p", "x")], "path string, detail string"), src.limit(0), ALL)
    assert failed.status == "failed" and not failed.persist_index


def test_publish_keeps_versions_for_their_time(spark, tmp_path):
    at, folder = f"file://{tmp_path}/p", tmp_path / "p"
    for n in range(3):
        snapshots.publish(spark.range(n + 1), at)
    assert [c["number"] for c in snapshots.commits(spark, at)] == [3, 2, 1]
    assert [snapshots.read_published(spark, at, n).count() for n in (1, 2, 3)] == [1, 2, 3] and snapshots.read_published(spark, at).count() == 3
    (folder / "v-unfinished").mkdir()  # another writer's
    snapshots.publish(spark.range(4), at)
    assert (folder / "v-unfinished").exists() and len(list(folder.glob("v-*"))) == 5
    time.sleep(1.1)
    snapshots.publish(spark.range(5), at, retain_s=1)
    assert [c["number"] for c in snapshots.commits(spark, at)] == [5, 4] and len(list(folder.glob("v-*"))) == 2  # the one just replaced stays
    with pytest.raises(FileNotFoundError):
        snapshots.read_published(spark, at, 1)
    (folder / "log" / f"{6:020d}.json").write_text("")  # a writer that died
    assert snapshots.read_published(spark, at).count() == 5
    snapshots.publish(spark.range(6), at)
    assert snapshots.current_commit(spark, at)["number"] == 7 and snapshots.read_published(spark, at).count() == 6


def test_two_writers_lose_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: snapshots.publish(spark.range(n + 1), at), range(6)))
    assert {c["version"] for c in snapshots.commits(spark, at)} == set(versions) and [c["number"] for c in snapshots.commits(spark, at)] == [6, 5, 4, 3, 2, 1]
    with pytest.raises(snapshots.ConflictError):
        snapshots.publish(spark.range(9), at, based_on=5)
    assert len(list((tmp_path / "p").glob("v-*"))) == 6

    def add(k):
        """Adds a row to what stands there, however often others do the same."""
        while True:
            known = snapshots.current_commit(spark, f"{at}2")
            try:
                return snapshots.publish(snapshots.read_published(spark, f"{at}2", known["number"]).union(spark.range(k, k + 1)), f"{at}2", based_on=known["number"])
            except snapshots.ConflictError:
                continue

    snapshots.publish(spark.range(0), f"{at}2")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(add, range(5)))
    assert sorted(r.id for r in snapshots.read_published(spark, f"{at}2").collect()) == [0, 1, 2, 3, 4]


def test_sync_plans_again_after_a_conflict(spark, sides, tmp_path, monkeypatch):
    src, dst = sides
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    snapshots.publish(src, a)
    snapshots.publish(dst, b)
    calls = []

    def late(df, target, **options):
        if not calls:
            calls.append(snapshots.publish(dst.limit(1), target))  # another writer is first
        return snapshots.publish(df, target, **options)

    monkeypatch.setattr(mirror, "publish", late)
    run = mirror.sync(spark, a, b, ALL)
    assert run.status == "success" and [c["number"] for c in snapshots.commits(spark, b)] == [3, 2, 1]
    assert run.stats["copies"] >= src.count() - 1


def test_a_damaged_index_is_a_full_plan(spark, sides, tmp_path):
    src, dst = sides
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    snapshots.publish(dst, a)
    for how in ("bytes", "values", "missing", "journal"):
        home = tmp_path / how
        snapshots.publish(dst, f"{b}{how}")
        assert mirror.sync(spark, a, f"{b}{how}", ALL, index_dir=f"file://{home}").status == "success"
        assert index.try_load_index(spark, f"file://{home}") is not None
        part = max((home / "snapshot").glob("v-*/part-*.parquet"), key=lambda p: p.stat().st_size)
        if how == "bytes":
            raw = bytearray(part.read_bytes())
            raw[len(raw) // 3 : len(raw) // 3 + 64] = bytes(64)
            part.write_bytes(raw)
        elif how == "values":
            one = spark.read.parquet(f"file://{part}").toPandas()
            one["len"] = one["len"] + 1
            one.to_parquet(part)
        elif how == "missing":
            part.unlink()
        else:
            (home / "journal").mkdir()
            (home / "journal" / "part-0.parquet").write_bytes(b"PAR1 torn PAR1")
        for crc in (home / "snapshot").glob("v-*/.*.crc"):
            crc.unlink()
        assert index.try_load_index(spark, f"file://{home}") is None, how
        run = mirror.sync(spark, a, f"{b}{how}", ALL, index_dir=f"file://{home}")
        assert run.status == "success" and run.stats["skips"] == dst.count(), how


def test_a_small_change_rewrites_its_buckets_only(spark, tmp_path):
    at, n = f"file://{tmp_path}/b", 2000
    rows = [_entry(f"d{k % 7}/f{k}", 1) for k in range(n)]
    old = spark.createDataFrame(rows, ENTRIES)
    assert buckets.publish_buckets(old, at, 32) == 1
    new = spark.createDataFrame([_entry(f"d{k % 7}/f{k}", 2 if k in (10, 20) else 1) for k in range(n) if k != 30], ENTRIES)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "b").glob("v-*/bucket=*/*.parquet")}
    before = {p for p in (tmp_path / "b").rglob("*.parquet")}
    touched = buckets.apply_changes(planning.mirror_plan(old, new).limit(0), at, ALL)
    assert touched == [] and files()
    touched = buckets.apply_changes(planning.mirror_plan(new, old), at, ALL)
    written = {p.parent.name for p in (tmp_path / "b").rglob("*.parquet") if p not in before}
    assert len(touched) <= 3 and written == {f"bucket={b}" for b in touched} and buckets.changed_buckets(spark, at, 1, 2) == touched
    state = lambda df: sorted((r.path, r.len) for r in df.collect())
    assert state(buckets.read_buckets(spark, at)) == state(new)
    # Retention keeps folders that the newest version shares with older ones.
    time.sleep(1.1)
    snapshots._expire(spark, at, 0)
    assert [c["number"] for c in snapshots.commits(spark, at)] == [2] and state(buckets.read_buckets(spark, at)) == state(new)
    # Another writer in between: the changes go to what stands there then.
    only = spark.createDataFrame([_entry("d0/f0", 9)], ENTRIES)
    real, calls = buckets.commit, []

    def late(*a, **k):
        if not calls:
            calls.append(1)
            buckets.apply_changes(planning.mirror_plan(spark.createDataFrame([_entry("d1/f1", 8)], ENTRIES), new, delete=False), at, ALL)
        return real(*a, **k)

    buckets.commit = late
    try:
        buckets.apply_changes(planning.mirror_plan(only, new, delete=False), at, ALL)
    finally:
        buckets.commit = real
    found = dict(state(buckets.read_buckets(spark, at)))
    assert found["d0/f0"] == 9 and found["d1/f1"] == 8 and len(found) == n - 1


def test_a_cycle_reads_its_buckets_only(spark, tmp_path):
    a, b, n = f"file://{tmp_path}/a", f"file://{tmp_path}/b", 400
    rows = spark.createDataFrame([_entry(f"f{k}", 1) for k in range(n)], ENTRIES)
    for at in (a, b):
        buckets.publish_buckets(rows, at, 16)
    change = spark.createDataFrame([_entry("f7", 9), _entry("new", 1)], ENTRIES)
    gone = spark.createDataFrame([_entry("f8", 1)], ENTRIES)
    buckets.apply_changes(planning.mirror_plan(change, rows.where("path IN ('f7')"), delete=False).union(planning.mirror_plan(gone.limit(0), gone)), a, ALL)
    touched = {r.b for r in spark.createDataFrame([("f7",), ("f8",), ("new",)], "path string").select(buckets.bucket_of("path", 16).alias("b")).collect()}
    for at in ("a", "b"):  # what no change falls into cannot be read
        for p in (tmp_path / at).glob("v-*/bucket=*/*.parquet"):
            if int(p.parent.name.removeprefix("bucket=")) not in touched:
                p.rename(p.with_suffix(".away"))
    changes = f"{tmp_path}/changes"
    spark.createDataFrame([("f7",), ("f8",), ("new",), (".twinlake/x",)], "path string").write.parquet(changes)
    incremental.follow(watch.changes_stream(spark, changes, "path string"), a, b, ALL, f"{tmp_path}/c").awaitTermination(120)
    for p in tmp_path.glob("[ab]/v-*/bucket=*/*.away"):
        p.rename(p.with_suffix(".parquet"))
    state = lambda at: sorted((r.path, r.len) for r in buckets.read_buckets(spark, at).collect())
    assert state(a) == state(b) and dict(state(b))["f7"] == 9 and "f8" not in dict(state(b)) and len(state(b)) == n
    with pytest.raises(mirror.DeletesNotApprovedError):
        incremental.sync_paths(spark, b, a, spark.createDataFrame([("f7",)], "path string"), replace(ALL, yes=False)) if buckets.apply_changes(planning.mirror_plan(change.limit(0), change.where("path = 'f7'")), b, ALL) else None


def test_continuous_mirror(spark, sides, tmp_path):
    src, dst = sides
    a, b, changes = (f"file://{tmp_path}/{x}" for x in ("a", "b", "changes"))
    snapshots.publish(dst, a)
    spark.createDataFrame([(".twinlake/journal",)], "path string").write.mode("append").parquet(changes)
    stream = watch.changes_stream(spark, changes, "path string")
    mirror.mirror_on_changes(stream, a, b, ALL, f"{tmp_path}/c").awaitTermination(120)
    assert compare.verify(dst, snapshots.read_published(spark, b), "all").isEmpty()
    snapshots.publish(src, a)
    spark.createDataFrame([("src1/en/1.txt",)], "path string").write.mode("append").parquet(changes)
    watch_again = watch.watch(watch.relevant_paths(stream), lambda batch, n: mirror.sync(spark, a, b, ALL), f"{tmp_path}/c")
    watch_again.awaitTermination(120)
    assert compare.verify(src, snapshots.read_published(spark, b), "all", tolerance_s=1).isEmpty()
    with pytest.raises(ValueError):
        mirror.mirror_on_changes(stream, a, b, Options(dry_run=True), f"{tmp_path}/d")


def test_requested_paths_and_dry_run(spark, sides):
    src, dst = sides
    some = src.limit(3).select("path").union(spark.createDataFrame([("no/such",)], "path string"))
    found, missing = planning.requested(src, some)
    assert found.count() == 3 and [(r.path, r.error) for r in missing.collect()] == [("no/such", "not found at the source")]
    stats, events = mirror.dry_run(src, dst, Options(delete=True, yes=True))
    s = stats.first()
    assert events.count() == s.copied + s.updated + s.skipped + s.deleted and s.deleted == events.where("event = 'deleted'").count()


def test_keys_with_slashes_and_nulls_stay_apart(spark):
    rows = spark.createDataFrame([("a/b", "c", 1), ("a", "b/c", 2), (None, "c", 3), ("%N", "c", 4), ("", "c", 5)], "k string, l string, v int")
    assert len({r.path for r in snapshots.entries_from_table(rows, ["k", "l"], ["v"]).collect()}) == 5


def test_scan_and_path_list(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/x.txt").write_text("hello")
    (tmp_path / "y.bin").write_bytes(b"1")
    found = {r.path: (r.len, r.hash) for r in snapshots.scan_files(spark, f"file://{tmp_path}", with_hash=True).collect()}
    assert set(found) == {"d/e/x.txt", "y.bin"} and found["d/e/x.txt"][0] == 5 and found["d/e/x.txt"][1].startswith("2cf24dba")
    (tmp_path / "list").write_text("# no\n\n  a/b \n#x\n #kept\n")
    assert [r.path for r in snapshots.read_path_list(spark, f"file://{tmp_path}/list").collect()] == ["a/b", "#kept"]
    with pytest.raises(snapshots.TooManyPathsError):
        snapshots.read_path_list(spark, f"file://{tmp_path}/list", 3)


def test_files_of_any_length_are_hashed_in_stretches(spark, tmp_path, monkeypatch):
    with open(tmp_path / "above 2 GB%20.bin", "wb") as f:
        f.truncate((1 << 31) + 5)  # takes no room
    for n in (100, 101, 128, 129, 256, 257, 1000):
        (tmp_path / f"{n}.bin").write_bytes(bytes(k * 7 % 251 for k in range(n)))
    want = {}
    for file in tmp_path.iterdir():
        with open(file, "rb") as f:
            want[file.name] = (file.stat().st_size, hashlib.file_digest(f, "sha256").hexdigest())
    assert {r.path: (r.len, r.hash) for r in snapshots.scan_files(spark, f"file://{tmp_path}", with_hash=True).collect()} == want
    monkeypatch.setattr(snapshots, "WHOLE", 100)
    monkeypatch.setattr(snapshots, "STRETCH", 128)
    assert {r.path: (r.len, r.hash) for r in snapshots.scan_files(spark, str(tmp_path), "[0-9]*", with_hash=True).collect()} == {p: x for p, x in want.items() if p[0] != "a"}


def test_watch_mirrors_each_burst_and_survives_failures(spark, tmp_path):
    changes, seen = f"{tmp_path}/changes", []
    for k in range(3):
        spark.createDataFrame([(f"p{k}", k)], "path string, seq long").coalesce(1).write.mode("append").parquet(changes)

    def cycle(batch, batch_id):
        if batch_id == 1:
            raise RuntimeError("no luck")
        seen.extend(r.path for r in batch.collect())

    stream = watch.changes_stream(spark, changes, "path string, seq long", max_files=1)
    watch.watch(stream, cycle, f"{tmp_path}/check", errors=f"{tmp_path}/errors").awaitTermination(120)
    assert len(seen) == 2 and spark.read.parquet(f"{tmp_path}/errors").first().message == "no luck"


def test_streaming_state_equals_batches(spark, tmp_path):
    events = fx.run_events(spark, DATA)
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    watch.live_run_state(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination(120)
    assert spark.table("live").exceptAll(watch.live_run_state(events)).isEmpty()


def test_session_forms_agree(spark):
    events = fx.table(spark, DATA, "events")
    a = watch.debounce_session(events, "user_id", "30 minutes").select("user_id", F.unix_micros("start").alias("t"))
    b = watch.session_starts(events, "user_id", 1_800_000).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("t"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def bursts_of(rows, window):
    """{(key, start): events} by going through each key's times."""
    found, open_at = {}, {}
    for k, t in sorted(((k, t) for k, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k not in open_at or t >= open_at[k] + window:
            open_at[k] = t
        found[k, open_at[k]] = found.get((k, open_at[k]), 0) + 1
    return found


@pytest.mark.parametrize("fan", [3, 64])
def test_anchored_bursts_by_definition(spark, monkeypatch, fan):
    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(watch, "STRETCH", 2 if fan == 3 else 16)
    rng = random.Random(fan)
    rows = [(k, int(rng.choice([1, 1, 5, 90]) * rng.random() * 5e4) + rng.choice([0, 0, -70000, 900000])) for k in (0, 1, 2, None) for _ in range(400)]
    rows += [(3, t) for t in range(0, 60000, 7)] + [(4, 5)] * 3 + [(5, None)]
    df = spark.createDataFrame(rows, "k int, t long").select("k", F.timestamp_micros("t").alias("ts"))
    got = {(r.k, r.t): r.events for r in watch.debounce_anchored(df.repartition(3), "k", 1).select("k", F.unix_micros("start").alias("t"), "events").collect()}
    assert got == bursts_of(rows, 1000)


def test_a_hot_key_without_rest(spark):
    """A million events of one key, each within the window of the one before."""
    n, step, window = 1_000_000, 700, 1_000_000
    events = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * step).alias("ts"))
    got = watch.debounce_anchored(events, "k", window // 1000).select(F.unix_micros("start").alias("t"), "events").orderBy("t").collect()
    each = -(-window // step)
    assert [(r.t, r.events) for r in got] == [(k * each * step, min(each, n - k * each)) for k in range(-(-n // each))]


def test_anchored_bursts_as_a_stream(spark, tmp_path):
    """Shuffled micro-batches, within the watermark's delay, give what the batch gives."""
    events = fx.table(spark, DATA, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).toPandas().sort_values("ts")
    rng = random.Random(5)
    order = sorted(range(len(events)), key=lambda k: k + rng.randint(0, len(events) // 20))
    parts = [order[k : k + len(order) // 4 + 1] for k in range(0, len(order), len(order) // 4 + 1)]
    for k, part in enumerate(parts):
        spark.createDataFrame(events.iloc[part]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        time.sleep(0.05)
    far = events["ts"].max().to_pydatetime() + timedelta(days=400)
    for k in range(2):
        spark.createDataFrame([(-1, far + timedelta(days=k))], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        time.sleep(0.05)
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b")
    span = events["ts"].max() - events["ts"].min()
    watch.stream_bursts(stream, "user_id", 1_800_000, f"{int(span.total_seconds())} seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/s").start().awaitTermination(240)
    got = {(int(r.key), r.start): r.events for r in spark.table("bursts").where("key != '-1'").collect()}
    want = watch.debounce_anchored(fx.table(spark, DATA, "events"), "user_id", 1_800_000).select("user_id", F.unix_micros("start").alias("t"), "events").collect()
    assert got == {(r.user_id, r.t): r.events for r in want}


def test_short_chains_of_stretches_need_no_function(spark, monkeypatch):
    """Only keys that rest in no stretch for long are composed from functions."""
    asked, entries = [], blocks.entries
    monkeypatch.setattr(blocks, "entries", lambda level: asked.append(level.count()) or entries(level))
    rows = [(k, k * 1000 + t) for k in range(50) for t in (0, 5, 900, 17000, 90000)] + [(99, t) for t in range(0, 70 * 16000, 500)]
    df = spark.createDataFrame(rows, "k int, t long").select("k", F.timestamp_micros("t").alias("ts"))
    got = {(r.k, r.t): r.events for r in watch.debounce_anchored(df, "k", 1).select("k", F.unix_micros("start").alias("t"), "events").collect()}
    assert got == bursts_of(rows, 1000)
    assert asked == [70]


def test_changes_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """The plan that tells the changed paths is joined by all tasks, not by the one that would write a single file."""
    from twinlake.queries import QUERIES

    monkeypatch.setattr(snapshots, "shared_dir", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        QUERIES["str1_mirror"](spark, DATA)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("follow-*/changes/*.parquet"))) > 2
