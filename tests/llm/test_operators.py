"""The operators on Spark against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.llm import ann, media, mixing, near_dup, packing, pii, registry, sharding, token_counts, tokens, toxicity, training_order

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named as the operators' own.
CLASH = ("key", "size", "shard", "bucket", "ids", "set_key", "n_shingles", "media", "row", "k", "target")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, "a b c d e f g"), (2, "A b C d e f g"), (2, "A b C d e f g"), (3, ""), (4, None), (5, " \t\n"), (6, "one two"), (7, "One  two"), (8, long), (9, long + " tail"), (None, "x y z a b c"), (None, None), (10, "p q r s t u v")]
    df = spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None) for k, (i, t) in enumerate(rows)], SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def _sets(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join(base[:k] + ["zz"] + base[k + 1 :]) for k in (2, 3, 20, 21, 40, 41)] + [" ".join(base), " ".join(base + ["end"])]
    extra = spark.createDataFrame([(100_000 + k, t, "en", "s", 1) for k, t in enumerate(chain)], SCHEMA)
    docs = docs.union(extra)
    sets = _sets([(r.doc_id, r.text) for r in docs.collect()])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, block=2).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
    kept = {r.doc_id for r in near_dup.deduplicate(docs, percent=85).collect()}
    assert kept == {i for i in ids if find(i) == i}


def test_near_duplicates_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect()), key=str)
    by = collections.defaultdict(list)
    for i, n, c, k in got:
        by[i].append((n, c, k))
    assert by[1] == [(3, 1, True)] and by[2] == [(3, 1, False)] * 2 and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[7] == [(1, 6, False)] and by[9][0][1] == 8 and sorted(by[None]) == [(0, None, True), (2, None, True)]
    assert near_dup.near_duplicates(none).count() == 0


def test_deduplicate_decides_by_row(spark, odd, none):
    copy, other = "a b c d e f g h", "another text that is like no other one here"
    rows = [(None, copy), (None, copy), (5, copy), (5, copy), (5, other), (7, copy.upper()), (None, other + " x y z"), (8, ""), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumn("row_key", F.lit("clash")).withColumn("C0", F.lit(1))
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(5, copy), (5, other), (None, other + " x y z"), (8, ""), (8, "")])
    assert near_dup.deduplicate(none).count() == 0 and near_dup.deduplicate(odd).columns == odd.columns


def test_media_round_trip(odd, none):
    stored = media.load(media.store(odd, rows=7))
    texts = collections.Counter((r.doc_id, (r.text or "").encode()) for r in odd.collect())
    back = collections.Counter((r.doc_id, bytes(r.samples)[: r.n_bytes]) for r in stored.collect())
    assert back == texts and all(len(r.samples) == r.width * r.height and r.width == 576 for r in stored.collect())
    assert media.load(media.store(none)).count() == 0
    clash = media.load(media.store(odd).withColumns({"width": F.lit("mine"), "Feature": F.lit("mine")}))
    assert clash.columns == ["doc_id", "n_bytes", "media", "width", "Feature", "samples", "width_", "height", "feature_"]
    assert {(r.width, r.width_) for r in clash.collect()} == {("mine", 576)}
    assert media.load(media.store(odd).withColumn("media", F.lit(None).cast("array<binary>"))).where("samples IS NOT NULL").count() == 0


def test_shards(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = docs.limit(1).crossJoin(spark.range(400)).select(F.col("id").alias("doc_id"), "text").withColumn("doc_id", F.col("doc_id") + 50_000)
    every = docs.select("doc_id", "text").union(hot)
    rows = sharding.assign(every, shards=12).collect()
    total = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == every.count() and len(total) == 12 and max(total.values()) < 1.02 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r.doc_id: r.text for r in every.collect()}
    shards = collections.defaultdict(set)
    for r in rows:
        assert r["size"] == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        shards[text[r.doc_id]].add(r.shard)
    held = collections.Counter()
    for r in rows:
        held[text[r.doc_id]] += r["size"]
    assert all(len(s) == 1 for t, s in shards.items() if held[t] <= sum(total.values()) / 12)  # only groups above a shard are split
    for capacity in (40_000, 70_000):
        least = sharding.assign(docs, shards=None, capacity=capacity).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        assert max(r.s for r in least) <= capacity and len(least) <= -(-sum(r.s for r in least) // capacity) + 1
    assert sharding.assign(odd, shards=3).count() == odd.count() and sharding.assign(none, shards=3).count() == 0


def test_pii_rows(odd, none, spark):
    assert all(r.base == [] and r.spans == [] for r in pii.detect(odd).collect()) and pii.detect(none).count() == 0
    df = spark.createDataFrame([(1, "to a@b.co", "x", "y", 9), (2, None, None, None, None)], SCHEMA)
    assert [(r.doc_id, r.text) for r in pii.redacted(df).orderBy("doc_id").collect()] == [(1, "to [EMAIL]"), (2, None)]
    registered = {r.doc_id: r for r in registry.op4_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base, every = pii.spans(r.text)
        listed = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        assert registered[r.doc_id].base_sha256 == pii.digest(listed(base)) and registered[r.doc_id].spans == listed(every)


@pytest.mark.parametrize("most", [1, 192, 193, 255, 15_552, 15_553, 49_408, training_order.MOST_RANKS])
def test_training_order_compact_ranks(most):
    edges = [r for r in (0, 191, 192, 255, 256, 15_551, 15_552, 15_553, 81_087, 81_088, most - 1) if r < most]
    rank = np.concatenate([edges, np.random.default_rng(most).integers(0, most, 300)]).astype(np.int64)
    for some in (rank, rank[:1], rank[:0]):
        raw = training_order.compact(some)
        assert training_order.spread(raw, len(some)).tolist() == some.tolist()
        assert len(raw) == sum(1 + (r >= 192) + (r >= 15_552) for r in some.tolist())


def test_training_order_round_trip(spark, odd, none, tmp_path):
    to = f"file://{tmp_path}/shards"
    rows = training_order.materialise(odd, registry.vocabulary(), to, stride=64, shard_rows=300).collect()
    library = tokens.load(registry.vocabulary())
    expected = collections.Counter()
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        for p in range(0, len(ids), 64):
            expected[(r.doc_id, p // 64, len(ids[p : p + 64]), zlib.crc32(np.array(ids[p : p + 64] + [0] * (64 - len(ids[p : p + 64])), "<u2").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.part, r.n_ids, r.ids_crc32) for r in rows) == expected
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len({r.shard for r in rows}) > 2
    assert all(r.slot == r.shard * 300 + r.place and r.place < 300 for r in rows)
    at = {r.slot: r.ids_crc32 for r in rows}
    read = training_order.read_from(spark, to, block=128).collect()
    assert [r.slot for r in read] == list(range(len(rows)))
    assert {r.slot: zlib.crc32(np.array(r.ids, "<u2").tobytes()) for r in read} == at
    later = training_order.read_from(spark, to, 303, 777, block=128).collect()
    assert [r.slot for r in later] == list(range(303, 777)) and [r.ids for r in later] == [r.ids for r in read[303:777]]
    again = training_order.materialise(odd, registry.vocabulary(), f"file://{tmp_path}/again", stride=64, shard_rows=300).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    gaps = odd.repartition(7).where(F.spark_partition_id() % 3 == 1)  # partitions without rows
    assert [r.slot for r in training_order.materialise(gaps, registry.vocabulary(), f"file://{tmp_path}/gaps", stride=64).orderBy("slot").collect()] == list(range(training_order.read_from(spark, f"file://{tmp_path}/gaps").count()))
    assert training_order.materialise(none, registry.vocabulary(), f"file://{tmp_path}/none").count() == 0
    assert training_order.read_from(spark, f"file://{tmp_path}/none").count() == 0


def test_mixing_against_sql_and_limits(spark, odd, none):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL}) x").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in registry.op6_mixing(spark, SF).collect()}
    assert got.keys() == expected.keys() and all(got[i][k] == pytest.approx(expected[i][k]) for i in got for k in range(4))
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows) and mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(none).count() == 0
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    times = mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in times} == {i: t // s for i, (s, _, _, t) in got.items() if t}


def test_mixing_where_the_rest_is_all_of_the_first_document(spark):
    """Two sources of two one-word documents: targets 4 and 2 of sizes 2 and 2, then 1 of 2 where sizes differ."""
    rows = [(k, "w", "en", "a" if k < 2 else "b", 1) for k in range(4)] + [(9, "w w", "en", "a", 3)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert {(r.doc_id, r.target, r.taken) for r in got} == set(con.execute(f"SELECT doc_id, target, taken FROM ({mixing.SQL}) x").fetchall())


def test_targets_fill_up_to_their_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, None: 70}
    df = spark.createDataFrame([*sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    weights = dict(zip([*sorted(s for s in sizes if s), None], (3, 1, 2, 3, 1)))
    want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want)


def test_search_recall_and_odd_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    found = collections.defaultdict(list)
    for r in registry.op7_ann(spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, got in found.items():
        exact = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        hits += len({i for _, i in exact} & {i for i, _ in got})
        assert all(s == pytest.approx(np.sqrt(((rows[i] - rows[q]) ** 2).sum()), abs=1e-12) for i, s in got) and got == sorted(got, key=lambda x: (x[1], x[0]))
    assert set(found) == {i for i in rows if i % 100 == 0} and hits >= 0.9 * 10 * len(found)
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 3.0]), (9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(odd, odd.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 8, pytest.approx(10**0.5))]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.9]), (0, None)], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id) for r in ann.search(odd, twice, k=2).where("query_id = 0").collect())
    assert got == [(1, 1), (1, 8), (2, 1), (2, 9)]  # a list for each of the two rows
    assert ann.search(odd.limit(0), odd.limit(0)).count() == 0 and ann.search(odd.where("vec_id = 3"), odd).count() == 0


def test_recall_at_scale(spark):
    """Recall at 10 against brute force on 16,000 vectors: those of a test table, and noisy ones around them."""
    few = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    noisy = F.transform("embedding", lambda x: (x + F.lit(0.05) * F.sin(F.col("copy") * 7919.0 + x * 99991.0)).cast("float"))
    df = few.crossJoin(spark.range(8).withColumnRenamed("id", "copy")).select((F.col("vec_id") + F.col("copy") * 2000).alias("vec_id"), F.when(F.col("copy") == 0, F.col("embedding")).otherwise(noisy).alias("embedding"))
    queries = df.where("vec_id % 1000 = 0")
    some = df.collect()
    ids, vectors = np.array([r.vec_id for r in some]), np.array([r.embedding for r in some], float)
    hits = n = 0
    found = collections.defaultdict(set)
    for r in ann.search(df, queries).collect():
        found[r.query_id].add(r.vec_id)
    for q in ids[ids % 1000 == 0].tolist():
        exact = np.argsort(((vectors - vectors[ids == q][0]) ** 2).sum(1), kind="stable")
        hits += len(set(ids[exact][ids[exact] != q][:10].tolist()) & found[q])
        n += 10
    print("recall", hits / n)
    assert hits >= 0.9 * n


def test_toxicity_held_out(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 4 != 0"))
    held = toxicity.score(docs.join(labels.where("doc_id % 4 = 0"), "doc_id"), model).select("toxic", "toxic_rejected", "toxic_severity").collect()
    toxic = [r for r in held if r.toxic]
    clean = [r for r in held if not r.toxic]
    assert sum(r.toxic_rejected for r in toxic) > 0.9 * len(toxic) and sum(r.toxic_rejected for r in clean) < 0.01 * len(clean)
    assert np.mean([r.toxic_severity for r in toxic]) > 5 * np.mean([r.toxic_severity for r in clean])
    assert toxicity.score(odd, model).where("toxic_rejected").count() == 0 and toxicity.score(none, model).count() == 0
    clash = docs.limit(20).withColumn("toxic_severity", F.lit("mine"))
    assert toxicity.accepted(clash, model).columns == clash.columns
    assert toxicity.score(clash, model).columns[-3:] == ["toxic_severity", "toxic_severity_", "toxic_rejected"]
    assert toxicity.accepted(docs, model).count() == toxicity.score(docs, model).where("NOT toxic_rejected").count()
    blank = toxicity.train(docs, labels.limit(0))
    assert not blank.weights and toxicity.score(docs.limit(5), blank).where("toxic_rejected").count() == 0


def test_packing_rows(odd, none):
    rows = packing.pack(odd, registry.vocabulary(), capacity=128).collect()
    table, whole = tokens.ChunkIds(registry.vocabulary()), collections.Counter()
    for r in odd.collect():
        whole[(r.doc_id, len(table.of([r.text or ""])[0]) // 4 + 1)] += 1
    pieces, windows = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert pieces == collections.Counter({k: n * k[1] for k, n in whole.items()})
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(none, registry.vocabulary()).count() == 0


def test_token_counts_and_budgets(odd, none, spark):
    library = tokens.load(registry.vocabulary())
    counts = token_counts.prefix_token_table(odd, registry.vocabulary())
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counts.collect())
    assert got == collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    text = odd.where("doc_id = 6").first().text
    asked = counts.where("doc_id = 6").select(token_counts.tokens_before("prefix_changes", F.lit(4).cast("long")).alias("n"), token_counts.longest_prefix("prefix_changes", F.lit(1).cast("long")).alias("k")).first()
    assert asked.n == len(library.encode(text[:4], add_special_tokens=False).ids)
    assert asked.k == max(k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= 1)
    assert token_counts.prefix_token_table(none, registry.vocabulary()).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "pii", "mixing", "packing"]
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert sizes[0] <= 200 and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    assert spark.read.parquet(f"{tmp_path}/2").where(F.col("text").rlike("[A-Za-z0-9]@[a-z]+[.]com")).count() == 0
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096
    assert corpus_pipeline.run(spark, SF).count() > 0
