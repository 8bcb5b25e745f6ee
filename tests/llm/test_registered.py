"""The registered queries, as they are, against the definitions of their columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from twinlake.llm import registry, tokens, webp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, "op1_near_dup")} == {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_op2(spark, texts):
    for r in run(spark, "op2_media"):
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature.startswith(f"576x{len(payload) // 576};sum={sum(payload)};min={min(payload)};max={max(payload)};")


def test_op2_one_file_for_a_long_text(spark):
    from twinlake.llm import media

    long = "".join(f"line {k} of a long text\n" for k in range(20_000))
    row = media.store(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert len(row.media) == 1 and len(long) > 512 * 576
    assert webp.decode_samples(row.media[0]).tobytes().rstrip(b"\xff").decode() == long


def test_op3(spark, texts):
    rows = run(spark, "op3_sharding")
    size = {i: len((t or "").encode()) + 16 for i, t in texts.items()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, size[i], zlib.crc32((t or "").encode())) for i, t in texts.items()}
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
        by[r.shard].append(r.slot)
        groups[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    whole, copies = sum(size.values()) / 40, Counter((t or "") for t in texts.values())
    assert all(len(s) == 1 for t, s in groups.items() if (len((t or "").encode()) + 16) * copies[t or ""] <= whole)


def test_op5(spark):
    rows = run(spark, "op5_training_order")
    slots = sorted(r[next(c for c in r.asDict() if "slot" in c)] for r in rows)
    assert slots == list(range(len(rows)))


def test_op8(spark, texts):
    rows = run(spark, "op8_toxicity")
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(0 <= r.severity <= 2 for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    by = {r.doc_id: r for r in rows}
    assert sum(by[i].rejected for i, t in labels.items() if not t and i in by) <= 2


def test_op9_and_op10(spark, texts):
    tokenizer = tokens.load(registry.vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in run(spark, "op9_packing"):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, some in pieces.items():
        at = 0
        for start, length in sorted(some):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    for some in windows.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    assert set(pieces) == set(texts) and sum(len(x) for x in ids.values()) > 0.9 * 4096 * (len(windows) - 1)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op10_token_counts")}
    assert got == {(i, len((t or "").encode()), len(ids[i]) - 1, len(ids[i]) - 1 > 2048) for i, t in texts.items()}


def test_op11_to_op13_have_their_columns(spark):
    want = {
        "op11_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op12_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op13_prefix_trie": {**dict.fromkeys(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "bigint"), "ends_sha256": "string"},
    }
    for name, columns in want.items():
        assert dict(registry.QUERIES[name](spark, SF).dtypes) == columns


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, an empty text, columns with the operators' names; then an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0), (900002, None, None, "src1", None), (900003, "same words again and again here", "en", "src1", 31), (900003, "same words again and again here", "en", "src1", 31)], docs.schema)
    for rows in (docs.union(odd), docs.limit(0)):
        at = f"{tmp_path}/{rows.count()}"
        rows.withColumns({c: rows["lang"] for c in ("size", "taken", "shard", "ids")}).write.parquet(f"file://{at}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"file://{at}/labels.parquet")
        got = corpus_pipeline.run(spark, f"file://{at}").collect()
        assert all(r.length > 0 for r in got) and (bool(got) == (rows.count() > 0))
        if got:
            assert Counter(r.doc_id for r in got)[900003] <= 2  # one of the repeated rows, taken twice at most
