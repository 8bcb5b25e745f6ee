import random

from twinlake.operators import delta


def frame(spark, contents):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()], "path string, content binary")


def weak(part):
    a = sum(part)
    b = sum((len(part) - k) * v for k, v in enumerate(part))
    return a % 65536 + b % 65536 * 65536


def expected_ops(old, new, block):
    """The greedy encoding, one pair at a time."""
    blocks = [old[k : k + block] for k in range(0, len(old), block)]
    ops, start, pos = [], 0, 0
    while pos + block <= len(new) and blocks:
        if new[pos : pos + block] in blocks:
            if pos > start:
                ops.append(("literal", new[start:pos]))
            ops.append(("copy", blocks.index(new[pos : pos + block])))
            pos += block
            start = pos
        else:
            pos += 1
    if rest := new[start:]:
        ops.append(("copy", blocks.index(rest)) if rest in blocks else ("literal", rest))
    return ops


def test_weak_checksum_by_definition(spark):
    rng = random.Random(1)
    contents = {str(k): bytes(rng.randrange(256) for _ in range(n)) for k, n in enumerate((1, 3, 50, 200))}
    got = {(r.path, r.pos): r.weak for r in delta.windows(frame(spark, contents), 3).collect()}
    assert got == {(p, k): weak(c[k : k + 3]) for p, c in contents.items() for k in range(len(c) - 2)}
    one = delta.signature(frame(spark, {"x": bytes([1, 2, 3])}), 3).first()
    assert one.weak == 6 + 10 * 65536


def test_ops_and_round_trip(spark):
    rng = random.Random(7)
    some = lambda n: bytes(rng.randrange(4) for _ in range(n))
    old, new = {}, {}
    cases = [(b"", b""), (b"", b"abc"), (b"abc", b""), (b"abcdefgh" * 4, b"abcdefgh" * 4), (some(40), some(40)), (b"abcdefghij", b"abcdef"), (b"abcdef", b"abcdefghij")]
    base = bytes(rng.randrange(256) for _ in range(120))
    cases += [(base, base[:50] + b"x" + base[51:]), (base, b"12345" + base), (base, base[:60] + some(9) + base[60:])] + [(some(rng.randrange(60)), some(rng.randrange(60))) for _ in range(12)]
    for k, (a, b) in enumerate(cases):
        old[str(k)], new[str(k)] = a, b
    o, n = frame(spark, old), frame(spark, new)
    ops = delta.encode(o, n, 8)
    got = {}
    for r in ops.orderBy("path", "op_seq").collect():
        got.setdefault(r.path, []).append((r.op, r.block_idx if r.op == "copy" else bytes(r.bytes)))
    for p in old:
        assert got.get(p, []) == expected_ops(old[p], new[p], 8), p
    rebuilt = {r.path: bytes(r.content) for r in delta.apply_delta(o, ops, 8).collect()}
    assert rebuilt == new
    stats = {r.path: r for r in delta.delta_stats(ops).collect()}
    assert stats["3"].copies == 4 and stats["3"].literal_bytes == 0 and stats["3"].reuse == 1.0


def test_blocks_sized_by_each_content(spark):
    rng = random.Random(3)
    long = rng.randbytes(900_000)  # blocks of 949 bytes
    old = {"a": b"", "b": long, "c": long[:3000], "d": b"x" * 5000, "gone": b"old"}
    new = {"a": b"abc", "b": long[:400_000] + b"!" + long[400_000:], "c": long[100:3000], "d": b"", "gone": b""}
    o, n = frame(spark, old), frame(spark, new)
    ops = delta.encode(o, n, None)
    got = {}
    for r in ops.orderBy("path", "op_seq").collect():
        got.setdefault(r.path, []).append((r.op, r.block_idx if r.op == "copy" else bytes(r.bytes)))
    for p in old:
        block = max(700, min(131072, round(len(old[p]) ** 0.5)))
        assert got.get(p, []) == expected_ops(old[p], new[p], block), p
    assert {r.path: bytes(r.content) for r in delta.apply_delta(o, ops, None).collect()} == new


def test_a_long_repetitive_file(spark):
    one = b"\0" * 1_000_000
    o, n = frame(spark, {"x": one}), frame(spark, {"x": b"ab" + one})
    ops = delta.encode(o, n, 700)
    assert {r.path: bytes(r.content) for r in delta.apply_delta(o, ops, 700).collect()} == {"x": b"ab" + one}
    assert ops.where("op = 'copy'").count() == 1_000_000 // 700 + 1


def test_fifty_megabytes(spark, tmp_path):
    data = random.Random(5).randbytes(50_000_000)
    o, n = frame(spark, {"x": data}), frame(spark, {"x": data[:25_000_000] + b"new" + data[25_000_000:]})
    rebuilt = delta.apply_delta(o, delta.encode(o, n, None), None).first()
    assert bytes(rebuilt.content) == data[:25_000_000] + b"new" + data[25_000_000:]


def test_out_of_range_copies_are_rejected(spark):
    ops = spark.createDataFrame([("a", 0, "copy", 5, None), ("b", 0, "copy", 0, None), ("e", 0, "copy", 0, None), ("f", 0, "copy", 1, None)], "path string, op_seq int, op string, block_idx int, bytes binary")
    old = frame(spark, {"a": b"xyz", "b": b"xyz", "e": b"", "f": b""})
    assert {r.path: bytes(r.content) for r in delta.apply_delta(old, ops, 2).collect()} == {"b": b"xy", "e": b""}
    ops, old = ops.where("path IN ('a', 'b')"), old.where("path IN ('a', 'b')")
    good, bad = delta.split_ops(old, ops, 2)
    assert [r.path for r in good.collect()] == ["b"]
    assert [(r.path, r.error) for r in bad.collect()] == [("a", "copy block 5 out of range")]


def test_contents_are_not_joined_for_their_block_sizes(spark, monkeypatch):
    """The size of an old content's blocks follows from its length and comes with the signature."""
    old = frame(spark, {"a": b"abc" * 900, "b": b""})
    new = frame(spark, {"a": b"x" + b"abc" * 900, "b": b"q", "c": b"new"})
    asked, block_of = [], delta.block_of
    monkeypatch.setattr(delta, "block_of", lambda *of: asked.append(of) or block_of(*of))
    ops = delta.encode(old, new, None)
    assert {(r.path, r.op) for r in ops.collect()} == {("a", "literal"), ("a", "copy"), ("b", "literal"), ("c", "literal")}
    assert len(asked) == 1  # by the signature
