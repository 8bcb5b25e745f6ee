"""Listings of trees against a walk of the same tree."""

import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinlake.operators.filters import included, rules_of
from twinlake.sources.listing import TreeReader, list_tree


def build(root, files):
    for name, data in files.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)


def listed(options):
    reader = TreeReader({"rules": "[]", **options})
    return [row for share in reader.partitions() for batch in reader.read(share) for row in batch.to_pylist()]


def walked(root):
    return sorted(os.path.relpath(os.path.join(at, n), root) for at, dirs, files in os.walk(root) for n in dirs + files)


def test_all_that_a_tree_holds(spark, tmp_path):
    build(tmp_path, {".hidden/_name": b"abc", "a/b/c.txt": b"12345", "a/b/empty": b"", "_top": b"x", "sp ace/ü\n.txt": b"y"})
    (tmp_path / "bare").mkdir()
    os.symlink("../a", tmp_path / "a" / "link")
    os.symlink("nowhere", tmp_path / "dangling")
    os.mkfifo(tmp_path / "pipe")
    os.chmod(tmp_path / "_top", 0o604)
    os.utime(tmp_path / "_top", ns=(0, -1_500_000_000))
    os.link(tmp_path / "_top", tmp_path / "twin")
    found = {r.path: r for r in list_tree(spark, f"file://{tmp_path}", with_hash=True, splits=2).collect()}
    assert sorted(found) == [p for p in walked(tmp_path) if p != "pipe"]
    for path, r in found.items():
        s = os.lstat(tmp_path / path)
        assert (r.mode, r.uid, r.gid, r.ino, r.dev) == (s.st_mode, s.st_uid, s.st_gid, s.st_ino, s.st_dev)
        assert (r.mtime_s, r.mtime_ns) == divmod(s.st_mtime_ns, 10**9)
    assert (found["_top"].mtime_s, found["_top"].mtime_ns, found["_top"].mode & 0o777) == (-2, 500_000_000, 0o604)
    assert found["_top"].ino == found["twin"].ino
    assert [(found[p].kind, found[p].len, found[p].target) for p in ("a/link", "dangling", "bare", ".hidden/_name")] == [("symlink", 0, "../a"), ("symlink", 0, "nowhere"), ("dir", 0, None), ("file", 3, None)]
    assert found["a/b/c.txt"].hash == hashlib.sha256(b"12345").hexdigest() and found["a/link"].hash is None


def test_rules_act_while_listing_and_directories_stay(spark, tmp_path):
    build(tmp_path, {f"{d}/{n}": b"" for d in ("src", "target/deep", ".git") for n in ("x.rs", "x.o")})
    rules = rules_of(["+ target/deep/x.rs", "- target"], ["*.rs"], ["*"])
    found = sorted(r.path for r in list_tree(spark, str(tmp_path), rules).collect())
    assert found == [".git", ".git/x.rs", "src", "src/x.rs", "target", "target/deep", "target/deep/x.rs"]
    assert found == sorted(r.path for r in list_tree(spark, str(tmp_path)).where(included(rules)).collect())


trees = st.dictionaries(st.lists(st.sampled_from("abcde"), min_size=1, max_size=5).map(lambda p: "/".join(f"d{x}" for x in p) + "/f"), st.just(b"1"), max_size=25)


@settings(max_examples=40, deadline=None)
@given(trees, st.integers(1, 6))
def test_each_entry_comes_once_whatever_the_tasks(tmp_path_factory, files, splits):
    root = tmp_path_factory.mktemp("tree")
    build(root, files)
    assert sorted(r["path"] for r in listed({"path": str(root), "splits": splits})) == walked(root)


def test_a_wide_level_and_a_long_chain(tmp_path):
    build(tmp_path, {f"w{k}/f": b"" for k in range(300)} | {"/".join(["c"] * 200) + "/f": b""})
    reader = TreeReader({"path": str(tmp_path), "splits": "8"})
    assert all(len(s.own) + len(s.dealt) <= 1 for s in reader.partitions())  # the wide level is not kept
    assert sorted(r["path"] for r in listed({"path": str(tmp_path), "splits": "8"})) == walked(tmp_path)
    chain = TreeReader({"path": f"{tmp_path}/c", "splits": "2"})
    assert sum(len(s.own) for s in chain.partitions()) == 32
    assert sorted(r["path"] for r in listed({"path": f"{tmp_path}/c", "splits": "2"})) == walked(tmp_path / "c")


def test_odd_roots_and_names(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(NotADirectoryError):
        listed({"path": f"{tmp_path}/missing"})
    with pytest.raises(ValueError, match="mounted"):
        TreeReader({"path": "s3://bucket/x"})
    with open(os.fsencode(str(tmp_path)) + b"/\xff", "wb"):
        pass
    assert [r.path for r in list_tree(spark, str(tmp_path)).collect()] == [r"\xff"]


def test_what_vanishes_is_left_out(tmp_path):
    build(tmp_path, {f"d{k}/f": b"" for k in range(5)})
    reader = TreeReader({"path": str(tmp_path), "splits": "8"})
    shares = reader.partitions()
    os.remove(tmp_path / "d3" / "f")
    os.rmdir(tmp_path / "d3")
    rows = [r["path"] for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(rows) == walked(tmp_path)
