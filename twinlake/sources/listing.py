"""Complete listings of mounted trees as a Spark data source: directories, links, hidden names, modes and owners (SRC-1)."""

from __future__ import annotations

import hashlib
import json
import os
import stat
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.rulesets import RuleAutomaton
from ..schemas import ENTRIES

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ENTRIES.split(", "))])
BATCH_ROWS = 8_192
BLOCK_BYTES = 1 << 20


@dataclass
class Share(InputPartition):
    """Task `k` of `n`: the entries of the `own` directories, and the part of the `dealt` ones that is its own, with all beneath."""

    k: int
    n: int
    own: list[str]
    dealt: list[str]


def list_tree(spark: SparkSession, root: str, rules: list[tuple[bool, str]] = (), with_hash: bool = False, splits: int = 64) -> DataFrame:
    """Entries of all that is below a root, which all executors must have mounted at the same place.

    Links are not followed; sockets, pipes and devices are left out; lengths of directories and links are 0. Rules are applied
    while listing, directories stay. Contents are read only for hashes, in blocks. What vanishes while the tree is listed is
    left out; a directory that cannot be read stops the job. Bytes of a name that are no UTF-8 are written as `\\xhh`. An empty
    root has no rows; one that is missing, or no directory, is an error.

    The driver looks at directories level by level, until a level has more than `splits` of them, and keeps none of that
    level: its directories are dealt to as many tasks by a hash of their paths. A subtree that begins there is one task's
    work, so more `splits` divide a deep tree further.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(rules=json.dumps(list(rules)), hash=str(bool(with_hash)).lower(), splits=splits).load(root)


class TreeSource(DataSource):
    """`spark.read.format("tree")` with the options path, rules (a JSON list of [include, pattern]), hash and splits."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options["path"]
        scheme, colon, rest = root.partition(":")
        if colon and scheme.isalnum() and rest.startswith("/"):
            if scheme != "file":
                raise ValueError(f"{root} is not mounted: listings are of local paths that all executors share")
            root = "/" + rest.lstrip("/")
        self.root = root.rstrip("/") or "/"
        self.rules = [(bool(i), p) for i, p in json.loads(options.get("rules", "[]"))]
        self.hash, self.splits = options.get("hash", "false") == "true", int(options.get("splits", 64))
        RuleAutomaton(tuple(p for _, p in self.rules))

    def partitions(self) -> list[Share]:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        above, level = [], [""]
        while len(above) < 16 * self.splits:  # a long chain of directories ends here
            below = []
            for at in level:
                for child in self._children(at):
                    if child.is_dir(follow_symlinks=False):
                        below.append(_under(at, child.name))
                        if len(below) > self.splits:
                            break
                if len(below) > self.splits:
                    break
            if not below or len(below) > self.splits:
                break
            above, level = above + level, below
        return [Share(k, self.splits, above[k :: self.splits], level) for k in range(self.splits)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self._entries(share):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _children(self, at: str) -> Iterator[os.DirEntry]:
        try:
            with os.scandir(os.path.join(self.root, at)) as found:
                yield from found
        except FileNotFoundError:
            return

    def _entries(self, share: Share) -> Iterator[tuple]:
        first = RuleAutomaton(tuple(p for _, p in self.rules)).first if self.rules else lambda path: None
        open_ = []
        for at in share.own:
            yield from (row for child in self._children(at) if (row := self._row(at, child, first)))
        for at in share.dealt:
            for child in self._children(at):
                path = _under(at, child.name)
                if zlib.crc32(os.fsencode(path)) % share.n == share.k:
                    if row := self._row(at, child, first):
                        yield row
                    if child.is_dir(follow_symlinks=False):
                        open_.append(path)
        while open_:
            at = open_.pop()
            for child in self._children(at):
                if row := self._row(at, child, first):
                    yield row
                if child.is_dir(follow_symlinks=False):
                    open_.append(_under(at, child.name))

    def _row(self, at: str, child: os.DirEntry, first) -> tuple | None:
        path = _text(_under(at, child.name))
        if not child.is_dir(follow_symlinks=False):
            rule = first(path)
            if rule is not None and not self.rules[rule][0]:
                return None
        target = digest = None
        try:
            found = child.stat(follow_symlinks=False)
            kind = next((name for name, test in _KINDS if test(found.st_mode)), None)
            if kind is None:
                return None
            if kind == "symlink":
                target = _text(os.readlink(child.path))
            elif kind == "file" and self.hash:
                digest = _digest(child.path)
        except FileNotFoundError:
            return None
        seconds, nanos = divmod(found.st_mtime_ns, 1_000_000_000)
        return path, kind, found.st_size if kind == "file" else 0, seconds, nanos, found.st_mode, _signed(found.st_uid, 32), _signed(found.st_gid, 32), _signed(found.st_dev, 64), _signed(found.st_ino, 64), target, digest


_KINDS = (("file", stat.S_ISREG), ("dir", stat.S_ISDIR), ("symlink", stat.S_ISLNK))


def _under(at: str, name: str) -> str:
    return f"{at}/{name}" if at else name


def _text(name: str) -> str:
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _signed(number: int, bits: int) -> int:
    return number - (1 << bits) if number >> (bits - 1) else number


def _digest(file: str) -> str:
    sha = hashlib.sha256()
    with open(file, "rb") as data:
        while block := data.read(BLOCK_BYTES):
            sha.update(block)
    return sha.hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
