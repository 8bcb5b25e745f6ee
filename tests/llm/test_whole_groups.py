"""Groups that fit a shard stay whole, whatever their share of it."""

import collections

import pytest
from pyspark.sql import functions as F

from twinlake.llm import sharding


@pytest.fixture(scope="module")
def copies(spark):
    """600 small texts, and groups of copies: four that fit one of 6 shards, one that is larger."""
    small = [f"text {k} " * (3 + k % 40) for k in range(600)]
    rows = [*small, *["a" * 984] * 12, *["b" * 984] * 18, *["c" * 984] * 25, *["d" * 984] * 36, *["e" * 984] * 75]
    return spark.createDataFrame([*enumerate(rows)], "doc_id long, text string").repartition(4)


def _shards(assigned, df):
    rows = assigned.join(df, "doc_id").select("doc_id", "text", "shard", "size").collect()
    groups, sizes = collections.defaultdict(set), collections.Counter()
    for r in rows:
        groups[r.text].add(r.shard)
        sizes[r.shard] += r["size"]
    assert len(rows) == df.count() == len({r.doc_id for r in rows})
    return groups, sizes


def test_groups_that_fit_a_shard_stay_whole(copies):
    mean = copies.agg(F.sum(F.octet_length("text") + 16)).first()[0] / 6
    assert 36_000 < mean < 75_000
    groups, sizes = _shards(sharding.assign(copies, shards=6), copies)
    assert [t[0] for t, s in groups.items() if len(s) > 1] == ["e"]
    assert len(sizes) == 6 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_groups_that_fit_a_bin_stay_whole(copies):
    groups, _ = _shards(sharding.assign(copies, shards=None, capacity=40_000), copies)
    assert [t[0] for t, s in groups.items() if len(s) > 1] == ["e"]
