"""Operator 10: exact token counts at every prefix of a text.

prefix_token_table() stores for each document how the token count changes from one code point to the next, so
that truncation and budget questions are answered by a cumulative sum, without encoding anything again.

Defined results: a null text counts as empty (0 tokens, empty table); repeated rows give repeated results; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .tokens import PrefixCounts, worker


def prefix_token_table(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and prefix_changes: int16 little-endian, one for each code point.

    The sum of the first k changes is the token count of the first k code points, as the library for the file at
    `path` gives it, without added special tokens, truncation or padding. No shuffle: a map over the scan.
    """
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), text_bytes(F.col(text)).alias("n_bytes"))
    kind = src.schema["key"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker(PrefixCounts, path)
        for whole in batches:
            for batch in slices(whole):
                changes = table.of(batch.column("text").to_pylist())
                total = [int(np.frombuffer(c, "<i2").sum(dtype=np.int64)) for c in changes]
                yield pa.record_batch([batch.column("key"), batch.column("n_bytes"), pa.array(total, pa.int64()), pa.array(changes, pa.binary())], ["key", "n_bytes", "n_tokens", "prefix_changes"])

    return src.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long, prefix_changes binary").withColumnRenamed("key", key)


def tokens_before(changes: Column | str, k: Column | str) -> Column:
    """Token count of the first k code points (k beyond the end: of the whole text)."""
    return _ask(lambda c, n: int(c[: max(n, 0)].sum(dtype=np.int64)))(changes, k)


def longest_prefix(changes: Column | str, budget: Column | str) -> Column:
    """The most code points whose prefix has at most `budget` tokens (counts may fall as a word goes on)."""
    return _ask(lambda c, n: int(np.flatnonzero(np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) <= n)[-1]) if n >= 0 else 0)(changes, budget)


def _ask(answer: Callable[[np.ndarray, int], int]) -> Callable[..., Column]:
    @F.pandas_udf("long")
    def asked(changes: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or pd.isna(k) else answer(np.frombuffer(c, "<i2"), int(k)) for c, k in zip(changes, n)], dtype="Int64")

    return asked
