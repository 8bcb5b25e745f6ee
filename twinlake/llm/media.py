"""Operator 2: media columns of lossless WebP images.

store() lays each text's bytes, filled up with 255 to a multiple of `unit`, out as 8-bit samples of `unit` columns and
writes them as lossless WebP. A medium is an array of files: one, which any reader of the format can open, up to the
format's 16,384 rows, and a further one for each 16,384 rows beyond.
load() reads the stored bytes back: prefix codes, back-references, colour cache and the inverse transforms, and
returns the pixel samples with a feature string.

Defined results: a null or empty text is stored as one unit of 255; equal texts give equal values; bytes that are no
lossless WebP stop the job with an error; a null or empty medium gives null samples; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored. No shuffle: both are maps over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import webp
from .common import free_name, slices, text_bytes


#: The most rows of an image of the format.
MOST_ROWS = 1 << 14


def encode_bytes(payload: bytes, unit: int, rows: int = MOST_ROWS) -> list[bytes]:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, unit)
    return [webp.encode_samples(samples[k : k + rows]) for k in range(0, len(samples), rows)]


def decode_files(files: list[bytes] | None) -> np.ndarray | None:
    """The samples of a medium's files, one below the other."""
    if not files:
        return None
    parts = [webp.decode_samples(f) for f in files]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def features(samples: np.ndarray) -> str:
    """Size, sum, extremes, number of levels and total horizontal change of the samples; whole numbers only."""
    levels = np.bincount(samples.ravel(), minlength=256)
    used = np.flatnonzero(levels)
    change = np.abs(np.diff(samples.astype(np.int16), axis=1)).sum(dtype=np.int64)
    return f"{samples.shape[1]}x{samples.shape[0]};sum={int(levels @ np.arange(256))};min={used[0]};max={used[-1]};levels={len(used)};change={change}"


def store(df: DataFrame, unit: int = 576, rows: int = MOST_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (before filling up), media."""
    src = df.select(F.col(key).alias("key"), text_bytes(text).alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256):
                media = []
                for t in batch.column("text").to_pylist():
                    raw = t.encode()
                    media.append(encode_bytes(raw + b"\xff" * (-len(raw) % unit if raw else unit), unit, rows))
                yield pa.record_batch([batch.column("key"), batch.column("n_bytes"), pa.array(media, pa.list_(pa.binary()))], ["key", "n_bytes", "media"])

    return src.mapInArrow(stored, f"key {src.schema['key'].dataType.simpleString()}, n_bytes long, media array<binary>").withColumnRenamed("key", key)


def load(df: DataFrame, media: str = "media") -> DataFrame:
    """The rows with samples (row by row), width, height and feature; where the input has a column of such a name, the new
    one's name gets "_" behind it."""
    place = df.columns.index(media)
    schema = StructType(df.schema.fields[:])
    for name, kind in (("samples", "binary"), ("width", "integer"), ("height", "integer"), ("feature", "string")):
        schema = schema.add(free_name(name, schema.names), kind)

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256):
                found = [decode_files(m) for m in batch.column(place).to_pylist()]
                own = [
                    pa.array([None if s is None else s.tobytes() for s in found], pa.binary()),
                    pa.array([None if s is None else s.shape[1] for s in found], pa.int32()),
                    pa.array([None if s is None else s.shape[0] for s in found], pa.int32()),
                    pa.array([None if s is None else features(s) for s in found], pa.string()),
                ]
                yield pa.record_batch([*batch.columns, *own], schema.names)

    return df.mapInArrow(loaded, schema)
