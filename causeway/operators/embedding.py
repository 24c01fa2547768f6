"""Vectors of texts' overlapping chunks behind a replaceable embedder, as half floats: one block of bytes a text, with offsets.

Edge cases: a null or empty text is one empty chunk; rows are independent of each other, so repeated rows and null keys give a row each; an
empty table gives an empty result. An embedder that answers with another number of vectors or another width raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import scalar
from causeway.functions.workers import by_value

by_value(__name__)


class Embedder(Protocol):
    """Makes, once a task, a function from texts to a matrix with a row of `width` numbers for each."""

    name: str
    width: int

    def client(self) -> Callable[[list[str]], np.ndarray]: ...


class WordBuckets:
    """Offline stand-in for an encoder: counts of a text's words by bucket of their md5. Counts below 2048 are exact as half floats."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"word-buckets-{width}"

    def client(self) -> Callable[[list[str]], np.ndarray]:
        import hashlib
        from functools import lru_cache

        width = self.width

        @lru_cache(maxsize=100_000)
        def bucket(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % width

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, t in enumerate(texts):
                np.add.at(out[i], [bucket(w) for w in t.split(" ") if w], 1.0)
            return out

        return run


def text_hash(text: Column) -> Column:
    """What tells whether stored vectors are those of this text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def text_chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of `size` tokens, `overlap` of them shared with the next, as texts."""
    return F.transform(scalar.chunks(scalar.tokens(F.coalesce(text, F.lit(""))), size, overlap), lambda c: F.array_join(c, " "))


def embedded(df: DataFrame, key: str, text: str, embedder: Embedder, size: int = 256, overlap: int = 32, batch: int = 64) -> DataFrame:
    """key, content (hash of the text), offsets (of each chunk's first number in the block, and the end), block (little-endian half floats).

    The embedder is opened once a task and asked for `batch` chunks at a time, over the limits of texts; a worker holds one Arrow batch.
    """
    name, schema = embedder.width, f"{key} {dict(df.dtypes)[key]}, content string, offsets array<int>, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = embedder.client()
        for b in batches:
            lists = b.column(2)
            ends, flat = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64), lists.flatten().to_pylist()
            parts = [np.asarray(ask(flat[i : i + batch])) for i in range(0, len(flat), batch)]
            if any(p.shape != (len(flat[i * batch : (i + 1) * batch]), name) for i, p in enumerate(parts)):
                raise ValueError(f"the embedder owes {name} numbers for each text")
            halves = np.concatenate([p.astype("<f2") for p in parts]) if parts else np.zeros((0, name), "<f2")
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            offsets = pa.array([np.arange(hi - lo + 1, dtype=np.int32) * name for lo, hi in spans], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), offsets, pa.array([halves[lo:hi].tobytes() for lo, hi in spans], pa.binary())], [key, "content", "offsets", "block"])

    return df.select(key, text_hash(F.col(text)).alias("content"), text_chunks(F.col(text), size, overlap).alias("chunks")).mapInArrow(run, schema)


def unpacked(df: DataFrame, key: str) -> DataFrame:
    """key and vectors (array of a vector for each chunk) of rows of embedded(); null where a row has no block."""
    schema = f"{key} {dict(df.dtypes)[key]}, vectors array<array<float>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for offsets, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows.append(None if block is None else [v.astype(np.float32) for v in np.split(np.frombuffer(block, "<f2"), offsets[1:-1])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.list_(pa.float32())))], [key, "vectors"])

    return df.select(key, "offsets", "block").mapInArrow(run, schema)
