"""Models of text: a truncated SVD of tf-idf, random projections, candidate-variable encoders, mention slots.

What a model learns is bounded by its parameters (terms times dimensions, slots): it comes to the driver and travels with the function that
applies it. Documents only stream by: their terms are counted and weighted within batches (`terms`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.workers import by_value
from causeway.operators import encoding, tables
from causeway.operators.terms import Weights, frequent, lowered, slices

by_value(__name__)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which Spark's functions lack."""
    import unicodedata

    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalized(text: Column) -> Column:
    """nfkc(), ** as blanks, dashes as -, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.translate(F.replace(nfkc(text), F.lit("**"), F.lit(" ")), "‑‐–—", "----"), r"\s+", " "))


def fitted_terms(train: DataFrame, text: str, least: int = 5, most: float = 0.95, size: int = 10_000) -> DataFrame:
    """term, idf, at: the terms of the training rows by their total number, ties by term; idf is smooth. A few thousand rows."""
    found = frequent(train.select(lowered(F.col(text))), least, most, size)
    return train.sparkSession.createDataFrame([(t, x, i) for i, (t, x) in enumerate(found)], "term string, idf double, at int")


def _places(known: DataFrame) -> list[tuple[str, float]]:
    return [(r["term"], r["idf"]) for r in known.orderBy("at").collect()]


def term_vectors(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, at, x: the places and unit-length weights of each row's known terms; empty arrays where it has none."""
    found, kind = _places(known), dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(found)
        for b in batches:
            start = 0
            for some in slices(b.column(1)):
                row, at, x = model.of(some)
                ends = pa.array(np.searchsorted(row, np.arange(len(some) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(some)), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(x))], [key, "at", "x"])
                start += len(some)

    return df.select(key, lowered(F.col(text)).alias("__text")).mapInArrow(run, f"`{key}` {kind}, at array<int>, x array<double>")


def _sparse(batch: pa.RecordBatch, at: int, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and weight of each value."""
    lengths = np.diff(batch.column(at).offsets.to_numpy())
    return np.repeat(np.arange(len(batch)), lengths), batch.column(at).flatten().to_numpy(zero_copy_only=False), batch.column(x).flatten().to_numpy(zero_copy_only=False)


def _summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values by their ascending places."""
    out, begin = np.zeros((n, values.shape[1])), np.flatnonzero(np.diff(at, prepend=-1))
    if len(begin):
        out[at[begin]] = np.add.reduceat(values, begin)
    return out


def svd_basis(vectors: DataFrame, size: int, dims: int, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """size x dims: orthonormal leading right singular vectors, by randomised subspace iteration.

    In each round a task adds up X'(X Q) over its rows, a row for each term it holds; only size x (dims + 8) sums come to the driver.
    """
    width = min(size, dims + 8)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    rows = vectors.select("at", "x").persist()
    try:
        for _ in range(rounds):
            basis = q

            def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((size, width))
                for b in batches:
                    row, at, x = _sparse(b, 0, 1)
                    y = _summed(x[:, None] * basis[at], row, len(b))
                    order = np.argsort(at, kind="stable")
                    total += _summed((x[:, None] * y[row])[order], at[order], size)
                some = np.flatnonzero(np.abs(total).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total[some]), pa.list_(pa.float64()))], ["at", "s"])

            sums = rows.mapInArrow(multiply, "at int, s array<double>").groupBy("at").agg(F.array(*[F.sum(F.get("s", i)) for i in range(width)]).alias("s")).collect()
            z = np.zeros((size, width))
            for r in sums:
                z[r["at"]] = r["s"]
            q, values, _ = np.linalg.svd(z, full_matrices=False)
    finally:
        rows.unpersist()
    sign = np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])  # a singular vector's sign is free: its largest entry is positive
    return (q * np.where(sign == 0, 1, sign))[:, :dims]


def embedded(vectors: DataFrame, key: str, basis: np.ndarray, prefix: str = "svd_") -> DataFrame:
    """key and one column for each dimension."""
    dims = basis.shape[1]
    schema = f"{key} {dict(vectors.dtypes)[key]}, " + ", ".join(f"{prefix}{i} double" for i in range(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, x = _sparse(b, 1, 2)
            y = _summed(x[:, None] * basis[at], row, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in y.T]], [key, *[f"{prefix}{i}" for i in range(dims)]])

    return vectors.select(key, "at", "x").mapInArrow(run, schema)


def text_svd(train: DataFrame, df: DataFrame, key: str, text: str, dims: int = 16, size: int = 5000, least: int = 5, seed: int = 1, prefix: str = "svd_") -> DataFrame:
    """df with `dims` columns of a truncated SVD of tf-idf, fitted on train alone."""
    known = fitted_terms(train, text, least, size=size).persist()
    found = _places(known)
    n = len(found)
    if not n:
        return df.withColumns({f"{prefix}{i}": F.lit(0.0) for i in range(dims)})
    basis = svd_basis(term_vectors(train, key, text, known), n, min(dims, n), seed=seed)
    known.unpersist()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def coordinates(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Weights(found)
        for t in texts:
            parts = []
            for some in slices(pa.array(t, pa.string())):
                row, at, x = model.of(some)
                parts.append(_summed(x[:, None] * basis[at], row, len(some)))
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    out = df.withColumn("__svd", coordinates(lowered(F.col(text))))
    return out.withColumns({f"{prefix}{i}": F.get("__svd", i) if i < n else F.lit(0.0) for i in range(dims)}).drop("__svd")


def projection(model: str, hidden: int, dims: int) -> np.ndarray:
    """hidden x dims normal entries over the square root of dims; the seed comes from the names, so every run has the same."""
    seed = int(hashlib.md5(f"rp|{model}|{hidden}|{dims}".encode()).hexdigest()[:8], 16)
    return np.random.default_rng(seed).normal(size=(hidden, dims)) / np.sqrt(dims)


def projected(df: DataFrame, key: str, vector: str, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """key and the vectors times matrix; null for null ones and for those of another length."""
    schema = f"{key} {dict(df.dtypes)[key]}, {out} array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if v is None or len(v) != len(matrix) else (np.array(v, float) @ matrix).tolist() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, out])

    return df.select(key, vector).mapInArrow(run, schema)


# candidate variables


def candidate_columns(train: DataFrame, prefix: str) -> list[Column]:
    """Columns for all candidates by prefix, as learned from train: numbers get the median where missing and a z-score, others the most frequent value and an indicator for each category seen."""
    kinds = {r["column"]: r["numeric"] for r in tables.discovered(train, prefix).collect()}
    numbers, words = [c for c, n in kinds.items() if n], [c for c, n in kinds.items() if not n]
    cast = train.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in words])
    fill = {r["feature"]: r["value"] for r in encoding.imputation(cast, numbers, words).collect()} if kinds else {}
    filled = cast.select(*[F.coalesce(F.col(c), F.lit(float(fill.get(c) or 0.0))).alias(c) for c in numbers], *[F.coalesce(c, F.lit(fill.get(c))).alias(c) for c in words])
    stats = encoding.normalization(filled, numbers) if numbers else {}
    seen = {c: [r[0] for r in filled.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(256).collect()] for c in words}
    out = [((F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(float(fill.get(c) or 0.0))) - stats[c][0]) / stats[c][1]).alias(c) for c in numbers]
    return out + [(F.coalesce(F.col(c).cast("string"), F.lit(fill.get(c))) == v).cast("double").alias(f"{c}={v}") for c in words for v in seen[c]]


# mention slots


WIDTH = 64


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def label_vector(label: pd.Series) -> pd.Series:
    """A unit vector of hashed character trigrams: an offline stand-in for an encoder's embedding."""
    import zlib

    def one(text: str | None) -> list[float]:
        t = f" {(text or '').lower()} "
        v = np.bincount([zlib.crc32(t[i : i + 3].encode()) % WIDTH for i in range(max(1, len(t) - 2))], minlength=WIDTH).astype(float)
        return (v / np.linalg.norm(v)).tolist()

    return label.map(one)


def mention_slots(mentions: DataFrame, slots: int = 8, seed: int = 0) -> np.ndarray:
    """slots x width: centres of the labels' vectors, by k-means. mentions: label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = mentions.select(array_to_vector(label_vector(F.col("label"))).alias("features"))
    centres = np.array(KMeans(k=slots, seed=seed, maxIter=20).fit(rows).clusterCenters())
    return centres[np.lexsort(centres.T[::-1])]


def slot_features(mentions: DataFrame, key: str, centres: np.ndarray, top: int = 4, temperature: float = 0.35) -> DataFrame:
    """key, slot, presence (largest weight), mass (ln(1 + sum)), number (weighted mean of the values' numbers, null without any). mentions: key, label, value."""

    @F.pandas_udf("array<struct<slot:int,w:double>>")
    def weights(vector: pd.Series) -> pd.Series:
        d = ((np.stack(vector.to_list())[:, None] - centres[None]) ** 2).sum(2) if len(vector) else np.zeros((0, len(centres)))
        near = np.argsort(d, 1, kind="stable")[:, :top]
        score = np.exp((np.min(d, 1)[:, None] - np.take_along_axis(d, near, 1)) / temperature) if len(d) else np.zeros((0, top))
        share = score / score.sum(1)[:, None]
        return pd.Series([[{"slot": int(s), "w": float(w)} for s, w in zip(a, b, strict=True)] for a, b in zip(near, share, strict=True)])

    number = F.regexp_extract("value", r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    long = mentions.select(key, F.when(F.abs(number) <= 100_000, number).alias("x"), F.explode(weights(label_vector("label"))).alias("e")).select(key, "x", "e.slot", "e.w")
    has = F.col("x").isNotNull()
    return long.groupBy(key, "slot").agg(F.max("w").alias("presence"), F.log1p(F.sum("w")).alias("mass"), F.try_divide(F.sum(F.when(has, F.col("w") * F.col("x"))), F.sum(F.when(has, F.col("w")))).alias("number"))
