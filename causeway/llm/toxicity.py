"""Toxicity: a counterfactual-regularised classifier.

A document is the set of its lower-case words and of their first three to seven letters, which catch inflected forms. Those that enough
documents of the labelled sample hold, the most telling `vocabulary` of them, make the vocabulary. The weights minimise logistic loss plus an
L2 penalty plus `fairness` times the mean squared change of the score's logit when each identity term in a labelled text gives way to another
of its group, so a neutral mention of a group moves the score as little as any other. The change is that of the whole text's logit: over all features that the swap takes away or brings in, first letters
included and those that another word of the text holds too left out; terms outside the vocabulary count with weight 0.

Training reads labelled rows alone, at most about `bound` of each class (a documented sample: rows whose hash falls under a rate; the
rate comes from counts over all labelled rows). Only the ids of that sample are broadcast, only its word counts and word ids reach the
driver. Scoring streams over all whole texts, without a shuffle; memory is the vocabulary and a batch.

Edge cases: a null or empty text has no words and scores as the intercept does; a null id belongs to no fold that is held out and trains
nothing; of repeated label rows the highest label counts, null labels don't; repeated documents are scored each for itself; without rows of
both classes the score is the smoothed share of label 1; other columns are neither read nor returned by toxicity_scores and carried along
by drop_toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import by_value, unused

by_value(__name__)

#: Groups of identity terms that may stand for one another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"), ("she", "he"),
    ("black", "white", "asian", "latino", "arab"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("femmes", "hommes"), ("femme", "homme"), ("mujeres", "hombres"), ("mujer", "hombre"), ("frauen", "männer"), ("frau", "mann"),
)
WORD = re.compile(r"\w+")
PREFIXES = range(3, 8)
BOUND, VOCABULARY, FOLDS, MEMO = 6000, 20_000, 5, 200_000


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def swaps_of(features: list[str], place: dict[str, int]) -> Iterator[tuple[tuple[int, ...], int]]:
    """For each identity term of a text and each other term of its group, what the swap brings in and takes away, as fit() has it, and the number of those others."""
    whole = set(features)
    held = None
    for group in IDENTITY:
        for w in group:
            if w not in whole:
                continue
            held = held or Counter(f for v in whole if not v.endswith("*") for f in features_of(v))
            lost = {f for f in features_of(w) if held[f] == 1}
            for o in group:
                if o != w:
                    new = features_of(o)
                    ids = [1 + place[f] for f in new if f not in whole and f in place] + [-1 - place[f] for f in lost.difference(new) if f in place]
                    if ids:
                        yield tuple(sorted(ids)), len(group) - 1


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(x: list[np.ndarray], y: np.ndarray, swaps: list[tuple[list[int], float]], size: int, weight: np.ndarray, ridge: float = 0.7, fairness: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of `size` words and the intercept. x: ids of the words in each text. swaps: the ids that a swap brings in, as 1 + id, and takes away, as -1 - id, and how many times it may happen."""
    index, of = np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(x)), [len(a) for a in x])
    n = len(x)
    pos, neg = (np.bincount(index, (weight * side)[of], size) for side in (y, 1 - y))
    ratio = np.log((pos + 0.5) / ((weight * y).sum() + 1)) - np.log((neg + 0.5) / ((weight * (1 - y)).sum() + 1))
    scale = np.abs(ratio)  # words that tell nothing can't add up over a long text
    changed = np.array([i for ids, _ in swaps for i in ids], np.int64)
    swap, sign, changed = np.repeat(np.arange(len(swaps)), [len(ids) for ids, _ in swaps]), np.sign(changed), np.abs(changed) - 1
    often = np.array([k for _, k in swaps], float) / max(1, n)
    u, c = np.sign(ratio) * 0.1, 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        w = u * scale
        z = np.bincount(of, w[index], n) + c
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        r = weight * (p - y)
        g = np.bincount(index, r[of], size)
        if len(changed):
            change = fairness * often * np.bincount(swap, sign * w[changed], len(swaps))
            g += np.bincount(changed, sign * change[swap], size) * weight.sum()
        grad = np.append(g * scale + ridge * u, r.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        u, c = u - move[:-1], c - move[-1]
    return u * scale, float(c)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BOUND, vocabulary: int = VOCABULARY, fairness: float = 10.0) -> tuple[dict[str, float], float]:
    """Word weights and intercept, from labelled rows that are not held out."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    sizes = {r["__y"]: r["count"] for r in ids.groupBy("__y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return {}, math.log((n1 + 0.5) / (n0 + 0.5))
    rate = F.when(F.col("__y") == 1, bound / n1).otherwise(bound / n0)
    u = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = F.broadcast(ids.where(u < rate))  # about 2 * bound ids at most
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).where(F.col("__text").isNotNull())

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                found = [sorted({f for w in words_of(t) for f in features_of(w)}) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["y", "words"])

    bags = texts.join(sample, "__id").select("__y", "__text").mapInArrow(tokens, "y int, words array<string>").cache()
    try:
        n, pos = (float(bags.where(c).count()) for c in ("true", "y = 1"))
        neg = n - pos
        if not pos or not neg:
            return {}, math.log((n1 + 0.5) / (n0 + 0.5))
        each = bags.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where(F.col("n") >= 2)
        tell = F.abs(F.ln((F.col("p") + 0.5) / (pos + 1)) - F.ln((F.col("n") - F.col("p") + 0.5) / (neg + 1))) * F.sqrt("n")
        known = [r["word"] for r in each.orderBy(tell.desc(), "word").limit(vocabulary).select("word").collect()]
        place = {w: i for i, w in enumerate(known)}

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [[place[w] for w in ws if w in place] for ws in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "x"])

        def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                many = Counter(swap for ws in b.column(1).to_pylist() for swap in swaps_of(ws, place))
                yield pa.RecordBatch.from_arrays([pa.array([list(ids) for ids, _ in many], pa.list_(pa.int32())), pa.array([k for _, k in many], pa.int32()), pa.array(many.values(), pa.int64())], ["ids", "others", "times"])

        rows = bags.mapInArrow(number, "y int, x array<int>").toArrow()
        counted = bags.mapInArrow(swapped, "ids array<int>, others int, times long").groupBy("ids", "others").agg(F.sum("times").alias("times")).collect() if fairness else []
    finally:
        bags.unpersist()
    y = np.array(rows.column("y").to_pylist(), float)
    x = [np.array(a, np.int64) for a in rows.column("x").to_pylist()]
    weight = np.where(y == 1, n1 / max(1.0, y.sum()), n0 / max(1.0, (1 - y).sum()))
    swaps = [(r["ids"], r["times"] / r["others"]) for r in sorted(counted)]
    w, c = fit(x, y, swaps, len(place), weight * len(y) / weight.sum(), fairness=fairness)
    return {k: float(v) for k, v in zip(known, w, strict=True) if abs(v) > 1e-4}, c


def toxicity_scores(docs: DataFrame, weights: dict[str, float], intercept: float, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns named in carry and score, the probability of label 1, for each row of docs."""
    kept = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(unused(docs, "whole_text")), *[F.col(f"`{c}`") for c in (id_col, *carry)])
    schema = T.StructType([*kept.schema.fields[1:], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}

        def logit(text: str) -> float:
            found: set[str] = set()
            for w in words_of(text):
                if (own := memo.get(w)) is None:
                    own = memo[w] = tuple(f for f in features_of(w) if f in weights)
                if own:
                    found.update(own)
            if len(memo) > MEMO:
                memo.clear()
            return intercept + sum(weights[f] for f in sorted(found))

        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                z = np.array([logit(t.as_py()) for t in part.column(0)], float)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], schema.names)

    return kept.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = BOUND, carry: tuple[str, ...] = ()) -> DataFrame:
    return toxicity_scores(docs, *learn(docs, labels, id_col, text_col, label_col, bound), id_col, text_col, carry)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns, whatever their names."""
    other = unused(docs, "given_score")  # a column `score` of docs steps aside
    given = {c: other if c == "score" else c for c in docs.columns}
    moved = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in given.items()])
    scored = toxicity_scores(moved, *learn(docs, labels, id_col, text_col), given[id_col], given[text_col], tuple(n for c, n in given.items() if c != id_col))
    return scored.where(F.col("score") < threshold).select(*[F.col(f"`{n}`").alias(c) for c, n in given.items()])
