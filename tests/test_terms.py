"""Terms of texts, counted within batches, against plain counting."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from causeway.functions import scalar
from causeway.operators import encoding, terms, textmodels
from causeway.plans import catalog
from pyspark.sql import functions as F

SCHEMA = "id long, text string"


def terms_of(text):
    w = re.findall(r"[a-z0-9_]{2,}", (text or "").lower())
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def weights(rows, least, most, size):
    """Of rows as the SQL has them: those of one key are one text, each row counts as a text in n."""
    tf = {}
    for i, t in rows:
        tf.setdefault(i, Counter()).update(terms_of(t))
    df, total, n = Counter(k for x in tf.values() for k in x), sum(tf.values(), Counter()), len(rows)
    kept = sorted((k for k, c in df.items() if least <= c <= most * n), key=lambda k: (-total[k], k))[:size]
    raw = {i: {k: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[k])) + 1) for k, c in x.items() if k in kept} for i, x in tf.items()}
    return {(i, k): v / math.sqrt(sum(z * z for z in x.values())) for i, x in raw.items() for k, v in x.items()}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    word = lambda: f"w{int(r.zipf(1.4)) % 300}"
    texts = [" ".join(word() for _ in range(r.integers(0, 40))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "a b É_x w1éw2 W1-w1"), (1003, "w1"), (1004, "w2w1\x00w3 w1")]


def compared(spark, rows, size):
    got = {(r.id, r.term): r.weight for r in encoding.tfidf(spark.createDataFrame(rows, SCHEMA), "id", "text", 2, 0.5, size).collect()}
    want = weights(rows, 2, 0.5, size)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("buckets", [1 << 8, 1 << 20])
def test_weights_are_exact_however_full_the_buckets_are(spark, rows, buckets, monkeypatch):
    monkeypatch.setattr(terms, "BUCKETS", 1 << 20)
    if buckets < 1 << 20:  # all terms share few buckets, so bounds are loose and more rounds are needed
        monkeypatch.setattr(terms, "_bucket", lambda h: (h >> np.uint64(60)).astype(np.int64) % 5)
    compared(spark, rows, 40)
    monkeypatch.setattr(terms, "BYTES", 100)
    compared(spark, rows, 100_000)


def test_rows_of_one_key_are_one_text(spark, rows):
    compared(spark, rows + [(i % 5, t) for i, t in rows[20:40]] + [(None, t) for _, t in rows[:7]], 60)


def test_texts_are_not_shuffled(spark, rows):
    """Each term of each text was a row of two shuffles."""
    df = spark.createDataFrame(rows, SCHEMA)
    assert "Exchange" not in encoding.tfidf(df, "id", "text", 2)._jdf.queryExecution().executedPlan().toString()
    known = textmodels.fitted_terms(df, "text", 2)
    for out in (textmodels.term_vectors(df, "id", "text", known), textmodels.text_svd(df, df, "id", "text", 2, least=2)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_svd_keeps_rows_of_one_key_and_without_one(spark, rows):
    more = [*rows, *rows[:5], (None, "w1 w2"), (None, None)]
    out = textmodels.text_svd(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(more, SCHEMA), "id", "text", 3, least=2)
    assert out.count() == len(more) and out.where(F.col("svd_0").isNull()).count() == 0
    assert out.where("text is null and (svd_0 <> 0 or svd_1 <> 0)").count() == 0


def test_buckets_within_batches_are_those_of_the_expression(spark, rows, monkeypatch):
    monkeypatch.setattr(terms, "BYTES", 300)
    odd = [*rows, (2000, "é\x00\x1c x　y\x0bz 中文 a_b_1 😀 don't"), (2001, " \t"), (2002, None)]
    docs = spark.createDataFrame(odd, SCHEMA).select("id", F.lower("text").alias("text"), catalog.ids().alias("x"))
    want = {(r.id, b) for r in docs.where("text is not null").select("id", scalar.ngram_buckets(F.col("x"), 4096).alias("b")).collect() for b in r.b}
    often, n = Counter(b for _, b in want), len(odd)
    want = {(i, b) for i, b in want if 2 <= often[b] <= n - 2}
    by_text = encoding.hashed_ngrams(docs, "id", "text", 4096, least=2, of=terms.token_ids(1000))
    for out in (by_text, encoding.hashed_ngrams(docs.where("text is not null or id = 2002"), "id", "x", 4096, least=2)):
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert "Exchange" not in by_text._jdf.queryExecution().executedPlan().toString()  # each bucket of a document was a row of two shuffles
    twice = encoding.hashed_ngrams(docs.unionByName(docs), "id", "text", 4096, least=2, of=terms.token_ids(1000))
    assert {tuple(r) for r in twice.collect()} == {(i, b) for i, b in {(i, b) for i, b in _all(docs)} if 2 <= often[b] <= 2 * n - 2} and twice.count() == twice.distinct().count()
    assert encoding.hashed_ngrams(docs.limit(0), "id", "x", 64).count() == 0


def _all(docs):
    return {(r.id, r.bucket) for r in terms.bucketed(docs, "id", "text", terms.token_ids(1000), 4096, (1, 2, 3)).collect()}
