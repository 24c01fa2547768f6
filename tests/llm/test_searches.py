"""Source divergence, pivot search and hard negatives against brute force in whole numbers, on hard rows and on empty tables."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from causeway.llm import hard_negatives, pivot_search, source_divergence, vector_blocks
from pyspark.sql import functions as F

NONE = 1 << 63  # where a null id sorts


def vectors(r, copies=40):
    """(vec_id, embedding, label): ties, copies, repeated ids and rows, null ids, nulls, non-finite and empty and short and zero and huge vectors."""
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6) / 8], int(r.integers(0, 3))) for i in range(160)]
    hot = [0.25, -0.5, 0.125, 0.5, 0.0, 0.375]
    rows += [(200 + i, hot, i % 3) for i in range(copies)]
    rows += [(50, rows[3][1], 1), (50, rows[3][1], 1), (100, hot, 2), (100, hot, 2), (None, hot, 1), (None, rows[5][1], 0)]
    rows += [(300, None, 1), (350, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (400, [float("nan")] * 6, 1), (450, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0], 2), (500, [], 1), (550, [0.5, 0.25], 0), (600, [0.0] * 6, 2), (650, [1e-9] * 6, None), (700, [1e150] * 6, 1), (750, [1e307] * 6, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def quantized(rows, labelled=False):
    out = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v) or labelled and label is None:
            continue
        out.append((NONE if i is None else i, [int(math.floor(256 * x)) if abs(256 * x) < 2**52 else int(256 * x) for x in v], label))
    return out


def product(a, b):
    s = sum(x * y for x, y in zip(a, b))
    return max(-vector_blocks.MOST, min(vector_blocks.MOST, s))


def null(i):
    return None if i == NONE else i


def nearest(rows, k, every):
    out = Counter()
    for n, (i, v, _) in enumerate(rows):
        if i != NONE and i % every == 0:
            best = sorted((-product(v, w), j, m) for m, (j, w, _) in enumerate(rows) if m != n)[:k]
            out.update((i, rank + 1, null(j), -s) for rank, (s, j, _) in enumerate(best))
    return out


@pytest.mark.parametrize(("block", "rings", "first"), [(4096, 65_536, 8), (8, 65_536, 1), (8, 4, 2)])
def test_pivot_search_equals_brute_force(spark, monkeypatch, block, rings, first):
    """With one block, with many and several rounds, and with annuli that stand for runs of blocks."""
    for name, value in (("FEWEST", min(block, 256)), ("BLOCK", block), ("GROUP", 7 if block < 256 else 1024)):
        monkeypatch.setattr(vector_blocks, name, value)
    monkeypatch.setattr(pivot_search, "RINGS", rings)
    monkeypatch.setattr(pivot_search, "FIRST", first)
    rows = vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1.5)).repartition(3)
    out = Counter(tuple(r) for r in pivot_search.search(df).collect())
    assert out == nearest(quantized(rows), 5, 50)


def test_pivot_search_skips_what_is_provably_worse(spark, monkeypatch):
    """On clusters the bounds leave few annuli, and results stay whole; fewer candidates than asked for give fewer rows."""
    monkeypatch.setattr(vector_blocks, "FEWEST", 16)
    monkeypatch.setattr(vector_blocks, "BLOCK", 16)
    r = np.random.default_rng(2)
    centres = np.eye(20)
    rows = [(i, [float(x) for x in centres[i % 20] + r.normal(0, 0.01, 20)], 0) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    planned = []
    real = vector_blocks.meet

    def counting(left, right, *rest):
        planned.append(left.count())
        return real(left, right, *rest)

    monkeypatch.setattr(vector_blocks, "meet", counting)
    out = Counter(tuple(x) for x in pivot_search.search(df, k=3).collect())
    assert out == nearest(quantized(rows), 3, 50)
    assert sum(planned) < 60  # of some 80 blocks for each group of queries
    few = pivot_search.search(df.where("vec_id in (50, 51, 52)")).collect()
    assert sorted(x.rank for x in few) == [1, 2]


def test_bounds_hold(spark):
    r = np.random.default_rng(3)
    x, q = np.floor(r.normal(0, 90, (500, 8))), np.floor(r.normal(0, 90, (60, 8)))
    pivots = pivot_search._units(r.normal(0, 1, (5, 8)))
    a = pivot_search.angles(x, pivots)
    for p in range(5):
        part = x[a.argmin(1) == p]
        own = a[a.argmin(1) == p, p]
        norms = np.linalg.norm(part, axis=1)
        ring = {"low": np.array([own.min()]), "high": np.array([own.max()]), "least": np.array([norms.min()]), "most": np.array([norms.max()])}
        assert ((q @ part.T).max(1) <= pivot_search.upper(pivot_search.angles(q, pivots)[:, [p]], np.linalg.norm(q, axis=1), ring)[:, 0]).all()


def test_products_are_exact():
    for scale in (1.0, 1e6, 1e12, 1e200):
        r = np.random.default_rng(4)
        q, x = np.floor(r.normal(0, 100, (9, 5)) * scale), np.floor(r.normal(0, 100, (11, 5)) * scale)
        want = [[product([int(c) for c in a], [int(c) for c in b]) for b in x.tolist()] for a in q.tolist()]
        assert vector_blocks.products(q, x).tolist() == want


def mined(rows, every=100, k=5):
    out = Counter()
    for n, (i, v, label) in enumerate(rows):
        if i == NONE or i % every:
            continue
        scored = sorted((-product(v, w), j, m, other) for m, (j, w, other) in enumerate(rows) if m != n)
        for p, pid, _, _ in [x for x in scored if x[3] == label][:k]:
            window = [x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out.update((i, null(pid), rank + 1, null(j), -p, -s) for rank, (s, j, _, _) in enumerate(window))
    return out


@pytest.mark.parametrize(("block", "digit"), [(4096, 10), (8, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, digit):
    for name, value in (("FEWEST", min(block, 256)), ("BLOCK", block), ("GROUP", 2 if block < 256 else 1024)):
        monkeypatch.setattr(vector_blocks, name, value)
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    monkeypatch.setattr(hard_negatives, "STRIPE", 2)
    rows = vectors(np.random.default_rng(6), copies=90)
    rows += [(1000 + 100 * i, [float(x) for x in np.random.default_rng(i).integers(-3, 4, 6) / 8], i % 3) for i in range(20)] + [(5000, [0.1] * 6, 77)]
    if block < 256:
        rows = [x for x in rows if x[0] != 700]  # else its scores ask for 20 passes
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).repartition(3)
    out = Counter(tuple(r) for r in hard_negatives.hard_negatives(df).collect())
    want = mined(quantized(rows, True))
    assert out == want and len(want) > 100


def test_vector_queries_on_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for df in (none, spark.createDataFrame([(50, None, 1), (None, [1.0], 1), (7, [1.0], None)], SCHEMA)):
        assert pivot_search.search(df).collect() == [] and hard_negatives.hard_negatives(df).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0], 1)], SCHEMA)
    assert pivot_search.search(one).collect() == [] and hard_negatives.hard_negatives(one).collect() == []


# divergence


def divergence(rows, least, most):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(lower))
        groups[lang].add(source)
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        size = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + math.floor(Fraction(10**9 * (n[lang, s][t] + 5), size[s] + 5 * len(kept))) for t in kept} for s in sources}
        q = {t: 1 + math.floor(Fraction(10**9 * (sum(n[lang, s][t] for s in sources) + 5), sum(size.values()) + 5 * len(kept))) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:most]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(ranked)}
    return out


def texts(r):
    words = ["Été", "naïve", "über", "x", "THE", "the", "Of", "ſharp", "中文", "😀"] + ["".join(r.choice(list("abcde"), 3)) for _ in range(60)]
    rows = [(" ".join(r.choice(words, int(r.integers(0, 40)))) + "1a_b-c", str(r.choice(["en", "de"])), f"s{int(r.integers(0, 9))}") for _ in range(300)]
    rows += [("the " * 3000, "en", "long"), (None, "en", None), ("", None, "s1"), (None, None, None), ("a b", "fr", "only"), ("a b", "fr", "only"), ("1 2 3", "xx", "p"), ("4", "xx", "q"), ("\x01[]`{|", "xx", "r")]
    return rows


@pytest.mark.parametrize(("tile", "chunk", "held"), [(512, 1_000_000, 500_000), (3, 20, 10)])
def test_divergence_equals_brute_force(spark, monkeypatch, tile, chunk, held):
    """As it runs, and with tiles of three sources, many chunks and small pieces of counts."""
    for name, value in (("TILE", tile), ("CHUNK", chunk), ("HELD", held), ("SALTS", 2 if tile == 3 else 32)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = texts(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("item", F.lit(1)).withColumn("rank", F.lit("x")).repartition(4)
    for least, most in ((5, 50), (1, 7)):
        out = source_divergence.source_divergence(df, least_docs=least, terms=most).collect()
        assert {tuple(r) for r in out} == divergence(rows, least, most) and len(out) == len({tuple(r) for r in out})
    assert source_divergence.source_divergence(df.limit(0)).collect() == []


def test_shares_of_large_counts(spark):
    """Exact where counts times a billion leave 64 bits."""
    cases = [(0, 5), (10**12, 10**15), (999_999_999_999_937, 10**15 + 37), (7, 10**15), (10**15, 10**15 + 5)]
    want = [1 + 10**9 * (n + 5) // t for n, t in cases]
    assert source_divergence.shares(np.array([c[0] for c in cases]), np.array([c[1] for c in cases])).tolist() == want
    rows = spark.createDataFrame(cases, "n long, t long").select(source_divergence.share(F.col("n"), F.col("t")).alias("p")).collect()
    assert [r.p for r in rows] == want
