"""Queries over whole tables, without SQL, against brute force."""

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from causeway.operators import matching, tables
from causeway.plans import catalog, cohorts
from pyspark.sql import functions as F

from tests.conftest import SF


@pytest.fixture(scope="module")
def arms(spark):
    units = cohorts.orders(spark, SF).select("unit_id", "t", "e", "y", "y_high", "c_mktsegment", "band").toPandas().sort_values("unit_id")
    return units[units.t == 1].reset_index(drop=True), units[units.t == 0].reset_index(drop=True)


def test_matching_covers_all_orders(spark, arms):
    a, b = arms
    assert len(a) + len(b) == spark.read.parquet(f"{SF}/orders.parquet").count()
    d = np.abs(a.e.to_numpy()[:, None] - b.e.to_numpy()[None])
    near = d <= 0.0005
    one = catalog.QUERIES["j6_band_pairs"](spark, SF).first()
    assert one.n == near.sum() and one.total == pytest.approx(d[near].sum(), abs=1e-5)
    want = {}
    for i, tid in enumerate(a.unit_id):
        want[tid] = [(int(b.unit_id[j]), round(float(d[i, j]), 9)) for j in sorted(np.flatnonzero(near[i]), key=lambda j: (d[i, j], b.unit_id[j]))[:3]]
    got = {tid: [] for tid in a.unit_id}
    for r in sorted(catalog.QUERIES["j3_nearest_controls"](spark, SF).collect(), key=lambda r: (r.treated_id, r["rank"])):
        got[r.treated_id].append((r.control_id, pytest.approx(r.distance, abs=2e-9)))
    assert got == want
    y0, high0 = b.set_index("unit_id").y, b.set_index("unit_id").y_high
    pairs = [(i, want[tid][0][0]) for i, tid in enumerate(a.unit_id) if want[tid]]
    found = catalog.QUERIES["a4_att_matched"](spark, SF).first()
    assert found.n_pairs == len(pairs) and found.att == pytest.approx(np.mean([a.y[i] - y0[c] for i, c in pairs]), abs=1e-3)
    up, down = (sum(a.y_high[i] - high0[c] == s for i, c in pairs) for s in (1, -1))
    odd = catalog.QUERIES["a9_mcnemar"](spark, SF).first()
    assert (odd.b, odd.c) == (up, down)
    change = catalog.QUERIES["a2_balance_change"](spark, SF).first()
    all_balance = catalog.QUERIES["a1_balance"](spark, SF).where("covariate = 'c_acctbal'").first()
    assert change.smd_before == pytest.approx(all_balance.smd, abs=1e-6)


def test_queries_without_sql_cover_all_orders(spark, arms):
    a, b = arms
    report = {r.method: r.estimate for r in catalog.QUERIES["a35_matching_report"](spark, SF).collect()}
    assert report["crude"] == pytest.approx(a.y_high.mean() - b.y_high.mean(), abs=1e-4)
    few = {k: len(g) for k, g in b.groupby(["c_mktsegment", "band"])}
    most = sum(min(len(g), few.get(k, 0)) for k, g in a.groupby(["c_mktsegment", "band"]))
    found = catalog.QUERIES["j4_optimal_pairs"](spark, SF).collect()
    assert 0.9 * most < len(found) <= most and all(r.distance <= 0.05 for r in found)


def test_line_assignment_is_the_best_assignment():
    r = np.random.default_rng(4)
    for n, m, caliper in [(1, 1, None), (4, 9, None), (9, 4, 0.1), (30, 30, 0.02), (25, 60, 0.01), (40, 20, None), (30, 31, 0.0), (0, 3, None)]:
        for digits in (1, 2, 6):
            a, b = np.sort(np.round(r.random(n), digits)), np.sort(np.round(r.random(m), digits))
            pairs = matching.line_assignment(a, b, caliper)
            assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            d = np.abs(a[:, None] - b[None])
            cost = np.where(d > caliper, 1000.0, d) if caliper is not None else d
            every = matching.assignment(cost) if n <= m else [(i, j) for j, i in matching.assignment(cost.T)]
            best = [d[i, j] for i, j in every if cost[i, j] < 999]
            assert len(pairs) == len(best) and sum(d[i, j] for i, j in pairs) == pytest.approx(sum(best))
            assert caliper is None or all(d[i, j] <= caliper for i, j in pairs)


def tokens_of(text):
    return re.findall(r"[a-z0-9]+|[^\t\n\x0b\f\r ]", text.lower())


def ids_of(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 1000 for w in tokens_of(text)]


def all_of(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_document_queries_cover_all_texts(spark, texts):
    assert {r.doc_id: r.text_hash for r in all_of(spark, "f4_text_hash")} == {i: hashlib.sha1(re.sub(r"[\t\n\x0b\f\r ]+", " ", t).strip(" ").encode()).hexdigest() for i, t in texts.items()}
    ids = {i: ids_of(t) for i, t in texts.items()}
    chunks = {(r.doc_id, r.i): r.chunk for r in all_of(spark, "w4_chunks")}
    assert chunks == {(i, k): json.dumps(x[k : k + 64], separators=(",", ":")) for i, x in ids.items() for k in range(0, max(len(x), 1), 48)}
    assert {r.doc_id: r.checksum for r in all_of(spark, "p10_token_window")} == {i: sum(x if len(x) <= 32 else x[:16] + x[-16:]) for i, x in ids.items()}

    def bucket(gram):
        n = len(gram)
        h = gram[0] * 1_000_003 + 9_176 if n == 1 else sum(g * (1_000_003 + 9_176 * (j + 1)) for j, g in enumerate(gram)) + 19_260_817 * n
        return h % 32_768

    found = {i: {bucket(x[k : k + n]) for n in (1, 2, 3) for k in range(len(x) - n + 1)} or {0} for i, x in ids.items()}
    often = Counter(b for x in found.values() for b in x)
    assert {(r.doc_id, r.bucket) for r in all_of(spark, "m4_hashed_ngrams")} == {(i, b) for i, x in found.items() for b in x if 5 <= often[b] <= len(ids) - 5}
    words = {i: tokens_of(t) for i, t in texts.items()}
    counts = Counter(w for x in words.values() for w in x)
    known = sorted((w for w, n in counts.items() if n >= 2), key=lambda w: (-counts[w], w.encode()))[:49_998]
    place = {w: k + 2 for k, w in enumerate(known)}
    assert {r.doc_id: json.loads(r.ids) for r in all_of(spark, "f2_token_ids")} == {i: [place.get(w, 1) for w in x] for i, x in words.items()}


def test_tfidf_covers_all_texts(spark, texts):
    tf = {}
    for i, t in texts.items():
        w = re.findall(r"[a-z0-9_]{2,}", t.lower())
        tf[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df, total = Counter(k for x in tf.values() for k in x), sum(tf.values(), Counter())
    n = len(texts)
    kept = set(sorted((k for k, c in df.items() if 5 <= c <= 0.95 * n), key=lambda k: (-total[k], k))[:10_000])
    raw = {i: {k: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[k])) + 1) for k, c in x.items() if k in kept} for i, x in tf.items()}
    got = {(r.doc_id, r.term): r.weight for r in all_of(spark, "m1_tfidf")}
    want = {(i, k): v / math.sqrt(sum(z * z for z in x.values())) for i, x in raw.items() for k, v in x.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items()) and len(kept) > 300


HEAD = """Extract these features, as known before treatment, and answer with one flat JSON object; use null where the text doesn't say.
- ecog_status (categorical: one of 0, 1, 2): performance status at baseline
- age (continuous): age

Text:
"""


def test_turn_queries_cover_all_turns(spark):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()}
    assert {(r.conv_id, r.turn): r.checksum for r in all_of(spark, "f25_byte_ids")} == {k: sum(b + 1 for b in t.encode()[: 512 * 128]) for k, t in turns.items()}
    assert {(r.conv_id, r.turn): r.prompt for r in all_of(spark, "f23_prompt")} == {k: HEAD + t[:8000] for k, t in turns.items()}
    few = spark.createDataFrame([("",), ("aé",)], "t string").select(tables.byte_ids(F.col("t"), 2).alias("b")).collect()
    assert [r.b for r in few] == [[], [98, 196]]
