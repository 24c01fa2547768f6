"""Searches within outer folds: no held-out row in an inner fold, losses against NumPy, resumption."""

import json

import numpy as np
import pytest
from causeway.operators import cohort, search
from pyspark.sql import functions as F


def planted(spark, n=300):
    r = np.random.default_rng(3)
    rows = []
    for i in range(n):
        m, x, t = int(r.integers(3)), int(r.integers(3)), int(r.random() < 0.5)
        rows.append((i, f"m{m}", f"x{x}", t, 0.5, float(1 + (m - 1) * 2 * t + 0.3 * r.normal())))
    return spark.createDataFrame(rows, "id long, modifier string, noise string, t int, e double, y double")


def brute(rows, columns, fold):
    cell = lambda a: tuple(a[c] or "" for c in columns)
    mean = lambda xs, other: float(np.mean(xs)) if xs else float(np.mean(other))
    m = {a.id: mean([b.y for b in rows if b[fold] != a[fold] and cell(b) == cell(a)], [b.y for b in rows if b[fold] != a[fold]]) for a in rows}
    out = {}
    for a in rows:
        others = [b for b in rows if b[fold] != a[fold] and cell(b) == cell(a)]
        below = sum((b.t - b.e) ** 2 for b in others)
        tau = sum((b.t - b.e) * (b.y - m[b.id]) for b in others) / below if below else 0.0
        out.setdefault(a[fold], []).append((a.y - m[a.id] - (a.t - a.e) * tau) ** 2)
    return {f: float(np.mean(x)) for f, x in out.items()}


def test_losses_are_those_of_a_plain_loop(spark):
    df = cohort.folds(planted(spark, 150).withColumn("modifier", F.when(F.col("id") == 7, "alone").when(F.col("id") % 50 != 9, F.col("modifier"))), "id", 3)
    for columns in ([], ["modifier"], ["modifier", "noise"]):
        want = brute(df.collect(), columns, "cv_fold")
        got = {r.fold: r.r_loss for r in search.cell_losses(df, "cv_fold", columns, "y", "t", "e").collect()}
        assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], rel=1e-9) for f in want)


class Proposes:
    def __init__(self, fold, seen, breaks=None):
        self.fold, self.seen, self.breaks, self.turn = fold, seen, breaks, 0

    def propose(self, context):
        if self.fold == self.breaks:
            raise RuntimeError("lost")
        self.seen.append(self.fold)
        names, self.turn = (["noise"], ["modifier"])[self.turn], self.turn + 1
        return [{"action": "add", "name": n, "type": "categorical", "categories": ["a", "b"], "roles": ["effect_modifier"], "description": "at baseline"} for n in names]


def test_outer_folds_find_the_modifier_and_resume(spark, tmp_path):
    df, folder, seen, used = planted(spark), str(tmp_path / "outer"), [], []
    held = {r.id: r.cv_fold for r in cohort.folds(df, "id", 2, 42).collect()}

    def losses(d, fold, specs):
        if fold == "cv_fold":
            used.append(({r.id for r in d.select("id").collect()}, {r[0] for r in d.select("outer_fold").distinct().collect()}))
        return search.cell_losses(d, fold, [s.name for s in specs], "y", "t", "e")

    run = lambda breaks: search.outer_search(df, "id", [], lambda f: Proposes(f, seen, breaks), lambda d, specs: d, losses, folder, outer=2, inner=2, turns=2)
    with pytest.raises(RuntimeError, match="lost"):
        run(2)
    assert set(seen) == {1}
    found = {r.outer_fold: r for r in run(None).collect()}
    assert seen == [1, 1, 2, 2] and {f: r.features for f, r in found.items()} == {1: ["modifier"], 2: ["modifier"]}
    assert all(len(folds) == 1 and ids == {i for i, f in held.items() if f not in (3 - g for g in folds)} for ids, folds in used)
    rows = df.withColumn("half", F.lit(0)).collect()
    half = spark.createDataFrame([(*[r[c] for c in df.columns], int(held[r.id] == 1)) for r in rows], df.schema.add("half", "integer"))
    assert found[1].held_out_loss == pytest.approx(brute(half.collect(), ["modifier"], "half")[1], rel=1e-9)
    log = [json.loads(r.value) for r in spark.read.text(f"{folder}/decisions").collect()]
    assert {(d["outer_fold"], d["event"]) for d in log} == {(f, e) for f in (1, 2) for e in ("agent_proposals", "candidate_evaluations")}
    assert run(9).count() == 2 and len(seen) == 4
