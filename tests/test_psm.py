"""The matching report on a simulated cohort with a known effect."""

import json

from causeway.operators import simulation
from causeway.plans import psm
from pyspark.sql import functions as F


def test_report(spark, tmp_path):
    base = simulation.characteristics(spark, 3000, ["x1"])
    df = simulation.simulate(base, simulation.Equation(0.0, {"x1": 1.0}), simulation.Equation(-0.5, {"x1": 1.0}, effect=1.0), positivity=(0.05, 0.95)).persist()
    truth = df.where("treatment = 1").agg(F.avg("true_ite")).first()[0]
    found = psm.report(df, "unit_id", "treatment", "outcome", "true_propensity", ["x1"], effect="true_ite")
    out = {r["method"]: r for r in found.estimates.collect()}
    assert abs(out["matched"].estimate - truth) < 0.06 and out["matched"].p < 0.001 and out["matched"].lower < truth < out["matched"].upper
    assert abs(out["weighted"].estimate - df.agg(F.avg("true_ite")).first()[0]) < 0.06
    assert out["crude"].estimate > out["matched"].estimate
    balance = found.balance.first()
    assert balance.smd_after < 0.1 < balance.smd_before
    psm.save(found, str(tmp_path / "r"))
    summary = json.loads(spark.read.text(str(tmp_path / "r" / "summary")).first()[0])
    assert len(summary["estimates"]) == 5 and spark.read.csv(str(tmp_path / "r" / "sensitivity"), header=True).count() == 8
