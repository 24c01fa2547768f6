"""Extraction behind fakes, its cache, a configured run from end to end, and streams."""

import json

import pytest
from causeway.operators import encoding, extraction
from causeway.plans.experiment import ExperimentConfig, run
from causeway.streaming import scoring
from pyspark.sql import functions as F

SPECS = [encoding.FeatureSpec("ecog", "categorical", ("0", "1", "2")), encoding.FeatureSpec("age", "continuous")]


class Flaky:
    """Answers badly at first; the category comes in another case."""

    name = "flaky"

    def client(self):
        calls = []

        def ask(texts):
            calls.append(1)
            return ["no json" if len(calls) == 1 else json.dumps({"stage": "iii", "size": "12.5"}) if len(calls) == 2 else "{}" for _ in texts]

        return ask


def test_parse():
    assert extraction.parse('x {"ecog": 1, "age": "61"} y', SPECS) == {"ecog": "1", "age": 61.0}
    assert extraction.parse('{"ecog": "9", "age": "nan"}', SPECS) == {"ecog": None, "age": None}
    assert extraction.parse(None, SPECS) == extraction.parse("{bad}", SPECS) == {"ecog": None, "age": None}


def test_best_partial_answer_is_kept(spark):
    specs = [encoding.FeatureSpec("stage", "categorical", ("II", "III")), encoding.FeatureSpec("size", "continuous"), encoding.FeatureSpec("never", "continuous")]
    r = extraction.extract(spark.createDataFrame([(1, "t")], "id long, t string").coalesce(1), "t", specs, Flaky()).first()
    assert (r.explicit_feat_stage, r.explicit_feat_size, r.explicit_feat_never_missing) == ("III", 12.5, True)


def test_servers_take_turns_and_broken_runs_go_on(spark):
    df = spark.createDataFrame([(i, f"age {i} and ecog 1") for i in range(20)], "id long, t string")
    done = extraction.extract_in_turn(df, "id", 3, "t", SPECS, extraction.KeywordProvider(SPECS), prefix="explicit_conf_")
    assert done.rdd.getNumPartitions() == 3 and {r.id: (r.explicit_conf_age, r.explicit_conf_ecog) for r in done.collect()} == {i: (float(i), "1") for i in range(20)}
    assert sorted(r.id for r in extraction.remaining(df, done.where("id < 15"), "id").collect()) == [15, 16, 17, 18, 19]


def test_cache_key():
    a = extraction.cache_key("d", SPECS, "p")
    assert len(a) == 25 and a == extraction.cache_key("d", SPECS, "p")
    assert len({a, extraction.cache_key("e", SPECS, "p"), extraction.cache_key("d", SPECS[:1], "p"), extraction.cache_key("d", SPECS, "p", tokens=5)}) == 4


def test_config():
    with pytest.raises(ValueError, match="no longer"):
        ExperimentConfig.from_dict({"dataset": "a", "output": "b", "explicit_confounders": {}})
    with pytest.raises(ValueError, match="outcome_type"):
        ExperimentConfig.from_dict({"dataset": "a", "output": "b", "outcome_type": "count"})
    assert ExperimentConfig("a", "b").hash() != ExperimentConfig("a", "c").hash()


def test_run(spark, tmp_path):
    n = F.pmod(F.xxhash64("row_id"), F.lit(60)) + 20
    e = F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(3))
    df = spark.range(600).withColumnRenamed("id", "row_id").withColumn("clinical_text", F.format_string("Patient with age %d and ecog %d.", n, e)).withColumn("treatment_indicator", (F.pmod(F.xxhash64("row_id", F.lit(2)), F.lit(10)) < 3 + e).cast("int")).withColumn("outcome_indicator", (F.pmod(F.xxhash64("row_id", F.lit(3)), F.lit(10)) < 3 + 2 * F.col("treatment_indicator")).cast("int"))
    df.write.parquet(str(tmp_path / "cohort.parquet"))
    config = ExperimentConfig.from_dict({"dataset": str(tmp_path / "cohort.parquet"), "output": str(tmp_path / "out"), "cache": str(tmp_path / "cache"), "bags": 4, "features": [{"name": "ecog", "kind": "categorical", "categories": ["0", "1", "2"], "roles": ["confounder"]}, {"name": "age", "kind": "continuous", "roles": ["effect_modifier"]}]})
    summary = run(spark, config)
    out = spark.read.parquet(str(tmp_path / "out" / "predictions"))
    assert out.count() == 600 and out.where("explicit_feat_age_missing or explicit_feat_ecog_missing").count() == 0
    assert out.where("pred_y0_prob between 0 and 1 and pred_y1_prob between 0 and 1 and cv_fold between 1 and 3 and pred_ite_lower <= pred_ite_upper").count() == 600
    assert 0.0 < summary["mean"] < 0.4 and summary["config_hash"] == config.hash()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, lambda b: b.withColumn("score", F.col("value") * 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == events.count() and out.select("batch").distinct().count() == 2
    q = scoring.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="1000 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()
