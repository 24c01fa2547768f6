"""A configured run: table, features, cross-fitted nuisances, forest, predictions and a summary."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import cohort, encoding, extraction, reports
from causeway.plans import arms

SECTIONS = ("data", "columns", "training", "extraction")
REMOVED = ("explicit_confounders", "confounder_forest")


@dataclass(frozen=True)
class ExperimentConfig:
    dataset: str
    output: str
    features: list[dict] = field(default_factory=list)
    key: str = "row_id"
    text: str = "clinical_text"
    treatment: str = "treatment_indicator"
    outcome: str = "outcome_indicator"
    outcome_type: str = "binary"
    folds: int = 3
    bags: int = 12
    model: str = "explicit_forest"
    options: dict = field(default_factory=dict)
    trim: list[float] | None = None
    cache: str | None = None
    seed: int = 42

    @classmethod
    def from_dict(cls, data: dict) -> ExperimentConfig:
        data = dict(data)
        for section in SECTIONS:  # nested sections name the same keys
            inner = data.pop(section, {})
            if both := sorted(set(inner) & set(data)):
                raise ValueError(f"given twice: {', '.join(both)}")
            data |= inner
        if gone := [k for k in REMOVED if k in data]:
            raise ValueError(f"no longer supported: {', '.join(gone)}; use features")
        if unknown := set(data) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        out = cls(**data)
        if out.outcome_type not in ("binary", "continuous"):
            raise ValueError(f"unknown outcome_type {out.outcome_type}")
        if out.model not in arms.MODELS:
            raise ValueError(f"unknown model {out.model}: {', '.join(sorted(arms.MODELS))}")
        if out.folds < 2:
            raise ValueError("folds must be 2 or more")
        return out

    def hash(self) -> str:
        return hashlib.md5(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]

    def specs(self) -> list[encoding.FeatureSpec]:
        return encoding.merged([encoding.FeatureSpec(f["name"], f["kind"], tuple(f.get("categories", ())), tuple(f.get("roles", ("confounder", "effect_modifier"))), f.get("description", "")) for f in self.features])


def predict(spark: SparkSession, config: ExperimentConfig, provider: extraction.Provider | None = None) -> DataFrame:
    """The table with cv_fold, out-of-fold pred_* columns and intervals; rows outside `trim` propensities are left out."""
    df = cohort.load_dataset(spark, config.dataset)
    cohort.validate(df, config.text, config.treatment, config.outcome)
    if not (specs := config.specs()):
        raise ValueError("no features")
    if missing := [s for s in specs if extraction.PREFIX + s.name not in df.columns]:
        asked = provider or extraction.KeywordProvider(missing)
        df = extraction.cached_extract(spark, config.cache, config.dataset, df, config.text, missing, asked) if config.cache else extraction.extract(df, config.text, missing, asked)
    c = arms.Columns(config.key, config.text, config.treatment, config.outcome, config.outcome_type == "binary")
    how = {"folds": config.folds, "prefix": extraction.PREFIX, "seed": config.seed} | ({"bags": config.bags} if "forest" in config.model else {}) | config.options
    out = arms.run(config.model, df, c, specs, **how)
    if config.trim:
        out = cohort.trim_by_propensity(out, *config.trim, "pred_propensity")
    return out.withColumnsRenamed({"pred_y0": "pred_y0_prob", "pred_y1": "pred_y1_prob", "pred_propensity": "pred_propensity_prob", "pred_ite": "pred_ite_prob"}).drop("pred_outcome")


def run(spark: SparkSession, config: ExperimentConfig, provider: extraction.Provider | None = None) -> dict:
    """Writes predictions and a summary under config.output and returns the summary."""
    out = predict(spark, config, provider)
    out.write.mode("overwrite").parquet(f"{config.output}/predictions")
    done = spark.read.parquet(f"{config.output}/predictions")
    summary = reports.prediction_summary(done, "pred_ite_prob", "pred_ite_lower", "pred_ite_upper", "pred_propensity_prob").withColumn("config_hash", F.lit(config.hash()))
    summary.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{config.output}/summary")
    return summary.first().asDict()
