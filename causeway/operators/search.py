"""Feature search: which proposals may be tried, how candidates compare, what is told to the agent, and the search itself."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions.workers import by_value
from causeway.operators import cohort
from causeway.operators.encoding import FeatureSpec
from causeway.sources.tables import exists

by_value(__name__)

#: Terms by which a proposal would read the outcome or what came after treatment, and what makes it a baseline variable.
POST_TREATMENT = ("post-treatment", "post treatment", "after treatment", "after therapy", "after systemic therapy", "post therapy", "future imaging", "follow-up imaging")
OUTCOME = (
    "treatment response", "response to", "response category", "objective response", "radiographic response", "complete response", "partial response", "stable disease", "progressive disease",
    "survival", "progression-free", "progression free", "overall survival", "mortality", "death", "recurrence", "relapse", "toxicity", "adverse event",
)
RATIONALE = ("post-treatment", "post treatment", "after treatment", "after therapy", "future imaging", "survival after", "progression after", "toxicity after")
SAFE = (
    "age", "sex", "gender", "race", "ethnicity", "smoking", "pack year", "ecog", "performance status", "comorbidity", "histology", "stage", "tumor", "metastasis", "metastatic",
    "biomarker", "pdl1", "pd l1", "egfr", "alk", "kras", "ros1", "braf", "met", "ret", "ntrk", "lab", "laboratory", "neutrophil", "lymphocyte", "albumin", "hemoglobin", "creatinine", "ldh",
)
ANCHORS = ("baseline", "pre-treatment", "pre treatment", "pretreatment", "before treatment", "prior to treatment", "at diagnosis", "at presentation", "treatment initiation")

LEAK = "post_treatment_or_outcome_leakage"


def plain(text: Column) -> Column:
    """Lower case, - and _ as spaces, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[_-]+", " "), r"\s+", " "))


def holds(text: Column, terms: tuple[str, ...]) -> Column:
    squeezed = sorted({re.sub(r"[_-]+", " ", t) for t in terms})
    return F.exists(F.array(*[F.lit(t) for t in squeezed]), lambda t: F.contains(text, t))


def leakage(name: Column, description: Column, rationale: Column | None = None, risk: Column | None = None) -> Column:
    """Why a proposal leaks, or null.

    A high stated risk; a term after treatment in the name or description; an outcome in the name; one in the description, unless the name is a
    safe concept and the description anchors it before treatment; or a rationale that says it comes after treatment.
    """
    own, why = plain(name), plain(rationale if rationale is not None else F.lit(""))
    target = F.trim(F.concat_ws(" ", own, plain(description)))
    allowed = holds(target, ANCHORS) & holds(own, SAFE)
    leaks = holds(target, POST_TREATMENT) | holds(own, OUTCOME) | (holds(target, OUTCOME) & ~allowed) | holds(why, RATIONALE)
    return F.when((risk if risk is not None else F.lit("")) == "high", "high_leakage_risk").when(leaks, LEAK)


def reviewed(proposals: DataFrame, known: list[str], most_added: int, most_removed: int | None = None) -> DataFrame:
    """proposals (pos, action, name, kind, n_categories, roles, description, and rationale and leakage_risk if present) with `reason`, null where accepted, none where nothing is proposed.

    Rules in order, then caps on accepted additions and removals; most_removed 0 allows neither removals nor changes of roles. A proposal list
    is an agent's short answer.
    """
    valid_roles = F.array(F.lit("confounder"), F.lit("effect_modifier"))
    repeat = F.row_number().over(Window.partitionBy("name").orderBy("pos")) > 1
    extra = {c: F.col(c) if c in proposals.columns else None for c in ("rationale", "leakage_risk")}
    leak = leakage(F.col("name"), F.col("description"), extra["rationale"], extra["leakage_risk"])
    add, remove = F.col("action") == "add", F.col("action") == "remove"
    bad_roles = (F.size("roles") == 0) | (F.size(F.array_except("roles", valid_roles)) > 0)
    reason = (
        F.when(F.col("action") == "none", "none")
        .when(~F.col("action").isin("add", "remove", "update_role") | F.col("action").isNull(), "invalid_action")
        .when(~F.coalesce(F.col("name").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)), "invalid_name")
        .when(leak.isNotNull(), leak)
        .when(add & (F.col("name").isin(known) | F.col("__repeat")), "duplicate_feature")
        .when(add & ~F.coalesce(F.col("kind").isin("categorical", "continuous"), F.lit(False)), "invalid_type")
        .when(add & bad_roles, "invalid_roles")
        .when(add & (F.col("kind") == "categorical") & (F.col("n_categories") == 0), "missing_categories")
        .when(add & (F.col("kind") == "categorical") & (F.col("n_categories") > 8), "too_many_categories")
        .when(add & (F.coalesce("description", F.lit("")) == ""), "missing_description")
        .when(~add & F.lit(most_removed == 0), "removal_or_role_update_not_allowed_yet")
        .when(~add & ~F.col("name").isin(known), "unknown_existing_feature")
        .when(~add & ~remove & bad_roles, "invalid_roles")
    )
    out = proposals.withColumn("__repeat", repeat).withColumn("reason", reason).drop("__repeat")
    for action, most, name in (("add", most_added, "too_many_additions"), ("remove", most_removed, "too_many_removals")):
        if most is not None:
            mine = F.col("reason").isNull() & (F.col("action") == action)
            so_far = F.count_if(mine).over(Window.orderBy("pos"))  # an agent's short list
            out = out.withColumn("reason", F.when(mine & (so_far > most), name).otherwise(F.col("reason")))
    return out


def accepted(candidates: DataFrame, least_gain: float, most_auroc_drop: float, least_share: float) -> DataFrame:
    """The passing candidate (name, pos, gain, outcome_drop, treatment_drop, share_better) with the largest gain, the first of equals."""
    ok = (F.col("gain") >= least_gain) & (F.col("outcome_drop") <= most_auroc_drop) & (F.col("treatment_drop") <= most_auroc_drop) & (F.col("share_better") >= least_share)
    return candidates.where(ok).orderBy(F.desc("gain"), "pos").limit(1)


def compared(metrics: DataFrame, least_gain: float = 0.01, most_outcome_drop: float = 0.02, most_treatment_drop: float = 0.02, least_share: float = 0.6) -> DataFrame:
    """Each candidate against the baseline, from rows (candidate, fold, r_loss, outcome_auroc, treatment_auroc); the baseline's candidate is null.

    Means over all folds of either; the share of common folds in which the candidate's loss is strictly less; what isn't measured counts as no change.
    """
    base = metrics.where("candidate is null")
    means = lambda df: [F.avg(c).alias(f"{c}_{df}") for c in ("r_loss", "outcome_auroc", "treatment_auroc")]
    b = base.agg(*means("b"))
    c = metrics.where("candidate is not null").groupBy("candidate").agg(*means("c"))
    folds = metrics.where("candidate is not null").select("candidate", "fold", F.col("r_loss").alias("own")).join(base.select("fold", F.col("r_loss").alias("other")), "fold")
    better = folds.where("own is not null and other is not null").groupBy("candidate").agg(F.avg((F.col("own") < F.col("other")).cast("double")).alias("improved_fold_fraction"))
    delta = lambda m: F.coalesce(F.col(f"{m}_c") - F.col(f"{m}_b"), F.lit(0.0))
    out = c.join(F.broadcast(b)).join(better, "candidate", "left").select(  # b: one row
        "candidate",
        F.coalesce((F.col("r_loss_b") - F.col("r_loss_c")) / F.greatest(F.abs("r_loss_b"), F.lit(1e-8)), F.lit(0.0)).alias("r_loss_improvement"),
        delta("outcome_auroc").alias("outcome_auroc_delta"),
        delta("treatment_auroc").alias("treatment_auroc_delta"),
        F.coalesce("improved_fold_fraction", F.lit(0.0)).alias("improved_fold_fraction"),
    )
    passes = (F.col("r_loss_improvement") >= least_gain) & (F.col("outcome_auroc_delta") >= -most_outcome_drop) & (F.col("treatment_auroc_delta") >= -most_treatment_drop) & (F.col("improved_fold_fraction") >= least_share)
    return out.withColumn("passes_acceptance", passes)


# what goes to and comes from an agent: small documents on the driver


def agent_proposals(response: str) -> list[dict]:
    """The proposals of a response: what stands between its outermost braces, else all of it, as JSON; a bare list is the proposals themselves."""
    text = response.strip()
    low, high = text.find("{"), text.rfind("}")
    parsed = json.loads(text[low : high + 1] if 0 <= low < high else text)
    found = parsed if isinstance(parsed, list) else parsed.get("proposals", [])
    if not isinstance(found, list):
        raise ValueError("the response has no list of proposals")
    return found


def without_examples(payload: Any, name: str = "clinical_text_examples") -> Any:
    """A copy in which, at any depth, the text examples are gone."""
    if isinstance(payload, dict):
        return {k: [] if k == name else without_examples(v, name) for k, v in payload.items()}
    return [without_examples(x, name) for x in payload] if isinstance(payload, list) else payload


@dataclass(frozen=True)
class Limits:
    """What a candidate must reach."""

    least_gain: float = 0.01
    most_outcome_drop: float = 0.02
    most_treatment_drop: float = 0.02
    least_share: float = 0.6
    least_coverage: float = 0.5
    most_added: int = 3
    most_removed: int = 1


MEASURES = "r_loss_improvement double, outcome_auroc_delta double, treatment_auroc_delta double, improved_fold_fraction double, passes_acceptance boolean, rejection_reason string, coverage_failures array<struct<name: string, coverage: double>>"

#: What an agent is told to do about each status.
INSTRUCTIONS = {
    "validation_rejected": "Do not repeat this proposal unchanged; fix the validation failure or propose a different pre-treatment variable.",
    "accepted": "This candidate became the current baseline; build on it unless later feedback indicates a problem.",
    "not_selected": "This candidate passed acceptance thresholds but was not selected because another candidate had stronger R-loss improvement.",
    "rejected": "Do not repeat this candidate unchanged; propose a different baseline variable, extraction target, or role that addresses the failed_checks.",
}


def _shown(numbers: Column) -> Column:
    """Numbers in four digits, as Python writes them."""

    @F.pandas_udf("array<string>")
    def run(given: pd.Series) -> pd.Series:
        return given.map(lambda xs: None if xs is None else [None if x is None else f"{x:.4g}" for x in xs])

    return run(numbers)


def failed_checks(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows with `failed`, a line for each check that keeps the measures in `c` (JSON text, null where a candidate was not evaluated) from passing."""
    m = F.from_json("c", MEASURES)
    floors = (("r_loss_improvement", limits.least_gain, "required"), ("outcome_auroc_delta", -limits.most_outcome_drop, "allowed"), ("treatment_auroc_delta", -limits.most_treatment_drop, "allowed"), ("improved_fold_fraction", limits.least_share, "required"))
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    read = rows.withColumn("m", m).withColumn("thin", F.filter(F.coalesce("m.coverage_failures", F.array().cast("array<struct<name: string, coverage: double>>")), lambda x: real(x["coverage"])))
    told = read.withColumns({"thin_text": _shown(F.transform("thin", lambda x: x["coverage"])), "text": _shown(F.array(*[F.col(f"m.{name}") for name, *_ in floors]))})
    reason = F.when(F.col("m.rejection_reason") != "", F.array(F.concat(F.lit("rejection_reason: "), "m.rejection_reason")))
    coverage = F.zip_with("thin", "thin_text", lambda x, t: F.concat(F.lit("coverage "), F.coalesce(x["name"], F.lit("feature")), F.lit(" "), t, F.lit(f" < required {limits.least_coverage:.4g}")))
    short = F.array(*[F.when(real(F.col(f"m.{name}")) & (F.col(f"m.{name}") < floor), F.concat(F.lit(f"{name} "), F.get("text", F.lit(i)), F.lit(f" < {word} {floor:.4g}"))) for i, (name, floor, word) in enumerate(floors)])
    lines = F.concat(F.coalesce(reason, F.array().cast("array<string>")), coverage, F.array_compact(short))
    failed = F.when(F.coalesce(F.substring(F.ltrim("c"), 1, 1), F.lit("")) != "{", F.array(F.lit("candidate_evaluation_missing"))).when(F.size(lines) == 0, F.array(F.lit("did_not_pass_acceptance_thresholds"))).otherwise(lines)
    return told.withColumn("failed", failed).drop("thin", "thin_text", "text")


def _short(proposal: Column) -> Column:
    """JSON of what matters of a proposal given as JSON, or the text itself under `raw`."""
    parsed = F.from_json(proposal, "action string, name string, type string, roles array<string>, description string")
    return F.when(F.ltrim(proposal).startswith("{"), F.to_json(parsed)).otherwise(F.to_json(F.struct(proposal.alias("raw"))))


def feedback_table(lines: DataFrame, limits: Limits, most: int = 20) -> DataFrame:
    """iteration, candidate_id, status, failed_checks (null for what was accepted), proposals and metrics (JSON), instruction: the latest of a search's decisions.

    lines: pos, value, JSON lines as `decision_log` reads them. Proposals that failed validation, and candidates as accepted, not_selected or rejected.
    """
    head = F.from_json("value", "event string, iteration int")
    events = lines.select("pos", head.alias("h"), F.get_json_object("value", "$.payload").alias("p"))
    refused = events.where("h.event = 'agent_proposals'").select("pos", "h.iteration", F.posexplode(F.from_json("p", "rejected array<string>")["rejected"]).alias("at", "x")).where("x LIKE '{%'")
    refused = refused.withColumn("x", F.from_json("x", "proposal string, reason string"))
    own = F.from_json("x.proposal", "name string, action string")
    refused = refused.select(
        "pos", "at", "iteration", F.coalesce(own["name"], own["action"], "x.proposal", F.lit("")).alias("candidate_id"), F.lit("validation_rejected").alias("status"),
        F.array(F.coalesce("x.reason", F.lit("validation_failed"))).alias("failed_checks"), F.array(_short(F.col("x.proposal"))).alias("proposals"), F.lit(None).cast("string").alias("metrics"),
    )
    tried = events.where("h.event = 'candidate_evaluations'").select("pos", "h.iteration", F.posexplode(F.from_json("p", "array<string>")).alias("at", "x")).where("x LIKE '{%'")
    tried = tried.withColumn("x", F.from_json("x", "candidate_id string, accepted boolean, proposals array<string>, comparison string"))
    judged = failed_checks(tried.withColumn("c", F.col("x.comparison")), limits)
    status = F.when(F.col("x.accepted"), "accepted").when(F.col("m.passes_acceptance"), "not_selected").otherwise("rejected")
    why = F.when(status == "not_selected", F.array(F.lit("passed_thresholds_but_lower_ranked"))).when(status == "rejected", F.col("failed"))
    judged = judged.select("pos", "at", "iteration", F.col("x.candidate_id").alias("candidate_id"), status.alias("status"), why.alias("failed_checks"), F.transform("x.proposals", _short).alias("proposals"), F.to_json("m").alias("metrics"))
    said = F.element_at(F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair]), F.col("status"))
    latest = refused.unionByName(judged).orderBy(F.desc("pos"), F.desc("at")).limit(most)
    return latest.withColumn("instruction", said).orderBy("pos", "at").drop("pos", "at")


def feedback(decisions: list[dict], limits: Limits, most: int = 20) -> list[dict]:
    """feedback_table() of a search's decisions, as an agent's context holds it."""
    lines = SparkSession.active().createDataFrame([(i, json.dumps(d)) for i, d in enumerate(decisions)], "pos long, value string")
    out = []
    for r in feedback_table(lines, limits, most).collect():  # `most` rows
        entry = {"iteration": r["iteration"], "candidate_id": r["candidate_id"], "status": r["status"], "proposals": [json.loads(p) for p in r["proposals"] or []], "instruction": r["instruction"]}
        entry |= {"failed_checks": r["failed_checks"]} if r["failed_checks"] is not None else {}
        out.append(entry | ({"metrics": json.loads(r["metrics"])} if r["metrics"] else {}))
    return out


def decision_log(lines: DataFrame) -> DataFrame:
    """outer_fold, iteration, rejected, candidates: JSON lines (value) of a search's decisions rolled up by turn; malformed lines and turns without either are left out."""
    item = "struct<candidate_id:string,accepted:boolean,comparison:struct<passes_acceptance:boolean,rejection_reason:string>,proposals:array<struct<action:string,name:string>>>"
    head = F.from_json("value", "struct<event:string,outer_fold:int,iteration:int,payload:string>")
    events = lines.select(head.alias("h"), F.get_json_object("value", "$.payload").alias("p")).where("h.event is not null")
    rejected = F.from_json("p", "struct<rejected:array<struct<proposal:struct<action:string,name:string>,reason:string>>>")["rejected"]
    each = events.select(
        F.coalesce("h.outer_fold", F.lit(0)).alias("outer_fold"),
        F.coalesce("h.iteration", F.lit(0)).alias("iteration"),
        F.when(F.col("h.event") == "agent_proposals", F.transform(rejected, lambda r: F.concat_ws(": ", r["proposal"]["name"], r["reason"]))).alias("rejected"),
        F.when(F.col("h.event") == "candidate_evaluations", F.transform(F.from_json("p", f"array<{item}>"), lambda c: F.concat_ws(" ", c["candidate_id"], F.when(c["accepted"], "accepted").when(c["comparison"]["passes_acceptance"], "passed").otherwise(F.coalesce(c["comparison"]["rejection_reason"], F.lit("rejected")))))).alias("candidates"),
    )
    out = each.groupBy("outer_fold", "iteration").agg(*[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("rejected", "candidates")])
    return out.where((F.size("rejected") > 0) | (F.size("candidates") > 0))


# start strategies


def interleaved(left: list, right: list) -> list:
    both = [x for pair in zip(left, right, strict=False) for x in pair]
    n = min(len(left), len(right))
    return both + left[n:] + right[n:]


def starting_specs(confounders: list[FeatureSpec], modifiers: list[FeatureSpec], distractors: list[FeatureSpec], count: int, strategy: str) -> list[FeatureSpec]:
    """The first `count` of an ordering of true and distracting features; of one name the first definition with all roles."""
    from causeway.operators.encoding import merged

    orders = {
        "true_first": confounders + modifiers + distractors,
        "modifiers_first": modifiers + distractors + confounders,
        "mixed": interleaved(confounders, modifiers) + distractors,
        "distractors": distractors + modifiers + confounders,
        "none": [],
    }
    if strategy not in orders:
        raise ValueError(f"unknown strategy {strategy}: {', '.join(sorted(orders))}")
    return merged(orders[strategy])[: max(0, count)]


def specs_of(metadata: dict, section: str = "features") -> list[FeatureSpec]:
    """Feature specs of a dataset's metadata: one section, or all of them by `features`, which falls back to both others."""
    from causeway.operators.encoding import merged

    if section not in ("features", "confounders", "effect_modifiers"):
        raise ValueError(f"unknown section {section}")
    roles = {"confounders": ("confounder",), "effect_modifiers": ("effect_modifier",)}
    parts = [section] if section != "features" or metadata.get("features") is not None else ["confounders", "effect_modifiers"]
    return merged([FeatureSpec(x["name"], x["type"], tuple(x.get("categories") or ()), tuple(x.get("roles") or roles.get(p, ("confounder", "effect_modifier"))), x.get("description", "")) for p in parts for x in metadata.get(p, [])])


def exact_counts(specs: list[FeatureSpec], total: int | None, confounders: int | None = None, modifiers: int | None = None) -> list[FeatureSpec]:
    """The first subset, in order, with these numbers of features and of either role; raises where there is none.

    Without counts of roles the first `total` are taken. Feature lists are short (a dozen), so subsets are simply tried.
    """
    from itertools import combinations

    counts = lambda some: (len(some), sum("confounder" in s.roles for s in some), sum("effect_modifier" in s.roles for s in some))
    want = (total, confounders, modifiers)
    fits = lambda some: all(w is None or w == n for w, n in zip(want, counts(some), strict=True))
    if fits(specs):
        return list(specs)
    if total is not None:
        for some in combinations(specs, total):
            if fits(some):
                return list(some)
    raise ValueError(f"no {want} (features, confounders, modifiers) among {counts(specs)}")


# the search


class Agent(Protocol):
    """Gives proposals for a context of current features, feedback and text examples."""

    def propose(self, context: dict) -> list[dict]: ...


def applied(specs: list[FeatureSpec], proposals: list[dict]) -> list[FeatureSpec]:
    """The specs after validated proposals."""
    out = list(specs)
    for p in proposals:
        if p["action"] == "add":
            out.append(FeatureSpec(p["name"], p.get("type") or "continuous", tuple(p.get("categories") or ()), tuple(p["roles"]), p.get("description") or ""))
        elif p["action"] == "remove":
            out = [s for s in out if s.name != p["name"]]
        elif p["action"] == "update_role":
            out = [replace(s, roles=tuple(p["roles"])) if s.name == p["name"] else s for s in out]
    return out


PROPOSAL = "pos int, action string, name string, kind string, n_categories int, roles array<string>, description string, rationale string, leakage_risk string"


def search(df: DataFrame, specs: list[FeatureSpec], agent: Agent, ensure: Callable[[DataFrame, list[FeatureSpec]], DataFrame], evaluate: Callable[[DataFrame, list[FeatureSpec], int], DataFrame], turns: int = 3, limits: Limits | None = None, patience: int = 2, examples: list[str] | None = None) -> tuple[list[FeatureSpec], list[dict]]:
    """The specs that the search ends with, and its decisions.

    In each turn the agent proposes, proposals are reviewed, each valid one alone is a candidate; `ensure` adds a candidate's columns to df,
    `evaluate(df, specs, turn)` gives its inner folds' rows (fold, r_loss, outcome_auroc, treatment_auroc). The best candidate that passes
    becomes the baseline; `patience` turns without one end the search. Only short lists and metric rows are on the driver.
    """
    limits = limits or Limits()
    spark, decisions, idle = df.sparkSession, [], 0
    df = ensure(df, specs)
    for turn in range(turns):
        context = {"iteration": turn, "features": [{"name": s.name, "type": s.kind, "roles": list(s.roles)} for s in specs], "feedback": feedback(decisions, limits), "clinical_text_examples": examples or []}
        raw = agent.propose(context)
        rows = [(i, p.get("action"), p.get("name"), p.get("type"), len(p.get("categories") or []), p.get("roles") or [], p.get("description"), " ".join(filter(None, [p.get("rationale"), p.get("expected_signal")])), p.get("leakage_risk")) for i, p in enumerate(raw)]
        reasons = {r["pos"]: r["reason"] for r in reviewed(spark.createDataFrame(rows, PROPOSAL), [s.name for s in specs], limits.most_added, limits.most_removed).collect()}
        decisions.append({"iteration": turn, "event": "agent_proposals", "payload": {"rejected": [{"proposal": raw[i], "reason": r} for i, r in sorted(reasons.items()) if r]}})
        valid = [raw[i] for i, r in sorted(reasons.items()) if r is None]
        trials: dict[str, tuple[list[FeatureSpec], DataFrame]] = {}
        metrics = evaluate(df, specs, turn).withColumn("candidate", F.lit(None).cast("string"))
        for p in valid:
            own = applied(specs, [p])
            wide = ensure(df, own)
            trials[f"{p['action']}:{p['name']}"] = (own, wide)
            metrics = metrics.unionByName(evaluate(wide, own, turn).withColumn("candidate", F.lit(f"{p['action']}:{p['name']}")))
        found = [r.asDict() for r in compared(metrics, limits.least_gain, limits.most_outcome_drop, limits.most_treatment_drop, limits.least_share).collect()] if trials else []
        passing = [c for name in trials for c in found if c["candidate"] == name and c["passes_acceptance"]]
        best = max(passing, key=lambda c: c["r_loss_improvement"], default=None)  # the first of equals
        decisions.append({"iteration": turn, "event": "candidate_evaluations", "payload": [{"candidate_id": c["candidate"], "accepted": c is best, "comparison": c, "proposals": [p for p in valid if f"{p['action']}:{p['name']}" == c["candidate"]]} for c in found]})
        if best is None:
            idle += 1
            if idle >= patience:
                break
            continue
        idle = 0
        specs, df = trials[best["candidate"]]
    return specs, without_examples(decisions)


# outer folds around the search


def cell_losses(df: DataFrame, fold: str, columns: list[str], outcome: str, treatment: str, propensity: str) -> DataFrame:
    """fold, r_loss, outcome_auroc and treatment_auroc (null: not measured): the R-loss of effects that differ by the columns' values.

    Means of the outcome and effects of a cell come from its rows in other folds; a cell without any has those folds' mean and no effect.
    Everything is a sum by cell and fold; rows meet these tables by one join each.
    """
    r, w = F.col(outcome) - F.col("__m"), F.col(treatment) - F.col(propensity)

    def elsewhere(rows: DataFrame, **sums: Column) -> DataFrame:
        """Sums by cell over the other folds, for each cell and fold."""
        keys = [f"__c{i}" for i in range(len(columns))]
        own = rows.groupBy(*keys, fold).agg(*[F.sum(x).alias(f"own_{n}") for n, x in sums.items()])
        over = Window.partitionBy(*keys)  # the folds of a cell
        return own.select(*keys, fold, *[(F.sum(f"own_{n}").over(over) - F.col(f"own_{n}")).alias(f"__{n}") for n in sums])

    rows = df.withColumns({f"__c{i}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for i, c in enumerate(columns)})
    cells = [*[f"__c{i}" for i in range(len(columns))], fold]
    whole = rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum(outcome).alias("s")).select(fold, (F.sum("s").over(Window.partitionBy()) - F.col("s")).alias("__os"), (F.sum("n").over(Window.partitionBy()) - F.col("n")).alias("__on"))  # a row a fold
    put = rows.join(F.broadcast(whole), fold).join(elsewhere(rows, n=F.lit(1), s=F.col(outcome)), cells)
    put = put.withColumn("__m", F.coalesce(F.try_divide("__s", "__n"), F.try_divide("__os", "__on"), F.lit(0.0))).drop("__s", "__n", "__os", "__on")
    judged = put.join(elsewhere(put, a=w * r, b=w * w), cells).withColumn("__tau", F.coalesce(F.try_divide("__a", "__b"), F.lit(0.0)))
    none = F.lit(None).cast("double")
    return judged.groupBy(fold).agg(F.avg(F.pow(r - w * F.col("__tau"), F.lit(2))).alias("r_loss")).select(F.col(fold).alias("fold"), "r_loss", none.alias("outcome_auroc"), none.alias("treatment_auroc"))


def outer_search(df: DataFrame, key: str, specs: list[FeatureSpec], agent: Callable[[int], Agent], ensure: Callable[[DataFrame, list[FeatureSpec]], DataFrame], losses: Callable[[DataFrame, str, list[FeatureSpec]], DataFrame], folder: str, outer: int = 5, inner: int = 3, seed: int = 42, **how) -> DataFrame:
    """outer_fold, features (names in order), held_out_loss: an independent search() for each outer fold, on the other folds' rows alone.

    `losses(df, fold, specs)` judges specs by the folds in that column; inner folds are dealt anew each turn within the training rows. What is
    found is then judged on the held-out rows, cross-fitted in two halves: their means are those of the training rows, but the training rows'
    residuals, from which effects come, are taken around means of the held-out half. So the choice of features is free of held-out rows and
    held_out_loss is not wholly free of their outcomes. Each fold's decisions and outcome are tables under `folder`, the outcome last: a run that
    broke off goes on with the folds without one.
    """
    spark, dealt = df.sparkSession, cohort.folds(df, key, outer, seed).withColumnRenamed("cv_fold", "outer_fold")
    for f in range(1, outer + 1):
        if exists(spark, f"{folder}/chosen/outer_fold={f}/_SUCCESS"):
            continue
        train = dealt.where(F.col("outer_fold") != f)

        def evaluate(d: DataFrame, some: list[FeatureSpec], turn: int, f: int = f) -> DataFrame:
            return losses(cohort.folds(d, key, inner, seed + 1000 * f + turn), "cv_fold", some)

        found, decisions = search(train, specs, agent(f), ensure, evaluate, **how)
        lines = spark.createDataFrame([(json.dumps({"outer_fold": f, **d}),) for d in decisions], "value string")
        lines.coalesce(1).write.mode("overwrite").text(f"{folder}/decisions/outer_fold={f}")
        halves = ensure(dealt, found).withColumn("__half", (F.col("outer_fold") == f).cast("int"))
        judged = losses(halves, "__half", found).where("fold = 1")
        out = judged.select(F.array(*[F.lit(s.name) for s in found]).cast("array<string>").alias("features"), F.col("r_loss").alias("held_out_loss"))
        out.write.mode("overwrite").parquet(f"{folder}/chosen/outer_fold={f}")
    return spark.read.parquet(f"{folder}/chosen").select("outer_fold", "features", "held_out_loss")
