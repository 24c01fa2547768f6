"""Text parsers and search rules on small vectors."""

import json
import time

import pytest
from causeway.functions import notes, scalar
from causeway.operators import encoding, search
from pyspark.sql import functions as F


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


def test_timeline(spark):
    text = "<1% and > before <clinical_note> seen at 50\nmore <b> text\n<imaging_report> CT\n<empty>\n<ngs_report> KRAS"
    events = one(spark, notes.timeline, text)
    assert [(e.event_type, e.event_text) for e in events] == [("clinical_note", "seen at 50\nmore <b> text"), ("imaging_report", "CT"), ("ngs_report", "KRAS")]
    masked = one(spark, lambda t: notes.masked_timeline(notes.timeline(t), 1), text)
    assert "\n<BEGIN EVENT CORRESPONDING TO SYNTHETIC NOTE> <imaging_report> CT <END EVENT CORRESPONDING TO SYNTHETIC NOTE>\n" in masked
    assert one(spark, notes.note_type, "imaging_report") == "imaging/radiology report" and one(spark, notes.note_type, "x") == "clinical document"
    assert one(spark, notes.timeline, "") == [] and one(spark, notes.timeline, "no tags") == []


def test_structured_events(spark):
    e = one(spark, notes.encounter, "At age 62, outpatient oncology visit for cough. DX: c34.90 (lung), Z51.11 (chemo).\nCPT: 99214 (visit), 96413 (infusion), 12345 no.")
    assert e.timepoint == "At age 62" and e.encounter_type == "outpatient oncology visit"
    assert [tuple(c) for c in e.dx_codes] == [("C34.90", "lung"), ("Z51.11", "chemo")] and [tuple(c) for c in e.cpt_codes] == [("99214", "visit"), ("96413", "infusion")]
    h = one(spark, notes.hospitalization, "At age 63, admitted for febrile neutropenia. Principal DX: D70.1 (Agranulocytosis). LOS: 4 days. Discharge: home. More")
    assert tuple(h) == ("At age 63", "febrile neutropenia", "D70.1", "Agranulocytosis", "4", "home")
    lab = one(spark, notes.lab_result, "At age 62, CBC: WBC 8.2 k/uL (normal), Hgb 11.5 g/dL (LOW).\nTumor Markers: CA 19-9 40 U/mL (high).")
    assert [(p.name, [tuple(c) for c in p.components]) for p in lab.panels] == [("Complete Blood Count (CBC)", [("WBC", "8.2", "k/uL", "normal"), ("Hgb", "11.5", "g/dL", "low")]), ("Tumor Markers", [("CA 19-9", "40", "U/mL", "high")])]
    assert [p.name for p in one(spark, notes.lab_result, "Cr 0.9 mg/dL (normal)").panels] == ["Laboratory Results"] and one(spark, notes.lab_result, "none").panels == []
    p = one(spark, notes.pro_assessment, "At age 63, EORTC QLQ-C30: Physical Function 60, Role Function 40. PRO-CTCAE: Nausea severity 2, Fatigue 3.")
    assert [(i.name, [tuple(s) for s in i.scores]) for i in p.instruments] == [("EORTC QLQ-C30", [("Physical Function", "60"), ("Role Function", "40")]), ("PRO-CTCAE", [("Nausea", "2"), ("Fatigue", "3")])]
    assert one(spark, lambda t: notes.structured_event_text(F.lit("other"), t), "x") is None
    assert one(spark, lambda t: notes.structured_event_text(F.lit("encounter"), t), "") == "Encounter Record"


def test_markers(spark):
    assert one(spark, notes.age, "A 61-year-old, now 63 year old; age: 70") == 63 and one(spark, notes.age, "none") is None
    assert one(spark, notes.age, "At age 50.5, pre-treatment, a 61-year-old; the patient is now 70 years old") == 70
    assert one(spark, notes.age, "At age 40. At age 41.5") == 41.5
    assert [one(spark, notes.percent_band, f"PD-L1 TPS {x}%") for x in ("0.5", "20", "80", "<1", "≥50", ">60")] == ["<1%", "1-49%", "≥50%", "<1%", "≥50%", "≥50%"]
    assert one(spark, notes.percent_band, "in the 1-49% band") == "1-49%" and one(spark, notes.percent_band, "none") is None
    assert one(spark, notes.marker_features, "72 year old, PD‑L1 20%") == [0.5, 0.0, 0.0, 1.0, 0.0, 0.0] and one(spark, notes.marker_features, "") == [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_mentions(spark):
    found = one(spark, notes.mentions, "Stage: IV\n| Name | Value |\n|---|---|\n| ECOG | 1 |\nstage: iv\n- **Smoking**: 20 pack years\nA: x\nAge: 60 Sex: female\nplain")
    got = [(m.label, m.value, m.source) for m in found]
    assert ("Stage", "IV", "inline") in got and ("ECOG", "1", "table") in got and ("Name", "Value", "table") in got
    assert got[0] == ("Smoking", "20 pack years", "inline") and sum(m.label.lower() == "stage" for m in found) == 1 and not any(m.label == "A" for m in found)
    assert ("Age", "60", "inline") in got and ("Sex", "female", "inline") in got
    assert one(spark, notes.mentions, "") == []


def test_many_mentions_are_each_parsed_once(spark):
    """Time is in proportion to a text's lines: it was quadratic, as the parse was repeated for each mention."""
    lines = [f"Item {i % 150}x: grade {i % 150}" for i in range(1500)] + ["Width: １２ﬁ", "| *a b* | 7\u00a0mg | x |"]
    began = time.monotonic()
    found = [(m.label, m.value, m.source) for m in one(spark, lambda t: notes.mentions(t, 500), "\n".join(lines))]
    assert time.monotonic() - began < 30
    want = sorted(range(150), key=lambda i: (-len(f"Item {i}x"), -len(f"grade {i}"), i))
    assert [f for f in found if f[2] == "inline"] == [(f"Item {i}x", f"grade {i}", "inline") for i in want] + [("Width", "12fi", "inline")]
    assert ("a b", "7 mg", "table") in found and len(found) == 152


def test_prompts_round_trip(spark):
    specs = [encoding.FeatureSpec("age", "continuous", description="Age"), encoding.FeatureSpec("stage", "categorical", ("i_a", "iv"), description="Stage")]
    df = spark.createDataFrame([(61.5, "i_a")], "age double, stage string")
    p = df.select(notes.characteristics_prompt(specs).alias("p"))
    assert p.first()[0].split("\n")[0] == "- Age: 62 years old (use this exact age)"
    assert tuple(p.select(*notes.stated_values(F.col("p"), specs)).first()) == (62.0, "i a")
    assert tuple(spark.createDataFrame([("x",)], "p string").select(*notes.stated_values(F.col("p"), specs)).first()) == (None, "unknown")
    assert notes.feature_list(specs).split("\n")[1] == "- stage (categorical): Stage. Roles: [confounder, effect_modifier]. Categories: [i_a, iv]"


def test_chunks_and_windows(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(19)).alias("a"), F.array().cast("array<int>").alias("e"))
    r = df.select(scalar.chunks(F.col("a"), 10, 4).alias("c"), scalar.chunks(F.col("e"), 10, 4).alias("n"), scalar.token_window(F.col("a"), 5, "head_tail").alias("w"), scalar.token_window(F.col("a"), 3, "tail").alias("t")).first()
    assert [c[0] for c in r.c] == [0, 6, 12, 18] and r.n == [[]] and r.w == [0, 1, 17, 18, 19] and r.t == [17, 18, 19]
    with pytest.raises(ValueError, match="overlap"):
        scalar.chunks(F.col("a"), 4, 4)


def test_ngram_buckets(spark):
    ids = [5, 7, 11]
    want = {(i * 1_000_003 + 9_176) % 97 for i in ids} | {(a * (1_000_003 + 9_176) + b * (1_000_003 + 18_352) + 19_260_817 * 2) % 97 for a, b in ((5, 7), (7, 11))} | {(5 * 1_009_179 + 7 * 1_018_355 + 11 * 1_027_531 + 19_260_817 * 3) % 97}
    r = spark.createDataFrame([(ids, [])], "a array<int>, e array<int>").select(scalar.ngram_buckets(F.col("a"), 97).alias("a"), scalar.ngram_buckets(F.col("e"), 97).alias("e")).first()
    assert r.a == sorted(want) and r.e == [0]


# search


def test_agent_documents(spark):
    assert search.agent_proposals('Sure: {"proposals": [{"name": "a"}]} done') == [{"name": "a"}] and search.agent_proposals('[1, 2]') == [1, 2]
    with pytest.raises(ValueError, match="list"):
        search.agent_proposals('{"proposals": 3}')
    assert search.without_examples({"a": [{"clinical_text_examples": ["x"], "b": 1}]}) == {"a": [{"clinical_text_examples": [], "b": 1}]}
    limits = search.Limits()
    low = {"r_loss_improvement": 0.001, "outcome_auroc_delta": -0.51239, "improved_fold_fraction": 1.0, "rejection_reason": "late", "coverage_failures": [{"name": "x", "coverage": 0.1}, {"coverage": 0.25}, {"name": "y"}]}
    tiny = {"r_loss_improvement": 0.0000123456, "treatment_auroc_delta": -123456.0}
    rows = spark.createDataFrame([(i, None if c is None else json.dumps(c)) for i, c in enumerate([low, {}, None, 3, tiny, {"r_loss_improvement": 0.5}])], "i int, c string")
    got = {r.i: r.failed for r in search.failed_checks(rows, limits).select("i", "failed").collect()}
    assert got[0] == ["rejection_reason: late", "coverage x 0.1 < required 0.5", "coverage feature 0.25 < required 0.5", "r_loss_improvement 0.001 < required 0.01", "outcome_auroc_delta -0.5124 < allowed -0.02"]
    assert got[1] == got[5] == ["did_not_pass_acceptance_thresholds"] and got[2] == got[3] == ["candidate_evaluation_missing"]
    assert got[4] == ["r_loss_improvement 1.235e-05 < required 0.01", "treatment_auroc_delta -1.235e+05 < allowed -0.02"]
    proposal = {"name": "death", "action": "add", "type": "binary", "roles": ["confounder"], "other": 1}
    decisions = [
        {"iteration": 0, "event": "agent_proposals", "payload": {"accepted": [], "rejected": [{"proposal": proposal, "reason": search.LEAK}, {"proposal": {"action": "remove"}}, {"proposal": "words"}, 7]}},
        {"iteration": 0, "event": "baseline", "payload": {"r_loss": 1.0}},
        {"iteration": 1, "event": "candidate_evaluations", "payload": [{"candidate_id": "a", "accepted": True, "proposals": [proposal], "comparison": {"passes_acceptance": True, "baseline": {"x": 1}}}, {"candidate_id": "b", "comparison": {"passes_acceptance": True}}, {"candidate_id": "c", "comparison": {"r_loss_improvement": 0.0}}]},
    ]
    found = search.feedback(decisions, limits)
    assert [(x["candidate_id"], x["status"]) for x in found] == [("death", "validation_rejected"), ("remove", "validation_rejected"), ("words", "validation_rejected"), ("a", "accepted"), ("b", "not_selected"), ("c", "rejected")]
    assert found[0]["proposals"] == [{k: v for k, v in proposal.items() if k != "other"}] and found[2]["proposals"] == [{"raw": "words"}]
    assert [x.get("failed_checks") for x in found] == [[search.LEAK], ["validation_failed"], ["validation_failed"], None, ["passed_thresholds_but_lower_ranked"], ["r_loss_improvement 0 < required 0.01"]]
    assert found[3]["metrics"] == {"passes_acceptance": True} and found[5]["metrics"] == {"r_loss_improvement": 0.0} and "metrics" not in found[0]
    assert [x["instruction"] for x in found] == [search.INSTRUCTIONS[x["status"]] for x in found] and [x["iteration"] for x in found] == [0, 0, 0, 1, 1, 1]
    latest = search.feedback(decisions * 9, limits)
    assert len(latest) == 20 and latest[-1] == found[-1] and search.feedback([], limits) == []
    json.dumps(latest)
    with pytest.raises(ValueError, match="no "):
        search.exact_counts([encoding.FeatureSpec("a", "continuous")], 2)
    with pytest.raises(ValueError, match="unknown strategy"):
        search.starting_specs([], [], [], 3, "x")


class Scripted:
    """Proposes one thing a turn and notes what it was told."""

    def __init__(self, turns):
        self.turns, self.seen = turns, []

    def propose(self, context):
        self.seen.append(context)
        return self.turns[min(len(self.seen), len(self.turns)) - 1]


def test_search_finds_the_hidden_feature(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string")
    ensured = []

    def ensure(d, specs):
        ensured.append([s.name for s in specs])
        return d.withColumns({f"explicit_feat_{s.name}": F.lit(1.0) for s in specs})

    def evaluate(d, specs, turn):
        loss = 0.5 if any(s.name == "hidden_modifier" for s in specs) else 1.0
        return spark.createDataFrame([(f, loss + f / 100, 0.7, 0.7) for f in (1, 2)], "fold int, r_loss double, outcome_auroc double, treatment_auroc double")

    add = lambda name, **more: {"action": "add", "name": name, "type": "continuous", "roles": ["effect_modifier"], "description": "at baseline", **more}
    agent = Scripted([[add("noise"), add("survival_time")], [add("hidden_modifier"), add("other")], [add("noise2")]])
    specs, decisions = search.search(df, [encoding.FeatureSpec("age", "continuous")], agent, ensure, evaluate, turns=4, examples=["secret text"])
    assert [s.name for s in specs] == ["age", "hidden_modifier"] and ["age", "hidden_modifier"] in ensured
    assert [f["status"] for f in agent.seen[1]["feedback"]] == ["validation_rejected", "rejected"] and agent.seen[0]["clinical_text_examples"] == ["secret text"]
    assert "secret text" not in json.dumps(decisions) and len(agent.seen) == 4
    tried = [c["candidate_id"] for e in decisions if e["event"] == "candidate_evaluations" for c in e["payload"]]
    assert "add:survival_time" not in tried and "add:hidden_modifier" in tried
    c = spark.createDataFrame([("a", 1, 0.1, 0.0, 0.0, 1.0), ("b", 2, 0.3, 0.2, 0.0, 1.0), ("c", 3, 0.1, 0.0, 0.0, 0.9)], "name string, pos int, gain double, outcome_drop double, treatment_drop double, share_better double")
    assert [r["name"] for r in search.accepted(c, 0.01, 0.02, 0.6).collect()] == ["a"]
