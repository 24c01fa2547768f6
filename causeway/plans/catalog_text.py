"""Queries of the text parsers and of feature search. Their inputs are composed of table columns, so SQL can compose what must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions import notes, scalar
from causeway.operators import quantiles, search, tables, textmodels
from causeway.operators.encoding import FeatureSpec
from causeway.plans.registry import query, u
from causeway.sources.tables import table


def _text(*parts) -> Column:
    """Literals and columns end to end."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _sql(*parts: str) -> str:
    """Lines of SQL strings as one string."""
    return " || chr(10) || ".join(parts)




def _key() -> Column:
    return F.col("o_orderkey")


AGE_SQL = "'At age ' || (o_orderkey % 60 + 20)"


def _age() -> Column:
    return _text("At age ", _key() % 60 + 20)


# timelines

TIMELINE_SQL = "'[clinical_note|clinical progress note|0|seen ' || o_orderkey || chr(10) || 'again][imaging_report|imaging/radiology report|1|CT <b>][plan|clinical document|2|rest]'"


@query(f"SELECT o_orderkey, {TIMELINE_SQL} AS events FROM orders")
def f9_f11_w6_timeline(spark, d):
    text = _text("intro <clinical_note> seen ", _key(), "\nagain\n  <imaging_report> CT <b>\n<empty> \n<plan>  rest \n")
    events = notes.indexed_events(notes.timeline(text))
    shown = F.array_join(F.transform(events, lambda e: F.concat(F.lit("["), F.concat_ws("|", e["event_type"], e["note_type"], e["event_index"].cast("string"), e["event_text"]), F.lit("]"))), "")
    return table(spark, d, "orders").select("o_orderkey", shown.alias("events"))


@query("SELECT o_orderkey, '<a> first' || chr(10) || '<BEGIN EVENT CORRESPONDING TO SYNTHETIC NOTE> <b> second ' || o_orderkey || ' <END EVENT CORRESPONDING TO SYNTHETIC NOTE>' AS masked FROM orders")
def f10_masked_timeline(spark, d):
    return table(spark, d, "orders").select("o_orderkey", notes.masked_timeline(notes.timeline(_text("<a> first\n<b> second ", _key())), 1).alias("masked"))


# structured events


@query(
    "SELECT o_orderkey, "
    + _sql("'Encounter Record'", f"'  Timepoint: ' || {AGE_SQL}", "'  Encounter Type: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'oncology visit' ELSE 'consult' END", "'  Diagnosis Codes:'", "'    - C34.' || (o_orderkey % 100) || ': lung ' || o_orderstatus", "'    - Z51.11: chemotherapy'", "'  Procedure Codes:'", "'    - ' || (10000 + o_orderkey % 90000) || ': visit'")
    + " AS record FROM orders"
)
def f16_encounter(spark, d):
    kind = F.when(_key() % 3 == 0, "oncology visit for follow up").otherwise("consult")
    text = _text(_age(), ", ", kind, ". DX: c34.", _key() % 100, " (lung ", F.col("o_orderstatus"), "), Z51.11 (chemotherapy). CPT: ", 10000 + _key() % 90000, " (visit).")
    return table(spark, d, "orders").select("o_orderkey", notes.encounter_text(notes.encounter(text)).alias("record"))


@query(
    "SELECT o_orderkey, "
    + _sql("'Hospital Admission Record'", f"'  Timepoint: ' || {AGE_SQL}", "'  Reason for Admission: febrile neutropenia'", "'  Principal Diagnosis: D70.' || (o_orderkey % 10) || ' - low counts'", "'  Length of Stay: ' || (o_orderkey % 30) || ' days'", "'  Discharge Disposition: home ' || o_orderstatus")
    + " AS record FROM orders"
)
def f17_hospitalization(spark, d):
    text = _text(_age(), ", admitted with febrile neutropenia. Principal DX: d70.", _key() % 10, " (low counts). LOS: ", _key() % 30, " days. Discharge: home ", F.col("o_orderstatus"), ". Later text.")
    return table(spark, d, "orders").select("o_orderkey", notes.hospitalization_text(notes.hospitalization(text)).alias("record"))


@query(
    "SELECT o_orderkey, "
    + _sql(
        "'Laboratory Results'",
        f"'  Timepoint: ' || {AGE_SQL}",
        "'  Complete Blood Count (CBC):'",
        "'    WBC: ' || (o_orderkey % 20) || '.5 k/uL [Reference: 3.7-10.5] - Normal'",
        "'    Platelets: ' || (o_orderkey % 400) || ' k/uL [Reference: 150-400] - LOW'",
        "'  Tumor Markers:'",
        "'    CA 19-9: 40 U/mL [Reference: 0-37] - HIGH'",
        "'    Odd Test: 1.0 mg/dL - HIGH'",
    )
    + " AS record FROM orders"
)
def f18_lab_result(spark, d):
    text = _text(_age(), ", CBC: WBC ", _key() % 20, ".5 k/uL (normal), Platelets ", _key() % 400, " k/uL (low). Tumor markers: CA 19-9 40 U/mL (High), Odd Test 1.0 mg/dL (high).")
    return table(spark, d, "orders").select("o_orderkey", notes.lab_result_text(notes.lab_result(text)).alias("record"))


@query(
    "SELECT o_orderkey, "
    + _sql(
        "'Patient-Reported Outcomes Assessment'",
        f"'  Timepoint: ' || {AGE_SQL}",
        "'  Instrument: EORTC QLQ-C30'",
        "'    Physical Function: ' || (o_orderkey % 100) || '/100'",
        "'    Fatigue: 40/100'",
        "'  Instrument: PRO-CTCAE'",
        "'    Nausea - Severity: ' || (o_orderkey % 5) || '/4 (' || ['None', 'Mild', 'Moderate', 'Severe', 'Very Severe'][o_orderkey % 5 + 1] || ')'",
    )
    + " AS record FROM orders"
)
def f19_pro_assessment(spark, d):
    text = _text(_age(), ", EORTC QLQ-C30: Physical Function ", _key() % 100, ", Fatigue 40. PRO-CTCAE: Nausea severity ", _key() % 5, ".")
    return table(spark, d, "orders").select("o_orderkey", notes.pro_assessment_text(notes.pro_assessment(text)).alias("record"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Encounter Record' || chr(10) || '  Encounter Type: follow-up' WHEN 1 THEN "
    "'Hospital Admission Record' || chr(10) || '  Length of Stay: 4 days' END AS record FROM orders"
)
def f20_structured_events(spark, d):
    kind = F.element_at(F.array(F.lit("encounter"), F.lit("hospitalization"), F.lit("imaging_report")), (_key() % 3 + 1).cast("int"))
    text = F.when(_key() % 3 == 0, "follow‑up. DX: none").otherwise("LOS: 4 days")
    return table(spark, d, "orders").select("o_orderkey", notes.structured_event_text(kind, text).alias("record"))


# markers, mentions, prompts


@query(
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_nationkey + 40.5 WHEN 1 THEN c_nationkey + 50.0 ELSE c_nationkey + 60.0 END::DOUBLE AS age, "
    "CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_nationkey * 4 < 1 THEN '<1%' WHEN c_nationkey * 4 >= 50 THEN '≥50%' ELSE '1-49%' END AS band FROM customer"
)
def f21_markers(spark, d):
    n = F.col("c_nationkey")
    stated = F.when(F.col("c_custkey") % 3 == 0, _text("A 33-year-old, the patient is now ", n + 40, ".5 years old. At age 20, pre-treatment")).when(F.col("c_custkey") % 3 == 1, _text("At age 30, later. At age ", n + 50, ", pretreatment")).otherwise(_text("A 30 year old, now ", n + 60, "-year–old".replace("–", "-")))
    marker = F.when(F.col("c_custkey") % 4 == 3, "no marker").otherwise(_text(" PD‑L1 TPS was ", n * 4, "%"))
    text = F.concat(stated, F.lit(".\n"), marker)
    return table(spark, d, "customer").select("c_custkey", notes.age(text).alias("age"), notes.percent_band(text).alias("band"))


@query("SELECT p_partkey, '[inline|Brand|' || p_brand || '][table|Size|' || p_size || ']' AS mentions FROM part")
def f24_t6_mentions(spark, d):
    text = _text("Brand: ", F.col("p_brand"), "\n| **Size** | ", F.col("p_size"), " | x |\n|---|---|\nBRAND: ", F.lower("p_brand"), "\nplain text")
    shown = F.array_join(F.transform(notes.mentions(text), lambda m: F.concat(F.lit("["), F.concat_ws("|", m["source"], m["label"], m["value"]), F.lit("]"))), "")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return part.repartition(quantiles.parts(part)).select("p_partkey", shown.alias("mentions"))  # a small file's rows, many tasks' work


@query("SELECT n_nationkey, 'Name: ' || n_name || ' - 2 fine' AS cleaned FROM nation")
def f7_compatibility_forms(spark, d):
    return table(spark, d, "nation").select("n_nationkey", textmodels.normalized(_text("Ｎａｍｅ:  **", F.col("n_name"), "** – ２ ﬁne ")).alias("cleaned"))


@query("SELECT n_nationkey, 'a-b-c-' || n_name AS plain, 'a-b ' || n_name AS marks FROM nation")
def f6_plain_dashes(spark, d):
    n = F.col("n_name")
    return table(spark, d, "nation").select("n_nationkey", scalar.plain_hyphens(_text("a‑b—c－", n)).alias("plain"), notes.plain_marks(_text("a–b ", n)).alias("marks"))


DRUGS = {"aspirin": ["ASA", "Bayer"], "pembrolizumab": ["Keytruda"]}


@query(f"SELECT c_custkey, 'Took ' || ['ASA', 'Bayer'][CAST(floor({u('1', chr(39) + 'aspirin' + chr(39), 'c_custkey')} * 2) AS INTEGER) + 1] || ', then Keytruda; ' || ['ASA', 'Bayer'][CAST(floor({u('1', chr(39) + 'aspirin' + chr(39), 'c_custkey')} * 2) AS INTEGER) + 1] || ' not aspirins' AS changed FROM customer")
def f12_perturbed_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", tables.perturbed(F.lit("Took Aspirin, then pembrolizumab; aspirin not aspirins"), DRUGS, F.col("c_custkey")).alias("changed"))


STATED = [
    FeatureSpec("age", "continuous", description="Age"),
    FeatureSpec("metastatic_sites", "continuous"),
    FeatureSpec("balance", "continuous", description="Account balance"),
    FeatureSpec("segment", "categorical", ("a", "b"), description="Market segment"),
]


def _stated(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", (F.col("c_nationkey") + 20.25).alias("age"), (F.col("c_nationkey") % 5 + 0.5).alias("metastatic_sites"), F.col("c_acctbal").alias("balance"), F.concat(F.lit("in_"), F.lower("c_mktsegment")).alias("segment"))


CODE = "(express this concept naturally in clinical language - do NOT use underscores or the literal category code)"


@query(
    "SELECT c_custkey, "
    + _sql(
        "'- Age: ' || (c_nationkey + 20) || ' years old (use this exact age)'",
        "'- Metastatic Sites: ' || CAST(round_even(c_nationkey % 5 + 0.5, 0) AS BIGINT) || ' site(s) (use this exact count - do not add or remove any)'",
        "'- Account balance: ' || printf('%.2f', c_acctbal)",
        f"'- Market segment: \"in ' || lower(c_mktsegment) || '\" {CODE}'",
    )
    + " AS prompt FROM customer"
)
def f14_characteristics_prompt(spark, d):
    return _stated(spark, d).select("c_custkey", notes.characteristics_prompt(STATED).alias("prompt"))


@query("SELECT c_custkey, (c_nationkey + 20)::DOUBLE AS age, round_even(c_nationkey % 5 + 0.5, 0)::DOUBLE AS metastatic_sites, abs(c_acctbal) AS balance, 'in ' || lower(c_mktsegment) AS segment FROM customer")
def f15_stated_values(spark, d):
    return _stated(spark, d).select("c_custkey", notes.characteristics_prompt(STATED).alias("p")).select("c_custkey", *notes.stated_values(F.col("p"), STATED))


@query("SELECT conv_id, turn, trim(text) AS answer, array_to_string(list_slice(w, -3, -1), ' ') AS tail FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM conversations) WHERE len(w) > 3")
def f22_t8_response_text(spark, d):
    t = F.concat(F.lit("<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>final<|message|>"), F.col("text"), F.lit("<|return|>"))
    out = table(spark, d, "conversations").where(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) > 3)
    return out.select("conv_id", "turn", scalar.response_text(t, "final:").alias("answer"), scalar.last_tokens(F.col("text"), 3).alias("tail"))


@query(
    "SELECT doc_id, CAST(list_sum(list_transform(range(0, 3), lambda c: list_sum(list_transform(range(1, 9), lambda i: CASE WHEN 6 * c + i <= least(len(x), 6 * c + 8) AND (c = 0 OR 6 * c < len(x)) THEN (c * 8 + i) * x[CAST(6 * c + i AS BIGINT)] ELSE 0 END)))) AS BIGINT) AS weighted, "
    "least(3, greatest(1, (len(x) + 5) // 6)) AS n_chunks FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+|[^\\s]'), lambda w: length(w)) AS x FROM documents)"
)
def f3_chunk_grid(spark, d):
    lengths = F.transform(scalar.tokens(F.col("text")), lambda w: F.char_length(w))
    ids, mask, real = tables.chunk_grid(scalar.chunks(F.col("x"), 8, 2), 8, 3)
    rows = table(spark, d, "documents").select("doc_id", lengths.alias("x")).select("doc_id", ids.alias("ids"), mask.alias("mask"), real.alias("real"))
    flat = F.zip_with(F.flatten("ids"), F.flatten("mask"), lambda a, m: a * m)
    weighted = F.aggregate(F.transform(flat, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("doc_id", weighted.alias("weighted"), F.aggregate("real", F.lit(0), lambda a, b: a + b).cast("long").alias("n_chunks"))


# feature search: names and descriptions with their reasons, by what the rules say

CASES = [
    ("overall_survival", "at baseline", None, "low", "post_treatment_or_outcome_leakage"),
    ("ecog_status", "performance status at baseline", "may change response to therapy", "low", None),
    ("tumor_size", "size before treatment, a predictor of progressive disease at presentation", None, "low", None),
    ("hobby_count", "baseline predictor of recurrence", None, "low", "post_treatment_or_outcome_leakage"),
    ("albumin", "value after-therapy", None, "low", "post_treatment_or_outcome_leakage"),
    ("albumin", "baseline value", "reflects survival after surgery", "low", "post_treatment_or_outcome_leakage"),
    ("age", "age at diagnosis", None, "high", "high_leakage_risk"),
    ("weight", "", None, "low", None),
]


def _cases(columns: int) -> Column:
    row = lambda c: F.array(*[F.lit(x).cast("string") for x in c[:columns]])
    return F.element_at(F.array(*[row(c) for c in CASES]), (F.col("p_partkey") % len(CASES) + 1).cast("int"))


@query("SELECT p_partkey, [" + ", ".join(f"'{c[4]}'" if c[4] else "NULL" for c in CASES) + f"][p_partkey % {len(CASES)} + 1] AS reason FROM part")
def p12_leakage_guard(spark, d):
    c = table(spark, d, "part").select("p_partkey", _cases(4).alias("c"))
    at = lambda i: F.get("c", i)
    return c.select("p_partkey", search.leakage(at(0), at(1), at(2), at(3)).alias("reason"))


REVIEWED = [
    (0, "add", "ecog_status", "categorical", 3, ["confounder"], "status at baseline", None),
    (1, "add", "overall_survival", "continuous", 0, ["confounder"], "x", search.LEAK),
    (2, "add", "known", "continuous", 0, ["confounder"], "x", "duplicate_feature"),
    (3, "add", "weight", "continuous", 0, [], "x", "invalid_roles"),
    (4, "drop", "x", "continuous", 0, ["confounder"], "x", "invalid_action"),
    (5, "add", "Bad-Name", "continuous", 0, ["confounder"], "x", "invalid_name"),
    (6, "add", "height", "text", 0, ["confounder"], "x", "invalid_type"),
    (7, "add", "grade", "categorical", 0, ["confounder"], "x", "missing_categories"),
    (8, "add", "code", "categorical", 9, ["confounder"], "x", "too_many_categories"),
    (9, "add", "bmi", "continuous", 0, ["confounder"], "", "missing_description"),
    (10, "remove", "absent", None, 0, [], None, "unknown_existing_feature"),
    (11, "update_role", "known", None, 0, ["effect_modifier"], None, None),
    (12, "add", "height", "continuous", 0, ["confounder"], "x", "duplicate_feature"),
    (13, "add", "sex", "categorical", 2, ["confounder"], "x", None),
    (14, "add", "race", "categorical", 4, ["confounder"], "x", "too_many_additions"),
    (15, "remove", "other", None, 0, [], None, None),
    (16, "remove", "third", None, 0, [], None, "too_many_removals"),
    (17, "none", "", None, 0, [], None, "none"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, {chr(39) + r[7] + chr(39) if r[7] else 'NULL'})" for r in REVIEWED) + ") AS t(pos, reason)")
def p11_reviewed_proposals(spark, d):
    rows = spark.createDataFrame([r[:7] for r in REVIEWED], "pos int, action string, name string, kind string, n_categories int, roles array<string>, description string")
    return search.reviewed(rows, ["known", "other", "third"], 2, 1).select("pos", "reason")


@query(
    "SELECT CAST(p_partkey % 3 AS INTEGER) AS outer_fold, CAST(p_partkey % 5 AS INTEGER) AS iteration, coalesce(string_agg('n' || p_partkey || ': invalid_type', ',' ORDER BY 'n' || p_partkey || ': invalid_type') FILTER (p_partkey % 2 = 0), '') AS rejected, "
    "coalesce(string_agg('c' || p_partkey || CASE WHEN p_partkey % 4 = 1 THEN ' accepted' ELSE ' rejected' END, ',' ORDER BY 'c' || p_partkey || CASE WHEN p_partkey % 4 = 1 THEN ' accepted' ELSE ' rejected' END) FILTER (p_partkey % 2 = 1), '') AS candidates "
    "FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL"
)
def h14_decision_log(spark, d):
    k = F.col("p_partkey")
    head = lambda event: _text('{"event": "', event, '", "outer_fold": ', k % 3, ', "iteration": ', k % 5, ', "payload": ')
    rejected = F.concat(head("agent_proposals"), _text('{"rejected": [{"proposal": {"action": "add", "name": "n', k, '"}, "reason": "invalid_type"}]}}'))
    tried = F.concat(head("candidate_evaluations"), _text('[{"candidate_id": "c', k, '", "accepted": ', F.when(k % 4 == 1, "true").otherwise("false"), ', "comparison": {"passes_acceptance": false}, "proposals": []}]}'))
    lines = table(spark, d, "part").select(F.when(k % 7 == 0, "{broken").when(k % 2 == 0, rejected).otherwise(tried).alias("value"))
    out = search.decision_log(lines)
    return out.select("outer_fold", "iteration", *[F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c) for c in ("rejected", "candidates")])
