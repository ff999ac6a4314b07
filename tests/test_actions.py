"""Action scores, anchors and escalation on small literal cases."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import actions as ac
from evigraph.operators import rank as k

SIGNAL = ("session_id long, candidate_id string, node_id string, name string, label string, rel string, hint string, priority long, contradiction long, "
          "rel_w100 long, red_flag boolean, mode string, cost string")


def rows(spark):
    return spark.createDataFrame([
        (1, "D1", "E1", "CD4 计数", "LabFinding", "HAS_LAB_FINDING", "lab", 10000, 100, 50, False, "needs_lab_test", "high"),
        (1, "D1", "E2", "干咳", "ClinicalFinding", "MANIFESTS_AS", "symptom", 8000, 85, 40, False, "direct_ask", "low"),
        (1, "D1", "E3", "胸部CT 磨玻璃影", "ImagingFinding", "HAS_IMAGING_FINDING", "imaging", 9000, 100, 60, True, "needs_imaging", "high"),
        (1, "D2", "E2", "干咳", "ClinicalFinding", "MANIFESTS_AS", "symptom", 8000, 85, 40, False, "direct_ask", "low"),
    ], SIGNAL)


def signals(spark, preferred=()):
    pref = spark.createDataFrame(list(preferred), "session_id long, candidate_id string, text string, source string")
    r = rows(spark)
    return ac.action_signals(r, r.select("session_id", "candidate_id", "node_id"), pref)


def test_recommended_texts_match_by_name_tag_and_token(spark):
    pref = [(1, "D1", "CD4计数", "verifier"), (1, "D1", "胸片", "hypothesis")]
    got = {(r.candidate_id, r.node_id): r for r in signals(spark, pref).collect()}
    assert got["D1", "E1"].verifier == 1.0 and got["D1", "E1"].hypothesis == 0.0
    # one shared tag of two: the question type counts as a tag of the row
    assert got["D1", "E3"].hypothesis == pytest.approx(0.55 + 1 / 2 * 0.35)
    assert got["D1", "E1"].joint == 1.0 and got["D1", "E1"].recommended_bonus == pytest.approx(0.45)
    e2 = got["D1", "E2"]
    assert e2.overlap == 1.0 and e2.ask_bonus == pytest.approx(ac.ASK_BONUS)
    assert e2.gain == pytest.approx(0.85 * (1 - 0.45)) and e2.action_score == pytest.approx(0.8 + 0.34 + ac.ASK_BONUS + 0.45)
    assert got["D1", "E1"].action_score == pytest.approx(1.0 + 0.45 - 0.16 + 0.16 * 0.45)


@pytest.mark.parametrize("state,direct,folded", [
    ([], {"E2"}, {"general": 2}),
    ([("general", "done", True)], {"E1", "E2", "E3"}, {}),
    ([("general", "not_done", True)], {"E2"}, {}),
    ([("general", "unknown", True)], {"E2"}, {"lab": 1, "imaging": 1}),
    ([("general", "unknown", True), ("lab", "unknown", True), ("imaging", "not_done", False)], {"E2"}, {}),
])
def test_exam_items_are_asked_folded_or_dropped(spark, state, direct, folded):
    exams = spark.createDataFrame([(1, *s) for s in state], "session_id long, exam_kind string, availability string, asked boolean")
    ask, fold = ac.verification_actions(signals(spark), exams)
    assert {r.node_id for r in ask.where("candidate_id = 'D1'").collect()} == direct
    assert {r.exam_question: r.n_items for r in fold.collect()} == folded
    for r in fold.collect():
        assert r.answerability == (ac.GENERAL_EXAM if r.exam_question == "general" else ac.SPECIFIC_EXAM)


def test_repair_prefers_what_is_missing(spark):
    s = signals(spark, [(1, "D1", "CD4计数", "verifier")])
    s = s.withColumn("role", ac.action_role(F.col("label"), F.col("rel"), F.col("tags"), F.col("hint"), F.col("name")))
    assert {(r.node_id, r.role) for r in s.collect()} == {("E1", "background_context"), ("E2", "phenotype_support"), ("E3", "disease_specific_anchor")}
    schema = "session_id long, reject_reason string, forced boolean, current_answer string, missing_roles array<string>, recent_type string, recent_tags array<string>"

    def first(reason, roles=("disease_specific_anchor",), forced=False):
        ctx = spark.createDataFrame([(1, reason, forced, "D2", list(roles), "symptom", ["respiratory", "type:symptom"])], schema)
        return ac.repair_action_rank(s, ctx).orderBy("rank").collect()

    support = first("missing_key_support")
    assert support[0].node_id == "E1"
    e1 = support[0].action_score
    bias = -0.10
    assert support[0].repair_score == pytest.approx(
        e1 + 5.2 + 4.0 + 2.8 + 2.1 + 0.45 * 2.4 + 0.16 * 1.1 + 0 + 0 + bias + support[0].gain * 0.45 + 0.35 * 0.55 + 0.35 * 0.85 - 1.25 - 0.8 * 0.15)
    assert first("hard_negative_key_evidence")[0].repair_score == pytest.approx(support[0].repair_score + 1.25)
    assert first("strong_alternative_not_ruled_out")[0].node_id == "E3"
    assert first("trajectory_insufficient", forced=True)[0].repair_score == pytest.approx(first("anchored_alternative_exists")[0].repair_score)
    assert first("trajectory_insufficient")[0].node_id == "E3"


def test_followup_by_test_name_then_family_then_kind(spark):
    s = signals(spark)
    said = lambda kind, *tests: spark.createDataFrame([(1, kind, t) for t in tests], "session_id long, exam_kind string, test string")
    one = lambda m: [(r.node_id, r.name_match) for r in ac.exam_followup_rank(s.where("exam_kind IS NOT NULL"), m).collect()]
    assert one(said("lab", "CD4")) == [("E1", 1.0)]
    assert one(said("imaging", "胸片")) == [("E3", 0.85)]
    assert one(said("general", "x线", "随便")) == [("E3", 0.85)]
    assert one(said("imaging", "别的")) == [("E3", 0.55)]
    assert one(said("lab", "别的")) == []


def test_payload_match_legs(spark):
    seen = spark.createDataFrame([(1, "E1", "高热"), (1, "D9", "x"), (1, "E5", "结核 病"), (1, "E6", "隐球菌抗体阳性"), (1, "E7", "咳嗽")], "session_id long, node_id string, name string")
    cand = spark.createDataFrame([(1, "D1", "肺炎"), (1, "D9", "脑炎"), (1, "D2", "结核病")], "session_id long, candidate_id string, candidate_name string")
    pay = spark.createDataFrame([("D1", "E1", "发热", "MANIFESTS_AS", "ClinicalFinding"), ("D1", "P6", "隐球菌检测阳性", "HAS_LAB_FINDING", "LabFinding"),
                                 ("D1", "P7", "干咳嗽", "MANIFESTS_AS", "ClinicalFinding"), ("D1", "P8", "咳嗽", "MANIFESTS_AS", "ClinicalFinding")],
                                "candidate_id string, node_id string, name string, rel string, label string")
    got = {(r.candidate_id, r.node_id): (r.payload_id, r.rel, r.match100) for r in k.payload_match(seen, cand, pay).collect()}
    assert got == {("D1", "E1"): ("E1", "MANIFESTS_AS", 100), ("D9", "D9"): ("D9", k.SELF_RELATION, 100), ("D2", "E5"): ("D2", k.SELF_RELATION, 100),
                   ("D1", "E6"): ("P6", "HAS_LAB_FINDING", 100), ("D1", "E7"): ("P8", "MANIFESTS_AS", 96)}


def scope(spark, rel, label, candidate, evidence, tags=(), role="x", background=False):
    df = spark.createDataFrame([(rel, label, role, candidate, evidence, list(tags), background)],
                               "rel string, label string, role string, c string, e string, tags array<string>, bg boolean")
    r = ac.anchor_scope(df, "c", "e").first()
    return r.scope, r.reason


def test_scopes_of_evidence(spark):
    assert scope(spark, "HAS_PATHOGEN", "Pathogen", "隐球菌感染", "隐球菌") == ("exact_scope", "pathogen_exact_match")
    assert scope(spark, "HAS_LAB_FINDING", "LabFinding", "播散性结核", "痰结核阳性") == ("competing_scope", "candidate_scope_not_observed:disseminated")
    assert scope(spark, "HAS_LAB_FINDING", "LabFinding", "脑膜炎", "白细胞升高") == ("family_scope", "candidate_scope_not_observed:cns")
    assert scope(spark, "HAS_LAB_FINDING", "LabFinding", "真菌感染", "肺部磨玻璃") == ("family_scope", "observed_evidence_more_specific_than_candidate")
    assert scope(spark, "MANIFESTS_AS", "ClinicalFinding", "高血压", "头晕") == ("phenotype_scope", "phenotype_support")
    assert scope(spark, "REQUIRES_DETAIL", "ClinicalAttribute", "高血压", "病程") == ("exact_scope", "definition_relation_direct")
    assert scope(spark, "RISK_FACTOR_FOR", "Pathogen", "高血压", "某菌") == ("background_scope", "pathogen_as_background_or_comorbidity")
    assert scope(spark, "SELF_DISEASE_MATCH", "Disease", "高血压", "高血压") == ("exact_scope", "disease_self_match")
    assert scope(spark, "MANIFESTS_AS", "ClinicalFinding", "高血压", "头晕", background=True) == ("background_scope", "background_keyword_or_family")
    assert scope(spark, "MANIFESTS_AS", "ClinicalFinding", "高血压", "头晕", role="background_context")[1] == "role_background_context"


def test_rerank_uses_the_boosted_score_last(spark):
    zero = dict.fromkeys(("strong", "definition", "family", "provisional", "phenotype", "background", "negative", "background_attractor", "exact", "observed",
                          "role_specificity"), 0)
    base = {"session_id": 1, "anchor_tier": "speculative", "cluster": 0.0, "specificity": 0.0, "mismatch": 0.0, "generic": 0.0, **zero}
    rows_ = [{**base, "candidate_id": "a", "candidate_name": "a", "score": 0.9}, {**base, "candidate_id": "b", "candidate_name": "b", "score": 0.5, "phenotype": 2000000},
             {**base, "candidate_id": "c", "candidate_name": "c", "score": 0.1, "cluster": 0.35}, {**base, "candidate_id": "d", "candidate_name": "d", "score": 0.0, "anchor_tier": "family_anchor"},
             {**base, "candidate_id": "e", "candidate_name": "e", "score": 9.0, "generic": 0.38}]
    got = k.anchor_rerank(spark.createDataFrame(rows_)).orderBy("anchor_rank").collect()
    assert [r.candidate_id for r in got] == ["d", "c", "b", "a", "e"]
    assert {r.candidate_id: r.boosted for r in got}["b"] == pytest.approx(0.5 + 2 * 0.35)


def test_escalation_reasons(spark):
    schema = ("session_id long, candidate_id string, candidate_name string, rank int, reject_reason string, observed long, exact long, family long, anchor_tier string, "
              "alternative boolean, times int, costly_gap boolean")
    key = "missing_key_support"
    lead = lambda s, reason, observed, times, costly: (s, "A", "a", 1, reason, observed, observed, 0, "speculative", False, times, costly)
    rival = lambda s, observed, alt=False, tier="speculative": (s, "B", "b", 2, key, observed, observed, 0, tier, alt, 0, False)
    df = spark.createDataFrame([
        lead(1, key, 0, 0, False), rival(1, 100000), lead(2, key, 0, 0, False), rival(2, 40000), lead(3, key, 500000, 2, False), rival(3, 10, True),
        lead(4, key, 500000, 0, True), rival(4, 600000), lead(5, "trajectory_insufficient", 0, 5, True), rival(5, 900000), lead(6, key, 0, 2, False),
        lead(7, key, 500000, 2, True), rival(7, 10, False, "family_anchor")], schema)
    got = {r.session_id: r.reasons for r in k.escalate(df).collect()}
    assert got == {1: "zero_anchor", 3: "repeated_rejection", 4: "costly_gap", 7: "repeated_rejection"}
    assert spark.range(1).select(k.costly_evidence(F.lit("胸部 CT 报告"))).first()[0] is True


EXPLORE = ("session_id long, candidate_id string, node_id string, name string, label string, rel string, hint string, mode string, cost string, role string, tags array<string>, "
           "action_score double, answerability double, gain double, novelty double, ask_bonus double, burden double")


def explore(spark):
    one = lambda s, n, label, rel, hint, mode, cost, role, score, tags=("phenotype",), bonus=0.0: (
        s, "D1", n, n, label, rel, hint, mode, cost, role, list(tags), score, 1.0, 0.0, 0.0, bonus, 0.0)
    return spark.createDataFrame([
        one(1, "cough", "ClinicalFinding", "MANIFESTS_AS", "symptom", "direct_ask", "low", "phenotype_support", 2.0),
        one(1, "ct", "ImagingFinding", "HAS_IMAGING_FINDING", "imaging", "needs_imaging", "high", "disease_specific_anchor", 9.0),
        one(1, "detail", "ClinicalAttribute", "REQUIRES_DETAIL", "detail", "direct_ask", "low", "definition_anchor", 1.0, ("detail",)),
        one(1, "age", "PopulationGroup", "APPLIES_TO", "risk", None, None, "background_context", 2.1),
        one(2, "ct", "ImagingFinding", "HAS_IMAGING_FINDING", "imaging", "needs_imaging", "high", "disease_specific_anchor", 9.0),
        one(3, "b", "ClinicalFinding", "MANIFESTS_AS", "symptom", "direct_ask", "low", "phenotype_support", 2.0),
        one(3, "a", "ClinicalFinding", "MANIFESTS_AS", "symptom", "direct_ask", "low", "phenotype_support", 2.0),
        one(3, "near", "ClinicalFinding", "MANIFESTS_AS", "symptom", "direct_ask", "low", "phenotype_support", 1.9),
    ], EXPLORE)


def test_explorer_takes_cheap_questions_only(spark):
    ctx = spark.createDataFrame([(1, ["phenotype", "type:symptom"], False), (2, None, False), (3, [], None)],
                                "session_id long, recent_tags array<string>, definition_only boolean")
    got = {(r.session_id, r["rank"]): (r.node_id, pytest.approx(r.explorer_score)) for r in ac.explorer_rank(explore(spark), ctx).collect()}
    # a new family adds 0.45; background loses 1.15 and has no role; examinations never enter; ties go by name
    assert got == {(1, 1): ("detail", 1.0 + 1.2 + 0.92 * 1.55 + 0.45), (1, 2): ("cough", 2.0 + 1.2 + 0.48 * 1.55), (1, 3): ("age", 2.1 + 1.2 - 1.15),
                   (3, 1): ("a", 3.2 + 0.744), (3, 2): ("b", 3.2 + 0.744), (3, 3): ("near", 3.1 + 0.744)}
    only = spark.createDataFrame([(1, [], True), (3, [], True)], "session_id long, recent_tags array<string>, definition_only boolean")
    assert [(r.session_id, r.node_id) for r in ac.explorer_rank(explore(spark), only, keep=1).orderBy("session_id").collect()] == [(1, "detail"), (3, "a")]


def test_explorer_keeps_the_action_at_hand_within_its_lead(spark):
    ctx = spark.createDataFrame([(1, [], False, "D1", "ct"), (2, [], False, "D1", "ct"), (3, [], False, "D1", "near")],
                                "session_id long, recent_tags array<string>, definition_only boolean, selected_candidate string, selected_node string")
    got = {r.session_id: (r.node_id, r.by_explorer) for r in ac.explorer_choice(explore(spark), ctx).collect()}
    assert got == {1: ("cough", True), 2: ("ct", False), 3: ("near", False)}
    assert {r.session_id: r.node_id for r in ac.explorer_choice(explore(spark), ctx, lead=0.05).collect()}[3] == "a"


def test_cold_start_avoids_background_while_there_is_other(spark):
    rows = [(1, "D1", "n1", "HIV 感染", "RiskFactor", "risk", 9.0, 1.0, 1.0, True), (1, "D1", "n2", "干咳", "ClinicalFinding", "symptom", 8.0, 1.0, 1.0, True),
            (2, None, "n3", "年龄", "PopulationGroup", "risk", 1.0, 0.0, 0.0, False), (2, None, "n4", "CD4 计数", "LabFinding", "lab", 1.0, 0.0, 0.0, False)]
    probes = spark.createDataFrame(rows, "session_id long, candidate_id string, node_id string, name string, label string, hint string, priority double, weight double, gain double, red_flag boolean")
    got = {r.session_id: (r.node_id, round(r.probe_score, 6)) for r in ac.cold_start_probe(probes).collect()}
    assert got == {1: ("n2", round(8 + 1 + 1.5 + 2 + 2.2 + 0.35, 6)), 2: ("n4", round(1 + 2.2 - 0.35, 6))}
    assert ac.cold_start_probe(probes.limit(0)).collect() == []


def test_trajectory_groups_equal_all_pairs(spark):
    import itertools
    import random
    rnd = random.Random(2)
    made = [(s, rnd.choice("AB"), rnd.randrange(101), rnd.random() < 0.5, sorted(rnd.sample("pqrstuvw", rnd.randrange(5)))) for s in (1, 2) for _ in range(60)]
    made += [(3, "A", 50, True, ["p"]), (4, "A", 10, False, []), (4, "A", 20, False, [])]
    df = spark.createDataFrame(made, "session_id int, answer string, score100 long, terminal boolean, actions array<string>")
    for rows_a_slice in (3, 1024):
        got = {(r.session_id, r.answer): r.diversity for r in k.trajectory_groups(df, rows_a_slice).collect()}
        for key in {(m[0], m[1]) for m in made}:
            sets = [set(m[4]) for m in made if (m[0], m[1]) == key]
            alike = [1000000 if a == b else len(a & b) * 1000000 // len(a | b) for a, b in itertools.combinations(sets, 2)]
            assert got[key] == pytest.approx(1 - sum(alike) / len(alike) / 1000000 if alike else 0.0)
