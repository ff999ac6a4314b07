"""Verification actions: scores, exam collapse, repair ranking, fallback answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import tags
from ..functions.text import contains_any, let, map_value, match_text
from .audit import EXAM_GROUPS, name_key
from .rank import (ANCHOR_RELATIONS, CRITICAL_FACETS, DEFINITION_RELATIONS, SCOPE_RULES, SELF_RELATION, SPECIFIC_TAGS, facet_covered, rank_prior,
                   scope_tokens)
from .replay import flag, rate
from .retrieve import beside, beside_lead, listed, top_k

# --- fixed values: what a mode or cost means for asking ------------------------------------------
RED_FLAG_BONUS = 1.5
LOW_MODES = ("direct_ask", "history_known")
EXAM_MODES = ("needs_lab_test", "needs_imaging", "needs_pathogen_test")
STRONG_ROLES = ("disease_specific_anchor", "definition_anchor", "phenotype_support")


def _by_cost(mode: Column, cost: Column, low: float, medium: float, high: float, other: float) -> Column:
    return (F.when(mode.isin(*LOW_MODES) | (cost == "low"), low).when((mode == "needs_clinician_assessment") | (cost == "medium"), medium)
            .when(mode.isin(*EXAM_MODES) | (cost == "high"), high).otherwise(other))


def accessibility(mode: Column, cost: Column) -> Column:
    return _by_cost(mode, cost, 0.34, 0.08, -0.16, 0.0)


def burden(mode: Column, cost: Column) -> Column:
    return _by_cost(mode, cost, 0.14, 0.48, 0.8, 0.25)


def answerability(mode: Column, cost: Column) -> Column:
    return _by_cost(mode, cost, 1.0, 0.55, 0.16, 0.48)


def repair_cost_bias(mode: Column, cost: Column) -> Column:
    return _by_cost(mode, cost, 0.18, 0.04, -0.10, 0.0)


# --- fixed values: tags of an evidence text, token families, and what the tags mean for asking --------
ACTION_TAGS = (
    ("immune_status", ("hiv", "cd4", "t淋巴", "免疫", "艾滋", "机会性感染", "免疫抑制")),
    ("imaging", ("ct", "影像", "x线", "胸片", "磨玻璃", "双肺")),
    ("oxygenation", ("低氧", "血氧", "pao2", "氧分压", "肺泡", "氧合")),
    ("respiratory", ("发热", "干咳", "咳嗽", "呼吸困难", "气促")),
    ("pathogen", ("βd葡聚糖", "bdg", "病原", "痰", "balf", "病原学")),
    ("pcp_specific", ("肺孢子", "pneumocystis", "pcp", "βd葡聚糖", "bdg")),
    ("viral", ("核酸", "pcr", "新冠", "covid", "病毒载量", "hivrna")),
    ("tuberculosis", ("结核", "盗汗", "抗酸", "分枝杆菌", "tb")),
    ("systemic", ("皮疹", "咽痛", "关节疼痛", "腹泻", "淋巴结")),
    ("risk", ("高危", "性行为", "接触史", "暴露")),
)
ACTION_TOKENS = (
    ("ct", ("ct", "胸部ct", "影像", "磨玻璃")),
    ("xray", ("x线", "胸片")),
    ("oxygen", ("低氧", "血氧", "氧分压", "pao2", "氧合")),
    ("hiv", ("hiv", "艾滋", "cd4", "病毒载量")),
    ("pcr", ("核酸", "pcr")),
    ("pcp", ("肺孢子", "pcp", "βd葡聚糖", "bdg")),
    ("tb", ("结核", "盗汗", "抗酸", "分枝杆菌")),
    ("risk", ("高危", "性行为", "暴露", "接触史")),
    ("respiratory", ("咳嗽", "干咳", "呼吸困难", "气促")),
)
BACKGROUND_ASKS = ("immune_status", "underlying_infection", "general_risk", "constitutional_symptom", "viral_load", "population_risk")
TELLING_ASKS = ("respiratory_symptom", "neurologic_symptom", "skin_symptom", "gi_symptom", "metabolic_definition", "detail", "general_detail",
                "exposure_risk", "pathology", "tumor_marker", "respiratory", "systemic", "risk", "tuberculosis", "pcp_specific")
BACKGROUND_NAMES = ("cd4", "免疫", "hiv感染", "hiv感染者", "hivaids", "发热", "发烧", "年龄", "性别")
ASK_BONUS, ASK_PENALTY = 0.28, 0.22
GENERAL_EXAM, SPECIFIC_EXAM = 0.78, 0.22
EXAM_OF_MODE = {"needs_lab_test": "lab", "needs_imaging": "imaging", "needs_pathogen_test": "pathogen"}


def action_tags(name: Column, hint: Column, rules=ACTION_TAGS) -> Column:
    """Tags of an evidence text, with its question type."""
    return F.array_distinct(F.concat(tags(name_key(name), rules), F.array(F.concat(F.lit("type:"), hint))))


def asked_texts(preferred: DataFrame, rules=ACTION_TAGS, tokens=ACTION_TOKENS) -> DataFrame:
    """``preferred`` as the list ``asked`` of a session (and candidate, if it is named), with what :func:`recommended_match` reads of the texts."""
    b = name_key(F.col("text"))
    p = preferred.where("text IS NOT NULL").withColumns({"b": b, "tb": tags(b, rules), "kb": tags(b, tokens)}).drop("text")
    return listed(p, "asked")


def evidence_words(name: Column, hint: Column, rules=ACTION_TAGS, tokens=ACTION_TOKENS) -> Column:
    """What :func:`recommended_match` reads of an evidence name."""
    a = name_key(name)
    return F.struct(a.alias("a"), action_tags(name, hint, rules).alias("ta"), tags(a, tokens).alias("ka"))


def _text_match(e: Column, x: Column) -> Column:
    """How well evidence ``e`` (key ``a``, tags ``ta``, token families ``ka``) answers the text ``x``."""
    some = (e["a"] != "") & (x["b"] != "")
    name = F.when(e["a"] == x["b"], 1.0).when(some & (F.contains(e["a"], x["b"]) | F.contains(x["b"], e["a"])), 0.85).otherwise(0.0)
    both, held = F.size(F.array_intersect(e["ta"], x["tb"])), F.size(F.array_intersect(e["ka"], x["kb"]))
    tagged = F.when(both > 0, F.lit(0.55) + both / F.greatest(F.size(F.array_union(e["ta"], x["tb"])), F.lit(1)) * 0.35).otherwise(0.0)
    shared = F.when(held > 0, held / F.greatest(F.least(F.size(e["ka"]), F.size(x["kb"])), F.lit(1)) * 0.65).otherwise(0.0)
    by_tag = let(name, lambda n: F.when(n < 0.85, F.greatest(n, tagged)).otherwise(n))
    return let(by_tag, lambda n: F.when(n < 0.65, F.greatest(n, shared)).otherwise(n))


def _over_node(rows: DataFrame, value) -> Column:
    """Largest ``value(entry)`` over the rows of the candidate and node of a row; NULL entries do not count.

    Rows that bring ``same`` know the others; the rest are looked for in the frame.
    """
    if "same" in rows.columns:
        return F.array_max(F.transform("same", value))
    own = F.struct(*[c for c in ("name", "label", "hint", "mode") if c in rows.columns])
    return F.max(let(own, value)).over(Window.partitionBy("session_id", "candidate_id", "node_id"))


def _recommended(rows: DataFrame, rules, tokens) -> DataFrame:
    """``rows``, which have the list ``asked``, with the scores ``verifier`` and ``hypothesis``, NULL where nothing was compared."""
    def best(entry: Column) -> Column:
        """Best match of one evidence name by who asked; NULL without a name, a type or a text."""
        read = entry["words"] if "words" in rows.columns else evidence_words(entry["name"], entry["hint"], rules, tokens)
        met = let(read, lambda e: F.transform("asked", lambda x: F.struct(x["source"].alias("s"), _text_match(e, x).alias("m"))))
        of = lambda found, who: F.coalesce(F.array_max(F.transform(F.filter(found, lambda y: y["s"] == who), lambda y: y["m"])), F.lit(0.0))
        both = let(met, lambda found: F.struct(of(found, "verifier").alias("verifier"), of(found, "hypothesis").alias("hypothesis")))
        return F.when(entry["name"].isNotNull() & entry["hint"].isNotNull() & (F.size("asked") > 0), both)

    if "same" in rows.columns:
        rows = rows.withColumn("_w", F.filter(F.transform("same", best), lambda x: x.isNotNull()))
        top = lambda who: F.array_max(F.transform("_w", lambda x: x[who]))
    else:
        rows = rows.withColumn("_w", best(F.struct("name", "hint")))
        top = lambda who: F.max(F.col(f"_w.{who}")).over(Window.partitionBy("session_id", "candidate_id", "node_id"))
    return rows.withColumns({who: F.when(F.col("node_id").isNotNull(), top(who)) for who in ("verifier", "hypothesis")}).drop("_w")


def recommended_match(rows: DataFrame, preferred: DataFrame | None, rules=ACTION_TAGS, tokens=ACTION_TOKENS) -> DataFrame:
    """How well each evidence row answers the texts asked for, by who asked.

    Equal names 1, one inside the other 0.85, shared tags 0.55 and more, shared token
    families up to 0.65.  ``rows``: ``session_id, candidate_id, node_id, name, hint``; ``preferred``:
    ``session_id, candidate_id, text, source`` (``verifier`` or ``hypothesis``), None where rows bring the list
    of :func:`asked_texts`.  Returns ``verifier`` and ``hypothesis`` scores per row key.
    """
    met = _recommended(beside_asked(rows, preferred, rules, tokens), rules, tokens).where("verifier IS NOT NULL")
    cols = ["session_id", "candidate_id", "node_id", "verifier", "hypothesis"]
    return met.where("first").select(*cols) if "first" in met.columns else met.select(*cols).distinct()


def beside_asked(rows: DataFrame, preferred: DataFrame | None, rules=ACTION_TAGS, tokens=ACTION_TOKENS) -> DataFrame:
    if "asked" in rows.columns:
        return rows
    texts = asked_texts(preferred, rules, tokens)
    return rows.join(texts, [c for c in ("session_id", "candidate_id") if c in texts.columns], "left")


def low_cost_bonus(mode: Column, cost: Column, tag_array: Column, hint: Column, name: Column, background: Sequence[str] = BACKGROUND_NAMES) -> Column:
    """Bonus of a cheap question that tells candidates apart, malus of one about the background."""
    plain = F.filter(tag_array, lambda t: ~t.startswith("type:"))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    other = F.size(F.array_except(plain, lit(BACKGROUND_ASKS)))
    cheap = mode.isin(*LOW_MODES) | (cost == "low")
    return (F.when(~cheap, 0.0).when(contains_any(match_text(name, drop=" -_/+"), background), -ASK_PENALTY)
            .when(F.arrays_overlap(plain, lit(TELLING_ASKS)), ASK_BONUS).when(hint.isin("symptom", "risk", "detail") & (other > 0), ASK_BONUS * 0.65)
            .when((F.size(plain) > 0) & (other == 0), -ASK_PENALTY).otherwise(0.0))


def action_signals(rows: DataFrame, rivals: DataFrame | None, preferred: DataFrame | None, rules=ACTION_TAGS, tokens=ACTION_TOKENS,
                   background: Sequence[str] = BACKGROUND_NAMES) -> DataFrame:
    """Scores of every evidence row as something to ask.

    ``rows``: evidence rows per (session, candidate) with the question type ``hint``;
    ``rivals``: ``session_id, candidate_id, node_id`` of all candidates of the session, None where rows bring
    ``n_rivals`` and ``n_others`` (see ``r2_evidence``); ``preferred``: see ``recommended_match``.
    """
    key = ["session_id", "candidate_id"]
    if "n_others" in rows.columns:
        r = rows.where("session_id IS NOT NULL")
    else:
        n_rivals = rows.select(*key).distinct().groupBy("session_id").agg((F.count(F.lit(1)) - 1).alias("n_rivals"))
        held = rivals.select(*key, "node_id").distinct().groupBy("session_id", "node_id").agg(F.count(F.lit(1)).alias("n_holders"))
        own = rivals.select(*key, "node_id", F.lit(1).alias("_own")).distinct()
        r = rows.join(n_rivals, "session_id").join(held, ["session_id", "node_id"], "left").join(own, [*key, "node_id"], "left")
        r = r.withColumn("n_others", F.coalesce("n_holders", F.lit(0)) - F.coalesce("_own", F.lit(0))).drop("n_holders", "_own")
    r = _recommended(beside_asked(r, preferred, rules, tokens), rules, tokens).drop("asked")
    r = r.withColumns({w: F.coalesce(w, F.lit(0.0)) for w in ("verifier", "hypothesis")})
    m, c, v, h = F.col("mode"), F.col("cost"), F.col("verifier"), F.col("hypothesis")
    r = r.withColumns({
        "overlap": F.when(F.col("n_rivals") > 0, F.least(F.col("n_others") / F.greatest(F.col("n_rivals"), F.lit(1)), F.lit(1.0))).otherwise(0.0),
        "recommended": F.greatest(v, h), "joint": F.when((v > 0) & (h > 0), F.least(v, h)).otherwise(F.greatest(v, h)),
        "tags": F.col("words.ta") if "words" in r.columns else action_tags(F.col("name"), F.col("hint"), rules), "burden": burden(m, c), "answerability": answerability(m, c)})
    gain = F.col("contradiction") / 100 * (F.lit(1.0) - F.col("overlap") * 0.45) + F.col("recommended") * 0.35 + F.col("joint") * 0.25
    novelty = F.lit(1.0) - F.col("rel_w100") / 100 * 0.7 - F.col("overlap") * 0.2 + F.col("recommended") * 0.15
    r = r.withColumns({
        "gain": F.greatest(gain, F.lit(0.0)), "novelty": F.greatest(novelty, F.lit(0.0)), "recommended_bonus": F.col("recommended") * 0.45,
        "ask_bonus": low_cost_bonus(m, c, F.col("tags"), F.col("hint"), F.col("name"), background)})
    r = r.withColumn("action_score", F.col("priority") / 10000 + F.when(F.col("red_flag"), RED_FLAG_BONUS).otherwise(0.0) + F.col("recommended_bonus")
                     + accessibility(m, c) + F.col("ask_bonus") + F.col("answerability") * 0.45)
    return r.drop("n_rivals", "n_others").withColumn("exam_kind", map_value(m, EXAM_OF_MODE))


def verification_actions(signals: DataFrame, exams: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Scored actions, and exam questions that stand for several exam items.

    ``signals``: see ``action_signals``; ``exams``: ``session_id, exam_kind, availability,
    asked`` for the kinds ``general, lab, imaging, pathogen`` (missing: unknown, not asked), None where signals
    bring them as the list ``exams``.
    An exam item is asked directly once exams are known to be done, dropped when they are
    not done, and folded into a question about exams (in general, or of its kind when the
    general one was asked) while that is unknown.
    """
    key = ["session_id", "candidate_id"]
    r = beside(signals, exams, "exams")
    of = lambda which: F.filter("exams", which)
    r = r.withColumn("_g", F.explode_outer(of(lambda x: x["exam_kind"] == "general")))
    r = r.withColumn("_k", F.explode_outer(of(lambda x: (x["exam_kind"] != "general") & (x["exam_kind"] == F.col("exam_kind"))))).drop("exams")
    r = r.select("*", *[F.col(f"_{p}.{x}").alias(f"{p}_{n}") for p in "gk" for x, n in (("availability", "av"), ("asked", "asked"))]).drop("_g", "_k")
    g, k = F.coalesce("g_av", F.lit("unknown")), F.coalesce("k_av", F.lit("unknown"))
    no = lambda col: ~F.coalesce(col, F.lit(False))
    way = (F.when(F.col("exam_kind").isNull(), "ask").when((g == "not_done") | (k == "not_done"), "drop").when(g != "unknown", "ask")
           .when(no("g_asked"), "general").when((k == "unknown") & no("k_asked"), F.col("exam_kind")).otherwise("drop"))
    r = r.withColumn("_way", way).drop("g_av", "g_asked", "k_av", "k_asked")
    ask = r.where("_way = 'ask'").drop("_way")
    folded = r.where("_way NOT IN ('ask', 'drop')").groupBy(*key, F.col("_way").alias("exam_question")).agg(
        F.max(F.greatest(F.col("action_score") - 0.05, F.lit(0.0))).alias("action_score"),
        *[F.max(x).alias(x) for x in ("gain", "novelty", "recommended", "joint", "recommended_bonus", "red_flag")], F.count(F.lit(1)).alias("n_items"))
    return ask, folded.withColumn("answerability", F.when(F.col("exam_question") == "general", GENERAL_EXAM).otherwise(SPECIFIC_EXAM))


# --- fixed values: evidence of common conditions ----------------------------------------------------
ROLE_BACKGROUND_TAGS = ("immune_status", "general_risk", "underlying_infection")
ROLE_BACKGROUND_NAMES = ("cd4", "t淋巴", "免疫功能低下", "免疫抑制", "hiv感染者", "hivaids", "发热", "发烧", "年龄", "性别", "既往病史")


def action_role(label: Column, rel: Column, tag_array: Column, hint: Column, name: Column, background: Sequence[str] = ROLE_BACKGROUND_NAMES) -> Column:
    """Which kind of evidence an action would add."""
    common = F.arrays_overlap(tag_array, F.array(*[F.lit(x) for x in ROLE_BACKGROUND_TAGS])) | contains_any(match_text(name, drop=" -_/+"), background)
    unless = lambda role: F.when(common, "background_context").otherwise(role)
    has = lambda x: F.array_contains(tag_array, F.lit(x))
    found = rel.isin("DIAGNOSED_BY", "CONFIRMED_BY", "DETECTED_BY", "HAS_LAB_FINDING", "HAS_IMAGING_FINDING")
    return (F.when((label == "Pathogen") | (rel == "HAS_PATHOGEN") | has("type:pathogen"), "disease_specific_anchor")
            .when(found & ((label == "ClinicalAttribute") | has("detail") | (hint == "detail")), "definition_anchor")
            .when(found & label.isin("LabFinding", "LabTest", "ImagingFinding"), unless("disease_specific_anchor"))
            .when((rel == "REQUIRES_DETAIL") | (label == "ClinicalAttribute"), unless("definition_anchor"))
            .when(rel.isin("RISK_FACTOR_FOR", "APPLIES_TO") | label.isin("RiskFactor", "PopulationGroup"), unless("risk_or_comorbidity"))
            .when((label == "ClinicalFinding") | (rel == "MANIFESTS_AS"), "phenotype_support").otherwise(unless("phenotype_support")))


# --- fixed values: what a role is worth for a repair, and reasons that look for rivals ------------------
ROLE_PRIORITY = {"disease_specific_anchor": 1.0, "definition_anchor": 0.92, "family_anchor": 0.72, "phenotype_support": 0.48,
                 "risk_or_comorbidity": 0.28, "background_context": 0.0}
SUPPORT_REASONS = ("missing_key_support", "hard_negative_key_evidence", "missing_required_anchor", "insufficient_evidence_family_coverage")
RIVAL_REASONS = ("strong_alternative_not_ruled_out", "strong_unresolved_alternative_candidates", "anchored_alternative_exists")


def role_gap_bonus(role: Column, missing: Column) -> Column:
    """Bonus of an action whose role the answer still lacks."""
    lacks = lambda r: F.array_contains(missing, F.lit(r))
    return (F.when(F.array_contains(missing, role), 3.5).when(lacks("disease_specific_anchor") & (role == "definition_anchor"), 2.4)
            .when(lacks("definition_anchor") & (role == "disease_specific_anchor"), 2.4)
            .when(lacks("clear_confirmation") & role.isin("disease_specific_anchor", "definition_anchor"), 2.0).otherwise(0.0))


def repair_score(reason: Column, forced: Column) -> Column:
    """Score of an action for a repair; each kind of reason weighs the same signals differently."""
    c = F.col
    plain = lambda t: F.filter(t, lambda x: ~x.startswith("type:"))
    asked_before = c("recent_type").isNotNull()
    same_type = F.when(asked_before & (c("hint") == c("recent_type")), 0.2).otherwise(0.0)
    new_type = F.when(asked_before & (c("hint") != c("recent_type")), 0.35).otherwise(0.0)
    known = F.size(plain(c("recent_tags"))) > 0
    shared = F.coalesce(F.arrays_overlap(plain(c("recent_tags")), plain(c("tags"))), F.lit(False))
    new_family, same_family = F.when(known & ~shared, 0.35).otherwise(0.0), F.when(shared, 0.3).otherwise(0.0)
    background = F.when(c("role") == "background_context", 1.25).otherwise(0.0)
    bias, gap = repair_cost_bias(c("mode"), c("cost")), role_gap_bonus(c("role"), c("missing_roles"))
    worth = map_value(c("role"), ROLE_PRIORITY, 0.2)
    wanted = F.greatest(c("recommended"), c("joint"), c("verifier") * 0.9, c("hypothesis") * 0.75)
    hard = F.when(wanted >= 0.9, 4.0).when(wanted >= 0.65, 2.5).when(wanted >= 0.35, 1.2).otherwise(0.0) + F.when(
        (reason == "hard_negative_key_evidence") & (wanted > 0), 1.25).otherwise(0.0)
    support = (c("action_score") + wanted * 5.2 + hard + c("joint") * 2.8 + c("verifier") * 2.1 + c("hypothesis") * 1.0 + c("recommended_bonus") * 2.4
               + c("answerability") * 1.1 + worth * 2.35 + gap + bias + c("gain") * 0.45 + new_type * 0.55 + new_family * 0.85 - same_type * 0.5
               - same_family * 0.85 - background - c("burden") * 0.15)
    rival = (c("action_score") + c("gain") * 2.45 + (F.lit(1.0) - c("overlap")) * 1.05 + c("recommended") * 1.1 + c("joint") * 0.65
             + F.when(c("current_answer").isNotNull() & (c("candidate_id") != c("current_answer")), 1.05).otherwise(0.0)
             + F.when(c("role").isin("disease_specific_anchor", "definition_anchor"), 1.25).otherwise(0.0) + worth * 1.4 + c("answerability") * 0.85 + bias
             + new_family * 0.75 - same_type * 0.35 - same_family * 1.75
             - F.when((c("hint") == "lab") & (F.size(plain(c("tags"))) == 0), 1.35).otherwise(0.0) - background - c("burden") * 0.1)
    fresh = (c("action_score") + c("novelty") * 2.15 + new_type * 2.1 + new_family * 1.75 + c("answerability") * 0.65 + worth * 1.25 + gap + bias
             - same_type * 1.25 - same_family * 1.9 - background - c("burden") * 0.08)
    return F.when(reason.isin(*SUPPORT_REASONS), support).when(forced | reason.isin(*RIVAL_REASONS), rival).otherwise(fresh)


def in_context(actions: DataFrame, context: DataFrame | None) -> DataFrame:
    """``actions`` with the columns that ``context``, or the list of that name which they bring, holds for their session; others drop out."""
    if "context" not in actions.columns:
        return actions.join(context, "session_id")
    return actions.withColumn("_c", F.explode("context")).drop("context").select("*", "_c.*").drop("_c")


def repair_action_rank(actions: DataFrame, context: DataFrame | None, keep: int = 3) -> DataFrame:
    """Best actions per session for what the verifier rejected.

    ``actions``: rows of ``verification_actions`` with ``role``; ``context``: one row per
    session with ``reject_reason, forced, current_answer, missing_roles, recent_type,
    recent_tags`` (see :func:`in_context`).
    """
    scored = in_context(actions, context).withColumn("repair_score", repair_score(F.col("reject_reason"), F.coalesce("forced", F.lit(False))))
    return top_k(scored, ["session_id"], [F.desc("repair_score"), F.col("name"), F.col("node_id"), F.col("candidate_id")], keep)


# --- fixed values: what can be learned without an examination ---------------------------------------------
EXAM_MODES = ("needs_lab_test", "needs_imaging", "needs_pathogen_test")
ASK_MODES = ("direct_ask", "history_known")
OBSERVABLE_LABELS = ("ClinicalFinding", "RiskFactor", "ClinicalAttribute", "PopulationGroup")
PROBE_BACKGROUND = ("hiv", "艾滋", "cd4", "t淋巴", "免疫", "年龄", "性别", "发热", "既往病史")
# The action at hand stays unless the best is ahead by more than this.
EXPLORER_LEAD = 0.2


def observable(mode: Column, cost: Column, label: Column) -> Column:
    """The action asks for something that costs no examination; NULL counts as empty."""
    m, c, at = (F.coalesce(x, F.lit("")) for x in (mode, cost, label))
    return ~m.isin(*EXAM_MODES) & (c != "high") & (m.isin(*ASK_MODES) | (c == "low") | at.isin(*OBSERVABLE_LABELS))


def explorer_score() -> Column:
    """Worth of a cheap question: answerability, gain, novelty, role, and a family not touched last."""
    c = F.col
    plain = lambda t: F.filter(F.coalesce(t, F.array().cast("array<string>")), lambda x: (x != "") & ~x.startswith("type:"))
    recent = plain(c("recent_tags"))
    other = (F.size(recent) > 0) & ~F.coalesce(F.arrays_overlap(recent, plain(c("tags"))), F.lit(False))
    return (c("action_score") + c("answerability") * 1.2 + c("gain") * 1.1 + c("novelty") * 0.65 + c("ask_bonus") * 1.6
            + map_value(c("role"), ROLE_PRIORITY, 0.2) * 1.55 + F.when(other, 0.45).otherwise(0.0)
            - F.when(c("role") == "background_context", 1.15).otherwise(0.0) - c("burden") * 0.15)


def _explored(actions: DataFrame, context: DataFrame | None) -> DataFrame:
    """All actions of the sessions of ``context`` with ``explorer_score`` and ``_pool``: what the explorer may choose."""
    c = F.col
    scored = in_context(actions, context).withColumns({"explorer_score": explorer_score(), "_low": observable(c("mode"), c("cost"), c("label"))})
    definition = F.coalesce(c("_low") & (c("rel").isin(*DEFINITION_RELATIONS) | ((c("hint") == "detail") & c("label").isin("ClinicalAttribute", "LabFinding"))
                                         | ((c("ask_bonus") > 0) & (c("label") == "ClinicalAttribute"))), F.lit(False))
    session = Window.partitionBy("session_id")  # a session has few actions: candidates times the evidence limit
    scored = scored.withColumn("_definition", definition).withColumn(
        "_only", F.coalesce(c("definition_only"), F.lit(False)) & F.max("_definition").over(session))
    return scored.withColumn("_pool", c("_low") & (~c("_only") | c("_definition")))


EXPLORER_ORDER = ("explorer_score", "action_score")


def explorer_rank(actions: DataFrame, context: DataFrame | None, keep: int = 3) -> DataFrame:
    """Best questions per session that cost no examination.

    ``actions``: rows of ``verification_actions`` with ``role``; ``context``: one row per
    session with ``recent_tags`` and ``definition_only`` (fall back to definitions, if the
    session has any, after examinations without result).  Ties: the better action score,
    then name, node and candidate.  Sessions without such a question give no row.
    """
    pool = _explored(actions, context).where("_pool").drop("_low", "_definition", "_only", "_pool")
    return top_k(pool, ["session_id"], [*map(F.desc, EXPLORER_ORDER), F.col("name"), F.col("node_id"), F.col("candidate_id")], keep)


def explorer_choice(actions: DataFrame, context: DataFrame | None, lead: float = EXPLORER_LEAD, hand: Column | None = None) -> DataFrame:
    """``session_id, candidate_id, node_id, explorer_score, by_explorer``: what is asked next.

    ``context`` also has ``selected_candidate, selected_node``, the action at hand (NULL: none).
    Or ``hand`` is a struct of an action, and the one where it is least is at hand.  It stays if it is within ``lead`` of the best; an action that is no cheap question counts as -1.
    ``explorer_score`` is the score of the best question, NULL where there is none.
    """
    c = F.col
    explored = _explored(actions, context)
    if hand is not None:
        explored = explored.withColumn("_f", F.min(hand).over(Window.partitionBy("session_id")))
        explored = explored.withColumns({"selected_candidate": c("_f.candidate_id"), "selected_node": c("_f.node_id")})
    mine = (c("candidate_id") == c("selected_candidate")) & (c("node_id") == c("selected_node"))
    order = F.struct(*[(-c(x)).alias(f"_{x}") for x in EXPLORER_ORDER], "name", "node_id", "candidate_id")
    out = explored.groupBy("session_id").agg(
        F.min(F.when(c("_pool"), order)).alias("best"), F.max(F.when(mine & c("_low"), c("explorer_score"))).alias("own"),
        F.first("selected_candidate").alias("sc"), F.first("selected_node").alias("sn"))
    best = -c("best._explorer_score")
    stays = c("best").isNull() | (c("sn").isNotNull() & (F.coalesce("own", F.lit(-1.0)) >= best - lead))
    pick = lambda old, new: F.when(stays, c(old)).otherwise(c(new))
    out = out.select("session_id", pick("sc", "best.candidate_id").alias("candidate_id"), pick("sn", "best.node_id").alias("node_id"),
                     best.alias("explorer_score"), (~stays).alias("by_explorer"))
    return out.where("node_id IS NOT NULL")


def cold_start_probe(probes: DataFrame, background: Sequence[str] = PROBE_BACKGROUND, expansion: bool = True) -> DataFrame:
    """``session_id, candidate_id, node_id, probe_score``: the question to begin a session with.

    ``probes``: ``session_id, candidate_id, node_id, name, label, hint, priority, weight, gain,
    red_flag`` of what was not asked yet.  Questions about the background lose much while a
    session has others, little when it has none, so both orders are kept in one aggregate.
    """
    c = F.col
    common = contains_any(match_text(F.concat_ws(" ", "name", "label", "hint"), drop=" -_/+"), background)
    score = c("priority") + c("weight") + c("gain") * 1.5 + F.when(c("red_flag"), 2.0).otherwise(0.0) + (2.2 if expansion else 0.0)
    score = score + F.when(c("label") == "ClinicalFinding", 0.35).when(c("label").isin("RiskFactor", "PopulationGroup") & c("candidate_id").isNotNull(), -0.35).otherwise(0.0)
    p = probes.withColumns({"_s": score, "_common": common})
    order = lambda loss: F.min(F.struct(-(c("_s") - F.when(c("_common"), loss).otherwise(0.0)), "name", "node_id", "candidate_id"))
    both = p.groupBy("session_id").agg(order(2.4).alias("mixed"), order(0.35).alias("alone"), F.min("_common").alias("only"))
    best = both.select("session_id", F.when(c("only"), c("alone")).otherwise(c("mixed")).alias("b"))
    return best.select("session_id", "b.candidate_id", "b.node_id", (-c("b.col1")).alias("probe_score"))


# --- fixed values: how a test the patient names and an evidence name belong together ---------------------
EXAM_NAMES = {
    "lab": ((("cd4", "t淋巴"), ("cd4", "t淋巴", "免疫")), (("βd葡聚糖", "bdg", "g试验", "葡聚糖"), ("βd葡聚糖", "bdg", "葡聚糖", "g试验")),
            (("hivrna", "病毒载量"), ("hivrna", "病毒载量")), (("血氧", "动脉血气", "pao2", "spo2"), ("血氧", "氧分压", "pao2", "spo2", "低氧"))),
    "imaging": ((("胸部ct", "ct", "胸片", "x线"), ("ct", "影像", "磨玻璃", "胸片", "x线")),),
    "pathogen": ((("pcr", "核酸"), ("pcr", "核酸", "阳性", "检出")), (("痰检", "痰培养", "痰涂片"), ("痰", "培养", "涂片", "病原")),
                 (("支气管肺泡", "肺泡灌洗", "bal", "balf"), ("支气管肺泡", "肺泡灌洗", "bal", "balf"))),
}


def exam_name_match(test: Column, name: Column, kind: Column, label: Column, rules=EXAM_NAMES) -> Column:
    """Match of one mentioned test with one evidence name: 1, 0.85 by family, less by kind alone."""
    a, b = match_text(test, drop=" -_/+"), match_text(name, drop=" -_/+")
    some = (F.length(a) > 0) & (F.length(b) > 0)
    family = F.lit(False)
    for k, pairs in rules.items():
        for tests, names in pairs:
            family = family | ((kind == k) & contains_any(a, tests) & contains_any(b, names))
    return (F.when(some & (F.contains(a, b) | F.contains(b, a)), 1.0).when(family, 0.85).when((kind == "imaging") & (label == "ImagingFinding"), 0.55)
            .when((kind == "pathogen") & label.isin("Pathogen", "LabFinding", "LabTest"), 0.45).otherwise(0.0))


def exam_signal_ratio(actions: DataFrame) -> DataFrame:
    """Share of strong-role evidence that needs an exam, and how much of it per kind."""
    s = actions.where(F.col("role").isin(*STRONG_ROLES))
    exam = F.col("mode").isin(*EXAM_MODES)
    kinds = [F.sum(flag(exam & (F.col("grp") == g))).alias(g) for g in EXAM_GROUPS]
    return s.groupBy("session_id").agg(F.count(F.lit(1)).alias("units"), rate(F.sum(flag(exam)), F.count(F.lit(1))).alias("exam_ratio"), *kinds)


def exam_followup_rank(candidates: DataFrame, mentioned: DataFrame | None, keep: int = 1, rules=EXAM_NAMES) -> DataFrame:
    """The evidence that a mentioned test result is most likely about.

    ``candidates``: exam items with ``exam_kind, label, priority, contradiction, gain,
    recommended, joint, recommended_bonus``; ``mentioned``: ``session_id, exam_kind, test``
    (kind ``general``: the item's own kind counts), None where candidates bring them as the list ``mentioned``.
    """
    def named(entry: Column) -> Column:
        """Best match of one item with the tests named of its kind; NULL when none is."""
        kind = map_value(entry["mode"], EXAM_OF_MODE)
        item = F.struct(entry["name"].alias("name"), entry["label"].alias("label"), kind.alias("kind"))
        fit = lambda x, e: (x["exam_kind"] == "general") | (x["exam_kind"] == e["kind"])
        return let(item, lambda e: F.when(e["kind"].isNotNull(), F.array_max(F.transform(
            F.filter("mentioned", lambda x: fit(x, e)), lambda x: exam_name_match(x["test"], e["name"], e["kind"], e["label"], rules)))))

    key = ["session_id", "candidate_id", "node_id"]
    j = beside(candidates, mentioned, "mentioned").where(" AND ".join(f"{c} IS NOT NULL" for c in key))
    j = j.withColumn("name_match", _over_node(j, named)).drop("mentioned").where("name_match > 0")
    score = (F.col("name_match") * 3.0 + F.col("priority") / 10000 * 0.45 + F.col("contradiction") / 100 * 0.55 + F.col("gain") * 0.8
             + F.col("recommended") * 1.1 + F.col("joint") * 1.0 + F.col("recommended_bonus") * 0.7)
    return top_k(j.withColumn("followup_score", score), ["session_id"], [F.desc("followup_score"), F.col("name"), F.col("node_id"), F.col("candidate_id")], keep)


def repair_scope(pool: DataFrame, keep: int = 3) -> DataFrame:
    """Candidates a repair looks at: the current answer for missing support, its rivals otherwise, at most three."""
    own = F.col("reject_reason").isin("missing_key_support", "hard_negative_key_evidence", "trajectory_insufficient")
    p = beside_lead(pool, F.col("rank") == 1, _own=own).withColumn("_k", F.when(F.col("_own") == (F.col("rank") == 1), 0).otherwise(1))
    return top_k(p, ["session_id"], [F.col("_k"), F.desc("score"), F.col("candidate_name"), F.col("candidate_id")], keep, "scope_rank").drop("_own", "_k")


def alignment_bonus(exact: Column, family: Column, phenotype: Column, background: Column, negative: Column, attractor: Column, mismatch: Column) -> Column:
    """Anchor bonus of an answer score, within [0, 0.28]."""
    raw = (exact * 0.22 + family * 0.16 + phenotype * 0.05 + F.least(background * 0.015, F.lit(0.025)) - negative * 0.18 - attractor * 0.06 - mismatch * 0.08)
    return F.greatest(F.least(raw, F.lit(0.28)), F.lit(0.0))


def simulated_penalty(n_simulated: Column, has_anchor: Column) -> Column:
    """Cost of key evidence that exists only in simulated paths, at most 0.12."""
    return F.when(has_anchor, 0.0).otherwise(F.least(n_simulated * 0.04, F.lit(0.12)))


def scope_penalty(mismatch: Column, generic: Column, missing: Column, specificity: Column, cluster: Column, exact: Column, family: Column) -> Column:
    """Scope penalty of a final score, within [0, 0.22]."""
    raw = mismatch * 0.11 + generic * 0.16 + missing * 0.12 - specificity * 0.05 - cluster * 0.08 - exact * 0.03 - family * 0.02
    return F.greatest(F.least(raw, F.lit(0.22)), F.lit(0.0))


def simulated_steps(steps: DataFrame) -> DataFrame:
    """Distinct simulated positives per answer: the action asked last before each simulated reply.

    ``steps``: ``session_id, answer, steps ARRAY<STRUCT<stage, action, polarity>>``; one
    trajectory is one row, so the carry runs inside its own array.
    """
    zero = F.struct(F.lit("").alias("a"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        hit = (s["stage"] == "PENDING_ACTION") & (acc["a"] != "") & (s["polarity"] == "present")
        return F.struct(F.when(s["stage"] == "A3", s["action"]).otherwise(acc["a"]).alias("a"),
                        F.when(hit, F.concat(acc["out"], F.array(acc["a"]))).otherwise(acc["out"]).alias("out"))

    names = steps.select("session_id", "answer", F.explode(F.aggregate("steps", zero, step)["out"]).alias("name"))
    return names.distinct().groupBy("session_id", "answer").agg(F.count(F.lit(1)).alias("n_simulated"))


def fallback_answer_scores(pool: DataFrame) -> DataFrame:
    """Answer scores from candidates alone when no trajectory reached an answer.

    ``pool``: ``session_id, candidate_id, candidate_name, score`` and the anchor scores
    ``exact, definition, family, phenotype, background, negative, specificity, scope_block,
    low_items, low_families, support`` of each candidate.
    """
    top = top_k(pool, ["session_id"], [F.desc("score"), F.col("candidate_name"), F.col("candidate_id")], 3)
    best = top.groupBy("session_id").agg(F.max("score").alias("_best"))
    t = top.join(best, "session_id")
    c = F.col
    cap = lambda x, m: F.least(x, F.lit(m))
    norm = F.coalesce(F.try_divide(c("score"), c("_best")), F.lit(0.0))
    t = t.withColumn("normalized", norm)
    observed = (c("normalized") * 0.16 + 0.28 + cap(c("exact") * 0.28, 0.24) + cap(c("definition") * 0.24, 0.18) + cap(c("family") * 0.16, 0.12)
                + cap(c("phenotype") * 0.06, 0.08) + cap(c("specificity") * 0.16, 0.12) + cap(c("low_items") * 0.055, 0.16) + cap(c("low_families") * 0.045, 0.14)
                + cap(c("support") * 0.035, 0.10) + cap(c("background") * 0.01, 0.025) - c("negative") * 0.18 - c("scope_block") * 0.24 - (c("rank") - 1) * 0.035)
    t = t.withColumn("observed_score", F.greatest(F.least(observed, F.lit(0.94)), F.lit(0.0)))
    clash = (c("negative") > 0) | (c("scope_block") >= 0.28)
    strong, low = c("exact") + c("definition") >= 0.35, (c("low_items") >= 2) & (c("low_families") >= 2)
    why = F.when(~clash & strong & (c("observed_score") >= 0.62), "observed_strong_anchor_sufficient").when(
        ~clash & low & (c("observed_score") >= 0.72), "observed_low_cost_profile_sufficient")
    t = t.withColumns({"accept_reason": F.coalesce(why, F.lit("observed_evidence_not_sufficient")), "accepted": why.isNotNull(),
                       "reject_reason": F.when(why.isNotNull(), "none").when(clash, "strong_alternative_not_ruled_out").otherwise("missing_key_support")})
    return t.withColumn("prior", rank_prior(c("rank"))).drop("_best")


# --- fixed values: words for a site of disease, families of pathogen names, words of a general diagnosis --
SITE_WORDS = ("脑膜", "脑炎", "脑病", "肺炎", "肺部", "肺孢子", "呼吸道", "食管", "结肠", "肠炎", "胃炎", "肝炎", "肝癌", "胆道", "胰腺", "心内膜",
              "骨髓", "视网膜", "眼", "皮肤", "软组织", "尿路", "泌尿")
PATHOGEN_FAMILIES = (
    ("水痘带状疱疹", ("水痘带状疱疹", "带状疱疹", "vzv")), ("巨细胞病毒", ("巨细胞病毒", "cmv")),
    ("弓形虫", ("弓形虫", "toxoplasma", "toxoplasmagondii", "弓形虫病")), ("隐球菌", ("隐球菌", "cryptococcus")),
    ("结核分枝杆菌", ("结核", "分枝杆菌", "mtb", "xpert", "抗酸")), ("肺孢子菌", ("肺孢子", "pcp", "pjp", "pneumocystis")),
    ("人类疱疹病毒8", ("hhv8", "人类疱疹病毒8", "卡波西")), ("乙肝病毒", ("乙肝", "hbv", "乙型肝炎")), ("丙肝病毒", ("丙肝", "hcv", "丙型肝炎")),
    ("hiv", ("hiv", "艾滋", "获得性免疫缺陷")), ("新冠", ("新冠", "sarscov2", "covid")),
)
GENERAL_WORDS = ("感染", "病", "阳性")


def candidate_scope(df: DataFrame, candidate: str, facets=SCOPE_RULES, sites: Sequence[str] = SITE_WORDS, general: Sequence[str] = GENERAL_WORDS) -> DataFrame:
    """``df`` with what :func:`anchor_scope` reads of the candidate's name, to be asked for once per candidate."""
    out = df.withColumn("_cand", match_text(F.col(candidate), drop=" -_/+"))
    crit = F.array_intersect(scope_tokens(F.col("_cand"), facets), F.array(*[F.lit(x) for x in CRITICAL_FACETS]))
    return out.withColumns({"_crit": crit, "_sc": contains_any(F.col("_cand"), sites), "_wide": contains_any(F.col("_cand"), general)})


def evidence_name_scope(df: DataFrame, evidence: str, facets=SCOPE_RULES, sites: Sequence[str] = SITE_WORDS, pathogens=PATHOGEN_FAMILIES) -> DataFrame:
    """The part of :func:`evidence_scope` that needs no tags."""
    if "_ev" in df.columns:
        return df
    out = df.withColumn("_ev", match_text(F.col(evidence), drop=" -_/+"))
    out = out.withColumns({"_seen": scope_tokens(F.col("_ev"), facets), "_fam": tags(F.col("_ev"), pathogens), "_se": contains_any(F.col("_ev"), sites)})
    critical = F.array(*[F.lit(x) for x in CRITICAL_FACETS])
    return out.withColumn("_own", (F.size(F.array_intersect("_seen", critical)) > 0) | F.array_contains("_seen", F.lit("mycobacteria")))


def evidence_scope(df: DataFrame, evidence: str, facets=SCOPE_RULES, sites: Sequence[str] = SITE_WORDS, pathogens=PATHOGEN_FAMILIES) -> DataFrame:
    """``df`` with what :func:`anchor_scope` reads of the evidence's name and ``tags``, to be asked for once per evidence node."""
    out = evidence_name_scope(df, evidence, facets, sites, pathogens)
    lit = lambda names: F.array(*[F.lit(x) for x in names])
    return out.withColumns({"_spec": F.arrays_overlap("tags", lit(SPECIFIC_TAGS)), "_type": F.array_contains("tags", F.lit("type:pathogen"))})


def anchor_scope(df: DataFrame, candidate: str, evidence: str, facets=SCOPE_RULES, sites: Sequence[str] = SITE_WORDS, pathogens=PATHOGEN_FAMILIES,
                 general: Sequence[str] = GENERAL_WORDS) -> DataFrame:
    """``df`` with the first matching ``scope`` of its evidence for its candidate, and the ``reason``.

    ``candidate`` and ``evidence`` are name columns; ``rel, label, role, tags`` and ``bg`` (evidence
    of common conditions) are read; the word tables are parameters.  A candidate whose
    critical facets the evidence lacks gets another scope: competing if the evidence has
    facets of its own.  Steps are columns, so that no expression is repeated in the plan.
    Where :func:`candidate_scope` or :func:`evidence_scope` was asked before the two met, its columns are taken.
    """
    c = F.col
    out = df if "_cand" in df.columns else candidate_scope(df, candidate, facets, sites, general)
    out = out if "_spec" in df.columns else evidence_scope(out, evidence, facets, sites, pathogens)
    out = out.withColumns({
        "_some": (F.length("_cand") > 0) & (F.length("_ev") > 0), "_holds": F.contains("_cand", c("_ev")), "_held": F.contains("_ev", c("_cand")),
        "_miss": F.array_sort(F.filter("_crit", lambda t: ~facet_covered(t, c("_seen")))),
        "_named": F.exists("_fam", lambda f: F.contains(c("_cand"), f)),
        "_path": (c("label") == "Pathogen") | (c("rel") == "HAS_PATHOGEN") | c("_type")})
    lacks, broad = F.size("_miss") > 0, (F.size("_crit") == 0) & c("_wide") & c("_own")
    exam = c("label").isin("LabFinding", "LabTest", "ImagingFinding", "ClinicalAttribute")
    reason = (
        F.when(c("role") == "background_context", "role_background_context").when(c("rel") == SELF_RELATION, "disease_self_match")
        .when(c("bg"), "background_keyword_or_family").when(lacks, F.concat(F.lit("candidate_scope_not_observed:"), F.array_join("_miss", ",")))
        .when(broad, "observed_evidence_more_specific_than_candidate")
        .when(c("_path") & c("rel").isin("RISK_FACTOR_FOR", "APPLIES_TO", "COMPLICATED_BY"), "pathogen_as_background_or_comorbidity")
        .when(c("_path") & c("_some") & ~c("_sc"), "pathogen_exact_match").when(c("_path") & c("_some") & (c("_holds") | c("_named")), "pathogen_family_match")
        .when(c("_path"), "pathogen_not_named_in_candidate").when(c("_some") & (c("_holds") | c("_held")), "normalized_name_match")
        .when(c("rel").isin(*DEFINITION_RELATIONS), "definition_relation_direct").when(exam & c("_sc") & c("_se"), "site_specific_detail_match")
        .when(exam & (c("_spec") | c("rel").isin(*ANCHOR_RELATIONS)), "specific_family_match")
        .when((c("label") == "ClinicalFinding") | (c("rel") == "MANIFESTS_AS"), "phenotype_support").when(c("_spec"), "specific_family_tag_match")
        .otherwise("fallback_background"))
    out = out.withColumns({"reason": reason, "_gap": F.when(lacks & c("_own"), "competing_scope").otherwise("family_scope")})
    return out.withColumn("scope", scope_of(c("reason"), c("_gap"))).drop(
        "_cand", "_ev", "_crit", "_seen", "_fam", "_sc", "_se", "_wide", "_some", "_holds", "_held", "_miss", "_own", "_named", "_spec", "_type", "_path", "_gap")


def scope_of(reason: Column, gap: Column) -> Column:
    """The scope that an ``anchor_scope`` reason stands for."""
    return (F.when(F.startswith(reason, F.lit("candidate_scope_not_observed")) | (reason == "observed_evidence_more_specific_than_candidate"), gap)
            .when(reason.isin("disease_self_match", "pathogen_exact_match", "normalized_name_match", "definition_relation_direct", "site_specific_detail_match"), "exact_scope")
            .when(reason.isin("pathogen_family_match", "specific_family_match", "specific_family_tag_match"), "family_scope")
            .when(reason == "phenotype_support", "phenotype_scope").otherwise("background_scope"))
