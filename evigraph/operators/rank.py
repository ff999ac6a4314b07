"""Ranking of candidates and answers: feedback folds, anchors, trajectories, acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Order, clamped_total, neighbours, running
from ..functions.tags import tags
from ..functions.text import contains_any, map_value, match_text, text_or
from ..functions.vocab import FEEDBACK_MULTIPLIER, FEEDBACK_MULTIPLIER_OTHER
from .replay import flag, rate
from .retrieve import beside_lead, top_k

# --- fixed values: anchors --------------------------------------------------------------------
ANCHOR_RELATIONS = ("HAS_PATHOGEN", "DIAGNOSED_BY", "HAS_LAB_FINDING", "HAS_IMAGING_FINDING", "CONFIRMED_BY", "DETECTED_BY")
DEFINITION_RELATIONS = ("DIAGNOSED_BY", "REQUIRES_DETAIL")
RELATION_WEIGHT = {
    "HAS_PATHOGEN": 1.0, "DIAGNOSED_BY": 1.0, "CONFIRMED_BY": 1.0, "DETECTED_BY": 1.0, "SELF_DISEASE_MATCH": 1.0,
    "HAS_LAB_FINDING": 0.85, "HAS_IMAGING_FINDING": 0.85, "MANIFESTS_AS": 0.45, "REQUIRES_DETAIL": 0.55,
    "RISK_FACTOR_FOR": 0.35, "APPLIES_TO": 0.25}
LABEL_PRIOR = {
    "Pathogen": 1.0, "LabFinding": 0.85, "ImagingFinding": 0.85, "LabTest": 0.55, "ClinicalAttribute": 0.55,
    "ClinicalFinding": 0.35, "RiskFactor": 0.25, "PopulationGroup": 0.2, "Disease": 1.0}
SCOPE_WEIGHT = {"exact_scope": 1.0, "family_scope": 0.72, "provisional_scope": 0.58, "phenotype_scope": 0.35,
                "competing_scope": 0.24, "background_scope": 0.12}
TIER_PRIORITY = {"strong_anchor": 5, "definition_anchor": 5, "family_anchor": 4, "provisional_anchor": 3,
                 "phenotype_supported": 2, "background_supported": 1, "speculative": 1, "negative_anchor": 0}
SPECIFIC_TAGS = ("pathogen", "imaging", "disease_specific_lab", "serology", "tumor_marker", "pathology", "oxygenation")
DEFINITION_TAGS = ("detail", "metabolic_definition")
BACKGROUND_TAGS = ("immune_status", "underlying_infection", "general_risk", "constitutional_symptom")
LOW_COST_EXCLUDED = (*BACKGROUND_TAGS, "viral_load", "population_risk")
TAG_ALIAS = {"respiratory": "respiratory_symptom", "systemic": "constitutional_symptom", "risk": "exposure_risk",
             "viral": "viral_pathogen", "detail": "general_detail"}
SITE_FACETS = ("lung", "cns", "skin", "gi", "eye", "liver", "cervix", "mediastinum")
CRITICAL_FACETS = (*SITE_FACETS, "disseminated", "iris", "drug_resistant", "malignancy", "active_tb", "tb", "ntm")

# --- fixed values: facets named in a disease or evidence text ------------------------------------
SCOPE_RULES = (
    ("lung", ("肺", "肺炎", "胸部", "支气管", "痰", "呼吸道", "肺泡灌洗", "bal", "balf")),
    ("cns", ("脑", "脑炎", "脑膜", "脑脊液", "颅内", "中枢", "神经")),
    ("skin", ("皮肤", "皮损", "皮疹", "软组织", "溃疡", "皮肤分泌物")),
    ("gi", ("食管", "结肠", "肠炎", "胃肠", "肠道")),
    ("eye", ("视网膜", "眼", "眼底")),
    ("liver", ("肝", "肝炎", "肝癌", "肝细胞")),
    ("cervix", ("宫颈",)),
    ("mediastinum", ("纵隔",)),
    ("disseminated", ("播散", "全身", "多器官", "血培养", "血液培养", "血液分枝杆菌")),
    ("iris", ("免疫重建", "iris", "抗病毒治疗后", "抗逆转录病毒治疗", "art", "art后", "病情稳定时突然恶化", "近期恶化", "重新恶化")),
    ("drug_resistant", ("耐药", "利福平")),
    ("malignancy", ("癌", "肉瘤", "淋巴瘤", "肿瘤", "恶性")),
    ("active_tb", ("活动性结核",)),
    ("tb", ("结核", "mtb", "结核分枝杆菌", "xpert")),
    ("ntm", ("非结核", "ntm", "龟分枝杆菌", "偶然分枝杆菌", "脓肿分枝杆菌")),
    ("mycobacteria", ("分枝杆菌", "抗酸")),
)

# --- fixed values: a candidate named by the observation itself; words that separate name tokens ------
SELF_RELATION = "SELF_DISEASE_MATCH"
TOKEN_BREAKS = ("感染", "疾病", "综合征", "阳性", "阴性", "检测", "抗体", "rna", "dna", "病毒", "细菌", "真菌", "计数", "<", ">", "小于", "大于", "低于", "升高", "降低")
CLUSTER_EXACT, CLUSTER_GENERIC = 0.35, 0.28

# --- fixed values: verifier codes ------------------------------------------------------------------
ACCEPT_REASONS = ("key_support_sufficient", "alternatives_reasonably_ruled_out", "trajectory_stable")
REJECT_REASONS = ("missing_key_support", "strong_alternative_not_ruled_out", "trajectory_insufficient")
STRONG_WORDS = ("strong", "high", "unresolved", "强", "高", "强竞争")
WEAK_WORDS = ("weak", "low", "ruled_down", "ruled-out", "弱", "低", "已排除")
STRONG_MARKERS = ("未排除", "不能排除", "尚未排除", "需要排除", "强支持", "证据支持", "同样支持", "更符合", "高度符合", "主要竞争", "强竞争")
WEAK_MARKERS = ("缺乏", "证据不足", "不支持", "不如", "可能性低", "可能性较低", "较不符合", "较弱", "未见", "没有关键证据", "无法解释",
                "不典型", "仅作为", "一般候选", "低于当前诊断")


def polarity_effective(polarity: Column, status: Column, existence: Column) -> Column:
    """Stated polarity when valid, else from the slot status or the existence flag, else unclear."""
    return (F.when(polarity.isin("present", "absent", "unclear"), polarity)
            .when((status == "true") | (existence == "exist"), "present")
            .when((status == "false") | (existence == "non_exist"), "absent").otherwise("unclear"))


def slot_status(polarity: Column) -> Column:
    return F.when(polarity == "present", "true").when(polarity == "absent", "false").otherwise("unknown")


# -- feedback ------------------------------------------------------------------------------------------

def feedback_delta(polarity: Column, resolution: Column, rel: Column) -> Column:
    """Score change of one observation in ten-thousandths."""
    m = map_value(rel, FEEDBACK_MULTIPLIER, FEEDBACK_MULTIPLIER_OTHER)
    base = (F.when((polarity == "present") & (resolution == "clear"), 100).when((polarity == "present") & (resolution == "hedged"), 40)
            .when((polarity == "absent") & (resolution == "clear"), -100).when((polarity == "absent") & (resolution == "hedged"), -40)
            .when(polarity == "unclear", -18).otherwise(0))
    return (base * m).cast("bigint")


def scope_weight(tier: Column, exact: Column, family: Column, phenotype: Column, observed: Column) -> Column:
    """How far a candidate's anchors make an observation count, in hundredths."""
    return (F.when(tier.isin("strong_anchor", "definition_anchor") | (exact >= 0.55), 100)
            .when((tier == "family_anchor") | (family >= 0.35), 78).when((tier == "phenotype_supported") | (phenotype > 0), 55)
            .when((tier == "background_supported") | (observed > 0), 32).otherwise(18))


def feedback_weight(same_node: Column, same_name: Column, same_relation: Column, scope: Column) -> Column:
    """Weight of an observation for a candidate in ten-thousandths (no focus)."""
    return (F.when(same_node, F.least(F.lit(10000), 7800 + scope * 24)).when(same_name, F.least(F.lit(9500), 5800 + scope * 28))
            .when(same_relation & (scope >= 55), F.least(F.lit(5200), 1800 + scope * 32)).otherwise(0))


def evidence_feedback(related: DataFrame, start: DataFrame, order: Order, per_evidence: int = 5) -> DataFrame:
    """Final score of each candidate after all observations, floored at 0 after each of them.

    ``related``: one row per (observation, candidate) with ``weight, delta, name`` and the
    order columns; only the best ``per_evidence`` candidates of an observation change.
    ``start``: ``session_id, candidate_id, start`` in the unit of delta x weight.
    """
    obs_key = ["session_id", *order.by]
    kept = top_k(related.where("weight > 0"), obs_key, [F.desc("weight"), F.col("name"), F.col("candidate_id")], per_evidence, "_r")
    rows = kept.join(start, ["session_id", "candidate_id"]).withColumn("_v", F.col("delta") * F.col("weight"))
    out = clamped_total(rows, order, F.col("_v"), F.max("start"), "score")
    return start.join(out, ["session_id", "candidate_id"], "left").select(
        "session_id", "candidate_id", F.coalesce("score", "start").alias("score"))


def feedback_stats(related: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feedback events, events that reach several candidates, and their rate."""
    per = related.where("weight > 0").groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum(flag(F.col("n") > 1)).alias("multi_hits"),
        rate(F.sum(flag(F.col("n") > 1)), F.count(F.lit(1))).alias("multi_rate"))


def action_reward(polarity: Column, resolution: Column) -> Column:
    """Reward of an answered action in tenths."""
    return (F.when((polarity == "present") & (resolution == "clear"), 10).when((polarity == "present") & (resolution == "hedged"), 5)
            .when((polarity == "absent") & (resolution == "clear"), -4).when((polarity == "absent") & (resolution == "hedged"), -1)
            .otherwise(0).cast("bigint"))


def action_stats(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Visits, total and mean reward per action."""
    r = action_reward(F.col("polarity"), F.col("resolution"))
    return turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("visit_count"), F.sum(r).alias("total10")).withColumn(
        "average_value", F.col("total10") / F.col("visit_count") / 10)


def path_cache(turns: DataFrame, order: Order, groups: Sequence[str]) -> DataFrame:
    """Best next group per state signature with its support.

    The state is which evidence groups have been seen with which polarity; the groups are
    a closed list, so the running state is one flag each.
    """
    seen = {f"{p[0]}_{g}": ("max", F.when((F.col("grp") == g) & (F.col("polarity") == p), 1)) for p in ("present", "absent", "unclear") for g in groups}
    t = running(turns, order, seen, inclusive=False)
    part = lambda p: F.concat_ws(";", *[F.when(F.col(f"{p}_{g}") == 1, F.lit(g)) for g in sorted(groups)])
    sig = F.sha1(F.concat_ws("|", F.concat(F.lit("P="), part("p")), F.concat(F.lit("N="), part("a")), F.concat(F.lit("U="), part("u"))))
    n = t.groupBy(sig.alias("signature"), F.col("grp").alias("next")).agg(F.count(F.lit(1)).alias("support"))
    return top_k(n, ["signature"], [F.desc("support"), F.col("next")], 1).drop("rank")


# -- turns ----------------------------------------------------------------------------------------------

NO_RESULT_TURNS, NEGATIVE_TURNS = 2, 1


def cooldown(turns: DataFrame, order: Order, turn: str = "turn") -> DataFrame:
    """Turns suppressed because the same key was answered 'no result' or 'negative' just before.

    ``turns``: ``no_result, negative`` flags; the order's keys are (session, key).
    """
    until = F.when(F.col("no_result"), F.col(turn) + NO_RESULT_TURNS).when(F.col("negative"), F.col(turn) + NEGATIVE_TURNS)
    t = running(turns, order, {"cool_until": ("max", until)}, inclusive=False)
    return t.withColumn("suppressed", F.coalesce(F.col(turn) < F.col("cool_until"), F.lit(False)))


def no_result_streak(turns: DataFrame, order: Order) -> DataFrame:
    """Consecutive 'no result' answers up to each turn."""
    t = running(turns, order, {"_n": ("sum", flag(F.col("no_result")))})
    t = running(t, order, {"_base": ("max", F.when(~F.col("no_result"), F.col("_n")))})
    return t.withColumn("streak", F.col("_n") - F.coalesce("_base", F.lit(0))).drop("_n", "_base")


def bounded_history(turns: DataFrame, order: Order, value: str, keep: int = 12) -> DataFrame:
    """Consecutive duplicates dropped, last ``keep`` entries per key."""
    t = neighbours(turns, order, lag={"_p": value})
    t = t.where(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")
    return top_k(t, list(order.keys), [F.desc(c) for c in order.by], keep, "age")


def rerank_trigger(turns: DataFrame, keep: int = 6) -> DataFrame:
    """Session turns with strong positive evidence, with up to six of its names."""
    strong = turns.where((F.col("polarity") == "present") & F.col("resolution").isin("clear", "hedged")
                         & F.col("label").isin("Pathogen", "LabFinding", "ImagingFinding", "LabTest"))
    names = strong.groupBy("session_id", "turn", "name").agg(F.lit(1).alias("_x"))
    top = top_k(names, ["session_id", "turn"], [F.col("name")], keep)
    return top.groupBy("session_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", F.array_sort(F.collect_list("name"))).alias("names"))


def repair_counts(turns: DataFrame, order: Order, reasons: Sequence[str] = REJECT_REASONS) -> DataFrame:
    """Running count per (session, answer, reason) over the tracked reasons."""
    return running(turns.where(F.col("reason").isin(*reasons)), order, {"times": ("sum", F.lit(1).cast("bigint"))})


# -- anchors ---------------------------------------------------------------------------------------------

def observed_evidence(states: DataFrame, slots: DataFrame) -> DataFrame:
    """Real evidence per (session, node): the better of evidence state and slot.

    Both: ``session_id, node_id, polarity, resolution, simulated``.  A slot wins only when
    it ranks higher.
    """
    rank = (F.when((F.col("polarity") == "present") & (F.col("resolution") == "clear"), 4).when(F.col("polarity") == "present", 3)
            .when(F.col("polarity") == "unclear", 2).otherwise(1))
    tag = lambda df, s: df.where(~F.coalesce("simulated", F.lit(False))).select(
        "session_id", "node_id", "polarity", "resolution", F.lit(s).alias("source"), rank.alias("_r"))
    both = tag(states, "evidence_state").unionByName(tag(slots, "slot"))
    key = F.struct("_r", (F.col("source") == "evidence_state").cast("int"))
    best = both.groupBy("session_id", "node_id").agg(F.max_by(F.struct("polarity", "resolution", "source"), key).alias("b"))
    return best.select("session_id", "node_id", "b.*")


def name_tokens(key: Column) -> Column:
    """Parts of a normalised name between the separating words, two characters or longer."""
    return F.array_distinct(F.filter(F.split(key, "|".join(TOKEN_BREAKS)), lambda t: F.length(t) >= 2))


def _token_pairs(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """``okey, pkey, match100`` of names, none inside the other, whose token sets have a Jaccard of at least ``minimum``."""
    def tokens(df: DataFrame, key: str) -> DataFrame:
        t = df.select(key, name_tokens(F.col(key)).alias("_t"))
        return t.select(key, F.size("_t").alias(f"n_{key}"), F.explode("_t").alias("token"))

    both = tokens(left, "okey").join(tokens(right, "pkey"), "token").groupBy("okey", "pkey", "n_okey", "n_pkey").agg(F.count(F.lit(1)).alias("i"))
    share = F.col("i") / (F.col("n_okey") + F.col("n_pkey") - F.col("i"))
    apart = ~(F.contains("okey", F.col("pkey")) | F.contains("pkey", F.col("okey")))
    return both.where(apart & (share >= minimum)).select("okey", "pkey", F.floor(share * 100).cast("int").alias("match100"))


def payload_match(observed: DataFrame, candidates: DataFrame, payloads: DataFrame, minimum: float = 0.72, bring: Sequence[str] = ()) -> DataFrame:
    """Best matching evidence of each candidate for each observed item.

    The candidate itself (by id or name) comes first, then the same node 1.0, the same
    normalised name 0.96, one name inside the other 0.88, and names with similar token
    sets.  Names are compared once per distinct spelling, and per candidate and spelling
    only the best payload is kept before sessions are joined.  ``observed``: ``session_id,
    node_id, name``; ``candidates``: ``session_id, candidate_id, candidate_name``;
    ``payloads``: ``candidate_id, node_id, name, rel, label``.  With ``bring``, columns of the first two frames, a match
    comes once for each pair of their rows that it stands for, with these columns.  The result lies session by session.
    """
    from ..functions.names import containment_pairs

    key = lambda c: match_text(F.col(c), drop=" -_/+")
    of = lambda df: [c for c in bring if c in df.columns]
    o = observed.withColumn("okey", key("name")).select("session_id", "node_id", "okey", *of(observed))
    p = payloads.withColumn("pkey", key("name")).select("candidate_id", F.col("node_id").alias("payload_id"), "pkey", "rel", "label")
    one, two = o.select("okey").where("okey <> ''").distinct(), p.select("pkey").where("pkey <> ''").distinct()
    a, b = one.withColumnRenamed("okey", "name"), two.withColumnRenamed("pkey", "name")
    inside = containment_pairs(a, b).toDF("okey", "pkey").union(containment_pairs(b, a).toDF("pkey", "okey").select("okey", "pkey"))
    inside = inside.select("okey", "pkey", F.when(F.col("okey") == F.col("pkey"), 96).otherwise(88).alias("match100"))
    alike = inside.unionByName(_token_pairs(one, two, minimum)).groupBy("okey", "pkey").agg(F.max("match100").alias("match100"))
    pairs = o.join(candidates.select("session_id", "candidate_id", key("candidate_name").alias("ckey"), *of(candidates)), "session_id")
    found = F.struct("payload_id", "rel", "label", "match100")
    # the best payload of a candidate for a spelling does not depend on the session
    by_name = p.groupBy("candidate_id", "pkey").agg(F.max_by(F.struct("payload_id", "rel", "label"), "payload_id").alias("x")).select("candidate_id", "pkey", "x.*")
    best = pairs.select("candidate_id", "okey").distinct().join(alike, "okey").join(by_name, ["candidate_id", "pkey"])
    best = best.groupBy("candidate_id", "okey").agg(F.max_by(found, F.struct("match100", "payload_id")).alias("b"))
    # every pair goes on once, with its match by name or as the candidate itself; a match by id follows as a row of its own
    itself = F.struct(F.col("candidate_id").alias("payload_id"), F.lit(SELF_RELATION).alias("rel"), F.lit("Disease").alias("label"), F.lit(100).alias("match100"))
    own = (F.col("node_id") == F.col("candidate_id")) | (F.col("okey") == F.col("ckey"))
    ids = ["session_id", "candidate_id", "node_id"]
    rows = pairs.join(best, ["candidate_id", "okey"], "left").select(*ids, F.when(own, itself).otherwise(F.col("b")).alias("b"), *([F.struct(*bring).alias("_pair")] if bring else []))
    by_id = pairs.select(*ids).join(p.drop("pkey").withColumn("node_id", F.col("payload_id")), ["candidate_id", "node_id"]).select(
        *ids, F.struct("payload_id", "rel", "label", F.lit(100).alias("match100")).alias("b"))
    if not bring:
        rows = rows.where("b IS NOT NULL")
    first = F.when(F.col("b").isNotNull(), F.struct((F.col("b.rel") == SELF_RELATION).cast("int").alias("s"), "b.match100", "b.payload_id"))
    out = rows.unionByName(by_id, allowMissingColumns=True).repartition("session_id").groupBy(*ids).agg(
        F.max_by("b", first).alias("b"), *([F.collect_list("_pair").alias("_pair")] if bring else []))
    out = out.where(F.col("b.match100") >= round(minimum * 100))
    if bring:
        return out.withColumn("_pair", F.explode("_pair")).select(*ids, "b.*", "_pair.*")
    return out.select(*ids, "b.*")


def scope_tokens(text: Column, rules=SCOPE_RULES) -> Column:
    return tags(match_text(text, drop=" -_/+"), rules)


def facet_covered(token: Column, seen: Column) -> Column:
    """A facet counts as observed; 'disseminated' also when two sites are."""
    has = lambda x: F.array_contains(seen, F.lit(x))
    sites = F.size(F.array_intersect(seen, F.array(*[F.lit(s) for s in SITE_FACETS])))
    return (F.when(token == "disseminated", has("disseminated") | (sites >= 2))
            .when(token == "active_tb", has("active_tb") | (has("tb") & ~has("ntm")))
            .when(token == "tb", has("tb") | has("active_tb")).otherwise(F.array_contains(seen, token)))


def scope_profile(candidate_facets: Column, observed_facets: Column, generic_name: Column, anchored: Column) -> dict[str, Column]:
    """Coverage, missing facets and penalties of a candidate's scope."""
    crit = F.array_intersect(candidate_facets, F.array(*[F.lit(x) for x in CRITICAL_FACETS]))
    seen = F.array_intersect(observed_facets, F.array(*[F.lit(x) for x in CRITICAL_FACETS]))
    sites = F.array(*[F.lit(x) for x in SITE_FACETS])
    missing = F.array_sort(F.filter(crit, lambda t: ~facet_covered(t, observed_facets)))
    n_cov = F.size(crit) - F.size(missing)
    more = (generic_name & (F.size(crit) == 0) & (F.size(seen) > 0)) | (
        (F.size(F.array_intersect(seen, sites)) > 0) & (F.size(F.array_intersect(crit, sites)) == 0))
    need = (F.when(anchored & (F.size(missing) > 0), F.least(F.size(missing) * 0.18, F.lit(0.54))).otherwise(0.0)
            + F.when(F.array_contains(missing, "iris"), 0.22).otherwise(0.0) + F.when(F.array_contains(missing, "disseminated"), 0.18).otherwise(0.0))
    spec = F.when(F.size(crit) > 0, n_cov / F.greatest(F.size(crit), F.lit(1)) * 0.7 + F.least(n_cov * 0.08, F.lit(0.24))).otherwise(0.0)
    return {"missing_facets": missing, "scope_specificity": spec, "generic_penalty": F.when(more, 0.38).otherwise(0.0), "requirement_missing": need}


def evidence_tags(label: Column, hint: Column, text: Column, rules) -> Column:
    """Tags from the question type, the label and the text."""
    by_label = (F.when(label.isin("LabFinding", "LabTest"), F.array(F.lit("type:lab"))).when(label == "ImagingFinding", F.array(F.lit("imaging"), F.lit("type:imaging")))
                .when(label == "Pathogen", F.array(F.lit("pathogen"), F.lit("type:pathogen"))).when(label == "ClinicalAttribute", F.array(F.lit("detail"), F.lit("type:detail")))
                .otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.filter(F.array(F.when(hint != "", F.concat(F.lit("type:"), hint))), lambda x: x.isNotNull()), by_label,
                                     tags(match_text(text, drop=" -_/+"), rules)))


def canonical_tags(tag_array: Column) -> Column:
    """Family tags under one name; type tags left out."""
    plain = F.filter(tag_array, lambda t: ~t.startswith("type:"))
    return F.array_distinct(F.transform(plain, lambda t: F.coalesce(map_value(t, TAG_ALIAS), t)))


def anchor_role(rel: Column, label: Column, tag_array: Column, background: Column) -> Column:
    """Role of one matched piece of evidence."""
    any_of = lambda names: F.arrays_overlap(tag_array, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(rel == "SELF_DISEASE_MATCH", "disease_specific_anchor").when(background, "background_context")
        .when((label.isin("Pathogen", "Disease")) | (rel == "HAS_PATHOGEN") | any_of(("type:pathogen",)), "disease_specific_anchor")
        .when(rel.isin(*DEFINITION_RELATIONS) | any_of(DEFINITION_TAGS), "definition_anchor")
        .when(rel.isin(*ANCHOR_RELATIONS) & label.isin("LabFinding", "LabTest", "ImagingFinding"), "disease_specific_anchor")
        .when(any_of(SPECIFIC_TAGS), "disease_specific_anchor").when(label == "ClinicalAttribute", "definition_anchor")
        .when(label.isin("RiskFactor", "PopulationGroup") | rel.isin("RISK_FACTOR_FOR", "APPLIES_TO"), "risk_or_comorbidity")
        .when((label == "ClinicalFinding") | (rel == "MANIFESTS_AS"), "phenotype_support").otherwise("background_context"))


def anchor_strength(polarity: Column, resolution: Column, rel: Column, label: Column, degree: Column, scope: Column) -> Column:
    """Anchor score of one match in millionths (whole, so that sums are exact)."""
    conf = (F.when((polarity == "present") & (resolution == "clear"), 1.0).when(polarity == "present", 0.55)
            .when((polarity == "absent") & (resolution == "clear"), 1.0).otherwise(0.0))
    raw = conf * map_value(rel, RELATION_WEIGHT, 0.35) * map_value(label, LABEL_PRIOR, 0.3) * map_value(scope, SCOPE_WEIGHT, 0.2) / F.log2(degree + 2)
    return F.floor(raw * 1000000 + 1e-6).cast("bigint")


def anchor_summary(matches: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    """Scores per (session, candidate) and role bucket, and the anchor tier; ``more`` are other aggregates of the same pass.

    ``matches``: ``session_id, candidate_id, polarity, resolution, rel, role, scope, score``.
    """
    neg = (F.col("polarity") == "absent") & (F.col("resolution") == "clear") & (F.col("scope") != "background_scope") & (
        F.col("role").isin("disease_specific_anchor", "definition_anchor") | F.col("rel").isin(*ANCHOR_RELATIONS))
    role = F.when(F.col("scope") == "background_scope", "background_context").when(
        F.col("scope").isin("family_scope", "competing_scope") & F.col("role").isin("disease_specific_anchor", "definition_anchor"), "family_anchor").otherwise(F.col("role"))
    clear = F.col("resolution") == "clear"
    bucket = (F.when(neg, "negative").when(F.col("polarity") != "present", F.lit(None)).when(role == "background_context", "background")
              .when(role == "definition_anchor", F.when(clear, "definition").otherwise("provisional")).when(role == "family_anchor", "family")
              .when(role == "disease_specific_anchor", F.when(clear, "strong").otherwise("provisional"))
              .when(role == "phenotype_support", "phenotype").otherwise("background"))
    m = matches.withColumn("bucket", bucket)
    names = ("strong", "definition", "family", "provisional", "phenotype", "background", "negative")
    competing = F.sum(F.when((F.col("bucket") == "family") & (F.col("scope") == "competing_scope"), F.col("score")).otherwise(0))
    out = m.where("session_id IS NOT NULL AND candidate_id IS NOT NULL").groupBy("session_id", "candidate_id").agg(
        *[F.sum(F.when(F.col("bucket") == n, F.col("score")).otherwise(0)).alias(n) for n in names],
        *[F.sum(flag(F.col("bucket") == n)).alias(f"n_{n}") for n in names], competing.alias("competing"), *more)
    tier = None
    for n, label in zip(names, ("strong_anchor", "definition_anchor", "family_anchor", "provisional_anchor", "phenotype_supported", "background_supported", "negative_anchor")):
        tier = F.when(F.col(f"n_{n}") > 0, label) if tier is None else tier.when(F.col(f"n_{n}") > 0, label)
    exact = F.col("strong") + F.col("definition")
    provisional = F.floor(F.col("provisional") * 65 / 100).cast("bigint")
    return out.withColumns({
        "anchor_tier": tier.otherwise("speculative"), "exact": exact,
        "background_attractor": F.when(exact + F.col("family") == 0, F.col("background")).otherwise(0),
        "observed": exact + F.col("family") + provisional,
        "role_specificity": F.floor((exact * 100 + F.col("family") * 80 + provisional * 100 + F.col("phenotype") * 25) / 100).cast("bigint")})


def scope_cluster(exact: Column, family: Column, provisional: Column, facets: Column, missing: Column, generic: Column, need: Column) -> Column:
    """Bonus for covered scope, less for a candidate that is too general or lacks observed scope."""
    seen = F.size(facets) > 0
    up = (F.when((exact > 0) & (F.size(missing) == 0) & seen, CLUSTER_EXACT).when((family > 0) & seen, CLUSTER_EXACT * 0.45)
          .when((provisional > 0) & seen, CLUSTER_EXACT * 0.2).otherwise(0.0))
    return up - F.when(generic > 0, F.least(generic / 0.38, F.lit(1.0)) * CLUSTER_GENERIC).otherwise(0.0) - F.when(
        need > 0, F.least(need * 0.35, F.lit(CLUSTER_GENERIC))).otherwise(0.0)


def anchor_bonus(specificity: Column, cluster: Column, mismatch: Column, generic: Column) -> Column:
    """Rank bonus from a summary; the weights are fixed values."""
    c = lambda n: F.col(n) / 1000000
    return (c("strong") * 2.4 + c("definition") * 2.4 + c("family") * 1.1 + c("provisional") * 0.95 + c("phenotype") * 0.35
            + c("background") * 0.10 + specificity * 0.42 + cluster - c("negative") * 1.45 - c("background_attractor") * 0.82
            - mismatch * 0.92 - generic * 0.85)


def anchor_rerank(summary: DataFrame) -> DataFrame:
    """Order the candidates of a session by tier, scope, anchors, penalties, boosted score and name.

    ``summary``: ``anchor_summary`` with ``candidate_name, score`` and the scope columns
    ``cluster, specificity, mismatch, generic``; the score is boosted before it sorts.
    """
    t = summary.withColumns({
        "_tier": map_value(F.col("anchor_tier"), TIER_PRIORITY, 1),
        "boosted": F.greatest(F.col("score") + anchor_bonus(F.col("specificity"), F.col("cluster"), F.col("mismatch"), F.col("generic")), F.lit(0.0))})
    w = Window.partitionBy("session_id").orderBy(
        F.desc("_tier"), F.desc("cluster"), F.desc("exact"), F.desc("family"), F.desc("role_specificity"), F.desc("specificity"), F.desc("observed"),
        F.asc("background_attractor"), F.asc("mismatch"), F.asc("generic"), F.desc("boosted"), "candidate_name", "candidate_id")  # few candidates a session
    return t.withColumn("anchor_rank", F.row_number().over(w)).drop("_tier")


def low_cost_profile(matches: DataFrame) -> DataFrame:
    """Low-cost positive support and its distinct families per (session, candidate).

    ``matches``: ``session_id, candidate_id, node_id, polarity, resolution, role, scope, mode,
    cost, label, rel, families`` (canonical).
    """
    fam = F.filter("families", lambda f: ~f.isin(*LOW_COST_EXCLUDED))
    fallback = (F.when(F.col("role") == "phenotype_support", F.array(F.lit("phenotype"))).when(F.col("role") == "risk_or_comorbidity", F.array(F.lit("risk_or_comorbidity")))
                .when(F.col("role") == "definition_anchor", F.array(F.lit("definition_detail"))).when(F.col("role") == "family_anchor", F.array(F.lit("family_anchor")))
                .otherwise(F.array().cast("array<string>")))
    m = matches.withColumn("_f", F.when(F.size(fam) > 0, fam).otherwise(fallback))
    costly = F.col("mode").isin("needs_lab_test", "needs_imaging", "needs_pathogen_test") | (F.col("cost") == "high")
    cheap = F.col("mode").isin("direct_ask", "history_known") | (F.col("cost") == "low") | (F.col("label") == "ClinicalFinding") | (F.col("rel") == "MANIFESTS_AS")
    ok = m.where((F.col("polarity") == "present") & (F.col("resolution") == "clear") & (F.col("scope") != "background_scope")
                 & (F.col("role") != "background_context") & (F.size("_f") > 0) & ~costly & cheap)
    families = F.size(F.array_distinct(F.flatten(F.collect_set("_f")))).cast("bigint")  # sets of a closed vocabulary
    out = ok.where("session_id IS NOT NULL AND candidate_id IS NOT NULL").groupBy("session_id", "candidate_id").agg(
        F.count(F.lit(1)).alias("low_cost_items"), families.alias("low_cost_families"))
    return out.withColumn("satisfied", (F.col("low_cost_items") >= 2) & (F.col("low_cost_families") >= 2))


# -- answers ------------------------------------------------------------------------------------------------

def rank_prior(rank: Column) -> Column:
    """Prior of a candidate by its rank (1-based)."""
    return F.greatest(F.lit(0.08) - (rank - 1) * 0.02, F.lit(0.0))


def trajectory_groups(trajectories: DataFrame, slice_rows: int = 1024) -> DataFrame:
    """Consistency, diversity, agent score and final score per (session, answer).

    ``trajectories``: ``session_id, answer, score100, terminal, actions`` with ``actions`` the
    sorted distinct action names.  Equal action sets are counted, not paired; the Jaccard
    of two different sets is kept in millionths so that the mean is exact.
    """
    key = ["session_id", "answer"]
    base = trajectories.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score100").alias("s"), F.max("score100").alias("m"), F.sum(flag(F.col("terminal"))).alias("t"))
    total = base.groupBy("session_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"))
    sets = trajectories.groupBy(*key, "actions").agg(F.count(F.lit(1)).alias("k"))
    # Only sets with an action in common meet, at the first action they share; frequent actions are
    # dealt into slices.  Pairs are summed up where they meet and never leave the task.
    posted = sets.select(*key, F.explode("actions").alias("action"), "actions", "k")
    load = posted.groupBy(*key, "action").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("slices"))
    posted = posted.join(load, [*key, "action"])
    a = posted.select(*key, "action", F.pmod(F.xxhash64("actions"), "slices").alias("slice"), F.col("actions").alias("a"), F.col("k").alias("ka"))
    b = posted.select(*key, "action", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"),
                      F.col("actions").alias("b"), F.col("k").alias("kb"))
    shared = F.array_intersect("a", "b")
    meets = a.join(b, [*key, "action", "slice"]).where((F.col("a") < F.col("b")) & (F.get(shared, F.lit(0)) == F.col("action")))
    sim = F.floor(F.size(shared) * 1000000 / (F.size("a") + F.size("b") - F.size(shared)))
    cross = meets.groupBy(*key).agg(F.sum(sim * F.col("ka") * F.col("kb")).alias("x"))
    same = sets.groupBy(*key).agg(F.sum(F.floor(F.col("k") * (F.col("k") - 1) / 2) * 1000000).alias("y"))
    out = base.join(total, "session_id").join(same, key).join(cross, key, "left")
    pairs = F.floor(F.col("n") * (F.col("n") - 1) / 2)
    diversity = F.when(pairs == 0, 0.0).otherwise(1.0 - (F.coalesce("x", F.lit(0)) + F.col("y")) / F.greatest(pairs, F.lit(1)) / 1000000)
    out = out.withColumns({"consistency": F.col("n") / F.col("total"), "diversity": diversity, "agent": group_agent_score()})
    return out.withColumn("final_score", F.col("consistency") * 0.3 + F.col("diversity") * 0.4 + F.col("agent") * 0.3).drop("x", "y")


def group_agent_score() -> Column:
    """0.55 mean + 0.30 best + 0.15 terminal share, within [0, 1]."""
    mean, best, term = F.col("s") / F.col("n") / 100, F.col("m") / 100, F.col("t") / F.col("n")
    return F.greatest(F.least(mean * 0.55 + best * 0.30 + term * 0.15, F.lit(1.0)), F.lit(0.0))


def best_trajectory(trajectories: DataFrame) -> DataFrame:
    """Best trajectory per (session, answer): score, then id."""
    return trajectories.groupBy("session_id", "answer").agg(
        F.min(F.struct((-F.col("score100")).alias("s"), F.col("trajectory_id").alias("id"))).alias("b")).select(
        "session_id", "answer", F.col("b.id").alias("trajectory_id"), (-F.col("b.s")).alias("score100"))


def alternative_gaps(scores: DataFrame) -> DataFrame:
    """Best answer minus ranks 2 and 3 on three scores."""
    top = top_k(scores, ["session_id"], [F.desc("final_score"), F.col("answer")], 3)
    best = top.where("rank = 1").select("session_id", *[F.col(c).alias(f"_{c}") for c in ("final_score", "consistency", "agent")])
    rest = top.where("rank > 1").join(best, "session_id")
    return rest.select("session_id", "answer", "rank", *[(F.col(f"_{c}") - F.col(c)).alias(f"{c}_gap") for c in ("final_score", "consistency", "agent")])


def acceptance_decision(mode: Column, should_accept: Column, reject: Column) -> dict[str, Column]:
    """Stop decision and the reason a repair has to deal with."""
    ready = F.coalesce(mode.isin("llm_verifier", "observed_evidence_final_evaluator"), F.lit(False))
    ok = ready & F.coalesce(should_accept, F.lit(False))
    return {"stop": ok, "reason": F.when(mode.isNull(), "no_answer_score").when(~ready, "verifier_not_ready").when(ok, "final_answer_accepted").otherwise("verifier_rejected_stop"),
            "repair_reason": F.when(ready & ~ok, text_or(reject, "missing_key_support"))}


def acceptance_guards(accept: Column, score: Column, scope_block: Column, missing_facets: Column, support: Column, simulated: Column) -> dict[str, Column]:
    """Block acceptance on a scope gap or on simulated-only support."""
    scope = accept & ((scope_block >= 0.28) | (missing_facets > 0))
    alone = accept & (support == 0) & (simulated > 0)
    return {"accept": accept & ~scope & ~alone, "score": F.when(scope | alone, F.least(score, F.lit(0.64))).otherwise(score),
            "guard": F.when(alone, "missing_key_support").when(scope, "strong_alternative_not_ruled_out")}


def reason_codes(accept: Column, score: Column, accept_reason: Column, reject_reason: Column, n_alternatives: Column, n_trajectories: Column) -> dict[str, Column]:
    """Allowed codes stay; others are inferred and marked so."""
    a_ok, r_ok = accept_reason.isin(*ACCEPT_REASONS), reject_reason.isin(*REJECT_REASONS)
    r = F.when(r_ok, reject_reason).when(n_alternatives > 0, "strong_alternative_not_ruled_out").when(n_trajectories <= 1, "trajectory_insufficient").otherwise("missing_key_support")
    a = (F.when(a_ok, accept_reason).when(accept & (score >= 0.9), "key_support_sufficient")
         .when(accept & (r == "strong_alternative_not_ruled_out"), "alternatives_reasonably_ruled_out").otherwise("trajectory_stable"))
    src = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "llm_schema").otherwise("fallback_inferred")
    return {"accept_reason": a, "accept_source": src(a_ok), "reject_reason": r, "reject_source": src(r_ok)}


def alternative_strength(explicit: Column, reason: Column) -> dict[str, Column]:
    """Strong, medium or weak competitor and why."""
    raw, text = F.lower(text_or(explicit)), match_text(F.coalesce(reason, F.lit("")))
    s = (F.when(raw.isin(*STRONG_WORDS), "explicit_strong").when(raw.isin(*WEAK_WORDS), "explicit_weak").when(contains_any(text, STRONG_MARKERS), "reason_strong")
         .when(contains_any(text, WEAK_MARKERS), "reason_weak").when(text == "", "no_reason").otherwise("none"))
    return {"strength": F.when(s.isin("explicit_strong", "reason_strong", "no_reason"), "strong").when(s.isin("explicit_weak", "reason_weak"), "weak").otherwise("medium"),
            "strength_reason": s}


def verifier_repair(pool: DataFrame) -> DataFrame:
    """Candidates re-ranked after a rejection.

    ``pool``: ``session_id, candidate_id, candidate_name, score, rank, current, alternative,
    reject_reason, times, exact, family, phenotype`` (the last three in millionths).
    """
    reason = F.col("reject_reason")
    penalty = F.when(~F.col("current"), 0.0).when(
        reason.isin("strong_alternative_not_ruled_out", "strong_unresolved_alternative_candidates", "anchored_alternative_exists"), 0.25).when(
        reason == "hard_negative_key_evidence", 0.32).when(
        reason.isin("missing_key_support", "missing_required_anchor", "insufficient_evidence_family_coverage"),
        F.lit(0.12) + F.least(F.col("times") * 0.08, F.lit(0.30))).when(reason == "trajectory_insufficient", 0.08).otherwise(0.0)
    c = lambda n: F.col(n) / 1000000
    anchor = F.least(c("exact") * 0.22 + c("family") * 0.14 + c("phenotype") * 0.04, F.lit(0.18))
    bonus = F.when(F.col("alternative"), F.greatest(F.lit(0.35) - (F.col("rank") - 1) * 0.05, F.lit(0.175)) + anchor).otherwise(0.0)
    out = pool.withColumn("repaired", F.greatest(F.col("score") + (bonus - penalty), F.lit(0.0)))
    w = Window.partitionBy("session_id").orderBy(F.desc("repaired"), "candidate_name", "candidate_id")
    return out.withColumn("repaired_rank", F.row_number().over(w))


# --- fixed values: marks of evidence that costs an examination; a lead that counts ------------------
COSTLY_MARKS = ("检查", "结果", "报告", "化验", "检测", "ct", "mri", "影像", "核酸", "pcr", "培养", "病原", "cd4", "病毒载量", "葡聚糖")
LEAD = 50000
RETRIES = 2


def costly_evidence(text: Column) -> Column:
    """The text asks for something that needs an examination."""
    return contains_any(match_text(text, drop=" -_/+"), COSTLY_MARKS)


def escalate(pool: DataFrame, keep: int = 3, retries: int = RETRIES) -> DataFrame:
    """Sessions whose leading candidate lacks key support while rivals wait: the rivals and the reasons.

    A rival has more observed or exact anchors by more than ``LEAD`` millionths, or any anchor
    of a high tier, or is named as an alternative.  Reasons: the leader has no anchor and a
    stronger rival exists; its support was missed ``retries`` times (no stronger rival
    needed); the evidence asked for is costly and a stronger rival exists.  ``pool``:
    ``session_id, candidate_id, candidate_name, rank, reject_reason, observed, exact, family,
    anchor_tier, alternative, times, costly_gap`` (the last two of the leader).
    """
    rivals = beside_lead(pool, (F.col("rank") == 1) & (F.col("reject_reason") == "missing_key_support"), leader=F.col("candidate_id"),
                         _o=F.col("observed"), _e=F.col("exact"), _t=F.col("times"), _c=F.col("costly_gap")).where("rank > 1")
    stronger = (F.col("observed") > F.col("_o") + LEAD) | (F.col("exact") > F.col("_e") + LEAD)
    anchored = F.col("anchor_tier").isin("strong_anchor", "definition_anchor", "family_anchor") & (F.col("observed") > 0)
    rivals = rivals.where(stronger | anchored | F.col("alternative")).withColumn("_s", stronger)
    best = top_k(rivals, ["session_id"], [F.desc("exact"), F.desc("observed"), F.desc("family"), F.col("candidate_name"), F.col("candidate_id")], keep, "rival_rank")
    best = best.withColumn("_any", F.max("_s").over(Window.partitionBy("session_id")))
    why = F.concat_ws(",", F.when((F.col("_o") <= 0) & F.col("_any"), "zero_anchor"), F.when(F.col("_t") >= retries, "repeated_rejection"),
                      F.when(F.col("_c") & F.col("_any"), "costly_gap"))
    return best.withColumn("reasons", why).where("reasons <> ''").select(
        "session_id", "leader", "candidate_id", "rival_rank", "reasons")


def remaining_low_cost(rows: DataFrame, keep: int = 12) -> DataFrame:
    """Unasked low-cost evidence over a session's candidates, best first."""
    low = rows.where(F.col("mode").isin("direct_ask", "history_known") & (F.col("cost") != "high"))
    best = low.groupBy("session_id", "node_id").agg(F.max("priority").alias("priority"), F.min("name").alias("name"))
    return top_k(best, ["session_id"], [F.desc("priority"), F.col("name"), F.col("node_id")], keep)
