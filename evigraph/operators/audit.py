"""Graph audit: evidence profiles per disease, reports, differential pairs, family catalog.

An evidence item row has ``disease_id, node_id, name, label, grp, rel, priority, spec100,
rel_w100, node_w100, mode, cost``.  Items are the first 80 of a disease, so windows and
arrays per disease stay bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import containment_pairs
from ..functions.tags import Rule, tags
from ..functions.text import blank, let, map_value, match_text
from ..functions.vocab import EVIDENCE_GROUPS, LABEL_GROUP
from .replay import flag, rate
from .retrieve import DEFAULT, evidence_profile, grouped_evidence, top_k

# --- fixed values ------------------------------------------------------------------------------
ITEM_LIMIT = 80
LOW_EVIDENCE = 6
EXAM_GROUPS = ("lab", "imaging", "pathogen")
ASK_MODES = ("direct_ask", "history_known")
SHARED_RATIO = 0.55
REQUIRED_FIELDS = ("group", "relation_type", "priority", "relation_specificity", "acquisition_mode", "evidence_cost")
RELATION_TO_GROUP = {
    "MANIFESTS_AS": "symptom", "HAS_LAB_FINDING": "lab", "DIAGNOSED_BY": "lab", "HAS_IMAGING_FINDING": "imaging",
    "HAS_PATHOGEN": "pathogen", "RISK_FACTOR_FOR": "risk", "APPLIES_TO": "risk", "REQUIRES_DETAIL": "detail",
}
GENERIC_FAMILIES = ("general_symptom", "general_lab", "general_risk", "general_detail")
FALLBACK_FAMILY = {
    "symptom": "general_symptom", "risk": "general_risk", "detail": "general_detail", "lab": "general_lab",
    "imaging": "imaging", "pathogen": "pathogen",
}

# --- fixed values: which family serves best as a minimum requirement ------------------------------
FAMILY_PRIORITY = {
    "fungal_pathogen": 104, "mycobacterial_pathogen": 104, "viral_pathogen": 104, "parasitic_pathogen": 104,
    "bacterial_pathogen": 104, "disease_specific_lab": 102, "pathogen": 100, "immune_status": 98, "viral_load": 98,
    "oxygenation": 98, "fungal_marker": 98, "cns_lab": 98, "worsening": 96, "respiratory_symptom": 94,
    "neurologic_symptom": 94, "pulmonary_imaging": 92, "cns_imaging": 92, "abdominal_imaging": 90,
    "lymph_node_imaging": 90, "cardiovascular_imaging": 90, "bone_imaging": 90, "imaging": 88,
    "severe_systemic_symptom": 88, "underlying_infection": 88, "art_or_reconstitution": 88, "metabolic_symptom": 86,
    "metabolic_definition": 86, "pathology": 84, "serology": 84, "inflammatory_marker": 83,
    "dermatologic_symptom": 82, "blood_count": 82, "gastrointestinal_symptom": 80, "liver_renal_function": 80,
    "genitourinary_symptom": 78, "onset_timing": 78, "ocular_symptom": 76, "severity": 76, "oral_ent_symptom": 74,
    "treatment_response": 74, "hematologic_symptom": 72, "exposure_risk": 72, "lymphatic_symptom": 70,
    "medication_risk": 70, "comorbidity_risk": 69, "cardiovascular_symptom": 68, "population_risk": 68,
    "musculoskeletal_symptom": 66, "location_detail": 64, "mental_symptom": 62, "constitutional_symptom": 50,
    "general_lab": 10, "general_risk": 8, "general_detail": 6, "general_symptom": 1,
}


def name_key(col: Column) -> Column:
    return match_text(col, drop=" 。、-_/", fold={"（": "(", "）": ")", "，": ","})


def audit_items(evidence: DataFrame, limit: int | None = ITEM_LIMIT) -> DataFrame:
    """Audit profile: deduplicated evidence of each disease, best ``limit`` items; without a limit all of them, unranked."""
    if limit is None:
        p, rank = grouped_evidence(evidence), []
    else:
        p, rank = evidence_profile(evidence, replace(DEFAULT, profile_limit=limit, profile_group_limit=limit)), ["profile_rank"]
    return p.select(F.col("candidate_id").alias("disease_id"), "node_id", "name", "label", "grp", "rel", "priority",
                    F.col("contradiction").alias("spec100"), "rel_w100", "node_w100", "mode", "cost", *rank)


def audit_score() -> Column:
    bonus = F.when(F.col("grp").isin(*EXAM_GROUPS), 0.2).otherwise(0.0)
    return F.col("priority") / 10000 + F.col("spec100") / 100 * 0.55 + F.col("rel_w100") / 100 * 0.2 + bonus


def audit_rank(items: DataFrame) -> DataFrame:
    w = Window.partitionBy("disease_id").orderBy(F.desc("audit_score"), "grp", "name", "node_id")
    return items.withColumn("audit_score", audit_score()).withColumn("audit_rank", F.row_number().over(w))


def valid_reports(items: DataFrame, fields: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Split diseases by whether any of their items lacks a required field.

    ``fields`` maps the reported field name to its column.
    """
    lacks = [F.max(F.when(F.col(c).isNull(), F.lit(f))).alias(f"_{f}") for f, c in fields.items()]
    bad = items.groupBy("disease_id").agg(*lacks)
    missing = F.concat_ws(",", *[F.col(f"_{f}") for f in fields])
    bad = bad.select("disease_id", missing.alias("missing_fields"))
    return bad.where("missing_fields = ''").select("disease_id"), bad.where("missing_fields <> ''")


def group_summary(items: DataFrame, diseases: DataFrame) -> DataFrame:
    """Per disease and group: count, means, high-cost count, best names; empty groups appear with zeros."""
    spark = items.sparkSession
    groups = F.broadcast(spark.createDataFrame([(g,) for g in EVIDENCE_GROUPS], "grp string"))
    agg = items.groupBy("disease_id", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("priority").alias("_p"), F.sum("spec100").alias("_s"),
        F.sum(flag(F.col("cost") == "high")).alias("high_cost"))
    best = top_k(audit_rank(items), ["disease_id", "grp"], [F.col("audit_rank")], 5)
    names = best.groupBy("disease_id", "grp").agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_n"))
    names = names.select("disease_id", "grp", F.concat_ws("|", F.transform("_n", lambda x: x["name"])).alias("top_names"))
    out = diseases.select("disease_id").crossJoin(groups)  # six fixed groups
    out = out.join(agg, ["disease_id", "grp"], "left").join(names, ["disease_id", "grp"], "left")
    return out.select(
        "disease_id", "grp", F.coalesce("n", F.lit(0)).alias("n"),
        (rate(F.col("_p"), F.col("n")) / 10000).alias("avg_priority"), (rate(F.col("_s"), F.col("n")) / 100).alias("avg_specificity"),
        F.coalesce("high_cost", F.lit(0)).alias("high_cost"), F.coalesce("top_names", F.lit("")).alias("top_names"))


def audit_issues(items: DataFrame, diseases: DataFrame, threshold: int = LOW_EVIDENCE) -> DataFrame:
    """No evidence is an error, too little a warning."""
    n = items.groupBy("disease_id").agg(F.count(F.lit(1)).alias("n"))
    out = diseases.select("disease_id").join(n, "disease_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumns({
        "severity": F.when(F.col("n") == 0, "error").when(F.col("n") <= threshold, "warning"),
        "code": F.when(F.col("n") == 0, "no_evidence").when(F.col("n") <= threshold, "too_few_evidence")})
    return out.where("code IS NOT NULL").select("disease_id", "severity", "code", F.col("n").alias("evidence_count"))


def low_evidence(items: DataFrame, diseases: DataFrame, threshold: int) -> DataFrame:
    """Diseases with at most ``threshold`` evidence items, fewest first."""
    n = items.groupBy("disease_id").agg(F.count(F.lit(1)).alias("n"))
    out = diseases.join(n, "disease_id", "left").withColumn("evidence_count", F.coalesce("n", F.lit(0))).drop("n")
    return out.where(F.col("evidence_count") <= threshold).orderBy("evidence_count", "disease_name", "disease_id")


def disease_summary(items: DataFrame, issues: DataFrame, diseases: DataFrame) -> DataFrame:
    """Counts per disease: evidence, issues, groups present, exam, askable, high-cost."""
    has = [F.max(F.when(F.col("grp") == g, F.lit(g))).alias(f"_{g}") for g in EVIDENCE_GROUPS]
    a = items.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.sum(flag(F.col("grp").isin(*EXAM_GROUPS))).alias("exam_evidence_count"),
        F.sum(flag(F.col("mode").isin(*ASK_MODES))).alias("direct_ask_count"),
        F.sum(flag(F.col("cost") == "high")).alias("high_cost_count"), *has)
    i = issues.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("issue_count"), F.sum(flag(F.col("severity") == "error")).alias("error_count"),
        F.sum(flag(F.col("severity") == "warning")).alias("warning_count"))
    out = diseases.select("disease_id").join(a, "disease_id", "left").join(i, "disease_id", "left")
    nums = ["evidence_count", "exam_evidence_count", "direct_ask_count", "high_cost_count", "issue_count", "error_count", "warning_count"]
    return out.select("disease_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in nums],
                      F.concat_ws(",", *[F.col(f"_{g}") for g in EVIDENCE_GROUPS]).alias("groups_present"))


# -- differential pairs -----------------------------------------------------------------------------

def split_pair(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Evidence of listed disease pairs as shared, target_only or competitor_only.

    Two items are the same when ids or normalised names agree.  Only the given pairs are
    compared.
    """
    it = items.withColumn("nkey", name_key(F.col("name")))
    cols = ["node_id", "nkey", "name", "grp", "priority", "spec100", "rel_w100"]

    def side(me: str, other: str, shared: str, alone: str) -> DataFrame:
        mine = pairs.join(it.select(F.col("disease_id").alias(me), *cols), me)
        theirs = pairs.join(it.select(F.col("disease_id").alias(other), "node_id", "nkey", "priority", "profile_rank"), other)
        by_id = theirs.groupBy("target_id", "competitor_id", "node_id").agg(
            F.min_by("priority", "profile_rank").alias("_pi"))
        by_name = theirs.where("nkey <> ''").groupBy("target_id", "competitor_id", "nkey").agg(
            F.min_by("priority", "profile_rank").alias("_pn"))
        out = mine.join(by_id, ["target_id", "competitor_id", "node_id"], "left").join(
            by_name, ["target_id", "competitor_id", "nkey"], "left")
        other_priority = F.coalesce("_pi", "_pn")
        return out.select("target_id", "competitor_id", F.when(other_priority.isNull(), alone).otherwise(shared).alias("bucket"),
                          *cols, other_priority.alias("other_priority"))

    mine = side("target_id", "competitor_id", "shared", "target_only")
    theirs = side("competitor_id", "target_id", "other_shared", "competitor_only").where("bucket = 'competitor_only'")
    return mine.unionByName(theirs)


def pair_issues(split: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per pair and its issues as one comma list in fixed order."""
    n = lambda cond, name: F.sum(flag(cond)).alias(name)
    b = F.col("bucket")
    strong = (b == "target_only") & ((F.col("priority") >= 10000) | (F.col("spec100") >= 85))
    agg = split.groupBy("target_id", "competitor_id").agg(
        n(b == "shared", "shared_count"), n(b == "target_only", "target_only_count"), n(b == "competitor_only", "competitor_only_count"),
        n(F.col("grp").isin(*EXAM_GROUPS), "exam_pool_count"), n(strong, "strong_target_count"))
    out = pairs.select("target_id", "competitor_id").join(agg, ["target_id", "competitor_id"], "left")
    nums = ["shared_count", "target_only_count", "competitor_only_count", "exam_pool_count", "strong_target_count"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in nums})
    total = F.col("shared_count") + F.col("target_only_count") + F.col("competitor_only_count")
    issues = F.when(total == 0, "empty_pair_evidence").otherwise(F.concat_ws(
        ",", F.when(F.col("target_only_count") == 0, "missing_target_only_evidence"),
        F.when(F.col("competitor_only_count") == 0, "missing_competitor_only_evidence"),
        F.when(rate(F.col("shared_count"), total) >= SHARED_RATIO, "shared_evidence_ratio_high"),
        F.when(F.col("exam_pool_count") == 0, "empty_exam_pool"),
        F.when(F.col("strong_target_count") == 0, "weak_target_only_evidence")))
    return out.withColumn("issues", issues)


def disease_lookup(requests: DataFrame, diseases: DataFrame) -> DataFrame:
    """Resolve a request text by id, name, canonical name or alias.

    ``requests``: ``request``; ``diseases``: ``disease_id, disease_name, aliases``.  An
    exact id or name beats aliases; more than one hit is ambiguous.
    """
    keys = diseases.select("disease_id", F.explode(F.array_distinct(F.concat(
        F.array(F.struct(F.lit(0).alias("p"), F.col("disease_id").alias("k")), F.struct(F.lit(0).alias("p"), F.col("disease_name").alias("k"))),
        F.transform("aliases", lambda a: F.struct(F.lit(1).alias("p"), a.alias("k")))))).alias("x"))
    keys = keys.groupBy("disease_id", F.col("x.k").alias("request")).agg(F.min("x.p").alias("p"))
    wanted = requests.select("request").distinct()
    hit = wanted.join(keys.where(~blank(F.col("request"))), "request")
    # hits per request and kind are counted before anything is picked
    agg = hit.groupBy("request", "p").agg(F.count(F.lit(1)).alias("n"), F.min("disease_id").alias("d"))
    best = agg.groupBy("request").agg(F.min_by(F.struct("n", "d"), "p").alias("b"))
    out = wanted.join(best, "request", "left")
    n = F.coalesce(F.col("b.n"), F.lit(0))
    return out.select("request", F.when(n == 1, F.col("b.d")).alias("disease_id"),
                      F.when(n == 0, "not_found").when(n == 1, "unique").otherwise("ambiguous").alias("outcome"))


# -- family catalog -------------------------------------------------------------------------------------

def evidence_group(explicit: Column, label: Column, rel: Column) -> Column:
    """Explicit group when valid, else by label, else by relation, else empty."""
    return F.coalesce(F.when(explicit.isin(*EVIDENCE_GROUPS), explicit), map_value(label, LABEL_GROUP),
                      map_value(rel, RELATION_TO_GROUP), F.lit(""))


def family_tags(text: Column, group: Column, rules: Mapping[str, Sequence[Rule]], common: Sequence[Rule] = (),
                always: Mapping[str, str] | None = None) -> Column:
    """Families of an evidence text: common rules, the rules of its group, else the group's fallback.

    ``always`` names a family every item of a group has (e.g. imaging).
    """
    always = {"imaging": "imaging", "pathogen": "pathogen"} if always is None else always
    none = F.array().cast("array<string>")
    parts = [tags(text, common)] if common else []
    parts += [F.when(group == g, tags(text, rule)).otherwise(none) for g, rule in rules.items()]
    parts += [F.when(group == g, F.array(F.lit(family))).otherwise(none) for g, family in always.items()]
    found = F.array_distinct(F.concat(*parts, none))
    fallback = F.array(map_value(group, FALLBACK_FAMILY, "general_detail"))
    return let(found, lambda x: F.when(F.size(x) == 0, fallback).otherwise(x))


def family_rows(evidence: DataFrame, rules: DataFrame, always: Mapping[str, str] | None = None) -> DataFrame:
    """``evidence_id, grp, family`` by a rule table of any size; as :func:`family_tags` does by literal rules.

    ``evidence``: ``evidence_id, name, grp``; ``rules``: ``grp, family, term`` with group
    ``*`` for all.  Every distinct name meets the distinct terms once, through an index on
    character grams in which a term is looked up by its rarest gram; the terms found then
    bring their families.
    """
    always = {"imaging": "imaging", "pathogen": "pathogen"} if always is None else always
    e = evidence.select("evidence_id", F.lower("name").alias("name"), "grp")
    hits = containment_pairs(rules.select(F.col("term").alias("name")), e.select("name")).toDF("term", "name")
    by_name = hits.join(rules.withColumnRenamed("grp", "rule_grp"), "term").select("name", "rule_grp", "family").distinct()
    found = e.join(by_name, "name").where("rule_grp = '*' OR rule_grp = grp").select("evidence_id", "grp", "family")
    fixed = map_value(F.col("grp"), always, "")
    found = found.unionByName(e.select("evidence_id", "grp", fixed.alias("family")).where("family <> ''")).distinct()
    rest = e.select("evidence_id", "grp").join(found.select("evidence_id").distinct(), "evidence_id", "left_anti")
    return found.unionByName(rest.select("evidence_id", "grp", map_value(F.col("grp"), FALLBACK_FAMILY, "general_detail").alias("family")))


def family_priority(col: Column, priority: Mapping[str, int] = FAMILY_PRIORITY) -> Column:
    return map_value(col, priority, 0)


def dedupe_edges(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row per (disease, evidence, relation, direction)."""
    key = ["disease_id", "evidence_id", "rel", "direction"]
    rest = [c for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def family_catalog(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges per disease, evidence group and family.

    ``evidence``: ``evidence_id, grp, families`` tagged once per node, not once per edge.
    """
    f = evidence.select("evidence_id", "grp", F.explode("families").alias("family"))
    return edges.join(f, "evidence_id").groupBy("disease_id", "grp", "family").agg(F.count(F.lit(1)).alias("n"))


def evidence_nodes(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Number of diseases per evidence node, and whether only generic families fit it."""
    d = edges.select("disease_id", "evidence_id").distinct().groupBy("evidence_id").agg(F.count(F.lit(1)).alias("disease_count"))
    generic = F.forall("families", lambda x: x.isin(*GENERIC_FAMILIES))
    return evidence.join(d, "evidence_id").withColumn("unclassified", generic)


def minimum_groups(counts: DataFrame, keys: Sequence[str], limit: int, priority: Mapping[str, int] = FAMILY_PRIORITY) -> DataFrame:
    """Families best suited as minimum evidence: by priority, count, name; the generic one only alone."""
    per = counts.groupBy(*keys, "family").agg(F.sum("n").alias("n"))
    other = per.where("family <> 'general_symptom'")
    only = per.where("family = 'general_symptom'").join(other.select(*keys).distinct(), list(keys), "left_anti")
    ranked = top_k(other.withColumn("p", family_priority(F.col("family"), priority)), keys,
                   [F.desc("p"), F.desc("n"), F.col("family")], limit)
    return ranked.drop("p").unionByName(only.withColumn("rank", F.lit(1)))


def evidence_connectivity(items: DataFrame, share: int = 8, floor: int = 3) -> DataFrame:
    """Diseases per evidence node, the threshold ``max(3, ceil(8% of diseases))`` and whether it is reached."""
    n = items.select("disease_id", "node_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("disease_count"))
    total = items.select("disease_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    limit = total.select(F.greatest(F.lit(floor), F.floor((F.col("_n") * share + 99) / 100)).cast("bigint").alias("threshold"))
    out = n.crossJoin(F.broadcast(limit))  # one row
    return out.withColumn("high", F.col("disease_count") >= F.col("threshold"))
