"""Assembling labelled cases from audited evidence: pools, competitors, selection, QC."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.overlap import STRIP, Overlap, first_columns
from ..functions.overlap import jaccard as inter_over_union
from ..functions.text import contains_any, match_text
from ..sources.sinks import written
from .audit import EXAM_GROUPS, name_key
from .replay import flag
from .retrieve import top_k

# --- fixed values --------------------------------------------------------------------------------
LOW_COST_GROUPS = ("symptom", "risk", "detail")
LOW_COST_MODES = ("direct_ask", "history_known")
EXAM_MODES = ("needs_lab_test", "needs_imaging", "needs_pathogen_test")
HIGH_VALUE_RELATIONS = ("DIAGNOSED_BY", "HAS_LAB_FINDING", "HAS_IMAGING_FINDING", "HAS_PATHOGEN")
CASE_TYPES = ("ordinary", "low_cost", "exam_driven", "competitive")
POSITIVE_LIMIT = 8
NEGATIVE_LIMIT = 3
OPENING_LIMIT = 3
POOL_MINIMUM = {"ordinary_total": 4, "ordinary_chief": 2, "low_cost": 4, "exam": 3, "exam_high_value": 2,
                "shared": 2, "target_only": 2, "competitor_negative": 1}
RESULT_MARKERS = ("阳性", "阴性", "升高", "降低", "减少", "增多", "异常", "<", ">", "≤", "≥", "检出", "提示",
                  "磨玻璃影", "空洞", "结节", "浸润", "溃疡")
PLAIN_CD4 = ("cd4", "cd4+", "cd4+t淋巴细胞计数", "cd4+t细胞计数", "cd4细胞计数", "cd4计数", "基线cd4+t淋巴细胞计数")
CONFLICT_FAMILIES = (
    ("bmi", ("bmi", "身体质量指数", "kg/m²", "kg/m2")),
    ("cd4", ("cd4",)),
    ("hiv_rna", ("hivrna", "hiv-1rna", "病毒载量")),
    ("hdl", ("高密度脂蛋白", "hdl")),
    ("ldl", ("低密度脂蛋白", "ldl")),
    ("triglyceride", ("甘油三酯", "tg")),
    ("total_cholesterol", ("总胆固醇",)),
    ("egfr", ("egfr", "肾小球滤过率")),
    ("age", ("年龄",)),
)
STATE_TERMS = {
    "hiv_rna": ("低于检测下限", "完全抑制", "未受抑制", "阳性", "高", "低"),
    "ldl": ("升高", "降低"), "hdl": ("降低", "升高"), "triglyceride": ("升高", "降低"),
    "total_cholesterol": ("升高", "降低"), "egfr": ("降低",),
}
PLAIN_NAMES = {
    "hiv_rna": ("hivrna", "hiv-1rna", "hiv病毒载量", "病毒载量", "血浆hiv-1rna"),
    "ldl": ("ldl-c", "低密度脂蛋白胆固醇"), "hdl": ("hdl", "高密度脂蛋白胆固醇"), "triglyceride": ("甘油三酯", "tg"),
    "total_cholesterol": ("总胆固醇",), "egfr": ("egfr", "肾小球滤过率"), "age": ("年龄",),
}
BACKGROUND_FAMILIES = ("immune_status", "underlying_infection", "art_or_reconstitution", "exposure_risk", "medication_risk",
                       "comorbidity_risk", "population_risk", "general_risk", "general_detail", "general_symptom",
                       "constitutional_symptom")
DEFINITION_FAMILIES = ("metabolic_definition", "pathology")
PATHOGEN_FAMILIES = ("pathogen", "fungal_pathogen", "mycobacterial_pathogen", "viral_pathogen", "parasitic_pathogen",
                     "bacterial_pathogen")
SPECIFIC_FAMILIES = (*PATHOGEN_FAMILIES, "disease_specific_lab", "serology", "fungal_marker", "cns_lab", "oxygenation",
                     "viral_load", "imaging", "pulmonary_imaging", "cns_imaging", "abdominal_imaging",
                     "lymph_node_imaging", "cardiovascular_imaging", "bone_imaging")
PHENOTYPE_FAMILIES = ("respiratory_symptom", "neurologic_symptom", "dermatologic_symptom", "gastrointestinal_symptom",
                      "ocular_symptom", "metabolic_symptom", "severe_systemic_symptom")
INFECTION_FAMILIES = (*PATHOGEN_FAMILIES, "disease_specific_lab", "serology", "fungal_marker", "cns_lab",
                      "pulmonary_imaging", "cns_imaging", "abdominal_imaging")
NEURO_FAMILIES = ("neurologic_symptom", "cns_imaging", "cns_lab")
TUMOR_FAMILIES = ("imaging", "abdominal_imaging", "lymph_node_imaging", "cns_imaging", "pulmonary_imaging", "pathology",
                  "disease_specific_lab")
QC_PENALTY = (
    ("no_positive_slots", 80),
    ("missing_disease_specific_or_definition_anchor", 40),
    ("missing_primary_diagnostic_path_core_evidence", 35),
    ("missing_required_family_coverage", 20),
    ("required_family_covered_by_generic_or_background_only", 15),
    ("opening_background_only", 15),
    ("all_positive_slots_high_connectivity_or_background", 25),
)
QC_HARD = ("no_positive_slots", "missing_disease_specific_or_definition_anchor",
           "missing_primary_diagnostic_path_core_evidence", "missing_required_family_coverage",
           "all_positive_slots_high_connectivity_or_background")
BUILTIN_REQUIREMENTS = (
    (("肺孢子", "pcp"), (("respiratory_symptom",), ("immune_status",), ("imaging",), ("oxygenation",), ("fungal_marker", "pathogen"))),
    (("免疫重建炎症综合征", "iris"), (("underlying_infection", "immune_status"), ("art_or_reconstitution",), ("worsening",),
                              ("imaging", "disease_specific_lab", "pathogen"))),
    (("脑炎", "脑膜炎", "脑膜脑炎", "cns", "中枢神经"), (("neurologic_symptom",), ("pathogen", "disease_specific_lab"), ("imaging", "cns_lab"))),
    (("肥胖", "血脂异常", "糖尿病", "代谢"), (("metabolic_definition",),)),
)


# -- measurements and conflicts ------------------------------------------------------------------------

def _number(text: Column) -> Column:
    """A plain number, or ``10^n``."""
    power = F.regexp_extract(text, r"^10\^(\d+)$", 1)
    return F.when(power != "", F.pow(F.lit(10.0), power.try_cast("int"))).otherwise(text.try_cast("double"))


COMPARATOR = r"(<=|>=|<|>|≤|≥)\s*(10\^\d+|\d+(?:\.\d+)?)"
RANGE = r"(\d+(?:\.\d+)?)\s*(?:-|–|~|至)\s*(\d+(?:\.\d+)?)"
BMI_RANGE = r"(\d+(?:\.\d+)?)\s*(?:<=|<|≤)\s*(?:bmi|身体质量指数)\s*(?:<|<=|≤)\s*(\d+(?:\.\d+)?)"


def measurements(text: Column) -> dict[str, Column]:
    """Last comparator and its value, number of comparators, first numeric range."""
    ops = F.regexp_extract_all(text, F.lit(COMPARATOR), F.lit(1))
    vals = F.regexp_extract_all(text, F.lit(COMPARATOR), F.lit(2))
    lo, hi = F.regexp_extract(text, RANGE, 1), F.regexp_extract(text, RANGE, 2)
    return {
        "n_comparators": F.size(ops), "last_op": F.try_element_at(ops, F.lit(-1)),
        "last_value": _number(F.try_element_at(vals, F.lit(-1))),
        "range_low": lo.try_cast("double"), "range_high": hi.try_cast("double")}


def conflict_family(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = CONFLICT_FAMILIES) -> Column:
    """Family of mutually exclusive levels an item belongs to; empty when none."""
    norm = name_text(text)
    out = None
    for name, words in rules:
        cond = contains_any(norm, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("")


def name_text(col: Column) -> Column:
    """Lower case, white space removed, full-width brackets folded."""
    return F.regexp_replace(match_text(col, drop=" "), r"\s+", "")


def strictness(name: Column, family: Column) -> Column:
    """Sort struct: the smaller, the stricter the level an item states within its family."""
    m = measurements(name)
    norm = name_text(name)
    less, more = m["last_op"].isin("<", "<=", "≤"), m["last_op"].isin(">", ">=", "≥")
    v, lo, hi = m["last_value"], m["range_low"], m["range_high"]
    width = F.floor(hi - lo)
    marker = contains_any(name, RESULT_MARKERS) | contains_any(norm, RESULT_MARKERS)

    def key(a, b=0.0, c=0):
        as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        return F.struct(as_col(a, "int").alias("r1"), as_col(b, "double").alias("r2"), as_col(c, "bigint").alias("r3"))

    cd4 = (F.when(less, key(0, v)).when(more, key(1, -v)).when(lo.isNotNull(), key(2, -lo, width))
           .when(contains_any(norm, ("持续低于", "显著降低", "降低")), key(3)).when(F.contains(norm, F.lit("升高")), key(4))
           .when(norm.isin(*PLAIN_CD4), key(6)).when(marker, key(5)).otherwise(key(7)))
    b_lo, b_hi = F.regexp_extract(norm, BMI_RANGE, 1), F.regexp_extract(norm, BMI_RANGE, 2)
    bmi = (F.when(b_lo != "", key(0, -b_lo.try_cast("double"), -F.floor(b_hi.try_cast("double") * 100)))
           .when(more, key(0, -v)).when(less, key(1, v)).when(marker, key(2)).otherwise(key(3)))

    def numeric(fam: str) -> Column:
        up = v if fam == "hdl" else -v
        out = F.when(less, key(0, v)).when(more, key(0, up)).when(lo.isNotNull(), key(1, -lo, width))
        for i, term in enumerate(STATE_TERMS.get(fam, ()), start=1):
            out = out.when(F.contains(norm, F.lit(term)), key(2, float(i)))
        out = out.when(marker, key(2, 99.0))
        plain = PLAIN_NAMES.get(fam, ())
        return (out.when(norm.isin(*plain), key(4)) if plain else out).otherwise(key(5))

    out = F.when(family == "cd4", cd4).when(family == "bmi", bmi)
    for fam in ("hiv_rna", "ldl", "hdl", "triglyceride", "total_cholesterol", "egfr", "age"):
        out = out.when(family == fam, numeric(fam))
    return out.otherwise(key(9))


def conflict_keep_best(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One item per conflict family and key, the strictest; items without a family pass."""
    sort = F.struct(strictness(F.col("name"), F.col("conflict")).alias("s"), (-F.col("priority")).alias("p"),
                    (-F.col("spec100")).alias("q"), (-F.length("name")).alias("l"), F.col("name").alias("n"), F.col("node_id").alias("i"))
    best = items.where("conflict <> ''").groupBy(*keys, "conflict").agg(F.min_by("node_id", sort).alias("_best"))
    out = items.join(best, [*keys, "conflict"], "left")
    return out.where((F.col("conflict") == "") | (F.col("node_id") == F.col("_best"))).select(*items.columns)


# -- pools ----------------------------------------------------------------------------------------------

def evidence_key(group: Column, name: Column, node_id: Column) -> Column:
    key = name_text(name)
    return F.when(key != "", F.concat_ws("::", group, key)).otherwise(F.coalesce(F.nullif(node_id, F.lit("")), group))


def unique_items(items: DataFrame) -> DataFrame:
    """First item per disease and evidence key in (priority, specificity, name) order."""
    keyed = items.withColumn("ekey", evidence_key(F.col("grp"), F.col("name"), F.col("node_id")))
    cols = [c for c in items.columns if c != "disease_id"]
    order = F.struct(-F.col("priority"), -F.col("spec100"), F.col("name"), F.col("node_id"))
    return keyed.groupBy("disease_id", "ekey").agg(F.min_by(F.struct(*cols), order).alias("_r")).select("disease_id", "ekey", "_r.*")


def cost_pool_flags() -> dict[str, Column]:
    """Low-cost, exam and opening predicates of an item."""
    low = F.col("grp").isin(*LOW_COST_GROUPS) & F.col("mode").isin(*LOW_COST_MODES) & (F.coalesce("cost", F.lit("")) != "high")
    return {
        "low_cost": low, "chief": low, "exam": F.col("grp").isin(*EXAM_GROUPS) | F.col("mode").isin(*EXAM_MODES),
        "opening_ok": opening_eligible(F.col("name"), F.col("grp"), F.col("label"), F.col("mode"))}


# --- fixed values: names and words a patient would not open with -------------------------------------
NOT_OPENING_NAMES = ("异常", "感染", "检查", "筛查", "诊断", "临床症状无改善")
NOT_OPENING_KEYS = ("年龄", "bmi", "身体质量指数", "kg/m²", "kg/m2", "测量部位", "持续时间")
BACKGROUND_RISK_TERMS = ("hiv", "aids", "艾滋", "抗逆转录病毒", "art", "免疫功能低下")
PLAIN_EXAM_NAMES = (*PLAIN_CD4, "hivrna", "hiv病毒载量检测", "cmvdna检测", "胸部ct", "血常规", "骨密度", "病毒载量", "脑脊液检查",
                    "血脂检测", "骨髓培养", "隐球菌抗原检测")
FORBIDDEN_TERMS = ("病死率", "疗效", "耐受性", "无改善", "体征无改善", "无症状", "呼吸频率", "收缩压", "舒张压", "胃镜", "肠镜",
                   "眼底", "筛查", "统计", "风险等级")


def concrete_result(name: Column) -> Column:
    """The name states a result, not just a test."""
    return contains_any(name, RESULT_MARKERS) | contains_any(name_text(name), RESULT_MARKERS)


def opening_eligible(name: Column, group: Column, label: Column, mode: Column) -> Column:
    """May a patient mention this item unasked?"""
    norm = name_text(name)
    barred = (
        label.isin("LabTest", "Pathogen", "PopulationGroup", "ClinicalAttribute") | group.isin("pathogen", "detail")
        | contains_any(norm, NOT_OPENING_KEYS) | norm.isin(*NOT_OPENING_NAMES)
        | ((group == "risk") & contains_any(norm, BACKGROUND_RISK_TERMS)) | norm.isin(*PLAIN_EXAM_NAMES)
        | contains_any(name, FORBIDDEN_TERMS) | (group.isin("lab", "imaging") & ~concrete_result(name)))
    fits = (group == "symptom") | ((group == "risk") & mode.isin(*LOW_COST_MODES)) | (
        group.isin("lab", "imaging") & concrete_result(name))
    return F.coalesce((F.length(norm) > 0) & ~barred & fits, F.lit(False))


def top_half_cutoff(items: DataFrame, keys: Sequence[str] = ("disease_id",), name: str = "cutoff") -> DataFrame:
    """Priority at rank ceil(n/2).  Items per disease are bounded, so the list is too."""
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list("priority"), asc=False).alias("_p")).select(
        *keys, F.element_at("_p", F.ceil(F.size("_p") / 2).cast("int")).alias(name))


def high_value(items: DataFrame) -> DataFrame:
    """Exam items at or above the cutoff, specific, or of a key relation."""
    exam = items.where(cost_pool_flags()["exam"])
    out = exam.join(top_half_cutoff(exam), "disease_id")
    keep = (F.col("priority") >= F.col("cutoff")) | (F.col("spec100") >= 85) | (
        F.col("grp").isin(*EXAM_GROUPS) & F.col("rel").isin(*HIGH_VALUE_RELATIONS))
    return out.where(keep).drop("cutoff")


def disease_profile(items: DataFrame) -> DataFrame:
    """Pool sizes and key sets per disease; sets are bounded by the item limit."""
    u = items.withColumns(cost_pool_flags())
    hv = high_value(items).groupBy("disease_id").agg(
        F.collect_set(name_key(F.col("name"))).alias("exam_names"), F.collect_set("grp").alias("exam_groups"),
        F.collect_set("rel").alias("exam_relations"), F.count(F.lit(1)).alias("n_high_value"))
    disc = items.join(top_half_cutoff(items), "disease_id").where((F.col("spec100") >= 85) | (F.col("priority") >= F.col("cutoff")))
    disc = disc.groupBy("disease_id").agg(F.collect_set("ekey").alias("disc_keys"))
    pick = lambda cond: F.collect_set(F.when(cond, F.col("ekey")))
    out = u.groupBy("disease_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(flag(F.col("chief"))).alias("n_chief"), F.sum(flag(F.col("low_cost"))).alias("n_low_cost"),
        F.sum(flag(F.col("exam"))).alias("n_exam"), F.collect_set("ekey").alias("all_keys"), pick(F.col("low_cost")).alias("low_keys"),
        pick(F.col("grp") == "symptom").alias("symptom_keys"), pick(F.col("grp").isin("risk", "detail")).alias("risk_keys"))
    empty = F.array().cast("array<string>")
    out = out.join(hv, "disease_id", "left").join(disc, "disease_id", "left")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("exam_names", "exam_groups", "exam_relations", "disc_keys")}
                           | {"n_high_value": F.coalesce("n_high_value", F.lit(0))})


# -- competitors ------------------------------------------------------------------------------------------

def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(both_empty)).otherwise(inter / F.greatest(union, F.lit(1)))


def set_similarity(pairs: DataFrame, sets: DataFrame, both_empty: float = 0.0) -> DataFrame:
    """Jaccard of the key sets of given pairs ``(a, b)``; ``sets``: distinct ``id, key``.

    Works on counts, so a set may be of any size.
    """
    n = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    inter = pairs.join(sets.toDF("a", "key"), "a").join(sets.toDF("b", "key"), ["b", "key"]).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("inter"))
    out = pairs.join(inter, ["a", "b"], "left").join(n.toDF("a", "na"), "a", "left").join(n.toDF("b", "nb"), "b", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    union = z("na") + z("nb") - z("inter")
    return out.select("a", "b", z("inter").alias("inter"), union.alias("union_size"),
                      F.when(union == 0, F.lit(both_empty)).otherwise(F.try_divide(z("inter"), union)).alias("similarity"))


def _rarity(sets: DataFrame) -> DataFrame:
    """``id, key, n, pos``: keys of every set from the rarest on; sets are bounded by the item limit."""
    freq = sets.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    arr = sets.join(freq, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("_k"))
    return arr.select("id", F.size("_k").alias("n"), F.posexplode("_k").alias("pos", "_x")).select("id", "n", "pos", "_x.key")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs ``a < b`` of sets with Jaccard of at least ``threshold``.

    Prefix filtering: with keys ordered from rare to common, two sets that similar share a
    key among their first ``n - ceil(t n) + 1``.  Common keys sit at the end and are not
    joined on.
    """
    rare = _rarity(sets)
    prefix = rare.where(F.col("pos") < F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    a = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "key")
    b = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "key")
    size_ok = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & size_ok).select("a", "b").distinct()
    return set_similarity(pairs, sets).where(F.col("similarity") >= threshold)


# --- fixed values: sets in a block, and the least number of blocks --------------------------------
TILE_SETS, TILE_BLOCKS = 8192, 6

# --- fixed values: weights of the competition score ------------------------------------------------
W_LOW, W_SYMPTOM, W_RISK, W_EXAM = 0.40, 0.25, 0.20, 0.15


def competition_score(t: str = "t", c: str = "c") -> dict[str, Column]:
    j = lambda name: jaccard(F.col(f"{t}.{name}"), F.col(f"{c}.{name}"))
    exam = j("exam_names") * 0.5 + j("exam_groups") * 0.25 + j("exam_relations") * 0.25
    score = j("low_keys") * W_LOW + j("symptom_keys") * W_SYMPTOM + j("risk_keys") * W_RISK + exam * W_EXAM
    return {
        "score": score,
        "n_shared": F.size(F.array_intersect(f"{t}.low_keys", f"{c}.low_keys")),
        "n_target_only": F.size(F.array_except(f"{t}.disc_keys", f"{c}.all_keys"))}


def nearest_in_tiles(rows: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``best`` of every pair of blocks of ``rows`` (distinct ``id``); a task holds two blocks, and no pair of rows leaves it unless chosen.

    Every set meets every other: the work grows with the square of their number, the data moved with the number of
    sets times that of blocks.
    """
    blocks = max(TILE_BLOCKS, -(-rows.count() // TILE_SETS))
    own, each = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.withColumn("a", own).withColumn("b", each).repartition(blocks * blocks, "a", "b")
    right = rows.withColumn("b", own).withColumn("a", each).repartition(blocks * blocks, "a", "b")
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, schema)


def nearest_sets(sets: DataFrame, k: int) -> DataFrame:
    """``a, b, inter, similarity, rank``: the ``k`` most similar other sets of each (Jaccard above 0); ``sets``: distinct ``id, key``.

    Of equal similarity the larger overlap comes first, then the smaller id.
    """
    rows = sets.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("key").alias("keys"))
    rows = written(rows, "sets")
    kind = rows.schema["id"].dataType.simpleString()

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        keys, out = Overlap(left["keys"], right["keys"]), []
        ids, others = (x["id"].to_pandas().to_numpy() for x in (left, right))
        n, m = left["n"].to_numpy(), right["n"].to_numpy()
        for lo in range(0, left.num_rows, STRIP):
            hi = min(lo + STRIP, left.num_rows)
            inter = keys.rows(lo, hi)
            similar = inter_over_union(inter, n[lo:hi], m)
            r, c = first_columns([similar, inter], (inter > 0) & (ids[lo:hi, None] != others[None, :]), k)
            out.append(pa.table([left["id"].take(r + lo), right["id"].take(c), inter[r, c].astype(np.int64), similar[r, c]], ["a", "b", "inter", "similarity"]))
        return pa.concat_tables(out) if out else pa.table([left["id"], left["id"], left["n"], left["n"].cast("double")], ["a", "b", "inter", "similarity"])

    found = nearest_in_tiles(rows, best, f"a {kind}, b {kind}, inter bigint, similarity double")
    return top_k(found, ["a"], [F.desc("similarity"), F.desc("inter"), F.col("b")], k)


def rank_competitors(profiles: DataFrame, names: DataFrame, k: int = 1) -> DataFrame:
    """Best ``k`` competitors of each disease among all others that score above 0.

    All pairs are scored (:func:`competition_score` states the score of one), block by block (:func:`nearest_in_tiles`).
    """
    name = names.groupBy("disease_id").agg(F.min("disease_name").alias("name"), F.lit(True).alias("named"))
    cols = [c for c in profiles.columns if c.endswith(("keys", "names", "groups", "relations"))]
    rows = profiles.where("disease_id IS NOT NULL").join(name, "disease_id", "left").select(F.col("disease_id").alias("id"), "name", "named", *cols)
    rows = written(rows, "profiles")
    shared = ("low_keys", "symptom_keys", "risk_keys", "exam_names", "exam_groups", "exam_relations")
    out_names = ["target_id", "competitor_id", "competitor_name", "score", "n_shared", "n_target_only"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.filter(pc.equal(right["named"], True))
        right = right.take(pc.sort_indices(right.select(["name", "id"]), [("name", "ascending"), ("id", "ascending")], null_placement="at_start"))
        sets = {x: Overlap(left[x], right[x]) for x in shared}
        only, out = Overlap(left["disc_keys"], right["all_keys"]), []
        ids, others = (x["id"].to_pandas().to_numpy() for x in (left, right))
        for lo in range(0, left.num_rows, STRIP):
            hi = min(lo + STRIP, left.num_rows)
            inter = {x: o.rows(lo, hi) for x, o in sets.items()}
            j = {x: inter_over_union(inter[x], o.left_size[lo:hi], o.right_size) for x, o in sets.items()}
            exam = j["exam_names"] * 0.5 + j["exam_groups"] * 0.25 + j["exam_relations"] * 0.25
            score = j["low_keys"] * W_LOW + j["symptom_keys"] * W_SYMPTOM + j["risk_keys"] * W_RISK + exam * W_EXAM
            rest = only.left_size[lo:hi, None] - only.rows(lo, hi)
            r, c = first_columns([score, inter["low_keys"], rest], (score > 0) & (ids[lo:hi, None] != others[None, :]), k)
            out.append(pa.table([left["id"].take(r + lo), right["id"].take(c), right["name"].take(c), score[r, c],
                                 inter["low_keys"][r, c].astype(np.int32), rest[r, c].astype(np.int32)], out_names))
        none = pa.array([], "int32")
        return pa.concat_tables(out) if out else pa.table([left["id"], left["id"], left["name"], none.cast("double"), none, none], out_names)

    kind = rows.schema["id"].dataType.simpleString()
    found = nearest_in_tiles(rows, best, f"target_id {kind}, competitor_id {kind}, competitor_name string, score double, n_shared int, n_target_only int")
    return top_k(found, ["target_id"], [F.desc("score"), F.desc("n_shared"), F.desc("n_target_only"), F.col("competitor_name"), F.col("competitor_id")], k)


def competitive_negatives(pairs: DataFrame, items: DataFrame, positives: DataFrame, names: DataFrame) -> DataFrame:
    """Competitor-only items that do not contradict the target.

    ``pairs``: ``target_id, competitor_id``; ``positives``: ``target_id, ekey, conflict`` of
    the chosen positive items.
    """
    low = items.withColumns(cost_pool_flags()).where("low_cost").withColumn("src", F.lit(0))
    hv = high_value(items).withColumns(cost_pool_flags()).withColumn("src", F.lit(1))
    pool = low.unionByName(hv)
    order = F.struct("src", -F.col("priority"), -F.col("spec100"), F.col("name"), F.col("node_id"))
    pool = pool.groupBy("disease_id", "ekey").agg(F.min(order).alias("_o"), F.min_by(F.struct("node_id", "name", "grp", "conflict"), order).alias("_r"))
    pool = top_k(pool, ["disease_id"], [F.col("_o")], POSITIVE_LIMIT + NEGATIVE_LIMIT).select(
        F.col("disease_id").alias("competitor_id"), "ekey", "_r.*", F.col("rank").alias("pool_rank"))
    out = pairs.join(pool, "competitor_id")
    own = items.select(F.col("disease_id").alias("target_id"), "ekey").distinct()
    out = out.join(own, ["target_id", "ekey"], "left_anti")
    out = out.join(positives.select("target_id", "ekey").distinct(), ["target_id", "ekey"], "left_anti")
    clash = positives.where("conflict <> ''").select("target_id", "conflict").distinct()
    out = out.join(clash, ["target_id", "conflict"], "left_anti")
    out = out.join(names.select(F.col("disease_id").alias("target_id"), F.col("disease_name").alias("target_name")), "target_id")
    a, b = name_text(F.col("target_name")), name_text(F.col("name"))
    conflict = (F.length(a) >= 2) & (F.length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))
    return out.where(~conflict).drop("target_name")


# -- selection ---------------------------------------------------------------------------------------------

def required_groups(names: DataFrame, catalog: DataFrame, available: DataFrame, builtin=BUILTIN_REQUIREMENTS) -> DataFrame:
    """Required family groups per disease: catalog groups the pool can cover, else built-in ones by name.

    ``catalog``: ``disease_id, group_no, family``; ``available``: distinct ``disease_id, family``.
    Returns ``disease_id, group_no, families, source``.
    """
    cat = catalog.groupBy("disease_id", "group_no").agg(F.sort_array(F.collect_set("family")).alias("families"))
    can = catalog.join(available, ["disease_id", "family"], "left_semi").select("disease_id", "group_no").distinct()
    from_catalog = cat.join(can, ["disease_id", "group_no"], "left_semi").withColumn("source", F.lit("catalog"))
    norm = name_text(F.col("disease_name"))
    rule = F.lit(None).cast("array<array<string>>")
    for words, groups in reversed(list(builtin)):
        value = F.array(*[F.array(*[F.lit(f) for f in g]) for g in groups])
        rule = F.when(contains_any(norm, words), value).otherwise(rule)
    rest = names.join(from_catalog.select("disease_id").distinct(), "disease_id", "left_anti")
    built = rest.select("disease_id", F.posexplode(rule).alias("group_no", "families")).withColumn("source", F.lit("builtin"))
    return from_catalog.unionByName(built)


def select_cover_items(pools: DataFrame, required: DataFrame, limit: int = POSITIVE_LIMIT) -> DataFrame:
    """Choose up to ``limit`` items per key: one per required group first, then by preference.

    ``pools``: ``disease_id, ekey, pref, cover_rank, families, conflict, strict`` with
    ``pref`` the preferred position, ``cover_rank`` the order in which an item may serve a
    requirement and ``strict`` its rank within its conflict family.  Pools are bounded
    (at most the audit limit per disease), so the choice runs over one short array.
    """
    item = F.struct("cover_rank", "pref", "ekey", "families", "conflict", "strict")
    arr = pools.groupBy("disease_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    req = required.groupBy("disease_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "families"))),
                                                         lambda x: x["families"]).alias("req"))
    df = arr.join(req, "disease_id", "left").withColumn("req", F.coalesce("req", F.array().cast("array<array<string>>")))

    def cover(state: Column, group: Column, pool: Column) -> Column:
        """Add the best pool item for ``group`` unless the state covers it already."""
        taken = F.transform(state, lambda s: s["ekey"])
        fit = F.filter(pool, lambda p: F.arrays_overlap(p["families"], group) & ~F.array_contains(taken, p["ekey"]))
        done = F.exists(state, lambda s: F.arrays_overlap(s["families"], group)) | (F.size(fit) == 0) | (F.size(state) >= limit)
        return F.when(done, state).otherwise(F.concat(state, F.slice(fit, 1, 1)))

    def strictest(state: Column) -> Column:
        """Within a conflict family only the strictest item stays."""
        return F.filter(state, lambda s: (s["conflict"] == "") | ~F.exists(
            state, lambda o: (o["conflict"] == s["conflict"]) & (
                F.struct(o["strict"].alias("a"), o["ekey"].alias("b")) < F.struct(s["strict"].alias("a"), s["ekey"].alias("b")))))

    df = df.withColumn("none", F.slice("pool", 1, 0))
    df = df.withColumn("picked", F.aggregate("req", F.col("none"), lambda acc, g: cover(acc, g, F.col("pool"))))
    by_pref = F.array_sort(F.transform("pool", lambda p: F.struct(p["pref"].alias("o"), p.alias("p"))))
    rest = F.filter(F.transform(by_pref, lambda x: x["p"]),
                    lambda p: ~F.array_contains(F.transform("picked", lambda s: s["ekey"]), p["ekey"]))
    df = df.withColumn("filled", F.concat("picked", F.slice(rest, 1, F.greatest(F.lit(limit) - F.size("picked"), F.lit(0)))))
    df = df.withColumn("kept", strictest(F.col("filled")))
    df = df.withColumn("kept", F.aggregate("req", F.col("kept"), lambda acc, g: strictest(cover(acc, g, F.col("pool")))))
    return df.select("disease_id", F.posexplode(F.slice("kept", 1, limit)).alias("pos", "x")).select(
        "disease_id", (F.col("pos") + 1).alias("pick"), "x.ekey", "x.families", "x.conflict")


def opening_items(positives: DataFrame, preferred: Column) -> DataFrame:
    """Up to three opening items per case: preferred ones, else symptoms, else askable risks, else stated results.

    ``positives``: ``case_id, ekey, pick, name, grp, label, mode``.
    """
    ok = opening_eligible(F.col("name"), F.col("grp"), F.col("label"), F.col("mode"))
    e = positives.where(ok).withColumn("tier", F.when(preferred, 0).when(F.col("grp") == "symptom", 1).when(F.col("grp") == "risk", 2).otherwise(3))
    has = e.groupBy("case_id").agg((F.min("tier") == 0).alias("_has"))
    e = e.join(has, "case_id").where(~F.col("_has") | (F.col("tier") == 0)).drop("_has")
    return top_k(e, ["case_id"], [F.col("tier"), F.col("pick")], OPENING_LIMIT, "opening_rank")


def case_skips(profiles: DataFrame, competitors: DataFrame, minimum: Mapping[str, int] = POOL_MINIMUM) -> DataFrame:
    """Per disease and case type: reason and sizes when a pool is too small, else 'generated'.

    ``competitors``: best competitor per disease with ``n_shared, n_target_only, n_negative``.
    """
    m = minimum
    p = profiles.join(competitors, profiles["disease_id"] == competitors["target_id"], "left")

    def row(case_type: str, *checks: tuple[str, Column, int]) -> Column:
        reason, have, need = F.lit("generated"), F.lit(0).cast("bigint"), F.lit(0)
        for name, size, least in reversed(checks):
            short = F.coalesce(size, F.lit(0)) < least
            reason = F.when(short, name).otherwise(reason)
            have = F.when(short, F.coalesce(size, F.lit(0)).cast("bigint")).otherwise(have)
            need = F.when(short, least).otherwise(need)
        return F.struct(F.lit(case_type).alias("case_type"), reason.alias("reason"), have.alias("available"), need.alias("required"))

    c = F.col
    rows = F.array(
        row("ordinary", ("insufficient_total_pool", c("n_all"), m["ordinary_total"]),
            ("insufficient_chief_complaint_friendly_pool", c("n_chief"), m["ordinary_chief"])),
        row("low_cost", ("insufficient_low_cost_pool", c("n_low_cost"), m["low_cost"])),
        row("exam_driven", ("insufficient_exam_pool", c("n_exam"), m["exam"]),
            ("insufficient_high_value_exam_pool", c("n_high_value"), m["exam_high_value"])),
        row("competitive", ("competitor_not_found", F.when(c("competitor_id").isNotNull(), 1), 1),
            ("insufficient_shared_pool", c("n_shared"), m["shared"]), ("insufficient_target_only_pool", c("n_target_only"), m["target_only"]),
            ("insufficient_competitor_negative_pool", c("n_negative"), m["competitor_negative"])))
    return p.select("disease_id", "competitor_id", F.explode(rows).alias("x")).select("disease_id", "competitor_id", "x.*")


def case_id(case_type: Column, disease_id: Column, competitor_id: Column, index: int = 1, keep: int | None = None) -> Column:
    """Id of a case from the whole disease ids; ``keep`` cuts them to so many characters, which may collide."""
    bare = lambda c: F.replace(c, F.lit("merged_node_"), F.lit(""))
    token = lambda c: F.coalesce(F.nullif(F.substring(bare(c), 1, keep) if keep else bare(c), F.lit("")), F.lit("unknown"))
    tail = f"{index:03d}"
    return F.when(case_type == "competitive", F.concat_ws("_", F.lit("kg_competitive"), token(disease_id), F.lit("vs"), token(competitor_id), F.lit(tail))).otherwise(
        F.concat_ws("_", F.lit("kg"), case_type, token(disease_id), F.lit(tail)))


# -- QC ---------------------------------------------------------------------------------------------------------

def evidence_role(group: Column, rel: Column, families: Column, background: Column, marker: Column) -> Column:
    """QC role of one item."""
    any_of = lambda names: F.arrays_overlap(families, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(background | ((F.size(families) > 0) & (F.size(F.array_except(families, F.array(*[F.lit(n) for n in BACKGROUND_FAMILIES]))) == 0)), "background_context")
        .when(any_of(DEFINITION_FAMILIES) | marker, "definition_anchor")
        .when((group == "pathogen") | (rel == "HAS_PATHOGEN") | any_of(PATHOGEN_FAMILIES), "disease_specific_anchor")
        .when(any_of(SPECIFIC_FAMILIES) & group.isin(*EXAM_GROUPS), "disease_specific_anchor")
        .when((group == "symptom") | any_of(PHENOTYPE_FAMILIES), "phenotype_support")
        .when(group.isin("risk", "detail"), "risk_or_context")
        .otherwise("supporting_context"))


def case_qc(cases: DataFrame, positives: DataFrame, opening: DataFrame, coverage: DataFrame) -> DataFrame:
    """Penalties, reasons, score and status per case.

    ``positives``: ``case_id, role, high_connectivity, core_infection, core_metabolic,
    core_tumor, core_neuro``; ``opening``: ``case_id, role``; ``coverage``: ``case_id,
    missing_groups, generic_only`` plus the four category flags ``is_infection ...``.
    """
    p = positives.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_pos"),
        F.max(F.col("role").isin("disease_specific_anchor", "definition_anchor")).alias("has_anchor"),
        F.min(F.col("high_connectivity")).alias("all_connected"),
        *[F.max(f"core_{c}").alias(f"core_{c}") for c in ("infection", "metabolic", "tumor", "neuro")])
    o = opening.groupBy("case_id").agg((F.min(F.col("role") == "background_context")).alias("opening_background"))
    j = cases.select("case_id").join(p, "case_id", "left").join(o, "case_id", "left").join(coverage, "case_id", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    general = ~(f("is_infection") | f("is_metabolic") | f("is_tumor") | f("is_neuro"))
    no_core = ((f("is_infection") & ~f("core_infection")) | (f("is_metabolic") & ~f("core_metabolic"))
               | (f("is_tumor") & ~f("core_tumor")) | (f("is_neuro") & ~f("core_neuro")) | (general & ~f("has_anchor")))
    hit = {
        "no_positive_slots": F.coalesce("n_pos", F.lit(0)) == 0,
        "missing_disease_specific_or_definition_anchor": ~f("has_anchor"),
        "missing_primary_diagnostic_path_core_evidence": no_core,
        "missing_required_family_coverage": F.coalesce("missing_groups", F.lit(0)) > 0,
        "required_family_covered_by_generic_or_background_only": f("generic_only"),
        "opening_background_only": f("opening_background"),
        "all_positive_slots_high_connectivity_or_background": f("all_connected")}
    penalty = sum((F.when(hit[name], points).otherwise(0) for name, points in QC_PENALTY), F.lit(0))
    reasons = F.concat_ws(",", *[F.when(hit[name], F.lit(name)) for name, _ in QC_PENALTY])
    hard = F.lit(False)
    for name in QC_HARD:
        hard = hard | hit[name]
    return j.select(
        "case_id", F.greatest(F.lit(100) - penalty, F.lit(0)).alias("case_qc_score"), reasons.alias("case_qc_reasons"),
        F.when(hard, "not_benchmark_eligible").when(reasons != "", "weak_anchor").otherwise("eligible").alias("case_qc_status"))


def generation_manifest(cases: DataFrame, skips: DataFrame) -> DataFrame:
    """Counts by type, QC status, reason and skip reason as ``(metric, key, value)`` rows."""
    by = lambda df, metric, key: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(metric).alias("metric"), "key", "value")
    reasons = cases.select(F.explode(F.filter(F.split("case_qc_reasons", ","), lambda x: x != "")).alias("r"))
    return (by(cases, "generated_case_count_by_type", F.col("case_type"))
            .unionByName(by(cases, "case_qc_count_by_status", F.col("case_qc_status")))
            .unionByName(by(reasons, "case_qc_reason_counts", F.col("r")))
            .unionByName(by(cases.where("case_qc_status = 'eligible'"), "benchmark_eligible_count_by_type", F.col("case_type")))
            .unionByName(by(skips, "skipped_case_count_by_reason", F.col("reason"))))


# -- sampling and outputs -------------------------------------------------------------------------------------------

def stratified_sample(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 42, total: int | None = None) -> DataFrame:
    """``n`` rows per stratum in hash order; with ``total``, leftover places are filled from the rest.

    The same seed always picks the same rows, whatever the partitioning.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    picked = top_k(rows.withColumn("_h", order), [stratum], [F.col("_h"), F.col(key)], n, "_r")
    picked = picked.withColumn("fill", F.lit(False))
    if total is None:
        return picked.drop("_h", "_r")
    rest = rows.withColumn("_h", order).join(picked.select(key), key, "left_anti")
    counted = picked.agg(F.count(F.lit(1)).alias("_n"))
    extra = rest.orderBy("_h", key).limit(total).crossJoin(F.broadcast(counted))  # one row
    w = Window.orderBy("_h", key)  # at most ``total`` rows are left here
    extra = extra.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= total - F.col("_n"))
    return picked.drop("_h", "_r").unionByName(extra.drop("_h", "_r", "_n").withColumn("fill", F.lit(True)))


def slot_rows(items: DataFrame, positive: bool) -> DataFrame:
    """Case slots from chosen items."""
    return items.select("case_id", F.col("node_id").alias("slot_id"), F.lit(str(positive).lower()).alias("value"), "grp", "label",
                        F.col("name").alias("alias"))
