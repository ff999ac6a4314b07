"""Row rules of the extraction contract as table jobs: validation, repair, direction checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, contains_any, map_value, strip, vocabulary_key
from ..functions.vocab import (
    CLINICIAN_MARKERS, COST_SPELLINGS, COSTS, DETAIL_LEVELS, GENERIC_IMAGING_NAMES, LAB_TEST_PATTERNS, LABELS,
    MODE_COST, MODE_SPELLINGS, PATHOGEN_MARKERS, RELATION_TYPES,
)

# --- fixed values: which labels a relation may join -------------------------------------------
EVIDENCE_LABELS = tuple(x for x in LABELS if x != "Disease")
DIRECTION_RULES = {
    "MANIFESTS_AS": (("Disease",), ("ClinicalFinding",)),
    "HAS_LAB_FINDING": (("Disease",), ("LabFinding",)),
    "HAS_IMAGING_FINDING": (("Disease",), ("ImagingFinding",)),
    "HAS_PATHOGEN": (("Disease",), ("Pathogen",)),
    "DIAGNOSED_BY": (("Disease",), ("LabTest", "LabFinding", "ImagingFinding")),
    "REQUIRES_DETAIL": (("Disease", "ClinicalFinding", "LabTest"), ("ClinicalAttribute",)),
    "RISK_FACTOR_FOR": (("RiskFactor", "PopulationGroup"), ("Disease",)),
    "COMPLICATED_BY": (("Disease",), ("Disease",)),
    "APPLIES_TO": (("Disease", *EVIDENCE_LABELS), ("PopulationGroup",)),
}


def direction_allowed(etype: Column, src_label: Column, dst_label: Column, rules=DIRECTION_RULES) -> Column:
    """True when the rule table allows the relation between the two labels."""
    ok = F.lit(False)
    for name, (sources, targets) in rules.items():
        ok = ok | ((etype == name) & src_label.isin(*sources) & dst_label.isin(*targets))
    return F.coalesce(ok, F.lit(False))


def direction_violations(edges: DataFrame, rules=DIRECTION_RULES) -> DataFrame:
    return edges.where(~direction_allowed(F.col("type"), F.col("src_label"), F.col("dst_label"), rules))


def safe_name(col: Column) -> Column:
    """Identifier check of labels and relation types."""
    return F.coalesce(col.rlike("^[A-Za-z][A-Za-z0-9_]*\\z"), F.lit(False))


def normalize_mode(col: Column) -> Column:
    """Canonical acquisition mode of a free spelling, NULL when unknown."""
    raw = strip(col)
    return F.when(raw.isin(*MODE_COST), raw).otherwise(map_value(vocabulary_key(raw), MODE_SPELLINGS))


def normalize_cost(col: Column) -> Column:
    raw = strip(col)
    return F.when(raw.isin(*COSTS), raw).otherwise(map_value(vocabulary_key(raw), COST_SPELLINGS))


def infer_mode(label: Column, text: Column, pathogen_markers: Sequence[str] = PATHOGEN_MARKERS,
               clinician_markers: Sequence[str] = CLINICIAN_MARKERS) -> Column:
    """Acquisition mode from the label, and for lab items and attributes from their text."""
    key = vocabulary_key(text)
    return (
        F.when(label.isin("ClinicalFinding", "RiskFactor"), "direct_ask")
        .when(label == "PopulationGroup", "history_known")
        .when(label == "ImagingFinding", "needs_imaging")
        .when(label == "Pathogen", "needs_pathogen_test")
        .when(label.isin("LabFinding", "LabTest"),
              F.when(contains_any(key, pathogen_markers), "needs_pathogen_test").otherwise("needs_lab_test"))
        .when(label == "ClinicalAttribute",
              F.when(contains_any(key, clinician_markers), "needs_clinician_assessment").otherwise("direct_ask")))


def repair_acquisition(nodes: DataFrame, **markers) -> DataFrame:
    """Fill ``mode`` and ``cost`` of nodes.

    Input columns ``label, text, mode, cost, attr_mode, attr_cost``.  Adds the final
    ``new_mode, new_cost`` and one flag per kind of repair.
    """
    from_attr_mode = F.col("mode").isNull() & normalize_mode(F.col("attr_mode")).isNotNull()
    from_attr_cost = F.col("cost").isNull() & normalize_cost(F.col("attr_cost")).isNotNull()
    out = nodes.withColumns({
        "_m": F.when(from_attr_mode, normalize_mode(F.col("attr_mode"))).otherwise(F.col("mode")),
        "_c": F.when(from_attr_cost, normalize_cost(F.col("attr_cost"))).otherwise(F.col("cost")),
        "promoted": from_attr_mode.cast("int") + from_attr_cost.cast("int")})
    out = out.withColumns({"_nm": normalize_mode(F.col("_m")), "_nc": normalize_cost(F.col("_c"))})
    removed = ((F.col("_m").isNotNull() & F.col("_nm").isNull()).cast("int")
               + (F.col("_c").isNotNull() & F.col("_nc").isNull()).cast("int"))
    guess = infer_mode(F.col("label"), F.col("text"), **markers)
    out = out.withColumns({
        "removed": removed,
        "inferred_mode": (F.col("_nm").isNull() & guess.isNotNull()).cast("int"),
        "new_mode": F.coalesce("_nm", guess)})
    implied = map_value(F.col("new_mode"), MODE_COST)
    out = out.withColumns({
        "inferred_cost": (F.col("_nc").isNull() & implied.isNotNull()).cast("int"),
        "new_cost": F.coalesce("_nc", implied)})
    return out.drop("_m", "_c", "_nm", "_nc")


# --- fixed values: wording that implies a lab operator, in the order it is tried ------------------
OPERATOR_WORDS = (
    ("above_detection_limit", ("高于检测下限", "高于检测值下限")),
    ("below_detection_limit", ("低于检测下限", "低于检测值下限")),
    ("positive", ("阳性",)),
    ("negative", ("阴性",)),
    ("becomes_negative", ("转阴",)),
    ("becomes_positive", ("转阳",)),
    ("above_normal_range", ("升高", "增高", "高于正常值")),
    ("below_normal_range", ("降低", "低于正常值")),
)
DETECTION_LIMIT_TEXT = "检测下限"


def infer_lab_operator(text: Column, has_low: Column, has_high: Column, words=OPERATOR_WORDS) -> Column:
    """Operator of a lab finding: both bounds, then comparison signs, then wording, then a range."""
    out = F.when(has_low & has_high, "between")
    for sign in (">=", "<=", ">", "<", "="):
        out = out.when(F.contains(text, F.lit(sign)), sign)
    for name, keys in words:
        out = out.when(contains_any(text, keys), name)
    return out.when(text.rlike(r"\d+\s*[~～-]\s*\d+"), "between")


def infer_lab_test(text: Column, known: Column, patterns=LAB_TEST_PATTERNS) -> Column:
    """Test id named in ``text``: the longest key of ``known`` (array of struct key, test_id), else a pattern."""
    norm = vocabulary_key(text)
    hits = F.filter(F.coalesce(known, F.array().cast("array<struct<key:string,test_id:string>>")),
                    lambda k: (F.length(k["key"]) > 0) & F.contains(norm, k["key"]))
    ranked = F.transform(hits, lambda k: F.struct((-F.length(k["key"])).alias("l"), k["key"].alias("k"), k["test_id"].alias("t")))
    best = F.try_element_at(F.array_sort(ranked), F.lit(1))["t"]
    guess = F.lit(None).cast("string")
    for pattern, test in reversed(list(patterns)):
        guess = F.when(norm.rlike(pattern), test).otherwise(guess)
    return F.coalesce(best, guess)


def repair_lab_nodes(nodes: DataFrame, known: DataFrame, words=OPERATOR_WORDS, patterns=LAB_TEST_PATTERNS) -> DataFrame:
    """Fill operator, test id and value text of lab findings and flag the ones that stay incomplete.

    ``nodes``: ``chunk_id, node_id, label, name, definition, value, value_low, value_high,
    value_text, reference_text, operator, test_id, unit``.  ``known``: ``chunk_id, tests``
    with ``tests`` an array of struct(key, test_id), the lab tests of that chunk.
    """
    parts = [F.nullif(strip(F.col(c)), F.lit("")) for c in ("name", "definition", "value_text", "reference_text")]
    lab = F.col("label") == "LabFinding"
    out = nodes.join(known, "chunk_id", "left").withColumn("_text", F.concat_ws("；", *parts))
    guess_op = infer_lab_operator(F.col("_text"), F.col("value_low").isNotNull(), F.col("value_high").isNotNull(), words)
    guess_test = infer_lab_test(F.col("_text"), F.col("tests"), patterns)
    need_value = F.col("value").isNull() & F.col("value_text").isNull() & F.col("reference_text").isNull()
    fallback = F.coalesce(F.nullif(strip(F.col("definition")), F.lit("")), F.nullif(strip(F.col("name")), F.lit("")))
    limit = guess_op.isin("above_detection_limit", "below_detection_limit")
    out = out.withColumns({
        "new_operator": F.when(lab, F.coalesce("operator", guess_op)).otherwise(F.col("operator")),
        "new_test_id": F.when(lab, F.coalesce("test_id", guess_test)).otherwise(F.col("test_id")),
        "new_value_text": F.when(lab & need_value, fallback).otherwise(F.col("value_text")),
        "new_reference_text": F.when(lab & F.col("operator").isNull() & limit & F.col("reference_text").isNull(),
                                     F.lit(DETECTION_LIMIT_TEXT)).otherwise(F.col("reference_text"))})
    repaired = lambda new, old: (lab & F.col(old).isNull() & F.col(new).isNotNull()).cast("int")
    incomplete = (F.col("new_test_id").isNull() | F.col("new_operator").isNull()
                  | (F.col("value").isNull() & F.col("new_value_text").isNull() & F.col("new_reference_text").isNull()))
    return out.withColumns({
        "fixed_operator": repaired("new_operator", "operator"),
        "fixed_test_id": repaired("new_test_id", "test_id"),
        "fixed_value": (lab & need_value & F.col("new_value_text").isNotNull()).cast("int"),
        "dropped": lab & incomplete}).drop("_text", "tests")


def drop_edges_of(edges: DataFrame, dropped: DataFrame, scope: str = "chunk_id") -> DataFrame:
    """Edges that touch a dropped node of the same chunk are removed."""
    ids = dropped.select(scope, F.col("node_id")).distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "source_id"), [scope, "source_id"], "left_anti")
    return e.join(ids.withColumnRenamed("node_id", "target_id"), [scope, "target_id"], "left_anti")


def node_error(prefix: str = "") -> Column:
    """First failing check of a node row, NULL when it is valid.

    Reads ``node_id, label, name, weight, detail, mode, cost, has_attributes, test_id,
    operator, value, value_text, reference_text, unit, definition``.
    """
    c = lambda n: F.col(prefix + n)
    lab = c("label") == "LabFinding"
    image = c("label") == "ImagingFinding"
    has_value = c("value").isNotNull()
    return (
        F.when(blank(c("node_id")), "NODE_INVALID_ID")
        .when(c("label").isNull() | ~c("label").isin(*LABELS), "NODE_UNSUPPORTED_LABEL")
        .when(blank(c("name")), "NODE_INVALID_NAME")
        .when(c("weight").isNull() | (c("weight") < 0) | (c("weight") > 1), "NODE_INVALID_WEIGHT")
        .when(c("detail").isNull() | ~c("detail").isin(*DETAIL_LEVELS), "NODE_INVALID_DETAIL_REQUIRED")
        .when(c("mode").isNotNull() & ~c("mode").isin(*MODE_COST), "NODE_INVALID_ACQUISITION_MODE")
        .when(c("cost").isNotNull() & ~c("cost").isin(*COSTS), "NODE_INVALID_EVIDENCE_COST")
        .when(lab & ~c("has_attributes"), "LAB_FINDING_MISSING_ATTRIBUTES")
        .when(lab & c("test_id").isNull(), "LAB_FINDING_MISSING_TEST_ID")
        .when(lab & c("operator").isNull(), "LAB_FINDING_MISSING_OPERATOR")
        .when(lab & ~has_value & c("value_text").isNull() & c("reference_text").isNull(), "LAB_FINDING_MISSING_VALUE_FIELDS")
        .when(lab & has_value & c("unit").isNull(), "LAB_FINDING_MISSING_UNIT")
        .when(image & vocabulary_key(c("name")).isin(*GENERIC_IMAGING_NAMES) & blank(c("definition")),
              "IMAGING_FINDING_GENERIC_NAME"))


def edge_error(edges: DataFrame, nodes: DataFrame, types: Sequence[str] = RELATION_TYPES) -> DataFrame:
    """Adds ``error_code`` to edges: id, type, endpoints known in the same chunk, weight, detail."""
    ids = nodes.select("chunk_id", "local_id").distinct()
    e = edges.join(ids.select("chunk_id", F.col("local_id").alias("source_id"), F.lit(True).alias("_s")),
                   ["chunk_id", "source_id"], "left")
    e = e.join(ids.select("chunk_id", F.col("local_id").alias("target_id"), F.lit(True).alias("_t")),
               ["chunk_id", "target_id"], "left")
    code = (
        F.when(blank(F.col("edge_id")), "EDGE_INVALID_ID")
        .when(F.col("type").isNull() | ~F.col("type").isin(*types), "EDGE_UNSUPPORTED_TYPE")
        .when(F.col("_s").isNull(), "EDGE_UNKNOWN_SOURCE_ID")
        .when(F.col("_t").isNull(), "EDGE_UNKNOWN_TARGET_ID")
        .when(F.col("weight").isNull() | (F.col("weight") < 0) | (F.col("weight") > 1), "EDGE_INVALID_WEIGHT")
        .when(F.col("detail").isNull() | ~F.col("detail").isin(*DETAIL_LEVELS), "EDGE_INVALID_DETAIL_REQUIRED"))
    return e.withColumn("error_code", code).drop("_s", "_t")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that the same chunk does not declare, with which side is missing."""
    ids = nodes.select("chunk_id", "local_id").distinct()
    e = edges.join(ids.select("chunk_id", F.col("local_id").alias("source_id"), F.lit(True).alias("_s")),
                   ["chunk_id", "source_id"], "left")
    e = e.join(ids.select("chunk_id", F.col("local_id").alias("target_id"), F.lit(True).alias("_t")),
               ["chunk_id", "target_id"], "left")
    return e.withColumns({"missing_source": F.col("_s").isNull(), "missing_target": F.col("_t").isNull()}).drop(
        "_s", "_t").where("missing_source OR missing_target")


def flatten_attributes(nodes: DataFrame, attributes: str, taken: Sequence[str]) -> DataFrame:
    """``extras``: nested attributes whose name is not already a top-level column."""
    keep = F.map_filter(F.col(attributes), lambda k, v: ~k.isin(*taken)) if taken else F.col(attributes)
    return nodes.withColumn("extras", keep)


def sanitize_list(col: Column) -> Column:
    """A homogeneous list without its nulls."""
    return F.filter(col, lambda x: x.isNotNull())


def sanitize_context(col: Column) -> dict[str, Column]:
    """A sample-context struct as five flat properties."""
    return {
        "sample_context_relative_path": col["relative_path"],
        "sample_context_heading_path": sanitize_list(col["heading_path"]),
        "sample_context_line_start": col["line_start"],
        "sample_context_line_end": col["line_end"],
        "sample_context_json": F.to_json(col),
    }
