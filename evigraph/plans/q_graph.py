"""Queries over extraction records and the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, lookup_key, match_text, vocabulary_key
from ..operators import checks, graph
from .registry import query

ORD = ["chunk_id", "pos", "pk", "sk", "local_id"]

# SQL pieces shared by several checks
SQL_KEY = "regexp_replace(lower(trim({c})), '\\s+', '', 'g')"
SQL_ALIAS = f"""alias AS (
  SELECT label, akey, arg_min(canonical, (file, canonical)) AS canonical FROM (
    SELECT file, label, canonical, {SQL_KEY.format(c='alias')} AS akey FROM alias_file
    UNION ALL SELECT file, label, canonical, {SQL_KEY.format(c='canonical')} FROM alias_file)
  GROUP BY label, akey)"""
SQL_RESOLVED = f"""{SQL_ALIAS},
resolved AS (
  SELECT n.*, coalesce(a.canonical, b.canonical, n.name) AS canonical,
         CASE WHEN a.canonical IS NOT NULL OR b.canonical IS NOT NULL THEN 'alias' ELSE 'self' END AS method
  FROM chunk_node n LEFT JOIN alias a ON a.label = n.label AND a.akey = {SQL_KEY.format(c='n.name')}
  LEFT JOIN alias b ON b.label = n.label AND b.akey = {SQL_KEY.format(c='n.alt_name')})"""
SQL_NID = "'merged_node_' || substr(sha1(label || '::' || canonical), 1, 12)"
SQL_DRANK = "CASE detail WHEN 'minimal' THEN 0 WHEN 'full' THEN 2 ELSE 1 END"
SQL_DMAX = f"CASE max({SQL_DRANK}) WHEN 0 THEN 'minimal' WHEN 2 THEN 'full' ELSE 'standard' END"
SQL_MAP = f"""{SQL_RESOLVED},
lmap AS (SELECT chunk_id, local_id, arg_max({SQL_NID}, (chunk_id, pos, pk, sk, local_id)) AS node_id
         FROM resolved GROUP BY 1, 2),
remap AS (SELECT e.*, s.node_id AS ns, t.node_id AS nt,
          CASE WHEN s.node_id IS NULL OR t.node_id IS NULL THEN 'unmapped' WHEN s.node_id = t.node_id THEN 'self_loop'
               ELSE 'remapped' END AS disposition
          FROM chunk_edge e LEFT JOIN lmap s ON s.chunk_id = e.chunk_id AND s.local_id = e.source_id
          LEFT JOIN lmap t ON t.chunk_id = e.chunk_id AND t.local_id = e.target_id)"""


def resolved(t):
    return graph.alias_resolve(t.chunk_node, graph.alias_index(t.alias_file), ["name", "alt_name"], "local_id")


def typed_edges(t):
    return t.chunk_edge.withColumnRenamed("rel", "type")


def remapped(t):
    return graph.edge_remap(typed_edges(t), graph.local_map(resolved(t), ORD), ["chunk_id"])


# -- row rules -----------------------------------------------------------------------------

@query("clean_text_col", r"""
SELECT nullif(regexp_replace(trim(replace(replace(text, '.', '  '), chr(10), ' ')), '[ \t]{2,}', ' ', 'g'), '') AS cleaned,
       count(*) AS n FROM conversations GROUP BY 1""")
def clean_text_col(t):
    padded = F.replace(F.replace("text", F.lit("."), F.lit("  ")), F.lit("\n"), F.lit(" "))
    return t.raw("conversations").groupBy(clean_text(padded).alias("cleaned")).agg(F.count(F.lit(1)).alias("n"))


@query("lookup_key_col", r"""
SELECT akey, count(*) AS n_rows, count(DISTINCT p_name || p_brand) AS n_surface FROM (
  SELECT *, regexp_replace(translate(lower(trim(p_name || '（' || p_brand || '）：')), '（），：', '(),:'), '\s+', '', 'g') AS akey
  FROM part) GROUP BY akey""")
def lookup_key_col(t):
    text = F.concat("p_name", F.lit("（"), "p_brand", F.lit("）："))
    p = t.raw("part").groupBy(lookup_key(text).alias("akey"), F.concat("p_name", "p_brand").alias("s")).agg(
        F.count(F.lit(1)).alias("n"))
    return p.groupBy("akey").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_surface"))


@query("match_text_col", r"""
SELECT lower(replace(replace(s_name, '#', ''), ' ', '')) AS short_key,
       lower(regexp_replace(s_name, '[ #0]', '', 'g')) AS tight_key, count(*) AS n FROM supplier GROUP BY 1, 2""")
def match_text_col(t):
    s = t.raw("supplier")
    return s.groupBy(match_text(F.col("s_name"), drop=" #").alias("short_key"),
                     match_text(F.col("s_name"), drop=" #0").alias("tight_key")).agg(F.count(F.lit(1)).alias("n"))


@query("flatten_attributes", """
SELECT 'P' || p_partkey AS node_id, x.k AS key, x.v AS value FROM part,
  unnest([{'k': 'brand', 'v': p_brand}, {'k': 'size', 'v': CAST(p_size AS VARCHAR)}]) AS u(x)""")
def flatten_attributes(t):
    p = t.raw("part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_name").alias("name"),
        F.create_map(F.lit("name"), F.lit("shadowed"), F.lit("brand"), F.col("p_brand"),
                     F.lit("size"), F.col("p_size").cast("string")).alias("attributes"))
    flat = checks.flatten_attributes(p, "attributes", ["node_id", "name"])
    return flat.select("node_id", F.explode("extras"))


@query("sanitize_props", """
SELECT chunk_id, pos, pk, sk, path AS sample_context_relative_path, label || '|' || p_brand AS heading,
       pos AS sample_context_line_start,
       '{"relative_path":"' || path || '","heading_path":["' || label || '",null,"' || p_brand || '"],"line_start":' || pos
       || ',"line_end":' || (pos + 1) || '}' AS sample_context_json
FROM chunk_line""")
def sanitize_props(t):
    ctx = F.struct(
        F.col("path").alias("relative_path"), F.array("label", F.lit(None).cast("string"), "p_brand").alias("heading_path"),
        F.col("pos").alias("line_start"), (F.col("pos") + 1).alias("line_end"))
    p = checks.sanitize_context(ctx)
    return t.chunk_line.select(
        "chunk_id", "pos", "pk", "sk", p["sample_context_relative_path"].alias("sample_context_relative_path"),
        F.concat_ws("|", p["sample_context_heading_path"]).alias("heading"),
        p["sample_context_line_start"].alias("sample_context_line_start"),
        F.to_json(ctx, {"ignoreNullFields": "false"}).alias("sample_context_json"))


@query("safe_name_filter", """
SELECT p_brand AS name, count(*) AS n, regexp_full_match(p_brand, '[A-Za-z][A-Za-z0-9_]*') AS safe FROM part GROUP BY 1
UNION ALL SELECT p_type, count(*), regexp_full_match(p_type, '[A-Za-z][A-Za-z0-9_]*') FROM part GROUP BY 1""")
def safe_name_filter(t):
    p = t.raw("part").select(F.explode(F.array("p_brand", "p_type")).alias("name"))
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("safe", checks.safe_name(F.col("name")))


def contract_nodes(t):
    """Node rows with the faults the contract must find, all derived from the line's own values."""
    s = lambda v: F.lit(v).cast("string")
    q = F.col("quantity")
    lab = F.col("label") == "LabFinding"
    return t.chunk_line.select(
        "chunk_id", "pos", "pk", "sk",
        F.when(q == 1, F.lit(" ")).otherwise(F.concat(F.lit("P"), F.col("pk").cast("string"))).alias("node_id"),
        F.when(q == 2, F.lit("Gadget")).otherwise(F.col("label")).alias("label"),
        F.when(q == 3, F.lit("")).when((F.col("label") == "ImagingFinding") & (q == 4), F.lit("影像 检查")).otherwise(F.col("p_name")).alias("name"),
        F.when(q == 5, F.lit(1.5)).otherwise(F.col("node_w100") / 100.0).alias("weight"),
        F.when(q == 6, F.lit("some")).otherwise(F.col("detail")).alias("detail"),
        F.when(q == 7, F.lit("guess")).alias("mode"),
        F.when(q == 8, F.lit("free")).alias("cost"),
        (q != 9).alias("has_attributes"),
        F.when(lab & (q != 10), F.lit("T1")).alias("test_id"),
        F.when(lab & (q != 11), F.lit(">")).alias("operator"),
        F.when(lab & (q > 13), q).alias("value"),
        F.when(lab & (q == 13), F.col("p_name")).alias("value_text"),
        s(None).alias("reference_text"),
        F.when(q != 14, F.lit("mg")).alias("unit"),
        s(None).alias("definition"))


@query("validate_nodes", """
SELECT label, CASE WHEN quantity = 1 THEN 'NODE_INVALID_ID' WHEN quantity = 2 THEN 'NODE_UNSUPPORTED_LABEL'
  WHEN quantity = 3 THEN 'NODE_INVALID_NAME' WHEN quantity = 5 THEN 'NODE_INVALID_WEIGHT'
  WHEN quantity = 6 THEN 'NODE_INVALID_DETAIL_REQUIRED' WHEN quantity = 7 THEN 'NODE_INVALID_ACQUISITION_MODE'
  WHEN quantity = 8 THEN 'NODE_INVALID_EVIDENCE_COST'
  WHEN label = 'LabFinding' AND quantity = 9 THEN 'LAB_FINDING_MISSING_ATTRIBUTES'
  WHEN label = 'LabFinding' AND quantity = 10 THEN 'LAB_FINDING_MISSING_TEST_ID'
  WHEN label = 'LabFinding' AND quantity = 11 THEN 'LAB_FINDING_MISSING_OPERATOR'
  WHEN label = 'LabFinding' AND quantity < 13 THEN 'LAB_FINDING_MISSING_VALUE_FIELDS'
  WHEN label = 'LabFinding' AND quantity = 14 THEN 'LAB_FINDING_MISSING_UNIT'
  WHEN label = 'ImagingFinding' AND quantity = 4 THEN 'IMAGING_FINDING_GENERIC_NAME' ELSE 'ok' END AS error_code,
  count(*) AS n FROM (SELECT CASE WHEN quantity = 2 THEN 'Gadget' ELSE label END AS label, quantity FROM chunk_line) GROUP BY 1, 2""")
def validate_nodes(t):
    return contract_nodes(t).withColumn("error_code", F.coalesce(checks.node_error(), F.lit("ok"))).groupBy(
        "label", "error_code").agg(F.count(F.lit(1)).alias("n"))


@query("validate_edges", """
SELECT rel AS type, error_code, count(*) AS n FROM (
  SELECT e.*, CASE WHEN s.local_id IS NULL THEN 'EDGE_UNKNOWN_SOURCE_ID' WHEN t.local_id IS NULL THEN 'EDGE_UNKNOWN_TARGET_ID'
    WHEN e.w100 > 95 THEN 'EDGE_INVALID_WEIGHT' ELSE 'ok' END AS error_code
  FROM chunk_edge e LEFT JOIN (SELECT DISTINCT chunk_id, local_id FROM chunk_node) s ON s.chunk_id = e.chunk_id AND s.local_id = e.source_id
  LEFT JOIN (SELECT DISTINCT chunk_id, local_id FROM chunk_node) t ON t.chunk_id = e.chunk_id AND t.local_id = e.target_id)
GROUP BY 1, 2""")
def validate_edges(t):
    e = typed_edges(t).withColumn("weight", F.when(F.col("w100") > 95, F.lit(2.0)).otherwise(F.col("w100") / 100.0))
    out = checks.edge_error(e, t.chunk_node)
    return out.groupBy("type", F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(
        F.count(F.lit(1)).alias("n"))


@query("edge_direction_check", """
SELECT rel AS type, src_label, dst_label, count(*) AS n FROM (
  SELECT rel, CASE WHEN n_occ > 1 THEN dst_label ELSE src_label END AS src_label,
         CASE WHEN n_occ > 1 THEN src_label ELSE dst_label END AS dst_label FROM kg_edge)
WHERE NOT ((rel = 'MANIFESTS_AS' AND src_label = 'Disease' AND dst_label = 'ClinicalFinding')
  OR (rel = 'HAS_LAB_FINDING' AND src_label = 'Disease' AND dst_label = 'LabFinding')
  OR (rel = 'HAS_IMAGING_FINDING' AND src_label = 'Disease' AND dst_label = 'ImagingFinding')
  OR (rel = 'HAS_PATHOGEN' AND src_label = 'Disease' AND dst_label = 'Pathogen')
  OR (rel = 'REQUIRES_DETAIL' AND src_label IN ('Disease','ClinicalFinding','LabTest') AND dst_label = 'ClinicalAttribute')
  OR (rel = 'RISK_FACTOR_FOR' AND src_label IN ('RiskFactor','PopulationGroup') AND dst_label = 'Disease'))
GROUP BY 1, 2, 3""")
def edge_direction_check(t):
    flip = F.col("n_occ") > 1
    e = t.kg_edge.select(
        F.col("rel").alias("type"), F.when(flip, F.col("dst_label")).otherwise(F.col("src_label")).alias("src_label"),
        F.when(flip, F.col("src_label")).otherwise(F.col("dst_label")).alias("dst_label"))
    return checks.direction_violations(e).groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_mode_cost", """
SELECT raw_mode, CASE raw_mode WHEN 'Direct-Ask' THEN 'direct_ask' WHEN ' PCR ' THEN 'needs_pathogen_test'
  WHEN 'ct' THEN 'needs_imaging' WHEN 'needs_lab_test' THEN 'needs_lab_test' END AS mode,
  raw_cost, CASE raw_cost WHEN '高 成本' THEN 'high' WHEN 'LOW-COST' THEN 'low' WHEN 'medium' THEN 'medium' END AS cost, count(*) AS n
FROM (SELECT CASE p_type WHEN 'ECONOMY' THEN 'Direct-Ask' WHEN 'SMALL' THEN ' PCR ' WHEN 'MEDIUM' THEN 'ct'
   WHEN 'LARGE' THEN 'needs_lab_test' ELSE p_brand END AS raw_mode,
   CASE WHEN p_size > 40 THEN '高 成本' WHEN p_size > 30 THEN 'LOW-COST' WHEN p_size > 20 THEN 'medium' ELSE p_name END AS raw_cost
 FROM part) GROUP BY 1, 2, 3, 4""")
def normalize_mode_cost(t):
    mode = (F.when(F.col("p_type") == "ECONOMY", "Direct-Ask").when(F.col("p_type") == "SMALL", " PCR ")
            .when(F.col("p_type") == "MEDIUM", "ct").when(F.col("p_type") == "LARGE", "needs_lab_test").otherwise(F.col("p_brand")))
    cost = (F.when(F.col("p_size") > 40, "高 成本").when(F.col("p_size") > 30, "LOW-COST").when(F.col("p_size") > 20, "medium")
            .otherwise(F.col("p_name")))
    raw = t.raw("part").groupBy(mode.alias("raw_mode"), cost.alias("raw_cost")).agg(F.count(F.lit(1)).alias("n"))
    return raw.select("raw_mode", checks.normalize_mode(F.col("raw_mode")).alias("mode"), "raw_cost",
                      checks.normalize_cost(F.col("raw_cost")).alias("cost"), "n")


@query("infer_acquisition", """
WITH s AS (SELECT chunk_id, label, p_name, CASE WHEN quantity < 5 THEN 'ct' WHEN quantity < 9 THEN 'nonsense' END AS mode,
    CASE WHEN quantity >= 46 THEN 'medium' END AS cost, CASE WHEN quantity BETWEEN 20 AND 29 THEN 'history' END AS attr_mode,
    CASE WHEN quantity BETWEEN 25 AND 34 THEN 'odd' WHEN quantity = 35 THEN '低' END AS attr_cost, quantity FROM chunk_line),
a AS (SELECT *, (mode IS NULL AND attr_mode IS NOT NULL)::INT + (cost IS NULL AND coalesce(attr_cost, '') = '低')::INT AS promoted,
    (mode = 'nonsense')::INT AS rm,
    CASE WHEN mode = 'ct' THEN 'needs_imaging' WHEN mode IS NULL AND attr_mode = 'history' THEN 'history_known' END AS nm,
    CASE WHEN cost = 'medium' THEN 'medium' WHEN cost IS NULL AND attr_cost = '低' THEN 'low' END AS nc,
    CASE WHEN label IN ('ClinicalFinding','RiskFactor') THEN 'direct_ask' WHEN label = 'ImagingFinding' THEN 'needs_imaging'
      WHEN label = 'Pathogen' THEN 'needs_pathogen_test'
      WHEN label = 'LabFinding' THEN CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'rod') THEN 'needs_pathogen_test' ELSE 'needs_lab_test' END
      WHEN label = 'ClinicalAttribute' THEN CASE WHEN contains(p_name, 'gear') THEN 'needs_clinician_assessment' ELSE 'direct_ask' END END AS guess
  FROM s),
b AS (SELECT *, coalesce(nm, guess) AS new_mode FROM a)
SELECT chunk_id, label, new_mode, coalesce(nc, CASE new_mode WHEN 'direct_ask' THEN 'low' WHEN 'history_known' THEN 'low'
   WHEN 'needs_clinician_assessment' THEN 'medium' ELSE 'high' END) AS new_cost, count(*) AS n,
   CAST(sum(promoted) AS BIGINT) AS promoted, CAST(sum((nm IS NULL AND guess IS NOT NULL)::INT) AS BIGINT) AS inferred_mode,
   CAST(sum((nc IS NULL)::INT) AS BIGINT) AS inferred_cost, CAST(sum(coalesce(rm, 0)) AS BIGINT) AS removed FROM b GROUP BY 1, 2, 3, 4""")
def infer_acquisition(t):
    q = F.col("quantity")
    n = t.chunk_line.select(
        "chunk_id", "label", F.col("p_name").alias("text"),
        F.when(q < 5, "ct").when(q < 9, "nonsense").alias("mode"), F.when(q >= 46, "medium").alias("cost"),
        F.when(q.between(20, 29), "history").alias("attr_mode"),
        F.when(q.between(25, 34), "odd").when(q == 35, "低").alias("attr_cost"))
    out = checks.repair_acquisition(n, pathogen_markers=("ring", "rod"), clinician_markers=("gear",))
    return out.groupBy("chunk_id", "label", "new_mode", "new_cost").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("promoted", "inferred_mode", "inferred_cost", "removed")])


SQL_OP = """CASE WHEN contains(x, '>=') THEN '>=' WHEN contains(x, '<=') THEN '<=' WHEN contains(x, '>') THEN '>'
  WHEN contains(x, '<') THEN '<' WHEN contains(x, '=') THEN '=' WHEN contains(x, 'hot') THEN 'positive'
  WHEN contains(x, 'cold') THEN 'negative' WHEN contains(x, 'large') OR contains(x, 'new') THEN 'above_normal_range'
  WHEN contains(x, 'small') THEN 'below_normal_range' WHEN regexp_matches(x, '\\d+\\s*[~～-]\\s*\\d+') THEN 'between' END"""
OP_WORDS = (("positive", ("hot",)), ("negative", ("cold",)), ("above_normal_range", ("large", "new")),
            ("below_normal_range", ("small",)))


def lab_text():
    q, size = F.col("quantity").cast("int").cast("string"), F.col("node_w100").cast("string")
    return F.when(F.col("quantity") > 45, F.concat("p_name", F.lit(" >= "), q)).when(
        F.col("quantity") > 40, F.concat("p_name", F.lit(" < "), q)).when(
        F.col("quantity") > 35, F.concat("p_name", F.lit(" "), q, F.lit(" ~ "), size)).otherwise(F.col("p_name"))


SQL_LABTEXT = """CASE WHEN quantity > 45 THEN p_name || ' >= ' || CAST(quantity AS INT) WHEN quantity > 40 THEN p_name || ' < ' || CAST(quantity AS INT)
  WHEN quantity > 35 THEN p_name || ' ' || CAST(quantity AS INT) || ' ~ ' || node_w100 ELSE p_name END"""


@query("infer_lab_operator", f"""
SELECT x AS text, {SQL_OP} AS operator, count(*) AS n FROM (SELECT {SQL_LABTEXT} AS x FROM chunk_line WHERE label = 'LabFinding')
GROUP BY 1, 2""")
def infer_lab_operator(t):
    texts = t.chunk_line.where(F.col("label") == "LabFinding").groupBy(lab_text().alias("text")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(False)
    return texts.withColumn("operator", checks.infer_lab_operator(F.col("text"), none, none, OP_WORDS))


LAB_PATTERNS = (("widget|gizmo", "LabTest_W"), ("^hot", "LabTest_H"))


def chunk_tests(t):
    """Tests a chunk names: the nouns of its symptom parts, plus the full name."""
    line = t.chunk_line.where(F.col("label") == "ClinicalFinding")
    keys = F.array(vocabulary_key(F.col("p_name")), vocabulary_key(F.substring_index("p_name", " ", -1)))
    named = line.select("chunk_id", F.explode(keys).alias("key"), F.concat(F.lit("T"), F.col("pk").cast("string")).alias("test_id"))
    return named.groupBy("chunk_id", "key").agg(F.min("test_id").alias("test_id"))


SQL_TESTS = """tests AS (
  SELECT chunk_id, key, min(test_id) AS test_id FROM (
    SELECT chunk_id, replace(p_name, ' ', '') AS key, 'T' || pk AS test_id FROM chunk_line WHERE label = 'ClinicalFinding'
    UNION ALL SELECT chunk_id, split_part(p_name, ' ', 2), 'T' || pk FROM chunk_line WHERE label = 'ClinicalFinding')
  GROUP BY 1, 2)"""


def lab_rows(t):
    """Lab findings of every chunk with the tests of the chunk that their text names."""
    line = t.chunk_line.where(F.col("label") == "LabFinding").select("chunk_id", "pos", "pk", "sk", "linestatus", "quantity", lab_text().alias("text"))
    hit = line.join(chunk_tests(t), "chunk_id", "left").where(
        F.col("key").isNull() | F.contains(vocabulary_key(F.col("text")), F.col("key")))
    # the longest key that the text holds, one row per finding
    best = hit.where("key IS NOT NULL").groupBy("chunk_id", "pos", "pk", "sk").agg(
        F.min_by("test_id", F.struct(-F.length("key"), F.col("key"))).alias("known_test"))
    return line.join(best, ["chunk_id", "pos", "pk", "sk"], "left")


SQL_LABROWS = f"""{SQL_TESTS},
lab AS (SELECT chunk_id, pos, pk, sk, linestatus, quantity, {SQL_LABTEXT} AS x FROM chunk_line WHERE label = 'LabFinding'),
labt AS (SELECT l.*, (SELECT arg_min(test_id, (-length(key), key)) FROM tests s WHERE s.chunk_id = l.chunk_id
          AND contains(replace(replace(replace(lower(l.x), ' ', ''), '-', ''), '_', ''), s.key)) AS known FROM lab l)"""


@query("infer_lab_test_id", f"""
WITH {SQL_LABROWS}
SELECT chunk_id, pos, pk, sk, coalesce(known, CASE WHEN contains(x, 'widget') OR contains(x, 'gizmo') THEN 'LabTest_W'
  WHEN starts_with(x, 'hot') THEN 'LabTest_H' END) AS test_id FROM labt""")
def infer_lab_test_id(t):
    guess = checks.infer_lab_test(F.col("text"), F.lit(None).cast("array<struct<key:string,test_id:string>>"), LAB_PATTERNS)
    return lab_rows(t).select("chunk_id", "pos", "pk", "sk", F.coalesce("known_test", guess).alias("test_id"))


def repaired_labs(t):
    s = lambda: F.lit(None).cast("string")
    n = lab_rows(t).select(
        "chunk_id", "pos", "pk", "sk", F.concat_ws("_", F.lit("L"), "pos", "pk", "sk").alias("node_id"),
        F.lit("LabFinding").alias("label"), F.col("text").alias("name"), s().alias("definition"),
        F.when(F.col("linestatus") == "F", F.col("quantity")).alias("value"), s().alias("value_low"), s().alias("value_high"),
        s().alias("value_text"), s().alias("reference_text"), s().alias("operator"), F.col("known_test").alias("test_id"), s().alias("unit"))
    none = n.select("chunk_id").distinct().withColumn("tests", F.lit(None).cast("array<struct<key:string,test_id:string>>"))
    return checks.repair_lab_nodes(n, none, OP_WORDS, LAB_PATTERNS)


@query("repair_lab_nodes", f"""
WITH {SQL_LABROWS},
r AS (SELECT chunk_id, {SQL_OP} AS op, known, coalesce(known, CASE WHEN contains(x, 'widget') OR contains(x, 'gizmo') THEN 'LabTest_W'
  WHEN starts_with(x, 'hot') THEN 'LabTest_H' END) AS test_id, linestatus FROM labt)
SELECT chunk_id, count(*) AS n, CAST(sum((op IS NOT NULL)::INT) AS BIGINT) AS fixed_operator,
  CAST(sum((known IS NULL AND test_id IS NOT NULL)::INT) AS BIGINT) AS fixed_test_id,
  CAST(sum((linestatus <> 'F')::INT) AS BIGINT) AS fixed_value,
  CAST(sum((op IS NULL OR test_id IS NULL)::INT) AS BIGINT) AS dropped FROM r GROUP BY 1""")
def repair_lab_nodes(t):
    return repaired_labs(t).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("fixed_operator", "fixed_test_id", "fixed_value")],
        F.sum(F.col("dropped").cast("int")).alias("dropped"))


# -- joins over extraction records ------------------------------------------------------------

@query("dangling_edges", """
SELECT e.chunk_id, count(*) AS n, min(edge_id) AS first_edge_id, CAST(sum((s.local_id IS NULL)::INT) AS BIGINT) AS missing_sources,
  CAST(sum((t.local_id IS NULL)::INT) AS BIGINT) AS missing_targets
FROM chunk_edge e LEFT JOIN (SELECT DISTINCT chunk_id, local_id FROM chunk_node) s ON s.chunk_id = e.chunk_id AND s.local_id = e.source_id
LEFT JOIN (SELECT DISTINCT chunk_id, local_id FROM chunk_node) t ON t.chunk_id = e.chunk_id AND t.local_id = e.target_id
WHERE s.local_id IS NULL OR t.local_id IS NULL GROUP BY 1""")
def dangling_edges(t):
    d = checks.dangling_edges(t.chunk_edge, t.chunk_node)
    return d.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("first_edge_id"),
        F.sum(F.col("missing_source").cast("int")).alias("missing_sources"),
        F.sum(F.col("missing_target").cast("int")).alias("missing_targets"))


@query("alias_resolve", f"WITH {SQL_RESOLVED} SELECT chunk_id, pos, pk, sk, local_id, label, canonical, method FROM resolved")
def alias_resolve(t):
    return resolved(t).select("chunk_id", "pos", "pk", "sk", "local_id", "label", "canonical", "method")


def strict_mentions(t):
    """Names as mentions whose second name may lead elsewhere in the dictionary."""
    return t.chunk_line.select(
        "chunk_id", "pos", "pk", "sk", "label", F.col("p_name").alias("name"),
        F.when(F.col("quantity") < 3, F.concat(F.lit("large "), F.substring_index("p_name", " ", -1))).alias("alt_name"),
        F.concat(F.lit("P"), F.col("pk").cast("string")).alias("local_id"))


@query("alias_resolve_strict", f"""
WITH {SQL_ALIAS},
m AS (SELECT chunk_id, pos, pk, sk, label, p_name AS name, CASE WHEN quantity < 3 THEN 'large ' || split_part(p_name, ' ', 2) END AS alt FROM chunk_line),
j AS (SELECT m.*, a.canonical AS c1, b.canonical AS c2 FROM m LEFT JOIN alias a ON a.label = m.label AND a.akey = {SQL_KEY.format(c='m.name')}
  LEFT JOIN alias b ON b.label = m.label AND b.akey = {SQL_KEY.format(c='m.alt')})
SELECT chunk_id, pos, pk, sk, CASE WHEN c1 <> c2 THEN 'reject' WHEN c1 IS NULL AND c2 IS NULL THEN 'self' ELSE 'alias' END AS outcome,
  CASE WHEN c1 <> c2 THEN least(c1, c2) ELSE coalesce(c1, c2, name) END AS canonical FROM j""")
def alias_resolve_strict(t):
    ok, bad = graph.alias_resolve_strict(strict_mentions(t), graph.alias_index(t.alias_file), ["name", "alt_name"], "local_id")
    cols = ["chunk_id", "pos", "pk", "sk"]
    return ok.select(*cols, F.col("method").alias("outcome"), "canonical").unionByName(
        bad.select(*cols, F.lit("reject").alias("outcome"), F.col("first_canonical").alias("canonical")))


@query("edge_remap", f"""
WITH {SQL_MAP}
SELECT chunk_id, edge_id, ns AS new_source, nt AS new_target, disposition FROM remap""")
def edge_remap(t):
    return remapped(t).select("chunk_id", "edge_id", "new_source", "new_target", "disposition")


# -- merging -------------------------------------------------------------------------------------

@query("merge_nodes", f"""
WITH {SQL_RESOLVED},
m AS (SELECT label, canonical, count(*) AS occurrence_count, max(w100) AS w100, {SQL_DMAX} AS detail,
  arg_min(name, (chunk_id, pos, pk, sk, local_id)) AS name, arg_min(path, (chunk_id, pos, pk, sk, local_id)) AS sample_path
  FROM resolved GROUP BY 1, 2)
SELECT {SQL_NID} AS node_id, label, canonical AS canonical_name, name, occurrence_count, w100, detail, sample_path FROM m""")
def merge_nodes(t):
    return graph.merge_nodes(resolved(t), ORD)


@query("merge_node_lists", f"""
WITH {SQL_RESOLVED},
v AS (SELECT {SQL_NID} AS id, chunk_id, pos, x.k AS kind, x.v AS value FROM resolved,
  unnest([{{'k': 'alias', 'v': canonical}}, {{'k': 'alias', 'v': name}}, {{'k': 'alias', 'v': alt_name}},
          {{'k': 'source_file', 'v': path}}, {{'k': 'source_node', 'v': local_id}}, {{'k': 'method', 'v': method}}]) AS u(x)
  WHERE x.v IS NOT NULL)
SELECT id, kind, value, min(chunk_id) AS first_chunk FROM v GROUP BY 1, 2, 3""")
def merge_node_lists(t):
    kinds = {"alias": ["canonical", "name", "alt_name"], "source_file": ["path"], "source_node": ["local_id"], "method": ["method"]}
    rows = graph.merge_lists(resolved(t), ORD, kinds, graph.node_hash(F.col("label"), F.col("canonical")))
    return rows.select("id", "kind", "value", F.col("first")["chunk_id"].alias("first_chunk"))


@query("merge_edges", f"""
WITH {SQL_MAP}
SELECT 'merged_edge_' || substr(sha1(rel || '|' || ns || '|' || nt || '|' || cond), 1, 12) AS edge_id, rel AS type, ns AS source_id,
  nt AS target_id, cond AS condition, count(*) AS occurrence_count, max(w100) AS w100, {SQL_DMAX} AS detail
FROM (SELECT *, CASE WHEN w100 > 50 THEN 'late stage' ELSE '' END AS cond FROM remap WHERE disposition IN ('kept','remapped'))
GROUP BY rel, ns, nt, cond""")
def merge_edges(t):
    ok = remapped(t).where(F.col("disposition").isin("kept", "remapped")).select(
        "type", F.col("new_source").alias("source_id"), F.col("new_target").alias("target_id"), "w100", "detail")
    return graph.merge_edges(ok, F.when(F.col("w100") > 50, " late  stage ")).select(
        "edge_id", "type", "source_id", "target_id", "condition", "occurrence_count", "w100", "detail")


SQL_CANON = """CASE WHEN split_part(name, ' ', 1) IN ('red','blue') AND label <> 'Disease' THEN 'blue ' || split_part(name, ' ', 2)
   WHEN split_part(name, ' ', 1) IN ('large','small') AND label <> 'Disease' THEN 'large ' || split_part(name, ' ', 2) ELSE name END"""


@query("remerge_graph", f"""
SELECT {SQL_NID} AS node_id, label, canonical AS canonical_name, arg_min(name, node_id) AS name,
  CAST(sum(occurrence_count) AS BIGINT) AS occurrence_count, max(w100) AS w100, {SQL_DMAX} AS detail, count(*) AS merged_from
FROM (SELECT *, {SQL_CANON} AS canonical FROM g_node) GROUP BY label, canonical""")
def remerge_graph(t):
    alias = graph.alias_index(t.alias_file.where("file = 1"))
    r = graph.alias_resolve(t.g_node, alias, ["canonical_name", "name"], "node_id")
    return graph.remerge_nodes(r.withColumn("new_id", graph.node_hash(F.col("label"), F.col("canonical"))))


# -- connectivity and rewrites ---------------------------------------------------------------------

SQL_PRUNE = """targets AS (SELECT n.node_id FROM g_node n JOIN (SELECT id, count(*) AS c FROM (SELECT source_id AS id FROM g_edge
     UNION ALL SELECT target_id FROM g_edge) GROUP BY 1) d ON d.id = n.node_id WHERE n.label = 'Disease' AND d.c <= {limit}),
kept_e AS (SELECT * FROM g_edge WHERE source_id NOT IN (SELECT node_id FROM targets) AND target_id NOT IN (SELECT node_id FROM targets)),
kept_n AS (SELECT * FROM g_node n WHERE node_id NOT IN (SELECT node_id FROM targets) AND (label = 'Disease'
   OR EXISTS (SELECT 1 FROM kept_e e WHERE e.source_id = n.node_id) OR EXISTS (SELECT 1 FROM kept_e e WHERE e.target_id = n.node_id)))"""


def low_targets(t, limit):
    deg = graph.incident_degree(t.g_edge).where(F.col("degree") <= limit)
    return t.g_node.where(F.col("label") == "Disease").join(deg, "node_id").select("node_id")


PRUNE_LIMIT = 290


def nodes_and_customers(t):
    """All nodes of the merged graph, and the customers, whom no edge names."""
    c = t.raw("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("PopulationGroup").alias("label"), F.col("c_name").alias("name"))
    return t.g_node.select("node_id", "label", "name").unionByName(c)


@query("semi_connected", """
WITH n AS (SELECT node_id, label FROM g_node UNION ALL SELECT 'C' || c_custkey, 'PopulationGroup' FROM customer),
ends AS (SELECT source_id AS id FROM g_edge UNION SELECT target_id FROM g_edge)
SELECT label, count(*) AS n FROM n WHERE node_id IN (SELECT id FROM ends) GROUP BY 1""")
def semi_connected(t):
    return graph.connected_nodes(nodes_and_customers(t), t.g_edge).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("isolated_nodes", """
WITH n AS (SELECT node_id, label, name FROM g_node UNION ALL SELECT 'C' || c_custkey, 'PopulationGroup', c_name FROM customer)
SELECT node_id, label, name, label = 'Disease' AS kept FROM n WHERE node_id NOT IN (SELECT source_id FROM g_edge UNION SELECT target_id FROM g_edge)""")
def isolated_nodes(t):
    alone = graph.isolated_nodes(nodes_and_customers(t), t.g_edge)
    return alone.select("node_id", "label", "name", (F.col("label") == "Disease").alias("kept"))


@query("incident_degree", """
SELECT id AS node_id, count(*) AS degree FROM (SELECT source_id AS id FROM g_edge UNION ALL SELECT target_id FROM g_edge) GROUP BY 1""")
def incident_degree(t):
    return graph.incident_degree(t.g_edge)


@query("prune_graph", f"""
WITH {SQL_PRUNE.format(limit=PRUNE_LIMIT)}
SELECT 'node' AS kind, node_id AS id FROM kept_n UNION ALL SELECT 'edge', edge_id FROM kept_e""")
def prune_graph(t):
    n, e = graph.prune_graph(t.g_node, t.g_edge, low_targets(t, PRUNE_LIMIT))
    return n.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


@query("prune_report", f"""
WITH {SQL_PRUNE.format(limit=PRUNE_LIMIT)}
SELECT 'before_nodes' AS metric, count(*) AS value FROM g_node
UNION ALL SELECT 'before_diseases', count(*) FROM g_node WHERE label = 'Disease'
UNION ALL SELECT 'before_edges', count(*) FROM g_edge
UNION ALL SELECT 'after_nodes', count(*) FROM kept_n UNION ALL SELECT 'after_diseases', count(*) FROM kept_n WHERE label = 'Disease'
UNION ALL SELECT 'after_edges', count(*) FROM kept_e
UNION ALL SELECT 'matched_targets', count(*) FROM targets
UNION ALL SELECT 'missing_targets', count(DISTINCT s_nationkey) FROM supplier""")
def prune_report(t):
    targets = low_targets(t, PRUNE_LIMIT)
    n, e = graph.prune_graph(t.g_node, t.g_edge, targets)
    unknown = t.raw("supplier").select(F.concat(F.lit("gone_"), F.col("s_nationkey").cast("string")).alias("node_id")).distinct()
    wanted = targets.unionByName(unknown)
    matched = wanted.join(t.g_node.select("node_id"), "node_id", "left_semi")
    missing = wanted.join(t.g_node.select("node_id"), "node_id", "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    return (graph.graph_counts(t.g_node, t.g_edge, "before").unionByName(graph.graph_counts(n, e, "after"))
            .unionByName(count(matched, "matched_targets")).unionByName(count(missing, "missing_targets")))


@query("prune_delete", """
WITH gone AS (SELECT node_id FROM g_node WHERE label = 'Disease' AND w100 < 10)
SELECT 'dry_run_nodes' AS metric, '' AS id, count(*) AS value FROM gone
UNION ALL SELECT 'dry_run_edges', '', count(*) FROM g_edge WHERE source_id IN (SELECT node_id FROM gone) OR target_id IN (SELECT node_id FROM gone)
UNION ALL SELECT 'node', node_id, 1 FROM g_node WHERE node_id NOT IN (SELECT node_id FROM gone)
UNION ALL SELECT 'edge', edge_id, 1 FROM g_edge WHERE source_id NOT IN (SELECT node_id FROM gone) AND target_id NOT IN (SELECT node_id FROM gone)""")
def prune_delete(t):
    gone = t.g_node.where((F.col("label") == "Disease") & (F.col("w100") < 10))
    n, e = graph.remove_nodes(t.g_node, t.g_edge, gone)
    hit = t.g_edge.join(e.select("edge_id"), "edge_id", "left_anti")
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("id"), "value")
    one = F.lit(1).cast("bigint").alias("value")
    return (row(gone, "dry_run_nodes").unionByName(row(hit, "dry_run_edges"))
            .unionByName(n.select(F.lit("node").alias("metric"), F.col("node_id").alias("id"), one))
            .unionByName(e.select(F.lit("edge").alias("metric"), F.col("edge_id").alias("id"), one)))


SQL_REWRITE = """
m AS (SELECT {nid} AS new_id, nlabel, canonical, name, node_id, occurrence_count, w100, detail FROM moved),
re AS (SELECT e.type, s.new_id AS ns, t.new_id AS nt, e.w100, e.occurrence_count,
   CASE WHEN e.source_id IN (SELECT node_id FROM gone) OR e.target_id IN (SELECT node_id FROM gone) THEN 'deleted'
        WHEN s.new_id IS NULL OR t.new_id IS NULL THEN 'unmapped' WHEN s.new_id = t.new_id THEN 'self_loop'
        WHEN s.new_id <> e.source_id OR t.new_id <> e.target_id THEN 'remapped' ELSE 'kept' END AS disposition
   FROM g_edge e LEFT JOIN m s ON s.node_id = e.source_id LEFT JOIN m t ON t.node_id = e.target_id),
ne AS (SELECT type, ns, nt, max(w100) AS w100, CAST(sum(occurrence_count) AS BIGINT) AS occ FROM re WHERE disposition IN ('kept','remapped') GROUP BY 1, 2, 3),
nn AS (SELECT new_id AS id, any_value(nlabel) AS label, any_value(canonical) AS name, CAST(sum(occurrence_count) AS BIGINT) AS occ, max(w100) AS w100 FROM m GROUP BY 1)
SELECT 'node' AS kind, id, label, name, occ, w100 FROM nn WHERE label = 'Disease' OR id IN (SELECT ns FROM ne UNION SELECT nt FROM ne)
UNION ALL SELECT 'edge', 'merged_edge_' || substr(sha1(type || '|' || ns || '|' || nt || '|'), 1, 12), type, '', occ, w100 FROM ne
UNION ALL SELECT 'disposition', disposition, '', '', count(*), 0 FROM re GROUP BY 2"""


def rewrite_rows(out):
    n = out["nodes"].select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "label", F.col("canonical_name").alias("name"),
                            F.col("occurrence_count").alias("occ"), "w100")
    e = out["edges"].select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.col("type").alias("label"),
                            F.lit("").alias("name"), F.col("occurrence_count").alias("occ"), "w100")
    d = out["remap"].groupBy(F.col("disposition").alias("id")).agg(F.count(F.lit(1)).alias("occ")).select(
        F.lit("disposition").alias("kind"), "id", F.lit("").alias("label"), F.lit("").alias("name"), "occ", F.lit(0).cast("bigint").alias("w100"))
    return n.unionByName(e).unionByName(d)


@query("apply_aliases", f"""
WITH gone AS (SELECT node_id FROM g_node WHERE (label, name) IN (SELECT label, name FROM delete_name)),
moved AS (SELECT *, {SQL_CANON} AS canonical, label AS nlabel FROM g_node WHERE node_id NOT IN (SELECT node_id FROM gone)),
{SQL_REWRITE.format(nid=SQL_NID)}""")
def apply_aliases(t):
    out = graph.apply_aliases(t.g_node, t.g_edge, graph.alias_index(t.alias_file.where("file = 1")), t.delete_name)
    return rewrite_rows(out)


@query("reclassify_graph", f"""
WITH acted AS (SELECT n.*, r.action FROM g_node n LEFT JOIN reclass_rule r ON r.label = n.label AND lower(replace(r.name, ' ', '')) = lower(replace(n.name, ' ', ''))),
gone AS (SELECT node_id FROM acted WHERE action = 'DELETE'),
moved AS (SELECT *, name AS canonical, coalesce(action, label) AS nlabel FROM acted WHERE coalesce(action, '') <> 'DELETE'),
{SQL_REWRITE.format(nid="'merged_node_' || substr(sha1(nlabel || '::' || canonical), 1, 12)")}
UNION ALL SELECT 'unused_rule', name, label, action, 0, 0 FROM reclass_rule r WHERE NOT EXISTS (
  SELECT 1 FROM acted a WHERE a.label = r.label AND a.name = r.name AND a.action = r.action)""")
def reclassify_graph(t):
    out = graph.reclassify_graph(t.g_node, t.g_edge, t.reclass_rule)
    zero = F.lit(0).cast("bigint")
    unused = out["unused"].select(F.lit("unused_rule").alias("kind"), F.col("name").alias("id"), "label",
                                  F.col("action").alias("name"), zero.alias("occ"), zero.alias("w100"))
    return rewrite_rows(out).unionByName(unused)


@query("stable_graph_sort", """
SELECT 'node' AS kind, label AS k1, name AS k2, '' AS k3, node_id AS id FROM g_node
UNION ALL SELECT 'edge', type, source_id, target_id, edge_id FROM g_edge ORDER BY 1, 2, 3, 4, 5""")
def stable_graph_sort(t):
    n = t.g_node.select(F.lit("node").alias("kind"), F.col("label").alias("k1"), F.col("name").alias("k2"), F.lit("").alias("k3"),
                        F.col("node_id").alias("id"))
    e = t.g_edge.select(F.lit("edge").alias("kind"), F.col("type").alias("k1"), F.col("source_id").alias("k2"),
                        F.col("target_id").alias("k3"), F.col("edge_id").alias("id"))
    return n.unionByName(e).orderBy("kind", "k1", "k2", "k3", "id")


# -- upsert, splice, reports ---------------------------------------------------------------------------

@query("graph_upsert", """
WITH delta AS (SELECT node_id, label, CASE WHEN w100 > 50 THEN upper(name) END AS name, w100 + 1 AS w100 FROM g_node WHERE occurrence_count > 4
  UNION ALL SELECT 'new_' || n_nationkey, 'PopulationGroup', n_name, n_regionkey FROM nation)
SELECT coalesce(d.node_id, b.node_id) AS node_id, coalesce(d.label, b.label) AS label, coalesce(d.name, b.name) AS name,
  coalesce(d.w100, b.w100) AS w100 FROM (SELECT node_id, label, name, w100 FROM g_node) b FULL JOIN delta d ON d.node_id = b.node_id AND d.label = b.label""")
def graph_upsert(t):
    base = t.g_node.select("node_id", "label", "name", "w100")
    delta = t.g_node.where("occurrence_count > 4").select(
        "node_id", "label", F.when(F.col("w100") > 50, F.upper("name")).alias("name"), (F.col("w100") + 1).alias("w100"))
    fresh = t.raw("nation").select(
        F.concat(F.lit("new_"), F.col("n_nationkey").cast("string")).alias("node_id"), F.lit("PopulationGroup").alias("label"),
        F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("w100"))
    return graph.upsert(base, delta.unionByName(fresh), ["label", "node_id"]).select("node_id", "label", "name", "w100")


@query("graph_upsert_edges", """
WITH delta AS (SELECT edge_id, type, source_id, target_id, occurrence_count * 10 AS occurrence_count FROM g_edge WHERE w100 > 90
  UNION ALL SELECT 'x' || s_suppkey, 'HAS_PATHOGEN', 'S' || s_suppkey, 'nowhere', 1 FROM supplier),
known AS (SELECT * FROM delta WHERE source_id IN (SELECT node_id FROM g_node) AND target_id IN (SELECT node_id FROM g_node))
SELECT coalesce(d.edge_id, b.edge_id) AS edge_id, coalesce(d.type, b.type) AS type, coalesce(d.occurrence_count, b.occurrence_count) AS occurrence_count
FROM g_edge b FULL JOIN known d ON d.edge_id = b.edge_id AND d.type = b.type""")
def graph_upsert_edges(t):
    cols = ["edge_id", "type", "source_id", "target_id", "occurrence_count"]
    delta = t.g_edge.where("w100 > 90").withColumn("occurrence_count", F.col("occurrence_count") * 10).select(*cols)
    stray = t.raw("supplier").select(
        F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("edge_id"), F.lit("HAS_PATHOGEN").alias("type"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit("nowhere").alias("target_id"),
        F.lit(1).cast("bigint").alias("occurrence_count"))
    known = graph.known_endpoints(delta.unionByName(stray), t.g_node)
    return graph.upsert(t.g_edge.select(*cols), known.select(*cols), ["type", "edge_id"]).select("edge_id", "type", "occurrence_count")


@query("replace_records", """
SELECT o_orderkey AS chunk_id, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'redone' ELSE o_orderstatus END AS record,
  o_orderstatus = 'O' AND o_totalprice > 100000 AS replaced FROM orders""")
def replace_records(t):
    o = t.raw("orders")
    base = o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("record"))
    redo = o.where("o_orderstatus = 'O' AND o_totalprice > 100000").select(F.col("o_orderkey").alias("chunk_id"), F.lit("redone").alias("record"))
    return graph.replace_records(base, redo, "chunk_id", ["record"])


@query("label_counts", "SELECT label, count(*) AS n FROM g_node GROUP BY 1")
def label_counts(t):
    return graph.label_counts(t.g_node)


@query("type_counts", "SELECT type, count(*) AS n FROM g_edge GROUP BY 1")
def type_counts(t):
    return graph.type_counts(t.g_edge)


@query("graph_quality_report", """
WITH n AS (SELECT * FROM kg_node UNION ALL SELECT NULL, 'Gadget', n_name, 0, NULL, NULL, NULL FROM nation
           UNION ALL SELECT 'S' || s_suppkey, 'Phase', s_name, 0, NULL, NULL, NULL FROM supplier WHERE s_acctbal > 9000),
e AS (SELECT rel AS type, src AS s, dst AS t FROM kg_edge UNION ALL SELECT 'LOOP', 'S' || s_suppkey, 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0),
ends AS (SELECT s AS id FROM e UNION SELECT t FROM e),
alone AS (SELECT * FROM n WHERE node_id IS NULL OR node_id NOT IN (SELECT id FROM ends)),
ev AS (SELECT * FROM n WHERE label IN ('ClinicalFinding','ClinicalAttribute','LabTest','LabFinding','ImagingFinding','Pathogen','RiskFactor','PopulationGroup'))
SELECT 'node_count' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM n
UNION ALL SELECT 'missing_id_node_count', '', count(*) FROM n WHERE coalesce(node_id, '') = ''
UNION ALL SELECT 'relationship_count', '', count(*) FROM e UNION ALL SELECT 'self_loop_count', '', count(*) FROM e WHERE s = t
UNION ALL SELECT 'isolated_node_count', '', count(*) FROM alone
UNION ALL SELECT 'duplicate_id_count', '', count(*) FROM (SELECT node_id FROM n WHERE node_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'evidence_node_count', '', count(*) FROM ev UNION ALL SELECT 'acquisition_mode_count', '', count(mode) FROM ev
UNION ALL SELECT 'evidence_cost_count', '', count(cost) FROM ev
UNION ALL SELECT 'acquisition_mode_coverage', '', count(mode) / count(*) FROM ev
UNION ALL SELECT 'evidence_cost_coverage', '', count(cost) / count(*) FROM ev
UNION ALL SELECT 'isolated_node_ratio', '', (SELECT count(*) FROM alone) / count(*) FROM n
UNION ALL SELECT 'label', label, count(*) FROM n GROUP BY 2 UNION ALL SELECT 'relationship_type', type, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'isolated_label', label, count(*) FROM alone GROUP BY 2
UNION ALL SELECT 'deprecated_label', label, count(*) FROM n WHERE label = 'Phase' GROUP BY 2
UNION ALL SELECT 'unexpected_label', label, count(*) FROM n WHERE label IN ('Phase', 'Gadget') GROUP BY 2
UNION ALL SELECT 'unexpected_relationship_type', type, count(*) FROM e WHERE type = 'LOOP' GROUP BY 2""")
def graph_quality_report(t):
    null, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    extra = t.raw("nation").select(null.alias("node_id"), F.lit("Gadget").alias("label"), F.col("n_name").alias("name"), zero.alias("w100"),
                                   null.alias("grp"), null.alias("mode"), null.alias("cost"))
    s = t.raw("supplier")
    sid = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    old = s.where("s_acctbal > 9000").select(sid.alias("node_id"), F.lit("Phase").alias("label"), F.col("s_name").alias("name"),
                                            zero.alias("w100"), null.alias("grp"), null.alias("mode"), null.alias("cost"))
    e = t.kg_edge.select(F.col("rel").alias("type"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    loop = s.where("s_acctbal < 0").select(F.lit("LOOP").alias("type"), sid.alias("source_id"), sid.alias("target_id"))
    return graph.quality_report(t.kg_node.unionByName(extra).unionByName(old), e.unionByName(loop), deprecated=("Phase",))


@query("name_candidates", "SELECT label, name, count(*) AS n FROM chunk_node GROUP BY 1, 2")
def name_candidates(t):
    return graph.name_candidates(t.chunk_node)


@query("names_by_label", """
SELECT DISTINCT CASE label WHEN 'Disease' THEN 1 WHEN 'ClinicalFinding' THEN 2 WHEN 'ClinicalAttribute' THEN 3 WHEN 'LabFinding' THEN 5
  WHEN 'ImagingFinding' THEN 6 WHEN 'Pathogen' THEN 7 WHEN 'RiskFactor' THEN 8 END AS label_order, label, name, lower(name) AS sort_key FROM kg_node""")
def names_by_label(t):
    return graph.names_by_label(t.kg_node.withColumn("canonical_name", F.col("name")))


@query("run_summary", """
SELECT path, count(DISTINCT chunk_id) AS chunks, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(edges) AS BIGINT) AS edges,
  CAST(sum(ok) AS BIGINT) AS successes, CAST(sum(1 - ok) AS BIGINT) AS failures FROM (
  SELECT 'guide_' || year(o_orderdate) || '.md' AS path, o_orderkey AS chunk_id, coalesce(n.nodes, 0) AS nodes, coalesce(e.edges, 0) AS edges, CASE WHEN coalesce(e.edges, 0) > 0 THEN 1 ELSE 0 END AS ok
  FROM orders LEFT JOIN (SELECT chunk_id, count(*) AS nodes FROM chunk_node GROUP BY 1) n ON n.chunk_id = o_orderkey
  LEFT JOIN (SELECT chunk_id, count(*) AS edges FROM chunk_edge GROUP BY 1) e ON e.chunk_id = o_orderkey) GROUP BY 1""")
def run_summary(t):
    """Every order is a chunk; one without lines has no extraction and counts as failed."""
    chunk = t.raw("orders").select(F.concat(F.lit("guide_"), F.year("o_orderdate").cast("string"), F.lit(".md")).alias("path"), F.col("o_orderkey").alias("chunk_id"))
    n = t.chunk_node.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = t.chunk_edge.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("edges"))
    j = chunk.join(n, "chunk_id", "left").join(e, "chunk_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("nodes", "edges")})
    ok = (F.col("edges") > 0).cast("int")
    return j.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"),
                                 F.sum(ok).alias("successes"), F.sum(1 - ok).alias("failures"))
