"""Queries for graph audit and case assembly."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.tags import tags
from ..functions.vocab import EVIDENCE_GROUPS
from ..operators import audit as a
from ..operators import cases as c
from ..operators import retrieve as r
from ..sources import scan
from ..sources.sinks import scratch_folder, written
from .q_retrieve import SQL_PROFILE, candidates, evidence, links, once
from .registry import query

# Family words that occur in the part names, per evidence group.
RULES = {
    "symptom": (("respiratory_symptom", ("ring", "gear")), ("neurologic_symptom", ("bolt",)), ("metabolic_symptom", ("widget",))),
    "risk": (("exposure_risk", ("anvil",)), ("medication_risk", ("rod",))),
    "detail": (("metabolic_definition", ("gizmo",)), ("onset_timing", ("plate",))),
    "lab": (("disease_specific_lab", ("ring",)), ("serology", ("gear",)), ("oxygenation", ("bolt",))),
    "imaging": (("cns_imaging", ("widget",)),),
    "pathogen": (("viral_pathogen", ("anvil", "rod")),),
}
COMMON = (("immune_status", ("hot",)), ("worsening", ("cold",)))
SQL_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{g}','{fam}','{w}')" for g, rs in RULES.items() for fam, ws in rs for w in ws) + ", " + ", ".join(
    f"('*','{fam}','{w}')" for fam, ws in COMMON for w in ws) + ") v(grp, family, word))"
SQL_PRIO = "CASE family " + " ".join(f"WHEN '{f}' THEN {p}" for f, p in a.FAMILY_PRIORITY.items()) + " ELSE 0 END"
SQL_EFAM = f"""{SQL_RULES},
ef0 AS (SELECT DISTINCT e.node_id, e.grp, r.family FROM kg_evidence e JOIN rules r ON r.grp IN (e.grp, '*') AND contains(e.name, r.word)
  UNION SELECT node_id, grp, grp FROM kg_evidence WHERE grp IN ('imaging','pathogen')),
efam AS (SELECT * FROM ef0 UNION ALL SELECT node_id, grp, 'general_' || grp FROM kg_evidence WHERE node_id NOT IN (SELECT node_id FROM ef0))"""
SQL_ITEM = f"""{SQL_PROFILE},
item AS (SELECT candidate_id AS disease_id, node_id, name, label, hint AS grp, rel, priority, contradiction AS spec100, rel_w100, node_w100, mode, cost,
  pre_rank AS profile_rank FROM pr1 WHERE pre_rank <= 80)"""
SQL_ASCORE = "priority / 10000 + spec100 / 100 * 0.55 + rel_w100 / 100 * 0.2 + CASE WHEN grp IN ('lab','imaging','pathogen') THEN 0.2 ELSE 0.0 END"
SQL_RANKED = f"""{SQL_ITEM},
ranked AS (SELECT *, {SQL_ASCORE} AS audit_score, row_number() OVER (PARTITION BY disease_id ORDER BY {SQL_ASCORE} DESC, grp, name, node_id) AS audit_rank FROM item)"""


def diseases(t):
    return candidates(t).select(F.col("candidate_id").alias("disease_id"), F.col("candidate_name").alias("disease_name"))


def items(t, limit=a.ITEM_LIMIT):
    """Lines are dealt by pair, evidence by node, where it meets its names, then by disease: each stays small in a task however much there is."""
    edges = t.edges(t.pairs(t.deal(t.raw("lineitem").select("l_suppkey", "l_partkey", "l_discount"), "l_suppkey", "l_partkey")))
    e = r.evidence_rows(r.direction_union(edges, deal=lambda k: t.deal(k, "feature_id")), t.kg_node)
    return a.audit_items(t.deal(e, "candidate_id"), limit)


def families(t):
    """Evidence nodes with their families, tagged once per node."""
    e = t.kg_evidence
    return e.select(F.col("node_id").alias("evidence_id"), "grp", a.family_tags(F.col("name"), F.col("grp"), RULES, COMMON).alias("families"))


@query("audit_rank", f"WITH {SQL_RANKED} SELECT disease_id, node_id, audit_score, audit_rank FROM ranked")
def audit_rank(t):
    return a.audit_rank(items(t)).select("disease_id", "node_id", "audit_score", "audit_rank")


@query("group_summary", f"""
WITH {SQL_RANKED},
g AS (SELECT unnest(['symptom','risk','lab','imaging','pathogen','detail']) AS grp),
s AS (SELECT disease_id, grp, count(*) AS n, sum(priority) AS p, sum(spec100) AS s, CAST(sum((cost = 'high')::INT) AS BIGINT) AS hc FROM item GROUP BY 1, 2),
nm AS (SELECT disease_id, grp, string_agg(name, '|' ORDER BY rk) AS top_names FROM (SELECT *, row_number() OVER (PARTITION BY disease_id, grp ORDER BY audit_rank) AS rk FROM ranked) WHERE rk <= 5 GROUP BY 1, 2)
SELECT d.node_id AS disease_id, g.grp, coalesce(n, 0) AS n, coalesce(p / n, 0) / 10000 AS avg_priority, coalesce(s / n, 0) / 100 AS avg_specificity,
  coalesce(hc, 0) AS high_cost, coalesce(top_names, '') AS top_names
FROM kg_disease d CROSS JOIN g LEFT JOIN s ON s.disease_id = d.node_id AND s.grp = g.grp LEFT JOIN nm ON nm.disease_id = d.node_id AND nm.grp = g.grp""")
def group_summary(t):
    return a.group_summary(items(t), diseases(t))


SQL_FOLDER = """fdis AS (SELECT 'O' || o_orderkey AS disease_id, 'order ' || o_orderkey AS disease_name FROM orders
  UNION ALL SELECT 'C' || c_custkey, c_name FROM customer),
fitem AS (SELECT 'O' || l_orderkey AS disease_id, e.node_id, e.name, e.label, e.grp, e.rel, e.mode, e.cost, e.w100 * 100 AS priority, 85 AS spec100, l.rel_w100, e.w100 AS node_w100
  FROM (SELECT l_orderkey, l_partkey, max(CAST(round(l_discount * 1000) AS BIGINT)) AS rel_w100 FROM lineitem GROUP BY 1, 2) l JOIN kg_evidence e ON e.node_id = 'P' || l_partkey)"""


def folder_diseases(t):
    """Orders and customers as diseases: orders have little evidence, customers none."""
    o = t.raw("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("disease_id"),
                               F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("disease_name"))
    return o.unionByName(t.raw("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("disease_id"), F.col("c_name").alias("disease_name")))


def folder_items(t):
    """Every part of every order as an evidence item of the order."""
    li = t.raw("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.round(F.col("l_discount") * 1000).cast("bigint")).alias("rel_w100"))
    li = li.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("disease_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("node_id"), "rel_w100")
    e = t.kg_evidence.select("node_id", "name", "label", "grp", "rel", "mode", "cost", (F.col("w100") * 100).alias("priority"), F.lit(85).alias("spec100"), F.col("w100").alias("node_w100"))
    return li.join(e, "node_id")


SQL_ISS = """iss AS (SELECT d.disease_id, CASE WHEN n IS NULL THEN 'error' ELSE 'warning' END AS severity,
  CASE WHEN n IS NULL THEN 'no_evidence' ELSE 'too_few_evidence' END AS code, coalesce(n, 0) AS evidence_count
  FROM fdis d LEFT JOIN (SELECT disease_id, count(*) AS n FROM fitem GROUP BY 1) x ON x.disease_id = d.disease_id WHERE coalesce(n, 0) <= 6)"""


@query("audit_issues", f"WITH {SQL_FOLDER}, {SQL_ISS} SELECT * FROM iss")
def audit_issues(t):
    return a.audit_issues(folder_items(t), folder_diseases(t))


@query("disease_summary", f"""
WITH {SQL_FOLDER}, {SQL_ISS},
s AS (SELECT disease_id, count(*) AS evidence_count, CAST(sum((grp IN ('lab','imaging','pathogen'))::INT) AS BIGINT) AS exam_evidence_count,
  CAST(sum((mode IN ('direct_ask','history_known'))::INT) AS BIGINT) AS direct_ask_count, CAST(sum((cost = 'high')::INT) AS BIGINT) AS high_cost_count,
  {', '.join(f"max(CASE WHEN grp = '{g}' THEN '{g}' END) AS h_{g}" for g in EVIDENCE_GROUPS)} FROM fitem GROUP BY 1)
SELECT d.disease_id, coalesce(s.evidence_count, 0) AS evidence_count, coalesce(exam_evidence_count, 0) AS exam_evidence_count,
  coalesce(direct_ask_count, 0) AS direct_ask_count, coalesce(high_cost_count, 0) AS high_cost_count, (iss.code IS NOT NULL)::BIGINT AS issue_count,
  (coalesce(iss.severity, '') = 'error')::BIGINT AS error_count, (coalesce(iss.severity, '') = 'warning')::BIGINT AS warning_count,
  concat_ws(',', {', '.join(f'h_{g}' for g in EVIDENCE_GROUPS)}) AS groups_present
FROM fdis d LEFT JOIN s ON s.disease_id = d.disease_id LEFT JOIN iss ON iss.disease_id = d.disease_id""")
def disease_summary(t):
    i, d = folder_items(t), folder_diseases(t)
    return a.disease_summary(i, a.audit_issues(i, d), d)


@query("low_evidence_list", f"""
WITH {SQL_FOLDER}
SELECT d.disease_id, d.disease_name, coalesce(n, 0) AS evidence_count FROM fdis d
LEFT JOIN (SELECT disease_id, count(*) AS n FROM fitem GROUP BY 1) x ON x.disease_id = d.disease_id WHERE coalesce(n, 0) <= 3""")
def low_evidence_list(t):
    return a.low_evidence(folder_items(t), folder_diseases(t), 3)


@query("scan_audit_reports", f"""
WITH {SQL_FOLDER},
x AS (SELECT disease_id, CASE WHEN node_w100 >= 94 THEN NULL ELSE mode END AS mode, CASE WHEN rel_w100 > 96 AND grp = 'lab' THEN NULL ELSE cost END AS cost FROM fitem)
SELECT disease_id, concat_ws(',', max(CASE WHEN mode IS NULL THEN 'acquisition_mode' END), max(CASE WHEN cost IS NULL THEN 'evidence_cost' END)) AS missing_fields
FROM x GROUP BY 1""")
def scan_audit_reports(t):
    """One report per order, written as JSON lines and read back; some items lack a field."""
    item = F.struct(
        F.col("node_id").alias("target_node_id"), F.col("name").alias("target_name"), F.col("label").alias("target_label"), F.col("grp").alias("group"),
        F.col("rel").alias("relation_type"), (F.col("priority") / 10000).alias("priority"), (F.col("spec100") / 100).alias("relation_specificity"),
        (F.col("rel_w100") / 100).alias("relation_weight"), F.when(F.col("node_w100") < 94, F.col("mode")).alias("acquisition_mode"),
        F.when(~((F.col("rel_w100") > 96) & (F.col("grp") == "lab")), F.col("cost")).alias("evidence_cost"))
    reports = folder_items(t).groupBy("disease_id").agg(F.collect_list(item).alias("evidence"))  # the lines of one order
    folder = scratch_folder(t.spark, "reports")
    reports.select(F.to_json(F.struct(F.struct("disease_id").alias("disease"), "evidence")).alias("value")).write.text(folder)
    ok, bad = a.valid_reports(scan.scan_audit_reports(t.spark, folder), {f: f for f in a.REQUIRED_FIELDS})
    return ok.withColumn("missing_fields", F.lit("")).unionByName(bad)


# -- pairs --------------------------------------------------------------------------------------------

def pairs(t):
    """Every disease against the next one by key."""
    s = t.raw("supplier").select("s_suppkey")
    nxt = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("other"))
    sid = lambda x: F.concat(F.lit("S"), F.col(x).cast("string"))
    return s.join(nxt, "s_suppkey").select(sid("s_suppkey").alias("target_id"), sid("other").alias("competitor_id"))


SQL_SPLIT = f"""{SQL_ITEM},
prs AS (SELECT 'S' || x.s_suppkey AS target_id, 'S' || y.s_suppkey AS competitor_id FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1),
split AS (
 SELECT p.target_id, p.competitor_id, i.node_id, i.grp, i.priority, i.spec100,
  CASE WHEN coalesce((SELECT min(1) FROM item o WHERE o.disease_id = p.competitor_id AND (o.node_id = i.node_id OR o.name = i.name)), 0) = 1 THEN 'shared' ELSE 'target_only' END AS bucket,
  coalesce((SELECT arg_min(o.priority, o.profile_rank) FROM item o WHERE o.disease_id = p.competitor_id AND o.node_id = i.node_id),
           (SELECT arg_min(o.priority, o.profile_rank) FROM item o WHERE o.disease_id = p.competitor_id AND o.name = i.name)) AS other_priority
 FROM prs p JOIN item i ON i.disease_id = p.target_id
 UNION ALL
 SELECT p.target_id, p.competitor_id, i.node_id, i.grp, i.priority, i.spec100, 'competitor_only', NULL FROM prs p JOIN item i ON i.disease_id = p.competitor_id
 WHERE NOT EXISTS (SELECT 1 FROM item o WHERE o.disease_id = p.target_id AND (o.node_id = i.node_id OR o.name = i.name)))"""


@query("differential_pair", f"WITH {SQL_SPLIT} SELECT target_id, competitor_id, node_id, bucket, priority, other_priority FROM split")
def differential_pair(t):
    return a.split_pair(pairs(t), items(t)).select("target_id", "competitor_id", "node_id", "bucket", "priority", "other_priority")


def b_(cond):
    return f"CAST(coalesce(sum(({cond})::INT), 0) AS BIGINT)"


@query("differential_issues", f"""
WITH {SQL_SPLIT},
x AS (SELECT target_id, competitor_id, {b_("bucket = 'shared'")} AS shared_count, {b_("bucket = 'target_only'")} AS target_only_count, {b_("bucket = 'competitor_only'")} AS competitor_only_count,
  {b_("grp IN ('lab','imaging','pathogen')")} AS exam_pool_count, {b_("bucket = 'target_only' AND (priority >= 10000 OR spec100 >= 85)")} AS strong_target_count FROM split GROUP BY 1, 2)
SELECT *, concat_ws(',', CASE WHEN target_only_count = 0 THEN 'missing_target_only_evidence' END, CASE WHEN competitor_only_count = 0 THEN 'missing_competitor_only_evidence' END,
  CASE WHEN shared_count / (shared_count + target_only_count + competitor_only_count) >= 0.55 THEN 'shared_evidence_ratio_high' END,
  CASE WHEN exam_pool_count = 0 THEN 'empty_exam_pool' END, CASE WHEN strong_target_count = 0 THEN 'weak_target_only_evidence' END) AS issues FROM x""")
def differential_issues(t):
    return a.pair_issues(a.split_pair(pairs(t), items(t)), pairs(t))


@query("disease_lookup", """
WITH k AS (SELECT node_id AS d, node_id AS k, 0 AS p FROM kg_disease UNION SELECT node_id, name, 0 FROM kg_disease
  UNION SELECT 'S' || s_suppkey, 'NATION_' || s_nationkey, 1 FROM supplier UNION SELECT 'S' || s_suppkey, 'S' || (s_suppkey + 1), 1 FROM supplier),
k2 AS (SELECT d, k, min(p) AS p FROM k GROUP BY 1, 2),
rq AS (SELECT DISTINCT request FROM (SELECT n_name AS request FROM nation UNION ALL SELECT 'S' || (s_suppkey + 1) FROM supplier UNION ALL SELECT s_name FROM supplier)),
h AS (SELECT request, p, count(*) AS n, min(d) AS d FROM rq JOIN k2 ON k2.k = request GROUP BY 1, 2),
b AS (SELECT request, arg_min(n, p) AS n, arg_min(d, p) AS d FROM h GROUP BY 1)
SELECT rq.request, CASE WHEN n = 1 THEN d END AS disease_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM rq LEFT JOIN b USING (request)""")
def disease_lookup(t):
    s = t.raw("supplier")
    nxt = F.concat(F.lit("S"), (F.col("s_suppkey") + 1).cast("string"))
    d = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("disease_id"), F.col("s_name").alias("disease_name"),
                 F.array(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")), nxt).alias("aliases"))
    req = t.raw("nation").select(F.col("n_name").alias("request")).unionByName(s.select(nxt.alias("request"))).unionByName(
        s.select(F.col("s_name").alias("request")))
    return a.disease_lookup(req, d)


# -- family catalog ------------------------------------------------------------------------------------------

@query("evidence_group_col", """
SELECT CASE WHEN p_size > 40 THEN 'odd' WHEN p_size > 30 THEN 'lab' ELSE '' END AS explicit_group, label, rel,
  CASE WHEN p_size > 30 AND p_size <= 40 THEN 'lab' WHEN p_size < 10 THEN CASE rel WHEN 'MANIFESTS_AS' THEN 'symptom' WHEN 'HAS_LAB_FINDING' THEN 'lab'
     WHEN 'HAS_IMAGING_FINDING' THEN 'imaging' WHEN 'HAS_PATHOGEN' THEN 'pathogen' WHEN 'RISK_FACTOR_FOR' THEN 'risk' ELSE 'detail' END ELSE e.grp END AS resolved, count(*) AS n
FROM (SELECT node_id, grp, rel, CASE WHEN w100 < 20 THEN 'Unknown' ELSE label END AS label FROM kg_evidence) e JOIN part ON 'P' || p_partkey = e.node_id GROUP BY 1, 2, 3, 4""")
def evidence_group_col(t):
    size = F.col("w100") / 2
    e = t.kg_evidence.select(
        F.when(size > 40, "odd").when(size > 30, "lab").otherwise("").alias("explicit_group"),
        F.when(F.col("w100") < 20, "Unknown").otherwise(F.col("label")).alias("label"), "rel")
    return e.groupBy("explicit_group", "label", "rel").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "resolved", a.evidence_group(F.col("explicit_group"), F.col("label"), F.col("rel")))


@query("family_tags", f"WITH {SQL_EFAM} SELECT node_id, family FROM efam")
def family_tags(t):
    return families(t).select(F.col("evidence_id").alias("node_id"), F.explode("families").alias("family"))


@query("family_rule_file", f"WITH {SQL_EFAM} SELECT node_id, family FROM efam")
def family_rule_file(t):
    """The same families by a rule file and the term index."""
    rules = {g: dict(rs) for g, rs in RULES.items()} | {"*": dict(COMMON)}
    folder = scratch_folder(t.spark, "rules")
    t.spark.createDataFrame([(json.dumps(rules),)], "value string").write.text(folder)
    rows = a.family_rows(t.kg_evidence.select(F.col("node_id").alias("evidence_id"), "name", "grp"), scan.scan_family_rules(t.spark, folder))
    return rows.select(F.col("evidence_id").alias("node_id"), "family")


@query("family_catalog", f"""
WITH {SQL_EFAM} SELECT disease_id, grp, family, count(*) AS n FROM kg_pair JOIN efam ON efam.node_id = evidence_id GROUP BY 1, 2, 3""")
def family_catalog(t):
    return a.family_catalog(t.kg_pair, families(t))


@query("evidence_nodes", f"""
WITH {SQL_EFAM}
SELECT evidence_id, grp, count(DISTINCT disease_id) AS disease_count, min((family LIKE 'general_%')::INT) = 1 AS unclassified FROM kg_pair JOIN efam ON efam.node_id = evidence_id GROUP BY 1, 2""")
def evidence_nodes(t):
    return a.evidence_nodes(t.kg_pair, families(t)).select("evidence_id", "grp", "disease_count", "unclassified")


@query("edge_dedupe", """
WITH e AS (SELECT 'S' || l_suppkey AS disease_id, 'P' || l_partkey AS evidence_id, l_returnflag AS rel, l_linestatus AS direction, l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT disease_id, evidence_id, rel, direction, arg_min(l_orderkey, (l_orderkey, l_linenumber, l_quantity)) AS l_orderkey, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS l_quantity
FROM e GROUP BY 1, 2, 3, 4""")
def edge_dedupe(t):
    li = t.raw("lineitem")
    e = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("disease_id"),
                  F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("evidence_id"), F.col("l_returnflag").alias("rel"),
                  F.col("l_linestatus").alias("direction"), "l_orderkey", "l_linenumber", "l_quantity")
    return a.dedupe_edges(e, ["l_orderkey", "l_linenumber", "l_quantity"]).drop("l_linenumber")


@query("minimum_groups", f"""
WITH {SQL_EFAM},
c AS (SELECT disease_id, family, count(*) AS n FROM kg_pair JOIN efam ON efam.node_id = evidence_id GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY {SQL_PRIO} DESC, n DESC, family) AS rank FROM c WHERE family <> 'general_symptom')
SELECT disease_id, family, n, rank FROM o WHERE rank <= 8
UNION ALL SELECT disease_id, family, n, 1 FROM c WHERE family = 'general_symptom' AND disease_id NOT IN (SELECT disease_id FROM o)""")
def minimum_groups(t):
    return a.minimum_groups(a.family_catalog(t.kg_pair, families(t)), ["disease_id"], 8)


@query("minimum_groups_by_group", f"""
WITH {SQL_EFAM},
c AS (SELECT disease_id, grp, family, count(*) AS n FROM kg_pair JOIN efam ON efam.node_id = evidence_id GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY disease_id, grp ORDER BY {SQL_PRIO} DESC, n DESC, family) AS rank FROM c WHERE family <> 'general_symptom')
SELECT disease_id, grp, family, n, rank FROM o WHERE rank <= 2
UNION ALL SELECT disease_id, grp, family, n, 1 FROM c WHERE family = 'general_symptom' AND (disease_id, grp) NOT IN (SELECT disease_id, grp FROM o)""")
def minimum_groups_by_group(t):
    return a.minimum_groups(a.family_catalog(t.kg_pair, families(t)), ["disease_id", "grp"], 2)


@query("evidence_connectivity", f"""
WITH {SQL_ITEM},
n AS (SELECT node_id, count(DISTINCT disease_id) AS disease_count FROM item GROUP BY 1),
l AS (SELECT greatest(3, CAST(ceil(count(DISTINCT disease_id) * 0.08::DOUBLE) AS BIGINT)) AS threshold FROM item)
SELECT node_id, disease_count, threshold, disease_count >= threshold AS high FROM n, l""")
def evidence_connectivity(t):
    return a.evidence_connectivity(items(t))


# -- measurements ---------------------------------------------------------------------------------------------

SQL_MTEXT = """CASE p_type WHEN 'ECONOMY' THEN 'BMI' WHEN 'STANDARD' THEN '年龄' WHEN 'PROMO' THEN 'LDL-C' WHEN 'LARGE' THEN 'CD4' WHEN 'MEDIUM' THEN 'HDL' ELSE 'HIV RNA' END
  || CASE WHEN p_size > 40 THEN ' > ' || p_size WHEN p_size > 30 THEN ' <= 10^' || (p_size - 30) WHEN p_size > 20 THEN ' ' || p_size || '-' || (p_size + 7)
     WHEN p_size > 12 THEN '升高' WHEN p_size > 6 THEN ' >= 2.5 < ' || p_size ELSE '' END"""


def mtext():
    base = (F.when(F.col("p_type") == "ECONOMY", "BMI").when(F.col("p_type") == "STANDARD", "年龄").when(F.col("p_type") == "PROMO", "LDL-C")
            .when(F.col("p_type") == "LARGE", "CD4").when(F.col("p_type") == "MEDIUM", "HDL").otherwise("HIV RNA"))
    s = F.col("p_size")
    text = lambda x: x.cast("string")
    tail = (F.when(s > 40, F.concat(F.lit(" > "), text(s))).when(s > 30, F.concat(F.lit(" <= 10^"), text(s - 30)))
            .when(s > 20, F.concat(F.lit(" "), text(s), F.lit("-"), text(s + 7))).when(s > 12, F.lit("升高"))
            .when(s > 6, F.concat(F.lit(" >= 2.5 < "), text(s))).otherwise(""))
    return F.concat(base, tail)


@query("measurement_extract", f"""
WITH x AS (SELECT {SQL_MTEXT} AS text, p_size, count(*) AS n FROM part GROUP BY 1, 2)
SELECT text, CAST(sum(n) AS BIGINT) AS n, CASE WHEN p_size > 30 THEN 1 WHEN p_size > 6 AND p_size <= 12 THEN 2 ELSE 0 END AS n_comparators,
  CASE WHEN p_size > 40 THEN '>' WHEN p_size > 30 THEN '<=' WHEN p_size > 6 AND p_size <= 12 THEN '<' END AS last_op,
  CAST(CASE WHEN p_size > 40 THEN p_size WHEN p_size > 30 THEN pow(10, p_size - 30) WHEN p_size > 6 AND p_size <= 12 THEN p_size END AS DOUBLE) AS last_value,
  CAST(CASE WHEN p_size > 20 AND p_size <= 30 THEN p_size END AS DOUBLE) AS range_low, CAST(CASE WHEN p_size > 20 AND p_size <= 30 THEN p_size + 7 END AS DOUBLE) AS range_high FROM x GROUP BY text, 3, 4, 5, 6, 7""")
def measurement_extract(t):
    g = t.raw("part").groupBy(mtext().alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("text", "n", *[v.alias(k) for k, v in c.measurements(F.col("text")).items()])


@query("conflict_family_col", f"""
WITH x AS (SELECT {SQL_MTEXT} AS text, p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2, 3),
y AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'bmi' WHEN 'STANDARD' THEN 'age' WHEN 'PROMO' THEN 'ldl' WHEN 'LARGE' THEN 'cd4' WHEN 'MEDIUM' THEN 'hdl' ELSE 'hiv_rna' END AS family,
  CASE WHEN p_size > 40 THEN '>' WHEN p_size > 30 THEN '<' WHEN p_size > 20 THEN 'range' WHEN p_size > 12 THEN 'up' WHEN p_size > 6 THEN '<' ELSE 'plain' END AS form,
  CAST(CASE WHEN p_size > 30 AND p_size <= 40 THEN pow(10, p_size - 30) ELSE p_size END AS DOUBLE) AS v FROM x)
SELECT text, family, CAST(sum(n) AS BIGINT) AS n,
  CASE form WHEN '<' THEN CASE family WHEN 'bmi' THEN 1 ELSE 0 END WHEN '>' THEN CASE family WHEN 'cd4' THEN 1 ELSE 0 END
    WHEN 'range' THEN CASE family WHEN 'cd4' THEN 2 WHEN 'bmi' THEN 3 ELSE 1 END WHEN 'up' THEN CASE family WHEN 'cd4' THEN 4 ELSE 2 END
    ELSE CASE family WHEN 'cd4' THEN 6 WHEN 'bmi' THEN 3 ELSE 4 END END AS r1,
  CASE form WHEN '<' THEN v WHEN '>' THEN CASE family WHEN 'hdl' THEN v ELSE -v END WHEN 'range' THEN CASE family WHEN 'bmi' THEN 0 ELSE -v END
    WHEN 'up' THEN CASE family WHEN 'ldl' THEN 1 WHEN 'hdl' THEN 2 WHEN 'cd4' THEN 0 WHEN 'bmi' THEN 0 WHEN 'hiv_rna' THEN 5 ELSE 99 END ELSE 0 END AS r2,
  CASE WHEN form = 'range' AND family <> 'bmi' THEN 7 ELSE 0 END AS r3 FROM y GROUP BY text, family, 4, 5, 6""")
def conflict_family_col(t):
    g = t.raw("part").groupBy(mtext().alias("text")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("family", c.conflict_family(F.col("text")))
    return g.withColumn("s", c.strictness(F.col("text"), F.col("family"))).select("text", "family", "n", "s.r1", "s.r2", "s.r3")


CONFLICT = (("gear", ("gear",)), ("bolt", ("bolt",)), ("rod", ("rod",)))
SQL_CONF = "CASE WHEN contains(name, 'gear') THEN 'gear' WHEN contains(name, 'bolt') THEN 'bolt' WHEN contains(name, 'rod') THEN 'rod' ELSE '' END"


def unique(t, limit=a.ITEM_LIMIT):
    return c.unique_items(items(t, limit)).withColumn("conflict", c.conflict_family(F.col("name"), CONFLICT))


def kept_unique(t):
    """The same for queries that need it several times."""
    return once(t, "_unique", lambda: unique(t))


SQL_UNIQ = f"""{SQL_ITEM},
uniq AS (SELECT *, {SQL_CONF} AS conflict FROM (SELECT *, grp || '::' || replace(name, ' ', '') AS ekey, row_number() OVER (PARTITION BY disease_id, grp, name
  ORDER BY priority DESC, spec100 DESC, name, node_id) AS rn FROM item) WHERE rn = 1),
flg AS (SELECT *, grp IN ('symptom','risk','detail') AND mode IN ('direct_ask','history_known') AND cost <> 'high' AS low_cost,
  grp IN ('lab','imaging','pathogen') OR mode IN ('needs_lab_test','needs_imaging','needs_pathogen_test') AS exam FROM uniq),
cut0 AS (SELECT disease_id, list(priority ORDER BY priority DESC)[CAST(ceil(count(*) / 2) AS INT)] AS cutoff FROM uniq GROUP BY 1),
cut1 AS (SELECT disease_id, list(priority ORDER BY priority DESC)[CAST(ceil(count(*) / 2) AS INT)] AS cutoff FROM flg WHERE exam GROUP BY 1),
hv AS (SELECT flg.* FROM flg JOIN cut1 USING (disease_id) WHERE exam AND (priority >= cutoff OR spec100 >= 85 OR (grp IN ('lab','imaging','pathogen')
  AND rel IN ('DIAGNOSED_BY','HAS_LAB_FINDING','HAS_IMAGING_FINDING','HAS_PATHOGEN')))),
disc AS (SELECT uniq.* FROM uniq JOIN cut0 USING (disease_id) WHERE spec100 >= 85 OR priority >= cutoff)"""


SQL_UNIQ_ALL = SQL_UNIQ.replace(" WHERE pre_rank <= 80", "")


@query("conflict_keep_best", f"""
WITH {SQL_UNIQ_ALL}
SELECT disease_id, node_id, conflict FROM uniq WHERE conflict = '' UNION ALL
SELECT disease_id, arg_min(node_id, (-priority, -spec100, -length(name), name, node_id)), conflict FROM uniq WHERE conflict <> '' GROUP BY disease_id, conflict""")
def conflict_keep_best(t):
    return c.conflict_keep_best(unique(t, None), ["disease_id"]).select("disease_id", "node_id", "conflict")


@query("cost_pool_flags", f"""
WITH {SQL_UNIQ} SELECT grp, mode, cost, low_cost, exam, (grp IN ('symptom','risk')) AS opening_ok, count(*) AS n FROM flg GROUP BY 1, 2, 3, 4, 5, 6""")
def cost_pool_flags(t):
    return unique(t).withColumns(c.cost_pool_flags()).groupBy("grp", "mode", "cost", "low_cost", "exam", "opening_ok").agg(F.count(F.lit(1)).alias("n"))


@query("top_half_cutoff", f"WITH {SQL_UNIQ} SELECT disease_id, cutoff FROM cut0")
def top_half_cutoff(t):
    return c.top_half_cutoff(unique(t))


@query("high_value_pool", f"WITH {SQL_UNIQ} SELECT disease_id, node_id, priority FROM hv")
def high_value_pool(t):
    return c.high_value(unique(t)).select("disease_id", "node_id", "priority")


@query("disease_profile", f"""
WITH {SQL_UNIQ}
SELECT f.disease_id, count(*) AS n_all, {b_('low_cost')} AS n_low_cost, {b_('exam')} AS n_exam, any_value(h.n) AS n_high_value, any_value(h.g) AS n_exam_groups, any_value(d.n) AS n_disc
FROM flg f LEFT JOIN (SELECT disease_id, count(*) AS n, count(DISTINCT grp) AS g FROM hv GROUP BY 1) h USING (disease_id)
LEFT JOIN (SELECT disease_id, count(*) AS n FROM disc GROUP BY 1) d USING (disease_id) GROUP BY 1""")
def disease_profile(t):
    return c.disease_profile(unique(t)).select(
        "disease_id", "n_all", "n_low_cost", "n_exam", "n_high_value", F.size("exam_groups").cast("bigint").alias("n_exam_groups"),
        F.size("disc_keys").cast("bigint").alias("n_disc"))


# -- competitors ------------------------------------------------------------------------------------------------

@query("set_similarity", f"""
WITH {SQL_UNIQ},
prs AS (SELECT 'S' || x.s_suppkey AS a, 'S' || y.s_suppkey AS b FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1),
i AS (SELECT p.a, p.b, count(*) AS n FROM prs p JOIN uniq x ON x.disease_id = p.a JOIN uniq y ON y.disease_id = p.b AND y.ekey = x.ekey GROUP BY 1, 2),
s AS (SELECT disease_id, count(*) AS n FROM uniq GROUP BY 1)
SELECT p.a, p.b, coalesce(i.n, 0) AS inter, sa.n + sb.n - coalesce(i.n, 0) AS union_size, coalesce(i.n, 0) / (sa.n + sb.n - coalesce(i.n, 0)) AS similarity
FROM prs p JOIN s sa ON sa.disease_id = p.a JOIN s sb ON sb.disease_id = p.b LEFT JOIN i ON i.a = p.a AND i.b = p.b""")
def set_similarity(t):
    return c.set_similarity(pairs(t).toDF("a", "b"), unique(t).select(F.col("disease_id").alias("id"), F.col("ekey").alias("key")))


@query("competitor_pairs", f"""
WITH {SQL_UNIQ},
k AS (SELECT disease_id, ekey FROM flg WHERE low_cost), s AS (SELECT disease_id, count(*) AS n FROM k GROUP BY 1),
i AS (SELECT x.disease_id AS a, y.disease_id AS b, count(*) AS n FROM k x JOIN k y ON y.ekey = x.ekey AND x.disease_id <> y.disease_id GROUP BY 1, 2),
j AS (SELECT a, b, i.n AS inter, i.n / (sa.n + sb.n - i.n) AS similarity FROM i JOIN s sa ON sa.disease_id = a JOIN s sb ON sb.disease_id = b)
SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, inter DESC, b) AS rank FROM j QUALIFY rank <= 5""")
def competitor_pairs(t):
    k = unique(t).withColumns(c.cost_pool_flags()).where("low_cost").select(F.col("disease_id").alias("id"), F.col("ekey").alias("key"))
    return c.nearest_sets(k, 5)


def sql_j(name: str, kind: str) -> str:
    return f"""{name}i AS (SELECT x.d AS a, y.d AS b, count(*) AS n FROM {kind} x JOIN {kind} y ON y.k = x.k AND x.d <> y.d GROUP BY 1, 2),
{name}s AS (SELECT d, count(*) AS n FROM {kind} GROUP BY 1)"""


def sql_jx(name: str) -> str:
    return (f"coalesce(coalesce({name}i.n, 0) / nullif(coalesce({name}a.n, 0) + coalesce({name}b.n, 0) - coalesce({name}i.n, 0), 0), 0.0)")


_K = ("l", "y", "r", "e", "g", "t")
SQL_COMPET = f"""{SQL_UNIQ},
kl AS (SELECT DISTINCT disease_id AS d, ekey AS k FROM flg WHERE low_cost), ky AS (SELECT DISTINCT disease_id AS d, ekey AS k FROM flg WHERE grp = 'symptom'),
kr AS (SELECT DISTINCT disease_id AS d, ekey AS k FROM flg WHERE grp IN ('risk','detail')), ke AS (SELECT DISTINCT disease_id AS d, replace(name, ' ', '') AS k FROM hv),
kg AS (SELECT DISTINCT disease_id AS d, grp AS k FROM hv), kt AS (SELECT DISTINCT disease_id AS d, rel AS k FROM hv),
{', '.join(sql_j(x, 'k' + x) for x in _K)},
ali AS (SELECT x.disease_id AS a, y.disease_id AS b, count(*) AS n FROM disc x JOIN uniq y ON y.ekey = x.ekey AND x.disease_id <> y.disease_id GROUP BY 1, 2),
dn AS (SELECT disease_id, count(*) AS n FROM disc GROUP BY 1),
pr AS (SELECT x.node_id AS a, y.node_id AS b FROM kg_disease x JOIN kg_disease y ON x.node_id <> y.node_id),
sc AS (SELECT pr.a AS target_id, pr.b AS competitor_id, {sql_jx('l')} * 0.40::DOUBLE + {sql_jx('y')} * 0.25::DOUBLE + {sql_jx('r')} * 0.20::DOUBLE
   + ({sql_jx('e')} * 0.5::DOUBLE + {sql_jx('g')} * 0.25::DOUBLE + {sql_jx('t')} * 0.25::DOUBLE) * 0.15::DOUBLE AS score, coalesce(li.n, 0) AS n_shared, coalesce(dn.n, 0) - coalesce(ali.n, 0) AS n_target_only
  FROM pr {' '.join(f"LEFT JOIN {x}i ON {x}i.a = pr.a AND {x}i.b = pr.b LEFT JOIN {x}s {x}a ON {x}a.d = pr.a LEFT JOIN {x}s {x}b ON {x}b.d = pr.b" for x in _K)}
  LEFT JOIN ali ON ali.a = pr.a AND ali.b = pr.b LEFT JOIN dn ON dn.disease_id = pr.a),
best AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, n_shared DESC, n_target_only DESC, d.name, competitor_id) AS rank
  FROM sc JOIN kg_disease d ON d.node_id = sc.competitor_id WHERE score > 0) WHERE rank <= {{k}})"""


def competitors(t, k):
    return c.rank_competitors(c.disease_profile(kept_unique(t)), diseases(t), k)


@query("rank_competitors", f"""
WITH {SQL_COMPET.format(k=3)} SELECT target_id, competitor_id, score, n_shared, n_target_only, rank FROM best""")
def rank_competitors(t):
    out = competitors(t, 3)
    return out.select("target_id", "competitor_id", "score", F.col("n_shared").cast("bigint").alias("n_shared"),
                      F.col("n_target_only").cast("bigint").alias("n_target_only"), "rank")


SQL_NEG = """pos AS (SELECT disease_id AS target_id, ekey, conflict FROM uniq WHERE grp = 'symptom'),
pool0 AS (SELECT disease_id, ekey, arg_min({'n': node_id, 'm': name, 'c': conflict}, (src, -priority, -spec100, name, node_id)) AS r, min((src, -priority, -spec100, name, node_id)) AS o
  FROM (SELECT *, 0 AS src FROM flg WHERE low_cost UNION ALL SELECT *, 1 FROM hv) GROUP BY 1, 2),
pool AS (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY o) AS pool_rank FROM pool0),
neg AS (SELECT p.target_id, p.competitor_id, x.ekey, x.r.n AS node_id, x.pool_rank FROM prs p JOIN pool x ON x.disease_id = p.competitor_id AND x.pool_rank <= 11
  JOIN kg_disease d ON d.node_id = p.target_id
  WHERE NOT EXISTS (SELECT 1 FROM uniq u WHERE u.disease_id = p.target_id AND u.ekey = x.ekey)
    AND NOT EXISTS (SELECT 1 FROM pos q WHERE q.target_id = p.target_id AND q.ekey = x.ekey)
    AND NOT EXISTS (SELECT 1 FROM pos q WHERE q.target_id = p.target_id AND q.conflict = x.r.c AND q.conflict <> '')
    AND NOT contains(lower(d.name), replace(x.r.m, ' ', '')))"""


def positives(t):
    return (t.__dict__.get("_unique") or unique(t)).where("grp = 'symptom'").select(F.col("disease_id").alias("target_id"), "ekey", "conflict")


@query("competitive_negatives", f"""
WITH {SQL_UNIQ},
prs AS (SELECT 'S' || x.s_suppkey AS target_id, 'S' || y.s_suppkey AS competitor_id FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1),
{SQL_NEG} SELECT target_id, competitor_id, ekey, node_id, pool_rank FROM neg""")
def competitive_negatives(t):
    return c.competitive_negatives(pairs(t), unique(t), positives(t), diseases(t)).select("target_id", "competitor_id", "ekey", "node_id", "pool_rank")


# -- selection and cases --------------------------------------------------------------------------------------------

REQ = (("S", 1, "viral_pathogen"), ("S", 1, "serology"), ("S", 2, "respiratory_symptom"), ("S", 3, "no_such_family"))


def catalog(t):
    """Required groups of every disease: its best families, plus one family no pool can cover."""
    counts = a.family_catalog(t.kg_pair, families(t))
    best = a.minimum_groups(counts, ["disease_id"], 4)
    out = best.select("disease_id", F.col("rank").alias("group_no"), "family")
    return out.unionByName(diseases(t).select("disease_id", F.lit(9).alias("group_no"), F.lit("no_such_family").alias("family")))


def tagged_items(t):
    f = families(t).select(F.col("evidence_id").alias("node_id"), "families")
    return unique(t).join(f, "node_id")


def required(t):
    avail = tagged_items(t).select("disease_id", F.explode("families").alias("family")).distinct()
    return c.required_groups(diseases(t), catalog(t), avail)


@query("catalog_join", f"""
WITH {SQL_UNIQ}, {SQL_EFAM},
cc AS (SELECT disease_id, family, count(*) AS n FROM kg_pair JOIN efam ON efam.node_id = evidence_id GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY {SQL_PRIO} DESC, n DESC, family) AS rank FROM cc WHERE family <> 'general_symptom')
SELECT o.disease_id, o.rank AS group_no, o.family AS families, 'catalog' AS source FROM o WHERE rank <= 4 AND EXISTS (SELECT 1 FROM uniq u JOIN efam USING (node_id) WHERE u.disease_id = o.disease_id AND efam.family = o.family)""")
def catalog_join(t):
    return required(t).select("disease_id", "group_no", F.concat_ws(",", "families").alias("families"), "source")


@query("scan_requirements", f"""
WITH {SQL_EFAM},
cc AS (SELECT disease_id, family, count(*) AS n FROM kg_pair JOIN efam ON efam.node_id = evidence_id GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY {SQL_PRIO} DESC, n DESC, family) AS rank FROM cc WHERE family <> 'general_symptom'),
r AS (SELECT d.s_nationkey AS name_key, o.disease_id, string_agg(family, '|' ORDER BY rank) AS required FROM o JOIN supplier d ON 'S' || d.s_suppkey = o.disease_id WHERE rank <= 4 GROUP BY 1, 2)
SELECT CAST(name_key AS VARCHAR) AS name_key, min(disease_id) AS disease_id, arg_min(required, disease_id) AS required FROM r GROUP BY 1""")
def scan_requirements(t):
    """One requirement entry per disease, written as JSON lines and read back; the nation serves as the name."""
    nation = t.raw("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("disease_id"), F.col("s_nationkey").cast("string").alias("disease_name"))
    cat = catalog(t).where("family <> 'no_such_family'").groupBy("disease_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "family"))).alias("g"))
    entry = F.struct("disease_id", "disease_name", F.transform("g", lambda x: F.array(x["family"])).alias("required_family_groups"))
    folder = scratch_folder(t.spark, "requirements")
    cat.join(nation, "disease_id").select(F.to_json(entry).alias("value")).write.text(folder)
    by_name = scan.scan_requirements(t.spark, folder)[1]
    return by_name.select("name_key", "disease_id", F.concat_ws("|", F.transform("required", lambda g: F.concat_ws("/", g))).alias("required"))


def cover_pool(t):
    """Items of a disease as the choice sees them: low-cost first, then the rest."""
    i = tagged_items(t).withColumns(c.cost_pool_flags())
    s = F.struct((-F.col("priority")).cast("double").alias("p"), (-F.col("spec100")).cast("double").alias("q"))
    concrete = F.when(c.concrete_result(F.col("name")), 0).otherwise(1)
    label = F.when(F.col("label").isin("LabFinding", "ImagingFinding", "Pathogen"), 0).otherwise(1)
    rel = F.when(F.col("rel").isin(*c.HIGH_VALUE_RELATIONS), 0).otherwise(1)
    return i.select(
        "disease_id", "ekey", "node_id", "name", "grp", "label", "mode", "rel", F.struct((~F.col("low_cost")).cast("int").alias("t"), s.alias("s"), F.col("name").alias("n")).alias("pref"),
        F.struct(concrete.alias("c"), label.alias("l"), rel.alias("r"), s.alias("s"), F.col("name").alias("n"), F.col("ekey").alias("k")).alias("cover_rank"),
        "families", "conflict", F.struct((-F.col("priority")).alias("p"), (-F.col("spec100")).alias("q"), (-F.length("name")).alias("l"), F.col("name").alias("n")).alias("strict"))


def chosen(t):
    return c.select_cover_items(cover_pool(t), required(t))


@query("select_cover_items")
def select_cover_items(t):
    return chosen(t).select("disease_id", "pick", "ekey", "conflict", F.concat_ws(",", "families").alias("families"))


def case_positives(t):
    i = cover_pool(t).select("disease_id", "ekey", "node_id", "name", "grp", "label", "mode", "rel")
    return chosen(t).join(i, ["disease_id", "ekey"]).withColumn("case_id", c.case_id(F.lit("ordinary"), F.col("disease_id"), F.lit("")))


@query("opening_items", f"""
WITH {SQL_UNIQ},
e AS (SELECT disease_id, ekey, CASE WHEN priority >= 13000 THEN 0 WHEN grp = 'symptom' THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY disease_id ORDER BY priority DESC, spec100 DESC, name, node_id) AS pick
  FROM uniq WHERE grp IN ('symptom','risk')),
h AS (SELECT disease_id, min(tier) = 0 AS has0 FROM e GROUP BY 1),
r AS (SELECT disease_id, ekey, row_number() OVER (PARTITION BY disease_id ORDER BY tier, pick) AS opening_rank FROM e JOIN h USING (disease_id) WHERE NOT has0 OR tier = 0)
SELECT disease_id AS case_id, ekey, opening_rank FROM r WHERE opening_rank <= 3""")
def opening_items(t):
    from pyspark.sql import Window

    w = Window.partitionBy("disease_id").orderBy(F.desc("priority"), F.desc("spec100"), "name", "node_id")  # at most 80 items
    p = unique(t).withColumn("pick", F.row_number().over(w)).withColumnRenamed("disease_id", "case_id")
    return c.opening_items(p, F.col("priority") >= 13000).select("case_id", "ekey", "opening_rank")


def best_competitor(t):
    best = competitors(t, 1)
    best = written(best, "competitors")
    neg = c.competitive_negatives(best.select("target_id", "competitor_id"), kept_unique(t), positives(t), diseases(t))
    n = neg.groupBy("target_id", "competitor_id").agg(F.count(F.lit(1)).alias("n_negative"))
    return best.select("target_id", "competitor_id", "n_shared", "n_target_only").join(n, ["target_id", "competitor_id"], "left")


SQL_BUILD = f"""{SQL_COMPET.format(k=1)},
prs AS (SELECT target_id, competitor_id FROM best),
{SQL_NEG},
prof AS (SELECT f.disease_id, count(*) AS n_all, {b_('low_cost')} AS n_low, {b_('exam')} AS n_exam, coalesce(any_value(h.n), 0) AS n_hv FROM flg f
  LEFT JOIN (SELECT disease_id, count(*) AS n FROM hv GROUP BY 1) h USING (disease_id) GROUP BY 1),
full_ AS (SELECT prof.*, b.competitor_id, coalesce(b.n_shared, 0) AS n_shared, coalesce(b.n_target_only, 0) AS n_to, coalesce(n.n, 0) AS n_neg FROM prof LEFT JOIN best b ON b.target_id = prof.disease_id
  LEFT JOIN (SELECT target_id, count(*) AS n FROM neg GROUP BY 1) n ON n.target_id = prof.disease_id),
skips AS (
  SELECT disease_id, competitor_id, 'ordinary' AS case_type, CASE WHEN n_all < 4 THEN 'insufficient_total_pool' WHEN n_low < 2 THEN 'insufficient_chief_complaint_friendly_pool' ELSE 'generated' END AS reason,
    CASE WHEN n_all < 4 THEN n_all WHEN n_low < 2 THEN n_low ELSE 0 END AS available, CASE WHEN n_all < 4 THEN 4 WHEN n_low < 2 THEN 2 ELSE 0 END AS required FROM full_
  UNION ALL SELECT disease_id, competitor_id, 'low_cost', CASE WHEN n_low < 18 THEN 'insufficient_low_cost_pool' ELSE 'generated' END, CASE WHEN n_low < 18 THEN n_low ELSE 0 END, CASE WHEN n_low < 18 THEN 18 ELSE 0 END FROM full_
  UNION ALL SELECT disease_id, competitor_id, 'exam_driven', CASE WHEN n_exam < 3 THEN 'insufficient_exam_pool' WHEN n_hv < 2 THEN 'insufficient_high_value_exam_pool' ELSE 'generated' END,
    CASE WHEN n_exam < 3 THEN n_exam WHEN n_hv < 2 THEN n_hv ELSE 0 END, CASE WHEN n_exam < 3 THEN 3 WHEN n_hv < 2 THEN 2 ELSE 0 END FROM full_
  UNION ALL SELECT disease_id, competitor_id, 'competitive', CASE WHEN competitor_id IS NULL THEN 'competitor_not_found' WHEN n_shared < 9 THEN 'insufficient_shared_pool' WHEN n_to < 2 THEN 'insufficient_target_only_pool'
    WHEN n_neg < 1 THEN 'insufficient_competitor_negative_pool' ELSE 'generated' END, CASE WHEN competitor_id IS NULL THEN 0 WHEN n_shared < 9 THEN n_shared WHEN n_to < 2 THEN n_to WHEN n_neg < 1 THEN n_neg ELSE 0 END,
    CASE WHEN competitor_id IS NULL THEN 1 WHEN n_shared < 9 THEN 9 WHEN n_to < 2 THEN 2 WHEN n_neg < 1 THEN 1 ELSE 0 END FROM full_)"""
# Pool minimums that some of the given diseases miss.
MINIMUM = {**c.POOL_MINIMUM, "low_cost": 18, "shared": 9}


def skips(t):
    return c.case_skips(c.disease_profile(kept_unique(t)), best_competitor(t), MINIMUM)


@query("build_cases", f"""
WITH {SQL_BUILD}
SELECT disease_id, case_type, reason, available, required, CASE WHEN reason <> 'generated' THEN '' WHEN case_type = 'competitive' THEN 'kg_competitive_' || disease_id || '_vs_' || competitor_id || '_001'
  ELSE 'kg_' || case_type || '_' || disease_id || '_001' END AS case_id FROM skips""")
def build_cases(t):
    s = skips(t)
    cid = F.when(F.col("reason") == "generated", c.case_id(F.col("case_type"), F.col("disease_id"), F.col("competitor_id"))).otherwise("")
    return s.select("disease_id", "case_type", "reason", "available", "required", cid.alias("case_id"))


def qc_inputs(t):
    """Cases made of all items of every disease, with their QC facts."""
    pos = tagged_items(t).withColumn("case_id", F.col("disease_id"))
    has = lambda names: F.arrays_overlap("families", F.array(*[F.lit(n) for n in names]))
    role = c.evidence_role(F.col("grp"), F.col("rel"), F.col("families"), F.startswith("name", F.lit("old")), F.lit(False))
    conn = a.evidence_connectivity(items(t)).select("node_id", "high")
    p = pos.join(conn, "node_id").withColumn("role", role)
    spec = F.col("role") == "disease_specific_anchor"
    p = p.withColumns({
        "high_connectivity": F.col("high") | (F.col("role") == "background_context"), "core_infection": spec & F.col("grp").isin(*a.EXAM_GROUPS),
        "core_metabolic": has(["metabolic_definition"]) & F.col("grp").isin("lab", "detail", "risk"),
        "core_tumor": (F.col("grp") == "imaging") & has(c.TUMOR_FAMILIES), "core_neuro": has(c.NEURO_FAMILIES)})
    opening = p.where("grp = 'symptom' OR grp = 'risk'")
    fam = p.groupBy("case_id").agg(F.max(has(c.INFECTION_FAMILIES)).alias("is_infection"), F.max(has(["metabolic_definition"])).alias("is_metabolic"),
                                   F.max(has(c.NEURO_FAMILIES)).alias("is_neuro"),
                                   (F.max(F.when(has(["serology"]), 1).otherwise(0)) == 0).alias("_no_serology"))
    tumor = t.kg_disease.select(F.col("node_id").alias("case_id"), F.contains("name", F.lit("7")).alias("is_tumor"))
    cov = tumor.join(fam, "case_id", "left").select("case_id", "is_infection", "is_metabolic", "is_tumor", "is_neuro",
                                                   F.coalesce("_no_serology", F.lit(True)).cast("int").alias("missing_groups"), F.lit(False).alias("generic_only"))
    return diseases(t).select(F.col("disease_id").alias("case_id")), p, opening, cov


SQL_QC = f"""{SQL_UNIQ}, {SQL_EFAM},
cn AS (SELECT node_id, count(DISTINCT disease_id) >= (SELECT greatest(3, CAST(ceil(count(DISTINCT disease_id) * 0.08::DOUBLE) AS BIGINT)) FROM item) AS high FROM item GROUP BY 1),
fl AS (SELECT node_id, list(family) AS fams FROM efam GROUP BY 1),
qp0 AS (SELECT u.*, fams, high, CASE
   WHEN u.name LIKE 'old%' OR len(list_filter(fams, lambda x: x NOT IN ('immune_status','underlying_infection','art_or_reconstitution','exposure_risk','medication_risk','comorbidity_risk','population_risk','general_risk','general_detail','general_symptom','constitutional_symptom'))) = 0 THEN 'background_context'
   WHEN list_has_any(fams, ['metabolic_definition','pathology']) THEN 'definition_anchor' WHEN grp = 'pathogen' THEN 'disease_specific_anchor'
   WHEN grp IN ('lab','imaging') AND list_has_any(fams, ['disease_specific_lab','serology','oxygenation','imaging','cns_imaging']) THEN 'disease_specific_anchor'
   WHEN grp = 'symptom' THEN 'phenotype_support' WHEN grp IN ('risk','detail') THEN 'risk_or_context' ELSE 'supporting_context' END AS role
  FROM uniq u JOIN fl USING (node_id) JOIN cn USING (node_id)),
qp AS (SELECT disease_id AS case_id, count(*) AS n, max(role IN ('disease_specific_anchor','definition_anchor')) AS anchor, min(high OR role = 'background_context') AS conn,
   max(role = 'disease_specific_anchor' AND grp IN ('lab','imaging','pathogen')) AS ci, max(list_contains(fams, 'metabolic_definition') AND grp IN ('lab','detail','risk')) AS cm,
   max(grp = 'imaging') AS ct, max(list_has_any(fams, ['neurologic_symptom','cns_imaging','cns_lab'])) AS cne,
   max(list_has_any(fams, ['pathogen','viral_pathogen','disease_specific_lab','serology','cns_imaging'])) AS ii, max(list_contains(fams, 'metabolic_definition')) AS im, max(list_contains(fams, 'serology')) AS ser
   FROM qp0 GROUP BY 1),
qo AS (SELECT disease_id AS case_id, min(role = 'background_context') AS bg FROM qp0 WHERE grp IN ('symptom','risk') GROUP BY 1),
qq AS (SELECT d.node_id AS case_id, coalesce(n, 0) = 0 AS r1, NOT coalesce(anchor, false) AS r2, contains(d.name, '7') AS tu,
   (coalesce(ii, false) AND NOT coalesce(ci, false)) OR (coalesce(im, false) AND NOT coalesce(cm, false)) OR (contains(d.name, '7') AND NOT coalesce(ct, false)) OR (coalesce(cne, false) AND NOT coalesce(cne, false))
     OR (NOT (coalesce(ii, false) OR coalesce(im, false) OR contains(d.name, '7') OR coalesce(cne, false)) AND NOT coalesce(anchor, false)) AS r3,
   NOT coalesce(ser, false) AS r4, coalesce(bg, false) AS r6, coalesce(conn, false) AS r7 FROM kg_disease d LEFT JOIN qp ON qp.case_id = d.node_id LEFT JOIN qo ON qo.case_id = d.node_id),
qc AS (SELECT case_id, greatest(100 - (r1::INT * 80 + r2::INT * 40 + r3::INT * 35 + r4::INT * 20 + r6::INT * 15 + r7::INT * 25), 0) AS case_qc_score,
  concat_ws(',', CASE WHEN r1 THEN 'no_positive_slots' END, CASE WHEN r2 THEN 'missing_disease_specific_or_definition_anchor' END, CASE WHEN r3 THEN 'missing_primary_diagnostic_path_core_evidence' END,
   CASE WHEN r4 THEN 'missing_required_family_coverage' END, CASE WHEN r6 THEN 'opening_background_only' END, CASE WHEN r7 THEN 'all_positive_slots_high_connectivity_or_background' END) AS case_qc_reasons,
  CASE WHEN r1 OR r2 OR r3 OR r4 OR r7 THEN 'not_benchmark_eligible' WHEN r6 THEN 'weak_anchor' ELSE 'eligible' END AS case_qc_status FROM qq)"""


@query("case_qc", f"WITH {SQL_QC} SELECT * FROM qc")
def case_qc(t):
    return c.case_qc(*qc_inputs(t))


@query("background_role", f"WITH {SQL_QC} SELECT grp, role, count(*) AS n, CAST(sum(high::INT) AS BIGINT) AS n_high FROM qp0 GROUP BY 1, 2")
def background_role(t):
    p = qc_inputs(t)[1]
    return p.groupBy("grp", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("high").cast("int")).alias("n_high"))


SQL_KIND = "CASE WHEN contains(d.name, '1') THEN 'ordinary' WHEN contains(d.name, '2') THEN 'low_cost' ELSE 'exam_driven' END"


@query("generation_manifest", f"""
WITH {SQL_QC},
cs AS (SELECT qc.*, {SQL_KIND} AS case_type FROM qc JOIN kg_disease d ON d.node_id = qc.case_id)
SELECT 'generated_case_count_by_type' AS metric, case_type AS key, count(*) AS value FROM cs GROUP BY 2
UNION ALL SELECT 'case_qc_count_by_status', case_qc_status, count(*) FROM cs GROUP BY 2
UNION ALL SELECT 'case_qc_reason_counts', r, count(*) FROM (SELECT unnest(string_split(case_qc_reasons, ',')) AS r FROM cs) WHERE r <> '' GROUP BY 2
UNION ALL SELECT 'benchmark_eligible_count_by_type', case_type, count(*) FROM cs WHERE case_qc_status = 'eligible' GROUP BY 2
UNION ALL SELECT 'skipped_case_count_by_reason', 'insufficient_low_cost_pool', count(*) FROM (SELECT disease_id FROM flg GROUP BY 1 HAVING {b_('low_cost')} < 18) HAVING count(*) > 0""")
def generation_manifest(t):
    kind = F.when(F.contains("disease_name", F.lit("1")), "ordinary").when(F.contains("disease_name", F.lit("2")), "low_cost").otherwise("exam_driven")
    qc = c.case_qc(*qc_inputs(t)).join(diseases(t).select(F.col("disease_id").alias("case_id"), kind.alias("case_type")), "case_id")
    short = c.disease_profile(unique(t)).where("n_low_cost < 18").select(F.lit("insufficient_low_cost_pool").alias("reason"))
    return c.generation_manifest(qc, short)


@query("case_outputs", f"""
WITH {SQL_UNIQ}
SELECT 'kg_ordinary_' || disease_id || '_001' AS case_id, node_id AS slot_id, CASE WHEN priority >= 10000 THEN 'true' ELSE 'false' END AS value, grp, label, name AS alias FROM uniq""")
def case_outputs(t):
    i = unique(t).withColumn("case_id", c.case_id(F.lit("ordinary"), F.col("disease_id"), F.lit("")))
    return c.slot_rows(i.where("priority >= 10000"), True).unionByName(c.slot_rows(i.where("priority < 10000"), False))


@query("required_family_rules", """
WITH x AS (SELECT DISTINCT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '肺孢子菌肺炎' WHEN 'STANDARD' THEN 'TB-IRIS' WHEN 'PROMO' THEN '隐球菌脑膜炎' WHEN 'LARGE' THEN '肥胖 症' WHEN 'MEDIUM' THEN 'PCP 脑炎' ELSE p_name END AS disease_name FROM part),
r AS (SELECT * FROM (VALUES ('肺孢子菌肺炎', 0, 'respiratory_symptom'), ('肺孢子菌肺炎', 1, 'immune_status'), ('肺孢子菌肺炎', 2, 'imaging'), ('肺孢子菌肺炎', 3, 'oxygenation'), ('肺孢子菌肺炎', 4, 'fungal_marker,pathogen'),
  ('PCP 脑炎', 0, 'respiratory_symptom'), ('PCP 脑炎', 1, 'immune_status'), ('PCP 脑炎', 2, 'imaging'), ('PCP 脑炎', 3, 'oxygenation'), ('PCP 脑炎', 4, 'fungal_marker,pathogen'),
  ('TB-IRIS', 0, 'underlying_infection,immune_status'), ('TB-IRIS', 1, 'art_or_reconstitution'), ('TB-IRIS', 2, 'worsening'), ('TB-IRIS', 3, 'imaging,disease_specific_lab,pathogen'),
  ('隐球菌脑膜炎', 0, 'neurologic_symptom'), ('隐球菌脑膜炎', 1, 'pathogen,disease_specific_lab'), ('隐球菌脑膜炎', 2, 'imaging,cns_lab'), ('肥胖 症', 0, 'metabolic_definition')) v(disease_name, group_no, families))
SELECT 'P' || p_partkey AS disease_id, group_no, families FROM x JOIN r USING (disease_name)""")
def required_family_rules(t):
    name = (F.when(F.col("p_type") == "ECONOMY", "肺孢子菌肺炎").when(F.col("p_type") == "STANDARD", "TB-IRIS").when(F.col("p_type") == "PROMO", "隐球菌脑膜炎")
            .when(F.col("p_type") == "LARGE", "肥胖 症").when(F.col("p_type") == "MEDIUM", "PCP 脑炎").otherwise(F.col("p_name")))
    d = t.raw("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("disease_id"), name.alias("disease_name"))
    none = t.spark.createDataFrame([], "disease_id string, group_no int, family string")
    return c.required_groups(d, none, none.select("disease_id", "family")).select("disease_id", "group_no", F.concat_ws(",", "families").alias("families"))


@query("stratified_sample", """
SELECT case_type, least(count(*), 50) AS n, true AS inside FROM replay GROUP BY 1""")
def stratified_sample(t):
    s = c.stratified_sample(t.replay.select("case_id", "case_type"), "case_id", "case_type", 50)
    known = s.join(t.replay.select("case_id"), "case_id", "left").groupBy("case_type").agg(F.count_distinct("case_id").alias("n"), (F.count("case_id") == F.count(F.lit(1))).alias("inside"))
    return known
