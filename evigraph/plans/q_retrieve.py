"""Queries that answer sessions: candidates, evidence, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import RELATION_SPECIFICITY
from ..operators import retrieve as r
from ..sources.sinks import written
from .registry import query

# Marker words that occur in the given part and supplier names.
BACKGROUND = ("gear",)
MARKERS = ("rod",)
FAMILY = "1"
SIBLINGS = (("11", ("gear",)), ("22", ("bolt",)), ("33", ("anvil",)), ("44", ("widget",)),
            ("55", ("gizmo",)), ("66", ("plate",)), ("77", ("ring",)), ("88", ("rod",)))

SQL_SPEC = "CASE rel " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RELATION_SPECIFICITY.items()) + " ELSE 25 END"
SQL_CONTRA = ("CASE WHEN rel IN ('HAS_LAB_FINDING','HAS_IMAGING_FINDING','HAS_PATHOGEN','DIAGNOSED_BY') THEN 100 "
              "WHEN rel = 'MANIFESTS_AS' THEN 85 WHEN rel = 'REQUIRES_DETAIL' THEN 55 ELSE 45 END")
SQL_ANCHOR = """CASE WHEN e.label = 'Pathogen' OR k.rel IN ('HAS_PATHOGEN','DIAGNOSED_BY') THEN
    CASE WHEN contains(e.name, 'rod') THEN CASE WHEN contains(d.name, '1') THEN 95 ELSE 35 END
         WHEN contains(e.name, 'gear') THEN CASE WHEN contains(d.name, '1') THEN 82 ELSE 25 END ELSE 88 END
  WHEN e.label = 'ImagingFinding' THEN 72
  WHEN e.label IN ('LabFinding','LabTest') THEN
    CASE WHEN contains(e.name, 'rod') THEN CASE WHEN contains(d.name, '1') THEN 82 ELSE 30 END
         WHEN contains(e.name, 'gear') THEN CASE WHEN contains(d.name, '1') THEN 72 ELSE 28 END ELSE 55 END
  WHEN k.rel = 'REQUIRES_DETAIL' THEN 48
  WHEN contains(e.name, 'gear') AND NOT contains(d.name, '1') THEN 30 ELSE 45 END"""
SQL_LA = f"""la AS (
  SELECT k.candidate_id, k.feature_id, k.rel, k.dir100, d.name AS candidate_name, d.w100 / 100 AS weight, {SQL_ANCHOR} AS anchor100
  FROM kg_link k JOIN kg_evidence e ON e.node_id = k.feature_id JOIN kg_disease d ON d.node_id = k.candidate_id)"""
SQL_SCORE = """greatest(least(matched_feature_count / feature_total, 1) * 0.34 + least(relation_count / feature_total, 1) * 0.18
  + spec100 / n_types / 100 * 0.16 + 1.0 * 0.14 + dirs / relation_count / 100 * 0.10 + least(weight, 1) * 0.04
  + {link} * 0.04 + anchor100 / 100 * 0.35
  - CASE WHEN feature_total <= 1 OR matched_feature_count > 1 THEN 0.0 WHEN weak = n_types THEN 0.24 ELSE 0.18 END, 0.0)"""


def sql_pool(prefix: str, feats: str, limit: int, by_features: bool, link: str) -> str:
    order = ("matched_feature_count DESC, " if by_features else "") + "relation_count DESC, weight DESC, candidate_name, candidate_id"
    return f"""
{prefix}m AS (SELECT f.session_id, la.* FROM {feats} f JOIN la ON la.feature_id = f.feature_id),
{prefix}a AS (SELECT session_id, candidate_id, candidate_name, weight, count(*) AS relation_count,
   count(DISTINCT feature_id) AS matched_feature_count, sum(dir100) AS dirs, max(anchor100) AS anchor100 FROM {prefix}m GROUP BY 1, 2, 3, 4),
{prefix}t AS (SELECT session_id, candidate_id, sum({SQL_SPEC}) AS spec100, count(*) AS n_types,
   sum((rel IN ('APPLIES_TO','COMPLICATED_BY','RISK_FACTOR_FOR'))::INT) AS weak FROM (SELECT DISTINCT session_id, candidate_id, rel FROM {prefix}m) GROUP BY 1, 2),
{prefix}n AS (SELECT session_id, count(*) AS feature_total FROM {feats} GROUP BY 1),
{prefix}r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS pool_rank FROM {prefix}a),
{prefix}s AS (SELECT r.*, t.spec100, t.n_types, n.feature_total, {SQL_SCORE.format(link=link)} AS score FROM {prefix}r r
   JOIN {prefix}t t USING (session_id, candidate_id) JOIN {prefix}n n USING (session_id) WHERE pool_rank <= {limit})"""


SQL_FEATS = "feats AS (SELECT DISTINCT session_id, node_id AS feature_id FROM obs WHERE polarity = 'present')"
SQL_R1 = f"{SQL_FEATS},\n{SQL_LA},{sql_pool('p', 'feats', 10, False, '0.0')},\nr1 AS (SELECT * FROM ps WHERE score >= 0.48)"
SQL_OBSIDS = """oid AS (SELECT session_id, feature_id FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, p, s, feature_id) AS rn FROM (
   SELECT session_id, node_id AS feature_id, arg_min(turn, (turn, pk, sk)) AS t, arg_min(pk, (turn, pk, sk)) AS p, arg_min(sk, (turn, pk, sk)) AS s
   FROM obs JOIN part ON p_partkey = pk WHERE polarity = 'present' AND NOT contains(p_name, 'gear') GROUP BY 1, 2)) WHERE rn <= 16)"""
SQL_RESCUE = f"""{SQL_OBSIDS},{sql_pool('q', 'oid', 8, True, '1.0')},
rescue AS (SELECT *, least(score + 0.16, 1.4) AS final FROM qs WHERE score >= 0.32)"""
SQL_SIB = """kw AS (SELECT * FROM (VALUES (0,'11','gear'),(1,'22','bolt'),(2,'33','anvil'),(3,'44','widget'),(4,'55','gizmo'),(5,'66','plate'),(6,'77','ring'),(7,'88','rod')) v(i, k, word)),
sk AS (SELECT DISTINCT session_id, kw.k FROM obs JOIN part ON p_partkey = pk JOIN kw ON contains(p_name, kw.word)
       WHERE polarity = 'present' AND resolution IN ('clear','hedged')),
outl AS (SELECT src AS candidate_id, count(*) AS relation_count FROM kg_edge WHERE src_label = 'Disease' GROUP BY 1),
sm AS (SELECT sk.session_id, d.node_id AS candidate_id, d.name AS candidate_name, d.w100 / 100 AS weight, count(*) AS matched_keywords
       FROM sk JOIN kg_disease d ON contains(d.name, sk.k) GROUP BY 1, 2, 3, 4),
sr AS (SELECT sm.*, coalesce(relation_count, 0) AS relation_count, row_number() OVER (PARTITION BY session_id
       ORDER BY matched_keywords DESC, weight DESC, coalesce(relation_count, 0) DESC, candidate_name, candidate_id) AS rank
       FROM sm LEFT JOIN outl USING (candidate_id)),
sib AS (SELECT *, least(0.42 + matched_keywords * 0.08::DOUBLE + least(relation_count, 6) * 0.025::DOUBLE + weight * 0.1, 1.05) AS score FROM sr WHERE rank <= 12)"""


def links(t):
    return t.__dict__.get("_links") or r.direction_union(t.kg_edge)


def anchored(t):
    ev = t.kg_evidence.select(F.col("node_id").alias("feature_id"), "label", F.col("name").alias("evidence_name"))
    k = links(t).join(ev, "feature_id").join(candidates(t).select("candidate_id", "candidate_name"), "candidate_id")
    score = r.anchor_score(F.col("candidate_name"), F.col("evidence_name"), F.col("label"), F.col("rel"), BACKGROUND, MARKERS, FAMILY)
    return k.withColumn("anchor100", score).drop("candidate_name")


def candidates(t):
    return t.kg_disease.select(F.col("node_id").alias("candidate_id"), F.col("name").alias("candidate_name"),
                               F.col("label").alias("candidate_label"), (F.col("w100") / 100).alias("weight"))


def once(t, name, make):
    """A frame that a query needs several times, written when it is first asked for."""
    if name not in t.__dict__:
        t.__dict__[name] = written(make(), name.strip("_"))
    return t.__dict__[name]


def summary(t):
    return t.__dict__.get("_summary") or r.link_summary(anchored(t), candidates(t))


def features(t):
    return r.feature_union(t.obs.where("polarity = 'present'").withColumnRenamed("node_id", "feature_id"))


def r1(t):
    return r.r1_candidates(features(t), summary(t))


def rescue(t):
    names = t.kg_evidence.select("node_id", "name")
    o = t.obs.join(names, "node_id")
    ids = r.observed_ids(o, ["turn", "pk", "sk"], background=F.contains("name", F.lit("gear")))
    return r.r1_rescue(ids, summary(t))


def siblings(t):
    o = t.obs.where("polarity = 'present' AND resolution IN ('clear','hedged')").join(t.kg_evidence.select("node_id", "name"), "node_id")
    out = t.kg_edge.where("src_label = 'Disease'").withColumnRenamed("src", "candidate_id")
    return r.scope_siblings(o, out, candidates(t), SIBLINGS)


POOL = ["session_id", "candidate_id", "pool_rank", "relation_count", "matched_feature_count", "score"]


@query("direction_union", "SELECT candidate_id, feature_id, rel, dir100, w100 FROM kg_link")
def direction_union(t):
    return links(t)


@query("feature_union", """
SELECT session_id, count(*) AS n_features, min(feature_id) AS first_feature FROM (
  SELECT DISTINCT session_id, node_id AS feature_id FROM obs WHERE polarity = 'present'
  UNION SELECT session_id, node_id FROM obs WHERE polarity = 'unclear' AND resolution = 'hedged') GROUP BY 1""")
def feature_union(t):
    a = t.obs.where("polarity = 'present'").withColumnRenamed("node_id", "feature_id")
    b = t.obs.where("polarity = 'unclear' AND resolution = 'hedged'").withColumnRenamed("node_id", "feature_id")
    return r.feature_union(a, b).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_features"), F.min("feature_id").alias("first_feature"))


@query("bidirectional_match", f"""
WITH {SQL_FEATS}
SELECT f.session_id, k.rel, k.dir100, count(*) AS n, count(DISTINCT k.candidate_id) AS n_candidates
FROM feats f JOIN kg_link k ON k.feature_id = f.feature_id GROUP BY 1, 2, 3""")
def bidirectional_match(t):
    m = r.bidirectional_match(features(t), links(t).select("candidate_id", "feature_id", "rel", "dir100"))
    per = m.groupBy("session_id", "rel", "dir100", "candidate_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("session_id", "rel", "dir100").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_candidates"))


@query("anchor_score_col", f"""
WITH {SQL_LA} SELECT candidate_id, rel, anchor100, count(*) AS n FROM la GROUP BY 1, 2, 3""")
def anchor_score_col(t):
    return anchored(t).groupBy("candidate_id", "rel", "anchor100").agg(F.count(F.lit(1)).alias("n"))


@query("r1_candidates", f"WITH {SQL_R1} SELECT {', '.join(POOL)} FROM r1")
def r1_candidates(t):
    return r1(t).select(*POOL)


@query("r1_rescue", f"WITH {SQL_LA},{SQL_RESCUE} SELECT session_id, candidate_id, pool_rank, relation_count, matched_feature_count, final AS score FROM rescue")
def r1_rescue(t):
    return rescue(t).select(*POOL)


@query("scope_siblings", f"WITH {SQL_SIB} SELECT session_id, candidate_id, matched_keywords, relation_count, rank, score FROM sib")
def scope_siblings(t):
    return siblings(t).select("session_id", "candidate_id", "matched_keywords", "relation_count", "rank", "score")


SQL_POOLS = f"""{SQL_R1},
{SQL_RESCUE},
{SQL_SIB},
pools AS (SELECT session_id, candidate_id, candidate_name, max(score) AS score FROM (
  SELECT session_id, candidate_id, candidate_name, score FROM r1 UNION ALL SELECT session_id, candidate_id, candidate_name, final FROM rescue
  UNION ALL SELECT session_id, candidate_id, candidate_name, score FROM sib) GROUP BY 1, 2, 3)"""


def pools(t):
    once(t, "_summary", lambda: summary(t))
    return r.merge_pools(r1(t), rescue(t), siblings(t))


@query("merge_candidate_pools", f"WITH {SQL_POOLS} SELECT session_id, candidate_id, score FROM pools")
def merge_candidate_pools(t):
    return pools(t).select("session_id", "candidate_id", "score")


@query("candidate_topk", f"""
WITH {SQL_POOLS}
SELECT session_id, candidate_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY score DESC, candidate_name, candidate_id) AS rank FROM pools) WHERE rank <= 3""")
def candidate_topk(t):
    return r.candidate_topk(pools(t), 3).select("session_id", "candidate_id", "score", "rank")


SQL_COMP = f"""{SQL_R1},
cev AS (SELECT DISTINCT r1.session_id, r1.candidate_id, f.feature_id AS evidence FROM r1 JOIN feats f USING (session_id)
   JOIN kg_link k ON k.candidate_id = r1.candidate_id AND k.feature_id = f.feature_id),
cfr AS (SELECT session_id, evidence, count(*) AS n FROM cev GROUP BY 1, 2),
csh AS (SELECT session_id, candidate_id, count(*) AS n_evidence, CAST(sum((n = 1)::INT) AS BIGINT) AS uniq FROM cev JOIN cfr USING (session_id, evidence) GROUP BY 1, 2),
comp AS (SELECT r1.session_id, r1.candidate_id, r1.candidate_name, uniq AS unique_evidence_count, (n_evidence - uniq) / n_evidence AS overlap_ratio,
   r1.score + (uniq * 0.18::DOUBLE + least(matched_feature_count / feature_total, 1) * 0.20 + r1.score * 0.22 + anchor100 / 100 * 0.35
     - (n_evidence - uniq) / n_evidence * 0.10) AS competition_score FROM r1 JOIN csh USING (session_id, candidate_id)),
compr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY competition_score DESC, candidate_name, candidate_id) AS rank FROM comp)"""


def competition(t):
    pool = r.r1_candidates(features(t), summary(t), evidence=True).select(
        "session_id", "candidate_id", "candidate_name", "score", "evidence",
        F.least(F.col("matched_feature_count") / F.col("feature_total"), F.lit(1.0)).alias("coverage"),
        F.col("score").alias("semantic"), "anchor100")
    return r.competition_rerank(pool)


@query("competition_rerank", f"""
WITH {SQL_COMP} SELECT session_id, candidate_id, unique_evidence_count, overlap_ratio, competition_score, rank FROM compr""")
def competition_rerank(t):
    return competition(t).select("session_id", "candidate_id", "unique_evidence_count", "overlap_ratio", "competition_score", "rank")


SQL_EV = f"""ev AS (SELECT k.candidate_id, k.feature_id AS node_id, n.label, n.name, k.rel, k.w100 AS rel_w100, n.w100 AS node_w100, n.mode, n.cost, k.dir100,
  (n.w100 + k.w100) * k.dir100 AS priority, {SQL_CONTRA.replace('rel ', 'k.rel ')} AS contradiction, n.grp AS hint, n.label IN ('ClinicalFinding','LabFinding','ImagingFinding') AS red_flag
  FROM kg_link k JOIN kg_evidence n ON n.node_id = k.feature_id)"""
SQL_SEEN = "seen AS (SELECT DISTINCT session_id, node_id FROM obs)"
SQL_R2 = f"""{SQL_EV},
{SQL_SEEN},
r2 AS (SELECT * FROM (SELECT p.session_id, ev.*, row_number() OVER (PARTITION BY p.session_id, p.candidate_id
    ORDER BY priority DESC, contradiction DESC, ev.name, ev.node_id, rel) AS rank
  FROM {{pool}} p JOIN ev ON ev.candidate_id = p.candidate_id
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.session_id = p.session_id AND s.node_id = ev.node_id)) WHERE rank <= 10)"""


def evidence(t):
    return r.evidence_rows(links(t), t.kg_node)


def seen(t):
    return t.obs.select("session_id", "node_id").distinct()


def top3(t):
    """The pool of the queries that look at links again after it."""
    if "_top3" not in t.__dict__:
        once(t, "_links", lambda: links(t))
    return once(t, "_top3", lambda: r.candidate_topk(r1(t), 3))


SQL_TOP3 = f"""{SQL_R1},
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, candidate_name, candidate_id) AS rank FROM r1) WHERE rank <= 3)"""


@query("r2_evidence", f"""
WITH {SQL_TOP3},
{SQL_R2.format(pool='top3')}
SELECT session_id, candidate_id, node_id, rel, priority, contradiction, rank, mode, cost FROM r2""")
def r2_evidence(t):
    out = r.r2_evidence(top3(t), evidence(t), seen(t))
    return out.select("session_id", "candidate_id", "node_id", "rel", "priority", "contradiction", "rank", "mode", "cost")


@query("not_in_filter", """
SELECT session_id, count(*) AS n, min(node_id) AS first_node FROM (SELECT DISTINCT session_id, node_id FROM obs) o
WHERE NOT EXISTS (SELECT 1 FROM obs a WHERE a.session_id = o.session_id AND a.node_id = o.node_id AND a.turn <= 2)
  AND NOT EXISTS (SELECT 1 FROM obs a WHERE a.session_id = o.session_id AND a.node_id = o.node_id AND a.polarity = 'absent') GROUP BY 1""")
def not_in_filter(t):
    out = r.not_in_filter(seen(t), t.obs.where("turn <= 2"), t.obs.where("polarity = 'absent'"))
    return out.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_node"))


SQL_PSCORE = "priority / 10000 + contradiction / 100 * 0.45 + rel_w100 / 100 * 0.2 + node_w100 / 100 * 0.1"


@query("dedupe_best_row", f"""
WITH {SQL_EV},
dup AS (SELECT * FROM ev UNION ALL SELECT candidate_id, node_id, label, name, 'DIAGNOSED_BY', node_w100, node_w100, mode, cost, dir100, priority, 100, hint, red_flag
  FROM ev WHERE hint = 'symptom')
SELECT candidate_id, node_id, rel, sort_score FROM (SELECT *, {SQL_PSCORE} AS sort_score,
  row_number() OVER (PARTITION BY candidate_id, node_id ORDER BY {SQL_PSCORE} DESC, rel DESC) AS rn FROM dup) WHERE rn = 1""")
def dedupe_best_row(t):
    ev = evidence(t)
    more = ev.where("hint = 'symptom'").withColumns({
        "rel": F.lit("DIAGNOSED_BY"), "rel_w100": F.col("node_w100"), "contradiction": F.lit(100)})
    return r.dedupe_best_row(ev.unionByName(more)).select("candidate_id", "node_id", "rel", "sort_score")


SQL_PROFILE = f"""{SQL_EV},
pr0 AS (SELECT *, {SQL_PSCORE} AS sort_score FROM ev),
pr1 AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sort_score DESC, name, node_id) AS pre_rank FROM pr0),
pr2 AS (SELECT *, hint AS grp, row_number() OVER (PARTITION BY candidate_id, hint ORDER BY sort_score DESC, name, node_id) AS group_rank FROM pr1 WHERE pre_rank <= 12),
profile AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sort_score DESC, name, node_id) AS profile_rank FROM pr2 WHERE group_rank <= 4)"""


@query("per_group_cap", f"""
WITH {SQL_EV},
c1 AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, hint ORDER BY priority DESC, name, node_id) AS group_rank FROM ev),
c2 AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY priority DESC, name, node_id) AS profile_rank FROM c1 WHERE group_rank <= 4)
SELECT candidate_id, node_id, hint, group_rank, profile_rank FROM c2 WHERE profile_rank <= 12""")
def per_group_cap(t):
    order = [F.desc("priority"), F.col("name"), F.col("node_id")]
    out = r.per_group_cap(evidence(t), ["candidate_id"], "hint", order, 4, 12)
    return out.select("candidate_id", "node_id", "hint", "group_rank", "profile_rank")


def states(t):
    """Last clear observation of a node is its evidence state; the last observation of any kind its slot."""
    clear = t.obs.where("resolution = 'clear'")
    return clear.groupBy("session_id", "node_id").agg(F.max_by("polarity", F.struct("turn", "pk", "sk")).alias("polarity"))


def slots(t):
    o = t.obs.join(t.kg_evidence.select("node_id", "name"), "node_id").repartition("session_id").groupBy("session_id", "node_id", "name").agg(
        F.max_by("polarity", F.struct("turn", "pk", "sk")).alias("polarity"), F.max(F.struct("turn", "pk", "sk")).alias("_o"))
    keys = o.select("session_id", "_o", "polarity", F.explode(F.array("node_id", "name")).alias("slot_key"))
    return keys.groupBy("session_id", "slot_key").agg(F.min_by("polarity", "_o").alias("polarity"))


SQL_STATES = """st AS (SELECT session_id, node_id, arg_max(polarity, (turn, pk, sk)) AS polarity FROM obs WHERE resolution = 'clear' GROUP BY 1, 2),
sl0 AS (SELECT session_id, node_id, arg_max(polarity, (turn, pk, sk)) AS polarity, max((turn, pk, sk)) AS o FROM obs GROUP BY 1, 2),
sl AS (SELECT session_id, k AS slot_key, arg_min(polarity, o) AS polarity FROM (
   SELECT session_id, node_id AS k, polarity, o FROM sl0 UNION ALL SELECT session_id, name, polarity, o FROM sl0 JOIN kg_evidence USING (node_id)) GROUP BY 1, 2)"""
SQL_STATUS = f"""{SQL_STATES},
status AS (SELECT p.session_id, p.candidate_id, p.node_id, p.name, p.grp, p.profile_rank, coalesce(st.polarity, a.polarity, b.polarity, 'unclear') AS polarity,
  CASE coalesce(st.polarity, a.polarity, b.polarity) WHEN 'present' THEN 'matched' WHEN 'absent' THEN 'negative' ELSE 'unknown' END AS status,
  CASE WHEN st.polarity IS NOT NULL THEN 'state' WHEN a.polarity IS NOT NULL OR b.polarity IS NOT NULL THEN 'slot' ELSE 'none' END AS status_source
  FROM sprof p LEFT JOIN st ON st.session_id = p.session_id AND st.node_id = p.node_id
  LEFT JOIN sl a ON a.session_id = p.session_id AND a.slot_key = p.node_id LEFT JOIN sl b ON b.session_id = p.session_id AND b.slot_key = p.name)"""
SQL_SPROF = f"""{SQL_TOP3},
{SQL_PROFILE},
sprof AS (SELECT top3.session_id, profile.* FROM top3 JOIN profile ON profile.candidate_id = top3.candidate_id AND profile_rank <= 12)"""


def session_profile(t):
    prof = r.evidence_profile(evidence(t)).select("candidate_id", "node_id", "name", "grp", "profile_rank")
    joined = top3(t).select("session_id", "candidate_id").join(prof, "candidate_id")
    return r.evidence_status(joined, states(t), slots(t))


@query("evidence_profile", f"""
WITH {SQL_SPROF},
{SQL_STATUS} SELECT session_id, candidate_id, node_id, grp, profile_rank, status FROM status""")
def evidence_profile(t):
    return session_profile(t).select("session_id", "candidate_id", "node_id", "grp", "profile_rank", "status")


@query("evidence_status_join", f"""
WITH {SQL_EV}, {SQL_SEEN}, sprof AS (SELECT seen.session_id, 'x' AS candidate_id, e.node_id, e.name, e.grp, 0 AS profile_rank FROM seen JOIN kg_evidence e USING (node_id)),
{SQL_STATUS} SELECT session_id, node_id, polarity, status, status_source FROM status""")
def evidence_status_join(t):
    rows = seen(t).join(t.kg_evidence.select("node_id", "name"), "node_id")
    return r.evidence_status(rows, states(t), slots(t)).select("session_id", "node_id", "polarity", "status", "status_source")


@query("profile_status_counts", f"""
WITH {SQL_SPROF},
{SQL_STATUS} SELECT session_id, candidate_id, CAST(sum((status = 'matched')::INT) AS BIGINT) AS matched, CAST(sum((status = 'negative')::INT) AS BIGINT) AS negative,
  CAST(sum((status = 'unknown')::INT) AS BIGINT) AS unknown FROM status GROUP BY 1, 2""")
def profile_status_counts(t):
    return r.profile_status_counts(session_profile(t))


@query("outer_profile", """
SELECT d.node_id AS candidate_id, d.name AS candidate_name, contains(d.name, '11')::INT + contains(d.name, '2')::INT AS matched_keywords,
  count(k.feature_id) AS relation_count, count(DISTINCT k.feature_id) AS feature_count
FROM kg_disease d LEFT JOIN kg_link k ON k.candidate_id = d.node_id
WHERE contains(d.name, '11') OR contains(d.name, '2') GROUP BY 1, 2, 3""")
def outer_profile(t):
    return r.outer_profile(candidates(t).select("candidate_id", "candidate_name"),
                           links(t), ["11", "2"])


@query("cold_start_topk", """
SELECT node_id, label, name, CASE WHEN label IN ('RiskFactor','PopulationGroup') THEN 3 WHEN label = 'ClinicalFinding' THEN 2 ELSE 1 END AS label_priority, w100
FROM kg_node WHERE label IN ('RiskFactor','ClinicalFinding','ClinicalAttribute','PopulationGroup')
ORDER BY 4 DESC, CASE WHEN cost = 'low' THEN 25 WHEN mode IN ('direct_ask','history_known') THEN 20 ELSE 0 END DESC, w100 DESC, name, node_id LIMIT 8""")
def cold_start_topk(t):
    return r.cold_start(t.kg_node).select("node_id", "label", "name", "label_priority", "w100")


@query("question_rank", f"""
WITH {SQL_TOP3},
{SQL_R2.format(pool='top3')},
q AS (SELECT session_id, node_id, name, max(red_flag::INT) AS red, max(node_w100) AS w, max(contradiction) AS g, max(priority) AS p FROM r2 GROUP BY 1, 2, 3),
asked AS (SELECT DISTINCT session_id, CASE WHEN pk > 0 THEN 'P' || (pk - 1) ELSE 'P0' END AS node_id FROM obs),
s AS (SELECT q.session_id, q.node_id, name, red * 2.0::DOUBLE + w / 100 * 1.0 + g / 100 * 1.5 + p / 10000
  - CASE WHEN a.node_id IS NOT NULL THEN 3.0 ELSE 0.0 END AS question_score FROM q LEFT JOIN asked a ON a.session_id = q.session_id AND a.node_id = q.node_id)
SELECT session_id, node_id, question_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY question_score DESC, name, node_id) AS rank FROM s) WHERE rank <= 5""")
def question_rank(t):
    rows = r.r2_evidence(top3(t), evidence(t), t.obs.select("session_id", "node_id")).select(
        "session_id", "node_id", "name", "red_flag", "node_w100", "contradiction", "priority")
    asked = t.obs.select("session_id", F.concat(F.lit("P"), F.greatest(F.col("pk") - 1, F.lit(0)).cast("string")).alias("node_id"))
    q = r.with_asked(rows, asked).groupBy("session_id", "node_id", "name").agg(
        F.max(F.col("red_flag").cast("int")).alias("red_flag"), (F.max("node_w100") / 100).alias("weight"),
        (F.max("contradiction") / 100).alias("gain"), (F.max("priority") / 10000).alias("priority"), F.max("asked").alias("asked"))
    return r.question_rank(q, None, 5).select("session_id", "node_id", "question_score", "rank")


@query("link_confidence", f"""
WITH ln AS (SELECT session_id, p_name AS name, max(CAST(50 + p_size AS BIGINT)) AS sim100 FROM obs JOIN part ON p_partkey = pk WHERE polarity = 'present' GROUP BY 1, 2),
gate AS (SELECT session_id FROM ln GROUP BY 1 HAVING max(sim100) >= 72),
m AS (SELECT DISTINCT o.session_id, k.candidate_id, e.name FROM obs o JOIN kg_evidence e ON e.node_id = o.node_id
      JOIN kg_link k ON k.feature_id = o.node_id WHERE o.polarity = 'present')
SELECT m.session_id, m.candidate_id, sum(sim100) / count(*) / 100 AS link_similarity FROM m JOIN ln ON ln.session_id = m.session_id AND ln.name = m.name
WHERE m.session_id IN (SELECT session_id FROM gate) GROUP BY 1, 2""")
def link_confidence(t):
    o = t.obs.where("polarity = 'present'").join(t.kg_evidence.select("node_id", "name", "w100"), "node_id")
    sims = o.select("session_id", "name", F.col("node_id").alias("feature_id"), (F.floor(F.col("w100") / 2) + 50).alias("sim100"))
    return r.link_confidence(sims, links(t))
