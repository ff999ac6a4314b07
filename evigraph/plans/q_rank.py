"""Queries that rank candidates and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ordered import Order
from ..functions.text import contains_any, match_text
from ..functions.vocab import EVIDENCE_GROUPS, FEEDBACK_MULTIPLIER
from ..operators import actions as ac
from ..operators import rank as k
from ..operators import retrieve as r
from ..sources.sinks import written
from .q_retrieve import SQL_R1, SQL_TOP3, SQL_R2, evidence, features, links, r1, seen, top3
from .q_replay import SQL_FOCUS, focus
from .registry import query

O3 = ("turn", "pk", "sk")
SLICE = ("turn", "floor(pk / 4096)")
SESSION = Order(("session_id",), O3, SLICE)


def n_(cond):
    return f"CAST(coalesce(sum(({cond})::INT), 0) AS BIGINT)"


@query("polarity_effective", """
WITH x AS (SELECT CASE WHEN l_quantity > 25 THEN CASE l_returnflag WHEN 'R' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'maybe' END END AS polarity,
  CASE WHEN l_quantity < 10 THEN 'true' WHEN l_quantity < 15 THEN 'false' ELSE '' END AS status, CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN 'non_exist' ELSE 'unknown' END AS existence FROM lineitem),
y AS (SELECT CASE WHEN polarity IN ('present','absent') THEN polarity WHEN status = 'true' THEN 'present' WHEN status = 'false' OR existence = 'non_exist' THEN 'absent' ELSE 'unclear' END AS effective FROM x)
SELECT effective, CASE effective WHEN 'present' THEN 'true' WHEN 'absent' THEN 'false' ELSE 'unknown' END AS status, count(*) AS n FROM y GROUP BY 1, 2""")
def polarity_effective(t):
    li, q = t.raw("lineitem"), F.col("l_quantity")
    pol = F.when(q > 25, F.when(F.col("l_returnflag") == "R", "present").when(F.col("l_returnflag") == "A", "absent").otherwise("maybe"))
    st = F.when(q < 10, "true").when(q < 15, "false").otherwise("")
    ex = F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.04), "non_exist").otherwise("unknown")
    return li.groupBy(k.polarity_effective(pol, st, ex).alias("effective")).agg(F.count(F.lit(1)).alias("n")).withColumn("status", k.slot_status(F.col("effective")))


SQL_REWARD = "CASE WHEN polarity = 'present' AND resolution = 'clear' THEN 10 WHEN polarity = 'present' THEN 5 WHEN polarity = 'absent' AND resolution = 'clear' THEN -4 WHEN polarity = 'absent' THEN -1 ELSE 0 END"


@query("action_feedback_stats", f"""
SELECT node_id, count(*) AS visit_count, CAST(sum({SQL_REWARD}) AS BIGINT) AS total10, sum({SQL_REWARD}) / count(*) / 10 AS average_value FROM obs GROUP BY 1""")
def action_feedback_stats(t):
    return k.action_stats(t.obs, ["node_id"])


def grouped_obs(t):
    return t.obs.join(t.kg_evidence.select("node_id", "grp", "label", "name", "rel"), "node_id")


def _sql_part(p):
    return "concat_ws(';', " + ", ".join(f"CASE WHEN bool_or(grp = '{g}' AND polarity = '{p}') OVER w THEN '{g}' END" for g in sorted(EVIDENCE_GROUPS)) + ")"


@query("path_cache", f"""
WITH g AS (SELECT o.*, e.grp FROM obs o JOIN kg_evidence e USING (node_id)),
s AS (SELECT grp, sha1('P=' || {_sql_part('present')} || '|N=' || {_sql_part('absent')} || '|U=' || {_sql_part('unclear')}) AS signature FROM g
  WINDOW w AS (PARTITION BY session_id ORDER BY turn, pk, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT signature, grp AS next, count(*) AS support FROM s GROUP BY 1, 2)
SELECT signature, next, support FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY support DESC, next) AS rn FROM n) WHERE rn = 1""")
def path_cache(t):
    return k.path_cache(grouped_obs(t), SESSION, EVIDENCE_GROUPS)


@query("cooldown_filter", """
WITH g AS (SELECT o.*, e.grp, polarity = 'unclear' AND resolution = 'hedged' AS no_result, polarity = 'absent' AND resolution = 'clear' AS negative FROM obs o JOIN kg_evidence e USING (node_id)),
c AS (SELECT *, max(CASE WHEN no_result THEN turn + 2 WHEN negative THEN turn + 1 END) OVER (PARTITION BY session_id, grp ORDER BY turn, pk, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cool_until FROM g)
SELECT session_id, turn, pk, sk, cool_until, coalesce(turn < cool_until, false) AS suppressed FROM c""")
def cooldown_filter(t):
    o = grouped_obs(t).withColumns({
        "no_result": (F.col("polarity") == "unclear") & (F.col("resolution") == "hedged"), "negative": (F.col("polarity") == "absent") & (F.col("resolution") == "clear")})
    return k.cooldown(o, Order(("session_id", "grp"), O3, SLICE)).select("session_id", *O3, "cool_until", "suppressed")


@query("no_result_streak", """
WITH g AS (SELECT *, polarity = 'unclear' AS nr FROM obs),
a AS (SELECT *, sum((NOT nr)::INT) OVER (PARTITION BY session_id ORDER BY turn, pk, sk ROWS UNBOUNDED PRECEDING) AS isl FROM g)
SELECT session_id, turn, pk, sk, CAST(sum(nr::INT) OVER (PARTITION BY session_id, isl ORDER BY turn, pk, sk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM a""")
def no_result_streak(t):
    return k.no_result_streak(t.obs.withColumn("no_result", F.col("polarity") == "unclear"), SESSION).select("session_id", *O3, "streak")


@query("bounded_history", """
WITH g AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, event_id, event_type, age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM g WHERE p IS NULL OR p <> event_type) WHERE age <= 12""")
def bounded_history(t):
    e = t.raw("events").select("user_id", "event_id", "ts", "event_type")
    order = Order(("user_id",), ("ts", "event_id"), ("date_trunc('HOUR', ts)",))
    return k.bounded_history(e, order, "event_type").select("user_id", "event_id", "event_type", "age")


@query("rerank_trigger", """
WITH s AS (SELECT DISTINCT session_id, turn, name FROM obs JOIN kg_evidence USING (node_id) WHERE polarity = 'present' AND label IN ('Pathogen','LabFinding','ImagingFinding','LabTest')),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY name) AS rn FROM s)
SELECT session_id, turn, count(*) AS n, string_agg(name, '|' ORDER BY name) AS names FROM r WHERE rn <= 6 GROUP BY 1, 2""")
def rerank_trigger(t):
    return k.rerank_trigger(grouped_obs(t))


@query("repair_counts", f"""
WITH {SQL_FOCUS}
SELECT case_id, turn, pk, sk, count(*) OVER (PARTITION BY case_id, answer, reject_reason ORDER BY turn, pk, sk ROWS UNBOUNDED PRECEDING) AS times FROM focus WHERE reject_reason IS NOT NULL""")
def repair_counts(t):
    f = focus(t).withColumn("reason", F.col("reject_reason"))
    return k.repair_counts(f, Order(("case_id", "answer", "reason"), O3, SLICE)).select("case_id", *O3, "times")


# -- feedback ------------------------------------------------------------------------------------------

SQL_MULT = "CASE rel " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in FEEDBACK_MULTIPLIER.items()) + " ELSE 90 END"
SQL_REL = f"""{SQL_TOP3},
rl AS (SELECT o.session_id, o.turn, o.pk, o.sk, o.node_id, t.candidate_id, t.candidate_name AS name, CASE t.rank WHEN 1 THEN 100 WHEN 2 THEN 55 ELSE 18 END AS scope,
  (CASE WHEN polarity = 'present' AND resolution = 'clear' THEN 100 WHEN polarity = 'present' THEN 40 WHEN polarity = 'absent' AND resolution = 'clear' THEN -100 WHEN polarity = 'absent' THEN -40 ELSE -18 END) * {SQL_MULT.replace('rel ', 'e.rel ')} AS delta,
  k.candidate_id IS NOT NULL AS same_node FROM obs o JOIN top3 t USING (session_id) JOIN kg_evidence e ON e.node_id = o.node_id LEFT JOIN kg_link k ON k.candidate_id = t.candidate_id AND k.feature_id = o.node_id),
rw AS (SELECT *, CASE WHEN same_node THEN least(10000, 7800 + scope * 24) WHEN scope >= 55 THEN least(5200, 1800 + scope * 32) ELSE 0 END AS weight FROM rl)"""


def related(t):
    scope = F.when(F.col("rank") == 1, 100).when(F.col("rank") == 2, 55).otherwise(18).alias("scope")
    pool = top3(t).select("session_id", "candidate_id", F.col("candidate_name").alias("name"), scope)
    pairs = links(t).select("candidate_id", F.col("feature_id").alias("node_id"), F.lit(True).alias("_hit"))
    # the change of a line is a number before the line meets candidates, so no text moves with each of them
    delta = k.feedback_delta(F.col("polarity"), F.col("resolution"), F.col("rel")).alias("delta")
    lines = grouped_obs(t).select("session_id", *O3, "node_id", delta)
    o, scope = lines.join(pool, "session_id").join(pairs, ["candidate_id", "node_id"], "left"), F.col("scope")
    return o.select("session_id", *O3, "node_id", "candidate_id", "name", "delta",
                    k.feedback_weight(F.coalesce("_hit", F.lit(False)), F.lit(False), F.lit(True), scope).alias("weight"))


@query("evidence_feedback", f"""
WITH {SQL_REL},
st AS (SELECT session_id, candidate_id, CAST(floor(score * 100000000) AS BIGINT) AS start FROM top3),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn, pk, sk ORDER BY weight DESC, name, candidate_id) AS rn FROM rw WHERE weight > 0) WHERE rn <= 5),
f AS (SELECT t.session_id, t.candidate_id, list(CAST(delta * weight AS BIGINT) ORDER BY turn, pk, sk) AS xs FROM tk t GROUP BY 1, 2)
SELECT st.session_id, st.candidate_id, CASE WHEN xs IS NULL THEN start ELSE list_reduce(xs, lambda a, x: greatest(a + x, 0), start) END AS score FROM st LEFT JOIN f USING (session_id, candidate_id)""")
def evidence_feedback(t):
    start = top3(t).select("session_id", "candidate_id", F.floor(F.col("score") * 100000000).cast("bigint").alias("start"))
    return k.evidence_feedback(related(t), start, Order(("session_id", "candidate_id"), O3, SLICE))


@query("feedback_fanout_stats", f"""
WITH {SQL_REL},
p AS (SELECT session_id, turn, node_id, count(*) AS n FROM rw WHERE weight > 0 GROUP BY 1, 2, 3)
SELECT session_id, turn, count(*) AS events, {n_('n > 1')} AS multi_hits, {n_('n > 1')} / count(*) AS multi_rate FROM p GROUP BY 1, 2""")
def feedback_fanout_stats(t):
    # a node may be named by two lines of one turn; every line counts as a hit
    return k.feedback_stats(related(t), ["session_id", "turn"])


# -- anchors ---------------------------------------------------------------------------------------------

SQL_OBSV = """os0 AS (SELECT session_id, node_id, arg_max({'p': polarity, 'r': resolution}, (turn, pk, sk)) AS v FROM obs WHERE resolution = 'clear' AND turn < 7 GROUP BY 1, 2),
sl0 AS (SELECT session_id, node_id, arg_max({'p': polarity, 'r': resolution}, (turn, pk, sk)) AS v FROM obs WHERE turn < 7 GROUP BY 1, 2),
un AS (SELECT session_id, node_id, v.p AS polarity, v.r AS resolution, 1 AS st FROM os0 UNION ALL SELECT session_id, node_id, v.p, v.r, 0 FROM sl0),
obsv AS (SELECT session_id, node_id, arg_max({'p': polarity, 'r': resolution, 's': st}, (CASE WHEN polarity = 'present' AND resolution = 'clear' THEN 4 WHEN polarity = 'present' THEN 3 WHEN polarity = 'unclear' THEN 2 ELSE 1 END, st)) AS b FROM un GROUP BY 1, 2)"""


def observed(t):
    """Turn 7 counts as simulated; the rest is real."""
    last = lambda df: df.groupBy("session_id", "node_id").agg(F.max_by(F.struct("polarity", "resolution"), F.struct(*O3)).alias("b")).select(
        "session_id", "node_id", "b.*", F.lit(False).alias("simulated"))
    real = t.obs.where("turn < 7")
    return k.observed_evidence(last(real.where("resolution = 'clear'")), last(real))


@query("observed_evidence", f"""
WITH {SQL_OBSV} SELECT session_id, node_id, b.p AS polarity, b.r AS resolution, CASE b.s WHEN 1 THEN 'evidence_state' ELSE 'slot' END AS source FROM obsv""")
def observed_evidence(t):
    return observed(t)


# Facet words that occur in the part names, and digits that stand for facets of the suppliers.
FACETS = (("lung", ("ring", "11")), ("cns", ("bolt", "22")), ("skin", ("gear", "33")), ("disseminated", ("hot", "44")), ("iris", ("cold", "55")), ("tb", ("rod", "66")),
          ("mycobacteria", ("plate",)))
SITES, GENERAL = ("11", "22", "ring"), ("7",)
PATHOGENS = (("rod", ("rod", "anvil")), ("1", ("bolt",)))
TAG_RULES = (("immune_status", ("hot",)), ("pathogen", ("cold",)), ("respiratory", ("ring",)))


def sql_words(rules, key):
    one = ", ".join(f"CASE WHEN {' OR '.join(f"contains({key}, '{w}')" for w in words)} THEN '{n}' END" for n, words in rules)
    return f"list_filter([{one}], lambda x: x IS NOT NULL)"


def sql_any(words, key):
    return "(" + " OR ".join(f"contains({key}, '{w}')" for w in words) + ")"


SQL_FACET = sql_words(FACETS, "{c}")


def observed_items(t):
    """Observed evidence with names; a large order names the disease itself."""
    e = observed(t).join(t.kg_evidence.select("node_id", "name"), "node_id").select("session_id", "node_id", "name", "polarity", "resolution")
    s = t.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    d = t.raw("lineitem").where("l_quantity >= 45").join(s, "l_suppkey").select(
        F.col("l_orderkey").alias("session_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node_id"), "name",
        F.lit("present").alias("polarity"), F.lit("clear").alias("resolution"))
    return e.unionByName(d.distinct())


SQL_MATCH = f"""{SQL_TOP3}, {SQL_OBSV},
obsi AS (SELECT o.session_id, o.node_id, e.name, b.p AS polarity, b.r AS resolution FROM obsv o JOIN kg_evidence e USING (node_id)
  UNION ALL SELECT DISTINCT l_orderkey, 'S' || l_suppkey, s_name, 'present', 'clear' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 45),
oc AS (SELECT o.session_id, o.node_id, o.name AS oname, o.polarity, o.resolution, replace(lower(o.name), ' ', '') AS okey, t.candidate_id, t.candidate_name, replace(lower(t.candidate_name), ' ', '') AS ckey, t.score
  FROM obsi o JOIN top3 t USING (session_id)),
bn AS (SELECT k.candidate_id, replace(e.name, ' ', '') AS pkey, max(k.feature_id) AS payload_id, arg_max(k.rel, k.feature_id) AS rel, arg_max(e.label, k.feature_id) AS label
  FROM kg_link k JOIN kg_evidence e ON e.node_id = k.feature_id GROUP BY 1, 2),
nm AS (SELECT dn.candidate_id, dn.okey, arg_max({{'i': payload_id, 'r': rel, 'l': label, 'm': CASE WHEN pkey = okey THEN 96 ELSE 88 END}}, (CASE WHEN pkey = okey THEN 96 ELSE 88 END, payload_id)) AS x
  FROM (SELECT DISTINCT candidate_id, okey FROM oc) dn JOIN bn ON bn.candidate_id = dn.candidate_id AND (contains(pkey, okey) OR contains(okey, pkey)) GROUP BY 1, 2),
pm0 AS (SELECT session_id, candidate_id, node_id, candidate_id AS payload_id, 'SELF_DISEASE_MATCH' AS rel, 'Disease' AS label, 100 AS match100, 1 AS s FROM oc WHERE node_id = candidate_id OR okey = ckey
  UNION ALL SELECT oc.session_id, oc.candidate_id, oc.node_id, k.feature_id, k.rel, e.label, 100, 0 FROM oc JOIN kg_link k ON k.candidate_id = oc.candidate_id AND k.feature_id = oc.node_id JOIN kg_evidence e ON e.node_id = k.feature_id
  UNION ALL SELECT oc.session_id, oc.candidate_id, oc.node_id, x.i, x.r, x.l, x.m, 0 FROM oc JOIN nm ON nm.candidate_id = oc.candidate_id AND nm.okey = oc.okey),
pmx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, candidate_id, node_id ORDER BY s DESC, match100 DESC, payload_id DESC) AS rn FROM pm0) WHERE rn = 1)"""


def matches(t, pool=None, items=None, bring=()):
    payloads = links(t).select("candidate_id", F.col("feature_id").alias("node_id"), "rel").join(
        t.kg_evidence.select("node_id", "name", "label"), "node_id")
    return k.payload_match(written(observed_items(t), "observed") if items is None else items, top3(t) if pool is None else pool, payloads, bring=bring)


@query("payload_match", f"WITH {SQL_MATCH} SELECT session_id, candidate_id, node_id, payload_id, rel, match100 FROM pmx")
def payload_match(t):
    return matches(t).select("session_id", "candidate_id", "node_id", "payload_id", "rel", "match100")


def sql_scope(cand, ev, facets):
    """Columns of the scope decision for normalised names ``cand`` and ``ev``; ``facets`` are those of the evidence."""
    crit = f"list_filter({SQL_FACET.format(c=cand)}, lambda x: x <> 'mycobacteria')"
    miss = f"""list_sort(list_filter({crit}, lambda c: NOT (list_contains({facets}, c) OR (c = 'disseminated' AND len(list_intersect({facets}, ['lung','cns','skin'])) >= 2))))"""
    specific = f"len({facets}) > 0"
    gap = f"CASE WHEN len({miss}) > 0 AND {specific} THEN 'competing_scope' WHEN len({miss}) > 0 OR (len({crit}) = 0 AND {sql_any(GENERAL, cand)} AND {specific}) THEN 'family_scope' END"
    reason = f"""CASE WHEN len({miss}) > 0 THEN 'candidate_scope_not_observed:' || array_to_string({miss}, ',') WHEN len({crit}) = 0 AND {sql_any(GENERAL, cand)} AND {specific} THEN 'observed_evidence_more_specific_than_candidate' END"""
    named = f"len(list_filter({sql_words(PATHOGENS, ev)}, lambda f: contains({cand}, f))) > 0"
    whole = f"""CASE WHEN role = 'background_context' THEN 'role_background_context' WHEN rel = 'SELF_DISEASE_MATCH' THEN 'disease_self_match' WHEN bg THEN 'background_keyword_or_family'
   WHEN {reason} IS NOT NULL THEN {reason}
   WHEN (label = 'Pathogen' OR rel = 'HAS_PATHOGEN' OR list_contains(tags, 'type:pathogen')) THEN CASE WHEN rel IN ('RISK_FACTOR_FOR','APPLIES_TO','COMPLICATED_BY') THEN 'pathogen_as_background_or_comorbidity' WHEN NOT {sql_any(SITES, cand)} THEN 'pathogen_exact_match'
     WHEN contains({cand}, {ev}) OR {named} THEN 'pathogen_family_match' ELSE 'pathogen_not_named_in_candidate' END
   WHEN contains({cand}, {ev}) OR contains({ev}, {cand}) THEN 'normalized_name_match' WHEN rel IN ('DIAGNOSED_BY','REQUIRES_DETAIL') THEN 'definition_relation_direct'
   WHEN label IN ('LabFinding','LabTest','ImagingFinding','ClinicalAttribute') AND {sql_any(SITES, cand)} AND {sql_any(SITES, ev)} THEN 'site_specific_detail_match'
   WHEN label IN ('LabFinding','LabTest','ImagingFinding','ClinicalAttribute') AND (list_has_any(tags, ['pathogen','imaging']) OR rel IN ('HAS_PATHOGEN','HAS_LAB_FINDING','HAS_IMAGING_FINDING')) THEN 'specific_family_match'
   WHEN label = 'ClinicalFinding' OR rel = 'MANIFESTS_AS' THEN 'phenotype_support' WHEN list_has_any(tags, ['pathogen','imaging']) THEN 'specific_family_tag_match' ELSE 'fallback_background' END"""
    return gap, whole


SQL_SCOPE_OF = """CASE WHEN reason LIKE 'candidate_scope_not_observed%' OR reason = 'observed_evidence_more_specific_than_candidate' THEN gap
  WHEN reason IN ('disease_self_match','pathogen_exact_match','normalized_name_match','definition_relation_direct','site_specific_detail_match') THEN 'exact_scope'
  WHEN reason IN ('pathogen_family_match','specific_family_match','specific_family_tag_match') THEN 'family_scope' WHEN reason = 'phenotype_support' THEN 'phenotype_scope' ELSE 'background_scope' END"""
SQL_ETAGS = """list_distinct(list_filter([CASE WHEN coalesce(grp, '') <> '' THEN 'type:' || grp END, CASE WHEN label IN ('LabFinding','LabTest') THEN 'type:lab' WHEN label = 'ImagingFinding' THEN 'type:imaging' WHEN label = 'Pathogen' THEN 'type:pathogen' WHEN label = 'ClinicalAttribute' THEN 'type:detail' END,
  CASE WHEN label = 'ImagingFinding' THEN 'imaging' WHEN label = 'Pathogen' THEN 'pathogen' WHEN label = 'ClinicalAttribute' THEN 'detail' END, CASE WHEN contains(ekey, 'hot') THEN 'immune_status' END, CASE WHEN contains(ekey, 'cold') THEN 'pathogen' END, CASE WHEN contains(ekey, 'ring') THEN 'respiratory' END], lambda x: x IS NOT NULL))"""
SQL_AROLE = """CASE WHEN rel = 'SELF_DISEASE_MATCH' THEN 'disease_specific_anchor' WHEN bg THEN 'background_context' WHEN label IN ('Pathogen','Disease') OR rel = 'HAS_PATHOGEN' OR list_contains(tags, 'type:pathogen') THEN 'disease_specific_anchor'
  WHEN rel IN ('DIAGNOSED_BY','REQUIRES_DETAIL') OR list_contains(tags, 'detail') THEN 'definition_anchor' WHEN rel IN ('HAS_LAB_FINDING','HAS_IMAGING_FINDING') AND label IN ('LabFinding','LabTest','ImagingFinding') THEN 'disease_specific_anchor'
  WHEN list_has_any(tags, ['pathogen','imaging']) THEN 'disease_specific_anchor' WHEN label = 'ClinicalAttribute' THEN 'definition_anchor' WHEN label = 'RiskFactor' OR rel = 'RISK_FACTOR_FOR' THEN 'risk_or_comorbidity'
  WHEN label = 'ClinicalFinding' OR rel = 'MANIFESTS_AS' THEN 'phenotype_support' ELSE 'background_context' END"""
_GAP, _REASON = sql_scope("ckey", "ekey", "ef")
BUCKETS = ("strong", "definition", "family", "provisional", "phenotype", "background", "negative")
SQL_AM = f"""{SQL_MATCH},
fr AS (SELECT session_id, node_id, count(DISTINCT candidate_id) AS deg FROM pmx GROUP BY 1, 2),
am1 AS (SELECT pmx.session_id, pmx.candidate_id, pmx.node_id, pmx.payload_id, pmx.rel, pmx.label, pmx.match100, oc.polarity, oc.resolution, oc.oname, oc.ckey, oc.candidate_name, oc.score, deg, n.name AS ename, replace(lower(n.name), ' ', '') AS ekey, n.grp, n.mode, n.cost
  FROM pmx JOIN oc USING (session_id, candidate_id, node_id) JOIN fr USING (session_id, node_id) JOIN kg_node n ON n.node_id = pmx.payload_id),
am2 AS (SELECT *, {SQL_ETAGS} AS tags, {SQL_FACET.format(c='ekey')} AS ef FROM am1),
am3 AS (SELECT *, list_contains(tags, 'immune_status') AND deg >= 2 AS bg FROM am2),
am4 AS (SELECT *, {SQL_AROLE} AS role FROM am3),
am5 AS (SELECT *, {_REASON} AS reason, {_GAP} AS gap FROM am4),
am0 AS (SELECT *, {SQL_SCOPE_OF} AS scope FROM am5),
am AS (SELECT *, CAST(floor((CASE WHEN polarity = 'present' AND resolution = 'clear' THEN 1.0 WHEN polarity = 'present' THEN 0.55 WHEN polarity = 'absent' AND resolution = 'clear' THEN 1.0 ELSE 0.0 END)::DOUBLE
  * (CASE rel WHEN 'SELF_DISEASE_MATCH' THEN 1.0 WHEN 'HAS_PATHOGEN' THEN 1.0 WHEN 'HAS_LAB_FINDING' THEN 0.85 WHEN 'HAS_IMAGING_FINDING' THEN 0.85 WHEN 'MANIFESTS_AS' THEN 0.45 WHEN 'REQUIRES_DETAIL' THEN 0.55 ELSE 0.35 END)::DOUBLE
  * (CASE label WHEN 'Disease' THEN 1.0 WHEN 'Pathogen' THEN 1.0 WHEN 'LabFinding' THEN 0.85 WHEN 'ImagingFinding' THEN 0.85 WHEN 'ClinicalAttribute' THEN 0.55 WHEN 'ClinicalFinding' THEN 0.35 ELSE 0.25 END)::DOUBLE
  * (CASE scope WHEN 'exact_scope' THEN 1.0 WHEN 'family_scope' THEN 0.72 WHEN 'phenotype_scope' THEN 0.35 WHEN 'competing_scope' THEN 0.24 ELSE 0.12 END)::DOUBLE / log2(deg + 2) * 1000000 + 0.000001::DOUBLE) AS BIGINT) AS ascore FROM am0),
bk AS (SELECT *, CASE WHEN polarity = 'absent' AND resolution = 'clear' AND scope <> 'background_scope' AND (role IN ('disease_specific_anchor','definition_anchor') OR rel IN ('HAS_PATHOGEN','HAS_LAB_FINDING','HAS_IMAGING_FINDING')) THEN 'negative'
   WHEN polarity <> 'present' THEN NULL WHEN scope = 'background_scope' THEN 'background'
   WHEN scope IN ('family_scope','competing_scope') AND role IN ('disease_specific_anchor','definition_anchor') THEN 'family'
   WHEN role = 'background_context' THEN 'background'
   WHEN role IN ('definition_anchor','disease_specific_anchor') THEN CASE WHEN resolution <> 'clear' THEN 'provisional' WHEN role = 'definition_anchor' THEN 'definition' ELSE 'strong' END
   WHEN role = 'phenotype_support' THEN 'phenotype' ELSE 'background' END AS bucket FROM am),
su AS (SELECT session_id, candidate_id, any_value(candidate_name) AS candidate_name, any_value(ckey) AS ckey, any_value(score) AS score, {', '.join(f"CAST(sum(CASE WHEN bucket = '{b}' THEN ascore ELSE 0 END) AS BIGINT) AS {b}, {n_(f"bucket = '{b}'")} AS n_{b}" for b in BUCKETS)},
  CAST(sum(CASE WHEN bucket = 'family' AND scope = 'competing_scope' THEN ascore ELSE 0 END) AS BIGINT) AS competing,
  list_distinct(flatten(coalesce(list(list_concat(ef, {SQL_FACET.format(c="replace(lower(oname), ' ', '')")})) FILTER (polarity = 'present' AND resolution IN ('clear','hedged')), []))) AS seen FROM bk GROUP BY 1, 2),
summ AS (SELECT *, strong + definition AS exact, CASE WHEN strong + definition + family = 0 THEN background ELSE 0 END AS background_attractor, strong + definition + family + provisional * 65 // 100 AS observed,
  ((strong + definition) * 100 + family * 80 + (provisional * 65 // 100) * 100 + phenotype * 25) // 100 AS role_specificity, CASE WHEN n_strong > 0 THEN 'strong_anchor' WHEN n_definition > 0 THEN 'definition_anchor'
  WHEN n_family > 0 THEN 'family_anchor' WHEN n_provisional > 0 THEN 'provisional_anchor' WHEN n_phenotype > 0 THEN 'phenotype_supported' WHEN n_background > 0 THEN 'background_supported' WHEN n_negative > 0 THEN 'negative_anchor' ELSE 'speculative' END AS anchor_tier FROM su),
sp1 AS (SELECT *, list_filter({SQL_FACET.format(c='ckey')}, lambda x: x <> 'mycobacteria') AS crit, list_filter(seen, lambda x: x <> 'mycobacteria') AS scrit FROM summ),
sp2 AS (SELECT *, list_filter(crit, lambda c: NOT (list_contains(seen, c) OR (c = 'disseminated' AND len(list_intersect(seen, ['lung','cns','skin'])) >= 2))) AS miss FROM sp1),
sp3 AS (SELECT *, CASE WHEN len(crit) > 0 THEN (len(crit) - len(miss)) / len(crit) * 0.7::DOUBLE + least((len(crit) - len(miss)) * 0.08::DOUBLE, 0.24) ELSE 0.0::DOUBLE END AS specificity,
  CASE WHEN ({sql_any(GENERAL, 'ckey')} AND len(crit) = 0 AND len(scrit) > 0) OR (len(list_intersect(scrit, ['lung','cns','skin'])) > 0 AND len(list_intersect(crit, ['lung','cns','skin'])) = 0) THEN 0.38::DOUBLE ELSE 0.0::DOUBLE END AS generic,
  CASE WHEN exact + family + provisional + phenotype > 0 AND len(miss) > 0 THEN least(len(miss) * 0.18::DOUBLE, 0.54) ELSE 0.0::DOUBLE END + CASE WHEN list_contains(miss, 'iris') THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN list_contains(miss, 'disseminated') THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END AS need FROM sp2),
sp4 AS (SELECT *, competing / 1000000 + need AS mismatch, CASE WHEN exact > 0 AND len(miss) = 0 AND len(seen) > 0 THEN 0.35::DOUBLE WHEN family > 0 AND len(seen) > 0 THEN 0.35::DOUBLE * 0.45::DOUBLE WHEN provisional * 65 // 100 > 0 AND len(seen) > 0 THEN 0.35::DOUBLE * 0.2::DOUBLE ELSE 0.0::DOUBLE END
  - CASE WHEN generic > 0 THEN least(generic / 0.38::DOUBLE, 1.0) * 0.28::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN need > 0 THEN least(need * 0.35::DOUBLE, 0.28) ELSE 0.0::DOUBLE END AS cluster FROM sp3),
sp AS (SELECT *, strong / 1000000 * 2.4::DOUBLE + definition / 1000000 * 2.4::DOUBLE + family / 1000000 * 1.1::DOUBLE + provisional / 1000000 * 0.95::DOUBLE + phenotype / 1000000 * 0.35::DOUBLE + background / 1000000 * 0.10::DOUBLE
  + specificity * 0.42::DOUBLE + cluster - negative / 1000000 * 1.45::DOUBLE - background_attractor / 1000000 * 0.82::DOUBLE - mismatch * 0.92::DOUBLE - generic * 0.85::DOUBLE AS bonus FROM sp4)"""


def anchored_matches(t):
    """Matches with their scope and score.  They bring what was observed and the candidate's score; names of payloads are read once per node."""
    c = F.col
    pool = written(top3(t).select("session_id", "candidate_id", "candidate_name", c("score").alias("base_score")), "pool")
    items = written(observed_items(t).withColumn("oname", c("name")), "observed")
    m = matches(t, pool, items, bring=("oname", "polarity", "resolution", "candidate_name", "base_score")).where("node_id IS NOT NULL")
    deg = F.size(F.collect_set("candidate_id").over(Window.partitionBy("session_id", "node_id")))  # candidates of a pool
    nodes = t.kg_node.select(c("node_id").alias("payload_id"), c("name").alias("ename"), "grp", "mode", "cost")
    m = m.withColumn("deg", deg).join(ac.evidence_name_scope(nodes, "ename", FACETS, SITES, PATHOGENS), "payload_id")
    m = m.withColumn("tags", k.evidence_tags(c("label"), F.coalesce("grp", F.lit("")), c("ename"), TAG_RULES))
    m = m.withColumn("bg", F.array_contains("tags", F.lit("immune_status")) & (c("deg") >= 2))
    m = m.withColumn("role", k.anchor_role(c("rel"), c("label"), c("tags"), c("bg")))
    m = ac.anchor_scope(m, "candidate_name", "ename", FACETS, SITES, PATHOGENS, GENERAL)
    return m.withColumn("score", k.anchor_strength(c("polarity"), c("resolution"), c("rel"), c("label"), c("deg"), c("scope")))


SUMMARY = ("strong", "definition", "family", "provisional", "phenotype", "background", "negative", "exact", "background_attractor", "observed", "role_specificity", "anchor_tier")


@query("anchor_summary", f"WITH {SQL_AM} SELECT session_id, candidate_id, {', '.join(SUMMARY)} FROM summ")
def anchor_summary(t):
    return k.anchor_summary(anchored_matches(t)).select("session_id", "candidate_id", *SUMMARY)


def scoped_summary(t):
    """Anchor summaries with the scope profile of each candidate."""
    c = F.col
    m = anchored_matches(t)
    real = (c("polarity") == "present") & c("resolution").isin("clear", "hedged")
    m = m.withColumns({"_fe": k.scope_tokens(c("ename"), FACETS), "_fo": k.scope_tokens(c("oname"), FACETS)})
    facets = F.concat("_fe", "_fo")  # lists of a closed vocabulary
    seen = F.array_distinct(F.flatten(F.collect_set(F.when(real, facets)))).alias("seen")
    who = F.collect_set(F.struct("candidate_name", c("base_score").alias("score"))).alias("_who")
    s = k.anchor_summary(m, [seen, who]).withColumn("_who", F.explode("_who")).select("*", "_who.*").drop("_who")
    s = s.withColumn("_name", match_text(c("candidate_name"), drop=" -_/+"))
    s = s.withColumns({"_facets": k.scope_tokens(c("_name"), FACETS), "_wide": contains_any(c("_name"), GENERAL),
                       "_any": c("exact") + c("family") + c("provisional") + c("phenotype") > 0})
    p = k.scope_profile(c("_facets"), c("seen"), c("_wide"), c("_any"))
    s = s.withColumns({"missing": p["missing_facets"], "specificity": p["scope_specificity"], "generic": p["generic_penalty"], "need": p["requirement_missing"]})
    half = F.floor(c("provisional") * 65 / 100)
    return s.withColumns({"mismatch": c("competing") / 1000000 + c("need"),
                          "cluster": k.scope_cluster(c("exact"), c("family"), half, c("seen"), c("missing"), c("generic"), c("need"))})


@query("anchor_bonus_apply", f"WITH {SQL_AM} SELECT session_id, candidate_id, specificity, generic, mismatch, cluster, bonus, greatest(score + bonus, 0.0) AS boosted FROM sp")
def anchor_bonus_apply(t):
    s = scoped_summary(t).withColumn("bonus", k.anchor_bonus(F.col("specificity"), F.col("cluster"), F.col("mismatch"), F.col("generic")))
    return s.select("session_id", "candidate_id", "specificity", "generic", "mismatch", "cluster", "bonus", F.greatest(F.col("score") + F.col("bonus"), F.lit(0.0)).alias("boosted"))


@query("anchor_rerank", f"""
WITH {SQL_AM}
SELECT session_id, candidate_id, anchor_tier, greatest(score + bonus, 0.0) AS boosted,
 row_number() OVER (PARTITION BY session_id ORDER BY CASE anchor_tier WHEN 'strong_anchor' THEN 5 WHEN 'definition_anchor' THEN 5 WHEN 'family_anchor' THEN 4 WHEN 'provisional_anchor' THEN 3 WHEN 'phenotype_supported' THEN 2 WHEN 'negative_anchor' THEN 0 ELSE 1 END DESC,
  cluster DESC, exact DESC, family DESC, role_specificity DESC, specificity DESC, observed DESC, background_attractor, mismatch, generic, greatest(score + bonus, 0.0) DESC, candidate_name, candidate_id) AS anchor_rank FROM sp""")
def anchor_rerank(t):
    return k.anchor_rerank(scoped_summary(t)).select("session_id", "candidate_id", "anchor_tier", "boosted", "anchor_rank")


_LGAP, _LREASON = sql_scope("ckey", "ekey", "ef")


@query("anchor_scope", f"""
WITH x0 AS (SELECT k.rel, e.label, e.grp, replace(e.name, ' ', '') AS ekey, lower(d.name) AS ckey FROM kg_link k JOIN kg_evidence e ON e.node_id = k.feature_id JOIN kg_disease d ON d.node_id = k.candidate_id),
x1 AS (SELECT *, {SQL_ETAGS} AS tags, {SQL_FACET.format(c='ekey')} AS ef, false AS bg FROM x0),
x2 AS (SELECT *, {SQL_AROLE} AS role FROM x1),
x3 AS (SELECT *, {_LREASON} AS reason, {_LGAP} AS gap FROM x2)
SELECT rel, reason, {SQL_SCOPE_OF} AS scope, count(*) AS n FROM x3 GROUP BY 1, 2, 3""")
def anchor_scope(t):
    """Scope of every link of the graph for the candidate that holds it."""
    c = F.col
    e = t.kg_evidence.select(c("node_id").alias("feature_id"), "label", "grp", "name")
    e = ac.evidence_scope(e.withColumn("tags", k.evidence_tags(c("label"), c("grp"), c("name"), TAG_RULES)), "name", FACETS, SITES, PATHOGENS)
    d = ac.candidate_scope(t.kg_disease.select(c("node_id").alias("candidate_id"), c("name").alias("candidate_name")), "candidate_name", FACETS, SITES, GENERAL)
    x = links(t).select("candidate_id", "feature_id", "rel").join(e, "feature_id").join(d, "candidate_id")
    x = x.withColumns({"bg": F.lit(False), "role": k.anchor_role(c("rel"), c("label"), c("tags"), F.lit(False))})
    return ac.anchor_scope(x, "candidate_name", "name", FACETS, SITES, PATHOGENS, GENERAL).groupBy("rel", "reason", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("low_cost_profile", f"""
WITH {SQL_AM},
lf AS (SELECT *, list_filter(list_distinct(list_transform(list_filter(tags, lambda x: x NOT LIKE 'type:%'), lambda x: CASE x WHEN 'respiratory' THEN 'respiratory_symptom' WHEN 'detail' THEN 'general_detail' ELSE x END)), lambda x: x <> 'immune_status') AS fam,
  CASE WHEN scope = 'background_scope' THEN 'background_context' WHEN scope IN ('family_scope','competing_scope') AND role IN ('disease_specific_anchor','definition_anchor') THEN 'family_anchor' ELSE role END AS arole FROM am),
ok AS (SELECT session_id, candidate_id, CASE WHEN len(fam) > 0 THEN fam WHEN arole = 'phenotype_support' THEN ['phenotype'] WHEN arole = 'risk_or_comorbidity' THEN ['risk_or_comorbidity'] WHEN arole = 'definition_anchor' THEN ['definition_detail'] WHEN arole = 'family_anchor' THEN ['family_anchor'] ELSE [] END AS f FROM lf
  WHERE polarity = 'present' AND resolution = 'clear' AND scope <> 'background_scope' AND role <> 'background_context' AND coalesce(mode, '') = 'direct_ask')
SELECT session_id, candidate_id, count(DISTINCT rowid_) AS low_cost_items, count(DISTINCT x) AS low_cost_families, count(DISTINCT rowid_) >= 2 AND count(DISTINCT x) >= 2 AS satisfied
FROM (SELECT session_id, candidate_id, row_number() OVER () AS rowid_, f FROM ok WHERE len(f) > 0), unnest(f) AS u(x) GROUP BY 1, 2""")
def low_cost_profile(t):
    c = F.col
    m = anchored_matches(t)
    role = F.when(c("scope") == "background_scope", "background_context").when(
        c("scope").isin("family_scope", "competing_scope") & c("role").isin("disease_specific_anchor", "definition_anchor"), "family_anchor").otherwise(c("role"))
    return k.low_cost_profile(m.withColumns({"role": role, "families": k.canonical_tags(c("tags")), "mode": F.coalesce("mode", F.lit("")), "cost": F.coalesce("cost", F.lit("high"))}))


@query("scope_tokens", f"SELECT p_name AS name, array_to_string({SQL_FACET.format(c='p_name')}, ',') AS facets, count(*) AS n FROM part GROUP BY 1, 2")
def scope_tokens(t):
    p = t.raw("part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("name", F.concat_ws(",", k.scope_tokens(F.col("name"), FACETS)).alias("facets"), "n")


@query("scope_profile", f"""
WITH x AS (SELECT DISTINCT a.p_name AS candidate, b.p_name AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
f AS (SELECT *, {SQL_FACET.format(c='candidate')} AS cf, {SQL_FACET.format(c='other')} AS sf FROM x),
g AS (SELECT *, list_filter(cf, lambda c: c <> 'mycobacteria') AS crit, list_filter(sf, lambda c: c <> 'mycobacteria') AS seen FROM f),
h AS (SELECT *, list_sort(list_filter(crit, lambda c: NOT (list_contains(sf, c) OR (c = 'disseminated' AND len(list_intersect(sf, ['lung','cns','skin'])) >= 2)))) AS miss FROM g)
SELECT candidate, other, array_to_string(miss, ',') AS missing, CASE WHEN len(crit) > 0 THEN (len(crit) - len(miss)) / len(crit) * 0.7 + least((len(crit) - len(miss)) * 0.08::DOUBLE, 0.24) ELSE 0.0::DOUBLE END AS scope_specificity,
 CASE WHEN (len(crit) = 0 AND len(seen) > 0) OR (len(list_intersect(seen, ['lung','cns','skin'])) > 0 AND len(list_intersect(crit, ['lung','cns','skin'])) = 0) THEN 0.38::DOUBLE ELSE 0.0::DOUBLE END AS generic_penalty,
 CASE WHEN len(miss) > 0 THEN least(len(miss) * 0.18::DOUBLE, 0.54) ELSE 0.0::DOUBLE END + CASE WHEN list_contains(miss, 'iris') THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN list_contains(miss, 'disseminated') THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END AS requirement_missing FROM h""")
def scope_profile(t):
    p = t.raw("part").select("p_partkey", F.col("p_name").alias("candidate"))
    nxt = t.raw("part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    x = p.join(nxt, "p_partkey").select("candidate", "other").distinct()
    x = x.withColumns({"_c": k.scope_tokens(F.col("candidate"), FACETS), "_o": k.scope_tokens(F.col("other"), FACETS)})
    s = k.scope_profile(F.col("_c"), F.col("_o"), F.lit(True), F.lit(True))
    return x.select("candidate", "other", F.concat_ws(",", s["missing_facets"]).alias("missing"), s["scope_specificity"].alias("scope_specificity"),
                    s["generic_penalty"].alias("generic_penalty"), s["requirement_missing"].alias("requirement_missing"))


@query("evidence_tags", """
WITH b AS (SELECT node_id, grp, label, name FROM kg_evidence),
x AS (SELECT node_id, 'type:' || grp AS tag FROM b UNION SELECT node_id, CASE label WHEN 'LabFinding' THEN 'type:lab' WHEN 'ImagingFinding' THEN 'type:imaging' WHEN 'Pathogen' THEN 'type:pathogen' WHEN 'ClinicalAttribute' THEN 'type:detail' END FROM b
  UNION SELECT node_id, CASE label WHEN 'ImagingFinding' THEN 'imaging' WHEN 'Pathogen' THEN 'pathogen' WHEN 'ClinicalAttribute' THEN 'detail' END FROM b
  UNION SELECT node_id, 'immune_status' FROM b WHERE contains(name, 'hot') UNION SELECT node_id, 'pathogen' FROM b WHERE contains(name, 'cold') UNION SELECT node_id, 'respiratory' FROM b WHERE contains(name, 'ring')),
c AS (SELECT DISTINCT node_id, CASE tag WHEN 'respiratory' THEN 'respiratory_symptom' WHEN 'detail' THEN 'general_detail' ELSE tag END AS tag FROM x WHERE tag IS NOT NULL AND tag NOT LIKE 'type:%')
SELECT x.node_id, count(DISTINCT x.tag) AS n_tags, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM c WHERE c.node_id = x.node_id), '') AS families FROM x WHERE tag IS NOT NULL GROUP BY 1""")
def evidence_tags(t):
    e = t.kg_evidence.withColumn("_t", k.evidence_tags(F.col("label"), F.col("grp"), F.col("name"), TAG_RULES))
    return e.select("node_id", F.size("_t").cast("bigint").alias("n_tags"), F.concat_ws(",", F.array_sort(k.canonical_tags(F.col("_t")))).alias("families"))


# -- answers ---------------------------------------------------------------------------------------------------

SQL_TRAJ = """ev0 AS (SELECT user_id AS session_id, CAST(date_trunc('day', ts) AS DATE) AS d, event_type, event_type || ':' || CAST(floor(value / 25) AS BIGINT) AS action, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
tj0 AS (SELECT session_id, d, event_type, count(*) AS n FROM ev0 GROUP BY 1, 2, 3),
ta AS (SELECT session_id, d, arg_max(event_type, (n, event_type)) AS answer FROM tj0 GROUP BY 1, 2),
tr AS (SELECT e.session_id, strftime(e.d, '%Y-%m-%d') AS trajectory_id, any_value(answer) AS answer, CAST(least(max(cents) // 200, 100) AS BIGINT) AS score100, count(*) >= 3 AS terminal, list_sort(list_distinct(list(action))) AS actions
  FROM ev0 e JOIN ta ON ta.session_id = e.session_id AND ta.d = e.d GROUP BY 1, 2)"""


def trajectories(t):
    e = t.raw("events").select(
        F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("trajectory_id"), "event_type",
        F.concat_ws(":", "event_type", F.floor(F.col("value") / 25).cast("string")).alias("action"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    key = ["session_id", "trajectory_id"]
    mode = e.groupBy(*key, "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("event_type", F.struct("n", "event_type")).alias("answer"))
    # one trajectory is one user's day: its actions are a short list
    body = e.groupBy(*key).agg(F.least(F.floor(F.max("cents") / 200), F.lit(100)).cast("bigint").alias("score100"), (F.count(F.lit(1)) >= 3).alias("terminal"),
                               F.array_sort(F.collect_set("action")).alias("actions"))
    return body.join(mode, key)


SQL_TG = f"""{SQL_TRAJ},
tb AS (SELECT session_id, answer, count(*) AS n, sum(score100) AS s, max(score100) AS m, {n_('terminal')} AS t FROM tr GROUP BY 1, 2),
tt AS (SELECT session_id, sum(n) AS total, count(*) AS groups FROM tb GROUP BY 1),
pr AS (SELECT a.session_id, a.answer, sum(CASE WHEN a.actions = b.actions THEN 1000000 ELSE len(list_intersect(a.actions, b.actions)) * 1000000 // (len(a.actions) + len(b.actions) - len(list_intersect(a.actions, b.actions))) END) AS x
  FROM tr a JOIN tr b ON b.session_id = a.session_id AND b.answer = a.answer AND a.trajectory_id < b.trajectory_id GROUP BY 1, 2),
tg AS (SELECT tb.session_id, tb.answer, n, n / total AS consistency, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - x / (n * (n - 1) / 2) / 1000000 END AS diversity,
  greatest(least(s / n / 100 * 0.55 + m / 100 * 0.30 + t / n * 0.15, 1.0), 0.0) AS agent FROM tb JOIN tt USING (session_id) LEFT JOIN pr USING (session_id, answer)),
tgs AS (SELECT *, consistency * 0.3 + diversity * 0.4 + agent * 0.3 AS final_score FROM tg)"""


@query("trajectory_groups", f"WITH {SQL_TG} SELECT session_id, answer, n, consistency, diversity, agent, final_score FROM tgs")
def trajectory_groups(t):
    return k.trajectory_groups(trajectories(t)).select("session_id", "answer", "n", "consistency", "diversity", "agent", "final_score")


@query("group_agent_score", f"WITH {SQL_TG} SELECT session_id, answer, agent FROM tg")
def group_agent_score(t):
    b = trajectories(t).groupBy("session_id", "answer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score100").alias("s"), F.max("score100").alias("m"), F.sum(F.col("terminal").cast("bigint")).alias("t"))
    return b.select("session_id", "answer", k.group_agent_score().alias("agent"))


@query("best_trajectory", f"WITH {SQL_TRAJ} SELECT session_id, answer, arg_min(trajectory_id, (-score100, trajectory_id)) AS trajectory_id, max(score100) AS score100 FROM tr GROUP BY 1, 2")
def best_trajectory(t):
    return k.best_trajectory(trajectories(t))


@query("alternative_gaps", f"""
WITH {SQL_TG},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final_score DESC, answer) AS rank FROM tgs)
SELECT a.session_id, a.answer, a.rank, b.final_score - a.final_score AS final_score_gap, b.consistency - a.consistency AS consistency_gap, b.agent - a.agent AS agent_gap
FROM r a JOIN r b ON b.session_id = a.session_id AND b.rank = 1 WHERE a.rank IN (2, 3)""")
def alternative_gaps(t):
    return k.alternative_gaps(k.trajectory_groups(trajectories(t)))


@query("rank_position_prior", f"WITH {SQL_R1} SELECT session_id, candidate_id, greatest(0.08::DOUBLE - (pool_rank - 1) * 0.02::DOUBLE, 0.0) AS prior FROM r1")
def rank_position_prior(t):
    return r1(t).select("session_id", "candidate_id", k.rank_prior(F.col("pool_rank")).alias("prior"))


@query("acceptance_decision", f"""
WITH {SQL_FOCUS},
x AS (SELECT CASE WHEN quantity = 50 THEN NULL WHEN verifier_called THEN 'llm_verifier' ELSE 'fallback' END AS mode, should_accept, reject_reason FROM focus)
SELECT coalesce(mode IN ('llm_verifier','observed_evidence_final_evaluator') AND should_accept, false) AS stop, CASE WHEN mode IS NULL THEN 'no_answer_score' WHEN mode = 'fallback' THEN 'verifier_not_ready'
 WHEN should_accept THEN 'final_answer_accepted' ELSE 'verifier_rejected_stop' END AS reason, CASE WHEN mode = 'llm_verifier' AND NOT should_accept THEN coalesce(reject_reason, 'missing_key_support') END AS repair_reason, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def acceptance_decision(t):
    f = focus(t).withColumn("mode", F.when(F.col("quantity") == 50, F.lit(None)).when(F.col("verifier_called"), "llm_verifier").otherwise("fallback"))
    d = k.acceptance_decision(F.col("mode"), F.col("should_accept"), F.col("reject_reason"))
    return f.groupBy(*[v.alias(n) for n, v in d.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("acceptance_guards", """
WITH x AS (SELECT l_returnflag = 'R' AS a, l_quantity / 50 AS s, l_discount * 5 AS b, l_linenumber - 6 AS m, CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END AS sup, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS sim FROM lineitem),
y AS (SELECT *, a AND (b >= 0.28 OR m > 0) AS sc, a AND sup = 0 AND sim > 0 AS al FROM x)
SELECT a AND NOT sc AND NOT al AS accept, CASE WHEN sc OR al THEN least(s, 0.64) ELSE s END AS score, CASE WHEN al THEN 'missing_key_support' WHEN sc THEN 'strong_alternative_not_ruled_out' END AS guard, count(*) AS n FROM y GROUP BY 1, 2, 3""")
def acceptance_guards(t):
    c = F.col
    g = k.acceptance_guards(c("l_returnflag") == "R", c("l_quantity") / 50, c("l_discount") * 5, c("l_linenumber") - 6,
                            F.when(c("l_tax") > 0.02, 1).otherwise(0), F.when(c("l_linestatus") == "F", 1).otherwise(0))
    return t.raw("lineitem").groupBy(*[v.alias(n) for n, v in g.items()]).agg(F.count(F.lit(1)).alias("n"))


@query("reason_codes", f"""
WITH {SQL_FOCUS},
x AS (SELECT should_accept AS a, quantity / 50 AS s, CASE WHEN cost = 'low' THEN 'key_support_sufficient' ELSE 'because' END AS ar, CASE WHEN grp = 'lab' THEN 'trajectory_insufficient' ELSE coalesce(reject_reason, '') END AS rr, (turn > 5)::INT AS na, turn AS nt FROM focus),
y AS (SELECT *, CASE WHEN rr IN ('missing_key_support','strong_alternative_not_ruled_out','trajectory_insufficient') THEN rr WHEN na > 0 THEN 'strong_alternative_not_ruled_out' WHEN nt <= 1 THEN 'trajectory_insufficient' ELSE 'missing_key_support' END AS reject_reason FROM x)
SELECT CASE WHEN ar = 'key_support_sufficient' THEN ar WHEN a AND s >= 0.9 THEN 'key_support_sufficient' WHEN a AND reject_reason = 'strong_alternative_not_ruled_out' THEN 'alternatives_reasonably_ruled_out' ELSE 'trajectory_stable' END AS accept_reason,
 CASE WHEN ar = 'key_support_sufficient' THEN 'llm_schema' ELSE 'fallback_inferred' END AS accept_source, reject_reason, CASE WHEN rr = reject_reason THEN 'llm_schema' ELSE 'fallback_inferred' END AS reject_source, count(*) AS n FROM y GROUP BY 1, 2, 3, 4""")
def reason_codes(t):
    c = F.col
    d = k.reason_codes(c("should_accept"), c("quantity") / 50, F.when(c("cost") == "low", "key_support_sufficient").otherwise("because"),
                       F.when(c("grp") == "lab", "trajectory_insufficient").otherwise(F.coalesce("reject_reason", F.lit(""))), (c("turn") > 5).cast("int"), c("turn"))
    return focus(t).select(*[v.alias(n) for n, v in d.items()]).groupBy(*d).agg(F.count(F.lit(1)).alias("n"))


@query("alternative_strength", """
WITH x AS (SELECT CASE WHEN l_quantity < 5 THEN ' High ' WHEN l_quantity < 9 THEN '弱' ELSE '' END AS s, CASE WHEN l_returnflag = 'R' THEN '仍不能排除该病' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '证据 不足' WHEN l_returnflag = 'A' THEN l_linestatus ELSE ' ' END AS r FROM lineitem),
y AS (SELECT CASE WHEN s = ' High ' THEN 'explicit_strong' WHEN s = '弱' THEN 'explicit_weak' WHEN r = '仍不能排除该病' THEN 'reason_strong' WHEN r = '证据 不足' THEN 'reason_weak' WHEN trim(r) = '' THEN 'no_reason' ELSE 'none' END AS strength_reason FROM x)
SELECT CASE WHEN strength_reason IN ('explicit_strong','reason_strong','no_reason') THEN 'strong' WHEN strength_reason IN ('explicit_weak','reason_weak') THEN 'weak' ELSE 'medium' END AS strength, strength_reason, count(*) AS n FROM y GROUP BY 1, 2""")
def alternative_strength(t):
    q = F.col("l_quantity")
    reason = (F.when(F.col("l_returnflag") == "R", "仍不能排除该病").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "证据 不足")
              .when(F.col("l_returnflag") == "A", F.col("l_linestatus")).otherwise(" "))
    d = k.alternative_strength(F.when(q < 5, " High ").when(q < 9, "弱").otherwise(""), reason)
    return t.raw("lineitem").select(*[v.alias(n) for n, v in d.items()]).groupBy(*d).agg(F.count(F.lit(1)).alias("n"))


SQL_RPOOL = """rp AS (SELECT session_id, candidate_id, candidate_name, score, pool_rank AS rank, pool_rank = 1 AS cur, pool_rank IN (2, 4) AS alt, CASE WHEN relation_count > 1 THEN 'missing_key_support' WHEN anchor100 > 80 THEN 'strong_alternative_not_ruled_out'
   WHEN anchor100 > 50 THEN 'hard_negative_key_evidence' ELSE 'trajectory_insufficient' END AS rr, feature_total AS times, anchor100 * 5000 AS exact, dirs * 1000 AS family, 0 AS phenotype FROM r1)"""


def repair_pool(t):
    c = F.col
    reason = (F.when(c("relation_count") > 1, "missing_key_support").when(c("anchor100") > 80, "strong_alternative_not_ruled_out")
              .when(c("anchor100") > 50, "hard_negative_key_evidence").otherwise("trajectory_insufficient"))
    return r1(t).select(
        "session_id", "candidate_id", "candidate_name", "score", c("pool_rank").alias("rank"), (c("pool_rank") == 1).alias("current"), c("pool_rank").isin(2, 4).alias("alternative"),
        reason.alias("reject_reason"), c("feature_total").alias("times"), (c("anchor100") * 5000).alias("exact"), (c("_dir") * 1000).alias("family"), F.lit(0).alias("phenotype"))


@query("verifier_repair_rerank", f"""
WITH {SQL_R1}, {SQL_RPOOL},
x AS (SELECT *, greatest(score + (CASE WHEN alt THEN greatest(0.35::DOUBLE - (rank - 1) * 0.05::DOUBLE, 0.175) + least(exact / 1000000 * 0.22 + family / 1000000 * 0.14 + phenotype / 1000000 * 0.04, 0.18) ELSE 0.0::DOUBLE END
  - CASE WHEN NOT cur THEN 0.0::DOUBLE WHEN rr = 'strong_alternative_not_ruled_out' THEN 0.25::DOUBLE WHEN rr = 'hard_negative_key_evidence' THEN 0.32::DOUBLE WHEN rr = 'missing_key_support' THEN 0.12::DOUBLE + least(times * 0.08::DOUBLE, 0.30) ELSE 0.08::DOUBLE END), 0.0) AS repaired FROM rp)
SELECT session_id, candidate_id, repaired, row_number() OVER (PARTITION BY session_id ORDER BY repaired DESC, candidate_name, candidate_id) AS repaired_rank FROM x""")
def verifier_repair_rerank(t):
    return k.verifier_repair(repair_pool(t)).select("session_id", "candidate_id", "repaired", "repaired_rank")


@query("escalate_competition", f"""
WITH {SQL_R1}, {SQL_RPOOL},
e AS (SELECT rp.session_id, candidate_id, candidate_name, rank, alt, rr, times, CASE WHEN rank = 1 AND exact < 300000 THEN 0 ELSE exact END AS exact, CASE WHEN rank = 1 AND exact < 300000 THEN 0 ELSE family END AS family,
  CASE WHEN exact > 400000 THEN 'strong_anchor' WHEN exact > 250000 THEN 'family_anchor' ELSE 'speculative' END AS tier, CASE WHEN contains(candidate_name, '3') THEN true ELSE false END AS costly FROM rp),
l AS (SELECT session_id, candidate_id AS leader, exact + family AS lo, exact AS le, times AS lt, costly AS lc FROM e WHERE rank = 1 AND rr = 'missing_key_support'),
v AS (SELECT e.*, leader, lo, lt, lc, exact + family > lo + 50000 OR exact > le + 50000 AS stronger FROM e JOIN l USING (session_id) WHERE rank > 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY exact DESC, exact + family DESC, family DESC, candidate_name, candidate_id) AS rival_rank FROM v WHERE stronger OR alt OR (tier IN ('strong_anchor','family_anchor') AND exact + family > 0)) WHERE rival_rank <= 3),
y AS (SELECT *, max(stronger) OVER (PARTITION BY session_id) AS any_stronger FROM b),
z AS (SELECT *, concat_ws(',', CASE WHEN lo <= 0 AND any_stronger THEN 'zero_anchor' END, CASE WHEN lt >= 2 THEN 'repeated_rejection' END, CASE WHEN lc AND any_stronger THEN 'costly_gap' END) AS reasons FROM y)
SELECT session_id, leader, candidate_id, rival_rank, reasons FROM z WHERE reasons <> ''""")
def escalate_competition(t):
    c = F.col
    weak = (c("rank") == 1) & (c("exact") < 300000)
    tier = F.when(c("exact") > 400000, "strong_anchor").when(c("exact") > 250000, "family_anchor").otherwise("speculative")
    asked = F.when(F.contains("candidate_name", F.lit("3")), "胸部 CT 报告").otherwise("既往史")
    p = repair_pool(t).withColumns({"anchor_tier": tier, "costly_gap": k.costly_evidence(asked)})
    p = p.withColumns({"exact": F.when(weak, 0).otherwise(c("exact")), "family": F.when(weak, 0).otherwise(c("family"))})
    return k.escalate(p.withColumn("observed", c("exact") + c("family")))


@query("remaining_low_cost", f"""
WITH {SQL_TOP3},
{SQL_R2.format(pool='top3')},
b AS (SELECT session_id, node_id, max(priority) AS priority, min(name) AS name FROM r2 WHERE mode IN ('direct_ask','history_known') AND cost <> 'high' GROUP BY 1, 2)
SELECT session_id, node_id, priority, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, name, node_id) AS rank FROM b) WHERE rank <= 12""")
def remaining_low_cost(t):
    rows = r.r2_evidence(top3(t), evidence(t), seen(t))
    return k.remaining_low_cost(rows).select("session_id", "node_id", "priority", "rank")
