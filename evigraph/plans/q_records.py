"""Queries over records, replies, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, graph
from ..operators import records as rc
from ..operators.cases import name_text
from ..sources import scan, sinks
from .q_graph import SQL_ALIAS, typed_edges
from .registry import query


def n_(cond):
    return f"CAST(coalesce(sum(({cond})::INT), 0) AS BIGINT)"


# Reply texts chosen by a line's quantity.
REPLIES = ((3, "有的。"), (6, "没有"), (9, "不太清楚，没注意"), (12, "会有一点"), (15, "无明显不适"), (18, "不确定吧"), (21, "上次报告 正常"), (24, "没有做过 检查"),
           (27, "CD4 150"), (30, "PaO2 85 mmHg"), (33, "BDG 120"), (36, "胸部CT 提示磨玻璃"), (39, "PCR 阳性"), (42, "血氧 偏低"), (45, "已经说过很多次了 真的不知道应该怎么回答这个问题呢"))


def reply():
    out = F.lit("说不上来")
    for q, text in reversed(REPLIES):
        out = F.when(F.col("l_quantity") <= q, text).otherwise(out)
    return out


SQL_REPLY = "CASE " + " ".join(f"WHEN l_quantity <= {q} THEN '{x}'" for q, x in REPLIES) + " ELSE '说不上来' END"


def replies(t):
    return t.raw("lineitem").groupBy(reply().alias("text"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


SQL_REPLIES = f"replies AS (SELECT {SQL_REPLY} AS text, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query("direct_reply_class", f"""
WITH {SQL_REPLIES}
SELECT text, flag, n, CASE text WHEN '有的。' THEN 'positive' WHEN '没有' THEN 'negative' WHEN '不太清楚，没注意' THEN 'uncertain' WHEN '会有一点' THEN 'positive' WHEN '无明显不适' THEN 'negative' WHEN '不确定吧' THEN 'uncertain'
 WHEN '没有做过 检查' THEN 'negative' WHEN '说不上来' THEN 'uncertain' END AS reply FROM replies""")
def direct_reply_class(t):
    return replies(t).withColumn("reply", rc.direct_reply(F.col("text")))


@query("answer_no_result_flag", f"""
WITH {SQL_REPLIES}
SELECT text, flag, n, text IN ('不太清楚，没注意', '没有做过 检查') AS no_result, text = '上次报告 正常' AS explicit_negative FROM replies""")
def answer_no_result_flag(t):
    f = rc.answer_flags(F.col("text"))
    return replies(t).select("text", "flag", "n", f["no_result"].alias("no_result"), f["explicit_negative"].alias("explicit_negative"))


@query("exam_result_class", f"""
WITH {SQL_REPLIES}
SELECT text, flag, n, CASE text WHEN '上次报告 正常' THEN 'negative' WHEN 'CD4 150' THEN 'low' WHEN 'PaO2 85 mmHg' THEN 'low' WHEN 'BDG 120' THEN 'negative' WHEN '胸部CT 提示磨玻璃' THEN 'positive' WHEN 'PCR 阳性' THEN 'positive' WHEN '血氧 偏低' THEN 'low' ELSE 'unknown' END AS direction,
 CASE text WHEN 'CD4 150' THEN 'CD4' WHEN 'PaO2 85 mmHg' THEN '血氧 / 动脉血气' WHEN 'BDG 120' THEN 'β-D 葡聚糖' WHEN '胸部CT 提示磨玻璃' THEN '胸部CT' WHEN 'PCR 阳性' THEN 'PCR' WHEN '血氧 偏低' THEN '血氧 / 动脉血气' ELSE '' END AS tests FROM replies""")
def exam_result_class(t):
    return replies(t).select("text", "flag", "n", rc.exam_result_class(F.col("text")).alias("direction"), F.concat_ws(",", rc.mentioned_tests(F.col("text"))).alias("tests"))


@query("exam_kind_sync", f"""
WITH x AS (SELECT l_orderkey AS session_id, l_linenumber AS turn, CASE l_returnflag WHEN 'A' THEN 'not_done' WHEN 'R' THEN 'done' ELSE 'unknown' END AS availability, {SQL_REPLY} AS text FROM lineitem),
k AS (SELECT *, unnest(CASE WHEN availability = 'not_done' THEN ['imaging','lab','pathogen'] WHEN availability = 'done' THEN CASE text WHEN 'CD4 150' THEN ['lab'] WHEN '胸部CT 提示磨玻璃' THEN ['imaging'] WHEN 'PCR 阳性' THEN ['pathogen'] ELSE [] END ELSE [] END) AS exam_kind FROM x)
SELECT session_id, exam_kind, availability, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def exam_kind_sync(t):
    a = F.when(F.col("l_returnflag") == "A", "not_done").when(F.col("l_returnflag") == "R", "done").otherwise("unknown")
    x = t.raw("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("turn"), a.alias("availability"), reply().alias("text"))
    return rc.exam_kind_sync(x).groupBy("session_id", "exam_kind", "availability").agg(F.count(F.lit(1)).alias("n"))


@query("exam_result_link", f"""
WITH x AS (SELECT o.session_id, 'R' || turn || '_' || o.pk AS result_id, e.grp AS family, CASE polarity WHEN 'present' THEN 'positive' WHEN 'absent' THEN 'negative' ELSE 'unknown' END AS direction
   FROM obs o JOIN kg_evidence e USING (node_id) WHERE e.grp IN ('lab','imaging','pathogen')),
c AS (SELECT DISTINCT o.session_id, o.node_id, e.grp AS family, e.w100 AS priority FROM obs o JOIN kg_evidence e USING (node_id)),
cr AS (SELECT *, row_number() OVER (PARTITION BY session_id, family ORDER BY priority DESC, node_id) AS lr FROM c),
j AS (SELECT x.session_id, x.result_id, cr.node_id, x.direction, lr FROM (SELECT DISTINCT * FROM x) x JOIN cr ON cr.session_id = x.session_id AND cr.family = x.family WHERE direction <> 'unknown' AND lr <= 3),
b AS (SELECT session_id, node_id, arg_min({{'r': result_id, 'd': direction}}, (lr, result_id, direction)) AS b FROM j GROUP BY 1, 2)
SELECT session_id, node_id, b.r AS result_id, CASE b.d WHEN 'negative' THEN 'absent' ELSE 'present' END AS polarity FROM b""")
def exam_result_link(t):
    o = t.obs.join(t.kg_evidence.select("node_id", "grp", "w100"), "node_id")
    d = F.when(F.col("polarity") == "present", "positive").when(F.col("polarity") == "absent", "negative").otherwise("unknown")
    res = o.where(F.col("grp").isin("lab", "imaging", "pathogen")).select(
        "session_id", F.concat_ws("_", F.concat(F.lit("R"), F.col("turn")), "pk").alias("result_id"), F.col("grp").alias("family"), d.alias("direction")).distinct()
    cand = o.select("session_id", "node_id", F.col("grp").alias("family"), F.col("w100").alias("priority")).distinct()
    return rc.exam_result_link(res, cand)


SQL_STYLE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'guarded' WHEN '2-HIGH' THEN 'concealing' ELSE 'cooperative' END"


@query("exam_truth_lookup", f"""
WITH k AS (SELECT o_orderkey AS case_id, unnest(CASE WHEN o_orderstatus = 'F' THEN ['general'] WHEN o_orderstatus = 'O' THEN ['lab'] ELSE ['imaging','pathogen'] END) AS exam_kind, {SQL_STYLE} AS style FROM orders)
SELECT k.case_id, k.exam_kind, count(*) AS n, min(s.node_id) AS first_slot FROM k JOIN (SELECT case_id, node_id, max(grp) AS grp, max(quantity) >= 30 AS hidden FROM replay_turn GROUP BY 1, 2) s USING (case_id)
WHERE (s.grp = k.exam_kind OR (k.exam_kind = 'general' AND s.grp IN ('lab','imaging','pathogen'))) AND NOT (hidden AND style IN ('guarded','concealing')) GROUP BY 1, 2""")
def exam_truth_lookup(t):
    o = t.raw("orders")
    kinds = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("general"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("lab"))).otherwise(F.array(F.lit("imaging"), F.lit("pathogen")))
    style = F.when(F.col("o_orderpriority") == "1-URGENT", "guarded").when(F.col("o_orderpriority") == "2-HIGH", "concealing").otherwise("cooperative")
    slots = t.replay_turn.groupBy("case_id", F.col("node_id").alias("slot_id")).agg(F.max("grp").alias("grp"), (F.max("quantity") >= 30).alias("hidden"))
    out = rc.exam_truths(slots, o.select(F.col("o_orderkey").alias("case_id"), F.explode(kinds).alias("exam_kind")), o.select(F.col("o_orderkey").alias("case_id"), style.alias("behavior_style")))
    return out.groupBy("case_id", "exam_kind").agg(F.count(F.lit(1)).alias("n"), F.min("slot_id").alias("first_slot"))


@query("target_mention", """
WITH m AS (SELECT o.session_id, o.turn, o.pk, o.sk, o.node_id, e.name FROM obs o JOIN kg_evidence e USING (node_id)),
a AS (SELECT session_id, turn, arg_max(node_id, (pk, sk)) AS last_node, arg_max(name, (pk, sk)) AS target_name, count(*) AS c FROM m GROUP BY 1, 2),
a2 AS (SELECT session_id, turn, CASE WHEN c > 1 THEN last_node || 'x' ELSE last_node END AS target_id, target_name FROM a),
h AS (SELECT a2.*, m.pk, m.sk, m.node_id, CASE WHEN m.node_id = target_id THEN 0 ELSE 1 END AS h FROM a2 JOIN m USING (session_id, turn) WHERE m.node_id = target_id OR replace(m.name, ' ', '') = replace(target_name, ' ', ''))
SELECT session_id, turn, target_id, arg_min(node_id, (h, pk, sk)) AS mention_node, CASE WHEN min(h) = 0 THEN 'id' ELSE 'alias' END AS matched_by FROM h GROUP BY 1, 2, 3""")
def target_mention(t):
    m = t.obs.join(t.kg_evidence.select("node_id", "name"), "node_id").withColumn("ord", F.struct("pk", "sk"))
    a = m.groupBy("session_id", "turn").agg(F.max_by("node_id", "ord").alias("last"), F.max_by("name", "ord").alias("target_name"), F.count(F.lit(1)).alias("c"))
    a = a.withColumn("target_id", F.when(F.col("c") > 1, F.concat("last", F.lit("x"))).otherwise(F.col("last")))
    return rc.target_mention(m, a)


# -- mentions -------------------------------------------------------------------------------------------

TEMPLATES = (("hot_rule", ("hot",), ("red ring", "red gear")), ("old_rule", ("old",), ("cold plate",)))


def mention_texts(t):
    return t.raw("part").select(F.explode(rc.split_mentions(F.concat_ws("，", "p_name", "p_brand"))).alias("mention")).distinct()


def surfaces(t):
    alias = graph.alias_index(t.alias_file.where("file = 1")).select(name_text(F.col("akey")).alias("akey"), "canonical").distinct()
    return rc.mention_surfaces(mention_texts(t), alias, TEMPLATES)


SQL_SURF = f"""{SQL_ALIAS.replace('FROM alias_file', 'FROM (SELECT * FROM alias_file WHERE file = 1)')},
mt AS (SELECT DISTINCT p_name AS mention FROM part UNION SELECT DISTINCT p_brand FROM part),
al AS (SELECT DISTINCT akey, canonical FROM alias),
sf0 AS (SELECT mention, coalesce(canonical, mention) AS surface, 'alias_normalization' AS rule, 0 AS o FROM mt LEFT JOIN al ON akey = replace(lower(mention), ' ', '')
  UNION ALL SELECT mention, mention, 'raw', 1 FROM mt UNION ALL SELECT mention, 'red ring', 'hot_rule', 2 FROM mt WHERE contains(mention, 'hot') UNION ALL SELECT mention, 'red gear', 'hot_rule', 3 FROM mt WHERE contains(mention, 'hot')
  UNION ALL SELECT mention, 'cold plate', 'old_rule', 12 FROM mt WHERE contains(mention, 'old')),
sf AS (SELECT mention, surface, arg_min(rule, o) AS rule FROM sf0 GROUP BY 1, 2)"""


@query("mention_expand", f"WITH {SQL_SURF} SELECT mention, surface, rule FROM sf")
def mention_expand(t):
    return surfaces(t)


def link_nodes(t):
    """Distinct evidence names as nodes, the noun as an alias."""
    p = t.raw("part").select("p_name").distinct()
    return p.select(F.concat(F.lit("N_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("node_id"), F.col("p_name").alias("name"), F.array(F.substring_index("p_name", " ", -1)).alias("aliases"))


@query("entity_candidates", """
WITH s AS (SELECT DISTINCT p_name AS surface FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT 'very ' || p_name || ' and ' || split_part(p_name, ' ', 1) FROM part),
n AS (SELECT DISTINCT 'N_' || replace(p_name, ' ', '_') AS node_id, p_name AS name, split_part(p_name, ' ', 2) AS alias FROM part),
c AS (SELECT surface, node_id, min(CASE WHEN surface = name OR surface = alias THEN 0 ELSE 1 END) AS how FROM s JOIN n ON surface = name OR surface = alias OR contains(surface, name) OR contains(name, surface) GROUP BY 1, 2)
SELECT surface, node_id, how, rank FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY how, node_id) AS rank FROM c) WHERE rank <= 5""")
def entity_candidates(t):
    p = t.raw("part")
    noun, head = F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    s = p.select(F.explode(F.array("p_name", noun, F.concat(F.lit("very "), "p_name", F.lit(" and "), head))).alias("surface"))
    return rc.entity_candidates(s, link_nodes(t), 5)


@query("entity_link")
def entity_link(t):
    return rc.entity_link(surfaces(t), link_nodes(t)).select("mention", "node_id", "similarity", "exact", "rule", "trusted")


# -- relation repair ---------------------------------------------------------------------------------------

def found_edges(t):
    """Edges of the first extraction: finished lines.  The open lines are the edges proposed later."""
    return typed_edges(t).where("linestatus = 'F'")


def suspicious(t):
    return rc.suspicious_nodes(t.chunk_node, found_edges(t))


SQL_SUS = """we AS (SELECT * FROM chunk_edge WHERE linestatus = 'F'),
ends AS (SELECT chunk_id, source_id AS id FROM we UNION SELECT chunk_id, target_id FROM we),
sus AS (SELECT n.* FROM chunk_node n WHERE NOT EXISTS (SELECT 1 FROM ends WHERE ends.chunk_id = n.chunk_id AND ends.id = n.local_id)),
one AS (SELECT chunk_id, local_id, max(label) AS label, max(name) AS name FROM chunk_node GROUP BY 1, 2)"""


@query("suspicious_nodes", f"""
WITH {SQL_SUS},
c AS (SELECT o.*, CASE WHEN s.local_id IS NOT NULL THEN 1000 ELSE 0 END + CASE WHEN label = 'Disease' THEN 180 ELSE 90 END + CASE WHEN label IN ('ClinicalFinding','LabFinding','ImagingFinding','RiskFactor') THEN 40 ELSE 0 END + least(length(name), 30) AS context_score
  FROM one o LEFT JOIN (SELECT DISTINCT chunk_id, local_id FROM sus) s USING (chunk_id, local_id))
SELECT chunk_id, local_id, context_score, context_rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY context_score DESC, label, name, local_id) AS context_rank FROM c) WHERE context_rank <= 3""")
def suspicious_nodes(t):
    return rc.context_nodes(t.chunk_node, suspicious(t), 3).select("chunk_id", "local_id", F.col("context_score").cast("bigint").alias("context_score"), "context_rank")


def proposed(t):
    """Proposed edges: the open lines of a chunk, some of them faulty."""
    q = F.col("quantity")
    s, p = F.concat(F.lit("S"), F.col("sk").cast("string")), F.concat(F.lit("P"), F.col("pk").cast("string"))
    return t.chunk_line.where("linestatus = 'O'").select(
        "chunk_id", F.struct("pos", "pk", "sk").alias("ord"), F.when(q == 11, F.lit(" ")).when(q == 12, p).when(F.col("rel") == "RISK_FACTOR_FOR", p).otherwise(s).alias("source_id"),
        F.when(q == 13, F.lit("nobody")).when(q == 12, p).when(F.col("rel") == "RISK_FACTOR_FOR", s).otherwise(p).alias("target_id"),
        F.when(q == 14, F.lit("LIKES")).when(q == 15, F.lit("COMPLICATED_BY")).otherwise(F.col("rel")).alias("type"), F.when(q != 16, F.col("p_name")).alias("evidence_text"), F.lit("").alias("condition"),
        (q / 20).alias("weight"), (F.col("node_w100") / 100).alias("confidence"), F.col("detail"))


SQL_PROP = f"""{SQL_SUS},
pp AS (SELECT chunk_id, (pos, pk, sk) AS ord, pos, pk, sk, CASE WHEN quantity = 11 THEN ' ' WHEN quantity = 12 THEN 'P' || pk WHEN rel = 'RISK_FACTOR_FOR' THEN 'P' || pk ELSE 'S' || sk END AS source_id,
  CASE WHEN quantity = 13 THEN 'nobody' WHEN quantity = 12 THEN 'P' || pk WHEN rel = 'RISK_FACTOR_FOR' THEN 'S' || sk ELSE 'P' || pk END AS target_id,
  CASE WHEN quantity = 14 THEN 'LIKES' WHEN quantity = 15 THEN 'COMPLICATED_BY' ELSE rel END AS type, CASE WHEN quantity <> 16 THEN p_name END AS evidence_text, quantity / 20 AS weight, node_w100 / 100 AS confidence, detail FROM chunk_line WHERE linestatus = 'O'),
su2 AS (SELECT DISTINCT chunk_id, local_id FROM sus),
pr AS (SELECT p.*, CASE WHEN trim(p.source_id) = '' THEN 'missing_endpoint_id' WHEN a.label IS NULL OR b.label IS NULL THEN 'unknown_node_id' WHEN x.local_id IS NULL AND y.local_id IS NULL THEN 'no_suspicious_endpoint'
   WHEN p.source_id = p.target_id THEN 'self_loop' WHEN p.type = 'LIKES' THEN 'invalid_edge_type' WHEN p.type = 'COMPLICATED_BY' THEN 'implausible_direction' WHEN p.evidence_text IS NULL THEN 'missing_evidence_text'
   WHEN EXISTS (SELECT 1 FROM we w WHERE w.chunk_id = p.chunk_id AND w.source_id = p.source_id AND w.target_id = p.target_id AND w.rel = p.type) THEN 'duplicate_edge' END AS r0
  FROM pp p LEFT JOIN one a ON a.chunk_id = p.chunk_id AND a.local_id = p.source_id LEFT JOIN one b ON b.chunk_id = p.chunk_id AND b.local_id = p.target_id
  LEFT JOIN su2 x ON x.chunk_id = p.chunk_id AND x.local_id = p.source_id LEFT JOIN su2 y ON y.chunk_id = p.chunk_id AND y.local_id = p.target_id),
p2 AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY chunk_id, source_id, type, target_id, r0 IS NULL ORDER BY pos, pk, sk) > 1 THEN 'duplicate_edge' ELSE r0 END AS r1 FROM pr),
p3 AS (SELECT *, CASE WHEN r1 IS NULL THEN row_number() OVER (PARTITION BY chunk_id, r1 IS NULL ORDER BY pos, pk, sk) END AS kr FROM p2),
san AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN kr <= 2 THEN 'kept' ELSE 'over_limit' END AS outcome FROM p3)"""


def sanitized(t):
    old = found_edges(t).withColumn("condition", F.lit(""))
    return rc.sanitize_added_edges(proposed(t), t.chunk_node, suspicious(t), old, 2)


@query("sanitize_added_edges", f"WITH {SQL_PROP} SELECT chunk_id, pos, pk, sk, least(weight, 1.0) AS weight, outcome FROM san")
def sanitize_added_edges(t):
    return sanitized(t).select("chunk_id", F.col("ord.pos").alias("pos"), F.col("ord.pk").alias("pk"), F.col("ord.sk").alias("sk"), "weight", "outcome")


@query("apply_repair", f"""
WITH {SQL_PROP},
gone AS (SELECT DISTINCT chunk_id, local_id FROM sus WHERE label = 'ClinicalAttribute'),
lf AS (SELECT DISTINCT chunk_id, local_id FROM chunk_node EXCEPT SELECT * FROM gone),
ad AS (SELECT s.* FROM san s JOIN lf a ON a.chunk_id = s.chunk_id AND a.local_id = s.source_id JOIN lf b ON b.chunk_id = s.chunk_id AND b.local_id = s.target_id WHERE outcome = 'kept' AND confidence >= 0.5)
SELECT c.chunk_id, coalesce(x.n, 0) AS added, coalesce(g.n, 0) AS dropped, CASE WHEN coalesce(x.n, 0) + coalesce(g.n, 0) > 0 THEN 'repaired' ELSE 'reviewed_no_change' END AS status, x.first_id
FROM (SELECT DISTINCT chunk_id FROM chunk_node) c LEFT JOIN (SELECT chunk_id, count(*) AS n, min('repair_edge_' || substr(sha1(chunk_id || '|' || source_id || '|' || type || '|' || target_id || '||' || evidence_text), 1, 12)) AS first_id FROM ad GROUP BY 1) x USING (chunk_id)
LEFT JOIN (SELECT chunk_id, count(*) AS n FROM gone GROUP BY 1) g USING (chunk_id)""")
def apply_repair(t):
    out = rc.apply_repair(t.chunk_node, found_edges(t), sanitized(t), suspicious(t).where("label = 'ClinicalAttribute'"), 0.5)
    first = out["added"].groupBy("chunk_id").agg(F.min("edge_id").alias("first_id"))
    return out["status"].join(first, "chunk_id", "left").select("chunk_id", "added", "dropped", "status", "first_id")


# -- sources and sinks ----------------------------------------------------------------------------------------

# Documents in a text file of the corpus.
FILE_DOCS = 500


@query("scan_corpus", "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY 1")
def scan_corpus(t):
    folder = sinks.scratch_folder(t.spark, "corpus")
    # Many bounded files per source, written by every task that reads documents: a file comes back as one row.
    t.raw("documents").select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", FILE_DOCS).text(folder)
    d = scan.scan_corpus(t.spark, folder, "*.txt")
    return d.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(F.sum(F.length("text")).alias("chars"))


@query("scan_tagged_jsonl", """
SELECT CASE WHEN o_totalprice > 400000 THEN 'bad_row' WHEN o_orderstatus = 'F' THEN 'chunk_result' WHEN o_orderstatus = 'O' THEN 'chunk_error' ELSE 'run_summary' END AS record_type, count(*) AS n FROM orders GROUP BY 1""")
def scan_tagged_jsonl(t):
    kind = F.when(F.col("o_orderstatus") == "F", "chunk_result").when(F.col("o_orderstatus") == "O", "chunk_error").otherwise("run_summary")
    rec = F.to_json(F.struct(kind.alias("record_type"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("status")))
    folder = sinks.scratch_folder(t.spark, "jsonl")
    t.raw("orders").select(F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("{broken "), F.col("o_orderkey").cast("string"))).otherwise(rec).alias("value")).write.text(folder)
    return scan.scan_tagged_jsonl(t.spark, folder)[1]


@query("scan_graph_json", """
SELECT 'node' AS kind, 'P' || p_partkey AS id, p_name AS name, p_size / 50 AS weight FROM part UNION ALL SELECT 'edge', 'e' || p_partkey, p_brand, NULL FROM part""")
def scan_graph_json(t):
    pid = F.col("p_partkey").cast("string")
    node = F.struct(F.concat(F.lit("P"), pid).alias("id"), F.lit("ClinicalFinding").alias("label"), F.col("p_name").alias("name"), (F.col("p_size") / 50).alias("weight"))
    edge = F.struct(F.concat(F.lit("e"), pid).alias("id"), F.lit("MANIFESTS_AS").alias("type"), F.col("p_brand").alias("source_id"), F.concat(F.lit("P"), pid).alias("target_id"))
    folder = sinks.scratch_folder(t.spark, "graph")
    t.raw("part").select(F.to_json(F.struct(F.array(node).alias("nodes"), F.array(edge).alias("edges"))).alias("value")).write.text(folder)
    n, e, _ = scan.scan_graph_json(t.spark, folder, multi_line=False)
    return n.select(F.lit("node").alias("kind"), "id", "name", "weight").unionByName(e.select(F.lit("edge").alias("kind"), "id", F.col("source_id").alias("name"), F.lit(None).cast("double").alias("weight")))


@query("scan_graph_objects", """
SELECT 'node' AS kind, 'P' || p_partkey AS id, p_name AS name, p_size / 50 AS weight FROM part UNION ALL SELECT 'edge', 'e' || p_partkey, p_brand, NULL FROM part
UNION ALL SELECT 'summary', p_brand || ' ' || (p_partkey // 200), CAST(count(*) AS VARCHAR), NULL FROM part GROUP BY p_brand, p_partkey // 200""")
def scan_graph_objects(t):
    """Graph files of one object each, parts in files of bounded size."""
    pid = F.col("p_partkey").cast("string")
    node = F.struct(F.concat(F.lit("P"), pid).alias("id"), F.lit("ClinicalFinding").alias("label"), F.col("p_name").alias("name"), (F.col("p_size") / 50).alias("weight"))
    edge = F.struct(F.concat(F.lit("e"), pid).alias("id"), F.lit("MANIFESTS_AS").alias("type"), F.col("p_brand").alias("source_id"), F.concat(F.lit("P"), pid).alias("target_id"))
    part = t.raw("part").withColumn("file", F.floor(F.col("p_partkey") / 200))
    brands = part.groupBy("file", "p_brand").count().groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(" ", "p_brand", F.col("file").cast("string")), F.col("count").cast("string")))).alias("summary"))
    graph_file = part.groupBy("file").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges")).join(brands, "file")
    folder = sinks.scratch_folder(t.spark, "graph-objects")
    graph_file.select("file", F.to_json(F.struct("nodes", "edges", "summary")).alias("value")).repartition("file").write.partitionBy("file").text(folder)
    n, e, s = scan.scan_graph_objects(t.spark, folder)
    none = F.lit(None).cast("double").alias("weight")
    return n.select(F.lit("node").alias("kind"), "id", "name", "weight").unionByName(
        e.select(F.lit("edge").alias("kind"), "id", F.col("source_id").alias("name"), none)).unionByName(
        s.select(F.lit("summary").alias("kind"), F.col("key").alias("id"), F.col("value").alias("name"), none))


@query("scan_alias_rules", """
WITH k AS (SELECT label, regexp_replace(lower(alias), '\\s+', '', 'g') AS akey, canonical FROM alias_file UNION SELECT label, regexp_replace(lower(canonical), '\\s+', '', 'g'), canonical FROM alias_file
  UNION SELECT label, regexp_replace(lower(name), '\\s+', '', 'g'), 'DELETE' FROM delete_name)
SELECT label, akey, count(*) AS n_canonical, min(canonical) AS first_canonical, max(canonical) AS last_canonical FROM k GROUP BY 1, 2 HAVING count(*) > 1""")
def scan_alias_rules(t):
    file = F.concat(F.lower("label"), F.lit("_"), F.col("file").cast("string"), F.lit(".json"))
    groups = t.alias_file.select(file.alias("file"), "label", F.to_json(F.struct(F.array(F.struct(F.col("canonical").alias("canonical_name"), F.array("alias").alias("aliases"))).alias("merge_groups"))).alias("value"))
    drops = t.delete_name.select(F.lit("clinicalattribute_1.json").alias("file"), "label", F.to_json(F.struct(F.array("name").alias("DELETE"))).alias("value"))
    rows = groups.unionByName(drops).select("file", F.from_json("value", scan.ALIAS_FILE).alias("p")).select("file", "p.*")
    labels = {f"{x.lower()}_{i}.json": x for x in ("ClinicalFinding", "RiskFactor", "ClinicalAttribute", "LabFinding", "ImagingFinding", "Pathogen") for i in (1, 2)}
    alias, delete = scan.alias_rows(rows, labels)
    return graph.alias_conflicts(alias, delete)


@query("scan_reclass_rules", "SELECT label, name, action FROM reclass_rule")
def scan_reclass_rules(t):
    rows = t.reclass_rule.select(F.to_json(F.create_map("label", F.create_map("action", F.array("name")))).alias("value"))
    return scan.reclass_rows(rows)


@query("reclass_conflicts", """
WITH r AS (SELECT label, lower(replace(name, ' ', '')) AS akey, action FROM reclass_rule UNION SELECT label, lower(replace(name, ' ', '')), 'DELETE' FROM reclass_rule WHERE name LIKE '%ring')
SELECT label, akey, count(*) AS n_action FROM r GROUP BY 1, 2 HAVING count(*) > 1""")
def reclass_conflicts(t):
    r = t.reclass_rule
    return graph.reclass_conflicts(r.unionByName(r.where(F.col("name").endswith("ring")).withColumn("action", F.lit("DELETE"))))


@query("scan_cases", """
SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS case_id, 'P' || l_partkey AS slot_id, CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END AS value, l_linestatus AS grp FROM lineitem""")
def scan_cases(t):
    sid = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    slot = F.struct(sid.alias("node_id"), F.when(F.col("l_returnflag") == "R", "true").otherwise("false").alias("value"), F.col("l_linestatus").alias("group"))
    case = F.struct(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("case_id"), F.create_map(sid, slot).alias("slot_truth_map"))
    folder = sinks.scratch_folder(t.spark, "cases")
    t.raw("lineitem").select(F.to_json(case).alias("value")).write.text(folder)
    return scan.scan_cases(t.spark, folder)[1].select("case_id", "slot_id", "value", "grp")


KINDS = (("purchase.jsonl", "replay", 1), ("signup.jsonl", "cases", 2), ("view.jsonl", "status", 4))


@query("scan_run_outputs", """
SELECT '/runs/u' || user_id AS run, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 4 END) AS detail, max(ts) AS changed_at,
 concat_ws(',', max(CASE WHEN event_type = 'signup' THEN 'cases' END), max(CASE WHEN event_type = 'purchase' THEN 'replay' END), max(CASE WHEN event_type = 'view' THEN 'status' END)) AS kinds
FROM events WHERE event_type IN ('purchase','signup','view') GROUP BY 1""")
def scan_run_outputs(t):
    files = t.raw("events").select(F.concat(F.lit("/runs/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".jsonl")).alias("path"), F.col("ts").alias("modificationTime"))
    return scan.rank_runs(files, KINDS)


@query("retry_selection", """
WITH e AS (SELECT l_orderkey AS chunk_id, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'timeout' WHEN 'A' THEN 'schema' ELSE 'other' END AS error_type, CASE WHEN l_quantity < 10 THEN '  ' ELSE 'text ' || l_partkey END AS chunk_text FROM lineitem),
x AS (SELECT chunk_id, arg_max({'e': error_type, 't': chunk_text}, (l_linenumber, l_partkey, l_suppkey)) AS b FROM e WHERE error_type IN ('timeout','schema') GROUP BY 1)
SELECT chunk_id, b.e AS error_type, b.t AS chunk_text FROM x WHERE trim(b.t) <> ''""")
def retry_selection(t):
    e = t.raw("lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", "timeout").when(F.col("l_returnflag") == "A", "schema").otherwise("other").alias("error_type"),
        F.when(F.col("l_quantity") < 10, "  ").otherwise(F.concat(F.lit("text "), F.col("l_partkey").cast("string"))).alias("chunk_text"))
    return scan.retry_selection(e, ["timeout", "schema"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("chunk_id", "error_type", "chunk_text")


@query("append_results_sink", "SELECT status, count(*) AS n, CAST(sum(total_cents) AS BIGINT) AS total_cents FROM replay GROUP BY 1")
def append_results_sink(t):
    folder = sinks.scratch_folder(t.spark, "results")
    sinks.append_results(t.replay.where("status = 'completed'"), folder)
    sinks.append_results(t.replay.where("status <> 'completed'"), folder)
    return t.spark.read.parquet(folder).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("total_cents").alias("total_cents"))


@query("drop_edges_of", """
WITH gone AS (SELECT DISTINCT chunk_id, local_id FROM chunk_node WHERE label = 'LabFinding')
SELECT rel AS type, count(*) AS n FROM chunk_edge e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.chunk_id = e.chunk_id AND (g.local_id = e.source_id OR g.local_id = e.target_id)) GROUP BY 1""")
def drop_edges_of(t):
    gone = t.chunk_node.where("label = 'LabFinding'").select("chunk_id", F.col("local_id").alias("node_id"))
    return checks.drop_edges_of(typed_edges(t), gone).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
