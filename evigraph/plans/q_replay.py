"""Queries over recorded sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import Order
from ..functions.tags import tags
from ..operators import replay as rp
from .q_retrieve import once
from .registry import query

ORD = ["turn", "pk", "sk"]
SQL_ORD = "(turn, pk, sk)"
# turn, then part key in steps of 4096: never decreases along (turn, pk, sk)
TURNS = Order(keys=("case_id",), by=("turn", "pk", "sk"), slices=("turn", "floor(pk / 4096)"))

# Family words that occur in the part names.
FAMILIES = (("thermal", ("hot", "cold")), ("age", ("old", "new")), ("scale", ("small", "large")),
            ("metal", ("bolt", "gear", "rod", "ring")), ("color", ("red", "blue")))
REQUIRED = (("competitive", 1, "thermal"), ("competitive", 1, "age"), ("competitive", 2, "metal"),
            ("exam_driven", 1, "scale"), ("low_cost", 1, "color"), ("low_cost", 2, "thermal"), ("low_cost", 3, "metal"))

SQL_FAM = """fam AS (SELECT * FROM (VALUES ('thermal','hot'),('thermal','cold'),('age','old'),('age','new'),('scale','small'),('scale','large'),
  ('metal','bolt'),('metal','gear'),('metal','rod'),('metal','ring'),('color','red'),('color','blue')) v(family, word))"""
SQL_REQ = "req AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}',{b},'{c}')" for a, b, c in REQUIRED) + ") v(case_type, group_no, family))"
SQL_NAMES = f"""ans0 AS (SELECT case_id, arg_max(answer_name, {SQL_ORD}) FILTER (WHERE accepted) AS best, arg_max(answer_name, {SQL_ORD}) AS last_name,
   count(*) AS n_turns, count(DISTINCT revealed_id) AS n_revealed FROM replay_turn GROUP BY 1),
res AS (SELECT r.*, coalesce(a.best, CASE WHEN price > 100000 THEN a.last_name END, '') AS answer,
   CASE WHEN a.best IS NOT NULL AND status <> 'failed' THEN 'final_answer_accepted' ELSE status END AS stop_reason,
   coalesce(n_turns, 0) AS n_turns, coalesce(n_revealed, 0) AS n_revealed FROM replay r LEFT JOIN ans0 a USING (case_id)),
truth AS (SELECT DISTINCT case_id, answer_name AS name FROM replay_turn WHERE quantity >= 45
   UNION SELECT case_id, arg_max(answer_name, (cents, turn, pk, sk)) FROM replay_turn GROUP BY 1),
hyp AS (SELECT case_id, answer_name AS name, row_number() OVER (PARTITION BY case_id ORDER BY quantity DESC, turn, pk, sk) AS rank FROM replay_turn)"""
SQL_HIT = """SELECT n.case_id, max(n.name = t.name) AS exact_hit, max(contains(replace(n.name, ' ', ''), replace(t.name, ' ', ''))
   OR contains(replace(t.name, ' ', ''), replace(n.name, ' ', ''))) AS family_hit FROM {names} n JOIN truth t USING (case_id) GROUP BY 1"""
SQL_FACTS = f"""{SQL_NAMES},
ah AS ({SQL_HIT.format(names="(SELECT case_id, answer AS name FROM res WHERE answer <> '')")}),
hh AS ({SQL_HIT.format(names='hyp')}), h3 AS ({SQL_HIT.format(names='(SELECT * FROM hyp WHERE rank <= 3)')}),
flags AS (SELECT DISTINCT case_id, node_id FROM replay_turn WHERE quantity >= 48),
seen AS (SELECT DISTINCT case_id, node_id FROM replay_turn WHERE revealed_id IS NOT NULL OR accepted),
rf AS (SELECT f.case_id, count(*) AS red_flags, max(s.node_id IS NOT NULL) AS red_flag_hit FROM flags f LEFT JOIN seen s USING (case_id, node_id) GROUP BY 1),
facts AS (SELECT res.*, coalesce(ah.exact_hit, false) AS exact_hit, coalesce(ah.family_hit, false) AS family_hit,
  coalesce(hh.family_hit, false) AS hypothesis_hit, coalesce(h3.family_hit, false) AS top3_hit, answer <> '' AS has_answer,
  coalesce(status = 'completed' OR stop_reason = 'final_answer_accepted', false) AS accepted, coalesce(red_flags, 0) AS red_flags,
  coalesce(red_flag_hit, false) AS red_flag_hit
  FROM res LEFT JOIN ah USING (case_id) LEFT JOIN hh USING (case_id) LEFT JOIN h3 USING (case_id) LEFT JOIN rf USING (case_id))"""


def n_(cond):
    return f"CAST(coalesce(sum(({cond})::INT), 0) AS BIGINT)"


SQL_BENCH = f"""count(*) AS case_count, {n_("status = 'completed'")} AS completed_count, {n_("status = 'max_turn_reached'")} AS max_turn_reached_count,
  {n_('hypothesis_hit')} AS hypothesis_hit_count, {n_('top3_hit')} AS top3_hypothesis_hit_count, {n_('has_answer')} AS final_answer_count,
  {n_('exact_hit')} AS final_answer_exact_hit_count, {n_('family_hit')} AS final_answer_family_hit_count, {n_('accepted')} AS accepted_final_answer_count,
  {n_('accepted AND exact_hit')} AS accepted_exact_hit_count, {n_('accepted AND family_hit')} AS accepted_family_hit_count,
  {n_('NOT accepted AND exact_hit')} AS top_exact_correct_but_rejected_count, {n_('NOT accepted AND family_hit')} AS top_family_correct_but_rejected_count,
  {n_('red_flags > 0')} AS red_flag_case_count, {n_('red_flag_hit')} AS red_flag_hit_count,
  {n_("status = 'completed'")} / count(*) AS completion_rate, sum(n_turns) / count(*) AS average_turns, sum(n_revealed) / count(*) AS average_revealed_slots,
  {n_('hypothesis_hit')} / count(*) AS hypothesis_hit_rate, {n_('top3_hit')} / count(*) AS top3_hypothesis_hit_rate,
  {n_('exact_hit')} / count(*) AS final_answer_exact_hit_rate, {n_('family_hit')} / count(*) AS final_answer_family_hit_rate,
  coalesce({n_('accepted AND exact_hit')} / nullif({n_('accepted')}, 0), 0.0) AS accepted_exact_accuracy,
  coalesce({n_('accepted AND family_hit')} / nullif({n_('accepted')}, 0), 0.0) AS accepted_family_accuracy,
  {n_('accepted')} - {n_('accepted AND exact_hit')} AS wrong_accepted_count, {n_('accepted')} - {n_('accepted AND family_hit')} AS family_wrong_accepted_count,
  coalesce({n_('red_flag_hit')} / nullif({n_('red_flags > 0')}, 0), 0.0) AS red_flag_hit_rate"""


# -- DataFrames behind the checks --------------------------------------------------------------------

def results(t):
    """Cases with final answer and stop reason."""
    a = t.replay_turn.groupBy("case_id").agg(
        F.max_by(F.when(F.col("accepted"), F.col("answer_name")), F.when(F.col("accepted"), F.struct(*ORD))).alias("best"),
        F.max_by("answer_name", F.struct(*ORD)).alias("last_name"))
    out = t.replay.join(a, "case_id", "left")
    none = F.lit("")
    return out.withColumns({
        "answer": rp.final_answer(F.col("best"), F.when(F.col("price") > 100000, F.col("last_name")), none, none),
        "stop_reason": F.when(F.col("best").isNotNull() & (F.col("status") != "failed"), rp.ACCEPTED).otherwise(F.col("status"))})


def truths(t):
    tr = t.replay_turn
    many = tr.where("quantity >= 45").select("case_id", F.col("answer_name").alias("name"))
    one = tr.groupBy("case_id").agg(F.max_by("answer_name", F.struct("cents", *ORD)).alias("name"))
    return many.unionByName(one).distinct()


def hypotheses(t):
    """Hypotheses by quantity; only the first three ranks are ever read, the rest just exist."""
    from ..operators.retrieve import top_k

    tr = t.replay_turn.select("case_id", F.col("answer_name").alias("name"), "quantity", *ORD)
    top = top_k(tr, ["case_id"], [F.desc("quantity"), *[F.col(o) for o in ORD]], 3).select("case_id", "name", "rank")
    return top.unionByName(tr.select("case_id", "name", F.lit(4).alias("rank")))


def facts(t):
    tr = t.replay_turn
    flags = tr.where("quantity >= 48").select("case_id", F.col("node_id").alias("name"))
    confirmed = tr.where("accepted").select("case_id", F.col("node_id").alias("name"))
    return rp.case_facts(results(t), tr, truths(t), hypotheses(t), flags, confirmed)


def slots(t):
    value = F.when(F.col("truth_hit"), "positive").when(F.col("quantity") >= 25, "3.5").otherwise(F.when(F.col("quantity") > 10, "阴性").otherwise(" Absent "))
    return t.replay_turn.select("case_id", F.col("node_id").alias("slot_id"), "grp", "answer_name", value.alias("value")).groupBy(
        "case_id", "slot_id").agg(F.max("grp").alias("grp"), F.max("answer_name").alias("answer_name"), F.max("value").alias("value"))


SQL_SLOTS = """slots AS (SELECT case_id, node_id AS slot_id, max(grp) AS grp, max(answer_name) AS answer_name, max(CASE WHEN truth_hit THEN 'positive'
  WHEN quantity >= 25 THEN '3.5' WHEN quantity > 10 THEN '阴性' ELSE ' Absent ' END) AS value FROM replay_turn GROUP BY 1, 2),
sp AS (SELECT *, value IN ('positive', '3.5') AS pos FROM slots),
opening AS (SELECT DISTINCT case_id, node_id AS slot_id FROM replay_turn WHERE turn = 1),
reveal AS (SELECT DISTINCT case_id, revealed_id AS slot_id FROM replay_turn WHERE revealed_id IS NOT NULL)"""


def opening(t):
    return t.replay_turn.where("turn = 1").select("case_id", F.col("node_id").alias("slot_id")).distinct()


def revealed(t):
    return t.replay_turn.where("revealed_id IS NOT NULL").select("case_id", F.col("revealed_id").alias("slot_id")).distinct()


# -- answers and facts ------------------------------------------------------------------------------

@query("final_answer", f"WITH {SQL_NAMES} SELECT case_id, answer FROM res")
def final_answer(t):
    return results(t).select("case_id", "answer")


@query("name_match", f"WITH {SQL_FACTS} SELECT case_id, exact_hit, family_hit FROM ah WHERE family_hit")
def name_match(t):
    a = results(t).where("answer <> ''").select("case_id", F.col("answer").alias("name"))
    return rp.name_match(a, truths(t))


@query("similar_names", """
WITH nm AS (SELECT DISTINCT p_name AS name FROM part), typo AS (SELECT DISTINCT p_name AS right_name,
  CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, k) || substr(p_name, k + 2) WHEN 1 THEN substr(p_name, 1, k) || 'q' || substr(p_name, k + 1)
    ELSE substr(p_name, 1, k) || 'q' || substr(p_name, k + 2) END AS left_name
  FROM (SELECT *, (p_partkey // 3) % length(p_name) AS k FROM part)),
l AS (SELECT DISTINCT left_name FROM typo),
prs AS (SELECT l.left_name, nm.name AS right_name, length(l.left_name) AS a, length(nm.name) AS b, levenshtein(l.left_name, nm.name) AS d FROM l, nm),
-- one edit: all but the edited characters match; names of up to 13 characters with two edits stay below the border
one AS (SELECT left_name, right_name, 2.0::DOUBLE * (CASE WHEN a = b THEN a - d ELSE least(a, b) END) / (a + b) AS ratio FROM prs WHERE d <= 1)
SELECT left_name, right_name, ratio FROM one WHERE ratio >= 0.92::DOUBLE""")
def similar_names(t):
    """Names with a missing, an added or a replaced letter against the clean ones."""
    from ..functions.names import similar_pairs

    part = t.raw("part").select("p_name", "p_partkey", F.pmod(F.floor(F.col("p_partkey") / 3), F.length("p_name")).cast("int").alias("k"))
    head = F.substr("p_name", F.lit(1), F.col("k"))
    tail = lambda n: F.substr("p_name", F.col("k") + n, F.length("p_name"))
    kind = F.col("p_partkey") % 3
    typo = F.when(kind == 0, F.concat(head, tail(2))).when(kind == 1, F.concat(head, F.lit("q"), tail(1))).otherwise(F.concat(head, F.lit("q"), tail(2)))
    return similar_pairs(part.select(typo.alias("name")), part.select(F.col("p_name").alias("name")), 0.92)


@query("truth_positive", f"WITH {SQL_SLOTS} SELECT grp, value, pos, count(*) AS n FROM sp GROUP BY 1, 2, 3")
def truth_positive(t):
    return slots(t).groupBy("grp", "value", rp.truth_positive(F.col("value")).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


@query("revealed_slots", "SELECT case_id, count(DISTINCT revealed_id) AS n_revealed FROM replay_turn WHERE revealed_id IS NOT NULL GROUP BY 1")
def revealed_slots(t):
    return rp.revealed_slots(t.replay_turn)


@query("red_flag_hit", f"WITH {SQL_FACTS} SELECT case_id, red_flags, red_flag_hit FROM rf")
def red_flag_hit(t):
    tr = t.replay_turn
    name = F.col("node_id").alias("name")
    return rp.red_flag_hit(tr.where("quantity >= 48").select("case_id", name), tr.where("accepted").select("case_id", name),
                           tr.where("revealed_id IS NOT NULL").select("case_id", F.col("revealed_id").alias("name")))


@query("benchmark_summary", f"WITH {SQL_FACTS} SELECT {SQL_BENCH} FROM facts")
def benchmark_summary(t):
    return rp.benchmark_summary(facts(t))


@query("status_breakdown", "SELECT status, count(*) AS n FROM replay GROUP BY 1")
def status_breakdown(t):
    return rp.status_breakdown(t.replay)


@query("cohort_summary", f"""
WITH {SQL_FACTS},
k AS (SELECT facts.*, 'overall' AS cohort, '' AS cohort_value FROM facts
  UNION ALL SELECT *, 'case_qc_status', CASE case_qc_status WHEN '' THEN 'unknown' ELSE case_qc_status END FROM facts
  UNION ALL SELECT *, 'benchmark_qc_status', CASE benchmark_qc_status WHEN '' THEN 'unknown' ELSE benchmark_qc_status END FROM facts
  UNION ALL SELECT *, 'case_type', CASE case_type WHEN '' THEN 'unknown' ELSE case_type END FROM facts)
SELECT cohort, cohort_value, {SQL_BENCH} FROM k GROUP BY 1, 2""")
def cohort_summary(t):
    return rp.cohort_summary(facts(t))


@query("field_coverage", """
SELECT 'case_qc_status' AS field, CAST(sum((case_qc_status <> '')::INT) AS BIGINT) AS populated_count, CAST(sum((case_qc_status = '')::INT) AS BIGINT) AS missing_count FROM replay
UNION ALL SELECT 'benchmark_qc_status', sum((benchmark_qc_status <> '')::INT)::BIGINT, sum((benchmark_qc_status = '')::INT)::BIGINT FROM replay
UNION ALL SELECT 'case_type', sum((case_type <> '')::INT)::BIGINT, sum((case_type = '')::INT)::BIGINT FROM replay""")
def field_coverage(t):
    return rp.field_coverage(t.replay, ["case_qc_status", "benchmark_qc_status", "case_type"])


# -- analysis ------------------------------------------------------------------------------------------

@query("turn_observation", f"""
WITH {SQL_SLOTS}
SELECT r.case_id, r.turn, r.pk, r.sk, s.slot_id IS NOT NULL AS truth_hit, s.grp AS revealed_group, s.pos AS revealed_positive
FROM replay_turn r LEFT JOIN sp s ON s.case_id = r.case_id AND s.slot_id = r.revealed_id""")
def turn_observation(t):
    return rp.turn_observation(t.replay_turn, slots(t)).select("case_id", *ORD, "truth_hit", "revealed_group", "revealed_positive")


SQL_CASEAN = f"""{SQL_SLOTS},
qa AS (SELECT case_id, grp, count(*) AS questions, {n_('truth_hit')} AS truth_hits FROM replay_turn GROUP BY 1, 2),
sa AS (SELECT s.case_id, s.grp, count(*) AS truths, {n_('pos')} AS positive, {n_('NOT pos')} AS negative,
  {n_('o.slot_id IS NOT NULL')} AS opening, {n_('o.slot_id IS NOT NULL AND pos')} AS opening_positive, {n_('o.slot_id IS NULL')} AS askable,
  {n_('o.slot_id IS NULL AND pos')} AS askable_positive, {n_('v.slot_id IS NOT NULL')} AS revealed, {n_('v.slot_id IS NOT NULL AND pos')} AS revealed_positive,
  {n_('o.slot_id IS NOT NULL OR v.slot_id IS NOT NULL')} AS covered, {n_('(o.slot_id IS NOT NULL OR v.slot_id IS NOT NULL) AND pos')} AS covered_positive
  FROM sp s LEFT JOIN opening o USING (case_id, slot_id) LEFT JOIN reveal v USING (case_id, slot_id) GROUP BY 1, 2)"""


@query("case_analysis", f"WITH {SQL_CASEAN} SELECT sa.*, questions, truth_hits FROM sa JOIN qa USING (case_id, grp)")
def case_analysis(t):
    q = rp.question_counts(t.replay_turn).groupBy("case_id", "grp").agg(F.sum("questions").alias("questions"), F.sum("truth_hits").alias("truth_hits"))
    return rp.slot_analysis(slots(t), opening(t), revealed(t)).join(q, ["case_id", "grp"])


@query("analysis_summary", f"""
WITH {SQL_CASEAN},
g AS (SELECT unnest(['symptom','risk','lab','imaging','pathogen','detail','exam_context','unknown']) AS grp),
x AS (SELECT g.grp, coalesce(questions, 0) AS questions, coalesce(truth_hits, 0) AS truth_hits, coalesce(askable_positive, 0) AS askable_positive,
  coalesce(revealed_positive, 0) AS revealed_positive, coalesce(ca, 0) AS cases_with_askable, coalesce(cz, 0) AS cases_zero_revealed FROM g
  LEFT JOIN (SELECT grp, sum(questions)::BIGINT AS questions, sum(truth_hits)::BIGINT AS truth_hits FROM qa GROUP BY 1) q USING (grp)
  LEFT JOIN (SELECT grp, sum(askable_positive)::BIGINT AS askable_positive, sum(revealed_positive)::BIGINT AS revealed_positive,
    {n_('askable_positive > 0')} AS ca, {n_('askable_positive > 0 AND revealed_positive <= 0')} AS cz FROM sa GROUP BY 1) s USING (grp))
SELECT *, truth_hits / nullif(questions, 0) AS truth_hit_rate, revealed_positive / nullif(askable_positive, 0) AS coverage_rate FROM x""")
def analysis_summary(t):
    return rp.analysis_by_group(rp.question_counts(t.replay_turn), rp.slot_analysis(slots(t), opening(t), revealed(t)))


def families(t, ids):
    s = slots(t).where(rp.truth_positive(F.col("value"))).join(ids, ["case_id", "slot_id"], "left_semi")
    return s.select("case_id", F.explode(tags(F.col("answer_name"), FAMILIES)).alias("family")).distinct()


@query("required_groups_covered", f"""
WITH {SQL_SLOTS}, {SQL_FAM}, {SQL_REQ},
o AS (SELECT DISTINCT s.case_id, family FROM sp s JOIN opening USING (case_id, slot_id) JOIN fam ON contains(answer_name, word) WHERE pos),
a AS (SELECT DISTINCT s.case_id, family FROM sp s JOIN (SELECT * FROM opening UNION SELECT * FROM reveal) USING (case_id, slot_id) JOIN fam ON contains(answer_name, word) WHERE pos),
oc AS (SELECT case_id, count(DISTINCT group_no) AS n FROM o JOIN replay USING (case_id) JOIN req USING (case_type, family) GROUP BY 1),
ac AS (SELECT case_id, count(DISTINCT group_no) AS n FROM a JOIN replay USING (case_id) JOIN req USING (case_type, family) GROUP BY 1),
g AS (SELECT case_type, count(DISTINCT group_no) AS n FROM req GROUP BY 1)
SELECT r.case_id, r.case_type, coalesce(g.n, 0) AS required_groups, coalesce(oc.n, 0) AS covered_on_opening, coalesce(ac.n, 0) AS covered_after,
  greatest(coalesce(ac.n, 0) - coalesce(oc.n, 0), 0) AS coverage_gain, coalesce(g.n, 0) - coalesce(ac.n, 0) AS missing_after
FROM replay r LEFT JOIN g USING (case_type) LEFT JOIN oc USING (case_id) LEFT JOIN ac USING (case_id)""")
def required_groups_covered(t):
    req = t.spark.createDataFrame(list(REQUIRED), "case_type string, group_no int, family string")
    both = opening(t).unionByName(revealed(t)).distinct()
    return rp.required_coverage(t.replay, F.broadcast(req), families(t, opening(t)), families(t, both))


# -- timing ------------------------------------------------------------------------------------------------

def timing(t):
    a = t.replay_turn.groupBy("case_id").agg(
        F.sum("cents").alias("turns"), F.sum("quantity").alias("answers"), F.min("cents").alias("opening"), F.max("cents").alias("initial"))
    return t.replay.join(a, "case_id").select(
        "case_id", F.col("total_cents").alias("total"), "opening", "initial", "answers", "turns", F.lit(0).cast("bigint").alias("finalize"))


SQL_TIMING = """timing AS (SELECT r.case_id, r.total_cents AS total, min(cents) AS opening, max(cents) AS initial, sum(quantity)::BIGINT AS answers, sum(cents)::BIGINT AS turns
  FROM replay r JOIN replay_turn t USING (case_id) GROUP BY 1, 2)"""


@query("timing_summary", f"""
WITH {SQL_TIMING}
SELECT 'average' AS kind, 0 AS case_id, count(*) AS timed_case_count, sum(total) / count(*) AS total, sum(opening) / count(*) AS opening,
  sum(answers) / count(*) AS answers, sum(turns) / count(*) AS turns FROM timing
UNION ALL (SELECT 'slowest', case_id, 1, total, opening, answers, turns FROM timing ORDER BY total DESC, case_id LIMIT 5)""")
def timing_summary(t):
    avg, top = rp.timing_summary(timing(t))
    a = avg.select(F.lit("average").alias("kind"), F.lit(0).cast("bigint").alias("case_id"), "timed_case_count", F.col("average_total").alias("total"),
                   F.col("average_opening").alias("opening"), F.col("average_answers").alias("answers"), F.col("average_turns").alias("turns"))
    s = top.select(F.lit("slowest").alias("kind"), "case_id", F.lit(1).cast("bigint").alias("timed_case_count"),
                   *[F.col(c).cast("double").alias(c) for c in ("total", "opening", "answers", "turns")])
    return a.unionByName(s)


@query("slowest_turn", """
SELECT case_id, max(cents) AS slowest_seconds, arg_max(turn, (cents, -turn, -pk, -sk)) AS slowest_turn FROM replay_turn GROUP BY 1""")
def slowest_turn(t):
    return rp.slowest_turn(t.replay_turn, "cents", ORD)


# -- unfinished cases ----------------------------------------------------------------------------------------

SQL_CAT = """CASE WHEN status = 'failed' THEN 'failed::' || CASE WHEN price > 200000 THEN 'timeout' ELSE 'unknown_error' END
  WHEN exact_hit THEN 'max_turn_reached::top_exact_correct_but_rejected' WHEN family_hit THEN 'max_turn_reached::top_family_correct_but_rejected'
  WHEN NOT has_answer THEN 'max_turn_reached::no_final_answer' WHEN hypothesis_hit THEN 'max_turn_reached::true_candidate_but_final_wrong'
  ELSE 'max_turn_reached::true_candidate_missing' END"""


def unfinished(t):
    return rp.non_completed(facts(t), F.when(F.col("price") > 200000, "timeout"))


@query("non_completed_breakdown", f"""
WITH {SQL_FACTS} SELECT {SQL_CAT} AS category, count(*) AS n, min(case_id) AS first_case FROM facts WHERE status <> 'completed' GROUP BY 1""")
def non_completed_breakdown(t):
    return unfinished(t).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first_case"))


@query("case_report_compact", f"""
WITH {SQL_FACTS},
lt AS (SELECT case_id, arg_max(turn, {SQL_ORD}) AS last_turn, arg_max(answer_name, {SQL_ORD}) AS last_answer_name FROM replay_turn GROUP BY 1),
c5 AS (SELECT case_id, string_agg(name, '|' ORDER BY rank) AS candidates_top5 FROM hyp WHERE rank <= 5 GROUP BY 1)
SELECT case_id, {SQL_CAT} AS category, answer, n_turns, n_revealed, last_turn, last_answer_name, candidates_top5
FROM facts LEFT JOIN lt USING (case_id) LEFT JOIN c5 USING (case_id) WHERE status <> 'completed'""")
def case_report_compact(t):
    from ..operators.retrieve import top_k

    tr = t.replay_turn
    top = top_k(tr, ["case_id"], [F.desc("quantity"), *[F.col(o) for o in ORD]], 5)
    names = top.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "answer_name"))).alias("l")).select(
        "case_id", F.concat_ws("|", F.transform("l", lambda x: x["answer_name"])).alias("candidates_top5"))
    last = rp.last_turn(tr, ORD, ["turn", "answer_name"])
    return unfinished(t).join(last, "case_id", "left").join(names, "case_id", "left").select(
        "case_id", "category", "answer", "n_turns", "n_revealed", "last_turn", "last_answer_name", "candidates_top5")


# -- focused metrics ------------------------------------------------------------------------------------------

def focus(t):
    """Turn records of the acceptance study, every field derived from the line."""
    q, c = F.col("quantity"), F.col
    tr = t.replay_turn
    sup = F.concat(F.lit("S"), c("sk").cast("string"))
    return tr.withColumns({
        "should_accept": c("accepted"), "answer": c("answer_name"), "family": F.substring_index("answer_name", " ", -1),
        "stop_accept": c("accepted") & (q >= 48),
        "accept_reason": F.when(c("cost") == "low", "key_support_sufficient").when(q < 40, "trajectory_stable"),
        "block_reason": F.when(c("accepted") & (q >= 45), "strong_unresolved_alternative_candidates")
        .when(c("accepted") & (q >= 40), "missing_confirmed_key_evidence"),
        "reject_reason": F.when(c("verifier_called") & (q < 10), "missing_key_support"),
        "rerooted": q == 7, "strong_alt": q >= 45, "weak_alt": q.between(30, 44), "combo_ok": c("cost") == "high",
        "combo_provisional": (c("cost") == "high") & c("truth_hit"), "metadata_complete": q != 33,
        "negative_key": ~c("truth_hit") & (q >= 35), "recent_switch": q.between(26, 28), "nonempty_alt": q >= 30,
        "root_node": c("node_id"), "selected_node": F.when(q < 5, sup).otherwise(c("node_id")),
        "root_hyp": sup, "selected_hyp": F.when(q < 3, F.lit("")).when(q < 6, F.lit("S_other")).otherwise(sup),
        "schema_valid": F.when(q > 20, q != 30), "high_risk": c("grp").isin("lab", "imaging"), "pcp": c("grp") == "pathogen",
        "confirmed_key": c("truth_hit"), "blocked": c("accepted") & (q >= 40)})


SQL_FOCUS = """focus AS (SELECT *, accepted AS should_accept, answer_name AS answer, split_part(answer_name, ' ', 2) AS family, accepted AND quantity >= 48 AS stop_accept,
  CASE WHEN cost = 'low' THEN 'key_support_sufficient' WHEN quantity < 40 THEN 'trajectory_stable' END AS accept_reason,
  CASE WHEN accepted AND quantity >= 45 THEN 'strong_unresolved_alternative_candidates' WHEN accepted AND quantity >= 40 THEN 'missing_confirmed_key_evidence' END AS block_reason,
  CASE WHEN verifier_called AND quantity < 10 THEN 'missing_key_support' END AS reject_reason, CASE WHEN quantity > 20 THEN quantity <> 30 END AS schema_valid,
  CASE WHEN quantity < 5 THEN 'S' || sk ELSE node_id END AS selected_node, 'S' || sk AS root_hyp,
  CASE WHEN quantity < 3 THEN '' WHEN quantity < 6 THEN 'S_other' ELSE 'S' || sk END AS selected_hyp FROM replay_turn),
lagged AS (SELECT *, lag(node_id) OVER w AS pn, lag(family) OVER w AS pf FROM focus WINDOW w AS (PARTITION BY case_id ORDER BY turn, pk, sk)),
ft AS (SELECT *, coalesce(pn = node_id, false) AS same_question, coalesce(pn <> node_id AND pf = family, false) AS semantic_repeat FROM lagged)"""


def focus_turns(t):
    return rp.repeat_flags(focus(t), TURNS)


@query("repeat_flags", f"WITH {SQL_FOCUS} SELECT case_id, turn, pk, sk, same_question, semantic_repeat FROM ft")
def repeat_flags(t):
    return focus_turns(t).select("case_id", *ORD, "same_question", "semantic_repeat")


SQL_TURNM = f"""{n_('verifier_called')} AS verifier_called_count,
  {n_('verifier_called AND should_accept AND block_reason IS NOT NULL')} AS verifier_positive_but_gate_rejected_count,
  {n_("verifier_called AND should_accept AND ((grp = 'pathogen' AND NOT cost = 'high') OR (grp IN ('lab','imaging') AND NOT truth_hit))")} AS accept_candidate_without_confirmed_combo_count,
  {n_('accepted AND quantity >= 45')} AS strong_alternative_block_count, {n_("accepted AND quantity >= 45 AND cost = 'high'")} AS combo_satisfied_but_alternative_blocked_count,
  {n_('should_accept AND quantity BETWEEN 30 AND 44')} AS weak_alternative_allowed_count, {n_("cost = 'high' AND truth_hit")} AS provisional_combo_satisfied_count,
  {n_('same_question')} AS repeated_question_turns, {n_('semantic_repeat')} AS semantic_repeat_turns, {n_('quantity = 7')} AS rerooted_turns,
  {n_('reject_reason IS NOT NULL')} AS repair_turns, {n_('node_id <> selected_node')} AS repair_override_turns,
  {n_("root_hyp <> selected_hyp AND selected_hyp <> ''")} AS repair_hypothesis_switch_turns, {n_('verifier_called AND coalesce(schema_valid, false)')} AS verifier_schema_valid_true,
  {n_('verifier_called AND NOT coalesce(schema_valid, true)')} AS verifier_schema_valid_false, {n_('verifier_called AND schema_valid IS NULL')} AS verifier_schema_valid_missing"""


def focus_cases(t):
    """One row per case that has turns: answer, truth, accept, timeline, final turn."""
    return once(t, "_focus_cases", lambda: _focus_cases(t))


def _focus_cases(t):
    res = results(t)
    hit = rp.name_match(res.where("answer <> ''").select("case_id", F.col("answer").alias("name")), truths(t))
    cases = res.join(hit.select("case_id", F.col("family_hit").alias("correct")), "case_id", "left").withColumns({
        "correct": F.coalesce("correct", F.lit(False)), "accepted": rp.is_stop_accepted(F.col("stop_reason"))})
    return cases.select("case_id", "case_type", "status", F.col("answer").alias("final_answer"), "stop_reason", "correct", "accepted")


def focus_correct(t):
    """Focused turns with the flag 'this turn's best answer is right'."""
    return once(t, "_focus_correct", lambda: _focus_correct(t))


def _focus_correct(t):
    from ..functions.names import match_table

    f = focus(t).select("case_id", *ORD, "answer", "should_accept", "stop_accept").withColumn("_k", rp.name_key(F.col("answer")))
    tr = truths(t).select("case_id", rp.name_key(F.col("name")).alias("expected"))
    table = match_table(f.select(F.col("_k").alias("name")), tr.select(F.col("expected").alias("name")), True, rp.FAMILY_RATIO)
    good = f.select("case_id", F.col("_k").alias("name")).distinct().join(table, "name").join(tr, ["case_id", "expected"], "left_semi")
    good = good.select("case_id", F.col("name").alias("_k"), F.lit(True).alias("correct")).distinct()
    return f.join(good, ["case_id", "_k"], "left").withColumn("correct", F.coalesce("correct", F.lit(False))).drop("_k")


def timeline(t):
    return once(t, "_timeline", lambda: _timeline(t))


def _timeline(t):
    cases = focus_cases(t).select("case_id", "final_answer", F.col("correct").alias("final_correct"))
    return rp.acceptance_timeline(focus_correct(t), cases, ORD)


SQL_FCASE = f"""{SQL_NAMES}, {SQL_FOCUS},
ah AS ({SQL_HIT.format(names="(SELECT case_id, answer AS name FROM res WHERE answer <> '')")}),
fc AS (SELECT res.case_id, case_type, status, answer AS final_answer, stop_reason, coalesce(family_hit, false) AS correct, stop_reason = 'final_answer_accepted' AS accepted
  FROM res LEFT JOIN ah USING (case_id)),
tn AS (SELECT DISTINCT case_id, answer FROM focus),
tc AS (SELECT tn.case_id, tn.answer, max(contains(replace(tn.answer, ' ', ''), replace(t.name, ' ', '')) OR contains(replace(t.name, ' ', ''), replace(tn.answer, ' ', ''))) AS correct
  FROM tn JOIN truth t USING (case_id) GROUP BY 1, 2),
ftc AS (SELECT focus.*, coalesce(tc.correct, false) AS correct, should_accept OR stop_accept AS acc, {SQL_ORD} AS pos FROM focus LEFT JOIN tc USING (case_id, answer)),
tl0 AS (SELECT f.case_id, min(CASE WHEN f.correct THEN pos END) AS c0, min(CASE WHEN acc THEN pos END) AS a, arg_min(CASE WHEN acc THEN answer END, CASE WHEN acc THEN pos END) AS an,
  min(CASE WHEN acc AND answer = final_answer THEN pos END) AS af, max(pos) AS last FROM ftc f JOIN fc USING (case_id) GROUP BY 1),
tl AS (SELECT fc.case_id, coalesce(c0, CASE WHEN fc.correct THEN last END) AS c, a, af, an, final_answer,
  coalesce(an IS NOT NULL AND final_answer <> '' AND an <> final_answer, false) AS changed FROM fc LEFT JOIN tl0 USING (case_id)),
timeline AS (SELECT case_id, struct_extract(c, 1) AS first_correct_turn, struct_extract(a, 1) AS first_accept_turn, struct_extract(af, 1) AS first_accept_turn_for_final,
  changed AS answer_changed_after_accept, c, a FROM tl),
stops AS (SELECT f.case_id, min(CASE WHEN f.correct AND acc THEN pos END) AS stop FROM ftc f JOIN timeline USING (case_id) WHERE pos >= c GROUP BY 1),
span AS (SELECT t.case_id, CAST(coalesce(sum(CASE WHEN coalesce(a >= c, false) THEN (pos < a)::INT ELSE (f.correct AND (stop IS NULL OR pos < stop))::INT END), 0) AS BIGINT) AS correct_but_rejected_span
  FROM timeline t LEFT JOIN ftc f ON f.case_id = t.case_id AND f.pos >= t.c LEFT JOIN stops ON stops.case_id = t.case_id GROUP BY 1)"""


@query("acceptance_timeline", f"""
WITH {SQL_FCASE} SELECT case_id, first_correct_turn, first_accept_turn, first_accept_turn_for_final, answer_changed_after_accept FROM timeline""")
def acceptance_timeline(t):
    return timeline(t).drop("c", "a")


@query("rejected_span", f"WITH {SQL_FCASE} SELECT case_id, correct_but_rejected_span FROM span")
def rejected_span(t):
    return rp.rejected_span(focus_correct(t), timeline(t), ORD)


FINAL = ["turn", "metadata_complete", "negative_key", "recent_switch", "nonempty_alt", "combo_provisional", "accept_reason"]
SQL_FINAL = """fin AS (SELECT case_id, arg_max({'turn': turn, 'mc': quantity <> 33, 'nk': NOT truth_hit AND quantity >= 35, 'rs': quantity BETWEEN 26 AND 28,
  'na': quantity >= 30, 'cp': cost = 'high' AND truth_hit, 'ar': accept_reason}, (stop_accept::INT, turn, pk, sk)) AS f FROM focus GROUP BY 1)"""


def final_turns(t):
    f = focus(t).withColumn("stop_reason", F.when(F.col("stop_accept"), rp.ACCEPTED))
    return rp.final_turn(f, ORD, FINAL)


@query("final_turn", f"""
WITH {SQL_FOCUS}, {SQL_FINAL} SELECT case_id, f.turn AS final_turn, f.mc AS final_metadata_complete, f.nk AS final_negative_key, f.rs AS final_recent_switch,
  f.na AS final_nonempty_alt, f.cp AS final_combo_provisional, f.ar AS final_accept_reason FROM fin""")
def final_turn(t):
    return final_turns(t)


def focus_rows(t):
    return once(t, "_focus_rows", lambda: _focus_rows(t))


def _focus_rows(t):
    tl = timeline(t)
    return focus_cases(t).join(tl, "case_id").join(rp.rejected_span(focus_correct(t), tl, ORD), "case_id").join(final_turns(t), "case_id", "left")


SQL_CASEM = f"""count(*) AS case_count, {n_('accepted AND correct')} AS accepted_correct_count, {n_('accepted AND NOT correct')} AS accepted_wrong_count,
  {n_('NOT accepted AND correct')} AS correct_best_answer_but_rejected_count, {n_('NOT accepted AND NOT correct')} AS wrong_best_answer_rejected_count,
  {n_("stop_reason = 'max_turn_reached'")} AS max_turn_reached_cases, {n_('accepted AND f.mc')} AS accepted_with_verifier_metadata_count,
  {n_('accepted AND NOT coalesce(f.mc, false)')} AS accepted_without_verifier_metadata_count, {n_('accepted AND first_accept_turn = 1')} AS accepted_on_turn1_count,
  {n_('accepted AND first_accept_turn = 1 AND NOT correct')} AS wrong_accept_on_turn1_count, {n_('accepted AND f.nk')} AS accepted_after_negative_key_evidence_count,
  {n_('accepted AND f.rs')} AS accepted_after_recent_hypothesis_switch_count, {n_('accepted AND f.na')} AS accepted_with_nonempty_alternative_candidates_count,
  {n_('accepted AND f.cp')} AS accepted_with_provisional_combo_count, {n_('answer_changed_after_accept')} AS final_answer_changed_after_first_accept_count,
  sum(first_correct_turn) / nullif(count(first_correct_turn), 0) AS avg_first_correct_best_answer_turn,
  sum(first_accept_turn) / nullif(count(first_accept_turn), 0) AS avg_first_verifier_accept_turn, sum(correct_but_rejected_span) / count(*) AS avg_correct_but_rejected_span"""
SQL_FROWS = f"{SQL_FCASE}, {SQL_FINAL},\nfrow AS (SELECT * FROM fc JOIN timeline USING (case_id) JOIN span USING (case_id) LEFT JOIN fin USING (case_id))"


@query("focused_metrics", f"""
WITH {SQL_FROWS},
cm AS (SELECT {SQL_CASEM} FROM frow), tm AS (SELECT {SQL_TURNM} FROM ft)
SELECT * FROM cm, tm""")
def focused_metrics(t):
    cases = focus_rows(t).agg(*rp.focused_case_metrics())
    turns = focus_turns(t).agg(*rp.focused_turn_metrics())
    return cases.crossJoin(turns)  # one row each


@query("acceptance_category", f"""
WITH {SQL_FCASE} SELECT CASE WHEN correct THEN 'correct' ELSE 'wrong' END || CASE WHEN accepted THEN '_accepted' ELSE '_rejected' END AS category,
  stop_reason, count(*) AS n FROM fc GROUP BY 1, 2""")
def acceptance_category(t):
    return focus_cases(t).groupBy(rp.acceptance_category(F.col("correct"), F.col("accepted")).alias("category"), "stop_reason").agg(F.count(F.lit(1)).alias("n"))


@query("reason_counts", f"""
WITH {SQL_FOCUS}
SELECT 'block' AS kind, block_reason AS reason, count(*) AS n FROM focus WHERE block_reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'accept', coalesce(accept_reason, 'missing'), count(*) FROM focus WHERE verifier_called AND should_accept GROUP BY 2""")
def reason_counts(t):
    f = focus(t)
    a = rp.reason_counts(f, F.col("block_reason"))
    b = rp.reason_counts(f.where("verifier_called AND should_accept"), F.col("accept_reason"), default="missing")
    return a.select(F.lit("block").alias("kind"), "reason", "n").unionByName(b.select(F.lit("accept").alias("kind"), "reason", "n"))


@query("family_recorded_next", """
WITH b AS (SELECT case_id, turn, pk, sk, grp, split_part(answer_name, ' ', 2) AS noun, accepted AND quantity >= 40 AS blocked, truth_hit,
  lead(CASE WHEN truth_hit THEN split_part(answer_name, ' ', 2) ELSE '' END) OVER w AS nxt, lead(grp) OVER w AS nxtg
  FROM replay_turn WINDOW w AS (PARTITION BY case_id ORDER BY turn, pk, sk)),
m AS (SELECT *, blocked AND noun IN ('bolt','gear','rod','ring') AS rep FROM b)
SELECT case_id, turn, pk, sk, blocked AS repair_turn, rep AS missing_family_selected, rep AND nxt IS NOT NULL AS recorded_attempt,
  coalesce(rep AND nxt IS NOT NULL AND nxt = noun, false) AS recorded FROM m""")
def family_recorded_next(t):
    noun = F.substring_index("answer_name", " ", -1)
    f = t.replay_turn.withColumns({
        "asked": F.array(noun, "grp"), "missing": F.array(F.lit("bolt"), F.lit("gear"), F.lit("rod"), F.lit("ring")),
        "confirmed": F.when(F.col("truth_hit"), F.array(noun)).otherwise(F.array().cast("array<string>")),
        "blocked": F.col("accepted") & (F.col("quantity") >= 40)})
    return rp.family_recorded_next(f, TURNS).select("case_id", *ORD, "repair_turn", "missing_family_selected", "recorded_attempt", "recorded")


@query("negative_evidence_counts", """
WITH i AS (SELECT CASE WHEN quantity > 3 THEN answer_name END AS node, CASE WHEN cost = 'high' THEN 'hard' WHEN quantity > 20 THEN 'soft' END AS tier,
  CASE WHEN grp IN ('lab','imaging') THEN grp ELSE '' END AS scope, answer_name, grp FROM replay_turn WHERE NOT truth_hit),
f AS (SELECT grp AS k, 1 FROM i WHERE grp IN ('lab','pathogen') UNION ALL SELECT split_part(answer_name, ' ', 1), 1 FROM i WHERE grp IN ('lab','pathogen')
  UNION ALL SELECT 'unknown', 1 FROM i WHERE grp NOT IN ('lab','pathogen'))
SELECT 'node' AS kind, coalesce(node, 'unknown') AS key, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'tier', coalesce(tier, 'unknown'), count(*) FROM i GROUP BY 2
UNION ALL SELECT 'scope', CASE scope WHEN '' THEN 'unknown' ELSE scope END, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'family', k, count(*) FROM f GROUP BY 2""")
def negative_evidence_counts(t):
    q = F.col("quantity")
    items = t.replay_turn.where("NOT truth_hit").select(
        F.when(q > 3, F.col("answer_name")).alias("node"), F.when(F.col("cost") == "high", "hard").when(q > 20, "soft").alias("tier"),
        F.when(F.col("grp").isin("lab", "imaging"), F.col("grp")).otherwise("").alias("scope"),
        F.when(F.col("grp").isin("lab", "pathogen"), F.array("grp", F.substring_index("answer_name", " ", 1))).alias("families"))
    return rp.negative_evidence_counts(items)


@query("gate_audit_rows", f"""
WITH {SQL_FOCUS} SELECT case_id, turn, pk, sk, CASE WHEN quantity = 45 THEN 'manual' ELSE block_reason END AS audit_reason,
  CASE WHEN quantity = 46 THEN upper(answer) ELSE answer END AS audit_name FROM focus WHERE verifier_called AND should_accept AND block_reason IS NOT NULL""")
def gate_audit_rows(t):
    q = F.col("quantity")
    f = focus(t).withColumns({"audit_block_reason": F.when(q == 45, "manual"), "audit_answer_name": F.when(q == 46, F.upper("answer"))})
    return rp.gate_audit_rows(f).select("case_id", *ORD, "audit_reason", "audit_name")


SQL_ABL = f"""{SQL_FROWS},
cm AS (SELECT case_type AS variant, {SQL_CASEM} FROM frow GROUP BY 1),
tm AS (SELECT case_type AS variant, {SQL_TURNM} FROM ft JOIN replay USING (case_id) GROUP BY 1)"""


def by_variant(t):
    cases = focus_rows(t).groupBy(F.col("case_type").alias("variant")).agg(*rp.focused_case_metrics())
    turns = focus_turns(t).join(t.replay.select("case_id", F.col("case_type").alias("variant")), "case_id").groupBy("variant").agg(*rp.focused_turn_metrics())
    return cases.join(turns, "variant")


@query("ablation_compare", f"""
WITH {SQL_ABL}
SELECT variant, case_count, accepted_correct_count, accepted_wrong_count, repair_turns, semantic_repeat_turns, repeated_question_turns,
  coalesce(repair_override_turns / nullif(repair_turns, 0), 0.0) AS root_vs_repair_diff_rate, verifier_schema_valid_true, verifier_schema_valid_false, verifier_schema_valid_missing
FROM cm JOIN tm USING (variant)""")
def ablation_compare(t):
    m = by_variant(t)
    return m.select("variant", "case_count", "accepted_correct_count", "accepted_wrong_count", "repair_turns", "semantic_repeat_turns",
                    "repeated_question_turns", rp.rate(F.col("repair_override_turns"), F.col("repair_turns")).alias("root_vs_repair_diff_rate"),
                    "verifier_schema_valid_true", "verifier_schema_valid_false", "verifier_schema_valid_missing")


@query("sweep_profile_table", f"""
WITH {SQL_ABL},
med AS (SELECT case_type AS variant, median(first_accept_turn) AS median_first_verifier_accept_turn, median(first_accept_turn_for_final) AS median_first_verifier_accept_turn_for_final_answer FROM frow GROUP BY 1)
SELECT * FROM cm JOIN tm USING (variant) JOIN med USING (variant)""")
def sweep_profile_table(t):
    rows = focus_rows(t).withColumnRenamed("case_type", "variant")
    a = rp.median_of(rows, ["variant"], "first_accept_turn", "median_first_verifier_accept_turn")
    b = rp.median_of(rows, ["variant"], "first_accept_turn_for_final", "median_first_verifier_accept_turn_for_final_answer")
    return by_variant(t).join(a, "variant").join(b, "variant")


@query("median_avg_optional", f"""
WITH {SQL_FCASE}
SELECT count(first_accept_turn) AS n, sum(first_accept_turn) / nullif(count(first_accept_turn), 0) AS avg_turn, median(first_accept_turn) AS median_turn FROM timeline""")
def median_avg_optional(t):
    tl = timeline(t)
    avg = tl.agg(F.count("first_accept_turn").alias("n"), *[c.alias("avg_turn") for c in rp.averages({"turn": "first_accept_turn"})])
    return avg.crossJoin(rp.median_of(tl, [], "first_accept_turn", "median_turn"))  # one row each


# -- joins with cases --------------------------------------------------------------------------------------------

@query("case_enrich", """
SELECT o_orderkey AS case_id, CASE WHEN case_type = '' THEN coalesce(c_mktsegment, '') ELSE case_type END AS case_type,
  CASE WHEN case_qc_status = '' THEN coalesce(c_name, '') ELSE case_qc_status END AS case_qc_status
FROM replay JOIN orders ON o_orderkey = case_id LEFT JOIN customer ON c_custkey = o_custkey""")
def case_enrich(t):
    own = t.raw("orders").join(t.raw("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("o_orderkey").alias("case_id"), F.col("c_mktsegment").alias("case_type"), F.col("c_name").alias("case_qc_status"))
    return rp.case_enrich(t.replay.select("case_id", "case_type", "case_qc_status"), own, ["case_type", "case_qc_status"])


@query("qc_defaults", """
WITH x AS (SELECT case_id, case_qc_status AS cq, CASE WHEN price > 400000 THEN 'eligible' WHEN price < 20000 THEN 'ineligible' ELSE '' END AS bq FROM replay),
y AS (SELECT *, CASE WHEN cq = '' AND bq = 'eligible' THEN 'eligible' ELSE cq END AS c2 FROM x)
SELECT c2 AS case_qc_status, CASE WHEN bq = '' AND c2 <> '' THEN CASE WHEN c2 = 'eligible' THEN 'eligible' ELSE 'ineligible' END ELSE bq END AS benchmark_qc_status, count(*) AS n
FROM y GROUP BY 1, 2""")
def qc_defaults(t):
    bench = F.when(F.col("price") > 400000, "eligible").when(F.col("price") < 20000, "ineligible").otherwise("")
    c, b = rp.qc_defaults(F.col("case_qc_status"), bench)
    return t.replay.groupBy(c.alias("case_qc_status"), b.alias("benchmark_qc_status")).agg(F.count(F.lit(1)).alias("n"))


@query("semi_selected_cases", """
WITH rec AS (SELECT o_custkey * 7 AS case_id, min(o_orderkey) AS ord FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT 'selected' AS kind, case_id, ord FROM replay JOIN rec USING (case_id) UNION ALL SELECT 'missing', case_id, ord FROM rec WHERE case_id NOT IN (SELECT case_id FROM replay)""")
def semi_selected_cases(t):
    rec = t.raw("orders").where("o_orderstatus <> 'F'").select((F.col("o_custkey") * 7).alias("case_id"), F.col("o_orderkey").alias("ord"))
    sel, miss = rp.select_cases(t.replay.select("case_id"), rec)
    return sel.select(F.lit("selected").alias("kind"), "case_id", "ord").unionByName(miss.select(F.lit("missing").alias("kind"), "case_id", "ord"))


@query("resume_pending", "SELECT case_id, case_type FROM replay WHERE case_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending(t):
    done = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    return rp.resume_pending(t.replay, done).select("case_id", "case_type")
