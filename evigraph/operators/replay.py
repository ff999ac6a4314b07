"""Evaluation of recorded sessions: case facts, benchmark, cohort, timing, timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import case_hits, match_table
from ..functions.ordered import Order, neighbours
from ..functions.text import blank, match_text, text_or
from ..functions.vocab import EVIDENCE_GROUPS

# --- fixed values: report groups and cost buckets ------------------------------------------
QUESTION_GROUPS = (*EVIDENCE_GROUPS, "exam_context", "unknown")
COST_BUCKETS = ("low", "high", "unknown")

# --- fixed values: texts that mean "not present" --------------------------------------------
NEGATIVE_VALUES = ("", "false", "0", "none", "null", "negative", "absent",
                   "阴性", "未见", "未检出", "无", "否", "正常")
ACCEPTED = "final_answer_accepted"
FAMILY_RATIO = 0.88


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("bigint")


def rate(num: Column, den: Column) -> Column:
    """Safe division: 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def name_key(col: Column) -> Column:
    """Comparison form of an answer name."""
    return match_text(col, drop=" 。、-_/", fold={"（": "(", "）": ")", "，": ","})


def truth_positive(value: Column) -> Column:
    """A recorded value means 'present' unless it is in the negative vocabulary."""
    return ~F.lower(text_or(value)).isin(*NEGATIVE_VALUES)


def final_answer(best: Column, group_first: Column, score_first: Column, fallback: Column) -> Column:
    """First non-blank of best answer, first group score, first final score, reported name."""
    return F.coalesce(*[F.nullif(text_or(c), F.lit("")) for c in (best, group_first, score_first, fallback)], F.lit(""))


def is_accepted(status: Column, stop_reason: Column) -> Column:
    """Accepted when completed or stopped by acceptance (the benchmark's predicate)."""
    return F.coalesce((status == "completed") | (stop_reason == ACCEPTED), F.lit(False))


def is_stop_accepted(stop_reason: Column) -> Column:
    """Accepted only by the stop reason (the focused metrics' predicate)."""
    return F.coalesce(stop_reason == ACCEPTED, F.lit(False))


def name_match(predicted: DataFrame, truths: DataFrame, ratio: float | None = FAMILY_RATIO, *kinds: str) -> DataFrame:
    """``case_id, exact_hit, family_hit`` for cases whose predicted names match a truth.

    ``predicted``: ``case_id, name`` and optional ``kinds`` columns that are matched apart;
    ``truths``: ``case_id, name``, both raw text.
    """
    p = predicted.select("case_id", *kinds, name_key(F.col("name")).alias("name")).where("name <> ''").distinct()
    e = truths.select("case_id", name_key(F.col("name")).alias("expected")).where("expected <> ''")
    table = match_table(p.select("name"), e.select(F.col("expected").alias("name")), True, ratio)
    return case_hits(p, e, table, *kinds)


def red_flag_hit(flags: DataFrame, confirmed: DataFrame, revealed: DataFrame) -> DataFrame:
    """Per case with red flags: count and whether one of them was confirmed or revealed."""
    f = flags.select("case_id", name_key(F.col("name")).alias("k")).distinct()
    seen = confirmed.select("case_id", name_key(F.col("name")).alias("k")).unionByName(
        revealed.select("case_id", name_key(F.col("name")).alias("k"))).distinct()
    hit = f.join(seen.withColumn("_h", F.lit(1)), ["case_id", "k"], "left")
    return hit.groupBy("case_id").agg(F.count(F.lit(1)).alias("red_flags"), (F.max("_h") == 1).alias("_hit")).select(
        "case_id", "red_flags", F.coalesce("_hit", F.lit(False)).alias("red_flag_hit"))


def revealed_slots(turns: DataFrame) -> DataFrame:
    """Distinct revealed ids per case."""
    d = turns.where("revealed_id IS NOT NULL").select("case_id", "revealed_id").distinct()
    return d.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_revealed"))


def case_facts(replay: DataFrame, turns: DataFrame, truths: DataFrame, hypotheses: DataFrame, flags: DataFrame,
               confirmed: DataFrame, ratio: float | None = FAMILY_RATIO) -> DataFrame:
    """One row per case with every flag the summaries count.

    ``replay``: case columns plus ``answer`` and ``stop_reason``; ``hypotheses``:
    ``case_id, name, rank``.
    """
    said = replay.where(~blank(F.col("answer"))).select("case_id", F.col("answer").alias("name"), F.lit("answer").alias("kind"))
    guess = hypotheses.select("case_id", "name", F.when(F.col("rank") <= 3, "top3").otherwise("later").alias("kind"))
    hit = name_match(said.unionByName(guess), truths, ratio, "kind")
    of = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    answer = hit.groupBy("case_id").agg(
        of("answer", "exact_hit").alias("exact_hit"), of("answer", "family_hit").alias("family_hit"), of("top3", "family_hit").alias("top3_hit"),
        F.max(F.when(F.col("kind") != "answer", F.col("family_hit"))).alias("hypothesis_hit"))
    n = turns.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_turns"))
    red = red_flag_hit(flags, confirmed, turns.where("revealed_id IS NOT NULL").select("case_id", F.col("revealed_id").alias("name")))
    out = replay
    for part in (n, revealed_slots(turns), answer, red):
        out = out.join(part, "case_id", "left")
    false = F.lit(False)
    return out.withColumns({
        "n_turns": F.coalesce("n_turns", F.lit(0)), "n_revealed": F.coalesce("n_revealed", F.lit(0)),
        "red_flags": F.coalesce("red_flags", F.lit(0)), "red_flag_hit": F.coalesce("red_flag_hit", false),
        "exact_hit": F.coalesce("exact_hit", false), "family_hit": F.coalesce("family_hit", false),
        "hypothesis_hit": F.coalesce("hypothesis_hit", false), "top3_hit": F.coalesce("top3_hit", false),
        "has_answer": ~blank(F.col("answer")), "accepted": is_accepted(F.col("status"), F.col("stop_reason"))})


def benchmark_aggs() -> list[Column]:
    """Counts behind every benchmark metric, mergeable across any grouping."""
    acc, ex, fam = F.col("accepted"), F.col("exact_hit"), F.col("family_hit")
    n = lambda cond, name: F.sum(flag(cond)).alias(name)
    return [
        F.count(F.lit(1)).alias("case_count"),
        n(F.col("status") == "completed", "completed_count"),
        n(F.col("status") == "max_turn_reached", "max_turn_reached_count"),
        F.sum("n_turns").alias("turn_total"), F.sum("n_revealed").alias("revealed_total"),
        n(F.col("hypothesis_hit"), "hypothesis_hit_count"), n(F.col("top3_hit"), "top3_hypothesis_hit_count"),
        n(F.col("has_answer"), "final_answer_count"),
        n(ex, "final_answer_exact_hit_count"), n(fam, "final_answer_family_hit_count"),
        n(acc, "accepted_final_answer_count"), n(acc & ex, "accepted_exact_hit_count"),
        n(acc & fam, "accepted_family_hit_count"),
        n(~acc & ex, "top_exact_correct_but_rejected_count"), n(~acc & fam, "top_family_correct_but_rejected_count"),
        n(F.col("red_flags") > 0, "red_flag_case_count"), n(F.col("red_flag_hit"), "red_flag_hit_count"),
    ]


def benchmark_rates(counts: DataFrame) -> DataFrame:
    """Rates and averages from the counts."""
    c = F.col
    return counts.withColumns({
        "completion_rate": rate(c("completed_count"), c("case_count")),
        "average_turns": rate(c("turn_total"), c("case_count")),
        "average_revealed_slots": rate(c("revealed_total"), c("case_count")),
        "hypothesis_hit_rate": rate(c("hypothesis_hit_count"), c("case_count")),
        "top3_hypothesis_hit_rate": rate(c("top3_hypothesis_hit_count"), c("case_count")),
        "final_answer_exact_hit_rate": rate(c("final_answer_exact_hit_count"), c("case_count")),
        "final_answer_family_hit_rate": rate(c("final_answer_family_hit_count"), c("case_count")),
        "accepted_exact_accuracy": rate(c("accepted_exact_hit_count"), c("accepted_final_answer_count")),
        "accepted_family_accuracy": rate(c("accepted_family_hit_count"), c("accepted_final_answer_count")),
        "wrong_accepted_count": c("accepted_final_answer_count") - c("accepted_exact_hit_count"),
        "family_wrong_accepted_count": c("accepted_final_answer_count") - c("accepted_family_hit_count"),
        "red_flag_hit_rate": rate(c("red_flag_hit_count"), c("red_flag_case_count")),
    }).drop("turn_total", "revealed_total")


def benchmark_summary(facts: DataFrame, *keys: str) -> DataFrame:
    grouped = facts.groupBy(*keys) if keys else facts.groupBy()
    return benchmark_rates(grouped.agg(*benchmark_aggs()))


def status_breakdown(facts: DataFrame) -> DataFrame:
    return facts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def cohort_summary(facts: DataFrame, cohorts: Sequence[str] = ("case_qc_status", "benchmark_qc_status", "case_type")) -> DataFrame:
    """Benchmark metrics overall and per value of each cohort field, in one grouping-sets pass."""
    keyed = facts.withColumns({c: text_or(F.col(c), "unknown") for c in cohorts})
    sets = [[]] + [[c] for c in cohorts]
    grouped = keyed.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cohorts])
    out = grouped.agg(F.grouping_id().alias("_gid"), *benchmark_aggs())
    full = (1 << len(cohorts)) - 1
    kind = F.lit("overall")
    key = F.lit("")
    for i, c in enumerate(cohorts):
        gid = full & ~(1 << (len(cohorts) - 1 - i))
        kind = F.when(F.col("_gid") == gid, c).otherwise(kind)
        key = F.when(F.col("_gid") == gid, F.col(c)).otherwise(key)
    out = out.withColumns({"cohort": kind, "cohort_value": key}).drop("_gid", *cohorts)
    return benchmark_rates(out)


def field_coverage(facts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Populated and missing counts per metadata field."""
    one = facts.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(flag(~blank(F.col(f)))).alias(f) for f in fields])
    stack = ", ".join(f"'{f}', `{f}`, _n - `{f}`" for f in fields)
    return one.select(F.expr(f"stack({len(fields)}, {stack}) as (field, populated_count, missing_count)"))


def in_vocabulary(col: Column, allowed: Sequence[str], other: str = "unknown") -> Column:
    return F.when(col.isin(*allowed), col).otherwise(F.lit(other))


def turn_observation(turns: DataFrame, slots: DataFrame) -> DataFrame:
    """Asked action joined to the truth it revealed: hit, group, positive, families."""
    s = slots.select("case_id", F.col("slot_id").alias("revealed_id"), F.col("grp").alias("revealed_group"),
                     truth_positive(F.col("value")).alias("revealed_positive"), F.lit(True).alias("_hit"))
    out = turns.drop("truth_hit").join(s, ["case_id", "revealed_id"], "left")
    return out.withColumn("truth_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def question_counts(turns: DataFrame) -> DataFrame:
    """Questions per case, group and cost bucket with their truth hits."""
    return turns.groupBy("case_id", in_vocabulary(F.col("grp"), QUESTION_GROUPS).alias("grp"),
                         in_vocabulary(F.col("cost"), COST_BUCKETS).alias("cost")).agg(
        F.count(F.lit(1)).alias("questions"), F.sum(flag(F.col("truth_hit"))).alias("truth_hits"))


def slot_analysis(slots: DataFrame, opening: DataFrame, revealed: DataFrame,
                  groups: Sequence[str] = EVIDENCE_GROUPS) -> DataFrame:
    """Truth counts per case and group: all, positive, opening, askable, revealed, covered."""
    s = slots.where(F.col("grp").isin(*groups)).select(
        "case_id", "slot_id", "grp", truth_positive(F.col("value")).alias("pos"))
    s = s.join(opening.select("case_id", "slot_id").distinct().withColumn("_o", F.lit(True)), ["case_id", "slot_id"], "left")
    s = s.join(revealed.select("case_id", "slot_id").distinct().withColumn("_r", F.lit(True)), ["case_id", "slot_id"], "left")
    o, r, p = F.coalesce("_o", F.lit(False)), F.coalesce("_r", F.lit(False)), F.col("pos")
    n = lambda cond, name: F.sum(flag(cond)).alias(name)
    return s.groupBy("case_id", "grp").agg(
        F.count(F.lit(1)).alias("truths"), n(p, "positive"), n(~p, "negative"), n(o, "opening"), n(o & p, "opening_positive"),
        n(~o, "askable"), n(~o & p, "askable_positive"), n(r, "revealed"), n(r & p, "revealed_positive"),
        n(o | r, "covered"), n((o | r) & p, "covered_positive"))


def required_coverage(cases: DataFrame, requirement: DataFrame, opening_families: DataFrame, all_families: DataFrame) -> DataFrame:
    """Required family groups covered on opening and in the end.

    ``requirement``: ``case_type, group_no, family`` (a group is met by any of its
    families); the family frames: distinct ``case_id, family``.
    """
    groups = requirement.select("case_type", "group_no").distinct().groupBy("case_type").agg(F.count(F.lit(1)).alias("required_groups"))

    def covered(families: DataFrame, name: str) -> DataFrame:
        met = families.join(cases.select("case_id", "case_type"), "case_id").join(requirement, ["case_type", "family"])
        met = met.select("case_id", "group_no").distinct()
        return met.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    out = cases.select("case_id", "case_type").join(groups, "case_type", "left")
    out = out.join(covered(opening_families, "covered_on_opening"), "case_id", "left")
    out = out.join(covered(all_families, "covered_after"), "case_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("required_groups", "covered_on_opening", "covered_after")}
    out = out.withColumns(zero)
    return out.withColumns({
        "coverage_gain": F.greatest(F.col("covered_after") - F.col("covered_on_opening"), F.lit(0)),
        "missing_after": F.col("required_groups") - F.col("covered_after")})


def analysis_by_group(questions: DataFrame, slots: DataFrame, groups: Sequence[str] = QUESTION_GROUPS) -> DataFrame:
    """Totals per question group; groups without a row still appear."""
    spark = questions.sparkSession
    base = spark.createDataFrame([(g,) for g in groups], "grp string")
    q = questions.groupBy("grp").agg(F.sum("questions").alias("questions"), F.sum("truth_hits").alias("truth_hits"))
    s = slots.groupBy("grp").agg(
        F.sum("askable_positive").alias("askable_positive"), F.sum("revealed_positive").alias("revealed_positive"),
        F.sum(flag(F.col("askable_positive") > 0)).alias("cases_with_askable"),
        F.sum(flag((F.col("askable_positive") > 0) & (F.col("revealed_positive") <= 0))).alias("cases_zero_revealed"))
    out = F.broadcast(base).join(q, "grp", "left").join(s, "grp", "left")
    cols = ["questions", "truth_hits", "askable_positive", "revealed_positive", "cases_with_askable", "cases_zero_revealed"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in cols})
    return out.withColumns({
        "truth_hit_rate": F.try_divide(F.col("truth_hits"), F.col("questions")),
        "coverage_rate": F.try_divide(F.col("revealed_positive"), F.col("askable_positive"))})


# -- timing ---------------------------------------------------------------------------------------

TIMINGS = ("total", "opening", "initial", "answers", "turns", "finalize")


def timing_summary(timing: DataFrame, slowest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Mean of each timing over the timed cases, and the slowest cases.

    Times are whole units (e.g. milliseconds) so that the mean does not depend on row order.
    """
    avg = timing.agg(F.count(F.lit(1)).alias("timed_case_count"),
                     *[rate(F.sum(F.coalesce(c, F.lit(0))), F.count(F.lit(1))).alias(f"average_{c}") for c in TIMINGS])
    top = timing.orderBy(F.desc("total"), "case_id").limit(slowest)
    return avg, top


def slowest_turn(turns: DataFrame, seconds: str, order: Sequence[str]) -> DataFrame:
    """Longest turn of each case; the first one on a tie."""
    key = F.struct(F.col(seconds), *[-F.col(o) for o in order])
    return turns.groupBy("case_id").agg(F.max(seconds).alias("slowest_seconds"), F.max_by("turn", key).alias("slowest_turn"))


# -- unfinished cases --------------------------------------------------------------------------------

def non_completed_category(status: Column, error_code: Column) -> Column:
    """Why a case did not finish, most telling reason first."""
    return (
        F.when(status == "failed", F.concat(F.lit("failed::"), text_or(error_code, "unknown_error")))
        .when(status == "max_turn_reached", F.concat(F.lit("max_turn_reached::"), F.when(F.col("exact_hit"), "top_exact_correct_but_rejected")
              .when(F.col("family_hit"), "top_family_correct_but_rejected").when(~F.col("has_answer"), "no_final_answer")
              .when(F.col("hypothesis_hit"), "true_candidate_but_final_wrong").otherwise("true_candidate_missing")))
        .otherwise(F.concat(F.lit("non_completed::"), text_or(status, "unknown"))))


def non_completed(facts: DataFrame, error_code: Column) -> DataFrame:
    left = facts.where(F.col("status") != "completed")
    return left.withColumn("category", non_completed_category(F.col("status"), error_code))


def last_turn(turns: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Chosen fields of the last turn of each case."""
    return turns.groupBy("case_id").agg(*[F.max_by(c, F.struct(*order)).alias(f"last_{c}") for c in cols])


# -- acceptance timelines ------------------------------------------------------------------------------

def final_turn(turns: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last accepting turn of each case, else its last turn."""
    key = F.struct(flag(F.col("stop_reason") == ACCEPTED).alias("_a"), *order)
    return turns.groupBy("case_id").agg(*[F.max_by(c, key).alias(f"final_{c}") for c in cols])


def acceptance_timeline(turns: DataFrame, cases: DataFrame, order: Sequence[str]) -> DataFrame:
    """First correct turn, first accept, first accept of the final answer, rejected span.

    ``turns``: ``case_id, turn, answer, correct, should_accept, stop_accept`` and the order
    columns; ``cases``: ``case_id, final_answer, final_correct``.  Everything is a
    mergeable aggregate, so a case with very many turns needs no single task.
    """
    pos = F.struct(*order)
    accept = F.col("should_accept") | F.col("stop_accept")
    t = turns.join(cases, "case_id").withColumn("_pos", pos).withColumn("_accept", accept)
    same = name_key(F.col("answer")) == name_key(F.col("final_answer"))
    first = t.groupBy("case_id").agg(
        F.min(F.when(F.col("correct"), F.col("_pos"))).alias("c"),
        F.min(F.when(F.col("_accept"), F.col("_pos"))).alias("a"),
        F.min_by(F.when(F.col("_accept"), F.col("answer")), F.when(F.col("_accept"), F.col("_pos"))).alias("a_name"),
        F.min(F.when(F.col("_accept") & same, F.col("_pos"))).alias("af"),
        F.max("_pos").alias("last"))
    out = cases.join(first, "case_id", "left")
    # a correct final answer that no turn shows counts from the last turn
    out = out.withColumn("c", F.coalesce("c", F.when(F.col("final_correct"), F.col("last"))))
    changed = (text_or(F.col("a_name")) != "") & (text_or(F.col("final_answer")) != "") & (
        name_key(F.col("a_name")) != name_key(F.col("final_answer")))
    turn = order[0]
    return out.select(
        "case_id", F.col(f"c.{turn}").alias("first_correct_turn"), F.col(f"a.{turn}").alias("first_accept_turn"),
        F.col(f"af.{turn}").alias("first_accept_turn_for_final"),
        F.coalesce(changed, F.lit(False)).alias("answer_changed_after_accept"), "c", "a")


def rejected_span(turns: DataFrame, timeline: DataFrame, order: Sequence[str]) -> DataFrame:
    """Turns between first correct and accept; without a later accept, the correct turns before the next accept.

    ``timeline`` carries the positions ``c`` (first correct) and ``a`` (first accept).
    """
    t = turns.join(timeline.select("case_id", "c", "a"), "case_id").withColumn("_pos", F.struct(*order))
    t = t.where(F.col("c").isNotNull() & (F.col("_pos") >= F.col("c")))
    has_later = F.coalesce(F.col("a") >= F.col("c"), F.lit(False))
    stop = t.groupBy("case_id").agg(F.min(F.when(
        F.col("correct") & (F.col("should_accept") | F.col("stop_accept")), F.col("_pos"))).alias("stop"))
    t = t.join(stop, "case_id")
    n = t.groupBy("case_id").agg(
        F.sum(flag(has_later & (F.col("_pos") < F.col("a")))).alias("between"),
        F.sum(flag(~has_later & F.col("correct") & (F.col("stop").isNull() | (F.col("_pos") < F.col("stop"))))).alias("correct_only"))
    out = timeline.select("case_id").join(n, "case_id", "left")
    return out.select("case_id", F.coalesce(F.col("between") + F.col("correct_only"), F.lit(0)).alias("correct_but_rejected_span"))


def acceptance_category(correct: Column, accepted: Column) -> Column:
    return F.concat_ws("_", F.when(correct, "correct").otherwise("wrong"), F.when(accepted, "accepted").otherwise("rejected"))


def repeat_flags(turns: DataFrame, order: Order) -> DataFrame:
    """Same question as the previous turn; different question of the same family."""
    t = neighbours(turns, order, lag={"_pn": "node_id", "_pf": "family"})
    prev = F.coalesce(F.col("_pn"), F.lit("")) != ""
    now = F.coalesce(F.col("node_id"), F.lit("")) != ""
    return t.withColumns({
        "same_question": prev & now & (F.col("_pn") == F.col("node_id")),
        "semantic_repeat": prev & now & (F.col("_pn") != F.col("node_id")) & (F.coalesce("family", F.lit("")) != "")
        & F.coalesce(F.col("_pf") == F.col("family"), F.lit(False))}).drop("_pn", "_pf")


def family_recorded_next(turns: DataFrame, order: Order) -> DataFrame:
    """Missing families that the turn asks for, and whether the next turn confirms one.

    ``turns``: ``asked, missing, confirmed`` (arrays of family names), ``blocked`` flag.
    """
    t = neighbours(turns, order, lead={"_next": "confirmed"})
    matched = F.array_intersect("asked", "missing")
    repair = F.col("blocked") & (F.size("missing") > 0)
    chosen = repair & (F.size(matched) > 0)
    has_next = F.col("_next").isNotNull()
    return t.withColumns({
        "repair_turn": repair, "missing_family_selected": chosen, "recorded_attempt": chosen & has_next,
        "recorded": chosen & has_next & F.coalesce(F.arrays_overlap(matched, F.col("_next")), F.lit(False))}).drop("_next")


def focused_turn_metrics() -> list[Column]:
    """Conditional sums over focused turns; every one merges across partitions."""
    c = F.col
    n = lambda cond, name: F.sum(flag(F.coalesce(cond, F.lit(False)))).alias(name)
    called = c("verifier_called")
    blocked = text_or(c("block_reason")) != ""
    strong_block = c("block_reason") == "strong_unresolved_alternative_candidates"
    return [
        n(called, "verifier_called_count"),
        n(called & c("should_accept") & blocked, "verifier_positive_but_gate_rejected_count"),
        n(called & c("should_accept") & ((c("pcp") & ~c("combo_ok")) | (c("high_risk") & ~c("confirmed_key"))),
          "accept_candidate_without_confirmed_combo_count"),
        n(strong_block, "strong_alternative_block_count"),
        n(strong_block & c("combo_ok"), "combo_satisfied_but_alternative_blocked_count"),
        n(c("should_accept") & c("weak_alt") & ~c("strong_alt") & ~F.coalesce(strong_block, F.lit(False)), "weak_alternative_allowed_count"),
        n(c("combo_provisional"), "provisional_combo_satisfied_count"),
        n(c("same_question"), "repeated_question_turns"),
        n(c("semantic_repeat"), "semantic_repeat_turns"),
        n(c("rerooted"), "rerooted_turns"),
        n(text_or(c("reject_reason")) != "", "repair_turns"),
        n((c("root_node") != c("selected_node")) & (text_or(c("root_node")) != "") & (text_or(c("selected_node")) != ""), "repair_override_turns"),
        n((c("root_hyp") != c("selected_hyp")) & (text_or(c("root_hyp")) != "") & (text_or(c("selected_hyp")) != ""), "repair_hypothesis_switch_turns"),
        n(called & c("schema_valid"), "verifier_schema_valid_true"),
        n(called & ~c("schema_valid"), "verifier_schema_valid_false"),
        n(called & c("schema_valid").isNull(), "verifier_schema_valid_missing"),
    ]


def focused_case_metrics() -> list[Column]:
    """Conditional sums over focused cases (one row per case with its final turn)."""
    c = F.col
    n = lambda cond, name: F.sum(flag(F.coalesce(cond, F.lit(False)))).alias(name)
    acc, ok = c("accepted"), c("correct")
    return [
        F.count(F.lit(1)).alias("case_count"),
        n(acc & ok, "accepted_correct_count"), n(acc & ~ok, "accepted_wrong_count"),
        n(~acc & ok, "correct_best_answer_but_rejected_count"), n(~acc & ~ok, "wrong_best_answer_rejected_count"),
        n(c("stop_reason") == "max_turn_reached", "max_turn_reached_cases"),
        n(acc & c("final_metadata_complete"), "accepted_with_verifier_metadata_count"),
        n(acc & ~F.coalesce(c("final_metadata_complete"), F.lit(False)), "accepted_without_verifier_metadata_count"),
        n(acc & (c("first_accept_turn") == 1), "accepted_on_turn1_count"),
        n(acc & (c("first_accept_turn") == 1) & ~ok, "wrong_accept_on_turn1_count"),
        n(acc & c("final_negative_key"), "accepted_after_negative_key_evidence_count"),
        n(acc & c("final_recent_switch"), "accepted_after_recent_hypothesis_switch_count"),
        n(acc & c("final_nonempty_alt"), "accepted_with_nonempty_alternative_candidates_count"),
        n(acc & c("final_combo_provisional"), "accepted_with_provisional_combo_count"),
        n(c("answer_changed_after_accept"), "final_answer_changed_after_first_accept_count"),
        *averages({"first_correct_best_answer_turn": "first_correct_turn", "first_verifier_accept_turn": "first_accept_turn"}),
        rate(F.sum("correct_but_rejected_span"), F.count(F.lit(1))).alias("avg_correct_but_rejected_span"),
    ]


def averages(cols: dict[str, str]) -> list[Column]:
    """Mean of whole numbers with missing ones left out."""
    return [F.try_divide(F.sum(F.col(c).cast("bigint")), F.count(c)).alias(f"avg_{name}") for name, c in cols.items()]


def median_of(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Exact median without sorting one key in one task.

    Values are counted first; the median is then read off the running counts of the
    distinct values, which for turn numbers are few.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        return _median_of_counts(counts, name)
    by = Window.partitionBy(*keys)
    run = counts.withColumns({"_hi": F.sum("_n").over(by.orderBy("_v")), "_total": F.sum("_n").over(by)})
    run = run.withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    left, right = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)
    at = lambda p: F.max(F.when((F.col("_lo") <= p) & (p <= F.col("_hi")), F.col("_v")))
    return run.groupBy(*keys).agg(((at(left) + at(right)) / 2).alias(name))


# Equal stretches between the smallest and the largest value in which the median is looked for.
STRETCHES = 1024


def _median_of_counts(counts: DataFrame, name: str) -> DataFrame:
    """Median of all values of ``_v, _n`` by distributed selection; one row, NULL for no values.

    Counts per stretch of the value range say in which stretches the two middle values
    lie; only the distinct values of these are put in order.
    """
    ends = counts.agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.sum("_n").alias("_total"))
    wide = F.col("_max").cast("double") - F.col("_min")
    stretch = F.when(wide > 0, F.least(F.lit(STRETCHES - 1), F.floor((F.col("_v") - F.col("_min")) / wide * STRETCHES))).otherwise(F.lit(0))
    placed = counts.join(F.broadcast(ends), F.lit(True)).withColumn("_s", stretch.cast("int"))  # one row
    sizes = placed.groupBy("_s").agg(F.sum("_n").alias("_n"), F.first("_total").alias("_total"))
    # At most STRETCHES entries in one row.
    state = F.struct(F.lit(0).cast("long").alias("hi"), F.array().cast("array<struct<s:int,lo:bigint,hi:bigint>>").alias("all"))
    run = F.aggregate(F.sort_array("_all"), state, lambda acc, x: F.struct(
        (acc["hi"] + x["n"]).alias("hi"), F.concat(acc["all"], F.array(F.struct(x["s"].alias("s"), (acc["hi"] + 1).alias("lo"), (acc["hi"] + x["n"]).alias("hi")))).alias("all")), lambda acc: acc["all"])
    total = F.col("_total")
    one = sizes.agg(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_n").alias("n"))).alias("_all"), F.max("_total").alias("_total")).select(
        run.alias("_run"), F.floor((total + 1) / 2).alias("_left"), F.ceil((total + 1) / 2).alias("_right"))
    hit = one.select("_left", "_right", F.explode("_run").alias("r")).where("(r.lo <= _left AND _left <= r.hi) OR (r.lo <= _right AND _right <= r.hi)")
    hit = hit.select("_left", "_right", F.col("r.s").alias("_s"), F.col("r.lo").alias("_base"))  # two rows at most
    near = placed.select("_s", "_v", "_n").join(F.broadcast(hit), "_s")
    by = Window.partitionBy("_s").orderBy("_v")
    near = near.withColumn("_hi", F.col("_base") - 1 + F.sum("_n").over(by)).withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    at = lambda p: F.max(F.when((F.col("_lo") <= F.col(p)) & (F.col(p) <= F.col("_hi")), F.col("_v")))
    return near.groupBy().agg(((at("_left") + at("_right")) / 2).alias(name))


def reason_counts(turns: DataFrame, reason: Column, *keys: str, default: str | None = None) -> DataFrame:
    """Histogram of a reason text; blank ones become ``default`` or are left out."""
    r = text_or(reason, default or "")
    out = turns.select(*keys, r.alias("reason"))
    if default is None:
        out = out.where("reason <> ''")
    return out.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def negative_evidence_counts(items: DataFrame) -> DataFrame:
    """Histograms by node, tier, scope and family in one grouping-sets pass; missing becomes 'unknown'.

    ``items``: one row per evidence with ``node, tier, scope, families`` (array).
    """
    one = items.select(text_or(F.col("node"), "unknown").alias("node"), text_or(F.col("tier"), "unknown").alias("tier"),
                       text_or(F.col("scope"), "unknown").alias("scope"), "families")
    base = one.groupingSets([["node"], ["tier"], ["scope"]], "node", "tier", "scope").agg(F.count(F.lit(1)).alias("n"))
    base = base.select(
        F.when(F.col("node").isNotNull(), "node").when(F.col("tier").isNotNull(), "tier").otherwise("scope").alias("kind"),
        F.coalesce("node", "tier", "scope").alias("key"), "n")
    fam = one.select(F.explode_outer("families").alias("f")).groupBy(text_or(F.col("f"), "unknown").alias("key")).agg(
        F.count(F.lit(1)).alias("n"))
    return base.unionByName(fam.select(F.lit("family").alias("kind"), "key", "n"))


def gate_audit_rows(turns: DataFrame) -> DataFrame:
    """Turns where the verifier accepted but a gate blocked; audit values win over turn values."""
    t = turns.where(F.col("verifier_called") & F.col("should_accept") & (text_or(F.col("block_reason")) != ""))
    pick = lambda a, b: F.coalesce(F.nullif(text_or(F.col(a)), F.lit("")), F.col(b))
    return t.withColumns({"audit_reason": pick("audit_block_reason", "block_reason"),
                          "audit_name": pick("audit_answer_name", "answer")})


# -- joins with cases ------------------------------------------------------------------------------------

def case_enrich(results: DataFrame, cases: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Blank result fields take the case's value."""
    c = cases.select("case_id", *[F.col(f).alias(f"_c_{f}") for f in fields])
    out = results.join(c, "case_id", "left")
    return out.withColumns({f: F.coalesce(F.nullif(text_or(F.col(f)), F.lit("")), F.col(f"_c_{f}"), F.lit("")) for f in fields}).select(
        *results.columns)


def qc_defaults(case_qc: Column, bench_qc: Column) -> tuple[Column, Column]:
    """Each QC status stands in for the other when one is blank."""
    case_text, bench_text = text_or(case_qc), text_or(bench_qc)
    case_final = F.when((case_text == "") & (bench_text == "eligible"), "eligible").otherwise(case_text)
    bench_final = F.when((bench_text == "") & (case_final != ""), F.when(case_final == "eligible", "eligible").otherwise("ineligible")).otherwise(bench_text)
    return case_final, bench_final


def select_cases(cases: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases named by the records, and the record ids no case has.

    ``records``: ``case_id, ord``; the first record of an id counts.
    """
    wanted = records.where(~blank(F.col("case_id").cast("string"))).groupBy("case_id").agg(F.min("ord").alias("ord"))
    return cases.join(wanted, "case_id"), wanted.join(cases.select("case_id"), "case_id", "left_anti")


def resume_pending(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases without a finished result."""
    return cases.join(results.select("case_id").distinct(), "case_id", "left_anti")
