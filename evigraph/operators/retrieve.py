"""Candidate and evidence retrieval for many sessions at once.

``links`` is the direction-independent edge frame of :func:`direction_union`:
``candidate_id, feature_id, rel, w100, dir100``.  Scores are float expressions over whole
counts, so they do not depend on the order in which rows were added up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import Order, position
from ..functions.tags import tags
from ..functions.text import contains_any, let, map_value, match_text
from ..functions.vocab import (
    BACKGROUND_MARKERS, CANDIDATE_LABELS, COLD_START_LABELS, CONTRADICTION_PRIORITY, CONTRADICTION_PRIORITY_OTHER,
    EVIDENCE_GROUPS, FAMILY_MARKERS, FAMILY_NAME, FEATURE_LABELS, FORWARD_CONFIDENCE, LABEL_COST, LABEL_GROUP,
    LABEL_MODE, NAME_TOKEN_SPLIT, R1_RELATIONS, RELATION_GROUP, RELATION_SPECIFICITY, RELATION_SPECIFICITY_OTHER,
    REVERSE_CONFIDENCE, SIBLING_RULES, WEAK_RELATIONS,
)
from ..sources.sinks import written


@dataclass(frozen=True)
class RetrievalConfig:
    """Limits and thresholds of retrieval."""

    cold_start_limit: int = 8
    r1_limit: int = 10
    rescue_limit: int = 8
    rescue_ids: int = 16
    sibling_limit: int = 12
    sibling_keywords: int = 12
    r2_limit: int = 10
    profile_limit: int = 12
    profile_group_limit: int = 4
    link_threshold: float = 0.72
    r1_min_score: float = 0.48
    rescue_min_score: float = 0.32
    rescue_bonus: float = 0.16
    rescue_cap: float = 1.4
    anchor_bonus: float = 0.35
    single_penalty: float = 0.18
    weak_single_penalty: float = 0.24


DEFAULT = RetrievalConfig()


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  The filter sits on the rank itself, so each map task keeps only k rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def beside_lead(pool: DataFrame, lead: Column, **fields: Column) -> DataFrame:
    """``fields`` of the row of the session that ``lead`` names, beside every row of the session.

    Sessions without such a row drop out.  A pool that lies session by session is not moved again, as it would be by a join.
    """
    found = F.collect_list(F.when(lead, F.struct(*[c.alias(n) for n, c in fields.items()]))).over(Window.partitionBy("session_id"))
    out = pool.where("session_id IS NOT NULL").withColumn("_lead", found).withColumn("_lead", F.explode("_lead"))
    return out.select(*pool.columns, *[F.col(f"_lead.{n}").alias(n) for n in fields])


def listed(frame: DataFrame, name: str) -> DataFrame:
    """One row per session (and candidate, if ``frame`` has it) with its rows of ``frame`` as the list ``name``."""
    keys = [c for c in ("session_id", "candidate_id") if c in frame.columns]
    return frame.where("session_id IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in frame.columns if c not in keys])).alias(name))


def beside(rows: DataFrame, frame: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with what ``frame`` holds for their session as the list ``name``; rows that bring the list already are not moved."""
    if name in rows.columns:
        return rows
    return rows.join(listed(frame, name), [c for c in ("session_id", "candidate_id") if c in frame.columns], "left")


# -- links -----------------------------------------------------------------------------------

def direction_union(edges: DataFrame, candidate_labels: Sequence[str] = CANDIDATE_LABELS,
                    feature_labels: Sequence[str] = FEATURE_LABELS, relations: Sequence[str] = R1_RELATIONS,
                    deal: Callable[[DataFrame], DataFrame] = lambda links: links) -> DataFrame:
    """Both edge directions as one set: feature -> candidate at full confidence, the reverse at less.

    ``deal`` may spread the links over more tasks before equal ones are dropped.
    """
    e = edges.where(F.col("rel").isin(*relations))
    into = e.where(F.col("dst_label").isin(*candidate_labels) & F.col("src_label").isin(*feature_labels)).select(
        F.col("dst").alias("candidate_id"), F.col("src").alias("feature_id"), "rel", "w100",
        F.lit(int(FORWARD_CONFIDENCE * 100)).alias("dir100"))
    away = e.where(F.col("src_label").isin(*candidate_labels) & F.col("dst_label").isin(*feature_labels)).select(
        F.col("src").alias("candidate_id"), F.col("dst").alias("feature_id"), "rel", "w100",
        F.lit(int(REVERSE_CONFIDENCE * 100)).alias("dir100"))
    return deal(into.union(away)).distinct()


def bidirectional_match(features: DataFrame, links: DataFrame) -> DataFrame:
    """Session features joined to the candidates they touch in either direction.

    Links of a feature that differ only in the candidate meet sessions as lists and are unfolded where the session
    lies.  Give ``links`` no more columns than are asked for.
    """
    rest = [c for c in links.columns if c != "candidate_id"]
    place = Window.partitionBy(*rest).orderBy("candidate_id")
    lists = links.withColumn("_chunk", F.floor((F.row_number().over(place) - 1) / CHUNK))
    lists = lists.groupBy(*rest, "_chunk").agg(F.collect_list(F.struct("candidate_id")).alias("_ids")).drop("_chunk")  # a struct keeps a null
    met = features.join(lists, "feature_id").repartition("session_id")
    return met.withColumn("_ids", F.explode("_ids")).select(*features.columns, *[F.col("_ids.candidate_id") if c == "candidate_id" else c for c in links.columns if c not in features.columns])


def feature_union(*frames: DataFrame) -> DataFrame:
    """Distinct present features ``(session_id, feature_id)`` from several sources."""
    out = frames[0].select("session_id", "feature_id")
    for f in frames[1:]:
        out = out.union(f.select("session_id", "feature_id"))
    return out.where("feature_id IS NOT NULL AND feature_id <> ''").distinct()


def not_in_filter(rows: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
    """Evidence rows whose node the session neither asked about nor already knows."""
    key = ["session_id", "node_id"]
    return rows.join(asked.select(*key), key, "left_anti").join(known.select(*key), key, "left_anti")


# -- scoring ------------------------------------------------------------------------------------

def relation_specificity(col: Column) -> Column:
    return map_value(col, RELATION_SPECIFICITY, RELATION_SPECIFICITY_OTHER)


def name_overlap(candidate: Column, evidence: Column, split: str = NAME_TOKEN_SPLIT) -> Column:
    """Containment either way, or a token of the evidence name of two or more characters inside the candidate's."""
    ok = (F.length(candidate) > 0) & (F.length(evidence) > 0)
    tokens = F.filter(F.split(evidence, split), lambda t: F.length(t) >= 2)
    hit = F.contains(candidate, evidence) | F.contains(evidence, candidate) | F.exists(
        tokens, lambda t: F.contains(candidate, t))
    return F.coalesce(ok & hit, F.lit(False))


def anchor_score(candidate_name: Column, evidence_name: Column, label: Column, rel: Column,
                 background: Sequence[str] = BACKGROUND_MARKERS, family_markers: Sequence[str] = FAMILY_MARKERS,
                 family: str = FAMILY_NAME) -> Column:
    """How specific one piece of evidence is to one candidate, in hundredths."""
    cand, ev = match_text(candidate_name), match_text(evidence_name)
    own = F.contains(cand, F.lit(family))
    marker, generic = contains_any(ev, family_markers), contains_any(ev, background)
    pathogen = (label == "Pathogen") | rel.isin("HAS_PATHOGEN", "DIAGNOSED_BY")

    def pick(mark_own, mark_other, gen_own, gen_other, other):
        return F.when(marker, F.when(own, mark_own).otherwise(mark_other)).when(
            generic, F.when(own, gen_own).otherwise(gen_other)).otherwise(other)

    return (
        F.when(F.length(ev) == 0, F.lit(None).cast("int"))
        .when(name_overlap(cand, ev), 100)
        .when(pathogen, pick(95, 35, 82, 25, 88))
        .when(label == "ImagingFinding", 72)
        .when(label.isin("LabFinding", "LabTest"), pick(82, 30, 72, 28, 55))
        .when(rel == "REQUIRES_DETAIL", 48)
        .when(generic & ~own, 30)
        .otherwise(45))


def link_summary(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links collapsed to one row per (candidate, feature) before any session joins them.

    Relation types are a closed vocabulary, so a bit mask stands for the set of types.
    The fields that rank candidates ride along, which saves a join per session later.
    """
    bit = {r: 1 << i for i, r in enumerate(RELATION_SPECIFICITY)}
    other = 1 << len(bit)
    out = links.groupBy("candidate_id", "feature_id").agg(
        F.count(F.lit(1)).alias("n_rel"),
        F.sum("dir100").alias("dir_sum"),
        F.max("anchor100").alias("anchor100"),
        F.bit_or(map_value(F.col("rel"), bit, other)).alias("types"))
    return out.join(candidates, "candidate_id")


def _type_stats(mask: Column) -> tuple[Column, Column, Column]:
    """Number of relation types in a mask, their summed specificity, and whether all are weak."""
    weights = [*RELATION_SPECIFICITY.items(), ("", RELATION_SPECIFICITY_OTHER)]
    on = [(name, w, F.when(mask.bitwiseAND(1 << i) != 0, 1).otherwise(0)) for i, (name, w) in enumerate(weights)]
    count = sum((f for _, _, f in on), F.lit(0))
    total = sum((f * w for _, w, f in on), F.lit(0))
    strong = sum((f for name, _, f in on if name not in WEAK_RELATIONS), F.lit(0))
    return count, total, (count > 0) & (strong == 0)


def semantic_score(total: Column, cfg: RetrievalConfig = DEFAULT, link: Column | None = None) -> Column:
    """Weighted candidate score; the weights are fixed values."""
    link = F.lit(0.0) if link is None else link
    coverage = F.least(F.col("matched_feature_count") / total, F.lit(1.0))
    relations = F.least(F.col("relation_count") / total, F.lit(1.0))
    specificity = F.coalesce(F.try_divide(F.col("spec100"), F.col("n_types")), F.lit(0.0)) / 100
    direction = F.col("_dir") / F.col("relation_count") / 100
    anchor = F.coalesce(F.col("anchor100"), F.lit(0)) / 100
    prior = F.when(F.col("candidate_label") == "Disease", 1.0).otherwise(0.7)
    penalty = (
        F.when((total <= 1) | (F.col("matched_feature_count") > 1) | (F.col("candidate_label") != "Disease"), 0.0)
        .when(F.col("only_weak"), cfg.weak_single_penalty).otherwise(cfg.single_penalty))
    score = (coverage * 0.34 + relations * 0.18 + specificity * 0.16 + prior * 0.14 + direction * 0.10
             + F.least(F.col("weight"), F.lit(1.0)) * 0.04 + link * 0.04 + anchor * cfg.anchor_bonus - penalty)
    return F.greatest(score, F.lit(0.0))


CHUNK = 64  # candidates of a feature in one row of its list
WIDE = 64  # features of a session beyond which its lists are dealt over several groups

_IDENTITY = ("candidate_id", "candidate_name", "candidate_label", "weight")
_STATS = ("n_rel", "n_match", "dir_sum", "anchor100", "types")


def _ranked(summary: DataFrame, by_features: bool) -> DataFrame:
    """The candidates of every feature, ``CHUNK`` in a row, in the order in which a session that holds only this feature ranks them."""
    rows = summary.groupBy("feature_id", *_IDENTITY).agg(
        F.sum("n_rel").alias("n_rel"), F.count(F.lit(1)).alias("n_match"), F.sum("dir_sum").alias("dir_sum"),
        F.max("anchor100").alias("anchor100"), F.bit_or("types").alias("types"))
    order = [F.desc("n_rel"), F.desc("weight"), F.col("candidate_name"), F.col("candidate_id")]
    if by_features:
        order = [F.desc("n_match"), *order]
    rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy("feature_id").orderBy(*order)))
    chunk = F.floor((F.col("_pos") - 1) / CHUNK).alias("_chunk")
    entry = F.struct("_pos", F.hash("candidate_id").alias("_hash"), *_IDENTITY, *_STATS)
    return written(rows.groupBy("feature_id", chunk).agg(F.collect_list(entry).alias("entries")), "ranked_links")


def _repeated(lists: DataFrame) -> DataFrame:
    """``session_id, feature_id, _hash`` of the candidates (by hash) that two features of a session share."""
    parts = F.ceil(F.col("feature_total") / WIDE).cast("int")
    part = lists.select(
        "session_id", "feature_id", "feature_total", "ids", parts.alias("_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    mine = F.filter("ids", lambda x: F.pmod(x, F.col("_parts")) == F.col("_part"))
    part = part.withColumn("ids", F.when(F.col("_parts") > 1, mine).otherwise(F.col("ids"))).drop("_parts")
    group = part.repartition("session_id", "_part").groupBy("session_id", "_part").agg(
        F.max("feature_total").alias("feature_total"), F.collect_list(F.struct("feature_id", "ids")).alias("_lists"))
    twice = let(F.sort_array(F.flatten(F.col("_lists.ids"))),
                lambda a: F.array_distinct(F.filter(a, lambda x, i: (i > 0) & (F.get(a, i - 1) == x))))
    group = group.withColumn("_twice", twice).where(F.size("_twice") > 0)
    one = group.select("session_id", "feature_total", "_twice", F.explode("_lists").alias("_l"))
    return one.select("session_id", "feature_total", F.col("_l.feature_id").alias("feature_id"),
                      F.explode(F.array_intersect("_l.ids", "_twice")).alias("_hash")).distinct()


def _scored(features: DataFrame, summary: DataFrame, limit: int, by_features: bool,
            cfg: RetrievalConfig, link_similarity: DataFrame | None, link_default: float, evidence: bool = False) -> DataFrame:
    """Pools of the sessions, cut to ``limit`` and scored; with ``evidence`` each candidate lists its features.

    A candidate that one feature of a session names and ``limit`` others of that feature precede is out: each
    of these has at least its counts in the session.  So a session takes the first of every feature's list,
    and of the rest only what two of its features share.  Lists meet sessions as rows of ``CHUNK`` hashes.
    """
    total = features.groupBy("session_id").agg(F.count(F.lit(1)).alias("feature_total"))
    rows = features.join(total, "session_id")
    ranked = _ranked(summary, by_features)
    fields = lambda e: F.struct(*[e[c].alias(c) for c in (*_IDENTITY, *_STATS)])
    head = ranked.where(F.col("_chunk") <= (limit - 1) // CHUNK).select(
        "feature_id", F.transform(F.filter("entries", lambda e: e["_pos"] <= limit), fields).alias("entries"))
    first = rows.join(head, "feature_id")
    shared = _repeated(rows.where("feature_total > 1").join(ranked.select("feature_id", F.col("entries._hash").alias("ids")), "feature_id"))
    tail = ranked.select("feature_id", F.explode("entries").alias("_e")).where(F.col("_e._pos") > limit).select(
        "feature_id", F.col("_e._hash").alias("_hash"), F.array(fields(F.col("_e"))).alias("entries"))
    more = shared.join(tail, ["feature_id", "_hash"])
    keep = ["session_id", "feature_total", *(["feature_id"] if evidence else [])]
    cols = [*keep, "entries"]
    matched = first.select(*cols).unionByName(more.select(*cols)).repartition("session_id").select(
        *keep, F.explode("entries").alias("_e")).select(*keep, "_e.*")
    # a candidate in the pool has met all of its features, so they are its evidence
    listed = [F.collect_set("feature_id").alias("evidence")] if evidence else []
    agg = matched.groupBy("session_id", *_IDENTITY, "feature_total").agg(
        F.sum("n_rel").alias("relation_count"), F.sum("n_match").alias("matched_feature_count"),
        F.sum("dir_sum").alias("_dir"), F.max("anchor100").alias("anchor100"), F.bit_or("types").alias("_types"), *listed)
    order = [F.desc("relation_count"), F.desc("weight"), F.col("candidate_name"), F.col("candidate_id")]
    if by_features:
        order = [F.desc("matched_feature_count"), *order]
    cut = top_k(agg, ["session_id"], order, limit, "pool_rank")
    n_types, spec, only_weak = _type_stats(F.col("_types"))
    cut = cut.withColumns({"n_types": n_types, "spec100": spec, "only_weak": only_weak})
    if link_similarity is not None:
        cut = cut.join(link_similarity, ["session_id", "candidate_id"], "left")
        link = F.coalesce("link_similarity", F.lit(0.0))
    else:
        link = F.lit(link_default)
    return cut.withColumn("score", semantic_score(F.col("feature_total"), cfg, link))


def r1_candidates(features: DataFrame, summary: DataFrame, cfg: RetrievalConfig = DEFAULT,
                  link_similarity: DataFrame | None = None, evidence: bool = False) -> DataFrame:
    """Top candidates of each session from its present features.

    ``features``: distinct ``(session_id, feature_id)``; ``summary`` from
    :func:`link_summary`.  The pool is cut to the limit by relation count first and scored
    afterwards.  With ``evidence`` the array of that name holds a candidate's features.
    """
    out = _scored(features, summary, cfg.r1_limit, False, cfg, link_similarity, 0.0, evidence)
    return out.where(F.col("score") >= cfg.r1_min_score)


def r1_rescue(observed: DataFrame, summary: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Second recall path from observed node ids: lower threshold, bonus, cap."""
    out = _scored(observed, summary, cfg.rescue_limit, True, cfg, None, 1.0)
    out = out.where(F.col("score") >= cfg.rescue_min_score)
    return out.withColumn("score", F.least(F.col("score") + cfg.rescue_bonus, F.lit(cfg.rescue_cap)))


def observed_ids(obs: DataFrame, order: Sequence[str], cfg: RetrievalConfig = DEFAULT,
                 background: Column | None = None) -> DataFrame:
    """First ids a session observed as present, clear or hedged, not shared background."""
    keep = (F.col("polarity") == "present") & F.col("resolution").isin("clear", "hedged")
    if background is not None:
        keep = keep & ~background
    first = obs.where(keep).groupBy("session_id", F.col("node_id").alias("feature_id")).agg(
        F.min(F.struct(*order)).alias("_o"))
    return top_k(first, ["session_id"], [F.col("_o"), F.col("feature_id")], cfg.rescue_ids).select("session_id", "feature_id")


def scope_siblings(observed_names: DataFrame, links_out: DataFrame, candidates: DataFrame,
                   rules: Sequence[tuple[str, Sequence[str]]] = SIBLING_RULES, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Candidates whose name holds a keyword that the session's observed names imply.

    Sessions with the same keywords have the same answer, so the ranking is made once per
    keyword set (the rules bound how many sets exist) and joined back.
    """
    named = observed_names.select("session_id", F.explode(tags(match_text(F.col("name")), rules)).alias("keyword"))
    keywords = [match_key for match_key, _ in rules]
    order = F.create_map(*[F.lit(x) for i, k in enumerate(keywords) for x in (k, i)])
    per = named.distinct().groupBy("session_id").agg(F.sort_array(F.collect_set(F.try_element_at(order, F.col("keyword")))).alias("_k"))
    per = per.withColumn("signature", F.slice("_k", 1, cfg.sibling_keywords)).drop("_k")
    sets = per.select("signature").distinct()
    text = match_text(F.col("candidate_name"))
    hits = candidates.select(
        "candidate_id", "candidate_name", "weight",
        F.explode(F.filter(F.array(*[F.when(F.contains(text, match_text(F.lit(k))), F.lit(i)) for i, k in enumerate(keywords)]),
                           lambda x: x.isNotNull())).alias("k"))
    pairs = sets.select("signature", F.explode("signature").alias("k")).join(hits, "k")
    pairs = pairs.groupBy("signature", "candidate_id", "candidate_name", "weight").agg(F.count(F.lit(1)).alias("matched_keywords"))
    stats = links_out.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("relation_count"))
    pairs = pairs.join(stats, "candidate_id", "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0)))
    best = top_k(pairs, ["signature"], [F.desc("matched_keywords"), F.desc("weight"), F.desc("relation_count"),
                                        F.col("candidate_name"), F.col("candidate_id")], cfg.sibling_limit)
    score = F.least(0.42 + F.col("matched_keywords") * 0.08 + F.least(F.col("relation_count"), F.lit(6)) * 0.025
                    + F.col("weight") * 0.1, F.lit(1.05))
    return per.join(best.withColumn("score", score), "signature").drop("signature")


def merge_pools(*pools: DataFrame) -> DataFrame:
    """Union of candidate pools, best score per candidate."""
    cols = ["session_id", "candidate_id", "candidate_name", "score"]
    out = pools[0].select(*cols)
    for p in pools[1:]:
        out = out.unionByName(p.select(*cols))
    return out.groupBy("session_id", "candidate_id").agg(
        F.max("score").alias("score"), F.max_by("candidate_name", "score").alias("candidate_name"))


def competition_rerank(pool: DataFrame) -> DataFrame:
    """Evidence only one candidate of the session has raises it, shared evidence lowers it.

    ``pool``: ``session_id, candidate_id, candidate_name, score, coverage, semantic, anchor100`` and the array
    ``evidence`` of the candidate, as :func:`r1_candidates` gives it.  A session has at most as many candidates
    as the limit of its pool, so they are compared side by side and the pool is not moved again.
    """
    session = Window.partitionBy("session_id")
    own = F.col("candidate_id")
    out = pool.withColumn("_all", F.collect_list(F.struct("candidate_id", "evidence")).over(session))
    of = lambda mine: F.array_distinct(F.flatten(F.transform(F.filter(
        "_all", lambda x: x["candidate_id"].eqNullSafe(own) if mine else ~x["candidate_id"].eqNullSafe(own)), lambda x: x["evidence"])))
    out = out.withColumn("_own", of(True)).withColumn("_unique", F.size(F.array_except("_own", of(False))))
    out = out.withColumns({"n_evidence": F.size("_own").cast("bigint"), "unique_evidence_count": F.col("_unique").cast("bigint")})
    out = out.withColumn("overlap_ratio", F.coalesce(
        F.try_divide(F.col("n_evidence") - F.col("unique_evidence_count"), F.col("n_evidence")), F.lit(0.0)))
    bonus = (F.col("unique_evidence_count") * 0.18 + F.col("coverage") * 0.20 + F.col("semantic") * 0.22
             + F.col("anchor100") / 100 * 0.35 - F.col("overlap_ratio") * 0.10)
    out = out.withColumn("competition_score", F.col("score") + bonus).drop("_all", "_own", "_unique", "evidence")
    return out.withColumn("rank", F.row_number().over(session.orderBy(F.desc("competition_score"), "candidate_name", "candidate_id")))


# -- evidence ------------------------------------------------------------------------------------

def contradiction_priority(col: Column) -> Column:
    return map_value(col, CONTRADICTION_PRIORITY, CONTRADICTION_PRIORITY_OTHER)


def default_mode(label: Column) -> Column:
    return map_value(label, LABEL_MODE, "")


def default_cost(label: Column) -> Column:
    return map_value(label, LABEL_COST, "")


def question_hint(label: Column) -> Column:
    return map_value(label, LABEL_GROUP, "symptom")


def evidence_group(hint: Column, label: Column, rel: Column, mode: Column) -> Column:
    """Display group: lab items tested by imaging or culture move there, then hint, label, relation."""
    lab = label.isin("LabFinding", "LabTest")
    return (
        F.when(lab & (mode == "needs_imaging"), "imaging")
        .when(lab & (mode == "needs_pathogen_test"), "pathogen")
        .when(hint.isin(*EVIDENCE_GROUPS), hint)
        .otherwise(F.coalesce(map_value(label, {k: v for k, v in LABEL_GROUP.items() if v != "detail"}),
                              map_value(rel, RELATION_GROUP), F.lit("detail"))))


def evidence_rows(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence of every candidate with its priority (hundredths of hundredths: node + edge weight, times direction)."""
    n = nodes.select(F.col("node_id").alias("feature_id"), "label", "name", F.col("w100").alias("node_w100"),
                     F.coalesce("mode", default_mode(F.col("label"))).alias("mode"),
                     F.coalesce("cost", default_cost(F.col("label"))).alias("cost"))
    out = links.join(n, "feature_id")
    return out.select(
        "candidate_id", F.col("feature_id").alias("node_id"), "label", "name", "rel", F.col("w100").alias("rel_w100"),
        "node_w100", "mode", "cost", "dir100",
        ((F.col("node_w100") + F.col("w100")) * F.col("dir100")).alias("priority"),
        contradiction_priority(F.col("rel")).alias("contradiction"),
        question_hint(F.col("label")).alias("hint"),
        F.col("label").isin("ClinicalFinding", "LabFinding", "ImagingFinding").alias("red_flag"))


RANK = Order(keys=("candidate_id",), by=("neg_priority", "neg_contradiction", "name", "node_id", "rel"),
             slices=("floor(neg_priority / 250)",))


BLOCK = 16  # list positions of a candidate that a session reads at once
HOLDERS = 64  # candidates of a node up to which they are told to each other without looking at sessions


def r2_evidence(pool: DataFrame, evidence: DataFrame, seen: DataFrame, cfg: RetrievalConfig = DEFAULT,
                known: Sequence[DataFrame] = (), rivals: bool = False, words: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For every (session, candidate) the best evidence the session has not asked or seen.

    ``seen``: ``session_id, node_id``, which may repeat.  The list positions that a session has seen are looked up
    first; with *n* of them among a candidate's list, the session reads the list up to limit + n, in blocks,
    and each row it keeps has its rank at once.

    Rows bring the columns of ``known``, frames of one row per session (see :func:`listed`): these join the pool,
    so that the rows need not be moved to meet them.  With ``rivals`` they also bring ``n_rivals``, the other
    candidates of the session that have rows; ``n_others``, the other candidates of the pool that hold the node;
    ``same``, the rows kept of this candidate and node; and ``first``, whether the row is the first of these.
    ``words`` is what is read of a name and its ``hint``: it is asked for once per list row, not per session.
    """
    ranked = evidence.withColumns({"neg_priority": -F.col("priority"), "neg_contradiction": -F.col("contradiction")})
    ranked = written(position(ranked, RANK, "list_pos").drop("neg_priority", "neg_contradiction"), "ranked_evidence")
    key = ["session_id", "candidate_id"]
    p = pool.groupBy(*key).agg(F.count(F.lit(1)).alias("_times"))
    met = p.select(*key).join(seen.select("session_id", "node_id"), "session_id").join(
        ranked.select("candidate_id", "node_id", "list_pos"), ["candidate_id", "node_id"])
    p = p.join(met.groupBy(*key).agg(F.collect_set("list_pos").alias("_seen")), key, "left")
    p = written(p.withColumn("_seen", F.coalesce("_seen", F.array().cast("array<bigint>"))), "pool_seen")
    far = cfg.r2_limit + (p.agg(F.max(F.size("_seen"))).first()[0] or 0)  # the last list position that any session reads
    if rivals:
        p = p.where("session_id IS NOT NULL").join(_held(p, ranked, far), key, "left")
        p = p.join(ranked.groupBy("candidate_id").agg(F.max("list_pos").alias("_n")), "candidate_id")
        left = F.when(F.col("_n") > F.size("_seen"), 1).otherwise(0)
        p = p.withColumn("n_rivals", F.sum(left).over(Window.partitionBy("session_id")) - 1).drop("_n")
    for frame in known:
        p = p.join(frame, [c for c in key if c in frame.columns], "left")
    more = [c for c in p.columns if c not in (*key, "_times", "_seen", "_held")]
    last = F.floor((F.size("_seen") + (cfg.r2_limit - 1)) / BLOCK)
    p = p.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    e = ranked.where(F.col("list_pos") <= far)
    if words is not None:
        e = e.withColumn("words", words(F.col("name"), F.col("hint")))
    if rivals:
        fields = [c for c in ("list_pos", "name", "label", "hint", "mode", "words") if c in e.columns]
        twins = F.collect_list(F.struct(*fields)).over(Window.partitionBy("candidate_id", "node_id"))
        e = e.withColumn("same", twins).withColumn("same", F.when(F.size("same") > 1, F.col("same")))
    listing = [c for c in e.columns if c not in ("candidate_id", "same")]
    e = e.withColumn("_block", F.floor((F.col("list_pos") - 1) / BLOCK))
    rows = p.join(e, ["candidate_id", "_block"]).where(~F.array_contains("_seen", F.col("list_pos")))
    # a candidate that the pool holds several times has each row as often
    before = lambda pos: (pos - 1 - F.size(F.filter("_seen", lambda x: x < pos))) * F.col("_times")
    rows = rows.withColumn("_before", before(F.col("list_pos"))).where(F.col("_before") < cfg.r2_limit)
    if rivals:
        kept = F.filter("same", lambda x: before(x["list_pos"]) < cfg.r2_limit)
        rows = rows.withColumns({
            "n_others": F.coalesce(F.size(F.filter("_held", lambda x: x == F.col("list_pos"))), F.lit(0)),
            "same": F.when(F.col("same").isNull(), F.array(F.struct(*fields))).otherwise(kept)})
        rows = rows.withColumn("_first", F.array_min(F.transform("same", lambda x: x["list_pos"])) == F.col("list_pos"))
        more += ["n_others", "same", "first"]
    end = F.least(F.col("_before") + F.col("_times"), F.lit(cfg.r2_limit))
    rows = rows.withColumn("rank", F.explode(F.sequence(F.col("_before") + 1, end)))
    if rivals:
        rows = rows.withColumn("first", F.col("_first") & (F.col("rank") == F.col("_before") + 1))
    return rows.select(*key, *listing, *more, F.col("rank").cast("int").alias("rank"))


def _held(pool: DataFrame, ranked: DataFrame, far: int) -> DataFrame:
    """``session_id, candidate_id, _held``: list positions, up to ``far``, whose node another candidate of the session holds, once for each.

    A node that few candidates hold tells them of each other, whatever the sessions.  For the others, only
    candidates that some session has side by side are compared.
    """
    me = pool.select("session_id", "candidate_id").distinct()
    pairs = me.join(me.withColumnRenamed("candidate_id", "_other"), "session_id").where(F.col("candidate_id") != F.col("_other"))
    top = ranked.where(F.col("list_pos") <= far).select("candidate_id", "node_id", "list_pos")
    holders = ranked.select(F.col("candidate_id").alias("_other"), "node_id").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("node_id")))
    narrow = top.join(holders.where(F.col("_n") <= HOLDERS).drop("_n"), "node_id").where(F.col("candidate_id") != F.col("_other"))
    wide = holders.where(F.col("_n") > HOLDERS).drop("_n")
    side = pairs.select("candidate_id", "_other").distinct()
    wide = top.join(wide.select("node_id").distinct(), "node_id", "left_semi").join(side, "candidate_id").join(wide, ["_other", "node_id"])
    cols = ["candidate_id", "_other", "list_pos"]
    shared = narrow.select(*cols).unionByName(wide.select(*cols)).groupBy("candidate_id", "_other").agg(F.collect_list("list_pos").alias("_at"))
    return pairs.join(shared, ["candidate_id", "_other"]).groupBy("session_id", "candidate_id").agg(F.flatten(F.collect_list("_at")).alias("_held"))


def profile_score() -> Column:
    """Sort score of evidence in a profile."""
    return (F.col("priority") / 10000 + F.col("contradiction") / 100 * 0.45 + F.col("rel_w100") / 100 * 0.2
            + F.col("node_w100") / 100 * 0.1)


def dedupe_best_row(evidence: DataFrame) -> DataFrame:
    """Best-scored relation per candidate and node."""
    rest = F.struct(*[c for c in evidence.columns if c not in ("candidate_id", "node_id")])
    scored = evidence.withColumn("sort_score", profile_score()).withColumn("_row", rest)
    best = scored.groupBy("candidate_id", "node_id").agg(
        F.max("sort_score").alias("sort_score"), F.max_by("_row", F.struct("sort_score", "rel")).alias("_row"))
    return best.select("candidate_id", "node_id", "sort_score", "_row.*")


def per_group_cap(rows: DataFrame, keys: Sequence[str], group: str, order: Sequence[Column], per_group: int, overall: int) -> DataFrame:
    """At most ``per_group`` rows of each group and ``overall`` rows in all, in rank order."""
    capped = top_k(rows, [*keys, group], order, per_group, "group_rank")
    return top_k(capped, keys, order, overall, "profile_rank")


def _with_group(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("grp", evidence_group(F.col("hint"), F.col("label"), F.col("rel"), F.col("mode")))


def grouped_evidence(evidence: DataFrame) -> DataFrame:
    """All evidence of every candidate, deduplicated, with its group."""
    return _with_group(dedupe_best_row(evidence))


def evidence_profile(evidence: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Per candidate: dedupe, first rows by score, group, caps.  The session does not matter here."""
    best = dedupe_best_row(evidence)
    order = [F.desc("sort_score"), F.col("name"), F.col("node_id")]
    cut = top_k(best, ["candidate_id"], order, cfg.profile_limit, "pre_rank")
    return per_group_cap(_with_group(cut), ["candidate_id"], "grp", order, cfg.profile_group_limit, cfg.profile_limit)


def evidence_status(profile: DataFrame, states: DataFrame, slots: DataFrame) -> DataFrame:
    """Status of each (session, node): evidence state by id, else slot by id or name, else unknown.

    ``states``: ``session_id, node_id, polarity``, one row per node; ``slots``: ``session_id, slot_key, polarity``
    with one row per key a slot answers to (id and names).  Give ``profile`` no more columns than are
    asked for: every row of it is moved.
    """
    # what is known goes beside the rows as rows of its own: all of a session meets in one move, where joins would need one for each key
    mark = lambda df, node, name, kind: df.select("session_id", node.alias("node_id"), name.alias("name"), F.col("polarity").alias("_mark"), F.lit(kind).alias("_kind"))
    key, name = F.col("slot_key"), profile.schema["name"].dataType
    known = mark(states.where("node_id IS NOT NULL"), F.col("node_id"), F.lit(None).cast(name), 1).unionByName(mark(slots.where("slot_key IS NOT NULL"), key, key, 2))
    rows = profile.unionByName(known.where("session_id IS NOT NULL"), allowMissingColumns=True).repartition("session_id")
    of = lambda kind, by: F.max(F.when(F.col("_kind") == kind, F.col("_mark"))).over(Window.partitionBy("session_id", by))
    out = rows.withColumns({"_p1": of(1, "node_id"), "_p2": of(2, "node_id")}).withColumn("_p3", of(2, "name"))
    out = out.where("_kind IS NULL").drop("_kind", "_mark")
    p = F.coalesce("_p1", "_p2", "_p3")
    return out.withColumns({
        "polarity": F.coalesce(p, F.lit("unclear")),
        "status": F.when(p == "present", "matched").when(p == "absent", "negative").otherwise("unknown"),
        "status_source": F.when(F.col("_p1").isNotNull(), "state").when(F.col("_p2").isNotNull() | F.col("_p3").isNotNull(), "slot")
        .otherwise("none")}).drop("_p1", "_p2", "_p3")


def profile_status_counts(profile: DataFrame) -> DataFrame:
    c = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return profile.groupBy("session_id", "candidate_id").agg(c("matched"), c("negative"), c("unknown"))


def outer_profile(candidates: DataFrame, links: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Candidates whose name holds a keyword, with their evidence if they have any."""
    hit = candidates.where(contains_any(F.lower("candidate_name"), keywords))
    n = [F.when(F.contains(F.lower("candidate_name"), F.lit(k)), 1).otherwise(0) for k in keywords]
    hit = hit.withColumn("matched_keywords", sum(n, F.lit(0)))
    out = hit.join(links, "candidate_id", "left")
    return out.groupBy("candidate_id", "candidate_name", "matched_keywords").agg(
        F.count("feature_id").alias("relation_count"), F.count_distinct("feature_id").alias("feature_count"))


# -- questions -----------------------------------------------------------------------------------

def cold_start(nodes: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """First questions: label priority, accessibility, weight, name."""
    n = nodes.where(F.col("label").isin(*COLD_START_LABELS))
    n = n.withColumns({
        "label_priority": F.when(F.col("label").isin("RiskFactor", "PopulationGroup"), 3)
        .when(F.col("label") == "ClinicalFinding", 2).otherwise(1),
        "access100": F.when(F.coalesce("cost", F.lit("")) == "low", 25)
        .when(F.coalesce("mode", F.lit("")).isin("direct_ask", "history_known"), 20).otherwise(0)})
    return n.orderBy(F.desc("label_priority"), F.desc("access100"), F.desc("w100"), "name", "node_id").limit(cfg.cold_start_limit)


def candidate_topk(pool: DataFrame, k: int) -> DataFrame:
    return top_k(pool, ["session_id"], [F.desc("score"), F.col("candidate_name"), F.col("candidate_id")], k)


def question_score(red_flag: Column, weight: Column, gain: Column, priority: Column, asked: Column) -> Column:
    """Fixed weights of the next-question policy."""
    return red_flag * 2.0 + weight * 1.0 + gain * 1.5 + priority - F.when(asked, 3.0).otherwise(0.0)


def with_asked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` with the flag ``asked``: the session asked about the node.  Rows and ``asked`` (which may repeat) are moved to the session, once."""
    marks = asked.where("session_id IS NOT NULL AND node_id IS NOT NULL").select("session_id", "node_id", F.lit(True).alias("_mark"))
    both = rows.unionByName(marks, allowMissingColumns=True).repartition("session_id")
    flag = F.max(F.coalesce("_mark", F.lit(False))).over(Window.partitionBy("session_id", "node_id"))
    return both.withColumn("asked", flag).where("_mark IS NULL").drop("_mark")


def question_rank(questions: DataFrame, asked: DataFrame | None, k: int) -> DataFrame:
    """Best next questions per session; an asked node pays the repeat penalty.  Without ``asked`` the questions bring that flag."""
    q = questions if asked is None else with_asked(questions, asked)
    score = question_score(F.col("red_flag").cast("int"), F.col("weight"), F.col("gain"), F.col("priority"), F.col("asked"))
    q = q.withColumn("question_score", score).drop("asked")
    return top_k(q, ["session_id"], [F.desc("question_score"), F.col("name"), F.col("node_id")], k)


def link_confidence(links: DataFrame, graph: DataFrame, cfg: RetrievalConfig = DEFAULT) -> DataFrame:
    """Sessions whose best link is trusted, with the mean link similarity of each candidate.

    ``links``: ``session_id, name, feature_id, sim100``; ``graph``: ``candidate_id, feature_id``.
    Similarities are given in whole hundredths so that the mean is exact.  Untrusted sessions leave before any
    candidate is met; the candidates of a feature meet a session as lists and are unfolded where it lies.
    """
    rows = links.where("session_id IS NOT NULL").repartition("session_id").groupBy("session_id", "name", "feature_id").agg(F.max("sim100").alias("sim100"))
    rows = rows.withColumn("sim100", F.max("sim100").over(Window.partitionBy("session_id", "name")))
    rows = rows.withColumn("_top", F.max("sim100").over(Window.partitionBy("session_id")))
    rows = rows.where(F.col("name").isNotNull() & (F.col("_top") >= round(cfg.link_threshold * 100))).drop("_top")
    place = Window.partitionBy("feature_id").orderBy("candidate_id")
    lists = graph.select("candidate_id", "feature_id").distinct().withColumn("_chunk", F.floor((F.row_number().over(place) - 1) / CHUNK))
    lists = lists.groupBy("feature_id", "_chunk").agg(F.collect_list(F.struct("candidate_id")).alias("ids")).drop("_chunk")  # a struct keeps a null
    met = rows.join(lists, "feature_id").select("session_id", "name", "sim100", "ids").repartition("session_id")
    met = met.select("session_id", "name", "sim100", F.explode("ids").alias("_c")).select("session_id", "name", "sim100", "_c.candidate_id")
    met = met.groupBy("session_id", "candidate_id", "name").agg(F.max("sim100").alias("sim100"))
    return met.groupBy("session_id", "candidate_id").agg((F.sum("sim100") / F.count(F.lit(1)) / 100).alias("link_similarity"))
