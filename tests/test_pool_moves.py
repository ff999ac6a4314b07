"""Steps behind the pools: what they return, and that a pool that lies session by session stays where it is."""

import numpy as np
import pyarrow as pa

from evigraph.llm import shingle_join
from evigraph.operators import actions as ac
from evigraph.operators import rank as k
from evigraph.operators import retrieve as r
from evigraph.plans import q_rank, q_retrieve

REPAIR = ("session_id long, candidate_id string, candidate_name string, score double, rank int, reject_reason string, observed long, exact long, "
          "family long, anchor_tier string, alternative boolean, times long, costly_gap boolean")


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Join")


def repair_rows(spark):
    def row(s, c, rank, reason, exact=0):
        return (s, f"S{c}", f"n{c}", 1.0 / c, rank, reason, exact, exact, 0, "speculative", rank == 2, 2, False)
    rows = [row(1, c, c, "missing_key_support", 0 if c == 1 else 60000 * c) for c in range(1, 6)]
    rows += [row(2, c, c, "strong_alternative_not_ruled_out") for c in range(1, 5)]
    rows += [row(3, 2, 2, "missing_key_support"), row(None, 1, 1, "missing_key_support"), row(None, 2, 2, "missing_key_support")]
    return spark.createDataFrame(rows, REPAIR).repartition(4, "session_id")


def test_repair_scope_compares_with_the_leader_in_place(spark):
    out = ac.repair_scope(repair_rows(spark))
    assert moves(out) == (1, 0)
    got = {(x.session_id, x.candidate_id, x.scope_rank) for x in out.collect()}
    assert got == {(1, "S1", 1), (1, "S2", 2), (1, "S3", 3), (2, "S2", 1), (2, "S3", 2), (2, "S4", 3)}


def test_escalation_compares_with_the_leader_in_place(spark):
    out = k.escalate(repair_rows(spark))
    assert moves(out) == (1, 0)
    got = {(x.session_id, x.leader, x.candidate_id, x.rival_rank, x.reasons) for x in out.collect()}
    assert got == {(1, "S1", f"S{c}", 6 - c, "zero_anchor,repeated_rejection") for c in (3, 4, 5)}


def test_competition_takes_the_evidence_of_the_pool(spark):
    rows = [(1, "S1", "a", 1.0, 1.0, 1.0, 50, ["P1", "P2"]), (1, "S2", "b", 1.0, 1.0, 1.0, 50, ["P2"]), (1, "S3", "c", 2.0, 1.0, 1.0, 50, []),
            (2, "S1", "a", 1.0, 1.0, 1.0, 50, ["P1"]), (2, "S1", "z", 1.0, 1.0, 1.0, 50, ["P1", "P3"])]
    pool = spark.createDataFrame(rows, "session_id long, candidate_id string, candidate_name string, score double, coverage double, "
                                       "semantic double, anchor100 int, evidence array<string>").repartition(4, "session_id")
    out = r.competition_rerank(pool)
    assert moves(out) == (1, 0)
    got = {(x.session_id, x.candidate_name): (x.n_evidence, x.unique_evidence_count, x.overlap_ratio, x.rank) for x in out.collect()}
    assert got == {(1, "a"): (2, 1, 0.5, 2), (1, "b"): (1, 0, 1.0, 3), (1, "c"): (0, 0, 0.0, 1), (2, "a"): (2, 2, 0.0, 1), (2, "z"): (2, 2, 0.0, 2)}


def test_a_pool_lists_all_features_of_its_candidates(spark):
    links = [(f"S{c}", f"P{f}") for f in (1, 2) for c in range(30)] + [("S40", "P2")]
    summary = spark.createDataFrame([(c, f, 1, 100, 40, 1, c, "Disease", 0.5) for c, f in links], "candidate_id string, feature_id string, n_rel long, "
                                    "dir_sum long, anchor100 int, types int, candidate_name string, candidate_label string, weight double")
    have = spark.createDataFrame([(1, "P1"), (1, "P2"), (2, "P2")], "session_id long, feature_id string")
    got = {(x.session_id, x.candidate_id): sorted(x.evidence) for x in r.r1_candidates(have, summary, evidence=True).collect()}
    assert len(got) == 20 and all(v == (["P1", "P2"] if s == 1 else ["P2"]) for (s, _), v in got.items())


def test_link_confidence_leaves_out_untrusted_sessions_and_counts_a_name_once(spark):
    links = spark.createDataFrame(
        [(1, "a", "P1", 80), (1, "a", "P2", 60), (1, "b", "P3", 51), (2, "a", "P1", 71), (3, None, "P1", 99), (3, "b", "P3", 52), (None, "a", "P1", 90)],
        "session_id long, name string, feature_id string, sim100 long")
    graph = spark.createDataFrame([(f"S{c}", "P1") for c in range(150)] + [("S0", "P2"), ("S0", "P2"), ("S0", "P3"), ("S200", "P2"), (None, "P2")],
                                  "candidate_id string, feature_id string")
    out = r.link_confidence(links, graph)
    got = {(x.session_id, x.candidate_id): x.link_similarity for x in out.collect()}
    assert got == {(1, "S0"): 131 / 2 / 100, (1, "S200"): 0.8, (1, None): 0.8, (3, "S0"): 0.52, **{(1, f"S{c}"): 0.8 for c in range(1, 150)}}


def test_profiles_meet_sessions_without_unasked_columns(spark, monkeypatch):
    seen, status = [], r.evidence_status
    monkeypatch.setattr(r, "evidence_status", lambda rows, *a: seen.append(rows.columns) or status(rows, *a))
    q_retrieve.session_profile(one_session(spark))
    assert set(seen[0]) == {"session_id", "candidate_id", "node_id", "name", "grp", "profile_rank"}


def test_lines_meet_candidates_without_text(spark):
    t = one_session(spark)
    plan = q_rank.related(t)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[:plan.index("Join")]
    assert "delta" in first and "polarity" not in first


def one_session(spark):
    """Tables of one session, its pool given."""
    import datetime
    import tempfile

    from evigraph.plans.views import Tables

    folder = tempfile.mkdtemp()
    day = datetime.datetime(1996, 9, 13)
    spark.createDataFrame([(1, 1, 1, 1, 5.0, 10.0, 0.01, 0.02, "R", "F", day)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "hot rod", "LARGE", "b", 30)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "s", 1, 9.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    t = Tables(spark, folder)
    t.__dict__["_top3"] = spark.createDataFrame([(1, "S1", "s", 1.0, 1)], "session_id long, candidate_id string, candidate_name string, score double, rank int")
    return t


def test_shared_hashes_are_counted_once_per_id_in_rows_that_do_not_grow_with_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    found = [(np.unique(rng.integers(-2**63, 2**63 - 1, 400)), rng) for _ in range(3)]
    found = [pa.RecordBatch.from_arrays([pa.array(np.sort(np.r_[ids, [7, 8]])), pa.array(r.integers(1, 9, len(ids) + 2))], names=["id", "shared"]) for ids, r in found]
    monkeypatch.setattr(shingle_join, "_shared", lambda batches: iter(batches))
    monkeypatch.setattr(shingle_join, "COUNT_HELD", 100)
    packed = list(shingle_join._packed_counts(found))
    assert all(b.num_rows <= shingle_join.COUNT_PARTS for b in packed)
    want = {}
    for b in found:
        for i, n in zip(*[c.to_pylist() for c in b.columns]):
            want[i] = want.get(i, 0) + n
    got = [x for b in shingle_join._summed(packed) for x in zip(*[c.to_pylist() for c in b.columns])]
    assert dict(got) == want and len(got) == len(want)
    assert list(shingle_join._summed([])) == []
