"""Steps mended in round 4: the whole job is done, and what a session needs is looked up without meeting all links."""

import datetime
import tempfile

from evigraph.operators import actions as ac
from evigraph.operators import rank as k
from evigraph.operators import retrieve as r
from evigraph.plans import q_actions, q_audit
from evigraph.plans.views import Tables

TYPES = ("ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM", "SMALL")
LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def tables(spark, lines, n_parts, n_suppliers):
    """Tables of the lines ``(order, part, supplier, number, discount, flag, status)``; part names come from short word lists."""
    folder, day = tempfile.mkdtemp(), datetime.datetime(1996, 9, 13)
    spark.createDataFrame([(o, p, s, n, 5.0, 10.0, d, 0.02, f, st, day) for o, p, s, n, d, f, st in lines], LINE).write.parquet(f"{folder}/lineitem.parquet")
    words = [f"{x} {y}" for x in ("red", "blue", "hot", "cold", "old", "new", "large") for y in ("gear", "bolt", "rod", "ring", "anvil", "widget", "plate")]
    spark.createDataFrame([(p, words[p % len(words)], TYPES[p % 6], "b", 1 + p % 50) for p in range(n_parts)],
                          "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(s, f"Supplier {s}", 1, 100.0 * s) for s in range(n_suppliers)],
                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    status, priority = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    orders = sorted({x[0] for x in lines})
    spark.createDataFrame([(o, status[o % 3], priority[o % 5], 100000.0 + 60000 * (o % 2)) for o in orders],
                          "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, folder)


def test_conflicts_are_settled_among_all_evidence_of_a_disease(spark):
    """112 parts of one supplier, 16 of each noun; beyond the first 80 items there are others (F31)."""
    spark.createDataFrame([(p, f"w{p} {'gear' if p % 7 == 0 else 'cog'}", TYPES[p % 6], "b", 1 + p % 50) for p in range(112)],
                          "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{(folder := tempfile.mkdtemp())}/part.parquet")
    day = datetime.datetime(1996, 9, 13)
    spark.createDataFrame([(1, p, 1, p, 5.0, 10.0, 0.01, 0.02, "R", "F", day) for p in range(112)], LINE).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "s", 1, 9.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    got = q_audit.conflict_keep_best(Tables(spark, folder)).collect()
    assert sorted(int(x.node_id[1:]) for x in got if not x.conflict) == [p for p in range(112) if p % 7]
    assert [x.conflict for x in got if x.conflict] == ["gear"]
    assert q_audit.items(Tables(spark, folder)).count() == 80


def action_rows(spark):
    """Lists of four candidates with ties, a node in two rows, a node that many hold, a pool that holds a candidate twice."""
    names = ("hot ring", "cold bolt", "old gear", "ring gizmo", "red rod", "rod anvil")
    kinds = (("LabFinding", "lab", "needs_lab_test", "high"), ("ClinicalFinding", "symptom", "direct_ask", "low"), ("ImagingFinding", "imaging", "needs_imaging", "high"))
    items = []
    for c in range(4):
        for i in range(40):
            n = i * (c + 1) % 47
            label, hint, mode, cost = kinds[n % 3]
            items.append((f"D{c}", f"N{n}", 9000 - 100 * (i // 2), 85 if n % 2 else 100, names[n % 6], "MANIFESTS_AS", label, hint, mode, cost, 40 + n, n % 5 == 0))
    items += [(f"D{c}", "N0", 9500 - c, 100, "cold gear", "HAS_LAB_FINDING", "LabFinding", "lab", "needs_lab_test", "high", 30, True) for c in range(3)]
    items += [(f"X{c}", "N0", 10, 85, "hot ring", "MANIFESTS_AS", "LabFinding", "lab", "needs_lab_test", "high", 30, False) for c in range(100)]
    ev = spark.createDataFrame(items, "candidate_id string, node_id string, priority long, contradiction int, name string, rel string, label string, hint string, "
                                      "mode string, cost string, rel_w100 long, red_flag boolean")
    pool = spark.createDataFrame([(1, "D0"), (1, "D1"), (1, "D2"), (2, "D3"), (2, "D1"), (3, "D2"), (3, "D2"), (4, "D9"), (4, "D0"), (5, "D0"), (5, "X1"), (None, "D1")],
                                 "session_id long, candidate_id string")
    seen = spark.createDataFrame([(1, "N0"), (1, "N2"), (1, "N2"), (2, "N3"), *[(3, f"N{i}") for i in range(0, 46)], (None, "N1")], "session_id long, node_id string")
    return ev, pool, seen


def plain_signals(spark):
    """The same by frames that hold all links of the pool."""
    ev, pool, seen = action_rows(spark)
    held = pool.join(ev.select("candidate_id", "node_id"), "candidate_id")
    want = [(1, "ring", "hypothesis"), (1, "cold bolt", "verifier"), (1, None, "verifier"), (2, "old gear", "verifier"), (2, "gizmo", "hypothesis"), (5, "rod", "other")]
    texts = spark.createDataFrame(want, "session_id long, text string, source string")
    return r.r2_evidence(pool, ev, seen).drop("rank"), held, texts, pool


TAGS, TOKENS, COMMON = q_actions.TAGS, q_actions.TOKENS, q_actions.COMMON
SIGNALS = ("session_id", "candidate_id", "node_id", "name", "verifier", "hypothesis", "overlap", "gain", "novelty", "action_score", "tags", "exam_kind")


def brought(spark, *known):
    ev, pool, seen = action_rows(spark)
    texts = plain_signals(spark)[2]
    return r.r2_evidence(pool, ev, seen, known=[ac.asked_texts(texts, TAGS, TOKENS), *known], rivals=True, words=lambda n, h: ac.evidence_words(n, h, TAGS, TOKENS)).drop("rank")


def as_text(df, cols):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in x]) for x in df.select(*cols).collect())


def test_rows_that_know_their_session_give_the_signals_of_whole_frames(spark):
    rows, held, texts, pool = plain_signals(spark)
    preferred = pool.distinct().join(texts, "session_id")
    old = ac.action_signals(rows, held, preferred, TAGS, TOKENS, COMMON)
    new = ac.action_signals(brought(spark), None, None, TAGS, TOKENS, COMMON)
    assert as_text(old, SIGNALS) == as_text(new, SIGNALS)
    match = ("session_id", "candidate_id", "node_id", "verifier", "hypothesis")
    assert as_text(ac.recommended_match(rows, preferred, TAGS, TOKENS), match) == as_text(ac.recommended_match(brought(spark), None, TAGS, TOKENS), match)


def test_lists_of_a_session_do_what_frames_do(spark):
    """Exam states that come twice count twice; tests are named by kind (F8, F14)."""
    rows, held, texts, pool = plain_signals(spark)
    exams = spark.createDataFrame([(1, "general", "unknown", True), (1, "lab", "unknown", False), (1, "lab", "unknown", False), (2, "general", "done", False),
                                   (2, "general", "done", False), (5, "general", "not_done", True)], "session_id long, exam_kind string, availability string, asked boolean")
    said = spark.createDataFrame([(1, "general", "cold"), (1, "lab", "hot"), (2, "imaging", "large"), (2, "imaging", None)], "session_id long, exam_kind string, test string")
    old = ac.action_signals(rows, held, pool.distinct().join(texts, "session_id"), TAGS, TOKENS, COMMON)
    new = ac.action_signals(brought(spark, r.listed(exams, "exams"), r.listed(said, "mentioned")), None, None, TAGS, TOKENS, COMMON)
    (ask, fold), (ask2, fold2) = ac.verification_actions(old, exams), ac.verification_actions(new, None)
    assert as_text(ask, SIGNALS) == as_text(ask2, SIGNALS)
    cols = ("session_id", "candidate_id", "exam_question", "action_score", "n_items")
    assert as_text(fold, cols) == as_text(fold2, cols) and fold.count() > 0
    follow = lambda s, m: ac.exam_followup_rank(s.where("exam_kind IS NOT NULL"), m, keep=5, rules=q_actions.EXAM_RULES)
    cols = ("session_id", "candidate_id", "node_id", "name", "name_match", "followup_score", "rank")
    assert as_text(follow(old, said), cols) == as_text(follow(new, None), cols)


def test_a_session_does_not_meet_the_links_of_its_candidates(spark, monkeypatch):
    """The work of signals does not follow the length of the lists (F4, F8 to F10, F12 to F14)."""
    lines = [(o, p, o % 3, p % 7 + 1, 0.01 * (p % 9), "RAN"[(o + p) % 3], "FO"[p % 2]) for o in range(1, 13) for p in range(o % 4, 100, 5)]
    t = tables(spark, lines, 100, 3)
    met = []
    monkeypatch.setattr(ac, "action_signals", lambda rows, rivals, *a: met.append(rivals) or rows)
    q_actions.signals(t)
    assert met == [None]


def test_queries_of_actions_equal_their_sql(spark):
    """On tables of its own, with five candidates that share many parts."""
    import duckdb

    from evigraph.plans import catalog

    lines = [(o, (o * 7 + k * 11) % 48, (o + k) % 5, k + 1, 0.01 * ((o + k) % 9), "RAN"[(o + k) % 3], "FO"[(o * k) % 2]) for o in range(1, 60) for k in range(6)]
    t = tables(spark, lines, 48, 5)
    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier", "orders"):
        con.execute(f"create view {name} as select * from '{t.folder}/{name}.parquet/*.parquet'")
    for name in ("exam_followup_rank", "explorer_choice", "repair_action_rank"):
        got = catalog.QUERIES[name](spark, t.folder)
        cols = sorted(got.columns)
        want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall()
        near = lambda rows: sorted(str([round(float(v), 7) if isinstance(v, float) or hasattr(v, "quantize") else v for v in x]) for x in rows)
        assert near(map(tuple, got.select(*cols).collect())) == near(want) and want, name


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Join")


def test_statuses_meet_the_rows_of_a_session_in_one_move(spark):
    rows = spark.createDataFrame([(1, "D1", "N1", "a"), (1, "D1", "N2", "b"), (1, "D2", "N3", "a"), (1, "D2", "N4", None), (2, "D1", "N1", "a"), (None, "D1", "N1", "a")],
                                 "session_id long, candidate_id string, node_id string, name string").repartition(3)
    states = spark.createDataFrame([(1, "N1", "absent"), (1, None, "present"), (None, "N1", "present")], "session_id long, node_id string, polarity string")
    slots = spark.createDataFrame([(1, "N1", "present"), (1, "N2", "unclear"), (1, "a", "present"), (1, None, "present"), (2, "b", "absent")], "session_id long, slot_key string, polarity string")
    out = r.evidence_status(rows, states, slots)
    assert moves(out)[1] == 0 and out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(session_id") == 1
    got = {(x.session_id, x.node_id): (x.polarity, x.status, x.status_source) for x in out.collect()}
    assert got == {(1, "N1"): ("absent", "negative", "state"), (1, "N2"): ("unclear", "unknown", "slot"), (1, "N3"): ("present", "matched", "slot"),
                   (1, "N4"): ("unclear", "unknown", "none"), (2, "N1"): ("unclear", "unknown", "none"), (None, "N1"): ("unclear", "unknown", "none")}
    assert set(out.columns) == {*rows.columns, "polarity", "status", "status_source"}


def test_questions_meet_what_was_asked_in_one_move(spark):
    q = spark.createDataFrame([(1, f"N{i}", f"n{i}", i % 2, 0.5, 0.4, i / 10) for i in range(8)] + [(None, "N1", "x", 0, 0.1, 0.1, 0.1)],
                              "session_id long, node_id string, name string, red_flag int, weight double, gain double, priority double").repartition(3)
    asked = spark.createDataFrame([(1, "N7"), (1, "N7"), (1, "N99"), (1, None), (None, "N1"), (2, "N1")], "session_id long, node_id string")
    out = r.question_rank(q, asked, 5)
    assert moves(out)[1] == 0
    got = [(x.session_id, x.node_id, x.rank, round(x.question_score, 6)) for x in out.orderBy("session_id", "rank").collect()]
    assert got == [(None, "N1", 1, 0.35), (1, "N5", 1, 3.6), (1, "N3", 2, 3.4), (1, "N1", 3, 3.2), (1, "N6", 4, 1.7), (1, "N4", 5, 1.5)]


def test_matches_bring_the_rows_they_stand_for(spark):
    """Items and candidates that come twice, a candidate named by an item, an item without a match."""
    items = spark.createDataFrame([(1, "N1", "hot ring", "present"), (1, "N1", "hot ring", "present"), (1, "N2", "ring", "absent"), (1, "D2", "x", "present"), (1, "N9", "zzz", "present"),
                                   (2, "N5", "second", "unclear"), (None, "N1", "ring", "present")], "session_id long, node_id string, name string, polarity string")
    pool = spark.createDataFrame([(1, "D1", "first", 0.5), (1, "D1", "other", 0.7), (1, "D2", "second", 0.1), (2, "D2", "second", 0.2)],
                                 "session_id long, candidate_id string, candidate_name string, score double")
    pay = spark.createDataFrame([("D1", "N1", "hot ring", "A", "L"), ("D1", "N3", "ring", "B", "L"), ("D2", "N2", "cold ring", "A", "L"), ("D2", "N4", "old ring", "C", "M")],
                                "candidate_id string, node_id string, name string, rel string, label string")
    plain = k.payload_match(items, pool, pay)
    want = plain.join(items.select("session_id", "node_id", "polarity"), ["session_id", "node_id"]).join(pool.select("session_id", "candidate_id", "score"), ["session_id", "candidate_id"])
    got = k.payload_match(items, pool, pay, bring=("polarity", "score"))
    cols = ("session_id", "candidate_id", "node_id", "payload_id", "rel", "label", "match100", "polarity", "score")
    assert as_text(got, cols) == as_text(want, cols) and got.count() == 9


def test_anchors_are_summed_up_in_one_pass(spark):
    cols = "session_id long, candidate_id string, polarity string, resolution string, rel string, role string, scope string, score long, families array<string>, mode string, cost string, label string"
    role = ("definition_anchor", "disease_specific_anchor", "phenotype_support")
    rows = [(i % 3, f"D{i % 2}", "present", "clear", "A", role[i % 3], "exact_scope" if i % 2 else "competing_scope", 10 + i, ["x"] if i % 4 else [], "direct_ask", "low", "L") for i in range(24)]
    m = spark.createDataFrame(rows, cols)
    s, low = k.anchor_summary(m), k.low_cost_profile(m)
    assert moves(s)[1] == 0 and moves(low)[1] == 0
    assert {(x.session_id, x.candidate_id): x.competing for x in s.collect()} == {
        (a, f"D{b}"): sum(x[7] for x in rows if x[:2] == (a, f"D{b}") and x[6] == "competing_scope" and x[5] != "phenotype_support") for a in range(3) for b in range(2)}
    assert {(x.session_id, x.candidate_id): (x.low_cost_items, x.low_cost_families) for x in low.collect()}[0, "D0"] == (4, 2)
