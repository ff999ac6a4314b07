from pyspark.sql import functions as F

from evigraph.operators import checks, graph
from evigraph.operators import records as rc


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, label string, name string, canonical_name string, occurrence_count bigint, w100 bigint, detail string")


def edges(spark, rows):
    return spark.createDataFrame(rows, "edge_id string, type string, source_id string, target_id string, occurrence_count bigint, w100 bigint")


def test_apply_aliases_merges_deletes_and_is_idempotent(spark):
    n = nodes(spark, [("d", "Disease", "D", "D", 1, 50, "minimal"), ("a", "Pathogen", "CMV", "CMV", 2, 10, "minimal"),
                      ("b", "Pathogen", "cytomegalovirus", "cytomegalovirus", 3, 90, "full"), ("x", "Pathogen", "junk", "junk", 1, 1, "minimal"),
                      ("l", "LabFinding", "alone", "alone", 1, 1, "minimal")])
    e = edges(spark, [("1", "HAS_PATHOGEN", "d", "a", 1, 10), ("2", "HAS_PATHOGEN", "d", "b", 2, 20), ("3", "HAS_PATHOGEN", "d", "x", 1, 5),
                      ("4", "HAS_PATHOGEN", "a", "b", 1, 5), ("5", "HAS_PATHOGEN", "d", "nowhere", 1, 5)])
    files = spark.createDataFrame([(1, "Pathogen", "cytomegalovirus", "CMV")], "file int, label string, canonical string, alias string")
    alias = graph.alias_index(files)
    gone = spark.createDataFrame([("Pathogen", "Junk")], "label string, name string")
    out = graph.apply_aliases(n, e, alias, gone)
    got = {r.canonical_name: (r.occurrence_count, r.w100, r.detail) for r in out["nodes"].collect()}
    assert got == {"D": (1, 50, "minimal"), "cytomegalovirus": (5, 90, "full")}
    assert [(r.occurrence_count, r.w100) for r in out["edges"].collect()] == [(3, 20)]
    kinds = {r.disposition: r.n for r in out["remap"].groupBy("disposition").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"remapped": 2, "deleted": 1, "self_loop": 1, "unmapped": 1}
    again = graph.apply_aliases(out["nodes"].select(n.columns), out["edges"].select(e.columns), alias, gone)
    assert sorted(r.node_id for r in again["nodes"].collect()) == sorted(r.node_id for r in out["nodes"].collect())
    assert sorted(r.edge_id for r in again["edges"].collect()) == sorted(r.edge_id for r in out["edges"].collect())


def test_conflicting_alias_is_reported_and_rejected(spark):
    files = spark.createDataFrame([(1, "Pathogen", "A", "x"), (2, "Pathogen", "B", "x"), (2, "Pathogen", "B", "y")], "file int, label string, canonical string, alias string")
    c = graph.alias_conflicts(files).collect()
    assert [(r.akey, r.first_canonical, r.last_canonical) for r in c] == [("x", "A", "B")]
    m = spark.createDataFrame([("1", "Pathogen", "x", "y")], "id string, label string, name string, alt string")
    ok, bad = graph.alias_resolve_strict(m, graph.alias_index(files), ["name", "alt"], "id")
    assert ok.count() == 0 and [(r.first_canonical, r.last_canonical) for r in bad.collect()] == [("A", "B")]
    last = graph.alias_index(files, last_file_wins=True)
    assert {r.akey: r.canonical for r in last.collect()} == {"x": "B", "y": "B", "b": "B"}


def test_upsert_keeps_old_values(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, x string, y int")
    delta = spark.createDataFrame([("2", None, 9), ("3", "c", 3)], "id string, x string, y int")
    assert sorted(tuple(r) for r in graph.upsert(base, delta, ["id"]).collect()) == [("1", "a", 1), ("2", "b", 9), ("3", "c", 3)]


def test_first_failing_check_wins(spark):
    cols = "node_id string, label string, name string, weight double, detail string, mode string, cost string, has_attributes boolean, test_id string, operator string, value double, value_text string, reference_text string, unit string, definition string"
    rows = [("1", "LabFinding", "x", 0.5, "full", None, None, True, "t", ">", 1.0, None, None, None, None),
            ("", "Nope", "", 5.0, "?", None, None, True, None, None, None, None, None, None, None),
            ("2", "Disease", "ok", 1.0, "minimal", "direct_ask", "low", False, None, None, None, None, None, None, None)]
    got = [r.e for r in spark.createDataFrame(rows, cols).select(checks.node_error().alias("e")).collect()]
    assert got == ["LAB_FINDING_MISSING_UNIT", "NODE_INVALID_ID", None]


def test_lab_operator_order(spark):
    f = F.lit(False)
    texts = ["CD4 >= 5", "x < 3", "结果阳性", "高于检测下限 阳性", "3 ~ 5", "plain", "转阴"]
    got = [r.o for r in spark.createDataFrame([(t,) for t in texts], "t string").select(checks.infer_lab_operator(F.col("t"), f, f).alias("o")).collect()]
    assert got == [">=", "<", "positive", "above_detection_limit", "between", None, "becomes_negative"]


def test_direct_replies(spark):
    want = {"有。": "positive", "没有的": "negative", "说不上来！": "uncertain", "无法说": "negative", "今天天气好": None, "是吧": "positive"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.r for r in df.select("t", rc.direct_reply(F.col("t")).alias("r")).collect()} == want


def test_entity_link_prefers_exact(spark):
    n = spark.createDataFrame([("1", "肺孢子菌肺炎", ["PCP"]), ("2", "肺炎", [])], "node_id string, name string, aliases array<string>")
    s = spark.createDataFrame([("pcp?", "PCP", "alias_normalization"), ("肺炎", "肺炎", "raw")], "mention string, surface string, rule string")
    got = {r.mention: (r.node_id, r.exact) for r in rc.entity_link(s, n).collect()}
    assert got == {"pcp?": ("1", True), "肺炎": ("2", True)}
