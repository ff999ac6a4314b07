"""Steps that queries share are computed once and move little."""

from pyspark.sql import functions as F

from evigraph.operators import retrieve as r
from evigraph.plans import q_replay
from evigraph.plans.views import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_meet_sessions_as_lists(spark):
    links = [(f"c{i:03d}", "f1", "r1", 100) for i in range(150)] + [("c001", "f2", "r1", 65), (None, "f2", "r2", 65)] + [("c002", "f1", "r1", 100)]
    links = spark.createDataFrame(links, "candidate_id string, feature_id string, rel string, dir100 int")
    features = spark.createDataFrame([(1, "f1"), (1, "f2"), (2, "f2"), (3, "f9"), (None, "f2")], "session_id bigint, feature_id string")
    out = r.bidirectional_match(features, links)
    assert "collect_list" in plan(out)
    cols = ["session_id", "feature_id", "candidate_id", "rel", "dir100"]
    key = lambda x: str(tuple(x))
    assert sorted(out.select(*cols).collect(), key=key) == sorted(features.join(links, "feature_id").select(*cols).collect(), key=key)


def test_focused_cases_are_computed_once(spark, sf):
    t = Tables(spark, sf)
    assert q_replay.focus_cases(t) is q_replay.focus_cases(t)
    assert q_replay.focus_correct(t) is q_replay.focus_correct(t)
