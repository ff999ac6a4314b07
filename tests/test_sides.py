"""What depends on one side of a join is computed before it; nothing large passes through the driver."""

from pyspark.sql import functions as F

from evigraph.operators import actions as ac
from evigraph.plans import q_audit, q_rank
from evigraph.plans.views import Tables


def test_scope_of_prepared_sides(spark):
    cand = spark.createDataFrame([("c1", "Lung 11"), ("c2", "general 1"), ("c3", ""), ("c4", None), ("c5", "old ring")], "cid string, cname string")
    ev = spark.createDataFrame([("e1", "old ring", "LabFinding", ["type:pathogen"]), ("e2", "hot bolt", "Pathogen", ["imaging"]), ("e3", None, "ClinicalFinding", []),
                                ("e4", "", "ClinicalAttribute", None)], "eid string, ename string, label string, tags array<string>")
    rest = {"rel": F.lit("HAS_LAB_FINDING"), "role": F.lit("phenotype_support"), "bg": F.lit(False)}
    words = (q_rank.FACETS, q_rank.SITES, q_rank.PATHOGENS, q_rank.GENERAL)
    one = ac.anchor_scope(cand.crossJoin(ev).withColumns(rest), "cname", "ename", *words)
    c = ac.candidate_scope(cand, "cname", words[0], words[1], words[3])
    e = ac.evidence_scope(ev, "ename", words[0], words[1], words[2])
    two = ac.anchor_scope(c.crossJoin(e).withColumns(rest), "cname", "ename", *words)
    cols = ["cid", "eid", "reason", "scope"]
    assert sorted(map(str, one.select(*cols).collect())) == sorted(map(str, two.select(*cols).collect()))
    assert set(one.columns) == set(two.columns)


def test_evidence_is_dealt_over_more_tasks(spark, sf, monkeypatch):
    whole = q_audit.items(Tables(spark, sf))
    monkeypatch.setattr("evigraph.plans.views.TASK_LINES", 500)
    dealt = q_audit.items(Tables(spark, sf))
    tasks = -(-Tables(spark, sf).n_lines // 500)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    by = [line.strip() for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert "candidate_id" in by[0] and "feature_id" in by[1] and all("l_suppkey" in line for line in by[2:]) and len(by) > 2 and all(line.endswith(f", {tasks}") for line in by)
    assert sorted(map(tuple, whole.select("disease_id", "node_id", "profile_rank").collect())) == sorted(
        map(tuple, dealt.select("disease_id", "node_id", "profile_rank").collect()))
