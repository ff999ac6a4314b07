"""Similar answers of the focused study."""

from pyspark.sql import functions as F

from evigraph.plans import q_replay
from evigraph.plans.views import Tables


def test_similar_answers_are_right_in_the_focused_study(spark, sf, monkeypatch):
    t = Tables(spark, sf)
    t.__dict__["replay_turn"] = t.replay_turn.withColumn("answer_name", F.lit("bronchopneumonla left"))
    truth = t.replay_turn.select("case_id", F.lit("bronchopneumonia left").alias("name")).distinct()
    monkeypatch.setattr(q_replay, "truths", lambda t: truth)
    assert q_replay.focus_correct(t).agg(F.min("correct")).first()[0] is True
    assert q_replay.focus_cases(t).where("final_answer <> ''").agg(F.min("correct")).first()[0] is True
