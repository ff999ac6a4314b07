import json
import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evigraph.functions import names, ordered, tags, text
from evigraph.operators import audit, replay
from evigraph.sources import scan


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("　 a \t b ", "a b"), ("  ", None), ("a  \tb", "a b"), ("x", "x")])
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text(F.col("a")), a=raw) == want


def test_keys_fold_punctuation(spark):
    assert one(spark, text.lookup_key(F.col("a")), a=" CD4（低）， X：") == "cd4(低),x:"
    assert one(spark, text.vocabulary_key(F.col("a")), a="Direct-Ask (x)") == "directaskx"


def test_tags_keep_rule_order_and_fall_back(spark):
    rules = (("b", ("bb", "zz")), ("a", ("aa",)))
    assert one(spark, tags.tags(F.col("t"), rules, "none"), t="aa bb") == ["b", "a"]
    assert one(spark, tags.tags(F.col("t"), rules, "none"), t="q") == ["none"]
    assert one(spark, tags.in_priority_order(F.array(F.lit("x"), F.lit("a"), F.lit("b")), ("b", "a")), t="") == ["b", "a", "x"]


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(7)
    rows = [(k, i, rnd.randint(-5, 5), rnd.choice("abc")) for k, n in ((1, 300), (2, 5), (3, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, i int, v int, c string").repartition(5)


@pytest.mark.parametrize("width", [7, 1000])
def test_ordered_operators_match_a_plain_loop(spark, log, width):
    rows, df = log
    order = ordered.Order(("k",), ("i",), (f"floor(i / {width})",))
    got = {(r.k, r.i): r for r in ordered.neighbours(df, order, {"p": "c"}, {"n": "c"}).collect()}
    run = {(r.k, r.i): r for r in ordered.running(df, order, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive=False).collect()}
    pos = {(r.k, r.i): r.pos for r in ordered.position(df, order, "pos").collect()}
    for k in (1, 2, 3):
        mine = sorted(r for r in rows if r[0] == k)
        for j, r in enumerate(mine):
            key = r[:2]
            assert got[key].p == (mine[j - 1][3] if j else None)
            assert got[key].n == (mine[j + 1][3] if j + 1 < len(mine) else None)
            before = [x[2] for x in mine[:j]]
            assert run[key].s == sum(before) and run[key].m == (max(before) if before else None)
            assert pos[key] == j + 1


@pytest.mark.parametrize("width", [3, 50, 10000])
def test_clamped_total(spark, log, width):
    rows, df = log
    order = ordered.Order(("k",), ("i",), (f"floor(i / {width})",))
    got = {r.k: r.acc for r in ordered.clamped_total(df, order, F.col("v"), F.lit(4), "acc").collect()}
    for k in (1, 2, 3):
        acc = 4
        for r in sorted(r for r in rows if r[0] == k):
            acc = max(acc + r[2], 0)
        assert got[k] == acc


def test_containment_and_similarity_match_brute_force(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(120)}
    words |= {w[:3] + "x" + w[3:] for w in list(words)[:40]}
    left, right = sorted(words)[::2], sorted(words)[1::2]
    a = spark.createDataFrame([(w,) for w in left], "name string")
    b = spark.createDataFrame([(w,) for w in right], "name string")
    got = {tuple(r) for r in names.containment_pairs(a, b).collect()}
    assert got == {(x, y) for x in left for y in right if x in y}
    sim = {(r.left_name, r.right_name) for r in names.similar_pairs(a, b, 0.8).collect()}
    assert sim == {(x, y) for x in left for y in right if SequenceMatcher(None, x, y).ratio() >= 0.8}


def test_similar_names_lose_nothing(spark):
    """Random names of few letters, with many near ones, against the ratio of all pairs."""
    rnd = random.Random(7)
    base = ["".join(rnd.choices("abcde ", k=rnd.randint(1, 26))) for _ in range(60)]
    near = []
    for s in base:
        x = list(s)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(x) + 1)
            x[at:at + rnd.randint(0, 1)] = rnd.choice(["", "z", "a"])
        near.append("".join(x))
    a = spark.createDataFrame([(x,) for x in base + ["", None]], "name string")
    b = spark.createDataFrame([(x,) for x in near + base[:20]], "name string")
    for t in (0.6, 0.88, 1.0):
        want = {(x, y) for x in set(base) for y in set(near + base[:20]) if x and y and SequenceMatcher(None, x, y).ratio() >= t}
        assert {(r.left_name, r.right_name) for r in names.similar_pairs(a, b, t).collect()} == want and want


def test_median_without_keys(spark):
    rnd = random.Random(3)
    for values in ([5], [1, 2], [1, 1, 9], [rnd.randint(0, 5) for _ in range(100)], [rnd.random() * 1e6 for _ in range(301)], [-3, None, 8, 8], [7, 7, 7]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
        want = statistics.median([v for v in values if v is not None])
        assert replay.median_of(df, [], "v", "m").first().m == pytest.approx(want)
    assert replay.median_of(spark.createDataFrame([(None,)], "v double"), [], "v", "m").first().m is None


def test_family_rules_of_any_size(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"lab": {"rna": ["RNA", " load "], "cell": ["cd4"]}, "risk": {"exposure": ["contact"]}, "*": {"worse": ["worse", ""]}}))
    rules = scan.scan_family_rules(spark, str(tmp_path))
    rows = [("1", "HIV RNA load", "lab"), ("2", "CD4 worse", "lab"), ("3", "contact", "symptom"), ("4", "Contact cd4", "risk"), ("5", "x", "imaging"), ("6", None, "lab")]
    got = audit.family_rows(spark.createDataFrame(rows, "evidence_id string, name string, grp string"), rules).collect()
    assert sorted((r.evidence_id, r.family) for r in got) == [
        ("1", "rna"), ("2", "cell"), ("2", "worse"), ("3", "general_symptom"), ("4", "exposure"), ("5", "imaging"), ("6", "general_lab")]


def test_graph_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nodes": [{"id": "n1", "name": "x", "weight": 0.5, "other": [1]}], "edges": [{"id": "e1", "source_id": "n1"}], "summary": {"k": 3}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"nodes": [], "edges": [], "summary": 7}))
    n, e, s = scan.scan_graph_objects(spark, str(tmp_path))
    assert [(r.id, r.name, r.weight) for r in n.collect()] == [("n1", "x", 0.5)]
    assert [(r.id, r.source_id, r.target_id) for r in e.collect()] == [("e1", "n1", None)] and [tuple(r) for r in s.collect()] == [("k", "3")]
    (tmp_path / "c.json").write_text('{"nodes": {}}')
    (tmp_path / "d.json").write_text("broken")
    assert scan.scan_graph_objects(spark, str(tmp_path), strict=False)[0].count() == 1
    with pytest.raises(Exception, match="no nodes and edges"):
        scan.scan_graph_objects(spark, str(tmp_path))[0].collect()
