import random

import pyarrow as pa
from pyspark.sql import functions as F

from evigraph.functions.overlap import Overlap
from evigraph.operators import cases as c
from evigraph.operators import rank as k
from evigraph.operators import replay as rp


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def sets(seed, n, vocab, size):
    rnd = random.Random(seed)
    return {f"d{i:02d}": {f"k{min(int(rnd.expovariate(0.15)), vocab)}" for _ in range(size)} for i in range(n)}


def test_similar_sets_match_brute_force(spark):
    s = sets(1, 40, 30, 12)
    df = spark.createDataFrame([(d, x) for d, ks in s.items() for x in ks], "id string, key string")
    for t in (0.3, 0.5, 0.9):
        got = {(r.a, r.b) for r in c.similar_sets(df, t).collect()}
        assert got == {(a, b) for a in s for b in s if a < b and jac(s[a], s[b]) >= t}


def test_nearest_sets_match_brute_force(spark):
    s = sets(1, 60, 30, 12) | {f"e{i}": {f"only{i}"} for i in range(3)}
    df = spark.createDataFrame([(d, x) for d, ks in s.items() for x in ks], "id string, key string")
    got = sorted((r.a, r["rank"], r.b, r.inter) for r in c.nearest_sets(df, 4).collect())
    want = []
    for a in s:
        best = sorted((b for b in s if b != a and s[a] & s[b]), key=lambda b: (-jac(s[a], s[b]), -len(s[a] & s[b]), b))[:4]
        want += [(a, i + 1, b, len(s[a] & s[b])) for i, b in enumerate(best)]
    assert got == sorted(want)


def test_rank_competitors_match_brute_force(spark):
    """All pairs that score above 0, those alike in groups and relations only among them."""
    low, sym, risk, exam = sets(1, 40, 25, 10), sets(2, 40, 25, 6), sets(3, 40, 25, 5), sets(4, 40, 25, 8)
    for i, d in enumerate(low):
        if i % 3 == 0:  # nothing in common with any other; some have no key at all
            for kind in (low, sym, risk, exam):
                kind[d] = {f"{d}-{j}" for j in range(2)} if i % 2 else set()
    grp = {d: ({"lab"}, {"lab", "imaging"}, set(), {"pathogen"})[i % 4] for i, d in enumerate(low)}
    rel = {d: ({"HAS_PATHOGEN"}, {"DIAGNOSED_BY", "HAS_PATHOGEN"}, set())[i % 5 % 3] for i, d in enumerate(low)}
    all_keys = {d: low[d] | {"common"} if i % 7 == 0 else low[d] for i, d in enumerate(low)}
    disc = {d: set(sorted(low[d])[:4]) | {"common"} for d in low}
    rows = [(d, *[sorted(x[d]) for x in (low, sym, risk, exam, grp, rel, disc, all_keys)]) for d in low]
    p = spark.createDataFrame(rows, "disease_id string, low_keys array<string>, symptom_keys array<string>, risk_keys array<string>, exam_names array<string>, exam_groups array<string>, exam_relations array<string>, disc_keys array<string>, all_keys array<string>")
    names = p.select("disease_id", F.concat(F.lit("n"), F.substring("disease_id", 3, 1)).alias("disease_name"))

    def score(a, b):
        exam_part = jac(exam[a], exam[b]) * 0.5 + jac(grp[a], grp[b]) * 0.25 + jac(rel[a], rel[b]) * 0.25
        return jac(low[a], low[b]) * 0.4 + jac(sym[a], sym[b]) * 0.25 + jac(risk[a], risk[b]) * 0.2 + exam_part * 0.15

    got = {}
    for r in c.rank_competitors(p, names, 4).collect():
        got.setdefault(r.target_id, {})[r.rank] = r.competitor_id
    apart = 0
    for a in low:
        order = lambda b: (-score(a, b), -len(low[a] & low[b]), -len(disc[a] - all_keys[b]), "n" + b[2], b)  # noqa: B023, E731
        best = sorted((b for b in low if b != a and score(a, b) > 0), key=order)[:4]
        assert [got.get(a, {})[i + 1] for i in range(len(best))] == best and len(got.get(a, {})) == len(best)
        apart += sum(not (low[a] & low[b] or sym[a] & sym[b] or risk[a] & risk[b] or exam[a] & exam[b]) for b in best)
    assert apart > 20


def test_cover_selection(spark):
    item = "disease_id string, ekey string, pref int, cover_rank int, families array<string>, conflict string, strict int"
    rows = [("d", "a", 1, 3, ["f1"], "", 0), ("d", "b", 2, 1, ["f2"], "x", 2), ("d", "c", 3, 2, ["f2", "f3"], "x", 1), ("d", "e", 4, 4, [], "", 0)]
    req = spark.createDataFrame([("d", 1, ["f2"]), ("d", 2, ["f9"]), ("d", 3, ["f3"])], "disease_id string, group_no int, families array<string>")
    got = sorted(c.select_cover_items(spark.createDataFrame(rows, item), req, 3).collect(), key=lambda r: r.pick)
    # b covers group 1, c covers group 3, a fills; b loses to the stricter c of the same conflict family
    assert [r.ekey for r in got] == ["c", "a"]


def test_strictness_orders_levels(spark):
    names = ["CD4 < 50", "CD4 < 200", "CD4 > 500", "CD4 200-350", "CD4升高", "CD4 计数", "BMI > 30", "24 <= BMI < 28"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("f", c.conflict_family(F.col("n")))
    got = {r.n: tuple(r.s) for r in df.select("n", c.strictness(F.col("n"), F.col("f")).alias("s")).collect()}
    assert got["CD4 < 50"] < got["CD4 < 200"] < got["CD4 > 500"] < got["CD4 200-350"] < got["CD4升高"] < got["CD4 计数"]
    assert got["24 <= BMI < 28"] == (0, -24.0, -2800) and got["BMI > 30"] == (0, -30.0, 0)


def test_sample_is_stable_and_fills_up(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3 if i < 30 else 0]) for i in range(60)], "id int, t string")
    a = c.stratified_sample(df.repartition(7), "id", "t", 12, total=36).collect()
    b = c.stratified_sample(df.coalesce(1), "id", "t", 12, total=36).collect()
    assert {r.id for r in a} == {r.id for r in b} and len(a) == 36 and sum(r.fill for r in a) == 4


def test_family_match_and_rates(spark):
    p = spark.createDataFrame([(1, "肺结核"), (2, "abcdefghij"), (3, "zzz"), (4, "")], "case_id int, name string")
    t = spark.createDataFrame([(1, "活动性肺结核"), (2, "abcdefghiX"), (3, "yyy"), (4, "a")], "case_id int, name string")
    got = {r.case_id: (r.exact_hit, r.family_hit) for r in rp.name_match(p, t).collect()}
    assert got == {1: (False, True), 2: (False, True)}
    assert rp.name_match(p, t, None).count() == 1


def test_median_of(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("a", 9), ("b", 2), ("b", None)], "g string, v int")
    assert {r.g: r.m for r in rp.median_of(df, ["g"], "v", "m").collect()} == {"a": 5.0, "b": 2.0}


def test_facet_cover(spark):
    seen = F.array(F.lit("lung"), F.lit("cns"))
    row = spark.range(1).select(k.facet_covered(F.lit("disseminated"), seen).alias("d"), k.facet_covered(F.lit("tb"), seen).alias("t")).first()
    assert row.d and not row.t


def test_pairs_of_sets_are_not_rows(spark):
    """A key that all sets hold gives no joined pair: pairs are compared inside tiles and only the chosen ones leave."""
    df = spark.createDataFrame([(f"d{i:03d}", x) for i in range(300) for x in ("common", f"k{i % 40}", f"m{i % 7}")], "id string, key string")
    out = c.nearest_sets(df, 2)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.a: (r.b, r.inter, r.similarity) for r in out.where("rank = 1").collect()}
    assert len(got) == 300 and got["d000"] == ("d280", 3, 1.0) and got["d001"] == ("d281", 3, 1.0)


def test_overlap_counts_frequent_and_rare_keys():
    rnd = random.Random(5)
    a, b = ([[f"k{int(rnd.expovariate(0.02))}" for _ in range(rnd.randrange(12))] for _ in range(n)] for n in (70, 90))
    a, b = ([sorted(set(x)) for x in y] for y in (a, b))
    o = Overlap(pa.chunked_array([a], pa.list_(pa.string())), pa.chunked_array([b], pa.list_(pa.string())))
    assert 0 < o.frequent.sum() < len(o.frequent)
    assert o.rows(10, 70).tolist() == [[len(set(x) & set(y)) for y in b] for x in a[10:]]
