"""Pools of sessions against a plain sum over all links."""

from collections import defaultdict

import pytest

from evigraph.operators import retrieve as r

SUMMARY = ("candidate_id string, feature_id string, n_rel long, dir_sum long, anchor100 int, types int, "
           "candidate_name string, candidate_label string, weight double")


def link(c, f, n=1, weight=None):
    return (f"S{c}", f"P{f}", n, 100 * n, 40 + c % 5, 1 << c % 4, f"name {c % 40:02d}", "Disease", (c % 7) / 10 if weight is None else weight)


def graph(spark):
    """Feature 1 names 150 candidates, the others 30 each; two rows of one pair and a second weight of one candidate."""
    rows = [link(c, 1, 1 + c % 2) for c in range(150)]
    rows += [link((f * 17 + i * 5) % 150, f) for f in range(2, 8) for i in range(30)]
    rows += [link(149, 1, 2), link(148, 1, 1, 0.95), link(148, 2, 1, 0.95)]
    features = [(s, f"P{f}") for s in range(12) for f in range(1, 9) if (s >> f % 4) & 1 or f == 1 + s % 3]
    features += [(50, "P1"), (51, "P8"), (None, "P1")]
    features += [(60, f"P{f}") for f in range(1, 80)]  # lists dealt over two groups
    return rows, features, spark.createDataFrame(rows, SUMMARY), spark.createDataFrame(features, "session_id long, feature_id string")


def plain(rows, features, limit, by_features):
    pools = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for s, f in features:
        for c, g, n, _, _, _, name, _, weight in rows:
            if s is not None and f == g:
                got = pools[s][c, name, weight]
                got[0] += n
                got[1] += 1
    out = set()
    for s, pool in pools.items():
        order = sorted(pool.items(), key=lambda x: (-x[1][1] if by_features else 0, -x[1][0], -x[0][2], x[0][1], x[0][0]))
        out |= {(s, c, weight, n, m, i + 1) for i, ((c, _, weight), (n, m)) in enumerate(order[:limit])}
    return out


@pytest.mark.parametrize("by_features,limit", [(False, 10), (True, 8), (True, 70)])
def test_pools_equal_the_sum_over_all_links(spark, by_features, limit):
    rows, features, summary, have = graph(spark)
    got = r._scored(have, summary, limit, by_features, r.DEFAULT, None, 0.0)
    cols = ["session_id", "candidate_id", "weight", "relation_count", "matched_feature_count", "pool_rank"]
    assert {tuple(x) for x in got.select(*cols).collect()} == plain(rows, features, limit, by_features)


def test_a_session_meets_the_head_of_a_list_only(spark, monkeypatch):
    """A feature with 150 candidates sends its first ten to a session that holds no other feature."""
    seen, top_k = [], r.top_k
    monkeypatch.setattr(r, "top_k", lambda df, *a, **k: seen.append(df) or top_k(df, *a, **k))
    _, _, summary, have = graph(spark)
    r.r1_candidates(have, summary).collect()
    assert seen[0].where("session_id = 50").count() == 10


def test_evidence_of_a_candidate_skips_what_the_session_saw(spark, monkeypatch):
    """Long lists, rows in ties, a pool that holds a candidate twice; no second ranking of all rows met."""
    ranked_again = []
    monkeypatch.setattr(r, "top_k", lambda *a, **k: ranked_again.append(a))
    items = [("D1", f"N{i}", 10000 - 100 * (i // 2), 85, f"name {i}", "MANIFESTS_AS") for i in range(60)]
    items += [("D1", "N3", 9900, 85, "name 3", "HAS_LAB_FINDING"), *[("D2", f"N{i}", 500, 45, "x", "MANIFESTS_AS") for i in range(4)]]
    ev = spark.createDataFrame(items, "candidate_id string, node_id string, priority long, contradiction int, name string, rel string")
    saw = [(1, "N0"), (1, "N3"), (1, "N99"), *[(2, f"N{i}") for i in range(0, 58)], (4, None), (None, "N0")]
    pool = [(1, "D1"), (2, "D1"), (3, "D1"), (3, "D1"), (1, "D2"), (4, "D3"), (4, "D2")]
    got = r.r2_evidence(spark.createDataFrame(pool, "session_id long, candidate_id string"), ev,
                        spark.createDataFrame(saw, "session_id long, node_id string"))
    want = []
    for s, c in sorted(set(pool)):
        left = [x for x in items if x[0] == c and (s, x[1]) not in saw]
        left = sorted(left, key=lambda x: (-x[2], -x[3], x[4], x[1], x[5]))
        left = [x for x in left for _ in range(pool.count((s, c)))][:10]
        want += [(s, c, x[1], x[5], i + 1) for i, x in enumerate(left)]
    assert sorted(map(tuple, got.select("session_id", "candidate_id", "node_id", "rel", "rank").collect())) == sorted(want)
    assert not ranked_again
