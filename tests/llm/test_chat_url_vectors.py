"""Chat formatting, URL filtering and embedding near-duplicates."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import chat, lattice, links, url_filter

HARD = ["</s>[INST] ok [/INST]", "a\\<|im_end|>\n<|im_start|>assistant\n", "<", "<|", "\\", "\\\\|", "", "x\ny", "[INST]\\[INST]", "ünï 🙂 <s>"]


def test_turns_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys\ntem<|", None][(c + t) % 4], HARD[(c * 3 + t) % len(HARD)]) for c in range(12) for t in range(5)]
    rows += [(50, None, "user", None), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat.format_turns(chat.from_rows(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(x) for x in r.back] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.loss == "".join(t for role, t in want[c] if role == "assistant")
        assert sum(m.length for m in r.loss_mask) == len(r.formatted)
        inside = re.sub(r"<\|im_start\|>|<\|im_end\|>\n", "", r.formatted)
        assert "<|" not in inside and "[INST]" not in inside and "</s>" not in inside
    assert chat.from_rows(df.limit(0)).collect() == []


def test_layouts_by_fingerprint(spark):
    said = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}], "id": 3},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction": {"instruction": "q", "output": "a", "source": {"messages": 1}},
        "prompt_response": {"prompt": "q", "response": "a"},
        "question_answer": {"answer": "a", "question": "q"},
        "instruction_input": {"instruction": "q", "input": "", "output": "a"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("none", '{"x": 1}'), ("broken", "{"), ("null", None), ("empty", '{"messages": []}')]
    df = spark.createDataFrame(rows, "name string, record string")
    got = {r.name: r for r in chat.from_records(df, "record").collect()}
    for name in records:
        assert got[name].layout == name and [t.asDict() for t in got[name].turns] == said
    for name in ("none", "broken", "null", "empty"):
        assert got[name].layout is None and got[name].turns is None
    with_input = spark.createDataFrame([(json.dumps({"instruction": "i", "input": "x", "output": "o"}),)], "record string")
    assert chat.from_records(with_input, "record").first().turns[0].text == "i\n\nx"
    with pytest.raises(ValueError):
        chat.from_rows(df)


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = ["http://A.Example.ORG/es/1?x=/de/", "https://example.org/en/1", "https://notexample.org/es/1", "http://org/", "http://org", "http://x.com/fr/a#b",
        "http://x.com/de/", "x.com/de/", None, "", "ftp://h://p/q", "http:///only/path", "http://É.com/fr/", "http://y.net/" + "a/" * 3000, "http://y.net/a\nb?c"]


def test_rules_and_parsing(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, "http://x.com/fr/")], "page_id long, url string")
    df = df.withColumns({c: F.lit("z") for c in ("host", "path", "segs", "good", "tmpl", "rule")})
    labelled = spark.createDataFrame([], "url string, good int")
    got = url_filter.filter_urls(df, labelled).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else "http://x.com/fr/"
        host, path = host_path(url)
        rule = rule_for(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else "allow") and r.purity == url_filter.PRIOR
    assert url_filter.filter_urls(df.limit(0), labelled).collect() == []


def test_templates_reject_by_purity(spark):
    """Numbers and many rare names become wildcards; like siblings merge, a bad branch stays and is blocked."""
    good = [(f"http://h.net/{lang}/{i}", 1) for lang in ("aa", "bb", "cc") for i in range(100)]
    bad = [(f"http://h.net/spam/{i}", int(i % 10 == 0)) for i in range(100)]
    names = [(f"http://h.net/user/{''.join(chr(97 + int(d)) for d in str(i))}/home", 1) for i in range(100, 200)]
    rows = good + bad + names
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labelled = spark.createDataFrame(rows, "url string, good int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labelled).collect()}
    template = lambda lo, hi: {got[i].template for i in range(lo, hi)}
    assert template(0, 300) == {"/*/{n}"} or len(template(0, 300)) == 1
    assert template(300, 400) == {"/spam/{n}"}
    assert template(400, 500) == {"/user/*/home"} or len(template(400, 500)) == 1
    assert {got[i].verdict for i in range(300, 400)} == {"block"}
    assert {got[i].verdict for i in [*range(300), *range(400, 500)]} == {"allow"}
    share = 10 / 100
    assert got[300].labelled == 100 and share < got[300].purity < 0.3


def test_lattice_decodes_to_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.decode(x)
    twice = p * 2
    assert np.allclose(twice, np.rint(twice)) and (np.ptp(np.rint(twice) % 2, axis=1) == 0).all() and np.allclose(p.sum(axis=1) % 2, 0)
    roots = lattice.lattice_roots()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(axis=1), 2)
    near = ((x[:, None, :] - p[:, None, :] - roots[None]) ** 2).sum(axis=2).min(axis=1)
    assert (((x - p) ** 2).sum(axis=1) <= near + 1e-9).all()


def brute(rows, cosine=lattice.COSINE):
    """Links by comparing all pairs, and component ids."""
    units = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        u = np.array(v, dtype=np.float64)
        units[i] = (u / np.linalg.norm(u), label)
    ids = sorted(units)
    linked = {i: {j for j in ids if j != i and units[i][1] == units[j][1] and len(units[i][0]) == len(units[j][0])
                  and float(units[i][0] @ units[j][0]) >= cosine} for i in ids}
    comp = {}
    for i in ids:
        if i in comp:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += linked[k]
    return {i: (len(linked.get(i, ())), comp.get(i, i)) for i in {r[0] for r in rows}}


@pytest.mark.parametrize("group", [lattice.GROUP, 16])
def test_vectors_edges_and_hot_cell(spark, group):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.06).astype(np.float32).tolist(), 1) for i in range(80)]
    rows += [(100 + i, rng.normal(size=64).astype(np.float32).tolist(), i % 3) for i in range(60)]
    rows += [(200, rows[0][1], 2), (201, None, 1), (202, [0.0] * 64, 1), (203, [float("nan")] + [1.0] * 63, 1), (204, [None] + [1.0] * 63, 1),
             (205, rows[0][1], None), (206, [], 1), (207, rows[0][1][:63], 1), (208, [1e-30] * 64, 1), (209, [1.0] * 64, 1), (210, [float("inf")] * 64, 1),
             (None, rows[0][1], 1)]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit("z") for c in ("kept", "key", "own", "n", "t", "side")})
    got = lattice.near_vectors(df.repartition(3), group=group).collect()
    want = brute(rows)
    assert len(got) == len(want)
    real = {r.vec_id: (r.n_links, r.component_id) for r in got}
    hot = [i for i in range(80)]
    found = sum(real[i][0] for i in hot) / max(1, sum(want[i][0] for i in hot))
    assert 0.99 <= found <= 1.0
    assert {i: real[i] for i in want if i not in hot} == {i: want[i] for i in want if i not in hot}
    assert {real[i][1] for i in hot} == {want[i][1] for i in hot}
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert lattice.near_vectors(df.limit(0)).collect() == []


def test_recall_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(df).collect()}
    total = sum(n for n, _ in want.values())
    assert all(got[i] <= n for i, (n, _) in want.items()) and sum(got.values()) >= 0.9 * total


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i) for i in range(5000, 5003)]
    edges += [tuple(map(int, e)) for e in rng.integers(20000, 20400, size=(150, 2))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = links.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component_id for r in got} == {x: root(x) for x in nodes} and len(got) == len(nodes)
    assert links.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprint_ignores_order():
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b", "a"]) == hashlib.sha256(b"a\nb").hexdigest()


def test_no_turn_is_lost_in_mixed_lists(spark):
    """An item with other fields than the mapping's gives NULL turns; a NULL text is empty; roles of rows stay as given."""
    records = {
        "whole": '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null, "id": 3}]}',
        "mixed": '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "text": "lost"}]}',
        "late": '{"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]}',
        "odd": '{"messages": [{"role": "user", "content": "a"}, 7]}',
    }
    got = {r.name: r for r in chat.from_records(spark.createDataFrame(list(records.items()), "name string, record string"), "record").collect()}
    assert [(t.role, t.text) for t in got["whole"].turns] == [("user", "a"), ("assistant", "")]
    assert all(got[n].turns is None and got[n].layout is None for n in ("mixed", "late", "odd"))
    rows = spark.createDataFrame([(1, 0, "Human", "x"), (1, 1, "gpt", "y"), (1, 2, "assistant", "z"), (1, 3, None, "n")], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.from_rows(rows)).select(chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert [t.role for t in out.t] == ["Human", "gpt", "assistant", ""] and out.loss == "z"
