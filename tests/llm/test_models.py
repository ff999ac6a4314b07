"""Toxicity, quality and the language model: edge cases, held-out accuracy, brute force."""

import collections
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import language_model as lm
from evigraph.llm import quality, toxicity
from evigraph.llm.common import bucket

from .helpers import EDGE, docs_frame, sql, words


def accuracy(df, sf, label, predicted):
    got = {r.doc_id: r for r in df.collect()}
    names, rows = sql(sf, f"select doc_id, {label} from labels")
    held = [(y, got[d][predicted]) for d, y in rows if d in got and got[d].held_out]
    return np.mean([y == p for y, p in held])


# -- toxicity

def training(n=200):
    """English-like texts, a fifth of them with an insult, and a phrase that makes its word harmless."""
    rng = np.random.default_rng(8)
    plain = [f"wo{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = []
    for i in range(n):
        text = list(rng.choice(plain, 30))
        toxic = i % 5 == 0
        if toxic:
            text.insert(int(rng.integers(30)), ["grubler", "grublers", "snarkoid"][i % 3])
        elif i % 7 == 0:
            text[3:3] = ["garden", "snarkoid"] if i % 2 else ["friendly", "talk"]
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows = training(400)
    docs = docs_frame(spark, [(i, t) for i, t, _ in rows])
    return toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, None)], "doc_id long, toxic int"))


def test_lexicon_folds_and_exceptions(toxic_model):
    terms = dict(toxic_model.terms)
    assert any(toxicity.fold("grubler").startswith(t) for t in terms) and all(w > 0 for w in terms.values())
    plain = toxic_model.score("woak wobl wocm")
    for text in ("a grubler b", "GRUBLERS", "grub1er", "grubIer", "gruble\u200br", "\u0261rubler", "grubl3r", "ｇｒｕｂｌｅｒ", "grubler!"):
        assert toxic_model.score(text) > 0.7 > plain, text
    assert toxic_model.score("xgrubler") == plain
    assert plain == toxic_model.score("") == toxic_model.score(None) < 0.5


def test_hits_equal_plain_search(toxic_model):
    """Every word that starts with a term is one hit, with its neighbours at any distance; phrases with either neighbour take it out."""
    rng = np.random.default_rng(3)
    parts = ["grubler", "Grub1ers", "snarkoid", "garden", "xgrubler", "snark", "woak", "_", "...", " " * 90, "\n", "q" * 70, "а", "5nark0id-5narkoid"]
    model = toxicity.Model((*toxic_model.terms, ("pnevmonouitra", 2.0)), frozenset({"garden " + toxicity.fold("snarkoid")}), (-2.0, 1.0, 0.5))
    for n in (0, 1, 2, 40, 400):
        text = " ".join(rng.choice(parts, n))
        folded = toxicity.fold(text)
        words = ["".join(g) for ok, g in itertools.groupby(folded, str.isalnum) if ok]
        total, hits = 0.0, 0
        for i, word in enumerate(words):
            near = {f"{words[i - 1] if i else ''} {word}", f"{word} {words[i + 1] if i + 1 < len(words) else ''}"}
            for term, weight in model.terms:
                if word.startswith(term):
                    hits += 1
                    total += 0.0 if near & model.phrases else weight
        assert len(list(model.hits(folded))) == hits
        x, y = model.features(text)
        assert x == pytest.approx(math.log1p(total)) and y == pytest.approx(10 * total / max(1, len(folded.split())))


def test_lexicon_equals_counts_by_hand(spark):
    """Terms and weights equal a plain count over words and beginnings; words beyond the longest beginning count whole; nothing is capped."""
    long_word = "abcdefghabcdefgh"
    rows = [(i, f"plain{i % 7} " + (f"{long_word}{'xy'[i % 2]} snarkoid{i % 3}" if i % 4 == 0 else "calm words"), int(i % 4 == 0)) for i in range(240)]
    docs = docs_frame(spark, [(i, t) for i, t, _ in rows])
    model = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    counts = collections.defaultdict(lambda: [0, 0])
    for _, text, y in rows:
        for word in set(toxicity.fold(text).split()):
            if len(word) >= toxicity.SHORTEST:
                for k in {*range(toxicity.SHORTEST, min(len(word), toxicity.LONGEST) + 1), len(word)}:
                    counts[word[:k], word][1 - y] += 1
    terms = collections.defaultdict(lambda: [0, 0])
    for (term, _), (t, c) in counts.items():
        terms[term][0] += t
        terms[term][1] += c
    n_toxic = sum(y for _, _, y in rows)
    rate, bar = n_toxic / len(rows), math.log(len(terms) / toxicity.LUCK)
    kept = {t: (a, b) for t, (a, b) in terms.items()
            if a >= 2 and (a + 0.5) / (a + b + 1) >= toxicity.PURE and a * math.log(a / (a + b) / rate) + (b * math.log(b / (a + b) / (1 - rate)) if b else 0) >= bar}
    one_more = lambda t, u: len(u) == len(t) + 1 <= toxicity.LONGEST or len(t) == toxicity.LONGEST < len(u) and u.startswith(t)
    exact = {t for t in kept if not any(u.startswith(t) and one_more(t, u) and kept[u] == kept[t] for u in kept)}
    short = {t for t in exact if not any(t != u and t.startswith(u) for u in exact)}
    weight = {t: math.log((kept[t][0] + 0.5) / (n_toxic + 1)) - math.log((kept[t][1] + 0.5) / (len(rows) - n_toxic + 1)) for t in short}
    assert dict(model.terms) == pytest.approx(weight) and len(short) >= 2


def test_exception_phrase_is_learned(spark):
    rows = [(i, f"calm{i % 9} " + ("you snarkoid" if i % 4 == 0 else "garden snarkoid fair" if i % 40 == 1 else "talk"), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.learn(docs_frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert "garden " + toxicity.fold("snarkoid") in model.phrases
    assert model.score("garden" + " " * 200 + "snarkoid") == model.score("talk") < 0.7 < model.score("you snarkoid")


def test_longer_texts_dilute(toxic_model):
    scores = [toxic_model.score("grubler " + "woak " * n) for n in (3, 300, 30000)]
    assert scores[0] >= scores[1] >= scores[2]


def test_exception_phrases():
    model = toxicity.Model((("trash", 3.0),), frozenset({"trash can"}), (-2.0, 2.0, 0.0))
    assert model.score("the trash can is full") == model.score("nothing") < model.score("you trash person")


def test_toxicity_edges(spark, toxic_model):
    docs = docs_frame(spark, [*EDGE, (30, "you grubler")])
    got = toxicity.score(docs, toxic_model).collect()
    assert len(got) == len(EDGE) + 1 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.keep_clean(docs, toxic_model)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("x") == 0.5 and toxicity.score(docs.limit(0), none).collect() == []


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(toxicity.op6_toxicity(spark, sf), sf, "toxic", "predicted") > 0.95


# -- quality

def test_statistics_by_hand():
    texts = pa.array(["Ab ab ab\nx# 12", "", None, "one", "é é"])
    x = quality.statistics(texts)
    at = quality.FEATURES.index
    assert x.shape == (5, len(quality.FEATURES)) and not x[1].any() and not x[2].any()
    assert x[0, at("distinct_words")] == pytest.approx(4 / 5) and x[0, at("top_word")] == pytest.approx(2 / 5)
    assert x[0, at("repeated_next")] == pytest.approx(1 / 5) and x[0, at("marked_words")] == pytest.approx(1 / 5)
    assert x[0, at("digit_words")] == pytest.approx(1 / 5) and x[0, at("distinct_lines")] == 1
    assert x[0, at("upper")] == pytest.approx(1 / 14) and x[4, at("non_ascii")] == pytest.approx(4 / 5)
    assert np.array_equal(quality.statistics(texts.slice(3)), x[3:])


def test_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = quality.grow(x[:2000], y[:2000], trees=30, levels=3)
    scores = trees.scores(x)
    assert ((scores[2000:] > 0.5) == y[2000:]).mean() > 0.97
    for i in range(0, 3000, 500):
        total = trees.start
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(trees.levels):
                node = 2 * node + 1 + int(x[i, trees.feature[t, node]] > trees.threshold[t, node])
            total += trees.value[t, node]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_edges(spark):
    docs = docs_frame(spark, EDGE)
    none = quality.learn(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    got = quality.score(docs, none).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.5}
    assert quality.score(docs.limit(0), none).collect() == []
    one = quality.learn(docs, spark.createDataFrame([(6, 1), (7, 1)], "doc_id long, quality int"))
    assert quality.score(docs, one).first().score == pytest.approx(2.5 / 3)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(quality.op10_quality(spark, sf), sf, "quality", "predicted") > 0.95


# -- language model

def small_vocabulary():
    rng = np.random.default_rng(1)
    n = lm.SHORT + 40
    keys = np.sort(rng.integers(-2**62, 2**62, n))
    place = np.full(n, -1)
    place[rng.permutation(n)[: lm.SHORT]] = np.arange(lm.SHORT)
    counts = np.where(place >= 0, 2000 - place, 3)
    return lm.Vocabulary(keys, counts, place, 50, int(counts.sum() + 50), n + 1, np.full(lm.SHAPES, 15.0), np.full(lm.SHAPES, 5.0))


def noisy(net):
    rng = np.random.default_rng(7)
    return net.filled(net.flat() + rng.normal(size=net.flat().size) * 0.05)


def test_probabilities_sum_to_one():
    net = noisy(lm.fresh(small_vocabulary()))
    state = np.random.default_rng(2).normal(size=(3, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.SHORT + lm.SHAPES + 1)
    for s in state:
        logp, _ = lm.log_probs(net, np.repeat(s[None], len(every), axis=0), every)
        assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_windows():
    net = noisy(lm.fresh(small_vocabulary()))
    rng = np.random.default_rng(3)
    lengths = np.array([1, 5, lm.WINDOW, lm.WINDOW + 1, 3 * lm.WINDOW + 7, 2])
    tokens = rng.integers(0, lm.SHORT + lm.SHAPES, lengths.sum())
    tokens[np.cumsum(lengths) - 1] = lm.SHORT + lm.SHAPES
    got = lm.network_scores(net, tokens, lengths)
    at = 0
    for n, score in zip(lengths, got):
        one, state, total, before = tokens[at:at + n], np.zeros((1, lm.HIDDEN), np.float32), 0.0, lm.SHORT + lm.SHAPES
        for t in one:
            states, state = lm.forward(net, np.array([[before]]), state)
            total += lm.log_probs(net, states[0], np.array([t]))[0][0]
            before = t
        assert score == pytest.approx(total / lm.LN10, rel=1e-4)
        at += n


def test_gradients_by_differences():
    vocab = small_vocabulary()
    net = noisy(lm.fresh(vocab))
    rng = np.random.default_rng(4)
    steps, lanes = 5, 3
    seq = rng.integers(0, lm.SHORT + lm.SHAPES + 1, (steps + 1, lanes))
    first = np.zeros((steps, lanes), bool)
    first[0], first[3, 1] = True, True

    def loss(flat):
        n = net.filled(flat)
        state, total = np.zeros((lanes, lm.HIDDEN), np.float32), 0.0
        for s in range(steps):
            state = state * ~first[s][:, None]
            states, state = lm.forward(n, seq[s:s + 1], state)
            total -= lm.log_probs(n, states[0], seq[s + 1])[0].sum()
        return total

    seen = {}

    class Probe(lm.Trainer):
        def _apply(self, grad, n):
            seen["g"] = grad.flat()

    Probe(net).window(seq[:-1], seq[1:], np.zeros((lanes, lm.HIDDEN), np.float32), first)
    g, flat = seen["g"].astype(np.float64), net.flat().astype(np.float64)
    for i in np.argsort(-np.abs(g))[::4000][:12]:
        step = np.zeros_like(flat)
        step[i] = 1e-2
        assert (loss(flat + step) - loss(flat - step)) / 2e-2 == pytest.approx(g[i], rel=0.05, abs=5e-3)


@pytest.mark.parametrize("n", (1, 2, 31, 32, 1000, 16 * 2 * 511 + 5, 16 * 2 * 512, 3_999_999, 4_000_123))
def test_lanes_cover_every_token(n):
    begins, width = lm.lane_cuts(n)
    met = np.zeros(n + 1, int)
    np.add.at(met, begins, 1)
    np.add.at(met, begins + width, -1)
    met = np.cumsum(met)[:n]
    assert met.min() == 1 and met.sum() - n < len(begins)


def test_base_score_and_counts(spark, monkeypatch):
    """Against plain counting, also with almost every word looked up in the join."""
    rows = [*EDGE, *[(40 + i, f"common words and r{i} r{i // 2}") for i in range(30)]]
    docs = docs_frame(spark, rows).select("doc_id", "text", (bucket("doc_id", 5) != 1).alias("train"))
    seen = docs.filter("train")
    train = [(r.doc_id, r.text) for r in seen.collect()]
    counts = {}
    for _, t in train:
        for w in [*words(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for known in (lm.KNOWN, 10):
        monkeypatch.setattr(lm, "KNOWN", known)
        table = lm.count_tokens(seen)
        vocab = lm.vocabulary(table)
        assert (vocab.total, vocab.distinct) == (n, v)
        got = lm.score_texts(lm.encode(docs, vocab), lm.fresh(vocab), vocab, table).collect()
        want = sorted((len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), n,
                       sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None])) for _, t in rows)
        have = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        for a, b in zip(have, want):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
        assert all(math.isfinite(r.score) for r in got)


def test_model_beats_counting_and_empty(spark):
    sf = "/root/testdata/sf0.01"
    got = [r for r in lm.op4_language_model(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, train boolean")
    counts = lm.count_tokens(empty)
    vocab = lm.vocabulary(counts)
    net = lm.train(lm.encode(empty, vocab), vocab)
    assert lm.score_texts(lm.encode(empty, vocab), net, vocab, counts).collect() == []
    edge = docs_frame(spark, EDGE).select("doc_id", "text", F.lit(False).alias("train"))
    alone = lm.score_texts(lm.encode(edge, vocab), net, vocab, counts).collect()
    assert len(alone) == len(EDGE) and all(r.n_known == 0 and math.isfinite(r.score) for r in alone)
