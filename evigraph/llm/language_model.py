"""Language-model scoring with a gated recurrent network (operator 4).

Tokens are words (A-Z lower-cased) and one end token per text.  Counting covers all
training texts: how often each token occurs, all tokens and all distinct ones.  From the
counts come the vocabulary of the network (the ``SHORT`` most frequent words, in classes of
``MEMBERS`` by frequency, the end token, and ``SHAPES`` classes of all other words by their
looks) and the base score.  A network token is a short word's place, or ``SHORT`` plus the
look of any other word, or ``SHORT + SHAPES`` for the end; texts are stored as such tokens.

The network is a gated recurrent unit whose output is factored: a softmax over classes
from the state, and inside a class a softmax over its members from the state; a rarer word
has its smoothed share of its class.  It is trained by truncated backpropagation (windows
of ``WINDOW`` tokens, the state handed on) over every training text: each partition trains
its own copy, the copies are averaged (first after the first eighth of the data, then after all
of it).  Scoring carries the state across windows from the first to the last token, so a
text of any length is scored whole.

Counts of words that make up at least a ``KNOWN``-th of the training tokens are sent to every
task (at most ``KNOWN`` of them, whatever the size of the corpus); the others meet their
counts in a join.

Defined cases: NULL text is empty and consists of the end token; NULL ids count as training
texts; rows that repeat id and text are scored alike; without training texts all counts
are 0 and the scores are those of an untrained network; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, read, split_words, stored, text_slices, word_hashes

SHORT, MEMBERS, SHAPES = 1024, 32, 8
HIDDEN, WINDOW, LANES, STEP = 16, 16, 512, 0.02
KNOWN = 1 << 20
# Texts scored side by side, and tokens read before they are scored.
BATCH, TOKENS = 2048, 4_000_000
HOLD = (5, 1)

END_KEY = np.int64(-1)  # the end token; no word hashes to it (a hash of -1 becomes 0)
SCHEMA_COUNT = "word long, shape int, c long"
LN10 = np.log(10.0)


def keyed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word key (64-bit hash), shape class and text index of every word."""
    words, owner = split_words(texts)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), owner
    coded = words.dictionary_encode()
    spelled = coded.dictionary
    key = word_hashes(spelled).view(np.int64)
    key[key == END_KEY] = 0
    long_ = pc.greater(pc.binary_length(spelled), 8).to_numpy(zero_copy_only=False)
    marked = pc.match_substring_regex(spelled, r"[^0-9A-Za-z\x80-\xff]$").to_numpy(zero_copy_only=False)
    beyond = pc.invert(pc.string_is_ascii(spelled)).to_numpy(zero_copy_only=False)
    shape = long_.astype(np.int64) + 2 * marked + 4 * beyond
    at = coded.indices.to_numpy(zero_copy_only=False)
    return key[at], shape[at], owner


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=16 << 20):
        key, shape, _ = keyed(batch.column("text"))
        word, first, c = np.unique(key, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[word, END_KEY]), pa.array(np.r_[shape[first], -1].astype(np.int32)), pa.array(np.r_[c, batch.num_rows])],
            names=["word", "shape", "c"])


@dataclass
class Vocabulary:
    """What every task knows of the counts."""

    words: np.ndarray  # sorted keys of the frequent words
    counts: np.ndarray
    place: np.ndarray  # position in the short list, or -1
    end_count: int
    total: int
    distinct: int
    shape_total: np.ndarray  # tokens and distinct words outside the short list, by shape
    shape_distinct: np.ndarray

    @property
    def classes(self) -> int:
        return SHORT // MEMBERS + SHAPES + 1

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index into ``words``, or -1."""
        if not len(self.words):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, at, -1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals of the counts, and the words that make up at least a ``KNOWN``-th of the tokens."""
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                      F.coalesce(F.sum(F.when(F.col("word") == int(END_KEY), F.col("c"))), F.lit(0)).alias("e")).first()
    n, v, e = int(sums["n"]), int(sums["v"]), int(sums["e"])
    real = counts.filter(F.col("word") != int(END_KEY))
    known = real.filter(F.col("c") * KNOWN >= n).select("word", "shape", "c").toArrow()
    word, shape, c = (known.column(k).to_numpy() for k in ("word", "shape", "c"))
    top = np.lexsort((word, -c))[:SHORT]
    place = np.full(len(word), -1, np.int64)
    place[top] = np.arange(len(top))
    order = np.argsort(word)
    total, distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in real.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # SHAPES rows
        total[r["shape"]], distinct[r["shape"]] = r["c"], r["v"]
    np.subtract.at(total, shape[top], c[top])
    np.subtract.at(distinct, shape[top], 1)
    return Vocabulary(word[order], c[order], place[order], e, n, v, total, distinct)


@dataclass
class Network:
    """Parameters of the network; every array is float32."""

    x: np.ndarray  # input, by token: (tokens, 3 * hidden), for update, reset and candidate
    u: np.ndarray  # recurrent: (hidden, 3 * hidden)
    b: np.ndarray
    wc: np.ndarray  # classes: (hidden, classes)
    bc: np.ndarray
    ww: np.ndarray  # members: (short classes, hidden, members)
    bw: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)


def fresh(vocab: Vocabulary) -> Network:
    """Small random weights; the output biases are the logs of the counted shares."""
    rng = np.random.default_rng(5)
    h, groups = HIDDEN, SHORT // MEMBERS
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    member = np.zeros(SHORT)
    ranked = vocab.place >= 0
    member[vocab.place[ranked]] = vocab.counts[ranked]
    member = member.reshape(groups, MEMBERS) + 0.5
    of_class = np.r_[member.sum(axis=1), vocab.shape_total + 0.5, vocab.end_count + 0.5]
    bias = np.zeros(3 * h, np.float32)
    bias[:h] = -1.0  # keep most of the state at first
    return Network(small(SHORT + SHAPES + 1, 3 * h), small(h, 3 * h), bias, small(h, vocab.classes) * 0,
                   np.log(of_class / of_class.sum()).astype(np.float32), small(groups, h, MEMBERS) * 0,
                   np.log(member / member.sum(axis=1, keepdims=True)).astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(net: Network, tokens: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each of the steps ``(steps, lanes)``; ``keep`` collects what backpropagation needs."""
    h = HIDDEN
    steps, lanes = tokens.shape
    states = np.empty((steps, lanes, h), np.float32)
    given = net.x[tokens] + net.b
    for s in range(steps):
        gate = _sigmoid(given[s, :, : 2 * h] + state @ net.u[:, : 2 * h])
        z, r = gate[:, :h], gate[:, h:]
        gated = r * state
        cand = np.tanh(given[s, :, 2 * h:] + gated @ net.u[:, 2 * h:])
        if keep is not None:
            keep.append((state, z, r, gated, cand))
        state = state + z * (cand - state)
        states[s] = state
    return states, state


def class_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens < SHORT, tokens // MEMBERS, tokens - SHORT + SHORT // MEMBERS)


_ONES = np.ones((max(MEMBERS, SHORT // MEMBERS + SHAPES + 1), 1), np.float32)


def _shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores and their sums by row; scores stay far below the limit of the exponent."""
    e = np.exp(np.minimum(x, 80.0, out=x))
    return e, e @ _ONES[: e.shape[1]]


def log_probs(net: Network, states: np.ndarray, target: np.ndarray, grad: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of class and, in the short list, member of each target; with ``grad``, also the gradient by state."""
    cls = class_of(target)
    rows = np.arange(len(target))
    e, total = _shares(states @ net.wc + net.bc)
    out = np.log(e[rows, cls] / total[:, 0]).astype(np.float64)
    back = None
    if grad is not None:
        e /= total
        e[rows, cls] -= 1
        grad.wc += states.T @ e
        grad.bc += e.sum(axis=0)
        back = e @ net.wc.T
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(SHORT // MEMBERS + 1))
    for g in range(SHORT // MEMBERS):
        at = order[ends[g]:ends[g + 1]]
        if not len(at):
            continue
        own = states[at]
        e, total = _shares(own @ net.ww[g] + net.bw[g])
        member = target[at] - g * MEMBERS
        n = np.arange(len(at))
        out[at] += np.log(e[n, member] / total[:, 0])
        if grad is not None:
            e /= total
            e[n, member] -= 1
            grad.ww[g] += own.T @ e
            grad.bw[g] += e.sum(axis=0)
            back[at] += e @ net.ww[g].T
    return out, back


class Trainer:
    """Truncated backpropagation with Adam over lanes of running text."""

    def __init__(self, net: Network):
        self.net = net
        self.m, self.v = [[np.zeros_like(a) for a in net.arrays()] for _ in range(2)]
        self.steps = 0

    def window(self, tokens: np.ndarray, target: np.ndarray, state: np.ndarray, fresh_start: np.ndarray) -> np.ndarray:
        """One update on ``(steps, lanes)``; a lane whose text starts inside the window begins at zero there."""
        net, h = self.net, HIDDEN
        grad = Network(*[np.zeros_like(a) for a in net.arrays()])
        steps, lanes = tokens.shape
        given = net.x[tokens] + net.b
        states, kept = np.empty((steps, lanes, h), np.float32), []
        for s in range(steps):
            state = state * ~fresh_start[s][:, None]
            gate = _sigmoid(given[s, :, : 2 * h] + state @ net.u[:, : 2 * h])
            z, r = gate[:, :h], gate[:, h:]
            gated = r * state
            cand = np.tanh(given[s, :, 2 * h:] + gated @ net.u[:, 2 * h:])
            kept.append((state, z, r, gated, cand))
            state = state + z * (cand - state)
            states[s] = state
        _, back = log_probs(net, states.reshape(-1, h), target.reshape(-1), grad)
        back = back.reshape(steps, lanes, h)
        ahead = np.zeros((lanes, h), np.float32)
        d_in = np.empty((steps, lanes, 3 * h), np.float32)
        for s in reversed(range(steps)):
            old, z, r, gated, cand = kept[s]
            d = back[s] + ahead
            d_cand = d * z * (1 - cand * cand)
            d_gated = d_cand @ net.u[:, 2 * h:].T
            d_gate = np.concatenate([d * (cand - old) * z * (1 - z), d_gated * old * r * (1 - r)], axis=1)
            d_in[s, :, : 2 * h], d_in[s, :, 2 * h:] = d_gate, d_cand
            grad.u[:, : 2 * h] += old.T @ d_gate
            grad.u[:, 2 * h:] += gated.T @ d_cand
            ahead = (d * (1 - z) + d_gated * r + d_gate @ net.u[:, : 2 * h].T) * ~fresh_start[s][:, None]
        flat = d_in.reshape(-1, 3 * h)
        grad.b += flat.sum(axis=0)
        order = np.argsort(tokens.reshape(-1), kind="stable")
        seen, first = np.unique(tokens.reshape(-1)[order], return_index=True)
        grad.x[seen] = np.add.reduceat(flat[order], first, axis=0)
        self._apply(grad, steps * lanes)
        return state

    def _apply(self, grad: Network, n: int) -> None:
        self.steps += 1
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for a, g, m, v in zip(self.net.arrays(), grad.arrays(), self.m, self.v):
            g /= n ** 0.5
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= np.float32(STEP * fix) * m / (np.sqrt(v) + 1e-6)


def _encode(vocab):
    """Texts as tokens, with what the task knows of their scores and the words it has to look up.

    ``known`` tokens, ``base`` (sum of log10 counts) and ``tail`` (log10 shares of words outside
    the short list in their class) are complete but for ``words`` and their ``times``.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocab.value
        rid = TaskContext.get().partitionId() << 40
        log_count = np.log10(known.counts + 0.5) if len(known.counts) else np.zeros(0)
        end_log = np.log10(known.end_count + 0.5)
        share = np.log10(known.shape_total + 0.5 * (known.shape_distinct + 1))
        for batch in text_slices(batches, limit=8 << 20):
            rows = batch.num_rows
            key, shape, owner = keyed(batch.column("text"))
            n = np.bincount(owner, minlength=rows)
            place = known.find(key)
            seen = place >= 0
            short = np.full(len(key), -1)
            short[seen] = known.place[place[seen]]
            tokens = np.insert(np.where(short >= 0, short, SHORT + shape), np.cumsum(n), SHORT + SHAPES).astype("<i2")
            ends = 2 * np.cumsum(np.r_[0, n + 1])
            raw = tokens.tobytes()
            add = lambda w, sel: np.bincount(owner[sel], weights=w, minlength=rows)
            base = add(log_count[place[seen]], seen) + end_log
            tail_seen = seen & (short < 0)
            tail = add(log_count[place[tail_seen]], tail_seen) - add(share[shape[short < 0]], short < 0)
            have = add(np.ones(seen.sum()), seen) + (known.end_count > 0)
            rare_owner, rare_key = owner[~seen], key[~seen]
            order = np.lexsort((rare_key, rare_owner))
            rare_owner, rare_key = rare_owner[order], rare_key[order]
            first = np.flatnonzero(np.r_[True, (rare_owner[1:] != rare_owner[:-1]) | (rare_key[1:] != rare_key[:-1])][:len(rare_key)])
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(rare_owner[first], minlength=rows))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + rows)), batch.column("doc_id"), batch.column("train"), pa.array(n + 1), pa.array(have.astype(np.int64)),
                 pa.array(base), pa.array(tail), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(rare_key[first])),
                 pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.r_[first, len(rare_key)]).astype(np.int32)))],
                names=["rid", "doc_id", "train", "n_tokens", "known", "base", "tail", "tokens", "words", "times"])
            rid += rows
    return run


ENCODED_SCHEMA = ("rid long, doc_id long, train boolean, n_tokens long, known long, base double, tail double, tokens binary, "
                  "words array<long>, times array<int>")


def encode(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The stored tokens of rows with ``doc_id, text, train``."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    return stored(texts.select("doc_id", "text", "train").mapInArrow(_encode(shared), ENCODED_SCHEMA), "encoded")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Tokens, lengths and rows of runs of texts with about ``TOKENS`` tokens."""
    held, size = [], 0
    for batch in text_slices(batches, "tokens", limit=2 << 20):
        held.append(batch)
        size += sum(len(x) for x in batch.column("tokens").to_pylist()) // 2
        if size >= TOKENS:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
    raw = [x for b in held for x in b.column("tokens").to_pylist()]
    return np.frombuffer(b"".join(raw), "<i2").astype(np.int32), np.array([len(x) // 2 for x in raw]), held


def lane_cuts(n: int) -> tuple[np.ndarray, int]:
    """Beginnings and common length of the lanes of ``n`` tokens.

    Lanes cover every token; where the length does not divide ``n``, neighbours overlap by
    a token, so fewer tokens than there are lanes are met twice.
    """
    lanes = max(1, min(LANES, n // (2 * WINDOW)))
    width = -(-n // lanes)
    return np.arange(lanes) * (n - width) // max(1, lanes - 1), width


def _train(vocab, flat: np.ndarray, part: int):
    """Trains a copy of the network on the texts of a partition; the first eighth only if ``part`` is 0."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(fresh(vocab.value).filled(flat)), 0
        for tokens, lengths, _ in _blocks(batches):
            begins, width = lane_cuts(len(tokens))
            width = max(1, width // 8) if part == 0 else width
            lanes = len(begins)
            start = np.zeros(len(tokens), bool)
            start[np.r_[0, np.cumsum(lengths)[:-1]]] = True
            grid = begins[:, None] + np.arange(width)[None, :]
            target, first = tokens[grid].T, start[grid].T.copy()
            first[0] = True
            before = np.where(first, SHORT + SHAPES, tokens[np.maximum(grid - 1, 0)].T)
            state = np.zeros((lanes, HIDDEN), np.float32)
            for at in range(0, width, WINDOW):
                cut = slice(at, at + WINDOW)
                state = trainer.window(before[cut], target[cut], state, first[cut])
            seen += target.size
        if seen:
            yield _weighed(trainer.net.flat().astype(np.float64) * seen, seen)
    return run


def _weighed(total: np.ndarray, seen: int) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([int(seen)]), pa.array([total.tobytes()], pa.binary())], names=["part", "seen", "total"])


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for batch in batches:
        for n, raw in zip(batch.column("seen").to_pylist(), batch.column("total").to_pylist()):
            one = np.frombuffer(raw)
            total, seen = one if total is None else total + one, seen + n
    if seen:
        yield _weighed(total, seen)


def train(encoded: DataFrame, vocab: Vocabulary) -> Network:
    """Two rounds of local training and averaging; copies are summed in a tree of tasks."""
    schema = "part long, seen long, total binary"
    net = fresh(vocab)
    shared = encoded.sparkSession.sparkContext.broadcast(vocab)
    texts = encoded.filter("train").select("tokens")
    for part in (0, 1):
        copies = stored(texts.mapInArrow(_train(shared, net.flat(), part), schema), "copies")
        n = copies.count()
        while n > 16:  # sixteen copies to one
            n = -(-n // 16)
            copies = stored(copies.repartition(n, "part").mapInArrow(_sum, schema), "copies")
        rows = copies.collect()  # sixteen vectors of the network's size at most
        if rows:
            net = net.filled(sum(np.frombuffer(r["total"]) for r in rows) / sum(r["seen"] for r in rows))
    return net


def _score(vocab, flat: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = fresh(vocab.value).filled(flat)
        for tokens, lengths, rows in _blocks(batches):
            found = network_scores(net, tokens, lengths)
            rids = np.concatenate([b.column("rid").to_numpy() for b in rows])
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(found)], names=["rid", "network"])
    return run


def network_scores(net: Network, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log10 probability of classes and short-list members, summed over each whole text."""
    out = np.zeros(len(lengths))
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), BATCH):
        rows = order[at:at + BATCH]
        state = np.zeros((len(rows), HIDDEN), np.float32)
        for begin in range(0, int(lengths[rows[0]]), WINDOW):
            rows = rows[: int(np.searchsorted(-lengths[rows], -begin, side="left"))]  # texts that go on
            state = state[: len(rows)]
            grid = begin + np.arange(min(WINDOW, int(lengths[rows[0]]) - begin))[:, None]
            inside = grid < lengths[rows][None, :]
            where = np.where(inside, start[rows][None, :] + grid, 0)
            target = tokens[where]
            before = np.where(grid > 0, tokens[np.maximum(where - 1, 0)], SHORT + SHAPES)
            states, state = forward(net, before, state)
            logp, _ = log_probs(net, states[inside], target[inside])
            out[rows] += np.bincount(np.nonzero(inside)[1], weights=logp, minlength=len(rows))
    return out / LN10


def count_tokens(texts: DataFrame) -> DataFrame:
    """``word, shape, c`` of all texts, stored; the end token has key -1."""
    counted = texts.select("text").mapInArrow(_count, SCHEMA_COUNT)
    return stored(counted.groupBy("word").agg(F.max("shape").alias("shape"), F.sum("c").alias("c")), "counts")


def score_texts(encoded: DataFrame, net: Network, vocab: Vocabulary, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every encoded row."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab)
    found = encoded.select("rid", "tokens").mapInArrow(_score(shared, net.flat()), "rid long, network double")
    rare = encoded.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), "w.times")
    looked = rare.join(counts.filter(F.col("c") * KNOWN < vocab.total).select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = looked.groupBy("rid").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_log"),
                                     F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = encoded.select("rid", "doc_id", "n_tokens", "known", "base", "tail").join(found, "rid").join(sums, "rid", "left")
    more, extra = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    floor = float(np.log10(vocab.total + 0.5 * (vocab.distinct + 1)))
    return out.select("doc_id", "n_tokens", (F.col("known") + extra).cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
                      (F.col("base") + more - F.col("n_tokens") * floor).alias("base_score"), (F.col("network") + F.col("tail") + more).alias("score"))


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    mod, rest = HOLD
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("train", bucket("doc_id", mod) != rest)
    counts = count_tokens(docs.filter("train"))
    vocab = vocabulary(counts)
    encoded = encode(docs, vocab)
    net = train(encoded, vocab)
    out = score_texts(encoded, net, vocab, counts)
    return out.select("doc_id", (bucket("doc_id", mod) == rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
