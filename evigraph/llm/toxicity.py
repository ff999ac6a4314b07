"""Toxicity by a weighted lexicon (operator 6).

Texts are folded: lower case, look-alike letters of other scripts and full-width letters
to Latin, digits and signs that stand for letters to those letters, invisible characters
dropped; ``i``, ``l`` and ``1`` are written for one another, so all become ``i``.  The
lexicon is learned from ``TRAIN_ROWS`` labelled rows: whole words, and beginnings of words
up to ``LONGEST`` letters, are counted by label in Spark, and all are kept that are
significantly toxic after allowing for the number of candidates; a term's weight is its
smoothed log odds.  One Aho-Corasick automaton finds all terms at once.  A hit inside an
exception phrase (a pair of neighbouring words that is mostly harmless in training) does
not count.  The sum of weights, also divided by the length of the text, goes through a
logistic curve.  Terms and phrases have no cap: the training rows bound them.

Defined cases: NULL and empty texts have no hits and get the score of hit-free texts;
NULL labels are not learned from; without training rows of both labels the lexicon is
empty and every score is the smoothed rate of the labels; NULL ids are scored, as are
repeated rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, read, stored, text_slices

# Letters that look like Latin ones, and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "i", "ո": "n", "ս": "u", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "l": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Terms are words of SHORTEST letters or more, or beginnings of words of SHORTEST to LONGEST letters.
SHORTEST, LONGEST = 3, 12
# A term must be this pure, and its chance of arising by luck among all candidates below LUCK.
PURE, LUCK = 0.8, 0.05
# Scores from here on mean toxic.
REJECT = 0.7
# Labelled rows learned from (smallest hashes of the id).
TRAIN_ROWS = 30000

_FOLD = {ord(a): b for a, b in (LOOKALIKES | SUBSTITUTES).items()} | {ord(c): None for c in INVISIBLE}
_WORD = re.compile(r"[^\W_]+")
_BANG = re.compile(r"(?<=[^\W\d_])!(?=[^\W\d_])")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        if any("\uff00" <= c <= "\uffef" or "\U0001d400" <= c <= "\U0001d7ff" for c in set(text)):
            text = unicodedata.normalize("NFKC", text).lower()
        text = unicodedata.normalize("NFC", text)
    text = text.translate(_FOLD)
    return _BANG.sub("i", text) if "!" in text else text


def _word_before(text: str, start: int) -> str:
    """The last word that ends before ``start``, however far away."""
    end = start
    while end and not text[end - 1].isalnum():
        end -= 1
    begin = end
    while begin and text[begin - 1].isalnum():
        begin -= 1
    return text[begin:end]


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float], ...] = ()
    phrases: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    automaton: list = field(default_factory=list, compare=False, hash=False)

    def hits(self, text: str) -> Iterator[tuple[str, float, str, str]]:
        """``term, weight, phrase with the word before, phrase with the word after`` of every hit that starts a word."""
        if not self.terms:
            return
        if not self.automaton:
            import ahocorasick

            auto = ahocorasick.Automaton()
            for term, weight in self.terms:
                auto.add_word(term, (term, weight))
            auto.make_automaton()
            self.automaton.append(auto)
        for end, (term, weight) in self.automaton[0].iter(text):
            start = end + 1 - len(term)
            if start and text[start - 1].isalnum():
                continue
            word = _WORD.match(text, start).group()
            after = _WORD.search(text, start + len(word))
            yield term, weight, f"{_word_before(text, start)} {word}", f"{word} {after.group() if after else ''}"

    def features(self, raw: str | None) -> tuple[float, float]:
        """Log of the total weight, and the total weight per ten words."""
        text = fold(raw)
        total = sum(w for _, w, a, b in self.hits(text) if a not in self.phrases and b not in self.phrases)
        return math.log1p(total), (10.0 * total / max(1, len(text.split())) if total else 0.0)

    def score(self, raw: str | None) -> float:
        x, y = self.features(raw)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


@lru_cache(maxsize=2)
def _ready(terms, phrases, curve) -> Model:
    """One automaton per worker and model."""
    return Model(terms, phrases, curve)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per folded word and label, summed up within about 2 MB of text."""
    for batch in text_slices(batches):
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (toxic if label else clean).update({w for w in _WORD.findall(fold(text)) if len(w) >= SHORTEST})
        words = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())],
            names=["word", "toxic", "clean"])


def _lexicon(train: DataFrame) -> tuple[tuple[tuple[str, float], ...], int, int]:
    """Terms with weights; numbers of toxic and clean training rows."""
    both = train.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    n_toxic, n_clean = int(both["t"] or 0), int(both["c"] or 0)
    if not n_toxic or not n_clean:
        return (), n_toxic, n_clean
    words = train.select("text", "label").mapInArrow(_count_words, "word string, toxic long, clean long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    length = F.length("word")
    ends = F.sequence(F.lit(SHORTEST), F.least(length, F.lit(LONGEST)))
    ends = F.when(length > LONGEST, F.concat(ends, F.array(length))).otherwise(ends)
    terms = words.select("word", "toxic", "clean", F.explode(ends).alias("k")).select(F.expr("substring(word, 1, k)").alias("term"), "toxic", "clean")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = n_toxic / (n_toxic + n_clean)
    seen = F.col("toxic") + F.col("clean")
    part = F.col("toxic") / seen
    gain = F.col("toxic") * F.log(part / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - part) / (1 - rate))).otherwise(0.0)
    scored = terms.filter("toxic >= 2").withColumn("gain", gain)
    pure = scored.filter((F.col("toxic") + 0.5) / (seen + 1.0) >= PURE)
    # Bounded at the luck of the largest possible number of candidates: the terms counted above.
    candidates = max(1, terms.count())
    kept = pure.filter(F.col("gain") >= math.log(candidates / LUCK))
    found = {r["term"]: (r["toxic"], r["clean"]) for r in kept.collect()}
    # Of beginnings with the same counts the longest says the same more exactly.
    vague = {t[:-1] if len(t) <= LONGEST else t[:LONGEST] for t, c in found.items() if found.get(t[:-1] if len(t) <= LONGEST else t[:LONGEST]) == c}
    exact = {t: c for t, c in found.items() if t not in vague}
    # A term behind another term adds nothing.
    short: list[str] = []
    for t in sorted(exact):
        if not short or not t.startswith(short[-1]):
            short.append(t)
    short.sort(key=lambda t: (-exact[t][0], t))
    weight = lambda t, c: math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
    return tuple((t, weight(*exact[t])) for t in short), n_toxic, n_clean


def _phrases(train: DataFrame, terms) -> frozenset[str]:
    """Pairs of neighbouring words around a hit that are mostly harmless."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(terms, frozenset(), (0.0, 0.0, 0.0))
        for batch in text_slices(batches):
            counts = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts.update({(p, label) for _, _, a, b in model.hits(fold(text)) for p in (a, b)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in counts], pa.string()), pa.array([n if y else 0 for (_, y), n in counts.items()], pa.int64()),
                 pa.array([0 if y else n for (_, y), n in counts.items()], pa.int64())], names=["phrase", "toxic", "clean"])

    found = train.select("text", "label").mapInArrow(run, "phrase string, toxic long, clean long").groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    mild = found.filter("clean >= 3 AND toxic * 4 <= clean")
    return frozenset(r["phrase"] for r in mild.collect())


def _curve(rows: list[tuple[float, float, int]], n_toxic: int, n_clean: int) -> tuple[float, float, float]:
    """Logistic fit with a small ridge by Newton steps."""
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not rows:
        return prior, 0.0, 0.0
    data = np.array(rows, dtype=float)
    x, y = np.column_stack([np.ones(len(data)), data[:, :2]]), data[:, 2]
    beta, ridge = np.array([prior, 0.0, 0.0]), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
    return float(beta[0]), float(beta[1]), float(max(0.0, beta[2]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from ``TRAIN_ROWS`` labelled rows of ``docs``, those with the smallest hashes of the id.

    The ids are few, so they are broadcast and the texts are read once, without a
    shuffle; only terms, phrases and two numbers a row come to the driver.
    """
    label = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    ids = label.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    train = stored(train.select("text", "label"), "toxic-train")
    terms, n_toxic, n_clean = _lexicon(train)
    if not terms:
        return Model(curve=(math.log((n_toxic + 0.5) / (n_clean + 0.5)), 0.0, 0.0))
    phrases = _phrases(train, terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(terms, phrases, (0.0, 0.0, 0.0))
        for batch in text_slices(batches):
            x = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column("label")], names=["x", "y", "label"])

    rows = train.mapInArrow(run, "x double, y double, label int").collect()
    return Model(terms, phrases, _curve([tuple(r) for r in rows], n_toxic, n_clean))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    terms, phrases, curve = model.terms, model.phrases, model.curve

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _ready(terms, phrases, curve)
        for batch in text_slices(batches):
            scores = [ready.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, all columns as they are, without a shuffle."""
    terms, phrases, curve = model.terms, model.phrases, model.curve

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _ready(terms, phrases, curve)
        for batch in text_slices(batches, text_col):
            yield batch.filter(pa.array([ready.score(t) < reject for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from the ids whose crc32 modulo 3 is not 1."""
    return learn(docs, labels.filter((bucket("doc_id", 3) != 1) & F.col("doc_id").isNotNull()))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = score(docs, training_model(docs, labels))
    return scored.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= REJECT).cast("int").alias("predicted"))
