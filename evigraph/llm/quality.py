"""Quality classification by histogram gradient-boosted trees (operator 10).

Every text becomes a row of statistics (``FEATURES``) computed over its whole length with
array operations.  The trees are grown on the statistics of ``TRAIN_ROWS`` labelled rows:
values are cut into quantile bins, each level of a tree needs one histogram of gradients
per feature, and all nodes of a level are split at once.  The finished model is four flat
arrays (feature, threshold, left child, leaf value); scoring walks all rows of a batch
down all trees together, one array step per level.

Defined cases: NULL and empty texts have all statistics 0; NULL labels are not learned
from; without labelled rows of both kinds the score is the smoothed rate of label 1; NULL
ids are scored, as are repeated rows; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, compact, read, split_words, text_slices

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digit", "white", "punctuation", "symbol",
    "non_ascii", "newline", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "marked_words", "upper_words",
    "digit_words", "word_runs", "distinct_lines", "log_lines", "mean_line", "bang", "pipe",
)
# Rows learned from (smallest hashes of the id); trees, levels, bins, step and penalty.
TRAIN_ROWS = 30000
TREES, LEVELS, BINS, RATE, RIDGE = 80, 4, 64, 0.15, 2.0

# Byte classes: 0 other letter, 1 upper case, 2 digit, 3 white space, 4 punctuation, 5 symbol, 6 beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[list(b".,;:'\"-()?!")] = 4
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 5


def _per_text(owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights=weight, minlength=n).astype(np.float64)


def _distinct(owner: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each text and the count of its most frequent one."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    width = int(codes.max()) + 1
    pair, count = np.unique(owner * width + codes, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, pair // width, count)
    return _per_text(pair // width, n), top


def _bytes(texts: pa.Array) -> np.ndarray:
    """All bytes of the texts on end, not copied."""
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(texts)
    texts = compact(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = _bytes(texts)
    byte_owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(byte_owner * 7 + _CLASS[raw], minlength=n * 7).reshape(n, 7).astype(np.float64)
    of = lambda byte: _per_text(byte_owner[raw == byte], n)
    bytes_ = np.maximum(size, 1).astype(np.float64)

    words, owner = split_words(texts, lower=False)
    count = _per_text(owner, n)
    some = np.maximum(count, 1)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.float64)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct, top = _distinct(owner, codes, n)
    same = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    next_owner, equal = owner[1:][same], (codes[1:] == codes[:-1])[same]
    runs = _per_text(next_owner, n, (~equal).astype(float)) + (count > 0)
    pairs, _ = _distinct(next_owner, _renumber(codes[:-1][same] * (len(coded.dictionary) + 1) + codes[1:][same]), n)
    # What a word looks like is found once per distinct word.
    spelled = coded.dictionary
    marked = pc.match_substring_regex(spelled, r"[#$%&*|!?]{1,}$").to_numpy(zero_copy_only=False)
    shout = pc.match_substring_regex(spelled, r"^[[:upper:]]{2,}[^[:lower:]]*$").to_numpy(zero_copy_only=False)
    digits = pc.match_substring_regex(spelled, r"[0-9]").to_numpy(zero_copy_only=False)
    share = lambda flags: _per_text(owner, n, flags[codes].astype(float)) / some if len(codes) else np.zeros(n)

    lines = pc.split_pattern(texts, "\n")
    line_count = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line_owner = np.repeat(np.arange(n), line_count)
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct_lines, _ = _distinct(line_owner, line_codes, n)
    columns = [
        np.log1p(size), np.log1p(count), _per_text(owner, n, length) / some, _per_text(owner[length > 12], n) / some,
        _per_text(owner[length <= 3], n) / some, kinds[:, 1] / bytes_, kinds[:, 2] / bytes_, kinds[:, 3] / bytes_, kinds[:, 4] / bytes_,
        kinds[:, 5] / bytes_, kinds[:, 6] / bytes_, of(10) / bytes_, distinct / some, top / some,
        _per_text(next_owner, n, equal.astype(float)) / some, pairs / some, share(marked), share(shout), share(digits), runs / some,
        distinct_lines / np.maximum(line_count, 1), np.log1p(line_count) * (size > 0), size / np.maximum(line_count, 1), of(33) / bytes_, of(124) / bytes_,
    ]
    out = np.stack(columns, axis=1)
    out[size == 0] = 0.0
    return out


def _renumber(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


@dataclass(frozen=True)
class Trees:
    """Flat arrays of shape (trees, nodes); node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    levels: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        trees = np.arange(self.feature.shape[0])
        for at in range(0, len(x), 4096):
            rows = x[at:at + 4096]
            node = np.zeros((len(rows), len(trees)), dtype=np.int64)
            for _ in range(self.levels):
                f = self.feature[trees, node]
                node = 2 * node + 1 + (np.take_along_axis(rows, f, axis=1) > self.threshold[trees, node])
            total[at:at + 4096] += self.value[trees, node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, bins: int = BINS, rate: float = RATE,
         ridge: float = RIDGE) -> Trees:
    """Boosted trees for labels 0/1 with the logistic loss."""
    n, m = x.shape
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    nodes, leaves = 2 ** levels - 1, 2 ** (levels + 1) - 1
    feature = np.zeros((trees, leaves), dtype=np.int64)
    threshold = np.full((trees, leaves), np.inf)
    value = np.zeros((trees, leaves))
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(levels):
            first, width = 2 ** level - 1, 2 ** level
            here = node - first
            best_gain, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(m):
                key = here * bins + binned[:, j]
                gh = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hh = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gl, hl, gt, ht = gh[:, :-1], hh[:, :-1], gh[:, -1:], hh[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl)**2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                b = gain[:, : max(1, len(cuts[j]))].argmax(axis=1)
                got = gain[np.arange(width), b]
                better = (got > best_gain) & (b < len(cuts[j]))
                best_gain[better], best_f[better], best_b[better] = got[better], j, b[better]
            split = best_b >= 0
            feature[t, first:first + width] = best_f
            threshold[t, first:first + width] = [cuts[f][b] if b >= 0 else np.inf for f, b in zip(best_f, best_b)]
            right = split[here] & (binned[np.arange(n), best_f[here]] > best_b[here])
            node = 2 * node + 1 + right
        sums_g, sums_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        value[t, nodes:] = (-rate * sums_g / (sums_h + ridge))[nodes:]
        total += value[t, node]
    return Trees(feature, threshold, value, start, levels)


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = statistics(batch.column("text"))
            flat = pa.array(x.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column("_label"), lists], names=["label", "x"])

    return rows.select("text", "_label").mapInArrow(run, "label int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees grown on the statistics of ``TRAIN_ROWS`` labelled rows, those with the smallest hashes of the id.

    The ids are few, so they are broadcast and no text is shuffled; only the statistics
    come to the driver.
    """
    label = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    ids = label.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    rows = _featured(sample).collect()
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    good = float(y.sum())
    if not 0 < good < len(y):
        none = np.zeros((1, 1))
        return Trees(none.astype(np.int64), none + np.inf, none, float(np.log((good + 0.5) / (len(y) - good + 0.5))), 0)
    # The rows come in no fixed order; sorted, sums of floats agree between runs.
    x = np.array([r["x"] for r in rows])
    order = np.lexsort(np.column_stack([y, x]).T[::-1])
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            scores = model.scores(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = learn(docs, labels.filter((bucket("doc_id", 5) != 0) & F.col("doc_id").isNotNull()))
    return score(docs, model).select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))
