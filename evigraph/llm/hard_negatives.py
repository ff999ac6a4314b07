"""Hard negatives by slot-decomposed selection (operator 11).

Every anchor has a few positives, the rows of its own label that score highest, and every
positive asks for the best rows of other labels inside a window of scores that hangs on
the positive's own score.  The windows of an anchor overlap.  Their distinct upper limits,
in falling order, split the scores into disjoint slots: slot ``j`` reaches from its own
limit (included) down to the next lower one.  A row belongs to one slot at most, and of a
slot no window needs more than the first ``NEGATIVES`` rows, so tasks and shuffle carry
that many rows a slot.  The answer of a window is the beginning of its slot and all lower
ones, so one sweep from the lowest slot upwards, which puts each slot in front of what is
below it, answers all windows; the window's lower limit then cuts the tail.

Anchors meet all rows in tiles: rows are dealt into blocks of about ``ROWS`` and anchors
into blocks of about ``ANCHORS`` by a hash of the id, and a tile is one block of each, so
a task's memory does not grow with the table.  Scores are integers computed exactly.

Defined cases: rows with a NULL id, label or vector, or a NULL or non-finite component take
no part; rows that repeat an id count as one (the smallest label and values); zero vectors
take part with score 0; vectors of unequal length do not meet; components beyond
``LARGEST`` count as that, so that every score fits 64 bits (of vectors of up to 512
components); ties go to the smaller id; an anchor without positives, and a window without
rows, gives no rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored

# Positives of an anchor, negatives of a positive, and the window in percent of the positive's score.
POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90
# Components are floor(UNITS * x).
UNITS, LARGEST = 256, 2**27
# About so many rows and anchors in a tile, and so many anchors and rows compared at once in it.
ROWS, ANCHORS = 16384, 16384
STEP_ROWS, STEP_ANCHORS = 4096, 256

FOUND = "anchor_id long, slot int, score long, vec_id long"


def quantise(vector: Column) -> Column:
    """Integer components."""
    part = lambda x: F.floor(F.lit(float(UNITS)) * x.cast("double"))
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), part(x))).cast("int"))


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """``vec_id, label, vec`` of the rows that take part, one per id, stored."""
    label = F.col("label") if label is None else label
    bad = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull()).filter(~bad)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), quantise(F.col(vector_col)).alias("vec")).alias("v"))
    return stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.vec"), "vectors")


def _block(n: int, size: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // size))))


def tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors (``is_anchor``), each copied to every tile it belongs to."""
    across, down = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    key = lambda a, r: (a * across + r).alias("tile")
    row = rows.select("vec_id", "label", "vec", F.lit(False).alias("is_anchor"), F.lit(None).cast("array<long>").alias("limits"), F.lit(None).cast("long").alias("least"),
                      _block(n_rows, ROWS).alias("_r")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    anchor = anchors.select("vec_id", "label", "vec", F.lit(True).alias("is_anchor"), "limits", "least",
                            _block(n_anchors, ANCHORS).alias("_a")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return row.unionByName(anchor).withColumn("tile", key(F.col("_a"), F.col("_r"))).drop("_a", "_r")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` and ``b``, as float64 where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row; of equal scores the smaller columns."""
    if scores.shape[1] > k:
        low = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
        masked = np.where(allowed, scores, low)
        allowed = allowed & (scores >= np.partition(masked, -k, axis=1)[:, -k][:, None])
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _matrix(vec: pa.Array) -> np.ndarray:
    width = pa.compute.list_value_length(vec)[0].as_py()
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), width)


def _emit(anchor: np.ndarray, slot, score: np.ndarray, vec_id: np.ndarray) -> pa.RecordBatch:
    slot = np.broadcast_to(np.asarray(slot, np.int32), anchor.shape)
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(slot), pa.array(score.astype(np.int64)), pa.array(vec_id)],
                                      names=["anchor_id", "slot", "score", "vec_id"])


def _pieces(table: pa.Table) -> Iterator[tuple[dict, dict]]:
    """Steps of a tile: some anchors and some rows, sorted by id, with vectors of one length."""
    table = table.combine_chunks()
    size = pa.compute.list_value_length(table["vec"])
    for width in pa.compute.unique(size).to_pylist():
        part = table.filter(pa.compute.equal(size, width)).sort_by("vec_id")
        mark = part["is_anchor"]
        rows, anchors = part.filter(pa.compute.invert(mark)), part.filter(mark)
        for i in range(0, len(anchors), STEP_ANCHORS):
            for j in range(0, len(rows), STEP_ROWS):
                out = []
                for t in (anchors.slice(i, STEP_ANCHORS), rows.slice(j, STEP_ROWS)):
                    t = t.combine_chunks()
                    out.append({"id": t["vec_id"].to_numpy(), "label": t["label"].to_numpy(), "limits": t["limits"], "least": t["least"],
                                "vec": _matrix(t["vec"].chunk(0))})
                yield tuple(out)


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first rows of each anchor's label in a tile."""
        for a, b in _pieces(pa.Table.from_batches(batches)):
            for label in np.intersect1d(a["label"], b["label"]):
                i, j = np.flatnonzero(a["label"] == label), np.flatnonzero(b["label"] == label)
                scores = inner_products(a["vec"][i], b["vec"][j])
                r, c = first(scores, a["id"][i][:, None] != b["id"][j][None, :], k)
                yield _emit(a["id"][i][r], 0, scores[r, c], b["id"][j][c])
    return run


def _negatives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first rows of each slot of each anchor in a tile."""
        for a, b in _pieces(pa.Table.from_batches(batches)):
            scores = inner_products(a["vec"], b["vec"])
            limits = a["limits"].to_pylist()
            most = max(map(len, limits))
            # Slots an anchor does not have get the limits (least - 1, least - 1], which hold no score.
            least = a["least"].to_numpy()
            edge = np.array([[*x, *[m - 1] * (most + 1 - len(x))] for x, m in zip(limits, least.tolist())], dtype=np.int64)
            other = (a["label"][:, None] != b["label"][None, :]) & (scores >= least[:, None])
            for slot in range(most):
                r, c = first(scores, other & (scores <= edge[:, slot, None]) & (scores > edge[:, slot + 1, None]), k)
                yield _emit(a["id"][r], slot, scores[r, c], b["id"][c])
    return run


def _leading(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key; Spark applies the limit in every task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for stored ``vectors``.

    ``anchors`` are rows of the same table.  ``lower * positive <= 100 * negative <= upper * positive``.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    plain = anchors.select("vec_id", "label", "vec", F.lit(None).cast("array<long>").alias("limits"), F.lit(None).cast("long").alias("least"))
    near = tiles(rows, plain, n_rows, n_anchors).groupBy("tile").applyInArrow(_positives(positives), FOUND)
    near = stored(_leading(near, ["anchor_id"], positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"CAST(floor(CAST({upper} AS DECIMAL(38,0)) * score / 100) AS LONG)").alias("top"),
        F.expr(f"CAST(ceil(CAST({lower} AS DECIMAL(38,0)) * score / 100) AS LONG)").alias("bottom")), "positives")
    # A window that holds a number; a positive below zero has none, as its lower limit is the higher one.
    windows = near.filter("bottom <= top")
    slots = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("top"), asc=False).alias("limits"), F.min("bottom").alias("least"))
    asking = anchors.join(slots, anchors["vec_id"] == slots["anchor_id"]).select("vec_id", "label", "vec", "limits", "least")
    far = tiles(rows, asking, n_rows, n_anchors).groupBy("tile").applyInArrow(_negatives(negatives), FOUND)
    far = _leading(far, ["anchor_id", "slot"], negatives)
    # Bounded lists: an anchor has at most ``positives`` slots of at most ``negatives`` rows.
    held = far.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "score", "vec_id"))).alias("held"))
    suffix = windows.join(slots, "anchor_id").join(held, "anchor_id").withColumn("slot", F.array_position("limits", F.col("top")) - 1)
    return suffix.select("anchor_id", "positive_id", "positive_score", "bottom", _suffix(negatives)[F.col("slot").cast("int")].alias("best")).select(
        "anchor_id", "positive_id", "positive_score",
        F.posexplode(F.filter("best", lambda x: x["score"] >= F.col("bottom"))).alias("at", "negative")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        "positive_score", F.col("negative.score").alias("negative_score"))


def _suffix(k: int) -> Column:
    """For every slot its first ``k`` rows and those of all lower slots, by one sweep from the lowest slot."""
    row = "struct<score:bigint,vec_id:bigint>"
    slot = F.sequence(F.lit(0), F.size("limits") - 1)
    own = lambda j: F.transform(F.filter("held", lambda x: x["slot"] == j), lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id")))
    below = lambda acc: F.when(F.size(acc) > 0, acc[0]).otherwise(F.array().cast(f"array<{row}>"))
    return F.aggregate(F.reverse(slot), F.array().cast(f"array<array<{row}>>"),
                       lambda acc, j: F.concat(F.array(F.slice(F.concat(own(j), below(acc)), 1, k)), acc))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors(read(spark, sf_dir, "embeddings"), label=shifted)
    return mine(rows, rows.filter("vec_id % 100 = 0"))


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOWER} * p.positive_score <= 100 * s.score AND 100 * s.score <= {UPPER} * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
