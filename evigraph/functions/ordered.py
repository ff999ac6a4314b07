"""Order-dependent operators that survive one key holding a third of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key in one task.  Here a key is cut into
*slices*: expressions that never decrease along the order (turn number divided by a
width, hour of a timestamp, ...).  Work inside a slice is a normal window over
``(key, slice)``; what has to cross a slice border is carried by a summary with one row
per slice.  The slices come from the data alone, so a re-run task sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Order:
    """How rows of one key are ordered and cut.

    ``by`` must be unique within a key.  ``slices`` are SQL expressions, each monotone in
    ``by`` when read as a tuple.
    """

    keys: tuple[str, ...]
    by: tuple[str, ...]
    slices: tuple[str, ...]

    def cut(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        names = [f"_s{i}" for i in range(len(self.slices))]
        return df.withColumns({n: F.expr(e) for n, e in zip(names, self.slices)}), names


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return cond


def neighbours(df: DataFrame, order: Order, lag: dict[str, str] | None = None,
               lead: dict[str, str] | None = None) -> DataFrame:
    """Value of the previous (``lag``) or next (``lead``) row of the same key.

    ``lag`` and ``lead`` map a new column to the column it is taken from.
    """
    lag, lead = lag or {}, lead or {}
    cut, s = order.cut(df)
    inside = Window.partitionBy(*order.keys, *s).orderBy(*order.by)
    rows = cut.withColumns(
        {n: F.lag(c).over(inside) for n, c in lag.items()}
        | {n: F.lead(c).over(inside) for n, c in lead.items()}
        | {"_first": F.lag(F.lit(1)).over(inside).isNull(), "_last": F.lead(F.lit(1)).over(inside).isNull()}
    )
    across = Window.partitionBy(*order.keys).orderBy(*s)
    ends = {f"_e_{c}": F.max_by(c, F.struct(*order.by)) for c in set(lag.values())}
    starts = {f"_b_{c}": F.min_by(c, F.struct(*order.by)) for c in set(lead.values())}
    edge = cut.groupBy(*order.keys, *s).agg(*[e.alias(n) for n, e in (ends | starts).items()])
    edge = edge.select(
        *order.keys, *s,
        *[F.lag(f"_e_{c}").over(across).alias(f"_in_{n}") for n, c in lag.items()],
        *[F.lead(f"_b_{c}").over(across).alias(f"_in_{n}") for n, c in lead.items()],
    )
    out = rows.join(edge, [*order.keys, *s], "left")
    fixed = {n: F.when(F.col("_first"), F.col(f"_in_{n}")).otherwise(F.col(n)) for n in lag}
    fixed |= {n: F.when(F.col("_last"), F.col(f"_in_{n}")).otherwise(F.col(n)) for n in lead}
    return out.withColumns(fixed).select(*df.columns, *lag, *lead)


_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, order: Order, aggs: dict[str, tuple[str, Column]],
            inclusive: bool = True) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` along the order of each key.

    ``aggs`` maps a new column to ``(kind, value)``.  With ``inclusive=False`` the current
    row is left out.  ``sum`` counts from 0; ``max``/``min`` are NULL before the first value.
    """
    cut, s = order.cut(df)
    values = {f"_v_{n}": v for n, (_, v) in aggs.items()}
    cut = cut.withColumns(values)
    frame = Window.partitionBy(*order.keys, *s).orderBy(*order.by)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = cut.withColumns({n: _RUNNING[k](f"_v_{n}").over(frame) for n, (k, _) in aggs.items()})
    total = cut.groupBy(*order.keys, *s).agg(
        *[_RUNNING[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    before = Window.partitionBy(*order.keys).orderBy(*s).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(
        *order.keys, *s,
        *[_RUNNING[k](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in aggs.items()])
    out = rows.join(carry, [*order.keys, *s], "left")

    def combine(n: str, kind: str) -> Column:
        if kind == "sum":
            return F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        return (F.greatest if kind == "max" else F.least)(F.col(n), F.col(f"_c_{n}"))

    return out.withColumns({n: combine(n, k) for n, (k, _) in aggs.items()}).select(*df.columns, *aggs)


def position(df: DataFrame, order: Order, name: str) -> DataFrame:
    """1-based position of each row within its key."""
    return running(df, order, {name: ("sum", F.lit(1).cast("bigint"))})


def clamped_total(df: DataFrame, order: Order, value: Column, start: Column, name: str) -> DataFrame:
    """Fold ``acc -> greatest(acc + value, 0)`` over the order of each key, from ``start``.

    Each stretch of the fold is the function ``acc -> greatest(acc + a, b)``; such
    functions compose into one of the same form, so a key is folded slice by slice and the
    slices are folded again.  ``start`` is an aggregate over the key.  ``value`` should be
    an integer (or exact decimal) so that the cut does not show in the last digit.
    """
    cut, s = order.cut(df)
    cut = cut.withColumns({"_x": value})
    inside = Window.partitionBy(*order.keys, *s).orderBy(*order.by)
    rest = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # a = sum of all values; b = best suffix sum (the fold after its last reset to zero), >= 0
    suffix = cut.withColumn("_suffix", F.sum("_x").over(rest))
    part = suffix.groupBy(*order.keys, *s).agg(
        F.sum("_x").alias("_a"),
        F.greatest(F.max(F.col("_suffix") - F.col("_x")), F.lit(0)).alias("_b"))
    later = Window.partitionBy(*order.keys).orderBy(*s).rowsBetween(1, Window.unboundedFollowing)
    part = part.withColumn("_after", F.coalesce(F.sum("_a").over(later), F.lit(0)))
    # A reset inside slice i leaves b_i, then the later slices add their sums.
    folded = part.groupBy(*order.keys).agg(
        F.sum("_a").alias("_sum"), F.max(F.col("_b") + F.col("_after")).alias("_best"))
    begin = df.groupBy(*order.keys).agg(start.alias("_start"))
    return begin.join(folded, list(order.keys)).select(
        *order.keys, F.greatest(F.col("_start") + F.col("_sum"), F.col("_best"), F.lit(0)).alias(name))
