"""Name matching on whole vocabularies: equality, containment and sequence ratio.

Names are compared once per distinct pair, never once per row, and candidate pairs come
from an index on character grams, never from a cross join.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings, Arrow-batched."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)])


def _grams(text: Column, n: int) -> Column:
    """All substrings of length ``n``."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))


def _keyed_grams(text: Column, longest: int = GRAM) -> Column:
    """Grams of every length up to ``longest``."""
    return F.array_distinct(F.flatten(F.filter(F.array(*[_grams(text, n) for n in range(1, longest + 1)]), lambda g: g.isNotNull())))


def containment_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs ``(inner_name, outer_name)`` where the inner name is a substring of the outer one.

    ``inner`` and ``outer`` have one column ``name``.  Every inner name is looked up by
    its rarest gram only, so a gram that half of all names share is not joined on.
    """
    i = inner.select("name").where("name <> ''").distinct()
    o = outer.select("name").where("name <> ''").distinct()
    og = o.select(F.col("name").alias("outer_name"), F.explode(_keyed_grams(F.col("name"))).alias("gram"))
    size = F.least(F.length("name"), F.lit(GRAM))
    own = F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda p: F.substr(F.col("name"), p, size))
    ig = i.select(F.col("name").alias("inner_name"), F.explode(F.array_distinct(own)).alias("gram"))
    freq = og.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no outer name has proves there is no match, hence the left join and 0
    rare = ig.join(freq, "gram", "left").groupBy("inner_name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_g"))
    rare = rare.where(F.col("_g.n") > 0).select("inner_name", F.col("_g.gram").alias("gram"))
    return rare.join(og, "gram").where(F.contains("outer_name", F.col("inner_name"))).select("inner_name", "outer_name")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(left_name, right_name, ratio)`` with a sequence ratio of at least ``threshold``.

    A ratio of *t* leaves at most (1 - t) of the characters of both names unmatched.  A left
    name of length L is cut into one segment more than that can be, for the longest partner
    allowed; so one segment survives whole in the partner.  Segments are indexed by L, their
    number and their text.  A right name looks only into the lengths that its own allows,
    and for each segment only at the places where it can lie: a shift of s before the
    segment and the rest of the difference in length behind it already cost their
    characters.  Nothing above the threshold is lost.
    """
    slack = 1.0 - threshold
    spread = (2.0 - threshold) / threshold  # largest length ratio that can reach the threshold
    eps = 1e-9
    size, other = F.col("_l"), F.col("_r")
    spare = F.floor(size * (1.0 + spread) * slack + eps).cast("int")
    # segment k of spare + 1 covers characters [k * L / (spare + 1), (k + 1) * L / (spare + 1))
    begin = F.floor(F.col("_k") * size / (spare + 1)).cast("int")
    end = F.floor((F.col("_k") + 1) * size / (spare + 1)).cast("int")
    a = left.select(F.col("name").alias("left_name")).where("left_name <> ''").distinct().withColumn("_l", F.length("left_name"))
    a = a.withColumn("_k", F.explode(F.sequence(F.lit(0), spare))).withColumn("_at", begin).withColumn("_w", end - begin).where("_w > 0")
    a = a.select("left_name", "_l", "_k", F.substr("left_name", F.col("_at") + 1, F.col("_w")).alias("segment"))
    b = right.select(F.col("name").alias("right_name")).where("right_name <> ''").distinct().withColumn("_r", F.length("right_name"))
    b = b.withColumn("_l", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(other / spread - eps)).cast("int"), F.floor(other * spread + eps).cast("int"))))
    b = b.where(2.0 * F.least(size, other) / (size + other) >= threshold - eps)
    b = b.withColumn("_k", F.explode(F.sequence(F.lit(0), spare))).withColumn("_at", begin).withColumn("_w", end - begin).where("_w > 0 AND _w <= _r")
    unmatched = F.floor((size + other) * slack + eps)
    low = F.greatest(F.lit(0), F.col("_at") + F.ceil((other - size - unmatched) / 2).cast("int"))
    high = F.least(other - F.col("_w"), F.col("_at") + F.floor((other - size + unmatched) / 2).cast("int"))
    b = b.withColumn("_from", low).withColumn("_to", high).where("_from <= _to").withColumn("_p", F.explode(F.sequence("_from", "_to")))
    b = b.select("right_name", "_l", "_k", F.substr("right_name", F.col("_p") + 1, F.col("_w")).alias("segment")).distinct()
    pairs = a.join(b, ["_l", "_k", "segment"]).select("left_name", "right_name").distinct()
    out = pairs.withColumn("ratio", sequence_ratio("left_name", "right_name"))
    return out.where(F.col("ratio") >= threshold)


def match_table(predicted: DataFrame, expected: DataFrame, family: bool = True, ratio: float | None = 0.88) -> DataFrame:
    """``(name, expected, exact)`` for every predicted and expected name that match.

    Exact is equality; family adds containment either way and, with ``ratio``, similar
    spelling.
    """
    p, e = predicted.select("name").distinct(), expected.select("name").distinct()
    same = p.join(e, "name").select("name", F.col("name").alias("expected"))
    if not family:
        return same.withColumn("exact", F.lit(True))
    inside = containment_pairs(p, e).toDF("name", "expected")
    around = containment_pairs(e, p).toDF("expected", "name").select("name", "expected")
    out = same.union(inside).union(around)
    if ratio is not None:
        out = out.union(similar_pairs(p, e, ratio).select("left_name", "right_name"))
    return out.distinct().withColumn("exact", F.col("name") == F.col("expected"))


def case_hits(names: DataFrame, truths: DataFrame, table: DataFrame, *kinds: str) -> DataFrame:
    """Per case (and kind): does any of its names match any of its truths (``exact_hit``, ``family_hit``)?

    ``names``: ``case_id, name`` plus the ``kinds`` columns; ``truths``: ``case_id, expected``.
    Each name row meets only the truths its spelling matches, not all truths of the case.
    """
    hit = names.select("case_id", *kinds, "name").distinct().join(table, "name").join(
        truths.select("case_id", "expected").distinct(), ["case_id", "expected"], "left_semi")
    return hit.groupBy("case_id", *kinds).agg(F.max("exact").alias("exact_hit"), F.lit(True).alias("family_hit"))
