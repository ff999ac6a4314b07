"""Keyword taggers: one literal rule table evaluated as array expressions, no join."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, let

Rule = tuple[str, Sequence[str]]


def tags(text: Column, rules: Iterable[Rule], fallback: str | None = None) -> Column:
    """All tags whose keywords occur in ``text``, in rule order; ``fallback`` when none does."""
    hits = F.filter(
        F.array(*[F.when(contains_any(text, words), F.lit(tag)) for tag, words in rules]),
        lambda x: x.isNotNull(),
    )
    hits = F.array_distinct(hits)
    if fallback is None:
        return hits
    return let(hits, lambda x: F.when(F.size(x) == 0, F.array(F.lit(fallback))).otherwise(x))


def first_tag(text: Column, rules: Iterable[Rule], default: str | None = None) -> Column:
    """The first rule that matches, as one CASE expression."""
    out = None
    for tag, words in rules:
        cond = contains_any(text, words)
        out = F.when(cond, F.lit(tag)) if out is None else out.when(cond, F.lit(tag))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def in_priority_order(tag_array: Column, priority: Sequence[str]) -> Column:
    """Sort a tag array by a fixed priority list; unknown tags keep alphabetical order after it."""
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(priority) for x in (t, i)])
    keyed = F.transform(
        tag_array,
        lambda t: F.struct(F.coalesce(F.try_element_at(rank, t), F.lit(len(priority))).alias("r"), t.alias("t")),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["t"])
