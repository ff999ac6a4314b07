"""Text normalisation as Column builders (JVM side, no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space (the full Unicode set, not only ASCII), as a regex
# class and as a plain string for the much cheaper trim and translate.
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def clean_text(col: Column) -> Column:
    """Strip, collapse runs of blanks and tabs, blank becomes NULL."""
    s = strip(col)
    runs = F.contains(s, F.lit("  ")) | F.contains(s, F.lit("\t"))
    return F.nullif(F.when(runs, F.regexp_replace(s, "[ \\t]{2,}", " ")).otherwise(s), F.lit(""))


def blank(col: Column) -> Column:
    """True for NULL, empty or white-space-only text."""
    return F.coalesce(strip(col), F.lit("")) == ""


def text_or(col: Column, default: str = "") -> Column:
    """Stripped text with NULL and blank replaced by ``default``."""
    return F.coalesce(F.nullif(strip(col), F.lit("")), F.lit(default))


def lookup_key(col: Column) -> Column:
    """Key of the alias dictionaries: lower case, full-width punctuation folded, no spaces."""
    return F.translate(F.lower(col), "（），：" + WS_CHARS, "(),:")


def vocabulary_key(col: Column) -> Column:
    """Key of mode, cost and lab-test spellings: punctuation and spaces removed."""
    return F.translate(F.lower(col), "-_()/（）,，.;；:+[]" + WS_CHARS, "")


def match_text(col: Column, drop: str = " -_/", fold: Mapping[str, str] | None = None) -> Column:
    """Comparison form of a name: lower case, ``drop`` characters removed, ``fold`` applied.

    The callers of the original rules differ only in which characters they remove, so
    those are parameters.
    """
    fold = {"（": "(", "）": ")"} if fold is None else fold
    src = "".join(fold) + drop
    return F.translate(F.lower(strip(col)), src, "".join(fold.values()))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when the text holds any of ``words`` as a substring."""
    words = list(words)
    if not words:
        return F.lit(False)
    out = F.contains(col, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(col, F.lit(word))
    return out


def map_value(col: Column, mapping: Mapping[str, object], default: object = None) -> Column:
    """Small fixed lookup as one literal map; no join, stays inside code generation."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, F.lit(default))


def hash_id(prefix: str, *parts: Column, sep: str = "|", digits: int = 12) -> Column:
    """``prefix`` plus the first hex digits of the SHA-1 of the joined parts."""
    joined = F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, digits))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda.

    The optimiser may otherwise paste a column's expression into the lambda and run it
    again for every element.
    """
    return F.transform(F.array(value), body)[0]
