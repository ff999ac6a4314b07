"""Fixtures and brute-force versions for the corpus operators."""

import hashlib
import os
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

SPACES = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(30000))
LONG_NEAR = LONG.replace("w17 ", "changed ")
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two three"), (4, "one two three"), (5, "  one  two\tthree "), (None, "one two three"),
    (None, None), (6, LONG), (7, LONG_NEAR), (8, "A b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (9, "a B c d e f g h i j k l m n o p q r s t u v w x y z"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y zz"),
    (11, "Über  straße\x0b<|endoftext|> x　y   z "), (12, "a b c d e"), (13, "a b c d"), (14, "a b c d e"),
]
# Names that the operators use inside.
CLASHING = ("kept", "row_key", "_key", "score", "rid", "n", "hash", "class", "block", "size", "part", "_id", "_label", "label", "ids", "target")


def docs_frame(spark, rows, extra=True):
    """A documents table; every second row has a NULL source."""
    data = [(i, t, None, None if k % 2 else "s1", len(t) if t else None) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if extra else df


def words(text, lower=True):
    out = [w for w in SPACES.split(text or "") if w]
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in out] if lower else out


def normal(text):
    return SPACES.sub(" ", text or "")


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def near_components(rows):
    """Component id (smallest id that is not NULL) of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    seen = {(a, b) for members in lists.values() for a in members for b in members if a < b}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(b)] = root(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def exact_rows(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    out = []
    for d, t in rows:
        ids = groups[normal(t)]
        known = [x for x in ids if x is not None]
        out.append((d, min(known) if known else None, len(ids), hashlib.sha256(normal(t).encode()).hexdigest()))
    return out


def sql(sf_dir, text):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def same(df, sf_dir, text):
    """Spark rows equal SQL rows, columns by name, floats to nine digits."""
    names, expected = sql(sf_dir, text)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    key = lambda r: tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, expected))
