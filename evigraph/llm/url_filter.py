"""URL filtering by path-template trees (operator 2).

Every url becomes host and path.  A path's segments are first written as *shapes*
(numbers, hex strings and file suffixes are classes), and urls are counted per host and
shape before anything is shuffled.  The shapes of a host form a tree.  Going down, a
node with many rare children gets one wildcard child for all of them; going up, sibling
branches whose labelled good share does not differ from that of all siblings together
(two-sided test) are merged into one wildcard branch.  A leaf is a template.  Its purity,
the share of good labels smoothed towards the host's and the host's towards the overall
share, decides: below ``REJECT`` the template is blocked.  Explicit rules come first.

Everything is DataFrame work.  Segments beyond ``DEPTH`` are one last segment, so deep
paths are covered too.  Defined cases: a url that is NULL or has no ``://`` has empty host
and path, fits no rule and is judged as the template of the empty host; repeated rows are
judged alike; without labels every purity is ``PRIOR``; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stored

DEPTH = 4
# A node keeps the children that hold at least 1 / CHILDREN of it, if it has more than CHILDREN.
CHILDREN = 16
# Two-sided bound of the test for siblings, weight of the parent's share, and the verdict's border.
Z = 1.96
SMOOTH = 20.0
PRIOR = 0.5
REJECT = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else NULL."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.text).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments of a path with lexical classes, ``DEPTH`` at most."""
    def classed(s: Column) -> Column:
        suffix = F.regexp_extract(s, r"\.([A-Za-z]{1,5})$", 0)
        stem = F.substr(s, F.lit(1), F.length(s) - F.length(suffix))
        kind = (F.when(stem.rlike(r"^\d+$"), "{n}")
                .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "{hex}")
                .when(stem.rlike(r"\d"), F.regexp_replace(stem, r"\d+", "{n}"))
                .otherwise(stem))
        return F.concat(kind, suffix)

    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), classed)
    head = F.slice(parts, 1, DEPTH - 1)
    rest = F.array_join(F.slice(parts, DEPTH, 1 << 30), "/")
    return F.when(rest == "", head).otherwise(F.concat(head, F.array(rest)))


def _counted(pages: DataFrame, labelled: DataFrame, url: str) -> DataFrame:
    """``host, segs, n, seen, good``: urls, labels and good labels per host and shape."""
    def rows(df: DataFrame, n: Column, seen: Column, good: Column) -> DataFrame:
        host, path = host_path(F.col(url))
        return df.select(host.alias("host"), shape(path).alias("segs"), n.alias("n"), seen.alias("seen"), good.alias("good"))

    one, none = F.lit(1), F.lit(0)
    both = rows(pages, one, none, none).unionByName(rows(labelled, none, one, F.col("good").cast("int")))
    sums = [F.sum(c).alias(c) for c in ("n", "seen", "good")]
    return both.groupBy("host", "segs").agg(*sums).withColumn("tmpl", F.col("segs"))


def _with(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    new = [f"r.{c}" for c in stats.columns if c not in keys]
    return df.alias("l").join(stats.alias("r"), cond, "left").select("l.*", *new)


def _seg(level: int) -> Column:
    return F.try_element_at("tmpl", F.lit(level + 1))


def _set(level: int, value: Column) -> Column:
    """``tmpl`` with the segment of a level replaced; shorter templates stay."""
    return F.transform("tmpl", lambda s, i: F.when(i == level, value).otherwise(s))


def templates(counted: DataFrame, children: int = CHILDREN, z: float = Z) -> DataFrame:
    """``host, segs, n, seen, good, tmpl``: the tree's leaf of every shape."""
    tree = counted
    for level in range(DEPTH):  # down: wildcards for rare children of wide nodes
        tree = tree.withColumns({"_up": F.slice("tmpl", 1, level) if level else F.array().cast("array<string>"), "_s": _seg(level)})
        child = tree.filter("_s IS NOT NULL").groupBy("host", "_up", "_s").agg(F.sum("n").alias("_n"))
        node = child.groupBy("host", "_up").agg(F.sum("_n").alias("_all"), F.count("*").alias("_wide"))
        rare = (F.col("_wide") > children) & (F.col("_n") * children < F.col("_all"))
        tree = _with(_with(tree, child, ("host", "_up", "_s")), node, ("host", "_up"))
        tree = tree.withColumn("tmpl", _set(level, F.when(rare, F.lit("*")).otherwise(F.col("_s"))))
        tree = stored(tree.drop("_up", "_s", "_n", "_all", "_wide"), "tree")
    for level in reversed(range(DEPTH)):  # up: merge siblings that do not differ
        tree = tree.withColumn("_group", _set(level, F.lit("*")))
        branch = tree.filter(F.size("tmpl") > level).groupBy("host", "_group", "tmpl").agg(
            F.sum("seen").alias("_seen"), F.sum("good").alias("_good"))
        pool = branch.groupBy("host", "_group").agg(F.sum("_seen").alias("_all"), F.count("*").alias("_wide"))
        own = F.try_divide("_good", "_seen")
        middle = branch.filter("_seen > 0").groupBy("host", "_group").agg(F.percentile(own, 0.5, F.col("_seen")).alias("_mid"))
        pool = _with(pool, middle, ("host", "_group"))
        # Two labels of either kind are added, so that a share of 0 or 1 has a spread too.
        share = (F.col("_mid") * F.col("_all") + 2) / (F.col("_all") + 4)
        spread = F.sqrt(share * (1 - share) / F.col("_seen"))
        alike = (F.col("_seen") == 0) | F.coalesce(F.abs(own - share) <= z * spread, F.lit(True))
        tree = _with(_with(tree, branch, ("host", "_group", "tmpl")), pool, ("host", "_group"))
        merge = F.coalesce(alike & (F.col("_wide") > 1), F.lit(False))
        tree = tree.withColumn("tmpl", F.when(merge, F.col("_group")).otherwise(F.col("tmpl")))
        tree = stored(tree.drop("_group", "_seen", "_good", "_all", "_mid", "_wide"), "tree")
    return tree


def purities(tree: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """``host, segs, template, labelled, purity`` of every shape."""
    leaf = tree.groupBy("host", "tmpl").agg(F.sum("seen").alias("_seen"), F.sum("good").alias("_good"))
    host = leaf.groupBy("host").agg(F.sum("_seen").alias("_hs"), F.sum("_good").alias("_hg"))
    overall = host.agg(F.sum("_hs").alias("_as"), F.sum("_hg").alias("_ag"))  # one row
    base = F.coalesce(F.try_divide(F.col("_ag"), F.col("_as")), F.lit(PRIOR))
    host_share = (F.col("_hg") + smooth * base) / (F.col("_hs") + smooth)
    host = host.crossJoin(F.broadcast(overall)).select("host", host_share.alias("_share"))
    purity = (F.col("_good") + smooth * F.col("_share")) / (F.col("_seen") + smooth)
    leaf = _with(leaf, host, ("host",)).select("host", "tmpl", F.col("_seen").alias("labelled"), purity.alias("purity"))
    out = _with(tree.select("host", "segs", "tmpl"), leaf, ("host", "tmpl"))
    return out.select("host", "segs", F.concat(F.lit("/"), F.array_join("tmpl", "/")).alias("template"), "labelled", "purity")


def filter_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[Rule] = RULES, reject: float = REJECT) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, labelled, purity`` of every row.

    ``labelled`` has ``url`` and ``good`` (0/1), one row per label.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    known = labelled.filter(F.col("good").isNotNull())
    judged = stored(purities(templates(_counted(rows, known, "url"))), "templates")
    host, path = host_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path")).withColumn("segs", shape(F.col("path")))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.alias("l").join(judged.alias("r"), (F.col("l.host") == F.col("r.host")) & (F.col("l.segs") == F.col("r.segs")), "left")
    own = F.when(F.col("purity") < reject, "block").otherwise("allow")
    return out.select("page_id", F.col("l.host").alias("host"), "path", "template", "labelled", "purity").withColumns(
        {"rule": name, "verdict": F.coalesce(said, own)}).select(
        "page_id", "host", "path", "rule", "verdict", "template", "labelled", "purity")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """A page is labelled by the document whose number ends its path: good if of quality and not toxic."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").filter("quality IS NOT NULL")
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    labels = labels.groupBy("doc_id").agg(good.alias("good"))
    number = F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)[^/?#0-9]*/?(?:[?#].*)?$', 1) AS bigint)")
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id").select("url", "good")
    return filter_urls(pages, labelled)
