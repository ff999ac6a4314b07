"""Markdown documents: cleaning, sections, chunks, tables.

A document is one row.  Line logic runs on the row's own array of lines with
higher-order functions, so a corpus of any size needs no shuffle and no document is
ever split over rows and put together again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, contains_any, let, strip

# --- fixed values: cleaning patterns ---------------------------------------------------------
ZERO_WIDTH = "[\\u200b\\u200c\\u200d\\u2060]"
HEADING = r"^(#{1,5})\s*(.*?)\s*$"
RANGE = r"\s*[~～]\s*"
TABLE_LINE = r"^\s*\|.*\|\s*$"
TABLE_SEPARATOR = r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?\s*$"
SYMBOLS = (("≥", ">=", "normalized_greater_equal_count"), ("≤", "<=", "normalized_less_equal_count"),
           ("＞", ">", "normalized_greater_than_count"), ("＜", "<", "normalized_less_than_count"),
           ("＝", "=", "normalized_equal_count"))
TERMS = ((r"(?i)CD4\s*[\+＋⁺]?\s*T\s*(?:淋巴细胞|细胞)?", "CD4+ T 淋巴细胞", "normalized_cd4_term_count"),
         (r"(?i)CD8\s*[\+＋⁺]?\s*T\s*(?:淋巴细胞|细胞)?", "CD8+ T 淋巴细胞", "normalized_cd8_term_count"),
         (r"(?i)HIV\s*RNA", "HIV RNA", "normalized_hiv_rna_term_count"),
         (r"(?i)P24\s*抗原", "P24 抗原", "normalized_p24_term_count"))
UNITS = ((r"(?i)(?:个|cells)\s*/\s*(?:μL|uL|ul)", "/μL", "normalized_cells_per_microliter_count"),
         (r"(?i)(?:拷贝|copies)\s*/\s*mL", "copies/mL", "normalized_copies_per_ml_count"),
         (r"(?i)pg\s*/\s*mL", "pg/mL", "normalized_pg_per_ml_count"),
         (r"(?i)mg\s*/\s*L", "mg/L", "normalized_mg_per_l_count"))
# What a text must hold for a rule to find anything, by the count the rule fills.
NEEDS = {**{stat: (mark,) for mark, _, stat in SYMBOLS}, "collapsed_internal_spaces": ("  ", "\t"), "normalized_ranges": ("~", "～"),
         "normalized_cd4_term_count": ("4",), "normalized_cd8_term_count": ("8",), "normalized_p24_term_count": ("24",),
         "normalized_hiv_rna_term_count": ("RNA", "RNa", "RnA", "Rna", "rNA", "rNa", "rnA", "rna"), **{stat: ("/",) for _, _, stat in UNITS}}
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SENTENCE_END = f"(?<=[。！？.!?])[{WS}]*"
PARAGRAPH_END = f"\\n[{WS}]*\\n"


def _count(lines: str, value) -> Column:
    """Sum of a per-line number over an array-of-lines column."""
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda acc, x: acc + value(x).cast("bigint"))


def clean_documents(docs: DataFrame) -> DataFrame:
    """Adds ``cleaned`` and one count per rule to ``(path, text)``.

    Headings keep their words; the term, unit, symbol, range and spacing rules touch the
    other lines only.  Each step is its own projection over the line array, so every
    pattern runs once per line.
    """
    df = docs.withColumn("_t", F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r", "\n"))
    df = df.withColumn("removed_bom", F.startswith("_t", F.lit("﻿")).cast("bigint"))
    df = df.withColumn("_t", F.regexp_replace("_t", "^﻿+", ""))
    df = df.withColumns({
        "replaced_full_width_spaces": F.regexp_count("_t", F.lit("[　 ]")).cast("bigint"),
        "removed_zero_width": F.regexp_count("_t", F.lit(ZERO_WIDTH)).cast("bigint")})
    df = df.withColumn("_t", F.regexp_replace(F.translate("_t", "　 ", "  "), ZERO_WIDTH, ""))
    df = df.withColumn("normalized_fullwidth_ascii_count", F.regexp_count("_t", F.lit("[！-～]")).cast("bigint"))
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    df = df.withColumn("_t", F.translate("_t", wide, "".join(chr(ord(c) - 0xFEE0) for c in wide)))
    # No rule makes a text that a later rule looks for, so what the whole text lacks no line will hold.
    df = df.withColumn("_has", F.struct(*[contains_any(F.col("_t"), n).alias(stat) for stat, n in NEEDS.items()]))
    line = lambda s: F.struct(s.rlike("^#{1,5}").alias("h"), s.alias("s"))
    df = df.withColumn("_l", F.transform(F.split("_t", "\n"), line))
    # headings: one blank after the marks, trimmed words
    head = lambda s: F.regexp_replace(F.regexp_replace(s, HEADING, "$1 $2"), r"^(#{1,5}) $", "$1")
    df = df.withColumn("_n", F.transform("_l", lambda x: F.struct(x["h"].alias("h"), F.when(x["h"], head(x["s"])).otherwise(
        F.regexp_replace(x["s"], "[ \\t]+$", "")).alias("s"))))
    changed = lambda kind: F.aggregate(
        F.zip_with("_l", "_n", lambda a, b: ((a["h"] == F.lit(kind)) & (a["s"] != b["s"])).cast("bigint")), F.lit(0).cast("bigint"), lambda p, q: p + q)
    df = df.withColumns({"normalized_headings": changed(True), "trimmed_trailing_whitespace": changed(False)})
    df = df.withColumn("_l", F.col("_n"))

    def rule(df: DataFrame, pattern: str, repl: str, stat: str, by_line: bool = False, skip=None) -> DataFrame:
        touch = (lambda x: ~x["h"]) if skip is None else (lambda x: ~x["h"] & ~skip(x["s"]))
        if by_line:
            n = _count("_l", lambda x: F.when(touch(x) & (F.regexp_replace(x["s"], pattern, repl) != x["s"]), 1).otherwise(0))
        else:
            n = _count("_l", lambda x: F.when(touch(x), F.regexp_count(x["s"], F.lit(pattern))).otherwise(0))
        done = F.transform("_l", lambda x: F.struct(
            x["h"].alias("h"), F.when(touch(x), F.regexp_replace(x["s"], pattern, repl)).otherwise(x["s"]).alias("s")))
        df = df.withColumns({stat: F.when(F.col("_has")[stat], n).otherwise(F.lit(0).cast("bigint")),
                             "_r": F.when(F.col("_has")[stat], done).otherwise(F.col("_l"))})
        return df.withColumn("_l", F.col("_r")).drop("_r")

    for pattern, repl, stat in SYMBOLS:
        df = rule(df, pattern, repl, stat)
    df = rule(df, "[ \\t]{2,}", " ", "collapsed_internal_spaces", True, skip=lambda s: F.startswith(F.ltrim(s), F.lit("|")))
    for pattern, repl, stat in (*TERMS, *UNITS):
        df = rule(df, pattern, repl, stat)
    df = rule(df, RANGE, " ~ ", "normalized_ranges", True)
    return drop_repeats(df)


def drop_repeats(df: DataFrame) -> DataFrame:
    """Drop a heading equal to the line before it and all but the first blank line of a run.

    A repeated heading can only follow its twin directly (any kept line in between would
    be the last kept line), and a blank line is dropped exactly when the line before it is
    blank, so both need nothing but the previous element.
    """
    blank = lambda x: ~x["h"] & (strip(x["s"]) == "")
    prev = lambda i: F.get("_l", i - 1)
    twin = lambda x, i: (i > 0) & x["h"] & F.coalesce(prev(i)["h"] & (prev(i)["s"] == x["s"]), F.lit(False))
    run = lambda x, i: (i > 0) & blank(x) & F.coalesce(blank(prev(i)), F.lit(False))
    df = df.withColumn("_k", F.transform("_l", lambda x, i: F.when(twin(x, i), "twin").when(run(x, i), "run").when(blank(x), "blank").otherwise("keep")))
    tally = lambda k: F.size(F.filter("_k", lambda v: v == k)).cast("bigint")
    df = df.withColumns({"removed_duplicate_headings": tally("twin"), "collapsed_blank_lines": tally("run")})
    kept = F.filter(F.zip_with("_l", "_k", lambda x, k: F.when(k == "blank", F.lit("")).when(k == "keep", x["s"])), lambda s: s.isNotNull())
    return df.withColumn("cleaned", F.concat(F.regexp_replace(F.array_join(kept, "\n"), r"\s+$", ""), F.lit("\n"))).drop("_t", "_l", "_n", "_k", "_has")


COUNTS = ("removed_bom", "removed_zero_width", "replaced_full_width_spaces", "normalized_headings", "removed_duplicate_headings",
          "collapsed_blank_lines", "trimmed_trailing_whitespace", "collapsed_internal_spaces", "normalized_ranges",
          "normalized_fullwidth_ascii_count", *[r[2] for r in (*TERMS, *UNITS, *SYMBOLS)])


def clean_summary(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Totals per key (or for the corpus) and the number of changed documents."""
    grouped = cleaned.groupBy(*keys) if keys else cleaned.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("cleaned") != F.col("text")).cast("bigint")).alias("changed_files"),
                       *[F.sum(c).alias(c) for c in COUNTS])


# -- sections --------------------------------------------------------------------------------------

def sections(docs: DataFrame, path: str = "path", text: str = "text", title: Column | None = None) -> DataFrame:
    """Sections of each document: heading path, level, title, 1-based line range, body.

    A heading keeps the first (level - 1) entries of the running path and adds itself.
    """
    lines = F.split(F.regexp_replace(F.col(text), f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)
    df = docs.withColumn("_l", F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(lines))
    mark = r"^(#{1,5})\s+(.*)$"
    df = df.withColumn("_h", F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(mark), F.struct(
        i.alias("at"), F.length(F.regexp_extract(x, mark, 1)).alias("level"), strip(F.regexp_extract(x, mark, 2)).alias("name")))),
        lambda s: s.isNotNull()))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("all"))

    def step(acc: Column, h: Column) -> Column:
        now = F.concat(F.slice(acc["path"], 1, h["level"] - 1), F.array(h["name"]))
        return F.struct(now.alias("path"), F.concat(acc["all"], F.array(now)).alias("all"))

    df = df.withColumn("_p", F.aggregate("_h", start, step)["all"])
    n = F.size("_l")
    none = F.array().cast("array<string>")
    lead = F.when((n > 0) & (F.coalesce(F.get("_h", F.lit(0))["at"], n) > 0), F.struct(
        F.lit(0).alias("from"), F.coalesce(F.get("_h", F.lit(0))["at"], n).alias("to"), F.lit(0).alias("level"), none.alias("heading_path"), F.lit(-1).alias("h")))
    own = let(F.struct(F.col("_h").alias("h"), F.col("_p").alias("p"), n.alias("n")), lambda z: F.transform(z["h"], lambda h, i: F.struct(
        h["at"].alias("from"), F.coalesce(F.get(z["h"], i + 1)["at"], z["n"]).alias("to"), h["level"].alias("level"),
        F.get(z["p"], i).alias("heading_path"), i.alias("h"))))
    df = df.withColumn("_s", F.filter(F.concat(F.array(lead), own), lambda x: x.isNotNull()))
    base = F.lit("") if title is None else title
    # Each section takes its own lines and title here, so no section row carries the document.
    df = df.withColumn("_title", F.transform("_h", lambda h: F.when(h["level"] == 1, h["name"])))
    body = lambda ls, x: F.slice(ls, F.when(x["h"] >= 0, x["from"] + 2).otherwise(F.lit(1)),
                                 x["to"] - F.when(x["h"] >= 0, x["from"] + 1).otherwise(F.lit(0)))
    named = lambda ts: F.aggregate(ts, F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("all")),
                                   lambda acc, v: let(F.coalesce(v, acc["now"]), lambda t: F.struct(t.alias("now"), F.concat(acc["all"], F.array(t)).alias("all"))))["all"]
    df = df.withColumn("_title", named("_title"))
    df = df.withColumn("_s", let(F.struct(F.col("_l").alias("l"), F.col("_title").alias("t"), F.col("_s").alias("s")), lambda z: F.transform(z["s"], lambda x: F.struct(
        x["from"].alias("from"), x["to"].alias("to"), x["level"].alias("level"), x["heading_path"].alias("heading_path"),
        F.get(z["t"], x["h"]).alias("title"), strip(F.array_join(body(z["l"], x), "\n")).alias("body")))))
    # The outer form: a plain explode infers a filter on the array, which is pushed down and builds it twice.
    out = df.select(path, base.alias("_base"), F.posexplode_outer("_s").alias("section_no", "s")).where("s IS NOT NULL")
    out = out.select(path, "section_no", F.col("s.heading_path").alias("heading_path"), F.col("s.level").alias("level"),
                     F.coalesce("s.title", "_base").alias("title"), (F.col("s.from") + 1).alias("line_start"),
                     F.col("s.to").alias("line_end"), F.col("s.body").alias("body"))
    return out.where((F.col("body") != "") | (F.size("heading_path") > 0))


def heading_block(path: Column) -> Column:
    """Heading path as Markdown lines."""
    return F.array_join(F.transform(path, lambda h, i: F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), h)), "\n")


def render(path: Column, body: Column) -> Column:
    head = strip(heading_block(path))
    return F.array_join(F.filter(F.array(head, strip(body)), lambda x: x != ""), "\n\n")


@dataclass(frozen=True)
class ChunkConfig:
    """Chunk sizes in characters."""

    target: int = 1800
    minimum: int = 600
    maximum: int = 2600



def _pack_sentences(paragraph: Column, limit: Column) -> Column:
    """Sentences of a long paragraph put together up to ``limit`` characters each."""
    sentences = F.filter(F.split(paragraph, SENTENCE_END), lambda x: strip(x) != "")
    zero = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(x) <= limit)
        return F.struct(F.when(fits, F.concat(acc["now"], x)).otherwise(x).alias("now"),
                        F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"))

    packed = F.aggregate(sentences, zero, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.filter(F.transform(packed, strip), lambda x: x != "")


def split_body(body: Column, head: Column, limit: Column) -> Column:
    """Bodies of the parts of one oversized section, each with room for ``head`` characters.

    A paragraph opens a part if the open one has no room for it; all but the last piece of
    a long paragraph end their part.  One fold over the pieces; an empty body has no part.
    """
    paragraphs = F.filter(F.transform(F.split(body, PARAGRAPH_END), strip), lambda x: x != "")
    cut = lambda p: let(F.when(F.length(p) <= limit, F.array(p)).otherwise(_pack_sentences(p, limit)), lambda ps: F.transform(
        ps, lambda x, i: F.struct(x.alias("text"), (i == 0).alias("first"), (i == F.size(ps) - 1).alias("last"), F.length(p).alias("whole"))))
    none = F.array().cast("array<string>")
    zero = F.struct(head.cast("int").alias("size"), F.lit(False).alias("end"), none.alias("now"), none.alias("done"))
    closed = lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["now"], "\n\n")))

    def step(acc: Column, x: Column) -> Column:
        new = acc["end"] | (x["first"] & (F.size(acc["now"]) > 0) & (acc["size"] + x["whole"] + 2 > limit))
        return let(new, lambda n: F.struct(
            (F.when(n, head).otherwise(acc["size"]) + F.length(x["text"]) + 2).cast("int").alias("size"), (~x["last"]).alias("end"),
            F.when(n, F.array(x["text"])).otherwise(F.concat(acc["now"], F.array(x["text"]))).alias("now"),
            F.when(n, closed(acc)).otherwise(acc["done"]).alias("done")))

    parts = F.aggregate(F.flatten(F.transform(paragraphs, cut)), zero, step, closed)
    return F.filter(parts, lambda x: x != "")


def split_oversized(secs: DataFrame, maximum: int, path: str = "path") -> DataFrame:
    """Parts of sections longer than ``maximum``: by paragraph, then by sentence."""
    s = secs.withColumn("_text", render(F.col("heading_path"), F.col("body")))
    s = s.where(F.length("_text") > maximum).withColumn("_head", strip(heading_block(F.col("heading_path"))))
    s = s.withColumn("_parts", split_body(F.col("body"), F.length("_head"), F.lit(maximum)))
    s = s.withColumn("_parts", F.when(F.size("_parts") == 0, F.array(F.lit(""))).otherwise(F.col("_parts")))
    s = s.select(path, "section_no", "title", "heading_path", "line_start", "line_end", "_head", F.posexplode_outer("_parts").alias("part", "_b"))
    text = F.array_join(F.filter(F.array("_head", "_b"), lambda x: x != ""), "\n\n")
    s = s.withColumn("text", strip(text))
    cid = F.substring(F.sha1(F.concat_ws(":", F.col(path).cast("string"), F.col("line_start"), F.col("part"), F.col("text"))), 1, 12)
    return s.select(path, "section_no", "part", F.concat(F.lit("chunk_"), cid).alias("chunk_id"), "title", "heading_path", "line_start",
                    "line_end", "text", F.length("text").alias("char_count"))


def chunks(secs: DataFrame, cfg: ChunkConfig = ChunkConfig(), path: str = "path") -> DataFrame:
    """Sections of each document packed into chunks.

    Only lengths decide where a chunk ends, so one fold over a document's list of section
    lengths gives every section its chunk number.
    """
    s = secs.withColumn("_r", render(F.col("heading_path"), F.col("body"))).where("_r <> ''").withColumn("_n", F.length("_r"))
    big = split_oversized(s.drop("_r", "_n"), cfg.maximum, path)
    arr = s.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("section_no", "_n"))).alias("_a"))
    # state: length of the open chunk (-1: none), its number, how each section starts
    zero = F.struct(F.lit(-1).alias("size"), F.lit(0).alias("no"), F.array().cast("array<struct<section_no:int,no:int,kind:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        joined = acc["size"] + 2 + x["_n"]
        huge = x["_n"] > cfg.maximum
        fits = (acc["size"] >= 0) & ~huge & ((joined <= cfg.target) | ((acc["size"] < cfg.minimum) & (joined <= cfg.maximum)))
        kind = F.when(huge, "huge").when(fits, "more").when(acc["size"] < 0, "fresh").otherwise("next")
        no = F.when(fits, acc["no"]).otherwise(acc["no"] + 1)
        row = F.struct(x["section_no"].alias("section_no"), no.alias("no"), kind.alias("kind"))
        size = F.when(huge, -1).when(fits, joined).otherwise(x["_n"])
        return F.struct(size.alias("size"), no.alias("no"), F.concat(acc["out"], F.array(row)).alias("out"))

    marks = arr.select(path, F.inline_outer(F.aggregate("_a", zero, step)["out"]))
    m = s.join(marks, [path, "section_no"]).where("kind <> 'huge'")
    parts = m.groupBy(path, "no").agg(F.array_sort(F.collect_list(F.struct(
        "section_no", "kind", "title", "heading_path", "line_start", "line_end", "_r"))).alias("_g"))
    first = F.get("_g", F.lit(0))
    shared = F.aggregate("_g", first["heading_path"], lambda acc, x: _common(acc, x["heading_path"]))
    seed = F.concat_ws(":", F.col(path).cast("string"), first["line_start"], first["line_end"], F.when(first["kind"] == "next", first["_r"]))
    small = parts.select(
        path, first["section_no"].alias("section_no"), F.lit(0).alias("part"),
        F.concat(F.lit("chunk_"), F.substring(F.sha1(seed), 1, 12)).alias("chunk_id"), first["title"].alias("title"), shared.alias("heading_path"),
        first["line_start"].alias("line_start"), F.element_at("_g", -1)["line_end"].alias("line_end"),
        strip(F.array_join(F.transform("_g", lambda x: x["_r"]), "\n\n")).alias("text"))
    return small.withColumn("char_count", F.length("text")).unionByName(big)


def _common(a: Column, b: Column) -> Column:
    """Longest common prefix of two heading paths."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.when(stop > 0, F.slice(a, 1, (stop - 1).cast("int"))).otherwise(a)


# -- tables ------------------------------------------------------------------------------------------

def detect_tables(docs: DataFrame, path: str = "path", text: str = "text", context: int = 4) -> DataFrame:
    """Pipe-table blocks with heading path and up to four context lines on each side."""
    df = docs.withColumn("_l", F.split(F.regexp_replace(F.col(text), f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK))
    bar = lambda x: F.contains(x, F.lit("|"))
    df = df.withColumn("_m", F.transform("_l", lambda x: F.struct((bar(x) & x.rlike(TABLE_LINE)).alias("row"), (bar(x) & x.rlike(TABLE_SEPARATOR)).alias("sep"),
                                                                  strip(x).alias("s"), x.alias("x"))))
    df = df.withColumn("_m", let(F.col("_m"), lambda m: F.transform(m, lambda x, i: F.struct(
        i.alias("i"), x["row"].alias("row"), (x["row"] & F.coalesce(F.get(m, i + 1)["sep"], F.lit(False))).alias("start"), (~x["row"] & (x["s"] != "")).alias("near"),
        x["s"].alias("s"), F.when(F.startswith(x["x"], F.lit("#")), F.struct(F.length(F.regexp_extract(x["x"], HEADING, 1)).alias("level"),
                                                                            F.regexp_extract(x["x"], HEADING, 2).alias("name"))).alias("h")))))
    # One fold over the lines: the open table (-1: none), the number of context lines so far, the heading path.
    none = F.array().cast("array<string>")
    table = "struct<from:int,to:int,before:int,after:int,heading_path:array<string>>"
    zero = F.struct(F.lit(-1).alias("open"), F.lit(0).alias("before"), F.lit(0).alias("n"), none.alias("path"), none.alias("trail"),
                    F.array().cast(f"array<{table}>").alias("done"))

    def closed(acc: Column, at: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["open"].alias("from"), (at - 1).cast("int").alias("to"), acc["before"].alias("before"),
                                                      acc["n"].alias("after"), acc["trail"].alias("heading_path"))))

    def step(acc: Column, x: Column) -> Column:
        ends = (acc["open"] >= 0) & ~x["row"] & (x["i"] >= acc["open"] + 2)
        opens = (acc["open"] < 0) & x["start"]
        return F.struct(
            F.when(opens, x["i"]).when(ends, -1).otherwise(acc["open"]).alias("open"), F.when(opens, acc["n"]).otherwise(acc["before"]).alias("before"),
            (acc["n"] + x["near"].cast("int")).alias("n"),
            F.when(x["h"].isNotNull(), F.concat(F.slice(acc["path"], 1, x["h"]["level"] - 1), F.array(x["h"]["name"]))).otherwise(acc["path"]).alias("path"),
            F.when(opens, acc["path"]).otherwise(acc["trail"]).alias("trail"), F.when(ends, closed(acc, x["i"])).otherwise(acc["done"]).alias("done"))

    df = df.withColumn("_b", let(F.col("_m"), lambda m: F.aggregate(
        m, zero, step, lambda acc: F.when(acc["open"] >= 0, closed(acc, F.size(m))).otherwise(acc["done"]))))
    df = df.withColumn("_c", F.transform(F.filter("_m", lambda x: x["near"]), lambda x: x["s"]))
    # Each table takes its own lines here, so no table row carries the document.
    lines = lambda a, at, n: F.array_join(F.slice(a, at, n), "\n")
    df = df.withColumn("_b", let(F.struct(F.col("_l").alias("l"), F.col("_c").alias("c"), F.col("_b").alias("b")), lambda z: F.transform(z["b"], lambda b: F.struct(
        b["from"].alias("start_index"), b["to"].alias("end_index"), b["heading_path"].alias("heading_path"),
        lines(z["l"], b["from"] + 1, b["to"] - b["from"] + 1).alias("table_text"),
        lines(z["c"], F.greatest(b["before"] - context + 1, F.lit(1)), F.least(b["before"], F.lit(context))).alias("before_context"),
        lines(z["c"], b["after"] + 1, F.lit(context)).alias("after_context")))))
    return df.select(path, F.posexplode_outer("_b").alias("table_no", "b")).where("b IS NOT NULL").select(path, "table_no", "b.*")


def run_summary(results: DataFrame, *keys: str) -> DataFrame:
    """Chunks, successes, failures, nodes and edges of a run."""
    ok = F.col("status") == "ok"
    grouped = results.groupBy(*keys) if keys else results.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("chunks"), F.sum(ok.cast("bigint")).alias("successes"), F.sum((~ok).cast("bigint")).alias("failures"),
                       F.sum("n_nodes").alias("nodes"), F.sum("n_edges").alias("edges"))
