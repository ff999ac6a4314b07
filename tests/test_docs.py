import hashlib
import random
import re

from pyspark.sql import functions as F

from evigraph.operators import docs


def test_clean_document(spark):
    raw = "﻿#  标题\r\n#标题\r\n\r\n\r\nCD4 +T细胞  ≥ 200个/μL  \r\n１～３ 天​　x\r\n| a  | b |\r\n"
    r = docs.clean_documents(spark.createDataFrame([("p", raw)], "path string, text string")).first()
    assert r.cleaned == "# 标题\n\nCD4+ T 淋巴细胞 >= 200/μL\n1 ~ 3 天 x\n| a  | b |\n"
    assert (r.removed_bom, r.removed_zero_width, r.replaced_full_width_spaces) == (1, 1, 1)
    assert (r.removed_duplicate_headings, r.collapsed_blank_lines, r.normalized_headings) == (1, 1, 2)
    assert (r.normalized_greater_equal_count, r.normalized_cd4_term_count, r.normalized_ranges) == (1, 1, 1)


def test_sections_follow_the_heading_stack(spark):
    md = "intro\n# A\nx\n### C\ny\n## B\n# D\n"
    s = docs.sections(spark.createDataFrame([("p", md)], "path string, text string")).collect()
    got = [(r.heading_path, r.level, r.line_start, r.line_end, r.body, r.title) for r in sorted(s, key=lambda r: r.section_no)]
    assert got == [([], 0, 1, 1, "intro", ""), (["A"], 1, 2, 3, "x", "A"), (["A", "C"], 3, 4, 5, "y", "A"), (["A", "B"], 2, 6, 6, "", "A"), (["D"], 1, 7, 7, "", "D")]


def test_chunks_pack_like_a_plain_loop(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice((5, 20, 60, 150)) for _ in range(60)]
    md = "\n".join(f"# h{i}\n{'x' * n}" for i, n in enumerate(sizes))
    cfg = docs.ChunkConfig(target=90, minimum=40, maximum=140)
    secs = docs.sections(spark.createDataFrame([("p", md)], "path string, text string"))
    got = sorted(docs.chunks(secs, cfg).collect(), key=lambda r: (r.line_start, r.part))
    want, cur = [], None
    for i, n in enumerate(sizes):
        text = f"# h{i}\n\n{'x' * n}"
        if len(text) > cfg.maximum:
            want += [cur] if cur else []
            want.append(text)
            cur = None
        elif cur is None:
            cur = text
        elif len(cur) + 2 + len(text) <= cfg.target or (len(cur) < cfg.minimum and len(cur) + 2 + len(text) <= cfg.maximum):
            cur += "\n\n" + text
        else:
            want.append(cur)
            cur = text
    want += [cur] if cur else []
    assert [r.text for r in got] == want
    assert len(got[0].text) <= cfg.maximum and got[0].chunk_id == "chunk_" + hashlib.sha1(f"p:{got[0].line_start}:2".encode()).hexdigest()[:12]


def test_oversized_section_splits_by_paragraph_then_sentence(spark):
    body = "aaa bbb.\n\n" + "One two. Three four! Five six?" + "\n\nend"
    s = docs.sections(spark.createDataFrame([("p", "# T\n" + body)], "path string, text string"))
    got = [r.text for r in sorted(docs.split_oversized(s, 25).collect(), key=lambda r: r.part)]
    assert got == ["# T\n\naaa bbb.", "# T\n\nOne two. Three four!".replace("One two. Three", "One two.Three"), "# T\n\nFive six?\n\nend"]


def test_tables_with_context(spark):
    md = "# H\nbefore\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n| x | y |\nno separator"
    t = docs.detect_tables(spark.createDataFrame([("p", md)], "path string, text string")).collect()
    assert [(r.start_index, r.end_index, r.heading_path, r.before_context, r.after_context) for r in t] == [
        (3, 5, ["H"], "# H\nbefore", "after\nno separator")]


def plain_parts(body, head, limit):
    """Parts of a section's body by plain loops."""
    parts, size = [[]], head
    for p in (x.strip() for x in re.split(r"\n\s*\n", body) if x.strip()):
        if parts[-1] and size + len(p) + 2 > limit:
            parts.append([])
            size = head
        pieces = [p]
        if len(p) > limit:
            pieces = []
            for s in (x for x in re.split(r"(?<=[。！？.!?])\s*", p) if x.strip()):
                if pieces and len(pieces[-1]) + len(s) <= limit:
                    pieces[-1] += s
                else:
                    pieces.append(s)
            pieces = [x.strip() for x in pieces]
        for i, piece in enumerate(pieces):
            parts[-1].append(piece)
            size += len(piece) + 2
            if i < len(pieces) - 1:
                parts.append([])
                size = head
    return ["\n\n".join(p) for p in parts if p]


def test_parts_equal_plain_loops(spark):
    rnd = random.Random(11)
    word = lambda: rnd.choice(("a", "bb", "ccc。", "d.", "ee!", "f?", "长句子", "g\u3000", "...", " ", "\t"))
    bodies = ["", "   ", "x" * 90, ".", "!!!"] + ["".join(rnd.choice((word(), word(), word(), "\n\n", "\n \n", "\n")) for _ in range(rnd.randrange(200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    for head, limit in ((0, 25), (7, 40)):
        got = dict(df.select("id", docs.split_body(F.col("body"), F.lit(head), F.lit(limit))).collect())
        assert got == {i: plain_parts(b, head, limit) for i, b in enumerate(bodies)}


def plain_tables(text, context=4):
    """Tables of a text by plain loops."""
    lines, out, path, i = text.split("\n"), [], [], 0
    row = lambda x: re.match(docs.TABLE_LINE, x) is not None
    trail = []
    for x in lines:
        if m := re.match(docs.HEADING, x):
            path = path[: len(m[1]) - 1] + [m[2]]
        trail.append(path)
    near = [(k, x.strip()) for k, x in enumerate(lines) if x.strip() and not row(x)]
    while i < len(lines):
        if row(lines[i]) and i + 1 < len(lines) and re.match(docs.TABLE_SEPARATOR, lines[i + 1]):
            end = i + 2
            while end < len(lines) and row(lines[end]):
                end += 1
            out.append((len(out), i, end - 1, trail[i], "\n".join(lines[i:end]), "\n".join([x for k, x in near if k < i][-context:]), "\n".join([x for k, x in near if k >= end][:context])))
            i = end
        else:
            i += 1
    return out


def test_tables_equal_plain_loops(spark):
    rnd = random.Random(3)
    line = lambda: rnd.choice(("| a | b |", "| a | b |", "|---|---|", "|---|---|", "---|---|", "# H", "### K", "text", "", " more ", "| open"))
    texts = ["", "| a |", "|---|", "| a |\n|---|"] + ["\n".join(line() for _ in range(rnd.randrange(40))).rstrip("\n") for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    found = {i: [] for i in range(len(texts))}
    for r in docs.detect_tables(df).collect():
        found[r.path].append((r.table_no, r.start_index, r.end_index, r.heading_path, r.table_text, r.before_context, r.after_context))
    assert {k: sorted(v) for k, v in found.items()} == {i: plain_tables(x) for i, x in enumerate(texts)}
