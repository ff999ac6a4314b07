"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs
from .registry import query

# Text with the features the cleaner looks for, made from every document's own text.
SQL_NOISY = """noisy AS (SELECT doc_id, '# ' || source || chr(10) || '#   ' || source || chr(10) || chr(10) || chr(10)
  || replace(replace(replace(replace(replace(replace(text, '. ', '.  '), ' the ', chr(12288) || 'the' || chr(8203) || ' '), ' of ', ' ≥ '), ' in ', '～'), ', ', '， '), ' and ', ' HIV  RNA ') || '  ' AS text FROM documents)"""


def noisy(t):
    d = t.raw("documents")
    text = F.col("text")
    for a, b in ((". ", ".  "), (" the ", "　the​ "), (" of ", " ≥ "), (" in ", "～"), (", ", "， "), (" and ", " HIV  RNA ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.concat(F.lit("# "), "source", F.lit("\n#   "), "source", F.lit("\n\n\n"), text, F.lit("  "))
    return d.select(F.col("doc_id").alias("path"), text.alias("text"))


SQL_CLEAN = f"""{SQL_NOISY},
s1 AS (SELECT doc_id, text, regexp_replace(translate(replace(replace(text, chr(12288), ' '), chr(8203), ''), '，～', ',~'), '', '') AS t FROM noisy),
ln AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS raw FROM s1),
l2 AS (SELECT doc_id, i, raw, regexp_matches(raw, '^#{{1,5}}') AS h, regexp_replace(raw, '[ \\t]+$', '') AS a FROM ln),
l3 AS (SELECT *, replace(a, '≥', '>=') AS b FROM l2),
l4 AS (SELECT *, CASE WHEN starts_with(ltrim(b), '|') THEN b ELSE regexp_replace(b, '[ \\t]{{2,}}', ' ', 'g') END AS c FROM l3),
l5 AS (SELECT *, regexp_replace(c, '(?i)HIV\\s*RNA', 'HIV RNA', 'g') AS d FROM l4),
l6 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(d, '(?i)(个|cells)\\s*/\\s*(μL|uL|ul)', '/μL', 'g'), '(?i)pg\\s*/\\s*mL', 'pg/mL', 'g'), '(?i)mg\\s*/\\s*L', 'mg/L', 'g') AS e FROM l5),
l7 AS (SELECT *, regexp_replace(e, '\\s*[~～]\\s*', ' ~ ', 'g') AS f FROM l6),
l8 AS (SELECT doc_id, i, h, raw, a, b, c, d, e, f, CASE WHEN h THEN regexp_replace(regexp_replace(raw, '^(#{{1,5}})\\s*(.*?)\\s*$', '\\1 \\2'), '^(#{{1,5}}) $', '\\1') ELSE f END AS s FROM l7),
l9 AS (SELECT *, lag(s) OVER w AS ps, lag(h) OVER w AS ph FROM l8 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l10 AS (SELECT *, h AND coalesce(ph AND ps = s, false) AS twin, NOT h AND trim(s, ' ' || chr(9)) = '' AND coalesce(NOT ph AND trim(ps, ' ' || chr(9)) = '', false) AS run FROM l9)"""


def n_(cond):
    return f"CAST(sum(({cond})::INT) AS BIGINT)"


@query("clean_documents", f"""
WITH {SQL_CLEAN},
agg AS (SELECT doc_id, {n_('h AND raw <> s')} AS normalized_headings, {n_('twin')} AS removed_duplicate_headings, {n_('run')} AS collapsed_blank_lines,
  {n_('NOT h AND raw <> a')} AS trimmed_trailing_whitespace, {n_('NOT h AND b <> c')} AS collapsed_internal_spaces, {n_('NOT h AND e <> f')} AS normalized_ranges,
  CAST(sum(CASE WHEN h THEN 0 ELSE len(regexp_extract_all(a, '≥')) END) AS BIGINT) AS normalized_greater_equal_count,
  CAST(sum(CASE WHEN h THEN 0 ELSE len(regexp_extract_all(c, '(?i)HIV\\s*RNA')) END) AS BIGINT) AS normalized_hiv_rna_term_count,
  rtrim(string_agg(CASE WHEN NOT h AND trim(s, ' ' || chr(9)) = '' THEN '' ELSE s END, chr(10) ORDER BY i) FILTER (WHERE NOT twin AND NOT run), ' ' || chr(10) || chr(9)) || chr(10) AS cleaned FROM l10 GROUP BY 1)
SELECT agg.doc_id AS path, len(regexp_extract_all(text, chr(12288))) AS replaced_full_width_spaces, len(regexp_extract_all(text, chr(8203))) AS removed_zero_width,
  len(regexp_extract_all(text, '[，～]')) AS normalized_fullwidth_ascii_count, normalized_headings, removed_duplicate_headings, collapsed_blank_lines, trimmed_trailing_whitespace,
  collapsed_internal_spaces, normalized_ranges, normalized_greater_equal_count, normalized_hiv_rna_term_count, sha1(cleaned) AS digest FROM agg JOIN noisy USING (doc_id)""")
def clean_documents(t):
    c = docs.clean_documents(noisy(t))
    return c.select("path", "replaced_full_width_spaces", "removed_zero_width", "normalized_fullwidth_ascii_count", "normalized_headings",
                    "removed_duplicate_headings", "collapsed_blank_lines", "trimmed_trailing_whitespace", "collapsed_internal_spaces",
                    "normalized_ranges", "normalized_greater_equal_count", "normalized_hiv_rna_term_count", F.sha1("cleaned").alias("digest"))


SQL_DROP = """dl AS (SELECT page_id, generate_subscripts(string_split(md, chr(10)), 1) AS i, unnest(string_split(md, chr(10))) AS s FROM (SELECT page_id, replace(md, chr(10) || '# ', chr(10) || '# page' || chr(10) || '# page' || chr(10) || '# page' || chr(10)) AS md FROM page_md)),
dk AS (SELECT *, s LIKE '#%' AND regexp_matches(s, '^#{1,5}') AS h, lag(s) OVER (PARTITION BY page_id ORDER BY i) AS ps FROM dl)"""


@query("drop_repeat_headings", f"""
WITH {SQL_DROP}
SELECT page_id, {n_("h AND coalesce(ps = s, false)")} AS removed_duplicate_headings, {n_("NOT h AND trim(s) = '' AND coalesce(trim(ps) = '', false)")} AS collapsed_blank_lines FROM dk GROUP BY 1""")
def drop_repeat_headings(t):
    md = F.replace("md", F.lit("\n# "), F.lit("\n# page\n# page\n# page\n"))
    p = t.page_md.withColumn("_l", F.transform(F.split(md, "\n"), lambda s: F.struct(s.rlike("^#{1,5}").alias("h"), s.alias("s"))))
    p = p.withColumns({"_t": F.lit(None), "_n": F.lit(None)})
    return docs.drop_repeats(p).select("page_id", "removed_duplicate_headings", "collapsed_blank_lines")


@query("clean_summary", """
SELECT source, count(*) AS files, CAST(sum(len(regexp_extract_all(text, ' the '))) AS BIGINT) AS replaced_full_width_spaces, count(*) AS removed_duplicate_headings FROM documents GROUP BY 1""")
def clean_summary(t):
    src = t.raw("documents").select(F.col("doc_id").alias("path"), "source")
    c = docs.clean_documents(noisy(t)).join(src, "path")
    return docs.clean_summary(c, "source").select("source", "files", "replaced_full_width_spaces", "removed_duplicate_headings")


SQL_SEC = """pl AS (SELECT page_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS s, len(ls) AS n FROM (SELECT page_id, string_split(regexp_replace(md, '\\n$', ''), chr(10)) AS ls FROM page_md)),
ph AS (SELECT *, regexp_extract(s, '^(#{1,5})\\s+(.*)$', 1) AS marks, trim(regexp_extract(s, '^(#{1,5})\\s+(.*)$', 2)) AS hname FROM pl),
pg AS (SELECT *, marks <> '' AS h, sum((marks <> '')::INT) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM ph),
sec AS (SELECT page_id, sec, min(i) AS line_start, max(i) AS line_end, max(CASE WHEN h THEN length(marks) ELSE 0 END) AS level, max(CASE WHEN h THEN hname END) AS hname,
   regexp_replace(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT h), ''), '^\\s+|\\s+$', '', 'g') AS body FROM pg GROUP BY 1, 2)"""


def page_sections(t):
    return docs.sections(t.page_md, "page_id", "md")


@query("sections", f"""
WITH {SQL_SEC}
SELECT page_id, line_start, line_end, level, coalesce(hname, '') AS heading, length(body) AS body_length, sha1(body) AS digest FROM sec WHERE body <> '' OR level > 0""")
def sections(t):
    s = page_sections(t)
    return s.select("page_id", "line_start", F.col("line_end").cast("bigint").alias("line_end"), "level",
                    F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("")).alias("heading"), F.length("body").alias("body_length"), F.sha1("body").alias("digest"))


# Sections with their heading paths, and the parts of those longer than a limit, stated as recursions.
SQL_PATHS = """hp AS (SELECT id, 0 AS sec, CAST([] AS VARCHAR[]) AS path FROM (SELECT DISTINCT id FROM ss)
  UNION ALL SELECT s.id, s.sec, list_append(list_slice(hp.path, 1, s.level - 1), s.hname) FROM hp JOIN ss s ON s.id = hp.id AND s.sec = hp.sec + 1),
hb AS (SELECT s.id, s.sec, s.line_start, s.line_end, s.body, s.level > 0 AS headed,
  trim(array_to_string([repeat('#', CAST(i AS INTEGER)) || ' ' || path[i] for i in range(1, len(path) + 1)], chr(10))) AS head FROM ss s JOIN hp ON hp.id = s.id AND hp.sec = s.sec),
rn AS (SELECT *, CASE WHEN head = '' THEN body WHEN body = '' THEN head ELSE head || chr(10) || chr(10) || body END AS r FROM hb WHERE body <> '' OR headed)"""


def sql_parts(limit):
    """``id, sec, line_start, line_end, part, chunk_id, text`` of the sections of ``rn`` longer than ``limit``."""
    return f"""big AS (SELECT * FROM rn WHERE length(r) > {limit}),
pa AS (SELECT id, sec, generate_subscripts(ps, 1) AS par, unnest(ps) AS p FROM (SELECT id, sec,
  [y for y in [regexp_replace(x, '^\\s+|\\s+$', '', 'g') for x in string_split_regex(body, '\\n\\s*\\n')] if y <> ''] AS ps FROM big)),
se AS (SELECT id, sec, par, generate_subscripts(xs, 1) AS k, unnest(xs) AS x FROM (SELECT id, sec, par,
  [y for y in [regexp_replace(x, '^\\s+', '') for x in regexp_extract_all(p, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+')] if y <> ''] AS xs FROM pa WHERE length(p) > {limit})),
sp AS (SELECT id, sec, par, k, length(x) AS size, 0 AS g FROM se WHERE k = 1
  UNION ALL SELECT e.id, e.sec, e.par, e.k, CASE WHEN sp.size + length(e.x) <= {limit} THEN sp.size + length(e.x) ELSE length(e.x) END, CASE WHEN sp.size + length(e.x) <= {limit} THEN sp.g ELSE sp.g + 1 END
  FROM sp JOIN se e ON e.id = sp.id AND e.sec = sp.sec AND e.par = sp.par AND e.k = sp.k + 1),
pc AS (SELECT id, sec, par, 0 AS g, p AS x, length(p) AS whole FROM pa WHERE length(p) <= {limit}
  UNION ALL SELECT id, sec, par, g, trim(string_agg(x, '' ORDER BY k)), 0 FROM sp JOIN se USING (id, sec, par, k) GROUP BY 1, 2, 3, 4),
pk AS (SELECT pc.id, pc.sec, x, length(pa.p) AS whole, g = 0 AS first, g = max(g) OVER (PARTITION BY pc.id, pc.sec, pc.par) AS last, row_number() OVER (PARTITION BY pc.id, pc.sec ORDER BY pc.par, g) AS k,
  CASE WHEN head = '' THEN 0 ELSE length(head) END AS room FROM pc JOIN pa USING (id, sec, par) JOIN big USING (id, sec)),
pt AS (SELECT id, sec, k, room + length(x) + 2 AS size, last, 0 AS part FROM pk WHERE k = 1
  UNION ALL SELECT n.id, n.sec, n.k, CASE WHEN NOT pt.last OR (n.first AND pt.size + n.whole + 2 > {limit}) THEN n.room ELSE pt.size END + length(n.x) + 2, n.last,
    CASE WHEN NOT pt.last OR (n.first AND pt.size + n.whole + 2 > {limit}) THEN pt.part + 1 ELSE pt.part END
  FROM pt JOIN pk n ON n.id = pt.id AND n.sec = pt.sec AND n.k = pt.k + 1),
pb AS (SELECT id, sec, part, string_agg(x, chr(10) || chr(10) ORDER BY k) AS b FROM pt JOIN pk USING (id, sec, k) GROUP BY 1, 2, 3),
px AS (SELECT id, sec, line_start, line_end, coalesce(part, 0) AS part, trim(CASE WHEN head = '' THEN coalesce(b, '') WHEN b IS NULL THEN head ELSE head || chr(10) || chr(10) || b END) AS text
  FROM big LEFT JOIN pb USING (id, sec)),
parts AS (SELECT *, 'chunk_' || substr(sha1(concat_ws(':', id, line_start, part, text)), 1, 12) AS chunk_id FROM px)"""


CHUNK = docs.ChunkConfig()


@query("chunks", f"""
WITH RECURSIVE {SQL_SEC},
ss AS (SELECT page_id AS id, sec, line_start, line_end, level, hname, body FROM sec),
{SQL_PATHS}, {sql_parts(CHUNK.maximum)},
ck AS (SELECT *, length(r) AS n, row_number() OVER (PARTITION BY id ORDER BY sec) AS k FROM rn WHERE r <> ''),
cs AS (SELECT id, k, CASE WHEN n > {CHUNK.maximum} THEN -1 ELSE n END AS size, 1 AS no, CASE WHEN n > {CHUNK.maximum} THEN 'huge' ELSE 'fresh' END AS kind FROM ck WHERE k = 1
  UNION ALL SELECT id, k, CASE kind WHEN 'huge' THEN -1 WHEN 'more' THEN size + 2 + n ELSE n END, CASE WHEN kind = 'more' THEN no ELSE no + 1 END, kind FROM (
    SELECT c.id, c.k, c.n, cs.size, cs.no, CASE WHEN c.n > {CHUNK.maximum} THEN 'huge' WHEN cs.size < 0 THEN 'fresh'
      WHEN cs.size + 2 + c.n <= {CHUNK.target} OR (cs.size < {CHUNK.minimum} AND cs.size + 2 + c.n <= {CHUNK.maximum}) THEN 'more' ELSE 'next' END AS kind
    FROM cs JOIN ck c ON c.id = cs.id AND c.k = cs.k + 1)),
cg AS (SELECT id, no, arg_min(line_start, k) AS line_start, arg_min(line_end, k) AS first_end, max(line_end) AS line_end, arg_min(CASE WHEN kind = 'next' THEN r ELSE '' END, k) AS first_text,
  arg_min(kind, k) AS first_kind, length(trim(string_agg(r, chr(10) || chr(10) ORDER BY k))) AS char_count FROM cs JOIN ck USING (id, k) WHERE kind <> 'huge' GROUP BY 1, 2)
SELECT id AS page_id, 'chunk_' || substr(sha1(concat_ws(':', id, line_start, first_end, CASE WHEN first_kind = 'next' THEN first_text END)), 1, 12) AS chunk_id, line_start, line_end, char_count FROM cg
UNION ALL SELECT id, chunk_id, line_start, line_end, length(text) FROM parts""")
def chunks(t):
    return docs.chunks(page_sections(t), CHUNK, "page_id").select("page_id", "chunk_id", "line_start", F.col("line_end").cast("bigint").alias("line_end"), "char_count")


@query("split_oversized", f"""
WITH RECURSIVE {SQL_SEC.replace("FROM page_md", "FROM (SELECT doc_id AS page_id, '# ' || source || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS md FROM documents)")},
ss AS (SELECT page_id AS id, sec, line_start, line_end, level, hname, body FROM sec),
{SQL_PATHS}, {sql_parts(1000)}
SELECT id AS path, part, chunk_id, length(text) AS char_count FROM parts""")
def split_oversized(t):
    d = docs.sections(t.raw("documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("# "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text")))
    return docs.split_oversized(d, 1000).select("path", "part", "chunk_id", "char_count")


SQL_TBL = """tb AS (SELECT doc_id, string_split(regexp_replace(replace(text, '. ', chr(10) || '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| x | y |' || chr(10) || 'tail '), '\\n$', ''), chr(10)) AS ls FROM documents),
tl AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS s FROM tb),
t2 AS (SELECT *, regexp_matches(s, '^\\s*\\|.*\\|\\s*$') AS r, regexp_matches(s, '^\\s*\\|?(\\s*:?-{3,}:?\\s*\\|)+\\s*:?-{3,}:?\\s*\\|?\\s*$') AS sp FROM tl),
t3 AS (SELECT *, r AND coalesce(lead(sp) OVER (PARTITION BY doc_id ORDER BY i), false) AS st FROM t2),
t4 AS (SELECT doc_id, i AS start_index, (SELECT coalesce(min(g.i), max(z.n)) - 1 FROM (SELECT len(ls) AS n FROM tb WHERE tb.doc_id = t3.doc_id) z LEFT JOIN t2 g ON g.doc_id = t3.doc_id AND NOT g.r AND g.i >= t3.i + 2) AS end_index FROM t3 WHERE st)"""


@query("detect_tables", f"""
WITH {SQL_TBL}
SELECT doc_id AS path, count(*) AS n_tables, min(start_index) AS first_start, max(end_index) AS last_end, CAST(sum(end_index - start_index + 1) AS BIGINT) AS n_lines FROM t4 GROUP BY 1""")
def detect_tables(t):
    text = F.replace("text", F.lit(". "), F.lit("\n| k | v |\n|---|---|\n| x | y |\ntail "))
    d = docs.detect_tables(t.raw("documents").select(F.col("doc_id").alias("path"), text.alias("text")))
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("n_tables"), F.min("start_index").cast("bigint").alias("first_start"), F.max("end_index").cast("bigint").alias("last_end"),
                                 F.sum(F.col("end_index") - F.col("start_index") + 1).alias("n_lines"))
