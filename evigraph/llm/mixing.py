"""Mixing sources to target weights by a low-discrepancy schedule (operator 5).

Each source is shuffled by the md5 of its ids, read as one stream of words, and cut into
equal blocks (sizes differ by one word at most): of about ``BLOCK`` words, or smaller ones
where a source would have less than ``FEWEST`` blocks.  The mix is a row of slots, each of
which takes one block.  Slot ``i`` has the point ``frac(i / golden ratio)``, kept as a
31-bit integer; the point falls into one source's stretch of the cumulated numbers of
blocks that the targets ask for, so every source's share of any run of slots is off by a
logarithmic number of slots only.  The slots of a source are ranked; rank ``r`` takes block
``r * STRIDE + STEP`` modulo the number of blocks, which visits every block once in each
pass.  The schedule is read twice as far as the targets need on average, and a source's
slots end where it has its blocks.  What a document gives is the sum over its blocks of
the slots that hit them.

Everything is DataFrame work.  Positions (of documents in a stream, of slots in a source)
are prefix sums in two levels: per bucket first, then a window inside the bucket, so a
source with a third of all rows is spread over ``BUCKETS`` tasks.

Defined cases: NULL text has size 0; documents of size 0 take 0; a NULL source is a source
of its own and sorts last; sources whose documents are all empty have target 0; rows that
repeat id, text and source share evenly what all of them take, and ``mixed`` returns them
with the other columns of one of them; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, read, row_key, stored

# Weights of the sources in their order, repeating; no source is used more often than MOST.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
# Words in a block, and blocks that a source has at least (if it has as many words).
BLOCK, FEWEST = 256, 1024
# Slots are ranked in runs of RUN; a stream is positioned in BUCKETS.
RUN = 4096
BUCKETS = 4096
# Golden-ratio step and modulus of the 31-bit points; the step is odd, so all points differ.
POINTS = 2**31
STEP = 1327217885
# Distance of the blocks of neighbouring ranks (a prime that divides no number of blocks).
STRIDE = 7919
# Points are looked up in cells of so many points.
CELL = 2**19


def word_count(text: Column) -> Column:
    """Number of maximal runs outside white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row_key, doc_id, source, size`` of every row, stored: the texts are read once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return stored(rows.select(row_key("doc_id", "text", "source").alias("row_key"), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` with capped shares of all words; one row per source.

    Sharing the excess of capped sources again and again ends where every source has the
    smaller of its cap and ``level * weight`` for one common level.  In the order of
    cap / weight the capped sources come first, so the level is found by running sums
    over the (few) sources.
    """
    source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    source = source.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    source = source.withColumn("_level", left / F.sum("weight").over(after))
    # The first source that stays below its cap has the level; the levels computed for the
    # sources after it take it as capped and are lower.
    free = F.max(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))).over(everything)
    target = F.least(F.col("cap"), free * F.col("weight"))
    return source.select("source", "source_size", target.alias("target"))


def _positions(sized: DataFrame, buckets: int) -> DataFrame:
    """Start of every document in its source's shuffled stream."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # The leading hex digits are the bucket, so buckets and keys sort alike.
    slot = F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("long") * buckets / F.lit(16**6)).cast("long")
    rows = sized.filter("size > 0").withColumn("_key", key).withColumn("_b", F.coalesce(slot, F.lit(buckets)))
    total = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("source", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_b").orderBy("_key", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.alias("r").join(total.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r._b") == F.col("t._b")))
    return joined.select("r.row_key", "r.source", "r.size", (F.col("_base") + F.col("_in")).alias("start"))


def blocks(shares: DataFrame, block: int = BLOCK, fewest: int = FEWEST) -> DataFrame:
    """``shares`` with ``blocks`` of each source and ``need``, the blocks that its target asks for."""
    count = F.least(F.col("source_size"), F.greatest(F.lit(fewest), F.ceil(F.col("source_size") / block))).cast("long")
    count = count - F.when((count > 0) & (count % STRIDE == 0), 1).otherwise(0)
    need = F.round(F.col("target") * count / F.col("source_size")).cast("long")
    return shares.withColumn("blocks", count).withColumn("need", F.when(F.col("source_size") > 0, need).otherwise(F.lit(0).cast("long")))


def first_word(block: Column, size: Column, count: Column) -> Column:
    """Where a block begins in a stream of ``size`` words cut into ``count`` blocks."""
    return block * F.floor(size / count) + F.least(block, F.pmod(size, count))


def block_of(word: Column, size: Column, count: Column) -> Column:
    """The block that holds a word; the first blocks are one word longer."""
    short, longer = F.floor(size / count), F.pmod(size, count)
    head = longer * (short + 1)
    return F.when(word < head, F.floor(word / (short + 1))).otherwise(longer + F.floor((word - head) / short)).cast("long")


def schedule(shares: DataFrame, run: int = RUN, step: int = STEP) -> DataFrame:
    """``slot, source, pass, block``: the block that each slot of the mix takes."""
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    total = F.sum("need").over(Window.partitionBy())
    high = F.sum("need").over(upto)
    # One row per source; stretches are cut at the borders of cells, so slots meet few of them.
    stretch = shares.filter("need > 0").select(
        "source", "blocks", "need",
        F.floor((high - F.col("need")).cast("double") / total * POINTS).alias("low"), F.floor(high.cast("double") / total * POINTS).alias("high")).filter("high > low")
    cells = stretch.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL))))
    # One row per run of slots, made from the one-row total, then one row per slot.
    runs = shares.agg((2 * F.sum("need")).alias("n")).filter("n > 0").select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run))).alias("run"), "n")
    begin = F.col("run") * run
    slots = runs.repartition("run").select("run", F.explode(F.sequence(begin, F.least(begin + run, F.col("n")) - 1)).alias("slot"))
    slots = slots.withColumn("point", F.pmod(F.pmod("slot", F.lit(POINTS)) * step, F.lit(POINTS))).withColumn("cell", F.floor(F.col("point") / CELL))
    # Sizes of generated rows are guessed far too low, so the joins on them are never left to be broadcasts.
    placed = slots.join(cells.hint("merge"), "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    placed = placed.select("slot", "run", "source", "blocks", "need")
    counts = placed.groupBy("source", "run").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source", "run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = placed.withColumn("_in", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1).alias("p")
    ranked = ranked.join(base.hint("merge").alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.run") == F.col("b.run")))
    rank = (F.col("_base") + F.col("_in")).cast("long")
    out = ranked.select("slot", "p.source", "blocks", "need", rank.alias("rank")).filter("rank < need")
    # Reduced factors, so that no product leaves 64 bits.
    block = F.pmod(F.pmod(F.pmod("rank", "blocks") * STRIDE, F.col("blocks")) + step, F.col("blocks"))
    return out.select("slot", "source", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), block.alias("block")).filter(F.col("pass") < MOST)


def _parts(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """``row_key, source, start, size, block, from, to``: the words of a document that lie in one block."""
    at = _positions(sized, BUCKETS).alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    all_words, count = F.col("source_size"), F.col("blocks")
    at = at.select("r.row_key", "r.source", "r.start", "r.size", "source_size", "blocks",
                   F.explode(F.sequence(block_of(F.col("start"), all_words, count), block_of(F.col("start") + F.col("size") - 1, all_words, count))).alias("block"))
    return at.select("row_key", "source", "start", "size", "block",
                     F.greatest(F.lit(0), first_word(F.col("block"), all_words, count) - F.col("start")).cast("long").alias("from"),
                     F.least(F.col("size"), first_word(F.col("block") + 1, all_words, count) - F.col("start")).cast("long").alias("to"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK, fewest: int = FEWEST, step: int = STEP) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row."""
    sized = sizes(docs, id_col, text_col, source_col)
    shares = stored(blocks(targets(sized), block, fewest), "targets")
    uses = stored(schedule(shares, step=step).groupBy("source", "block").agg(F.count("*").alias("uses")), "uses").alias("u")
    parts = _parts(sized, shares).alias("p").join(uses, F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block")))
    taken = parts.groupBy("row_key").agg(F.sum((F.col("to") - F.col("from")) * F.col("uses")).alias("taken"))
    once = sized.groupBy("row_key", "doc_id", "source", "size").agg(F.count("*").alias("copies"))
    out = once.join(taken, "row_key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    # Rows that repeat id, text and source share what their positions take, evenly.
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    more = F.when(F.col("copy") <= F.pmod("taken", "copies"), 1).otherwise(0)
    out = out.withColumn("taken", (F.floor(F.col("taken") / F.col("copies")) + more).cast("long"))
    joined = out.alias("o").join(shares.alias("w"), F.col("o.source").eqNullSafe(F.col("w.source")))
    return joined.select("o.doc_id", "o.source", "o.size", "w.source_size", "w.target", "o.taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          block: int = BLOCK, fewest: int = FEWEST, step: int = STEP, slot_col: str | None = None) -> DataFrame:
    """The mix: rows of ``docs`` as the slots take them, all columns, and ``slot_col`` if it is named.

    In each pass a document gives one row for every stretch of neighbouring blocks that is
    taken: the document as it is where that is all of it, else the words of the stretch
    joined by spaces.  The slot is that of the stretch's first block; rows in the order of
    their slots are the schedule.
    """
    sized = sizes(docs, id_col, text_col, source_col)
    shares = stored(blocks(targets(sized), block, fewest), "targets")
    parts = _parts(sized, shares).alias("p").join(
        stored(schedule(shares, step=step), "slots").alias("u"), F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block")))
    parts = parts.select("row_key", "start", "size", "pass", "p.block", "slot", "from", "to")
    order = Window.partitionBy("row_key", "start", "pass").orderBy("block")
    stretches = parts.withColumn("_s", F.col("block") - F.row_number().over(order)).groupBy("row_key", "start", "pass", "_s").agg(
        F.min("from").alias("_from"), F.max("to").alias("_to"), F.min_by("slot", "block").alias("_slot"), F.first("size").alias("_size"))
    stretches = stretches.select(F.col("row_key").alias("_key"), "_from", "_to", "_size", "_slot")
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.col(source_col))
    rows = docs.withColumn("_key", key).dropDuplicates(["_key"]).join(stretches, "_key")
    words = F.filter(F.split(F.col(text_col), SPACE_CLASS), lambda w: w != "")
    part = F.array_join(F.slice(words, (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")), " ")
    text = F.when(F.col("_to") - F.col("_from") == F.col("_size"), F.col(text_col)).otherwise(part)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *([F.col("_slot").alias(slot_col)] if slot_col else []))


def op5_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH w(pos, weight) AS (VALUES (0, 5.0::DOUBLE), (1, 2.0::DOUBLE), (2, 1.0::DOUBLE)),
s AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS pos FROM s GROUP BY source),
cap AS (SELECT source, source_size, weight, 3.0::DOUBLE * source_size AS cap FROM src JOIN w USING (pos)),
lev AS (SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap),
tgt AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM lev WHERE level * weight <= cap)) AS target FROM lev),
cut0 AS (SELECT *, least(source_size, greatest({FEWEST}, ceil(source_size / {BLOCK}.0)))::BIGINT AS b0 FROM tgt WHERE source_size > 0),
cut1 AS (SELECT source, source_size, target, b0 - CASE WHEN b0 % {STRIDE} = 0 THEN 1 ELSE 0 END AS blocks FROM cut0),
needs AS (SELECT *, round(target * blocks / source_size)::BIGINT AS need, source_size // blocks AS short, source_size % blocks AS longer FROM cut1),
stretch AS (SELECT *, floor((sum(need) OVER o - need)::DOUBLE / sum(need) OVER () * {POINTS})::BIGINT AS low,
    floor((sum(need) OVER o)::DOUBLE / sum(need) OVER () * {POINTS})::BIGINT AS high
  FROM needs WHERE need > 0 WINDOW o AS (ORDER BY source NULLS LAST)),
slots AS (SELECT slot, (slot % {POINTS} * {STEP}) % {POINTS} AS point FROM (SELECT unnest(range(2 * (SELECT sum(need) FROM needs)::BIGINT)) AS slot)),
ranked AS (SELECT source, blocks, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
  FROM slots JOIN stretch ON point >= low AND point < high),
uses AS (SELECT source, (r % blocks * {STRIDE} + {STEP}) % blocks AS block, count(*) AS uses FROM ranked WHERE r < need AND r // blocks < {MOST} GROUP BY ALL),
located AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start FROM s WHERE size > 0),
ends AS (SELECT n.source, n.blocks, unnest(range(n.blocks)) AS block, n.short, n.longer FROM needs n),
bounds AS (SELECT source, block, block * short + least(block, longer) AS a, (block + 1) * short + least(block + 1, longer) AS b FROM ends),
taken AS (SELECT doc_id, sum((least(l.start + l.size, bounds.b) - greatest(l.start, bounds.a)) * uses)::BIGINT AS taken
  FROM located l JOIN bounds ON bounds.source IS NOT DISTINCT FROM l.source AND bounds.a < l.start + l.size AND bounds.b > l.start
  JOIN uses ON uses.source IS NOT DISTINCT FROM l.source AND uses.block = bounds.block GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(taken.taken, 0) AS taken
FROM s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (doc_id)
"""
