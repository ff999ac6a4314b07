"""Exact deduplication by content-defined chunk recipes (operator 7).

A text is normalised (every run of ``[\\x20\\x09-\\x0D]`` becomes one space), cut where its own
content says so, and turned into a *recipe*: the ordered list of identifiers of its chunks.
Equal texts have equal recipes, so from there on only recipes move, never texts.  Chunks
are deduplicated first: those of one 64-bit identifier are brought together, and the
identifier is verified if all have the same 128-bit digest and length.  Recipes are then
compared by their identifiers, eight bytes a chunk; where an identifier turns out to be
shared by different chunks, the digests at its places are compared as well.

Defined cases: NULL text counts as empty; an empty text has an empty recipe.  NULL ids sort
last when the smallest id is looked for.  Rows that repeat id and text are told apart by
their place in the stored recipe table, and one of them is kept.  Columns other than the
id and the text are not read, so their names cannot clash.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, row_key, stored, text_slices

# Cut points: one in 2**CUT_BITS positions, chunks of MIN_CHUNK to MAX_CHUNK bytes.
CUT_BITS = 10
MIN_CHUNK = 256
MAX_CHUNK = 8192
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_DIGEST = struct.Struct(">qq")

RECIPE_SCHEMA = ("part long, row long, doc_id long, row_key long, text_sha256 string, ids binary, "
                 "chunks array<struct<id:bigint,high:bigint,low:bigint,n_bytes:bigint>>")


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with white-space runs replaced by one space."""
    raw = (text or "").encode().translate(_SPACES)
    while b"  " in raw:  # each pass halves the longest run
        raw = raw.replace(b"  ", b" ")
    return raw


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``; they depend on the eight bytes before them only."""
    n = len(raw)
    if n <= MIN_CHUNK:
        return [n] if n else []
    window = np.empty(n - 7, dtype=np.uint64)
    for k in range(min(8, n - 7)):
        words = np.frombuffer(raw, "<u8", count=(n - k) // 8, offset=k)
        window[k::8] = words[: len(window[k::8])]
    marks = np.flatnonzero((window * _MIX) >> np.uint64(64 - CUT_BITS) == 0) + 8
    ends, last = [], 0
    for end in [*marks.tolist(), n]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if end - last >= MIN_CHUNK or end == n:
            if end > last:
                ends.append(end)
            last = end
    return ends


def recipe(raw: bytes) -> list[tuple[int, int, int, int]]:
    """The chunks in order: identifier, and what verifies it: digest in two halves and length."""
    out, last = [], 0
    for end in cut_points(raw):
        piece = raw[last:end]
        chunk_id = xxhash.xxh3_64_intdigest(piece) - (1 << 63)
        out.append((chunk_id, *_DIGEST.unpack(hashlib.blake2b(piece, digest_size=16).digest()), end - last))
        last = end
    return out


def _recipes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in text_slices(batches):
        raws = [normalise(t) for t in batch.column("text").to_pylist()]
        n, made = len(raws), [recipe(r) for r in raws]
        flat = np.array([c for chunks in made for c in chunks], np.int64).reshape(-1, 4)
        ends = np.cumsum([0, *map(len, made)])
        ids = np.ascontiguousarray(flat[:, 0]).tobytes()
        chunks = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], names=["id", "high", "low", "n_bytes"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"),
             batch.column("row_key"), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()),
             pa.array([ids[8 * a:8 * b] for a, b in zip(ends, ends[1:])], pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)],
            names=["part", "row", "doc_id", "row_key", "text_sha256", "ids", "chunks"])
        row += n


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One recipe per row, stored: ``part, row`` name the row, ``row_key`` finds it again."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.withColumn("row_key", row_key("doc_id", "text")).mapInArrow(_recipes, RECIPE_SCHEMA), "recipes")


def chunk_store(recipe_table: DataFrame) -> DataFrame:
    """The distinct chunks of a corpus: ``chunk_id``, verifying ``digest``, ``n_bytes``, ``uses``."""
    digest = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("high", "low")])
    return recipe_table.select(F.inline("chunks")).groupBy("id", "high", "low", "n_bytes").agg(F.count("*").alias("uses")).select(
        F.col("id").alias("chunk_id"), digest.alias("digest"), "n_bytes", "uses")


def verified(recipe_table: DataFrame) -> DataFrame:
    """The recipes as ``ids`` and ``extra``: equal in both if and only if all chunks are equal.

    Chunks meet by identifier, counted inside tasks first, so a passage that fills the corpus
    sends one row per task.  ``extra`` holds position and digest of the places whose identifier
    names more than one chunk; such identifiers are about one in 2^64 pairs, and any number
    of them is right.
    """
    parts = ("high", "low", "n_bytes")
    ids = recipe_table.select(F.inline("chunks")).groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in parts for f in (F.min, F.max)])
    shared = stored(ids.filter(" OR ".join(f"min_{c} <> max_{c}" for c in parts)).select("id"), "shared-ids")
    chunks = recipe_table.select("part", "row", F.posexplode("chunks").alias("pos", "c")).select("part", "row", "pos", "c.*")
    places = chunks.join(shared, "id", "left_semi").groupBy("part", "row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", *parts))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("pos", *parts)])), " ").alias("extra"))
    return recipe_table.drop("chunks").join(stored(places, "shared-places"), ["part", "row"], "left").withColumn("extra", F.coalesce("extra", F.lit("")))


def grouped(recipe_table: DataFrame) -> DataFrame:
    """``doc_id, row_key, keep_id, group_size, kept, text_sha256`` for every row of a stored recipe table.

    Ordered identifier lists are compared by grouping on them; groups are counted inside
    each task first, so a text that fills a third of the table sends one row per task.
    Groups of one row need nothing, so only larger ones are joined back, from a stored
    table, which lets Spark split the rows of a large group over tasks.
    """
    table = verified(recipe_table)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "part", "row"))
    groups = table.groupBy("ids", "extra").agg(first.alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = stored(groups, "groups")
    out = table.join(groups, ["ids", "extra"], "left")
    alone = F.col("group_size").isNull()
    own = (F.col("keep.part") == F.col("part")) & (F.col("keep.row") == F.col("row"))
    return out.select(
        "doc_id", "row_key", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(own, alone).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Recipes of all rows, grouped."""
    return grouped(recipes(docs, id_col, text_col))


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are.

    Of rows that repeat id and text one stays; which, if they differ in other columns, is not defined.
    """
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("row_key").alias("_stay_key"))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    keyed = docs.withColumn("_stay_key", key).join(stay, "_stay_key", "left_semi")
    return keyed.dropDuplicates(["_stay_key"]).drop("_stay_key")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("row_key")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
