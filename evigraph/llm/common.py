"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch_folder

# White space of every contract here: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
# Bytes of text worked on at once inside a task, whatever the size of the Arrow batch.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The copy cuts the lineage (a lost executor never replays what is behind it), has
    real size statistics, and is removed when the application ends.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def bucket(col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; NULL ids fall into bucket -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % divisor, F.lit(-1))


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at, n = 0, len(size)
        while at < n:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def compact(texts: pa.Array) -> pa.Array:
    """The texts with NULL as empty, in buffers of their own.

    Casting a slice to large strings leaves an offset that string kernels misread, so the
    rows are copied first.
    """
    return pc.fill_null(texts, "").take(pa.array(np.arange(len(texts)))).cast(pa.large_string())


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and for each word the index of its text.

    Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; NULL has none.
    """
    texts = compact(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(words, "")
    keep = full.to_numpy(zero_copy_only=False)
    if keep.all():
        return words, owner
    return words.filter(full), owner[keep]


# Tabulation hashing: a random number for each byte at each of the first places of a word.
_PLACES = 48
_RANDOM = np.random.default_rng(2024).integers(0, 2**64, size=(_PLACES + 1, 256), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (large strings without NULL), by array operations.

    Words longer than the table are hashed one by one.
    """
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(at)
    if not len(size):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], size)
    values = _RANDOM[np.minimum(place, _PLACES), raw]
    sums = np.cumsum(values, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), sums])
    h = mixed(total[at[1:] - at[0]] - total[at[:-1] - at[0]] + size.astype(np.uint64) * _RANDOM[_PLACES, 0])
    for i in np.flatnonzero(size > _PLACES):
        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] - at[0]:at[i + 1] - at[0]].tobytes())
    return h


def row_key(*cols: str) -> Column:
    """64-bit key of a row's id and text, for finding the row again; NULL is a value."""
    return F.xxhash64(*[F.col(c) for c in cols])
