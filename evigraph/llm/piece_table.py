"""Fill-in-middle transformation with a piece table (operator 13).

A document is a list of descriptors ``(buffer, start, length)`` over buffers that never
change: the bytes of its text and those of the three sentinels.  Cutting splits
descriptors, an arrangement is a permutation of them, the inverse permutation restores the
document, and hashes are fed one descriptor after the other, so that a long text is never
copied for them.  Where a text is cut, and how it is arranged, follows from a hash of its
id alone, so a lost task repeats itself exactly.

Defined cases: NULL text is empty; an empty text, one that contains a sentinel, and a share
of all others stay plain (prefix and middle are NULL then); a NULL id is hashed as an empty
id; rows that repeat an id are cut by the same hash, each over its own text; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read, text_slices

# Sentinels, the share of documents left plain and that of the suffix-first form, in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20

# A cut document is P prefix M middle S suffix; an arrangement lists places of that order.
WHOLE = (PREFIX, MIDDLE, SUFFIX)
ARRANGEMENTS = {"psm": (0, 1, 4, 5, 2, 3), "spm": (4, 5, 0, 1, 2, 3)}

OUTPUT = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
          "pieces array<struct<buffer: int, start: long, length: long>>, output string, output_sha256 string")


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable byte buffers; every operation returns a new table over the same buffers."""

    def __init__(self, buffers: tuple[memoryview, ...], pieces: Iterable[Piece]):
        self.buffers, self.pieces = buffers, tuple(pieces)

    @classmethod
    def of(cls, text: memoryview, *more: bytes) -> "PieceTable":
        """A table of one descriptor, the whole of ``text``; ``more`` are buffers to draw on."""
        return cls((text, *map(memoryview, more)), [Piece(0, 0, len(text))])

    def cut(self, places: Iterable[int]) -> "PieceTable":
        """Split descriptors so that one begins at each place (rising, in bytes of the content).

        Every place makes one more descriptor, which may be empty.
        """
        out, at, rest = [], 0, list(self.pieces)
        for place in places:
            while rest and at + rest[0].length < place:
                out.append(rest.pop(0))
                at += out[-1].length
            buffer, start, length = rest.pop(0)
            out.append(Piece(buffer, start, place - at))
            rest.insert(0, Piece(buffer, start + place - at, length - place + at))
            at = place
        return PieceTable(self.buffers, out + rest)

    def put_before(self, buffers: Iterable[int]) -> "PieceTable":
        """A whole buffer before each descriptor."""
        return PieceTable(self.buffers, [p for b, piece in zip(buffers, self.pieces) for p in (Piece(b, 0, len(self.buffers[b])), piece)])

    def arrange(self, order: tuple[int, ...]) -> "PieceTable":
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def take(self, places: Iterable[int]) -> "PieceTable":
        return self.arrange(tuple(places))

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def content(self) -> bytes:
        return b"".join(self.stream())

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return tuple(out)


def byte_places(raw: np.ndarray, points: list[int]) -> tuple[int, list[int]]:
    """Number of code points of UTF-8 bytes, and the byte where each of ``points`` begins."""
    ahead = (raw & 0xC0) != 0x80
    n = int(np.count_nonzero(ahead))
    if n == len(raw):
        return n, points
    starts = np.append(np.flatnonzero(ahead), len(raw))
    return n, [int(starts[p]) for p in points]


def draw(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that belong to an id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def cut_document(doc_id: int | None, text: memoryview) -> tuple[int, str, int | None, int | None, PieceTable]:
    """``n, form, prefix_chars, middle_chars`` and the arranged table of one document."""
    h1, h2, h3, h4 = draw(doc_id)
    raw = np.frombuffer(text, np.uint8)
    table = PieceTable.of(text, *(s.encode() for s in WHOLE))
    n = int(np.count_nonzero((raw & 0xC0) != 0x80))
    if not n or h3 % 100 >= PLAIN_FROM or any(s.encode() in bytes(text) for s in WHOLE):
        return n, "plain", None, None, table
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"
    table = table.cut(byte_places(raw, [low, high])[1]).put_before((1, 2, 3)).arrange(ARRANGEMENTS[form])
    return n, form, low, high - low, table


def restore_document(form: str, output: memoryview) -> PieceTable:
    """The document behind an output: its descriptors are cut at the sentinels and put back in order."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order, raw, places, at = ARRANGEMENTS[form], bytes(output), [], 0
    for sentinel in [WHOLE[i // 2].encode() for i in order if i % 2 == 0]:
        at = raw.index(sentinel, at)
        places += [at, at + len(sentinel)]
        at = places[-1]
    # The first descriptor is the empty one before the first sentinel.
    parts = table.cut(places).take(range(1, len(order) + 1))
    return parts.arrange(inverse(order)).take((1, 3, 5))


def _buffers(texts: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text in the batch's own buffer; NULL is empty."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    for known, a, b in zip(texts.is_valid().to_pylist(), at.tolist(), at[1:].tolist()):
        yield raw[a:b] if known else raw[:0]


def _transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
    for batch in text_slices(batches):
        ids = batch.column("doc_id")
        rows = [cut_document(i, t) for i, t in zip(ids.to_pylist(), _buffers(batch.column("text")))]
        n, form, prefix, middle, tables = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
             pa.array([[p._asdict() for p in t.pieces] for t in tables], pa.list_(piece)),
             pa.array([t.content() for t in tables], pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in tables], pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``OUTPUT`` of every row: the training text, its descriptors (bytes), and its hash.

    Buffer 0 of a descriptor is the text, 1 to 3 are the sentinels of ``WHOLE``.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_transform, OUTPUT)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``restored_sha256`` of the document rebuilt from ``form`` and ``output`` alone."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "output"):
            pairs = zip(batch.column("form").to_pylist(), _buffers(batch.column("output")))
            found = pa.array([restore_document(f, t).sha256() for f, t in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "restored_sha256"])

    return outputs.mapInArrow(run, StructType(list(outputs.schema.fields)).add("restored_sha256", "string"))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transform(read(spark, sf_dir, "documents"))
    rows = restore(out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
    WHEN h4 % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
