"""Packing by concatenate and cut (operator 8).

All documents are one stream of token ids, each document followed by ``END``; windows of
``WINDOW`` tokens are cut from it, so only the very last sequence is not full.  Where a
document begins in the stream comes from two passes of prefix sums: while tokenising, each
task counts the tokens before every row of its own partition; the totals of the
partitions, one row each, are then summed up to give every partition its offset.  Ids are
stored once (two bytes each where the vocabulary allows) and cut in a second pass, row by
row; a document that crosses a window border leaves one boundary record per window.

Defined cases: NULL text is empty and yields ``END`` alone; rows with NULL or repeated ids
are packed like any other; other columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored, text_slices

WINDOW = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
# Words after which a worker begins to forget older ones; only speed depends on it.
REMEMBERED = 250_000

TOKEN_SCHEMA = "part long, row long, before long, doc_id long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Encoder:
    """Token ids of whole texts; words seen before are not encoded again.

    Byte-level pair encoding never merges across a space that stands before a word, so a
    text whose spaces all stand before words falls apart into words that can be encoded
    on their own, and many words can be encoded as one text: every token that begins with
    a space begins a word.  Any other text is encoded whole.
    """

    _loose = re.compile(r" (?:\s|\Z)")
    _space = "\u0120"  # how byte-level vocabularies write a space
    _marks = ".,;:!?"
    # The other bytes: printable ones of Latin-1 stand for themselves, the rest, in order, for 256 and up.
    _bytes = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)], map(chr, range(256, 512))))

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.by_word = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.begins = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.begins[i] = token.startswith(self._space)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.tails: dict[str, bytes] = {"": b""}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _plain(self, word: str) -> bytes | None:
        """Ids of letters with closing marks after a space: the letters are one piece, the marks another."""
        core = word.rstrip(self._marks)
        if not core.isalpha():
            return None
        tail = word[len(core):]
        if tail not in self.tails:
            self.tails[tail] = self._ids(tail).tobytes()
        piece = core if core.isascii() else core.encode().decode("latin-1").translate(self._bytes)
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(self._space + piece)]).tobytes() + self.tails[tail]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that each follow a space."""
        out = [self.new.get(w) or self.old.get(w) or self._plain(w) for w in words]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(missing), 20_000):
            part = missing[at:at + 20_000]
            ids = self._ids("".join([" " + words[i] for i in part]))
            ends = np.r_[np.flatnonzero(self.begins[ids]), len(ids)] * self.dtype.itemsize
            raw = ids.tobytes()
            for i, a, b in zip(part, ends.tolist(), ends[1:].tolist()):
                out[i] = raw[a:b]
        if len(self.new) > REMEMBERED:  # the words of the last while stay known
            self.old, self.new = self.new, {}
        self.new.update(zip(words, out))
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if t and self.by_word and t[0] != " " and not self._loose.search(t) and not any(s in t for s in self.special)]
        out: list[np.ndarray | None] = [None] * len(texts)
        if plain:
            for i, ids in zip(plain, self._split([texts[i] for i in plain])):
                out[i] = ids
        return [np.append(self._ids(t), self.dtype.type(END)) if ids is None else ids for t, ids in zip(texts, out)]

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The first word of a text follows no space; the end is a word of its own.
        first = np.cumsum(count) - count
        openers, place = np.unique(code[first], return_inverse=True)
        known = [*self._words(words), *[self._ids(words[i]).tobytes() for i in openers], np.array([END], self.dtype).tobytes()]
        code[first] = len(words) + place
        code = np.insert(code, np.cumsum(count), len(known) - 1)
        size = np.array([len(k) for k in known]) // self.dtype.itemsize
        start = np.cumsum(size) - size
        length = size[code]
        where = np.repeat(start[code] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        ids = np.frombuffer(b"".join(known), self.dtype)[where]
        ends = np.cumsum(length)[np.cumsum(count + 1) - 1]
        return np.split(ids, ends[:-1])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenise(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in text_slices(batches, limit=4 << 20):
            ids = encode([t or "" for t in batch.column("text").to_pylist()])
            n = np.array([len(x) for x in ids], dtype=np.int64)
            starts = before + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part)), pa.array(np.arange(row, row + len(n))), pa.array(starts), batch.column("doc_id"),
                 pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["part", "row", "before", "doc_id", "n", "ids"])
            row += len(n)
            before += int(n.sum())
    return run


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``part, row, before, doc_id, n, ids`` of every row, stored; ``before`` counts inside the partition."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_tokenise(public_tokenizers.path(vocabulary)), TOKEN_SCHEMA), "tokens")


def _cut(window: int, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "ids"):
            rows = []
            for doc, n, start, raw in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n", "start", "ids")]):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    place = start + at
                    length = min(n - at, window - place % window)
                    cut = ids[at:at + length].tobytes()
                    rows.append((doc, at, length, zlib.crc32(cut), n, place // window, place % window, cut if keep_ids else None))
                    at += length
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(columns)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def pack(tokens: DataFrame, window: int = WINDOW, keep_ids: bool = True) -> DataFrame:
    """The pieces of all windows; ``ids`` are unsigned 32-bit little-endian."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # One row of two numbers for each task that read the corpus; stored, so its size is known to the join.
    placed = tokens.join(stored(bases, "bases"), "part")
    rows = placed.select("doc_id", "n", (F.col("base") + F.col("before")).alias("start"), "ids")
    return rows.mapInArrow(_cut(window, keep_ids), PIECE_SCHEMA)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """``sequence_id, n_tokens, ids`` with the ids padded to ``window``; a sequence has at most ``window`` pieces."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("_p"))
    hexed = F.array_join(F.transform("_p", lambda p: F.hex(p["ids"])), "")
    padding = F.lit(int(pad).to_bytes(4, "little").hex().upper())
    return joined.select("sequence_id", "n_tokens", F.unhex(F.rpad(hexed, F.lit(8 * window), padding)).alias("ids"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(tokenise(read(spark, sf_dir, "documents")), keep_ids=False).drop("ids")
