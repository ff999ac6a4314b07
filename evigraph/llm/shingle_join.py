"""N-gram Jaccard join by T-occurrence search (operator 9).

Two texts link if their sets of five-word shingles have a Jaccard similarity of 0.8 or
more.  A set of ``n`` shingles then shares at least ``T = ceil(0.8 n)`` with any partner.

1. Texts become sets of 64-bit shingle hashes.  Equal sets are one *class*; only its
   representative goes on.
2. First filter.  Two linked sets share ``slack`` of their first ``n - T + slack`` hashes (in
   hash order).  These beginnings, about a third of all hashes, are listed by ranges of
   the hash; each batch of documents sends a hash once, however many of them hold it.  A
   set whose beginning holds fewer than ``slack`` shared hashes cannot link and leaves.
3. Second filter.  The whole sets of the rest are listed, so every hash has its number of
   sets.  A set with fewer than ``T`` shared hashes leaves.  Linked sets have one of their
   ``n - T + 1`` rarest hashes in common, so the rest falls apart into *blocks* connected by
   those; passages that many texts share are not rare and connect nothing.
4. Search.  The sets of a block come together.  Every set queries the block's inverted
   lists with DivideSkip: its longest lists are set aside, the short ones are merged,
   sets that occur ``T`` minus the number of long lists times are looked up in the long
   lists by binary search, and those that reach the overlap are linked.  Sets already
   known to be connected to the query need no lookup.
5. A block with more than ``WEIGHT`` hashes is cut into chunks by a hash of the node.  Chunks
   are searched, then one set of each connected part of every chunk, and last all sets
   outside the block's largest part against all chunks, in groups of at most two chunks.
   Together these see every pair that is not yet connected.

Links are returned as edges to the smallest connected node, never as all pairs.

Defined cases: NULL and empty texts, and texts without words, have an empty set, link with
nothing and are their own component; texts of one to four words have one shingle; the
smallest id of a component ignores NULL ids; rows that repeat id and text are in one
class; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, read, row_key, split_words, stored, text_slices, word_hashes
from .links import components

WORDS = 5
# Similarity in hundredths; shared hashes asked of two beginnings, as a part of the set.
SIMILAR = 80
SLACK = 0.1
# Hashes in a chunk; DivideSkip's weight of a lookup in a long list against merging.
WEIGHT = 1 << 20
MU = 0.02

_FACTORS = np.random.default_rng(97).integers(1, 2**63, size=WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SET_SCHEMA = "node long, doc_id long, n long, class binary, short long"


def needed(n: int, similar: int = SIMILAR) -> int:
    """Shingles that a set of ``n`` shares with any partner."""
    return -(-similar * n // 100)


def slack(n: int) -> int:
    return 1 + int(SLACK * n)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    n = len(texts)
    words, owner = split_words(texts)
    coded = words.dictionary_encode()
    spelled = word_hashes(coded.dictionary)
    h = spelled[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    if len(h) >= WORDS:
        grams = np.zeros(len(h) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            grams += h[k:len(h) - WORDS + 1 + k] * _FACTORS[k]
        grams = mixed(grams)
    out = []
    for start, c in zip(first.tolist(), count.tolist()):
        if c >= WORDS:
            out.append(np.unique(grams[start:start + c - WORDS + 1]))
        elif c:
            whole = np.append(h[start:start + c], np.uint64(c)) * np.append(_FACTORS[:c], _FACTORS[WORDS])
            out.append(mixed(whole.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(hashes: np.ndarray) -> bytes | None:
    """Identity of a set: 128 bits of a digest of its sorted hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, limit=8 << 20):
        sets = shingle_sets(batch.column("text"))
        digests = [_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
             pa.array([_short(d) if d else None for d in digests], pa.int64())], names=["node", "doc_id", "n", "class", "short"])


# -- first filter: shared hashes of the beginnings

BEGIN_SCHEMA = "range int, ids binary, owner binary, hashes binary, several binary, certain binary, times binary"


def _beginnings(ranges: int):
    """Beginnings of the distinct sets of a slice, by range of the hash; every hash goes on once.

    ``ids`` of the sets (their digests' first half), and for each hash its ``owner`` among
    them and whether ``several`` sets of the slice have it.  The sets beside the owner share
    it for certain: they are counted here and sent as ``certain`` ids and how many ``times``,
    to the range of the id, so that near copies are dealt out like everything else.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=8 << 20):
            once = {_short(_digest(s)): s for s in shingle_sets(batch.column("text")) if len(s)}
            if not once:
                continue
            ids = np.fromiter(once, np.int64, len(once))
            begin = [s[: len(s) - needed(len(s)) + slack(len(s))] for s in once.values()]
            flat = np.concatenate(begin)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(b) for b in begin])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            new = np.r_[True, flat[1:] != flat[:-1]]
            several = np.r_[~new[1:], False][new]
            # Sorted as unsigned numbers, so the ids of a range are side by side.
            certain, times = np.unique(ids[owner[~new]].view(np.uint64), return_counts=True)
            flat, owner = flat[new], owner[new]
            ends = np.searchsorted(_range_of(flat, ranges), np.arange(ranges + 1))
            stops = np.searchsorted(_range_of(certain, ranges), np.arange(ranges + 1))
            rows = []
            for r in range(ranges):
                cut, sure = slice(ends[r], ends[r + 1]), slice(stops[r], stops[r + 1])
                if ends[r] < ends[r + 1] or stops[r] < stops[r + 1]:
                    held, place = np.unique(owner[cut], return_inverse=True)
                    rows.append((r, ids[held].tobytes(), place.astype("<u4").tobytes(), flat[cut].tobytes(), several[cut].tobytes(),
                                 certain[sure].tobytes(), times[sure].astype("<u4").tobytes()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                names=["range", "ids", "owner", "hashes", "several", "certain", "times"])
    return run


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _rows(batch: pa.RecordBatch, *columns: str):
    return zip(*[batch.column(c).to_pylist() for c in columns])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, shared`` over the ranges of one task: how many of a set's hashes other sets have too."""
    ids, hashes, several, found, times = [], [], [], [], []
    for batch in batches:
        for i, o, h, s, c, t in _rows(batch, "ids", "owner", "hashes", "several", "certain", "times"):
            ids.append(np.frombuffer(i, np.int64)[np.frombuffer(o, "<u4")])
            hashes.append(np.frombuffer(h, np.uint64))
            several.append(np.frombuffer(s, bool))
            found.append(np.frombuffer(c, np.int64))
            times.append(np.frombuffer(t, "<u4"))
    if not ids:
        return
    i, h, s = np.concatenate(ids), np.concatenate(hashes), np.concatenate(several)
    if len(h):
        order = np.lexsort((i, h))
        i, h, s = i[order], h[order], s[order]
        head = np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1])]  # one set, sent by two batches, is one
        s = np.logical_or.reduceat(s, np.flatnonzero(head))
        i, h = i[head], h[head]
        same = h[1:] == h[:-1]
        found.append(i[np.r_[False, same] | np.r_[same, False] | s])
        times.append(np.ones(len(found[-1]), "<u4"))
    unique, place = np.unique(np.concatenate(found), return_inverse=True)
    count = np.bincount(place, np.concatenate(times), len(unique)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(count)], names=["id", "shared"])


# Id ranges that the counts of one task are cut into; a fixed number, so that rows grow with the tasks alone.
COUNT_PARTS = 64
COUNT_HELD = 1 << 22  # counts a task holds before it adds up those of one id


def _packed_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, ids, counts``: what :func:`_shared` finds, one row per range of the id."""
    for batch in _shared(batches):
        ids, count = (batch.column(c).to_numpy() for c in ("id", "shared"))
        part = _range_of(ids.view(np.uint64), COUNT_PARTS).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ids, count = ids[order], count[order]
        ends = np.cumsum(np.bincount(part, minlength=COUNT_PARTS))
        cuts = [(p, a, b) for p, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)) if a < b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _, _ in cuts], pa.int32()), pa.array([ids[a:b].tobytes() for _, a, b in cuts], pa.binary()),
             pa.array([count[a:b].tobytes() for _, a, b in cuts], pa.binary())], names=["part", "ids", "counts"])


def _added(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(np.concatenate(ids), return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts), len(unique)).astype(np.int64)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, shared``: the counts of every id added up; all of an id are in one task, which holds each id once."""
    ids, counts, held = [], [], 0
    for batch in batches:
        for i, c in _rows(batch, "ids", "counts"):
            ids.append(np.frombuffer(i, np.int64))
            counts.append(np.frombuffer(c, np.int64))
            held += len(ids[-1])
            if held >= COUNT_HELD:
                one = _added(ids, counts)
                ids, counts = [one[0]], [one[1]]
                held = 0
    if ids:
        unique, total = _added(ids, counts)
        yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(total)], names=["id", "shared"])


# -- second filter: numbers of sets of all hashes

WHOLE_SCHEMA = "batch long, nodes binary, sizes binary, hashes binary"


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets, one row for a slice of texts: its nodes, the sizes of their sets, and the sets on end.

    A row of another text with the same 64-bit key is not the one meant and is left out.
    """
    batch_id = TaskContext.get().partitionId() << 32
    for batch in text_slices(batches):
        sets = shingle_sets(batch.column("text"))
        rows = [(n, s) for n, s, c in zip(batch.column("node").to_pylist(), sets, batch.column("class").to_pylist()) if _digest(s) == c]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch_id]), pa.array([np.array([n for n, _ in rows], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([len(s) for _, s in rows], np.int32).tobytes()], pa.binary()),
                 pa.array([np.concatenate([s for _, s in rows]).tobytes()], pa.binary())], names=["batch", "nodes", "sizes", "hashes"])
            batch_id += 1


def _by_range(ranges: int):
    """``range, batch, hashes``: the hashes of a slice that lie in a range, in the order of its sets."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in _rows(batch, "batch", "hashes"):
                h = np.frombuffer(raw, np.uint64)
                part = _range_of(h, ranges)
                h = h[np.argsort(part, kind="stable")]
                ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=ranges))
                cuts = [h[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(ranges), pa.int32()), pa.array([key] * ranges, pa.int64()), pa.array(cuts, pa.binary())], names=["range", "batch", "hashes"])
    return run


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batch, range, often``: for each hash one byte, the number of sets that have it (255: or more)."""
    rows = [r for batch in batches for r in _rows(batch, "batch", "range", "hashes")]
    if not rows:
        return
    _, place, count = np.unique(np.frombuffer(b"".join(r[2] for r in rows), np.uint64), return_inverse=True, return_counts=True)
    often = np.minimum(count, 255).astype(np.uint8)[place].tobytes()
    ends = np.cumsum([0, *[len(r[2]) // 8 for r in rows]])
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([often[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["batch", "range", "often"])


def _rarest(ranges: int):
    """``node, hashes``: of sets with enough shared hashes, the shared ones among the ``n - T + 1`` rarest."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sizes, raw, answer in _rows(batch, "nodes", "sizes", "hashes", "often"):
                h = np.frombuffer(raw, np.uint64)
                f = np.empty(len(h), np.uint8)
                f[np.argsort(_range_of(h, ranges), kind="stable")] = np.frombuffer(answer, np.uint8)
                kept, lists, at = [], [], 0
                for node, n in zip(np.frombuffer(nodes, np.int64).tolist(), np.frombuffer(sizes, np.int32).tolist()):
                    own, often, t = h[at:at + n], f[at:at + n], needed(n)
                    at += n
                    if np.count_nonzero(often > 1) >= t:
                        rare = np.lexsort((own, often))[: n - t + 1]
                        kept.append(node)
                        lists.append(own[rare[often[rare] > 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["node", "hashes"])
    return run


def _single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, hashes``: one row per set."""
    for batch in batches:
        for nodes, sizes, raw in _rows(batch, "nodes", "sizes", "hashes"):
            ends = 8 * np.cumsum(np.r_[0, np.frombuffer(sizes, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes, np.int64)), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                                             names=["node", "hashes"])


# -- search

class Search:
    """Inverted lists over some sets, searched with DivideSkip.

    Sets can be dropped; the lists are packed anew whenever half of their entries are gone,
    so that dropping costs no more than building.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.doc = doc[order]
        self.hash, self.start, self.length = np.unique(flat[order], return_index=True, return_counts=True)
        self.alive, self.gone = np.ones(len(sets), bool), 0

    def drop(self, ids: np.ndarray) -> None:
        """Leave out some sets from now on."""
        self.alive[ids] = False
        self.gone += int(self.sizes[ids].sum())
        if len(self.doc) and 2 * self.gone >= len(self.doc):
            keep = self.alive[self.doc]
            length = np.add.reduceat(keep, self.start, dtype=np.int64)
            self.doc, self.hash, self.length = self.doc[keep], self.hash[length > 0], length[length > 0]
            self.start, self.gone = np.cumsum(self.length) - self.length, 0

    def linked(self, query: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
        """Sets similar to the query, dropped ones left out."""
        n = len(query)
        if not len(self.hash):
            return np.zeros(0, np.int64)
        t = needed(n, similar)
        at = np.minimum(np.searchsorted(self.hash, query), len(self.hash) - 1)
        at = at[self.hash[at] == query]
        if len(at) < t:
            return np.zeros(0, np.int64)
        length = self.length[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        set_aside = min(t - 1, int(t / (MU * np.log2(longest + 1) + 1)))
        short, long_ = at[: len(at) - set_aside], at[len(at) - set_aside:]
        # Merging the short lists: sorted runs become one sorted sequence, equal ids side by side.
        size = self.length[short]
        places = np.repeat(self.start[short] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        merged = np.sort(self.doc[places], kind="stable")
        ids, hits = np.unique(merged, return_counts=True)
        fits = (hits >= t - set_aside) & (self.sizes[ids] * 100 >= similar * n) & (self.sizes[ids] * similar <= 100 * n)
        fits &= self.alive[ids]
        ids, hits = ids[fits], hits[fits]
        left = set_aside
        for k in long_:  # binary probes, dropping documents that can no longer get there
            if not len(ids):
                break
            run = self.doc[self.start[k]:self.start[k] + self.length[k]]
            place = np.minimum(np.searchsorted(run, ids), len(run) - 1)
            hits = hits + (run[place] == ids)
            left -= 1
            able = hits + left >= t
            if not able.all():
                ids, hits = ids[able], hits[able]
        return ids[100 * hits >= similar * (n + self.sizes[ids] - hits)]


def _connect(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges ``node, smallest connected node`` of one group; with two sides only pairs across them are searched.

    Connected parts are walked one after the other.  A set is dropped from the lists when
    it is reached, so every set is found once and asks once, and a group of copies costs
    one search that finds them all and many that find nothing left.
    """
    members = [np.flatnonzero(side == x) for x in np.unique(side)]
    searches = [Search([sets[i] for i in m]) for m in members]
    home = np.searchsorted(np.unique(side), side)
    place = np.empty(len(node), np.int64)
    for m in members:
        place[m] = np.arange(len(m))
    part = np.full(len(node), -1)
    for first in members[0].tolist():
        if part[first] >= 0:
            continue
        part[first] = first
        searches[home[first]].drop(place[[first]])
        ahead = [first]
        while ahead:
            i = ahead.pop()
            other = len(members) - 1 - home[i]
            found = searches[other].linked(sets[i])
            searches[other].drop(found)
            found = members[other][found]
            part[found] = first
            ahead += found.tolist()
    reached = np.flatnonzero(part >= 0)
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, part[reached], node[reached])
    return [(int(node[i]), int(least[part[i]])) for i in reached if node[i] != least[part[i]]]


def _search_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of all groups of rows sorted by ``g1, g2, g3``; a group has at most about two chunks."""
    group, rows = None, {}

    def done():
        out = _connect(np.array([n for n, _ in rows]), np.array([s for _, s in rows]), list(rows.values())) if len(rows) > 1 else []
        columns = list(zip(*out)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "root"])

    for batch in text_slices(batches, "hashes"):
        keys = zip(*[batch.column(c).to_pylist() for c in ("g1", "g2", "g3")])
        for key, node, side, raw in zip(keys, *[batch.column(c).to_pylist() for c in ("node", "side", "hashes")]):
            if key != group:
                if rows:
                    yield done()
                group, rows = key, {}
            rows.setdefault((node, side), np.frombuffer(raw, np.uint64))
    if rows:
        yield done()


def _search(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Edges from searching the groups of ``node, g1, g2, g3, side``."""
    full = rows.join(whole, "node").select("g1", "g2", "g3", "side", "node", "hashes")
    full = full.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "node")
    return stored(full.mapInArrow(_search_groups, "node long, root long"), "found")


def _least_slack(n: Column, similar: int = SIMILAR) -> Column:
    """The slack of the smallest partner that a set of ``n`` can have."""
    return 1 + F.floor(SLACK * F.ceil(n * similar / 100))


# About so many hashes lie in a range; a task that counts them holds one range.
RANGE_HASHES = 1 << 21


def _ranges(classes: DataFrame) -> int:
    """As many ranges as the hashes of all sets need, and no fewer than the session's partitions."""
    hashes = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashes // RANGE_HASHES))


def candidate_blocks(texts: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, hashes`` of the sets that pass the first filter, and ``node, block`` of those that pass both."""
    ranges = _ranges(classes)
    dealt = texts.select("text").mapInArrow(_beginnings(ranges), BEGIN_SCHEMA).repartition(ranges, "range")
    counts = dealt.mapInArrow(_packed_counts, "part int, ids binary, counts binary").repartition("part")
    shared = stored(counts.mapInArrow(_summed, "id long, shared long"), "shared")
    able = classes.withColumnRenamed("short", "id").join(shared, "id").filter(F.col("shared") >= _least_slack(F.col("n")))
    able = stored(able.select("node", "class"), "able")
    # Merged at every size: whether the nodes happen to be few enough to broadcast must not change the plan.
    whole = texts.join(able.hint("merge"), "node").select("node", "class", "text").mapInArrow(_whole, WHOLE_SCHEMA)
    whole = stored(whole, "whole")
    cut = whole.select("batch", "hashes").mapInArrow(_by_range(ranges), "range int, batch long, hashes binary").repartition(ranges, "range")
    often = cut.mapInArrow(_frequencies, "batch long, range int, often binary")
    often = often.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("range", "often"))).alias("o"))  # a row per range
    often = often.select("batch", F.unhex(F.array_join(F.transform("o", lambda x: F.hex(x["often"])), "")).alias("often"))
    rare = whole.join(often, "batch").select("nodes", "sizes", "hashes", "often").mapInArrow(_rarest(ranges), "node long, hashes array<long>")
    rare = stored(rare, "rare")
    lists = rare.select("node", F.explode("hashes").alias("hash"))
    first = stored(lists.groupBy("hash").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").drop("last"), "first")
    pairs = lists.join(first, "hash").filter("node <> first").select("node", "first")
    blocks = components(pairs, "node", "first").select(F.col("id").alias("node"), F.col("component_id").alias("block"))
    return whole.select("nodes", "sizes", "hashes").mapInArrow(_single, "node long, hashes binary"), blocks


def class_links(texts: DataFrame, classes: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Edges ``node, root`` between representatives; ``texts`` has ``node, text``, ``classes`` ``class, node, n``."""
    whole, blocks = candidate_blocks(texts, classes)
    members = stored(blocks.join(classes.select("node", "n"), "node"), "members")
    chunks = members.groupBy("block").agg(F.ceil(F.sum("n") / weight).cast("long").alias("chunks"))
    members = stored(members.join(stored(chunks, "chunks"), "block"), "members")
    chunk, zero, one_side = F.pmod(F.xxhash64("node"), "chunks"), F.lit(0).cast("long"), F.lit(0).alias("side")
    found = _search(members.select("node", F.col("block").alias("g1"), chunk.alias("g2"), zero.alias("g3"), one_side), whole)
    large = members.filter("chunks > 1")
    if large.isEmpty():
        return found
    # One set of each connected part of every chunk, chunked anew.
    heads = stored(large.join(found, "node", "left").filter("root IS NULL").select("node", "block", "n"), "heads")
    again = heads.groupBy("block").agg(F.ceil(F.sum("n") / weight).cast("long").alias("chunks"))
    heads = heads.join(again, "block").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), "chunks"))
    second = _search(heads.select("node", F.col("block").alias("g1"), F.col("chunk").alias("g2"), zero.alias("g3"), one_side), whole)
    found = stored(found.unionByName(second), "found")
    # All sets outside the largest part, in runs of queries, against every chunk.
    parts = components(found, "node", "root").select(F.col("id").alias("node"), "component_id")
    large = large.join(parts, "node", "left").withColumn("part", F.coalesce("component_id", "node")).drop("component_id")
    large = stored(large, "large")
    size = large.groupBy("block", "part").agg(F.count("*").alias("size"))
    top = size.groupBy("block").agg(F.max(F.struct("size", "part")).alias("t")).select("block", F.col("t.part").alias("top"))
    queries = stored(large.join(top, "block").filter("part <> top").drop("top"), "queries")
    runs = stored(queries.groupBy("block").agg(F.ceil(F.sum("n") / weight).cast("long").alias("runs")), "runs")
    index = large.join(runs, "block").select("node", F.col("block").alias("g1"), chunk.alias("g2"),
                                             F.explode(F.sequence(zero, F.col("runs") - 1)).alias("g3"), F.lit(1).alias("side"))
    asked = queries.join(runs, "block").select("node", F.col("block").alias("g1"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("g2"),
                                               F.pmod(F.xxhash64("node", F.lit(2)), "runs").alias("g3"), one_side)
    third = _search(index.unionByName(asked), whole)
    return stored(found.unionByName(third), "found")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = WEIGHT) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, kept`` of every row; one row of a component is kept.

    Rows that repeat id and text have one ``row_key`` and are kept or not together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("node", row_key("doc_id", "text"))
    sets = stored(rows.mapInArrow(_sets, SET_SCHEMA), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "node", "n", "short"))
    classes = sets.filter("n > 0").groupBy("class").agg(first.alias("f"))
    classes = stored(classes.select("class", "f.node", "f.doc_id", "f.n", "f.short"), "classes")
    links = class_links(rows.select("node", "text"), classes, weight)
    parts = components(links, "node", "root").select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    named = classes.select("class", "node", "doc_id").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = stored(named, "named")
    key = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "node"))
    least = stored(named.groupBy("part").agg(key.alias("k")).select("part", F.col("k.doc_id").alias("component_id"), F.col("k.node").alias("keep")), "least")
    named = stored(named.join(least, "part").select("class", "component_id", "keep"), "named")
    out = sets.join(named, "class", "left")
    alone = F.col("keep").isNull()
    return out.select("doc_id", F.col("node").alias("row_key"), F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce(F.col("keep") == F.col("node"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per component, all columns as they are."""
    stay = similar_groups(docs, id_col, text_col).filter("kept").select(F.col("row_key").alias("_stay_key"))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    return docs.withColumn("_stay_key", key).join(stay, "_stay_key", "left_semi").dropDuplicates(["_stay_key"]).drop("_stay_key")


def op9_shingle_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS MATERIALIZED (SELECT doc_id, g FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (WITH RECURSIVE walk(id, root) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, w.root FROM walk w JOIN l ON l.a = w.id WHERE w.root < l.b)
  SELECT id, min(root) AS root FROM walk GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.root, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.id = w.doc_id
"""
