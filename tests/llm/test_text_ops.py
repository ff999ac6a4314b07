"""Exact deduplication, shingle join, packing and mixing against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigraph.llm import exact_dedup, mixing, packing, shingle_join
from evigraph.llm.queries import ORACLES, QUERIES

from .helpers import CLASHING, EDGE, LONG, docs_frame, exact_rows, near_components, normal, same, words


def by_repr(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), sf, ORACLES[name])


def test_exact_groups_edges(spark):
    got = exact_dedup.exact_groups(docs_frame(spark, EDGE)).collect()
    assert by_repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_repr(exact_rows(EDGE))
    for text_hash in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == text_hash) == 1


def test_exact_keep_and_empty(spark):
    docs = docs_frame(spark, EDGE)
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(t) for _, t in EDGE})
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []


def test_shared_identifiers_are_told_apart(spark):
    """Chunks that share an identifier by chance are told apart by digest or length, at their place."""
    a, b, c, d = (7, 1, 1, 300), (7, 1, 2, 300), (9, 5, 5, 20), (7, 1, 1, 301)
    lists = [[a, c], [b, c], [a, c], [c, a], [d, c], [c], [], [b, c], [], [a, b], [b, a]]
    rows = [(i % 3, i, 50 - i, i, str(x), b"".join(e[0].to_bytes(8, "big") for e in x), x) for i, x in enumerate(lists)]
    got = exact_dedup.grouped(spark.createDataFrame(rows, exact_dedup.RECIPE_SCHEMA)).collect()
    want = {(50 - i, 50 - max(j for j, y in enumerate(lists) if y == x), lists.count(x)) for i, x in enumerate(lists)}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == want and len(got) == len(lists)


def test_chunks_follow_content(spark):
    raw = exact_dedup.normalise(LONG)
    ends = exact_dedup.cut_points(raw)
    assert ends[-1] == len(raw) and all(b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
    pieces = lambda r: {r[a:b] for a, b in zip([0, *exact_dedup.cut_points(r)], exact_dedup.cut_points(r))}
    moved = pieces(b"some words in front " + raw)
    assert len(pieces(raw) & moved) > 0.9 * len(pieces(raw))
    store = exact_dedup.chunk_store(exact_dedup.recipes(docs_frame(spark, [(1, LONG), (2, LONG), (3, "x")])))
    rows = store.collect()
    assert sum(r.n_bytes * r.uses for r in rows) == 2 * len(raw) + 1
    # the text repeats itself, so a chunk may be used several times in each of the two documents
    assert len(rows) == len(pieces(raw)) + 1 and sorted(r.uses % 2 for r in rows) == [0] * len(pieces(raw)) + [1]


NEAR = [*EDGE, *[(100 + i, " ".join(f"v{j}" if j % 97 != i else f"u{i}" for j in range(300))) for i in range(40)],
        *[(200 + i, " ".join([*(f"p{j}" for j in range(60)), *(f"q{i}x{j}" for j in range(90))])) for i in range(40)],
        *[(300 + i, " ".join(f"c{j + 2 * i}" for j in range(60))) for i in range(20)]]


@pytest.mark.parametrize("weight", [shingle_join.WEIGHT, 400])
def test_near_components(spark, weight):
    """Near copies, texts that share a passage, and chains; once with blocks cut into many chunks."""
    got = shingle_join.similar_groups(docs_frame(spark, NEAR).repartition(3), weight=weight).collect()
    assert by_repr((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_repr(near_components(NEAR))


def test_near_keep_and_empty(spark):
    docs = docs_frame(spark, NEAR)
    kept = shingle_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for d, n, c in near_components(NEAR) if n}
    assert {r.doc_id for r in kept.filter(F.size(F.split(F.trim("text"), r"\s+")) > 0).collect() if words(r.text)} == want
    assert shingle_join.similar_groups(docs.limit(0)).collect() == []


def test_beginnings_of_near_copies_are_dealt_out():
    """Near copies in one slice: no range gets more than its share, and the counts are those of counting."""
    texts = [" ".join(f"v{j}" if j % 97 != i else f"u{i}" for j in range(300)) for i in range(90)]
    ranges = 8
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = [r for b in shingle_join._beginnings(ranges)([batch]) for r in b.to_pylist()]
    sent = {k: sum(len(v) for r in rows if r["range"] == k for v in r.values() if isinstance(v, bytes)) for k in range(ranges)}
    assert max(sent.values()) < 3 * sum(sent.values()) / ranges
    schema = pa.schema([("range", pa.int32()), *[(c, pa.binary()) for c in rows[0] if c != "range"]])
    got = Counter()
    for k in range(ranges):
        for b in shingle_join._shared([pa.RecordBatch.from_pylist([r for r in rows if r["range"] == k], schema)]):
            got.update(dict(zip(b.column("id").to_pylist(), b.column("shared").to_pylist())))
    sets = shingle_join.shingle_sets(pa.array(texts))
    begin = {shingle_join._short(shingle_join._digest(s)): s[: len(s) - shingle_join.needed(len(s)) + shingle_join.slack(len(s))].tolist() for s in sets}
    often = Counter(h for b in begin.values() for h in b)
    assert got == Counter({i: n for i, b in begin.items() if (n := sum(often[h] > 1 for h in b))})


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2000, size=(12, 120))
    sets = [np.unique(np.where(rng.random(120) < 0.08, rng.integers(0, 2000, 120), base[i % 12])).astype(np.uint64) for i in range(120)]
    search = shingle_join.Search(sets)
    for s in sets:
        want = {i for i, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o))}
        assert set(search.linked(s).tolist()) == want


def test_packing_edges(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*EDGE, (20, "x" * 5000), (21, "a\n\n b \n c"), (22, "  lead"), (23, "tail  "), (24, "it's  we'll 123 45!")]
    tokens = packing.tokenise(docs_frame(spark, rows).repartition(3))
    pieces = packing.pack(tokens)
    got = pieces.collect()
    texts = Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in rows)
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.sequence_id * packing.WINDOW + r.offset - r.start), []).append(r)
    seen = Counter()
    for (doc, _), parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        ids = tuple(int(x) for r in parts for x in np.frombuffer(r.ids, "<u4"))
        assert len(ids) == parts[0].doc_tokens and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in parts)
        seen[(doc, ids)] += 1
    assert seen == texts
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, spans in full.items():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        assert sum(n for _, n in spans) == packing.WINDOW or k == max(full)
    seqs = packing.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * packing.WINDOW for r in seqs) and sum(r.n_tokens for r in seqs) == sum(len(t[1]) * n for t, n in texts.items())
    assert packing.pack(packing.tokenise(docs_frame(spark, rows).limit(0))).collect() == []


def test_mix_edges(spark):
    rows = [*EDGE, *[(1000 + i, "w " * (1 + i % 50)) for i in range(200)]]
    docs = docs_frame(spark, rows)
    got = mixing.mix(docs, block=8).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len(words(t))) for d, t in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    target = {r.source_size: r.target for r in got}
    total = sum(len(words(t)) for _, t in rows)
    assert abs(sum(target.values()) - total) < 1e-6 * total and all(t <= 3 * s + 1e-6 for s, t in target.items())
    for size, aim in target.items():
        assert abs(sum(r.taken for r in got if r.source_size == size) - aim) < 16
    assert by_repr(got) == by_repr(mixing.mix(docs.repartition(5), block=8).collect())
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def brute_mix(rows, block, fewest, step):
    """Words that each row takes, slot by slot; rows are (id, source, words), ids and sources are not NULL."""
    names = sorted({s for _, s, _ in rows})
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    target |= {s: level * weight[s] for s in free}
    count = {s: min(size[s], max(fewest, -(-size[s] // block))) for s in names}
    need = {s: round(target[s] * count[s] / size[s]) for s in names}
    stream = {s: [d for d, x, n in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()) if x == s for _ in range(n)] for s in names}
    total, rank, taken, slots = sum(need.values()), Counter(), Counter(), []
    for slot in range(2 * total):
        point, upto = slot * step % 2**31, 0
        for s in names:
            upto += need[s]
            if point < int(upto / total * 2**31):
                break
        r, b = rank[s], count[s]
        rank[s] += 1
        if r < need[s] and r < 3 * b:
            k = (r * mixing.STRIDE + step) % b
            q, more = divmod(size[s], b)
            first = lambda j: j * q + min(j, more)
            taken.update(stream[s][first(k):first(k + 1)])
            slots.append((slot, s, r // b, k))
    return taken, target, slots


@pytest.mark.parametrize("step", [mixing.STEP, 987654321])
def test_mix_is_its_schedule(spark, step):
    """Documents take what the slots take, slot by slot; another step takes other blocks for the same targets."""
    rows = [(i, "abcde"[i % 5 * (i % 3) // 2], 1 + i * 37 % 90) for i in range(300)]
    docs = spark.createDataFrame([(i, s, f"w{i} " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = mixing.mix(docs, block=16, fewest=32, step=step).collect()
    taken, target, slots = brute_mix(rows, 16, 32, step)
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(taken)
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got)
    shares = mixing.blocks(mixing.targets(mixing.sizes(docs)), 16, 32)
    assert sorted((r["slot"], r["source"], r["pass"], r["block"]) for r in mixing.schedule(shares, run=50, step=step).collect()) == slots
    other, _, _ = brute_mix(rows, 16, 32, step + 2**20)
    assert other != taken
    out = mixing.mixed(docs, block=16, fewest=32, step=step, slot_col="slot").collect()
    words_out = Counter()
    for r in out:
        words_out[r.doc_id] += len(words(r.text))
    assert words_out == taken and {r.slot for r in out} <= {x[0] for x in slots}


def test_small_sources_give_their_target(spark):
    """Sources of less than a block, or of a block and a bit, beside a large one; blocks as in production."""
    sizes = {"b": 20, "c": 40, "d": 100, "e": 300, None: 35, "a": 50000}
    rows = [(1000 * k + i, s, "w " * 5) for k, (s, n) in enumerate(sizes.items()) for i in range(n // 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    assert len({r.source_size for r in got}) == len(sizes)
    for size in sizes.values():
        target = {r.target for r in got if r.source_size == size}.pop()
        assert abs(sum(r.taken for r in got if r.source_size == size) - target) <= max(1, size / 1024)
    words_out = Counter()
    for r in mixing.mixed(docs).collect():
        words_out[r.source] += len(words(r.text))
    assert words_out[None] == 105 and words_out["b"] == 60


def test_mixed_rows(spark):
    rows = [*EDGE, *[(1000 + i, f"a{i} " * (1 + i % 50)) for i in range(200)]]
    docs = docs_frame(spark, rows)
    taken = Counter()
    for r in mixing.mix(docs, block=8).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed(docs, block=8)
    assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
    words_out, texts = Counter(), {d: [words(t) for x, t in rows if x == d] for d, _ in rows}
    for r in out.collect():
        w = words(r.text)
        words_out[r.doc_id] += len(w)
        assert any(" ".join(w) in " ".join(t) for t in texts[r.doc_id])
    assert {d: n for d, n in taken.items() if n} == dict(words_out)


def test_capped_targets(spark):
    """A source with few words is capped at three times its size and the excess goes to the others."""
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got["a"] == pytest.approx(30)
    level = (2100 - 30 - 270) / 3
    assert got["b"] == pytest.approx(2 * level) and got["c"] == pytest.approx(level) and got[None] == pytest.approx(270)


@pytest.mark.parametrize("two", [False, True])
def test_connected_parts_are_those_of_all_pairs(two):
    """Groups of near copies, chains and strangers; also only across two sides, a node on both."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, size=(9, 70)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(70) < rng.choice([0.02, 0.1]), rng.integers(0, 2**62, 70).astype(np.uint64), base[i % 9])) for i in range(300)]
    sets += [np.unique(base[0][:40]), np.arange(5, dtype=np.uint64), *[np.arange(i, i + 60, dtype=np.uint64) for i in range(0, 90, 3)]]
    node = rng.permutation(len(sets)).astype(np.int64)
    side = np.arange(len(sets)) % 2 if two else np.zeros(len(sets), int)
    sets.append(sets[4])
    node, side = np.append(node, node[4]), np.append(side, 1 if two else 0)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if (not two or side[i] != side[j]) and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), 10**9), int(node[i]))
    want = {(int(node[i]), least[root(i)]) for i in range(len(sets)) if node[i] != least[root(i)]}
    assert set(shingle_join._connect(node, side, sets)) == want and want
