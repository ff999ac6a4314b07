"""Secret scan by character Markov models (operator 12).

Three plain rules (assignments, access keys, long hexadecimal runs) give the base spans.
Beyond them every long run of identifier characters is scored by two character models of
order two, one of random strings and one of ordinary identifiers; a run whose
log-likelihood ratio reaches ``RATIO`` is a span of kind ``random``, unless it overlaps a
base span.

The models are trained from labelled samples.  Random: the values inside base spans, and
``GENERATED`` strings drawn by a fixed seed from each of the usual alphabets, which keeps
the model whole where a corpus holds few secrets.  Ordinary: all other runs of the corpus,
the same runs joined as identifiers join words, and filler (numbers, dates, one character again and again).
Each distinct run of a label counts once, so copies of a document weigh nothing, and what a
single ordinary run holds counts as not seen, so an unlabelled secret does not vouch for itself.  What
reaches the driver are counts of character triples, bounded by the alphabet.

Defined cases: NULL and empty texts have no spans; a corpus without any run has a model
that finds nothing random; rows that repeat are scanned alike; a NULL id stays NULL; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, text_slices

# The rules, and how long a match (or its second group) must be.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

# Runs that the models judge: characters, and the fewest of them.
CHARACTERS = "-+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
SHORTEST = 12
# Nats by which the random model must explain a run better.
RATIO = 20.0
# Generated strings per alphabet, their lengths, and weights of the shorter contexts.
GENERATED, LENGTHS, SEED = 500, (16, 64), 12
BACK_2, BACK_1 = 8.0, 4.0
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", CHARACTERS[3:], CHARACTERS)

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
# A run that is long enough is found whole, so short ones need no visit.
_HEX = re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")
_RUN = re.compile(f"[A-Za-z0-9+/_-]{{{SHORTEST},}}")
# What a text must hold to be searched by a rule; found by a linear-time automaton.
_HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA", "hex": f"[0-9a-f]{{{LEAST['hex']}}}"}

# Codes of characters: 0 stands for both ends of a run.
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in CHARACTERS]] = np.arange(1, len(CHARACTERS) + 1)
SIZE = len(CHARACTERS) + 1


def base_spans(text: str, hints: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int, int, int]]:
    """``start, kind, end, value start, value end`` of the matches of the rules, sorted."""
    out = []
    if hints[0]:
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if hints[1]:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hints[2]:
        out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def other_runs(text: str, spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of the runs that overlap no base span."""
    runs = [m.span() for m in _RUN.finditer(text)]
    if not spans:
        return runs
    taken, at, reach = [], 0, 0
    for a, b in runs:
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= a:
            taken.append((a, b))
    return taken


def _scanned(texts: pa.Array) -> Iterator[tuple[str, list, list[tuple[int, int]]]]:
    """``text, base spans, other runs`` of each text; NULL is empty."""
    texts = pc.fill_null(texts, "")
    hints = zip(*[pc.match_substring_regex(texts, _HINTS[k]).to_pylist() for k in KINDS[:3]])
    for text, hint in zip(texts.to_pylist(), hints):
        spans = base_spans(text, hint) if any(hint) else []
        yield text, spans, other_runs(text, spans)


def codes(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the character triple that ends at each place of the runs, and the run of each.

    A run is read with two ends before it and one behind it.
    """
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = np.array([len(r) for r in runs], dtype=np.int64)
    raw = np.frombuffer("".join(f"\0\0{r}\0" for r in runs).encode("ascii"), np.uint8)
    code = _CODE[raw]
    triple = (code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:]
    first = np.cumsum(n + 3) - (n + 3)
    owner = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    return triple[first[owner] + place], owner


def generated() -> list[str]:
    """Random strings of the usual alphabets."""
    rng = random.Random(SEED)
    return ["".join(rng.choices(a, k=rng.randint(*LENGTHS))) for a in ALPHABETS for _ in range(GENERATED)]


def identifiers(runs: list[str]) -> list[str]:
    """Each run once more, its halves joined in one of the ways in which identifiers join words."""
    out = []
    for run in runs:
        a, b, k = run[:len(run) // 2], run[len(run) // 2:], zlib.crc32(run.encode())
        out.append((f"{a}_{b}", f"{a}{b.capitalize()}", f"{a}-{b}", f"{a}/{b}", f"{a.upper()}_{b.upper()}", f"{run}{k % 97}", f"{run}_v{k % 89}")[k % 7])
    return out


def filler() -> list[str]:
    """Rows of one character, numbers and dates."""
    rng = random.Random(SEED)
    numbers = ["".join(rng.choices("0123456789", k=16)) for _ in range(GENERATED)]
    return numbers + [c * 32 for c in CHARACTERS] + [f"{y}-{m:02d}-{d:02d}" for y in range(1970, 2040) for m in (1, 6, 10, 12) for d in (1, 15, 31)]


def log_likelihood(counts: np.ndarray, less: int = 0) -> np.ndarray:
    """Log probability of each character after two others; short contexts fill in for rare ones.

    ``less`` is taken off the count of every triple, not off that of its shorter contexts.
    """
    three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    two = three.sum(axis=0)
    three = np.maximum(three - less, 0)
    one = (two + BACK_1 / SIZE) / (two.sum(axis=1, keepdims=True) + BACK_1)
    return np.log((three + BACK_2 * one) / (three.sum(axis=2, keepdims=True) + BACK_2)).ravel()


def _samples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct labelled runs of about 2 MB of text."""
    for batch in text_slices(batches):
        secret, ordinary = set(), set()
        for text, spans, runs in _scanned(batch.column("text")):
            for span in spans:
                secret.update(m.group() for m in _RUN.finditer(text, span[3], span[4]))
            ordinary.update(text[a:b] for a, b in runs)
        rows = [*((r, True) for r in secret), *((r, False) for r in ordinary)]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.bool_())], names=["run", "secret"])


def _triples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of triples, summed up within the task."""
    total = np.zeros((2, SIZE**3), np.int64)
    for batch in text_slices(batches, "run"):
        secret = batch.column("secret")
        for label, mask in ((1, secret), (0, pc.invert(secret))):
            runs = batch.column("run").filter(mask).to_pylist()
            for part in (runs, [] if label else identifiers(runs)):
                total[label] += np.bincount(codes(part)[0], minlength=SIZE**3)
    label, triple = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label == 1), pa.array(triple), pa.array(total[label, triple])], names=["secret", "triple", "n"])


def learn(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio, random to ordinary, of every character triple; learned from all rows."""
    runs = docs.select(F.col(text_col).alias("text")).mapInArrow(_samples, "run string, secret boolean").distinct()
    counts = runs.mapInArrow(_triples, "secret boolean, triple long, n long").groupBy("secret", "triple").agg(F.sum("n").alias("n"))
    total = np.zeros((2, SIZE**3), np.int64)
    for r in counts.collect():  # at most two rows per triple of characters
        total[int(r["secret"]), r["triple"]] = r["n"]
    if not total.any():
        return np.full(SIZE**3, -np.inf)
    # Filler is a fixed part of what is ordinary, whatever the size of the corpus.
    total[0] += np.bincount(codes(filler())[0], minlength=SIZE**3) * max(1, int(total[0].sum()) // 100_000)
    total[1] += np.bincount(codes(generated())[0], minlength=SIZE**3)
    # What only one run holds may be a secret that no rule knows; a run is read twice, with its identifier.
    return log_likelihood(total[1]) - log_likelihood(total[0], 2)


def ratios(runs: list[str], model: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each run."""
    triple, owner = codes(runs)
    return np.bincount(owner, weights=model[triple], minlength=len(runs))


@lru_cache(maxsize=1)
def _model(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32).astype(np.float64)


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, ratio: double>>"


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``SPANS`` of every row, sorted by start and kind; offsets are code points, ends exclusive; base spans have no ratio."""
    raw = model.astype(np.float32).tobytes()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _model(raw)
        for batch in text_slices(batches):
            rows = list(_scanned(batch.column("text")))
            score = iter(ratios([text[a:b] for text, _, runs in rows for a, b in runs], table).tolist())
            out = []
            for _, spans, runs in rows:
                found = [(a, kind, b, None) for a, kind, b, _, _ in spans]
                found += [(a, 3, b, s) for (a, b), s in zip(runs, score) if s >= ratio]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "ratio": s} for a, k, b, s in sorted(found, key=lambda x: x[:2])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, learn(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *map(count, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
