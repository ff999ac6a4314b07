"""The pipeline against a brute-force version of its stages."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evigraph.llm import mixing, packing, toxicity

from .helpers import EDGE, docs_frame, near_components, normal, words


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.training_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        steps[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(steps[name], out.schema)

    rows = [(d, t) for d, t in rows if model.score(t) < 0.7]
    assert sorted(r.doc_id for r in steps["toxicity"]) == sorted(d for d, _ in rows) and len(rows) < 200
    first = {}
    for d, t in sorted(rows):
        first.setdefault(normal(t), (d, t))
    rows = sorted(first.values())
    assert sorted((r.doc_id, r.text) for r in steps["exact_dedup"]) == rows
    stay = {c for _, _, c in near_components(rows)}
    rows = [(d, t) for d, t in rows if d in stay]
    assert sorted((r.doc_id, r.text) for r in steps["shingle_join"]) == rows
    kept = spark.createDataFrame(steps["shingle_join"], docs.schema)
    taken = {r.doc_id: r.taken for r in mixing.mix(kept).collect()}
    counts = {}
    for r in steps["source_mix"]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert counts == {d: n for d, n in taken.items() if n}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps["source_mix"])
    assert sum(r.length for r in steps["packing"]) == total
    assert max(r.sequence_id for r in steps["packing"]) == (total - 1) // packing.WINDOW


def test_run_equals_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"] and out.count() > 0


def test_edges_go_through(spark, sf):
    for docs in (docs_frame(spark, EDGE), docs_frame(spark, EDGE).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), out.schema)
        out.collect()
