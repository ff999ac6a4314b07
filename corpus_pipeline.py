"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents go; of equal texts the first stays; of near-duplicates the first stays; the
sources are mixed to their weights (documents are repeated, dropped, or cut at the borders of
blocks); what remains is packed into sequences, whose token ids are returned piece by piece.
Every stage but the last returns the columns of its input.  Missing columns fail, NULLs and
empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import exact_dedup, mixing, packing, shingle_join, toxicity
from evigraph.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the border of toxicity, by a lexicon learned from the labels of training ids."""
    return toxicity.keep_clean(docs, toxicity.training_model(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal up to white space."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8."""
    return shingle_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the length column follows a cut text."""
    out = mixing.mixed(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences with their token ids."""
    return packing.pack(packing.tokenise(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("shingle_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack),
]

# The learned lexicon and the tokenizer cannot be stated as SQL; a brute-force version checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
