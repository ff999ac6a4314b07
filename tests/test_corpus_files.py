"""Files of a scanned corpus."""

from pyspark.sql import functions as F

from evigraph.plans import q_records
from evigraph.plans.views import Tables
from evigraph.sources import scan, sinks


def test_scan_corpus_files_are_bounded(spark, tmp_path, monkeypatch):
    docs = spark.range(2100).select(F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("source"), F.lit("abc").alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{tmp_path}/corpus"
    monkeypatch.setattr(sinks, "scratch_folder", lambda spark, name: folder)
    got = {r.source: r.chars for r in q_records.scan_corpus(Tables(spark, str(tmp_path))).collect()}
    assert got == {"hot": 8000, "cold": 400}
    sizes = [len(r.text) for r in scan.scan_corpus(spark, folder, "*.txt").collect()]
    assert max(sizes) <= 4 * q_records.FILE_DOCS and sum(sizes) == 8400
