"""Readers: corpus, tagged JSON lines, graph JSON, dictionaries, cases, run folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank, clean_text, lookup_key, strip
from ..functions.vocab import ALIAS_FILE_LABEL

# Schemas are fixed text; nothing is inferred from the files.
NODE = ("struct<id:string, label:string, name:string, canonical_name:string, definition:string, aliases:array<string>, weight:double, "
        "detail_required:string, acquisition_mode:string, evidence_cost:string, attributes:map<string,string>>")
EDGE = ("struct<id:string, type:string, source_id:string, target_id:string, weight:double, detail_required:string, "
        "condition_text:string, attributes:map<string,string>>")
CHUNK_RECORD = (
    "record_type string, run_id string, chunk_id string, relative_path string, heading_path array<string>, line_start int, "
    f"line_end int, status string, extraction struct<nodes:array<{NODE}>, edges:array<{EDGE}>>, error_type string, "
    "error_code string, retryable boolean, chunk_text string")
GRAPH = f"summary map<string,string>, nodes array<{NODE}>, edges array<{EDGE}>"
ALIAS_FILE = ("merge_groups array<struct<canonical_name:string, aliases:array<string>, confidence:string, reason:string>>, "
              "DELETE array<string>")
CASE = (
    "case_id string, title string, true_disease_phase string, chief_complaint string, behavior_style string, "
    "true_conditions array<string>, slot_truth_map map<string, struct<node_id:string, value:string, group:string, node_label:string, "
    "mention_style:string, reveal_only_if_asked:boolean, aliases:array<string>>>, hidden_slots array<string>, red_flags array<string>, "
    "metadata map<string,string>")


def file_name(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """One row per text file below ``root``: ``path`` relative to it, ``text``."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    base = root.rstrip("/").split("://")[-1].lstrip("/").removeprefix("file:")
    return df.select(F.substring_index("_metadata.file_path", f"{base}/", -1).alias("path"), F.col("value").alias("text"))


def scan_tagged_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_RECORD, tag: str | None = None,
                      strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of one tag, and the counts per tag (bad lines count as ``bad_row``).

    Strict reading fails on a bad line, lenient reading skips it.
    """
    reader = spark.read
    if strict:
        df = reader.schema(schema).option("mode", "FAILFAST").json(path)
        counts = df.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))
    else:
        df = reader.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
        kind = F.when(F.col("_bad").isNotNull(), "bad_row").otherwise(F.col("record_type"))
        counts = df.select(kind.alias("record_type"), "chunk_id").groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))
        df = df.where("_bad IS NULL").drop("_bad")
    return (df.where(F.col("record_type") == tag) if tag else df), counts


def scan_graph_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node, edge and summary frames of graph JSON: one object per file, or per line for sharded graphs."""
    df = spark.read.schema(GRAPH).option("multiLine", multi_line).json(path)
    return (df.select(F.inline("nodes")), df.select(F.inline("edges")), df.select(F.explode("summary")))


def scan_graph_objects(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node, edge and summary frames of graph files that hold one JSON object each.

    Files are read whole and in parallel, so a graph is best cut into many of bounded size.
    A file that is no object with a ``nodes`` and an ``edges`` array fails the read, or
    with ``strict`` off gives no rows; a ``summary`` that is no object is empty.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    kind = lambda field: F.substring(F.schema_of_variant(F.variant_get("v", field, "variant")), 1, 5)
    whole = F.coalesce((kind("$.nodes") == "ARRAY") & (kind("$.edges") == "ARRAY"), F.lit(False))
    raw = raw.withColumn("v", F.when(whole, F.col("v")).when(F.lit(strict), F.raise_error(F.concat(F.lit("no nodes and edges arrays in "), "file"))))

    def rows(field: str, types: str) -> DataFrame:
        item = raw.select(F.explode(F.variant_get("v", f"$.{field}", "array<variant>")).alias("x"))
        wanted = T.StructType.fromDDL(types) if isinstance(types, str) else types
        return item.select(*[F.try_variant_get("x", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in wanted.fields])

    fields = {f.name: f.dataType for f in T.StructType.fromDDL(GRAPH).fields} if isinstance(GRAPH, str) else {f.name: f.dataType for f in GRAPH.fields}
    summary = raw.select(F.explode(F.try_variant_get("v", "$.summary", "map<string, string>")))
    return rows("nodes", fields["nodes"].elementType), rows("edges", fields["edges"].elementType), summary


def scan_family_rules(spark: SparkSession, path: str) -> DataFrame:
    """``grp, family, term`` of rule files: ``{group: {family: [terms]}}``, group ``*`` for all; terms are trimmed and lower-cased."""
    raw = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string, map<string, array<string>>>")).alias("grp", "f"))
    rows = raw.select("grp", F.explode("f").alias("family", "terms")).select("grp", "family", F.explode("terms").alias("term"))
    return rows.withColumn("term", F.lower(F.trim("term"))).where("term <> ''").distinct()


def alias_rows(files: DataFrame, labels: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(file, label, canonical, alias)`` and ``(file, label, name)`` to delete.

    ``files``: ``file`` (name) plus the dictionary payload columns.
    """
    labels = ALIAS_FILE_LABEL if labels is None else labels
    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    df = files.withColumn("label", F.try_element_at(mapping, F.col("file"))).where("label IS NOT NULL")
    g = df.select("file", "label", F.explode("merge_groups").alias("g"))
    own = F.array(F.col("g.canonical_name"))
    alias = g.select("file", "label", clean_text(F.col("g.canonical_name")).alias("canonical"),
                     F.explode(F.concat(own, F.coalesce("g.aliases", F.array().cast("array<string>")))).alias("alias"))
    alias = alias.where("canonical IS NOT NULL AND alias IS NOT NULL")
    delete = df.select("file", "label", F.explode("DELETE").alias("name")).where("name IS NOT NULL")
    return alias, delete


def scan_alias_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.schema(ALIAS_FILE).option("multiLine", True).json(path)
    return alias_rows(df.select(file_name(F.col("_metadata.file_path")).alias("file"), "*"))


def reclass_rows(payload: DataFrame) -> DataFrame:
    """``{label: {target or DELETE: [names]}}`` text as ``(label, name, action)`` rows."""
    one = payload.select(F.explode(F.from_json("value", "map<string, map<string, array<string>>>")).alias("label", "targets"))
    two = one.select("label", F.explode("targets").alias("action", "names"))
    return two.select("label", F.explode("names").alias("name"), "action").where(~blank(F.col("name")))


def scan_reclass_rules(spark: SparkSession, path: str) -> DataFrame:
    return reclass_rows(spark.read.text(path, wholetext=True))


def requirement_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements by id and by normalised name; the first entry in ``ord`` order wins.

    ``rows``: ``disease_id, disease_name, required ARRAY<ARRAY<STRING>>, ord``.
    """
    ok = rows.where(F.size("required") > 0)
    by_id = ok.where(~blank(F.col("disease_id"))).groupBy("disease_id").agg(F.min_by("required", "ord").alias("required"))
    by_name = ok.withColumn("name_key", lookup_key(F.col("disease_name"))).where("name_key <> ''").groupBy("name_key").agg(
        F.min_by("disease_id", "ord").alias("disease_id"), F.min_by("required", "ord").alias("required"))
    return by_id, by_name


# A report and a requirement entry; fields that are not listed are ignored.
AUDIT_REPORT = (
    "disease struct<disease_id:string, disease_name:string, disease_label:string>, evidence array<struct<target_node_id:string, target_name:string, "
    "target_label:string, group:string, relation_type:string, priority:double, relation_specificity:double, relation_weight:double, "
    "acquisition_mode:string, evidence_cost:string>>")
REQUIREMENT = "disease_id string, disease_name string, required_family_groups array<array<string>>"


def scan_audit_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Evidence items of audit reports, one report per line (or per file): ``disease_id`` and the item's fields."""
    df = spark.read.schema(AUDIT_REPORT).option("multiLine", multi_line).json(path)
    return df.select("disease.disease_id", F.inline("evidence"))


def scan_requirements(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Required family groups by id and by normalised name, from entries in one or many files; the smallest id wins."""
    df = spark.read.schema(REQUIREMENT).option("multiLine", multi_line).json(path)
    return requirement_index(df.select("disease_id", "disease_name", F.col("required_family_groups").alias("required"), F.col("disease_id").alias("ord")))


def scan_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases (JSON lines or one JSON array) and their slots as rows."""
    df = spark.read.schema(CASE).option("multiLine", path.endswith(".json")).json(path)
    slots = df.select("case_id", F.explode("slot_truth_map").alias("slot_id", "s")).select(
        "case_id", "slot_id", F.col("s.value").alias("value"), F.col("s.group").alias("grp"), F.col("s.node_label").alias("label"),
        F.col("s.reveal_only_if_asked").alias("reveal_only_if_asked"))
    return df.drop("slot_truth_map"), slots


# --- fixed values: files that make a folder a run, most detailed first ------------------------------
RUN_FILES = (("replay_results.jsonl", "replay", 1), ("focused_repair_summary.jsonl", "focused", 1), ("cases.jsonl", "cases", 2),
             ("benchmark_summary.json", "benchmark", 3), ("status.json", "status", 4), ("run.log", "log", 5))


def scan_run_outputs(spark: SparkSession, root: str, kinds: Sequence[tuple[str, str, int]] = RUN_FILES) -> DataFrame:
    """Run folders below ``root`` with their file kinds, best detail rank and last change.

    Only file metadata is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    return rank_runs(files, kinds)


def rank_runs(files: DataFrame, kinds: Sequence[tuple[str, str, int]] = RUN_FILES) -> DataFrame:
    known = F.broadcast(files.sparkSession.createDataFrame(list(kinds), "file string, kind string, detail int"))  # a handful of rows
    f = files.withColumns({"file": file_name(F.col("path")), "run": F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")})
    hit = f.join(known, "file")
    # kinds are a closed vocabulary, so one flag each stands for the set
    names = sorted({k for _, k, _ in kinds})
    out = hit.groupBy("run").agg(F.min("detail").alias("detail"), F.max("modificationTime").alias("changed_at"),
                                 *[F.max(F.when(F.col("kind") == k, F.lit(k))).alias(f"_{k}") for k in names])
    return out.select("run", "detail", "changed_at", F.concat_ws(",", *[F.col(f"_{k}") for k in names]).alias("kinds")).orderBy(
        "detail", F.desc("changed_at"), "run")


def retry_selection(errors: DataFrame, error_types: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Chunks to try again: last record per chunk of the wanted error types, blank text dropped."""
    e = errors.where(F.col("error_type").isin(*error_types)) if error_types else errors
    cols = [c for c in errors.columns if c != "chunk_id"]
    last = e.groupBy("chunk_id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("chunk_id", "_r.*")
    return last.where(strip(F.coalesce("chunk_text", F.lit(""))) != "")


def repair_ids(listed: DataFrame, report: DataFrame) -> DataFrame:
    """Chunk ids named by a list or a report, each once."""
    both = listed.select(strip(F.col("chunk_id").cast("string")).alias("chunk_id")).unionByName(
        report.select(strip(F.col("chunk_id").cast("string")).alias("chunk_id")))
    return both.where("chunk_id <> ''").distinct()
