"""Building and rewriting the property graph: entity resolution, merging, pruning, reports.

A node frame has ``node_id, label, name, canonical_name, occurrence_count, w100, detail``;
an edge frame ``edge_id, type, source_id, target_id, occurrence_count, w100``.  Lists that
grow with the data (aliases, sources) are child tables ``(node_id, kind, value, first)``,
never arrays in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, hash_id, lookup_key
from ..functions.vocab import DETAIL_LEVELS, LABELS, RELATION_TYPES

DELETE = "DELETE"


def detail_rank(col: Column) -> Column:
    """Ordered detail level; unknown text counts as 'standard'."""
    found = F.array_position(F.array(*[F.lit(d) for d in DETAIL_LEVELS]), F.coalesce(clean_text(col), F.lit("standard")))
    return F.when(found > 0, found - 1).otherwise(F.lit(1))


def max_detail(col: Column) -> Column:
    levels = F.array(*[F.lit(d) for d in DETAIL_LEVELS])
    return F.element_at(levels, (F.max(detail_rank(col)) + 1).cast("int"))


# -- alias dictionaries --------------------------------------------------------------------

def alias_index(files: DataFrame, last_file_wins: bool = False) -> DataFrame:
    """``(file, label, canonical, alias)`` -> ``(label, akey, canonical)``, one row per key.

    All files of a label are united and the first file that names a key decides.  With
    ``last_file_wins`` only the last file of each label counts.
    """
    own = files.select("file", "label", "canonical", F.col("canonical").alias("alias"))
    rows = files.select("file", "label", "canonical", "alias").unionByName(own)
    rows = rows.select("file", "label", clean_text(F.col("canonical")).alias("canonical"),
                       lookup_key(F.col("alias")).alias("akey")).where("canonical IS NOT NULL AND akey <> ''")
    if last_file_wins:
        last = rows.groupBy("label").agg(F.max("file").alias("file"))
        rows = rows.join(last, ["label", "file"])
    return rows.groupBy("label", "akey").agg(F.min_by("canonical", F.struct("file", "canonical")).alias("canonical"))


def alias_conflicts(files: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Keys with two canonical names, or both an alias and a delete entry."""
    own = files.select("label", "canonical", F.col("canonical").alias("alias"))
    rows = files.select("label", "canonical", "alias").unionByName(own)
    keyed = rows.select("label", lookup_key(F.col("alias")).alias("akey"), clean_text(F.col("canonical")).alias("canonical"))
    if deletes is not None:
        both = deletes.select("label", lookup_key(F.col("name")).alias("akey"), F.lit(DELETE).alias("canonical"))
        keyed = keyed.unionByName(both)
    distinct = keyed.distinct()
    return distinct.groupBy("label", "akey").agg(
        F.count(F.lit(1)).alias("n_canonical"), F.min("canonical").alias("first_canonical"),
        F.max("canonical").alias("last_canonical")).where("n_canonical > 1")


def reclass_conflicts(rules: DataFrame) -> DataFrame:
    """Same label and key with two different actions."""
    keyed = rules.select("label", lookup_key(F.col("name")).alias("akey"), "action").distinct()
    return keyed.groupBy("label", "akey").agg(F.count(F.lit(1)).alias("n_action")).where("n_action > 1")


def _lookups(mentions: DataFrame, alias: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """One left join per candidate name; a dictionary below the broadcast limit costs no shuffle."""
    out, found = mentions, []
    for i, n in enumerate(names):
        d = alias.select("label", F.col("akey").alias(f"_k{i}"), F.col("canonical").alias(f"_c{i}"))
        out = out.withColumn(f"_k{i}", lookup_key(F.col(n))).join(d, ["label", f"_k{i}"], "left")
        found.append(F.col(f"_c{i}"))
    return out, found


def alias_resolve(mentions: DataFrame, alias: DataFrame, names: Sequence[str], fallback: str) -> DataFrame:
    """First candidate name found in the dictionary decides; otherwise the mention keeps its own name.

    ``names`` are the candidate columns of a mention in order.
    """
    joined, found = _lookups(mentions, alias, names)
    own = F.coalesce(*[clean_text(F.col(n)) for n in names], F.col(fallback))
    hit = F.coalesce(*found) if len(found) > 1 else found[0]
    return joined.select(
        *mentions.columns, F.coalesce(hit, own).alias("canonical"),
        F.when(hit.isNotNull(), "alias").otherwise("self").alias("method"))


def alias_resolve_strict(mentions: DataFrame, alias: DataFrame, names: Sequence[str],
                         fallback: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`alias_resolve`, but a mention that matches two canonical names is rejected.

    Returns (resolved, rejects).
    """
    joined, found = _lookups(mentions, alias, names)
    lo = F.least(*found) if len(found) > 1 else found[0]
    hi = F.greatest(*found) if len(found) > 1 else found[0]
    clash = F.coalesce(lo != hi, F.lit(False))
    own = F.coalesce(*[clean_text(F.col(n)) for n in names], F.col(fallback))
    resolved = joined.where(~clash).select(
        *mentions.columns, F.coalesce(lo, own).alias("canonical"), F.when(lo.isNotNull(), "alias").otherwise("self").alias("method"))
    rejects = joined.where(clash).select(*mentions.columns, lo.alias("first_canonical"), hi.alias("last_canonical"))
    return resolved, rejects


def node_hash(label: Column, canonical: Column) -> Column:
    return hash_id("merged_node_", F.concat_ws("::", label, canonical))


def edge_hash(etype: Column, src: Column, dst: Column, condition: Column) -> Column:
    return hash_id("merged_edge_", etype, src, dst, condition)


# -- merging -----------------------------------------------------------------------------------

def merge_nodes(resolved: DataFrame, order: Sequence[str], key_cols: Sequence[str] = ("label", "canonical")) -> DataFrame:
    """Mentions of one entity become one node; first-seen fields follow ``order``.

    ``key_cols`` may add more columns (e.g. document and node id) for labels that must not merge.
    """
    first = F.struct(*order)
    return resolved.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.max("w100").alias("w100"),
        max_detail(F.col("detail")).alias("detail"),
        F.min_by(F.coalesce(clean_text(F.col("name")), F.col("canonical")), first).alias("name"),
        F.min_by("path", first).alias("sample_path"),
    ).select(
        hash_id("merged_node_", F.concat_ws("::", *key_cols)).alias("node_id"), "label",
        F.col("canonical").alias("canonical_name"), "name", "occurrence_count", "w100", "detail", "sample_path")


def merge_lists(resolved: DataFrame, order: Sequence[str], kinds: dict[str, Sequence[str]],
                key: Column) -> DataFrame:
    """List-valued fields as rows ``(id, kind, value, first)``, unique, with the first place seen."""
    parts = [F.struct(F.lit(kind).alias("kind"), clean_text(F.col(c)).alias("value"))
             for kind, cols in kinds.items() for c in cols]
    rows = resolved.select(key.alias("id"), F.struct(*order).alias("_o"), F.explode(F.array(*parts)).alias("_p"))
    rows = rows.select("id", "_o", "_p.kind", "_p.value").where("value IS NOT NULL")
    return rows.groupBy("id", "kind", "value").agg(F.min("_o").alias("first"))


def field_variants(resolved: DataFrame, fields: Sequence[str], key: Column) -> DataFrame:
    """Values of a generic field where one entity has more than one of them."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    rows = resolved.select(key.alias("id"), F.explode(F.array(*parts)).alias("_p")).select("id", "_p.field", "_p.value")
    values = rows.where("coalesce(value, '') <> ''").distinct()
    many = values.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return values.join(many, ["id", "field"])


def local_map(resolved: DataFrame, order: Sequence[str], chunk: str = "chunk_id") -> DataFrame:
    """``(chunk, local_id) -> node_id``; a repeated local id takes its last definition."""
    return resolved.groupBy(chunk, "local_id").agg(
        F.max_by(node_hash(F.col("label"), F.col("canonical")), F.struct(*order)).alias("node_id"))


def edge_remap(edges: DataFrame, mapping: DataFrame, scope: Sequence[str] = (), old_id: str = "local_id",
               new_id: str = "node_id", deleted: DataFrame | None = None) -> DataFrame:
    """Endpoints through ``mapping``; adds ``new_source, new_target, disposition``.

    ``scope`` columns (e.g. the chunk) must agree.  Disposition: deleted, unmapped,
    self_loop, remapped or kept.
    """
    m = mapping.select(*scope, old_id, new_id)
    s = m.withColumnsRenamed({old_id: "source_id", new_id: "new_source"})
    t = m.withColumnsRenamed({old_id: "target_id", new_id: "new_target"})
    out = edges.join(s, [*scope, "source_id"], "left").join(t, [*scope, "target_id"], "left")
    gone = F.lit(False)
    if deleted is not None:
        d = deleted.select(F.col("node_id")).distinct()
        out = out.join(d.select(F.col("node_id").alias("source_id"), F.lit(True).alias("_ds")), "source_id", "left")
        out = out.join(d.select(F.col("node_id").alias("target_id"), F.lit(True).alias("_dt")), "target_id", "left")
        gone = F.coalesce("_ds", F.lit(False)) | F.coalesce("_dt", F.lit(False))
    disposition = (
        F.when(gone, "deleted")
        .when(F.col("new_source").isNull() | F.col("new_target").isNull(), "unmapped")
        .when(F.col("new_source") == F.col("new_target"), "self_loop")
        .when((F.col("new_source") != F.col("source_id")) | (F.col("new_target") != F.col("target_id")), "remapped")
        .otherwise("kept"))
    return out.withColumn("disposition", disposition).drop("_ds", "_dt")


def merge_edges(edges: DataFrame, condition: Column | None = None, count: Column | None = None) -> DataFrame:
    """Edges with equal type, endpoints and condition become one."""
    cond = F.lit("") if condition is None else F.coalesce(clean_text(condition), F.lit(""))
    n = F.lit(1) if count is None else count
    rows = edges.select("type", "source_id", "target_id", cond.alias("condition"), "w100", n.cast("bigint").alias("_n"),
                        *(["detail"] if "detail" in edges.columns else []))
    aggs = [F.sum("_n").alias("occurrence_count"), F.max("w100").alias("w100")]
    if "detail" in rows.columns:
        aggs.append(max_detail(F.col("detail")).alias("detail"))
    out = rows.groupBy("type", "source_id", "target_id", "condition").agg(*aggs)
    return out.withColumn("edge_id", edge_hash(F.col("type"), F.col("source_id"), F.col("target_id"), F.col("condition")))


def remerge_nodes(nodes: DataFrame) -> DataFrame:
    """Second merge of canonical rows (``new_id, label, canonical, name, old id``): counts add up."""
    return nodes.groupBy("new_id", "label", "canonical").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.max("w100").alias("w100"),
        max_detail(F.col("detail")).alias("detail"),
        F.min_by("name", "node_id").alias("name"),
        F.count(F.lit(1)).alias("merged_from"),
    ).select(F.col("new_id").alias("node_id"), "label", F.col("canonical").alias("canonical_name"), "name",
             "occurrence_count", "w100", "detail", "merged_from")


# -- connectivity ---------------------------------------------------------------------------------

def endpoints(edges: DataFrame) -> DataFrame:
    """Every node id that has an edge, once."""
    both = F.explode(F.array("source_id", "target_id")).alias("node_id")
    return edges.select(both).distinct()


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "node_id", "left_semi")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "node_id", "left_anti")


def drop_isolated(nodes: DataFrame, edges: DataFrame, keep_label: str = "Disease") -> DataFrame:
    """Nodes without an edge are dropped unless they carry ``keep_label``."""
    alone = isolated_nodes(nodes, edges)
    return connected_nodes(nodes, edges).unionByName(alone.where(F.col("label") == keep_label))


def incident_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("degree"))


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete nodes with their incident edges."""
    gone = ids.select("node_id").distinct()
    kept = nodes.join(gone, "node_id", "left_anti")
    e = edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    e = e.join(gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return kept, e.select(*edges.columns)


def prune_graph(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop target diseases, their edges, then evidence left without an edge."""
    diseases = nodes.where(F.col("label") == "Disease").join(targets.select("node_id").distinct(), "node_id", "left_semi")
    kept, e = remove_nodes(nodes, edges, diseases)
    return drop_isolated(kept, e), e


# -- composite rewrites ----------------------------------------------------------------------------

def _rewrite(nodes: DataFrame, edges: DataFrame, moved: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """Shared tail of both rewrites: ``moved`` has node columns plus ``new_id, new_label, canonical``."""
    merged = remerge_nodes(moved.select(
        "new_id", F.col("new_label").alias("label"), "canonical", "name", "node_id", "occurrence_count", "w100", "detail"))
    remap = edge_remap(edges, moved.select(F.col("node_id").alias("old"), "new_id"), (), "old", "new_id", deleted)
    ok = remap.where(F.col("disposition").isin("remapped", "kept"))
    new_edges = merge_edges(
        ok.select("type", F.col("new_source").alias("source_id"), F.col("new_target").alias("target_id"), "w100",
                  "occurrence_count"), count=F.col("occurrence_count"))
    return {"nodes": drop_isolated(merged, new_edges), "edges": new_edges, "merged": merged, "remap": remap}


def apply_aliases(nodes: DataFrame, edges: DataFrame, alias: DataFrame, delete_names: DataFrame) -> dict[str, DataFrame]:
    """Delete by name, rename to the canonical name, merge what coincides, remap edges, drop isolated evidence."""
    gone = delete_names.select("label", lookup_key(F.col("name")).alias("akey")).distinct()
    keyed = nodes.withColumns({"akey": lookup_key(F.col("canonical_name")), "_nkey": lookup_key(F.col("name"))})
    hit = keyed.join(gone.withColumn("_d1", F.lit(True)), ["label", "akey"], "left").join(
        gone.select("label", F.col("akey").alias("_nkey"), F.lit(True).alias("_d2")), ["label", "_nkey"], "left")
    is_gone = F.coalesce("_d1", "_d2", F.lit(False))
    deleted = hit.where(is_gone).select("node_id", "label", "name")
    left = hit.where(~is_gone).select(*nodes.columns)
    resolved, rejects = alias_resolve_strict(left, alias, ["canonical_name", "name"], "node_id")
    moved = resolved.withColumns({
        "new_label": F.col("label"), "new_id": node_hash(F.col("label"), F.col("canonical")),
        "name": F.when(F.col("method") == "alias", F.col("canonical")).otherwise(F.col("name"))})
    return _rewrite(nodes, edges, moved, deleted) | {"deleted": deleted, "rejects": rejects, "resolved": moved}


def reclass_action(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``action`` and ``matched_key``: the rule for the canonical name, else for the display name."""
    r = rules.select("label", lookup_key(F.col("name")).alias("akey"), "action").distinct()
    keyed = nodes.withColumns({"_c": lookup_key(F.col("canonical_name")), "_n": lookup_key(F.col("name"))})
    one = keyed.join(r.select("label", F.col("akey").alias("_c"), F.col("action").alias("_a1")), ["label", "_c"], "left")
    two = one.join(r.select("label", F.col("akey").alias("_n"), F.col("action").alias("_a2")), ["label", "_n"], "left")
    key = F.when(F.col("_a1").isNotNull(), F.col("_c")).when(F.col("_a2").isNotNull(), F.col("_n"))
    return two.select(*nodes.columns, F.coalesce("_a1", "_a2").alias("action"), key.alias("matched_key"))


def reclassify_graph(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """Relabel or delete nodes by rule, then merge, remap and drop isolated evidence; report unused rules."""
    acted = reclass_action(nodes, rules)
    is_gone = F.coalesce(F.col("action") == DELETE, F.lit(False))
    deleted = acted.where(is_gone).select("node_id", "label", "name")
    moved = acted.where(~is_gone).withColumns({
        "new_label": F.coalesce("action", "label"), "canonical": F.col("canonical_name")})
    moved = moved.withColumn("new_id", node_hash(F.col("new_label"), F.col("canonical")))
    used = acted.where("action IS NOT NULL").select("label", F.col("matched_key").alias("akey")).distinct()
    unused = rules.withColumn("akey", lookup_key(F.col("name"))).join(used, ["label", "akey"], "left_anti")
    return _rewrite(nodes, edges, moved, deleted) | {
        "deleted": deleted, "unused": unused.select("label", "name", "action"), "resolved": moved}


# -- upsert and splice -----------------------------------------------------------------------------

def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """New non-null values win, old values stay otherwise; new keys are added."""
    cols = [c for c in base.columns if c not in key]
    b, d = base.alias("b"), delta.alias("d")
    cond = F.lit(True)
    for k in key:
        cond = cond & (F.col(f"b.{k}") == F.col(f"d.{k}"))
    return b.join(d, cond, "full").select(
        *[F.coalesce(F.col(f"d.{k}"), F.col(f"b.{k}")).alias(k) for k in key],
        *[(F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")) if c in delta.columns else F.col(f"b.{c}")).alias(c) for c in cols])


def known_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both endpoints exist."""
    ids = nodes.select("node_id").distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    return e.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def replace_records(base: DataFrame, redo: DataFrame, key: str, value: Sequence[str]) -> DataFrame:
    """Re-done records replace the baseline record of the same key; others stay."""
    r = redo.select(key, *[F.col(v).alias(f"_{v}") for v in value], F.lit(True).alias("_redo"))
    out = base.join(r, key, "left")
    pick = {v: F.when(F.col("_redo"), F.col(f"_{v}")).otherwise(F.col(v)) for v in value}
    return out.withColumns(pick).withColumn("replaced", F.coalesce("_redo", F.lit(False))).select(*base.columns, "replaced")


# -- reports ----------------------------------------------------------------------------------------

def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def _metric(df: DataFrame, *cols: Column) -> DataFrame:
    """One aggregated row turned into ``(metric, key, value)`` rows."""
    row = df.agg(*cols)
    names = row.columns
    stack = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    return row.select(F.expr(f"stack({len(names)}, {stack}) as (metric, value)")).select(
        "metric", F.lit("").alias("key"), "value")


def _keyed(df: DataFrame, metric: str, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(metric).alias("metric"), "key", "value")


def quality_report(nodes: DataFrame, edges: DataFrame, labels: Sequence[str] = LABELS,
                   types: Sequence[str] = RELATION_TYPES, deprecated: Sequence[str] = (),
                   evidence_labels: Sequence[str] = tuple(x for x in LABELS if x != "Disease")) -> DataFrame:
    """Graph health as ``(metric, key, value)`` rows.  Nodes carry ``mode`` and ``cost``."""
    alone = isolated_nodes(nodes, edges)
    dup = nodes.where("node_id IS NOT NULL").groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    evidence = nodes.where(F.col("label").isin(*evidence_labels))
    one = F.lit(1)
    parts = [
        _metric(nodes, F.count(one).alias("node_count"),
                F.sum(F.when(F.coalesce("node_id", F.lit("")) == "", 1).otherwise(0)).alias("missing_id_node_count")),
        _metric(edges, F.count(one).alias("relationship_count"),
                F.sum(F.when(F.col("source_id") == F.col("target_id"), 1).otherwise(0)).alias("self_loop_count")),
        _metric(alone, F.count(one).alias("isolated_node_count")),
        _metric(dup, F.count(one).alias("duplicate_id_count")),
        _metric(evidence, F.count(one).alias("evidence_node_count"), F.count("mode").alias("acquisition_mode_count"),
                F.count("cost").alias("evidence_cost_count"),
                F.coalesce(F.try_divide(F.count("mode"), F.count(one)), F.lit(0.0)).alias("acquisition_mode_coverage"),
                F.coalesce(F.try_divide(F.count("cost"), F.count(one)), F.lit(0.0)).alias("evidence_cost_coverage")),
        _metric(nodes.join(endpoints(edges).withColumn("_e", F.lit(1)), "node_id", "left"),
                F.coalesce(F.try_divide(F.sum(F.when(F.col("_e").isNull(), 1).otherwise(0)), F.count(one)), F.lit(0.0))
                .alias("isolated_node_ratio")),
        _keyed(nodes, "label", "label"),
        _keyed(edges, "relationship_type", "type"),
        _keyed(alone, "isolated_label", "label"),
        _keyed(nodes.where(F.col("label").isin(*deprecated) if deprecated else F.lit(False)), "deprecated_label", "label"),
        _keyed(nodes.where(~F.col("label").isin(*labels)), "unexpected_label", "label"),
        _keyed(edges.where(~F.col("type").isin(*types)), "unexpected_relationship_type", "type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def name_candidates(nodes: DataFrame) -> DataFrame:
    """Names per label by frequency: rows ``(label, name, n)``."""
    return nodes.select(clean_text(F.col("label")).alias("label"), clean_text(F.col("name")).alias("name")).where(
        "label IS NOT NULL AND name IS NOT NULL").groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))


def names_by_label(nodes: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Distinct names per label with the fixed label order and the case-insensitive sort key."""
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    name = F.coalesce(clean_text(F.col("canonical_name")), clean_text(F.col("name")))
    rows = nodes.select("label", name.alias("name")).where("label IS NOT NULL AND name IS NOT NULL").distinct()
    return rows.select(F.when(order > 0, order).otherwise(len(labels) + 1).cast("int").alias("label_order"), "label", "name",
                       F.lower("name").alias("sort_key"))


def graph_counts(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """Counts of nodes, edges and diseases as ``(metric, value)`` rows."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("label") == "Disease", 1)).alias("diseases"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    a = n.select(F.expr(f"stack(2, '{prefix}_nodes', nodes, '{prefix}_diseases', diseases) as (metric, value)"))
    return a.unionByName(e.select(F.lit(f"{prefix}_edges").alias("metric"), F.col("edges").alias("value")))
