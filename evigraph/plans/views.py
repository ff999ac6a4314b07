"""Binding of the evidence-graph data model to the given tables.

``Tables`` builds each view as a DataFrame; ``VIEW_SQL`` states the same view as SQL for
the checking engine.  Weights are kept as whole hundredths next to the float so that
sums never depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_id, map_value
from ..functions.vocab import FORWARD_CONFIDENCE, REVERSE_CONFIDENCE

# p_type has six values; each stands for one evidence group.
TYPE_LABEL = {
    "ECONOMY": "ClinicalFinding",
    "STANDARD": "RiskFactor",
    "PROMO": "ClinicalAttribute",
    "LARGE": "LabFinding",
    "MEDIUM": "ImagingFinding",
    "SMALL": "Pathogen",
}
TYPE_RELATION = {
    "ECONOMY": "MANIFESTS_AS",
    "STANDARD": "RISK_FACTOR_FOR",
    "PROMO": "REQUIRES_DETAIL",
    "LARGE": "HAS_LAB_FINDING",
    "MEDIUM": "HAS_IMAGING_FINDING",
    "SMALL": "HAS_PATHOGEN",
}
TYPE_GROUP = {
    "ECONOMY": "symptom",
    "STANDARD": "risk",
    "PROMO": "detail",
    "LARGE": "lab",
    "MEDIUM": "imaging",
    "SMALL": "pathogen",
}
TYPE_MODE = {
    "ECONOMY": "direct_ask",
    "STANDARD": "direct_ask",
    "PROMO": "direct_ask",
    "LARGE": "needs_lab_test",
    "MEDIUM": "needs_imaging",
    "SMALL": "needs_pathogen_test",
}
TYPE_COST = {
    "ECONOMY": "low",
    "STANDARD": "low",
    "PROMO": "low",
    "LARGE": "high",
    "MEDIUM": "high",
    "SMALL": "high",
}
FLAG_POLARITY = {"R": "present", "A": "absent", "N": "unclear"}
STATUS_RESOLUTION = {"F": "clear", "O": "hedged"}
CASE_STATUS = {"F": "completed", "P": "max_turn_reached", "O": "failed"}
CASE_TYPE = {
    "1-URGENT": "competitive",
    "2-HIGH": "exam_driven",
    "3-MEDIUM": "low_cost",
    "4-NOT SPECIFIED": "ordinary",
    "5-LOW": "",
}


# Lines of the line table whose evidence one task sorts at most.
TASK_LINES = 250_000


def sql_case(col: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


class Tables:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_lines(self) -> int:
        return self.raw("lineitem").count()

    def deal(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df``, about a row per line, dealt by ``keys`` over so many tasks that a task holds ``TASK_LINES`` rows, whatever the input.

        Where the session's own number of tasks is enough, nothing is moved.
        """
        n = -(-self.n_lines // TASK_LINES)
        return df if n <= int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)

    # -- graph -----------------------------------------------------------------------
    @cached_property
    def kg_evidence(self) -> DataFrame:
        p = self.raw("part")
        t = F.col("p_type")
        return p.select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node_id"),
            map_value(t, TYPE_LABEL).alias("label"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            (F.col("p_size") * 2).cast("bigint").alias("w100"),
            map_value(t, TYPE_GROUP).alias("grp"),
            map_value(t, TYPE_MODE).alias("mode"),
            map_value(t, TYPE_COST).alias("cost"),
            map_value(t, TYPE_RELATION).alias("rel"),
        )

    @cached_property
    def kg_disease(self) -> DataFrame:
        s = self.raw("supplier")
        capped = F.greatest(F.least(F.col("s_acctbal"), F.lit(10000.0)), F.lit(0.0))
        return s.select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"),
            F.lit("Disease").alias("label"),
            F.col("s_name").alias("name"),
            F.floor(capped / 100.0).cast("bigint").alias("w100"),
        )

    @cached_property
    def kg_node(self) -> DataFrame:
        null = F.lit(None).cast("string")
        ev = self.kg_evidence.select("node_id", "label", "name", "w100", "grp", "mode", "cost")
        ds = self.kg_disease.select(
            "node_id", "label", "name", "w100", null.alias("grp"), null.alias("mode"), null.alias("cost"))
        return ds.unionByName(ev)

    @cached_property
    def kg_pair(self) -> DataFrame:
        return self.pairs(self.raw("lineitem"))

    def pairs(self, li: DataFrame) -> DataFrame:
        """One row per linked disease and evidence node, whatever the edge direction."""
        pairs = li.groupBy("l_suppkey", "l_partkey").agg(
            F.count(F.lit(1)).alias("n_occ"),
            F.max(F.round(F.col("l_discount") * 1000).cast("bigint")).alias("w100"),
        )
        return pairs.select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("disease_id"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("evidence_id"),
            "w100", "n_occ",
        )

    @cached_property
    def kg_edge(self) -> DataFrame:
        return self.edges(self.kg_pair)

    def edges(self, pairs: DataFrame) -> DataFrame:
        """Directed edges; risk factors and every second size point at the disease, the rest away from it."""
        ev = self.kg_evidence.select(F.col("node_id").alias("evidence_id"), "rel", "label", F.col("w100").alias("_size"))
        e = pairs.join(ev, "evidence_id")
        into = (F.col("rel") == "RISK_FACTOR_FOR") | (F.col("_size") % 4 == 0)
        return e.select(
            F.when(into, F.col("evidence_id")).otherwise(F.col("disease_id")).alias("src"),
            F.when(into, F.col("disease_id")).otherwise(F.col("evidence_id")).alias("dst"),
            "rel",
            F.when(into, F.col("label")).otherwise("Disease").alias("src_label"),
            F.when(into, F.lit("Disease")).otherwise(F.col("label")).alias("dst_label"),
            "w100", "n_occ",
        )

    @cached_property
    def g_node(self) -> DataFrame:
        """Merged graph: one node per label and name."""
        rows = self.kg_node.withColumn("canonical", F.col("name"))
        return rows.groupBy("label", F.col("canonical").alias("canonical_name")).agg(
            F.count(F.lit(1)).alias("occurrence_count"), F.max("w100").alias("w100"),
        ).select(
            hash_id("merged_node_", F.concat_ws("::", "label", "canonical_name")).alias("node_id"),
            "label", F.col("canonical_name").alias("name"), "canonical_name", "occurrence_count", "w100",
            F.when(F.col("occurrence_count") > 5, "full").when(F.col("occurrence_count") > 2, "standard")
            .otherwise("minimal").alias("detail"),
        )

    @cached_property
    def g_edge(self) -> DataFrame:
        name = self.kg_node.select(
            "node_id", hash_id("merged_node_", F.concat_ws("::", "label", "name")).alias("gid"))
        e = self.kg_edge.join(name.toDF("src", "source_id"), "src").join(name.toDF("dst", "target_id"), "dst")
        return e.groupBy(F.col("rel").alias("type"), "source_id", "target_id").agg(
            F.sum("n_occ").alias("occurrence_count"), F.max("w100").alias("w100"),
        ).select(
            hash_id("merged_edge_", F.col("type"), F.col("source_id"), F.col("target_id"), F.lit("")).alias("edge_id"),
            "type", "source_id", "target_id", "occurrence_count", "w100",
        )

    @cached_property
    def delete_name(self) -> DataFrame:
        """Names to delete: attributes whose name starts with 'old', and one name nobody uses."""
        p = self.raw("part").where((F.col("p_type") == "PROMO") & F.col("p_name").startswith("old "))
        return p.select(F.lit("ClinicalAttribute").alias("label"), F.col("p_name").alias("name")).distinct()

    @cached_property
    def reclass_rule(self) -> DataFrame:
        """(label, name, action): relabel or delete; the brand-based rows match no node name."""
        p = self.raw("part")
        move = p.where((F.col("p_type") == "STANDARD") & F.col("p_name").startswith("new ")).select(
            F.lit("RiskFactor").alias("label"), F.col("p_name").alias("name"), F.lit("ClinicalFinding").alias("action"))
        drop = p.where((F.col("p_type") == "SMALL") & F.col("p_name").startswith("cold ")).select(
            F.lit("Pathogen").alias("label"), F.col("p_name").alias("name"), F.lit("DELETE").alias("action"))
        unused = p.select(F.lit("LabFinding").alias("label"), F.col("p_brand").alias("name"),
                          F.lit("ImagingFinding").alias("action"))
        return move.unionByName(drop).unionByName(unused).distinct()

    # -- observations ----------------------------------------------------------------
    @cached_property
    def obs(self) -> DataFrame:
        """Turn log of the sessions; unique order within a session is (turn, pk, sk)."""
        li = self.raw("lineitem")
        return li.select(
            F.col("l_orderkey").alias("session_id"),
            F.col("l_linenumber").alias("turn"),
            F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("sk"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("node_id"),
            map_value(F.col("l_returnflag"), FLAG_POLARITY).alias("polarity"),
            map_value(F.col("l_linestatus"), STATUS_RESOLUTION).alias("resolution"),
        )

    # -- extraction records ------------------------------------------------------------
    @cached_property
    def chunk_line(self) -> DataFrame:
        li = self.raw("lineitem").join(
            self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return li.select(
            F.col("l_orderkey").alias("chunk_id"),
            F.col("l_linenumber").alias("pos"),
            F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("sk"),
            F.concat(F.lit("guide_"), F.year("l_shipdate").cast("string"), F.lit(".md")).alias("path"),
            F.col("p_name").alias("p_name"),
            F.col("p_brand").alias("p_brand"),
            map_value(F.col("p_type"), TYPE_LABEL).alias("label"),
            map_value(F.col("p_type"), TYPE_RELATION).alias("rel"),
            (F.col("p_size") * 2).cast("bigint").alias("node_w100"),
            F.round(F.col("l_discount") * 1000).cast("bigint").alias("edge_w100"),
            F.when(F.col("l_returnflag") == "A", "minimal").when(F.col("l_returnflag") == "N", "standard")
            .otherwise("full").alias("detail"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_linestatus").alias("linestatus"),
        )

    @cached_property
    def chunk_node(self) -> DataFrame:
        """Node mentions: every part of a line; the supplier only where the quantity is 10 or more."""
        line = self.chunk_line
        parts = line.select(
            "chunk_id", "pos", "pk", "sk", "path",
            F.concat(F.lit("P"), F.col("pk").cast("string")).alias("local_id"),
            "label", F.col("p_name").alias("name"), F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")).alias("alt_name"),
            F.col("node_w100").alias("w100"), "detail")
        sups = line.where(F.col("quantity") >= 10).select(
            "chunk_id", "pos", "pk", "sk", "path",
            F.concat(F.lit("S"), F.col("sk").cast("string")).alias("local_id"),
            F.lit("Disease").alias("label"),
            F.concat(F.lit("Supplier#"), F.lpad(F.col("sk").cast("string"), 9, "0")).alias("name"),
            F.lit(None).cast("string").alias("alt_name"), F.col("edge_w100").alias("w100"), "detail")
        return parts.unionByName(sups)

    @cached_property
    def chunk_edge(self) -> DataFrame:
        return self.chunk_line.select(
            "chunk_id", "pos", "pk", "sk", "path", "rel",
            F.concat_ws("_", F.lit("e"), "pos", "pk", "sk").alias("edge_id"),
            F.concat(F.lit("S"), F.col("sk").cast("string")).alias("source_id"),
            F.concat(F.lit("P"), F.col("pk").cast("string")).alias("target_id"),
            F.col("edge_w100").alias("w100"), "detail", "linestatus")

    @cached_property
    def alias_file(self) -> DataFrame:
        """Alias dictionaries (file, label, canonical, alias); the last file disagrees with the first."""
        p = self.raw("part").select(
            map_value(F.col("p_type"), TYPE_LABEL).alias("label"), F.col("p_name").alias("alias")).distinct()
        head, noun = F.substring_index("alias", " ", 1), F.substring_index("alias", " ", -1)
        first = p.where(head.isin("red", "blue", "large", "small")).select(
            F.lit(1).alias("file"), "label",
            F.concat_ws(" ", F.when(head.isin("red", "blue"), "blue").otherwise("large"), noun).alias("canonical"),
            "alias")
        second = p.where((head == "red") & noun.isin("gear", "bolt")).select(
            F.lit(2).alias("file"), "label", F.concat_ws(" ", F.lit("hot"), noun).alias("canonical"), "alias")
        return first.unionByName(second)

    # -- replay ------------------------------------------------------------------------
    @cached_property
    def replay(self) -> DataFrame:
        """Cases with their recorded result; final answer and truth are part names."""
        o = self.raw("orders")
        price = F.col("o_totalprice")
        return o.select(
            F.col("o_orderkey").alias("case_id"),
            map_value(F.col("o_orderstatus"), CASE_STATUS).alias("status"),
            map_value(F.col("o_orderpriority"), CASE_TYPE).alias("case_type"),
            F.when(price >= 300000, "eligible").when(price >= 150000, "weak").when(price >= 50000, "not_eligible")
            .otherwise("").alias("case_qc_status"),
            F.when(F.year("o_orderdate") < 1997, "passed").otherwise("").alias("benchmark_qc_status"),
            F.col("o_orderdate").alias("finished_at"),
            price.alias("price"),
            F.round(price * 100).cast("bigint").alias("total_cents"),
        )

    @cached_property
    def replay_turn(self) -> DataFrame:
        li = self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        return li.select(
            F.col("l_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("turn"),
            F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("sk"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("node_id"),
            F.col("p_name").alias("answer_name"),
            map_value(F.col("p_type"), TYPE_GROUP).alias("grp"),
            map_value(F.col("p_type"), TYPE_COST).alias("cost"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
            .alias("revealed_id"),
            (F.col("l_returnflag") == "R").alias("truth_hit"),
            (F.col("l_linestatus") == "F").alias("verifier_called"),
            ((F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 25)).alias("accepted"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("l_shipdate").alias("ts"),
        )

    # -- documents -----------------------------------------------------------------------
    @cached_property
    def page_md(self) -> DataFrame:
        """Pages as Markdown: heading tags become '#' lines, other tags line breaks."""
        html = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", "")
        for level in range(1, 7):
            html = F.regexp_replace(html, f"<h{level}[^>]*>", "\n" + "#" * level + " ")
        html = F.regexp_replace(html, "<[^>]*>", "\n")
        return self.raw("pages").select("page_id", html.alias("md"))


VIEW_SQL: dict[str, str] = {
    "kg_evidence": f"""
SELECT 'P' || p_partkey AS node_id, {sql_case('p_type', TYPE_LABEL)} AS label, p_name AS name,
       p_brand AS brand, CAST(p_size * 2 AS BIGINT) AS w100, {sql_case('p_type', TYPE_GROUP)} AS grp,
       {sql_case('p_type', TYPE_MODE)} AS mode, {sql_case('p_type', TYPE_COST)} AS cost,
       {sql_case('p_type', TYPE_RELATION)} AS rel
FROM part""",
    "kg_disease": """
SELECT 'S' || s_suppkey AS node_id, 'Disease' AS label, s_name AS name,
       CAST(floor(greatest(least(s_acctbal, CAST(10000 AS DOUBLE)), CAST(0 AS DOUBLE)) / 100) AS BIGINT) AS w100
FROM supplier""",
    "kg_node": """
SELECT node_id, label, name, w100, NULL AS grp, NULL AS mode, NULL AS cost FROM kg_disease
UNION ALL SELECT node_id, label, name, w100, grp, mode, cost FROM kg_evidence""",
    "kg_pair": """
SELECT 'S' || l_suppkey AS disease_id, 'P' || l_partkey AS evidence_id,
       max(CAST(round(l_discount * 1000) AS BIGINT)) AS w100, count(*) AS n_occ
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "kg_edge": """
SELECT CASE WHEN rel = 'RISK_FACTOR_FOR' OR e.w100 % 4 = 0 THEN evidence_id ELSE disease_id END AS src,
       CASE WHEN rel = 'RISK_FACTOR_FOR' OR e.w100 % 4 = 0 THEN disease_id ELSE evidence_id END AS dst,
       rel, CASE WHEN rel = 'RISK_FACTOR_FOR' OR e.w100 % 4 = 0 THEN label ELSE 'Disease' END AS src_label,
       CASE WHEN rel = 'RISK_FACTOR_FOR' OR e.w100 % 4 = 0 THEN 'Disease' ELSE label END AS dst_label, p.w100, p.n_occ
FROM kg_pair p JOIN kg_evidence e ON e.node_id = p.evidence_id""",
    "g_node": """
SELECT 'merged_node_' || substr(sha1(label || '::' || name), 1, 12) AS node_id, label, name, name AS canonical_name,
       count(*) AS occurrence_count, max(w100) AS w100,
       CASE WHEN count(*) > 5 THEN 'full' WHEN count(*) > 2 THEN 'standard' ELSE 'minimal' END AS detail
FROM kg_node GROUP BY label, name""",
    "g_edge": """
SELECT 'merged_edge_' || substr(sha1(type || '|' || source_id || '|' || target_id || '|'), 1, 12) AS edge_id, *
FROM (SELECT rel AS type, 'merged_node_' || substr(sha1(a.label || '::' || a.name), 1, 12) AS source_id,
             'merged_node_' || substr(sha1(b.label || '::' || b.name), 1, 12) AS target_id,
             CAST(sum(n_occ) AS BIGINT) AS occurrence_count, max(e.w100) AS w100
      FROM kg_edge e JOIN kg_node a ON a.node_id = e.src JOIN kg_node b ON b.node_id = e.dst GROUP BY 1, 2, 3)""",
    "delete_name": """
SELECT DISTINCT 'ClinicalAttribute' AS label, p_name AS name FROM part WHERE p_type = 'PROMO' AND p_name LIKE 'old %'""",
    "reclass_rule": """
SELECT DISTINCT 'RiskFactor' AS label, p_name AS name, 'ClinicalFinding' AS action FROM part
WHERE p_type = 'STANDARD' AND p_name LIKE 'new %'
UNION SELECT 'Pathogen', p_name, 'DELETE' FROM part WHERE p_type = 'SMALL' AND p_name LIKE 'cold %'
UNION SELECT 'LabFinding', p_brand, 'ImagingFinding' FROM part""",
    "kg_link": f"""
SELECT dst AS candidate_id, src AS feature_id, rel, w100, 100 AS dir100 FROM kg_edge WHERE dst LIKE 'S%'
UNION SELECT src, dst, rel, w100, 65 FROM kg_edge WHERE src LIKE 'S%'""",
    "obs": f"""
SELECT l_orderkey AS session_id, l_linenumber AS turn, l_partkey AS pk, l_suppkey AS sk,
       'P' || l_partkey AS node_id, {sql_case('l_returnflag', FLAG_POLARITY)} AS polarity,
       {sql_case('l_linestatus', STATUS_RESOLUTION)} AS resolution
FROM lineitem""",
    "chunk_line": f"""
SELECT l_orderkey AS chunk_id, l_linenumber AS pos, l_partkey AS pk, l_suppkey AS sk,
       'guide_' || year(l_shipdate) || '.md' AS path, p_name, p_brand,
       {sql_case('p_type', TYPE_LABEL)} AS label, {sql_case('p_type', TYPE_RELATION)} AS rel,
       CAST(p_size * 2 AS BIGINT) AS node_w100, CAST(round(l_discount * 1000) AS BIGINT) AS edge_w100,
       CASE l_returnflag WHEN 'A' THEN 'minimal' WHEN 'N' THEN 'standard' ELSE 'full' END AS detail,
       l_quantity AS quantity, l_linestatus AS linestatus
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "chunk_node": """
SELECT chunk_id, pos, pk, sk, path, 'P' || pk AS local_id, label, p_name AS name, p_brand || ' ' || p_name AS alt_name,
       node_w100 AS w100, detail FROM chunk_line
UNION ALL
SELECT chunk_id, pos, pk, sk, path, 'S' || sk, 'Disease', 'Supplier#' || lpad(CAST(sk AS VARCHAR), 9, '0'), NULL,
       edge_w100, detail FROM chunk_line WHERE quantity >= 10""",
    "chunk_edge": """
SELECT chunk_id, pos, pk, sk, path, rel, 'e_' || pos || '_' || pk || '_' || sk AS edge_id,
       'S' || sk AS source_id, 'P' || pk AS target_id, edge_w100 AS w100, detail, linestatus FROM chunk_line""",
    "alias_file": f"""
SELECT 1 AS file, label, CASE WHEN split_part(alias, ' ', 1) IN ('red','blue') THEN 'blue' ELSE 'large' END
       || ' ' || split_part(alias, ' ', 2) AS canonical, alias
FROM (SELECT DISTINCT {sql_case('p_type', TYPE_LABEL)} AS label, p_name AS alias FROM part)
WHERE split_part(alias, ' ', 1) IN ('red','blue','large','small')
UNION ALL
SELECT 2, label, 'hot ' || split_part(alias, ' ', 2), alias
FROM (SELECT DISTINCT {sql_case('p_type', TYPE_LABEL)} AS label, p_name AS alias FROM part)
WHERE split_part(alias, ' ', 1) = 'red' AND split_part(alias, ' ', 2) IN ('gear','bolt')""",
    "replay": f"""
SELECT o_orderkey AS case_id, {sql_case('o_orderstatus', CASE_STATUS)} AS status,
       {sql_case('o_orderpriority', CASE_TYPE)} AS case_type,
       CASE WHEN o_totalprice >= 300000 THEN 'eligible' WHEN o_totalprice >= 150000 THEN 'weak'
            WHEN o_totalprice >= 50000 THEN 'not_eligible' ELSE '' END AS case_qc_status,
       CASE WHEN year(o_orderdate) < 1997 THEN 'passed' ELSE '' END AS benchmark_qc_status,
       o_orderdate AS finished_at, o_totalprice AS price, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents
FROM orders""",
    "replay_turn": f"""
SELECT l_orderkey AS case_id, l_linenumber AS turn, l_partkey AS pk, l_suppkey AS sk, 'P' || l_partkey AS node_id,
       p_name AS answer_name, {sql_case('p_type', TYPE_GROUP)} AS grp, {sql_case('p_type', TYPE_COST)} AS cost,
       CASE WHEN l_returnflag = 'R' THEN 'P' || l_partkey END AS revealed_id, l_returnflag = 'R' AS truth_hit,
       l_linestatus = 'F' AS verifier_called, l_linestatus = 'F' AND l_quantity >= 25 AS accepted,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS quantity, l_shipdate AS ts
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "page_md": r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
       regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'),
       '<h1[^>]*>', chr(10) || '# ', 'g'), '<h2[^>]*>', chr(10) || '## ', 'g'),
       '<h3[^>]*>', chr(10) || '### ', 'g'), '<h4[^>]*>', chr(10) || '#### ', 'g'),
       '<h5[^>]*>', chr(10) || '##### ', 'g'), '<h6[^>]*>', chr(10) || '###### ', 'g'),
       '<[^>]*>', chr(10), 'g') AS md FROM pages""",
}
