"""Driver tables and the domain views made of them. The view texts hold for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "locations": """SELECT CAST(n_nationkey AS BIGINT) AS ordinal, concat('LOC', CAST(n_nationkey AS STRING)) AS location_id, concat(n_name, ' Hub') AS location_name,
        n_name AS country, r_name AS region, CAST((n_nationkey * 37 + 11) % 160 AS DOUBLE) - 80 AS latitude, CAST((n_nationkey * 73 + 29) % 340 AS DOUBLE) - 170 AS longitude
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "suppliers": """SELECT s_suppkey AS ordinal, concat('SUP', CAST(s_suppkey AS STRING)) AS supplier_id, s_name AS supplier_name, n_name AS country,
        CAST((n_nationkey * 37 + 11) % 160 AS DOUBLE) - 80 + CAST(s_suppkey % 7 AS DOUBLE) / 10 AS latitude,
        CAST((n_nationkey * 73 + 29) % 340 AS DOUBLE) - 170 + CAST(s_suppkey % 11 AS DOUBLE) / 10 AS longitude,
        CAST(s_suppkey % 3 + 1 AS INT) AS tier, CASE WHEN s_acctbal < 0 THEN 'Low' WHEN s_acctbal < 3000 THEN 'Medium' WHEN s_acctbal < 7000 THEN 'High' ELSE 'Critical' END AS criticality,
        s_suppkey % 4 = 0 AS single_source FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "products": """SELECT p_partkey AS ordinal, concat('PRD', CAST(p_partkey AS STRING)) AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category,
        CASE WHEN p_retailprice < 1000 THEN 'Low' WHEN p_retailprice < 1400 THEN 'Medium' WHEN p_retailprice < 1800 THEN 'High' ELSE 'Critical' END AS criticality FROM part""",
    "supplier_products": """SELECT concat('SUP', CAST(l_suppkey AS STRING)) AS supplier_id, concat('PRD', CAST(l_partkey AS STRING)) AS product_id,
        q, CASE WHEN 100 * q < 10 * t THEN 'Low' WHEN 100 * q < 30 * t THEN 'Medium' WHEN 100 * q < 60 * t THEN 'High' ELSE 'Critical' END AS dependency_level, round(100 * q / t, 2) AS share_percent
        FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey, l_partkey) a
        JOIN (SELECT l_partkey AS k, sum(l_quantity) AS t FROM lineitem GROUP BY l_partkey) b ON l_partkey = k""",
    "supplier_locations": """SELECT DISTINCT concat('SUP', CAST(l_suppkey AS STRING)) AS supplier_id, concat('LOC', CAST(c_nationkey AS STRING)) AS location_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "incidents": """SELECT event_id, concat('LOC', CAST(user_id % 25 AS STRING)) AS location_id, CAST(floor(abs(value)) AS BIGINT) % 5 + 1 AS severity, event_type, ts AS event_time FROM events""",
    "news": """SELECT doc_id AS ordinal, concat('ART', CAST(doc_id AS STRING)) AS article_id, source AS source_name, concat('https://news.example/', CAST(doc_id % 700 AS STRING)) AS url,
        concat(CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN 'Severe port closure halts cargo at the terminal. ' WHEN 1 THEN 'A factory shutdown was minor and temporary. ' WHEN 2 THEN 'Dockworker strike blocks freight. '
        WHEN 3 THEN 'Ransomware attack on a supplier. ' WHEN 4 THEN 'Catastrophic earthquake hits a plant. ' WHEN 5 THEN 'Celebrity gossip and sports. ' WHEN 6 THEN 'Flooding delays shipments. '
        WHEN 7 THEN 'Tropical storm nears the harbor. ' WHEN 8 THEN 'Warehouse fire, brief delay. ' ELSE 'Quiet day. ' END, text) AS content FROM documents""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


class Catalog:
    """Tables and domain views of one folder; a missing table is an error where it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        import re

        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB text with the views it names in front."""
    import re

    need = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    if not need:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
