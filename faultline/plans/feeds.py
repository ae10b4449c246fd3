"""Queries of sources, sinks, normalised texts and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.operators import lookup
from faultline.plans.registry import query
from faultline.sources import files, sinks
from faultline.sources.tables import Catalog

_AT = "2024-02-01T00:00:00+00:00"


@query(
    f"""WITH a AS (SELECT ordinal, row_number() OVER (PARTITION BY ordinal // 20 ORDER BY ordinal) AS idx, CASE WHEN ordinal % 7 <> 0 THEN concat(' Title ', article_id) END AS title, CASE WHEN ordinal % 11 = 0 THEN ' ' ELSE url END AS url,
    COALESCE(source_name, '') AS name, concat(' On ', article_id) AS des, CASE WHEN ordinal % 5 <> 0 THEN content END AS content, CASE WHEN ordinal % 13 <> 0 THEN concat('2024-01-', lpad(CAST(ordinal % 28 + 1 AS VARCHAR), 2, '0'), 'T08:15:30Z') END AS pub FROM news)
    SELECT concat('NEWSAPI-', regexp_replace(left(COALESCE(pub, '{_AT}'), 19), '[^0-9]', '', 'g'), '-', lpad(CAST(idx AS VARCHAR), 4, '0')) AS article_id, CASE WHEN name = '' THEN 'NewsAPI Publisher' ELSE name END AS source_name, '' AS author, trim(title) AS title, trim(des) AS description, url,
    COALESCE(pub, '{_AT}') AS published_at, regexp_replace(CASE WHEN content IS NULL OR content = '' THEN trim(des) ELSE content END, '^\\s+|\\s+$', '', 'g') AS content, concat('topic ', CAST(ordinal // 20 AS VARCHAR)) AS query, '{_AT}' AS retrieved_at, 'REAL_DATA' AS data_status FROM a WHERE title IS NOT NULL AND url <> ' '"""
)
def article_feed(k: Catalog) -> DataFrame:
    o = F.col("ordinal")
    fields = {
        "title": F.when(o % 7 != 0, F.concat(F.lit(" Title "), "article_id")),
        "url": F.when(o % 11 == 0, F.lit(" ")).otherwise(F.col("url")),
        "source": F.struct(F.col("source_name").alias("name")),
        "author": F.lit(None).cast("string"),
        "description": F.concat(F.lit(" On "), "article_id"),
        "content": F.when(o % 5 != 0, F.col("content")),
        "publishedAt": F.when(o % 13 != 0, F.concat(F.lit("2024-01-"), F.lpad((o % 28 + 1).cast("string"), 2, "0"), F.lit("T08:15:30Z"))),
    }
    rows = k.view("news").select(F.floor(o / 20).alias("g"), "ordinal", F.struct(*[v.alias(x) for x, v in fields.items()]).alias("a"))
    some = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("ordinal", "a"))).alias("s"))
    return files.articles(some.select(F.concat(F.lit("topic "), F.col("g").cast("string")).alias("query"), F.transform("s", lambda x: x["a"]).alias("articles")), F.lit(_AT))


def _terms(k: Catalog) -> DataFrame:
    return files.location_terms(k.view("locations").select("ordinal", "location_id", "location_name", F.col("country").alias("city")))


_TERMS = 'terms AS (SELECT ordinal * 2 AS "at", lower(location_name) AS term, location_id FROM locations UNION ALL SELECT ordinal * 2 + 1, lower(country), location_id FROM locations WHERE length(country) > 3)'


@query(f"WITH {_TERMS} SELECT * FROM terms")
def location_terms(k):
    return _terms(k)


@query(f"""WITH {_TERMS}, m AS (SELECT article_id, arg_min(location_id, terms."at") AS location_id FROM news JOIN terms ON contains(lower(content), term) GROUP BY 1) SELECT article_id, COALESCE(location_id, 'UNKNOWN') AS location_id FROM news LEFT JOIN m USING (article_id)""")
def location_match(k):
    return lookup.match_location(k.view("news"), _terms(k))


@query("SELECT DISTINCT name FROM (SELECT trim(supplier_name) AS name FROM suppliers UNION ALL SELECT trim(product_name) FROM products UNION ALL SELECT trim(location_name) FROM locations) WHERE length(name) > 2")
def catalog_names(k):
    s, p, v = k.view("suppliers"), k.view("products"), k.view("locations")
    return files.catalog_names(F.col("supplier_name"), F.col("product_name"), F.col("location_name"), of=[s, p, v])


@query("SELECT trim(concat(' ', CAST(p_partkey AS VARCHAR), ' ')) AS part_id, concat('a  ', p_name) AS evidence, replace(concat(p_name, ' x'), '  ', ' ') AS name, p_retailprice AS price FROM part")
def normalized_parts(k):
    p = k.table("part")
    return files.normalized(p.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" ")).alias("part_id"), F.concat(F.lit("a  "), "p_name").alias("evidence"), F.concat(F.lit("\t"), "p_name", F.lit(" \n x ")).alias("name"), F.col("p_retailprice").alias("price")))


@query("SELECT COALESCE(CAST(n_nationkey AS VARCHAR), '') AS n_nationkey, COALESCE(n_name, '') AS n_name, COALESCE(CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) END, '') AS n_regionkey FROM nation")
def api_records(k):
    return files.records(k.table("nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).alias("n_regionkey")))


@query(
    r"""WITH p AS (SELECT article_id, content AS t, strpos(content, 'er') - 1 AS a0 FROM news), q AS (SELECT article_id, t, greatest(0, a0 - 150) AS a, least(length(t), a0 + 2 + 150) AS b FROM p WHERE a0 >= 0),
    w AS (SELECT article_id, t, greatest(0, length(regexp_extract(substr(t, 1, a + 1), '(?s)^.*\s')) - 1) AS a, b + length(regexp_extract(substr(t, b + 1), '^\S*')) AS b FROM q) SELECT article_id, regexp_replace(substr(t, a + 1, b - a), '^\s+|\s+$', '', 'g') AS snippet FROM w"""
)
def context_windows(k):
    at = F.instr("content", "er") - 1
    return k.view("news").where(at >= 0).select("article_id", c.context_window(F.col("content"), at, at + 2).alias("snippet"))


@query(rf"SELECT supplier_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat(supplier_name, ', Group Ltd. & Co')), '\b({c.CORPORATE_WORDS})\b', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM suppliers")
def legacy_names(k):
    return k.view("suppliers").select("supplier_id", c.legacy_linking_text(F.concat("supplier_name", F.lit(", Group Ltd. & Co"))).alias("name"))


@query("SELECT supplier_id, CASE WHEN ordinal % 2 = 0 THEN 'LIVE / NEWSAPI' ELSE 'DEMO DATA' END AS status, CASE WHEN criticality IN ('Critical', 'High', 'Medium') THEN upper(criticality) ELSE 'LOW' END AS band FROM suppliers")
def badges(k):
    s = k.view("suppliers")
    return s.select("supplier_id", c.status_badge(F.when(F.col("ordinal") % 2 == 0, "real_data").otherwise("SYNTHETIC_DEMO")).alias("status"), c.band_badge(F.col("criticality")).alias("band"))


_SPOTS = "s AS (SELECT ordinal, concat(' ART', CAST(ordinal % 50 AS VARCHAR)) AS article_id, ordinal % 4 AS character_start, ordinal % 9 AS character_end FROM news)"


@query(f"WITH {_SPOTS} SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s h WHERE h.ordinal % 10 = 0 AND h.article_id = s.article_id AND h.character_start = s.character_start AND h.character_end = s.character_end)")
def append_entities(k):
    o = F.col("ordinal")
    s = k.view("news").select("ordinal", F.concat(F.lit(" ART"), (o % 50).cast("string")).alias("article_id"), (o % 4).alias("character_start"), (o % 9).alias("character_end"))
    return sinks.unseen(s, s.where("ordinal % 10 = 0"), sinks.entity_keys())


@query("SELECT supplier_id AS source, product_id AS target, 'RELATION' AS edge_type, round(share_percent / 100, 4) AS weight, 'SYNTHETIC_DEMO' AS data_status FROM supplier_products")
def export_edges(k):
    return sinks.export_edges(k.view("supplier_products").select(F.col("supplier_id").alias("source"), F.col("product_id").alias("target"), (F.col("share_percent") / 100).alias("weight")))


@query(
    f"SELECT (SELECT count(*) FROM news) AS articles_retrieved, (SELECT count(*) FROM news WHERE contains(content, 'port')) AS articles_relevant, count(*) AS alerts_generated, count(*) FILTER (criticality = 'Critical') AS critical_alerts, count(*) FILTER (criticality = 'High') AS high_alerts, 'GAT' AS model_used, '{_AT}' AS generated_at, 'SYNTHETIC_DEMO' AS data_status FROM suppliers"
)
def run_metrics(k):
    n, s = k.view("news"), k.view("suppliers").select(F.upper("criticality").alias("combined_risk_level"))
    return sinks.run_metrics(n.select("article_id"), n.where(F.col("content").contains("port")).select("article_id"), s, "gat", F.lit(_AT))


@query(
    """WITH s AS (SELECT supplier_id AS id, row_number() OVER (ORDER BY ordinal) AS rn FROM suppliers), p AS (SELECT product_id AS id, row_number() OVER (ORDER BY ordinal) AS rn FROM products)
    SELECT a.id AS source, b.id AS target, 'SUPPLIER_DEPENDS_ON_SUPPLIER' AS edge_type, 0.75::DOUBLE AS weight, 'SYNTHETIC_DEMO' AS data_status FROM s a JOIN s b ON a.rn = b.rn + 1 AND b.rn <= 500
    UNION ALL SELECT a.id, b.id, 'PRODUCT_DEPENDS_ON_PRODUCT', 0.70::DOUBLE, 'SYNTHETIC_DEMO' FROM p a JOIN p b ON a.rn = b.rn + 1 AND b.rn <= 400"""
)
def chain_edges(k):
    s = lookup.chain(k.view("suppliers"), 500, 0.75, "SUPPLIER_DEPENDS_ON_SUPPLIER", "supplier_id")
    return s.unionByName(lookup.chain(k.view("products"), 400, 0.70, "PRODUCT_DEPENDS_ON_PRODUCT", "product_id"))
