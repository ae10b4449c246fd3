"""Queries of linking, alert records, explanations, audits, features and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.operators import alerts, linking
from faultline.operators import engine as op
from faultline.plans import registry as r
from faultline.plans.registry import query
from faultline.sources.tables import Catalog


def _case(x: str, names: dict[str, str], otherwise: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items()) + f" ELSE {otherwise} END"


def _norm(x: str, corporate: bool) -> str:
    t = f"trim(lower(COALESCE({x}, '')))"
    t = rf"CASE WHEN regexp_matches({t}, '^port\s+') THEN trim(regexp_replace({t}, '^port\s+(of\s+)?', '')) || ' port' ELSE {t} END"
    for _ in range(linking.ROUNDS if corporate else 0):
        t = rf"trim(regexp_replace(regexp_replace({t}, '{linking.CORPORATE}', '', 'g'), '[\s,.;:-]+$', ''))"
    t = _case(f"({t})", linking.COUNTRIES, f"({t})")
    return rf"trim(regexp_replace(regexp_replace({t}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _nums(x: str) -> str:
    n = rf"regexp_extract_all({x}, '\b(\d+)\b', 1)"
    return rf"list_distinct(list_concat({n}, list_transform({n}, lambda d: regexp_replace(d, '^0+([0-9])', '\1'))))"


def _cascade(mentions: str, master: str, kind: str) -> str:
    """The stages but the fuzzy one; ``master`` selects id, name and the alias columns."""
    sup = kind == "SUPPLIER"
    extra = {"LOCATION": f", {_norm('country', False)} AS alias", "PRODUCT": f", {_norm('category', False)} AS alias"}.get(kind, "")
    free = "NOT (len(m.nums) > 0 AND len(s.nums) > 0 AND NOT list_has_any(m.nums, s.nums))"
    ratio = "least(length(m.norm), length(s.norm))::DOUBLE / greatest(length(m.norm), length(s.norm))"
    third = {
        "SUPPLIER": f"SELECT mention, 3, round(0.90::DOUBLE * ({ratio}), 3), s.id, 'alias' FROM m JOIN s ON s.norm <> '' AND length(m.norm) > 3 AND (contains(s.norm, m.norm) OR contains(m.norm, s.norm)) AND {free} AND {ratio} >= 0.80",
        "LOCATION": f"SELECT mention, 3, 0.92::DOUBLE, s.id, 'alias' FROM m JOIN s ON s.alias <> '' AND {_case('m.low', linking.COUNTRIES, 'm.norm')} = s.alias",
        "PRODUCT": "SELECT mention, 3, 0.88::DOUBLE, s.id, 'alias' FROM m JOIN s ON s.alias <> '' AND m.norm = s.alias",
    }[kind]
    return f"""WITH m AS MATERIALIZED (SELECT mention, lower(mention) AS low, upper(mention) AS uid, {_norm("mention", sup)} AS norm, {_nums("mention")} AS nums FROM (SELECT DISTINCT trim(mention) AS mention FROM ({mentions}) WHERE trim(mention) <> '')),
    s AS MATERIALIZED (SELECT id, lower(trim(name)) AS low, {_norm("name", sup)} AS norm, {_nums("name")} AS nums{extra} FROM ({master})),
    x(mention, stage, score, id, method) AS (SELECT mention, 1, 1.0::DOUBLE, s.id, 'exact' FROM m JOIN s ON m.low = s.low UNION ALL SELECT mention, 1, 1.0::DOUBLE, s.id, 'exact' FROM m JOIN s ON m.uid = s.id
      UNION ALL SELECT mention, 2, 0.98::DOUBLE, s.id, 'normalized' FROM m JOIN s ON m.norm = s.norm AND m.norm <> '' AND {free} UNION ALL {third}),
    b AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY stage, id) AS rn FROM x),
    links AS (SELECT m.mention, '{kind}' AS entity_type, COALESCE(b.id, 'UNKNOWN') AS linked_id, COALESCE(b.method, 'unresolved') AS match_method, round(COALESCE(b.score, 0.0), 3)::DOUBLE AS match_score,
      round(CASE b.method WHEN 'exact' THEN 0.98::DOUBLE WHEN 'normalized' THEN least(0.96::DOUBLE, 0.92::DOUBLE + (b.score - 0.90::DOUBLE) * 0.4::DOUBLE) WHEN 'alias' THEN least(0.92::DOUBLE, 0.88::DOUBLE + (b.score - 0.80::DOUBLE) * 0.3::DOUBLE) ELSE 0.0::DOUBLE END, 3)::DOUBLE AS confidence
      FROM m LEFT JOIN b ON m.mention = b.mention AND rn = 1)"""


_SUP_MENTIONS = "SELECT CASE WHEN ordinal % 3 = 0 THEN upper(supplier_name) WHEN ordinal % 3 = 1 THEN concat(supplier_name, ' Ltd.') ELSE concat('Nobody ', supplier_name) END AS mention FROM suppliers UNION ALL SELECT concat('9', supplier_name, ' x') FROM suppliers UNION ALL SELECT lower(supplier_id) FROM suppliers UNION ALL SELECT concat(supplier_name, 's') FROM suppliers"
_SUP = _cascade(_SUP_MENTIONS, "SELECT supplier_id AS id, supplier_name AS name FROM suppliers", "SUPPLIER")


def _suppliers(k: Catalog) -> DataFrame:
    s = k.view("suppliers")
    odd = F.when(F.col("ordinal") % 3 == 0, F.upper("supplier_name")).when(F.col("ordinal") % 3 == 1, F.concat("supplier_name", F.lit(" Ltd."))).otherwise(F.concat(F.lit("Nobody "), "supplier_name"))
    m = s.select(odd.alias("mention")).unionByName(s.select(F.concat(F.lit("9"), "supplier_name", F.lit(" x")).alias("mention"))).unionByName(s.select(F.lower("supplier_id").alias("mention"))).unionByName(s.select(F.concat("supplier_name", F.lit("s")).alias("mention")))
    return linking.link(m, s.select(F.col("supplier_id").alias("id"), F.col("supplier_name").alias("name")), "SUPPLIER", fuzzy=False)


@query(_SUP + " SELECT * FROM links")
def link_suppliers(k):
    return _suppliers(k)


@query(
    _SUP
    + """ SELECT count(*) AS total_entities, count(*) FILTER (match_method = 'exact') AS exact_matches, count(*) FILTER (match_method = 'normalized') AS normalized_matches, count(*) FILTER (match_method = 'alias') AS alias_matches,
    count(*) FILTER (match_method = 'fuzzy') AS fuzzy_matches, count(*) FILTER (match_method = 'unresolved') AS unresolved_entities, (20 * sum(round(confidence * 1000)::BIGINT) + count(*))::BIGINT // (2 * count(*)) / 10000.0::DOUBLE AS average_confidence, printf('%.1f%%', round(100.0::DOUBLE * count(*) FILTER (match_method = 'unresolved') / count(*), 1)) AS unresolved_percentage FROM links"""
)
def link_quality(k):
    return linking.link_report(_suppliers(k))


@query(_cascade("SELECT country AS mention FROM locations UNION ALL SELECT lower(location_name) FROM locations UNION ALL SELECT location_id FROM locations UNION ALL SELECT unnest(['usa', 'U.K.', 'prc', 'Atlantis', 'Port of China'])", "SELECT location_id AS id, location_name AS name, country FROM locations", "LOCATION") + " SELECT * FROM links")
def link_locations(k):
    v = k.view("locations")
    m = v.select(F.col("country").alias("mention")).unionByName(v.select(F.lower("location_name").alias("mention"))).unionByName(v.select(F.col("location_id").alias("mention")))
    m = m.unionByName(k.spark.createDataFrame([(x,) for x in ("usa", "U.K.", "prc", "Atlantis", "Port of China")], "mention string"))
    return linking.link(m, v.select(F.col("location_id").alias("id"), F.col("location_name").alias("name"), F.lit("").alias("city"), "country"), "LOCATION", fuzzy=False)


@query(_cascade("SELECT upper(product_name) AS mention FROM products UNION ALL SELECT concat(product_name, '!') FROM products UNION ALL SELECT category FROM products", "SELECT product_id AS id, product_name AS name, category FROM products", "PRODUCT") + " SELECT * FROM links")
def link_products(k):
    v = k.view("products")
    m = v.select(F.upper("product_name").alias("mention")).unionByName(v.select(F.concat("product_name", F.lit("!")).alias("mention"))).unionByName(v.select(F.col("category").alias("mention")))
    return linking.link(m, v.select(F.col("product_id").alias("id"), F.col("product_name").alias("name"), "category"), "PRODUCT", fuzzy=False)


# --- alerts and explanations

_TEXT = f"concat('Supplier:', chr(10), supplier_id, ' (Supplier ', supplier_id, ')', chr(10), chr(10), 'Risk:', chr(10), band, chr(10), chr(10), 'Reasons:', chr(10), '* ', replace(reasons, '; ', chr(10) || '* '), chr(10), chr(10), '{alerts.BANDS_DISCLAIMER}')"


def _records(k: Catalog) -> DataFrame:
    names = {"supplier_id": "supplier_id", "first_event": "event_id", "risk_norm": "deterministic_risk", "first": "graphsage_risk", "second": "gat_risk", "f_severity": "event_severity", "exposure": "geographic_exposure", "f_dependency": "dependency_strength", "f_product": "product_criticality", "single": "single_source"}
    return r._alert_input(k).select(*[F.col(x).alias(y) for x, y in names.items()])


@query(
    r._ALERTS
    + f""" SELECT concat('ALT-', first_event, '-', supplier_id) AS alert_id, supplier_id, concat('Supplier ', supplier_id) AS supplier_name, CAST(first_event AS VARCHAR) AS event_id, 'Operational Disruption' AS event_type, round(risk_norm, 4) AS deterministic_risk,
    round(first, 4) AS graphsage_risk, round(second, 4) AS gat_risk, norm AS combined_risk, score AS risk_score_100, band AS risk_band, reasons, 'SYNTHETIC_DEMO' AS data_status, {_TEXT} AS explanation FROM al"""
)
def alert_records(k):
    return alerts.generate_alerts(_records(k))


@query(r._RISK + f", g AS (SELECT supplier_id, location_id, severity, round(0.65::DOUBLE * {r._RISK4} + 0.35::DOUBLE * risk_score, 2) AS score FROM risk) SELECT *, {r._band('score', 80, 60, 40)} AS level FROM g")
def legacy_alerts(k):
    det, _ = op.four_factor_risk(F.col("severity"), F.col("dependency"), F.col("supplier"), F.col("exposure"), F.col("single"), F.col("product"))
    score, _ = alerts.legacy_alert(det, F.col("risk_score"))
    return r._risk(k).select("supplier_id", "location_id", "severity", score.alias("score")).withColumn("level", c.band(F.col("score"), 80, 60, 40))


_SAY = ", ".join(
    f"{{'by': -round(f_{n} * {w}::DOUBLE, 4), 'i': {i}, 'v': f_{n}, 'say': CASE WHEN f_{n} >= 0.75 THEN '{alerts.SENTENCES[n][0]}' WHEN f_{n} >= 0.40 THEN '{alerts.SENTENCES[n][1]}' ELSE '{alerts.SENTENCES[n][2]}' END}}" for i, (n, w) in enumerate(c.RISK_WEIGHTS.items())
)


@query(
    r._RISK
    + f""", e0 AS (SELECT supplier_id, location_id, severity, risk_score, risk_band, list_sort([{_SAY}]) AS ranked FROM risk),
    e1 AS (SELECT *, CASE WHEN len(list_filter(ranked, lambda x: x.v >= 0.40)) > 0 THEN list_filter(ranked, lambda x: x.v >= 0.40) ELSE ranked[1:2] END AS chosen FROM e0),
    e2 AS (SELECT *, array_to_string(list_transform(chosen, lambda x, i: concat(i, '. ', x.say)), chr(10)) AS points FROM e1)
    SELECT supplier_id, location_id, severity, concat('Deterministic Risk: ', printf('%.1f', round(risk_score, 1)), '/100 (', risk_band, ').', chr(10), 'Risk increased because:', chr(10), points, chr(10), chr(10), '{alerts.SCORE_DISCLAIMER}') AS explanation FROM e2"""
)
def risk_explanations(k):
    points = alerts.drivers({n: F.col(f"f_{n}") for n in c.RISK_WEIGHTS})
    return r._risk(k).select("supplier_id", "location_id", "severity", alerts.risk_text(F.round("risk_score", 1), F.col("risk_band"), points).alias("explanation"))


@query(r._ALERTS + ", u AS (SELECT supplier_id, max(score) / 100 AS news_risk, least(count(*) / 5.0, 1.0)::DOUBLE AS media_volume, max(exposure) AS geographic_volatility FROM al GROUP BY 1) SELECT * FROM u")
def alert_rollup(k):
    norm, score, _ = op.combined_risk(F.col("risk_norm"), F.col("first"), F.col("second"))
    return alerts.rollup(r._alert_input(k).select("supplier_id", score.alias("risk_score"), F.col("exposure").alias("geographic_exposure")))


# --- names, audits, features, metrics

_CUT = "trim(name)"
for _ in range(linking.ROUNDS):
    _CUT = rf"trim(regexp_replace(regexp_replace({_CUT}, '{linking.CORPORATE_NAME}', '', 'g'), '[\s,.;:-]+$', ''))"


@query(rf"""WITH n AS (SELECT supplier_id, concat(supplier_name, ' Holding Co., Ltd.') AS name FROM suppliers UNION ALL SELECT location_id, concat('Port of ', country) FROM locations) SELECT supplier_id AS id, CASE WHEN starts_with(name, 'Port of ') THEN concat(upper(trim(substr(name, 9))), ' PORT') ELSE upper({_CUT}) END AS canonical FROM n""")
def entity_canonical(k):
    s = k.view("suppliers").select(F.col("supplier_id").alias("id"), F.concat("supplier_name", F.lit(" Holding Co., Ltd.")).alias("name"))
    s = s.unionByName(k.view("locations").select(F.col("location_id").alias("id"), F.concat(F.lit("Port of "), "country").alias("name")))
    return s.select("id", linking.entity_name(F.col("name"), F.lit("ORG")).alias("canonical"))


@query(
    """WITH a AS (SELECT 'suppliers' AS file, count(*) AS n, count(*) - count(supplier_name) + count(*) - count(country) AS m, count(*) - count(DISTINCT supplier_id) AS d FROM suppliers
    UNION ALL SELECT 'products', count(*), count(*) - count(product_name) + count(*) - count(category), count(*) - count(DISTINCT product_id) FROM products UNION ALL SELECT 'locations', count(*), count(*) - count(country), count(*) - count(DISTINCT location_id) FROM locations)
    SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(d) AS BIGINT) AS duplicate_ids, CAST(sum(m) AS BIGINT) AS missing_cells, bool_and(d = 0) AS all_files_valid FROM a"""
)
def dq_summary(k):
    parts = (("suppliers", "supplier_id", ("supplier_name", "country")), ("products", "product_id", ("product_name", "category")), ("locations", "location_id", ("country",)))
    return op.summary([op.audit(k.view(v).select(i, *cols), v, i, (i, *cols)) for v, i, cols in parts])


_SHARED = "fs AS (SELECT product_id, supplier_id, row_number() OVER (PARTITION BY product_id ORDER BY supplier_id) AS n FROM supplier_products), se AS (SELECT DISTINCT a.supplier_id AS src, b.supplier_id AS dst FROM fs a JOIN fs b ON a.product_id = b.product_id AND a.n <= 4 AND b.n <= 4 AND a.supplier_id <> b.supplier_id)"


@query(f"WITH {_SHARED} SELECT src, dst FROM se")
def supplier_edges(k):
    return supplier_edges_of(k)


def supplier_edges_of(k: Catalog) -> DataFrame:
    return op.shared_product_edges(k.view("supplier_products"))


_BASE = f"bs AS (SELECT supplier_id AS node_id, {_case('lower(criticality)', {k_: str(v) for k_, v in {'low': 0.25, 'medium': 0.5, 'high': 0.75, 'critical': 1.0}.items()}, chr(39) + '0.5' + chr(39))}::DOUBLE AS base, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.65 ELSE 0.35 END::DOUBLE AS centrality FROM suppliers)"


def _base(k: Catalog) -> DataFrame:
    crit, tier = F.lower("criticality"), F.col("tier")
    base = F.when(crit == "low", 0.25).when(crit == "high", 0.75).when(crit == "critical", 1.0).otherwise(0.5)
    return k.view("suppliers").select(F.col("supplier_id").alias("node_id"), base.alias("base"), F.when(tier == 1, 1.0).when(tier == 2, 0.65).otherwise(0.35).alias("centrality"))


@query(
    f"""WITH {_SHARED}, {_BASE}, nb AS (SELECT dst, sum(base) AS s, count(*) AS n FROM se JOIN bs ON src = node_id GROUP BY 1)
    SELECT node_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.60::DOUBLE * base + 0.30::DOUBLE * ((base + COALESCE(s, 0.0::DOUBLE)) / (1 + COALESCE(n, 0))) + 0.10::DOUBLE * centrality)), 6) AS risk FROM bs LEFT JOIN nb ON dst = node_id"""
)
def topology_risk(k):
    return op.topology_risk(_base(k), op.shared_product_edges(k.view("supplier_products")))


@query(f"WITH {_SHARED}, {_BASE} SELECT round(COALESCE(avg(0.5::DOUBLE * (a.base - b.base) * (a.base - b.base)), 0.0), 6) AS loss FROM se JOIN bs a ON src = a.node_id JOIN bs b ON dst = b.node_id")
def smoothness_loss(k):
    e = op.shared_product_edges(k.view("supplier_products")).withColumn("weight", F.lit(0.5))
    return op.smoothness(_base(k).select("node_id", F.col("base").alias("score")), e)


@query(
    r._RISK
    + """, s AS (SELECT CAST(severity >= 4 AS BIGINT) AS y, risk_norm AS v FROM risk), g AS (SELECT v, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY 1), w AS (SELECT *, COALESCE(sum(q) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
    t AS (SELECT sum(p)::DOUBLE AS P1, sum(q)::DOUBLE AS Q1, sum(p * (below + q / 2.0::DOUBLE)) AS U, (sum(p) FILTER (v >= 0.5))::DOUBLE AS tp, (sum(q) FILTER (v >= 0.5))::DOUBLE AS fp, sum(p * abs(1 - v) + q * abs(v)) AS e FROM w)
    SELECT round(U / (P1 * Q1), 6) AS roc_auc, round((tp + Q1 - fp) / (P1 + Q1), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / P1, 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / P1) / (tp / (tp + fp) + tp / P1), 6) AS f1, round(e / (P1 + Q1), 6) AS mae FROM t"""
)
def classifier_metrics(k):
    """How well the risk tells severe events from others."""
    return op.classifier_metrics(r._risk(k).select((F.col("severity") >= 4).cast("long").alias("label"), F.col("risk_norm").alias("score")))
