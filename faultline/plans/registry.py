"""All registered queries of the library itself, by name, with DuckDB SQL for each."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.functions import lexicon as lx
from faultline.operators import connect, spans
from faultline.operators import engine as op
from faultline.sources.tables import Catalog, with_views

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_O: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Catalog], DataFrame]):
        _Q[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            _O[f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)


# --- SQL pieces for the oracles


def _scale(x: str, scale: dict[str, float], default: float = 0.5, text: bool = True) -> str:
    names = " ".join(f"WHEN lower(trim(CAST({x} AS VARCHAR))) = '{k}' THEN {v}::DOUBLE" for k, v in reversed(scale.items()))
    n = f"TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE)"
    beyond = f"{default}::DOUBLE" if text else f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {n}))"
    return f"CASE WHEN {x} IS NULL THEN {default}::DOUBLE {names} WHEN {n} IS NULL THEN {default}::DOUBLE WHEN {n} BETWEEN 0 AND 1 THEN {n} WHEN {n} > 1 AND {n} <= 5 THEN round({n} / 5, 4) WHEN {n} > 5 AND {n} <= 100 THEN round({n} / 100, 4) ELSE {beyond} END"


def _band(x: str, a: float = 0.75, b: float = 0.60, m: float = 0.40) -> str:
    return f"CASE WHEN {x} >= {a} THEN 'CRITICAL' WHEN {x} >= {b} THEN 'HIGH' WHEN {x} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"


def _hits(x: str, words: tuple[str, ...], whole: bool = True) -> str:
    return "(" + " + ".join(rf"CAST(regexp_matches({x}, '\b{re.escape(w)}\b') AS INT)" if whole else f"CAST(contains({x}, '{w}') AS INT)" for w in words) + ")"


_CLEAN = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(COALESCE({0}, ''), '<[^>]+>', ' ', 'g'), 'https?://\S+|www\.\S+', ' ', 'g'), '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), ' ([.,!?;:])', '\1', 'g')"
_HAV = "round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 4)"
_H = "least(1.0, greatest(0.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"
_ZONE = "CASE WHEN distance_km IS NULL OR distance_km < 0 THEN 0.10 WHEN distance_km <= 25 THEN 1.00 WHEN distance_km <= 100 THEN 0.85 WHEN distance_km <= 250 THEN 0.65 ELSE 0.20 END::DOUBLE"
_ZONE_NAME = "CASE WHEN distance_km IS NULL OR distance_km < 0 THEN 'UNKNOWN' WHEN distance_km <= 25 THEN '0-25 km' WHEN distance_km <= 100 THEN '25-100 km' WHEN distance_km <= 250 THEN '100-250 km' ELSE '>250 km' END"
_NEAR = (
    """WITH site AS (SELECT supplier_id, NULL AS site_id, -1 AS ord, latitude, longitude FROM suppliers
      UNION ALL SELECT sl.supplier_id, l.location_id, l.ordinal, l.latitude, l.longitude FROM supplier_locations sl JOIN locations l ON sl.location_id = l.location_id),
    dist AS (SELECT location_id, supplier_id, site_id, ord, """
    + _HAV
    + " AS distance_km FROM (SELECT e.location_id, s.supplier_id, s.site_id, s.ord, "
    + _H.format(a="e.latitude", b="s.latitude", c="e.longitude", d="s.longitude")
    + f""" AS h FROM locations e CROSS JOIN site s)),
    near0 AS (SELECT *, row_number() OVER (PARTITION BY location_id, supplier_id ORDER BY distance_km NULLS FIRST, ord) AS rn FROM dist),
    near AS (SELECT location_id, supplier_id, site_id, distance_km, {_ZONE} AS exposure, {_ZONE_NAME} AS zone FROM near0 WHERE rn = 1)"""
)
_EDGES = """WITH e0 AS (
    SELECT location_id AS src, concat('FAC_', supplier_id, '_', location_id) AS dst, 'LOCATION_AFFECTS_FACILITY' AS edge_type, 0.90::DOUBLE AS weight FROM supplier_locations
    UNION ALL SELECT concat('FAC_', supplier_id, '_', location_id), supplier_id, 'FACILITY_BELONGS_TO_SUPPLIER', 1.0::DOUBLE FROM supplier_locations
    UNION ALL SELECT supplier_id, product_id, 'SUPPLIER_PROVIDES_PRODUCT', round(share_percent / 100, 4) FROM supplier_products), edges AS (SELECT * FROM e0)"""


def _near(k: Catalog) -> DataFrame:
    return op.nearest_site(k.view("locations"), k.view("suppliers"), k.view("supplier_locations"))


def _edges(k: Catalog) -> DataFrame:
    return op.graph_edges(k.view("supplier_locations"), k.view("supplier_products"))


# --- data quality


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dq_duplicate_ids(k):
    return op.duplicate_ids(k.table("lineitem").select("l_orderkey"), "l_orderkey")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def dq_duplicate_relationships(k):
    return op.duplicate_relationships(k.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS orphan FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def dq_fk_orphans(k):
    return op.orphans(k.table("lineitem"), "l_suppkey", k.table("supplier"), "s_suppkey")


@query("SELECT 'quality' AS column_name, count(*) AS n_missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL HAVING count(*) > 0")
def dq_missing(k):
    labels = k.table("labels").select("doc_id", "quality")
    return op.missing_cells(k.table("documents").select("doc_id").join(labels, "doc_id", "left"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'real' WHEN o_orderstatus = 'O' THEN 'synthetic' ELSE 'unknown' END AS provenance, count(*) AS n FROM orders GROUP BY 1")
def dq_provenance(k):
    status = F.when(F.col("o_orderstatus") == "F", " real_data ").when(F.col("o_orderstatus") == "O", "Synthetic_Demo").otherwise("DERIVED")
    return k.table("orders").groupBy(op.provenance(status).alias("provenance")).agg(F.count("*").alias("n"))


# --- text, relevance, events


@query(f"SELECT page_id, {_CLEAN.format('html')} AS clean FROM pages")
def clean_pages(k):
    return k.table("pages").select("page_id", c.clean_text(F.col("html")).alias("clean"))


@query(f"SELECT article_id, round(least(n / 5.0, 1.0), 3)::DOUBLE AS score, n > 0 AS relevant FROM (SELECT article_id, {_hits('lower(content)', lx.KEYWORDS)} AS n FROM news)")
def relevance_keywords(k):
    score, flag = op.keyword_relevance(F.col("content"))
    return k.view("news").select("article_id", score.alias("score"), flag.alias("relevant"))


@query(
    f"""WITH h AS (SELECT article_id, content, {_hits("lower(content)", lx.PHRASES, False)} AS p, {_hits("lower(content)", lx.ENTITY_TERMS)} AS e, {_hits("lower(content)", lx.DISRUPTION_TERMS)} AS d FROM news),
    s AS (SELECT *, CASE WHEN length(content) < 10 THEN 0.0 ELSE round(least(CASE WHEN p > 0 THEN 0.50::DOUBLE + 0.15::DOUBLE * least(p, 3) ELSE 0.0 END + CASE WHEN e > 0 AND d > 0 THEN 0.40::DOUBLE + 0.05::DOUBLE * least(e + d, 6)
      WHEN p > 0 THEN 0.20::DOUBLE WHEN d >= 2 OR e >= 3 THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 3) END::DOUBLE AS score FROM h)
    SELECT article_id, score, length(content) >= 10 AND (score >= 0.40 OR p > 0 OR (e >= 1 AND d >= 1)) AS relevant FROM s"""
)
def relevance_lexicon(k):
    return op.lexicon_relevance(k.view("news"), "content").select("article_id", "score", "relevant")


_RULES = ", ".join(f"({len(t)}, {a * 100 + b}, '{r[0]}', '{r[1]}', '{t}')" for a, r in enumerate(lx.EVENT_RULES) for b, t in enumerate(r[3]))


@query(
    f"""WITH rules(n, o, event_type, event_category, trig) AS (VALUES {_RULES}), t AS (SELECT article_id, lower({_CLEAN.format("content")}) AS txt FROM news),
    m AS (SELECT article_id, event_type, event_category, trig, n, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, o) AS rn FROM t JOIN rules ON contains(txt, trig) AND regexp_matches(txt, '\\b' || trig || '\\b'))
    SELECT article_id, event_type, event_category, trig AS "trigger", round(least(0.98, 0.75 + least(n, 25) / 100.0), 3)::DOUBLE AS confidence FROM m WHERE rn = 1"""
)
def event_types(k):
    return op.extract_events(k.view("news")).select("article_id", "event_type", "event_category", "trigger", "confidence")


@query()
def event_extract(k):
    return op.extract_events(k.view("news"))


@query("SELECT article_id, url FROM (SELECT article_id, url, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY ordinal) AS rn FROM news) WHERE rn = 1")
def url_dedup(k):
    n = k.view("news").withColumn("key", F.lower(F.trim("url")))
    first = n.where("key <> ''").groupBy("key").agg(F.min(F.struct("ordinal", "article_id", "url")).alias("m"))
    return first.select("m.article_id", "m.url")


@query("SELECT n.article_id FROM news n WHERE NOT EXISTS (SELECT 1 FROM news o WHERE o.ordinal % 3 = 0 AND lower(trim(o.url)) = lower(trim(n.url))) AND NOT EXISTS (SELECT 1 FROM news o WHERE o.ordinal % 3 = 0 AND o.article_id = n.article_id)")
def append_if_new(k):
    n = k.view("news").withColumn("key", F.lower(F.trim("url"))).select("ordinal", "article_id", "key")
    old = n.where("ordinal % 3 = 0")
    return n.join(old.select("key"), "key", "left_anti").join(old.select("article_id"), "article_id", "left_anti").select("article_id")


# --- geography, risk, alerts


@query(_NEAR + " SELECT * FROM near")
def geo_exposure(k):
    return _near(k)


@query(
    f"""WITH d AS (SELECT supplier_id, location_id, {_HAV} AS d FROM (SELECT s.supplier_id, l.location_id, {_H.format(a="l.latitude", b="s.latitude", c="l.longitude", d="s.longitude")} AS h FROM suppliers s CROSS JOIN locations l))
    SELECT supplier_id, location_id, CASE WHEN d <= 25 THEN 1.00 WHEN d <= 100 THEN 0.85 WHEN d <= 250 THEN 0.65 WHEN d <= 500 THEN 0.45 WHEN d <= 1000 THEN 0.25 ELSE 0.10 END::DOUBLE AS tiered, round(least(1.0, greatest(0.05, exp(-d / 250))), 4) AS exponential FROM d"""
)
def distance_decay(k):
    s, l_ = k.view("suppliers").withColumn("_lane", op.lane("supplier_id")).alias("s"), k.view("locations").withColumn("_lane", op.every_lane()).alias("l")
    d = c.haversine(F.col("l.latitude"), F.col("l.longitude"), F.col("s.latitude"), F.col("s.longitude"))
    return s.join(l_, "_lane").select("supplier_id", "location_id", d.alias("d")).select("supplier_id", "location_id", c.tiered_decay(F.col("d")).alias("tiered"), c.exponential_decay(F.col("d")).alias("exponential"))


def _supply(k: Catalog) -> DataFrame:
    """Each supplier with its largest dependency and the product it belongs to."""
    s = k.view("supplier_products").groupBy("supplier_id").agg(F.max(F.struct("share_percent", "product_id", "dependency_level")).alias("m"))
    p = k.view("products").select("product_id", F.col("criticality").alias("product"))
    return s.select("supplier_id", "m.product_id", F.col("m.dependency_level").alias("dependency")).join(p, "product_id")


_SUPPLY = "sup AS (SELECT supplier_id, dependency_level AS dependency, criticality AS product FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY share_percent DESC, product_id DESC, dependency_level DESC) AS rk FROM supplier_products) x JOIN products p ON x.product_id = p.product_id WHERE rk = 1)"


def _risk(k: Catalog) -> DataFrame:
    ev = k.view("incidents").groupBy("location_id", "severity").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))
    s = k.view("suppliers").select("supplier_id", F.col("criticality").alias("supplier"), F.col("single_source").alias("single"))
    return op.six_factor_risk(ev.join(_near(k), "location_id").join(s, "supplier_id").join(_supply(k), "supplier_id"))


_F6 = {"severity": ("severity", c.SEVERITY, 0.5, False), "exposure": ("exposure", {}, 0.5, False), "supplier": ("supplier", c.CRITICALITY, 0.4), "product": ("product", c.CRITICALITY, 0.4), "dependency": ("dependency", c.DEPENDENCY)}
_RISK = (
    _NEAR
    + ", "
    + _SUPPLY
    + """, ev AS (SELECT location_id, severity, count(*) AS n_events, min(event_id) AS first_event FROM incidents GROUP BY ALL),
    j AS (SELECT ev.*, near.supplier_id, distance_km, exposure, zone, s.criticality AS supplier, s.single_source AS single, product, dependency FROM ev JOIN near ON ev.location_id = near.location_id
      JOIN suppliers s ON s.supplier_id = near.supplier_id JOIN sup ON sup.supplier_id = near.supplier_id),
    f AS (SELECT *, """
    + ", ".join(f"{_scale(*x)} AS f_{n}" for n, x in _F6.items())
    + """, CASE WHEN single THEN 1.0 ELSE 0.0 END::DOUBLE AS f_single FROM j),
    whole AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.0::DOUBLE + """
    + " + ".join(f"f_{n} * {w}::DOUBLE" for n, w in c.RISK_WEIGHTS.items())
    + ")) AS total FROM f), risk AS (SELECT *, round(total, 4) AS risk_norm, round(total * 100, 2) AS risk_score, "
    + _band("total")
    + " AS risk_band FROM whole)"
)


@query(_RISK + f" SELECT supplier_id, location_id, severity, n_events, risk_norm, risk_score, risk_band, zone FROM risk")
def deterministic_risk6(k):
    return _risk(k).select("supplier_id", "location_id", "severity", "n_events", "risk_norm", "risk_score", "risk_band", "zone")


@query(_RISK + f" SELECT supplier_id, location_id, severity, first_event, distance_km, risk_norm, risk_band FROM risk ORDER BY risk_norm DESC, supplier_id, location_id, severity LIMIT 20")
def flagship_top_risks(k):
    return _risk(k).select("supplier_id", "location_id", "severity", "first_event", "distance_km", "risk_norm", "risk_band").orderBy(F.desc("risk_norm"), "supplier_id", "location_id", "severity").limit(20)


@query(_RISK + " SELECT risk_band, count(*) AS n, CAST(sum(n_events) AS BIGINT) AS events FROM risk GROUP BY 1")
def alert_band_counts(k):
    return _risk(k).groupBy("risk_band").agg(F.count("*").alias("n"), F.sum("n_events").alias("events"))


def _named(x: str, scale: dict[str, float]) -> str:
    return "CASE lower(" + x + ") " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scale.items()) + " ELSE 0.5::DOUBLE END"


_SEV4 = "CASE WHEN severity <= 1 THEN severity::DOUBLE ELSE severity / 5.0::DOUBLE END"
_RISK4 = f"round(least((0.30::DOUBLE * {_SEV4} + 0.25::DOUBLE * {_named('dependency', c.DEPENDENCY4)} + 0.25::DOUBLE * (0.5::DOUBLE * {_named('product', c.CRITICALITY4)} + 0.5::DOUBLE * {_named('supplier', c.CRITICALITY4)}) + 0.20::DOUBLE * exposure) * 100 + CASE WHEN single THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END, 100.0::DOUBLE), 2)"


@query(_RISK + f", g AS (SELECT supplier_id, location_id, severity, {_RISK4} AS score FROM j) SELECT *, {_band('score', 80, 60, 40)} AS level FROM g")
def deterministic_risk4(k):
    """Severities are whole numbers here, read as numbers before names."""
    score, _ = op.four_factor_risk(F.col("severity"), F.col("dependency"), F.col("supplier"), F.col("exposure"), F.col("single"), F.col("product"))
    return _risk(k).select("supplier_id", "location_id", "severity", score.alias("score")).withColumn("level", c.band(F.col("score"), 80, 60, 40))


_R = op.REASONS
_REASONS = f"""concat_ws('; ', CASE WHEN f_severity >= 0.70 THEN '{_R[0][0]}' WHEN f_severity >= 0.40 THEN '{_R[0][1]}' END, CASE WHEN exposure >= 0.65 THEN '{_R[1][0]}' WHEN exposure >= 0.40 THEN '{_R[1][1]}' END,
      CASE WHEN f_dependency >= 0.70 THEN '{_R[2][0]}' WHEN f_dependency >= 0.45 THEN '{_R[2][1]}' END, CASE WHEN risk_norm >= 0.60 THEN '{_R[3][0]}' WHEN risk_norm >= 0.40 THEN '{_R[3][1]}' END,
      CASE WHEN first >= 0.50 OR second >= 0.50 THEN '{_R[4][0]}' END, CASE WHEN single THEN '{_R[5][0]}' END, CASE WHEN f_product >= 0.75 THEN '{_R[6][0]}' END)"""
#: Stand-ins for the two model scores, which need trained weights.
_MODELS = "m AS (SELECT *, 0.9137::DOUBLE * risk_norm AS first, 0.9571::DOUBLE * risk_norm AS second FROM risk)"
_ALERTS = (
    _RISK
    + f""", {_MODELS}, a0 AS (SELECT *, round(least(1.0::DOUBLE, 0.50::DOUBLE * risk_norm + 0.25::DOUBLE * first + 0.25::DOUBLE * second), 4) AS norm, {_REASONS} AS r0 FROM m),
    al AS (SELECT *, round(norm * 100, 2) AS score, {_band("norm")} AS band, CASE WHEN r0 = '' THEN '{op.ROUTINE}' ELSE r0 END AS reasons FROM a0)"""
)


def _alert_input(k: Catalog) -> DataFrame:
    """What alerts are made of: a record for each supplier, place and severity, with the first event there."""
    return _risk(k).withColumns({"first": 0.9137 * F.col("risk_norm"), "second": 0.9571 * F.col("risk_norm")})


@query(_ALERTS + " SELECT supplier_id, location_id, severity, norm, score, band, reasons FROM al")
def combined_alerts(k):
    n = F.col("risk_norm")
    norm, score, band = op.combined_risk(n, F.col("first"), F.col("second"))
    reasons = op.alert_reasons(F.col("f_severity"), F.col("exposure"), F.col("f_dependency"), n, F.col("single"), F.col("first"), F.col("second"), F.col("f_product"))
    return _alert_input(k).select("supplier_id", "location_id", "severity", norm.alias("norm"), score.alias("score"), band.alias("band"), reasons.alias("reasons"))


@query(_RISK + ", g AS (SELECT supplier_id, location_id, severity, unnest(['severity','exposure','supplier','product','dependency','single']) AS factor, unnest([f_severity, f_exposure, f_supplier, f_product, f_dependency, f_single]) AS value FROM risk) SELECT *, CASE WHEN factor = 'single' THEN CASE WHEN value > 0.5 THEN 'critical' ELSE 'low' END WHEN value >= 0.75 THEN 'high' WHEN value >= 0.40 THEN 'moderate' ELSE 'low' END AS level FROM g")
def risk_factors(k):
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"f_{n}").alias("value")) for n in c.RISK_WEIGHTS]))
    return _risk(k).select("supplier_id", "location_id", "severity", s.alias("s")).select("supplier_id", "location_id", "severity", "s.*").withColumn("level", F.when(F.col("factor") == "single", c.single_level(F.col("value"))).otherwise(c.level(F.col("value"))))


# --- graph


@query(_EDGES + " SELECT src, dst, edge_type, weight FROM edges")
def graph_edges(k):
    return _edges(k)


@query(_EDGES + ", d AS (SELECT edge_type, count(*) AS n, round(avg(weight), 4) AS mean_weight FROM edges GROUP BY 1) SELECT * FROM d")
def edges_by_type(k):
    return _edges(k).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 4).alias("mean_weight"))


_NODES = "nodes AS (SELECT location_id AS node_id FROM locations UNION SELECT supplier_id FROM suppliers UNION SELECT product_id FROM products UNION SELECT src FROM edges UNION SELECT dst FROM edges)"


def _nodes(k: Catalog, e: DataFrame) -> DataFrame:
    parts = [k.view(v).select(F.col(x).alias("node_id")) for v, x in (("locations", "location_id"), ("suppliers", "supplier_id"), ("products", "product_id"))]
    return parts[0].union(parts[1]).union(parts[2]).union(e.select("src")).union(e.select("dst")).distinct()


@query(_EDGES + f", {_NODES}, i AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1) SELECT node_id, COALESCE(i.n, 0) AS in_degree, COALESCE(o.n, 0) AS out_degree FROM nodes LEFT JOIN i ON i.dst = node_id LEFT JOIN o ON o.src = node_id")
def degrees(k):
    e = connect.cut(_edges(k))
    return op.degrees(e, _nodes(k, e))


@query(_EDGES + f", {_NODES} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def isolated_nodes(k):
    e = connect.cut(_edges(k))
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return _nodes(k, e).join(ends, "node_id", "left_anti")


@query(_EDGES + f", {_NODES}, c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m) SELECT n AS num_nodes, m AS num_edges, round(m / (n * (n - 1)), 6)::DOUBLE AS density FROM c")
def density(k):
    e = connect.cut(_edges(k))
    return op.density(e, _nodes(k, e))


@query(
    _EDGES
    + f""", {_NODES}, i AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), d AS (SELECT COALESCE(i.n, 0) AS a, COALESCE(o.n, 0) AS b FROM nodes LEFT JOIN i ON i.dst = node_id LEFT JOIN o ON o.src = node_id),
    u AS (SELECT 'in' AS degree, a AS n FROM d UNION ALL SELECT 'out', b FROM d UNION ALL SELECT 'total', a + b FROM d)
    SELECT degree, min(n) AS least, max(n) AS most, round(avg(n), 3) AS mean, round(median(n), 3)::DOUBLE AS median FROM u GROUP BY 1"""
)
def degree_stats(k):
    e = connect.cut(_edges(k))
    return op.degree_stats(e, _nodes(k, e))


@query(
    _EDGES
    + """, b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), n1 AS (SELECT 'PRD1' AS x UNION SELECT y FROM b WHERE x = 'PRD1'), n2 AS (SELECT x FROM n1 UNION SELECT y FROM b WHERE x IN (SELECT x FROM n1))
    SELECT src, dst, edge_type, weight FROM edges WHERE src IN (SELECT x FROM n2) AND dst IN (SELECT x FROM n2)"""
)
def ego2(k):
    return op.ego_network(_edges(k), "PRD1", 2)


def _shock(k: Catalog) -> DataFrame:
    return k.view("locations").where("location_id = 'LOC1'").select(F.col("location_id").alias("node_id"), F.lit(1.0).alias("shock"))


@query(
    _EDGES
    + """, t AS (SELECT dst, sum(weight) AS t FROM edges GROUP BY 1), w AS (SELECT src, e.dst, weight / t AS w FROM edges e JOIN t ON e.dst = t.dst),
    n AS (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges), r0 AS (SELECT node_id, CASE WHEN node_id = 'LOC1' THEN 1.0 ELSE 0.0 END::DOUBLE AS r0 FROM n),
    r1 AS (SELECT node_id, r0, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * r0 + 0.6::DOUBLE * COALESCE(p, 0.0))) AS r FROM r0 LEFT JOIN (SELECT w.dst, sum(w * r0.r0) AS p FROM w JOIN r0 ON w.src = r0.node_id GROUP BY 1) x ON x.dst = node_id),
    r2 AS (SELECT node_id, r0, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * r0 + 0.6::DOUBLE * COALESCE(p, 0.0))) AS r FROM r1 LEFT JOIN (SELECT w.dst, sum(w * r1.r) AS p FROM w JOIN r1 ON w.src = r1.node_id GROUP BY 1) x ON x.dst = node_id)
    SELECT node_id, round(r, 4) AS risk FROM r2"""
)
def shock_propagation(k):
    """Two fixed rounds, as its SQL has them; ``shock_settled`` runs until the risks settle."""
    return op.propagate(connect.cut(_edges(k)), _shock(k), rounds=2)


@query()
def shock_settled(k):
    return op.propagate(connect.cut(_edges(k)), _shock(k))


@query()
def pagerank_rounds(k):
    return op.pagerank(connect.cut(_edges(k)))


@query(_EDGES + " SELECT src, dst, weight, rank FROM (SELECT src, dst, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INT) AS rank FROM edges) WHERE rank <= 3")
def topk_neighbours(k):
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return _edges(k).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("src", "dst", "weight", "rank")


@query(
    """WITH f AS (SELECT s.supplier_id, CASE WHEN single_source THEN 1.0 ELSE 0.0 END::DOUBLE AS single, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.65 ELSE 0.35 END::DOUBLE AS tier, COALESCE(p.n, 0) AS products, COALESCE(l.n, 0) AS sites
    FROM suppliers s LEFT JOIN (SELECT supplier_id, count(*) AS n FROM supplier_products GROUP BY 1) p ON p.supplier_id = s.supplier_id LEFT JOIN (SELECT supplier_id, count(*) AS n FROM supplier_locations GROUP BY 1) l ON l.supplier_id = s.supplier_id)
    SELECT supplier_id, single, tier, round(1.0 / greatest(products, 1), 4)::DOUBLE AS concentration, round(least(products / 10.0, 1.0), 4)::DOUBLE AS breadth, round(least(sites / 5.0, 1.0), 4)::DOUBLE AS spread FROM f"""
)
def supplier_features(k):
    p = k.view("supplier_products").groupBy("supplier_id").agg(F.count("*").alias("products"))
    l_ = k.view("supplier_locations").groupBy("supplier_id").agg(F.count("*").alias("sites"))
    s = k.view("suppliers").join(p, "supplier_id", "left").join(l_, "supplier_id", "left").fillna(0, ["products", "sites"])
    return s.select("supplier_id", F.when(F.col("single_source"), 1.0).otherwise(0.0).alias("single"), F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.65).otherwise(0.35).alias("tier"), F.round(1.0 / F.greatest("products", F.lit(1)), 4).alias("concentration"), F.round(F.least(F.col("products") / 10.0, F.lit(1.0)), 4).alias("breadth"), F.round(F.least(F.col("sites") / 5.0, F.lit(1.0)), 4).alias("spread"))


# --- serving


@query("SELECT supplier_id, supplier_name, country FROM suppliers ORDER BY ordinal LIMIT 10 OFFSET 5")
def api_supplier_page(k):
    return op.page(k.view("suppliers").select("ordinal", "supplier_id", "supplier_name", "country"), "ordinal", 5, 10).drop("ordinal")


@query("SELECT supplier_id, criticality FROM suppliers WHERE lower(criticality) = 'critical' AND contains(lower(supplier_name), 'supplier')")
def api_supplier_filter(k):
    return k.view("suppliers").where((F.lower("criticality") == "critical") & F.lower("supplier_name").contains("supplier")).select("supplier_id", "criticality")


@query("SELECT event_type, severity, count(*) AS n FROM incidents GROUP BY 1, 2")
def event_frequency(k):
    return k.view("incidents").groupBy("event_type", "severity").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM suppliers) AS suppliers, (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM locations) AS locations, (SELECT count(*) FROM incidents) AS incidents")
def kpi_counts(k):
    parts = [k.view(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("v"), "n") for v in ("suppliers", "products", "locations", "incidents")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.agg(*[F.max(F.when(F.col("v") == v, F.col("n"))).alias(v) for v in ("suppliers", "products", "locations", "incidents")])


# --- without SQL: tests hold the graph's against brute force, the others on fixed texts


@query()
def entity_spans(k):
    return spans.entity_spans(k.view("news"), "article_id", "content")


@query()
def graph_weak_components(k):
    return connect.weak_components(connect.cut(_edges(k)))


@query()
def graph_strong_components(k):
    return connect.strong_components(connect.cut(_edges(k)))


from faultline.plans import audits, feeds, models, more, network  # noqa: E402, F401  (they add their queries to the ones here)
