"""The domain operators as functions from DataFrames to DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.functions import lexicon as lx
from faultline.operators.blocks import Block, Box, graph
from faultline.operators.connect import cut
from faultline.operators.tiles import numbered

# --- data quality


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct values of the id that occur more than once; nulls are no ids."""
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_relationships(df: DataFrame, key: list[str]) -> DataFrame:
    """Number of rows beyond the first of each key; null keys equal each other."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct trimmed keys of the child that the parent lacks; an empty parent gives none."""
    keys = child.select(F.trim(F.col(child_col).cast("string")).alias("orphan")).where("orphan is not null").distinct()
    held = parent.select(F.trim(F.col(parent_col).cast("string")).alias("orphan")).distinct()
    some = parent.limit(1).select(F.lit(1).alias("_some"))
    return keys.join(held, "orphan", "left_anti").join(F.broadcast(some)).select("orphan")


def missing_cells(df: DataFrame) -> DataFrame:
    """(column_name, n_missing), columns without nulls left out; one pass."""
    one = df.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).alias("n_missing")) for x in df.columns])).alias("s")).select("s.*").where("n_missing > 0")


def provenance(status: Column) -> Column:
    s = F.upper(F.trim(status))
    return F.when(s.isin("SYNTHETIC_DEMO", "SYNTHETIC"), "synthetic").when(s.isin("REAL_DATA", "REAL"), "real").otherwise("unknown")


def audit(df: DataFrame, name: str, id_col: str, expected: tuple[str, ...] = ()) -> DataFrame:
    """One row for a table: rows, ids that repeat, empty cells, columns that are missing, and whether it is valid. Empty cells do not make it invalid."""
    missing = [x for x in expected if x not in df.columns]
    cells = sum((F.count_if(F.col(x).isNull()) for x in df.columns), F.lit(0))
    rows = df.agg(F.count("*").alias("total_rows"), cells.alias("missing_cells"))
    twice = duplicate_ids(df, id_col).agg(F.count("*").alias("duplicate_ids"))
    return rows.join(F.broadcast(twice)).select(F.lit(name).alias("file"), "total_rows", "duplicate_ids", "missing_cells", F.lit(", ".join(missing)).alias("missing_columns"), ((F.col("duplicate_ids") == 0) & F.lit(not missing)).alias("is_valid"))


def summary(audits: list[DataFrame]) -> DataFrame:
    """The pack's totals over the audits of its tables."""
    every = audits[0]
    for a in audits[1:]:
        every = every.unionByName(a)
    return every.agg(F.count("*").alias("files"), F.sum("total_rows").alias("total_rows"), F.sum("duplicate_ids").alias("duplicate_ids"), F.sum("missing_cells").alias("missing_cells"), F.bool_and("is_valid").alias("all_files_valid"))


# --- relevance and events


def keyword_relevance(text: Column) -> tuple[Column, Column]:
    n = c.hits(F.lower(text), lx.KEYWORDS)
    return F.round(F.least(n / 5, F.lit(1.0)), 3), n > 0


def lexicon_relevance(df: DataFrame, text_col: str) -> DataFrame:
    """Adds score and relevant, from phrases (anywhere), entity and disruption terms (whole words). The counts are columns of their own, so each is made once."""
    t = F.lower(F.col(text_col))
    df = df.withColumns({"_p": c.hits(t, lx.PHRASES, whole=False), "_e": c.hits(t, lx.ENTITY_TERMS), "_d": c.hits(t, lx.DISRUPTION_TERMS)})
    p, e, d = (F.col(x) for x in ("_p", "_e", "_d"))
    lead = F.when(p > 0, 0.50 + 0.15 * F.least(p, F.lit(3))).otherwise(F.lit(0.0))
    both = F.when((e > 0) & (d > 0), 0.40 + 0.05 * F.least(e + d, F.lit(6))).when(p > 0, F.lit(0.20)).when((d >= 2) | (e >= 3), F.lit(0.35)).otherwise(F.lit(0.0))
    short = F.length(F.col(text_col)) < 10
    df = df.withColumn("score", F.when(short, F.lit(0.0)).otherwise(F.round(F.least(lead + both, F.lit(1.0)), 3)))
    return df.withColumn("relevant", ~short & ((F.col("score") >= 0.40) | (p > 0) | ((e >= 1) & (d >= 1)))).drop("_p", "_e", "_d")


def sentences(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), F.trim), lambda s: F.length(s) > 3)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def severity(base: Column, sentence: Column) -> Column:
    s = F.lower(sentence)
    high = F.when(c.hits(s, lx.STRONGEST) > 0, 2).when(c.hits(s, lx.HIGH_TERMS) > 0, 1).otherwise(0)
    low = F.when(c.hits(s, lx.LOW_TERMS) > 0, 1).otherwise(0)
    return F.least(F.lit(5), F.greatest(F.lit(1), base + high - low)).cast("int")


def extract_events(articles: DataFrame, id_col: str = "article_id", text_col: str = "content") -> DataFrame:
    """The event of each article: the longest whole-word trigger, first listed on ties; articles without one are left out."""
    rules = sorted(((-len(t), k, i, t) for k, r in enumerate(lx.EVENT_RULES) for i, t in enumerate(r[3])))
    place = {t: n for n, (*_, t) in reversed(list(enumerate(rules)))}
    text = c.clean_text(F.col(text_col))
    # One-element arrays are exploded so that the filters stay above the long expressions and don't repeat them.
    a = articles.select(F.col(id_col), F.explode(F.array(text)).alias("_text")).where(F.length("_text") >= 5)
    ranks = F.create_map(*[F.lit(x) for t, n in place.items() for x in (t, n)])
    found = F.array_min(F.transform(c.whole_words(F.lower("_text"), tuple(place)), lambda t: F.element_at(ranks, t)))
    a = a.select("*", F.explode(F.array(found)).alias("_n")).where("_n is not null")
    a = a.withColumn("_w", F.element_at(F.array(*[F.struct(F.lit(-n).alias("n"), F.lit(k).alias("k"), F.lit(t).alias("t")) for n, k, _, t in rules]), F.col("_n") + 1))
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in lx.EVENT_RULES]), F.col("_w.k") + 1)
    at = F.filter(sentences(F.col("_text")), lambda s: F.regexp_like(F.lower(s), F.concat(F.lit(r"\b"), F.col("_w.t"), F.lit(r"\b"))))
    a = a.withColumn("evidence_text", F.when(F.size(at) > 0, at[0]).otherwise(F.substring("_text", 1, 250)))
    return a.select(id_col, pick(0).alias("event_type"), pick(1).alias("event_category"), severity(pick(2), F.col("evidence_text")).alias("severity"), F.round(F.least(F.lit(0.98), 0.75 + F.least(F.col("_w.n"), F.lit(25)) / 100.0), 3).alias("confidence"), F.col("_w.t").alias("trigger"), "evidence_text", c.event_id(F.col(id_col), pick(0), F.col("_w.t"), F.col("evidence_text")).alias("event_id"))


# --- geography and risk

LANES = 64


def lane(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(LANES)).cast("int")


def every_lane() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))


def nearest_site(centers: DataFrame, suppliers: DataFrame, sites: DataFrame) -> DataFrame:
    """Nearest of headquarters and linked sites for every (location, supplier); headquarters win ties, then the earliest.

    The distance depends on the epicentre only, so events join afterwards; the pairs are locations by suppliers,
    never events by suppliers. Sites are dealt into ``LANES`` lanes that each have a copy of the epicentres, so that
    Spark broadcasts these while they are small and a shuffle is spread over the lanes when they are not.
    """
    hq = suppliers.select("supplier_id", F.lit(None).cast("string").alias("site_id"), F.lit(-1).cast("long").alias("at"), "latitude", "longitude")
    place = centers.select(F.col("location_id").alias("site_id"), F.col("ordinal").alias("at"), "latitude", "longitude")
    # the sites of a supplier in one place: the least of them is found before the grid's rows are shuffled or sorted apart
    every = hq.unionByName(sites.select("supplier_id", F.col("location_id").alias("site_id")).join(place, "site_id").select("supplier_id", "site_id", "at", "latitude", "longitude")).repartition("supplier_id")
    e = centers.select("location_id", F.col("latitude").alias("e_lat"), F.col("longitude").alias("e_lon"))
    grid = every.withColumn("_lane", lane("supplier_id", "site_id")).join(e.withColumn("_lane", every_lane()), "_lane")
    d = c.haversine(F.col("e_lat"), F.col("e_lon"), F.col("latitude"), F.col("longitude"))
    near = grid.withColumn("distance", d).groupBy("location_id", "supplier_id").agg(F.min(F.struct("distance", "at", "site_id")).alias("m"))
    return near.select("location_id", "supplier_id", F.col("m.site_id").alias("site_id"), F.col("m.distance").alias("distance_km"), c.zone(F.col("m.distance"), 1).alias("exposure"), c.zone(F.col("m.distance"), 2).alias("zone"))


def six_factor_risk(df: DataFrame) -> DataFrame:
    """Adds f_* factors, risk_norm, risk_score, risk_band and primary_driver to columns severity, exposure, supplier, product, dependency, single.

    The band is that of the score before rounding; the driver is the first of the greatest rounded impacts.
    """
    w = c.RISK_WEIGHTS
    f = {"severity": c.factor(F.col("severity"), c.SEVERITY), "exposure": c.factor(F.col("exposure"), {}), "supplier": c.factor(F.col("supplier"), c.CRITICALITY, 0.4), "product": c.factor(F.col("product"), c.CRITICALITY, 0.4), "dependency": c.factor(F.col("dependency"), c.DEPENDENCY), "single": c.factor(F.col("single"), c.SINGLE_SOURCE, 0.0)}
    total = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((F.col(f"f_{k}") * w[k] for k in w), F.lit(0.0))))
    df = df.withColumns({f"f_{k}": v for k, v in f.items()}).withColumn("_whole", total)
    impact = {k: F.round(F.col(f"f_{k}") * w[k], 4) for k in w}
    top, driver = F.greatest(*impact.values()), F.lit(None).cast("string")
    for k in reversed(w):
        driver = F.when(impact[k] == top, F.lit(k)).otherwise(driver)
    return df.withColumns({"risk_norm": F.round("_whole", 4), "risk_score": F.round(F.col("_whole") * 100, 2), "risk_band": c.band(F.col("_whole")), "primary_driver": driver}).drop("_whole")


def four_factor_risk(severity_: Column, dependency: Column, criticality: Column, exposure: Column, single: Column, product: Column | None = None, strict: bool = True) -> tuple[Column, Column]:
    """Score of 100 and level. Criticality is the mean of the product's and the supplier's where a product is given; ``strict`` as in ``legacy_factor``."""
    f = lambda x, scale: c.legacy_factor(x, scale, strict=strict)
    crit = f(criticality, c.CRITICALITY4) if product is None else 0.5 * f(product, c.CRITICALITY4) + 0.5 * f(criticality, c.CRITICALITY4)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(exposure.try_cast("double"), F.lit(0.5))))
    alone = F.upper(single.cast("string")).isin("YES", "TRUE", "1")
    s = (0.30 * f(severity_, c.SEVERITY4) + 0.25 * f(dependency, c.DEPENDENCY4) + 0.25 * crit + 0.20 * near) * 100 + F.when(alone, 5.0).otherwise(0.0)
    s = F.round(F.least(s, F.lit(100.0)), 2)
    return s, c.band(s, 80, 60, 40)


def combined_risk(det: Column, first: Column, second: Column) -> tuple[Column, Column, Column]:
    n = lambda x: F.when(x > 1, x / 100).otherwise(F.greatest(F.lit(0.0), x))
    norm = F.round(F.least(F.lit(1.0), c.BLEND[0] * n(det) + c.BLEND[1] * n(first) + c.BLEND[2] * n(second)), 4)
    return norm, F.round(norm * 100, 2), c.band(norm)


# The reasons of an alert.
REASONS = (
    ("High-severity disruption", "Moderate disruption event detected"), ("Geographic exposure detected", "Moderate geographic proximity to event"),
    ("High dependency relationship", "Direct operational dependency"), ("Elevated deterministic risk", "Moderate baseline heuristic risk"),
    ("Graph propagation from affected upstream nodes",), ("Single-source sole supplier vulnerability",), ("Essential product criticality",))
ROUTINE = "Routine baseline operational monitoring"


def alert_reasons(sev: Column, geo: Column, dep: Column, det: Column, single: Column, first: Column, second: Column, product: Column) -> Column:
    """The reasons in their order, joined by semicolons; the routine one if none holds."""
    steps = [F.when(x >= a, names[0]).when(x >= b, names[1]) for (x, a, b), names in zip(((sev, 0.70, 0.40), (geo, 0.65, 0.40), (dep, 0.70, 0.45), (det, 0.60, 0.40)), REASONS, strict=False)]
    flags = [F.when(x, names[0]) for x, names in zip(((first >= 0.50) | (second >= 0.50), single, product >= 0.75), REASONS[4:], strict=True)]
    r = F.array_compact(F.array(*steps, *flags))
    return F.when(F.size(r) > 0, F.array_join(r, "; ")).otherwise(F.lit(ROUTINE))


# --- graph


def graph_edges(sites: DataFrame, supplies: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight): one edge for each ordered pair, the highest priority wins."""
    fac = F.concat(F.lit("FAC_"), "supplier_id", F.lit("_"), "location_id")
    parts = [
        sites.select(F.col("location_id").alias("src"), fac.alias("dst"), F.lit("LOCATION_AFFECTS_FACILITY").alias("edge_type"), F.lit(0.90).alias("weight")),
        sites.select(fac.alias("src"), F.col("supplier_id").alias("dst"), F.lit("FACILITY_BELONGS_TO_SUPPLIER").alias("edge_type"), F.lit(1.0).alias("weight")),
        supplies.select(F.col("supplier_id").alias("src"), F.col("product_id").alias("dst"), F.lit("SUPPLIER_PROVIDES_PRODUCT").alias("edge_type"), F.round(F.coalesce(F.col("share_percent") / 100, F.lit(0.80)), 4).alias("weight")),
    ]
    e = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("src <> '' and dst <> ''")
    return e.groupBy("src", "dst").agg(F.max(F.struct("edge_type", "weight")).alias("e")).select("src", "dst", "e.edge_type", "e.weight")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("node_id").distinct().join(out, "node_id", "left").join(inn, "node_id", "left").select("node_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(num_nodes, num_edges, density) of a directed graph; below two nodes the density is 0."""
    n, m = nodes.select("node_id").distinct().agg(F.count("*").alias("num_nodes")), edges.agg(F.count("*").alias("num_edges"))
    full = F.col("num_nodes") * (F.col("num_nodes") - 1)
    return n.crossJoin(m).select("num_nodes", "num_edges", F.when(full > 0, F.round(F.col("num_edges") / F.when(full > 0, full), 6)).otherwise(0.0).alias("density"))


def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(degree, least, most, mean, median) of the in, out and total degrees, nodes without edges included."""
    kinds = F.array(*[F.struct(F.lit(k).alias("degree"), v.alias("n")) for k, v in (("in", F.col("in_degree")), ("out", F.col("out_degree")), ("total", F.col("in_degree") + F.col("out_degree")))])
    d = degrees(edges, nodes).select(F.explode(kinds).alias("s")).select("s.*")
    return d.groupBy("degree").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 3).alias("mean"), F.round(F.median("n"), 3).alias("median"))


def ego_network(edges: DataFrame, node: str, radius: int = 2) -> DataFrame:
    """The directed edges among the nodes that are at most ``radius`` steps from ``node`` in either direction. The edges are worked out once."""
    edges = cut(edges)
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("to")).union(edges.select("dst", "src"))
    near = edges.select(F.lit(node).alias("node_id")).limit(1)
    for _ in range(radius):
        near = cut(near.union(both.join(near, "node_id", "left_semi").select("to")).distinct())
    return edges.join(near.withColumnRenamed("node_id", "src"), "src", "left_semi").join(near.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def prune(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between registered nodes."""
    known = nodes.select("node_id").distinct()
    return edges.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(*edges.columns)


def shared_product_edges(supplies: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst): both ways between the first ``most`` suppliers of each product, in id order; the limit is the feature."""
    w = Window.partitionBy("product_id").orderBy("supplier_id")
    first = supplies.select("product_id", "supplier_id").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("product_id").agg(F.collect_list("supplier_id").alias("s"))
    pairs = first.select(F.explode("s").alias("src"), "s").select("src", F.explode("s").alias("dst")).where("src <> dst")
    return pairs.distinct()


def topology_risk(base: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, risk) from ``base(node_id, base, centrality)``: 0.60 of the node's own, 0.30 of the mean over itself and its neighbours, 0.10 of its centrality."""
    own = base.select("node_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "base")).alias("base"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "centrality")).alias("centrality"))
    both = edges.select("src", "dst").where("src <> dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst")).distinct()
    near = both.join(own.select(F.col("node_id").alias("src"), "base"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("base").alias("s"), F.count("*").alias("n"))
    mean = (F.col("base") + F.coalesce("s", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.60 * F.col("base") + 0.30 * mean + 0.10 * F.col("centrality")))
    return own.join(near, "node_id", "left").select("node_id", F.round(risk, 6).alias("risk"))


def smoothness(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean of weight times squared difference over the edges; 0 without edges."""
    s = scores.select("node_id", "score")
    j = edges.join(s.select(F.col("node_id").alias("src"), F.col("score").alias("a")), "src").join(s.select(F.col("node_id").alias("dst"), F.col("score").alias("b")), "dst")
    return j.agg(F.round(F.coalesce(F.avg(F.col("weight") * (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))), F.lit(0.0)), 6).alias("loss"))


def classifier_metrics(scored: DataFrame, cut_at: float = 0.5) -> DataFrame:
    """One row for ``scored(label, score)``: ROC-AUC with ties as halves, accuracy, precision, recall, F1 and mean absolute error.

    Equal scores are one row before the running counts, so that these pass over distinct scores only.
    """
    by = scored.where("label is not null and score is not null").groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    up = F.col("score") >= cut_at
    t = by.withColumn("below", below).agg(F.sum("p").alias("P"), F.sum("q").alias("Q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("U"), F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("q")).otherwise(0)).alias("fp"), F.sum(F.col("p") * F.abs(1 - F.col("score")) + F.col("q") * F.abs(F.col("score"))).alias("e"))
    c_, none = F.col, F.lit(0.0)
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(none)
    precision, recall = share(c_("tp"), c_("tp") + c_("fp")), share(c_("tp"), c_("P"))
    r = {"roc_auc": share(c_("U"), c_("P") * c_("Q")), "accuracy": share(c_("tp") + c_("Q") - c_("fp"), c_("P") + c_("Q")), "precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall), "mae": share(c_("e"), c_("P") + c_("Q"))}
    return t.select(*[F.round(v, 6).alias(k) for k, v in r.items()])


def average_precision(scored: DataFrame) -> DataFrame:
    """One row (pr_auc) for ``scored(label, score)``: precision at each distinct score times the recall gained there.

    Equal scores are one step. Distinct scores are dealt by range, highest first; each range counts on its own from the
    totals of the ranges above it, which are one row a range, so no task orders them all. 0 without a positive.
    """
    by = scored.where("label is not null and score is not null").groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    by = cut(by.repartitionByRange(F.col("score").desc()).withColumn("part", F.spark_partition_id()))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by.groupBy("part").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn")).select("part", F.coalesce(F.sum("tp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("tn").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("part").orderBy(F.col("score").desc())
    run = by.join(F.broadcast(base), "part").select("p", (F.sum("p").over(w) + F.col("p0")).alias("tp"), (F.sum("n").over(w) + F.col("n0")).alias("n"))
    total = F.coalesce(F.sum("p"), F.lit(0))
    return run.agg(F.round(F.when(total > 0, F.sum(F.col("p") * F.col("tp") / F.col("n")) / F.when(total > 0, total)).otherwise(F.lit(0.0)), 6).alias("pr_auc"))


def _weighted(edges: DataFrame, side: str) -> DataFrame:
    """(src, dst, w): weights as shares of their sum at ``side``; where that sum is 0 they stay as they are."""
    total = edges.groupBy(side).agg(F.sum("weight").alias("t"))
    return edges.join(total, side).select("src", "dst", (F.col("weight") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))).alias("w"))


def propagate(edges: DataFrame, shocks: DataFrame, rounds: int | None = None, damping: float = 0.60, limit: int = 15, tol: float = 1e-4) -> DataFrame:
    """(node_id, risk) by Jacobi rounds over normalised in-edges; the shock is (node_id, shock).

    Rounds end after the first whose largest change is below ``tol``, or after ``limit``; ``rounds`` asks for a
    fixed number instead. Rounds run over blocks that stay in place (``blocks.py``); the largest change of each block is all that reaches the driver.
    """
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    lost = edges.where("src is null").groupBy(F.col("dst").alias("node_id")).agg(F.sum("weight").alias("lost"))  # it counts in the sum, but carries nothing
    index = numbered(ends)
    nodes = index.select("node_id").join(shocks.groupBy("node_id").agg(F.max("shock").alias("r0")), "node_id", "left").join(lost, "node_id", "left").select("node_id", F.coalesce("r0", F.lit(0.0)).alias("r0"), F.coalesce("lost", F.lit(0.0)).cast("double").alias("lost"))
    g = graph(nodes, edges.select(F.col("dst").alias("node_id"), F.col("src").alias("source"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")), index)

    def move(block: Block, state: dict, box: Box) -> list[tuple[str, np.ndarray]]:
        weight = block.edge["weight"]
        total = np.bincount(block.a, weights=weight, minlength=block.size) + block.cols["lost"]
        p = np.bincount(block.a, weights=weight / np.where(total == 0, 1.0, total)[block.a] * box.far("r", 1)[block.b, 0], minlength=block.size)
        new = np.minimum(1.0, np.maximum(0.0, (1 - damping) * block.cols["r0"] + damping * p))
        state["moved"], state["r"] = float(np.abs(new - state["r"]).max()), new
        return [("r", new[:, None])]

    def begin(block: Block, state: dict, box: Box) -> list[tuple[str, np.ndarray]]:
        state["r"] = block.cols["r0"]
        return [("r", state["r"][:, None])]

    sent = g.step([], begin)
    for _ in range(limit if rounds is None else rounds):
        sent = g.step([sent], move)
        if rounds is None and max(g.each([sent], lambda block, state, box: state["moved"]), default=0.0) < tol:
            break
    risk = g.table(edges.sparkSession, [sent], lambda block, state, box: state["r"], "double")
    g.free()
    return risk.join(index, "idx").select("node_id", F.round("value", 4).alias("risk"))


def pagerank(edges: DataFrame, rounds: int | None = None, alpha: float = 0.85, limit: int = 100, tol: float = 1e-6, nodes: DataFrame | None = None, digits: int | None = 6) -> DataFrame:
    """(node_id, rank), weighted, dangling mass spread evenly.

    Rounds end after the first whose changes sum to less than ``tol`` times the number of nodes; if ``limit``
    rounds don't reach that, every rank is 1/n, as in the reference. ``rounds`` asks for a fixed number instead.
    Rounds run over blocks that stay in place; their changes and lost mass are all that reaches the driver. ``nodes(node_id)`` adds nodes
    without edges, ``digits`` None leaves the ranks unrounded.
    """
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst"))
    index = numbered((ends if nodes is None else ends.union(nodes.select("node_id"))).distinct())
    n = max(index.count(), 1)
    g = graph(index.select("node_id"), edges.select(F.col("dst").alias("node_id"), F.col("src").alias("source"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")), index)

    def share(state: dict) -> list[tuple[str, np.ndarray]]:
        state["lost"] = float(state["r"][state["t"] == 0].sum())
        return [("r", (state["r"] / np.where(state["t"] == 0, 1.0, state["t"]))[:, None])]

    def begin(block: Block, state: dict, box: Box) -> list[tuple[str, np.ndarray]]:
        state |= {"t": box.back("back", 1)[:, 0], "r": np.full(block.size, 1.0 / n)}
        return share(state)

    def move(lost: float):
        def work(block: Block, state: dict, box: Box) -> list[tuple[str, np.ndarray]]:
            p = np.bincount(block.a, weights=block.edge["weight"] * box.far("r", 1)[block.b, 0], minlength=block.size)
            new = (1 - alpha) / n + alpha * (p + lost / n)
            state["moved"], state["r"] = float(np.abs(new - state["r"]).sum()), new
            return share(state)

        return work

    leaving = lambda block, state, box: [("back", np.bincount(block.b, weights=block.edge["weight"], minlength=block.far)[:, None])]
    sent, settled = g.step([g.step([], leaving)], begin), rounds is not None
    lost = sum(g.each([sent], lambda block, state, box: state["lost"]))
    for _ in range(limit if rounds is None else rounds):
        sent = g.step([sent], move(lost))
        found = g.each([sent], lambda block, state, box: (state["moved"], state["lost"]))
        lost = sum(x for _, x in found)
        if rounds is None and sum(x for x, _ in found) < tol * n:
            settled = True
            break
    rank = g.table(edges.sparkSession, [sent], lambda block, state, box: state["r"] if settled else np.full(block.size, 1.0 / n), "double")
    g.free()
    return rank.join(index, "idx").select("node_id", (F.col("value") if digits is None else F.round("value", digits)).alias("rank"))


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)
