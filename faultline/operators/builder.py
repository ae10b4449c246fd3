"""The whole supply graph from relational tables: typed nodes with attributes, seven edge types, pruning, and dense indices by type.

Every table contributes rows with a place in an order. Of a node each attribute is the last one contributed, of an edge
the last contribution counts as a whole: both are one aggregate, whatever the number of tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import gnn, lookup
from faultline.operators.connect import cut

#: Attributes of nodes, and the derived chains (type of node, most pairs, weight, type of edge).
ATTRIBUTES = {
    "node_type": "string", "label": "string", "tier": "int", "criticality": "string", "country": "string", "category": "string", "city": "string", "latitude": "double", "longitude": "double",
    "published_at": "string", "event_category": "string", "severity": "double", "facility_type": "string", "ownership": "string", "source": "string", "data_status": "string",
}
CHAINS = (("SUPPLIER", 500, 0.75, "SUPPLIER_DEPENDS_ON_SUPPLIER"), ("PRODUCT", 400, 0.70, "PRODUCT_DEPENDS_ON_PRODUCT"))
DEMO = "SYNTHETIC_DEMO"


@dataclass(frozen=True)
class Graph:
    """nodes (node_id and ATTRIBUTES) and edges (source, target, edge_type, weight, data_status) after pruning; removed edges, and the ends that no table knows."""

    nodes: DataFrame
    edges: DataFrame
    removed: DataFrame
    ghosts: DataFrame


def _id(x: str) -> Column:
    """A trimmed id; empty text and the text nan are none."""
    t = F.trim(F.col(x).cast("string"))
    return F.when((t != "") & (t != "nan"), t)


def _value(df: DataFrame, x: str, default: Column | str | float | None, kind: str = "string") -> Column:
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.col(x).cast(kind), d.cast(kind)) if x in df.columns else d.cast(kind)


def _order(df: DataFrame) -> Column:
    """The row's place in its table: its ordinal, or else a digest of the row, so that the order is always total and the same."""
    return F.col("ordinal").cast("long") if "ordinal" in df.columns else F.xxhash64(*df.columns)


def _nodes(df: DataFrame | None, prio: int, key: Column, **attrs: Column) -> DataFrame | None:
    if df is None:
        return None
    return df.select(key.alias("node_id"), F.lit(prio).alias("prio"), _order(df).alias("at"), *[attrs.get(a, F.lit(None)).cast(k).alias(a) for a, k in ATTRIBUTES.items()]).where("node_id is not null")


def _edges(df: DataFrame | None, prio: int, source: Column, target: Column, kind: Column | str, weight: Column | float, where: Column | None = None) -> DataFrame | None:
    if df is None:
        return None
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    e = df if where is None else df.where(where)
    return e.select(source.alias("source"), target.alias("target"), F.lit(prio).alias("prio"), _order(df).alias("at"), as_col(kind).alias("edge_type"), F.round(as_col(weight).cast("double"), 4).alias("weight"), _value(df, "data_status", DEMO).alias("data_status")).where("source is not null and target is not null")


def _all(parts: list[DataFrame | None]) -> DataFrame:
    found = [p for p in parts if p is not None]
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    return out


def build(suppliers: DataFrame, products: DataFrame, locations: DataFrame, supplier_products: DataFrame, supplier_locations: DataFrame, news: DataFrame | None = None, events: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """The graph of the tables, each with the columns of its name and, for the order of its rows, ``ordinal``.

    Exported ``nodes`` (node_id, ...) come first and are enriched by the tables, exported ``edges`` (source, target, ...)
    come last and overwrite. Rows without an id are left out, missing columns have defaults. Suppliers and products
    are chained in the order in which they first occur where no edge of the chain's type is there. Edges to ids that
    no table knows go. Empty tables give an empty graph; rows that repeat an id are merged, the last one's values first.
    """
    v, fac = _value, _facility()
    supplier_locations = cut(supplier_locations)
    merged = _merged(suppliers, products, locations, supplier_locations, news, events, nodes)
    known = cut(merged.select("node_id", "node_type", "_first"))
    share = F.round(F.when(F.col("share_percent").isNull(), 0.80).otherwise(F.col("share_percent").cast("double") / 100), 3) if "share_percent" in supplier_products.columns else F.lit(0.5)
    place = _id("location_id")
    drawn = _all([
        _edges(supplier_locations, 7, place, fac, "LOCATION_AFFECTS_FACILITY", 0.90), _edges(supplier_locations, 7, fac, _id("supplier_id"), "FACILITY_BELONGS_TO_SUPPLIER", 1.0),
        _edges(supplier_products, 8, _id("supplier_id"), _id("product_id"), "SUPPLIER_PROVIDES_PRODUCT", share),
        _edges(events, 9, _id("article_id") if events is not None and "article_id" in events.columns else F.lit(None), _id("event_id"), "NEWS_HAS_EVENT", 0.95),
        events and _edges(events, 9, _id("event_id"), place, "EVENT_AT_LOCATION", 0.90, where=place != "UNKNOWN"),
        edges and _edges(edges, 10, _id("source"), _id("target"), _value(edges, "edge_type", "RELATION"), _value(edges, "weight", 1.0, "double")),
    ])
    one = F.max(F.struct("prio", "at", "edge_type", "weight", "data_status")).alias("e")
    whole = cut(drawn.groupBy("source", "target").agg(one).select("source", "target", "e.edge_type", "e.weight", "e.data_status"))
    for kind, most, weight, name in CHAINS:
        some = known.where(F.col("node_type") == kind).select("node_id", F.col("_first").alias("ordinal"))
        chained = cut(lookup.chain_if_none(whole, lookup.chain(some, most, weight, name)))  # at most ``most`` rows, which replace edges between the same ends
        whole = whole.join(F.broadcast(chained.select("source", "target")), ["source", "target"], "left_anti").unionByName(chained)
    end = lambda side: known.select(F.col("node_id").alias(side), F.lit(True).alias(f"_{side}"))
    ends = cut(whole.join(end("source"), "source", "left").join(end("target"), "target", "left"))
    kept = ends.where("_source and _target").drop("_source", "_target")
    lost = ends.where("_source is null or _target is null")
    ghost = F.explode(F.filter(F.array(F.when(F.col("_source").isNull(), F.col("source")), F.when(F.col("_target").isNull(), F.col("target"))), lambda x: x.isNotNull()))
    return Graph(merged.drop("_first"), kept, lost.select("source", "target"), lost.select(ghost.alias("node_id")).distinct())


def nodes_of(suppliers: DataFrame, products: DataFrame, locations: DataFrame, supplier_locations: DataFrame, news: DataFrame | None = None, events: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """The nodes of ``build`` alone: they don't depend on the edges, which are not made."""
    return _merged(suppliers, products, locations, cut(supplier_locations), news, events, nodes).drop("_first")


def _facility() -> Column:
    return F.concat(F.lit("FAC_"), _id("supplier_id"), F.lit("_"), _id("location_id"))


def _merged(suppliers: DataFrame, products: DataFrame, locations: DataFrame, supplier_locations: DataFrame, news: DataFrame | None, events: DataFrame | None, nodes: DataFrame | None) -> DataFrame:
    """One row an id with its attributes' last values and, as _first, where it first came. Ids that stand in one row only, most of them, pass as they are."""
    v, fac = _value, _facility()
    made = _all([
        nodes and _nodes(nodes, 1, _id("node_id"), node_type=F.upper(v(nodes, "node_type", "UNKNOWN")), label=v(nodes, "label", _id("node_id")), source=v(nodes, "source", "PROJECT_DEMO_EXPANSION"), data_status=v(nodes, "data_status", DEMO)),
        _nodes(suppliers, 2, _id("supplier_id"), node_type=F.lit("SUPPLIER"), label=v(suppliers, "supplier_name", _id("supplier_id")), tier=v(suppliers, "tier", 1, "int"), criticality=v(suppliers, "criticality", "Medium"), country=v(suppliers, "country", ""), source=v(suppliers, "source", "MASTER_SUPPLIERS"), data_status=v(suppliers, "data_status", DEMO)),
        _nodes(products, 3, _id("product_id"), node_type=F.lit("PRODUCT"), label=v(products, "product_name", _id("product_id")), category=v(products, "category", ""), criticality=v(products, "criticality", "Medium"), source=v(products, "source", "MASTER_PRODUCTS"), data_status=v(products, "data_status", DEMO)),
        _nodes(locations, 4, _id("location_id"), node_type=F.lit("LOCATION"), label=v(locations, "location_name", _id("location_id")), city=v(locations, "city", ""), country=v(locations, "country", ""), latitude=v(locations, "latitude", 0.0, "double"), longitude=v(locations, "longitude", 0.0, "double"), source=v(locations, "source", "MASTER_LOCATIONS"), data_status=v(locations, "data_status", DEMO)),
        news and _nodes(news, 5, _id("article_id"), node_type=F.lit("NEWS"), label=F.substring(v(news, "title", _id("article_id")), 1, 100), published_at=v(news, "published_at", ""), source=v(news, "source_name", "NEWS_FEED"), data_status=v(news, "data_status", DEMO)),
        events and _nodes(events, 6, _id("event_id"), node_type=F.lit("EVENT"), label=v(events, "event_type", _id("event_id")), event_category=v(events, "event_category", "Disruption"), severity=v(events, "severity", 3.0, "double"), source=v(events, "source_url", "NLP_EVENT_EXTRACTION"), data_status=v(events, "data_status", DEMO)),
        _nodes(supplier_locations, 7, fac, node_type=F.lit("FACILITY"), label=F.concat(F.lit("Facility "), _id("supplier_id"), F.lit("-"), _id("location_id")), facility_type=v(supplier_locations, "facility_type", "Manufacturing"), ownership=v(supplier_locations, "ownership", "Owned"), source=F.lit("SUPPLIER_LOCATIONS"), data_status=v(supplier_locations, "data_status", DEMO)),
    ])
    turn = F.struct("prio", "at")
    last = {a: F.max(F.when(F.col(a).isNotNull(), F.struct("prio", "at", a)))[a].alias(a) for a in ATTRIBUTES}
    often = cut(made.groupBy("node_id").agg(F.count("*").alias("_n")).where("_n > 1").select("node_id"))
    alone = made.select("node_id", *ATTRIBUTES, turn.alias("_first"))
    if often.isEmpty():
        return alone
    once = alone.join(often, "node_id", "left_anti")
    return once.unionByName(made.join(often, "node_id", "left_semi").groupBy("node_id").agg(*last.values(), F.min(turn).alias("_first")))


def summary(g: Graph) -> DataFrame:
    """(part, kind, n): the nodes and edges of each type, and in all; edges removed and ids that no table knows."""
    by = lambda df, part, kind: cut(df.groupBy(F.lit(part).alias("part"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")))
    add = lambda df, part, n: df.agg(n.alias("n")).select(F.lit(part).alias("part"), F.lit("all").alias("kind"), "n")
    nodes, edges = by(g.nodes, "nodes", "node_type"), by(g.edges, "edges", "edge_type")
    total, rows = F.coalesce(F.sum("n"), F.lit(0).cast("long")), F.count("*")
    return _all([nodes, edges, add(nodes, "nodes", total), add(edges, "edges", total), add(g.removed, "removed", rows), add(g.ghosts, "ghosts", rows)])


def indexed(nodes: DataFrame) -> DataFrame:
    """(node_type, node_id, idx): in each type the ids in order, from 0 and without gaps.

    Types and ids are dealt by range; a range counts its own and starts where the ranges before it end, which are one
    row a range and type. No task orders a whole type.
    """
    # stored before and after: the ranges must be the same for the counts and for the places
    ids = cut(nodes.select("node_type", "node_id").distinct())
    dealt = cut(ids.repartitionByRange("node_type", "node_id").withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("node_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = dealt.groupBy("node_type", "part").agg(F.count("*").alias("n")).select("node_type", "part", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part", "node_type").orderBy("node_id"))
    return dealt.join(F.broadcast(base), ["node_type", "part"]).select("node_type", "node_id", (F.col("base") + place - 1).alias("idx"))


def relations(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(src_type, edge_type, dst_type, src_idx, dst_idx, weight): the edges of each relation by the indices of both types; null weights are 1."""
    end = lambda side: index.select(F.col("node_id").alias("source" if side == "src" else "target"), F.col("node_type").alias(f"{side}_type"), F.col("idx").alias(f"{side}_idx"))
    j = edges.join(end("src"), "source").join(end("dst"), "target")
    return j.select("src_type", "edge_type", "dst_type", "src_idx", "dst_idx", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def encode(g: Graph) -> tuple[DataFrame, DataFrame]:
    """((node_type, idx, node_id, x), relations): every node's place in its type with its feature vector, and the edges by places."""
    index = cut(indexed(g.nodes))
    x = gnn.typed_vectors(g.nodes, g.edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return index.join(x, "node_id").select("node_type", "idx", "node_id", F.col("h").alias("x")), relations(g.edges, index)
