"""Places named in texts, chains of nodes, and row filters of the served pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import catalogue

#: Terms to a block; a text meets every block once, whatever the number of terms.
BLOCK = 5000
#: Lanes of texts that each have a copy of the blocks, so that a join that isn't broadcast is spread over as many keys.
LANES = 32


def match_location(texts: DataFrame, terms: DataFrame, id_col: str = "article_id", text_col: str = "content") -> DataFrame:
    """(id, location_id): the first of ``terms(at, term, location_id)`` that stands anywhere in the lower-cased text, else UNKNOWN.

    Null texts and null or empty terms match nothing. Ids are taken to be distinct; rows that repeat one become one row.
    Terms of up to ``catalogue.NAME_BYTES`` are found in one pass over each text. More are laid into arrays of
    ``BLOCK``, so that texts are multiplied by blocks and not by terms.
    """
    found = terms.where("term <> ''")
    short = catalogue.listed(found, "term", "at", "location_id")
    if short is not None:
        ordered = sorted((at, term, place) for term, at, place in short)
        known = F.struct((F.col("location_id") == "UNKNOWN").alias("no"), F.col("_at"), F.col("location_id"))
        hits = catalogue.first_term(texts, [(at, term, f"{i}:{place}") for i, (at, term, place) in enumerate(ordered)], id_col, text_col)
        hits = hits.withColumn("_at", F.substring_index("location_id", ":", 1).try_cast("long")).withColumn("location_id", F.when(F.col("_at").isNull(), F.col("location_id")).otherwise(F.regexp_replace("location_id", r"^\d+:", "")))
        return hits.groupBy(id_col).agg(F.min(known).alias("m")).select(id_col, F.col("m.location_id").alias("location_id"))
    blocks = found.withColumn("b", F.floor(F.col("at") / BLOCK)).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("at", "term", "location_id"))).alias("terms"))
    numbers = blocks.agg(F.collect_list("b").alias("_all"))  # one row, a number a block
    t = texts.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text")).join(F.broadcast(numbers))
    t = t.select("_id", "_text", F.explode_outer("_all").alias("b"), F.pmod(F.xxhash64("_id"), F.lit(LANES)).alias("lane"))
    j = t.join(blocks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LANES - 1).cast("long")))), ["b", "lane"], "left")
    first = F.try_element_at(F.filter("terms", lambda x: F.coalesce(F.col("_text").contains(x["term"]), F.lit(False))), F.lit(1))
    best = j.select("_id", first.alias("m")).groupBy("_id").agg(F.min(F.struct(F.col("m").isNull().alias("no"), "m")).alias("best"))
    return best.select(F.col("_id").alias(id_col), F.coalesce("best.m.location_id", F.lit("UNKNOWN")).alias("location_id"))


def chain(nodes: DataFrame, most: int, weight: float, edge_type: str, id_col: str = "node_id", order_col: str = "ordinal") -> DataFrame:
    """Edges from each node to the one before it, for the first ``most`` pairs of the order; ``most`` + 1 rows meet in the window."""
    first = nodes.orderBy(order_col, id_col).limit(most + 1)
    before = F.lag(id_col).over(Window.orderBy(order_col, id_col))
    return first.select(F.col(id_col).alias("source"), before.alias("target")).where("target is not null").select("*", F.lit(edge_type).alias("edge_type"), F.lit(weight).alias("weight"), F.lit("SYNTHETIC_DEMO").alias("data_status"))


def chain_if_none(edges: DataFrame, chained: DataFrame) -> DataFrame:
    """``chained`` where ``edges`` has no edge of that type yet, else nothing."""
    held = edges.select("edge_type").distinct()
    return chained.join(held, "edge_type", "left_anti").select(*chained.columns)


def within(df: DataFrame, most: float, distance_col: str = "distance_km") -> DataFrame:
    """Rows of at most that distance; an unknown distance stays."""
    return df.where(F.col(distance_col).isNull() | (F.col(distance_col) <= most))


def finite(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns all read as finite numbers."""
    for x in cols:
        v = F.col(x).cast("string").try_cast("double")
        df = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df


def gate(df: DataFrame, relevant: Column) -> DataFrame:
    """The relevant rows; a table of a single row passes as it is."""
    more = df.limit(2).agg((F.count("*") > 1).alias("_many"))
    return df.join(F.broadcast(more)).where(~F.col("_many") | relevant).drop("_many")


def latest_first(df: DataFrame, *cols: str) -> list[Column]:
    """The order of served pages: status, then the given columns, all descending, then the id if there is one."""
    return [F.col(x).desc() for x in ("data_status", *cols)] + [F.col(x) for x in df.columns if x in ("alert_id", "article_id", "event_id")][:1]


def options(df: DataFrame, *cols: str) -> DataFrame:
    """(field, value): the distinct values of each column as text, to choose from; null and empty ones are none."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).cast("string").alias("value")) for x in cols]))
    return df.select(each.alias("o")).select("o.*").where("value <> ''").distinct()


def labelled(features: DataFrame, labels: DataFrame, key: str = "supplier_id") -> DataFrame:
    """The features of every labelled entity with its deterministic_risk; ``labels`` are by entity_id, or else by the key."""
    by = "entity_id" if "entity_id" in labels.columns else key
    return features.join(labels.select(F.col(by).alias(key), "deterministic_risk"), key)
