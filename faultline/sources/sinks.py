"""Sinks that append what is new, and the records of a run. Tables are Parquet; nothing already stored is rewritten."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from faultline.sources.files import first_found

Key = Sequence[Column]


def _text(x: str, lower: bool = False) -> Column:
    t = F.trim(F.coalesce(F.col(x).cast("string"), F.lit("")))
    return F.lower(t) if lower else t


def _spot(x: str) -> Column:
    return F.coalesce(F.col(x).cast("string"), F.lit(""))


def news_keys() -> list[Key]:
    """An article is known by its url or by its id."""
    return [[_text("url", True)], [_text("article_id")]]


def event_keys() -> list[Key]:
    return [[_text("event_id")]]


def entity_keys() -> list[Key]:
    return [[_text("article_id"), _spot("character_start"), _spot("character_end")]]


def link_keys() -> list[Key]:
    return [[_text("entity_text", True), _text("linked_id"), _text("entity_type")]]


def unseen(new: DataFrame, held: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """Rows of ``new`` of which no key occurs in ``held``; repeats within ``new`` stay. Null parts of a key are empty text."""
    names = new.columns
    left = new
    for i, key in enumerate(keys):
        parts = [f"_key{i}_{j}" for j in range(len(key))]
        # Each known key once: a key that many stored rows share is one row of the join.
        known = held.select(*[x.alias(p) for x, p in zip(key, parts, strict=True)]).distinct()
        left = left.withColumns(dict(zip(parts, key, strict=True))).join(known, parts, "left_anti")
    return left.select(*names)


def append_new(new: DataFrame, path: str, keys: Sequence[Key], columns: Sequence[str] | None = None, defaults: dict[str, str] | None = None) -> int:
    """Appends the unseen rows to the table at ``path`` and returns how many; a table that isn't there is begun with all rows.

    With ``columns`` the rows have just these, and one that they lack is its default or empty text.
    """
    if columns is not None:
        new = new.select(*[F.col(x) if x in new.columns else F.lit((defaults or {}).get(x, "")).alias(x) for x in columns])
    count = Observation()
    fresh = unseen(new, first_found(new.sparkSession, [path], new.schema), keys)
    fresh.observe(count, F.count("*").alias("n")).write.mode("append").parquet(path)
    return count.get["n"]


def raw_response(responses: DataFrame, path: str, query: str, stamp: str) -> str:
    """Responses as JSON in a folder of their own, named by the time and the query; returns the folder."""
    slug = re.sub(r"[^\w]+", "_", query.strip().lower())[:30] or "query"
    at = f"{path}/{stamp}_{slug}"
    responses.write.json(at)
    return at


def export_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as they are exported; what is missing has a default."""
    fill = {"node_type": F.lit("UNKNOWN"), "label": F.col("node_id"), "source": F.lit("GRAPH_BUILDER"), "data_status": F.lit("SYNTHETIC_DEMO")}
    return nodes.select("node_id", *[(F.coalesce(F.col(x), y) if x in nodes.columns else y).alias(x) for x, y in fill.items()])


def export_edges(edges: DataFrame) -> DataFrame:
    """Edges as they are exported, weights at four digits."""
    fill = {"edge_type": F.lit("RELATION"), "weight": F.lit(1.0), "data_status": F.lit("SYNTHETIC_DEMO")}
    out = edges.select("source", "target", *[(F.coalesce(F.col(x), y) if x in edges.columns else y).alias(x) for x, y in fill.items()])
    return out.withColumn("weight", F.round(F.col("weight").cast("double"), 4))


def run_metrics(retrieved: DataFrame, relevant: DataFrame, alerts: DataFrame, model: str, generated_at: Column, level: str = "combined_risk_level", data_status: str = "SYNTHETIC_DEMO") -> DataFrame:
    """One row of counts of a run; aggregates of each table meet, never their rows."""
    n = lambda df, x: df.agg(F.count("*").alias(x))
    a = alerts.agg(F.count("*").alias("alerts_generated"), F.count_if(F.col(level) == "CRITICAL").alias("critical_alerts"), F.count_if(F.col(level) == "HIGH").alias("high_alerts"))
    rows = n(retrieved, "articles_retrieved").join(n(relevant, "articles_relevant")).join(a)
    return rows.select("*", F.upper(F.lit(model)).alias("model_used"), generated_at.alias("generated_at"), F.lit(data_status).alias("data_status"))


def feedback(reviews: DataFrame, created_at: Column) -> DataFrame:
    """Audit rows of ``reviews(alert_id, decision[, analyst_id, comment, recommended_action])``, to be appended; an empty analyst is the default one."""
    text = lambda x: F.coalesce(F.col(x), F.lit("")) if x in reviews.columns else F.lit("")
    who = text("analyst_id")
    number = F.concat(F.lit("FB-"), F.upper(F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 8)))
    return reviews.select(number.alias("feedback_id"), "alert_id", F.upper("decision").alias("decision"), F.when(who == "", F.lit("analyst_default")).otherwise(who).alias("analyst_id"), text("comment").alias("comment"), text("recommended_action").alias("recommended_action"), created_at.alias("created_at"))
