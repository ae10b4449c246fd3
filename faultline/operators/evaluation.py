"""Measures of extracted events, links, duplicates and alerts against what is known, each one aggregate over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """One row (precision, recall, f1, samples) for ``pairs(truth, predicted)``: the measures of each class weighted by its true rows.

    A class without predictions has a precision of 0. A null is a class of its own, named None. Every pair of classes is
    counted before anything is joined, so the work after that pass grows with the classes only.
    """
    name = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("None"))
    cells = pairs.groupBy(name("truth").alias("truth"), name("predicted").alias("predicted")).agg(F.count("*").alias("n"))
    # each cell counts once for its true class and once for its predicted one
    sides = F.array(F.struct(F.col("truth").alias("kind"), F.lit(True).alias("own")), F.struct(F.col("predicted").alias("kind"), F.lit(False).alias("own")))
    hit = F.col("truth") == F.col("predicted")
    by = cells.select("n", hit.alias("hit"), F.explode(sides).alias("s")).groupBy("s.kind").agg(
        F.coalesce(F.sum(F.when(F.col("s.own"), F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(~F.col("s.own"), F.col("n"))), F.lit(0)).alias("said"), F.coalesce(F.sum(F.when(F.col("s.own") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp")
    )
    p, r = _share(F.col("tp"), F.col("said")), _share(F.col("tp"), F.col("support"))
    each = {"precision": p, "recall": r, "f1": _share(2 * p * r, p + r)}
    # sums of whole billionths are the same in whatever order the classes are added
    whole = by.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("samples"), *[F.coalesce(F.sum(F.round(v * F.col("support") * 1e9).cast("decimal(38,0)")), F.lit(0)).cast("double").alias(k) for k, v in each.items()])
    return whole.select(*[F.round(_share(F.col(k) / 1e9, F.col("samples")), 4).alias(k) for k in each], "samples")


def link_target(text: Column, kind: Column) -> Column:
    """The id that a mention's first number stands for; null without a number or for another kind of entity."""
    upper, number = F.upper(text), F.regexp_extract(text, r"\d+", 0)
    digits = F.lpad(F.regexp_replace(number, r"^0+(?=\d)", ""), 5, "0")
    digits = F.when(F.length(F.regexp_replace(number, r"^0+(?=\d)", "")) > 5, F.regexp_replace(number, r"^0+(?=\d)", "")).otherwise(digits)
    k = F.upper(kind)
    prefix = F.when(upper.contains("SUPPLIER") | (k == "ORG"), "SUP").when(upper.contains("LOCATION") | k.isin("GPE", "LOC"), "LOC").when(upper.contains("PRODUCT") | (k == "PRODUCT"), "PROD")
    return F.when(number != "", F.concat(prefix, digits))


def link_metrics(links: DataFrame) -> DataFrame:
    """One row (accuracy, mean_confidence, samples) for ``links(entity_text, entity_type, linked_id, confidence)``.

    A link is right if it is the id that the mention's number stands for; a wrong or missing one counts with confidence
    0, a right one without a confidence with 0.5. Mentions without such an id are left out; without any, all are 0.
    """
    t = links.select(link_target(F.col("entity_text"), F.col("entity_type")).alias("target"), "linked_id", F.col("confidence").cast("double").alias("confidence")).where("target is not null")
    right = F.coalesce(F.col("linked_id") == F.col("target"), F.lit(False))
    sure = F.sum(F.when(right, F.round(F.coalesce("confidence", F.lit(0.5)) * 1e6).cast("long")).otherwise(F.lit(0)))
    whole = t.agg(F.count("*").alias("samples"), F.count_if(right).alias("right"), F.coalesce(sure, F.lit(0)).alias("sure"))
    return whole.select(F.round(_share(F.col("right"), F.col("samples")), 4).alias("accuracy"), F.round(_share(F.col("sure") / 1e6, F.col("samples")), 4).alias("mean_confidence"), "samples")


def agreement(cases: DataFrame) -> DataFrame:
    """One row (accuracy, test_cases) for ``cases(expected, found)``; a null agrees with a null only."""
    whole = cases.agg(F.count("*").alias("test_cases"), F.count_if(F.col("expected").eqNullSafe(F.col("found"))).alias("right"))
    return whole.select(_share(F.col("right"), F.col("test_cases")).alias("accuracy"), "test_cases")


def severe_share(alerts: DataFrame, band: str = "risk_level") -> DataFrame:
    """One row (precision_proxy, alerts): the share of HIGH and CRITICAL among all alerts, those without a band included; 0 without alerts."""
    whole = alerts.agg(F.count("*").alias("alerts"), F.count_if(F.coalesce(F.col(band).isin("HIGH", "CRITICAL"), F.lit(False))).alias("severe"))
    return whole.select(F.round(_share(F.col("severe"), F.col("alerts")), 3).alias("precision_proxy"), "alerts")
