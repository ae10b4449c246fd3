"""The sixteen-feature table of a supply graph: kinds, exposure, criticality, dependency, risk and degrees of each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import columns as c
from faultline.operators.connect import cut

# Kinds of nodes and names of the features, in their order.
KINDS = ("SUPPLIER", "PRODUCT", "LOCATION", "FACILITY", "EVENT", "NEWS")
FEATURES = (
    *(f"is_{k.lower()}" for k in KINDS), "event_severity", "geographic_exposure", "supplier_criticality", "product_criticality", "dependency_strength",
    "single_source_dependency", "deterministic_risk", "norm_in_degree", "norm_out_degree", "norm_total_degree",
)


def seeds(labels: DataFrame) -> DataFrame:
    """(node_id, seed): the known risk of each id of ``labels``, in [0, 1] where it was of 100.

    The id is supplier_id or else entity_id, the risk deterministic_risk or else risk_score. What doesn't read as a finite
    number is no risk; of an id that repeats the greatest counts. Without these columns there are no seeds.
    """
    have = labels.columns
    key, score = "supplier_id" if "supplier_id" in have else "entity_id", "deterministic_risk" if "deterministic_risk" in have else "risk_score"
    if key not in have or score not in have:
        return labels.sparkSession.createDataFrame([], "node_id string, seed double")
    n = c.safe_float(F.col(score), -1e308)
    return labels.select(F.col(key).cast("string").alias("node_id"), n.alias("n")).where("node_id is not null and n > -1e308").groupBy("node_id").agg(F.max(F.when(F.col("n") > 1, F.col("n") / 100).otherwise(F.col("n"))).alias("seed"))


def features16(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, pruned: bool = False) -> DataFrame:
    """(node_id, node_type, x, y) for ``nodes(node_id, ...)`` and ``edges(source, target)``: the FEATURES as an array, and the seed or 0.

    Missing or unreadable values have defaults: severity 0 (above 1 it is of 5), exposure 0.20, criticality 0.50 of a
    node's own kind and else 0, dependency 0.50, risk 0.30 unless there is a seed. Every edge row between known nodes
    counts for the degrees, which are shares of the greatest total. Nodes without an id are left out; a table without
    kinds holds suppliers; ``pruned`` says that every edge is between known nodes. Degrees are sums by end, so that a hub is one row after the first aggregation.
    """
    have = set(nodes.columns)
    text = lambda x, default: F.coalesce(F.col(x).cast("string"), F.lit("")) if x in have else F.lit(default)

    def number(*names: str, default: Column | float) -> Column:
        found = [F.col(x).cast("string") for x in names if x in have]
        n = c.safe_float(F.coalesce(*found), float("-inf")) if found else F.lit(float("-inf"))
        return F.when(n == float("-inf"), default if isinstance(default, Column) else F.lit(default)).otherwise(n)

    ids = nodes.select(F.col("node_id").cast("string").alias("_id")).where("_id is not null").distinct()
    ends = edges.select(F.trim(F.col("source").cast("string")).alias("source"), F.trim(F.col("target").cast("string")).alias("target"))
    ends = ends if pruned else ends.join(ids.withColumnRenamed("_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("_id", "target"), "target", "left_semi")
    one = F.array(F.struct(F.col("source").alias("_id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("_id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degree = cut(ends.select(F.explode(one).alias("s")).groupBy("s._id").agg(F.sum("s.out").alias("_out"), F.sum("s.into").alias("_in")))
    top = degree.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.col("_out") + F.col("_in")), F.lit(1))).alias("_top"))
    kind = F.trim(F.upper(text("node_type", "SUPPLIER")))
    own = {"supplier": F.when(kind == "SUPPLIER", 0.50).otherwise(0.0), "product": F.when(kind == "PRODUCT", 0.50).otherwise(0.0)}
    sev = number("event_severity", "severity", default=0.0)
    values = nodes.where("node_id is not null").select(
        F.col("node_id").cast("string").alias("_id"), kind.alias("node_type"), F.when(sev > 1, sev / 5).otherwise(sev).alias("_sev"), number("geographic_exposure", "exposure_score", default=0.20).alias("_geo"),
        *[number(f"{k}_criticality", default=v).alias(f"_{k}") for k, v in own.items()], number("dependency_strength", default=0.50).alias("_dep"),
        F.when(F.upper(text("single_source", "FALSE")).isin("TRUE", "YES", "1"), 1.0).otherwise(0.0).alias("_single"), number("deterministic_risk", default=0.30).alias("_risk"),
    )
    values = values.join(degree, "_id", "left").join(F.broadcast(top))
    values = values.join(seeds(labels).withColumnRenamed("node_id", "_id"), "_id", "left") if labels is not None else values.withColumn("seed", F.lit(None).cast("double"))
    share = lambda n: F.coalesce(n, F.lit(0)) / F.col("_top")
    x = [*[F.when(F.col("node_type") == k, 1.0).otherwise(0.0) for k in KINDS], *[F.col(f"_{n}") for n in ("sev", "geo", "supplier", "product", "dep", "single")], F.coalesce("seed", F.col("_risk")), share(F.col("_in")), share(F.col("_out")), share(F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0)))]
    return values.select(F.col("_id").alias("node_id"), "node_type", F.array(*x).alias("x"), F.coalesce("seed", F.lit(0.0)).alias("y"))
