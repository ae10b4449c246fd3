"""Hard negatives by blocked dense products: blocks of anchors meet blocks of candidates, twice.

The first pass keeps each anchor's best positives block by block and merges them; the second keeps, for each positive,
the best rows of other labels whose score lies in a window below the positive's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import stored
from faultline.llm.vectors import CANDIDATES, matrix, spread

#: Most anchors of a block: a block's scores are ANCHORS by CANDIDATES doubles, 128 MB with their integers.
ANCHORS = 512


def products(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Anchor by candidate; in doubles while no sum can reach 2**53, else in 64-bit integers."""
    a, b = matrix(left["v"]), matrix(right["v"])
    exact = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**52
    kind = np.float64 if exact else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def top(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the candidates ``at``, the k of highest score, ties to the smaller id."""
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def positives(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(anchor_id, positive_id, positive_score): a block's k best rows of each anchor's label."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(left) and len(right):
        s, ids, label = products(left, right), right["vec_id"].to_numpy(), right["label"].to_numpy()
        for row, own, of in zip(s, left["vec_id"].to_pylist(), left["label"].to_pylist(), strict=True):
            best = top(row, ids, np.flatnonzero((label == of) & (ids != own)), k)
            out.append((np.full(len(best), own, np.int64), ids[best], row[best]))
    return _table(out, ["anchor_id", "positive_id", "positive_score"])


def negatives(left: pa.Table, right: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """(anchor_id, positive_score, negative_id, negative_score): a block's k best other labels in the window of each different score."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(left) and len(right):
        s, ids, label = products(left, right), right["vec_id"].to_numpy(), right["label"].to_numpy()
        for row, own, of, wanted in zip(s, left["vec_id"].to_pylist(), left["label"].to_pylist(), left["scores"].to_pylist(), strict=True):
            other = np.flatnonzero((label != of) & (ids != own))
            for p in sorted(set(wanted)):
                best = top(row, ids, other[(100 * row[other] >= low * p) & (100 * row[other] <= high * p)], k)
                out.append((np.full(len(best), own, np.int64), np.full(len(best), p, np.int64), ids[best], row[best]))
    return _table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i, n in enumerate(names)})


def first(rows: DataFrame, group: list[str], score: str, key: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(key))
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, every: int = 100, k_positive: int = 5, k_negative: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows whose id is divisible by ``every``.

    Components become floor(scale * x); scores are integer inner products, which must fit 64 bits, 100 times over.
    Rows with a null id or label, or a null or empty vector or one with null or non-finite components, take no part;
    rows of another length are no candidates. Where an anchor's id repeats, the row of the least label and vector is
    the anchor, and no row of its id is its candidate; repeated candidates each count. An anchor without positives, or
    a positive without a row in its window, gives no row, nor does an empty table. Blocks of anchors and candidates are
    of bounded size, so the stated query set meets all rows block by block.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("a")).select("vec_id", "a.*")
    total, asked = rows.count(), anchors.count()
    lanes, lots = max(1, -(-total // CANDIDATES)), max(1, -(-asked // ANCHORS))
    right = rows.withColumn("lane", spread(F.col("vec_id"), total, CANDIDATES)).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    cut = ["dim", "lane", "lot"]

    def meet(left: DataFrame, kernel, schema: str) -> DataFrame:
        left = left.withColumn("lot", spread(F.col("vec_id"), asked, ANCHORS).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        one, other = (x.toDF(*x.columns) for x in (left, right))
        return one.groupBy(*cut).cogroup(other.groupBy(*cut)).applyInArrow(kernel, schema)

    part = meet(anchors, lambda x, y: positives(x, y, k_positive), "anchor_id long, positive_id long, positive_score long")
    chosen = stored(first(part, ["anchor_id"], "positive_score", "positive_id", k_positive, "place"), "positives")
    wanted = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))
    part = meet(anchors.join(wanted, "vec_id"), lambda x, y: negatives(x, y, k_negative, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    best = first(part, ["anchor_id", "positive_score"], "negative_score", "negative_id", k_negative, "rank")
    return chosen.join(best, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
