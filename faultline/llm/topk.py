"""Exact top-k search by columnar branch and bound.

Candidates lie column by column. Inner products grow by blocks of dimensions; after each block the mass that
remains bounds what a candidate can still reach, and those that cannot enter the k best are dropped and the rest compacted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.vectors import CANDIDATES, QUERIES, answers, best, matrix, spread, valid

BLOCK = 16


def branch_and_bound(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, own: int, k: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer scores of the k best of ``columns`` (dimension by candidate) for one query.

    ``rest[b]`` are the candidates' norms from block b on. Sums stay exact: in doubles below 2**53, else in integers.
    """
    at = np.flatnonzero(ids != own)
    part = np.zeros(len(at), columns.dtype)
    starts = range(0, len(query), BLOCK)
    for b, d in enumerate(starts):
        block = columns[d : d + BLOCK]
        part = part + query[d : d + BLOCK] @ (block if len(at) == block.shape[1] else block[:, at])
        if len(at) > k and b + 1 < len(starts):
            reach = np.sqrt(np.square(query[d + BLOCK :].astype(float)).sum()) * rest[b + 1][at] * (1 + 1e-9) + 1
            floor = np.partition(part - reach, len(at) - k)[len(at) - k]
            stay = part + reach >= floor
            if not stay.all():
                at, part = at[stay], part[stay]
    if len(at) > k:
        stay = part >= np.partition(part, len(at) - k)[len(at) - k]
        at, part = at[stay], part[stay]
    order = np.lexsort((ids[at], -part))[:k]
    return ids[at[order]], part[order].astype(np.int64)


def search(vectors: DataFrame, every: int, k: int, scale: float = 1024.0, **columns: str) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows whose id is divisible by ``every``, against all other rows.

    Components become floor(scale * x). Invalid vectors (null, empty, with null or non-finite components) take
    no part; vectors of another length are no candidates of a query. A row that repeats a query's id is not its
    candidate; repeated candidates each count. Sums must fit 64 bits. Queries and candidates meet in groups of
    bounded size, so the stated query set is answered block by block.
    """
    c = valid(vectors, **columns).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))
    q = c.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    total, asked = c.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    lanes, lots = max(1, -(-total // CANDIDATES)), max(1, -(-asked // QUERIES))
    c = c.withColumn("lane", spread(F.col("vec_id"), total, CANDIDATES)).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    q = q.withColumn("lot", spread(F.col("vec_id"), asked, QUERIES).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            x, ids = matrix(right["v"]).T, right["vec_id"].to_numpy()
            qs = matrix(left["v"])
            exact = float(np.abs(x).max(initial=0)) * float(np.abs(qs).max(initial=0)) * len(x) < 2**52
            x, qs = (np.ascontiguousarray(y, np.float64 if exact else np.int64) for y in (x, qs))
            squares = np.square(x.astype(np.float64))
            rest = np.sqrt(np.stack([squares[d:].sum(0) for d in range(0, len(x), BLOCK)]))
            for own, v in zip(left["vec_id"].to_pylist(), qs, strict=True):
                rows.append((own, *branch_and_bound(v, x, ids, own, k, rest)))
        return answers(rows, pa.int64())

    part = q.groupBy("dim", "lane", "lot").cogroup(c.groupBy("dim", "lane", "lot")).applyInArrow(kernel, "query_id long, vec_id long, score long")
    return best(part, k)
