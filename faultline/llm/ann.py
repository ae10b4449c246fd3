"""Approximate nearest neighbours by inverted lists and an adaptive dimension scan.

Vectors are completed to one length (so that the largest inner product is the least distance), rotated at
random, and kept in column blocks. Within each probed list the partial distances of all its queries and
candidates grow block by block: by the rotation a partial distance estimates the whole one, and a pair that is
beyond the k-th best with the test's confidence is abandoned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import stored
from faultline.llm.vectors import CANDIDATES, QUERIES, answers, best, matrix, valid

BLOCK = 16
#: The sample's bound never stands above this rank: there, chance alone seldom makes it too tight.
LEAST_RANK = 5
#: Pairs of queries and candidates that one step of the scan holds.
PAIRS = 4_000_000
#: Below this share of pairs left the scan goes from whole blocks to single pairs.
SPARSE = 0.1


@dataclass(frozen=True)
class Index:
    """Fitted on a bounded sample: ``sample`` vectors with the least hash of their id."""

    norm2: float
    rotation: np.ndarray
    centers: np.ndarray
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray

    def rotated(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm2 - np.square(v).sum(1), 0))
        return (np.concatenate([v, last[:, None]], 1) @ self.rotation).astype(np.float32)

    def nearness(self, r: np.ndarray) -> np.ndarray:
        """Squared distances to the centers, without the vectors' own part."""
        return np.square(self.centers).sum(1) - 2 * r @ self.centers.T


def fit(v: DataFrame, least: int = 8192, most: int = 65_536, sample_bytes: int = 64 << 20, recall: float = 0.97, k: int = 20, seed: int = 5) -> Index | None:
    """An index over the vectors of the commonest length; None if there are no vectors.

    The number of lists grows as half the square root of the number of vectors. They are fitted on a sample of 64
    vectors a list, at least ``least`` and at most ``most`` vectors and ``sample_bytes``, which also is the
    smallest list's 16 sampled vectors. The number of probed lists is the least that reaches ``recall`` within the
    sample.
    """
    common = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    size = common.dim
    lists = max(64, math.isqrt(common.n) // 2)
    sample = max(1, min(max(least, 64 * lists), most, sample_bytes // (8 * size)))
    rows = v.where(F.size("v") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x, ids = np.array([r.v for r in rows]), np.array([r.vec_id for r in rows])
    g = np.random.default_rng(seed)
    rotation, _ = np.linalg.qr(g.standard_normal((size + 1, size + 1)))
    index = Index(common.norm2 * (1 + 1e-12), rotation, np.zeros((1, size + 1), np.float32), 1, x, ids)
    r = index.rotated(x)
    count = max(1, min(lists, len(r) // 16))
    c = r[g.choice(len(r), count, replace=False)].astype(np.float64)
    for _ in range(12):
        near = (np.square(c).sum(1) - 2 * r @ c.T).argmin(1)
        n = np.bincount(near, minlength=count)
        sums = np.stack([np.bincount(near, r[:, d], count) for d in range(r.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    index = Index(index.norm2, rotation, c.astype(np.float32), 1, x, ids)
    near, ask = index.nearness(r).argmin(1), np.arange(0, len(r), max(1, len(r) // 400))
    scores = x[ask] @ x.T
    scores[np.arange(len(ask)), ask] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(r) - 1))]
    order = np.argsort(index.nearness(index.rotated(x[ask], True)), axis=1)
    rank = np.argsort(order, axis=1)
    need = np.sort(rank[np.arange(len(ask))[:, None], near[top]].ravel())
    probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1
    return Index(index.norm2, rotation, index.centers, probes, x, ids)


def scan(queries: np.ndarray, columns: np.ndarray, norms: np.ndarray, limit: np.ndarray, slack: float, alive: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (query, candidate) of ``alive`` whose distance the tests leave possible.

    ``columns`` is dimension by candidate and ``norms`` the candidates' squares by block. Partial distances grow
    block by block; a pair beyond its limit is abandoned for good. Once few pairs are left only these are added up.
    """
    dims = len(columns)
    part, i, j = np.zeros(alive.shape, np.float32), None, None
    for b, d in enumerate(range(0, dims, BLOCK)):
        q, block, seen = queries[:, d : d + BLOCK], columns[d : d + BLOCK], min(d + BLOCK, dims)
        most = (limit if seen == dims else limit * (1 + confidence / math.sqrt(seen)) ** 2 * seen / dims) * (1 + 1e-5) + slack
        if i is None:
            part += norms[b] + np.square(q).sum(1)[:, None] - 2 * (q @ block)
            alive &= part <= most[:, None]
            if np.count_nonzero(alive) < SPARSE * alive.size:
                i, j = np.nonzero(alive)
                part = part[i, j]
        else:
            part = part + np.square(q[i] - block[:, j].T).sum(1)
            stay = part <= most[i]
            i, j, part = i[stay], j[stay], part[stay]
    return np.nonzero(alive) if i is None else (i, j)


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best pairs (i, j) that reach its bound; a pair's score is summed alone, so equal vectors score alike."""
    rough = np.empty(len(i))
    for a in range(0, len(i), 50_000):
        rough[a : a + 50_000] = np.einsum("ij,ij->i", queries[i[a : a + 50_000]], vectors[j[a : a + 50_000]])
    order = np.lexsort((ids[j], -rough, i))
    i, j, rough = i[order], j[order], rough[order]
    starts = np.searchsorted(i, np.arange(len(queries) + 1))
    out = []
    for q in range(len(queries)):
        s = slice(starts[q], min(starts[q] + k, starts[q + 1]))
        stay = rough[s] >= bound[q]
        out.append((ids[j[s]][stay], rough[s][stay]))
    return out


def search(vectors: DataFrame, every: int, k: int, confidence: float = 2.1, index: Index | None = None, **columns: str) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows whose id is divisible by ``every``, against all other rows.

    Invalid vectors (null, empty, zero, or with null or non-finite components) and rows with a null id take no
    part; an empty table gives an empty answer; other columns are not read. A row that repeats a query's id is not
    its candidate, other repeated rows each count. Only vectors of one length meet: those of the index's length
    by its lists, the others by a scan of all vectors of their length. The score is the inner product of the
    original vectors in doubles, ties go to the smaller id. A list with many vectors is split, as is one that many
    queries probe.

    The nearest list comes first: its k best are kept and the last of them bounds the scan of the other probed
    lists, so that what these return doesn't grow with the number of vectors. A second bound is the sample's,
    at the rank that stands for the ``5 * k`` best of all vectors. Queries that end with fewer than k rows are
    scored against every list without bounds or tests.
    """
    spark = vectors.sparkSession
    every_vector = valid(vectors, zero=False, **columns)
    index = index or fit(every_vector, k=k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = index.sample.shape[1]
    v = every_vector.where(F.size("v") == size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = index.nearness(index.rotated(matrix(b.column(1)))).argmin(1) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int64())], ["vec_id", "v", "list"])

    c = stored(v.mapInArrow(place, "vec_id long, v array<double>, list long"), "placed")
    total = c.count()
    share = min(1.0, len(index.sample) / max(1, total))
    depth = max(LEAST_RANK, math.ceil(5 * k * share))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 500):
                b = whole.slice(i, 500)
                x, ids = matrix(b.column(1)), b.column(0).to_numpy()
                order = np.argsort(index.nearness(index.rotated(x, True)), axis=1)[:, : index.probes]
                s = x @ index.sample.T
                s[ids[:, None] == index.sample_ids] = -np.inf
                bound = np.partition(s, -depth, axis=1)[:, -depth] if s.shape[1] > depth else np.full(len(x), -np.inf)
                who = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
                turn = np.tile(np.arange(order.shape[1]), len(x))
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(bound).take(who), pa.array(order.ravel(), pa.int64()), pa.array(turn, pa.int64())], ["vec_id", "v", "bound", "list", "turn"])

    q = v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).mapInArrow(probe, "vec_id long, v array<double>, bound double, list long, turn long")

    def answered(left: pa.Table, right: pa.Table, whole: bool) -> pa.Table:
        rows = []
        if len(left) and len(right):
            x, ids = matrix(right["v"]), right["vec_id"].to_numpy()
            qs, own, bound = matrix(left["v"]), left["vec_id"].to_numpy(), left["bound"].to_numpy()
            if not whole:
                cols = np.ascontiguousarray(index.rotated(x).T)
                norms = [np.square(cols[d : d + BLOCK]).sum(0) for d in range(0, len(cols), BLOCK)]
                turned, mass = index.rotated(qs, True), np.square(qs).sum(1) + index.norm2
            step = max(1, PAIRS // len(x))
            for a in range(0, len(qs), step):
                part = slice(a, a + step)
                alive = own[part, None] != ids
                if whole:
                    least, (i, j) = np.full(len(alive), -np.inf), np.nonzero(alive)
                else:
                    few = slice(None, None, max(1, len(x) // 256))
                    s = np.where(alive[:, few], qs[part] @ x[few].T, -np.inf)
                    reached = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(s), -np.inf)
                    least = bound[part]
                    i, j = scan(turned[part], cols, norms, mass[part] - 2 * np.maximum(least, reached), 4e-6 * float(mass[part].max()), alive, confidence)
                rows += [(o, *r) for o, r in zip(own[part].tolist(), nearest(qs[part], x, ids, i, j, least, k), strict=True)]
        return answers(rows, pa.float64())

    mine = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(77)), F.col(n).cast("long")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        return answered(left, right, False)

    def kernel_whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return answered(left, right, True)

    def scanned(asking: DataFrame, held: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table] = kernel) -> DataFrame:
        """The k best of each query in each group of bounded size of the lists it asks."""
        many = lambda n, size: F.ceil(F.col(n) / size).cast("int")
        sizes = held.groupBy("list").agg(F.count("*").alias("held")).join(asking.groupBy("list").agg(F.count("*").alias("asked")), "list")
        sizes = F.broadcast(stored(sizes.select("list", many("held", CANDIDATES).alias("lanes"), many("asked", QUERIES).alias("lots")), "sizes"))  # a row per list
        right = held.join(sizes, "list").withColumn("lane", mine("lanes")).withColumn("lot", all_of("lots")).select("list", "lane", "lot", "vec_id", "v")
        left = asking.join(sizes, "list").withColumn("lot", mine("lots")).withColumn("lane", all_of("lanes")).select("list", "lane", "lot", "vec_id", "v", "bound")
        return left.groupBy("list", "lane", "lot").cogroup(right.groupBy("list", "lane", "lot")).applyInArrow(run, "query_id long, vec_id long, score double")

    first = stored(best(scanned(q.where("turn = 0").withColumn("bound", F.lit(float("-inf"))), c), k), "nearest")
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    others = q.where("turn > 0").join(reached, "vec_id", "left").withColumn("bound", F.greatest("bound", F.coalesce("reached", F.lit(float("-inf"))))).drop("reached")
    found = stored(best(first.drop("rank").unionByName(scanned(stored(others, "asking"), c)), k), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stored(q.where("turn = 0").join(full, "vec_id", "left_anti"), "short")
    out = found
    if not short.isEmpty():
        every_list = short.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(index.centers) - 1).cast("long")))).select("vec_id", "v", "bound", "list", "turn")
        again = best(scanned(stored(every_list, "asking"), c, kernel_whole), k)
        out = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*again.columns).unionByName(again)
    odd = every_vector.where(F.size("v") != size).withColumn("list", F.size("v").cast("long"))
    if not odd.isEmpty():
        asked = odd.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("bound", F.lit(float("-inf")))
        out = out.unionByName(best(scanned(stored(asked, "asking"), stored(odd, "odd"), kernel_whole), k))
    return out
