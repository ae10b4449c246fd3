"""What both vector searches share: valid vectors, bounded groups of queries and candidates, and the merge of partial answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most candidates and queries that meet in one group; a group is what one call of the kernel holds.
CANDIDATES, QUERIES = 16_384, 2_048


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite numbers, which must not be empty, nor all zero unless ``zero``."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return v if zero else v.where(F.exists("v", lambda x: x != 0))


def spread(key: Column, count: int, size: int) -> Column:
    """A number below ceil(count / size) from a hash of the id."""
    return F.pmod(F.xxhash64(key, F.lit(77)), F.lit(max(1, -(-count // size)))).cast("long")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def best(partial: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores, ties to the smaller id. Spark limits each group before the shuffle too."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def answers(rows: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Table:
    ids = np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in rows]) if rows else np.zeros(0, np.int64)
    return pa.table({"query_id": ids, "vec_id": np.concatenate([i for _, i, _ in rows]) if rows else np.zeros(0, np.int64), "score": pa.array(np.concatenate([s for _, _, s in rows]) if rows else np.zeros(0), kind)})
