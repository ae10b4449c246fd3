"""What the operators of this subpackage share: stored intermediate tables and vectorised hashing of texts."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Python tasks take a batch of rows apart into pieces of about so many bytes, so that memory follows this, not the batch.
PIECE_BYTES = 1 << 20
BATCH_ROWS = 1000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of its own only on one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "/tmp/checkpoints"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and any executor may be lost afterwards.

    From here on the session hands Python at most ``BATCH_ROWS`` rows at once, since each may be a long text.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
    path = f"{scratch_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back to the system: workers stay for later stages."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in glibc only
            if trim:
                trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def with_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """``docs`` and a last column __place, a number of its own for each different (id, text), in the order of ids and then of the texts' digests.

    None where no id repeats, which a count of the ids alone tells. Rows without an id have no place. Ranks are taken
    within ranges of the ids and digests, so that an id of very many rows is not one task's.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return None
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    keys = stored(docs.select(F.col(id_col).cast("long").alias("__id"), digest.alias("__digest")).where("__id is not null").distinct(), "keys")
    dealt = stored(keys.repartitionByRange("__id", "__digest").withColumn("part", F.spark_partition_id()), "keys")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    base = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("__id", "__digest"))
    place = dealt.join(base, "part").select("__id", "__digest", (F.col("base") + rank).cast("long").alias("__place"))
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__digest": digest})
    return stored(rows.join(place, ["__id", "__digest"], "left").select(*docs.columns, "__place"), "places")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids fall in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = pa.large_binary() if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else pa.large_string()
    a = a.cast(kind)
    a = a.fill_null(pa.scalar(b"" if kind == pa.large_binary() else "", kind)) if a.null_count else a
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES):
    """Ranges of rows that hold about ``size`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODE = _stream(7, 256)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x5851F42D4C957F2D | 1
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POW[0]) < n:
        m = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                p = np.full(m, b, U64)
                p[0] = 1
                _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) in order, and the number of words of each row."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(n, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    ends_at = solid.copy()
    ends_at[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(ends_at) + 1
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        code = LOWER_CODE[data]
        code *= up[: len(data)]
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(code, out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return h, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """For each row its sorted distinct k-word shingle hashes; a row of 1 to k-1 words has its whole sequence as one."""
    for i, j in pieces(offsets):
        h, counts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        at = np.concatenate([[0], np.cumsum(counts)])
        with np.errstate(over="ignore"):
            odd = _stream(99, k) | U64(1)
            grams = np.zeros(max(0, len(h) - k + 1), U64)
            for x in range(k if len(grams) else 0):
                grams += h[x : len(h) - k + 1 + x] * odd[x]
            grams = mix(grams)
            for r in range(j - i):
                a, b = at[r], at[r + 1]
                if b - a >= k:
                    yield np.unique(grams[a : b - k + 1])
                elif b > a:
                    yield mix(np.array([(h[a:b] * odd[: b - a]).sum() + U64(b - a)], U64))
                else:
                    yield np.zeros(0, U64)


def int_bits(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits, which is how Spark holds hashes."""
    return x.view(np.int64)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from arrays."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
