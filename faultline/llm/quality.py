"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import pieces, stored, text_bytes, tidy

#: The statistics, in the order of the feature vector.
STATISTICS = ("length", "words", "word_length", "capitals", "exclamations", "symbols", "bars", "digits", "stops", "lines", "wide", "spaces")
_CLASS = np.zeros(256, np.uint8)
for _k, _s in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"!", b"$%&*#@^~<>{}[]\\/=+_", b"|", b"0123456789", b".,;:?", b"\n\r", b" \t\v\f"), 1):
    _CLASS[list(_s)] = _k
_CLASS[128:] = 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text: logs of sizes, square roots of shares. Empty texts give zeros."""
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i, j in pieces(offsets):
        o = offsets[i : j + 1] - offsets[i]
        kinds = _CLASS[data[offsets[i] : offsets[j]]]
        n = np.diff(o).astype(float)
        rows = np.repeat(np.arange(j - i), np.diff(o))
        c = np.bincount(rows * 11 + kinds, minlength=11 * (j - i)).reshape(j - i, 11).astype(float)
        solid = kinds < 8
        solid |= kinds == 10
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | (rows[1:] != rows[:-1])
        words = np.bincount(rows[begins], minlength=j - i).astype(float)
        w, b = np.maximum(words, 1), np.maximum(n, 1)
        letters = np.maximum(c[:, 1] + c[:, 2], 1)
        cols = (np.log1p(n), np.log1p(words), np.log1p((n - c[:, 9] - c[:, 8]) / w), c[:, 1] / letters, c[:, 3] / w, c[:, 4] / w, c[:, 5] / w, c[:, 6] / b, c[:, 7] / w, c[:, 8] / w, c[:, 10] / b, c[:, 9] / b)
        out[i:j] = np.stack([*cols[:3], *(np.sqrt(x) for x in cols[3:])], 1)
    return out


@dataclass(frozen=True)
class Discriminant:
    """Class means and the inverse Cholesky factors of the shrunk covariances, kept so that scoring is a product of matrices."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logs: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        d = [np.square((z - self.means[k]) @ self.factors[k].T).sum(1) for k in (0, 1)]
        gap = self.logs[1] - self.logs[0] - 0.5 * (d[1] - d[0])
        return 1 / (1 + np.exp(-np.clip(gap, -30, 30)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) for every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*text_bytes(b.column(1)))
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1] if x.size else 1, dtype=np.int32)[: len(b) + 1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, x array<double>")


def fit(examples: DataFrame, shrink: float = 0.1) -> Discriminant:
    """Fit on all rows of ``examples(x, label)``.

    Counts, sums and products of each class are summed on the executors; a few hundred numbers reach the
    driver whatever the input. ``shrink`` mixes each class covariance with the pooled one and with its own
    diagonal. With one class only, every score is that class; without examples it is 0.5.
    """
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                v = x[y == k]
                total[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        k, i = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total.ravel())], ["k", "i", "v"])

    clean = examples.where(F.col("label").isin(0, 1) & F.col("x").isNotNull()).select("x", F.col("label").cast("int").alias("label"))
    rows = clean.mapInArrow(moments, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, 1 + d + d * d))
    for r in rows:
        m[r.k, r.i] = r.v
    n = m[:, 0]
    if not n.all():
        return Discriminant(*[np.zeros(0)] * 5, constant=0.5 if not n.any() else float(n[1] > 0))
    mean = m[:, 1 : d + 1] / n[:, None]
    cov = m[:, d + 1 :].reshape(2, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    shift = m[:, 1 : d + 1].sum(0) / n.sum()
    pooled = np.einsum("k,kij->ij", n / n.sum(), cov)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    means, factors, logs = (mean - shift) / scale, [], []
    within = pooled / np.outer(scale, scale)
    for k in (0, 1):
        c = cov[k] / np.outer(scale, scale)
        c = (1 - shrink) * ((1 - shrink) * c + shrink * within) + shrink * np.diag(np.diag(c)) + 0.02 * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(shift, scale, means, np.array(factors), np.array(logs))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[Discriminant, DataFrame]:
    """The model from ``labels(doc_id, <label_col>)`` and the stored statistics of every document. Null labels are left out."""
    x = stored(features(docs, id_col, text_col), "quality")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("label is not null")
    return fit(known.join(x, "doc_id").select("x", "label")), x


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) from stored statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "x").mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of ``threshold`` or more, all columns kept as they are; one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = model.score(statistics(*text_bytes(b.column(at)))) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
