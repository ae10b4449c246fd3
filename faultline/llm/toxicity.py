"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

The network is trained in numpy on a bounded sample of labelled documents and scores overlapping windows of
every text, each half a window after the last, so a passage of up to ``window - stride + 1`` tokens lies whole
in one wherever it stands; a document's score is that of its worst window.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import tidy

STRIP = ".,;:!?\"'()[]{}*%$&#|-_~"


@dataclass(frozen=True)
class Shape:
    """Sizes of the network and bounds of its training sample."""

    word_dim: int = 8
    char_dim: int = 8
    char_buckets: int = 2048
    hidden: int = 8
    window: int = 32
    stride: int = 16
    piece_chars: int = 32
    vocabulary: int = 20_000
    least_docs: int = 3
    #: At most so many labelled documents of each class, least hash of the id first, none above so many characters.
    train_docs: int = 700
    train_chars: int = 20_000
    temperatures: tuple[float, ...] = (1.0, 2.0, 6.0, 12.0)
    rate: float = 0.02
    seed: int = 11


def tokens(text: str | None, piece: int) -> list[str]:
    """Lower-cased words; a word over ``piece`` characters is cut so that no input step is unbounded."""
    ws = (text or "").lower().split()
    if any(len(w) > piece for w in ws):
        ws = [w[i : i + piece] for w in ws for i in range(0, len(w), piece)]
    return ws


def trigrams(word: str, buckets: int) -> list[int]:
    b = f"^{word}$".encode("utf-8", "surrogatepass")
    return [zlib.crc32(b[i : i + 3]) % buckets for i in range(len(b) - 2)]


def windows(n: int, size: int, stride: int) -> list[int]:
    """Starts of overlapping windows that cover n tokens, one at least."""
    return list(range(0, max(1, n - size + stride), stride))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(xw: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of one direction from projected inputs (T, B, 3H)."""
    steps, rows, wide = xw.shape
    hid = wide // 3
    h, out, saved = np.zeros((rows, hid), xw.dtype), np.empty((steps, rows, hid), xw.dtype), []
    for t in range(steps):
        g = h @ u
        rz = sigmoid(xw[t, :, : 2 * hid] + g[:, : 2 * hid])
        r, z = rz[:, :hid], rz[:, hid:]
        n = np.tanh(xw[t, :, 2 * hid :] + r * g[:, 2 * hid :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        new = h + m * (new - h)
        if keep:
            saved.append((h, r, z, n, g[:, 2 * hid :], m))
        h = out[t] = new
    return out, saved


def _back(dout: np.ndarray, saved: list, u: np.ndarray):
    """Gradients of projected inputs and recurrent weights."""
    steps, rows, hid = dout.shape
    dx, du, dh = np.zeros((steps, rows, 3 * hid), dout.dtype), np.zeros_like(u), np.zeros((rows, hid), dout.dtype)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, gn, m = saved[t]
        d = dh + dout[t]
        dnew = d * m
        dn = dnew * (1 - z) * (1 - n * n)
        dz = dnew * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dg = np.concatenate([dr, dz, dn * r], 1)
        dx[t] = np.concatenate([dr, dz, dn], 1)
        du += h.T @ dg
        dh = d * (1 - m) + dnew * z + dg @ u.T
    return dx, du


@dataclass
class Network:
    shape: Shape
    vocab: dict[str, int]
    p: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    _cache: dict[str, int] = field(default_factory=dict)
    _rows: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def new(cls, shape: Shape, vocab: dict[str, int]) -> Network:
        g = np.random.default_rng(shape.seed)
        d, h = shape.word_dim + shape.char_dim, shape.hidden
        make = lambda *s, k=1.0: (g.standard_normal(s) * k).astype(np.float32)
        p = {"word": make(len(vocab) + 1, shape.word_dim, k=0.1), "char": make(shape.char_buckets, shape.char_dim, k=0.1)}
        p["word"][0] = 0
        for s in "fb":
            p |= {f"w{s}": make(d, 3 * h, k=d**-0.5), f"u{s}": make(h, 3 * h, k=h**-0.5), f"c{s}": np.zeros(3 * h, np.float32)}
        p |= {"wa": make(2 * h, h, k=(2 * h) ** -0.5), "va": make(h, k=h**-0.5), "wo": make(2 * h, k=(2 * h) ** -0.5), "bo": np.zeros(1, np.float32)}
        return cls(shape, vocab, p)

    def inputs(self, words: list[str]):
        """Row of the word table and mean of the character table for each word."""
        grams = [trigrams(w, self.shape.char_buckets) for w in words]
        n = np.array([len(x) for x in grams])
        flat, owner = np.concatenate([np.array(x, np.int64) for x in grams]), np.repeat(np.arange(len(words)), n)
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        chars = np.add.reduceat(self.p["char"][flat], at, axis=0) / n[:, None]
        rows = np.array([self.vocab.get(w.strip(STRIP), 0) for w in words], np.int64)
        return np.concatenate([self.p["word"][rows], chars], 1).astype(np.float32), (rows, flat, owner, n)

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ids and mask are (T, B), x has a row per id."""
        p = self.p
        both, state = [], []
        for s in "fb":
            i, m = (ids, mask) if s == "f" else (ids[::-1], mask[::-1])
            table = x @ p[f"w{s}"] + p[f"c{s}"]
            h, saved = _run(table[i], m, p[f"u{s}"], keep)
            both.append(h if s == "f" else h[::-1])
            state.append(saved)
        h = np.concatenate(both, 2)
        a = np.tanh(h @ p["wa"])
        e = np.where(mask > 0, a @ p["va"], -1e9)
        e = np.exp(e - e.max(0))
        w = e / e.sum(0)
        c = np.einsum("tb,tbh->bh", w, h)
        return c @ p["wo"] + p["bo"][0], (h, a, w, c, state)

    def backward(self, dlogit: np.ndarray, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, kept, word_info) -> dict[str, np.ndarray]:
        p, (h, a, w, c, state) = self.p, kept
        g = {"wo": c.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
        dc = dlogit[:, None] * p["wo"]
        dh = w[:, :, None] * dc
        dw = np.einsum("tbh,bh->tb", h, dc)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("tbk,tb->k", a, de)
        g["wa"] = np.einsum("tbh,tbk->hk", h, da)
        dh = dh + da @ p["wa"].T
        hid, dx = self.shape.hidden, np.zeros_like(x)
        for k, s in enumerate("fb"):
            d = dh[:, :, :hid] if s == "f" else dh[::-1, :, hid:]
            i = ids if s == "f" else ids[::-1]
            dxt, g[f"u{s}"] = _back(d, state[k], p[f"u{s}"])
            flat, order = dxt.reshape(-1, 3 * hid), np.argsort(i.ravel(), kind="stable")
            who, at = np.unique(i.ravel()[order], return_index=True)
            dt = np.zeros((len(x), 3 * hid), np.float32)
            dt[who] = np.add.reduceat(flat[order], at, axis=0)
            g[f"w{s}"], g[f"c{s}"] = x.T @ dt, dt.sum(0)
            dx += dt @ p[f"w{s}"].T
        rows, grams, owner, n = word_info
        wd = self.shape.word_dim
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], rows, dx[:, :wd])
        g["word"][0] = 0
        np.add.at(g["char"], grams, (dx[:, wd:] / n[:, None])[owner])
        return g

    def lay_out(self, docs: list[list[str]]):
        """Windows of several documents as ids into their distinct words; owner of each window."""
        s = self.shape
        words: dict[str, int] = {}
        ids, mask, owner = [], [], []
        for k, d in enumerate(docs):
            num = np.fromiter((words.setdefault(w, len(words)) for w in d), np.int64, len(d))
            for a in windows(len(d), s.window, s.stride):
                piece = num[a : a + s.window]
                ids.append(np.pad(piece, (0, s.window - len(piece))))
                mask.append(np.arange(s.window) < len(piece))
                owner.append(k)
        return list(words), np.array(ids).T, np.array(mask, np.float32).T, np.array(owner)

    def fit(self, docs: list[list[str]], y: np.ndarray) -> None:
        """Adam over documents; windows share a document's error by a soft maximum that sharpens with the epochs."""
        g = np.random.default_rng(self.shape.seed)
        m, v, step = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        order = np.arange(len(docs))
        for heat in self.shape.temperatures:
            g.shuffle(order)
            for i in range(0, len(order), 32):
                part = order[i : i + 32]
                words, ids, mask, owner = self.lay_out([docs[k] for k in part])
                x, info = self.inputs(words)
                z, kept = self.forward(x, ids, mask, True)
                top = np.full(len(part), -np.inf, np.float32)
                np.maximum.at(top, owner, z)
                e = np.exp(heat * (z - top[owner]))
                share = e / np.bincount(owner, e, len(part))[owner]
                err = (sigmoid(np.bincount(owner, share * z, len(part))) - y[part]) / len(part)
                grads = self.backward((share * err[owner]).astype(np.float32), x, ids, mask, kept, info)
                step += 1
                for k, d in grads.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    self.p[k] -= self.shape.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """A slope and an offset of the worst window's logit, by ridge-regularised Newton steps."""
        z = np.clip(z, -20, 20)
        a = np.array([1.0, 0.0])
        d = np.stack([z, np.ones_like(z)], 1)
        for _ in range(25):
            s = sigmoid(d @ a)
            grad = d.T @ (weight * (s - y)) + 1e-2 * (a - [1, 0])
            a = a - np.linalg.solve((d.T * (weight * s * (1 - s))) @ d + 1e-2 * np.eye(2), grad)
        if a[0] > 0:
            self.slope, self.offset = map(float, a)

    def worst(self, docs: list[list[str]], most: int = 4096) -> np.ndarray:
        """The largest window logit of each document. Inputs of words are cached; the cache is emptied before it grows large."""
        s, out = self.shape, np.full(len(docs), -np.inf, np.float32)
        if len(self._cache) > 150_000:
            self._cache.clear()
            self._rows.clear()
        known, fresh = self._cache, []
        starts, owner, nums, base = [], [], [], 0
        for k, d in enumerate(docs):
            num = np.empty(len(d), np.int32)
            for i, w in enumerate(d):
                j = known.get(w)
                if j is None:
                    j = known[w] = len(known)
                    fresh.append(w)
                num[i] = j
            at = windows(len(d), s.window, s.stride)
            starts += [base + a for a in at]
            owner += [k] * len(at)
            nums.append(num)
            base += len(d)
        if fresh:
            self._rows.append(self.inputs(fresh)[0])
            if len(self._rows) > 1:
                self._rows[:] = [np.concatenate(self._rows)]
        x = self._rows[0] if self._rows else np.zeros((1, s.word_dim + s.char_dim), np.float32)
        flat = np.concatenate([*nums, np.zeros(s.window, np.int32)])
        ends = np.cumsum([len(d) for d in docs])
        starts, owner = np.array(starts), np.array(owner)
        for i in range(0, len(starts), most):
            pos = starts[i : i + most] + np.arange(s.window)[:, None]
            mask = (pos < ends[owner[i : i + most]]).astype(np.float32)
            ids, local = np.unique(np.where(mask > 0, flat[np.minimum(pos, len(flat) - 1)], 0), return_inverse=True)
            z, _ = self.forward(x[ids], local.reshape(pos.shape), mask)
            np.maximum.at(out, owner[i : i + most], z)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for each text; an empty text is one empty window."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, i = np.zeros(len(texts)), 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 400_000):
                size += len(texts[j] or "")
                j += 1
            z = self.worst([tokens(t, self.shape.piece_chars) for t in texts[i:j]])
            out[i:j] = sigmoid(self.slope * np.clip(z.astype(float), -20, 20) + self.offset)
            i = j
        return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on a bounded sample of ``labels``: at most ``shape.train_docs`` documents of each class, chosen by hash of the id.

    With one class only, every score is that class; without examples it is 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ends = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(ends) < 2:
        return Network(shape, {}, {}, constant=float(max(ends, default=0)))
    short = docs.where(F.length(text_col) <= shape.train_chars).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pick = known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(shape.train_docs).unionByName(known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(shape.train_docs))
    one = short.join(F.broadcast(pick.distinct()), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # a text an id, however often it repeats
    rows = one.orderBy("doc_id", "label").collect()  # 2 * train_docs rows of train_chars at most
    texts, y = [tokens(r.text, shape.piece_chars) for r in rows], np.array([r.label for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return Network(shape, {}, {}, constant=float(y.sum() > 0))
    seen = Counter(w for t in texts for w in {x.strip(STRIP) for x in t})
    usual = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= shape.least_docs and w]
    vocab = {w: k for k, w in enumerate(usual[: shape.vocabulary], 1)}
    net = Network.new(shape, vocab)
    net.fit(texts, y)
    share = ends[1] / (ends[0] + ends[1])
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    net.calibrate(net.worst(texts).astype(float), y, weight)
    net._cache.clear()
    net._rows.clear()
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; null text is empty. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")
