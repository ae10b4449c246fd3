"""Mixture-controlled packing: deficit round-robin over source queues, worked out in closed form.

Each source is a queue of tokens. Every window is one round: a source's credit grows by its target share of the
window, it is served as many whole quanta as its credit holds, and the rest is carried into the next window. Credits
are whole numbers over a cycle of windows, so what a source has been served before any window, and at which window a
token of its queue comes up, are formulas: any partition places its own documents without walking through the windows
before. Every window is thus within one quantum of every target until queues run dry.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm.shared import pieces, stored, text_bytes, tidy


#: Classes of code points: white space, letter, number, other, and those that only the library itself may judge.
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)
#: White space and the endings that stay with their apostrophe, as the vocabulary file's patterns have them (fixed values).
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Blocks whose classes, cases and compositions all versions of Unicode share; other texts go through the file's own library.
_KNOWN = ((0x0001, 0x052F), (0x1E00, 0x1EFF), (0x2010, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF), (0x1F300, 0x1F64F))
_LAST = 0x20000
#: How a vocabulary file must say that it finds words for them to be found here (fixed values).
_FINDS_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def _classes() -> np.ndarray:
    """The class of each code point below ``_LAST``."""
    kind, out = {"L": _LETTER, "N": _NUMBER}, np.full(_LAST, _UNSURE, np.uint8)
    for a, b in _KNOWN:
        names = [unicodedata.category(chr(i)) for i in range(a, b + 1)]
        out[a : b + 1] = [_UNSURE if c == "Cn" else kind.get(c[0], _OTHER) for c in names]
    out[list(_WHITE)] = _SPACE
    return out


def byte_signs() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


@functools.lru_cache(2)
def merge_table(path: str) -> tuple[list[tuple[bytes, int]], list[str]]:
    """(bytes, id) of every token in the order of the merges that make it, and the special tokens.

    A closing zero byte stands for the end of a word. Merging by token instead of by pair gives the same ids as
    long as each token's own bytes lead to it by the listed pairs; tokens that they don't lead to never occur and
    are left out.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    if len({a + b for a, b in pairs}) != len(pairs):
        raise ValueError("two merges make the same token")
    sign = byte_signs()

    def symbols(token: str) -> list[str]:
        body = token.removesuffix(end)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def reached(token: str) -> bool:
        s = symbols(token)
        while len(s) > 1:
            best = min(range(len(s) - 1), key=lambda i: rank.get((s[i], s[i + 1]), len(rank)))
            if (s[best], s[best + 1]) not in rank:
                return False
            s[best : best + 2] = [s[best] + s[best + 1]]
        return True

    def raw(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(sign[c] for c in body) + b"\0" * (token != body)

    tokens = [c + e for e in ("", end) for c in sign] + [t for a, b in pairs if reached(t := a + b)]
    return [(raw(t), vocab[t]) for t in tokens], [t["content"] for t in whole.get("added_tokens", ())]


class WordTokenizer:
    """Ids of many whole texts at once, the same as the vocabulary file's own library gives, several times as fast.

    Pieces are found for all texts together and merged by rank in a second library. Texts with a special token, a
    zero byte or a code point outside the known ones go through the file's own library.
    """

    def __init__(self, text: str, table: list[tuple[bytes, int]], special: list[str]) -> None:
        self.text, self.special = text, special
        self.merger = tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks={b: i for i, (b, _) in enumerate(table)}, special_tokens={})
        self.id_of = np.array([i for _, i in table], "<u4")
        self.closes = np.array([len(b) > 1 and b[-1] == 0 for b, _ in table])
        self.kind = _classes()

    @functools.cached_property
    def own(self) -> Tokenizer:
        """The file's own library, loaded for the first text that needs it."""
        return Tokenizer.from_str(self.text)

    def _ends(self, cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where a piece ends: at a change of class, after each number, and after an apostrophe's ending."""
        n = len(cp)
        end = kind != _SPACE
        end[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == _NUMBER)
        at = np.flatnonzero(cp == 0x27)
        at = at[(at == 0) | (kind[at - 1] != _OTHER)]
        for ending in _ENDINGS:
            hit = at[at + len(ending) < n]
            for k, c in enumerate(ending, 1):
                hit = hit[cp[hit + k] == ord(c)]
            end[hit] = False
            end[hit + len(ending)] = True
        return end

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if "\0" in t or any(s in t for s in self.special)}
        usual = [unicodedata.normalize("NFC", "" if i in odd else t).replace("Σ", "σ").lower() for i, t in enumerate(texts)]
        joined = "\n".join(usual)
        if joined.isascii():
            cp = np.frombuffer(joined.encode("ascii"), np.uint8)
            kind, code = self.kind[cp], "ascii"
        else:
            cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            kind, code = np.where(cp < _LAST, self.kind[np.minimum(cp, _LAST - 1)], np.uint8(_UNSURE)), "utf-32-le"
        stop = np.cumsum([len(t) + 1 for t in usual]) - 1
        unsure = np.flatnonzero(kind == _UNSURE)
        odd.update(np.searchsorted(stop, unsure, "right").tolist())
        end = self._ends(cp, kind)
        solid = kind != _SPACE
        last = end[solid]
        before = np.cumsum(last)
        marked = np.zeros(len(last) + (int(before[-1]) if len(last) else 0), cp.dtype)
        marked[np.arange(len(last)) + before - last] = cp[solid]
        rank = self.merger.encode_to_numpy(marked.tobytes().decode(code), disallowed_special=()) if len(marked) else np.zeros(0, np.uint32)
        found, close = self.id_of[rank], np.concatenate([[0], np.flatnonzero(self.closes[rank]) + 1])
        cuts = close[np.concatenate([[0], np.cumsum(end)])[stop]]
        out = np.split(found, cuts[:-1])
        for i in odd:
            out[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out


class OwnTokenizer:
    """Ids by the vocabulary file's own library, for files that find words in another way."""

    def __init__(self, text: str) -> None:
        self.own = Tokenizer.from_str(text)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def vocabulary(path: str) -> tuple:
    """The file's text, with its merge table and special tokens if its words can be found here."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    whole = json.loads(text)
    usual = (whole.get("normalizer"), whole.get("pre_tokenizer")) == _FINDS_WORDS and whole["model"].get("end_of_word_suffix")
    return (text, *merge_table(path)) if usual else (text,)


def tokenizer(text: str, *merges) -> WordTokenizer | OwnTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokenizer(text, *merges) if merges else OwnTokenizer(text)


_KEPT: dict[str, WordTokenizer | OwnTokenizer] = {}


def _worker_tokenizer(path: str, held: tuple) -> WordTokenizer | OwnTokenizer:
    """One for all tasks of a worker process."""
    if path not in _KEPT:
        _KEPT[path] = tokenizer(*held)
    return _KEPT[path]


def tokenize(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", piece: int = 1 << 19) -> DataFrame:
    """(doc_id, source, ids, n, part, start): ids as little-endian uint32, closed by ``end_id``.

    ``part`` is the task and ``start`` the tokens of the same source before it in that task. Null text is empty.
    Texts are taken in groups of about ``piece`` bytes, or alone if longer. The file and its merges are read on
    the driver and broadcast; only the vocabulary sizes them.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, at, part = _worker_tokenizer(path, held.value), {}, TaskContext.get().partitionId()
        for b in batches:
            for i, j in pieces(text_bytes(b.column(1))[1], piece):
                rows, ids, starts = b.slice(i, j - i), [], []
                for s, x in zip(rows.column(2).to_pylist(), t.ids(rows.column(1).to_pylist()), strict=True):
                    starts.append(at.get(s, 0))
                    at[s] = starts[-1] + len(x) + 1
                    ids.append(np.append(x, np.uint32(end_id)).astype("<u4").tobytes())
                m = len(ids)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(ids, pa.binary()), pa.array([len(y) // 4 for y in ids], pa.int64()), pa.array([part] * m, pa.int64()), pa.array(starts, pa.int64())], ["doc_id", "source", "ids", "n", "part", "start"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source")).mapInArrow(tidy(run), f"doc_id {kind}, source string, ids binary, n long, part long, start long")


class Schedule:
    """Which window holds each quantum of each queue.

    It is a list of phases: in each the shares stay the same and no queue that takes part runs dry. Without weights
    the shares are those of what is left, so that all queues last to the end. What never fills a window any more
    follows at the end, queue after queue.
    """

    def __init__(self, totals: np.ndarray, weights: np.ndarray | None, window: int, quantum: int) -> None:
        self.window, self.quantum, self.cycle = window, quantum, 256
        slots, n = window // quantum, len(totals)
        while self.cycle * slots < 16 * n * n:  # rounding shares to the cycle leaves a sixteenth for the next phase at most
            self.cycle *= 2
        left, taken, on, at = totals // quantum, np.zeros(n, np.int64), np.ones(n, bool), 0
        #: (quanta served before, edges of the shares in quanta per cycle, first window)
        self.phases: list[tuple[np.ndarray, np.ndarray, int]] = []
        while (left * on).sum() >= slots:
            share = np.where(on & (left > 0), left if weights is None else weights, 0).astype(float)
            a = np.floor(share / share.sum() * slots * self.cycle).astype(np.int64)
            a[share.argmax()] += slots * self.cycle - a.sum()
            edges = np.concatenate([[0], np.cumsum(a)])
            some = np.flatnonzero(a)
            lasts = self.window_of(edges, some, left[some])
            k = int(lasts.min())
            if k:
                self.phases.append((taken.copy(), edges, at))
                used = self.served(edges, np.arange(n), np.int64(k))
                taken, left, at = taken + used, left - used, at + k
            else:
                on[some[lasts == 0]] = False
        self.taken, self.end = taken, at
        rest = totals - taken * quantum
        self.tail = at * window + np.cumsum(rest) - rest

    def _edge(self, edge: np.ndarray, r: np.ndarray) -> np.ndarray:
        return r * (edge // self.cycle) + np.maximum(0, r - self.cycle + edge % self.cycle)

    def served(self, edges: np.ndarray, source: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Quanta of a source in the first k windows of a phase."""
        turns, r = k // self.cycle, k % self.cycle
        return turns * (edges[source + 1] - edges[source]) + self._edge(edges[source + 1], r) - self._edge(edges[source], r)

    def window_of(self, edges: np.ndarray, source: np.ndarray, quanta: np.ndarray) -> np.ndarray:
        """The window of a phase that holds a source's quantum of that number, which is also how many windows so many quanta fill."""
        per = edges[source + 1] - edges[source]
        turns, x = quanta // per, quanta % per
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.cycle)
        while (high - low > 1).any():
            mid = (low + high) // 2
            fits = self.served(edges, source, mid) <= x
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        return turns * self.cycle + low


def _every(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's numbers first..last, and the row of each."""
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def cut(schedule: Schedule, source: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents at ``begin`` of their queues: document, start, length and global position; neighbours that stay together are one."""
    q, window, out = schedule.quantum, schedule.window, []
    befores = [p[0] for p in schedule.phases] + [schedule.taken]
    for (first, edges, at), then in zip(schedule.phases, befores[1:], strict=True):
        lo, hi = np.maximum(begin, first[source] * q), np.minimum(begin + n, then[source] * q)
        doc = np.flatnonzero(hi > lo)
        if not len(doc):
            continue
        s, lo, hi = source[doc], lo[doc], hi[doc]
        u0, u1 = lo // q - first[s], (hi - 1) // q - first[s]
        k0, k1 = schedule.window_of(edges, s, u0), schedule.window_of(edges, s, u1)
        wide = u1 - u0 <= k1 - k0  # by quanta where windows between them have none
        row, k = _every(np.where(wide, u0, k0), np.where(wide, u1, k1))
        some = wide[row]
        u = k.copy()
        k[some] = schedule.window_of(edges, s[row][some], u[some])
        base = schedule.served(edges, s[row], k)
        a = np.maximum(lo[row], (first[s][row] + np.where(some, u, base)) * q)
        b = np.minimum(hi[row], (first[s][row] + np.where(some, u + 1, schedule.served(edges, s[row], k + 1))) * q)
        place = (at + k) * window + (edges[s][row] + k % schedule.cycle) // schedule.cycle * q + a - (first[s][row] + base) * q
        full = b > a
        out.append((doc[row][full], a[full], b[full], place[full]))
    lo, hi = np.maximum(begin, schedule.taken[source] * q), begin + n
    doc = np.flatnonzero(hi > lo)
    place = schedule.tail[source[doc]] + lo[doc] - schedule.taken[source[doc]] * q
    row, k = _every(place // window, (place + hi[doc] - lo[doc] - 1) // window)
    start = np.maximum(place[row], k * window)
    stop = np.minimum((place + hi[doc] - lo[doc])[row], (k + 1) * window)
    shift = (lo[doc] - place)[row]
    out.append((doc[row], start + shift, stop + shift, start))
    doc, lo, hi, at = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((lo, doc))
    doc, lo, at, hi = doc[order], lo[order], at[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1]) | (at[1:] % window == 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return doc[first], lo[first] - begin[doc[first]], hi[last] - lo[first], at[first]


def pack(docs: DataFrame, path: str, window: int = 4096, quantum: int = 16, weights: dict[str | None, float] | None = None, end_id: int = 2, with_ids: bool = False, **columns: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, source, ids]), one row per piece.

    Every sequence but the last is full, so padding is less than one window. ``weights`` are the target
    proportions; by default each queue's own share, so all queues last to the end. A queue that runs dry leaves
    its turns to the others. Tokens are made once and stored; what reaches the driver and every task is a row per
    source, of some 100 bytes.

    Null and empty texts are the closing id alone; a null source is a queue of its own; repeated rows and rows with
    a null id are documents of their own; an empty table gives an empty one; other columns are not read.
    """
    if window % quantum:
        raise ValueError("quantum must divide window")
    ids = stored(tokenize(docs, path, end_id, **columns), "tokens")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    held = stored(ids.groupBy("part", key.alias("key")).agg(F.sum("n").alias("n"), F.first("source").alias("source")), "queues")
    total = held.groupBy("key").agg(F.sum("n").alias("n"), F.first("source").alias("source")).orderBy("key").collect()
    queue = {r.key: i for i, r in enumerate(total)}
    totals = np.array([r.n for r in total], np.int64)
    share = np.array([float(weights.get(r.source, 0.0)) for r in total]) if weights else None
    if share is not None and (share <= 0).any():
        raise ValueError("each source needs a weight above 0")
    schedule = Schedule(totals, share, window, quantum)
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("part", "key", F.coalesce(earlier, F.lit(0)).alias("before"))
    if held.count() <= 200_000:  # a row per task and source, of some 30 bytes
        base = F.broadcast(base)
    placed = ids.withColumn("key", key).join(base, ["part", "key"]).select("doc_id", "source", "key", "ids", "n", (F.col("before") + F.col("start")).alias("begin"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["source", "ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                b = whole.slice(i, 2000)
                n = b.column(4).to_numpy()
                doc, lo, length, at = cut(schedule, np.array([queue[k] for k in b.column(2).to_pylist()]), b.column(5).to_numpy(), n)
                views = [x.as_buffer() for x in b.column(3)]
                parts = [views[d][4 * a : 4 * (a + m)] for d, a, m in zip(doc.tolist(), lo.tolist(), length.tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
                who = pa.array(doc)
                more = [b.column(1).take(who), pa.array([bytes(x) for x in parts], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), *map(pa.array, (lo, length, crc, n[doc], at // window, at % window)), *more], names)

    kind = ids.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", source string, ids binary" * with_ids
    return placed.mapInArrow(tidy(run), spec)
