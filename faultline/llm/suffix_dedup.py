"""Exact repeated passages by prefix-free parsing and suffix arrays.

A rolling hash over 32 bytes sets triggers: the trigger of a string of ``length`` bytes is its least hash
(the last of equals), so equal strings have theirs at the same place. Triggers cut the corpus into phrases,
here the bytes of all strings that share a trigger. The parse is the corpus as phrases; its order says which
phrase occurs where first. Phrases that occur twice as a whole need no look inside. Only where a trigger's
phrases differ do they form a dictionary, whose suffixes are sorted: neighbours with ``length`` equal bytes
are the repeats, and the parse's order says which comes first in the corpus. Both orders are cut off at
``length`` bytes, the only depth that the result depends on, which lets triggers be sorted apart from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import BYTE_CODE, lists, mix, pieces, powers, stored, text_bytes, tidy, with_places

U64 = np.uint64
GRAM = 32
_POSITION_BITS = U64(22)
#: Triggers with more different phrases are dealt by string. A phrase has at most ``length`` - GRAM + 1 starts, so one
#: sort holds at most some 300,000 suffixes of ``length`` bytes.
HEAVY = 4000


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by running minima of blocks from both sides."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, ~U64(0))
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _parse_part(data: np.ndarray, length: int):
    """Triggers of one stretch of bytes: first and last start of the strings of each, the trigger's hash, and prefix hashes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
        gram = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    pos = np.arange(len(gram), dtype=U64)
    top = (U64(1) << _POSITION_BITS) - U64(1)
    least = _sliding_least((gram >> _POSITION_BITS << _POSITION_BITS) | (top - pos), length - GRAM + 1)
    trigger = (top - (least & top)).astype(np.int64)
    return trigger, gram, total


def parse(data: np.ndarray, offsets: np.ndarray, length: int):
    """For each text its phrases: starts lo..hi of the strings of one trigger, key (hash of the trigger) and ctx (hash of the phrase)."""
    limit = (1 << int(_POSITION_BITS)) - 1
    for i, j in pieces(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a > limit:  # one long text: overlapping stretches, joined where they meet
            yield i, *_parse_long(data[a:b], length, limit)
            continue
        part = data[a:b]
        if len(part) < length:
            for r in range(i, j):
                yield (r, *[np.zeros(0, np.int64)] * 4)
            continue
        trigger, gram, total = _parse_part(part, length)
        o = offsets[i : j + 1] - a
        valid = np.zeros(len(trigger) + 1, bool)
        for s, e in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
            if e - s >= length:
                valid[s : e - length + 1] = True
        lo, hi, key, ctx = _phrases(trigger, valid, gram, total, length)
        ends = np.searchsorted(lo, o)
        for r in range(j - i):
            s = slice(ends[r], ends[r + 1])
            yield i + r, lo[s] - o[r], hi[s] - o[r], key[s], ctx[s]


def _phrases(trigger: np.ndarray, valid: np.ndarray, gram: np.ndarray, total: np.ndarray, length: int):
    new = valid[:-1].copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-2]
    last = valid[:-1].copy()
    last[:-1] &= (trigger[1:] != trigger[:-1]) | ~valid[1:-1]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    _, down = powers(len(total))
    t = trigger[lo]
    with np.errstate(over="ignore"):
        ctx = mix(mix((total[hi + length] - total[lo]) * down[lo]) + (t - lo).astype(U64) * U64(1000003) + (hi - lo).astype(U64))
    return lo, hi, (gram[t] >> U64(1)).astype(np.int64), (ctx >> U64(1)).astype(np.int64)


def _parse_long(data: np.ndarray, length: int, limit: int):
    """Phrases of one text above the limit, stretch by stretch; a phrase cut at a seam becomes two, on either side of it."""
    out, step = [], limit - length
    for s in range(0, len(data) - length + 1, step):
        part = data[s : s + step + length - 1]
        if len(part) < length:
            break
        trigger, gram, total = _parse_part(part, length)
        lo, hi, key, ctx = _phrases(trigger, np.append(np.ones(len(trigger), bool), False), gram, total, length)
        out.append((lo + s, hi + s, key, ctx))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_in_text(key: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """Whether each phrase is the first of its kind in the text."""
    first = np.zeros(len(key), bool)
    if len(key):
        order = np.lexsort((np.arange(len(key)), ctx, key))
        k, c = key[order], ctx[order]
        lead = np.ones(len(key), bool)
        lead[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first[order[lead]] = True
    return first


def phrase_counts(docs: DataFrame, length: int) -> DataFrame:
    """(key, ctx, first, n): phrases combined within a batch, so that a passage in a third of all texts is one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, ctxs, docs_, n = b.column(0).to_numpy(), [], [], [], 0
            for r, _, _, key, ctx in parse(*text_bytes(b.column(1)), length):
                keys.append(key)
                ctxs.append(ctx)
                docs_.append(np.full(len(key), ids[r], np.int64))
                n += len(key)
                if n >= 300_000 or r + 1 == len(b):
                    k, c, d = (np.concatenate(x) for x in (keys, ctxs, docs_))
                    order = np.lexsort((d, c, k))
                    k, c, d = k[order], c[order], d[order]
                    new = np.ones(len(k), bool)
                    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                    at = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (k[at], c[at], d[at], np.diff(np.append(at, len(k)))))], ["key", "ctx", "first", "n"])
                    keys, ctxs, docs_, n = [], [], [], 0

    return docs.mapInArrow(tidy(run), "key long, ctx long, first long, n long")


def phrase_places(docs: DataFrame, length: int) -> DataFrame:
    """(key, ctx, doc_id, lo, hi, again): every phrase; ``again`` if the same text has it earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, n = b.column(0).to_numpy(), [], 0
            for r, lo, hi, key, ctx in parse(*text_bytes(b.column(1)), length):
                held.append((key, ctx, np.full(len(key), ids[r], np.int64), lo, hi, ~_first_in_text(key, ctx)))
                n += len(key)
                if n >= 100_000 or r + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["key", "ctx", "doc_id", "lo", "hi", "again"])
                    held, n = [], 0

    return docs.mapInArrow(tidy(run), "key long, ctx long, doc_id long, lo long, hi long, again boolean")


def dictionary_repeats(entries: DataFrame, length: int, most: int = 60_000) -> DataFrame:
    """(doc_id, lo, hi) of starts whose string also starts earlier, from phrases (key, doc_id, lo, bytes) sorted by key and place.

    The suffixes of a trigger's phrases are sorted with those of other triggers in one suffix array of about
    ``most`` suffixes; no trigger has more than ``HEAVY`` phrases here.
    """

    def repeats(bits: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """Suffix array of the phrases' starts, cut off at ``length`` bytes, in corpus order where equal."""
        text = np.frombuffer(b"".join(x[3] for x in bits), np.uint8)
        n = np.array([len(x[3]) - length + 1 for x in bits])
        base = np.concatenate([[0], np.cumsum([len(x[3]) for x in bits])[:-1]])
        owner = np.repeat(np.arange(len(bits)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        suffix = np.lib.stride_tricks.sliding_window_view(text, length)[base[owner] + start]
        words = np.ascontiguousarray(np.pad(suffix, ((0, 0), (0, -length % 8)))).view(">u8").astype(U64)
        order = np.lexsort(words.T[::-1])  # stable, and phrases came in corpus order
        equal = np.zeros(len(order), bool)
        equal[1:] = (words[order[1:]] == words[order[:-1]]).all(1)
        dup = np.zeros(len(order), bool)
        dup[order] = equal
        new = dup.copy()
        new[1:] &= ~dup[:-1] | (owner[1:] != owner[:-1])
        end = dup.copy()
        end[:-1] &= ~dup[1:] | (owner[1:] != owner[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        place = np.array([x[2] for x in bits], np.int64)[owner] + start
        ids = np.array([x[1] for x in bits], np.int64)[owner]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[a], place[a], place[b])], ["doc_id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = [], 0
        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bits and entry[0] != bits[-1][0] and size >= most:
                    yield repeats(bits)
                    bits, size = [], 0
                if bits and bits[-1] == entry:  # a repeated row
                    continue
                bits.append(entry)
                size += len(entry[3]) - length + 1
        if bits:
            yield repeats(bits)

    return entries.mapInArrow(tidy(run), "doc_id long, lo long, hi long")


def string_repeats(phrases: DataFrame, length: int) -> DataFrame:
    """As ``dictionary_repeats``, for the phrases of heavy triggers: each string is known by its trigger and its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.slice(i, 2000)
                data, offsets = text_bytes(part.column(3))
                up, down = powers(len(data) + 1)
                total = np.zeros(len(data) + 1, U64)
                with np.errstate(over="ignore"):
                    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
                n = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(n)), n)
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[row] + start
                with np.errstate(over="ignore"):
                    h = mix((total[at + length] - total[at]) * down[at])
                who = pa.array(row)
                place = part.column(2).to_numpy()[row] + start
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), pa.array(h.view(np.int64)), part.column(1).take(who), pa.array(place)], ["key", "hash", "doc_id", "at"])

    t = stored(phrases.mapInArrow(tidy(run), "key long, hash long, doc_id long, at long"), "strings")
    first = t.groupBy("key", "hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return t.join(first, ["key", "hash"]).where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, spans): sorted disjoint byte ranges [a, b) of each text to remove, from ``docs(doc_id, text)``; texts without any are left out."""
    d = docs.where(F.octet_length("text") >= length)
    # Both are stored so that each side of the joins is an exchange of its own, which Spark can split at a hot key.
    live = phrase_counts(d, length).groupBy("key").agg(F.min("ctx").alias("c0"), F.max("ctx").alias("c1"), F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1").select("key", (F.col("c0") < F.col("c1")).alias("differ"), "first")
    live = stored(live, "live")
    places = stored(phrase_places(d, length).join(live, "key").where("differ or again or doc_id > first"), "places")
    whole = places.where("again or not differ").select("doc_id", "lo", "hi")

    once = places.where("differ and not again").select("key", "ctx", "doc_id", "lo", "hi")
    first = stored(once.groupBy("key", "ctx").agg(F.min("doc_id").alias("first")), "first")
    known = stored(once.join(first, ["key", "ctx"]), "known")
    heavy = stored(first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("key"), "heavy")

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, size = b.column(0).to_pylist(), [], 0
            for r, doc in enumerate(ids):
                raw = b.column(1)[r].as_buffer()
                col = b.column(2)[r].values
                for key, lo, hi in zip(*(x.to_pylist() for x in col.flatten()), strict=True):
                    held.append((key, doc, lo, bytes(raw[lo : hi + length])))
                    size += hi + length - lo
                if held and (size > 4 << 20 or r + 1 == len(ids)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "doc_id", "lo", "raw"])
                    held, size = [], 0

    def entries(some: DataFrame) -> DataFrame:
        """(key, doc_id, lo, raw) of the first of each different phrase."""
        look = some.groupBy("doc_id").agg(F.collect_set(F.struct("key", "lo", "hi")).alias("look"))
        return d.join(look.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "look").mapInArrow(tidy(phrases), "key long, doc_id long, lo long, raw binary")

    lead = known.where("doc_id = first").select("key", "doc_id", "lo", "hi")
    starts = whole.unionByName(known.where("doc_id > first").select("doc_id", "lo", "hi"))
    light = entries(lead)
    if not heavy.isEmpty():
        every = stored(light, "entries")
        light = every.join(heavy, "key", "left_anti").select(*every.columns)
        starts = starts.unionByName(string_repeats(every.join(heavy, "key", "left_semi").select(*every.columns), length))
    starts = starts.unionByName(dictionary_repeats(light.repartition("key").sortWithinPartitions("key", "doc_id", "lo"), length))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for r in range(len(b)):
                lo, hi = (x.to_numpy() for x in b.column(1)[r].values.flatten())
                order = np.argsort(lo, kind="stable")
                a, e = lo[order], np.maximum.accumulate(hi[order] + length)
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > e[:-1]
                at = np.flatnonzero(new)
                spans.append(np.stack([a[at], e[np.append(at[1:], len(a)) - 1]], 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), lists(spans, pa.int64())], ["doc_id", "spans"])

    return starts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("s")).mapInArrow(tidy(merged), "doc_id long, spans array<long>")


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Every byte covered by a ``length``-byte string that also starts earlier (smaller doc_id, or earlier in the
    same text) is removed; matches stay within a document and are judged on the input. Null text is empty. Rows
    with a null id are kept whole and match nothing. Equal rows of one id count as one place in the order; different
    texts of one id are places of their own, in the order of their SHA-256. Ids are whole numbers, or texts that read
    as such; others are an error. Other columns are not read. An empty table gives no rows.
    """
    placed = with_places(docs.select(id_col, text_col), id_col, text_col)
    if placed is not None:
        found = _dedup(placed.select("__place", text_col).where("__place is not null"), length, "__place", text_col, with_text).withColumnRenamed("doc_id", "__place")
        names = placed.select("__place", F.col(id_col).cast("long").alias("doc_id")).where("__place is not null").distinct()
        rest = placed.where("__place is null").select(id_col, text_col)
        out = found.join(names, "__place").select("doc_id", *found.columns[1:])
        return out.unionByName(_dedup(rest, length, id_col, text_col, with_text))
    return _dedup(docs, length, id_col, text_col, with_text)


def _dedup(docs: DataFrame, length: int, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """``dedup`` where equal ids have equal texts."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = stored(repeated(d.where("doc_id is not null"), length), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            rows, kept = [], []
            for r in range(len(b)):
                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                s = b.column(2)[r].as_py() or []
                parts, at = [], 0
                for a, e in zip(s[::2], s[1::2], strict=True):
                    parts.append(raw[at:a])
                    at = e
                out = b"".join([*parts, raw[at:]])
                rows.append((len(raw), len(raw) - len(out), len(s) // 2, hashlib.sha256(out).hexdigest()))
                if with_text:
                    kept.append(out.decode("utf-8", "ignore"))
            cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, *([pa.array(kept, pa.string())] if with_text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return d.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def remove(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes of each text gone and all other columns as they are.

    Where a cut falls inside a character, what is left of the character goes too. Null and empty texts, repeated ids, rows
    without an id and empty tables are as in ``dedup``; columns of any other name stay untouched.
    """
    placed = with_places(docs, id_col, text_col)
    if placed is not None:
        return _remove(placed, length, "__place", text_col).drop("__place")
    return _remove(docs, length, id_col, text_col)


def _remove(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``remove`` where equal ids have equal texts."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = stored(repeated(d.where("doc_id is not null"), length), "spans")
    at, schema = docs.columns.index(text_col), docs.schema
    big = pa.types.is_large_string

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept = b.column(at), []
            for r, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not s:
                    kept.append(texts[r].as_py())
                    continue
                raw, parts, last = texts[r].as_py().encode(), [], 0
                for a, e in zip(s[::2], s[1::2], strict=True):
                    parts.append(raw[last:a])
                    last = e
                kept.append(b"".join([*parts, raw[last:]]).decode("utf-8", "ignore"))
            cols = list(b.columns[:-1])
            cols[at] = pa.array(kept, pa.large_string() if big(texts.type) else pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    # By place and not by name, so that no column of theirs can clash with the names here.
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    joined = rows.join(spans.hint("shuffle_hash"), rows[f"c{docs.columns.index(id_col)}"].cast("long") == spans["doc_id"], "left")
    return joined.select(*rows.columns, "spans").mapInArrow(tidy(run), schema)
