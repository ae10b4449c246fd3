"""How far the sources of a language diverge in their terms, counted in mergeable radix tries.

Each task counts its documents in a byte trie whose leaves hold a counter per source, and hands its leaves on in
byte order. Leaves meet by prefix range: a range holds every counter of its terms, in UTF-8 order, so one pass
merges them, and a second pass over blocks of merged leaves adds up the distance of each two sources and keeps the
terms that a source uses more than its language, ties in the order of the traversal.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import pieces, stored, text_bytes, tidy

#: Leaves after which a task hands its trie on and starts another; merged leaves of a block; sources of a tile.
LEAVES, BLOCK, TILE = 250_000, 4_096, 256
#: Bytes of text counted at a time, and bytes of neighbouring keys that are compared to find where they part.
PIECE, SHARED = 8 << 20, 32
#: What a byte counts as in a term: letters lower-cased, bytes from 128 themselves, 0 for what parts terms.
SPELLED = np.zeros(256, np.uint8)
SPELLED[128:] = np.arange(128, 256)
SPELLED[97:123] = SPELLED[65:91] = np.arange(97, 123)
LEAF = "key binary, docs long, counts array<struct<source:string,n:long>>"
COUNTS = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))


class RadixTrie:
    """Byte strings by shared prefixes. A node is [edge bytes, children by first byte or None, documents, {source: count} or None where no key ends]."""

    def __init__(self) -> None:
        self.root: list = [b"", None, 0, None]
        self.leaves = 0

    def leaf(self, key: bytes, path: list[tuple[int, list]] | None = None) -> list:
        """The node at which ``key`` ends, made where it is missing; an edge that goes another way is split at the last shared byte.

        ``path`` holds the nodes known to lie on the way with the bytes they consume, and gets the new ones.
        """
        path = [(0, self.root)] if path is None else path
        (at, node), end = path[-1], len(key)
        while at < end:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(key[at])
            if child is None:
                node = children[key[at]] = [key[at:], None, 0, None]
                at = end
            else:
                edge = child[0]
                if key.startswith(edge, at):
                    node, at = child, at + len(edge)
                else:
                    same = 1
                    while same < len(edge) and at + same < end and edge[same] == key[at + same]:
                        same += 1
                    children[key[at]] = node = [edge[:same], {edge[same]: child}, 0, None]
                    child[0] = edge[same:]
                    at += same
            path.append((at, node))
        return node

    def _count(self, node: list, docs: int, sources: list[str], counts: list[int]) -> None:
        node[2] += docs
        held = node[3]
        if held is None:
            self.leaves += 1
            node[3] = dict(zip(sources, counts, strict=True))
        else:
            for s, n in zip(sources, counts, strict=True):
                held[s] = held.get(s, 0) + n

    def add(self, key: bytes, docs: int, sources: list[str], counts: list[int]) -> list:
        node = self.leaf(key)
        self._count(node, docs, sources, counts)
        return node

    def add_sorted(self, keys: list[bytes], docs: list[int], cuts: list[int], sources: list[str], counts: list[int]) -> None:
        """Adds different keys in byte order; each goes on from the last node it shares with the one before. Counters of key i are from cuts[i] on."""
        start = np.array(keys, f"S{SHARED}")
        same = start[1:].view(np.uint8).reshape(-1, SHARED) == start[:-1].view(np.uint8).reshape(-1, SHARED)
        shared = [0, *np.where(same.all(1), SHARED, same.argmin(1)).tolist()]
        path = [(0, self.root)]
        for i, key in enumerate(keys):
            while path[-1][0] > shared[i]:
                path.pop()
            a, b = cuts[i], cuts[i + 1]
            self._count(self.leaf(key, path), docs[i], sources[a:b], counts[a:b])

    def merge(self, other: RadixTrie, once: bool = False) -> None:
        """Adds another trie's counters; ``once`` when both are parts of one document, which a leaf counts once."""
        for key, docs, held in other.walk():
            node = self.add(key, docs, list(held), list(held.values()))
            if once:
                node[2] = 1

    def walk(self) -> Iterator[tuple[bytes, int, dict[str, int]]]:
        """(key, documents, counts) in the order of bytes, which is that of UTF-8."""
        todo = [(b"", self.root)]
        while todo:
            path, (edge, children, docs, held) = todo.pop()
            path += edge
            if held is not None:
                yield path, docs, held
            if children:
                todo.extend((path, children[b]) for b in sorted(children, reverse=True))


def term_array(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts in order, spelled out, and the number of terms of each text."""
    spelled = SPELLED[data]
    solid = spelled > 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=at[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(spelled[solid])])
    return terms, np.diff(np.searchsorted(starts, offsets))


def insert(trie: RadixTrie, data: np.ndarray, offsets: np.ndarray, langs: list[str], sources: list[str]) -> None:
    """Counts some texts into ``trie``: terms are numbered and counted per document and source first, then each leaf is met once."""
    terms, many = term_array(data, offsets)
    if not len(terms):
        return
    coded, n = terms.dictionary_encode(), len(many)
    number: dict = {}
    group = np.array([number.setdefault(g, len(number)) for g in zip(langs, sources, strict=True)])
    groups = list(number)
    lang_no = {x: i for i, x in enumerate(dict.fromkeys(g[0] for g in groups))}
    lang_of = np.array([lang_no[g[0]] for g in groups])
    pair, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), many), return_counts=True)
    code, doc = np.divmod(pair, n)
    leaf = code * len(lang_no) + lang_of[group[doc]]
    cell, back = np.unique(leaf * len(groups) + group[doc], return_inverse=True)
    total, docs = np.bincount(back, times).astype(np.int64), np.bincount(back)
    leaf, own = np.divmod(cell, len(groups))
    first = np.flatnonzero(np.diff(leaf, prepend=-1))
    docs, leaf = np.add.reduceat(docs, first), leaf[first]
    heads, words = [x.encode() + b"\0" for x in lang_no], coded.dictionary.to_pylist()
    keys = [heads[k % len(heads)] + words[k // len(heads)] for k in leaf.tolist()]
    order = pc.sort_indices(pa.array(keys, pa.binary())).to_numpy()
    many = np.diff(first, append=len(cell))[order]
    cuts = np.append(0, np.cumsum(many))
    at = np.repeat(first[order] - cuts[:-1], many) + np.arange(len(cell))
    trie.add_sorted([keys[i] for i in order.tolist()], docs[order].tolist(), cuts.tolist(), [groups[g][1] for g in own[at].tolist()], total[at].tolist())


def insert_long(trie: RadixTrie, data: np.ndarray, lang: str, source: str) -> None:
    """One text longer than a piece, cut where no term is; its leaves count it once."""
    whole, a = RadixTrie(), 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        while b < len(data) and SPELLED[data[b]] and SPELLED[data[b - 1]]:
            b += 1
        part = RadixTrie()
        insert(part, data[a:b], np.array([0, b - a]), [lang], [source])
        whole.merge(part, once=True)
        a = b
    trie.merge(whole)


def leaf_rows(leaves: list[tuple[bytes, int, dict[str, int]]]) -> pa.RecordBatch:
    at = np.zeros(len(leaves) + 1, np.int32)
    np.cumsum([len(x) for _, _, x in leaves], out=at[1:])
    flat = pa.StructArray.from_arrays([pa.array([s for _, _, x in leaves for s in x], pa.string()), pa.array([n for _, _, x in leaves for n in x.values()], pa.int64())], ["source", "n"])
    return pa.record_batch([pa.array([k for k, _, _ in leaves], pa.binary()), pa.array([d for _, d, _ in leaves], pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat)], ["key", "docs", "counts"])


def _spilled(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
    leaves = trie.walk()
    while part := list(islice(leaves, 10_000)):
        yield leaf_rows(part)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold PIECE bytes, so that a term that many of them share is met once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PIECE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@tidy
def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to the leaves of one or more tries, each in byte order."""
    trie = RadixTrie()
    gc.disable()  # a trie has no cycles, and the collector would walk all its nodes again and again
    try:
        for batch in gathered(batches):
            data, offsets = text_bytes(batch.column("text"))
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, j in pieces(offsets, PIECE):
                part = data[offsets[i] : offsets[j]]
                if len(part) > PIECE:
                    insert_long(trie, part, langs[i], sources[i])
                else:
                    insert(trie, part, offsets[i : j + 1] - offsets[i], langs[i:j], sources[i:j])
                if trie.leaves > LEAVES:
                    yield from _spilled(trie)
                    trie = RadixTrie()
        yield from _spilled(trie)
    finally:
        gc.enable()


def sums(counts: pa.ListArray, first: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The counters of each range of rows added up by source."""
    flat, at = counts.flatten(), counts.offsets.to_numpy() - counts.offsets[0].as_py()
    a, many = at[first], at[ends] - at[first]
    run = np.repeat(np.arange(len(first)), many)
    take = np.repeat(a - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
    coded = flat.field("source").dictionary_encode()
    cell, back = np.unique(run * len(coded.dictionary) + coded.indices.to_numpy()[take], return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, back, flat.field("n").to_numpy()[take])
    run, source = np.divmod(cell, len(coded.dictionary))
    cuts = np.searchsorted(run, np.arange(len(first) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(source)), pa.array(total)], ["source", "n"]))


def merged(least: int):
    """A task for leaves in byte order: counters of one key are added up; terms in ``least`` documents stay, in blocks of at most BLOCK."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, kept, last = TaskContext.get().partitionId() << 32, 0, None

        def out(keys: list[bytes], counts: pa.Array) -> pa.RecordBatch:
            nonlocal kept
            parts = [k.rsplit(b"\0", 1) for k in keys]
            block = base + (kept + np.arange(len(keys))) // BLOCK
            kept += len(keys)
            return pa.record_batch([pa.array([p[0].decode() for p in parts], pa.string()), pa.array([p[1].decode() for p in parts], pa.string()), pa.array(block, pa.int64()), counts], ["lang", "item", "block", "counts"])

        def settled(leaf: tuple[bytes, int, dict[str, int]] | None) -> Iterator[pa.RecordBatch]:
            if leaf is not None and leaf[1] >= least:
                yield out([leaf[0]], leaf_rows([leaf]).column("counts"))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = batch.column("key"), batch.column("counts")
            first = np.flatnonzero(np.concatenate([[True], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)]))
            docs, ends = np.add.reduceat(batch.column("docs").to_numpy(), first), np.append(first[1:], len(keys))
            for x in (0, len(first) - 1)[: len(first)]:  # the batch's ends may go on in its neighbours
                key = keys[int(first[x])].as_py()
                if last is not None and last[0] != key:
                    yield from settled(last)
                    last = None
                held, before = (last[2], last[1]) if last is not None else ({}, 0)
                for c in counts.slice(first[x], ends[x] - first[x]).flatten().to_pylist():
                    held[c["source"]] = held.get(c["source"], 0) + c["n"]
                last = (key, before + int(docs[x]), held)
                if x == 0 and len(first) > 1:
                    yield from settled(last)
                    last = None
                    inner = np.flatnonzero(docs[1:-1] >= least) + 1
                    if len(inner):
                        yield out(keys.take(pa.array(first[inner])).to_pylist(), sums(counts, first[inner], ends[inner]))
        yield from settled(last)

    return run


def joined(terms: DataFrame) -> DataFrame:
    """``terms`` with neighbouring blocks of a language put together up to BLOCK terms, so that their number follows the terms and not the tasks."""
    size = terms.groupBy("lang", "block").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    place = size.select("lang", "block", F.floor(F.coalesce(ahead, F.lit(0)) / BLOCK).cast("long").alias("place"))
    return terms.join(place, ["lang", "block"]).select("lang", "item", F.col("place").alias("block"), "counts")


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), three digits at a time so that 64 bits hold it below 9 * 10**15 words."""
    below = np.broadcast_to(total + 5 * terms, count.shape)
    left, out = count + 5, np.zeros(count.shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // below
        left = left % below
    return out + 1


def _distances(key: tuple, left: pa.Table, right: pa.Table, top: int) -> pa.Table:
    """One block of merged leaves against one or two tiles of sources: partial distances, and the block's best terms of each source."""
    low, high = key[2].as_py(), key[3].as_py()
    right = right.sort_by("source")
    names, tile = right["source"].to_pylist(), right["tile"].to_numpy()
    a, b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    sums = np.zeros((len(a), len(b)), np.int64)
    found: list[tuple[str, str, str, int]] = []
    if len(left) and len(right):
        left = left.sort_by("item")
        items, lists = left["item"].to_pylist(), left["counts"].combine_chunks()
        flat, many = lists.flatten(), np.diff(lists.offsets.to_numpy())
        coded = flat.field("source").dictionary_encode()
        at = {s: i for i, s in enumerate(names)}
        column = np.array([at.get(s, -1) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        n, row = flat.field("n").to_numpy(), np.repeat(np.arange(len(left)), many)
        own = np.zeros((len(left), len(names)), np.int64)
        own[row[column >= 0], column[column >= 0]] = n[column >= 0]
        terms = int(right["terms"][0].as_py())
        p = share(own, right["words"].to_numpy()[None, :], terms)
        for i, x in enumerate(a):
            sums[i] = np.abs(p[:, x : x + 1] - p[:, b]).sum(0)
        if low == high:
            whole = np.zeros(len(left), np.int64)
            np.add.at(whole, row, n)
            more = p - share(whole[:, None], right["lang_words"].to_numpy()[:1], terms)
            for x, s in enumerate(names):
                use = np.flatnonzero((own[:, x] > 0) & (more[:, x] > 0))
                best = use[np.argsort(-more[use, x], kind="stable")[:top]]
                found += [("term", s, items[t], int(more[t, x])) for t in best]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x != y:
                found.append(("pair", names[x], names[y], int(sums[i, j])))
                if low != high:
                    found.append(("pair", names[y], names[x], int(sums[i, j])))
    lang = key[0].as_py()
    columns = list(zip(*found, strict=True)) or [(), (), (), ()]
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "part": pa.array(columns[0], pa.string()), "source": pa.array(columns[1], pa.string()), "item": pa.array(columns[2], pa.string()), "value": pa.array(columns[3], pa.int64())})


def kept_terms(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, item, block, counts): the terms in ``least`` documents of their language with their counts by source, in stored blocks."""
    leaves = stored(docs.mapInArrow(count, LEAF), "leaves")
    by_range = leaves.repartitionByRange("key").sortWithinPartitions("key")
    return joined(stored(by_range.mapInArrow(merged(least), "lang string, item string, block long, counts array<struct<source:string,n:long>>"), "terms"))


def totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, words, lang_words, terms) of every occurring group, those without a term too."""
    words = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("words"))
    size = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    every = words.groupBy("lang").agg(F.sum("words").alias("lang_words")).join(size, "lang", "full")
    zero = {"words": 0, "lang_words": 0, "terms": 0}
    return docs.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(every, "lang", "left").fillna(zero)


def audit(documents: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to each other source, and the ``top`` terms a source uses more than its language.

    Null text, lang and source are ''. Repeated rows count each, whatever their ids; an empty table gives no rows, and a
    language without a kept term has its pairs at distance 0. Texts of any length are read whole, in pieces. Other
    columns of ``documents`` are not read, so their names cannot clash. A term's leaf is sent once per trie, a source's
    counters are added up in tries before the shuffle, and each two sources are compared a tile and a block at a time.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = kept_terms(docs, least)
    groups = stored(totals(docs, terms), "groups")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    groups = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    tile = lambda df: df.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("high", F.explode(F.sequence("low", F.col("tiles") - 1)))
    blocks = terms.select("lang", "block").distinct().unionByName(tiles.select("lang", F.lit(-1).cast("long").alias("block")))
    right = tile(groups.join(blocks, "lang")).where("tile = low or tile = high")
    left = tile(terms.join(tiles, "lang"))
    left, right = (x.toDF(*x.columns) for x in (left, right))
    cell = ("lang", "block", "low", "high")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(lambda k, x, y: _distances(k, x, y, top), "lang string, part string, source string, item string, value long")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked.select("lang", "source", "part", "item", "value", "rank")).select("lang", "source", "part", "item", "value", "rank")
