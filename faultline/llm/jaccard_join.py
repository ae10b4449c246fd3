"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles stand in one global order, rarest first. Two sets with overlap t share at least l tokens among the
first n - t + l of each, for every l. Each document picks its own l by the estimated cost of its candidates: a
longer prefix demands more shared tokens before a pair is verified. Classes of equal sets count once.

Counting all shingles would move the whole corpus, so the first order ranks a fixed part of the hash space,
which prefixes seldom leave. Documents whose prefix still holds a frequent token (large groups of near copies,
mostly boilerplate) are dense. A pair with a document that isn't dense shares rare tokens only and is found from
short posting lists. Pairs of two dense documents are found in a second order that counts all their shingles.
There the documents of a frequent token are written as differences from the token's most central document, and
prefixes over those differences find the pairs: however large a group of near copies is, its members' own
changes are rare. Documents far from the center take another one in the next round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.shared import int_bits, lists, mix, shingle_sets, stored, text_bytes, tidy, with_places

U64 = np.uint64


@dataclass(frozen=True)
class Jaccard:
    """Words to a shingle; documents link when ``den * intersection >= num * union``."""

    words: int = 5
    num: int = 80
    den: int = 100
    most_l: int = 6
    #: Cost of verifying one candidate against that of one step through a posting list.
    verify_cost: float = 8.0
    #: Tokens in more documents are frequent.
    frequent: int = 8
    #: Rounds in which frequent tokens take a center; what lies far from every center is then joined pair by pair.
    pivots: int = 6
    #: A round that leaves more than this share far from their centers is the last.
    useful: float = 0.9
    #: Up to so many ids a side is broadcast (8 bytes each); above, it is joined by shuffle.
    broadcast_ids: int = 500_000
    #: Links of a component are counted in lanes of about so many sets and tokens, every two lanes in a group.
    lane_sets: int = 1024
    lane_tokens: int = 400_000

    def least(self, n):
        """The overlap that a set of n shingles needs with any partner."""
        return (self.num * n + self.den - 1) // self.den

    def overlap(self, a, b):
        """The overlap that sets of a and b shingles need with each other, before rounding down."""
        return ((a + b) * self.num + self.num + self.den - 1) / (self.num + self.den)

    @property
    def low(self) -> int:
        """Tokens below this hash come first in the global order, rarest first; they are somewhat more than a prefix needs."""
        return int(min(1.0, 1 - self.num / self.den + 0.05) * 2**63)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum() >> U64(1)), int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum() >> U64(1))


def shingle_table(docs: DataFrame, cfg: Jaccard, every: bool = False) -> DataFrame:
    """(doc_id, n, fa, fb, low, tokens): set size, 126-bit fingerprint, and the tokens that can stand in a prefix, in hash order.

    ``low`` of the tokens have a hash below ``cfg.low``; others follow only where those don't fill the longest
    prefix. With ``every``, all tokens are there and rank alike.
    """
    bound = 2**63 if every else cfg.low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fa, fb, low, tokens = [], [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(*text_bytes(b.column(1)), cfg.words):
                    h = s >> U64(1)
                    n.append(len(h))
                    for f, x in zip((fa, fb), fingerprint(s), strict=True):
                        f.append(x)
                    low.append(int(np.searchsorted(h, U64(bound))))
                    tokens.append(int_bits(h[: max(low[-1], min(len(h), len(h) - cfg.least(len(h)) + cfg.most_l))]))
            for i in range(0, len(n), 1000):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1000), *(pa.array(x[i : i + 1000], pa.int64()) for x in (n, fa, fb, low)), lists(tokens[i : i + 1000], pa.int64())], ["doc_id", "n", "fa", "fb", "low", "tokens"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, fa long, fb long, low long, tokens array<long>")


def adaptive_prefixes(shared: DataFrame, cfg: Jaccard) -> DataFrame:
    """(token, doc_id, n, l, at, df, alone, dense) from rows (doc_id, n, low, tokens) of structs (at, df, token).

    ``at`` is the token's place in the document's order, ``alone`` the number of ranked tokens that no other
    document has, ``dense`` whether the chosen prefix holds a frequent token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns, lows = (b.column(i).to_numpy() for i in range(3))
            col = b.column(3)
            at, df, token = (x.to_numpy() for x in col.flatten().flatten())
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()
            out = []
            for k in range(len(b)):
                n, low, s = int(ns[k]), int(lows[k]), slice(ends[k], ends[k + 1])
                t, first = np.unique(token[s], return_index=True)
                a, d = at[s][first], df[s][first]
                head = a < low
                early = np.lexsort((t[head], d[head]))
                t, a, d = (np.concatenate([x[head][early], x[~head]]) for x in (t, a, d))
                alone = low - int(head.sum())
                place = np.concatenate([alone + np.arange(low - alone), a[low - alone :]])
                least, best = cfg.least(n), None
                for length in range(1, min(cfg.most_l, least) + 1):
                    m = int(np.searchsorted(place, n - least + length))
                    walk = float((d[:m] - 1).sum())
                    cost = walk + cfg.verify_cost * walk / length
                    if best is None or cost < best[0]:
                        best = cost, length, m
                _, length, m = best
                out.append((t[:m], place[:m], d[:m], ids[k], n, length, alone, int((d[:m] > cfg.frequent).any())))
            if out:
                size = [len(x[0]) for x in out]
                cols = [np.repeat([x[i] for x in out], size) for i in range(3, 8)]
                token_, place_, df_ = (np.concatenate([x[i] for x in out]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (token_, *cols[:3], place_, df_, *cols[3:])], ["token", "doc_id", "n", "l", "at", "df", "alone", "dense"])

    return shared.mapInArrow(tidy(run), "token long, doc_id long, n long, l long, at long, df long, alone long, dense long")


def _meet(p: str, q: str, cfg: Jaccard) -> Column:
    """Whether a shared token lies in the prefixes that this pair's own sizes ask for."""
    c = F.col
    need, l_ = F.floor(cfg.overlap(c(f"{p}.n"), c(f"{q}.n"))), F.least(f"{p}.l", f"{q}.l")
    near = F.least(f"{p}.n", f"{q}.n") * cfg.den >= F.greatest(f"{p}.n", f"{q}.n") * cfg.num
    return near & (c(f"{p}.at") < c(f"{p}.n") - need + l_) & (c(f"{q}.at") < c(f"{q}.n") - need + l_)


def prefixes(reps: DataFrame, cfg: Jaccard) -> DataFrame:
    """The adaptive prefixes of ``reps``: tokens that only one of them has are counted but not kept."""
    tokens = reps.select("doc_id", "n", "low", F.posexplode("tokens").alias("at", "token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(common, "token").groupBy("doc_id", "n", "low").agg(F.collect_list(F.struct("at", "df", "token")).alias("tokens"))
    return adaptive_prefixes(shared, cfg)


def _pairs(p: DataFrame, q: DataFrame, extra: Column, cfg: Jaccard) -> DataFrame:
    """(a, b) of p and q that share as many tokens of their prefixes as the shorter prefix asks for."""
    j = p.alias("p").join(q.alias("q"), (F.col("p.token") == F.col("q.token")) & extra & _meet("p", "q", cfg))
    j = j.groupBy(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b"), F.least("p.l", "q.l").alias("m"))
    return j.agg(F.count("*").alias("c")).where("c >= m").select("a", "b")


def whole_sets(docs: DataFrame, cfg: Jaccard) -> DataFrame:
    """(doc_id, fa, fb, s): fingerprint and whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, fa, fb, size, i = [], [], [], 0, 0
            for k, s in enumerate(shingle_sets(*text_bytes(b.column(1)), cfg.words)):
                held.append(int_bits(s))
                for f, x in zip((fa, fb), fingerprint(s), strict=True):
                    f.append(x)
                size += s.nbytes
                if size > 4 << 20 or k + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(held)), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), lists(held, pa.int64())], ["doc_id", "fa", "fb", "s"])
                    held, fa, fb, size, i = [], [], [], 0, k + 1

    return docs.mapInArrow(tidy(run), "doc_id long, fa long, fb long, s array<long>")


def verified(pairs: DataFrame, docs: DataFrame, cfg: Jaccard) -> DataFrame:
    """The linked ones of ``pairs(a, b)``, by their whole shingle sets. Sets are made for documents in a pair only."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "involved")
    few = F.broadcast(ids) if ids.count() <= cfg.broadcast_ids else ids.hint("shuffle_hash")

    sets = stored(whole_sets(docs.join(few, "doc_id", "left_semi"), cfg).select("doc_id", "s"), "sets")
    j = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return j.withColumn("i", both).where(F.col("i") * cfg.den >= (F.size("sa") + F.size("sb") - F.col("i")) * cfg.num).select("a", "b").distinct()


def deltas(member: DataFrame, sets: DataFrame, cfg: Jaccard) -> DataFrame:
    """(center, cf, doc_id, n, w, k, tokens) from ``member(center, doc_id)`` and ``sets(doc_id, fa, s)``.

    A document is written as what it lacks of its center's set and what it has beyond it (a lacking token is its
    complement). With K = (den - num) * |center| and W = den * lacking + num * beyond, two documents of a center
    link exactly if (num + den) * (delta tokens in common) >= W + W' - K, so one links with its center if W <= K.
    Documents of W <= 2K link only with those of W <= 2K * den / num + K; tokens beyond that are left out.
    """
    c = sets.select(F.col("doc_id").alias("center"), F.col("fa").alias("cf"), F.col("s").alias("sc"))
    j = member.join(sets, "doc_id").join(c, "center")
    j = j.select("center", "cf", "doc_id", F.array_except("sc", "s").alias("lacks"), F.array_except("s", "sc").alias("more"), ((cfg.den - cfg.num) * F.size("sc")).cast("long").alias("k"))
    j = j.withColumn("w", (cfg.den * F.size("lacks") + cfg.num * F.size("more")).cast("long"))
    tokens = F.when(F.col("w") * cfg.num <= F.col("k") * (2 * cfg.den + cfg.num), F.concat(F.transform("lacks", lambda x: F.bitwise_not(x)), F.col("more")))
    return j.select("center", "cf", "doc_id", (F.size("lacks") + F.size("more")).alias("n"), "w", "k", tokens.alias("tokens"))


def delta_pairs(d: DataFrame, cfg: Jaccard) -> DataFrame:
    """Candidates (a, b) of ``deltas`` that aren't both linked with their center, by prefixes over the delta tokens.

    Tokens stand rarest first within their center's group. What near copies have in common are neither their own
    changes nor, mostly, the places of them, so that the joined lists stay short however large the group is.
    """
    c, whole, group = F.col, cfg.num + cfg.den, ["center", "cf"]
    near = d.where("tokens is not null and n > 0")
    least = near.where("w > k").groupBy(*group).agg(F.min("w").alias("far"))
    t = stored(near.join(least, group).select(*group, "doc_id", "n", "w", "k", "far", F.explode("tokens").alias("token")), "delta-tokens")
    common = t.groupBy(*group, "token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = t.join(common, [*group, "token"]).groupBy(*group, "doc_id", "n", "w", "k", "far").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    ranked = ranked.select(*group, "doc_id", "n", "w", "k", "far", F.size("t").alias("held"), F.posexplode("t").alias("pos", "x")).select(*group, "doc_id", "n", "w", "k", "far", c("x.token").alias("token"), (c("pos") + c("n") - c("held")).alias("at"))
    need = lambda w: F.ceil((c("w") + w - c("k")) / whole)
    ranked = stored(ranked.where(c("at") <= c("n") - F.when(c("w") > c("k"), need(F.lit(0))).otherwise(need(c("far")))), "delta-prefixes")

    def met(p: DataFrame, q: DataFrame, extra: Column) -> DataFrame:
        r = F.greatest(F.lit(1), F.ceil((c("p.w") + c("q.w") - c("p.k")) / whole))
        on = (c("p.center") == c("q.center")) & (c("p.cf") == c("q.cf")) & (c("p.token") == c("q.token")) & extra
        on &= (c("p.at") <= c("p.n") - r) & (c("q.at") <= c("q.n") - r)
        j = p.alias("p").join(q.alias("q"), on)
        return j.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b"))

    out, linked = ranked.where("w > k"), ranked.where("w <= k")
    short = out.where(c("at") <= c("n") - need(c("far")))
    return met(short, short, c("p.doc_id") < c("q.doc_id")).unionByName(met(out, linked, c("p.doc_id") != c("q.doc_id"))).distinct()


def links(docs: DataFrame, table: DataFrame, cfg: Jaccard) -> DataFrame:
    """Edges (a, b) between representatives of equal sets that have every link's components."""
    classes = table.where("n > 0 and doc_id is not null").groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("doc_id"))
    reps = table.join(classes.hint("shuffle_hash"), ["doc_id", "n", "fa", "fb"], "left_semi")
    ranked = stored(prefixes(reps, cfg), "prefixes")

    rare = ranked.where(F.col("df") <= cfg.frequent).select("token", "doc_id", "n", "l", "at", "dense")
    found = _pairs(rare, rare, (F.col("p.doc_id") < F.col("q.doc_id")) & (F.col("p.dense") + F.col("q.dense") < 2), cfg)

    dense = stored(ranked.where("dense = 1").select("doc_id").distinct(), "dense")
    few = F.broadcast(dense) if dense.count() <= cfg.broadcast_ids else dense.hint("shuffle_hash")
    whole = shingle_table(docs.join(few, "doc_id", "left_semi"), cfg, every=True).dropDuplicates(["doc_id", "fa", "fb"])
    again = stored(prefixes(whole, cfg).drop("dense"), "dense-prefixes")
    rest = again.where(F.col("df") <= cfg.frequent).drop("df", "alone")
    hot = again.where(F.col("df") > cfg.frequent).drop("df")
    ids = stored(hot.select("doc_id").distinct(), "hot")
    few = F.broadcast(ids) if ids.count() <= cfg.broadcast_ids else ids.hint("shuffle_hash")
    sets = stored(whole_sets(docs.join(few, "doc_id", "left_semi"), cfg).dropDuplicates(["doc_id", "fa", "fb"]).drop("fb"), "hot-sets")
    near = None
    for _ in range(cfg.pivots):
        size = hot.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("alone", "doc_id"))["doc_id"].alias("center"))
        placed = stored(hot.join(size, "token"), "centers")
        rest = rest.unionByName(placed.where(F.col("size") <= cfg.frequent).select(*rest.columns))
        placed = placed.where(F.col("size") > cfg.frequent).drop("size")
        hot = placed.drop("center")
        if placed.isEmpty():
            break
        d = stored(deltas(placed.select("center", "doc_id").distinct(), sets, cfg), "deltas")
        star = d.where("w <= k and center <> doc_id").select(F.least("center", "doc_id").alias("a"), F.greatest("center", "doc_id").alias("b"))
        near = star if near is None else near.unionByName(star)
        found = found.unionByName(delta_pairs(d, cfg))
        far = d.where("w > 2 * k").select("center", "doc_id").distinct()
        hot = stored(placed.join(far, ["center", "doc_id"], "left_semi").drop("center"), "far")
        if hot.count() > cfg.useful * placed.count():
            break
    rest = rest.unionByName(hot.select(*rest.columns))
    found = stored(found.distinct(), "candidates")
    first = verified(found, docs, cfg)
    first = stored(first if near is None else first.unionByName(near).distinct(), "links")

    comp = components(first)
    placed = stored(rest.join(comp, rest["doc_id"] == comp["node"], "left").select("token", "doc_id", "n", "l", "at", F.coalesce("component", "doc_id").alias("comp")), "placed")
    split = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
    left = placed.join(split, "token", "left_semi")
    more = stored(_pairs(left, left, F.col("p.comp") < F.col("q.comp"), cfg).join(found, ["a", "b"], "left_anti"), "rest")
    return first.unionByName(verified(more, docs, cfg))


def link_counts(docs: DataFrame, classes: DataFrame, cfg: Jaccard) -> DataFrame:
    """(n, fa, fb, more): the rows of other classes that each class links with, for classes that share a component.

    ``classes`` holds (n, fa, fb, rep, size, component_id). Every link lies within a component, so each two sets
    of a component are compared, in groups of two bounded lanes; counts leave a group, not pairs.
    """
    many = classes.groupBy("component_id").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where("sets > 1")
    many = many.select("component_id", F.ceil(F.greatest(F.col("sets") / cfg.lane_sets, F.col("tokens") / cfg.lane_tokens)).cast("int").alias("lanes"))
    some = stored(classes.join(many, "component_id").withColumn("lane", F.pmod(F.xxhash64("n", "fa", "fb"), F.col("lanes").cast("long")).cast("int")), "counted")
    ids = some.select(F.col("rep").alias("doc_id")).distinct()
    few = F.broadcast(ids) if ids.count() <= cfg.broadcast_ids else ids.hint("shuffle_hash")
    sets = whole_sets(docs.join(few, "doc_id", "left_semi"), cfg).withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "fa", "fb"])
    placed = stored(some.join(sets, ["rep", "fa", "fb"]), "counted-sets")
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumns({"i": F.least("lane", "o"), "j": F.greatest("lane", "o")})

    def kernel(t: pa.Table) -> pa.Table:
        lane, n, w, i, j = (t[x].to_numpy() for x in ("lane", "n", "size", "i", "j"))
        col = t["s"].combine_chunks()
        ends = col.offsets.to_numpy().astype(np.int64) - col.offsets[0].as_py()
        tokens, code = np.unique(col.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(t)), np.diff(ends))
        right = lane == j
        of = right[row]
        order = np.argsort(code[of], kind="stable")
        posts, start = row[of][order], np.searchsorted(code[of][order], np.arange(len(tokens) + 1))
        more = np.zeros(len(t), np.int64)
        for a in np.flatnonzero(lane == i):
            c = code[ends[a] : ends[a + 1]]
            size = start[c + 1] - start[c]
            at = np.repeat(start[c] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.bincount(posts[at], minlength=len(t))
            link = right & (both * cfg.den >= (n[a] + n - both) * cfg.num)
            link[a] = False
            more[a] += w[link].sum()
            if i[0] != j[0]:
                more[link] += w[a]
        return pa.table([t["n"], t["fa"], t["fb"], pa.array(more)], ["n", "fa", "fb", "more"])

    part = met.select("component_id", "i", "j", "lane", "n", "fa", "fb", "size", "s").groupBy("component_id", "i", "j").applyInArrow(kernel, "n long, fa long, fb long, more long")
    return part.groupBy("n", "fa", "fb").agg(F.sum("more").alias("more"))


def _placed(d: DataFrame, cfg: Jaccard) -> tuple[DataFrame, DataFrame]:
    """The shingle table of ``d(doc_id, text)`` without its tokens, and (n, fa, fb, rep, size, component_id) of its classes."""
    table = stored(shingle_table(d, cfg), "shingles")
    comp = components(links(d.where("doc_id is not null"), table, cfg)).select(F.col("node").alias("rep"), "component")
    rep = table.where("n > 0").groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("size"))
    return table.select("doc_id", "n", "fa", "fb"), rep.join(comp, "rep", "left").select("n", "fa", "fb", "rep", "size", F.coalesce("component", "rep").alias("component_id"))


def _input(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def groups(docs: DataFrame, cfg: Jaccard = Jaccard(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    Null and blank texts have no shingles and are their own component, as are rows with a null id (component
    and links null). Equal sets link whatever their text. Rows that repeat an id share its component.
    ``n_links`` counts the other rows with an id whose set links with the row's own, equal sets included.
    """
    d = _input(docs, id_col, text_col)
    table, classes = _placed(d, cfg)
    classes = stored(classes, "classes")
    more = link_counts(d.where("doc_id is not null"), classes.where("rep is not null"), cfg)
    named = classes.join(more, ["n", "fa", "fb"], "left").select("n", "fa", "fb", "component_id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out, has = table.join(named, ["n", "fa", "fb"], "left"), F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(has, F.coalesce("n_links", F.lit(0))).alias("n_links"))


def keep_one(docs: DataFrame, cfg: Jaccard = Jaccard()) -> DataFrame:
    """Rows of ``docs`` whose id is the least of its component, all columns kept.

    Rows with a null id and null or blank texts stay, each its own group. Equal rows of one id stay or go together;
    different texts of one id are documents of their own, in the order of their SHA-256. Other columns are not read.
    An empty table gives no rows.
    """
    placed = with_places(docs)
    if placed is None:
        return _keep_one(docs, "doc_id", cfg)
    return _keep_one(placed, "__place", cfg).drop("__place")


def _keep_one(docs: DataFrame, id_col: str, cfg: Jaccard) -> DataFrame:
    table, classes = _placed(_input(docs, id_col), cfg)
    gone = table.join(classes, ["n", "fa", "fb"]).where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
