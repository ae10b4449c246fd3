"""Source divergence, embedding near-duplicates and hard negatives against brute force, on awkward rows."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import divergence, embedding_dedup, hard_negatives, oracles, queries

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def spelled(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in TERM.findall((text or "").encode())]


def audit(rows, least, top):
    """The contract of the audit in plain loops over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    seen, counts = {}, {}
    for lang, source, text in rows:
        w = spelled(text)
        for t in set(w):
            seen[lang, t] = seen.get((lang, t), 0) + 1
        for t in w:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
    out = []
    for lang in {r[0] for r in rows}:
        terms = sorted(t for (l, t), n in seen.items() if l == lang and n >= least)
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)
        c = {s: [counts.get((lang, s, t), 0) for t in terms] for s in sources}
        share = lambda x: [1 + 10**9 * (n + 5) // (sum(x) + 5 * len(terms)) for n in x]
        p, q = {s: share(c[s]) for s in sources}, share([sum(c[s][i] for s in sources) for i in range(len(terms))])
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s]
            best = [(q[i] - p[s][i], terms[i], terms[i].decode()) for i in range(len(terms)) if c[s][i] and p[s][i] > q[i]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    g = random.Random(4)
    words = [f"{a}{b}" for a in ("Al", "be", "ÉÉ", "ça", "日本", "x") for b in ("pha", "TA", "é", "", "😀", "long" * 9)]
    rows = [(None, None, None), ("", "", ""), ("", "a", "1 2 3"), ("xx", None, "onlyonce"), ("xx", "s", None), ("nul\0l", "s\0", "alpha alpha"), ("en", "big", " ".join(g.choices(words, k=30_000)))]
    for i in range(400):
        lang = g.choice(("en", "en", "fr", "ÉN"))
        source = "hot" if i % 3 == 0 else f"s{g.randrange(9)}" if i % 5 else g.choice(("日", "😀", "Z", "z", ""))
        rows.append((lang, source, "".join(w + g.choice(" 1.\t\n_\0") for w in g.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=g.randint(0, 30)))))
    return rows + rows[20:40]


@pytest.mark.parametrize("tile", [256, 3])
def test_divergence(spark, talk, tile, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", tile)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in talk], "lang string, source string, text string, value long, part string, item string")
    got = sorted(tuple(r) for r in divergence.audit(docs, least=30, top=5).collect())
    want = audit(talk, 30, 5)
    assert got == want and {r[2] for r in want} == {"pair", "term"}


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).count() == 0
    one = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(one).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_tries(monkeypatch):
    """Edges split and merge as in a dictionary; a text cut in pieces counts once; leaves come in the order of bytes."""
    g = random.Random(1)
    keys = [bytes(g.choices(b"ab\xc3\xff", k=g.randint(0, 6))) for _ in range(2000)]
    tries, want = [divergence.RadixTrie(), divergence.RadixTrie()], {}
    for i, k in enumerate(keys):
        tries[i % 2].add(k, 1, ["s", "t"], [1, i])
        d, c = want.get(k, (0, {"s": 0, "t": 0}))
        want[k] = d + 1, {"s": c["s"] + 1, "t": c["t"] + i}
    tries[0].merge(tries[1])
    assert [(k, v) for k, *v in tries[0].walk()] == [(k, list(v)) for k, v in sorted(want.items())] and tries[0].leaves == len(want)
    monkeypatch.setattr(divergence, "PIECE", 64)
    text = " ".join(g.choices(("Alpha", "beta", "É" * 50, "c"), k=500))
    trie = divergence.RadixTrie()
    divergence.insert_long(trie, np.frombuffer(text.encode(), np.uint8), "en", "s")
    words = spelled(text)
    assert {k: (d, c) for k, d, c in trie.walk()} == {b"en\0" + w: (1, {"s": words.count(w)}) for w in set(words)}


def test_shares_are_exact():
    g = random.Random(2)
    rows = [(n, t, v) for v in (1, 7, 10**6) for t in (0, 12, 10**13) for n in (0, t // 3, t)]
    for n, t, v in rows + [(g.randrange(10**14), 10**14, g.randrange(1, 10**8)) for _ in range(200)]:
        assert divergence.share(np.array([n]), np.array([t]), v)[0] == 1 + 10**9 * (n + 5) // (t + 5 * v)


def linked(rows, least):
    """(n_links, component) of each row by comparing all pairs."""
    ok = [i is not None and y is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, y in rows]
    n, top = [0] * len(rows), list(range(len(rows)))
    unit = [np.array(v, float) / np.abs(v).max() if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                n[a] += 1
                n[b] += 1
                top[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i, r in enumerate(rows):
        k = find(i)
        low[k] = r[0] if low.get(k) is None else low[k] if r[0] is None else min(low[k], r[0])
    return [(r[0], n[i], low[find(i)], r[0] is not None and r[0] == low[find(i)]) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(3)
    rows = [(i, v, y) for i, (v, y) in enumerate([(None, 1), ([], 1), ([0.0] * 12, 1), ([None] * 12, 1), ([float("nan")] + [1.0] * 11, 1), ([float("inf")] * 12, 1), ([1.0] * 12, None), ([1.0] * 12, None), ([1.0, 0.0], 1), ([2.0, 0.0], 1), ([1e200] * 12, 2), ([1e-200] * 12, 2)])]
    centers = g.standard_normal((14, 12))
    for i in range(700):
        c = centers[g.integers(14)] if i % 3 else centers[0]
        rows.append((20 + i, (c * g.uniform(0.5, 2) + g.standard_normal(12) * (0.02, 0.12, 0.5)[i % 3]).tolist(), int(g.integers(3)) if i % 3 else 1))
    return rows + [(1000 + i, rows[40][1], rows[40][2]) for i in range(60)] + [(25, rows[60][1], rows[60][2]), (25, rows[61][1], rows[61][2]), (None, rows[40][1], 1)]


@pytest.mark.parametrize(("cell", "lane"), [(4096, 2048), (40, 30)])
def test_embedding_groups(spark, vectors, cell, lane, monkeypatch):
    """Every link of a brute-force comparison, with one cell and with many cells of several lanes."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "LANE", lane)
    df = spark.createDataFrame([(*r, 1, "k") for r in vectors], "vec_id long, embedding array<double>, label int, n_links long, component string")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in embedding_dedup.groups(df).collect()), key=key)
    want = sorted(linked(vectors, 0.98), key=key)
    assert max(w[1] for w in want) > 100 and got == want


def test_embedding_keep_one(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    kept = embedding_dedup.keep_one(df)
    assert kept.columns == df.columns
    want = {w[0] for w in linked(vectors, 0.98) if w[3]}
    assert {r.vec_id for r in kept.collect()} == want | {None}
    assert embedding_dedup.groups(df.limit(0)).count() == embedding_dedup.keep_one(df.limit(0)).count() == 0


def mined(rows, every, kp, kn):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, anchors = [], {}
    for i, y, v in ok:
        if i % every == 0 and (i not in anchors or (y, v) < anchors[i]):
            anchors[i] = (y, v)
    for a, (y, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, l) for i, l, w in ok if i != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == y][:kp]:
            held = [s for s in scored if s[2] != y and 30 * -p <= 100 * -s[0] <= 90 * -p][:kn]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize("block", [None, 40])
def test_hard_negatives(spark, block, monkeypatch):
    if block:
        monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
        monkeypatch.setattr(hard_negatives, "CANDIDATES", block)
        import faultline.llm.vectors as shared

        monkeypatch.setattr(shared, "CANDIDATES", block)
    g = random.Random(9)
    vec = lambda n=6: [g.choice((-0.5, 0.25, 0.125, 1.0, 0.3)) for _ in range(n)]
    odd = [None, [], [None] * 6, [float("nan")] * 6, [float("-inf")] * 6]
    rows = [(i, odd[i % 50] if i % 50 < 5 and i % 10 else vec(), g.randrange(3) if i % 11 else None) for i in range(300)]
    rows += [(i, vec(3), 1) for i in range(300, 340)] + [(10, vec(), 2), (20, vec(), 1), (20, vec(), 1), (None, vec(), 1), (30, [0.0] * 6, 1)] + rows[100:120]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, rank int")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, every=10, k_positive=5, k_negative=10).collect())
    assert got and got == sorted(mined(rows, 10, 5, 10))
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_large_components_stay_exact():
    """Products that doubles cannot hold are taken in integers."""
    import pyarrow as pa

    big = 1 << 28
    left = pa.table({"v": pa.array([[big, 1]], pa.list_(pa.int64()))})
    right = pa.table({"v": pa.array([[big, 1], [big, 2]], pa.list_(pa.int64()))})
    assert hard_negatives.products(left, right).tolist() == [[big * big + 1, big * big + 2]]


def test_kmeans_centers():
    g = np.random.default_rng(1)
    x = embedding_dedup.unit(np.concatenate([np.eye(5)[i] + g.normal(0, 0.01, (30, 5)) for i in range(5)]))
    c = embedding_dedup.spherical_kmeans(x, 8)
    assert np.allclose(np.square(c).sum(1), 1) and ((x @ c.T).max(1) > 0.99).all()


@pytest.mark.parametrize("name", ["op11_divergence", "op12_embedding_dedup", "op13_hard_negatives"])
def test_sql_and_columns(spark, talk, vectors, name, tmp_path):
    spark.createDataFrame([(i, *r) for i, r in enumerate(talk)], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = [(i, v, y) for i, v, y in vectors if not v or max(abs(x or 0) for x in v) < 1e100 and max(abs(x or 1) for x in v) > 1e-100]
    spark.createDataFrame(plain, "vec_id long, embedding array<double>, label int").select("vec_id", F.col("embedding").cast("array<float>"), "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(oracles.oracle_sql()[name]).fetchall()
    names = [x[0] for x in con.description]
    got = queries.queries()[name](spark, str(tmp_path))
    types = {"op11_divergence": "lang string, source string, part string, item string, value bigint, rank int", "op12_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean", "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"}
    assert got.dtypes == [tuple(x.split(" ")) for x in types[name].split(", ")]
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order([tuple(r[x] for x in names) for r in got.collect()]) == order(want)


def test_different_texts_of_one_id(spark):
    """A row whose id another row has loses only its own repeats, and no other row's group takes it along."""
    from faultline.llm import jaccard_join, suffix_dedup, toxicity

    g = random.Random(6)
    a, b, c = (" ".join(g.choices([f"w{i}" for i in range(500)], k=90)) for _ in range(3))
    rows = [(1, a, "p"), (2, "intro " + a, "q"), (2, b + c, "r"), (2, b + c, "s"), (None, a, "t"), (7, b, "u"), (2, None, "v")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    kept = {r.spans: r.text for r in suffix_dedup.remove(d).collect()}
    assert kept["p"] == a and kept["r"] == kept["s"] == b + c and kept["t"] == a and kept["u"] == "" and kept["v"] is None
    assert len(kept["q"]) < 10 and suffix_dedup.remove(d).columns == d.columns
    digest = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(d).collect())
    assert digest == sorted([(1, len(a), 0), (2, len(a) + 6, len(a) + 6 - len(kept["q"])), (2, len(b + c), 0), (2, len(b + c), 0), (-1, len(a), 0), (7, len(b), len(b)), (2, 0, 0)])
    some = spark.createDataFrame([(1, a, "p"), (2, a, "q"), (2, b, "r"), (2, c, "s"), (3, c + " x", "t"), (3, b + " y", "u"), (None, a, "v")], "doc_id long, text string, n string")
    out = jaccard_join.keep_one(some)
    assert sorted(r.n for r in out.collect()) == ["p", "r", "s", "v"] and out.columns == some.columns
    many = spark.createDataFrame([(1, f"fine words {i}") for i in range(50)] + [(2, "scum")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.train(many, y).shape.train_docs > 0
