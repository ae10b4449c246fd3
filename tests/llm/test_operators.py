"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ann, components, jaccard_join, mixing, packing, quality, shared, suffix_dedup, topk, toxicity, url_filter, warc
from faultline.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def texts():
    g = random.Random(3)
    base = [" ".join(g.choices(WORDS, k=g.randint(5, 120))) for _ in range(60)]
    out = [None, "", "   ", "One", "one", "a b c", "A  B\tC", "x" * 3000, " ".join(g.choices(WORDS, k=4000))]
    for b in base:
        out.append(b)
        for _ in range(g.choice((0, 0, 1, 3))):
            w = b.split()
            for _ in range(g.choice((0, 1, 2))):
                w[g.randrange(len(w))] = g.choice(WORDS)
            out.append(" ".join(w))
    for _ in range(30):  # one large group of near copies
        w = base[0].split() * 2
        w[g.randrange(len(w))] = g.choice(WORDS)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "a", "b", "b", "b"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text, k):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard(docs, texts, k, num):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(docs, jaccard_join.Jaccard(words=k, num=num)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("lane", [1024, 8])
def test_jaccard_links(spark, docs, texts, lane):
    sets = [shingles(t, 4) for t in texts]
    want = {a: sum(1 for b in range(len(sets)) if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])) for a in range(len(sets))}
    assert max(want.values()) > 20
    extra = docs.unionByName(docs.where("doc_id = 20").selectExpr("cast(null as long) as doc_id", "text"), allowMissingColumns=True)
    got = {r.doc_id: r.n_links for r in jaccard_join.groups(extra, jaccard_join.Jaccard(words=4, num=85, lane_sets=lane)).collect()}
    assert got == want | {None: None}


def test_jaccard_of_a_large_group_just_below_the_threshold(spark, monkeypatch):
    """2,000 edits of one text that mostly don't link with each other: right components, and candidates far fewer than pairs."""
    g = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    base = g.choices(words, k=130)
    texts = []
    for _ in range(2000):
        w = base[:]
        for p in g.sample(range(len(w)), g.choice((3, 4, 5))):
            w[p] = g.choice(words)
        texts.append(" ".join(w))
    names: dict = {}
    sets = [[names.setdefault(x, len(names)) for x in shingles(t, 4)] for t in texts]
    m = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, s] = 1
    n, both = m.sum(1), m @ m.T
    link = 100 * both >= 85 * (n[:, None] + n - both)
    label = np.arange(len(sets))
    while (new := np.where(link, label, len(sets)).min(1)).tolist() != label.tolist():
        label = new
    held, whole = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda p, d, c: held.append(p.count()) or whole(p, d, c))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, classes = jaccard_join._placed(d, jaccard_join.Jaccard(words=4, num=85))
    got = {r.rep: r.component_id for r in classes.collect()}
    assert got == dict(enumerate(label.tolist()))
    assert sum(held) < len(texts) ** 2 / 2 / 20


def removed(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(docs).collect()}
    assert got == dict(enumerate(removed(texts, 100)))


def test_suffix_dedup_long_text_and_repeated_rows(spark):
    g = random.Random(5)
    long = "".join(g.choices("abcdefgh ", k=200_000))
    rows = [(0, long[:5000] + "é" * 300), (1, long), (1, long), (None, long)]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = removed([rows[0][1], long], 100)
    assert sorted((r.doc_id, r.n_removed) for r in got if r.doc_id is not None) == [(0, want[0][1]), (1, want[1][1]), (1, want[1][1])]
    assert [r.n_removed for r in got if r.doc_id is None] == [0]


@pytest.mark.parametrize("heavy", [2, 4000])
def test_one_trigger_in_all_texts(spark, monkeypatch, heavy):
    """A short passage between different neighbours: its triggers have as many phrases as there are texts."""
    g = random.Random(9)
    core = "".join(g.choices("abcdefgh ", k=90))
    texts = ["".join(g.choices("xyzé ", k=g.randint(5, 60))) + core[: g.choice((70, 90))] + "".join(g.choices("pq", k=2)) + "".join(g.choices("rst ", k=60)) for _ in range(800)]
    texts += [texts[3] + texts[3], texts[5][20:], None, "", core * 3]
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(d).collect()} == dict(enumerate(removed(texts, 100)))


def test_suffix_dedup_of_a_text_above_four_megabytes(spark):
    g = np.random.default_rng(7)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz      ", np.uint8)
    raw = letters[g.integers(0, 32, 4_700_000)].tobytes().decode()
    seam = 4_194_303
    long = raw[:seam] + raw[1000:1500] + raw[seam:] + raw[seam - 150 : seam + 150]
    rows = [(1, long), (2, raw[seam - 400 : seam])]
    got = {r.doc_id: (r.n_bytes, r.n_spans, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, spans, gone = got[1]
    assert n == len(long) and spans == 2 and 500 + 150 + 150 <= gone <= 500 + 150 + 150 + 20
    assert got[2] == (400, 1, 400)


def test_columns_that_clash(spark):
    text = "word " * 60
    d = spark.createDataFrame([(1, text, 1, "a", "b"), (2, "x" + text, 2, "c", "d"), (None, text, 3, "e", None)], "doc_id long, text string, _spans int, spans string, doc string")
    got = {r.spans: r for r in suffix_dedup.remove(d).collect()}
    assert suffix_dedup.remove(d).columns == d.columns and got["e"].text == text and len(got["c"].text) < 101 and (got["c"]._spans, got["c"].doc) == (2, "d")


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    at, seqs = dict.fromkeys(range(len(ids)), 0), {}
    for r in sorted(packing.pack(docs, tokenizer_path(), window=512, quantum=32).collect(), key=lambda r: (r.doc_id, r.start)):
        x = ids[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(x) and r.length > 0
        assert zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in enumerate(ids)}
    for k, v in seqs.items():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))]
        assert sum(n for _, n in v) == 512 or k == max(seqs)


def test_ids_of_another_vocabulary(docs, texts):
    """A file that finds its words otherwise goes through its own library."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in packing.tokenize(docs, path, end_id=50256).collect()}
    assert got == {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 50256], "<u4").tobytes() for i, t in enumerate(texts)}


@pytest.mark.parametrize("weights", [None, [5, 1, 1, 1, 2, 1, 1, 3, 1, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_every_window_has_the_target_shares(weights):
    """20 queues, more than a window of 256 tokens has quanta of 16: each window is within a quantum of each target until a queue runs dry."""
    g = np.random.default_rng(3)
    totals, window, q = np.append(g.integers(20_000, 60_000, 19), 37 if weights is None else 30_000), 256, 16
    s = packing.Schedule(totals, None if weights is None else np.array(weights, float), window, q)
    got, at, total = np.zeros((int(totals.sum()) // window + 1, 20), np.int64), [], 0
    for k, n in enumerate(totals):
        cuts = np.unique(np.append(g.integers(0, n, 200), 0))
        doc, lo, length, place = packing.cut(s, np.full(len(cuts), k), cuts, np.diff(np.append(cuts, n)))
        assert (length > 0).all() and length.sum() == n
        order = np.lexsort((lo, doc))
        assert (np.concatenate([cuts[doc[order]] + lo[order], [n]])[1:] == (cuts[doc] + lo + length)[order]).all()
        assert (place // window == (place + length - 1) // window).all()
        np.add.at(got, (place // window, k), length)
        at += list(zip(place.tolist(), length.tolist(), strict=True))
    for p, n in sorted(at):  # gapless
        assert p == total
        total += n
    share = totals / totals.sum() if weights is None else np.array(weights) / sum(weights)
    main = s.phases[1][2] if len(s.phases) > 1 else s.end
    assert main > (0.9 if weights is None else 0.1) * len(got)
    assert np.abs(got[:main] - share * window).max() <= q + 1


def test_mixing(docs, texts):
    got = mixing.copies(docs).collect()
    assert len(got) == len(texts)
    size = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    assert all(r.size == size[r.doc_id] and 0 <= r.copies <= 2 for r in got)
    for s in (None, "a", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own) + 1
    again = {r.doc_id: r.copies for r in mixing.copies(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    assert mixing.mix(docs).count() == sum(r.copies for r in got)


def test_mixing_of_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 6 if i % 7 else None, " ".join(["w"] * (i % 9)), "ab"[i % 2], i, "k", "m") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, key string, mark string")
    d = d.unionByName(d.limit(20))
    assert mixing.mix(d).columns == d.columns
    got, times = mixing.mix(d).collect(), mixing.copies(d).agg(F.sum("copies")).first()[0]
    assert len(got) == times and {tuple(r) for r in got} <= set(rows)
    held = {r.doc_id: r.n for r in mixing.copies(d).groupBy("doc_id").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    words: dict = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in held.items() if v} == {k: v for k, v in words.items() if v}


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "ü" * 50_000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read(warc.write(warc.plan(pages)), bodies=True).collect()}
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    raw = ("ü" * 50_000).encode()
    assert got[5].payload_bytes == len(raw) and got[5].payload == raw and got[5].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert got[1].payload_bytes == 4 and not got[1].payload


def test_url_filter(spark):
    rows = [(1, "http://x.example.com/en/7a?q"), (2, "HTTP://Example.COM/en/8"), (3, None), (4, "nothing"), (5, "a://b.org#f"), (6, "http://notcom/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("x.example.com", "/en/7a", "example.com/en/7", "allow")
    assert got[2] == ("example.com", "/en/8", "com/en/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][:3] == ("b.org", "", None) and got[6][2] is None
    bad = spark.createDataFrame([(i, f"http://h/spam/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "page_id long, bad int")
    assert {r.verdict for r in url_filter.judge(bad, rules=(), labels=labels).collect()} == {"block"}


def test_url_rules_have_the_words_of_the_contract(spark):
    """Each rule's own word, on its host, a subdomain and where a longer rule decides."""
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.host + r.path: "block" if r.block else "allow" for r in url_filter.RULES} == words
    rows = [("a.com", "/en/1", "com/en/"), ("x.example.com", "/en/71", "example.com/en/7"), ("b.net", "/de/9", "net/de/"), ("example.net", "/de/7", "net/de/"), ("example.net", "/de/8", "example.net/de/8"), ("y.example.net", "/de/80/z", "example.net/de/8"), ("c.org", "/es/", "org/es/")]
    pages = spark.createDataFrame([(i, f"https://{h}{p}") for i, (h, p, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {i: (rule, words[rule]) for i, (_, _, rule) in enumerate(rows)}


def tree_verdicts(pages, depth=8):
    """The template tree by brute force: page -> (template, purity), labels from the rules."""
    split = {}
    for i, url in pages:
        host, path = url_of(url)
        segs = [x for x in path.split("/") if x]
        split[i] = (host, segs if len(segs) <= depth else [*segs[: depth - 1], "/".join(segs[depth - 1 :])], ruled(host, path))
    at = {i: [""] for i in split}
    for k in range(depth):
        kids: dict = {}
        for i, (host, segs, _) in split.items():
            if len(segs) > k:
                kids.setdefault((host, at[i][-1]), []).append(segs[k])
        for i, (host, segs, _) in split.items():
            if len(segs) > k:
                every = kids[host, at[i][-1]]
                keep = len(set(every)) <= 20 or every.count(segs[k]) * 20 >= len(every)
                at[i] = [*at[i], at[i][-1] + "/" + (segs[k] if keep else "*")]
    held: dict = {}
    for i, (host, _, r) in split.items():
        for k, t in enumerate(at[i]):
            n = held.setdefault((host, k, t), [at[i][k - 1] if k else None, 0, 0])
            n[1] += r == "block"
            n[2] += r is not None
    purity = {}
    for (host, k, t), (parent, b, n) in sorted(held.items(), key=lambda x: x[0][1]):
        if k and n >= 5:
            pool = []
            for (h2, k2, _), (p2, b2, n2) in held.items():
                if (h2, k2, p2) == (host, k, parent) and n2 >= 5:
                    p = (b + b2 + 1) / (n + n2 + 2)
                    if (b * n2 - b2 * n) ** 2 < 3.84 * p * (1 - p) * n * n2 * (n + n2):
                        pool.append((b2, n2))
            b, n = map(sum, zip(*pool, strict=True))
        purity[host, k, t] = (b + 4 * (purity[host, k - 1, parent] if k else 0.25)) / (n + 4)
    return {i: (at[i][-1], purity[split[i][0], len(at[i]) - 1, at[i][-1]]) for i in split}


def url_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return rest[:cut].lower(), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return None if not fit else "block" if max(fit, key=lambda r: len(r.host) + len(r.path)).block else "allow"


def test_url_tree(spark, tmp_path):
    """Against the tree by brute force and against the query's SQL: deep paths, ties, repeated rows, hosts without labels."""
    import duckdb

    from faultline.llm import oracles, queries

    g = random.Random(6)
    hosts = [f"{a}.example.{b}" for a in ("a", "b.c", "d") for b in ("com", "net", "org")] + ["other.de", "example.com"]
    pages = []
    for i in range(3000):
        segs = [g.choice(["en", "de", "es", "fr"])] + [g.choice(["x", "y", str(g.randrange(300))]) for _ in range(g.choice((0, 1, 1, 2, 3, 12)))]
        pages.append((i, f"http://{g.choice(hosts)}/{'/'.join(segs)}" + g.choice(("", "/", "?a=/b", "#c"))))
    pages += [(5000, None), (5001, "no"), (5002, "a://other.de"), (5003, pages[0][1]), (5004, pages[0][1])]
    d = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in url_filter.judge(d).collect()}
    want = tree_verdicts(pages)
    assert {i: (r.template, round(r.purity, 9)) for i, r in got.items()} == {i: (t, round(p, 9)) for i, (t, p) in want.items()}
    free = [r for r in got.values() if r.rule is None]
    assert {r.verdict for r in free} == {"allow", "block"}
    assert all(r.verdict == ("block" if want[r.page_id][1] >= 0.5 else "allow") for r in free)
    d.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    cols = "page_id, host, path, rule, verdict"
    sql = sorted(con.execute(f"select {cols} from ({oracles.OP7})").fetchall(), key=str)
    assert sql == sorted((tuple(r) for r in queries.op7_url_filter(spark, str(tmp_path)).select(*cols.split(", ")).collect()), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(1)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(g.standard_normal((600, 24)).astype(np.float32))]
    rows[7] = (7, rows[100][1])
    odd = [(600, None), (605, [0.0] * 24), (610, [1.0, None] * 12), (620, [float("nan")] * 24), (630, [float("inf")] * 24)]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


def test_topk(vectors):
    rows, df = vectors
    z = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows} | {605: np.zeros(24, np.int64)}
    want = set()
    for q in (i for i in z if i % 100 == 0):
        best = sorted((-int(z[q] @ z[j]), j) for j in z if j != q)[:10]
        want |= {(q, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in topk.search(df, every=100, k=10).collect()} == want


def test_ann(vectors):
    rows, df = vectors
    x = {i: np.array(v, np.float64) for i, v in rows}
    got = ann.search(df, every=20, k=20).collect()
    hit = total = 0
    for q in (i for i in x if i % 20 == 0):
        best = {j for _, j in sorted((-(x[q] @ x[j]), j) for j in x if j != q)[:20]}
        own = [r for r in got if r.query_id == q]
        assert len(own) == 20 and all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in own)
        hit, total = hit + len(best & {r.vec_id for r in own}), total + 20
    assert hit / total >= 0.9


def test_classifiers(spark):
    g = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        w = g.choices(WORDS, k=60)
        tox, bad = i % 4 == 0, i % 3 == 0
        if tox:
            w[g.randrange(60)] = w[g.randrange(60)] = "scum"
        rows.append((i, " ".join(w).upper().replace(" ", "!! ") if bad else " ".join(w)))
        labels.append((i, int(not bad), int(tox)))
    d = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = lambda r: r.doc_id < 300 and r.doc_id % 5 == 0
    model, stats = quality.train(d, y.where("doc_id % 5 <> 0"))
    got = quality.score(stats, model).collect()
    assert len(got) == 302 and all(r.predicted == labels[r.doc_id][1] for r in got if held(r))
    net = toxicity.train(d, y.where("doc_id % 5 <> 0"))
    got = toxicity.score(d, net).collect()
    assert len(got) == 302 and np.mean([r.predicted == labels[r.doc_id][2] for r in got if held(r)]) >= 0.9
    assert toxicity.score(d, toxicity.train(d, y.limit(0))).where("score <> 0").count() == 0


def test_network_gradient():
    s = toxicity.Shape(word_dim=3, char_dim=2, char_buckets=16, hidden=3, window=5, stride=3)
    net = toxicity.Network.new(s, {"a": 1, "b": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, ids, mask, _ = net.lay_out([["a", "b", "cc", "a", "dd", "b", "a"], ["b"]])
    x, info = net.inputs(words)
    x = x.astype(np.float64)
    weight = np.arange(1, ids.shape[1] + 1) / 3.0
    _, kept = net.forward(x, ids, mask, True)
    grads = net.backward(weight, x, ids, mask, kept, info)
    for name in ("uf", "wb", "wa", "va", "wo"):
        flat = net.p[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 4)):
            old, out = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                out.append(float(net.forward(x, ids, mask)[0] @ weight))
            flat[i] = old
            assert abs((out[0] - out[1]) / 2e-5 - grads[name].reshape(-1)[i]) < 1e-4


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 50), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 51: 50, 52: 50}


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string, score double, size long, key string, spans string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(*reversed(quality.train(d, y))).count() == 0
    for out in (jaccard_join.groups(d), suffix_dedup.dedup(d), mixing.copies(d), packing.pack(d, tokenizer_path()), toxicity.score(d, toxicity.train(d, y)), suffix_dedup.remove(d), jaccard_join.keep_one(d)):
        assert out.count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>, score double")
    assert topk.search(v, 10, 5).count() == ann.search(v, 10, 5).count() == 0
    p = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert warc.read(warc.write(warc.plan(p))).count() == url_filter.judge(p).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before = shared.stored(stage(spark, before, str(tmp_path)), "test")
        assert before.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("length") <= 0).count() == 0


def test_ids_are_the_librarys():
    t, g = packing.tokenizer(*packing.vocabulary(tokenizer_path())), random.Random(11)
    assert isinstance(t, packing.WordTokenizer)
    bits = ["'", "'s", "'ll", "'re", "''", "s", "don", "THE", " ", "\n", "\t", "1", "23", "é", "é", "Σ", "ΑΣ", "ß", "İ", "!", "...", "​", "　", "中", "😀", "\0", "<|endoftext|>", "\x85", "\x1c", "٣", "Ⅷ", "͸", "\U000323af", "हिन्दी", "한글", "x" * 300]
    known = [c for a, b in packing._KNOWN for c in range(a, b + 1) if c < 0x3100]
    texts = ["".join(g.choices(bits, k=g.randint(0, 30))) for _ in range(3000)] + ["".join(chr(g.choice(known)) for _ in range(g.randint(0, 40))) for _ in range(3000)]
    for i in range(0, len(texts), 41):
        part = texts[i : i + 41]
        assert [x.tolist() for x in t.ids(part)] == [e.ids for e in t.own.encode_batch(part, add_special_tokens=False)]
    assert [len(x) for x in t.ids([None, "", " \n"])] == [0, 0, 0]


def test_tokens_are_those_that_merges_reach(tmp_path):
    """A token that its own bytes do not lead to by the listed pairs is left out."""
    import json

    model = {"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]], "end_of_word_suffix": "</w>"}
    model["vocab"] |= {c + e: 0 for c in packing.byte_signs() for e in ("", "</w>") if c + e not in model["vocab"]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": model}))
    made = {b for b, _ in packing.merge_table(str(path))[0]}
    assert {b"bc", b"ab"} <= made and b"abc" not in made


def test_passages_lie_whole_in_a_window():
    s = toxicity.Shape()
    assert s.stride <= s.window // 2
    for n in range(1, 200):
        starts = toxicity.windows(n, s.window, s.stride)
        size = min(n, s.window - s.stride + 1)
        assert all(any(w <= a and a + size <= w + s.window for w in starts) for a in range(n - size + 1))


def test_ann_answers_every_length_and_repeated_rows(spark):
    g = np.random.default_rng(4)
    rows = [(i, g.standard_normal(12).tolist()) for i in range(300)] + [(i, g.standard_normal(5).tolist()) for i in range(300, 360)] + [(400, [1.0]), (None, [1.0] * 12), (40, [2.0] * 12), (7, [0.5] * 12), (7, [0.5] * 12)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")), 20, 10, confidence=99.0).collect()
    held: dict = {}
    for r in sorted(got, key=lambda r: r.rank):
        held.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q, v in rows[300:360:20]:
        want = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i is not None and i != q and len(w) == 5))[:10]
        assert held[q] == [(i, round(-s, 9)) for s, i in want]
    assert sorted(held) == [*range(0, 360, 20)] and all(len(x) == 10 for x in held.values())
    assert 40 not in [i for i, _ in held[40]]


def test_ann_tops_up(spark):
    """One probed list of few vectors: the other lists fill the answer."""
    g = np.random.default_rng(2)
    x = np.concatenate([g.normal(0, 0.05, (400, 8)) + np.eye(8)[0], g.normal(0, 0.05, (5, 8)) - np.eye(8)[0]])
    v = spark.createDataFrame([(i + 1, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    near = ann.fit(ann.valid(v, zero=False), k=20)
    index = ann.Index(near.norm2, near.rotation, near.rotated(np.array([np.eye(8)[0], -np.eye(8)[0]])), 1, near.sample, near.sample_ids)
    got = ann.search(v, 405, 20, index=index).collect()
    f = x.astype(np.float32).astype(np.float64)
    s = f[:404] @ f[404]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == (np.argsort(-s)[:20] + 1).tolist()
