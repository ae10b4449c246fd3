"""The registered queries on a small folder of awkward rows: brute-force scores for the classifiers, SQL for what has SQL, and the returned columns of all."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from faultline.llm import oracles, quality, queries, toxicity
from faultline.llm.shared import fold_of

WORDS = [f"w{i}" for i in range(200)]
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.fixture(scope="module")
def texts():
    g = random.Random(5)
    out = [None, "", " \t\n", "!", "|||", "\x01\x02", "é中😀 Ünï", "x" * 5000, " ".join(g.choices(WORDS, k=9000)) + " SCUM " + " ".join(g.choices(WORDS, k=300))]
    for i in range(150):
        w = g.choices(WORDS, k=g.randint(1, 90))
        if i % 4 == 0:
            w[g.randrange(len(w))] = g.choice(("scum", "Scum!", "(scum)"))
        out.append(" ".join(w).upper().replace(" ", "!! ") if i % 3 == 0 else " ".join(w) + ".\n" + str(g.random()))
    return out + out[12:16]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    g = random.Random(6)
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(at / f"{name}.parquet"))
    save([(i, t, None, [None, "a", "B", "b", "é"][i % 5], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    labels = [(i, int((i - 9) % 3 > 0), int((i - 9) % 4 == 0)) for i in range(9, 150)] + [(1, None, None), (2, 0, None), (99999, 1, 1)]
    save(labels, "doc_id long, quality int, toxic int", "labels")
    urls = [None, "", "no scheme", "HTTP://Sub.Example.COM/en/7/x?q", "http://example.com/en/7", "https://a.com/en/1", "ftp://b.net/de/9#f", "x://example.net/de/8/1", "://org/es/", "https://c.org/es", "https://host.test"]
    urls += [f"https://h{g.randrange(4)}.example.com/{g.choice(('en', 'de'))}/{g.randrange(9)}/{g.randrange(99)}" for _ in range(80)]
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 100000]
    save([(i, u, html[i % 5] if i % 2 else f"<html>{i % 7}</html>") for i, u in enumerate(urls)] + [(500, urls[3], None)], "page_id long, url string, html string", "pages")
    vec = lambda: [g.choice((-0.5, 0.25, 0.125, 1.0)) for _ in range(8)]
    some = [None, [None] * 8, [float("nan")] * 8, [0.0] * 8, [float("inf")] + [0.0] * 7]
    save([(i, some[i % 100] if 0 < i % 100 < 5 else vec(), 0) for i in range(400)], "vec_id long, embedding array<float>, label int", "embeddings")
    return str(at)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, folder, texts, name):
    """Names and types of each contract; one row a document or page where the contract says so."""
    got = queries.queries()[name](spark, folder)
    want = [tuple(x.split(" ")) for x in COLUMNS[name].split(", ")]
    assert got.dtypes[: len(want)] == want
    rows = got.collect()
    if name in ("op1_toxicity", "op2_jaccard_join", "op4_mixing", "op6_quality", "op10_suffix_dedup"):
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    if "held_out" in got.columns:
        mod, left = (5, 0) if name.startswith("op1") else (3, 1)
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


@pytest.mark.parametrize("name", ["op3_topk", "op4_mixing", "op5_warc", "op7_url_filter"])
def test_sql_on_awkward_rows(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(oracles.oracle_sql()[name]).fetchall()
    names = [x[0] for x in con.description]
    got = [tuple(r[x] for x in names) for r in queries.queries()[name](spark, folder).collect()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert order(got) == order(want)


def plain_statistics(text):
    """The twelve statistics of one text, byte by byte."""
    raw = (text or "").encode()
    upper, lower, bang, symbol, bar, digit, stop, line, space, wide, words, inside = *[0] * 11, False
    for b in raw:
        ch = chr(b)
        upper += "A" <= ch <= "Z"
        lower += "a" <= ch <= "z"
        bang += ch == "!"
        symbol += ch in "$%&*#@^~<>{}[]\\/=+_"
        bar += ch == "|"
        digit += "0" <= ch <= "9"
        stop += ch in ".,;:?"
        line += ch in "\n\r"
        space += ch in " \t\v\f"
        wide += b >= 128
        solid = ch not in "\n\r \t\v\f"
        words += solid and not inside
        inside = solid
    n, w, b = len(raw), max(words, 1), max(len(raw), 1)
    shares = [upper / max(upper + lower, 1), bang / w, symbol / w, bar / w, digit / b, stop / w, line / w, wide / b, space / b]
    return [math.log1p(n), math.log1p(words), math.log1p((n - space - line) / w), *map(math.sqrt, shares)]


def test_quality_against_brute_force(spark, folder, texts):
    """Scores are the normal log-density difference of class means and shrunk covariances, without any factorisation."""
    x = np.array([plain_statistics(t) for t in texts])
    known = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.quality is not None and r.doc_id < len(texts) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    rows, y = np.array([k for k, _ in known]), np.array([v for _, v in known])
    cov = [np.cov(x[rows[y == k]].T, bias=True) for k in (0, 1)]
    share = [np.mean(y == k) for k in (0, 1)]
    pooled = share[0] * cov[0] + share[1] * cov[1]
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    logp = []
    for k in (0, 1):
        own, both = cov[k] / np.outer(scale, scale), pooled / np.outer(scale, scale)
        c = 0.9 * (0.9 * own + 0.1 * both) + 0.1 * np.diag(np.diag(own)) + 0.02 * np.eye(len(scale))
        z = (x - x[rows[y == k]].mean(0)) / scale
        logp.append(math.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,ij->i", z, np.linalg.solve(c, z.T).T))
    want = 1 / (1 + np.exp(-np.clip(logp[1] - logp[0], -30, 30)))
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, folder).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-6)
    assert quality.statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).tolist() == [[0.0] * 12]


def plain_score(net, text):
    """The score of one text: every window, step by step in plain vectors, the worst one."""
    s, p = net.shape, {k: v.astype(float) for k, v in net.p.items()}
    words = [w[i : i + s.piece_chars] for w in (text or "").lower().split() for i in range(0, len(w), s.piece_chars)]

    def embed(w):
        b = f"^{w}$".encode()
        grams = [zlib.crc32(b[i : i + 3]) % s.char_buckets for i in range(len(b) - 2)]
        return np.concatenate([p["word"][net.vocab.get(w.strip(toxicity.STRIP), 0)], np.mean([p["char"][k] for k in grams], 0)])

    def run(xs, d):
        h, out, n = np.zeros(s.hidden), [], s.hidden
        for v in xs:
            a, g = v @ p[f"w{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            r, z = (1 / (1 + np.exp(-(a[i : i + n] + g[i : i + n]))) for i in (0, n))
            h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
            out.append(h)
        return out

    vectors, best, a = {w: embed(w) for w in set(words)}, -np.inf, 0
    while True:
        part = [vectors[w] for w in words[a : a + s.window]]
        logit = p["bo"][0]
        if part:
            h = np.array([np.concatenate(x) for x in zip(run(part, "f"), run(part[::-1], "b")[::-1], strict=True)])
            e = np.exp(np.tanh(h @ p["wa"]) @ p["va"])
            logit += (e / e.sum()) @ h @ p["wo"]
        best = max(best, logit)
        if a + s.window >= len(words):
            return 1 / (1 + math.exp(-min(30, max(-30, net.slope * min(20, max(-20, best)) + net.offset))))
        a += s.stride


def test_toxicity_against_brute_force(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    net = toxicity.train(docs, labels.where(fold_of(labels["doc_id"], 5) > 0))
    got = {r.doc_id: r.score for r in queries.op1_toxicity(spark, folder).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain_score(net, t) for t in texts], atol=1e-4)
    assert got[8] >= 0.5, "one toxic word after 9,000 clean ones"


def test_classifiers_with_null_and_repeated_ids(spark):
    """A null id is scored like any row, repeated rows are scored each, and labels of unknown documents teach nothing."""
    d = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, "C!! D!!"), (5, None)], "doc_id long, text string")
    y = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (77, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model, stats = quality.train(d, y)
    for rows in (quality.score(stats, model).collect(), toxicity.score(d, toxicity.train(d, y)).collect()):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 3), (False, 3), (False, 4), (False, 5), (True, 0)]
        assert len({r.score for r in rows if r.doc_id in (None, 3)}) == 1
