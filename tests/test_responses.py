"""The data source of news responses against a server on this machine and against stored files."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from faultline.sources import files, responses


@pytest.fixture(scope="module")
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked[q["q"], int(q["page"])] += 1
            n = asked[q["q"], int(q["page"])]
            if q["q"] == "flaky" and n == 1:
                self.connection.close()  # the first attempt gets no answer
                return
            code = {"limited": 429, "secret": 401, "broken": 500}.get(q["q"], 200)
            if self.headers["X-Api-Key"] != "k":
                code = 401
            body = {"status": "ok", "articles": [{"title": f"{q['q']} {q['page']} {i}", "url": f"http://a/{q['q']}/{q['page']}/{i}", "source": {"name": "S", "id": 1}, "publishedAt": "2024-01-02T03:04:05Z", "content": q.get("language"), "more": []} for i in range(int(q["pageSize"]))]}
            if q["q"] == "odd":
                body = {"status": "error", "code": "parametersMissing", "message": "no"}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"<html>" if q["q"] == "page" else json.dumps(body).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/everything", asked
    s.shutdown()


def load(spark, url, queries, **options):
    responses.register(spark)
    return spark.read.format("news_responses").options(url=url, queries="\n".join(queries), pause="0.01", **options).load()


def test_pages_retries_and_errors(spark, server):
    url, asked = server
    df = load(spark, url, ["ports", "flaky", "limited", "secret", "broken", "odd", "page", "ports"], key="k", limit="130", **{"param.language": "en"})
    got = {(r.query, r.page): r for r in df.collect()}
    assert len(got) == 14
    assert [(len(got["ports", p].articles), got["ports", p].status, got["ports", p].attempts) for p in (1, 2)] == [(100, "ok", 1), (30, "ok", 1)]
    assert (got["flaky", 1].status, got["flaky", 1].attempts, len(got["flaky", 1].articles)) == ("ok", 2, 100)
    assert {q: got[q, 1].code for q in ("limited", "secret", "broken", "odd", "page")} == {"limited": "rateLimited", "secret": "apiKeyInvalid", "broken": "http500", "odd": "parametersMissing", "page": "unreadable"}
    assert asked["limited", 1] == 1, "a refusal is not asked again"
    assert got["ports", 1].articles[0].content == "en"


def test_filters_choose_pages(spark, server):
    url, asked = server
    df = load(spark, url, ["one", "two", "three"], key="k", limit="250")
    assert df.where(F.col("query").isin("one", "two") & (F.col("page") == 2)).count() == 2
    assert {k: n for k, n in asked.items() if k[0] in ("one", "two", "three")} == {("one", 2): 1, ("two", 2): 1}
    assert df.where("query = 'four'").count() == 0


def test_no_key_and_nobody_there(spark):
    (r,) = load(spark, "http://127.0.0.1:9/x", ["a"]).collect()
    assert (r.status, r.code, r.attempts) == ("error", "apiKeyMissing", 0)
    (r,) = load(spark, "http://127.0.0.1:9/x", ["a"], key="k", retries="1").collect()
    assert (r.status, r.code, r.attempts, r.articles) == ("error", "unreachable", 2, [])
    with pytest.raises(Exception, match="needs the option url"):
        spark.read.format("news_responses").load().collect()
    assert load(spark, "http://127.0.0.1:9/x", [" "], key="k").count() == 0


def test_stored_files_read_as_articles(spark, tmp_path):
    """The same articles as the reader of stored responses gives."""
    page = {"status": "ok", "query": "port strike", "articles": [{"title": "", "url": "u"}, {"title": " t ", "url": "u", "publishedAt": "2024-01-02T03:04:05Z", "description": " d ", "content": ""}, None, {"title": "n", "url": "v", "source": {"name": "N"}, "author": 5}]}
    (tmp_path / "port_strike-1.json").write_text(json.dumps(page))
    df = load(spark, str(tmp_path), ["port strike", "absent"])
    stamp = F.lit("2025-01-01T00:00:00")
    want = files.articles(files.response_files(spark, str(tmp_path / "port_strike-1.json")), stamp)
    assert sorted(files.articles(df, stamp).collect()) == sorted(want.collect()) and want.count() == 2
    assert [tuple(r) for r in df.where("status = 'error'").select("query", "code").collect()] == [("absent", "notFound")]
