"""News responses as a Spark data source: pages of an HTTP search or of stored files, one partition each, with retries.

``register(spark)``, then ``spark.read.format("news_responses")`` with the options

- ``url``: address of the search (http or https), or a folder of stored responses named ``<query>-<page>.json``;
- ``queries``: queries, one a line; ``limit``: articles a query (20), at most 100 of them a page;
- ``key``: the service's key. An HTTP search without one isn't asked;
- ``retries`` (2), ``pause`` (seconds, 1.0, times the attempt) and ``timeout`` (15);
- ``param.<name>``: further parameters, such as language, from, to, sortBy or country.

Every page is a row: (query, page, status, code, message, attempts, articles). A page that fails is retried after lost
connections and timeouts, and is in the end a row whose status is error, with the reason as code; the other pages stand. ``files.articles`` takes
the rows as they are. A filter on query or page for equal values leaves the other pages unasked.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from faultline.sources.files import ARTICLE

#: Articles to a page, as the service allows.
PAGE = 100
#: What a refusal of the service is called.
REFUSED = {401: ("apiKeyInvalid", "the key is invalid"), 429: ("rateLimited", "the rate limit is reached")}
FIELDS = ("title", "url", "author", "description", "content", "publishedAt")


@dataclass
class Page(InputPartition):
    query: str
    page: int
    size: int


def _article(a: dict | None) -> dict | None:
    """One article with just the fields of ``ARTICLE``; what isn't text becomes text."""
    if not isinstance(a, dict):
        return None
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    source = a.get("source")
    return {"title": text(a.get("title")), "url": text(a.get("url")), "source": {"name": text(source.get("name"))} if isinstance(source, dict) else None} | {k: text(a.get(k)) for k in FIELDS[2:]}


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of query and page choose the pages; every other filter is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("query",), ("page",)):
                held = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if held is None else held & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        limit = int(self.options.get("limit", "20"))
        out = []
        for query in dict.fromkeys(q.strip() for q in self.options.get("queries", "").split("\n") if q.strip()):
            for i in range(-(-limit // PAGE)):
                if all(v in self.wanted.get(k, {v}) for k, v in (("query", query), ("page", i + 1))):
                    out.append(Page(query, i + 1, min(PAGE, limit - i * PAGE)))
        return out or [Page("", 0, 0)]

    def _get(self, p: Page) -> dict:
        url = self.options["url"]
        if not url.startswith(("http://", "https://")):
            slug = "".join(c if c.isalnum() else "_" for c in p.query.lower())
            return json.loads((Path(url.removeprefix("file://")) / f"{slug}-{p.page}.json").read_text())
        more = {k.removeprefix("param."): v for k, v in self.options.items() if k.startswith("param.")}
        asked = urllib.parse.urlencode(more | {"q": p.query, "page": p.page, "pageSize": min(PAGE, int(self.options.get("limit", "20")))})
        request = urllib.request.Request(f"{url}?{asked}", headers={"X-Api-Key": self.options["key"]})
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "15"))) as r:
            return json.load(r)

    def read(self, partition: Page) -> Iterator[tuple]:
        p = partition
        if p.size <= 0:
            return
        error = lambda code, message, n: (p.query, p.page, "error", code, str(message)[:500], n, [])
        if self.options["url"].startswith("http") and not self.options.get("key", "").strip():
            yield error("apiKeyMissing", "no key is given", 0)
            return
        for attempt in range(1, int(self.options.get("retries", "2")) + 2):
            try:
                got = self._get(p)
            except urllib.error.HTTPError as e:
                yield error(*REFUSED.get(e.code, (f"http{e.code}", e.reason)), attempt)
                return
            except FileNotFoundError as e:
                yield error("notFound", e, attempt)
                return
            except (OSError, TimeoutError) as e:  # lost connections and timeouts may pass
                last = error("unreachable", e, attempt)
                if attempt <= int(self.options.get("retries", "2")):
                    time.sleep(float(self.options.get("pause", "1.0")) * attempt)
                continue
            except ValueError as e:
                yield error("unreadable", e, attempt)
                return
            if not isinstance(got, dict) or got.get("status") != "ok":
                got = got if isinstance(got, dict) else {}
                yield error(got.get("code") or "refused", got.get("message") or "the request failed", attempt)
                return
            found = got.get("articles")
            yield (p.query, p.page, "ok", None, None, attempt, [_article(a) for a in (found if isinstance(found, list) else [])[: p.size]])
            return
        yield last


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "news_responses"

    def schema(self) -> str:
        return f"query string, page int, status string, code string, message string, attempts int, articles array<{ARTICLE}>"

    def reader(self, schema) -> Reader:
        if not self.options.get("url"):
            raise ValueError("news_responses needs the option url")
        return Reader({k: self.options[k] for k in self.options})


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
