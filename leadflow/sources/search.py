"""Search providers: an interface, the replies of three services, and table-backed offline ones."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import RESULT

# Where the services' replies hold the rows, and the names of their fields.
REPLIES = {
    "tavily": ("results", "title", "url", "content"),
    "serper": ("organic", "title", "link", "snippet"),
    "brave": ("web.results", "title", "url", "description"),
}
KEY_VARIABLES = {"tavily": "TAVILY_API_KEY", "serper": "SERPER_API_KEY", "brave": "BRAVE_API_KEY"}


def reply_rows(replies: DataFrame, service: str) -> DataFrame:
    """``query, title, url, snippet, provider`` of JSON replies (``query, body``); missing fields are ''.

    A reply that cannot be read or has no rows gives none.
    """
    place, title, url, snippet = REPLIES[service]
    kind = f"array<struct<{title}:string,{url}:string,{snippet}:string>>"
    for name in reversed(place.split(".")):
        kind = f"struct<{name}:{kind}>"
    rows = F.from_json("body", kind)
    for name in place.split("."):
        rows = rows[name]
    item = replies.select("query", F.explode(rows).alias("r"))
    text = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(""))
    return item.select("query", text(title).alias("title"), text(url).alias("url"), text(snippet).alias("snippet"), F.lit(service).alias("provider"))


class SearchProvider(ABC):
    """Turns queries into result rows."""

    name: str
    is_mock = False
    session: SparkSession

    @abstractmethod
    def search(self, queries: DataFrame) -> DataFrame:
        """Rows of ``query, title, url, snippet, provider`` for a table of ``query``."""


class TableProvider(SearchProvider):
    """Answers from a table of earlier results, by equal query."""

    def __init__(self, results: DataFrame, name: str = "table") -> None:
        self.results, self.name, self.session = results, name, results.sparkSession

    def search(self, queries: DataFrame) -> DataFrame:
        return self.results.join(queries.select("query").distinct(), "query").select("query", "title", "url", "snippet", "provider")


class RoutedProvider(SearchProvider):
    """Labelled fixtures, picked by patterns on the query; several may fire."""

    is_mock = True

    def __init__(self, spark: SparkSession, routes: list[tuple[str, list[tuple[str, str, str]]]], name: str = "mock") -> None:
        self.session, self.routes, self.name = spark, routes, name

    def search(self, queries: DataFrame) -> DataFrame:
        rows = [(i, k, *fixture) for i, (_, fixtures) in enumerate(self.routes) for k, fixture in enumerate(fixtures)]
        fixtures = self.session.createDataFrame(rows, "route int, place int, title string, url string, snippet string")
        fired = F.array_compact(F.array(*[F.when(F.lower("query").rlike(pattern), F.lit(i)) for i, (pattern, _) in enumerate(self.routes)]))
        # The fixtures are literals of this program; their size is fixed.
        return queries.select("query", F.explode(fired).alias("route")).join(F.broadcast(fixtures), "route").select(
            "query", "title", "url", "snippet", F.lit(self.name).alias("provider"))


class CallableSource(DataSource):
    """Python data source over ``fetch(query) -> rows``; partitions bound how many calls run at once.

    Options: ``queries`` (separated by newlines), ``concurrency``. Register a subclass that sets
    ``fetch`` and ``service``.
    """

    fetch: Callable[[str], list[tuple[str, str, str]]]
    service = "custom"

    @classmethod
    def name(cls) -> str:
        return f"leadflow_{cls.service}"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return _CallableReader(type(self).fetch, self.service, self.options)


class _CallableReader(DataSourceReader):
    def __init__(self, fetch, service: str, options) -> None:
        self.fetch, self.service = fetch, service
        self.queries = [q for q in options.get("queries", "").split("\n") if q]
        self.concurrency = max(1, int(options.get("concurrency", "3")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.queries[i :: self.concurrency]) for i in range(min(self.concurrency, len(self.queries)) or 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for query in partition.value:
            for title, url, snippet in self.fetch(query):
                yield title, url, snippet, query, self.service


def chosen_service(environment: dict[str, str] | None = None) -> str:
    """The named service, else the first that has a key; none is an error, and mock never a fallback."""
    env = os.environ if environment is None else environment
    named = env.get("SEARCH_PROVIDER", "").strip().lower()
    if named in ("mock", *REPLIES):
        return named
    for service, variable in KEY_VARIABLES.items():
        if env.get(variable):
            return service
    raise ValueError("no search service: set SEARCH_PROVIDER, or the key of a service")


def required(name: str, environment: dict[str, str] | None = None) -> str:
    value = (os.environ if environment is None else environment).get(name, "").strip()
    if not value:
        raise ValueError(f"missing environment variable {name}")
    return value


def budgets(limit: int, budget: str | None = None) -> tuple[int, int]:
    """(queries that may be sent, results to gather) of a request."""
    return min(int(budget or 80), 120), min(300, max(60, limit * 10))
