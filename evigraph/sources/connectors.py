"""Rows of search services to documents, as projections; and a data source that asks for them.

Each ``parse_*`` takes raw rows in the schema of the same name and returns the columns of ``DOCUMENT``."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evigraph.functions import constants as C
from evigraph.functions import text as T
from evigraph.sources import schemas

DOCUMENT = (
    "source_id", "source_family", "source_url", "title", "abstract", "authors", "publication_date", "source_tier", "doi", "openalex_id", "s2_id", "is_peer_reviewed", "cited_by_count", "concepts", "embedding",
)


def _document(rows: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"authors": "array<string>", "concepts": "array<string>", "embedding": "array<float>", "source_tier": "int", "is_peer_reviewed": "boolean", "cited_by_count": "bigint"}
    full = [columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in DOCUMENT]
    return rows.select(*full).where(F.coalesce("title", F.lit("")) != "")


def parse_openalex(rows: DataFrame) -> DataFrame:
    """Works: the abstract is rebuilt from its inverted index; articles in journals and proceedings are peer-reviewed."""
    journal = F.coalesce(F.col("type").isin(*C.REVIEWED_TYPES), F.lit(False))
    bare = F.regexp_replace("id", "^https://openalex.org/", "")
    doi = F.coalesce(F.col("doi"), F.lit(""))
    url = F.coalesce(T.missing_as_null(F.when(doi == "", F.lit("")).when(doi.startswith("http"), doi).otherwise(F.concat(F.lit("https://doi.org/"), doi))), F.col("id"))
    return _document(
        rows,
        source_id=bare, source_family=F.lit("scholarly"), source_url=url, title=F.col("title"), abstract=F.coalesce(T.rebuilt_abstract(F.col("abstract_inverted_index")), F.lit("")),
        authors=F.slice(F.transform("authorships", lambda a: a["author"]["display_name"]), 1, 10), publication_date=F.col("publication_date"), source_tier=F.when(journal, 1).otherwise(2),
        openalex_id=bare, is_peer_reviewed=journal, cited_by_count=F.coalesce("cited_by_count", F.lit(0)), concepts=F.slice(F.transform("concepts", lambda c: c["display_name"]), 1, 5),
    )


def parse_semantic_scholar(rows: DataFrame) -> DataFrame:
    doi = F.try_element_at("externalIds", F.lit("DOI"))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), T.missing_as_null(doi)), T.missing_as_null(F.col("url")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("paperId")))
    abstract = F.coalesce(T.missing_as_null(F.col("abstract")), F.col("tldr.text"), F.lit(""))
    return _document(
        rows,
        source_id=F.col("paperId"), source_family=F.lit("scholarly"), source_url=url, title=F.col("title"), abstract=abstract, authors=F.slice(F.transform("authors", lambda a: a["name"]), 1, 10),
        publication_date=F.coalesce(T.missing_as_null(F.col("publicationDate")), F.col("year").cast("string")), source_tier=F.lit(2), doi=doi, s2_id=F.col("paperId"),
        cited_by_count=F.coalesce("citationCount", F.lit(0)), embedding=F.col("embedding.vector"),
    )


def parse_arxiv(entries: DataFrame) -> DataFrame:
    """Atom entries: the id follows ``/abs/``; the primary category comes first."""
    terms = F.array_union(F.array_compact(F.array(F.col("primary_category._term"))), F.coalesce(F.transform("category", lambda c: c["_term"]), F.array()))
    flat = lambda x: F.regexp_replace(T.strip(x), r"\s+", " ")
    return _document(
        entries.where(F.col("title") != "Error"),
        source_id=F.regexp_extract("id", "/abs/(.*)$", 1), source_family=F.lit("scholarly"), source_url=F.col("id"), title=flat(F.col("title")), abstract=flat(F.col("summary")),
        authors=F.slice(F.transform("author", lambda a: a["name"]), 1, 10), publication_date=F.substring("published", 1, 10), source_tier=F.lit(2), concepts=terms,
    )


def parse_github(rows: DataFrame) -> DataFrame:
    return _document(
        rows,
        source_id=F.col("full_name"), source_family=F.lit("code"), source_url=F.col("html_url"), title=F.col("full_name"), abstract=F.coalesce("description", F.lit("")),
        authors=F.array("owner.login"), publication_date=F.substring("pushed_at", 1, 10), source_tier=F.lit(2), cited_by_count=F.coalesce("stargazers_count", F.lit(0)), concepts=F.col("topics"),
    )


def parse_web(rows: DataFrame) -> DataFrame:
    return _document(
        rows,
        source_id=F.col("url"), source_family=F.lit("web"), source_url=F.col("url"), title=F.col("title"), abstract=F.substring(F.coalesce("content", F.lit("")), 1, 2000),
        publication_date=F.col("published_date"), source_tier=F.lit(3),
    )


def pages_to_web(pages: DataFrame) -> DataFrame:
    """Raw pages in the schema of web search results: title element, and text without scripts and tags."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " "), r"\s+", " ")
    return pages.select("url", title.alias("title"), F.trim(plain).alias("content"), F.lit(None).cast("string").alias("published_date"), F.lit(None).cast("double").alias("score"))


# What services are asked

# Where services answer, most rows of a page of a search and of an expansion, ids of a batch.
BASE = {
    "openalex": "https://api.openalex.org", "semantic_scholar": "https://api.semanticscholar.org/graph/v1", "arxiv": "https://export.arxiv.org/api", "github": "https://api.github.com", "web_search": "https://api.tavily.com",
}
PAGE = {"openalex": 50, "semantic_scholar": 100, "arxiv": 50, "github": 30, "web_search": 20}
MOST_IDS = 500
# Fields asked of papers, and of those that cite one.
FIELDS = "title,abstract,year,citationCount,influentialCitationCount,tldr,authors,externalIds,publicationDate,embedding.specter_v2"
CITING_FIELDS = "title,abstract,year,citationCount,authors,externalIds,publicationDate"
# Seconds between requests to one service; first and longest wait before it is asked again.
PAUSES = {"arxiv": 3.0}
WAITS = {"openalex": (2, 10), "semantic_scholar": (3, 15), "arxiv": (5, 30), "github": (2, 10), "web_search": (2, 10)}


@dataclass(frozen=True)
class Request:
    """One question to a service: kind is search, get, expand or batch; value a query, an id, or ids parted by commas."""

    connector: str
    kind: str
    value: str
    limit: int = 20
    #: First and last year, for services that can tell.
    years: tuple[str, str] | None = None

    def parts(self, keys: dict[str, str], base: dict[str, str]) -> tuple[str, str, dict[str, str], dict | None] | None:
        """Method, url, headers and body; None where a service has no such question or its key is missing."""
        make = {"openalex": self._openalex, "semantic_scholar": self._semantic_scholar, "arxiv": self._arxiv, "github": self._github, "web_search": self._web}[self.connector]
        found = make(keys)
        if found is None:
            return None
        method, path, query, headers, body = found
        asked = urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})
        return method, f"{(BASE | base)[self.connector]}{path}{'?' if asked else ''}{asked}", {k: v for k, v in headers.items() if v}, body

    def _page(self) -> int:
        return min(self.limit, PAGE[self.connector])

    def _openalex(self, keys: dict[str, str]):
        mail = keys.get("OPENALEX_MAILTO") or keys.get("OPENALEX_EMAIL")
        headers = {"Authorization": f"Bearer {keys['OPENALEX_API_KEY']}" if keys.get("OPENALEX_API_KEY") else "", "User-Agent": f"mailto:{mail}" if mail else ""}
        concept = keys.get("OPENALEX_SEARCH_CONCEPT_ID", "").strip()
        filters = ([f"concepts.id:{concept}"] if concept else []) + ([f"publication_year:{'-'.join(self.years)}"] if self.years else [])
        if self.kind == "search":
            return "GET", "/works", {"search": self.value, "per_page": self._page(), "filter": ",".join(filters) or None}, headers, None
        if self.kind == "expand":
            return "GET", "/works", {"filter": f"cites:{self.value}", "per_page": self._page()}, headers, None
        return ("GET", f"/works/{urllib.parse.quote(self.value)}", {}, headers, None) if self.kind == "get" else None

    def _semantic_scholar(self, keys: dict[str, str]):
        headers = {"x-api-key": keys.get("SEMANTIC_SCHOLAR_API_KEY", "")}
        if self.kind == "search":
            return "GET", "/paper/search", {"query": self.value, "limit": self._page(), "fields": FIELDS, "year": "-".join(self.years) if self.years else None}, headers, None
        if self.kind == "expand":
            return "GET", f"/paper/{urllib.parse.quote(self.value)}/citations", {"fields": CITING_FIELDS, "limit": self._page()}, headers, None
        if self.kind == "batch":
            return "POST", "/paper/batch", {"fields": FIELDS}, headers, {"ids": self.value.split(",")[:MOST_IDS]}
        return "GET", f"/paper/{urllib.parse.quote(self.value)}", {"fields": FIELDS}, headers, None

    def _arxiv(self, keys: dict[str, str]):
        if self.kind == "search":
            return "GET", "/query", {"search_query": f"all:{self.value}", "start": 0, "max_results": self._page(), "sortBy": "relevance", "sortOrder": "descending"}, {}, None
        return ("GET", "/query", {"id_list": self.value, "max_results": 1}, {}, None) if self.kind == "get" else None

    def _github(self, keys: dict[str, str]):
        headers = {"Accept": "application/vnd.github+json", "Authorization": f"Bearer {keys['GITHUB_TOKEN']}" if keys.get("GITHUB_TOKEN") else ""}
        if self.kind == "search":
            return "GET", "/search/repositories", {"q": self.value, "sort": "stars", "order": "desc", "per_page": self._page()}, headers, None
        return ("GET", f"/repos/{self.value}", {}, headers, None) if self.kind == "get" else None

    def _web(self, keys: dict[str, str]):
        key = keys.get("TAVILY_API_KEY")
        if self.kind != "search" or not key:
            return None
        return "POST", "/search", {}, {}, {"api_key": key, "query": self.value, "max_results": self._page(), "include_answer": False, "search_depth": "advanced"}


def batches_of_ids(ids: list[str]) -> list[Request]:
    """Look-ups of any number of papers, ``MOST_IDS`` at a time."""
    return [Request("semantic_scholar", "batch", ",".join(ids[at : at + MOST_IDS])) for at in range(0, len(ids), MOST_IDS)]


def may_ask_again(e: Exception) -> bool:
    """Whether a failure may pass: a service that is busy or broken, or can't be reached; not one that says no."""
    return e.code == 429 or e.code >= 500 if isinstance(e, urllib.error.HTTPError) else True


def with_retry(ask: Callable[[], bytes], attempts: int = 3, wait: float = 1.0, longest: float = 30.0) -> bytes:
    """The answer, after up to ``attempts`` tries with doubling waits between them."""
    for attempt in range(attempts):
        try:
            return ask()
        except (urllib.error.URLError, TimeoutError) as e:
            if attempt + 1 == attempts or not may_ask_again(e):
                raise
            time.sleep(min(wait * 2**attempt, longest))
    raise AssertionError("no attempt was made")


class SearchPartition(InputPartition):
    def __init__(self, requests: list[Request]) -> None:
        self.requests = requests


class SearchReader(DataSourceReader):
    """One partition for each request; but all requests to a service that wants pauses are one, so that they come one by one."""

    def __init__(self, options) -> None:
        self.requests = [Request(**{**r, "years": tuple(r["years"]) if r.get("years") else None}) for r in json.loads(options["requests"])]
        self.keys, self.base = json.loads(options.get("keys", "{}")), json.loads(options.get("base", "{}"))
        self.pauses = PAUSES | json.loads(options.get("pauses", "{}"))
        self.wait = options.get("wait")

    def partitions(self) -> list[SearchPartition]:
        slow: dict[str, list[Request]] = {}
        for r in self.requests:
            if self.pauses.get(r.connector):
                slow.setdefault(r.connector, []).append(r)
        return [SearchPartition(rs) for rs in slow.values()] + [SearchPartition([r]) for r in self.requests if r.connector not in slow]

    def read(self, partition: SearchPartition) -> Iterator[tuple]:
        last = None
        for request in partition.requests:
            asked = request.parts(self.keys, self.base)
            if asked is None:
                continue
            method, url, headers, body = asked

            def ask() -> bytes:
                data = None if body is None else json.dumps(body).encode()  # noqa: B023
                sent = urllib.request.Request(url, data, headers | ({"Content-Type": "application/json"} if data else {}), method=method)  # noqa: B023
                with urllib.request.urlopen(sent, timeout=30) as answer:
                    return answer.read()

            if last is not None:
                time.sleep(max(0.0, self.pauses.get(request.connector, 0.0) - (time.monotonic() - last)))
            first, longest = WAITS[request.connector]
            try:
                found = with_retry(ask, wait=first if self.wait is None else float(self.wait), longest=longest)
            except urllib.error.HTTPError as e:
                # What isn't there is no answer.
                if request.kind == "get" and (e.code == 404 or request.connector == "github"):
                    continue
                raise
            finally:
                last = time.monotonic()
            yield (request.connector, request.kind, request.value, found.decode("utf-8", "replace"))


class SearchSource(DataSource):
    """``spark.read.format("evigraph-search")`` with options requests (JSON list of ``Request`` fields), keys, base and pauses (JSON maps)."""

    @classmethod
    def name(cls) -> str:
        return "evigraph-search"

    def schema(self) -> str:
        return "connector string, kind string, value string, body string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def ask(spark: SparkSession, requests: list[Request], keys: dict[str, str] | None = None, **options) -> DataFrame:
    """(connector, kind, value, body): the answers to some requests."""
    spark.dataSource.register(SearchSource)
    given = {"requests": json.dumps([asdict(r) for r in requests]), "keys": json.dumps(keys or {}), **{k: json.dumps(v) for k, v in options.items()}}
    return spark.read.format("evigraph-search").options(**given).load()


def documents_of(answers: DataFrame) -> DataFrame:
    """The documents that answers hold, each read as its service writes it, with their connector."""
    found = None

    def add(connector: str, kinds: tuple[str, ...], rows: Callable[[DataFrame], DataFrame], parse: Callable[[DataFrame], DataFrame]) -> None:
        nonlocal found
        part = parse(rows(answers.where((F.col("connector") == connector) & F.col("kind").isin(*kinds)))).select(F.lit(connector).alias("connector"), *DOCUMENT)
        found = part if found is None else found.unionByName(part)

    listed = lambda schema, field, inner="": lambda df: df.select(F.explode(F.from_json("body", f"{field} array<struct<{schema if not inner else f'{inner} struct<{schema}>'}>>")[field]).alias("r")).select(f"r.{inner + '.' if inner else ''}*")
    single = lambda schema: lambda df: df.select(F.from_json("body", schema).alias("r")).select("r.*")
    bare = lambda schema: lambda df: df.select(F.explode(F.from_json("body", f"array<struct<{schema}>>")).alias("r")).select("r.*")
    feed = lambda df: df.select(F.explode(F.from_xml("body", f"entry array<struct<{schemas.ATOM}>>")["entry"]).alias("r")).select("r.*")
    add("openalex", ("search", "expand"), listed(schemas.OPENALEX, "results"), parse_openalex)
    add("openalex", ("get",), single(schemas.OPENALEX), parse_openalex)
    add("semantic_scholar", ("search",), listed(schemas.SEMANTIC_SCHOLAR, "data"), parse_semantic_scholar)
    add("semantic_scholar", ("expand",), listed(schemas.SEMANTIC_SCHOLAR, "data", "citingPaper"), parse_semantic_scholar)
    add("semantic_scholar", ("batch",), bare(schemas.SEMANTIC_SCHOLAR), parse_semantic_scholar)
    add("semantic_scholar", ("get",), single(schemas.SEMANTIC_SCHOLAR), parse_semantic_scholar)
    add("arxiv", ("search", "get"), feed, parse_arxiv)
    add("github", ("search",), listed(schemas.GITHUB, "items"), parse_github)
    add("github", ("get",), single(schemas.GITHUB), parse_github)
    add("web_search", ("search",), listed(schemas.WEB, "results"), parse_web)
    return found


def keys_from(lines: Iterable[str], known: dict[str, str] | None = None) -> dict[str, str]:
    """Keys of ``NAME=value`` lines; comments and lines without a sign are left out, quotes go, known keys stay as they are."""
    found = dict(known or {})
    for line in lines:
        name, sign, value = line.strip().partition("=")
        if sign and name.strip() and not name.startswith("#"):
            found.setdefault(name.strip(), value.strip().strip("'").strip('"'))
    return found


def missing_keys(keys: dict[str, str], needed: tuple[str, ...] = ()) -> list[str]:
    """Needed keys that are empty or absent."""
    return [k for k in needed if not keys.get(k)]
