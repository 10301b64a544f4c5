"""Live trace providers as a Python data source: traces are selected page by page, then fetched in batches by the tasks.

    spark.dataSource.register(TracePages)
    spark.read.format("trace_pages").options(provider="langfuse", url=..., since=..., until=..., limit=100).load()

gives (trace_id, position, part, body): what the provider returned, as JSON text. Selection runs on the driver and keeps
ids and their places alone; it stops as soon as there are enough traces. Each partition fetches the details of one batch of
ids, and an answer without one of them is refused.

Keys are no options, as these are shown in plans, and executors' environments have none: source_with(keys) makes a data
source that carries them to the tasks within itself.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.functions.urls import sql_literal

SECONDS, BATCH = 60, 50
#: Requests that are tried again after so many seconds: when the connection fails, and by status.
PAUSES, AGAIN = (0.5, 2.0, 8.0), {429, 500, 502, 503, 504}
#: Names of keys in the environment or in an .env file.
KEYS = ("LANGFUSE_PUBLIC_KEY", "LANGFUSE_SECRET_KEY", "MLFLOW_TRACKING_TOKEN", "LANGSMITH_API_KEY", "LANGCHAIN_API_KEY", "BRAINTRUST_API_KEY", "NMP_ACCESS_TOKEN")


class ProviderError(ValueError):
    """A provider answered something that can't be a complete selection."""


def call(url: str, headers: dict[str, str], query: dict | None = None, body: dict | None = None) -> tuple[dict, dict]:
    """(JSON body, headers) of a request; a body makes it a POST. Failures that may pass are tried again, a few times."""
    if query:
        url += "?" + urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
    for pause in (*PAUSES, None):
        try:
            with urllib.request.urlopen(request, timeout=SECONDS) as answer:
                return json.loads(answer.read()), {k.lower(): v for k, v in answer.headers.items()}
        except urllib.error.HTTPError as error:
            if pause is None or error.code not in AGAIN:
                raise ProviderError(f"{urllib.parse.urlsplit(url).path}: status {error.code}") from error
        except OSError as error:
            if pause is None:
                raise ProviderError(f"{urllib.parse.urlsplit(url).path}: {error}") from error
        time.sleep(pause)
    raise AssertionError


@dataclass
class Provider:
    """Options of a run; select() gives the ids of whole traces, fetch() (trace_id, part, body) of a batch of them."""

    options: dict[str, str]
    keys: dict[str, str] = field(default_factory=dict, repr=False)

    @property
    def url(self) -> str:
        return self.options["url"].rstrip("/")

    @property
    def limit(self) -> int:
        return int(self.options.get("limit", 100))

    def secret(self, *names: str) -> str:
        """The first of the keys that were handed over, else of the environment's."""
        return next((where[n] for where in (self.keys, os.environ) for n in names if where.get(n)), "")

    def bearer(self, *names: str) -> dict[str, str]:
        key = self.secret(*names)
        return {"Authorization": f"Bearer {key}"} if key else {}

    def select(self) -> list[str]:
        raise NotImplementedError

    def fetch(self, ids: list[str]) -> Iterator[tuple[str, str, dict]]:
        raise NotImplementedError


class Langfuse(Provider):
    """Newest traces in [since, until), oldest first; one request for each trace's details."""

    @property
    def headers(self) -> dict[str, str]:
        pair = f"{self.secret('LANGFUSE_PUBLIC_KEY')}:{self.secret('LANGFUSE_SECRET_KEY')}"
        return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}

    def select(self) -> list[str]:
        found: dict[str, str] = {}
        page, size = 1, min(self.limit, 100)
        while len(found) < self.limit:
            query = {"page": page, "limit": size, "orderBy": "timestamp.desc", "fromTimestamp": self.options["since"], "toTimestamp": self.options["until"]}
            answer, _ = call(f"{self.url}/api/public/traces", self.headers, query)
            for trace in answer["data"][: self.limit - len(found)]:
                found.setdefault(trace["id"], trace["timestamp"])
            if page >= answer["meta"]["totalPages"]:
                break
            if not answer["data"]:
                raise ProviderError(f"page {page} of traces is empty, though others follow")
            page += 1
        return sorted(found, key=lambda i: (found[i], i))

    def fetch(self, ids):
        for i in ids:
            yield i, "trace", call(f"{self.url}/api/public/traces/{urllib.parse.quote(i, safe='')}", self.headers)[0]


class MLflow(Provider):
    """First traces of an experiment by time. Pages are selected without spans; a task asks for its page with them, which has to hold the same traces."""

    def select(self) -> list[str]:
        ids, seen, token, total = [], set(), None, 0
        while total < self.limit:
            size = min(self.limit - total, 500)
            answer = self._page(token, size, spans=False)
            found = [t["info"]["trace_id"] for t in answer.get("traces", [])]
            following = answer.get("next_page_token") or None
            if not found:
                if following:
                    raise ProviderError("an empty page says that others follow")
                break
            if len(found) > size:
                raise ProviderError(f"{len(found)} traces came where {size} were asked for")
            again = seen.intersection(found) or len(set(found)) < len(found)
            if again:
                raise ProviderError("a trace came twice")
            seen.update(found)
            ids.append(json.dumps([token, size, found]))
            total += len(found)
            if not following:
                break
            if following in {json.loads(i)[0] for i in ids}:
                raise ProviderError("a page token came twice")
            token = following
        return ids

    def _page(self, token: str | None, size: int, spans: bool) -> dict:
        place = {"type": "MLFLOW_EXPERIMENT", "mlflow_experiment": {"experiment_id": self.options["experiment"]}}
        body = {"locations": [place], "filter": self.options.get("filter"), "max_results": size, "order_by": ["timestamp_ms ASC"], "page_token": token, "include_spans": spans}
        return call(f"{self.url}/api/3.0/mlflow/traces/search", self.bearer("MLFLOW_TRACKING_TOKEN"), body={k: v for k, v in body.items() if v is not None})[0]

    def fetch(self, ids):
        for i in ids:
            token, size, listed = json.loads(i)
            traces = self._page(token, size, spans=True).get("traces", [])
            if [t["info"]["trace_id"] for t in traces] != listed:
                raise ProviderError("a page has other traces than when it was selected")
            for trace in traces:
                yield trace["info"]["trace_id"], "trace", trace


class LangSmith(Provider):
    """Newest root runs of a project, then all runs of their traces, a batch of ids at a time."""

    @property
    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.secret("LANGSMITH_API_KEY", "LANGCHAIN_API_KEY")}

    def _runs(self, **query) -> Iterator[dict]:
        cursor, seen = None, set()
        while True:
            body = {"session": [self.options["project"]], **query, **({"cursor": cursor} if cursor else {})}
            answer, _ = call(f"{self.url}/api/v1/runs/query", self.headers, body=body)
            yield from answer["runs"]
            cursor = (answer.get("cursors") or {}).get("next")
            if not cursor:
                return
            if cursor in seen or not answer["runs"]:
                raise ProviderError("run pages make no progress")
            seen.add(cursor)

    def select(self) -> list[str]:
        found: dict[str, str] = {}
        for run in self._runs(is_root=True, start_time=self.options.get("since"), limit=min(self.limit, 100)):
            if run["id"] in found:
                raise ProviderError(f"root {run['id']} came twice")
            found[run["id"]] = run["start_time"]
            if len(found) == self.limit:
                break
        return sorted(found, key=lambda i: (found[i], i))

    def fetch(self, ids):
        wanted, got, seen = set(ids), set(), set()
        listed = ", ".join(json.dumps(i) for i in ids)
        for run in self._runs(trace_filter=f"in(id, [{listed}])"):
            if run["id"] in seen:
                raise ProviderError(f"run {run['id']} came twice")
            if run["trace_id"] not in wanted:
                raise ProviderError(f"run {run['id']} belongs to {run['trace_id']}, which wasn't asked for")
            seen.add(run["id"])
            got.add(run["trace_id"])
            yield run["trace_id"], "run", run
        if wanted - got:
            raise ProviderError(f"no runs of {', '.join(sorted(wanted - got))}")


class Braintrust(Provider):
    """Newest roots in [since, until) by the provider's own SQL, then all rows of each."""

    def _rows(self, text: str) -> Iterator[dict]:
        cursor, seen = None, set()
        while True:
            paged = text if cursor is None else f"{text} OFFSET {sql_literal(cursor)}"
            answer, headers = call(f"{self.url}/btql", self.bearer("BRAINTRUST_API_KEY"), body={"query": paged, "fmt": "json"})
            cursor = headers.get("x-bt-cursor")
            if cursor and (cursor in seen or not answer["data"]):
                raise ProviderError("rows make no progress")
            seen.add(cursor)
            yield from answer["data"]
            if not cursor:
                return

    @property
    def table(self) -> str:
        kind = "project_logs" if "project" in self.options else "experiment"
        return f"{kind}({sql_literal(self.options.get('project') or self.options['experiment'])})"

    def select(self) -> list[str]:
        bounds = f"created >= {sql_literal(self.options['since'])} AND created < {sql_literal(self.options['until'])}"
        found: dict[str, str] = {}
        for row in self._rows(f"SELECT root_span_id, created FROM {self.table} WHERE is_root AND {bounds} ORDER BY _pagination_key DESC LIMIT {min(self.limit, 1000)}"):
            if row["root_span_id"] in found:
                raise ProviderError(f"root {row['root_span_id']} came twice")
            found[row["root_span_id"]] = row["created"]
            if len(found) == self.limit:
                break
        return sorted(found, key=lambda i: (found[i], i))

    def fetch(self, ids):
        for i in ids:
            for row in self._rows(f"SELECT * FROM {self.table} WHERE root_span_id = {sql_literal(i)} ORDER BY _pagination_key ASC LIMIT 1000"):
                yield i, "row", row


class Intake(Provider):
    """First traces in the requested order, those of an experiment's evaluations merged; then spans and results of each."""

    def _page(self, what: str, page: int, **query) -> dict:
        base = f"{self.url}/apis/intake/v2/workspaces/{urllib.parse.quote(self.options['workspace'], safe='')}/{what}"
        return call(base, self.bearer("NMP_ACCESS_TOKEN"), {**query, "page": page, "page_size": int(self.options.get("page_size", 100))})[0]

    def _pages(self, what: str, **query) -> Iterator[dict]:
        for _, rows in self._numbered(what, **query):
            yield from rows

    def _numbered(self, what: str, **query) -> Iterator[tuple[int, list[dict]]]:
        """(number, rows) of all pages, which have to agree with what they say about themselves."""
        page, received, first = 1, 0, None
        while True:
            answer = self._page(what, page, **query)
            told, rows = answer["pagination"], answer["data"]
            totals = told["total_results"], told["total_pages"]
            first = first or totals
            received += len(rows)
            last = page >= told["total_pages"]
            for wrong, why in (
                (told["page"] != page, "another page came"), (told["current_page_size"] != len(rows), "the page has another size than it says"), (totals != first, "the totals changed"),
                (received > first[0] or last and received != first[0], "there are more or fewer rows than it says"), (not rows and not last, "an empty page came before the last"),
            ):
                if wrong:
                    raise ProviderError(f"{what}, page {page}: {why}")
            yield page, rows
            if last:
                return
            page += 1

    def _query(self, evaluation: str | None) -> dict[str, str]:
        query = {"filter[started_at][gte]": self.options["since"], "filter[started_at][lte]": self.options["until"], "sort": self.options.get("sort", "started_at"), "mode": "detailed"}
        return query | ({} if evaluation is None else {"filter[experiment_id]": self.options["experiment"], "filter[evaluation_name]": evaluation})

    def _places(self, evaluation: str | None) -> Iterator[tuple[str, str, int, str]]:
        for page, rows in self._numbered("traces", **self._query(evaluation)):
            yield from ((r["started_at"], evaluation, page, r["id"]) for r in rows)

    def select(self) -> list[str]:
        """The evaluation, page and id of each trace; bodies stay where they are."""
        names: list[str | None] = [None]
        if "experiment" in self.options:
            found = {e["name"] for e in self._pages("evaluations", **{"filter[experiment_id]": self.options["experiment"], "sort": "name"})}
            names = sorted(found & {self.options["evaluation"]} if "evaluation" in self.options else found)
        merged = heapq.merge(*map(self._places, names), key=lambda t: t[0], reverse=self.options.get("sort", "").startswith("-"))
        out = [json.dumps(place[1:]) for place in itertools.islice(merged, int(self.options.get("limit", 1 << 31)))]
        if not out:
            raise ProviderError("no traces")
        return out

    def fetch(self, ids):
        pages: dict[tuple[str | None, int], dict[str, dict]] = {}
        for text in ids:
            evaluation, page, i = json.loads(text)
            if (evaluation, page) not in pages:  # each page of this batch once
                pages[evaluation, page] = {t["id"]: t for t in self._page("traces", page, **self._query(evaluation))["data"]}
            trace = pages[evaluation, page].get(i)
            if trace is None:
                raise ProviderError(f"trace {i} isn't on page {page} any more")
            yield trace["id"], "trace", trace
            for span in self._pages("spans", **{"filter[trace_id]": trace["id"], "sort": "started_at", "mode": "detailed"}):
                yield trace["id"], "span", span
            for result in self._pages("evaluator-results", **{"filter[session_id]": trace["session_id"], "sort": "created_at"}):
                yield trace["id"], "result", result


PROVIDERS: dict[str, type[Provider]] = {"langfuse": Langfuse, "mlflow": MLflow, "langsmith": LangSmith, "braintrust": Braintrust, "intake": Intake}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], keys: dict[str, str]):
        self.options, self.keys = dict(options), keys

    def provider(self) -> Provider:
        return PROVIDERS[self.options["provider"]](self.options, self.keys)

    def partitions(self) -> list[InputPartition]:
        ids = self.provider().select()
        size = int(self.options.get("batch", BATCH))
        return [InputPartition((start, ids[start : start + size])) for start in range(0, len(ids), size)] or [InputPartition((0, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, ids = partition.value
        places: dict[str, int] = {}
        for trace_id, part, body in self.provider().fetch(ids):
            place = places.setdefault(trace_id, start + len(places))
            yield trace_id, place, part, json.dumps(body)


class TracePages(DataSource):
    """Options: provider, url, limit, batch, and what the provider needs (since, until, project, experiment, workspace ...)."""

    keys: dict[str, str] = {}

    @classmethod
    def name(cls) -> str:
        return "trace_pages"

    def schema(self) -> str:
        return "trace_id string, position long, part string, body string"

    def reader(self, schema) -> _Reader:
        # Option names lose their case on the way here.
        return _Reader({k.lower(): v for k, v in self.options.items()}, self.keys)


def source_with(keys: dict[str, str]) -> type[TracePages]:
    """The data source with keys. It is pickled with what it holds, so the keys reach the tasks though no plan shows them."""

    class KeyedTracePages(TracePages):
        pass

    KeyedTracePages.keys = {k: v for k, v in keys.items() if v}
    return KeyedTracePages
