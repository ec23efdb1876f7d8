"""A paged JSON API as a Spark source: executors fetch the records, window by window of time, in pages by key.

A read asks the API for the first and last time and cuts it into windows, one for each task, and one more for records without a time.
A task pages through its window by the last key seen, so records that come or go meanwhile shift no page; a page
that fails is asked for again. As a stream, an offset is the greatest time of any change column, and a batch has the records
that changed since the last one; Spark keeps the offsets in its checkpoint. No record passes through the driver.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from servista.functions.clean import RAW_SCHEMA
from servista.operators.changes import latest_per_key

Record = dict[str, object]
Fetch = Callable[[str, dict[str, str], float], tuple[int, bytes]]
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
FORMAT = "records_api"
#: Columns whose times say that a record changed; a record counts under the first of them that does.
CHANGES = ("created_date", "last_modified_date", "closed_date")
_ISO = "%Y-%m-%dT%H:%M:%S"


@dataclass(frozen=True)
class ApiConfig:
    """Where and how to ask; `key` tells records apart, windows are `window_days` of `moment` long."""

    base_url: str
    app_token: str | None = None
    timeout: float = 30
    max_retries: int = 3
    retry_backoff: float = 0.5
    page_size: int = 10_000
    pause: float = 0.1
    key: str = "sr_number"
    moment: str = "created_date"
    window_days: int = 30

    @classmethod
    def from_env(cls, url: str = "OPENDATA_URL", token: str = "OPENDATA_APP_TOKEN") -> ApiConfig:
        return cls(os.environ[url], os.environ.get(token))

    def options(self) -> dict[str, str]:
        return {k: str(v) for k, v in asdict(self).items() if v is not None}

    @classmethod
    def from_options(cls, options: dict[str, str]) -> ApiConfig:
        given = {k.lower(): v for k, v in options.items()}
        kinds = {"float": float, "int": int}
        return cls(**{f.name: kinds.get(str(f.type), str)(given[f.name]) for f in fields(cls) if f.name in given})


def http_get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body; connection errors count as status 503."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as got:
            return got.status, got.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except (urllib.error.URLError, TimeoutError, ConnectionError):
        return 503, b""


class ApiError(Exception):
    """The API answered with an error status, or with records that were not asked for."""


@dataclass(frozen=True)
class Request:
    """What is asked of the API: the filter, projection, order and page are the server's work."""

    where: str | None = None
    select: str | None = None
    order: str | None = None
    limit: int = 0

    def url(self, config: ApiConfig) -> str:
        """A limit of 0 means the page size. Names of the parameters are fixed by the API."""
        given = [("$order", self.order), ("$limit", self.limit or config.page_size), ("$where", self.where), ("$select", self.select)]
        return f"{config.base_url}?{urllib.parse.urlencode([(k, v) for k, v in given if v is not None])}"


def ask(config: ApiConfig, request: Request, get: Fetch = http_get, sleep: Callable[[float], None] = time.sleep) -> list[Record]:
    """The answer to one request, asked again after growing pauses while the status says so."""
    headers = {"Accept": "application/json"} | ({"X-App-Token": config.app_token} if config.app_token else {})
    status, body = 503, b""
    for attempt in range(config.max_retries + 1):
        status, body = get(request.url(config), headers, config.timeout)
        if status not in RETRY_STATUS:
            break
        if attempt < config.max_retries:
            sleep(config.retry_backoff * 2**attempt)
    if status >= 400:
        raise ApiError(f"status {status}")
    return json.loads(body)


def both(*conditions: str | None) -> str | None:
    """The conditions that are given, joined by AND."""
    given = [f"({c})" for c in conditions if c]
    return " AND ".join(given) or None


def quoted(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def records_by_key(config: ApiConfig, where: str | None = None, get: Fetch = http_get, sleep: Callable[[float], None] = time.sleep) -> Iterator[Record]:
    """All records that the filter finds, in order of their key, a page after the other; those without a key come first."""
    yield from ask(config, Request(both(where, f"{config.key} IS NULL"), limit=2**31 - 1), get, sleep)
    last: str | None = None
    while True:
        got = ask(config, Request(both(where, f"{config.key} > {quoted(last)}" if last is not None else f"{config.key} IS NOT NULL"), order=config.key), get, sleep)
        for record in got:
            key = str(record[config.key])
            if last is not None and key <= last:
                raise ApiError(f"the server doesn't honour the order: {key} after {last}")
            last = key
            yield record
        if len(got) < config.page_size:
            return
        sleep(config.pause)


@dataclass
class Part(InputPartition):
    where: str | None


def windows(low: str, high: str, days: int) -> list[tuple[str, str]]:
    """Half-open windows of so many days from low on, the last one ending at high."""
    out, at, end = [], datetime.fromisoformat(low), datetime.fromisoformat(high)
    while at < end:
        upto = min(at + timedelta(days=days), end)
        out.append((at.strftime(_ISO), upto.strftime(_ISO)))
        at = upto
    return out


class _Read:
    """Fields as the schema names them; nested ones as JSON text, others as strings."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names, self.config, self.where = schema.names, ApiConfig.from_options(options), options.get("where")

    def read(self, part: Part) -> Iterator[tuple]:
        for record in records_by_key(self.config, part.where):
            yield tuple(None if record.get(c) is None else json.dumps(record[c]) if not isinstance(record[c], str) else record[c] for c in self.names)


class RecordsReader(_Read, DataSourceReader):
    def partitions(self) -> list[Part]:
        c = self.config.moment
        span = ask(self.config, Request(self.where, f"min({c}) AS low, max({c}) AS high", limit=1))[0]
        parts = [Part(both(self.where, f"{c} IS NULL"))]
        if span.get("low") is not None:
            each = windows(str(span["low"]), str(span["high"]), self.config.window_days)
            parts += [Part(both(self.where, f"{c} >= {quoted(a)} AND {c} < {quoted(z)}")) for a, z in each]
            parts.append(Part(both(self.where, f"{c} >= {quoted(datetime.fromisoformat(str(span['high'])).strftime(_ISO))}")))
        return parts


class ChangesReader(_Read, DataSourceStreamReader):
    """The first batch has the records made from `since` on; each other one those of which some change column is after its start and up to
    its end, each once. A record that changes again meanwhile comes again with the next batch."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.start, self.columns = options["since"], options.get("changes", ",".join(CHANGES)).split(",")

    def initialOffset(self) -> dict:
        return {"mark": self.start}

    def latestOffset(self) -> dict:
        seen = ask(self.config, Request(self.where, ", ".join(f"max({c}) AS m{i}" for i, c in enumerate(self.columns)), limit=1))[0]
        return {"mark": max([self.start, *(str(v) for v in seen.values() if v is not None)])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, z, parts = start["mark"], end["mark"], []
        if a >= z:
            return parts
        if a == self.start:
            cuts = [*[low for low, _ in windows(a, z, self.config.window_days)], z]
            m = self.config.moment
            return [Part(both(self.where, f"{m} >= {quoted(low)} AND {m} {'<=' if high == z else '<'} {quoted(high)}")) for low, high in zip(cuts, cuts[1:], strict=False)]
        inside = lambda c, low, high: f"{c} > {quoted(low)} AND {c} <= {quoted(high)}"
        for i, c in enumerate(self.columns):
            earlier = [f"{b} IS NULL OR {b} <= {quoted(a)} OR {b} > {quoted(z)}" for b in self.columns[:i]]
            cuts = [a, *[high for _, high in windows(a, z, self.config.window_days)][:-1], z]
            parts += [Part(both(self.where, inside(c, low, high), *earlier)) for low, high in zip(cuts, cuts[1:], strict=False)]
        return parts

    def commit(self, end: dict) -> None:
        pass


class RecordsSource(DataSource):
    """Format `records_api`; options are ApiConfig's fields, `where`, and for streams `since` and `changes`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordsReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ChangesReader(schema, self.options)


def records(spark: SparkSession, config: ApiConfig, where: str | None = None, schema: str = RAW_SCHEMA) -> DataFrame:
    """All records that the API's filter finds."""
    spark.dataSource.register(RecordsSource)
    return spark.read.format(FORMAT).schema(schema).options(**config.options(), **({"where": where} if where else {})).load()


def recent(spark: SparkSession, config: ApiConfig, days: int = 7, now: datetime | None = None, schema: str = RAW_SCHEMA) -> DataFrame:
    """Records created in the last days."""
    day = (now or datetime.now()) - timedelta(days=days)
    return records(spark, config, f"{config.moment} >= '{day:%Y-%m-%d}T00:00:00'", schema)


def since(spark: SparkSession, config: ApiConfig, moment: str, schema: str = RAW_SCHEMA) -> DataFrame:
    return records(spark, config, f"{config.moment} > {quoted(moment)}", schema)


def changes_since(spark: SparkSession, config: ApiConfig, moment: str, columns: tuple[str, ...] = CHANGES, schema: str = RAW_SCHEMA) -> DataFrame:
    """The last record of each key that changed after a moment."""
    return latest_per_key(records(spark, config, " OR ".join(f"{c} > {quoted(moment)}" for c in columns), schema), config.key, columns[min(1, len(columns) - 1)])


def date_range(spark: SparkSession, config: ApiConfig, start: str, end: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """Half-open: from start up to, not including, end."""
    return records(spark, config, f"{config.moment} >= {quoted(start)} AND {config.moment} < {quoted(end)}", schema)


def with_fallback(spark: SparkSession, config: ApiConfig, where: str, schema: str = RAW_SCHEMA) -> DataFrame:
    """Filtered records, or unfiltered ones when the filter finds none."""
    found = ask(config, Request(where, f"count({config.key}) AS n", limit=1))[0]
    return records(spark, config, where if int(str(found["n"])) else None, schema)


def changes(spark: SparkSession, config: ApiConfig, start: str, columns: tuple[str, ...] = CHANGES, schema: str = RAW_SCHEMA) -> DataFrame:
    """A stream of the records made from `start` on, and then of those that change."""
    spark.dataSource.register(RecordsSource)
    return spark.readStream.format(FORMAT).schema(schema).options(**config.options(), since=start, changes=",".join(columns)).load()
