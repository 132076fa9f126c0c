"""AList and OpenList sources: a Python data source for listings, distributed walks, scoped refreshes.

Requests are made in tasks. What a provider answers is kept as text and read by `listings.alist_page`; failures are rows
with an error class, so that a scan becomes evidence of failure instead of an exception.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.operators.ordered import stored
from ledgerline.sources import listings

#: Most children of a scoped listing.
MOST = 1000
PAGE = "scope string, page int, body string, error string, message string"


class Failed(RuntimeError):
    """A request that failed; kind is an error class of work."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def kind_of(code: int) -> str:
    """Error class of an HTTP status or of a provider's own code."""
    return "AUTH_OR_PERMISSION" if code in (401, 403) else "THROTTLED" if code == 429 else "TRANSIENT_PROVIDER"


@dataclass(frozen=True)
class Provider:
    """Where and as whom to ask. base_path: the name space that the account must be in, if it is known."""

    url: str
    token: str = ""
    username: str = ""
    password: str = ""
    base_path: str = ""
    timeout: float = 30.0
    per_page: int = 1000

    def __post_init__(self):
        if not self.url.startswith(("http://", "https://")) or len(self.url.split("://", 1)[1].strip("/")) == 0:
            raise ValueError("the address must be http or https, with a host")

    def call(self, path: str, payload: dict | None, token: str) -> dict:
        """The answer's data; anything but success raises Failed."""
        request = urllib.request.Request(self.url.rstrip("/") + path, None if payload is None else json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": token})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                got = json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise Failed(kind_of(e.code), f"HTTP status {e.code}") from e
        except (OSError, ValueError) as e:
            raise Failed("TRANSIENT_PROVIDER", f"no usable answer from {path}") from e
        if not isinstance(got, dict) or got.get("code") != 200:
            raise Failed(kind_of(got.get("code") if isinstance(got, dict) and isinstance(got.get("code"), int) else 500), f"refused by {path}")
        return got

    def session(self) -> str:
        """A token: the given one, or that of a log-in."""
        if self.token or not self.username:
            return self.token
        return (self.call("/api/auth/login", {"username": self.username, "password": self.password}, "").get("data") or {}).get("token", "")

    def check_name_space(self, token: str) -> None:
        """Raises if the account sees another name space than the expected one."""
        if self.base_path and (self.call("/api/me", None, token).get("data") or {}).get("base_path") != self.base_path:
            raise Failed("AUTH_OR_PERMISSION", "the account is in another name space")

    def page(self, token: str, scope: str, page: int, per_page: int, refresh: bool = False) -> dict:
        return self.call("/api/fs/list", {"path": scope, "page": page, "per_page": per_page, "refresh": refresh}, token)

    def pages(self, token: str, scope: str) -> Iterator[tuple[int, str]]:
        """All pages of a scope as (number, text). An end before the declared total, or rows beyond it, raises."""
        n, page = 0, 1
        while True:
            got = self.page(token, scope, page, self.per_page)
            data = got.get("data") or {}
            rows, total = data.get("content") or [], data.get("total") or 0
            n += len(rows)
            yield page, json.dumps(got)
            if n >= total or not rows:
                break
            page += 1
        if n != total:
            raise Failed("TRANSIENT_PROVIDER", f"listing has {n} of {total} rows")

    def refreshed(self, token: str, scope: str, most: int) -> str:
        """One refreshed page that holds all children; one more than `most` is asked for, so that an overflow shows."""
        self.check_name_space(token)
        got = self.page(token, scope, 1, most + 1, True)
        total = (got.get("data") or {}).get("total") or 0
        if total > most:
            raise Failed("SCOPE_TOO_LARGE", f"{total} children, at most {most}")
        self.check_name_space(token)  # still the same account's
        return json.dumps(got)


def fetch(provider: Provider, scopes: list[str], most: int | None = None) -> Iterator[tuple]:
    """PAGE rows of scopes: all pages, or with `most` one refreshed page each."""
    try:
        token = provider.session()
    except Failed as e:
        for scope in scopes:
            yield scope, 0, None, e.kind, str(e)
        return
    for scope in scopes:
        try:
            for page, body in [(1, provider.refreshed(token, scope, most))] if most is not None else provider.pages(token, scope):
                yield scope, page, body, None, None
        except Failed as e:
            yield scope, 0, None, e.kind, str(e)


class AListSource(DataSource):
    """spark.read.format("alist"): PAGE rows of the scopes in option `scopes` (JSON), a task each. Other options are those of
    Provider in lower case, and `most` for refreshed scopes."""

    @classmethod
    def name(cls) -> str:
        return "alist"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return AListReader(self.options)


class AListReader(DataSourceReader):
    def __init__(self, options: dict):
        kinds = {"timeout": float, "per_page": int}
        self.provider = Provider(**{k: kinds.get(k, str)(options[k]) for k in ("url", "token", "username", "password", "base_path", "timeout", "per_page") if k in options})
        self.scopes = json.loads(options.get("scopes", '["/"]'))
        self.most = int(options["most"]) if "most" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.scopes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from fetch(self.provider, [partition.value], self.most)


def list_scopes(scopes: DataFrame, provider: Provider) -> DataFrame:
    """PAGE rows of a table of scopes; each task lists its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(fetch(provider, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["scope", "page", "body", "error", "message"])

    return scopes.select("scope").mapInArrow(run, PAGE)


EVIDENCE = "traversal string, error_summary string, skipped_scopes string, skipped_known_empty boolean, freshness string, assurance string, identity_assurance string"


def evidence_of(spark: SparkSession, traversal: str, freshness: str | None, error: str | None = None) -> DataFrame:
    """One row. A walk never confirms that nothing was skipped, and a provider may hide a failed back end."""
    summary = None if error is None else json.dumps({"message": error})
    return spark.createDataFrame([(traversal, summary, None, False, freshness, "WEAK_FAILURE_VISIBILITY", "UNVERIFIED")], EVIDENCE)


def _entries(pages: DataFrame) -> DataFrame:
    c = F.col
    return listings.alist_page(pages).filter("name is not null").select(c("scope").alias("parent_ref"), "name", "is_dir", "size", "mtime", "hash", "alg")


def scan(spark: SparkSession, provider: Provider, top: str = "/", parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(entries, evidence) of a walk from `top`: a level of directories at a time, listed in tasks. Any failure makes the whole
    scan FAILED, without entries. Directories are tables; the driver holds none."""
    from ledgerline.functions.paths import entry_path

    frontier = spark.createDataFrame([(top,)], "scope string")
    seen, found = frontier, []
    while True:
        pages = stored(list_scopes(frontier.repartition(parallel), provider), "listing")
        bad = pages.filter("error is not null").orderBy("scope").head(1)
        if bad:
            empty = _entries(pages.limit(0))
            return empty, evidence_of(spark, "FAILED", None, f"{bad[0]['scope']}: {bad[0]['message']}")
        found.append(_entries(pages))
        dirs = found[-1].filter("is_dir").select(entry_path(F.col("parent_ref"), F.col("name")).alias("scope")).distinct()
        frontier = stored(dirs.join(seen, "scope", "left_anti"), "frontier")
        if not frontier.head(1):
            break
        seen = stored(seen.union(frontier), "seen")
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out, evidence_of(spark, "SUCCESS", "FRESH_DIRECT")


def scan_scope(spark: SparkSession, provider: Provider, scope: str, most: int = MOST) -> tuple[DataFrame, DataFrame, str | None]:
    """(entries, evidence, error class) of one refreshed listing of direct children. It never says anything of what is absent
    elsewhere: PARTIAL. Too many, miscounted, bad or repeated names are errors, without entries."""
    if not 0 <= most <= MOST:
        raise ValueError(f"0 to {MOST} children")
    page = next(iter(fetch(provider, [scope], most)))
    pages = spark.createDataFrame([Row(scope=page[0], body=page[2])], "scope string, body string")
    error = page[3] or listings.page_error(pages, most).first()["error"]
    if error:
        return _entries(pages.limit(0)), evidence_of(spark, "FAILED", None, page[4] or error), error
    return _entries(pages), evidence_of(spark, "PARTIAL", "FRESH_REFRESHED"), None
