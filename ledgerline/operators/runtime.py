"""Run-time decisions: selection windows, background class, source budgets, journal repair, corroboration, offline analysis."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import selectors

BACKGROUND_AGE_US = 30_000_000
# Parts of a setting's name that make it a secret unless it names an environment variable.
SECRET_PARTS = ("password", "passwd", "token", "secret", "credential", "apikey", "privatekey")


def selection_window(work: DataFrame, roots: DataFrame, adapters: DataFrame, inventory: DataFrame, now: int, max_items: int) -> DataFrame:
    """The work that one bounded cycle would take, in its order (`slot`, `selection`).

    First one aged background item, then at most two first discoveries of different roots, then by priority. Each cohort
    is a distributed top-k of at most max_items rows; an item that two cohorts pick counts once.
    """
    if max_items < 3:
        raise ValueError("a window has at least three items")
    at = F.lit(now)
    aged = selectors.aged_background(work, roots, at, F.lit(now - BACKGROUND_AGE_US)).select("root_id", "scope")
    first = selectors.first_discovery(work, roots, adapters, inventory, at)
    picks = [("AGED_BACKGROUND", aged)]
    seen = aged.collect()  # one row
    found, excluded = [], []
    rest = work.join(aged, ["root_id", "scope"], "left_anti")
    for _ in range(min(2, max_items - 2)):
        first = selectors.first_discovery(rest, roots, adapters, inventory, at, excluded) if excluded or seen else first
        row = first.select("root_id", "scope").head(1)
        if not row:
            break
        found.append(tuple(row[0]))
        excluded.append(row[0]["root_id"])
    spark = work.sparkSession
    fast = spark.createDataFrame(found, "root_id string, scope string")
    picks.append(("FIRST_DISCOVERY", fast))
    taken = aged.unionByName(fast)
    fifo = selectors.next_work(work.join(taken, ["root_id", "scope"], "left_anti"), roots, at, max_items).select("root_id", "scope", "priority", "first_seen")
    from pyspark.sql import Window

    from ledgerline.functions.values import priority_rank

    order = Window.orderBy(priority_rank(F.col("priority")).desc(), "first_seen", "root_id", "scope")
    tail = fifo.withColumn("p", F.row_number().over(order) + 10).select("root_id", "scope", F.lit("PRIORITY_FIFO").alias("selection"), "p")
    places = {r: i + 1 for i, r in enumerate(found)}
    head = spark.createDataFrame([(*tuple(r), "AGED_BACKGROUND", 0) for r in seen] + [(*r, "FIRST_DISCOVERY", places[r]) for r in found], "root_id string, scope string, selection string, p int")
    return head.unionByName(tail).orderBy("p").limit(max_items).withColumn("slot", F.row_number().over(Window.orderBy("p"))).drop("p")


def background_claims(work: DataFrame, budgets: DataFrame) -> DataFrame:
    """Claims that only the poll schedule asked for, of the root's outstanding scope and no later than its number."""
    b = budgets.filter("outstanding is not null").select("root_id", F.col("outstanding").alias("scope"), "outstanding_seq")
    poll = F.col("claimed_sources") == F.array(F.lit("POLL_SCHEDULE"))
    return work.filter(F.coalesce(poll, F.lit(False)) & F.col("claimed_seq").isNotNull()).join(b, ["root_id", "scope"]).filter("outstanding_seq <= claimed_seq").drop("outstanding_seq")


def repair_event(journal: DataFrame, root_id: str, generation: int, event_type: str, resource_id: str, reason: str) -> DataFrame:
    """One corrective event at the current generation, numbered after all the root's events and after that generation's."""
    mine = journal.filter(F.col("root_id") == root_id)
    last = mine.agg((F.coalesce(F.max("event_seq"), F.lit(0)) + 1).alias("event_seq"), (F.coalesce(F.max(F.when(F.col("generation") == generation, F.col("intra_seq"))), F.lit(0)) + 1).alias("intra_seq"))
    return last.select(F.lit(root_id).alias("root_id"), F.lit(generation).cast("long").alias("generation"), "intra_seq", "event_seq", F.lit(event_type).alias("event_type"), F.lit(resource_id).alias("resource_id"), F.to_json(F.struct(F.lit(reason).alias("reason"))).alias("payload"))


def derive_corroboration(shrinks: DataFrame, observations: DataFrame) -> DataFrame:
    """(root_id, corroboration): what the first independent sound observation after a shrink says of it.

    shrinks: root_id, significant. observations: root_id, seq, fresh, no_error, no_skips, strong, shrunk.
    """
    sound = observations.filter("fresh and no_error and no_skips and strong").groupBy("root_id").agg(F.min_by("shrunk", "seq").alias("shrunk"))
    said = F.when(~F.col("significant") | F.col("shrunk").isNull(), "NONE").when(F.col("shrunk"), "CORROBORATED").otherwise("CONTRADICTED")
    return shrinks.join(sound, "root_id", "left").select("root_id", said.alias("corroboration"))


def is_secret_key(key: str) -> bool:
    plain = key.lower().translate({ord(c): None for c in "_-."})
    return not plain.endswith("env") and any(p in plain for p in SECRET_PARTS)


def check_config(text: str) -> None:
    """Raise if a collector's settings are no JSON or hold a secret in the open. Empty settings are fine."""

    def look(x) -> None:
        for k, v in x.items() if isinstance(x, dict) else ((None, v) for v in x) if isinstance(x, list) else ():
            if k is not None and is_secret_key(k):
                raise ValueError(f"{k}: name an environment variable instead ({k}_env)")
            look(v)

    if text.strip():
        look(json.loads(text))


class Deferred(Exception):
    """The source asked for a pause that isn't over."""


@dataclass
class SourceBudget:
    """Spacing of calls to a source: overall, per root, per provider group; background calls get a share of each.

    Failures double a pause up to a bound; a provider's own wait is never shortened. For one driver: calls are serial.
    """

    spacing: float = 0.1
    root_spacing: float = 0.1
    group_spacing: float = 0.1
    backoff: float = 45.0
    max_backoff: float = 900.0
    background_percent: int = 0
    max_keys: int = 4096
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: dict = field(default_factory=dict)
    _until: dict = field(default_factory=dict)
    _strikes: dict = field(default_factory=dict)

    def acquire(self, root: str, group: str, background: bool = False) -> None:
        keys = {("all", ""): self.spacing, ("root", root): self.root_spacing, ("group", group): self.group_spacing}
        if len(self._next) + len([k for k in keys if k not in self._next]) > 4 * self.max_keys:
            raise OverflowError("too many sources")
        if background and self.background_percent:
            keys |= {("bg", *k): s * 100 / self.background_percent for k, s in list(keys.items())}
        now = self.clock()
        if max(self._until.get(("root", root), now), self._until.get(("group", group), now)) > now:
            raise Deferred(f"{root} {group}")
        wait = max(self._next.get(k, now) for k in keys) - now
        if wait > 0:
            self.sleep(wait)
        now = self.clock()
        for k, s in keys.items():
            self._next[k] = now + s

    def report(self, root: str, group: str, ok: bool, retry_after: float = 0.0) -> None:
        if ok:
            self._strikes.pop(group, None)
            return
        n = self._strikes[group] = self._strikes.get(group, 0) + 1
        pause = max(min(self.backoff * 2 ** min(n - 1, 40), self.max_backoff), retry_after)
        self._until[("group", group)] = max(self._until.get(("group", group), 0.0), self.clock() + pause)


def analyse_receipts(records: DataFrame) -> dict[str, DataFrame]:
    """Offline report over NDJSON receipts (type, started, finished, scope, status, http; claims with seen and claimed).

    arrivals by second, peak concurrency, requests by status, list calls by scope, claim latency quantiles.
    """
    from ledgerline.operators import metrics

    http = records.filter("type = 'receiver_http'")
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    timed = http.select(micros(F.col("started")).alias("started"), micros(F.col("finished")).alias("finished"), "scope", "status", "http", F.lit(0).alias("all"))
    start = timed.agg(F.min("started")).first()[0] or 0
    claims = records.filter("type = 'claim' and scope <> '/'").select(F.lit(0).alias("all"), (micros(F.col("claimed")) - micros(F.col("seen"))).alias("waited"))
    return {
        "arrivals": metrics.arrivals(timed, "started", start),
        "peak": metrics.peak_concurrency(timed, ["all"], "started", "finished"),
        "statuses": timed.groupBy("status").agg(F.count("*").alias("n")),
        "lists": timed.filter("http = '/api/fs/list'").groupBy("scope").agg(F.count("*").alias("n")),
        "claims": metrics.nearest_rank(claims, ["all"], "waited"),
    }


def retry_delay(error: Column, transient_s: int = 30, throttled_s: int = 45, internal_s: int = 60) -> Column:
    """Seconds until a failed scope is retried; null for classes that aren't."""
    return F.when(error == "TRANSIENT_PROVIDER", transient_s).when(error == "THROTTLED", throttled_s).when(error == "INTERNAL", internal_s)
