"""The control loop: rolling polls under a budget, executor cycles, the orchestration cycle, and the run-time loop.

State is tables (work, watches, budgets, bindings) that each step replaces; decisions are relations over all their rows, and
the driver sees only what a cycle's bounds let through (a handful of picks). Reading a source is a callable: scan(root_id,
scope) returns {"outcome", "error", "children", "mirror"}; several are read at once, their results are committed strictly
in the order of their claims. Clocks are inputs, so that every step can be replayed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import runtime, selectors, work
from ledgerline.operators.ordered import stored

SECOND = 1_000_000
HOUR = 3600 * SECOND
# Why a cycle ended.
COMPLETED, NO_WORK, MAX_ITEMS, MAX_WALL_TIME, INTERNAL_FAILURE, CANCELLED = "COMPLETED", "NO_ELIGIBLE_WORK", "MAX_ITEMS", "MAX_WALL_TIME", "INTERNAL_ITEM_FAILURE", "CONTEXT_CANCELLED"
#: Bounds of the run-time loop.
RETRY_PROMOTIONS, BURST, COOLDOWN, RECOVERY_BATCH, SCOPE_CHILDREN = 5, 4, SECOND, 100, 1000


# ---- settings


@dataclass(frozen=True)
class RollingPolicy:
    """Background share of a source in percent, spacing of its calls, and a binding's lease, in microseconds."""

    share: int
    spacing: int
    lease: int

    def __post_init__(self):
        if not (1 <= self.share <= 50 and 1000 <= self.spacing <= 60 * SECOND and HOUR <= self.lease <= 7 * 24 * HOUR):
            raise ValueError("share 1 to 50, spacing 1 ms to 1 min, lease 1 h to 7 d")

    @property
    def admission_spacing(self) -> int:
        """A scan is taken as eight calls."""
        return self.spacing * 8 * 100 // self.share


def check_revisit(interval: int) -> int:
    """0 turns revisits off; else whole seconds from 30 s to 1 h, in microseconds."""
    if interval != 0 and (not 30 * SECOND <= interval <= HOUR or interval % SECOND):
        raise ValueError("0, or whole seconds from 30 s to 1 h")
    return interval


@dataclass(frozen=True)
class Settings:
    """Bounds of one orchestration cycle and of the loop; times in microseconds."""

    due_watches: int = 5
    items: int = 5
    wall_time: int = 60 * SECOND
    readers: int = 1
    wake_interval: int = 5 * SECOND
    retries: int = RETRY_PROMOTIONS
    revisit: int = 0
    rolling: RollingPolicy | None = None
    discovery: str = ""

    def __post_init__(self):
        check_revisit(self.revisit)
        if not (3 <= self.due_watches <= 5 and 3 <= self.items <= 100 and SECOND <= self.wall_time <= 600 * SECOND):
            raise ValueError("3 to 5 due watches, 3 to 100 items, 1 s to 10 min")
        if self.readers not in (1, 2, 4, 8) or not SECOND <= self.wake_interval <= 60 * SECOND or not 0 <= self.retries <= RETRY_PROMOTIONS:
            raise ValueError("1, 2, 4 or 8 readers, wakes from 1 s to 1 min, at most 5 retries")
        if self.rolling and not self.revisit:
            raise ValueError("rolling polls need a revisit interval")

    @staticmethod
    def from_environment(env: dict[str, str]) -> Settings:
        """Settings of LEDGERLINE_* variables, times in milliseconds (MS) or whole seconds (S); others keep their defaults."""
        number = lambda name, unit: None if f"LEDGERLINE_{name}" not in env else int(env[f"LEDGERLINE_{name}"]) * unit
        given = {"due_watches": number("DUE_WATCHES", 1), "items": number("ITEMS", 1), "wall_time": number("WALL_TIME_S", SECOND), "readers": number("READERS", 1), "wake_interval": number("WAKE_INTERVAL_S", SECOND), "retries": number("RETRIES", 1), "revisit": number("REVISIT_S", SECOND), "discovery": env.get("LEDGERLINE_DISCOVERY_SCOPE")}
        share = number("ROLLING_SHARE", 1)
        if share is not None:
            given["rolling"] = RollingPolicy(share, number("ROLLING_SPACING_MS", 1000) or 200_000, number("ROLLING_LEASE_S", SECOND) or 24 * HOUR)
        return Settings(**{k: v for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class DiagnoseLimits:
    """Rows of a data set, time for all of it, and from when a lag counts; times in microseconds."""

    rows: int = 1000
    timeout: int = 5 * SECOND
    stale_after: int = 600 * SECOND

    def __post_init__(self):
        if not (1 <= self.rows <= 10_000 and 1000 <= self.timeout <= 30 * SECOND and SECOND <= self.stale_after <= 24 * HOUR):
            raise ValueError("rows 1 to 10000, timeout 1 ms to 30 s, stale-after 1 s to 24 h")


def diagnose_root(work_rows: DataFrame, roots: DataFrame, root_id: str, now: int, limits: DiagnoseLimits = DiagnoseLimits()) -> tuple[DataFrame, bool]:
    """(checks of one root with their overall state, whether all rows were looked at). Reads only; a root that has more work
    than `rows` is told by its first ones."""
    from ledgerline.operators import diagnose

    rows, whole = selectors.bounded_sample(work_rows.filter(F.col("root_id") == root_id), limits.rows, "scope")
    mine = roots.filter(F.col("root_id") == root_id)
    checks = diagnose.work_checks(diagnose.work_facts(rows), F.lit(now), limits.stale_after).unionByName(diagnose.root_checks(mine))
    return checks.join(diagnose.overall(checks), "root_id"), whole


# ---- rolling polls


def rolling_decisions(picks: DataFrame, work_rows: DataFrame, budgets: DataFrame, bindings: DataFrame, proofs: DataFrame, now: Column, ready: Column) -> DataFrame:
    """picks (root_id, scope, interval_s) plus decision and binds.

    DEFERRED: the root has a poll outstanding, the scope has work that isn't plainly verified, its directory isn't proven, or
    its binding doesn't match the proof or is retired; only cursors move. WAIT: the global spacing isn't over. Else EMIT;
    `binds` tells those that get a binding first. proofs: root_id, scope, resource_id, valid, changed_at. budgets: root_id,
    outstanding. bindings: root_id, scope, resource_id, lifecycle.
    """
    c = F.col
    w = work_rows.select("root_id", "scope", c("work_state").alias("__state"), F.size("sources").alias("__pending"), c("claimed_seq").alias("__claimed"), c("error_class").alias("__error"))
    m = picks.join(w, ["root_id", "scope"], "left").join(budgets.select("root_id", c("outstanding").alias("__out")), "root_id", "left")
    m = m.join(bindings.select("root_id", "scope", c("resource_id").alias("__bound"), c("lifecycle").alias("__life")), ["root_id", "scope"], "left").join(proofs.select("root_id", "scope", c("resource_id").alias("__proof"), "valid", "changed_at"), ["root_id", "scope"], "left")
    busy = c("__state").isNotNull() & ((c("__state") != "VERIFIED") | (F.coalesce("__pending", F.lit(0)) > 0) | c("__claimed").isNotNull() | c("__error").isNotNull())
    unproven = ~F.coalesce("valid", F.lit(False)) | F.coalesce(c("changed_at") > now, F.lit(True))
    other = c("__life").isNotNull() & (~c("__bound").eqNullSafe(c("__proof")) | (c("__life") == "RETIRED"))
    decision = F.when(c("__out").isNotNull() | busy | unproven | other, "DEFERRED").when(~ready, "WAIT").otherwise("EMIT")
    return m.select(*picks.columns, decision.alias("decision"), ((decision == "EMIT") & c("__life").isNull()).alias("binds"))


def rolling_stats(watches: DataFrame, bindings: DataFrame, budgets: DataFrame, budget: dict, now: int) -> DataFrame:
    """One row: managed watches and their freshness debt, bindings and what befell them, roots with a poll outstanding, and
    the polls emitted and deferred. A binding's or a verification's own time of freshness comes before the watch's."""
    from ledgerline.operators import metrics

    c = F.col
    mine = watches.filter(selectors.managed()).join(bindings.select("root_id", "scope", c("fresh_at").alias("__bound_at")), ["root_id", "scope"], "left").withColumn("fresh_at", F.coalesce("__bound_at", "fresh_at"))
    bound = bindings.agg(F.count("*").alias("bindings"), F.count_if(c("lifecycle") == "EXPIRED").alias("expired"), F.count_if(c("lifecycle") == "RETIRED").alias("retired"), F.coalesce(F.sum(c("epoch") - 1), F.lit(0)).alias("rebindings"))
    out = budgets.agg(F.count_if(c("outstanding").isNotNull()).alias("outstanding"))
    # one row each
    return metrics.freshness_debt(mine, now).crossJoin(F.broadcast(bound)).crossJoin(F.broadcast(out)).withColumns({"emitted": F.lit(budget["emitted"]).cast("long"), "deferred": F.lit(budget["deferred"]).cast("long")})


# ---- discovery


def discovery_children(prefix: str, parent: str, observed: list[str]) -> list[str]:
    """The direct children of a verified scope that are followed: inside the prefix, at most eight levels below it, each
    once. More than SCOPE_CHILDREN, or one that is no direct child, raises."""
    from posixpath import dirname, normpath

    top = prefix.removesuffix("/") + "/"
    if not prefix or (parent != prefix and not parent.startswith(top)):
        return []
    if len(observed) > SCOPE_CHILDREN:
        raise ValueError("more children than a scope may have")
    for child in observed:
        if not child.startswith("/") or child == "/" or normpath(child) != child or "\\" in child or dirname(child) != parent:
            raise ValueError(f"{child!r} is no direct child of {parent!r}")
    return [c for c in dict.fromkeys(observed) if len(c.removeprefix(top).split("/")) <= 8]


# ---- state


@dataclass
class Control:
    """The tables of the loop, and the one global budget row. Each replacement is stored, so lineage stays short."""

    spark: SparkSession
    roots: DataFrame
    work: DataFrame
    watches: DataFrame
    adapters: DataFrame
    inventory: DataFrame
    budgets: DataFrame  # root_id, scope_cursor, outstanding, outstanding_seq
    bindings: DataFrame  # root_id, scope, resource_id, lifecycle, epoch, fresh_at
    clock: Callable[[], int] = lambda: time.time_ns() // 1000
    budget: dict = field(default_factory=lambda: {"root_cursor": "", "next_admit_at": 0, "emitted": 0, "deferred": 0})

    def put(self, name: str, df: DataFrame) -> None:
        setattr(self, name, stored(df, f"control-{name}"))

    def picked(self, rows: list[tuple[str, str]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "root_id string, scope string")


# ---- executor


@dataclass
class CycleResult:
    stop: str = ""
    selected: int = 0
    succeeded: int = 0
    failed: int = 0
    stale: int = 0
    order: list = field(default_factory=list)  # (root_id, scope, what it ended as) in the order of commits


def read_ordered(items: list[tuple[str, str]], scan: Callable[[str, str], dict], readers: int) -> Iterator[tuple[tuple[str, str], dict]]:
    """(item, result) strictly in the order of items, with `readers` reads at once. Items of one root are read one after
    another, so that a source never sees two calls for a root; a read that raises is an INTERNAL error."""

    def one(item: tuple[str, str], after) -> dict:
        if after is not None:
            after.exception()  # wait
        try:
            return scan(*item)
        except Exception as e:  # a source may fail in any way
            return {"error": "INTERNAL", "cause": str(e)}

    with ThreadPoolExecutor(readers) as pool:
        last: dict[str, object] = {}
        jobs = []
        for item in items:
            last[item[0]] = job = pool.submit(one, item, last.get(item[0]))
            jobs.append(job)
        for item, job in zip(items, jobs, strict=True):
            yield item, job.result()


def execute_cycle(state: Control, scan: Callable[[str, str], dict], settings: Settings, deadline: int | None = None, cancelled: Callable[[], bool] = lambda: False) -> CycleResult:
    """Claim, read and commit at most settings.items pieces of work, in the order of the selection window.

    Before each group of readers: cancellation, then the number of items, then the deadline ends the cycle. An INTERNAL
    failure ends it after its own commit; other failures leave their item waiting or blocked, and the cycle goes on.
    Cancelled after reads, nothing of them is committed: the claims stay in flight, for recovery.
    """
    out = CycleResult()
    now = state.clock()
    window = [(r["root_id"], r["scope"]) for r in runtime.selection_window(state.work, state.roots, state.adapters, state.inventory, now, settings.items).orderBy("slot").collect()]
    while True:
        if cancelled():
            out.stop = CANCELLED
        elif out.selected >= settings.items:
            out.stop = MAX_ITEMS
        elif deadline is not None and state.clock() >= deadline:
            out.stop = MAX_WALL_TIME
        elif not window:
            out.stop = NO_WORK
        if out.stop:
            return out
        group, window = window[: settings.readers], window[settings.readers :]
        now = state.clock()
        versions = state.work.join(state.picked(group), ["root_id", "scope"]).select("root_id", "scope", "version")
        state.put("work", work.claim(state.work, versions, F.lit(now), state.roots))
        claimed = {(r["root_id"], r["scope"]): r for r in state.work.join(state.picked(group), ["root_id", "scope"]).filter("work_state = 'IN_FLIGHT'").collect()}
        out.stale += len(group) - len(claimed)
        group = [g for g in group if g in claimed]
        out.selected += len(group)
        if not group:
            continue
        _watch(state, [(*g, "STARTED", None) for g in group], now)
        results = list(read_ordered(group, scan, settings.readers))
        if cancelled():
            out.stop = CANCELLED
            return out
        for item, got in results:
            error, children = got.get("error"), []
            if error is None and got.get("outcome") not in ("APPLIED", "NOOP"):
                error = "INTERNAL"  # only what was applied, or is known already, verifies a scope
            if error is None:
                try:
                    children = discovery_children("/" if got.get("mirror") else settings.discovery, item[1], got.get("children", []))
                except ValueError:
                    error = "INTERNAL"
            now = state.clock()
            mine = (F.col("root_id") == item[0]) & (F.col("scope") == item[1])
            # the watch is told by what was claimed, so before the claim is given back
            _watch(state, [(*item, "SUCCEEDED" if error is None else "FAILED", error)], now)
            if error is None:
                if got.get("mirror") and settings.revisit:
                    children = mirror_children(state, item[0], children, settings, now)
                state.put("work", _followed(state, work.complete(state.work, mine, F.lit(now)), item, children, settings, now))
                out.succeeded += 1
            else:
                state.put("work", work.fail(state.work, mine, F.lit(error), F.lit(now) + F.coalesce(runtime.retry_delay(F.lit(error)), F.lit(0)) * SECOND, F.lit(now)))
                out.failed += 1
            state.put("budgets", state.budgets.withColumn("outstanding", F.when(~((F.col("root_id") == item[0]) & F.coalesce(F.col("outstanding") == item[1], F.lit(False))), F.col("outstanding"))))
            out.order.append((*item, error or "VERIFIED"))
            if error == "INTERNAL":
                out.stop = INTERNAL_FAILURE
        if out.stop:
            return out


def mirror_children(state: Control, root_id: str, children: list[str], settings: Settings, now: int) -> list[str]:
    """The children of a mirrored scope that need a signal: those that a sound verification or queued work doesn't cover
    already. Children without a watch get one that revisits them."""
    from ledgerline.operators.controls import path_proofs

    if not children:
        return []
    c, mine = F.col, F.col("root_id") == root_id
    top = settings.discovery
    high = lambda x: bool(top) and (x == top or x.startswith(top.removesuffix("/") + "/"))
    kids = state.spark.createDataFrame([(root_id, x, "HIGH" if high(x) else "NORMAL") for x in children], "root_id string, scope string, child_priority string")
    proofs = path_proofs(state.inventory.filter(mine)).select("root_id", c("path").alias("scope"), ((c("n") == 1) & c("good")).alias("proof_ok"), "changed_at")
    watches = state.watches.filter(mine).select("root_id", "scope", "watch_state", "cadence", "source_set", "priority", "last_error", "deferred_until", "interval_s", "next_due")
    rows = state.work.filter(mine).select("root_id", "scope", "work_state", "verified_at", "verified_seq", "signal_seq", "attempts", "error_class", c("priority").alias("work_priority"), "not_before")
    told = work.admit_children(kids.join(proofs, ["root_id", "scope"], "left").join(watches, ["root_id", "scope"], "left").join(rows, ["root_id", "scope"], "left"), F.lit(now), settings.revisit // SECOND)
    told = told.select("scope", "verdict", c("watch_state").isNull().alias("bare")).collect()  # a scope's children
    bare = [r["scope"] for r in told if r["bare"]]
    if bare:
        new = state.spark.createDataFrame([(root_id, x) for x in bare], "root_id string, scope string")
        given = {"watch_state": F.lit("WARM"), "cadence": F.lit("MIRROR_REVISIT"), "priority": F.lit("NORMAL"), "interval_s": F.lit(settings.revisit // SECOND), "next_due": F.lit(now + settings.revisit), "failures": F.lit(0), "version": F.lit(1), "source_set": F.array(F.lit("BACKSTOP_ENROLL"))}
        kind = state.watches.schema
        state.put("watches", state.watches.unionByName(new.select("root_id", "scope", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind if f.name not in ("root_id", "scope")])))
    return [r["scope"] for r in told if r["verdict"] not in ("VERIFIED_REUSED", "ALREADY_QUEUED")]


def _watch(state: Control, steps: list[tuple], now: int) -> None:
    told = state.spark.createDataFrame(steps, "root_id string, scope string, step string, __e string")
    rows = state.work.select("root_id", "scope", "claimed_sources").join(told, ["root_id", "scope"]).withColumnRenamed("__e", "error_class")
    state.put("watches", work.watch_effects(state.watches, rows, F.lit(now)))


def _followed(state: Control, rows: DataFrame, item: tuple[str, str], children: list[str], settings: Settings, now: int) -> DataFrame:
    """rows after the signals of a verified scope's children: high inside the scope that discovery is about, else normal."""
    if not children:
        return rows
    top = settings.discovery
    inside = lambda c: bool(top) and (c == top or c.startswith(top.removesuffix("/") + "/"))
    signals = state.spark.createDataFrame([(item[0], c, "RECOVERY", "POSSIBLE_CHANGE", "HIGH" if inside(c) else "NORMAL", now, None) for c in children], "root_id string, scope string, source string, reason string, priority string, seen_at long, not_before long")
    opened = work.merge_signals(rows, signals, state.roots)
    zero = {"attempts": 0, "failures": 0, "version": 1}
    return opened.select(*[F.coalesce(c, F.lit(zero[c])).cast(rows.schema[c].dataType).alias(c) if c in zero else F.col(c) for c in rows.columns])


# ---- orchestration


@dataclass
class OrchestrationResult:
    stop: str = ""
    due: int = 0
    more_due: bool = False
    emitted: int = 0
    deferred: int = 0
    stale: int = 0
    executor: CycleResult | None = None


def orchestrate(state: Control, scan: Callable[[str, str], dict], settings: Settings, cancelled: Callable[[], bool] = lambda: False) -> OrchestrationResult:
    """One cycle: list due watches (one more than it takes, to know of more), emit a poll for each, then run the executor
    once, whether or not anything was emitted. Polls that were emitted stay, whatever comes after."""
    out, start = OrchestrationResult(), state.clock()
    if cancelled():
        return replace(out, stop=CANCELLED)
    now, limit = F.lit(start), settings.due_watches + 1
    if settings.rolling:
        due = selectors.due_rolling(state.watches, state.roots, state.budgets, now, state.budget["root_cursor"], limit).orderBy("slot")
    elif settings.revisit:
        due = selectors.due_fair(state.watches, state.roots, now, limit).orderBy("slot")
    else:
        due = selectors.due_watches(state.watches, state.roots, now, limit).orderBy(*selectors.FIFO)
    managed = selectors.managed()
    rows = due.select("root_id", "scope", "interval_s", managed.alias("rolling")).collect()  # limit rows
    out.due, out.more_due = len(rows), len(rows) > settings.due_watches
    rows = rows[: settings.due_watches]
    plain = [(r["root_id"], r["scope"]) for r in rows if not (settings.rolling and r["rolling"])]
    if plain:
        mine = state.watches.join(state.picked(plain), ["root_id", "scope"])
        signals, _ = work.due_polls(mine, now)
        signals = stored(signals, "signals")
        state.put("work", _opened(state, signals))
        _next_due(state, plain, start)
        out.emitted += signals.count()
        out.stale += len(plain) - out.emitted
    for r in rows:
        if settings.rolling and r["rolling"]:
            done = emit_rolling(state, r["root_id"], r["scope"], r["interval_s"], settings.rolling, start)
            out.emitted, out.deferred = out.emitted + (done == "EMIT"), out.deferred + (done != "EMIT")
    if cancelled():
        return replace(out, stop=CANCELLED)
    out.executor = execute_cycle(state, scan, settings, start + settings.wall_time, cancelled)
    out.stop = out.executor.stop if out.executor.stop in (CANCELLED, MAX_WALL_TIME, INTERNAL_FAILURE) else COMPLETED
    return out


def _opened(state: Control, signals: DataFrame) -> DataFrame:
    rows = work.merge_signals(state.work, signals, state.roots)
    zero = {"attempts": 0, "failures": 0, "version": 1}
    return rows.select(*[F.coalesce(c, F.lit(zero[c])).cast(state.work.schema[c].dataType).alias(c) if c in zero else F.col(c) for c in rows.columns])


def _next_due(state: Control, picked: list[tuple[str, str]], now: int) -> None:
    c = F.col
    m = state.watches.join(state.picked(picked).withColumn("__p", F.lit(True)), ["root_id", "scope"], "left")
    state.put("watches", m.withColumn("next_due", F.when(c("__p"), F.lit(now) + c("interval_s") * SECOND).otherwise(c("next_due"))).withColumn("version", c("version") + F.when(c("__p"), 1).otherwise(0)).drop("__p").select(*state.watches.columns))


def emit_rolling(state: Control, root_id: str, scope: str, interval_s: int, policy: RollingPolicy, now: int) -> str:
    """Emit one managed poll within the budget: at most one outstanding a root, spaced over all roots. A deferred scope
    only moves the cursors on. Returns the decision."""
    from ledgerline.operators.controls import path_proofs

    c = F.col
    pick = state.spark.createDataFrame([(root_id, scope, interval_s)], "root_id string, scope string, interval_s long")
    proofs = path_proofs(state.inventory.filter(c("root_id") == root_id)).select("root_id", c("path").alias("scope"), "resource_id", ((c("n") == 1) & c("good")).alias("valid"), "changed_at")
    told = rolling_decisions(pick, state.work, state.budgets, state.bindings, proofs, F.lit(now), F.lit(state.budget["next_admit_at"] <= now)).join(proofs.select("root_id", "scope", "resource_id"), ["root_id", "scope"], "left").first()
    if told["decision"] == "WAIT":
        return "WAIT"
    mine = c("root_id") == root_id
    state.budget["root_cursor"] = root_id
    if told["decision"] == "DEFERRED":
        state.put("budgets", state.budgets.withColumn("scope_cursor", F.when(mine, scope).otherwise(c("scope_cursor"))))
        state.budget["deferred"] += 1
        return "DEFERRED"
    if told["binds"]:
        state.put("bindings", state.bindings.unionByName(state.spark.createDataFrame([(root_id, scope, told["resource_id"], "ACTIVE", 1, now)], state.bindings.schema)))
    signal = state.spark.createDataFrame([(root_id, scope, "POLL_SCHEDULE", "POSSIBLE_CHANGE", "NORMAL", now, None)], "root_id string, scope string, source string, reason string, priority string, seen_at long, not_before long")
    state.put("work", _opened(state, signal))
    seq = state.work.filter(mine & (c("scope") == scope)).select("signal_seq").first()[0]
    _next_due(state, [(root_id, scope)], now)
    state.put("budgets", state.budgets.withColumns({"scope_cursor": F.when(mine, scope).otherwise(c("scope_cursor")), "outstanding": F.when(mine, scope).otherwise(c("outstanding")), "outstanding_seq": F.when(mine, F.lit(seq).cast("long")).otherwise(c("outstanding_seq"))}))
    state.budget["next_admit_at"] = now + policy.admission_spacing
    state.budget["emitted"] += 1
    return "EMIT"


# ---- the loop


@dataclass
class Burst:
    """How long the next cycle has to wait: after BURST cycles without a pause of COOLDOWN, for what is left of one."""

    count: int = 0
    ended: int | None = None

    def wait(self, now: int) -> int:
        if self.ended is not None and now - self.ended >= COOLDOWN:
            self.count = 0
        return COOLDOWN - (now - self.ended) if self.count >= BURST and self.ended is not None else 0

    def finished(self, now: int) -> None:
        self.count, self.ended = self.count + 1, now


def recover_startup(state: Control) -> int:
    """Give back everything that a lost run left in flight, RECOVERY_BATCH roots at a time. A batch that changes nothing raises."""
    total = 0
    while True:
        flying = state.work.filter("work_state = 'IN_FLIGHT'")
        roots = flying.select("root_id").distinct().orderBy("root_id").limit(RECOVERY_BATCH)
        n = flying.join(roots, "root_id", "left_semi").count()
        if not n:
            return total
        own = state.work.join(roots, "root_id", "left_semi")
        rest = state.work.join(roots, "root_id", "left_anti")
        state.put("work", rest.unionByName(work.recover_stale(own, state.roots, F.lit(state.clock() + 1)).select(*rest.columns)))
        left = state.work.join(stored(roots, "roots"), "root_id", "left_semi").filter("work_state = 'IN_FLIGHT'").count()
        if left >= n:
            raise RuntimeError("recovery made no progress")
        total += n - left


def run_loop(state: Control, scan: Callable[[str, str], dict], settings: Settings, stopped: Callable[[], bool], sleep: Callable[[int], None], retry_adapters: DataFrame | None = None) -> list[OrchestrationResult]:
    """Recover, then cycle: at once while there is a backlog, else at the next wake, with a pause after each burst. Each
    cycle first promotes a few retries that are due. Ends when `stopped`; what a cycle raises ends the loop."""
    recover_startup(state)
    burst, done = Burst(), []
    while not stopped():
        pause = burst.wait(state.clock())
        if pause > 0:
            sleep(pause)
            burst.count = 0
        now = F.lit(state.clock())
        if settings.retries:
            due = state.work.filter("work_state = 'RETRY_WAIT'") if retry_adapters is None else selectors.due_retries(state.work, state.roots, state.watches, retry_adapters, now, settings.retries)
            first = stored(due.filter(F.col("not_before") <= now).orderBy("not_before", "root_id", "scope").limit(settings.retries).select("root_id", "scope"), "retries")
            own = state.work.join(first, ["root_id", "scope"], "left_semi")
            state.put("work", state.work.join(first, ["root_id", "scope"], "left_anti").unionByName(work.retry_ready(own, now, state.roots)))
        done.append(orchestrate(state, scan, settings, stopped))
        burst.finished(state.clock())
        backlog = done[-1].more_due or (done[-1].executor is not None and done[-1].executor.stop == MAX_ITEMS)
        if not backlog and not stopped():
            sleep(settings.wake_interval)
    return done
