"""Work and watch selection. Orders are total, so every pick is the same on every run; limits are the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.paths import depth, parent_scope, under_base
from ledgerline.functions.values import blank, priority_rank
from ledgerline.operators.ordered import stored


def of_active(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.filter("lifecycle = 'ACTIVE'").select("root_id"), "root_id", "left_semi")


def open_now(now: Column) -> Column:
    return F.col("not_before").isNull() | (F.col("not_before") <= now)


def eligible(work: DataFrame, roots: DataFrame, now: Column) -> DataFrame:
    return of_active(work.filter("work_state = 'PENDING'").filter(open_now(now)), roots)


def next_work(work: DataFrame, roots: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """Highest priority, then oldest."""
    return eligible(work, roots, now).orderBy(priority_rank(F.col("priority")).desc(), "first_seen", "root_id", "scope").limit(limit)


def aged_background(work: DataFrame, roots: DataFrame, now: Column, before: Column, limit: int = 1) -> DataFrame:
    """Oldest NORMAL or LOW work seen by `before`, so that a stream of urgent work can't starve it."""
    return eligible(work, roots, now).filter(F.col("priority").isin("NORMAL", "LOW") & (F.col("first_seen") <= before)).orderBy("first_seen", "root_id", "scope").limit(limit)


def fair_pool(work: DataFrame, roots: DataFrame, now: Column, cursor: str, excluded: list[str] = (), limit: int = 1) -> DataFrame:
    """Round-robin over roots after the cursor; within one HIGH, then NORMAL, then all others."""
    rows = eligible(work, roots, now)
    rows = rows.filter(~F.col("root_id").isin(*excluded)) if excluded else rows
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "NORMAL", 1).otherwise(2)
    return rows.orderBy(F.when(F.col("root_id") > cursor, 0).otherwise(1), "root_id", rank, "first_seen", "scope").limit(limit)


def due_retries(work: DataFrame, roots: DataFrame, watches: DataFrame, adapters: DataFrame, now: Column, limit: int) -> DataFrame:
    """Retries whose wait is over: provider errors, and few INTERNAL ones of a mirrored root with credentials.

    adapters: root_id, kind, mirror, token, username, password (the names of settings). The two policy tests sit under an
    OR, so they are flags of left joins, not semi joins. Where rows repeat a root and scope, the other columns order them.
    """
    policy = watches.filter(F.col("watch_state").isin("HOT", "WARM") & (F.col("cadence") == "SOURCE_MIRROR") & F.array_contains("source_set", "OPERATOR_POLICY")).select("root_id", "scope").distinct().withColumn("has_watch", F.lit(True))
    able = adapters.filter(F.col("kind").isin("alist", "openlist") & F.coalesce("mirror", F.lit(False)) & ((blank(F.col("token")) != "") | ((blank(F.col("username")) != "") & (blank(F.col("password")) != "")))).select("root_id").distinct().withColumn("has_adapter", F.lit(True))
    rows = of_active(work.filter("work_state = 'RETRY_WAIT'").filter(F.col("not_before") <= now), roots).join(policy, ["root_id", "scope"], "left").join(able, "root_id", "left")
    few = (F.col("error_class") == "INTERNAL") & (F.col("scope") == "/") & F.col("failures").between(1, 2) & F.coalesce("has_watch", F.lit(False)) & F.coalesce("has_adapter", F.lit(False))
    return rows.filter(F.col("error_class").isin("TRANSIENT_PROVIDER", "THROTTLED") | few).drop("has_watch", "has_adapter").orderBy(*dict.fromkeys(["not_before", "root_id", "scope", *work.columns])).limit(limit)


def managed() -> Column:
    """A watch that the mirror policy enrolled and may revisit by itself."""
    return (F.col("watch_state") == "WARM") & (F.col("cadence") == "MIRROR_REVISIT") & (F.col("source_set") == F.array(F.lit("BACKSTOP_ENROLL"))) & (F.col("priority") == "NORMAL")


def is_due(now: Column) -> Column:
    return F.col("watch_state").isin("HOT", "WARM") & (F.col("next_due") <= now) & (F.col("deferred_until").isNull() | (F.col("deferred_until") <= now))


def covers(now: Column, interval_s: int) -> Column:
    """A managed watch that will look again within the asked interval by itself."""
    return managed() & F.col("last_error").isNull() & (F.col("deferred_until").isNull() | (F.col("deferred_until") <= now)) & (F.col("interval_s") <= interval_s) & (F.col("next_due") <= now + interval_s * 1_000_000)


def due_watches(watches: DataFrame, roots: DataFrame, now: Column, limit: int) -> DataFrame:
    return of_active(watches.filter(is_due(now)), roots).orderBy("next_due", "root_id", "scope").limit(limit)


FIFO = ["next_due", "root_id", "scope"]


def due_fair(watches: DataFrame, roots: DataFrame, now: Column, limit: int) -> DataFrame:
    """The first ordinary and the first managed watch, then the rest in order; `slot` numbers the result.

    Each cohort is cut to `limit` by a distributed top-k before the window, so the window sees few rows.
    """
    if not 3 <= limit <= 6:
        raise ValueError("3 to 6 candidates")
    kind = (F.col("watch_state") == "WARM") & (F.col("cadence") == "MIRROR_REVISIT") & (F.col("source_set") == F.array(F.lit("BACKSTOP_ENROLL")))
    due = of_active(watches.filter(is_due(now)), roots).withColumn("managed", kind)
    both = due.filter("not managed").orderBy(*FIFO).limit(limit).unionByName(due.filter("managed").orderBy(*FIFO).limit(limit))
    pos = F.row_number().over(Window.partitionBy("managed").orderBy(*FIFO))
    first = F.when((F.col("pos") == 1) & ~F.col("managed"), 0).when((F.col("pos") == 1) & F.col("managed"), 1).otherwise(2)
    top = both.withColumn("pos", pos).withColumn("band", first).orderBy("band", *FIFO).limit(limit)
    return top.withColumn("slot", F.row_number().over(Window.orderBy("band", *FIFO))).drop("pos", "band")


def after_cursor(rows: DataFrame, key: str, cursor: Column, by: list[str]) -> DataFrame:
    """One row per `by`: the first by `key` after the cursor, or, where none is, the first of all."""
    band = F.when(F.col(key) > cursor, 0).otherwise(1)
    order = Window.partitionBy(*by).orderBy(band, key)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def rolling_pick(watches: DataFrame, roots: DataFrame, budgets: DataFrame, now: Column, root_cursor: str) -> DataFrame:
    """The next managed watch: roots round-robin after root_cursor, in each the scope after its own cursor.

    budgets: root_id, scope_cursor, outstanding; a root with work outstanding waits.
    """
    due = of_active(watches.filter(managed() & is_due(now)), roots).join(budgets.filter("outstanding is null").select("root_id", "scope_cursor"), "root_id")
    one = after_cursor(due, "scope", F.col("scope_cursor"), ["root_id"]).drop("scope_cursor")
    return one.orderBy(F.when(F.col("root_id") > root_cursor, 0).otherwise(1), "root_id").limit(1)


def due_rolling(watches: DataFrame, roots: DataFrame, budgets: DataFrame, now: Column, root_cursor: str, limit: int) -> DataFrame:
    """Ordinary due watches with one managed watch put in after the first; `slot` numbers the result."""
    ordinary = of_active(watches.filter(~managed() & is_due(now)), roots).orderBy(*FIFO).limit(limit).withColumn("__p", F.row_number().over(Window.orderBy(*FIFO)) * 2)
    one = rolling_pick(watches, roots, budgets, now, root_cursor).withColumn("__p", F.lit(3))
    return ordinary.unionByName(one).orderBy("__p").limit(limit).withColumn("slot", F.row_number().over(Window.orderBy("__p"))).drop("__p")


def first_discovery(work: DataFrame, roots: DataFrame, adapters: DataFrame, inventory: DataFrame, now: Column, excluded: list[str] = (), limit: int = 1) -> DataFrame:
    """Never-verified recovery work of a directory that the inventory holds once and whose parent was verified.

    adapters: root_id, kind, base_path. At most two roots may be excluded; depth is at most eight.
    """
    if len(excluded) > 2:
        raise ValueError("at most two excluded roots")
    c = F.col
    base = adapters.filter(c("kind").isin("alist", "openlist")).select("root_id", "base_path")
    present = inventory.filter("presence = 'PRESENT'").groupBy("root_id", c("path").alias("at")).agg(F.count("*").alias("n"), F.bool_and(F.coalesce("is_dir", F.lit(False)) & (c("evidence") == "NONE")).alias("good")).filter("n = 1 and good").select("root_id", "at")
    parents = work.filter("verified_at is not null and error_class is null").filter(c("work_state").isin("VERIFIED", "PENDING", "IN_FLIGHT")).select("root_id", c("scope").alias("up"))
    w = of_active(work, roots).filter((c("work_state") == "PENDING") & (c("priority") == "NORMAL") & c("verified_at").isNull() & (c("attempts") == 0) & (c("scope") != "/") & F.array_contains("sources", "RECOVERY") & F.array_contains("reasons", "POSSIBLE_CHANGE"))
    w = w.filter(open_now(now)).filter(depth(c("scope")) <= 8)
    w = w.filter(~c("root_id").isin(*excluded)) if excluded else w
    w = w.join(base, "root_id").withColumn("up", parent_scope(c("scope"))).withColumn("at", under_base(c("base_path"), c("scope"))).join(parents, ["root_id", "up"], "left_semi").join(present, ["root_id", "at"], "left_semi")
    top = w.filter("up = '/'")
    nested = w.filter("up <> '/'").withColumn("at", under_base(c("base_path"), c("up"))).join(present, ["root_id", "at"], "left_semi")
    return top.unionByName(nested).drop("up", "at", "base_path").orderBy("first_seen", "root_id", "scope").limit(limit)


def maintenance_page(bindings: DataFrame, watches: DataFrame, cursor: tuple[str, str], limit: int) -> DataFrame:
    """Bindings after (root, scope), then from the start, at most `limit` (1 to 5); retired ones don't count."""
    if not 1 <= limit <= 5:
        raise ValueError("1 to 5 items")
    root, scope = cursor
    band = F.when((F.col("root_id") > root) | ((F.col("root_id") == root) & (F.col("scope") > scope)), 0).otherwise(1)
    return bindings.filter("lifecycle <> 'RETIRED'").join(watches.select("root_id", "scope", "version"), ["root_id", "scope"]).withColumn("band", band).orderBy("band", "root_id", "scope").limit(limit)


def bounded_sample(rows: DataFrame, limit: int, *order: str) -> tuple[DataFrame, bool]:
    """The first `limit` rows, and whether these are all."""
    more = stored(rows.orderBy(*order).limit(limit + 1), "sample")  # limit + 1 rows, read twice
    return more.orderBy(*order).limit(limit), more.count() <= limit
