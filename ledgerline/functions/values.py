"""Value rules shared by the kernel: which nulls are equal, ranks, defaults, digests, back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed sets of the data model, in their defined order.
PRIORITY_RANK = {"URGENT": 4, "HIGH": 3, "NORMAL": 2, "LOW": 1}
ERROR_STATE = {
    "TRANSIENT_PROVIDER": "RETRY_WAIT",
    "THROTTLED": "RETRY_WAIT",
    "INTERNAL": "RETRY_WAIT",
    "AUTH_OR_PERMISSION": "BLOCKED",
    "SCOPE_TOO_LARGE": "BLOCKED",
    "INVALID_SCOPE": "BLOCKED",
    "CONFIG_INVALID": "BLOCKED",
    "ROOT_INACTIVE": "SUSPENDED",
}
FRESH = ("FRESH_DIRECT", "FRESH_REFRESHED", "CACHED_FRESH")
MISSING_STATES = ("MISSING_CONFIRMED_BY_COMPLETE_SNAPSHOT", "REMOVAL_CANDIDATE")
STABLE = "STABLE_WITHIN_SCOPE"


def blank(x: Column) -> Column:
    """Null as the empty string: hashes, algorithms and content types compare like this."""
    return F.coalesce(x, F.lit(""))


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals nothing: sizes and times compare like this."""
    return F.coalesce(a == b, F.lit(False))


def comparable_hash(h: Column, alg: Column) -> Column:
    return (blank(h) != "") & (blank(alg) != "")


def hashes_agree(h1: Column, a1: Column, h2: Column, a2: Column) -> Column:
    return (blank(h1) != "") & (blank(h1) == blank(h2)) & (blank(a1) == blank(a2))


def lookup(x: Column, table: dict, other=None) -> Column:
    out = F.lit(None)
    first = True
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)) if first else out.when(x == k, F.lit(v))
        first = False
    return out if other is None else out.otherwise(F.lit(other))


def priority_rank(p: Column) -> Column:
    return lookup(p, PRIORITY_RANK, 0)


def error_state(error: Column) -> Column:
    """Work state that a failure of this class leads to; an unknown class blocks."""
    return lookup(error, ERROR_STATE, "BLOCKED")


def defaulted(x: Column, value: str) -> Column:
    return F.when(blank(x) == "", value).otherwise(x)


def skipped_form(skipped: Column, known_empty: Column) -> Column:
    """Canonical form of the skip evidence; an empty list counts as none."""
    return F.when(known_empty, "CONFIRMED_EMPTY").when(blank(skipped).isin("", "[]"), "UNKNOWN").otherwise(skipped)


def backoff(failures: Column, base_ms: int, most_ms: int, retry_after_ms: Column | None = None) -> Column:
    """Doubling per failure up to a bound; a provider's own wait is never shortened."""
    wait = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(40))), F.lit(float(most_ms))).cast("long")
    return wait if retry_after_ms is None else F.greatest(wait, F.coalesce(retry_after_ms, F.lit(0)))


def budget_group(url: Column) -> Column:
    """scheme://host:port, lower-cased, the scheme's usual port left out."""
    scheme, host, port = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, "://([^/?#:]*)", 1)), F.regexp_extract(url, "://[^/?#:]*:([0-9]+)", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat(scheme, F.lit("://"), host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))


def admission_spacing(spacing_ms: int, share_percent: Column) -> Column:
    """Time between admissions of a background share of a request budget."""
    return F.lit(spacing_ms * 8 * 100) / share_percent
