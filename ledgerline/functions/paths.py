"""Path and scope expressions. All are Catalyst expressions; prefix tests never use LIKE, so % and _ are plain characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entry_path(parent: Column, name: Column) -> Column:
    """Canonical path of a listed entry; one trailing slash of the parent is dropped."""
    return F.when(parent.isNull() | parent.isin("", "/"), F.concat(F.lit("/"), name)).otherwise(F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"), name))


def dirname(path: Column) -> Column:
    """Directory of a clean path: `.` of an empty one, `/` at the top."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def basename(path: Column) -> Column:
    return F.when(path == "", ".").when(path == "/", "/").otherwise(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def parent_scope(scope: Column) -> Column:
    up = F.regexp_replace(scope, "/[^/]+$", "")
    return F.when(up == "", "/").otherwise(up)


def under_base(base: Column, scope: Column) -> Column:
    """Canonical path of a scope below an adapter's base path."""
    return F.concat(F.when(base == "/", "").otherwise(F.regexp_replace(base, "/+$", "")), scope)


def depth(scope: Column) -> Column:
    """Number of segments; an empty scope has none."""
    inner = F.regexp_replace(scope, "^/+|/+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/")))


def is_below(path: Column, top: Column) -> Column:
    return path.startswith(F.concat(top, F.lit("/")))


def normalise(path: Column) -> Column:
    """One leading slash, no empty and no `.` segment, no trailing slash."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), "/"))


def within(path: Column, root: Column) -> Column:
    """Whether a path without `..` lies at or below a root path."""
    p, r = normalise(path), normalise(root)
    return ~F.array_contains(F.split(path, "/"), "..") & ((r == "/") | (p == r) | is_below(p, r))


def valid_scope(scope: Column) -> Column:
    """`/`, or an absolute path of clean segments without a trailing slash or a backslash."""
    return F.coalesce((scope == "/") | (scope.rlike(r"\A(/[^/\\]+)+\z") & F.forall(F.split(F.substr(scope, F.lit(2)), "/"), lambda s: ~s.isin(".", ".."))), F.lit(False))


def ancestors(path: Column) -> Column:
    """All proper ancestors of an absolute path but the top, nearest last; makes a prefix join an equi-join."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))
