"""The read API: nine fixed reads over roots, inventory and journal."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEW = ["resource_id", "root_id", "path", "is_dir", "size", "mtime", "hash", "content_type", "presence", "confirmed_generation"]
DEFAULT_LIMIT = 100


def page_limit(limit: int | None) -> int:
    return limit if limit and limit > 0 else DEFAULT_LIMIT


def visible(deprecated: bool = False, deleted: bool = False) -> Column:
    """NEW and ACTIVE roots; deprecated and deleted ones only when asked for, each on its own."""
    states = ["NEW", "ACTIVE", *["DEPRECATED"] * deprecated, *["DELETED"] * deleted]
    return F.col("lifecycle").isin(*states)


def get_root(roots: DataFrame, root_id: str, **opts: bool) -> DataFrame:
    return roots.filter(F.col("root_id") == root_id).filter(visible(**opts))


def list_roots(roots: DataFrame, **opts: bool) -> DataFrame:
    return roots.filter(visible(**opts)).orderBy("created_at", "root_id")


def _of_visible(inventory: DataFrame, roots: DataFrame, **opts: bool) -> DataFrame:
    return inventory.join(roots.filter(visible(**opts)).select("root_id"), "root_id", "left_semi")


def get_resource(inventory: DataFrame, roots: DataFrame, resource_id: str, removed: bool = False, **opts: bool) -> DataFrame:
    rows = inventory.filter(F.col("resource_id") == resource_id)
    return _of_visible(rows if removed else rows.filter("presence = 'PRESENT'"), roots, **opts).select(*VIEW)


def list_children(inventory: DataFrame, roots: DataFrame, root_id: str, parent_id: str | None, removed: bool = False, **opts: bool) -> DataFrame:
    """Children of a resource, or the top level of a root. Page the result with `page`."""
    parent = F.col("parent_resource_id")
    rows = inventory.filter((F.col("root_id") == root_id) & (parent.isNull() if parent_id is None else parent == parent_id))
    return _of_visible(rows if removed else rows.filter("presence = 'PRESENT'"), roots, **opts)


def resolve_path(inventory: DataFrame, roots: DataFrame, root_id: str, path: str, removed: bool = False, **opts: bool) -> DataFrame:
    """All rows at a path, present ones first, each with whether there are several."""
    rows = _of_visible(inventory.filter((F.col("root_id") == root_id) & (F.col("path") == path)), roots, **opts)
    rows = rows if removed else rows.filter("presence = 'PRESENT'")
    several = F.count("*").over(Window.partitionBy("root_id", "path")) > 1  # rows of one path
    return rows.select(*VIEW, several.alias("ambiguous")).orderBy(F.when(F.col("presence") == "PRESENT", 0).otherwise(1), "resource_id")


def json_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON text a row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("body"))


def parameter(value: str | None, default: int = 0) -> int:
    """A number of a request: digits, else the default."""
    return int(value) if value is not None and value.isascii() and value.isdigit() else default


def switch(value: str | None) -> bool:
    """A flag of a request: 1 or true."""
    return value in ("1", "true")


def ambiguous_paths(inventory: DataFrame) -> DataFrame:
    """(root_id, path, n) of paths with several present rows."""
    return inventory.filter("presence = 'PRESENT'").groupBy("root_id", "path").agg(F.count("*").alias("n")).filter("n > 1")


def active(inventory: DataFrame, roots: DataFrame, root_id: str | None = None) -> DataFrame:
    rows = inventory.filter("presence = 'PRESENT'")
    return _of_visible(rows if root_id is None else rows.filter(F.col("root_id") == root_id), roots)


def removed(inventory: DataFrame, roots: DataFrame, root_id: str | None = None) -> DataFrame:
    """Removed resources, those of deprecated and deleted roots too."""
    rows = inventory.filter("presence = 'REMOVED'")
    return _of_visible(rows if root_id is None else rows.filter(F.col("root_id") == root_id), roots, deprecated=True, deleted=True)


class StaleCursor(ValueError):
    """The root has moved to another generation, or the cursor is another root's."""


def encode_cursor(root_id: str, generation: int, path: str, resource_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([root_id, generation, path, resource_id]).encode()).decode().rstrip("=")


def decode_cursor(token: str) -> tuple[str, int, str, str]:
    try:
        root, generation, path, rid = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except (ValueError, TypeError) as e:
        raise StaleCursor("not a cursor") from e
    return root, generation, path, rid


def page(rows: DataFrame, root_id: str, generation: int, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """The next `limit` rows by (path, resource_id), in byte order, after the cursor. A null path counts as empty.

    A limit is the feature here: it becomes a distributed top-k, never a full sort.
    """
    path = F.coalesce("path", F.lit(""))
    if cursor is not None:
        root, bound, after, rid = decode_cursor(cursor)
        if (root, bound) != (root_id, generation):
            raise StaleCursor("the listing has changed")
        rows = rows.filter((path > after) | ((path == after) & (F.col("resource_id") > rid)))
    return rows.filter(F.col("root_id") == root_id).orderBy(path, "resource_id").limit(page_limit(limit))


def pages(rows: DataFrame, root_id: str, generation: int, limit: int | None = None):
    """All pages of one version, in order, as (rows, next cursor): one distributed sort, then partition by partition.

    The same pages as repeated calls of `page`, for a consumer that wants them all; the driver holds one page and one
    partition at a time.
    """
    path = F.coalesce("path", F.lit(""))
    held = []
    for row in rows.filter(F.col("root_id") == root_id).orderBy(path, "resource_id").toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == page_limit(limit):
            yield held, next_cursor(held, root_id, generation, limit)
            held = []
    yield held, None


def next_cursor(rows: list, root_id: str, generation: int, limit: int | None = None) -> str | None:
    """A full page has a next one, which may be empty."""
    if len(rows) < page_limit(limit):
        return None
    return encode_cursor(root_id, generation, rows[-1]["path"] or "", rows[-1]["resource_id"])


def read_journal(journal: DataFrame, root_id: str, after: int, limit: int) -> DataFrame:
    return journal.filter((F.col("root_id") == root_id) & (F.col("event_seq") > after)).orderBy("event_seq").limit(page_limit(limit))


def root_status(roots: DataFrame, admissions: DataFrame) -> DataFrame:
    """Each root with its highest applied admission, null if none."""
    top = admissions.filter("status = 'APPLIED'").groupBy("root_id").agg(F.max("seq").alias("applied_seq"))
    return roots.join(top, "root_id", "left")
