"""Listings of file-like sources as snapshot entries, with the evidence that says how far they can be trusted."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.paths import dirname
from ledgerline.functions.values import blank

RCLONE = T.StructType(
    [
        T.StructField("Path", T.StringType()), T.StructField("Name", T.StringType()), T.StructField("Size", T.LongType()), T.StructField("MimeType", T.StringType()), T.StructField("ModTime", T.StringType()),
        T.StructField("IsDir", T.BooleanType()), T.StructField("ID", T.StringType()), T.StructField("Hashes", T.MapType(T.StringType(), T.StringType())),
    ]
)
ALIST_ITEM = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("is_dir", T.BooleanType()), T.StructField("modified", T.StringType()), T.StructField("hash_info", T.MapType(T.StringType(), T.StringType()))])
ALIST = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("message", T.StringType()), T.StructField("data", T.StructType([T.StructField("content", T.ArrayType(ALIST_ITEM)), T.StructField("total", T.LongType())]))])


def pick_hash(hashes: Column, preferred: list[str]) -> tuple[Column, Column]:
    """(hash, lower-case algorithm): the first preferred key that has a value, else the first key in order."""
    some = F.map_filter(hashes, lambda k, v: blank(v) != "")
    keys = F.map_keys(some)
    key = F.coalesce(*[F.when(F.array_contains(keys, k), F.lit(k)) for k in preferred], F.get(F.array_sort(keys), F.lit(0)))
    return F.element_at(some, key), F.lower(key)


def instant(text: Column) -> Column:
    """RFC 3339 text as microseconds, null where it isn't one."""
    return F.unix_micros(F.try_to_timestamp(text))


def rclone_entries(raw: DataFrame, *keep: str) -> DataFrame:
    """Entries of a recursive listing. A directory's size of zero or less is none, and it has no content type."""
    c = F.col
    path = F.concat(F.lit("/"), F.regexp_replace("Path", "^/+", ""))
    h, alg = pick_hash(c("Hashes"), ["SHA-1", "MD5"])
    known = blank(c("ID")) != ""
    return raw.select(
        *keep, dirname(path).alias("parent_ref"), c("Name").alias("name"), c("IsDir").alias("is_dir"), F.when(~(c("IsDir") & (c("Size") <= 0)), c("Size")).cast("long").alias("size"), instant(c("ModTime")).alias("mtime"), h.alias("hash"), alg.alias("alg"),
        F.when(known, c("ID")).alias("provider_id"), F.when(known, "rclone").alias("provider_scope"), F.when(~c("IsDir") & (blank(c("MimeType")) != ""), c("MimeType")).alias("content_type"),
    )


def read_rclone(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, evidence of one row) of listing files. Unreadable input is evidence of failure, not an error."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", T.ArrayType(RCLONE)).alias("rows"), F.from_json("value", "array<string>").alias("shape"))
    broken = parsed.filter("shape is null")
    evidence = broken.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, "FAILED").otherwise("SUCCESS").alias("traversal"), F.when(F.col("n") > 0, '{"message":"listing is not a JSON array"}').alias("error_summary"))
    return rclone_entries(parsed.select(F.explode("rows").alias("r")).select("r.*")), evidence


def alist_page(pages: DataFrame) -> DataFrame:
    """Entries of listing pages (scope, body as JSON): one row per name with the page's total, for checks and entries."""
    c = F.col
    p = pages.select("scope", F.from_json("body", ALIST).alias("p")).select("scope", "p.code", "p.data.total", F.explode_outer("p.data.content").alias("i"))
    h, alg = pick_hash(c("i.hash_info"), ["sha1", "SHA1", "md5", "MD5"])
    return p.select("scope", "code", "total", c("i.name").alias("name"), c("i.is_dir").alias("is_dir"), F.when(~c("i.is_dir"), c("i.size")).alias("size"), instant(c("i.modified")).alias("mtime"), h.alias("hash"), alg.alias("alg"))


def page_error(pages: DataFrame, most: int) -> DataFrame:
    """(scope, error): why a scoped listing can't be used, null if it can.

    Too many children, a count that differs from the declared total, bad or repeated names, or an error code.
    """
    c = F.col
    g = alist_page(pages).groupBy("scope").agg(F.max("code").alias("code"), F.max("total").alias("total"), F.count("name").alias("n"), F.countDistinct("name").alias("names"), F.bool_or(c("name").contains("/") | c("name").contains("\\") | c("name").isin("", ".", "..")).alias("bad"))
    error = F.when(c("code").isin(401, 403), "AUTH_OR_PERMISSION").when(c("code") == 429, "THROTTLED").when(c("code").isNull() | (c("code") != 200), "TRANSIENT_PROVIDER").when(c("n") > most, "SCOPE_TOO_LARGE").when((c("n") != F.coalesce("total", F.lit(0))) | (c("n") != c("names")) | F.coalesce("bad", F.lit(False)), "TRANSIENT_PROVIDER")
    return g.select("scope", error.alias("error"))


def scan_rclone(spark: SparkSession, remote: str, program: str = "rclone", timeout: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """(entries, evidence) of a recursive listing that the program makes. Its output goes to the shared folder; a program that
    can't run, fails or writes no listing is evidence of failure."""
    import subprocess

    from ledgerline.operators.ordered import shared_dir

    at = f"{shared_dir(spark)}/rclone-{uuid.uuid4().hex}.json"
    try:
        done = subprocess.run([program, "lsjson", "--recursive", "--hash", remote], capture_output=True, timeout=timeout)
        error = None if done.returncode == 0 else done.stderr.decode(errors="replace")[-500:] or f"exit status {done.returncode}"
        text = done.stdout
    except (OSError, subprocess.SubprocessError) as e:
        error, text = f"{type(e).__name__}: {program}", b""
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(b"[]" if error else text))
    out.close()
    rows, evidence = read_rclone(spark, at)
    return (rows, evidence) if error is None else (rows, evidence_row(spark, "FAILED", error))


def evidence_row(spark: SparkSession, traversal: str, error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(traversal, None if error is None else json.dumps({"message": error}))], "traversal string, error_summary string")


def collect(spark: SparkSession, kind: str, where, **options) -> tuple[DataFrame, DataFrame]:
    """(entries, evidence) of a source: `rclone` listing files, `rclone-live` remotes, or the address of an `alist` or
    `openlist` server with the options of alist.Provider and `top`."""
    if kind == "rclone":
        return read_rclone(spark, where)
    if kind == "rclone-live":
        return scan_rclone(spark, where, **options)
    if kind in ("alist", "openlist"):
        from ledgerline.sources import alist

        top = options.pop("top", "/")
        return alist.scan(spark, alist.Provider(where, **options), top)
    raise ValueError(f"unknown collector {kind}")


def walk(list_one, top: str = "/") -> tuple[list[dict], str | None]:
    """Breadth-first walk with a callable that lists one directory: (entries, error). Any failing page fails the walk.

    The callable returns dicts with name and is_dir; the provider's paging and truncation check are its own.
    """
    queue, seen, out = [top], {top}, []
    while queue:
        at = queue.pop(0)
        try:
            rows = list_one(at)
        except Exception as e:  # a provider may fail in any way
            return [], f"{at}: {e}"
        for r in rows:
            path = ("" if at == "/" else at) + "/" + r["name"]
            out.append({**r, "parent_ref": at, "path": path})
            if r["is_dir"] and path not in seen:
                seen.add(path)
                queue.append(path)
    return out, None


def paged(fetch, per_page: int) -> list[dict]:
    """All pages of fetch(page, per_page) -> (rows, total). Fewer or more rows than the total is an error."""
    rows, page = [], 1
    while True:
        got, total = fetch(page, per_page)
        rows += got
        if len(rows) >= total or not got:
            break
        page += 1
    if len(rows) != total:
        raise ValueError(f"listing has {len(rows)} of {total} rows")
    return rows
