"""URL filters: allow and block rules, and a path-template tree for the rest. DataFrame functions only.

Per host, paths form a tree of segments that is generalised from the top: at each level the children of a node are named,
and the level below is grouped by the names above it, so that what stands below a wildcard is one node. Variable segments
become wildcards: those with a digit, and all children of a node that has many different ones with few urls each. Children
of a node whose labelled block rates can't be told apart merge into one branch (a two-sided test against their pooled rate;
a child without labels never merges). A template is rejected when its labelled purity, smoothed by one url of either kind,
reaches `purity`.

Distinct (host, path) pairs are counted first, so a url in a third of all rows is one row of the tree; all counts are
partial aggregates, and joins carry no group as a whole. A level is a few joins, written to the shared folder; there are
as many as the longest path has, LEVELS at most: segments from the last level on count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks that a node's urls are dealt to; most levels of a template.
SALTS, LEVELS = 32, 8
#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null; of equally long ones the first."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def templates(urls: DataFrame, many: int = 8, few: float = 3.0, z: float = 2.0, levels: int = LEVELS) -> DataFrame:
    """urls (distinct host, path with label counts n, blocked and allowed) plus template.

    many, few: a node with at least `many` different children and under `few` urls a child has a wildcard child.
    """
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    lexical = F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x))
    rows = C.materialise(urls.select("host", "path", "n", "blocked", "allowed", F.lit("").alias("template")), "paths")
    deepest = rows.agg(F.max(F.size(segments))).first()[0] or 0
    key = ["host", "template"]
    for d in range(min(deepest, levels)):
        rest = F.when(F.size(lexical) > d, F.array_join(F.slice(lexical, d + 1, F.greatest(F.size(lexical), F.lit(1))), "/"))
        steps = rows.withColumn("seg", rest if d == levels - 1 else F.get(lexical, F.lit(d))).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
        children = steps.filter("seg is not null").groupBy(*key, "seg").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
        nodes = children.groupBy(*key).agg(
            F.count("*").alias("distinct"),
            F.sum("n").alias("urls"),
            F.sum("blocked").alias("all_blocked"),
            (F.sum("blocked") + F.sum("allowed")).alias("all_labelled"),
        )
        labelled, rate = F.col("blocked") + F.col("allowed"), F.col("all_blocked") / F.col("all_labelled")
        wild = (F.col("distinct") >= many) & (F.col("urls") < few * F.col("distinct"))
        alike = (labelled > 0) & (F.abs(F.col("blocked") - labelled * rate) <= z * F.sqrt(labelled * rate * (1 - rate) + 0.25))
        # one child may hold a third of all urls: its name goes to SALTS tasks
        named = children.join(nodes, key).select(*key, "seg", F.when(wild, "*").when(alike, "~").otherwise(F.col("seg")).alias("name"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        told = steps.join(named, [*key, "seg", "salt"], "left")
        rows = C.materialise(told.select("host", "path", "n", "blocked", "allowed", F.concat("template", F.coalesce(F.concat(F.lit("/"), "name"), F.lit(""))).alias("template")), "paths")
    return rows.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template")))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", purity: float = 0.8, label: Column | None = None, many: int = 8, few: float = 3.0, z: float = 2.0) -> DataFrame:
    """pages plus host, path, rule, verdict, template, rejected_share; columns of these names are replaced.

    The rule that fits decides; else the template does. label: a boolean column of pages, true for a url known bad, null
    for unknown; by default a fitting rule's verdict. Null urls have an empty host and path, which is a template too.
    """
    made = ["host", "path", "rule", "verdict", "template", "rejected_share"]
    url = F.col(f"`{url_col}`")
    kept = [c for c in pages.columns if c not in made]
    base = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(url).alias("host"), path_of(url).alias("path"), (F.lit(None).cast("boolean") if label is None else label).alias("__label"))
    base = base.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    known = F.coalesce("__label", F.col("__rule.verdict") == "block")
    urls = base.groupBy("host", "path").agg(F.count("*").alias("n"), F.count_if(known).alias("blocked"), F.count_if(~known).alias("allowed"))
    shaped = templates(urls, many, few, z)
    share = (F.sum("blocked") + 1) / (F.sum("blocked") + F.sum("allowed") + 2)
    # one template may hold a third of all urls: its one row of shares goes to SALTS tasks
    shares = shaped.groupBy("host", "template").agg(share.alias("rejected_share")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = shaped.select("host", "path", "n", "template", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")).join(shares, ["host", "template", "salt"]).drop("salt")
    total = shaped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return C.join_hot(base, told, ["host", "path"], total, "n").select(
        *[F.col(f"`{c}`") for c in kept],
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("rejected_share") >= purity, "block").otherwise("allow")).alias("verdict"),
        "template",
        "rejected_share",
    )
