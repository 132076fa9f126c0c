"""The thin opN_ queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, load


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import urls

    return urls.judge(load(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import lm

    return lm.score(load(spark, sf_dir, "documents").select("doc_id", "text"), held_out=held_out("doc_id", 7, 2))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import decontaminate

    found = decontaminate.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import langid

    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out("doc_id", 4, 2)))
    return langid.identify(docs.withColumn("held_out", held_out("doc_id", 4, 2)), model, keep=["doc_id", "held_out"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import packing

    docs = load(spark, sf_dir, "documents").select("doc_id", packing.count_words("text").alias("n_tokens"))
    return packing.pack_documents(docs)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import simhash

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import quality

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, load(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1)))
    return quality.score(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model, keep=["doc_id", "held_out"])


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import vectors

    return vectors.near_duplicates(load(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import substrings

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import chat

    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(rows.unionByName(planted)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_chat_formatting": op10_chat_formatting,
}

OP4_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), paths AS (
  SELECT host, path, count(*) AS n FROM parts GROUP BY ALL
), ruled AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM paths JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
), urls AS (
  SELECT host, path, rule, verdict, CASE WHEN verdict = 'block' THEN n ELSE 0 END AS blocked, CASE WHEN verdict = 'allow' THEN n ELSE 0 END AS allowed, n,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS segs
  FROM paths LEFT JOIN ruled USING (host, path)
), l0 AS (
  SELECT *, '' AS template FROM urls
LEVELS
), shaped AS (
  SELECT host, path, rule, verdict, blocked, allowed, CASE template WHEN '' THEN '/' ELSE template END AS template FROM l8
), shares AS (
  SELECT host, template, (sum(blocked) + 1) / (sum(blocked) + sum(allowed) + 2) AS rejected_share FROM shaped GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN rejected_share >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, template, rejected_share
FROM parts JOIN shaped USING (host, path) JOIN shares USING (host, template)
"""

#: A level of the template tree: children of a node, the nodes, their children's names, paths with one more name.
_LEVEL = """), c{d} AS MATERIALIZED (
  SELECT host, template, {seg} AS seg, sum(n) AS n, sum(blocked) AS blocked, sum(allowed) AS allowed FROM l{p} WHERE len(segs) >= {d} GROUP BY ALL
), n{d} AS (
  SELECT host, template, count(*) AS kinds, sum(n) AS urls, sum(blocked) AS all_blocked, sum(blocked) + sum(allowed) AS all_labelled FROM c{d} GROUP BY ALL
), m{d} AS (
  SELECT host, template, seg, CASE
    WHEN kinds >= 8 AND urls < 3.0 * kinds THEN '*'
    WHEN blocked + allowed > 0 AND abs(blocked - (blocked + allowed) * (all_blocked / all_labelled)) <= 2.0 * sqrt((blocked + allowed) * (all_blocked / all_labelled) * (1 - all_blocked / all_labelled) + 0.25) THEN '~'
    ELSE seg END AS name
  FROM c{d} JOIN n{d} USING (host, template)
), l{d} AS MATERIALIZED (
  SELECT l{p}.* EXCLUDE (template), l{p}.template || coalesce('/' || name, '') AS template FROM l{p} LEFT JOIN m{d} ON l{p}.host = m{d}.host AND l{p}.template = m{d}.template AND len(segs) >= {d} AND {seg} = m{d}.seg"""
OP4_SQL = OP4_SQL.replace("LEVELS", "\n".join(_LEVEL.format(d=d, p=d - 1, seg="array_to_string(segs[8:], '/')" if d == 8 else f"segs[{d}]") for d in range(1, 9)))

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM d)
), late AS (
  SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late
), words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(8, len(w)) AS n FROM b WHERE len(w) > 0))
), sizes AS (
  SELECT DISTINCT n FROM phrases
), windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, s, n, item_id FROM windows JOIN phrases USING (n, k)
), hits AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST|ROLE|NAME|s)[\]>])', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '([\[<])(\\*)(/?(?:INST|ROLE|NAME|s)[\]>])', '\1\\\2\3', 'g')) AS r FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 7 ELSE n + r + 19 END)::BIGINT AS formatted_chars, 0::INTEGER AS rewrites
FROM e GROUP BY 1
"""

ORACLES: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op10_chat_formatting": OP10_SQL,
}
