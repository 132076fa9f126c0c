"""Structured Streaming forms: signal coalescing per scope, and journal tailing.

Both keep Spark's checkpoint as their cursor, so a restart goes on where it stopped; the batch fold of the same rows gives
the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ledgerline.operators.work import coalesce_signals

SIGNAL = T.StructType(
    [
        T.StructField("root_id", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("source", T.StringType()), T.StructField("reason", T.StringType()),
        T.StructField("priority", T.StringType()), T.StructField("seen_at", T.LongType()), T.StructField("not_before", T.LongType()),
    ]
)

# Reasons that a mutation hint may give; none means the first.
HINT_REASONS = ("POSSIBLE_CHANGE", "DELETE_HINT", "MOVE_UNCERTAIN", "METADATA_UNCERTAIN")


def hints(raw: DataFrame) -> DataFrame:
    """Mutation hints (root_id, scope, reason, seen_at) as signals; unknown reasons are dropped."""
    reason = F.when(F.coalesce("reason", F.lit("")) == "", HINT_REASONS[0]).otherwise(F.col("reason"))
    return raw.withColumn("reason", reason).filter(F.col("reason").isin(*HINT_REASONS)).select("root_id", "scope", F.lit("MUTATION_HINT").alias("source"), "reason", F.lit("HIGH").alias("priority"), "seen_at", F.lit(None).cast("long").alias("not_before"))


def signal_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def coalesced_stream(signals: DataFrame) -> DataFrame:
    """Running pending buckets, in complete or update mode: the batch fold with its state kept by Spark per (root, scope)."""
    return coalesce_signals(signals)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process all that is there now and stop. The sink gets each micro-batch once per id; it should replace by id."""
    return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail_journal(spark: SparkSession, path: str, schema: T.StructType, after: dict[str, int] | None = None) -> DataFrame:
    """Journal events as a stream; `after` is a consumer's cursor vector, last number seen per root. No order across roots."""
    rows = spark.readStream.schema(schema).parquet(path)
    if not after:
        return rows
    cursor = F.create_map(*[x for k, v in after.items() for x in (F.lit(k), F.lit(v))])
    return rows.filter(F.col("event_seq") > F.coalesce(F.element_at(cursor, F.col("root_id")), F.lit(0)))


def advance(after: dict[str, int], batch: DataFrame) -> dict[str, int]:
    """The cursor vector after a micro-batch: one row per root."""
    return after | {r[0]: r[1] for r in batch.groupBy("root_id").agg(F.max("event_seq")).collect()}
