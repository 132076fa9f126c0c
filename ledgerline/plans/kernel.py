"""The kernel's check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import apply, identity, reconcile
from ledgerline.plans.fixtures import NOW, fixture
from ledgerline.plans.kernel_sql import GRACE, HORIZON

CONFIG = reconcile.Config(removal_grace=GRACE, move_horizon=HORIZON)
ENTRY = ["root_id", "kind", "ordinal", "resource_id", "entry_id", "new_path", "reason"]


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf_dir, "inv_prior"), fixture(spark, sf_dir, "inv_entries")


def _transitions(spark: SparkSession, sf_dir: str, acceptance: str = "COMPLETE") -> DataFrame:
    prior, entries = _inputs(spark, sf_dir)
    return reconcile.reconcile(prior, entries, acceptance, CONFIG, F.lit(NOW), F.lit("s1"))


def k6_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, entries = _inputs(spark, sf_dir)
    return identity.resolve(prior, entries, F.lit(NOW), HORIZON).select("root_id", "entry_id", "path", "status", "reason", F.col("match.resource_id").alias("match_id"))


def k7_reconcile_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir)


def k7_reconcile_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir, "PARTIAL").select(*ENTRY)


def k9_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, entries = _inputs(spark, sf_dir)
    gone = reconcile.unobserved(prior, identity.resolve(prior, entries, F.lit(NOW), HORIZON))
    return reconcile.missing_transitions(gone, F.lit("s1"), F.lit(NOW), CONFIG).select("root_id", "resource_id", "kind", "reason", "missing_since", "consecutive", "missing_first", "missing_last")


def k10_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, entries = _inputs(spark, sf_dir)
    return reconcile.reconcile_directory(prior, entries, F.lit("/en"), CONFIG, F.lit(NOW), F.lit("s1")).select(*ENTRY)


def k11_removal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, entries = _inputs(spark, sf_dir)
    return reconcile.removal_context(prior, identity.resolve(prior, entries, F.lit(NOW), HORIZON))


def a6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.counts(_transitions(spark, sf_dir))


def _generation(t: DataFrame) -> DataFrame:
    return apply.generations(t.select("root_id").distinct().withColumn("generation", F.lit(7)), t)


def k12_journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transitions(spark, sf_dir)
    return apply.events(t, _generation(t), t.select("root_id").distinct().withColumn("event_seq", F.lit(100)))


def k13_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, entries = _inputs(spark, sf_dir)
    t = _transitions(spark, sf_dir)
    return apply.apply_transitions(prior, entries, t, _generation(t))


QUERIES = {f.__name__: f for f in (k6_resolve, k7_reconcile_complete, k7_reconcile_partial, k9_missing, k10_directory, k11_removal_context, a6_counts, k12_journal_events, k13_apply)}
