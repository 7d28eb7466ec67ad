"""Filters, picks and pages that several parts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The closed set of event types.
EVENT_TYPES = (
    "user.registered", "user.invited", "auth.login", "auth.logout", "auth.token_expired", "platform.started", "platform.migration_applied",
    "run.queued", "run.started", "run.step.started", "run.step.succeeded", "run.step.failed", "run.step.retry_scheduled", "run.succeeded", "run.failed", "run.canceled",
    "schedule.fired", "schedule.missed", "schedule.paused", "schedule.resumed",
    "sensor.evaluated", "sensor.fired", "sensor.evaluation_failed", "sensor.disabled", "sensor.cooldown_skipped", "sensor.dedup_skipped",
    "backfill.submitted", "backfill.run_enqueued", "backfill.completed",
    "lineage.captured", "lineage.drift_detected",
    "schema.captured", "schema.unchanged", "schema.change_detected", "schema.capture_failed", "schema.break_acknowledged",
    "metadata.updated",
    "quality.rule_passed", "quality.rule_failed", "quality.rule_error", "quality.run_evaluated",
    "sla.breached", "sla.recovered",
    "notification.dispatched", "notification.dispatch_failed",
    "governance.materialization_blocked", "governance.reviewer_reassigned",
)


def where_opt(df: DataFrame, contains: dict[str, object] | None = None, **equals: object) -> DataFrame:
    """Keeps rows that equal every argument that is given; `contains` asks array columns."""
    for name, value in equals.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    for name, value in (contains or {}).items():
        if value not in (None, ""):
            df = df.filter(F.array_contains(name, value))
    return df


def split_valid_events(df: DataFrame, types: tuple[str, ...] = EVENT_TYPES) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): known type, and resource type and id that are not empty."""
    ok = F.coalesce(F.col("event_type").isin(*types) & (F.length("resource_type") > 0) & (F.length("resource_id") > 0), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def latest(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The newest row of each key by the order columns; an aggregate, so it combines before the shuffle."""
    keys, by = [key] if isinstance(key, str) else key, [order] if isinstance(order, str) else order
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*by)).alias("__row")).select("__row.*")


def consecutive(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `previous`, the order value of the key's row before; null for the first."""
    return df.withColumn("previous", F.lag(order).over(Window.partitionBy(key).orderBy(order)))


def queue_order(runs: DataFrame, k: int) -> DataFrame:
    """The next k queued runs: critical, then normal and unknown, then backfill; oldest first."""
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "backfill", 2).otherwise(1)
    return runs.filter(F.col("state") == "queued").orderBy(rank, "queued_at", "run_id").limit(k)


def page(df: DataFrame, order: list[Column | str], size: int, number: int) -> DataFrame:
    """Page `number` (from 0) in an order that has to end in a unique column."""
    return df.orderBy(*order).offset(size * number).limit(size)


def with_total(df: DataFrame) -> tuple[DataFrame, int]:
    return df, df.count()


def facets(versions: DataFrame) -> DataFrame:
    """facet, value: distinct tags and owners that are not empty, in order."""
    tags = versions.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value"))
    owners = versions.select(F.lit("owner").alias("facet"), F.col("owner").alias("value"))
    return tags.unionByName(owners).filter(F.length("value") > 0).distinct().orderBy("facet", "value")


def rule_history(results: DataFrame, runs: DataFrame, asset: str, rule: str, n: int = 50) -> DataFrame:
    """The last n results of an asset's rule, newest first."""
    hit = results.filter(F.col("rule_name") == rule).join(runs.filter(F.col("asset_name") == asset).select("run_id"), "run_id")
    return hit.orderBy(F.desc("evaluated_at"), F.desc("run_id")).limit(n)


def rule_histories(results: DataFrame, runs: DataFrame, n: int = 50) -> DataFrame:
    """The same for all assets and rules at once."""
    newest = Window.partitionBy("asset_name", "rule_name").orderBy(F.desc("evaluated_at"), F.desc("run_id"))
    return results.join(runs.select("run_id", "asset_name"), "run_id").withColumn("at", F.row_number().over(newest)).filter(F.col("at") <= n)


def resource_usage(tokens: DataFrame, capacities: DataFrame) -> DataFrame:
    """tag, used, capacity, free: weights of the tokens in use against each tag's capacity."""
    used = tokens.groupBy("tag").agg(F.sum("weight").alias("used"))
    return capacities.join(used, "tag", "left").select("tag", F.coalesce("used", F.lit(0)).alias("used"), "capacity", (F.col("capacity") - F.coalesce("used", F.lit(0))).alias("free"))
