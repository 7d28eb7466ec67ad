"""Runs, partitions, backfills and triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, DAY, MONTH, WEEK, partition_key, valid_category_key

MOST_KEYS = 3_650
STALE_SECONDS = 300
UNITS = {DAY: "day", WEEK: "week", MONTH: "month"}
LEAST_INTERVAL = 30
# The transitions a run may take.
TRANSITIONS = (("queued", "starting"), ("queued", "canceled"), ("starting", "running"), ("starting", "failed"), ("starting", "canceled"), ("running", "succeeded"), ("running", "failed"), ("running", "canceled"))
RESETS = (("starting", "queued"), ("running", "queued"))


def _dates(start: Column, end: Column, strategy: str) -> Column:
    """First days of the periods from the one of start to the one of end."""
    steps = {DAY: "interval 1 day", WEEK: "interval 7 days", MONTH: "interval 1 month"}
    first = {DAY: start, WEEK: F.trunc(start, "week"), MONTH: F.trunc(start, "month")}[strategy]
    return F.when(start <= end, F.sequence(first, end, F.expr(steps[strategy])))


def keys_between(df: DataFrame, start: str, end: str, strategy: str) -> DataFrame:
    """df with a row for each partition key between two dates (columns), both included; an inverted range is an error."""
    if strategy == CATEGORY:
        raise ValueError("categories have no order")
    checked = F.when(F.col(start) > F.col(end), F.raise_error(F.lit("inverted range"))).otherwise(F.col(start))
    return df.withColumn("day", F.explode(_dates(checked.cast("date"), F.col(end).cast("date"), strategy))).withColumn("partition_key", partition_key(F.col("day"), strategy)).drop("day")


def expand_specs(specs: DataFrame, most: int = MOST_KEYS) -> tuple[DataFrame, DataFrame]:
    """(backfill_id, asset, partition_key; backfill_id, error) of specs (backfill_id, asset, spec, strategy, categories).

    A spec is a:b (dates of a calendar strategy), a list a,b or one key.  Listed keys have to fit the
    strategy, categories have to be declared.
    """
    ranged = F.col("spec").contains(":") & (F.col("strategy") != CATEGORY)
    a, b = (F.try_to_date(F.get(F.split("spec", ":"), F.lit(i)), "yyyy-MM-dd") for i in range(2))
    days = F.when(F.col("strategy") == DAY, F.transform(_dates(a, b, DAY), lambda d: partition_key(d, DAY))).when(F.col("strategy") == WEEK, F.transform(_dates(a, b, WEEK), lambda d: partition_key(d, WEEK))).otherwise(F.transform(_dates(a, b, MONTH), lambda d: partition_key(d, MONTH)))
    listed = F.array_distinct(F.filter(F.transform(F.split("spec", ","), lambda k: F.trim(k)), lambda k: k != ""))
    shape = F.when(F.col("strategy") == DAY, r"^\d{4}-\d{2}-\d{2}$").when(F.col("strategy") == WEEK, r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$").when(F.col("strategy") == MONTH, r"^\d{4}-(0[1-9]|1[0-2])$")
    keys = F.when(ranged, days).otherwise(listed)
    odd = F.when(F.col("strategy") == CATEGORY, F.size(F.array_except(listed, F.coalesce("categories", F.array().cast("array<string>")))) > 0).when(~ranged, F.exists(listed, lambda k: ~F.regexp(k, F.col("__shape"))))
    error = (
        F.when(ranged & (a.isNull() | b.isNull()), "bad date").when(ranged & (a > b), "inverted range").when(F.size("__keys") < 1, "no keys")
        .when(odd & (F.col("strategy") == CATEGORY), "undeclared category").when(odd, "bad key").when(F.size("__keys") > most, "too many keys")
    )
    whole = specs.withColumns({"__keys": keys, "__shape": shape}).withColumn("__error", error)
    good = whole.filter("__error is null").select("backfill_id", "asset", F.explode("__keys").alias("partition_key"))
    return good, whole.filter("__error is not null").select("backfill_id", F.col("__error").alias("error"))


def valid_categories(keys: DataFrame) -> DataFrame:
    return keys.filter(valid_category_key(F.col("partition_key")))


def plan_backfill(keys: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys to enqueue, enqueued and skipped counts by backfill): keys (backfill_id, asset, partition_key) with a run in flight are skipped."""
    busy = runs.filter(F.col("state").isin("queued", "starting", "running")).select("asset", "partition_key").distinct()
    once = keys.dropDuplicates(["backfill_id", "asset", "partition_key"])
    marked = once.join(busy.withColumn("busy", F.lit(True)), ["asset", "partition_key"], "left")
    counts = marked.groupBy("backfill_id").agg(F.count_if(F.col("busy").isNull()).alias("enqueued"), F.count_if(F.col("busy").isNotNull()).alias("skipped"))
    return marked.filter(F.col("busy").isNull()).select(*keys.columns), counts


def backfill_status(runs: DataFrame) -> DataFrame:
    """backfill_id, state, n"""
    return runs.filter(F.col("backfill_id").isNotNull()).groupBy("backfill_id", "state").agg(F.count(F.lit(1)).alias("n"))


def missed_fires(schedules: DataFrame, now: Column) -> DataFrame:
    """schedule_id, fire_at, missed of schedules (cadence_seconds, next_fire_at): the latest window up to now fires, those before it were missed."""
    behind = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("next_fire_at").cast("timestamp"))) / F.col("cadence_seconds"))
    due = schedules.filter(F.col("next_fire_at") <= now).withColumn("missed", behind.cast("long"))
    return due.select("schedule_id", F.timestamp_add("SECOND", (F.col("missed") * F.col("cadence_seconds")).cast("int"), F.col("next_fire_at")).alias("fire_at"), "missed")


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.filter((F.col("next_fire_at") <= now) & ~F.col("paused")).orderBy("next_fire_at", "schedule_id")


def stale_runs(runs: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """Runs that started and have not been heard of for longer, put back into the queue with a note."""
    silent = F.timestamp_add("SECOND", F.lit(stale_seconds), F.col("heartbeat_at")) < now
    hit = runs.filter(F.col("state").isin("starting", "running") & silent)
    return hit.withColumns({"was": F.col("state"), "state": F.lit("queued"), "note": F.concat(F.lit("re-queued: no heartbeat for "), F.lit(str(stale_seconds)), F.lit(" s"))})


def runs_with_steps(runs: DataFrame, steps: DataFrame, size: int, number: int = 0) -> DataFrame:
    """A page of runs, newest first, each with its steps in order; the page is cut before the join."""
    page = runs.orderBy(F.desc("queued_at"), F.desc("run_id")).offset(size * number).limit(size)
    nested = steps.join(page.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("topo_order", "asset", "state"))).alias("steps"))
    return page.join(nested, "run_id", "left")


def illegal_transitions(history: DataFrame, resets: bool = False) -> DataFrame:
    """run_id, before, after, changed_at of state changes (run_id, state, changed_at) that a run may not take."""
    pairs = history.sparkSession.createDataFrame([*TRANSITIONS, *(RESETS if resets else ())], "before string, after string")
    steps = history.withColumn("before", F.lag("state").over(Window.partitionBy("run_id").orderBy("changed_at", "event_id"))).filter("before is not null").withColumnRenamed("state", "after")
    return steps.join(F.broadcast(pairs), ["before", "after"], "left_anti").select("run_id", "before", "after", "changed_at")


def gate(definitions: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(may run, blocked): definitions (asset, code_hash) whose version is active."""
    ok = versions.filter(F.col("governance_state") == "active").select("asset", "code_hash")
    return definitions.join(ok, ["asset", "code_hash"], "left_semi"), definitions.join(ok, ["asset", "code_hash"], "left_anti")


def sync_triggers(current: DataFrame, declared: DataFrame, now: Column) -> DataFrame:
    """(asset, name, interval_seconds, updated_at) after a declaration: new ones come in, changed intervals (30 s at least) are taken, none is deleted."""
    want = declared.select("asset", "name", F.greatest(F.coalesce("interval_seconds", F.lit(LEAST_INTERVAL)), F.lit(LEAST_INTERVAL)).alias("wanted"))
    both = current.join(want, ["asset", "name"], "full_outer")
    changes = F.col("wanted").isNotNull() & ~F.col("wanted").eqNullSafe(F.col("interval_seconds"))
    return both.select("asset", "name", F.coalesce("wanted", "interval_seconds").alias("interval_seconds"), F.when(changes, now).otherwise(F.col("updated_at")).alias("updated_at"))
