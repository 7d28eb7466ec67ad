"""Quality rules that fuse into one scan, their results, trends, alerts, and freshness."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSED, FAILED, ERROR, SKIPPED = "passed", "failed", "error", "skipped"


@dataclass(frozen=True)
class NullCheck:
    """Fails above max_rate of nulls; an empty table has rate 0."""

    column: str
    max_rate: float = 0.0
    kind: str = "null_check"

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}"

    def aggregates(self) -> list[Column]:
        return [F.count_if(F.col(self.column).isNull()), F.count(F.lit(1))]

    def verdict(self, got: list[Column]) -> tuple[Column, Column, Column]:
        rate = F.when(got[1] == 0, 0.0).otherwise(got[0] / got[1])
        return F.when(rate > self.max_rate, FAILED).otherwise(PASSED), rate, F.lit(float(self.max_rate))


@dataclass(frozen=True)
class RangeCheck:
    """Fails if the smallest value is under low, else if the largest is over high; no values count as 0, and values that are no numbers are an error."""

    column: str
    low: float
    high: float
    kind: str = "range_check"

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}"

    def aggregates(self) -> list[Column]:
        number = F.col(self.column).try_cast("double")
        return [F.coalesce(F.min(number), F.lit(0.0)), F.coalesce(F.max(number), F.lit(0.0)), F.count_if(F.col(self.column).isNotNull() & number.isNull())]

    def verdict(self, got: list[Column]) -> tuple[Column, Column, Column]:
        low, high, odd = got
        under, over = low < self.low, high > self.high
        measured, threshold = F.when(under, low).otherwise(high), F.when(under, float(self.low)).otherwise(float(self.high))
        return F.when(odd > 0, ERROR).when(under | over, FAILED).otherwise(PASSED), F.when(odd == 0, measured), F.when(odd == 0, threshold)

    def error(self, got: list[Column]) -> Column:
        return F.when(got[2] > 0, F.concat(got[2].cast("string"), F.lit(f" values of {self.column} are no numbers")))


def equals_zero(value: Column) -> Column:
    return value == 0


def less_than(bound: float) -> Callable[[Column], Column]:
    return lambda value: value < bound


row_count_zero = equals_zero


@dataclass(frozen=True)
class SQLAssertion:
    """First column of the first row of a query over ${asset} against a predicate; null counts as 0, text fails without a measure."""

    name: str
    sql: str
    predicate: Callable[[Column], Column] | None
    kind: str = "sql_assertion"

    def result(self, df: DataFrame) -> DataFrame:
        if self.predicate is None:
            raise ValueError("an assertion needs a predicate")
        out = df.sparkSession.sql(self.sql.replace("${asset}", "{asset}"), asset=df).limit(1)
        first = out.columns[0]
        text = dict(out.dtypes)[first] == "string"
        value = F.lit(None).cast("double") if text else F.coalesce(F.col(first).cast("double"), F.lit(0.0))
        ok = F.lit(False) if text else self.predicate(value)
        status = F.when(F.count(F.lit(1)) == 0, ERROR).when(F.bool_and(ok), PASSED).otherwise(FAILED)
        return out.agg(status.alias("status"), F.max(value).alias("measured_value"), F.lit(None).cast("double").alias("threshold"))


RESULT = "run_id string, rule_name string, rule_type string, status string, measured_value double, threshold double, error string"


def _fused(df: DataFrame, rules: list, keys: list[str]) -> DataFrame:
    """One aggregate for all rules, then a row a rule."""
    wanted = [(r, [f"__{i}_{j}" for j in range(len(r.aggregates()))]) for i, r in enumerate(rules)]
    columns = [c.alias(n) for r, names in wanted for c, n in zip(r.aggregates(), names, strict=True)]
    grouped = df.groupBy(*keys).agg(*columns)
    rows = []
    for r, names in wanted:
        got = [F.col(n) for n in names]
        status, measured, threshold = r.verdict(got)
        error = r.error(got) if hasattr(r, "error") else F.lit(None)
        rows.append(F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.kind).alias("rule_type"), status.alias("status"), measured.cast("double").alias("measured_value"), threshold.cast("double").alias("threshold"), error.cast("string").alias("error")))
    return grouped.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


# what a rule itself can get wrong; a lost connection or an aborted job is none of these, and goes on to the caller
RULE_ERRORS = (PySparkException, ValueError, TypeError, KeyError, AttributeError)


def _failed(run_id: str, rule, e: Exception) -> tuple:
    return (run_id, rule.name, rule.kind, ERROR, None, None, str(e).splitlines()[0] if str(e) else type(e).__name__)


def _run_together(df: DataFrame, rules: list, run_id: str) -> list[tuple]:
    """Rows of aggregating rules from one scan; if that fails, of each half by itself, so a rule that fails on data costs a few scans more and no other rule its result."""
    if not rules:
        return []
    try:
        return [(run_id, *r) for r in _fused(df, rules, []).collect()]
    except RULE_ERRORS as e:
        if len(rules) == 1:
            return [_failed(run_id, rules[0], e)]
        half = len(rules) // 2
        return _run_together(df, rules[:half], run_id) + _run_together(df, rules[half:], run_id)


def evaluate(df: DataFrame, rules: list, run_id: str) -> DataFrame:
    """A result row for each rule.

    Null and range checks share one scan, which runs when the result is read; they cannot fail on data.
    Aggregating rules of a caller's own share one scan that is run here, as they may fail, and each assertion is a query of its own.  A rule
    that cannot be analysed or fails at run time gives a row with its error, and the others are not touched by it.
    """
    spark, fit, own, rows = df.sparkSession, [], [], []
    for rule in rules:
        try:
            if hasattr(rule, "aggregates"):
                _fused(df, [rule], [])  # is analysed, not run
                (fit if isinstance(rule, (NullCheck, RangeCheck)) else own).append(rule)
            else:
                rows.append((run_id, rule.name, rule.kind, *rule.result(df).select("status", "measured_value", "threshold").first(), None))
        except RULE_ERRORS as e:
            rows.append(_failed(run_id, rule, e))
    rows += _run_together(df, own, run_id)
    known = spark.createDataFrame(rows, RESULT)
    if not fit:
        return known
    fused = _fused(df, fit, []).select(F.lit(run_id).alias("run_id"), "*")
    return fused.unionByName(known) if rows else fused


def evaluate_by(df: DataFrame, rules: list, keys: list[str]) -> DataFrame:
    """The aggregating rules for each group of keys, still in one scan."""
    return _fused(df, rules, keys)


def overall(results: DataFrame) -> DataFrame:
    """status: the worst of all results, skipped without any."""
    worst = F.when(F.count_if(F.col("status") == ERROR) > 0, ERROR).when(F.count_if(F.col("status") == FAILED) > 0, FAILED).when(F.count(F.lit(1)) > 0, PASSED).otherwise(SKIPPED)
    return results.agg(worst.alias("status"))


def quality_trend(runs: DataFrame, results: DataFrame, asset: str, n: int = 30) -> DataFrame:
    """run_id, finished_at, score of the asset's last n (at most 100) finished runs: percentage of rules passed, 100 without rules."""
    done = runs.filter((F.col("asset_name") == asset) & F.col("finished_at").isNotNull()).orderBy(F.desc("finished_at"), F.desc("run_id")).limit(min(n, 100))
    passed = results.groupBy("run_id").agg(F.count_if(F.col("status") == PASSED).alias("passed"), F.count(F.lit(1)).alias("total"))
    score = F.when(F.col("total").isNull(), 100.0).otherwise(100.0 * F.col("passed") / F.col("total"))
    return done.join(passed, "run_id", "left").select("run_id", "finished_at", score.alias("score"))


def mean_score(trend: DataFrame) -> DataFrame:
    return trend.agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("runs"))


def alerts(results: DataFrame, runs: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """run_id, asset_name, rule_name, severity of results that failed and were not acknowledged."""
    bad = results.filter(F.col("status").isin(FAILED, ERROR)).join(runs.select("run_id", "asset_name"), "run_id")
    if acks is not None:
        bad = bad.join(acks, ["run_id", "rule_name"], "left_anti")
    return bad.select("run_id", "asset_name", "rule_name", F.when(F.col("status") == ERROR, "critical").otherwise("warning").alias("severity"))


def _after(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), ts)


def freshness_breaches(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules whose last success (or creation) lies more than max_lag_seconds back and that were not reported within that time.

    schedules: max_lag_seconds, created_at, last_succeeded, breach_emitted_at; null lags are ignored.
    """
    late = _after(F.coalesce("last_succeeded", "created_at"), F.col("max_lag_seconds")) < now
    told = F.col("breach_emitted_at").isNotNull() & (_after(F.col("breach_emitted_at"), F.col("max_lag_seconds")) >= now)
    return schedules.filter(F.col("max_lag_seconds").isNotNull() & late & ~told)


def emit_breaches(schedules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(breaches with window_start, schedules with their markers set)."""
    hit = freshness_breaches(schedules, now)
    events = hit.select("asset_name", "schedule_id", now.alias("emitted_at"), F.timestamp_add("SECOND", -F.col("max_lag_seconds").cast("int"), now).alias("window_start"))
    marked = schedules.join(hit.select("schedule_id", F.lit(True).alias("hit")), "schedule_id", "left")
    return events, marked.withColumn("breach_emitted_at", F.when(F.col("hit"), now).otherwise(F.col("breach_emitted_at"))).select(*schedules.columns)


def record_success(schedules: DataFrame, runs: DataFrame) -> DataFrame:
    """schedules after the runs (asset_name, finished_at) succeeded: last success set, marker cleared."""
    done = runs.groupBy("asset_name").agg(F.max("finished_at").alias("done"))
    both = schedules.join(done, "asset_name", "left")
    last = F.greatest("last_succeeded", "done")
    return both.withColumns({"breach_emitted_at": F.when(F.col("done").isNotNull(), F.lit(None)).otherwise(F.col("breach_emitted_at")), "last_succeeded": last}).select(*schedules.columns)


def rules_missing_columns(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """asset, rule_name, column_name: null and range rules (config JSON) on a column that the asset (asset, column_name) does not have."""
    asked = rules.filter(F.col("rule_type").isin("null_check", "range_check")).select("asset", "rule_name", F.get_json_object("config", "$.column").alias("column_name")).filter(F.col("column_name").isNotNull())
    return asked.join(columns.select("asset", "column_name").distinct(), ["asset", "column_name"], "left_anti").select("asset", "rule_name", "column_name")
