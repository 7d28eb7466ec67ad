"""Streaming forms: masking, routing and validity of events, micro-batch quality, freshness and sensors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import serial
from ..operators.policies import apply_masks
from ..operators.quality import evaluate
from ..operators.relational import split_valid_events
from ..operators.reviews import route

DISABLE_AFTER = 60


def masked_stream(stream: DataFrame, rules: dict[str, str], salt: str = "") -> DataFrame:
    """Masks are column expressions, so a stream takes them as a table does."""
    return apply_masks(stream, rules, salt)


def routed_stream(stream: DataFrame, rules: DataFrame, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid events with their channels, quarantine)"""
    valid, quarantine = split_valid_events(stream, *([types] if types else []))
    return route(valid, rules), quarantine


def quality_sink(rules: list, path: str):
    """For foreachBatch: a batch's results replace those of the same batch, so a retry adds none."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = evaluate(batch, rules, f"batch-{batch_id}").withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").parquet(path)

    return write


def sensor_step(state: tuple, ts, fired: bool, run_key: str | None, errored: bool, cooldown_seconds: float, disable_after: int) -> tuple[tuple, str]:
    """State (last key, cooled until, failures, disabled) and outcome after one evaluation."""
    last_key, until, failures, disabled = state
    if disabled:
        return state, "disabled"
    if errored:
        failures += 1
        off = failures >= disable_after
        return (last_key, until, failures, off), "disabled_now" if off else "evaluation_failed"
    if not fired:
        return (last_key, until, 0, False), "evaluated"
    if run_key and run_key == last_key:
        return (last_key, until, 0, False), "dedup_skipped"
    if ts < until:
        return (last_key, until, 0, False), "cooldown_skipped"
    return (run_key or None, ts + cooldown_seconds, 0, False), "fired"


def _sensor_rows(pdf: pd.DataFrame, state: tuple, cooldown_seconds: float, disable_after: int) -> tuple[tuple, list[str]]:
    outcomes = []
    for row in pdf.itertuples(index=False):
        state, outcome = sensor_step(state, row.ts.timestamp(), bool(row.fired), row.run_key, bool(row.errored), cooldown_seconds, disable_after)
        outcomes.append(outcome)
    return state, outcomes


SENSOR_START = (None, float("-inf"), 0, False)
SENSOR_OUT = "sensor string, event_id long, outcome string"


def sensor_firings(evaluations: DataFrame, cooldown_seconds: float, disable_after: int = DISABLE_AFTER) -> DataFrame:
    """sensor, event_id, outcome of evaluations (sensor, event_id, ts, fired, run_key, errored) in order of time; a sensor's state is carried from batch to batch, so its history never lies in memory."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sensor, state = None, SENSOR_START
        for pdf in batches:
            for key, rows in pdf.groupby("__key", sort=False):
                if key != sensor:
                    sensor, state = key, SENSOR_START
                state, outcomes = _sensor_rows(rows, state, cooldown_seconds, disable_after)
                yield pd.DataFrame({"sensor": rows["sensor"], "event_id": rows["event_id"], "outcome": outcomes})

    needed = evaluations.select("sensor", "event_id", "ts", "fired", "run_key", "errored")
    return serial(needed, "sensor", "ts", "event_id").mapInPandas(fold, SENSOR_OUT)


def sensor_stream(evaluations: DataFrame, cooldown_seconds: float, disable_after: int = DISABLE_AFTER) -> DataFrame:
    """The same over a stream, with the state kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = SENSOR_START
        if state.exists:
            last, until, failures, disabled = state.get
            now = (last, until, failures, disabled)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        now, outcomes = _sensor_rows(pdf, now, cooldown_seconds, disable_after)
        state.update(now)
        yield pd.DataFrame({"sensor": key[0], "event_id": pdf["event_id"], "outcome": outcomes})

    return evaluations.groupBy("sensor").applyInPandasWithState(step, SENSOR_OUT, "last_key string, until double, failures int, disabled boolean", "append", GroupStateTimeout.NoTimeout)


def freshness_stream(successes: DataFrame, max_lag_seconds: int) -> DataFrame:
    """asset_name, breached_at: one breach when event time passes an asset's last success (asset_name, finished_at with a watermark) by the lag; the next success clears it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"asset_name": [key[0]], "breached_at": [pd.Timestamp((last + max_lag_seconds) * 1_000_000_000)]})
            return
        newest = max(b["finished_at"].max() for b in batches).timestamp()
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        due = int((last + max_lag_seconds) * 1000)
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return successes.groupBy("asset_name").applyInPandasWithState(step, "asset_name string, breached_at timestamp_ntz", "last double", "append", GroupStateTimeout.EventTimeTimeout)
