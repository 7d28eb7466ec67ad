"""Governance tables derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import ship

NOW = "2024-01-31 00:00:00"

FIXTURES = {
    "fx_asset_edges": """
        SELECT concat('region:', CAST(n_regionkey AS VARCHAR(20))) AS from_asset, concat('nation:', CAST(n_nationkey AS VARCHAR(20))) AS to_asset,
               TIMESTAMP '1992-01-01 00:00:00' AS first_seen_at, CAST(NULL AS TIMESTAMP) AS superseded_at FROM nation
        UNION ALL
        SELECT concat('nation:', CAST(c_nationkey AS VARCHAR(20))), concat('customer:', CAST(c_custkey AS VARCHAR(20))), TIMESTAMP '1993-01-01 00:00:00', CAST(NULL AS TIMESTAMP) FROM customer
        UNION ALL
        SELECT concat('region:', CAST(n_regionkey AS VARCHAR(20))), concat('customer:', CAST(c_custkey AS VARCHAR(20))), TIMESTAMP '1993-01-01 00:00:00', CAST(NULL AS TIMESTAMP)
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0
        UNION ALL
        SELECT concat('customer:', CAST(o_custkey AS VARCHAR(20))), concat('order:', CAST(o_orderkey AS VARCHAR(20))), o_orderdate,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '180' DAY END FROM orders""",
    "fx_runs": """
        SELECT event_id AS run_id, concat('asset_', CAST(user_id % 40 AS VARCHAR(20))) AS asset_name,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS state,
               CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'normal' ELSE 'backfill' END AS priority, ts AS queued_at,
               CASE WHEN event_type IN ('click', 'purchase', 'error') THEN ts + INTERVAL '30' MINUTE END AS finished_at,
               CAST(ts AS DATE) AS partition_date, CASE WHEN event_id % 3 = 2 THEN event_id % 20 END AS backfill_id FROM events""",
    "fx_column_edges": """
        SELECT concat('nation:', CAST(c_nationkey AS VARCHAR(20))) AS from_asset, 'n_name' AS from_column, concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS to_asset, 'c_name' AS to_column,
               TIMESTAMP '1993-01-01 00:00:00' AS first_seen_at, CAST(NULL AS TIMESTAMP) AS superseded_at FROM customer
        UNION ALL
        SELECT concat('customer:', CAST(o_custkey AS VARCHAR(20))), CASE WHEN o_orderkey % 2 = 0 THEN 'c_name' ELSE 'c_acctbal' END, concat('order:', CAST(o_orderkey AS VARCHAR(20))), 'o_totalprice', o_orderdate,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '180' DAY END FROM orders""",
    "fx_pii_tags": """
        SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS asset, 'c_name' AS column_name, c_custkey % 4 <> 0 AS pii, CASE WHEN c_custkey % 8 = 0 THEN 'override' ELSE 'manual' END AS source FROM customer""",
    "fx_quality_results": """
        SELECT event_id AS run_id, CASE event_id % 3 WHEN 0 THEN 'null_check_value' WHEN 1 THEN 'range_check_value' ELSE 'no_outliers' END AS rule_name,
               CASE event_id % 3 WHEN 0 THEN 'null_check' WHEN 1 THEN 'range_check' ELSE 'sql_assertion' END AS rule_type,
               CASE WHEN event_type = 'error' THEN 'error' WHEN value > 100 THEN 'failed' ELSE 'passed' END AS status, value AS measured_value, CAST(100 AS DOUBLE) AS threshold, ts AS evaluated_at
        FROM events WHERE event_type IN ('click', 'purchase', 'error')""",
    "fx_schema_columns": """
        SELECT p_brand AS asset, p_size % 4 AS version, concat('c', CAST(p_partkey % 23 AS VARCHAR(20))) AS column_name,
               min(CASE p_partkey % 7 WHEN 0 THEN 'int16' WHEN 1 THEN 'int32' WHEN 2 THEN 'int64' WHEN 3 THEN 'varchar(20)' WHEN 4 THEN 'varchar(40)' WHEN 5 THEN 'text' ELSE 'decimal(10,2)' END) AS type,
               min(p_partkey % 2) = 0 AS nullable, CASE WHEN min(p_partkey) % 5 = 0 THEN '0' END AS default_value, concat('size ', CAST(max(p_size) AS VARCHAR(20))) AS comment
        FROM part GROUP BY p_brand, p_size % 4, concat('c', CAST(p_partkey % 23 AS VARCHAR(20)))""",
    "fx_policies": """
        SELECT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, concat('c', CAST(c_custkey % 7 AS VARCHAR(20))) AS column_name,
               CASE c_custkey % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'redact' ELSE 'partial' END AS mask_type, CASE c_nationkey % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'builder' ELSE 'yaml-default' END AS source,
               CASE WHEN c_nationkey % 2 = 0 THEN 'in-pipeline' ELSE 'warehouse-native' END AS enforcement_mode, c_custkey AS policy_id, c_custkey < 1200 AS superseded FROM customer""",
    "fx_audit_input": """
        SELECT event_id + 1 AS seq, ts AS occurred_at, CASE event_type WHEN 'error' THEN 'masking.sync_failed' WHEN 'signup' THEN 'role.assigned' ELSE 'policy.changed' END AS event_type,
               CAST(user_id AS VARCHAR(20)) AS actor_id, 'column_policy' AS resource_type, concat('t', CAST(user_id % 50 AS VARCHAR(20))) AS resource_id, props AS payload FROM events""",
    "fx_schedules": """
        SELECT concat('asset_', CAST(s_suppkey % 40 AS VARCHAR(20))) AS asset_name, s_suppkey AS schedule_id, 3600 * (1 + s_suppkey % 48) AS max_lag_seconds, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM supplier""",
    "fx_votes": """
        SELECT user_id % 200 AS review_id, event_id AS vote_id, user_id % 17 AS submitter_id, event_id % 17 AS decider_id, CASE WHEN event_type = 'error' THEN 'reject' ELSE 'approve' END AS vote,
               1 + user_id % 3 AS quorum, ts AS voted_at FROM events""",
    "fx_sensor_evals": """
        SELECT concat('sensor_', CAST(user_id % 20 AS VARCHAR(20))) AS sensor, event_id, ts, event_type IN ('click', 'purchase') AS fired,
               CASE WHEN event_type IN ('click', 'purchase') THEN CAST(CAST(ts AS DATE) AS VARCHAR(20)) END AS run_key, event_type = 'error' AS errored FROM events""",
}

_BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the given tables, with timestamps without time zone."""
    sql = re.sub(r"\bTIMESTAMP\b", "TIMESTAMP_NTZ", sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    used = [t for t in _BASE if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in used})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, sf_dir, FIXTURES[name])


def with_fixtures(body: str) -> str:
    """body with the fixtures that it names in front, for DuckDB."""
    names = [n for n in FIXTURES if re.search(rf"\b{n}\b", body)]
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in names)
    if not names:
        return body
    recursive = re.match(r"\s*WITH RECURSIVE\b", body) is not None
    own = re.match(r"\s*WITH (?:RECURSIVE )?", body)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}" + (f", {body[own.end() :]}" if own else f" {body}")
