"""Named queries over the given tables, each with the SQL it has to agree with where SQL can say it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_json, fired_partition_key, partition_key, valid_category_key, valid_partition_key
from ..functions.session import shared_dir
from ..functions.masks import mask_hash, mask_partial, mask_redact, warehouse_mask
from ..operators import audit, lineage, metadata, policies, quality, relational, reviews, runs, schemas, search_index
from ..sources.files import read_files, type_token
from ..streaming import monitors
from .fixtures import base, derived, fixture, now, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_fixtures(sql)
        return f

    return add


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def shown(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def ordered(c: str, name: str | None = None):
    return F.array_join(c, ",").alias(name or c)


# ---- sources, filters ------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_nation(spark, sf):
    return read_files(spark, f"{sf}/nation.parquet")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def read_limited(spark, sf):
    return read_files(spark, f"{sf}/orders.parquet", limit=100).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'DOUBLE' THEN 'float64' WHEN 'VARCHAR' THEN 'text' ELSE 'timestamp' END AS type,
                 count_star() AS n FROM (SELECT c.column_name, c.data_type FROM (DESCRIBE lineitem) c, lineitem) GROUP BY 1, 2""".replace("c.column_name, c.data_type FROM (DESCRIBE lineitem) c, lineitem", "column_name, column_type AS data_type FROM (DESCRIBE SELECT * FROM lineitem), (SELECT 1 FROM lineitem)"))
def describe_lineitem(spark, sf):
    df = base(spark, sf, "lineitem")
    one = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(type_token(f.dataType)).alias("type")) for f in df.schema.fields))
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(one).alias("c"), "n").select("c.*", "n")


@query("SELECT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL")
def active_edges(spark, sf):
    return lineage.active(fixture(spark, sf, "fx_asset_edges")).select("from_asset", "to_asset")


@query("SELECT from_asset, to_asset FROM fx_asset_edges WHERE first_seen_at <= TIMESTAMP '1996-06-01 00:00:00' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1996-06-01 00:00:00')")
def edges_as_of(spark, sf):
    return lineage.as_of(fixture(spark, sf, "fx_asset_edges"), ts("1996-06-01 00:00:00")).select("from_asset", "to_asset")


_LOOPS = "SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS from_asset, concat('customer:', CAST(c_custkey - c_custkey % 2 AS VARCHAR(20))) AS to_asset, CAST(NULL AS TIMESTAMP) AS superseded_at FROM customer UNION ALL SELECT 'region:0', concat('nation:', CAST(c_nationkey AS VARCHAR(20))), CAST(NULL AS TIMESTAMP) FROM customer"


@query(f"""WITH e AS ({_LOOPS}) SELECT from_asset, to_asset, 'self_edge' AS violation FROM e WHERE from_asset = to_asset
           UNION ALL SELECT from_asset, to_asset, 'duplicate' FROM e WHERE superseded_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def edge_violations(spark, sf):
    return lineage.edge_violations(derived(spark, sf, _LOOPS))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#23' AND p_size = 7")
def filtered_by_options(spark, sf):
    return relational.where_opt(base(spark, sf, "part"), p_brand="Brand#23", p_size=7, p_type=None).select("p_partkey", "p_brand")


@query("""SELECT event_type, count(*) AS n, octet_length(encode(event_type)) BETWEEN 1 AND 128 AND NOT contains(event_type, '/') AS valid FROM events GROUP BY event_type""")
def category_keys(spark, sf):
    return base(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("valid", valid_category_key(F.col("event_type")))


_KEYS = "SELECT event_id, concat(CAST(2019 + event_id % 8 AS VARCHAR(20)), '-W', lpad(CAST(event_id % 56 AS VARCHAR(20)), 2, '0')) AS week_key, concat(CAST(2019 + event_id % 8 AS VARCHAR(20)), '-', lpad(CAST(event_id % 14 AS VARCHAR(20)), 2, '0'), '-', lpad(CAST(event_id % 33 AS VARCHAR(20)), 2, '0')) AS day_key FROM events"


@query(f"""WITH k AS ({_KEYS}) SELECT event_id, coalesce(regexp_matches(week_key, '^\\d{{4}}-W(0[1-9]|[1-4]\\d|5[0-3])$') AND (right(week_key, 2) <> '53' OR weekofyear(make_date(CAST(left(week_key, 4) AS INT), 12, 28)) = 53), false) AS week_ok,
           TRY_CAST(day_key AS DATE) IS NOT NULL AS day_ok, regexp_matches(left(day_key, 7), '^\\d{{4}}-(0[1-9]|1[0-2])$') AS month_ok FROM k""")
def key_shapes(spark, sf):
    k = derived(spark, sf, _KEYS)
    return k.select("event_id", valid_partition_key(F.col("week_key"), "weekly").alias("week_ok"), valid_partition_key(F.col("day_key"), "daily").alias("day_ok"), valid_partition_key(F.substr("day_key", F.lit(1), F.lit(7)), "monthly").alias("month_ok"))


_TYPES = ("masking.sync_failed", "policy.changed")


@query("SELECT event_type IN ('masking.sync_failed', 'policy.changed') AND length(resource_id) > 0 AS valid, event_type, count(*) AS n FROM fx_audit_input GROUP BY 1, 2")
def event_validity(spark, sf):
    ok, bad = relational.split_valid_events(fixture(spark, sf, "fx_audit_input"), _TYPES)
    return ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).groupBy("valid", "event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- lineage ---------------------------------------------------------------------------------------------


def _reach(edges: str, start: str, down: bool = True, depth: int = 10) -> str:
    src, dst = ("from_asset", "to_asset") if down else ("to_asset", "from_asset")
    return f"""WITH RECURSIVE e AS ({edges}), r(asset, depth) AS (SELECT {dst}, 1 FROM e WHERE {src} = '{start}' UNION SELECT e.{dst}, r.depth + 1 FROM r JOIN e ON e.{src} = r.asset WHERE r.depth < {depth})
               SELECT asset, depth FROM r"""


# every nation also feeds its region, so region and nations are one component
_CYCLIC = "SELECT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL UNION SELECT to_asset, from_asset FROM fx_asset_edges WHERE from_asset LIKE 'region:%' AND to_asset LIKE 'nation:%'"


@query(f"""WITH RECURSIVE e AS ({_CYCLIC}),
           r(asset, depth, path) AS (SELECT to_asset, 1, ['nation:7', to_asset] FROM e WHERE from_asset = 'nation:7'
           UNION ALL SELECT e.to_asset, r.depth + 1, list_append(r.path, e.to_asset) FROM r JOIN e ON e.from_asset = r.asset WHERE r.depth < 10 AND NOT list_contains(r.path, e.to_asset))
           SELECT DISTINCT asset, depth FROM r""")
def impact_cyclic(spark, sf):
    edges = fixture(spark, sf, "fx_asset_edges")
    back = edges.filter("from_asset LIKE 'region:%' AND to_asset LIKE 'nation:%'").withColumns({"from_asset": F.col("to_asset"), "to_asset": F.col("from_asset")})
    return lineage.impact_assets(edges.unionByName(back), "nation:7")


_ACTIVE = "SELECT DISTINCT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL"
_MOMENT = "SELECT DISTINCT from_asset, to_asset FROM fx_asset_edges WHERE first_seen_at <= TIMESTAMP '1995-01-01 00:00:00' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1995-01-01 00:00:00')"


@query(_reach(_ACTIVE, "region:0"))
def impact_assets_down(spark, sf):
    return lineage.impact_assets(fixture(spark, sf, "fx_asset_edges"), "region:0")


@query(_reach(_ACTIVE, "order:7", down=False))
def impact_assets_up(spark, sf):
    return lineage.impact_assets(fixture(spark, sf, "fx_asset_edges"), "order:7", lineage.UP)


@query(_reach(_MOMENT, "region:1"))
def impact_assets_asof(spark, sf):
    return lineage.impact_assets(fixture(spark, sf, "fx_asset_edges"), "region:1", moment=ts("1995-01-01 00:00:00"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_asset, from_column, to_asset, to_column FROM fx_column_edges WHERE superseded_at IS NULL),
          r(asset, column_name, depth) AS (SELECT to_asset, to_column, 1 FROM e WHERE from_asset = 'nation:3' AND from_column = 'n_name'
          UNION SELECT e.to_asset, e.to_column, r.depth + 1 FROM r JOIN e ON e.from_asset = r.asset AND e.from_column = r.column_name WHERE r.depth < 10) SELECT asset, column_name, depth FROM r""")
def impact_columns_down(spark, sf):
    return lineage.impact_columns(fixture(spark, sf, "fx_column_edges"), "nation:3", "n_name")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL),
          r(seed, asset, depth) AS (SELECT from_asset, to_asset, 1 FROM e WHERE from_asset LIKE 'nation:%' UNION SELECT r.seed, e.to_asset, r.depth + 1 FROM r JOIN e ON e.from_asset = r.asset WHERE r.depth < 10)
          SELECT seed, asset, depth FROM r""")
def impact_many_seeds(spark, sf):
    seeds = derived(spark, sf, "SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(20))) AS seed FROM nation")
    return lineage.impact_many(fixture(spark, sf, "fx_asset_edges"), seeds)


@query(_reach(_ACTIVE, "region:2", depth=2) + " ORDER BY depth, asset LIMIT 50")
def neighborhood_nodes(spark, sf):
    return lineage.neighborhood(fixture(spark, sf, "fx_asset_edges"), "region:2")


@query(_reach(_ACTIVE, "region:2", depth=2).replace("SELECT asset, depth FROM r", ", n AS (SELECT asset FROM (SELECT asset, depth FROM r ORDER BY depth, asset LIMIT 50) UNION SELECT 'region:2') SELECT from_asset, to_asset FROM e WHERE from_asset IN (SELECT asset FROM n) AND to_asset IN (SELECT asset FROM n)"))
def neighborhood_edges(spark, sf):
    edges = fixture(spark, sf, "fx_asset_edges")
    nodes = lineage.neighborhood(edges, "region:2").select("asset")
    return lineage.induced_edges(edges, nodes.unionByName(spark.range(1).select(F.lit("region:2").alias("asset"))))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL), r(asset) AS (SELECT 'order:10' UNION SELECT e.from_asset FROM r JOIN e ON e.to_asset = r.asset) SELECT asset FROM r""")
def closure_upstream(spark, sf):
    return lineage.upstream_closure(fixture(spark, sf, "fx_asset_edges"), "order:10")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL),
          w(asset, level) AS (SELECT DISTINCT from_asset, 0 FROM e WHERE from_asset NOT IN (SELECT to_asset FROM e) UNION SELECT e.to_asset, w.level + 1 FROM w JOIN e ON e.from_asset = w.asset)
          SELECT asset, max(level) AS level FROM w GROUP BY asset""")
def levels_of_assets(spark, sf):
    return lineage.topo_levels(fixture(spark, sf, "fx_asset_edges"))


_DEFS = "SELECT concat('customer:', CAST(o_custkey AS VARCHAR(20))) AS asset, array_agg(concat('order:', CAST(o_orderkey AS VARCHAR(20)))) AS upstreams FROM orders GROUP BY o_custkey"
_SEEN = "SELECT concat('customer:', CAST(o_custkey AS VARCHAR(20))) AS asset, array_agg(concat('order:', CAST(o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)))) AS observed FROM orders GROUP BY o_custkey"


@query(f"""WITH d AS ({_DEFS}), s AS ({_SEEN}), b AS (SELECT asset, list_sort(upstreams) AS d, list_sort(observed) AS o FROM d JOIN s USING (asset))
           SELECT asset, CASE WHEN d = o THEN 'clean' ELSE 'pending' END AS drift_status, array_to_string(list_sort(list_distinct(list_filter(d, lambda x: NOT list_contains(o, x)))), ',') AS missing,
                  array_to_string(list_sort(list_distinct(list_filter(o, lambda x: NOT list_contains(d, x)))), ',') AS extra FROM b""")
def drift_of_upstreams(spark, sf):
    return lineage.upstream_drift(derived(spark, sf, _DEFS), derived(spark, sf, _SEEN)).select("asset", "drift_status", ordered("missing"), ordered("extra"))


@query(f"WITH d AS ({_DEFS}), u AS (SELECT asset, unnest(upstreams) AS upstream FROM d) SELECT asset, upstream FROM u WHERE upstream NOT IN (SELECT asset FROM d)")
def unknown_upstreams(spark, sf):
    return lineage.unknown_upstreams(derived(spark, sf, _DEFS))


_DECLARED = "SELECT concat('nation:', CAST(c_nationkey AS VARCHAR(20))) AS from_asset, concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS to_asset FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT concat('supplier:', CAST(c_custkey % 10 AS VARCHAR(20))), concat('customer:', CAST(c_custkey AS VARCHAR(20))) FROM customer WHERE c_custkey % 5 = 0"


@query(f"""WITH w AS ({_DECLARED}), t AS (SELECT DISTINCT to_asset FROM w), a AS (SELECT DISTINCT from_asset, to_asset FROM fx_asset_edges WHERE superseded_at IS NULL)
           SELECT coalesce(a.from_asset, w.from_asset) AS from_asset, coalesce(a.to_asset, w.to_asset) AS to_asset, a.from_asset IS NULL AS added,
                  w.from_asset IS NULL AND coalesce(a.to_asset, w.to_asset) IN (SELECT to_asset FROM t) AS retired
           FROM a FULL JOIN w ON a.from_asset = w.from_asset AND a.to_asset = w.to_asset""")
def synced_edges(spark, sf):
    edges = lineage.active(fixture(spark, sf, "fx_asset_edges")).dropDuplicates(["from_asset", "to_asset"])
    edges = edges.select("from_asset", "to_asset", F.lit("h0").alias("code_hash_first"), F.lit("h0").alias("code_hash_latest"), "first_seen_at", F.col("first_seen_at").alias("last_seen_at"), "superseded_at")
    told = derived(spark, sf, _DECLARED).groupBy(F.col("to_asset").alias("asset")).agg(F.collect_set("from_asset").alias("upstreams")).withColumn("code_hash", F.lit("h1"))
    return lineage.sync_edges(edges, told, now()).select("from_asset", "to_asset", (F.col("first_seen_at") == now()).alias("added"), F.col("superseded_at").isNotNull().alias("retired"))


_ITEM_RUNS = "SELECT l_orderkey * 10 + l_linenumber AS run_id, concat('order:', CAST(l_orderkey AS VARCHAR(20))) AS asset, l_shipdate AS at FROM lineitem"


@query(f"""WITH r AS ({_ITEM_RUNS}) SELECT DISTINCT r.run_id, r.asset, e.from_asset FROM r JOIN fx_asset_edges e ON e.to_asset = r.asset AND e.first_seen_at <= r.at AND (e.superseded_at IS NULL OR e.superseded_at > r.at)""")
def openlineage_inputs(spark, sf):
    return lineage.run_inputs(derived(spark, sf, _ITEM_RUNS), fixture(spark, sf, "fx_asset_edges"))


_OL_RUNS = "SELECT o_orderkey AS run_id, concat('order:', CAST(o_orderkey AS VARCHAR(20))) AS asset, 'succeeded' AS state, o_orderdate + INTERVAL '1' DAY AS started_at, o_orderdate AS queued_at, o_orderdate + INTERVAL '2' DAY AS finished_at FROM orders"


@query(f"""WITH r AS ({_OL_RUNS}) SELECT r.run_id, r.asset, strftime(r.finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, e.from_asset AS input, c.from_column AS field FROM r
           LEFT JOIN fx_asset_edges e ON e.to_asset = r.asset AND e.first_seen_at <= r.started_at AND (e.superseded_at IS NULL OR e.superseded_at > r.started_at)
           LEFT JOIN fx_column_edges c ON c.to_asset = r.asset AND c.first_seen_at <= r.started_at AND (c.superseded_at IS NULL OR c.superseded_at > r.started_at)""")
def openlineage_events(spark, sf):
    out = lineage.openlineage(derived(spark, sf, _OL_RUNS), fixture(spark, sf, "fx_asset_edges"), fixture(spark, sf, "fx_column_edges"))
    return out.select("run_id", "asset", shown("finished_at"), F.get_json_object("event", "$.inputs[0].name").alias("input"), F.get_json_object("event", "$.outputs[0].facets.columnLineage.fields.o_totalprice.inputFields[0].field").alias("field"))


@query("""SELECT run_id, asset_name AS asset, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at FROM fx_runs WHERE state = 'succeeded' AND asset_name = 'asset_7' AND finished_at >= TIMESTAMP '2024-01-15 00:00:00'""")
def export_of_lineage(spark, sf):
    r = fixture(spark, sf, "fx_runs").withColumnRenamed("asset_name", "asset").withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    events = lineage.openlineage(r, fixture(spark, sf, "fx_asset_edges"), fixture(spark, sf, "fx_column_edges"))
    return lineage.export_lineage(events, "asset_7", ts("2024-01-15 00:00:00")).select("run_id", "asset", shown("finished_at"))


# ---- quality ---------------------------------------------------------------------------------------------

_NULLS = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"


def _result(c):
    return c.select("rule_name", "rule_type", "status", F.round("measured_value", 6).alias("measured_value"), "threshold")


@query(f"""WITH t AS ({_NULLS}) SELECT 'null_check_value' AS rule_name, 'null_check' AS rule_type, CASE WHEN r > 0.1 THEN 'failed' ELSE 'passed' END AS status, round(r, 6) AS measured_value, 0.1::DOUBLE AS threshold
           FROM (SELECT count(*) FILTER (value IS NULL) / count(*) AS r FROM t)""")
def null_check(spark, sf):
    return _result(quality.evaluate(derived(spark, sf, _NULLS), [quality.NullCheck("value", 0.1)], "r"))


@query("""SELECT 'range_check_l_quantity' AS rule_name, 'range_check' AS rule_type, CASE WHEN a < 1 OR b > 40 THEN 'failed' ELSE 'passed' END AS status, CASE WHEN a < 1 THEN a ELSE b END AS measured_value,
                 CASE WHEN a < 1 THEN 1 ELSE 40 END::DOUBLE AS threshold FROM (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem)""")
def range_check(spark, sf):
    return _result(quality.evaluate(base(spark, sf, "lineitem"), [quality.RangeCheck("l_quantity", 1, 40)], "r"))


@query("""SELECT 'no_cheap' AS rule_name, 'sql_assertion' AS rule_type, CASE WHEN n < 100 THEN 'passed' ELSE 'failed' END AS status, n::DOUBLE AS measured_value, NULL::DOUBLE AS threshold
          FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice < 1000)""")
def sql_assertion(spark, sf):
    rule = quality.SQLAssertion("no_cheap", "SELECT count(*) FROM ${asset} WHERE o_totalprice < 1000", quality.less_than(100))
    return _result(quality.evaluate(base(spark, sf, "orders"), [rule], "r"))


_SUITE = [("l_quantity", 1, 50), ("l_discount", 0, 0.05), ("l_tax", 0, 0.08), ("l_extendedprice", 0, 1e9)]
_SUITE_NULLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]


@query(" UNION ALL ".join([f"SELECT 'null_check_{c}' AS rule_name, CASE WHEN count(*) FILTER ({c} IS NULL) > 0 THEN 'failed' ELSE 'passed' END AS status FROM lineitem" for c in _SUITE_NULLS] + [f"SELECT 'range_check_{c}', CASE WHEN min({c}) < {a} OR max({c}) > {b} THEN 'failed' ELSE 'passed' END FROM lineitem" for c, a, b in _SUITE] + ["SELECT 'null_check_nothing', 'error'"]))
def quality_suite(spark, sf):
    rules = [*(quality.NullCheck(c) for c in _SUITE_NULLS), *(quality.RangeCheck(*x) for x in _SUITE), quality.NullCheck("nothing")]
    return quality.evaluate(base(spark, sf, "lineitem"), rules, "r").select("rule_name", "status")


@query("""SELECT 'range_check_l_returnflag' AS rule_name, 'error' AS status, NULL::DOUBLE AS measured_value UNION ALL SELECT 'by_nothing', 'error', NULL
          UNION ALL SELECT 'range_check_l_tax', CASE WHEN min(l_tax) < 0 OR max(l_tax) > 0.05 THEN 'failed' ELSE 'passed' END, CASE WHEN min(l_tax) < 0 THEN min(l_tax) ELSE max(l_tax) END FROM lineitem""")
def quality_errors(spark, sf):
    rules = [quality.RangeCheck("l_returnflag", 0, 1), quality.SQLAssertion("by_nothing", "SELECT sum(l_linenumber) DIV (count(*) - count(*)) FROM ${asset}", quality.equals_zero), quality.RangeCheck("l_tax", 0, 0.05)]
    return quality.evaluate(base(spark, sf, "lineitem"), rules, "r").select("rule_name", "status", "measured_value")


@query("""SELECT l_returnflag, l_linestatus, CASE WHEN max(l_discount) > 0.05 THEN 'failed' ELSE 'passed' END AS status, max(l_discount) AS measured_value FROM lineitem GROUP BY ALL""")
def quality_by_partition(spark, sf):
    return quality.evaluate_by(base(spark, sf, "lineitem"), [quality.RangeCheck("l_discount", 0, 0.05)], ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", "status", "measured_value")


@query("SELECT CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) > 0 THEN 'passed' ELSE 'skipped' END AS status FROM fx_quality_results")
def overall_status(spark, sf):
    return quality.overall(fixture(spark, sf, "fx_quality_results"))


@query("""WITH d AS (SELECT run_id FROM fx_runs WHERE asset_name = 'asset_3' AND finished_at IS NOT NULL ORDER BY finished_at DESC, run_id DESC LIMIT 30),
          p AS (SELECT run_id, 100.0 * count(*) FILTER (status = 'passed') / count(*) AS s FROM fx_quality_results GROUP BY run_id) SELECT run_id, coalesce(s, 100)::DOUBLE AS score FROM d LEFT JOIN p USING (run_id)""")
def quality_trend(spark, sf):
    return quality.quality_trend(fixture(spark, sf, "fx_runs"), fixture(spark, sf, "fx_quality_results"), "asset_3").select("run_id", "score")


@query("""WITH d AS (SELECT run_id FROM fx_runs WHERE asset_name = 'asset_5' AND finished_at IS NOT NULL ORDER BY finished_at DESC, run_id DESC LIMIT 100),
          p AS (SELECT run_id, 100.0 * count(*) FILTER (status = 'passed') / count(*) AS s FROM fx_quality_results GROUP BY run_id) SELECT round(avg(coalesce(s, 100)), 6)::DOUBLE AS mean_score, count(*) AS runs FROM d LEFT JOIN p USING (run_id)""")
def quality_mean(spark, sf):
    out = quality.mean_score(quality.quality_trend(fixture(spark, sf, "fx_runs"), fixture(spark, sf, "fx_quality_results"), "asset_5", 100))
    return out.select(F.round("mean_score", 6).alias("mean_score"), "runs")


@query("""SELECT run_id, status, measured_value FROM fx_quality_results q JOIN fx_runs USING (run_id) WHERE rule_name = 'range_check_value' AND asset_name = 'asset_1' ORDER BY evaluated_at DESC, run_id DESC LIMIT 50""")
def rule_history(spark, sf):
    return relational.rule_history(fixture(spark, sf, "fx_quality_results"), fixture(spark, sf, "fx_runs"), "asset_1", "range_check_value").select("run_id", "status", "measured_value")


@query("""SELECT asset_name, rule_name, run_id FROM fx_quality_results q JOIN fx_runs USING (run_id) QUALIFY row_number() OVER (PARTITION BY asset_name, rule_name ORDER BY evaluated_at DESC, run_id DESC) <= 5""")
def rule_histories(spark, sf):
    return relational.rule_histories(fixture(spark, sf, "fx_quality_results"), fixture(spark, sf, "fx_runs"), 5).select("asset_name", "rule_name", "run_id")


@query("""SELECT run_id, asset_name, rule_name, CASE status WHEN 'error' THEN 'critical' ELSE 'warning' END AS severity FROM fx_quality_results JOIN fx_runs USING (run_id) WHERE status IN ('failed', 'error') AND run_id % 5 <> 0""")
def alerts(spark, sf):
    acks = fixture(spark, sf, "fx_quality_results").filter("run_id % 5 = 0").select("run_id", "rule_name")
    return quality.alerts(fixture(spark, sf, "fx_quality_results"), fixture(spark, sf, "fx_runs"), acks)


def _schedules(spark, sf):
    done = fixture(spark, sf, "fx_runs").filter("state = 'succeeded'").groupBy("asset_name").agg(F.max("finished_at").alias("last_succeeded"))
    told = F.when(F.col("schedule_id") % 5 == 0, now() - F.expr("INTERVAL '2' HOUR"))
    return fixture(spark, sf, "fx_schedules").join(done, "asset_name", "left").withColumn("breach_emitted_at", told)


_LATE = """WITH s AS (SELECT f.*, l.last_succeeded, CASE WHEN schedule_id % 5 = 0 THEN TIMESTAMP '2024-01-30 22:00:00' END AS told FROM fx_schedules f
           LEFT JOIN (SELECT asset_name, max(finished_at) AS last_succeeded FROM fx_runs WHERE state = 'succeeded' GROUP BY 1) l USING (asset_name)),
           b AS (SELECT * FROM s WHERE coalesce(last_succeeded, created_at) + to_seconds(max_lag_seconds) < TIMESTAMP '2024-01-31 00:00:00' AND NOT (told IS NOT NULL AND told + to_seconds(max_lag_seconds) >= TIMESTAMP '2024-01-31 00:00:00'))"""


@query(f"{_LATE} SELECT asset_name, schedule_id FROM b")
def freshness_breaches(spark, sf):
    return quality.freshness_breaches(_schedules(spark, sf), now()).select("asset_name", "schedule_id")


@query(f"{_LATE} SELECT asset_name, schedule_id, strftime(TIMESTAMP '2024-01-31 00:00:00' - to_seconds(max_lag_seconds), '%Y-%m-%d %H:%M:%S') AS window_start FROM b")
def freshness_events(spark, sf):
    return quality.emit_breaches(_schedules(spark, sf), now())[0].select("asset_name", "schedule_id", shown("window_start"))


@query("""SELECT schedule_id, strftime(d, '%Y-%m-%d %H:%M:%S') AS last_succeeded, d IS NULL AND schedule_id % 5 = 0 AS marked FROM fx_schedules LEFT JOIN (SELECT asset_name, max(finished_at) AS d FROM fx_runs WHERE state = 'succeeded' GROUP BY 1) USING (asset_name)""")
def recorded_success(spark, sf):
    done = fixture(spark, sf, "fx_runs").filter("state = 'succeeded'")
    return quality.record_success(_schedules(spark, sf), done).select("schedule_id", shown("last_succeeded"), F.col("breach_emitted_at").isNotNull().alias("marked"))


_RULES = "SELECT p_brand AS asset, concat('rule_', CAST(p_partkey AS VARCHAR(20))) AS rule_name, CASE p_partkey % 3 WHEN 0 THEN 'null_check' WHEN 1 THEN 'range_check' ELSE 'sql_assertion' END AS rule_type, concat('{\"column\":\"c', CAST(p_partkey % 29 AS VARCHAR(20)), '\"}') AS config FROM part"


@query(f"""WITH r AS ({_RULES}) SELECT asset, rule_name, json_extract_string(config, '$.column') AS column_name FROM r WHERE rule_type IN ('null_check', 'range_check')
           AND NOT EXISTS (SELECT 1 FROM fx_schema_columns c WHERE c.asset = r.asset AND c.column_name = json_extract_string(r.config, '$.column'))""")
def rules_missing_columns(spark, sf):
    return quality.rules_missing_columns(derived(spark, sf, _RULES), fixture(spark, sf, "fx_schema_columns"))


# ---- masks and policies ----------------------------------------------------------------------------------

_SALT = "s3cret"


def _pads(salt: str) -> tuple[str, str]:
    key = salt.encode().ljust(64, b"\0")
    return tuple("".join(f"\\x{b ^ p:02X}" for b in key) for p in (0x36, 0x5C))


_INNER, _OUTER = _pads(_SALT)


@query(f"SELECT c_custkey, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(c_name)))) AS masked FROM customer")
def masked_by_hash(spark, sf):
    return base(spark, sf, "customer").select("c_custkey", mask_hash(F.col("c_name"), _SALT).alias("masked"))


@query("SELECT c_custkey, '***' AS masked FROM customer")
def masked_by_redaction(spark, sf):
    return base(spark, sf, "customer").select("c_custkey", mask_redact(F.col("c_name")).alias("masked"))


@query("SELECT doc_id, CASE WHEN length(text) <= 7 THEN '***' ELSE left(text, 3) || repeat('*', length(text) - 6) || right(text, 3) END AS masked FROM documents")
def masked_in_part(spark, sf):
    return base(spark, sf, "documents").select("doc_id", mask_partial(F.col("text"), 3).alias("masked"))


@query("SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, left(c_mktsegment, 2) || repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 2) AS c_mktsegment FROM customer")
def masked_table(spark, sf):
    return policies.apply_masks(base(spark, sf, "customer"), {"c_name": "redact", "c_mktsegment": "partial", "c_acctbal": "hash", "nothing": "hash"})


@query("SELECT c_custkey, c_name, sha256(c_mktsegment) AS c_mktsegment FROM customer")
def masked_view(spark, sf):
    rules = {"c_name": ("redact", ["analyst"]), "c_mktsegment": ("hash", ["owner"])}
    return policies.masked_view(base(spark, sf, "customer"), rules, "analyst", "warehouse").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, left(s_name, 2) || repeat('*', greatest(length(s_name) - 4, 0)) || right(s_name, 2) AS masked FROM supplier")
def masked_for_warehouse(spark, sf):
    return base(spark, sf, "supplier").select("s_suppkey", warehouse_mask(F.col("s_name"), "partial").alias("masked"))


_RANK = "CASE source WHEN 'runtime' THEN 0 WHEN 'builder' THEN 1 WHEN 'yaml-default' THEN 2 ELSE 3 END"
_BEST = f"QUALIFY row_number() OVER (PARTITION BY asset, column_name ORDER BY {_RANK}, policy_id DESC) = 1"


@query(f"SELECT asset, column_name, mask_type, source, policy_id FROM fx_policies WHERE NOT superseded {_BEST}")
def effective_policies(spark, sf):
    return policies.effective_policies(fixture(spark, sf, "fx_policies")).select("asset", "column_name", "mask_type", "source", "policy_id")


_TABLE_PII = "SELECT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, concat('c', CAST(c_custkey % 11 AS VARCHAR(20))) AS column_name, c_custkey % 4 = 0 AS pii FROM customer"


@query(f"""WITH p AS ({_TABLE_PII}) (SELECT asset, column_name, mask_type FROM fx_policies WHERE NOT superseded AND enforcement_mode IN ('in-pipeline', 'unknown') {_BEST})
           UNION ALL SELECT DISTINCT asset, column_name, 'redact' FROM p WHERE pii AND NOT EXISTS (SELECT 1 FROM fx_policies q WHERE NOT q.superseded AND q.asset = p.asset AND q.column_name = p.column_name)""")
def mask_rules(spark, sf):
    return policies.mask_rules(fixture(spark, sf, "fx_policies"), derived(spark, sf, _TABLE_PII))


_ACTUAL = "SELECT DISTINCT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, concat('c', CAST(c_custkey % 9 AS VARCHAR(20))) AS column_name, CASE (c_custkey % 450) % 2 WHEN 0 THEN 'hash' ELSE 'redact' END AS mask_type FROM customer"


@query(f"""WITH e AS (SELECT asset, column_name, mask_type FROM fx_policies WHERE NOT superseded {_BEST}), a AS ({_ACTUAL})
           SELECT coalesce(e.asset, a.asset) AS asset, coalesce(e.column_name, a.column_name) AS column_name, CASE WHEN a.mask_type IS NULL THEN 'missing' WHEN e.mask_type IS NULL THEN 'extra' ELSE 'different' END AS drift,
                  e.mask_type AS expected, a.mask_type AS actual FROM e FULL JOIN a ON e.asset = a.asset AND e.column_name = a.column_name WHERE e.mask_type IS DISTINCT FROM a.mask_type""")
def policy_drift(spark, sf):
    return policies.policy_drift(policies.effective_policies(fixture(spark, sf, "fx_policies")), derived(spark, sf, _ACTUAL))


@query("SELECT DISTINCT asset FROM fx_policies WHERE NOT superseded")
def policy_assets(spark, sf):
    return policies.policy_assets(fixture(spark, sf, "fx_policies"))


@query("SELECT policy_id, asset, column_name FROM fx_policies WHERE NOT superseded AND source = 'runtime' AND asset = 't7'")
def policy_list(spark, sf):
    return policies.list_policies(fixture(spark, sf, "fx_policies"), "t7", "runtime").select("policy_id", "asset", "column_name")


_TAGS = "SELECT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, array_agg(DISTINCT c_mktsegment) AS tags FROM customer WHERE c_custkey % 50 < 30 GROUP BY c_custkey % 50"
_TAG_MASKS = "SELECT DISTINCT c_mktsegment AS tag, CASE WHEN c_mktsegment < 'C' THEN 'hash' ELSE 'partial' END AS mask_type FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'"


@query(f"""WITH m AS ({_TAGS}), k AS ({_TAG_MASKS}), x AS (SELECT asset, unnest(tags) AS tag FROM m), w AS (SELECT asset, arg_min(mask_type, tag) AS mask_type FROM x JOIN k USING (tag) GROUP BY asset)
           SELECT DISTINCT p.asset, p.column_name, w.mask_type, 'yaml-default' AS source FROM fx_policies p JOIN w USING (asset) WHERE NOT p.superseded""")
def tag_defaults(spark, sf):
    return policies.apply_tag_defaults(fixture(spark, sf, "fx_policies"), derived(spark, sf, _TAGS), derived(spark, sf, _TAG_MASKS))


_DECLARED_POLICIES = "SELECT asset, column_name, min(mask_type) AS mask_type FROM (SELECT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, concat('c', CAST(c_custkey % 8 AS VARCHAR(20))) AS column_name, CASE c_nationkey % 2 WHEN 0 THEN 'hash' ELSE 'redact' END AS mask_type FROM customer) x GROUP BY asset, column_name"


@query(f"""WITH b AS (SELECT asset, column_name, mask_type FROM fx_policies WHERE NOT superseded AND source = 'builder' {_BEST}), d AS ({_DECLARED_POLICIES})
           SELECT coalesce(b.asset, d.asset) AS asset, coalesce(b.column_name, d.column_name) AS column_name, CASE WHEN d.mask_type IS NULL THEN 'retired' WHEN b.mask_type IS NULL THEN 'inserted' ELSE 'changed' END AS action,
                  b.mask_type AS before, d.mask_type AS after FROM b FULL JOIN d ON b.asset = d.asset AND b.column_name = d.column_name WHERE b.mask_type IS DISTINCT FROM d.mask_type""")
def policy_changes(spark, sf):
    mine = policies.effective_policies(fixture(spark, sf, "fx_policies").filter("source = 'builder'"))
    rows = mine.select("asset", "column_name", "mask_type", "source", F.lit("h0").alias("code_hash_first"), F.lit("h0").alias("code_hash_latest"), ts("2024-01-01 00:00:00").alias("first_seen_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    return policies.apply_policies(rows, derived(spark, sf, _DECLARED_POLICIES).withColumn("code_hash", F.lit("h1")), now())[1]


_HELD = "SELECT DISTINCT from_asset, from_column, to_asset, to_column FROM fx_column_edges WHERE superseded_at IS NULL"


@query(f"""WITH e AS ({_HELD}), j AS (SELECT to_asset, to_column, coalesce(t.pii, false) AS pii, from_asset || '.' || from_column AS name FROM e LEFT JOIN fx_pii_tags t ON t.asset = from_asset AND t.column_name = from_column)
           SELECT to_asset AS asset, to_column AS column_name, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (pii) AS contributors FROM j
           WHERE NOT EXISTS (SELECT 1 FROM fx_pii_tags o WHERE o.source = 'override' AND o.asset = to_asset AND o.column_name = to_column) GROUP BY 1, 2 HAVING bool_or(pii)""")
def pii_union(spark, sf):
    return policies.propagate_pii(fixture(spark, sf, "fx_column_edges"), fixture(spark, sf, "fx_pii_tags")).select("asset", "column_name", ordered("contributors"))


@query(f"""WITH RECURSIVE e AS ({_HELD}), r(asset, column_name) AS (SELECT asset, column_name FROM fx_pii_tags WHERE pii UNION SELECT e.to_asset, e.to_column FROM r JOIN e ON e.from_asset = r.asset AND e.from_column = r.column_name
           WHERE NOT EXISTS (SELECT 1 FROM fx_pii_tags o WHERE o.source = 'override' AND o.asset = e.to_asset AND o.column_name = e.to_column)) SELECT asset, column_name FROM r""")
def pii_fixpoint(spark, sf):
    return policies.propagate_pii_all(fixture(spark, sf, "fx_column_edges"), fixture(spark, sf, "fx_pii_tags"))


_OVERRIDES = "SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))) AS asset, 'c_name' AS column_name, c_custkey % 2 = 0 AS pii FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT concat('customer:', CAST(c_custkey AS VARCHAR(20))), 'c_acctbal', true FROM customer WHERE c_custkey % 9 = 0"


@query(f"""WITH o AS ({_OVERRIDES}) SELECT coalesce(t.asset, o.asset) AS asset, coalesce(t.column_name, o.column_name) AS column_name, coalesce(o.pii, t.pii) AS pii, CASE WHEN o.pii IS NOT NULL THEN 'override' ELSE t.source END AS source
           FROM fx_pii_tags t FULL JOIN o ON t.asset = o.asset AND t.column_name = o.column_name""")
def pii_overrides(spark, sf):
    return policies.apply_pii_overrides(fixture(spark, sf, "fx_pii_tags"), derived(spark, sf, _OVERRIDES))[0]


_META = "SELECT asset, column_name, CASE WHEN bool_or(pii) THEN 'pii' ELSE 'plain' END AS tag FROM (SELECT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, concat('c', CAST(c_custkey % 11 AS VARCHAR(20))) AS column_name, c_custkey % 4 = 0 AS pii FROM customer) x GROUP BY asset, column_name"


@query(f"""WITH m AS ({_META}), p AS (SELECT DISTINCT asset, column_name FROM fx_policies WHERE NOT superseded)
           SELECT m.asset, bool_or(tag = 'pii') AS has_pii, bool_or(tag = 'pii' AND p.asset IS NULL) AS missing_policy FROM m LEFT JOIN p ON m.asset = p.asset AND m.column_name = p.column_name GROUP BY m.asset""")
def pii_coverage(spark, sf):
    return policies.pii_coverage(derived(spark, sf, _META).withColumn("tags", F.array("tag")), fixture(spark, sf, "fx_policies"))


# ---- schemas ---------------------------------------------------------------------------------------------

_RAW = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'smallint' WHEN 1 THEN 'integer' WHEN 2 THEN 'character varying' WHEN 3 THEN 'numeric' WHEN 4 THEN 'double precision' WHEN 5 THEN 'timestamp without time zone' WHEN 6 THEN 'jsonb' WHEN 7 THEN 'money' ELSE 'character' END AS raw, CASE WHEN p_size % 2 = 0 THEN p_size END AS len, CASE WHEN p_size % 3 <> 0 THEN p_size END AS prec, CASE WHEN p_size % 5 <> 0 THEN 2 END AS scale FROM part"


@query(f"""WITH t AS ({_RAW}) SELECT p_partkey, CASE raw WHEN 'smallint' THEN 'int16' WHEN 'integer' THEN 'int32' WHEN 'character varying' THEN CASE WHEN len IS NULL THEN 'varchar' ELSE 'varchar(' || len || ')' END
           WHEN 'numeric' THEN CASE WHEN prec IS NULL THEN 'decimal' WHEN scale IS NULL THEN 'decimal(' || prec || ')' ELSE 'decimal(' || prec || ',' || scale || ')' END WHEN 'double precision' THEN 'float64'
           WHEN 'timestamp without time zone' THEN 'timestamp' WHEN 'jsonb' THEN 'jsonb' WHEN 'money' THEN '?:money' ELSE CASE WHEN len IS NULL THEN 'char' ELSE 'char(' || len || ')' END END AS token FROM t""")
def type_tokens(spark, sf):
    return derived(spark, sf, _RAW).select("p_partkey", schemas.normalize_type(F.col("raw"), F.col("len"), F.col("prec"), F.col("scale")).alias("token"))


_VER = "SELECT a.asset, a.version, a.column_name, a.type, a.nullable, a.default_value, a.comment, a.column_name = 'c0' AS is_pk FROM fx_schema_columns a"
_STEPS = "SELECT asset, version, before FROM (SELECT asset, version, lag(version) OVER (PARTITION BY asset ORDER BY version) AS before FROM (SELECT DISTINCT asset, version FROM fx_schema_columns)) WHERE before IS NOT NULL"
_BOTH = f"""v AS ({_VER}), s AS ({_STEPS}), n AS (SELECT v.*, s.before FROM v JOIN s USING (asset, version)), p AS (SELECT v.* REPLACE (s.version AS version) FROM v JOIN s ON v.asset = s.asset AND v.version = s.before),
    j AS (SELECT coalesce(p.asset, n.asset) AS asset, coalesce(p.version, n.version) AS version, coalesce(p.column_name, n.column_name) AS column_name, p.type AS prev_type, n.type AS new_type, p.nullable AS pn, n.nullable AS nn,
          p.default_value AS pd, n.default_value AS nd, p.comment AS pc, n.comment AS nc, p.is_pk AS pk, n.is_pk AS nk FROM p FULL JOIN n ON p.asset = n.asset AND p.version = n.version AND p.column_name = n.column_name)"""
_DIFF = f"""{_BOTH}, d AS (SELECT asset, version, 'column_added' AS kind, column_name, prev_type, new_type FROM j WHERE prev_type IS NULL UNION ALL SELECT asset, version, 'column_dropped', column_name, prev_type, new_type FROM j WHERE new_type IS NULL
    UNION ALL SELECT asset, version, 'type_changed', column_name, prev_type, new_type FROM j WHERE prev_type <> new_type UNION ALL SELECT asset, version, CASE WHEN nn THEN 'nullable_added' ELSE 'nullable_removed' END, column_name, prev_type, new_type FROM j WHERE pn <> nn
    UNION ALL SELECT asset, version, 'default_changed', column_name, prev_type, new_type FROM j WHERE prev_type IS NOT NULL AND new_type IS NOT NULL AND pd IS DISTINCT FROM nd UNION ALL SELECT asset, version, 'comment_changed', column_name, prev_type, new_type FROM j WHERE pc <> nc
    UNION ALL SELECT asset, version, 'pk_changed', NULL, NULL, NULL FROM j GROUP BY asset, version HAVING coalesce(bool_or(pk), false) <> coalesce(bool_or(nk), false))"""
_WIDER = """CASE WHEN a = b THEN true WHEN a IN ('int16', 'int32', 'int64') AND b IN ('int16', 'int32', 'int64') THEN b >= a WHEN a = 'text' AND b LIKE 'varchar(%' THEN false WHEN b = 'text' AND a LIKE 'varchar(%' THEN true
    WHEN a LIKE 'varchar(%' AND b LIKE 'varchar(%' THEN CAST(regexp_extract(b, '[0-9]+') AS INT) >= CAST(regexp_extract(a, '[0-9]+') AS INT) END"""


def _columns(spark, sf):
    return fixture(spark, sf, "fx_schema_columns").withColumn("is_pk", F.col("column_name") == "c0")


@query(f"WITH {_DIFF} SELECT asset, version, kind, column_name, prev_type, new_type FROM d")
def schema_diff_history(spark, sf):
    return schemas.diff_history(_columns(spark, sf)).drop("place")


@query(f"""WITH {_DIFF}, c AS (SELECT *, prev_type AS a, new_type AS b FROM d), k AS (SELECT *, CASE WHEN kind = 'type_changed' THEN CASE WHEN coalesce({_WIDER}, false) THEN 'type_widened' ELSE 'type_narrowed' END ELSE kind END AS change_type FROM c)
           SELECT asset, version, column_name, change_type, change_type IN ('column_dropped', 'type_narrowed', 'nullable_removed', 'pk_changed') AS is_breaking FROM k""")
def classify_changes(spark, sf):
    return schemas.classify(schemas.diff_history(_columns(spark, sf))).select("asset", "version", "column_name", "change_type", "is_breaking")


@query(f"WITH t AS (SELECT DISTINCT type FROM fx_schema_columns), p AS (SELECT x.type AS a, y.type AS b FROM t x, t y) SELECT a, b, {_WIDER} AS wider FROM p")
def widening(spark, sf):
    t = fixture(spark, sf, "fx_schema_columns").select("type").distinct()
    both = t.select(F.col("type").alias("a")).groupBy().agg(F.collect_set("a").alias("x")).select(F.explode("x").alias("a"), F.col("x").alias("y")).select("a", F.explode("y").alias("b"))
    return both.withColumn("wider", schemas.is_widening(F.col("a"), F.col("b")))


@query("""WITH h AS (SELECT asset, version, string_agg(column_name || '|' || type || '|' || nullable || '|' || coalesce(default_value, '~'), ';' ORDER BY column_name) AS s FROM fx_schema_columns GROUP BY 1, 2)
          SELECT asset, version, count(*) OVER (PARTITION BY s)::BIGINT AS same FROM h""")
def schema_hashes(spark, sf):
    rows = _columns(spark, sf).withColumn("pk_position", F.when(F.col("is_pk"), 0))
    hashed = schemas.schema_hash(rows, ["asset", "version"])
    return hashed.join(hashed.groupBy("schema_hash").agg(F.count(F.lit(1)).alias("same")), "schema_hash").select("asset", "version", "same")


@query("""WITH m AS (SELECT asset, max(version) AS version FROM fx_schema_columns GROUP BY asset) SELECT asset, version + (asset > 'Brand#3')::INT AS version, asset <= 'Brand#3' AS touched FROM m""")
def captured_schemas(spark, sf):
    h = schemas.schema_hash(_columns(spark, sf).withColumn("pk_position", F.when(F.col("is_pk"), 0)), ["asset", "version"])
    old = h.select("asset", "version", "schema_hash", ts("2024-01-01 00:00:00").alias("captured_at"), ts("2024-01-01 00:00:00").alias("last_seen_at"))
    newest = relational.latest(h, "asset", "version").withColumn("schema_hash", F.when(F.col("asset") > "Brand#3", F.concat("schema_hash", F.lit("x"))).otherwise(F.col("schema_hash")))
    table, _ = schemas.capture_schemas(old, newest, now())
    return relational.latest(table, "asset", "version").select("asset", "version", (F.col("captured_at") < now()).alias("touched"))


_CHANGES = f"WITH {_DIFF}, c AS (SELECT *, prev_type AS a, new_type AS b FROM d), k AS (SELECT *, CASE WHEN kind = 'type_changed' THEN coalesce(NOT ({_WIDER}), true) ELSE kind IN ('column_dropped', 'nullable_removed', 'pk_changed') END AS is_breaking FROM c)"


def _changes(spark, sf):
    out = schemas.classify(schemas.diff_history(_columns(spark, sf)))
    acked = F.when((F.col("version") == 1) & F.col("column_name").isNotNull(), ts("2024-01-02 00:00:00"))
    return out.withColumns({"acknowledged_at": acked, "observed_at": F.timestamp_add("DAY", F.col("version"), ts("2024-01-01 00:00:00"))})


@query(f"{_CHANGES} SELECT asset, count(*) AS breaks FROM k WHERE is_breaking AND NOT (version = 1 AND column_name IS NOT NULL) GROUP BY asset")
def unacked_breaks(spark, sf):
    return schemas.unacked_breaks(_changes(spark, sf))


@query(f"{_CHANGES} SELECT version, kind FROM k WHERE asset = 'Brand#23' AND column_name = 'c5'")
def change_history(spark, sf):
    return schemas.change_history(_changes(spark, sf), "Brand#23", "c5").select("version", "kind")


@query(f"""WITH v AS ({_VER}), j AS (SELECT coalesce(p.asset, n.asset) AS asset, coalesce(p.column_name, n.column_name) AS column_name, p.type AS a, n.type AS b FROM (SELECT * FROM v WHERE version = 0) p
           FULL JOIN (SELECT * FROM v WHERE version = 3) n ON p.asset = n.asset AND p.column_name = n.column_name), k AS (SELECT asset FROM v WHERE version = 0 INTERSECT SELECT asset FROM v WHERE version = 3)
           SELECT asset, column_name, CASE WHEN a IS NULL THEN 'column_added' WHEN b IS NULL THEN 'column_dropped' WHEN coalesce({_WIDER}, false) THEN 'type_widened' ELSE 'type_narrowed' END AS change_type
           FROM j WHERE a IS DISTINCT FROM b AND asset IN (SELECT asset FROM k)""")
def version_diff(spark, sf):
    out = schemas.diff_versions(_columns(spark, sf), 0, 3)
    return out.filter(F.col("change_type").isin("column_added", "column_dropped", "type_widened", "type_narrowed")).select("asset", "column_name", "change_type")


# ---- runs, partitions, backfills ----------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m') AS month FROM events")
def partition_keys(spark, sf):
    return base(spark, sf, "events").select("event_id", *(partition_key(F.col("ts"), s).alias(n) for n, s in (("day", "daily"), ("week", "weekly"), ("month", "monthly"))))


@query("SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS day, strftime(ts - INTERVAL 7 DAY, '%G-W%V') AS week, strftime(ts - INTERVAL 1 MONTH, '%Y-%m') AS month FROM events")
def fired_keys(spark, sf):
    return base(spark, sf, "events").select("event_id", *(fired_partition_key(F.col("ts"), s).alias(n) for n, s in (("day", "daily"), ("week", "weekly"), ("month", "monthly"))))


_SPANS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate + INTERVAL '40' DAY AS DATE) AS b FROM orders"


@query(f"""WITH s AS ({_SPANS}) SELECT o_orderkey, strftime(d, '%G-W%V') AS partition_key FROM s, LATERAL (SELECT unnest(generate_series(date_trunc('week', a), b::TIMESTAMP, INTERVAL 7 DAY)) AS d)
           UNION ALL SELECT o_orderkey, strftime(d, '%Y-%m') FROM s, LATERAL (SELECT unnest(generate_series(date_trunc('month', a), b::TIMESTAMP, INTERVAL 1 MONTH)) AS d)
           UNION ALL SELECT o_orderkey, strftime(d, '%Y-%m-%d') FROM s, LATERAL (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS d)""")
def backfill_keys(spark, sf):
    spans = derived(spark, sf, _SPANS)
    days, weeks, months = (runs.keys_between(spans, "a", "b", s) for s in ("daily", "weekly", "monthly"))
    return weeks.unionByName(months).unionByName(days).select("o_orderkey", "partition_key")


_SPECS = "SELECT s_suppkey AS backfill_id, concat('asset_', CAST(s_suppkey % 40 AS VARCHAR(20))) AS asset, CASE s_suppkey % 4 WHEN 0 THEN '2024-01-01:2024-02-10' WHEN 1 THEN 'us, eu,us' WHEN 2 THEN '2024-03-01:2024-01-01' ELSE '2024-01,2024-02' END AS spec, CASE s_suppkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'category' WHEN 2 THEN 'daily' ELSE 'monthly' END AS strategy FROM supplier"


@query(f"""WITH s AS ({_SPECS}) SELECT backfill_id, strftime(d, '%Y-%m-%d') AS partition_key FROM s, LATERAL (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS d) WHERE backfill_id % 4 = 0
           UNION ALL SELECT backfill_id, k FROM s, (VALUES ('us'), ('eu')) v(k) WHERE backfill_id % 4 = 1 AND backfill_id % 8 = 1 UNION ALL SELECT backfill_id, k FROM s, (VALUES ('2024-01'), ('2024-02')) v(k) WHERE backfill_id % 4 = 3
           UNION ALL SELECT backfill_id, '!inverted range' FROM s WHERE backfill_id % 4 = 2 UNION ALL SELECT backfill_id, '!undeclared category' FROM s WHERE backfill_id % 8 = 5""")
def expanded_specs(spark, sf):
    specs = derived(spark, sf, _SPECS).withColumn("categories", F.when(F.col("backfill_id") % 8 == 1, F.array(F.lit("us"), F.lit("eu"), F.lit("apac"))).otherwise(F.array(F.lit("us"))))
    good, bad = runs.expand_specs(specs)
    return good.select("backfill_id", "partition_key").unionByName(bad.select("backfill_id", F.concat(F.lit("!"), "error").alias("partition_key")))


@query("SELECT backfill_id, state, count(*) AS n FROM fx_runs WHERE backfill_id IS NOT NULL GROUP BY 1, 2")
def backfill_status(spark, sf):
    return runs.backfill_status(fixture(spark, sf, "fx_runs"))


_WANTED = "SELECT event_id % 20 AS backfill_id, concat('asset_', CAST(user_id % 40 AS VARCHAR(20))) AS asset, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS partition_key FROM events"


@query(f"""WITH w AS (SELECT DISTINCT * FROM ({_WANTED})), b AS (SELECT DISTINCT asset_name AS asset, partition_date::VARCHAR AS partition_key FROM fx_runs WHERE state IN ('queued', 'starting', 'running'))
           SELECT backfill_id, count(*) FILTER (b.asset IS NULL) AS enqueued, count(*) FILTER (b.asset IS NOT NULL) AS skipped FROM w LEFT JOIN b ON w.asset = b.asset AND w.partition_key = b.partition_key GROUP BY 1""")
def plan_backfill(spark, sf):
    busy = fixture(spark, sf, "fx_runs").select(F.col("asset_name").alias("asset"), F.col("partition_date").cast("string").alias("partition_key"), "state")
    return runs.plan_backfill(derived(spark, sf, _WANTED), busy)[1]


@query("SELECT run_id, priority FROM fx_runs WHERE state = 'queued' ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'backfill' THEN 2 ELSE 1 END, queued_at, run_id LIMIT 100")
def queue_top(spark, sf):
    return relational.queue_order(fixture(spark, sf, "fx_runs"), 100).select("run_id", "priority")


@query("SELECT run_id, 'running' AS was, 'queued' AS state FROM fx_runs WHERE state = 'running' AND queued_at + to_seconds(300) < TIMESTAMP '2024-01-20 00:00:00'")
def stale_runs(spark, sf):
    beating = fixture(spark, sf, "fx_runs").withColumn("heartbeat_at", F.col("queued_at"))
    return runs.stale_runs(beating, ts("2024-01-20 00:00:00")).select("run_id", "was", "state")


def _cadenced(spark, sf):
    return fixture(spark, sf, "fx_schedules").select("schedule_id", F.element_at(F.array(F.lit(3600), F.lit(86400), F.lit(604800)), (F.col("schedule_id") % 3 + 1).cast("int")).alias("cadence_seconds"), F.timestamp_add("HOUR", F.col("schedule_id").cast("int"), ts("2024-01-25 00:00:00")).alias("next_fire_at"), (F.col("schedule_id") % 7 == 0).alias("paused"))


_CADENCE = "WITH s AS (SELECT schedule_id, CASE schedule_id % 3 WHEN 0 THEN 3600 WHEN 1 THEN 86400 ELSE 604800 END AS c, TIMESTAMP '2024-01-25 00:00:00' + to_hours(schedule_id) AS f FROM fx_schedules)"


@query(f"""{_CADENCE}, m AS (SELECT schedule_id, f, c, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - f) / c)::BIGINT AS missed FROM s WHERE f <= TIMESTAMP '2024-01-31 00:00:00')
           SELECT schedule_id, strftime(f + to_seconds(missed * c), '%Y-%m-%d %H:%M:%S') AS fire_at, missed FROM m""")
def missed_fires(spark, sf):
    return runs.missed_fires(_cadenced(spark, sf), now()).select("schedule_id", shown("fire_at"), "missed")


@query(f"{_CADENCE} SELECT schedule_id FROM s WHERE f <= TIMESTAMP '2024-01-31 00:00:00' AND schedule_id % 7 <> 0")
def due_schedules(spark, sf):
    return runs.due_schedules(_cadenced(spark, sf), now()).select("schedule_id")


@query("""WITH o AS (SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20) SELECT run_id, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS steps FROM o LEFT JOIN lineitem ON l_orderkey = run_id GROUP BY 1""")
def runs_with_steps(spark, sf):
    r = base(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("queued_at"))
    steps = base(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("topo_order"), F.col("l_partkey").cast("string").alias("asset"), F.col("l_linestatus").alias("state"))
    return runs.runs_with_steps(r, steps, 20, 1).select("run_id", F.array_join(F.transform("steps", lambda s: s["topo_order"].cast("string")), ",").alias("steps"))


_HISTORY = "SELECT user_id AS run_id, event_id, ts AS changed_at, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'starting' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state FROM events"


@query(f"""WITH h AS ({_HISTORY}), s AS (SELECT run_id, event_id, state AS after, lag(state) OVER (PARTITION BY run_id ORDER BY changed_at, event_id) AS before, changed_at FROM h)
           SELECT run_id, before, after, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS changed_at FROM s WHERE before IS NOT NULL
           AND (before, after) NOT IN (('queued', 'starting'), ('queued', 'canceled'), ('starting', 'running'), ('starting', 'failed'), ('starting', 'canceled'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'canceled'))""")
def illegal_transitions(spark, sf):
    return runs.illegal_transitions(derived(spark, sf, _HISTORY)).select("run_id", "before", "after", shown("changed_at"))


_VERSIONS = "SELECT concat('part:', CAST(p_partkey AS VARCHAR(20))) AS asset, p_type AS code_hash, CASE WHEN p_size % 3 = 0 THEN 'active' WHEN p_size % 3 = 1 THEN 'in_review' ELSE 'rejected' END AS governance_state FROM part"


@query(f"WITH v AS ({_VERSIONS}) SELECT asset, governance_state = 'active' AS runs FROM v")
def materialization_gate(spark, sf):
    v = derived(spark, sf, _VERSIONS)
    ok, blocked = runs.gate(v.select("asset", "code_hash"), v)
    return ok.select("asset", F.lit(True).alias("runs")).unionByName(blocked.select("asset", F.lit(False).alias("runs")))


_TRIGGERS = "SELECT concat('asset_', CAST(s_suppkey % 40 AS VARCHAR(20))) AS asset, concat('sensor_', CAST(s_suppkey AS VARCHAR(20))) AS name, CAST(10 * (s_suppkey % 9) AS INT) AS interval_seconds, s_suppkey FROM supplier"


@query(f"""WITH t AS ({_TRIGGERS}) SELECT asset, name, CASE WHEN s_suppkey % 2 = 0 THEN greatest(interval_seconds, 30) ELSE 60 END AS interval_seconds, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 <> 0 OR greatest(interval_seconds, 30) <> 60 ELSE false END AS changed
           FROM t WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""")
def synced_triggers(spark, sf):
    t = derived(spark, sf, _TRIGGERS)
    there = t.filter("s_suppkey % 3 = 0").select("asset", "name", F.lit(60).alias("interval_seconds"), ts("2024-01-01 00:00:00").alias("updated_at"))
    return runs.sync_triggers(there, t.filter("s_suppkey % 2 = 0"), now()).select("asset", "name", "interval_seconds", (F.col("updated_at") == now()).alias("changed"))


_TOKENS = "SELECT event_type AS tag, CAST(1 + event_id % 3 AS INT) AS weight FROM events"


@query(f"WITH t AS ({_TOKENS}), c AS (SELECT DISTINCT event_type AS tag, 1000::BIGINT AS capacity FROM events) SELECT tag, coalesce(sum(weight), 0)::BIGINT AS used, capacity, (capacity - coalesce(sum(weight), 0))::BIGINT AS free FROM c LEFT JOIN t USING (tag) GROUP BY tag, capacity")
def resource_usage(spark, sf):
    caps = base(spark, sf, "events").select(F.col("event_type").alias("tag")).distinct().withColumn("capacity", F.lit(1000).cast("long"))
    return relational.resource_usage(derived(spark, sf, _TOKENS), caps)


@query("SELECT p_brand, max(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def latest_parts(spark, sf):
    return relational.latest(base(spark, sf, "part"), "p_brand", "p_partkey").select("p_brand", "p_partkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_of_orders(spark, sf):
    return relational.page(base(spark, sf, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 25, 2).select("o_orderkey")


# ---- reviews, notifications ----------------------------------------------------------------------------------


@query("""WITH v AS (SELECT * FROM fx_votes WHERE decider_id <> submitter_id QUALIFY row_number() OVER (PARTITION BY review_id, decider_id ORDER BY voted_at, vote_id) = 1),
          c AS (SELECT *, count(*) FILTER (vote = 'approve') OVER (PARTITION BY review_id ORDER BY voted_at, vote_id ROWS UNBOUNDED PRECEDING) AS n FROM v),
          e AS (SELECT *, CASE WHEN vote = 'reject' THEN 'rejected' WHEN n >= quorum THEN 'approved' END AS ends FROM c),
          d AS (SELECT review_id, ends, decider_id FROM e WHERE ends IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY voted_at, vote_id) = 1)
          SELECT r.review_id, coalesce(d.ends, 'in_review') AS status, d.decider_id AS decided_by FROM (SELECT DISTINCT review_id FROM fx_votes) r LEFT JOIN d USING (review_id)""")
def review_tally(spark, sf):
    votes = fixture(spark, sf, "fx_votes").withColumns({"comment": F.lit("seen"), "pool_size": F.lit(3)})
    return reviews.tally(votes).select("review_id", "status", "decided_by")


_POOL = "SELECT s_suppkey, concat('a', CAST(s_suppkey AS VARCHAR(20))) AS asset, concat('owner', CAST(s_suppkey % 4 AS VARCHAR(20))) AS owner, s_suppkey % 3 = 0 AS named, s_suppkey % 2 = 0 AS tagged, s_suppkey % 5 = 0 AS pii_review FROM supplier"


@query(f"""WITH p AS ({_POOL}) SELECT asset, concat_ws(',', CASE WHEN named THEN 'stewards' END, CASE WHEN tagged THEN 'finance-team' END, CASE WHEN NOT named AND NOT tagged AND owner <> 'owner3' THEN owner || '-team' END, CASE WHEN pii_review THEN 'privacy-team' END) AS roles,
           concat_ws(',', CASE WHEN named THEN 'builder' END, CASE WHEN tagged THEN 'yaml-tag:finance' END, CASE WHEN NOT named AND NOT tagged AND owner <> 'owner3' THEN 'owner-fallback' END) AS source FROM p""")
def reviewer_roles(spark, sf):
    p = derived(spark, sf, _POOL)
    empty = F.array().cast("array<string>")
    defs = p.select("asset", F.when(F.col("named"), F.array(F.lit("stewards"), F.lit("stewards"))).otherwise(empty).alias("reviewer_roles"), F.when(F.col("tagged"), F.array(F.lit("finance"), F.lit("other"))).otherwise(empty).alias("tags"), "owner", F.lit(0).alias("quorum"), "pii_review", empty.alias("extra_roles"))
    owners = p.select("owner").distinct().filter("owner <> 'owner3'").withColumn("roles", F.array(F.concat("owner", F.lit("-team"))))
    tags = p.select(F.lit("finance").alias("tag")).distinct().withColumn("roles", F.array(F.lit("finance-team")))
    return reviews.reviewer_pool(defs, tags, owners).select("asset", ordered("roles"), ordered("source"))


_REVIEWS = "SELECT event_id AS review_id, ts AS submitted_at, CASE WHEN event_type IN ('click', 'view') THEN ts + INTERVAL '5' HOUR END AS decided_at, concat('owner', CAST(user_id % 4 AS VARCHAR(20))) AS owner FROM events"


@query(f"WITH r AS ({_REVIEWS}) SELECT review_id, concat_ws(',', 'stewards', CASE WHEN owner <> 'owner3' THEN owner || '-team' END, 'cdo') AS recipients FROM r WHERE decided_at IS NULL AND submitted_at + INTERVAL 48 HOUR < TIMESTAMP '2024-01-20 00:00:00'")
def review_breaches(spark, sf):
    r = derived(spark, sf, _REVIEWS)
    owners = r.select("owner").distinct().filter("owner <> 'owner3'").withColumn("roles", F.array(F.concat("owner", F.lit("-team")), F.lit("stewards")))
    asked = r.withColumns({"breach_emitted_at": F.lit(None).cast("timestamp_ntz"), "roles": F.array(F.lit("stewards")), "escalation_roles": F.array(F.lit("cdo"))})
    return reviews.review_breaches(asked, owners, ts("2024-01-20 00:00:00")).select("review_id", ordered("recipients"))


@query(f"WITH r AS ({_REVIEWS}) SELECT review_id FROM r WHERE owner = 'owner1' ORDER BY submitted_at DESC, review_id LIMIT 200")
def review_list(spark, sf):
    r = derived(spark, sf, _REVIEWS).withColumn("asset", F.col("owner"))
    return reviews.list_reviews(r, asset="owner1").select("review_id")


@query(f"WITH r AS ({_REVIEWS}) SELECT review_id, CASE WHEN decided_at IS NULL AND review_id % 3 = 0 THEN 'x,y' ELSE 'stewards' END AS roles FROM r")
def reassigned_reviews(spark, sf):
    r = derived(spark, sf, _REVIEWS).withColumn("roles", F.array(F.lit("stewards")))
    changes = r.filter("review_id % 3 = 0").select("review_id", F.array(F.lit("x"), F.lit("y"), F.lit("x")).alias("roles"))
    return reviews.reassign(r, changes).select("review_id", ordered("roles"))


_RULE_ROWS = [("*", "log"), ("policy.*", "governance"), ("role.assigned", "security"), ("mask*", "none")]


@query("""SELECT seq, channel FROM fx_audit_input, (VALUES ('*', 'log'), ('policy.*', 'governance'), ('role.assigned', 'security'), ('mask*', 'none')) r(pattern, channel)
          WHERE pattern = '*' OR pattern = event_type OR (pattern LIKE '%.*' AND starts_with(event_type, left(pattern, length(pattern) - 1)))""")
def routed_events(spark, sf):
    rules = spark.createDataFrame(_RULE_ROWS, "pattern string, channel string")
    return reviews.route(fixture(spark, sf, "fx_audit_input"), rules).select("seq", "channel")


_APPROVE = "SELECT DISTINCT p_brand AS asset, CASE WHEN p_brand LIKE '%3' THEN 'pending' ELSE 'clean' END AS drift_status, p_brand LIKE '%5' AS require_human_review FROM part"
_BRAND_META = "SELECT p_brand AS asset, concat('c', CAST(p_partkey % 23 AS VARCHAR(20))) AS column_name, CASE WHEN min(p_partkey) % 9 = 0 THEN 'pii' ELSE 'plain' END AS tag FROM part GROUP BY p_brand, concat('c', CAST(p_partkey % 23 AS VARCHAR(20)))"
_BRAND_POLICIES = "SELECT DISTINCT p_brand AS asset, concat('c', CAST(p_partkey % 23 AS VARCHAR(20))) AS column_name, p_brand >= 'Brand#3' AS superseded FROM part"
_FEW_RULES = "SELECT p_brand AS asset, concat('rule_', CAST(p_partkey AS VARCHAR(20))) AS rule_name, 'null_check' AS rule_type, concat('{\"column\":\"c', CAST(p_partkey % 23 + CASE WHEN p_partkey % 97 = 0 THEN 50 ELSE 0 END AS VARCHAR(20)), '\"}') AS config FROM part"


@query(f"""WITH {_DIFF}, v AS ({_APPROVE}), brk AS (SELECT DISTINCT asset FROM (SELECT *, prev_type AS a, new_type AS b FROM d) WHERE version = 3 AND kind = 'column_dropped'), m AS ({_BRAND_META}), q AS (SELECT * FROM ({_BRAND_POLICIES}) WHERE NOT superseded), r AS ({_FEW_RULES}),
           cov AS (SELECT m.asset, bool_or(tag = 'pii') AS has_pii, bool_or(tag = 'pii' AND q.asset IS NULL) AS bare FROM m LEFT JOIN q ON m.asset = q.asset AND m.column_name = q.column_name GROUP BY 1),
           mis AS (SELECT r.asset, min(json_extract_string(config, '$.column')) AS c FROM r WHERE NOT EXISTS (SELECT 1 FROM fx_schema_columns s WHERE s.asset = r.asset AND s.column_name = json_extract_string(r.config, '$.column')) GROUP BY 1),
           f AS (SELECT v.*, brk.asset IS NOT NULL AS b, coalesce(bare, false) AS bare, coalesce(has_pii, false) AS has_pii, c FROM v LEFT JOIN brk USING (asset) LEFT JOIN cov USING (asset) LEFT JOIN mis USING (asset)),
           g AS (SELECT *, b OR bare OR c IS NOT NULL OR drift_status = 'pending' AS blocked FROM f)
           SELECT asset, CASE WHEN blocked THEN 'blocked' WHEN has_pii OR require_human_review THEN 'must_human_review' ELSE 'auto_approved' END AS decision,
                  concat_ws(',', CASE WHEN b THEN 'schema_break_ack' END, CASE WHEN bare THEN 'pii_policy_consistency' END, CASE WHEN c IS NOT NULL THEN 'quality_config_sanity' END, CASE WHEN drift_status = 'pending' THEN 'lineage_drift' END,
                            CASE WHEN NOT blocked AND has_pii THEN 'pii_presence' WHEN NOT blocked AND require_human_review THEN 'require_human_review' END) AS failed_checks FROM g""".replace(", v AS (SELECT DISTINCT p_brand", ", w AS (SELECT DISTINCT p_brand").replace("FROM v LEFT JOIN brk", "FROM w LEFT JOIN brk").replace("SELECT v.*, brk", "SELECT w.*, brk"))
def auto_approval(spark, sf):
    changes = schemas.classify(schemas.diff_history(_columns(spark, sf))).filter("version = 3 and kind = 'column_dropped'").withColumn("acknowledged_at", F.lit(None).cast("timestamp_ntz"))
    meta = derived(spark, sf, _BRAND_META).withColumn("tags", F.array("tag"))
    out = reviews.auto_approve(derived(spark, sf, _APPROVE), changes, meta, derived(spark, sf, _BRAND_POLICIES), derived(spark, sf, _FEW_RULES), fixture(spark, sf, "fx_schema_columns"))
    return out.select("asset", "decision", ordered("failed_checks"))


# ---- audit, metadata, search ------------------------------------------------------------------------------------


def _audit_log(spark, sf):
    entries = fixture(spark, sf, "fx_audit_input").select(F.col("resource_id").alias("chain_key"), F.col("seq").alias("entry_id"), *audit.BODY)
    kinds = dict(entries.dtypes)
    none = spark.createDataFrame([], f"chain_key string, seq long, prev_hash binary, self_hash binary, {', '.join(f'{c} {kinds[c]}' for c in audit.BODY)}")
    return audit.append_audit(none, entries)


_TAMPERED = "(chain_key = 't3' AND seq = 5) OR (chain_key = 't7' AND seq = 20)"
_HASHED = """WITH RECURSIVE n AS (SELECT resource_id AS chain_key, row_number() OVER (PARTITION BY resource_id ORDER BY occurred_at, seq) AS k,
    unhex(lpad(hex(epoch_us(occurred_at) * 1000), 16, '0')) || encode(event_type || coalesce(actor_id, '') || resource_type || resource_id || coalesce(payload, '')) AS body FROM fx_audit_input),
    c(chain_key, k, h) AS (SELECT chain_key, k, sha256(unhex(lpad(hex(k), 16, '0')) || unhex(repeat('00', 32)) || body) FROM n WHERE k = 1
    UNION ALL SELECT n.chain_key, n.k, sha256(unhex(lpad(hex(n.k), 16, '0')) || unhex(c.h) || n.body) FROM c JOIN n ON n.chain_key = c.chain_key AND n.k = c.k + 1)"""


@query(f"{_HASHED} SELECT chain_key, k AS seq, h AS self_hash FROM c")
def audit_chain(spark, sf):
    return _audit_log(spark, sf).select("chain_key", "seq", F.lower(F.hex("self_hash")).alias("self_hash"))


@query("""WITH n AS (SELECT resource_id AS chain_key, count(*) AS scanned FROM fx_audit_input GROUP BY 1) SELECT chain_key, scanned, CASE WHEN chain_key = 't3' AND scanned >= 5 THEN 5 WHEN chain_key = 't7' AND scanned >= 20 THEN 20 END::BIGINT AS first_bad, false AS gap FROM n""")
def audit_verify(spark, sf):
    log = _audit_log(spark, sf)
    changed = log.withColumn("actor_id", F.when(F.expr(_TAMPERED), "someone else").otherwise(F.col("actor_id")))
    return audit.verify_audit(changed)


@query("""SELECT seq, strftime(CASE event_type WHEN 'role.assigned' THEN occurred_at + INTERVAL 10 DAY WHEN 'policy.changed' THEN NULL ELSE occurred_at + INTERVAL 5 DAY END, '%Y-%m-%d %H:%M:%S') AS expires_at FROM fx_audit_input""")
def audit_expiry(spark, sf):
    return audit.with_expiry(fixture(spark, sf, "fx_audit_input"), 5, {"role.assigned": 10, "policy.changed": 0}).select("seq", shown("expires_at"))


@query("""SELECT event_type, count(*) AS kept FROM fx_audit_input WHERE NOT coalesce(CASE event_type WHEN 'role.assigned' THEN occurred_at + INTERVAL 10 DAY WHEN 'policy.changed' THEN NULL ELSE occurred_at + INTERVAL 5 DAY END < TIMESTAMP '2024-01-31 00:00:00', false) GROUP BY 1""")
def audit_kept(spark, sf):
    kept, _ = audit.purge(audit.with_expiry(fixture(spark, sf, "fx_audit_input"), 5, {"role.assigned": 10, "policy.changed": 0}), now())
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


_PART_VERSIONS = "SELECT concat(p_name, ' ', CAST(p_partkey - p_partkey % 2 AS VARCHAR(20))) AS asset, p_type AS description, p_brand AS owner, p_size, p_partkey FROM part"


def _parts(spark, sf):
    rows = derived(spark, sf, _PART_VERSIONS)
    return rows.withColumns({"tags": F.array(F.concat(F.lit("size"), "p_size")), "created_at": F.timestamp_add("DAY", F.col("p_partkey").cast("int"), ts("2000-01-01 00:00:00"))})


_NEWEST = f"p AS (SELECT * FROM ({_PART_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY p_partkey DESC) = 1)"
_WORDS = "list_contains(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), '{}')"


def _rank(term: str) -> str:
    return " + ".join(f"CASE WHEN {_WORDS.format(c, term)} THEN {w} ELSE 0 END" for c, w in (("asset", 1.0), ("description", 0.4), ("owner", 0.2), ("concat('size', p_size)", 0.2)))


_KEPT: dict[tuple, search_index.TermIndex] = {}


def _kept(spark, sf, name, make, docs, of):
    """The index over docs(), built once for an application and its tables as they are; of: the tables' names."""
    when = [search_index.modified(spark, f"{sf}/{t}.parquet") for t in of]
    at = (spark.sparkContext.applicationId, sf, name, *when)
    if at not in _KEPT:
        _KEPT[at] = make(f"{shared_dir(spark)}/index-{name}-{uuid.uuid4().hex}").build(docs())
    return _KEPT[at]


def _part_index(spark, sf):
    return _kept(spark, sf, "parts", search_index.asset_index, lambda: metadata.asset_documents(_parts(spark, sf)), ["part"])


def _column_index(spark, sf):
    return _kept(spark, sf, "columns", search_index.column_index, lambda: metadata.column_documents(fixture(spark, sf, "fx_column_edges")), ["customer", "orders"])


@query(f"WITH {_NEWEST}, r AS (SELECT asset, {_rank('large')} AS a, {_rank('promo')} AS b FROM p) SELECT asset AS name, round(a + b, 6)::DOUBLE AS rank FROM r WHERE a > 0 AND b > 0")
def search_parts(spark, sf):
    return search_index.found(_part_index(spark, sf), spark, "asset", "LARGE promo").select("name", F.round("rank", 6).alias("rank"))


@query(f"WITH {_NEWEST}, r AS (SELECT asset, owner, {_rank('promo')} AS a FROM p WHERE p_size % 10 <> 0) SELECT asset AS name, round(a, 6)::DOUBLE AS rank FROM r WHERE a > 0 AND owner = 'Brand#4'")
def search_after_update(spark, sf):
    """An index over the first versions, then an update by the newest ones that also takes sizes of whole tens out, then a merge."""
    parts = _parts(spark, sf)
    first = parts.groupBy("asset").agg(F.min_by(F.struct("description", "owner", "tags"), "created_at").alias("v")).select("asset", "v.*").withColumn("tag_text", F.array_join("tags", " "))
    newest = metadata.asset_documents(parts)
    index = search_index.asset_index(f"{shared_dir(spark)}/index-updated-{uuid.uuid4().hex}").build(first)
    stays = F.col("p_size") % 10 != 0
    index.update(newest.filter(stays), newest.filter(~stays))
    index.merge(spark)
    return search_index.found(index, spark, "asset", "promo", owner="Brand#4").select("name", F.round("rank", 6).alias("rank"))


@query(f"WITH {_NEWEST} SELECT 'tag' AS facet, concat('size', p_size) AS value FROM p UNION SELECT 'owner', owner FROM p")
def facets(spark, sf):
    return relational.facets(relational.latest(_parts(spark, sf), "asset", "created_at"))


@query("""WITH n AS (SELECT DISTINCT a || '.' || c AS name, a, c FROM (SELECT from_asset AS a, from_column AS c FROM fx_column_edges WHERE superseded_at IS NULL UNION SELECT to_asset, to_column FROM fx_column_edges WHERE superseded_at IS NULL) x)
          SELECT name, 1.4::DOUBLE AS rank FROM n WHERE a LIKE 'nation:%' AND c = 'n_name'""")
def search_columns(spark, sf):
    # nation is a word of the asset, name one of the column
    return search_index.found(_column_index(spark, sf), spark, "column", "nation name").select("name", F.round("rank", 6).alias("rank"))


@query(f"WITH {_NEWEST} SELECT asset, owner FROM p ORDER BY p_partkey DESC LIMIT 50")
def asset_catalogue(spark, sf):
    return metadata.list_assets(_parts(spark, sf)).select("asset", "owner")


_RUNTIME = "SELECT concat(p_name, ' ', CAST(p_partkey - p_partkey % 2 AS VARCHAR(20))) AS asset, CASE WHEN p_partkey % 2 = 0 THEN concat('about ', p_type) ELSE '' END AS description, CASE WHEN p_partkey % 3 = 0 THEN 'new owner' ELSE '' END AS owner, p_partkey AS id FROM part WHERE p_partkey % 4 < 3"


@query(f"""WITH {_NEWEST}, r AS (SELECT * FROM ({_RUNTIME}) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY id DESC) = 1)
           SELECT p.asset, coalesce(nullif(r.description, ''), p.description) AS description, coalesce(nullif(r.owner, ''), p.owner) AS owner FROM p LEFT JOIN r USING (asset)""")
def effective_metadata(spark, sf):
    put = derived(spark, sf, _RUNTIME).withColumns({"column_name": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "set_at": F.timestamp_add("DAY", F.col("id").cast("int"), ts("2000-01-01 00:00:00"))})
    return metadata.effective_metadata(_parts(spark, sf), put).select("asset", "description", "owner")


@query(f"""WITH {_NEWEST}, r AS (SELECT asset, {_rank('10')} AS w FROM p), n AS (SELECT DISTINCT a || '.' || c AS name FROM (SELECT from_asset AS a, from_column AS c FROM fx_column_edges WHERE superseded_at IS NULL UNION SELECT to_asset, to_column FROM fx_column_edges WHERE superseded_at IS NULL)),
           u AS (SELECT 'asset' AS kind, asset AS name, w AS rank FROM r WHERE w > 0 UNION ALL SELECT 'column', name, 0.4 FROM n WHERE regexp_matches(name, '^[a-z]+:10[.]')) SELECT kind, name, round(rank, 6)::DOUBLE AS rank, (SELECT count(*) FROM u) AS total FROM u ORDER BY rank DESC, name, kind LIMIT 20""")
def search_combined(spark, sf):
    page, total = metadata.combined(search_index.found(_part_index(spark, sf), spark, "asset", "10"), search_index.found(_column_index(spark, sf), spark, "column", "10"))
    return page.select("kind", "name", F.round("rank", 6).alias("rank"), F.lit(total).cast("long").alias("total"))


@query(f"""WITH {_NEWEST} SELECT asset, concat_ws(',', 'size' || p_size, CASE WHEN owner <> 'size' || p_size THEN owner END) AS tags FROM p""")
def merged_tags(spark, sf):
    newest = relational.latest(_parts(spark, sf), "asset", "created_at")
    kind = ["id", "asset", "column_name", "description", "owner", "tags", "set_by", "set_at"]
    row = newest.withColumns({"id": F.lit(1), "column_name": F.lit(None).cast("string"), "set_by": F.lit("me"), "set_at": F.lit(1)})
    put = row.withColumns({"id": F.lit(2), "set_at": F.lit(2), "tags": F.array("owner", F.get("tags", F.lit(0)))})
    return metadata.put_metadata(row.select(*kind), put.select(*kind)).filter("id = 2").select("asset", ordered("tags"))


_REPORTED = "SELECT concat('customer:', CAST(o_custkey AS VARCHAR(20))) AS from_asset, 'c_name' AS from_column, concat('order:', CAST(o_orderkey AS VARCHAR(20))) AS to_asset, CASE WHEN o_orderkey % 4 = 0 THEN 'o_totalprice' ELSE 'o_clerk' END AS to_column FROM orders"


@query(f"""WITH a AS ({_HELD}), w AS ({_REPORTED}) SELECT coalesce(a.from_asset, w.from_asset) AS from_asset, coalesce(a.from_column, w.from_column) AS from_column, coalesce(a.to_asset, w.to_asset) AS to_asset, coalesce(a.to_column, w.to_column) AS to_column, a.from_asset IS NULL AS added, w.from_asset IS NOT NULL AS seen
           FROM a FULL JOIN w ON a.from_asset = w.from_asset AND a.from_column = w.from_column AND a.to_asset = w.to_asset AND a.to_column = w.to_column""")
def captured_column_edges(spark, sf):
    keys = ["from_asset", "from_column", "to_asset", "to_column"]
    have = lineage.active(fixture(spark, sf, "fx_column_edges")).dropDuplicates(keys).withColumn("last_seen_at", F.col("first_seen_at"))
    told = derived(spark, sf, _REPORTED).select(F.col("to_asset").alias("asset"), F.create_map("to_column", F.array(F.struct(F.col("from_asset").alias("asset"), F.col("from_column").alias("column")))).alias("lineage"))
    out = lineage.capture_column_edges(have.select(*keys, "first_seen_at", "last_seen_at", "superseded_at"), told, now())
    return out.select(*keys, (F.col("first_seen_at") == now()).alias("added"), (F.col("last_seen_at") == now()).alias("seen"))


@query("""SELECT concat('part:', CAST(p_partkey AS VARCHAR(20))) AS asset, CASE WHEN p_size % 3 = 0 THEN 'runtime' WHEN p_size % 2 = 0 THEN 'builder_default' ELSE 'undeclared' END AS source FROM part""")
def lineage_sources(spark, sf):
    parts = derived(spark, sf, "SELECT concat('part:', CAST(p_partkey AS VARCHAR(20))) AS asset, p_size FROM part")
    filled = lambda c: F.when(c, F.create_map(F.lit("c"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    run = parts.select("asset", filled(F.col("p_size") % 3 == 0).alias("lineage"))
    return lineage.resolve_lineage(run, parts.select("asset", filled(F.col("p_size") % 2 == 0).alias("lineage"))).select("asset", "source")


@query("""WITH v AS (SELECT DISTINCT p_brand AS asset, p_type AS code_hash, p_size < 25 AS old FROM part), o AS (SELECT DISTINCT asset, code_hash FROM v WHERE old), n AS (SELECT DISTINCT asset, code_hash FROM v WHERE NOT old EXCEPT SELECT asset, code_hash FROM o)
          SELECT asset, code_hash, 'pending' AS drift_status FROM o UNION ALL SELECT asset, code_hash, 'clean' FROM n""")
def registered_versions(spark, sf):
    v = base(spark, sf, "part").select(F.col("p_brand").alias("asset"), F.col("p_type").alias("code_hash"), "p_size")
    old = v.filter("p_size < 25").select("asset", "code_hash").distinct().withColumn("drift_status", F.lit("pending"))
    return lineage.register_versions(old, v.filter("p_size >= 25").select("asset", "code_hash"))


@query("""SELECT from_asset, to_asset, CASE WHEN superseded_at IS NULL AND to_asset LIKE 'order:%0' THEN 'run-' || to_asset END AS last_seen_run_id FROM fx_asset_edges""")
def attributed_runs(spark, sf):
    e = fixture(spark, sf, "fx_asset_edges").withColumns({"first_seen_run_id": F.lit(lineage.ZERO_RUN), "last_seen_run_id": F.lit(None).cast("string")})
    r = derived(spark, sf, "SELECT concat('order:', CAST(o_orderkey AS VARCHAR(20))) AS asset, CASE WHEN o_orderkey % 10 = 0 THEN concat('run-order:', CAST(o_orderkey AS VARCHAR(20))) END AS run_id FROM orders")
    return lineage.attribute_run(e, r).select("from_asset", "to_asset", "last_seen_run_id")


_PATCHES = "SELECT DISTINCT concat('t', CAST(c_custkey % 50 AS VARCHAR(20))) AS asset, concat('c', CAST(c_custkey % 7 AS VARCHAR(20))) AS column_name, 'redact' AS mask_type, CASE WHEN c_custkey % 2 = 0 THEN 'because' ELSE '' END AS reason FROM customer WHERE c_custkey % 350 < 40"


@query(f"""WITH w AS (SELECT * FROM ({_PATCHES}) WHERE reason <> '') SELECT asset, column_name, policy_id, CASE WHEN NOT superseded AND NOT (source = 'runtime' AND EXISTS (SELECT 1 FROM w WHERE w.asset = p.asset AND w.column_name = p.column_name)) THEN 'active' ELSE 'ended' END AS state FROM fx_policies p
           UNION ALL SELECT asset, column_name, -1, 'active' FROM w""")
def patched_policies(spark, sf):
    p = fixture(spark, sf, "fx_policies").withColumns({"superseded_at": F.when(F.col("superseded"), ts("2024-01-01 00:00:00")), "sync_status": F.lit("synced"), "first_seen_at": ts("2023-01-01 00:00:00")})
    table, _ = policies.patch_policies(p, derived(spark, sf, _PATCHES), now(), F.lit(-1).cast("long"))
    return table.select("asset", "column_name", "policy_id", F.when(F.col("superseded_at").isNull(), "active").otherwise("ended").alias("state"))


@query("""SELECT policy_id, CASE WHEN NOT superseded AND asset IN ('t1', 't2') THEN 'warehouse-native' ELSE enforcement_mode END AS enforcement_mode, CASE WHEN NOT superseded AND asset IN ('t1', 't2') THEN 'synced' ELSE 'pending' END AS sync_status FROM fx_policies""")
def policy_states(spark, sf):
    p = fixture(spark, sf, "fx_policies").withColumns({"superseded_at": F.when(F.col("superseded"), ts("2024-01-01 00:00:00")), "sync_status": F.lit("pending")})
    updates = p.filter(F.col("asset").isin("t1", "t2")).select("asset", "column_name").distinct().withColumns({"enforcement_mode": F.lit("warehouse-native"), "sync_status": F.lit("synced")})
    return policies.set_policy_state(p, updates).select("policy_id", "enforcement_mode", "sync_status")


@query("""SELECT event_id, concat('{"a":"', CAST(user_id AS VARCHAR), '","b":"', event_type, '"}') AS json FROM events""")
def canonical_payloads(spark, sf):
    return base(spark, sf, "events").select("event_id", canonical_json(F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), F.col("user_id").cast("string"))).alias("json"))


@query(f"""{_CHANGES} SELECT asset, version, kind, column_name, NOT (version = 1 AND column_name IS NOT NULL) AND kind = 'column_dropped' AND version = 3 AS acked FROM k""")
def acknowledged_changes(spark, sf):
    c = _changes(spark, sf).withColumn("change_id", F.concat_ws("|", "asset", "version", "kind", "column_name")).withColumns({"acknowledged_by": F.lit(None).cast("string"), "acknowledgement_reason": F.lit(None).cast("string")})
    acks = c.filter("kind = 'column_dropped' and version = 3").select("change_id", F.lit("me").alias("by"), F.lit("known").alias("reason"))
    return schemas.ack_changes(c, acks, now())[0].select("asset", "version", "kind", "column_name", F.col("acknowledged_by").isNotNull().alias("acked"))


@query("""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts, event_id) AS k FROM fx_sensor_evals),
    w(sensor, k, event_id, last_key, until, failures, off, outcome) AS (
        SELECT DISTINCT sensor, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), 0, false, '' FROM n
        UNION ALL
        SELECT sensor, k, event_id, CASE WHEN said = 'fired' THEN run_key ELSE last_key END, CASE WHEN said = 'fired' THEN CAST(ts AS TIMESTAMP) + INTERVAL 3600 SECOND ELSE until END,
               CASE WHEN off THEN failures WHEN errored THEN failures + 1 ELSE 0 END, off OR said = 'disabled_now', said
        FROM (SELECT n.*, w.last_key, w.until, w.failures, w.off,
                     CASE WHEN w.off THEN 'disabled' WHEN n.errored AND w.failures + 1 >= 60 THEN 'disabled_now' WHEN n.errored THEN 'evaluation_failed' WHEN NOT n.fired THEN 'evaluated'
                          WHEN n.run_key = w.last_key THEN 'dedup_skipped' WHEN n.ts < w.until THEN 'cooldown_skipped' ELSE 'fired' END AS said
              FROM w JOIN n ON n.sensor = w.sensor AND n.k = w.k + 1) AS x)
    SELECT sensor, event_id, outcome FROM w WHERE k > 0""")
def sensor_firings(spark, sf):
    return monitors.sensor_firings(fixture(spark, sf, "fx_sensor_evals"), 3600)


@query(f"""WITH p AS (SELECT * FROM ({_PART_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY p_partkey DESC) = 1)
           SELECT asset, sha256(concat('{{"asset":"', asset, '","description":"', description, '","owner":"', owner, '","upstreams":["', owner, '"],"tags":["size', p_size, '"],"columns":[{{"name":"', description, '","refs":["', owner,
                  '"]}}],"policies":[{{"column":"', description, '","mask":"hash","roles":["a","b"]}}],"rules":[{{"name":"r","config":"{{}}"}}]}}')) AS code_hash FROM p""")
def code_hashes(spark, sf):
    newest = relational.latest(_parts(spark, sf), "asset", "p_partkey")
    rows = newest.select("asset", "description", "owner", F.array("owner").alias("upstreams"), "tags", F.array(F.struct(F.col("description").alias("name"), F.array("owner").alias("refs"))).alias("columns"), F.array(F.struct(F.col("description").alias("column"), F.lit("hash").alias("mask"), F.array(F.lit("b"), F.lit("a")).alias("roles"), F.lit("why").alias("reason"))).alias("policies"), F.array(F.struct(F.lit("r").alias("name"), F.lit("{}").alias("config"))).alias("rules"))
    return schemas.code_hash(rows)
