from datetime import datetime

from pyspark.sql import functions as F

from ledgerlake.operators import quality
from ledgerlake.streaming import monitors

EVALS = "sensor string, event_id long, ts timestamp_ntz, fired boolean, run_key string, errored boolean"


def evaluations(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("s", 1, t(0), True, "a", False), ("s", 2, t(1), True, "a", False), ("s", 3, t(2), True, "b", False), ("s", 4, t(20), True, "b", False), ("s", 5, t(21), False, None, True), ("s", 6, t(22), False, None, True), ("s", 7, t(23), True, "c", False)]
    return spark.createDataFrame(rows, EVALS)


WANT = {1: "fired", 2: "dedup_skipped", 3: "cooldown_skipped", 4: "fired", 5: "evaluation_failed", 6: "disabled_now", 7: "disabled"}


def run(df, name, **options):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").options(**options).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sensors_in_batch_and_stream(spark, tmp_path):
    out = {r.event_id: r.outcome for r in monitors.sensor_firings(evaluations(spark), 600, 2).collect()}
    assert out == WANT
    evaluations(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVALS).parquet(f"{tmp_path}/in")
    got = run(monitors.sensor_stream(stream, 600, 2), "sensors", checkpointLocation=f"{tmp_path}/cp")
    assert {r.event_id: r.outcome for r in got.collect()} == WANT


def test_stream_of_masks_routes_and_quality(spark, tmp_path):
    kind = "event_type string, resource_type string, resource_id string"
    spark.createDataFrame([("run.failed", "run", "secret-name"), ("nonsense", "run", "x")], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    masked = run(monitors.masked_stream(stream, {"resource_id": "partial"}), "masked", checkpointLocation=f"{tmp_path}/cp1")
    assert {r.resource_id for r in masked.collect()} == {"se*******me", "***"}
    rules = spark.createDataFrame([("run.*", "ops"), ("*", "log")], "pattern string, channel string")
    valid, quarantine = monitors.routed_stream(stream, rules)
    assert {r.channel for r in run(valid, "routed", checkpointLocation=f"{tmp_path}/cp2").collect()} == {"ops", "log"}
    assert run(quarantine, "bad", checkpointLocation=f"{tmp_path}/cp3").count() == 1
    sink = monitors.quality_sink([quality.NullCheck("resource_id")], f"{tmp_path}/results")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp4").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.status, r.batch_id) for r in spark.read.parquet(f"{tmp_path}/results").collect()] == [("passed", 0)]


def test_freshness_stream(spark, tmp_path):
    kind = "asset_name string, finished_at timestamp"
    rows = [[("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")], [("b", "2024-01-01 05:00:00")], [("b", "2024-01-01 05:30:00")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "asset_name string, t string").select("asset_name", F.col("t").cast("timestamp").alias("finished_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    spark.createDataFrame([], kind)
    import shutil

    (tmp_path / "all").mkdir()
    for i in range(3):
        for p in (tmp_path / f"in{i}").glob("*.parquet"):
            shutil.copy(p, tmp_path / "all" / f"{i}-{p.name}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all").withWatermark("finished_at", "0 seconds")
    out = run(monitors.freshness_stream(stream, 3600), "fresh", checkpointLocation=f"{tmp_path}/cp")
    got = {(r.asset_name, r.breached_at) for r in out.collect()}
    assert ("a", datetime(2024, 1, 1, 1)) in got


def test_sensor_state_is_carried_over_batches(spark):
    rows = [(f"s{i % 2}", i, 60 * i, i % 3 == 0, f"k{i // 40}", i % 11 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "sensor string, event_id long, at long, fired boolean, run_key string, errored boolean").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))
    whole = sorted(map(tuple, monitors.sensor_firings(df, 600, 5).collect()))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, monitors.sensor_firings(df, 600, 5).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len({r[2] for r in whole}) >= 4
