"""The kept index: pruned reads, updates equal to a rebuild, merges that touch what changed."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.session import shared_dir
from ledgerlake.operators import search_index

KIND = "asset string, description string, owner string, tags array<string>"
DOCS = [("orders daily", "orders of a day", "ann", ["gold"]), ("orders raw", None, "bob", ["raw", "raw"]), ("customers", "who orders", "ann", None), (None, "orders", "x", []), ("empty", "", None, [])]


def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("tag_text", F.array_join("tags", " "))


def index(spark, name, rows, buckets=16):
    return search_index.asset_index(f"{shared_dir(spark)}/test-index-{name}-{os.urandom(4).hex()}", buckets).build(docs(spark, rows))


def found(at, spark, q, **exact):
    return {r.key: round(r["rank"], 6) for r in at.search(spark, q, **exact).collect()}


def everything(at, spark):
    return sorted((r.term, r.key, round(r.weight, 6), r.bucket) for r in at.current(spark).collect())


def files(at):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{at.path}/postings") for f in fs if f.endswith(".parquet")}


def test_searches_and_filters(spark):
    at = index(spark, "find", DOCS)
    assert found(at, spark, "ORDERS") == {"orders daily": 1.4, "orders raw": 1.0, "customers": 0.4}
    assert found(at, spark, "orders", owner="ann") == {"orders daily": 1.4, "customers": 0.4}
    assert found(at, spark, "orders", owner="ann", tag="gold") == {"orders daily": 1.4}
    assert found(at, spark, "orders nothing") == found(at, spark, " ,") == found(at, spark, "orders", owner="an") == {}
    with pytest.raises(ValueError):
        at.search(spark, "orders", source="x")


def test_a_search_reads_its_buckets_only(spark):
    at = index(spark, "prune", DOCS)
    plan = at.search(spark, "orders ann")._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :].split("PushedFilters")
    assert "bucket" in part[0] and "xxhash64" not in part[0] and "In(term" in part[1]


@pytest.mark.parametrize("merged", [False, True])
def test_updates_equal_a_rebuild(spark, merged):
    at = index(spark, "update", DOCS)
    first = [("orders raw", "raw rows", "cat", ["new"]), ("parts", "orders of parts", "ann", [])]
    at.update(docs(spark, first), docs(spark, [DOCS[2], DOCS[0]]))
    second = [("parts", "spare parts", "bob", ["gold"]), ("customers", "buyers", "ann", [])]
    at.update(docs(spark, second))
    if merged:
        at.merge(spark)
        assert at.merge(spark) == []
    assert everything(at, spark) == everything(index(spark, "rebuilt", [first[0], *second, DOCS[4]]), spark)
    assert found(at, spark, "orders") == {"orders raw": 1.0} and found(at, spark, "daily") == {}


def test_a_merge_rewrites_only_touched_buckets(spark):
    at = index(spark, "merge", DOCS, buckets=64)
    before = files(at)
    at.update(docs(spark, [("empty", "word", None, [])]))
    touched = at.merge(spark)
    assert 0 < len(touched) <= 2
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept <= files(at) and len(kept) > 5


def test_a_merge_that_was_cut_short_changes_nothing_and_can_be_run_again(spark):
    at = index(spark, "cut", DOCS)
    at.update(docs(spark, [("orders raw", "changed", "cat", [])]), docs(spark, DOCS[:1]))
    want = everything(at, spark)
    rows = [(r.term, r.key, r.weight, r.bucket) for r in at.current(spark).collect()]
    # postings written, changes still there
    at._write(spark.createDataFrame(rows, search_index.KIND), f"{at.path}/postings", partitionOverwriteMode="dynamic")
    assert everything(at, spark) == want
    at.merge(spark)
    assert everything(at, spark) == want


def test_empty_tables(spark):
    at = index(spark, "empty", [])
    assert found(at, spark, "orders") == {}
    at.update(docs(spark, DOCS[:1]))
    assert found(at, spark, "orders") == {"orders daily": 1.4}
    at.update(docs(spark, []), docs(spark, DOCS[:1]))
    at.merge(spark)
    assert everything(at, spark) == []


def test_no_task_of_a_build_holds_more_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(search_index, "TASK_POSTINGS", 100, raising=False)
    rows = [(f"orders {i}", "orders of a day", "ann", ["gold"]) for i in range(2000)]
    at = index(spark, "large", rows)
    held = spark.read.parquet(f"{at.path}/postings").groupBy(F.input_file_name().alias("file")).count()
    assert held.agg(F.max("count")).first()[0] <= 200
    assert at.search(spark, "orders gold").count() == 2000 and found(at, spark, "orders 7") == {"orders 7": 2.4}
