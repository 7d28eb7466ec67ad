"""Round trips through the database that ships with Spark."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources import files

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "log"))
    return "jdbc:derby:memory:ledger;create=true"


@pytest.fixture(scope="module")
def orders(spark, small, url):
    df = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    # a third of all rows hold one key, a few none
    df = df.withColumn("hot", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).when(F.col("o_orderkey") % 50 == 1, F.lit(None)).otherwise(F.col("o_custkey") * F.col("o_custkey")))
    files.write_jdbc(df, url, "orders", batch=500, **DRIVER)
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"part_col": "o_orderkey"}, {"part_col": "o_orderkey", "bounds": (0, 6000), "partitions": 3}, {"part_col": "hot"}, {"part_col": "o_totalprice", "partitions": 5}])
def test_what_was_written_is_read(spark, url, orders, options):
    assert rows(files.read_jdbc(spark, url, "orders", **options, **DRIVER)) == rows(orders)


def test_slices_hold_about_as_many_rows(spark, url, orders):
    back = files.read_jdbc(spark, url, "orders", part_col="o_totalprice", partitions=6, **DRIVER)
    sizes = [r.n for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert back.rdd.getNumPartitions() == 6 and max(sizes) < 1.3 * sum(sizes) / 6


def test_every_row_meets_one_predicate_of_a_hot_column(spark, url, orders):
    slices = files.jdbc_slices(spark, url, "orders", "hot", 8, **DRIVER)
    met = files.read_jdbc(spark, url, "orders", **DRIVER).select([F.when(F.expr(s.replace('"', "`")), 1).otherwise(0).alias(f"s{i}") for i, s in enumerate(slices)])
    assert met.filter(" + ".join(met.columns) + " <> 1").count() == 0 and len(slices) > 2


def test_limit_and_appending(spark, url, orders):
    assert files.read_jdbc(spark, url, "orders", limit=7, **DRIVER).count() == 7
    one = orders.limit(1)
    for _ in range(2):
        files.write_jdbc(one, url, "Odd name", **DRIVER)
    assert files.read_jdbc(spark, url, "Odd name", part_col="o_orderkey", **DRIVER).count() == 2


def test_empty_and_constant_columns_are_one_slice(spark, url, orders):
    files.write_jdbc(orders.limit(0), url, "none", **DRIVER)
    assert files.read_jdbc(spark, url, "none", part_col="o_orderkey", **DRIVER).count() == 0
    assert files.jdbc_slices(spark, url, "none", "o_orderkey", 8, **DRIVER) == ["1 = 1"]


def test_text_columns_need_bounds_and_names_are_checked(spark, url, orders):
    with pytest.raises(ValueError):
        files.read_jdbc(spark, url, "orders", part_col="o_orderstatus", **DRIVER)
    for name in ('or"ders', "a;b", "a..b", ""):
        with pytest.raises(ValueError):
            files.read_jdbc(spark, url, name, **DRIVER)
