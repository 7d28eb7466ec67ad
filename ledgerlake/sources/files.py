"""File and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet": "parquet", "csv": "csv", "ndjson": "json", "json": "json"}


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, limit: int = 0) -> DataFrame:
    """Parquet, CSV with a header, or one JSON object a line, from any Hadoop file system; limit 0 means all rows."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.format(FORMATS[fmt])
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.limit(limit) if limit > 0 else df


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Replaces the target; with partition_by only the partitions that df holds."""
    writer = df.write.format(FORMATS[fmt]).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def _quoted(spark: SparkSession, url: str, name: str, parts: int = 1) -> str:
    """A name as the database quotes it, taken letter for letter; a table's may have up to three parts, with dots between."""
    split = name.split(".") if parts > 1 else [name]
    if len(split) > parts or not all(split) or any(c in name for c in "\"`[];\0"):
        raise ValueError(f"not a name: {name!r}")
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return ".".join(dialect.quoteIdentifier(p) for p in split)


BUCKETS = 64  # of a histogram, for each slice


def jdbc_slices(spark: SparkSession, url: str, table: str, column: str, partitions: int, **options: str) -> list[str]:
    """Predicates that cut a table along a numeric column into at most `partitions` slices of about as many rows each, nulls in the first.

    The database counts rows in BUCKETS equal widths a slice and returns the counts alone; cuts lie between buckets, so a
    narrow crowd of values stays together.  Every row meets exactly one predicate, also rows that arrive in the meantime.
    """

    def ask(sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load()

    of, c = _quoted(spark, url, table, 3), _quoted(spark, url, column)
    kinds = {f.name: f.dataType for f in ask(f"SELECT {c} FROM {of}").schema.fields}
    if not isinstance(kinds[column], T.NumericType):
        raise ValueError(f"{column} is no number: name bounds")
    low, high = ask(f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM {of}").first()
    if low is None or low == high or partitions < 2:
        return ["1 = 1"]
    low, width = float(low), (float(high) - float(low)) / (BUCKETS * partitions)
    inner = f"SELECT FLOOR(({c} - ({low!r})) / {width!r}) AS bucket FROM {of} WHERE {c} IS NOT NULL"
    counts = sorted((int(b), int(n)) for b, n in ask(f"SELECT bucket, COUNT(*) AS n FROM ({inner}) counted GROUP BY bucket").collect())
    total, run, due, cuts = sum(n for _, n in counts), 0, 1, []
    for bucket, n in counts[:-1]:
        run += n
        if run * partitions >= total * due:
            cuts.append(low + (bucket + 1) * width)
            due = run * partitions // total + 1
    if not cuts:
        return ["1 = 1"]
    between = [f"{c} >= {x!r} AND {c} < {y!r}" for x, y in zip(cuts, cuts[1:])]
    return [f"{c} < {cuts[0]!r} OR {c} IS NULL", *between, f"{c} >= {cuts[-1]!r}"]


def read_jdbc(spark: SparkSession, url: str, table: str, part_col: str | None = None, bounds: tuple | None = None, partitions: int = 8, limit: int = 0, **options: str) -> DataFrame:
    """A database table; with part_col it is read in parallel slices, of equal widths between bounds where these are given, else of about equal counts."""
    of = _quoted(spark, url, table, 3)
    if part_col and bounds is None:
        df = spark.read.jdbc(url, of, predicates=jdbc_slices(spark, url, table, part_col, partitions, **options), properties=options)
    else:
        reader = spark.read.format("jdbc").options(url=url, dbtable=of, **options)
        if part_col:
            reader = reader.options(partitionColumn=part_col, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
        df = reader.load()
    return df.limit(limit) if limit > 0 else df


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=_quoted(df.sparkSession, url, table, 3), batchsize=str(batch), **options).mode("append").save()


def _plain(table: str) -> str:
    parts = table.split(".")
    if not 1 <= len(parts) <= 3 or not all(p and p.replace("_", "a").isalnum() for p in parts):
        raise ValueError(f"not a table name: {table!r}")
    return table


def read_warehouse(spark: SparkSession, kind: str, table: str, limit: int = 0, **options: str) -> DataFrame:
    """BigQuery or Snowflake through their Spark connectors, which have to be on the class path."""
    if kind not in ("bigquery", "snowflake"):
        raise ValueError(f"unknown warehouse {kind!r}")
    df = spark.read.format(kind).options(**({"table": table} if kind == "bigquery" else {"dbtable": _plain(table)}), **options).load()
    return df.limit(limit) if limit > 0 else df


TOKENS = {"smallint": "int16", "integer": "int32", "int": "int32", "bigint": "int64", "real": "float32", "float": "float32", "double": "float64", "boolean": "bool", "string": "text", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "date": "date", "binary": "bytea"}


def type_token(kind: T.DataType) -> str:
    """The normalised type token of a Spark type; kinds without one keep their own name behind ?:."""
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    return TOKENS.get(kind.simpleString(), f"?:{kind.simpleString()}")


def describe_schema(df: DataFrame, pk: list[str] | None = None) -> DataFrame:
    """One row a column: position, name, type token, nullable, default, is_pk, comment."""
    pk = pk or []
    rows = [(i, f.name, type_token(f.dataType), f.nullable, f.metadata.get("default"), f.name in pk, f.metadata.get("comment")) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean, default_value string, is_pk boolean, comment string")


def conformance(df: DataFrame, fmt: str, path: str) -> DataFrame:
    """Writes df, reads it back and reports what differs: rows lost, rows added, columns whose type or nullability changed, before and after.

    Columns count whatever their order.  File sources read every column as nullable, so a required one is reported.
    """
    write_files(df, path, fmt)
    back = read_files(df.sparkSession, path, fmt, schema=None if fmt == "parquet" else df.schema).select(*df.columns)
    lost, added = df.exceptAll(back), back.exceptAll(df)
    report = lost.agg(F.lit("rows_lost").alias("check"), F.count(F.lit(1)).alias("n")).unionByName(added.agg(F.lit("rows_added").alias("check"), F.count(F.lit(1)).alias("n")))
    a, b = (describe_schema(x).select("name", "type", "nullable") for x in (df, back))
    return report.unionByName(a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit("columns").alias("check"), F.count(F.lit(1)).alias("n")))
