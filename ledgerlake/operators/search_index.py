"""A kept inverted index: searches read the postings of their terms, changes cost what they touch.

A folder on storage that all machines share holds three Parquet tables:

  postings  bucket=b               term, key, weight: the build and what was merged since, sorted by term
  changes   number=n / bucket=b    term, key, weight of the documents that update n put in
  changed   number=n               the keys that update n put in or took out

A bucket is a hash of the term, so a search prunes to its terms' folders.  A posting counts if its update is the last one
that names its key (postings: if none does).  An update appends, and is there once its `changed` is.
A merge rewrites only the buckets that hold postings of changed keys, old or new; until the changes are removed
(`changed` first, oldest first) they hide what it wrote, so a merge that is cut short can be run again.  One writer at a
time; a search that runs while a merge replaces its bucket has to be repeated.

Defined cases: rows without a key are left out, rows that share a key add up, null fields are empty, a search
without terms or filters finds nothing, an empty table is an index that finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import dealt, stored
from .metadata import highlight, query_terms, term_index

TASK_DOCS, TASK_POSTINGS = 60_000, 1_000_000  # of one task of a build or merge
KIND = "term string, key string, weight double, bucket int"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def modified(spark: SparkSession, path: str) -> int:
    """When a table's file or folder last changed."""
    system, at = _file_system(spark, path)
    return system.getFileStatus(at).getModificationTime()


@dataclass(frozen=True)
class TermIndex:
    """fields: text column -> weight A, B or C; exact: label -> column (string or array) whose whole values a search can filter by."""

    path: str
    key: str
    fields: dict[str, str]
    exact: dict[str, str] = field(default_factory=dict)
    buckets: int = 32  # folders; a listing of more becomes a job of its own

    def _postings(self, docs: DataFrame) -> DataFrame:
        docs = dealt(stored(docs.filter(F.col(self.key).isNotNull()), "index-docs"), self.key, rows=TASK_DOCS)
        found = term_index(docs, self.key, self.fields).select("term", F.col(self.key).cast("string").alias("key"), "weight")
        for label, c in self.exact.items():
            values = F.explode(F.col(c).cast("array<string>")) if docs.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
            filters = docs.select(F.col(self.key).cast("string").alias("key"), values.alias("value")).filter("value is not null")
            found = found.unionByName(filters.select(F.concat(F.lit(f"{label}="), "value").alias("term"), "key", F.lit(0.0).alias("weight")).distinct())
        return found.withColumn("bucket", self._bucket(F.col("term")))

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, to: str, **options: str) -> None:
        """A common term's bucket is split over tasks and files of about TASK_POSTINGS; counts of the buckets say over how many."""
        rows = stored(rows, "index-rows")
        sizes = {r.bucket: -(-r["count"] // TASK_POSTINGS) for r in rows.groupBy("bucket").count().collect()}
        first = dict(zip(sizes, accumulate(sizes.values(), initial=0)))
        share = F.pmod(F.xxhash64("key", "term"), F.get(F.array(*map(F.lit, (sizes.get(b, 1) for b in range(self.buckets)))), F.col("bucket")))
        place = F.get(F.array(*map(F.lit, (first.get(b, 0) for b in range(self.buckets)))), F.col("bucket")) + share
        rows.repartitionById(max(1, sum(sizes.values())), place.cast("int")).sortWithinPartitions("bucket", "term").write.options(**options).mode("overwrite").partitionBy("bucket").parquet(to)

    def _numbers(self, spark: SparkSession, table: str) -> list[int]:
        """Numbers of the updates that the table has."""
        system, at = _file_system(spark, f"{self.path}/{table}")
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("number="))

    def build(self, docs: DataFrame) -> TermIndex:
        spark = docs.sparkSession
        for table in ("changed", "changes"):
            system, at = _file_system(spark, f"{self.path}/{table}")
            system.delete(at, True)
        self._write(self._postings(docs), f"{self.path}/postings")
        return self

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts docs in, in place of what had their keys, and takes out the keys of `gone` that are not among them."""
        spark = docs.sparkSession
        number = 1 + max([0, *self._numbers(spark, "changes"), *self._numbers(spark, "changed")])
        self._write(self._postings(docs), f"{self.path}/changes/number={number}")
        keys = [d.select(F.col(self.key).cast("string").alias("key")) for d in (docs, gone) if d is not None]
        reduce(DataFrame.unionByName, keys).filter("key is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/changed/number={number}")

    def _last(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("key string, number int").parquet(f"{self.path}/changed").groupBy("key").agg(F.max("number").alias("last"))

    def current(self, spark: SparkSession, only=None) -> DataFrame:
        """term, key, weight, bucket of the documents as they are now; only: a condition on term and bucket."""
        pick = lambda df: df if only is None else df.filter(only)
        base = pick(spark.read.schema(KIND).parquet(f"{self.path}/postings"))
        if not self._numbers(spark, "changed"):
            return base
        new = pick(spark.read.schema(f"{KIND}, number int").parquet(f"{self.path}/changes"))
        both = base.withColumn("number", F.lit(0)).unionByName(new).join(self._last(spark), "key", "left")
        return both.filter(F.col("number") == F.coalesce("last", F.lit(0))).select("term", "key", "weight", "bucket")

    def search(self, spark: SparkSession, q: str, **exact: str) -> DataFrame:
        """key, rank of the documents with all terms of q and all exact values."""
        terms = [*query_terms(q), *(f"{label}={value}" for label, value in exact.items())]
        if unknown := set(exact) - set(self.exact):
            raise ValueError(f"not kept: {', '.join(sorted(unknown))}")
        if not query_terms(q):
            return self.current(spark, F.lit(False)).select("key", F.col("weight").alias("rank"))
        here = F.col("bucket").isin(*(self._bucket(F.lit(t)) for t in terms)) & F.col("term").isin(*terms)
        hits = self.current(spark, here).groupBy("key").agg(F.sum("weight").alias("rank"), F.count(F.lit(1)).alias("n"))
        return hits.filter(F.col("n") == len(terms)).select("key", "rank")

    def merge(self, spark: SparkSession) -> list[int]:
        """Brings the changes into the postings; the buckets that were rewritten."""
        numbers = self._numbers(spark, "changed")
        touched = []
        if numbers:
            last = stored(self._last(spark), "index-last")
            base = spark.read.schema(KIND).parquet(f"{self.path}/postings")
            new = spark.read.schema(f"{KIND}, number int").parquet(f"{self.path}/changes")
            # at most as many rows as there are buckets
            old_ones = base.select("key", "bucket").join(last, "key", "left_semi").select("bucket")
            touched = sorted(r.bucket for r in old_ones.unionByName(new.select("bucket")).distinct().collect())
            rows = stored(self.current(spark, F.col("bucket").isin(touched)), "index-merge")
            full = {r.bucket for r in rows.select("bucket").distinct().collect()}
            self._write(rows, f"{self.path}/postings", partitionOverwriteMode="dynamic")
            for b in set(touched) - full:
                system, at = _file_system(spark, f"{self.path}/postings/bucket={b}")
                system.delete(at, True)
        for n in sorted({*numbers, *self._numbers(spark, "changes")}):
            for table in ("changed", "changes"):
                system, at = _file_system(spark, f"{self.path}/{table}/number={n}")
                system.delete(at, True)
        return touched


# ---- the catalogue's two indexes ---------------------------------------------------------------------------


def asset_index(path: str, buckets: int = 32) -> TermIndex:
    """Over rows of metadata.asset_documents: names weigh most, then descriptions, then owners and tags."""
    return TermIndex(path, "asset", {"asset": "A", "description": "B", "owner": "C", "tag_text": "C"}, {"tag": "tags", "owner": "owner"}, buckets)


def column_index(path: str, buckets: int = 32) -> TermIndex:
    """Over rows of metadata.column_documents."""
    return TermIndex(path, "name", {"column": "A", "asset": "B"}, {}, buckets)


def found(index: TermIndex, spark: SparkSession, kind: str, q: str, tag: str | None = None, owner: str | None = None) -> DataFrame:
    """kind, name, title, rank as of metadata.search_assets and search_columns, from the index."""
    exact = {label: v for label, v in (("tag", tag), ("owner", owner)) if v}
    hits = index.search(spark, q, **exact)
    return hits.select(F.lit(kind).alias("kind"), F.col("key").alias("name"), highlight(F.col("key"), q).alias("title"), "rank")
