"""Schema versions as long tables (one row a column): hashes, capture, diffs and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Raw PostgreSQL type names and their tokens.
PLAIN_TYPES = {
    "smallint": "int16", "integer": "int32", "bigint": "int64", "real": "float32", "double precision": "float64", "boolean": "bool", "text": "text",
    "timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp", "date": "date", "jsonb": "jsonb", "json": "json", "uuid": "uuid", "bytea": "bytea",
}
SIZED_TYPES = {"character varying": "varchar", "character": "char"}
BREAKING = ("column_dropped", "type_narrowed", "nullable_removed", "pk_changed")
HARMLESS = ("column_added", "type_widened", "nullable_added", "comment_changed", "default_changed")
MOST_COLUMNS = 10_000


def normalize_type(raw: Column, length: Column, precision: Column, scale: Column) -> Column:
    """The token of a raw type; unknown ones keep their name behind ?:."""
    name, out = F.lower(raw), None
    for k, v in PLAIN_TYPES.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    for k, v in SIZED_TYPES.items():
        out = out.when((name == k) & length.isNotNull(), F.concat(F.lit(f"{v}("), length.cast("string"), F.lit(")"))).when(name == k, v)
    sizes = F.concat_ws(",", precision.cast("string"), F.when(precision.isNotNull(), scale.cast("string")))
    out = out.when(name == "numeric", F.when(sizes == "", "decimal").otherwise(F.concat(F.lit("decimal("), sizes, F.lit(")"))))
    return out.otherwise(F.concat(F.lit("?:"), raw))


def is_widening(old: Column, new: Column) -> Column:
    """true for a widening or no change, false for a narrowing, null where the lattice does not know."""
    a, b = F.trim(old), F.trim(new)

    def rank(t: Column, names: tuple[str, ...]) -> Column:
        return F.array_position(F.array(*map(F.lit, names)), t)

    def number(t: Column, pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("long")

    # the text family is ordered by length, text itself has no bound
    varchar = r"^varchar\((\d+)\)$"
    size = lambda t: F.when(t == "text", F.lit(2**62)).otherwise(number(t, varchar))
    decimal = r"^decimal\((\d+),\s*(\d+)\)$"
    out = F.when(a == b, True)
    for family in (("int16", "int32", "int64"), ("float32", "float64")):
        out = out.when((rank(a, family) > 0) & (rank(b, family) > 0), rank(b, family) >= rank(a, family))
    out = out.when(size(a).isNotNull() & size(b).isNotNull(), size(b) >= size(a))
    return out.when(a.rlike(decimal) & b.rlike(decimal), (number(b, decimal) >= number(a, decimal)) & (number(b, decimal, 2) >= number(a, decimal, 2)))


def classify(changes: DataFrame) -> DataFrame:
    """change_type and is_breaking for `kind`: a type change widens only where the lattice says so, and what is unknown breaks."""
    wider = F.coalesce(is_widening(F.col("prev_type"), F.col("new_type")), F.lit(False))
    final = F.when(F.col("kind") == "type_changed", F.when(wider, "type_widened").otherwise("type_narrowed")).otherwise(F.col("kind"))
    return changes.withColumn("change_type", final).withColumn("is_breaking", ~F.col("change_type").isin(*HARMLESS))


def schema_hash(columns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, schema_hash, n_columns.  The order of columns and their comments do not count, the order of the key does (is_pk, pk_position)."""
    one = F.struct(F.col("column_name").alias("name"), "type", "nullable", F.coalesce("default_value", F.lit("\0")).alias("default"), "is_pk")
    pk = F.struct(F.col("pk_position").alias("at"), F.col("column_name").alias("name"))
    grouped = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("c"), F.array_sort(F.collect_list(F.when(F.col("is_pk"), pk))).alias("p"), F.count(F.lit(1)).alias("n_columns"))
    return grouped.select(*keys, F.sha2(F.to_json(F.struct("c", F.transform("p", lambda x: x["name"]).alias("p"))), 256).alias("schema_hash"), "n_columns")


def choose_captures(assets: DataFrame, described: DataFrame, resulted: DataFrame) -> DataFrame:
    """asset, schema_hash, n_columns, source of each of assets.asset: what its connector describes, else what its run's result shows, else unsupported.

    described and resulted: asset, schema_hash, n_columns, one row an asset.
    """
    side = lambda df, name: df.select("asset", F.struct("schema_hash", "n_columns").alias(name))
    both = assets.select("asset").distinct().join(side(described, "d"), "asset", "left").join(side(resulted, "r"), "asset", "left")
    source = F.when(F.col("d").isNotNull(), "descriptor").when(F.col("r").isNotNull(), "result").otherwise("unsupported")
    return both.withColumn("c", F.coalesce("d", "r")).select("asset", "c.schema_hash", "c.n_columns", source.alias("source"))


def capture_schemas(versions: DataFrame, captured: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new version table, failures) after captures (asset, schema_hash, n_columns).

    versions: asset, version, schema_hash, captured_at, last_seen_at.  A capture equal to the newest
    version touches it, another one is the next version; captures without columns or with more than
    10,000 fail.
    """
    ok = (F.col("n_columns") > 0) & (F.col("n_columns") <= MOST_COLUMNS)
    failed = captured.filter(~ok).select("asset", F.lit("capture_failed").alias("status"))
    newest = versions.groupBy("asset").agg(F.max_by(F.struct("version", "schema_hash"), "version").alias("top"))
    both = captured.filter(ok).select("asset", F.col("schema_hash").alias("new_hash")).join(newest, "asset", "left")
    same = F.coalesce(F.col("top.schema_hash") == F.col("new_hash"), F.lit(False))
    touched = both.filter(same).select("asset", F.col("top.version").alias("version"), F.lit(True).alias("hit"))
    kept = versions.join(touched, ["asset", "version"], "left").withColumn("last_seen_at", F.when(F.col("hit"), now).otherwise(F.col("last_seen_at"))).select(*versions.columns)
    added = both.filter(~same).select("asset", (F.coalesce(F.col("top.version"), F.lit(-1)) + 1).alias("version"), F.col("new_hash").alias("schema_hash"), now.alias("captured_at"), now.alias("last_seen_at"))
    return kept.unionByName(added.select(*versions.columns)), failed


def schema_diff(prev: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, column_name, prev_type, new_type, order of the changes from prev to new (long tables).

    A column may change in several ways; a renamed one is dropped and added.  A change of the key has
    no column.  `place` orders added, dropped, changed columns and the key.
    """
    names = ["type", "nullable", "default_value", "comment", "is_pk"]
    a = prev.select(*keys, "column_name", F.struct(*names).alias("a"))
    b = new.select(*keys, "column_name", F.struct(*names).alias("b"))
    both = a.join(b, [*keys, "column_name"], "full_outer")
    change = lambda kind, when, place: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind")))
    added, dropped = F.col("a").isNull(), F.col("b").isNull()
    there = ~added & ~dropped
    found = F.array(
        change("column_added", added, 0), change("column_dropped", dropped, 1), change("type_changed", there & (F.col("a.type") != F.col("b.type")), 2),
        change("nullable_added", there & ~F.col("a.nullable") & F.col("b.nullable"), 3), change("nullable_removed", there & F.col("a.nullable") & ~F.col("b.nullable"), 3),
        change("default_changed", there & ~F.col("a.default_value").eqNullSafe(F.col("b.default_value")), 4), change("comment_changed", there & ~F.col("a.comment").eqNullSafe(F.col("b.comment")), 5),
    )
    columns = both.select(*keys, "column_name", F.col("a.type").alias("prev_type"), F.col("b.type").alias("new_type"), F.explode(F.array_compact(found)).alias("c")).select(*keys, "c.place", "c.kind", "column_name", "prev_type", "new_type")
    key_of = lambda side: F.array_sort(F.collect_list(F.when(F.coalesce(F.col(f"{side}.is_pk"), F.lit(False)), F.col("column_name"))))
    key = both.groupBy(*keys).agg(key_of("a").alias("ka"), key_of("b").alias("kb")).filter("ka <> kb")
    null = F.lit(None).cast("string")
    return columns.unionByName(key.select(*keys, F.lit(6).alias("place"), F.lit("pk_changed").alias("kind"), null.alias("column_name"), null.alias("prev_type"), null.alias("new_type")))


def diff_history(columns: DataFrame) -> DataFrame:
    """asset, version and the changes from the version before it, for the whole history in one job."""
    versions = columns.select("asset", "version").distinct()
    steps = versions.withColumn("before", F.lag("version").over(Window.partitionBy("asset").orderBy("version"))).filter("before is not null")
    after = columns.join(steps, ["asset", "version"])
    before = columns.withColumnRenamed("version", "before").join(steps, ["asset", "before"])
    return schema_diff(before, after, ["asset", "version"])


def diff_versions(columns: DataFrame, a: int, b: int) -> DataFrame:
    """The classified changes of every asset between two versions by number."""
    pick = lambda v: columns.filter(F.col("version") == v).drop("version")
    both = pick(a).select("asset").distinct().join(pick(b).select("asset").distinct(), "asset")
    return classify(schema_diff(pick(a).join(both, "asset", "left_semi"), pick(b).join(both, "asset", "left_semi"), ["asset"]))


def change_history(changes: DataFrame, asset: str, column: str | None = None) -> DataFrame:
    out = changes.filter(F.col("asset") == asset)
    return (out.filter(F.col("column_name") == column) if column else out).orderBy("observed_at")


def ack_changes(changes: DataFrame, acks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(changes with acknowledgements, rejected acks): acks (change_id, by, reason) need a reason and a change that is not acknowledged yet; the first of several counts."""
    reasoned = F.coalesce(F.length(F.trim("reason")) > 0, F.lit(False))
    first = acks.filter(reasoned).groupBy("change_id").agg(F.min(F.struct("by", "reason")).alias("ack"))
    both = changes.join(first, "change_id", "left")
    takes = F.col("ack").isNotNull() & F.col("acknowledged_at").isNull()
    updated = both.withColumns({"acknowledged_at": F.when(takes, now).otherwise(F.col("acknowledged_at")), "acknowledged_by": F.when(takes, F.col("ack.by")).otherwise(F.col("acknowledged_by")), "acknowledgement_reason": F.when(takes, F.col("ack.reason")).otherwise(F.col("acknowledgement_reason"))}).select(*changes.columns)
    open_ = changes.filter(F.col("acknowledged_at").isNull()).select("change_id")
    late = acks.filter(reasoned).join(open_, "change_id", "left_anti").withColumn("rejected", F.lit("already acknowledged or unknown"))
    return updated, acks.filter(~reasoned).withColumn("rejected", F.lit("reason required")).unionByName(late)


def unacked_breaks(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("is_breaking") & F.col("acknowledged_at").isNull()).groupBy("asset").agg(F.count(F.lit(1)).alias("breaks"))


def code_hash(definitions: DataFrame) -> DataFrame:
    """asset, code_hash.  Orders of upstreams, tags, columns, references, policies, roles and rules do not count, nor do the reasons of policies.

    definitions: asset, description, owner, upstreams, tags, columns array<struct<name, refs>>,
    policies array<struct<column, mask, roles, reason>>, rules array<struct<name, config>>.
    """
    columns = F.array_sort(F.transform("columns", lambda c: F.struct(c["name"].alias("name"), F.array_sort(c["refs"]).alias("refs"))))
    policies = F.array_sort(F.transform("policies", lambda p: F.struct(p["column"].alias("column"), p["mask"].alias("mask"), F.array_sort(p["roles"]).alias("roles"))))
    whole = F.struct("asset", "description", "owner", F.array_sort("upstreams").alias("upstreams"), F.array_sort("tags").alias("tags"), columns.alias("columns"), policies.alias("policies"), F.array_sort("rules").alias("rules"))
    return definitions.select("asset", F.sha2(F.to_json(whole), 256).alias("code_hash"))
