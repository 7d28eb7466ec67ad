"""Column masking policies: applying them, precedence, upkeep, drift, and PII tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import apply_mask, warehouse_mask
from ..functions.session import is_empty, stored

SOURCES = ("runtime", "builder", "yaml-default")
MASKS = ("hash", "redact", "partial")
KEY = ["asset", "column_name"]


def apply_masks(df: DataFrame, rules: dict[str, str], salt: str = "") -> DataFrame:
    """df with the masks (column -> mask) on its text columns; other types, absent columns and nulls stay."""
    text = {n for n, t in df.dtypes if t == "string"}
    return df.select(*(F.when(F.col(n).isNotNull(), apply_mask(F.col(n), rules[n], salt)).alias(n) if n in rules and n in text else F.col(n) for n in df.columns))


def masked_view(df: DataFrame, policies: dict[str, tuple[str, list[str]]], role: str, style: str = "pipeline", salt: str = "") -> DataFrame:
    """df as a role sees it; policies: column -> (mask, roles that see the value)."""
    text = {n for n, t in df.dtypes if t == "string"}

    def seen(n: str) -> Column:
        if n not in policies or n not in text:
            return F.col(n)
        mask, roles = policies[n]
        hidden = warehouse_mask(F.col(n), mask) if style == "warehouse" else F.when(F.col(n).isNotNull(), apply_mask(F.col(n), mask, salt))
        return F.when(F.array_contains(F.array(*map(F.lit, roles)).cast("array<string>"), role), F.col(n)).otherwise(hidden).alias(n)

    return df.select(*map(seen, df.columns))


def source_rank(source: Column) -> Column:
    return F.when(source == "runtime", 0).when(source == "builder", 1).when(source == "yaml-default", 2).otherwise(3)


def active_policies(policies: DataFrame) -> DataFrame:
    return policies.filter(~F.col("superseded"))


def effective_policies(policies: DataFrame) -> DataFrame:
    """Of the active policies of a column the one of the strongest source, the newest id among equals; an aggregate without a window."""
    best = F.min_by(F.struct(*policies.columns), F.struct(source_rank(F.col("source")), -F.col("policy_id")))
    return active_policies(policies).groupBy(*KEY).agg(best.alias("p")).select("p.*")


def mask_rules(policies: DataFrame, pii: DataFrame) -> DataFrame:
    """asset, column_name, mask_type that the pipeline itself has to apply: policies it enforces, and redaction of PII columns without any active policy."""
    inside = effective_policies(policies.filter(F.col("enforcement_mode").isin("in-pipeline", "unknown"))).select(*KEY, "mask_type")
    bare = pii.filter("pii").select(*KEY).join(active_policies(policies).select(*KEY), KEY, "left_anti").distinct()
    return inside.unionByName(bare.withColumn("mask_type", F.lit("redact")))


def policy_assets(policies: DataFrame) -> DataFrame:
    return active_policies(policies).select("asset").distinct().orderBy("asset")


def list_policies(policies: DataFrame, asset: str | None = None, source: str | None = None) -> DataFrame:
    out = active_policies(policies)
    out = out.filter(F.col("asset") == asset) if asset else out
    return out.filter(F.col("source") == source) if source else out


def apply_policies(policies: DataFrame, declared: DataFrame, now: Column, code_hash: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table, changes) after assets declared their builder policies.

    policies: asset, column_name, mask_type, source, code_hash_first, code_hash_latest, first_seen_at,
    superseded_at; declared: asset, column_name, mask_type, code_hash.  Vanished policies are retired,
    equal ones touched, changed ones retired and inserted with their first hash, new ones inserted.
    """
    mine = (F.col("source") == "builder") & F.col("superseded_at").isNull()
    rest = policies.filter(~mine)
    both = policies.filter(mine).join(declared.select(*KEY, F.col("mask_type").alias("new_mask"), F.col("code_hash").alias("new_hash")), KEY, "full_outer")
    old, new = F.col("mask_type").isNotNull(), F.col("new_mask").isNotNull()
    action = F.when(old & ~new, "retired").when(~old & new, "inserted").when(F.col("mask_type") == F.col("new_mask"), "touched").otherwise("changed")
    merged = stored(both.withColumn("action", action))
    row = lambda mask, last, seen, end: [*KEY, F.col(mask).alias("mask_type"), F.lit("builder").alias("source"), F.coalesce("code_hash_first", "new_hash").alias("code_hash_first"), last.alias("code_hash_latest"), seen.alias("first_seen_at"), end.alias("superseded_at")]
    none = F.lit(None).cast("timestamp_ntz")
    retired = merged.filter(F.col("action").isin("retired", "changed")).select(*row("mask_type", F.col("code_hash_latest"), F.col("first_seen_at"), now))
    kept = merged.filter(F.col("action") == "touched").select(*row("mask_type", F.col("new_hash"), F.col("first_seen_at"), none))
    added = merged.filter(F.col("action").isin("inserted", "changed")).select(*row("new_mask", F.col("new_hash"), now, none))
    table = reduce(DataFrame.unionByName, [rest.select(*retired.columns), retired, kept, added])
    changes = merged.filter(F.col("action") != "touched").select(*KEY, "action", F.col("mask_type").alias("before"), F.col("new_mask").alias("after"))
    return table, changes


def patch_policies(policies: DataFrame, patches: DataFrame, now: Column, next_id: Column) -> tuple[DataFrame, DataFrame]:
    """(new table, rejected) after runtime overrides (asset, column_name, mask_type, reason): the runtime row before is retired, a pending one inserted."""
    ok = F.coalesce((F.length(F.trim("reason")) > 0) & F.col("mask_type").isin(*MASKS), F.lit(False))
    good, bad = patches.filter(ok), patches.filter(~ok)
    table = _retire(policies, good, now)
    new = good.select(*KEY, "mask_type", F.lit("runtime").alias("source"), F.lit("pending").alias("sync_status"), now.alias("first_seen_at"), next_id.alias("policy_id"))
    return table.unionByName(new, allowMissingColumns=True), bad


def delete_policies(policies: DataFrame, removals: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new table, rejected): the runtime rows of (asset, column_name, reason) end; a reason is needed."""
    ok = F.coalesce(F.length(F.trim("reason")) > 0, F.lit(False))
    return _retire(policies, removals.filter(ok), now), removals.filter(~ok)


def _retire(policies: DataFrame, hit: DataFrame, now: Column) -> DataFrame:
    both = policies.join(hit.select(*KEY, F.lit(True).alias("hit")).distinct(), KEY, "left")
    ends = F.col("hit") & (F.col("source") == "runtime") & F.col("superseded_at").isNull()
    return both.withColumn("superseded_at", F.when(ends, now).otherwise(F.col("superseded_at"))).select(*policies.columns)


def apply_tag_defaults(policies: DataFrame, metadata: DataFrame, tag_masks: DataFrame) -> DataFrame:
    """asset, column_name, mask_type, source: default masks of an asset's tags for each of its columns with an active policy; the first tag in order wins."""
    tagged = metadata.select("asset", F.explode("tags").alias("tag")).join(F.broadcast(tag_masks) if tag_masks.count() < 10_000 else tag_masks, "tag")
    mask = tagged.groupBy("asset").agg(F.min_by("mask_type", "tag").alias("mask_type"))
    return active_policies(policies).select(*KEY).distinct().join(mask, "asset").select(*KEY, "mask_type", F.lit("yaml-default").alias("source"))


def policy_drift(expected: DataFrame, actual: DataFrame, now: Column | None = None, grace_seconds: int = 0) -> DataFrame:
    """asset, column_name, drift (missing, different, extra), expected, actual; expected policies (first_seen_at) younger than the grace are left out."""
    young = F.lit(False) if now is None else F.timestamp_add("SECOND", F.lit(grace_seconds), F.col("first_seen_at")) > now
    want = expected.select(*KEY, F.col("mask_type").alias("expected"), young.alias("young"))
    both = want.join(actual.select(*KEY, F.col("mask_type").alias("actual")), KEY, "full_outer")
    drift = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("actual"), "different")
    return both.filter(~F.coalesce("young", F.lit(False))).withColumn("drift", drift).filter("drift is not null").select(*KEY, "drift", "expected", "actual")


def set_policy_state(policies: DataFrame, updates: DataFrame) -> DataFrame:
    """Active rows take enforcement_mode and sync_status of updates (asset, column_name, both nullable)."""
    both = policies.join(updates.select(*KEY, F.col("enforcement_mode").alias("m"), F.col("sync_status").alias("s"), F.lit(True).alias("hit")), KEY, "left")
    hit = F.col("hit") & F.col("superseded_at").isNull()
    return both.withColumns({"enforcement_mode": F.when(hit, F.coalesce("m", "enforcement_mode")).otherwise(F.col("enforcement_mode")), "sync_status": F.when(hit, F.coalesce("s", "sync_status")).otherwise(F.col("sync_status"))}).select(*policies.columns)


# ---- PII tags -------------------------------------------------------------------------------------------


def propagate_pii(column_edges: DataFrame, tags: DataFrame) -> DataFrame:
    """asset, column_name, contributors: columns with an active upstream column that is PII; overridden columns are left out."""
    held = column_edges.filter(F.col("superseded_at").isNull())
    up = tags.select(F.col("asset").alias("from_asset"), F.col("column_name").alias("from_column"), "pii")
    joined = held.join(up, ["from_asset", "from_column"], "left").withColumn("pii", F.coalesce("pii", F.lit(False)))
    name = F.concat_ws(".", "from_asset", "from_column")
    reached = joined.groupBy(F.col("to_asset").alias("asset"), F.col("to_column").alias("column_name")).agg(F.bool_or("pii").alias("pii"), F.array_sort(F.collect_set(F.when(F.col("pii"), name))).alias("contributors"))
    fixed = tags.filter(F.col("source") == "override").select(*KEY)
    return reached.filter("pii").drop("pii").join(fixed, KEY, "left_anti")


def propagate_pii_all(column_edges: DataFrame, tags: DataFrame) -> DataFrame:
    """asset, column_name of every column that PII reaches over any number of steps; overrides stop it."""
    steps = stored(column_edges.filter(F.col("superseded_at").isNull()).select("from_asset", "from_column", "to_asset", "to_column").distinct())
    fixed = tags.filter(F.col("source") == "override").select(*KEY)
    now = stored(tags.filter("pii").select(*KEY).distinct())
    seen = now
    while not is_empty(now):
        move = now.toDF("from_asset", "from_column").join(steps, ["from_asset", "from_column"]).select(F.col("to_asset").alias("asset"), F.col("to_column").alias("column_name")).distinct()
        now = stored(move.join(fixed, KEY, "left_anti").join(seen, KEY, "left_anti"))
        seen = stored(seen.unionByName(now))
    return seen


def apply_pii_overrides(tags: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new tags, audit rows): overrides (asset, column_name, pii) win and are audited the first time."""
    both = tags.join(overrides.select(*KEY, F.col("pii").alias("forced")), KEY, "full_outer")
    table = both.select(*KEY, F.coalesce("forced", "pii").alias("pii"), F.when(F.col("forced").isNotNull(), "override").otherwise(F.col("source")).alias("source"))
    known = tags.filter(F.col("source") == "override").select(*KEY)
    return table, overrides.join(known, KEY, "left_anti").select(*KEY, "pii", F.lit("pii.overridden").alias("event_type"))


def pii_coverage(metadata: DataFrame, policies: DataFrame) -> DataFrame:
    """asset, has_pii, missing_policy: whether columns tagged pii (asset, column_name, tags) lack an active policy."""
    tagged = metadata.select(*KEY, F.coalesce(F.array_contains("tags", "pii"), F.lit(False)).alias("pii"))
    covered = active_policies(policies).select(*KEY, F.lit(True).alias("covered")).distinct()
    return tagged.join(covered, KEY, "left").groupBy("asset").agg(F.bool_or("pii").alias("has_pii"), F.bool_or(F.col("pii") & F.col("covered").isNull()).alias("missing_policy"))
