"""Governance reviews: automatic decisions, reviewer pools, votes, deadlines, and notification routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ordered_union
from .policies import pii_coverage
from .quality import rules_missing_columns
from .schemas import unacked_breaks

REVIEW_HOURS = 48
QUORUM_ALL = -1
PRIVACY_TEAM = "privacy-team"


def auto_approve(versions: DataFrame, changes: DataFrame, metadata: DataFrame, policies: DataFrame, rules: DataFrame, columns: DataFrame) -> DataFrame:
    """asset, decision, reason, failed_checks of versions (asset, drift_status, require_human_review).

    Blocked by an unacknowledged break, a PII column without policy, a rule on a missing column or
    pending drift; then left to people if there is PII or the asset asks for it; else approved.  The
    first check that fails gives the reason.
    """
    missing = rules_missing_columns(rules, columns).groupBy("asset").agg(F.min("column_name").alias("missing_column"))
    facts = versions.join(unacked_breaks(changes), "asset", "left").join(pii_coverage(metadata, policies), "asset", "left").join(missing, "asset", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    hard = [
        (F.col("breaks").isNotNull(), "schema_break_ack", F.lit("unacknowledged breaking schema change")),
        (yes(F.col("missing_policy")), "pii_policy_consistency", F.lit("PII column without policy")),
        (F.col("missing_column").isNotNull(), "quality_config_sanity", F.concat(F.lit("quality rule references missing column: "), F.col("missing_column"))),
        (yes(F.col("drift_status") == "pending"), "lineage_drift", F.lit("lineage drift unacknowledged")),
    ]
    blocked = hard[0][0] | hard[1][0] | hard[2][0] | hard[3][0]
    pii = ~blocked & yes(F.col("has_pii"))
    forced = ~blocked & ~pii & yes(F.col("require_human_review"))
    checks = [*hard, (pii, "pii_presence", F.lit("PII columns require human review")), (forced, "require_human_review", F.lit("human review is required"))]
    failed = F.array_compact(F.array(*(F.when(c, name) for c, name, _ in checks)))
    reason = F.coalesce(*(F.when(c, r) for c, _, r in checks), F.lit(""))
    decision = F.when(blocked, "blocked").when(pii | forced, "must_human_review").otherwise("auto_approved")
    return facts.select("asset", decision.alias("decision"), reason.alias("reason"), failed.alias("failed_checks"))


def reviewer_pool(definitions: DataFrame, tag_roles: DataFrame, owners: DataFrame) -> DataFrame:
    """asset, roles, quorum, source of definitions (asset, reviewer_roles, tags, owner, quorum, pii_review, extra_roles).

    Roles of the definition, then of its tags in order; those of the owner only if there are none.
    The privacy team joins where PII is the reason for the review.
    """
    tagged = definitions.select("asset", F.explode("tags").alias("tag")).join(tag_roles.filter(F.size("roles") > 0), "tag")
    by_tag = tagged.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("tag", "roles"))).alias("t"))
    both = definitions.join(by_tag, "asset", "left").join(owners.select("owner", F.col("roles").alias("owner_roles")), "owner", "left")
    empty = F.array().cast("array<string>")
    from_tags = F.coalesce(F.flatten(F.transform("t", lambda x: x["roles"])), empty)
    named = F.coalesce("reviewer_roles", empty)
    alone = (F.size(named) == 0) & (F.size(from_tags) == 0)
    owned = alone & (F.size(F.coalesce("owner_roles", empty)) > 0)
    roles = ordered_union(named, from_tags, F.when(owned, F.col("owner_roles")), F.col("extra_roles"), F.when(F.col("pii_review"), F.array(F.lit(PRIVACY_TEAM))))
    tag_names = F.coalesce(F.transform("t", lambda x: F.concat(F.lit("yaml-tag:"), x["tag"])), empty)
    source = F.concat(F.when(F.size(named) > 0, F.array(F.lit("builder"))).otherwise(empty), tag_names, F.when(owned, F.array(F.lit("owner-fallback"))).otherwise(empty))
    return both.select("asset", roles.alias("roles"), F.when(F.col("quorum") == 0, 1).otherwise(F.coalesce("quorum", F.lit(1))).alias("quorum"), source.alias("source"))


def tally(votes: DataFrame) -> DataFrame:
    """review_id, status, decided_at, decided_by, approvals of votes (review_id, submitter_id, decider_id, vote, comment, quorum, pool_size, voted_at, vote_id).

    A submitter's own vote does not count, nor a second one of a decider, nor a rejection without a
    comment.  Votes are read in order: the first rejection or the approval that fills the quorum
    (-1: the pool's size, 1 at least) decides, and later votes are ignored.
    """
    commented = (F.col("vote") != "reject") | (F.length(F.trim(F.coalesce("comment", F.lit("")))) > 0)
    valid = votes.filter((F.col("decider_id") != F.col("submitter_id")) & commented)
    first = valid.groupBy("review_id", "decider_id").agg(F.min_by(F.struct(*votes.columns), F.struct("voted_at", "vote_id")).alias("v")).select("v.*")
    order = Window.partitionBy("review_id").orderBy("voted_at", "vote_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.greatest(F.when(F.col("quorum") < 0, F.col("pool_size")).otherwise(F.col("quorum")), F.lit(1))
    counted = first.withColumn("approvals", F.count_if(F.col("vote") == "approve").over(order))
    ends = F.when(F.col("vote") == "reject", "rejected").when(F.col("approvals") >= need, "approved")
    marked = counted.withColumn("ends", ends)
    when = F.when(F.col("ends").isNotNull(), F.struct("voted_at", "vote_id"))
    decided = marked.groupBy("review_id").agg(F.min_by(F.struct("ends", "voted_at", "decider_id", "approvals"), when).alias("d"), F.max("approvals").alias("so_far"))
    open_ = votes.select("review_id").distinct().join(decided, "review_id", "left")
    return open_.select("review_id", F.coalesce("d.ends", F.lit("in_review")).alias("status"), F.col("d.voted_at").alias("decided_at"), F.col("d.decider_id").alias("decided_by"), F.coalesce("d.approvals", "so_far", F.lit(0).cast("long")).alias("approvals"))


def review_breaches(reviews: DataFrame, owners: DataFrame, now: Column, hours: int = REVIEW_HOURS) -> DataFrame:
    """review_id, recipients of reviews (submitted_at, decided_at, breach_emitted_at, roles, owner, escalation_roles) that are overdue and were not reported."""
    late = F.col("decided_at").isNull() & F.col("breach_emitted_at").isNull() & (F.timestamp_add("HOUR", F.lit(hours), F.col("submitted_at")) < now)
    both = reviews.filter(late).join(owners.select("owner", F.col("roles").alias("owner_roles")), "owner", "left")
    return both.select("review_id", ordered_union(F.col("roles"), F.col("owner_roles"), F.col("escalation_roles")).alias("recipients"))


def list_reviews(reviews: DataFrame, asset: str | None = None, status: str | None = None) -> DataFrame:
    for name, value in (("asset", asset), ("status", status)):
        if value:
            reviews = reviews.filter(F.col(name) == value)
    return reviews.orderBy(F.desc("submitted_at"), "review_id").limit(200)


def reassign(reviews: DataFrame, changes: DataFrame) -> DataFrame:
    """Open reviews take the roles of changes (review_id, roles)."""
    both = reviews.join(changes.select("review_id", F.col("roles").alias("new_roles")), "review_id", "left")
    takes = F.col("new_roles").isNotNull() & F.col("decided_at").isNull()
    return both.withColumn("roles", F.when(takes, F.array_distinct("new_roles")).otherwise(F.col("roles"))).select(*reviews.columns)


BROADCAST_RULES = 10_000


def route(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with the channel of every rule (pattern, channel) that matches: *, an exact type, or prefix.*

    Each event is asked under the few patterns that can match it, so the join is one on equality.  Every event
    has the key *, so up to BROADCAST_RULES rules are broadcast; more are joined by a shuffle.
    """
    parts = F.split("event_type", r"\.")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.concat_ws(".", F.slice(parts, 1, n)), F.lit(".*")))).otherwise(F.array().cast("array<string>"))
    asked = F.array_distinct(F.concat(F.array(F.lit("*"), F.col("event_type")), prefixes))
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    return events.withColumn("pattern", F.explode(asked)).join(F.broadcast(rules) if few else rules, "pattern")
