import hashlib
import hmac
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.columns import canonical_json, partition_key, valid_partition_key
from ledgerlake.functions.masks import mask_hash, mask_partial
from ledgerlake.operators import audit, metadata, policies, quality, reviews, runs, schemas
from ledgerlake.sources import assets, files


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("day", "strategy", "key"),
    [("2024-01-15", "daily", "2024-01-15"), ("2024-01-15", "weekly", "2024-W03"), ("2024-01-15", "monthly", "2024-01"), ("2019-12-30", "weekly", "2020-W01"), ("2015-01-01", "weekly", "2015-W01"), ("2015-12-31", "weekly", "2015-W53")],
)
def test_partition_keys(spark, day, strategy, key):
    assert one(spark, partition_key(ntz(day), strategy)) == key
    assert one(spark, valid_partition_key(F.lit(key), strategy))


@pytest.mark.parametrize(("key", "strategy"), [("2024-W53", "weekly"), ("2024-13", "monthly"), ("2023-02-29", "daily"), ("a/b", "category"), ("", "category"), ("x" * 129, "category")])
def test_bad_keys(spark, key, strategy):
    assert one(spark, valid_partition_key(F.lit(key), strategy)) is False


def test_keys_between(spark):
    span = spark.createDataFrame([("2024-01-01", "2024-01-31")], "a string, b string")
    assert runs.keys_between(span, "a", "b", "daily").count() == 31
    assert [r.partition_key for r in runs.keys_between(span, "a", "b", "weekly").collect()] == [f"2024-W0{i}" for i in range(1, 6)]
    quarter = spark.createDataFrame([("2024-01-10", "2024-03-01")], "a string, b string")
    assert runs.keys_between(quarter, "a", "b", "monthly").count() == 3
    with pytest.raises(Exception, match="inverted"):
        runs.keys_between(span, "b", "a", "daily").collect()


def test_specs(spark):
    rows = [(1, "t", "2024-01-01:2024-12-31", "daily", None), (2, "t", "us,eu,apac", "category", ["us", "eu", "apac"]), (3, "t", "mars", "category", ["us"]), (4, "t", "2024-W02", "weekly", None), (5, "t", "2000-01-01:2024-01-01", "daily", None), (6, "t", "", "daily", None)]
    good, bad = runs.expand_specs(spark.createDataFrame(rows, "backfill_id int, asset string, spec string, strategy string, categories array<string>"))
    assert {r.backfill_id: r["count"] for r in good.groupBy("backfill_id").count().collect()} == {1: 366, 2: 3, 4: 1}
    assert {r.backfill_id: r.error for r in bad.collect()} == {3: "undeclared category", 5: "too many keys", 6: "no keys"}


@pytest.mark.parametrize(("text", "masked"), [("hello-world", "he*******ld"), ("short", "***"), ("sixsix", "si**ix"), ("äöüäöü", "äö**öü")])
def test_partial_mask(spark, text, masked):
    assert one(spark, mask_partial(F.lit(text), 0)) == masked


def test_hash_mask_is_an_hmac(spark):
    for salt in ("k", "long" * 30, ""):
        assert one(spark, mask_hash(F.lit("välue"), salt)) == hmac.new(salt.encode(), "välue".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        mask_hash(F.lit("x"), "", production=True)


def test_masks_on_a_table(spark):
    df = spark.createDataFrame([("a-long-name", 5, None)], "name string, n int, other string")
    assert tuple(policies.apply_masks(df, {"name": "partial", "n": "hash", "other": "redact", "gone": "hash"}).first()) == ("a-*******me", 5, None)
    assert tuple(policies.apply_masks(df, {"name": "nonsense"}).first()) == ("a-long-name", 5, None)


LATTICE = [
    ("int16", "int64", True), ("int64", "int32", False), ("float32", "float64", True), ("varchar(64)", "varchar(255)", True), ("varchar(255)", "text", True), ("text", "varchar(255)", False),
    ("decimal(8,2)", "decimal(10,2)", True), ("decimal(10,4)", "decimal(10,2)", False), ("int32", "uuid", None), ("text", "bytea", None), ("varchar", "varchar(10)", None), ("uuid", "uuid", True), ("int32", "float64", None),
]


def test_lattice(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in LATTICE], "a string, b string")
    got = {(r.a, r.b): r.w for r in df.withColumn("w", schemas.is_widening(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b): w for a, b, w in LATTICE}


BASE = {"type": "int32", "nullable": False, "default_value": None, "comment": None, "is_pk": False}
CHANGES = [
    ({"new": BASE}, "column_added", False), ({"old": BASE}, "column_dropped", True), ({"old": BASE, "new": {**BASE, "type": "int64"}}, "type_widened", False),
    ({"old": BASE, "new": {**BASE, "type": "int16"}}, "type_narrowed", True), ({"old": BASE, "new": {**BASE, "nullable": True}}, "nullable_added", False),
    ({"old": {**BASE, "nullable": True}, "new": BASE}, "nullable_removed", True), ({"old": BASE, "new": {**BASE, "is_pk": True}}, "pk_changed", True),
    ({"old": BASE, "new": {**BASE, "comment": "c"}}, "comment_changed", False), ({"old": BASE, "new": {**BASE, "default_value": "0"}}, "default_changed", False),
]


def test_schema_changes(spark):
    kind = "asset string, column_name string, type string, nullable boolean, default_value string, comment string, is_pk boolean"
    row = lambda i, c: (f"a{i}", "c", c["type"], c["nullable"], c["default_value"], c["comment"], c["is_pk"])
    old = spark.createDataFrame([row(i, c["old"]) for i, (c, _, _) in enumerate(CHANGES) if "old" in c], kind)
    new = spark.createDataFrame([row(i, c["new"]) for i, (c, _, _) in enumerate(CHANGES) if "new" in c], kind)
    got = {r.asset: (r.change_type, r.is_breaking) for r in schemas.classify(schemas.schema_diff(old, new, ["asset"])).collect()}
    assert got == {f"a{i}": (k, b) for i, (_, k, b) in enumerate(CHANGES)}


def test_schema_hash_invariants(spark):
    kind = "v int, column_name string, type string, nullable boolean, default_value string, comment string, is_pk boolean, pk_position int"
    a, b = ("a", "int32", False, None, "x", True), ("b", "text", True, "0", None, True)
    rows = [(1, *a, 0), (1, *b, 1), (2, *b, 1), (2, *a[:4], "other", True, 0), (3, *a, 1), (3, *b, 0)]
    h = {r.v: r.schema_hash for r in schemas.schema_hash(spark.createDataFrame(rows, kind), ["v"]).collect()}
    assert h[1] == h[2] != h[3]


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 9.0)], "i int, v double")
    rules = [quality.NullCheck("v", 0.5), quality.NullCheck("v", 0.1), quality.RangeCheck("v", 0, 8), quality.RangeCheck("v", 6, 20), quality.NullCheck("gone"), quality.SQLAssertion("n", "SELECT count(*) FROM ${asset}", quality.less_than(3)), quality.SQLAssertion("t", "SELECT 'x' FROM ${asset}", quality.equals_zero), quality.SQLAssertion("none", "SELECT i FROM ${asset} WHERE i > 9", quality.equals_zero), quality.SQLAssertion("p", "SELECT 1", None)]
    got = [(r.rule_name, r.status, r.measured_value) for r in quality.evaluate(df, rules, "r").collect()]
    third = pytest.approx(1 / 3)
    assert got[:4] == [("null_check_v", "passed", third), ("null_check_v", "failed", third), ("range_check_v", "failed", 9.0), ("range_check_v", "failed", 5.0)]
    assert {(n, s) for n, s, _ in got[4:]} == {("null_check_gone", "error"), ("n", "failed"), ("t", "failed"), ("none", "error"), ("p", "error")}
    empty = quality.evaluate(df.limit(0), [quality.RangeCheck("v", 1, 2), quality.NullCheck("v")], "r").collect()
    assert [(r.status, r.measured_value) for r in empty] == [("failed", 0.0), ("passed", 0.0)]
    assert quality.overall(df.limit(0).withColumn("status", F.lit("x"))).first().status == "skipped"


def test_freshness(spark):
    rows = [(1, "a", 3600, "2024-01-01", "2024-01-30 23:30:00", None), (2, "b", 3600, "2024-01-01", "2024-01-30", None), (3, "c", 3600, "2024-01-01", None, None), (4, "d", 3600, "2024-01-01", None, "2024-01-30 23:30:00"), (5, "e", None, "2024-01-01", None, None)]
    df = spark.createDataFrame(rows, "schedule_id int, asset_name string, max_lag_seconds int, created_at string, last_succeeded string, breach_emitted_at string")
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_succeeded", "breach_emitted_at")})
    events, marked = quality.emit_breaches(df, ntz("2024-01-31"))
    assert sorted(r.schedule_id for r in events.collect()) == [2, 3]
    assert quality.freshness_breaches(marked, ntz("2024-01-31")).count() == 0


def test_policy_upkeep(spark):
    kind = "asset string, column_name string, mask_type string, source string, code_hash_first string, code_hash_latest string, first_seen_at timestamp_ntz, superseded_at timestamp_ntz"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "x", "hash", "builder", "h0", "h0", t, None), ("a", "y", "hash", "builder", "h0", "h0", t, None), ("a", "z", "hash", "builder", "h0", "h0", t, None), ("a", "x", "redact", "runtime", "h0", "h0", t, None)], kind)
    told = spark.createDataFrame([("a", "x", "hash", "h1"), ("a", "y", "redact", "h1"), ("a", "n", "partial", "h1")], "asset string, column_name string, mask_type string, code_hash string")
    table, changes = policies.apply_policies(old, told, ntz("2024-02-01"))
    assert {(r.column_name, r.action) for r in changes.collect()} == {("y", "changed"), ("z", "retired"), ("n", "inserted")}
    live = {(r.column_name, r.mask_type, r.source, r.code_hash_first) for r in table.filter("superseded_at is null").collect()}
    assert live == {("x", "hash", "builder", "h0"), ("y", "redact", "builder", "h0"), ("n", "partial", "builder", "h1"), ("x", "redact", "runtime", "h0")}
    patch = spark.createDataFrame([("a", "x", "partial", "because"), ("a", "y", "partial", " ")], "asset string, column_name string, mask_type string, reason string")
    patched, rejected = policies.patch_policies(table, patch, ntz("2024-03-01"), F.lit(9))
    assert rejected.count() == 1
    assert {r.mask_type for r in patched.filter("source = 'runtime' and superseded_at is null").collect()} == {"partial"}


def test_pii_overrides(spark):
    tags = spark.createDataFrame([("a", "c", True, "manual"), ("b", "c", True, "override")], "asset string, column_name string, pii boolean, source string")
    forced = spark.createDataFrame([("a", "c", False), ("b", "c", True)], "asset string, column_name string, pii boolean")
    table, rows = policies.apply_pii_overrides(tags, forced)
    assert {(r.asset, r.pii, r.source) for r in table.collect()} == {("a", False, "override"), ("b", True, "override")}
    assert [r.asset for r in rows.collect()] == ["a"]


def test_audit_chain_finds_changes_and_gaps(spark):
    rows = [("k", i, datetime(2024, 1, 1, i), "policy.changed", "me", "column", "c", f'{{"n":{i}}}') for i in range(1, 8)] + [("other", 1, datetime(2024, 1, 1), "role.assigned", None, "role", "r", None)]
    entries = spark.createDataFrame(rows, "chain_key string, entry_id long, occurred_at timestamp_ntz, event_type string, actor_id string, resource_type string, resource_id string, payload string")
    none = spark.createDataFrame([], "chain_key string, seq long, prev_hash binary, self_hash binary, occurred_at timestamp_ntz, event_type string, actor_id string, resource_type string, resource_id string, payload string")
    first = audit.append_audit(none, entries.filter("entry_id <= 4")).cache()
    log = audit.append_audit(first, entries.filter("entry_id > 4")).cache()
    clean = {r.chain_key: (r.scanned, r.first_bad, r.gap) for r in audit.verify_audit(log).collect()}
    assert clean == {"k": (7, None, False), "other": (1, None, False)}
    bad = audit.verify_audit(log.withColumn("payload", F.when(F.col("seq") == 5, "{}").otherwise(F.col("payload")))).filter("chain_key = 'k'").first()
    assert bad.first_bad == 5
    gap = audit.verify_audit(log.filter("seq <> 3")).filter("chain_key = 'k'").first()
    assert (gap.first_bad, gap.gap) == (4, True)
    assert audit.verify_audit(log, 5, 6).filter("chain_key = 'k'").first().scanned == 2


def test_chains_are_carried_over_batches(spark):
    n = 500
    rows = [(f"k{i % 3}" if i % 10 else None, i, datetime(2024, 1, 1 + i % 28), "policy.changed", "me", "column", "c", str(i)) for i in range(n)]
    entries = spark.createDataFrame(rows, "chain_key string, entry_id long, occurred_at timestamp_ntz, event_type string, actor_id string, resource_type string, resource_id string, payload string")
    none = spark.createDataFrame([], "chain_key string, seq long, prev_hash binary, self_hash binary, occurred_at timestamp_ntz, event_type string, actor_id string, resource_type string, resource_id string, payload string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = audit.append_audit(none, entries).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for chain in (None, "k0", "k1", "k2"):
        log = sorted((r for r in got if r.chain_key == chain), key=lambda r: r.seq)
        want = sorted((r[2], r[1]) for r in rows if r[0] == chain)
        assert [r.seq for r in log] == list(range(1, len(want) + 1)) and [int(r.payload) for r in log] == [e for _, e in want]
        assert bytes(log[0].prev_hash) == audit.GENESIS and all(a.self_hash == b.prev_hash for a, b in zip(log, log[1:]))


def test_tally(spark):
    kind = "review_id int, submitter_id int, decider_id int, vote string, comment string, quorum int, pool_size int, voted_at int, vote_id int"
    rows = [(1, 1, 1, "approve", "", 1, 3, 1, 1), (2, 1, 2, "approve", "", 2, 3, 1, 2), (2, 1, 2, "approve", "", 2, 3, 2, 3), (3, 1, 2, "reject", " ", 1, 3, 1, 4), (3, 1, 3, "reject", "no", 1, 3, 2, 5), (4, 1, 2, "approve", "", -1, 2, 1, 6), (4, 1, 3, "approve", "", -1, 2, 2, 7), (4, 1, 4, "reject", "late", -1, 2, 3, 8)]
    got = {r.review_id: (r.status, r.decided_by) for r in reviews.tally(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("in_review", None), 2: ("in_review", None), 3: ("rejected", 3), 4: ("approved", 3)}


def test_json_and_metadata(spark):
    m = spark.createDataFrame([({"b": "1", "a": "2"},)], "m map<string,string>")
    assert m.select(canonical_json(F.col("m")).alias("x")).first().x == '{"a":"2","b":"1"}'
    kind = "id int, asset string, column_name string, description string, owner string, tags array<string>, set_by string, set_at int"
    have = spark.createDataFrame([(1, "a", None, "", "", ["x", "y"], "me", 1)], kind)
    put = spark.createDataFrame([(2, "a", None, "", "", ["y", "z"], "me", 2)], kind)
    assert [r.tags for r in metadata.put_metadata(have, put).filter("id = 2").collect()] == [["x", "y", "z"]]
    assert [r.tags for r in metadata.put_metadata(have, put, merge=False).filter("id = 2").collect()] == [["y", "z"]]
    assert one(spark, metadata.highlight(F.lit("Steel and steely"), "steel")) == "<b>Steel</b> and steely"


def test_acknowledgements(spark):
    changes = spark.createDataFrame([(1, None, None, None), (2, datetime(2024, 1, 1), "x", "y")], "change_id int, acknowledged_at timestamp_ntz, acknowledged_by string, acknowledgement_reason string")
    acks = spark.createDataFrame([(1, "me", "fine"), (1, "me", ""), (2, "me", "again")], "change_id int, by string, reason string")
    updated, rejected = schemas.ack_changes(changes, acks, ntz("2024-02-01"))
    assert {r.change_id: r.acknowledged_by for r in updated.collect()} == {1: "me", 2: "x"}
    assert sorted(r.rejected for r in rejected.collect()) == ["already acknowledged or unknown", "reason required"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "ndjson"])
def test_files_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "i long, s string, d double")
    assert {r.check: r.n for r in files.conformance(df, fmt, f"{tmp_path}/{fmt}").collect()} == {"rows_lost": 0, "rows_added": 0, "columns": 0}


def test_assets(spark, tmp_path):
    root = str(tmp_path)
    files.write_files(spark.createDataFrame([(1, "A@x.org"), (2, None)], "id long, email string"), f"{root}/users_raw")
    made = assets.AssetBuilder("users_clean").upstream("users_raw").policy("email", "redact").build(lambda io: io.read("users_raw").filter("email is not null"))
    io = assets.materialize(spark, made, root, hooks={"mask": lambda df: policies.apply_masks(df, made.policies)})
    assert io.observed() == ["users_raw"]
    assert [tuple(r) for r in files.read_files(spark, f"{root}/users_clean").collect()] == [(1, "***")]
    with pytest.raises(assets.UndeclaredUpstream):
        io.read("other")
    with pytest.raises(ValueError):
        assets.AssetBuilder("x").policy("c", "hash").policy("c", "redact")
    with pytest.raises(ValueError):
        assets.AssetBuilder("bad name!").build()
    with pytest.raises(ValueError):
        files.read_jdbc(spark, "jdbc:x", "t; drop table t")


def test_builder_takes_cadence_reviewers_and_overrides():
    made = assets.AssetBuilder("a").every(3600).reviewed_by("steward", "owner").pii_override("email", True).pii_override("id", False).build()
    assert (made.every_seconds, made.reviewers, made.pii_overrides) == (3600, ("steward", "owner"), {"email": True, "id": False})
    for bad in (lambda b: b.every(0), lambda b: b.reviewed_by("x", "x"), lambda b: b.reviewed_by(""), lambda b: b.pii_override("c", True).pii_override("c", True), lambda b: b.pii_override("", True)):
        with pytest.raises(ValueError):
            bad(assets.AssetBuilder("a"))


def test_captures_take_the_description_first(spark):
    kind = "asset string, schema_hash string, n_columns long"
    told = spark.createDataFrame([("a", "h1", 2), ("b", "h2", 0)], kind)
    seen = spark.createDataFrame([("a", "h3", 3), ("c", "h4", 4)], kind)
    found = schemas.choose_captures(spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "asset string"), told, seen)
    assert sorted((tuple(r) for r in found.collect()), key=str) == [("a", "h1", 2, "descriptor"), ("b", "h2", 0, "descriptor"), ("c", "h4", 4, "result"), ("d", None, None, "unsupported")]


def test_conformance_reports_nullability(spark, tmp_path):
    got = files.conformance(spark.range(3), "parquet", f"{tmp_path}/x")
    assert {r.check: r.n for r in got.collect()} == {"rows_lost": 0, "rows_added": 0, "columns": 2}


def test_rules_that_fail_at_run_time_leave_the_others_alone(spark):
    df = spark.createDataFrame([("a", 1), ("2", 3), (None, None)], "t string, v int")
    rules = [quality.RangeCheck("t", 0, 5), quality.RangeCheck("v", 0, 5), quality.SQLAssertion("z", "SELECT 1 DIV 0", quality.equals_zero), quality.NullCheck("v", 0.5)]
    got = quality.evaluate(df, rules, "r").collect()
    assert {r.rule_name: r.status for r in got} == {"range_check_t": "error", "range_check_v": "passed", "z": "error", "null_check_v": "passed"}
    assert got[0].error == "1 values of t are no numbers" and got[0].measured_value is None and any("ZERO" in (r.error or "").upper() for r in got)


def test_highlight_marks_words_only(spark):
    df = spark.createDataFrame([("a bold b and B",)], "t string")
    assert df.select(metadata.highlight(F.col("t"), "bold b")).first()[0] == "a <b>bold</b> <b>b</b> and <b>B</b>"
