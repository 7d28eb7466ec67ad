import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import lineage

TIME = "timestamp_ntz"


def edges(spark, pairs, dead=()):
    rows = [(a, b, False) for a, b in pairs] + [(a, b, True) for a, b in dead]
    df = spark.createDataFrame(rows, "from_asset string, to_asset string, dead boolean")
    return df.withColumn("first_seen_at", F.lit("2024-01-01").cast(TIME)).withColumn("superseded_at", F.when(F.col("dead"), F.lit("2024-01-05").cast(TIME))).drop("dead")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_chain_reaches_one_asset_a_depth(spark):
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    assert found(lineage.impact_assets(chain, "n0")) == [(f"n{i}", i) for i in range(1, 7)]
    assert found(lineage.impact_assets(chain, "n6", lineage.UP, 2)) == [("n4", 2), ("n5", 1)]


def test_diamond_has_two_depths(spark):
    assert found(lineage.impact_assets(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")]), "a")) == [("b", 1), ("c", 1), ("c", 2)]


def test_cycle_follows_simple_paths(spark):
    assert found(lineage.impact_assets(edges(spark, [("a", "b"), ("b", "a")]), "a")) == [("b", 1)]
    ring = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])
    assert found(lineage.impact_assets(ring, "a")) == [("b", 1), ("c", 2), ("d", 3)]


def test_depth_is_checked(spark):
    e = edges(spark, [("a", "b")])
    with pytest.raises(ValueError):
        lineage.impact_assets(e, "a", depth=26)
    assert found(lineage.impact_assets(e, "a", depth=25)) == [("b", 1)]
    assert found(lineage.impact_assets(e, "nowhere")) == []


def test_superseded_edges_count_only_in_their_time(spark):
    e = edges(spark, [("a", "b")], dead=[("a", "x")])
    assert found(lineage.impact_assets(e, "a")) == [("b", 1)]
    then = F.lit("2024-01-03").cast(TIME)
    assert found(lineage.impact_assets(e, "a", moment=then)) == [("b", 1), ("x", 1)]
    assert found(lineage.impact_assets(e, "a", moment=F.lit("2024-01-05").cast(TIME))) == [("b", 1)]


def test_levels_and_cycles(spark):
    graph = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")])
    out = {r.asset: r.level for r in lineage.topo_levels(graph).collect()}
    assert out == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def longest_paths(pairs):
    """Levels by peeling roots one layer at a time."""
    nodes, ups = {n for p in pairs for n in p}, {}
    for a, b in pairs:
        ups.setdefault(b, set()).add(a)
    out = {}
    while ready := [n for n in nodes if n not in out and ups.get(n, set()) <= out.keys()]:
        out |= {n: max((out[u] + 1 for u in ups.get(n, ())), default=0) for n in ready}
    return {n: out.get(n) for n in nodes}


def test_levels_agree_with_peeling_on_random_graphs(spark):
    import random

    pick = random.Random(5)
    for shape in range(6):
        pairs = set()
        for g in range(4):  # graphs beside each other, sparse and dense ones
            n = pick.choice([4, 12, 25])
            for _ in range(pick.choice([n // 2, n, 2 * n])):
                a, b = pick.sample(range(n), 2)
                if shape < 3 or pick.random() < 0.85:
                    a, b = min(a, b), max(a, b)
                pairs.add((f"{g}-{a:02}", f"{g}-{b:02}"))
        got = {r.asset: r.level for r in lineage.topo_levels(edges(spark, sorted(pairs))).collect()}
        assert got == longest_paths(pairs), shape


def test_levels_of_long_chains_take_few_rounds(spark, monkeypatch):
    # two chains of 1,500 that part and meet, a tail of 500 behind them, and a loop with a tail of its own
    left, right = ([f"{side}{i}" for i in range(1500)] for side in "lr")
    pairs = [*zip(left, left[1:]), *zip(right, right[1:]), ("l0", "r0"), (left[-1], "t0"), (right[-1], "t0")]
    pairs += [(f"t{i}", f"t{i + 1}") for i in range(500)] + [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)] + [("c3", "d0"), ("d0", "d1"), ("t9", "d1")]
    written = []
    monkeypatch.setattr(lineage, "stored", lambda df, name="step", keep=lineage.stored: written.append(name) or keep(df, name))
    got = {r.asset: r.level for r in lineage.topo_levels(edges(spark, pairs)).collect()}
    assert (got["l0"], got["l1499"], got["r0"], got["r1499"], got["t0"], got["t500"]) == (0, 1499, 1, 1500, 1501, 2001)
    assert all(got[n] is None for n in ("c0", "c6", "d0", "d1"))
    assert len(written) < 50


def test_levels_of_no_edges_and_of_edges_without_an_end(spark):
    assert found(lineage.topo_levels(edges(spark, []))) == []
    assert found(lineage.topo_levels(edges(spark, [("a", "b"), (None, "b"), ("b", None)]))) == [("a", 0), ("b", 1)]


def test_sync_retires_touches_and_adds(spark):
    old = edges(spark, [("a", "t"), ("b", "t"), ("q", "other")]).selectExpr("from_asset", "to_asset", "'h0' code_hash_first", "'h0' code_hash_latest", "first_seen_at", "first_seen_at last_seen_at", "superseded_at")
    told = spark.createDataFrame([("t", ["a", "c"], "h1"), ("other", [], "h1")], "asset string, upstreams array<string>, code_hash string")
    out = {(r.from_asset, r.to_asset): (r.code_hash_first, r.code_hash_latest, r.superseded_at is None) for r in lineage.sync_edges(old, told, F.lit("2024-02-01").cast(TIME)).collect()}
    assert out == {("a", "t"): ("h0", "h1", True), ("b", "t"): ("h0", "h0", False), ("c", "t"): ("h1", "h1", True), ("q", "other"): ("h0", "h0", True)}


def test_attribution_capture_and_versions(spark):
    e = edges(spark, [("a", "t")]).withColumns({"first_seen_run_id": F.lit(lineage.ZERO_RUN), "last_seen_run_id": F.lit(None).cast("string")})
    r = lineage.attribute_run(e, spark.createDataFrame([("t", "run1")], "asset string, run_id string")).first()
    assert (r.first_seen_run_id, r.last_seen_run_id) == ("run1", "run1")
    old = spark.createDataFrame([], "from_asset string, from_column string, to_asset string, to_column string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, superseded_at timestamp_ntz")
    told = spark.createDataFrame([("t", {"x": [("a", "c")], "y": [("a", "c"), ("b", "d")]})], "asset string, lineage map<string,array<struct<asset:string,column:string>>>")
    assert lineage.capture_column_edges(old, told, F.lit("2024-01-01").cast(TIME)).count() == 3
    have = spark.createDataFrame([("t", "h", "pending")], "asset string, code_hash string, drift_status string")
    new = spark.createDataFrame([("t", "h"), ("t", "h2")], "asset string, code_hash string")
    assert found(lineage.register_versions(have, new)) == [("t", "h", "pending"), ("t", "h2", "clean")]


def test_lineage_sources(spark):
    kind = "asset string, lineage map<string,string>"
    run = spark.createDataFrame([("a", {"x": "r"}), ("b", {})], kind)
    defs = spark.createDataFrame([("a", {"x": "d"}), ("b", {"x": "d"}), ("c", None)], kind)
    assert {r.asset: r.source for r in lineage.resolve_lineage(run, defs).collect()} == {"a": "runtime", "b": "builder_default", "c": "undeclared"}


def brute_force(pairs, start, depth):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    got, paths = set(), [(start,)]
    for d in range(1, depth + 1):
        paths = [(*p, n) for p in paths for n in out.get(p[-1], ()) if n not in p]
        got |= {(p[-1], d) for p in paths}
    return sorted(got)


@pytest.mark.parametrize("seed", [1])
def test_random_cyclic_graphs_follow_simple_paths(spark, seed):
    import random

    dice = random.Random(seed)
    pairs = sorted({(f"n{dice.randrange(9)}", f"n{dice.randrange(9)}") for _ in range(16)} | {("n0", "n1"), ("n1", "n0")})
    assert found(lineage.impact_assets(edges(spark, pairs), "n0", depth=6)) == brute_force(pairs, "n0", 6)


def test_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "g"), ("x", "x")]
    df = spark.createDataFrame(pairs, "src string, dst string")
    assert found(lineage.strong_components(df)) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e")]
    assert found(lineage.strong_components(df.filter("src in ('e', 'f', 'x')"))) == []


def test_a_small_cycle_in_front_of_linked_layers_carries_no_paths(spark):
    pairs = [("a", "b"), ("b", "a")] + [("b", f"0-{i}") for i in range(50)]
    pairs += [(f"{d}-{i}", f"{d + 1}-{j}") for d in range(11) for i in range(50) for j in range(50)]
    out = lineage.impact_assets(edges(spark, pairs), "a", depth=12)
    assert out.groupBy("depth").count().filter("depth > 1 and count <> 50").count() == 0 and out.count() == 1 + 11 * 50
