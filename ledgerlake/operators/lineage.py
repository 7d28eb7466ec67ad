"""Lineage graphs as edge tables: impact, closure, levels, upkeep of edges, and OpenLineage events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import is_empty, stored

MOST_DEPTH = 25
MOST_UPSTREAMS = 256
DOWN, UP = "downstream", "upstream"


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("superseded_at").isNull())


def as_of(df: DataFrame, t: Column) -> DataFrame:
    """Rows valid at t: from first_seen_at, up to but not at superseded_at."""
    return df.filter((F.col("first_seen_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t)))


def edge_violations(edges: DataFrame) -> DataFrame:
    """from_asset, to_asset, violation: edges to themselves and active edges that are there twice."""
    selves = edges.filter(F.col("from_asset") == F.col("to_asset")).select("from_asset", "to_asset", F.lit("self_edge").alias("violation"))
    twice = active(edges).groupBy("from_asset", "to_asset").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("from_asset", "to_asset", F.lit("duplicate").alias("violation"))
    return selves.unionByName(twice)


def _steps(edges: DataFrame, direction: str, keys: int, moment: Column | None) -> DataFrame:
    """Distinct steps src -> dst of the edges that hold, each node one struct or string."""
    held = active(edges) if moment is None else as_of(edges, moment)
    ends = [F.col("from_asset"), F.col("to_asset")] if keys == 1 else [F.struct(F.col("from_asset").alias("asset"), F.col("from_column").alias("column")), F.struct(F.col("to_asset").alias("asset"), F.col("to_column").alias("column"))]
    src, dst = ends if direction == DOWN else ends[::-1]
    return held.select(src.alias("src"), dst.alias("dst")).distinct()


def _walk(steps: DataFrame, seeds: DataFrame, depth: int | None, carry: list[str]) -> tuple[list[DataFrame], bool]:
    """Frontiers (carry, node) by depth from seeds (carry, node); whether the last one still goes on."""
    now, levels = seeds, []
    while depth is None or len(levels) < depth:
        now = stored(now.join(steps, now["node"] == steps["src"]).select(*carry, F.col("dst").alias("node")).distinct())
        if is_empty(now):
            return levels, False
        levels.append(now)
        if depth is None:
            # unbounded walks only ask for new nodes
            known = reduce(DataFrame.unionByName, [seeds.select(*carry, "node"), *levels[:-1]])
            now = levels[-1] = stored(now.join(known, [*carry, "node"], "left_anti"))
    return levels, not is_empty(now.join(steps, now["node"] == steps["src"], "left_semi"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """src, dst without the edges whose source is entered by none or whose target is left by none, again and again; cycles and what lies between them stay."""
    n = edges.count()
    while n:
        edges = stored(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cycles")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node that reaches it, itself included."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = stored(nodes.withColumn("colour", F.col("node")), "colours")
    while True:
        told = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
        grown = stored(now.join(told, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("moved")), "colours")
        now = grown.select("node", "colour")
        if is_empty(grown.filter("moved")):
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its largest node) of the nodes of edges (src, dst) that lie on a cycle of two nodes or more.

    Forward and backward colouring: nodes take the largest node that reaches them as their colour; a
    component has one colour, and those of a colour that reach the node that gave it are its component.  What
    remains inside the colours is trimmed and coloured again.
    """
    left, done = _trimmed(stored(edges.filter("src <> dst").select("src", "dst").distinct(), "cycles")), []
    none = left.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component"))
    while not is_empty(left):
        colours = _coloured(left)
        ends = left.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        inside = stored(ends.filter("colour = other").select("src", "dst", "colour"), "cycles")
        new = colours.filter("node = colour").select("node")
        seen = new
        while not is_empty(new):
            back = inside.join(new.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            new = stored(back.join(seen, "node", "left_anti"), "component")
            seen = seen.unionByName(new)
        held = stored(seen.join(colours, "node").select("node", F.col("colour").alias("component")), "component")
        done.append(held)
        rest = inside.join(held.select(F.col("node").alias("src")), "src", "left_anti").join(held.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = _trimmed(stored(rest.select("src", "dst"), "cycles"))
    found = reduce(DataFrame.unionByName, done, none)
    # a node of its own colour that nothing of its colour reaches back to is alone
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return stored(found.join(several, "component", "left_semi").select("node", "component"), "components")


def _simple_paths(steps: DataFrame, members: DataFrame, seeds: DataFrame, depth: int, carry: list[str]) -> list[DataFrame]:
    """Frontiers along simple paths; members: node, component.

    A path that leaves a component never comes back to it, so only the nodes that it visited in the one it is in are
    kept, as a set: paths over the same nodes to the same node go on alike and are one row.
    """
    of = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    placed = steps.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select("src", "dst", F.coalesce(F.col("of_src") == F.col("of_dst"), F.lit(False)).alias("within"))
    placed = stored(placed.filter("src <> dst"))
    now, levels = seeds.withColumn("seen", F.array("node")), []
    for _ in range(depth):
        onward = now.join(placed, now["node"] == placed["src"]).filter(~(F.col("within") & F.array_contains("seen", F.col("dst"))))
        seen = F.when(F.col("within"), F.array_sort(F.array_append("seen", F.col("dst")))).otherwise(F.array("dst"))
        now = stored(onward.select(*carry, F.col("dst").alias("node"), seen.alias("seen")).distinct())
        if is_empty(now):
            break
        levels.append(now.select(*carry, "node").distinct())
    return levels


def _impact(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, keys: int, moment: Column | None, carry: list[str]) -> DataFrame:
    """Distinct (carry, node, depth) along simple paths.

    Frontiers of distinct nodes are enough while the walk cannot come back to a node: if it ends by
    itself, or if what it reaches has no cycle.  Otherwise the nodes visited are carried, inside strongly connected components only.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth has to be from 1 to {MOST_DEPTH}")
    steps = stored(_steps(edges, direction, keys, moment))
    levels, goes_on = _walk(steps, seeds, depth, carry)
    if goes_on:
        reached = reduce(DataFrame.unionByName, [x.select("node") for x in levels], seeds.select("node")).distinct()
        inside = steps.join(reached.withColumnRenamed("node", "src"), "src", "left_semi").join(reached.withColumnRenamed("node", "dst"), "dst", "left_semi")
        members = strong_components(inside)
        if not is_empty(members) or not is_empty(inside.filter("src = dst")):
            levels = _simple_paths(steps, members, seeds, depth, carry)
    if not levels:
        return seeds.limit(0).select(*carry, "node", F.lit(0).alias("depth"))
    return reduce(DataFrame.unionByName, [x.withColumn("depth", F.lit(i + 1)) for i, x in enumerate(levels)])


def _seed(edges: DataFrame, node: Column) -> DataFrame:
    return edges.sparkSession.range(1).select(node.alias("node"))


def impact_assets(edges: DataFrame, start: str, direction: str = DOWN, depth: int = 10, moment: Column | None = None) -> DataFrame:
    """asset, depth: every depth at which an asset is reached from start along a simple path."""
    found = _impact(edges, _seed(edges, F.lit(start)), direction, depth, 1, moment, [])
    return found.select(F.col("node").alias("asset"), "depth").orderBy("depth", "asset")


def impact_columns(edges: DataFrame, asset: str, column: str, direction: str = DOWN, depth: int = 10, moment: Column | None = None) -> DataFrame:
    """asset, column_name, depth: the same for columns."""
    start = F.struct(F.lit(asset).alias("asset"), F.lit(column).alias("column"))
    found = _impact(edges, _seed(edges, start), direction, depth, 2, moment, [])
    return found.select("node.asset", F.col("node.column").alias("column_name"), "depth").orderBy("depth", "asset", "column_name")


def impact_many(edges: DataFrame, seeds: DataFrame, direction: str = DOWN, depth: int = 10, moment: Column | None = None) -> DataFrame:
    """seed, asset, depth for every asset of the column `seed`; frontiers of all seeds move together."""
    starts = seeds.select("seed", F.col("seed").alias("node")).distinct()
    found = _impact(edges, starts, direction, depth, 1, moment, ["seed"])
    return found.select("seed", F.col("node").alias("asset"), "depth")


def neighborhood(edges: DataFrame, start: str, depth: int = 2, limit: int = 50) -> DataFrame:
    """asset, depth downstream along any walk, the nearest `limit` of them."""
    levels, _ = _walk(stored(_steps(edges, DOWN, 1, None)), _seed(edges, F.lit(start)), min(depth, 5), [])
    if not levels:
        return _seed(edges, F.lit(start)).limit(0).select(F.col("node").alias("asset"), F.lit(0).alias("depth"))
    found = reduce(DataFrame.unionByName, [x.select(F.col("node").alias("asset"), F.lit(i + 1).alias("depth")) for i, x in enumerate(levels)])
    return found.orderBy("depth", "asset").limit(limit)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges with both ends among nodes.asset."""
    inside = nodes.select("asset").distinct()
    return active(edges).join(inside.withColumnRenamed("asset", "from_asset"), "from_asset", "left_semi").join(inside.withColumnRenamed("asset", "to_asset"), "to_asset", "left_semi").select("from_asset", "to_asset").distinct()


def upstream_closure(edges: DataFrame, target: str) -> DataFrame:
    """asset: the target and all it depends on."""
    start = _seed(edges, F.lit(target))
    levels, _ = _walk(stored(_steps(edges, UP, 1, None)), start, None, [])
    return reduce(DataFrame.unionByName, levels, start).select(F.col("node").alias("asset")).distinct()


def _followed(links: DataFrame) -> DataFrame:
    """links (node, up, w, base: a level of base at least, and w above up's) with `up` followed to the first node that is no link, and `ends`, false where that never comes.

    Pointers double, so a chain takes as many rounds as the logarithm of its length.  While a node at a finite
    distance is open, one comes to its end in every round; what is open when none does is on a loop of links, or behind one.
    """
    tops = links.select(F.col("node").alias("up"), F.lit(False).alias("ends"))
    now = stored(links.join(tops, "up", "left").select("node", "up", "w", "base", F.coalesce("ends", F.lit(True)).alias("ends")), "links")
    left, before = now.filter("not ends").count(), None
    while left and left != before:
        hop = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("w").alias("more"), F.col("base").alias("low"), F.col("ends").alias("over"))
        open_ = now.filter("not ends").drop("ends").join(hop, "up")
        moved = open_.select("node", F.col("far").alias("up"), (F.col("w") + F.col("more")).alias("w"), F.greatest("base", F.col("low") + F.col("w")).alias("base"), F.col("over").alias("ends"))
        now = stored(now.filter("ends").unionByName(moved), "links")
        left, before = now.filter("not ends").count(), left
    return now


def topo_levels(edges: DataFrame) -> DataFrame:
    """asset, level: the longest path from a root; null for assets on a cycle or behind one.  Edges without one of their ends say nothing.

    Each round settles the nodes that nothing open leads to, and contracts those that one node leads to: such a
    node's level is max(base, level of the other + w), and these compose, so whole trees and chains go at once, by
    pointer doubling.  What they led to is led to by where they hang, and by a base; links of the same two ends become
    one, so that parallel chains contract further.  Rounds grow with the depth of joins in joins, not with path lengths.
    Contracted nodes take their levels at the end, last round first.
    """
    steps = stored(active(edges).filter("from_asset is not null and to_asset is not null").select(F.col("from_asset").alias("src"), F.col("to_asset").alias("dst"), F.lit(1).cast("long").alias("w")).distinct())
    nodes = steps.select(F.col("src").alias("node")).unionByName(steps.select(F.col("dst").alias("node"))).distinct().withColumn("base", F.lit(0).cast("long"))
    kind, known, hung = dict(steps.dtypes)["src"], [], []
    while True:
        ups = steps.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("src", "w")).alias("one"))
        placed = stored(nodes.join(ups, "node", "left").select("node", "base", F.coalesce("n", F.lit(0)).alias("n"), F.col("one.src").alias("up"), F.col("one.w").alias("w")), "placed")
        ready, links = placed.filter("n = 0").select("node", F.col("base").alias("level")), placed.filter("n = 1").select("node", "up", "w", "base")
        moves = ready.select("node", "level", F.lit(None).cast(kind).alias("up"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("base"))
        if not is_empty(links):
            followed = _followed(links)
            # a loop, and what hangs on one alone, has no level; edges out of it stay and are never settled
            known.append(followed.filter("not ends").select("node", F.lit(None).cast("long").alias("level")))
            roots = ready.select(F.col("node").alias("up"), F.col("level").alias("top"))
            level = F.greatest("base", F.when(F.col("top").isNotNull(), F.col("top") + F.col("w")))
            tied = followed.filter("ends").join(roots, "up", "left").select("node", F.when(F.col("top").isNotNull(), level).alias("level"), "up", "w", "base")
            moves = stored(moves.unionByName(tied), "moves")
            hung.append(moves.filter("level is null").select("node", "up", "w", "base"))
        elif is_empty(ready):
            break
        known.append(moves.filter("level is not null").select("node", "level"))
        rest = placed.filter("n > 1").select("node", "base")
        into = moves.select(F.col("node").alias("src"), "level", "up", F.col("w").alias("more"), F.col("base").alias("low"))
        hit = stored(steps.join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").join(into, "src", "left"), "hits")
        told = hit.groupBy(F.col("dst").alias("node")).agg(F.max(F.coalesce("level", "low") + F.col("w")).alias("told"))
        nodes = rest.join(told, "node", "left").select("node", F.greatest("base", "told").alias("base"))
        steps = hit.filter("level is null").groupBy(F.coalesce("up", "src").alias("src"), "dst").agg(F.max(F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    levels = reduce(DataFrame.unionByName, known, placed.select("node", F.lit(None).cast("long").alias("level")))
    for links in reversed(hung):
        if not is_empty(links):
            tops = levels.select(F.col("node").alias("up"), F.col("level").alias("top"))
            found = links.join(tops, "up", "left").select("node", F.when(F.col("top").isNotNull(), F.greatest("base", F.col("top") + F.col("w"))).alias("level"))
            levels = levels.unionByName(stored(found, "levels"))
    return levels.select(F.col("node").alias("asset"), F.col("level").cast("int").alias("level"))


# ---- upkeep: each returns the new table -----------------------------------------------------------------


def sync_edges(edges: DataFrame, declared: DataFrame, now: Column) -> DataFrame:
    """edges after assets declared their upstreams anew.

    declared: asset, upstreams array, code_hash.  Edges that are declared stay and take the hash and
    the time; new ones are added; active ones of these assets that are gone are retired.  An asset
    that declares none is left alone, one with more than 256 is an error.
    """
    if not is_empty(declared.filter(F.size("upstreams") > MOST_UPSTREAMS)):
        raise ValueError(f"more than {MOST_UPSTREAMS} upstreams")
    told = declared.filter(F.size("upstreams") > 0)
    want = told.select(F.explode(F.array_distinct("upstreams")).alias("from_asset"), F.col("asset").alias("to_asset"), F.col("code_hash").alias("new_hash"))
    assets = told.select(F.col("asset").alias("to_asset"), F.lit(True).alias("told"))
    old = edges.filter(F.col("superseded_at").isNotNull())
    both = active(edges).join(want, ["from_asset", "to_asset"], "full_outer").join(assets, "to_asset", "left")
    declared_now = F.col("new_hash").isNotNull()
    merged = both.select(
        "from_asset", "to_asset",
        F.coalesce("code_hash_first", "new_hash").alias("code_hash_first"), F.coalesce("new_hash", "code_hash_latest").alias("code_hash_latest"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(declared_now, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("told") & ~declared_now, now).alias("superseded_at"),
    )
    return old.select(*merged.columns).unionByName(merged)


def capture_column_edges(edges: DataFrame, lineage: DataFrame, now: Column, retire: bool = False) -> DataFrame:
    """edges after runs reported lineage (asset, lineage map<column, array<struct<asset, column>>>); with retire, ones no longer reported end."""
    out = lineage.select(F.col("asset").alias("to_asset"), F.explode("lineage").alias("to_column", "refs")).select("to_asset", "to_column", F.explode("refs").alias("ref"))
    seen = out.select(F.col("ref.asset").alias("from_asset"), F.col("ref.column").alias("from_column"), "to_asset", "to_column", F.lit(True).alias("seen")).distinct()
    keys = ["from_asset", "from_column", "to_asset", "to_column"]
    both = active(edges).join(seen, keys, "full_outer").join(lineage.select(F.col("asset").alias("to_asset"), F.lit(True).alias("told")).distinct(), "to_asset", "left")
    ends = F.when(F.lit(retire) & F.col("told") & F.col("seen").isNull(), now)
    merged = both.select(*keys, F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(F.col("seen"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), ends.alias("superseded_at"))
    return edges.filter(F.col("superseded_at").isNotNull()).select(*merged.columns).unionByName(merged)


def resolve_lineage(run: DataFrame, definitions: DataFrame) -> DataFrame:
    """asset, lineage, source: of the run if it reported any, else of the definition, else undeclared."""
    given = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    both = definitions.select("asset", F.col("lineage").alias("d")).join(run.select("asset", F.col("lineage").alias("r")), "asset", "full_outer")
    return both.select("asset", F.when(given("r"), F.col("r")).when(given("d"), F.col("d")).alias("lineage"), F.when(given("r"), "runtime").when(given("d"), "builder_default").otherwise("undeclared").alias("source"))


ZERO_RUN = "00000000-0000-0000-0000-000000000000"


def attribute_run(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Active edges of runs.asset take run_id as last seen, and as first seen where none was known."""
    by = runs.select(F.col("asset").alias("to_asset"), "run_id")
    hit = F.col("superseded_at").isNull() & F.col("run_id").isNotNull()
    both = edges.join(by, "to_asset", "left")
    first = F.when(hit & (F.coalesce("first_seen_run_id", F.lit(ZERO_RUN)) == ZERO_RUN), F.col("run_id")).otherwise(F.col("first_seen_run_id"))
    return both.withColumns({"first_seen_run_id": first, "last_seen_run_id": F.when(hit, F.col("run_id")).otherwise(F.col("last_seen_run_id"))}).select(*edges.columns)


def register_versions(versions: DataFrame, new: DataFrame) -> DataFrame:
    """versions with each (asset, code_hash) of `new` that was not there, its drift clean."""
    fresh = new.dropDuplicates(["asset", "code_hash"]).join(versions, ["asset", "code_hash"], "left_anti").withColumn("drift_status", F.lit("clean"))
    return versions.unionByName(fresh, allowMissingColumns=True)


def unknown_upstreams(definitions: DataFrame) -> DataFrame:
    """asset, upstream: declared upstreams that are no asset."""
    told = definitions.select("asset", F.explode("upstreams").alias("upstream"))
    return told.join(definitions.select(F.col("asset").alias("upstream")), "upstream", "left_anti").select("asset", "upstream")


def upstream_drift(definitions: DataFrame, observed: DataFrame) -> DataFrame:
    """asset, drift_status, missing, extra: declared against observed upstreams, as sorted lists with repeats."""
    both = definitions.select("asset", F.array_sort("upstreams").alias("d")).join(observed.select("asset", F.array_sort("observed").alias("o")), "asset")
    return both.select("asset", F.when(F.col("d") == F.col("o"), "clean").otherwise("pending").alias("drift_status"), F.array_except("d", "o").alias("missing"), F.array_except("o", "d").alias("extra"))


# ---- OpenLineage -------------------------------------------------------------------------------------------


def run_inputs(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """run_id, from_asset: edges into the run's asset (runs: run_id, asset, at) that held when it started.  Equi-join on the asset, the interval a residual."""
    held = (F.col("first_seen_at") <= F.col("at")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("at")))
    return runs.join(edges.select("from_asset", F.col("to_asset").alias("asset"), "first_seen_at", "superseded_at"), "asset").filter(held).select("run_id", "asset", "from_asset").distinct()


def openlineage(runs: DataFrame, edges: DataFrame, column_edges: DataFrame, namespace: str = "platform") -> DataFrame:
    """run_id, asset, finished_at, event: a COMPLETE event for each run that succeeded and finished."""
    done = runs.filter((F.col("state") == "succeeded") & F.col("finished_at").isNotNull()).withColumn("at", F.coalesce("started_at", "queued_at"))
    inputs = run_inputs(done, edges).groupBy("run_id").agg(F.array_sort(F.collect_set(F.struct(F.lit(namespace).alias("namespace"), F.col("from_asset").alias("name")))).alias("inputs"))
    held = (F.col("first_seen_at") <= F.col("at")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > F.col("at")))
    fields = done.select("run_id", F.col("asset").alias("to_asset"), "at").join(column_edges, "to_asset").filter(held)
    by_column = fields.groupBy("run_id", "to_column").agg(F.array_sort(F.collect_set(F.struct(F.lit(namespace).alias("namespace"), F.col("from_asset").alias("name"), F.col("from_column").alias("field")))).alias("inputFields"))
    facet = by_column.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("to_column", F.struct("inputFields"))))).alias("fields"))
    whole = done.join(inputs, "run_id", "left").join(facet, "run_id", "left")
    event = F.to_json(F.struct(
        F.lit("COMPLETE").alias("eventType"), F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.struct(F.col("run_id").cast("string").alias("runId")).alias("run"), F.struct(F.lit(namespace).alias("namespace"), F.col("asset").alias("name")).alias("job"),
        F.coalesce("inputs", F.array().cast("array<struct<namespace:string,name:string>>")).alias("inputs"),
        F.array(F.struct(F.lit(namespace).alias("namespace"), F.col("asset").alias("name"), F.when(F.col("fields").isNotNull(), F.struct(F.struct("fields").alias("columnLineage"))).alias("facets"))).alias("outputs"),
    ))
    return whole.select("run_id", "asset", "finished_at", event.alias("event"))


def export_lineage(events: DataFrame, asset: str, since: Column) -> DataFrame:
    return events.filter((F.col("asset") == asset) & (F.col("finished_at") >= since)).orderBy("finished_at", "run_id")
