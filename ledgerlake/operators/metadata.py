"""Asset and column metadata: runtime values over defaults of the code, and the catalogue's search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ordered_union
from ..functions.session import dealt, stored
from .relational import latest

TERM = r"[^\p{L}\p{N}]+"
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def effective_metadata(versions: DataFrame, runtime: DataFrame) -> DataFrame:
    """asset, description, owner, tags: the newest runtime value of each field where it is not empty, else that of the newest version."""
    code = latest(versions, "asset", "created_at").select("asset", F.col("description").alias("d"), F.col("owner").alias("o"), F.col("tags").alias("t"))
    put = latest(runtime.filter(F.col("column_name").isNull()), "asset", ["set_at", "id"]).select("asset", "description", "owner", "tags")
    pick = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.col("t"))
    return code.join(put, "asset", "left").select("asset", pick("description", "d").alias("description"), pick("owner", "o").alias("owner"), tags.alias("tags"))


def put_metadata(runtime: DataFrame, puts: DataFrame, merge: bool = True) -> DataFrame:
    """runtime with a row appended for each put; with merge its tags join those that are there, in order."""
    key = ["asset", "column_name"]
    now = runtime.groupBy(*key).agg(F.max_by("tags", F.struct("set_at", "id")).alias("had"))
    same = [puts[k].eqNullSafe(now[k]) for k in key]
    both = puts.join(now, (same[0]) & (same[1]), "left").select(*(puts[c] for c in puts.columns), "had")
    tags = ordered_union(F.col("had"), F.col("tags")) if merge else F.col("tags")
    return runtime.unionByName(both.withColumn("tags", tags).select(*runtime.columns))


def term_index(docs: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """term, key, weight: the weights of the fields (column -> A, B or C) that hold a term; the table a search reads instead of the texts."""
    parts = F.array(*(F.struct(F.col(c).cast("string").alias("text"), F.lit(WEIGHTS[w]).alias("weight")) for c, w in fields.items()))
    split = docs.select(key, F.explode(parts).alias("p")).select(key, F.explode(F.array_distinct(F.split(F.lower("p.text"), TERM))).alias("term"), "p.weight")
    return split.filter("term <> ''").groupBy("term", key).agg(F.sum("weight").alias("weight"))


def query_terms(q: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split(r"[^\w]+", q.lower()) if t))


def search(index: DataFrame, key: str, q: str) -> DataFrame:
    """key, rank of what holds all terms of q: the sum of the weights."""
    terms = query_terms(q)
    hit = index.filter(F.col("term").isin(*terms)) if terms else index.limit(0)
    return hit.groupBy(key).agg(F.sum("weight").alias("rank"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms)).select(key, "rank")


def highlight(text: Column, q: str) -> Column:
    """Matched words between <b> and </b>; all terms in one pass, so none matches inside the marks of another."""
    terms = sorted(query_terms(q), key=lambda t: (-len(t), t))
    if not terms:
        return text
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(terms)})(?![\p{{L}}\p{{N}}])", "<b>$1</b>")


def asset_documents(versions: DataFrame) -> DataFrame:
    """The newest versions with their tags as a text."""
    return latest(dealt(versions, "asset"), "asset", "created_at").withColumn("tag_text", F.array_join("tags", " "))


def column_documents(column_edges: DataFrame) -> DataFrame:
    """asset, column, name of the columns of active column edges."""
    salt = F.pmod(F.xxhash64("from_asset", "to_asset"), F.lit(32)).alias("salt")  # a column of very many edges is first seen once in each share of them
    ends = column_edges.filter(F.col("superseded_at").isNull()).select(salt, F.explode(F.array(F.struct(F.col("from_asset").alias("asset"), F.col("from_column").alias("column")), F.struct(F.col("to_asset").alias("asset"), F.col("to_column").alias("column")))).alias("c"))
    ends = dealt(ends.select("c.*", "salt"), "asset", "column", "salt").distinct()
    return dealt(stored(ends.select("asset", "column"), "column-ends"), "asset", "column").distinct().withColumn("name", F.concat_ws(".", "asset", "column"))


def search_assets(versions: DataFrame, q: str, tag: str | None = None, owner: str | None = None) -> DataFrame:
    """kind, name, title, rank over the newest versions: names weigh most, then descriptions, then owners and tags."""
    flat = asset_documents(versions)
    if tag:
        flat = flat.filter(F.array_contains("tags", tag))
    if owner:
        flat = flat.filter(F.col("owner") == owner)
    hits = search(term_index(flat, "asset", {"asset": "A", "description": "B", "owner": "C", "tag_text": "C"}), "asset", q)
    return hits.join(flat.select("asset", "description"), "asset").select(F.lit("asset").alias("kind"), F.col("asset").alias("name"), highlight(F.col("asset"), q).alias("title"), "rank")


def search_columns(column_edges: DataFrame, q: str) -> DataFrame:
    """kind, name, title, rank over columns of active column edges."""
    named = column_documents(column_edges)
    hits = search(term_index(named, "name", {"column": "A", "asset": "B"}), "name", q)
    return hits.select(F.lit("column").alias("kind"), "name", highlight(F.col("name"), q).alias("title"), "rank")


def combined(assets: DataFrame, columns: DataFrame, size: int = 20, number: int = 0) -> tuple[DataFrame, int]:
    """(page by rank and name, total)"""
    both = assets.unionByName(columns)
    return both.orderBy(F.desc("rank"), "name", "kind").offset(size * number).limit(size), both.count()


def list_assets(versions: DataFrame, size: int = 50, number: int = 0) -> DataFrame:
    """Newest first, at most 100 a page."""
    size = min(size, 100)
    return latest(versions, "asset", "created_at").orderBy(F.desc("created_at"), "asset").offset(size * number).limit(size)
