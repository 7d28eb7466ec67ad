"""Registered queries on the smallest tables: against SQL, the libraries or each other; and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from ledgerlake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = registry.QUERIES[name](spark, small)
    want = c.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op3_pii_surrogates", "op9_extendible_dedup"])
def test_native_queries_run_no_python(spark, small, name):
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    whole = {r.doc_id: r for r in docs.collect()}
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, small).cache()
        assert at.columns == docs.columns
        kept[name] = {r.doc_id: r for r in at.collect()}
    assert set(kept["pii"]) == set(kept["near_dedup"]) < set(kept["exact_dedup"]) < set(kept["quality"]) < set(whole)
    texts = [r.text for r in kept["exact_dedup"].values()]
    assert len(texts) == len(set(texts)) == len({r.text for r in kept["quality"].values()})
    assert all(r.n_chars == len(r.text) for r in kept["pii"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, at, small).collect()
    assert {r.doc_id for r in packed} == set(kept["pii"])
    per = {}
    for r in packed:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert all(per[r.doc_id] == r.doc_tokens for r in packed)


def test_pipeline_stages_on_odd_tables(spark):
    kind = "doc_id long, text string, id string, keep_id string, digest string, __digest string, __entities string, n string"
    text = "The river runs past the old mill and the children watch the boats on their way to school every morning."
    rows = [(1, text), (2, text), (3, None), (None, f"Write to anna.k@mail.example.com today. {text} {text[:40]} and more of it."), (5, "")]
    for some in (rows, []):
        at = spark.createDataFrame([(*r, *["clash"] * 6) for r in some], kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, "").cache()
            assert at.columns[:2] == ["doc_id", "text"] and len(at.columns) == 8, name
            assert all(tuple(r)[2:] == ("clash",) * 6 for r in at.collect()), name
        got = {r.doc_id: r.text for r in at.collect()}
        assert not some or 1 not in got and "anna.k" not in (got[None] or "")
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, at, "").collect()} == set(got)
