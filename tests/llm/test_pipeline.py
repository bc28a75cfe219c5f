import corpus_pipeline as cp
from pyspark.sql import functions as F

from chronoscope.llm import mixing, quality
from test_decontaminate import brute as brute_leaks
from test_near_duplicates import brute_classes
from test_sharding import brute_capacity


def test_stages_and_names():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_run_against_brute_force(spark, sf001, documents, texts):
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.quality_of_documents(documents, labels).collect()}
    ids = [k for k in texts if score[k] >= 0.7]
    classes = brute_classes([(k, texts[k]) for k in ids])
    ids = sorted(set(classes.values()))
    items = [tuple(r) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in brute_leaks([(k, texts[k]) for k in ids], items)}
    ids = [k for k in ids if k not in leaks]
    # the draws of the rounding depend on the rows alone, so the same rows give the same copies
    taken = {r["doc_id"]: r["count"] for r in mixing.mixed_copies(documents.where(F.col("doc_id").isin(ids))).groupBy("doc_id").count().collect()}
    rows = cp.run(spark, sf001).collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == taken and set(got) <= set(ids)
    load = {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    assert max(load.values()) == brute_capacity([texts[r["doc_id"]] for r in rows], 40)


def test_stages_keep_columns_and_survive_edges(spark, sf001, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf001)
            assert out.columns == docs.columns, name
            assert out.count() >= 0
        assert cp.STAGES[-1][1](spark, docs, sf001).count() == docs.count()
