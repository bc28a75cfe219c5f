import math

from chronoscope.plans import pipeline as PL
from chronoscope.sources import signals as S
from paths import SF001


def test_dense_cells_by_hand(spark):
    bins = [(1, "b", 12, 5.0), (1, "a", 10, 1.0), (2, "b", 10, 7.0), (3, "a", 12, 9.0), (3, None, 11, 1.0), (3, "a", None, 1.0)]
    got = {(r.noun_id, r.feature, r.t): r.x for r in S.dense_cells(spark.createDataFrame(bins, "noun_id long, channel string, step int, v double")).collect()}
    want = {(i, f, t): 0.0 for i in (1, 2, 3) for f in (0, 1) for t in range(3)} | {(1, 1, 2): 5.0, (1, 0, 0): 1.0, (2, 1, 0): 7.0, (3, 0, 2): 9.0}
    assert got == want


def test_source_is_read_once(spark):
    """Origin, channels and bins come from one scan: what remains of the plan has no file in it."""
    plan = S.cells_from_events(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


def test_rows_have_nan_gaps(spark):
    rows = {r.noun_id: r for r in S.rows_from_events(spark, SF001).collect()}
    seen = spark.read.parquet(f"{SF001}/events.parquet").selectExpr("user_id", "to_date(ts) AS d", "event_type", "value").collect()
    names = sorted({r.event_type for r in seen})
    gaps = 0
    for i, row in rows.items():
        mine = [r for r in seen if r.user_id == i]
        first, last = min(r.d for r in mine), max(r.d for r in mine)
        assert len(row.signal) == (last - first).days + 1 and all(len(x) == len(names) for x in row.signal)
        assert row.labels == sorted({r.event_type for r in mine if r.d == last})
        sums = {}
        for r in mine:
            key = (r.d - first).days, names.index(r.event_type)
            sums[key] = sums.get(key, 0.0) + (r.value or 0.0)
        for t, values in enumerate(row.signal):
            for f, x in enumerate(values):
                gaps += math.isnan(x)
                assert math.isnan(x) if (t, f) not in sums else abs(x - sums[t, f]) < 1e-9
    assert gaps and len(rows) == len({r.user_id for r in seen})


def test_lookup_reads_one_bucket(spark):
    stored = S.store_for_lookup(S.rows_from_embeddings(spark, SF001))
    one = S.point_lookup(stored, stored.first().noun_id)
    assert one.count() == 1
    # the plan names the buckets only where the scan is kept bucketed; files are pruned either way
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = S.point_lookup(stored, 13)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan and "PushedFilters: [IsNotNull(noun_id), EqualTo(noun_id" in plan
    assert not spark.catalog.listTables()


def test_selection_among_classifiers(spark, tmp_path):
    from chronoscope.operators import surrogate
    pr = PL.prepared(spark, SF001, "emb")
    from pyspark.sql import functions as F
    fitted = pr.split.where(F.col("split") != "test").select("noun_id")
    rows = surrogate.select_classifier(pr.std_cells, pr.labelled, fitted, pr.test_ids, str(tmp_path / "model")).orderBy("cand").collect()
    assert len(rows) == 6 and len({r.val_accuracy for r in rows}) > 1
    best = max(r.val_accuracy for r in rows)
    chosen = [r for r in rows if r.chosen]
    assert len(chosen) == 1 and chosen[0].val_accuracy == best and chosen[0].cand == min(r.cand for r in rows if r.val_accuracy == best)
    assert [r.best_so_far for r in rows] == [max(x.val_accuracy for x in rows[:i + 1]) for i in range(6)]
    assert 0 <= chosen[0].test_accuracy <= 1 and all(r.test_accuracy is None for r in rows if not r.chosen)


def test_dataset_stats_against_the_files(spark):
    import os

    import pyarrow.parquet as pq

    import __spark_entry__ as E
    r = E.queries()["dataset_stats"](spark, SF001).first()
    path = f"{SF001}/embeddings.parquet"
    assert (r.n_rows, r.total_bytes, r.n_files, r.valid) == (pq.read_metadata(path).num_rows, os.path.getsize(path), 1, True)


def test_exports_are_in_order(spark, tmp_path):
    """lines of a text archive stand by sample, rows of a wide matrix by step."""
    from chronoscope.sources import text_formats as TX
    pr = PL.prepared(spark, SF001, "evt")
    TX.write_ts(pr.cells, pr.targets, str(tmp_path / "ts"))
    by_line = {(r.noun_id, r.target) for r in TX.read_ts(spark, str(tmp_path / "ts")).select("noun_id", "target").distinct().collect()}
    ids = sorted((r.noun_id, r.target) for r in pr.targets.collect())
    assert by_line == {(n, target) for n, (_, target) in enumerate(ids)}
    rel = spark.createDataFrame([(i, 0, t, float(i + t)) for i in (1, 2) for t in range(30)], "noun_id long, feature long, t long, r double").repartition(5)
    TX.write_wide_matrix(rel, str(tmp_path / "wide"))
    rows = [line.split(",") for part in sorted((tmp_path / "wide").glob("part-*.csv")) for line in part.read_text().splitlines()[1:]]
    assert [int(r[0]) for r in rows] == list(range(30))


def test_nan_and_null_entries_count_as_zero(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, float("nan"), None], 0), (2, [2.0, 3.0, 4.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.noun_id, r.t): r.x for r in S.cells_from_embeddings(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 0.0, (1, 2): 0.0, (2, 0): 2.0, (2, 1): 3.0, (2, 2): 4.0}
    from chronoscope.operators import rows as R
    ready = R.prepare_rows(S.rows_from_embeddings(spark, str(tmp_path)), R.RowTransform(classes=("0", "1")), 1)
    assert {(r.noun_id, r.t): r.x for r in R.prepared_cells(ready).collect()} == got
