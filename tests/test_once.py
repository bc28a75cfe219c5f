"""Arrays that a lambda reads are built once for the row, not for every element."""

import datetime
import re

from chronoscope.sources import signals as S


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signals_of_events_are_built_once(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, day, "a", 1.0), (1, day + datetime.timedelta(days=2), "b", 2.0), (2, day, "b", None), (2, day + datetime.timedelta(days=1), "a", 4.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    signals = S.rows_from_events(spark, str(tmp_path))
    got = {r.noun_id: ([["nan" if x is not None and x != x else x for x in s] for s in r.signal], list(r.labels)) for r in signals.collect()}
    assert got == {1: ([[1.0, "nan"], ["nan", "nan"], ["nan", 2.0]], ["b"]), 2: ([["nan", None], [4.0, "nan"]], ["a"])}
    assert re.search(r"lambdafunction\(slice\(lambda", plan_of(signals))  # not lambdafunction(slice(concat(.., flatten(..)))
