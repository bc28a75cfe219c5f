import math
import random

import pytest
from pyspark.sql import functions as F

from chronoscope.streaming import feature_stats as ST

SCHEMA = "ts timestamp, f string, v double"


def write(rows, spark, path, name):
    frame = spark.createDataFrame(rows, "ts string, f string, v double").withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.parquet(f"{path}/{name}")


def many(seed, n):
    r = random.Random(seed)
    return [(f"2024-01-{r.randrange(1, 9):02d} {r.randrange(24):02d}:00:00", r.choice(["a", "b", None]), r.choice([None, 1e9 + r.random(), r.gauss(3, 2)])) for _ in range(n)]


def brute(rows, key):
    groups = {}
    for row in rows:
        groups.setdefault(key(row), []).append(row[2])
    out = {}
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None]
        mean = math.fsum(vs) / len(vs) if vs else None
        std = math.sqrt(math.fsum((v - mean) ** 2 for v in vs) / (len(vs) - 1)) if len(vs) > 1 else 0.0
        out[k] = (len(vs), mean, std, min(vs, default=None), max(vs, default=None))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][3:] == want[k][3:]
        assert (got[k][1] is None) == (want[k][1] is None)
        if want[k][0]:
            assert got[k][1] == pytest.approx(want[k][1], rel=1e-12) and got[k][2] == pytest.approx(want[k][2], rel=1e-9)


def table(df):
    return {(*((r.window_start.strftime("%m-%d"),) if "window_start" in r else ()), r.feature): (r.n, r.mean, r.std, r.min, r.max) for r in df.collect()}


def test_late_rows_over_several_files(spark, tmp_path):
    """Each file is a batch; the later ones hold rows of windows that earlier ones have left behind."""
    path, every = str(tmp_path / "in"), []
    for i in range(7):
        rows = many(i, 40) + [("2023-12-31 23:59:59", "late", float(i))]
        every += rows
        write(rows, spark, path, f"part={i}")
    got = ST.windowed_feature_stats(spark, path, SCHEMA, "ts", "f", "v", compact_every=3)
    same(table(got), brute(every, lambda r: (r[0][5:10], r[1])))
    assert table(got)[("12-31", "late")][0] == 7


def test_increments_and_reruns(spark, tmp_path):
    """A second call reads only the new file; a batch that runs again changes nothing."""
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    first, second = many(1, 60), many(2, 60)
    write(first, spark, path, "part=0")
    same(table(ST.streaming_feature_stats(spark, path, SCHEMA, "f", "v", state=state)), brute(first, lambda r: (r[1],)))
    write(second, spark, path, "part=1")
    now = table(ST.streaming_feature_stats(spark, path, SCHEMA, "f", "v", state=state))
    same(now, brute(first + second, lambda r: (r[1],)))
    assert ST._committed(spark, state) == {"base": [], "delta": [0, 1]}
    again = spark.createDataFrame([(r[1], r[2]) for r in second], "feature string, value double")
    ST.update_state(again, 1, state, ["feature"], "value")
    same(table(ST.read_state(spark, state, ["feature"])), now)
    assert table(ST.streaming_feature_stats(spark, path, SCHEMA, "f", "v", state=state)) == table(ST.read_state(spark, state, ["feature"]))


def test_compaction_and_uncommitted_folders(spark, tmp_path):
    state, every = str(tmp_path / "state"), []
    for i in range(8):
        rows = many(10 + i, 30)
        every += rows
        for _ in range(2 if i in (3, 5, 7) else 1):  # with reruns of batches that end in a base
            ST.update_state(spark.createDataFrame([(r[1], r[2]) for r in rows], "feature string, value double"), i, state, ["feature"], "value", compact_every=2)
        same(table(ST.read_state(spark, state, ["feature"])), brute(every, lambda r: (r[1],)))
    assert ST._committed(spark, state) == {"base": [5, 7], "delta": [6, 7]}
    (tmp_path / "state" / "delta=8").mkdir()  # a writer that died
    same(table(ST.read_state(spark, state, ["feature"])), brute(every, lambda r: (r[1],)))


def test_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ST.read_state(spark, str(tmp_path / "none"), ["feature"]) is None
    assert ST.streaming_feature_stats(spark, str(tmp_path / "in"), SCHEMA, "f", "v").count() == 0
