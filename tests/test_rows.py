import math

import pytest
from pyspark.sql import functions as F

from chronoscope.operators import rows as R

SCHEMA = "noun_id long, signal array<array<double>>, labels array<string>"
NAN = float("nan")
SAMPLES = [(1, [[1.0, 10.0], [2.0, NAN], [3.0, 30.0], [4.0, 40.0]], ["b", "a", "x"]), (2, [[5.0, 1.0], [6.0, 2.0], [None, 3.0]], ["a"]),
           (3, [[7.0, 7.0], [8.0, 7.0]], []), (4, [[9.0, 9.0], [9.0, 9.0], [9.0, 9.0]], None), (5, [], ["a", "b", "a", ""])]


def frame(spark):
    return spark.createDataFrame(SAMPLES, SCHEMA)


def test_state_and_rows_by_hand(spark):
    asked = R.RowTransform(min_length=3, length=3, cropping="start", keep=("a", "b"))
    got = R.fit(frame(spark), asked)
    first = [1, 2, 3, 4, 5, 6, 0, 9, 9, 9]
    mean = sum(first) / 10
    assert got.mean[0] == pytest.approx(mean) and got.std[0] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in first) / 9))
    assert got.classes == ("0", "a", "a,b")
    ready = {r.noun_id: r for r in R.prepare_rows(frame(spark), got).collect()}
    assert {i: (r.target, r.encoded) for i, r in ready.items()} == {1: ("a,b", 2), 2: ("a", 1), 4: ("0", 0)}
    second = [(0 - got.mean[1]) / got.std[1], (30 - got.mean[1]) / got.std[1], (40 - got.mean[1]) / got.std[1]]
    assert list(ready[1].signal[1]) == pytest.approx(second)  # steps 2 to 4, NaN as 0
    assert ready[2].signal[0][2] == pytest.approx(-got.mean[0] / got.std[0])  # null as 0


def test_encodings_and_crops(spark):
    plain = {r.noun_id: r for r in R.prepare_rows(frame(spark), R.RowTransform(length=2, cropping="both", encoding="binary", keep=("b",)), 2).collect()}
    assert {i: r.encoded for i, r in plain.items()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    assert [list(s) for s in plain[1].signal] == [[2.0, 3.0], [0.0, 30.0]] and [list(s) for s in plain[5].signal] == [[], []]
    hot = R.prepare_rows(frame(spark), R.RowTransform(length=3, encoding="onehot", keep=("a",), classes=("0", "a")), 2)
    assert {r.noun_id: list(r.encoded) for r in hot.collect()} == {1: [0, 1], 2: [0, 1], 3: [1, 0], 4: [1, 0], 5: [0, 1]}
    with pytest.raises(Exception, match="not seen"):
        R.prepare_rows(frame(spark), R.RowTransform(classes=("a",)), 2).collect()


def test_crop_equals_the_long_form(spark):
    from chronoscope.operators.prepare import resize

    rows = frame(spark).where(F.size("signal") > 0)
    cells = R.prepared_cells(R.prepare_rows(rows, R.RowTransform(encoding="binary"), 2))
    for cropping in ("end", "start", "both"):
        for length in (1, 2, 3, 5):
            want = {tuple(r) for r in resize(cells, length, cropping).collect()}
            got = R.prepared_cells(R.prepare_rows(rows, R.RowTransform(length=length, cropping=cropping, encoding="binary"), 2))
            assert {tuple(r) for r in got.collect()} == want


def test_no_exchange_and_one_feature_without_spread(spark):
    state = R.fit(frame(spark).where("noun_id = 4"))
    ready = R.prepare_rows(frame(spark).where("noun_id = 4"), state)
    assert [list(s) for s in ready.first().signal] == [[0.0] * 3] * 2
    plan = ready._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
