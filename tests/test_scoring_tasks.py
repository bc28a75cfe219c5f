"""The scores of corrupted samples are made in as many tasks as the session asks for, however few bytes they are."""

import numpy as np

from chronoscope.operators.blocks import corrupted_logits
from chronoscope.operators.network import Network


def test_scored_samples_are_not_merged_into_a_few_tasks(spark):
    cells = [("m", i, 0, t, float(t), float(t - 1)) for i in range(40) for t in range(4)]
    rel = spark.createDataFrame(cells, "method string, noun_id long, feature long, t long, x double, r double")
    stats = spark.createDataFrame([("m", i, [1.0, 1.0], 1, 4) for i in range(40)], "method string, noun_id long, bound array<double>, n_feat int, n_steps int")
    sm = spark.createDataFrame([("m", i, g, 0.5, 1) for i in range(40) for g in range(2)], "method string, noun_id long, g long, drop_prob double, block_size int")
    net = Network(np.zeros(4, np.int64), np.arange(4), ((np.ones((2, 4)), np.zeros(2)),))
    scored = corrupted_logits(rel, stats, sm, net, 1, 42)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scored.rdd.getNumPartitions() == n
    rows = scored.collect()
    assert sorted((r.noun_id, r.g) for r in rows) == [(i, g) for i in range(40) for g in range(2)]
