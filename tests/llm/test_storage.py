"""What a query leaves on disk while it runs."""

import os
import re
import time

import corpus_pipeline as cp
from chronoscope.llm import near_duplicates as nd
from chronoscope.llm import storage
from conftest import words


def shuffle_blocks(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def tables(spark):
    return set(os.listdir(re.sub("^file:(//)?", "", storage.shared_folder(spark))))


def names(found):
    return {re.sub("-[0-9a-f]{32}$", "", x) for x in found}


def test_shuffle_files_go_with_their_table(spark):
    before, setting = shuffle_blocks(spark), spark.conf.get(storage.SHUFFLES_GO, None)
    table = storage.stored(spark.range(20_000).selectExpr("id % 7001 AS k").groupBy("k").count(), "test-counts")
    for _ in range(50):  # they are deleted in the background
        left = shuffle_blocks(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 7001
    assert spark.conf.get(storage.SHUFFLES_GO, None) == setting


def test_a_table_goes_with_its_last_reader(spark):
    before = tables(spark)
    first = storage.stored(spark.range(10).toDF("k"), "test-first")
    second = storage.stored(first.where("k > 3"), "test-second", first, spark.range(1))
    assert names(tables(spark) - before) == {"test-second"} and second.count() == 6
    storage.drop_stored(first, second)
    assert tables(spark) == before


def test_near_duplicates_keep_what_the_result_reads(spark):
    base = words(7, 80)
    texts = [" ".join(base), " ".join(base[:40] + ["new"] + base[41:]), " ".join(words(8, 60)), None, "", " ".join(base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = tables(spark)
    found = nd.near_duplicate_classes(docs).select("doc_id", "class_id")
    left = names(tables(spark) - before)
    assert not left & {f"near-{x}" for x in "sketches nodes members holders pairs texts first families differences recentred common common-elements".split()}
    assert {tuple(r) for r in found.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 0)}
    assert found.count() == 6  # again


def test_pipeline_keeps_the_last_stage(spark, sf001):
    before = tables(spark)
    rows = cp.run(spark, sf001)
    left = {x for x in names(tables(spark) - before) if x.startswith("pipeline-")}
    assert left == {"pipeline-source-mixing"} and rows.count() > 0
