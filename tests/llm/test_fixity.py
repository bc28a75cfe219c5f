from pyspark.sql import functions as F

from chronoscope.llm import fixity


def pages(spark, n):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("<p>"), F.sha2(F.col("id").cast("string"), 256), F.lit("</p>")).alias("html"))


def test_record_is_whole(spark):
    r = pages(spark, 1).select(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first()["r"]
    head, _, body = r.partition("\r\n\r\n")
    assert head.startswith("WARC/1.0\r\n") and f"Content-Length: {len(body) - 4}" in head and body.endswith("</p>\r\n\r\n")


def test_locates_planted_damage(spark):
    good = fixity.archive(pages(spark, 2300), file_pages=40)
    bad = fixity.archive(pages(spark, 2300).withColumn("html", F.when(F.col("page_id").isin(7, 1234), F.lit("?")).otherwise(F.col("html"))), file_pages=40)
    bad = bad.where("page_id <> 2299")
    got = {(r["page_id"], r["status"]) for r in fixity.audit(good, bad).collect()}
    # a record of another length moves all later ones of its file, which are sound
    assert got == {(7, "changed"), (1234, "changed"), (2299, "missing")}
    extra = {(r["page_id"], r["status"]) for r in fixity.audit(bad.where("page_id > 1400"), good.where("page_id > 1400")).collect()}
    assert (2299, "extra") in extra


def test_records_lost_or_added_in_the_middle(spark):
    """One page gone from the middle of a file, one more in another, one repeated, and one changed after the gap."""
    good = fixity.archive(pages(spark, 500), file_pages=50)
    rows = pages(spark, 500).where("page_id <> 120").withColumn("html", F.when(F.col("page_id") == 140, F.lit("?")).otherwise(F.col("html")))
    more = spark.createDataFrame([(210, "http://x/210", "new"), (310, None, "h")], "page_id long, url string, html string")
    again = rows.where("page_id = 410")
    bad = fixity.archive(rows.unionByName(more.where("page_id = 210")).unionByName(again), file_pages=50)
    got = sorted((r["page_id"], r["status"]) for r in fixity.audit(good, bad).collect())
    assert got == [(120, "missing"), (140, "changed"), (210, "extra"), (410, "extra")]


def test_pages_without_id_are_spread(spark):
    rows = spark.range(600).select(F.lit(None).cast("long").alias("page_id"), F.col("id").cast("string").alias("url"), F.lit("h").alias("html"))
    index = fixity.archive(rows)
    assert index.agg(F.max("nth")).first()[0] < 10 and index.where("file < 0").count() == 600
    got = fixity.audit(index, fixity.archive(rows.where("url <> '77'"))).collect()
    assert [r["status"] for r in got] == ["missing"]


def test_equal_replicas_stop_at_the_root(spark):
    good = fixity.archive(pages(spark, 500), file_pages=40)
    assert fixity.audit(good, good.repartition(5)).collect() == []
    trees = [fixity.hash_tree(x, ["file", "file", "archive"], 0) for x in (good, good.repartition(3))]
    assert [len(t) for t in trees] == [4, 4]
    roots = [t[-1].collect() for t in trees]
    assert len(roots[0]) == 1 and roots[0][0]["hash"] == roots[1][0]["hash"]


def test_edges(spark):
    odd = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "h", "x"), (2, "u", "", "x"), (10**12, "u", "h", "x")], "page_id long, url string, html string, node string")
    index = fixity.archive(odd)
    assert index.count() == 5 and fixity.audit(index, index).collect() == []
    assert fixity.archive(odd.limit(0)).collect() == [] and fixity.audit(index.limit(0), index.limit(0)).collect() == []
    assert fixity.audit(index, index.where("page_id is not null")).select("status").collect()[0][0] == "missing"
