"""Merkle fixity audit of WARC archives.

Pages become WARC records, files hold the records of a range of page ids in order, and each replica of
the archive gets a hash tree: leaves are the SHA-256 of a record with its length, inner nodes the SHA-256
of up to FAN_OUT children in order with the ranges they cover, counted from the start of the node's own
range; over the records of a file and then over the files up to one root. Two replicas are compared from
the root, and only the children of nodes that differ are looked at, down to the records. A record that is
lost or added in the middle of a file moves all later ones of that file, so the records below unequal nodes
are aligned by page id and digest before any is called damaged: those that only moved are sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

FAN_OUT = 16
FILE_PAGES = 1000
#: the `file` of the tree's nodes above the files
ARCHIVE = -(1 << 62)
#: pages without id are dealt to so many files by a hash of the record
NAMELESS_FILES = 4096


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """One resource record as text; null url and html count as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"),
                    F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, html: Column | None = None, file_pages: int = FILE_PAGES) -> DataFrame:
    """The index of an archive: file, nth (record in the file), page_id, start and end (bytes in the
    file) and sha256 of every record. Records of a file stand by page id, then by digest (repeated
    rows: next to each other); pages without id are in files of their own, -1 and below, by a hash of
    the record. A file holds the pages of FILE_PAGES consecutive ids, so the windows are small."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html") if html is None else html)
    rows = pages.select("page_id", record.alias("record"))
    nameless = -1 - F.pmod(F.xxhash64("record"), F.lit(NAMELESS_FILES))
    file = F.when(F.col("page_id").isNull(), nameless).otherwise(F.floor(F.col("page_id") / file_pages)).cast("long")
    rows = rows.select(file.alias("file"), "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("sha256"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").isNotNull(), "page_id", "sha256")
    return (rows.withColumn("nth", (F.row_number().over(order) - 1).cast("long"))
            .withColumn("end", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .select("file", "nth", "page_id", (F.col("end") - F.col("length")).alias("start"), "end", "sha256"))


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"), 256)


def _levels_to_one(width: int) -> int:
    n = 0
    while width > 1:
        width, n = -(-width // FAN_OUT), n + 1
    return n


def hash_tree(index: DataFrame, steps: list[str], low: int) -> list[DataFrame]:
    """Levels from the records to the single root, each (file, node, parent_file, parent, start, end,
    hash). steps: how each level finds its parents: "file" (by place in the file), "archive" (the one
    node of a file by the file's place) or "top" (by place among the archive's nodes)."""
    level = index.select("file", F.col("nth").alias("node"), "start", "end", _hash(F.col("end") - F.col("start"), F.col("sha256")).alias("hash"))
    levels = []
    for step in steps:
        place = F.col("file") - low if step == "archive" else F.col("node")
        level = (level.withColumn("parent_file", F.col("file") if step == "file" else F.lit(ARCHIVE).cast("long"))
                 .withColumn("parent", F.floor(place / FAN_OUT)))
        levels.append(level)
        child = F.struct(place.alias("place"), "start", "end", "hash")
        first = F.array_min("c.start") if step == "file" else F.lit(0)  # ranges of different files have no common start
        text = F.transform("c", lambda x: F.concat_ws(":", x["place"].cast("string"), (x["start"] - F.col("first")).cast("string"), (x["end"] - F.col("first")).cast("string"), x["hash"]))
        level = (level.groupBy(F.col("parent_file").alias("file"), F.col("parent").alias("node"))
                 .agg(F.array_sort(F.collect_list(child)).alias("c")).withColumn("first", first)
                 .select("file", "node", F.array_min("c.start").alias("start"), F.array_max("c.end").alias("end"), _hash(F.array_join(text, ",")).alias("hash")))
        level = stored(level, "fixity-level")
    return [*levels, level.withColumn("parent_file", F.lit(None).cast("long")).withColumn("parent", F.lit(None).cast("long"))]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two archive indexes differ: file, nth, page_id, start, end, sha256 in either
    replica (null: no such record), and status changed (another content under the same id), missing or
    extra. Of repeated records each counts. Equal roots leave nothing to
    compare below and give no rows. The indexes and inner levels are stored; each step of the descent
    joins only the children of nodes that differ."""
    primary, replica = stored(primary, "fixity-index"), stored(replica, "fixity-index")
    at = primary.unionByName(replica).agg(F.max("nth").alias("n"), F.min("file").alias("low"), F.max("file").alias("high")).first()
    if at["n"] is None:
        return _report(primary, replica, primary.select("file", "nth"))
    steps = ["file"] * _levels_to_one(at["n"] + 1) + ["archive"] + ["top"] * max(0, _levels_to_one(at["high"] - at["low"] + 1) - 1)
    unequal = None
    for a, b in zip(*(reversed(hash_tree(x, steps, at["low"])) for x in (primary, replica))):
        if unequal is not None:
            above = unequal.select(F.col("file").alias("parent_file"), F.col("node").alias("parent"))
            a, b = (x.join(above, ["parent_file", "parent"], "left_semi") for x in (a, b))
        both = a.select("file", "node", F.col("hash").alias("a")).join(b.select("file", "node", F.col("hash").alias("b")), ["file", "node"], "full_outer")
        unequal = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    return _report(primary, replica, stored(unequal.select("file", F.col("node").alias("nth")), "fixity-found"))


def _report(primary: DataFrame, replica: DataFrame, keys: DataFrame) -> DataFrame:
    """The records below unequal nodes, aligned within their file: first those of equal id and digest (the
    n-th with the n-th) drop out, then what is left pairs by id. A page of one id has few records, so the
    windows are small."""
    def numbered(x: DataFrame, *by: str) -> DataFrame:
        return x.withColumn("n", F.row_number().over(Window.partitionBy("file", "page_id", *by).orderBy("nth")))

    def same(*by: str) -> list[Column]:
        return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("file", "page_id", "n", *by)]

    a, b = (numbered(x.join(keys, ["file", "nth"], "left_semi"), "sha256") for x in (primary, replica))
    lost = numbered(a.alias("a").join(b.alias("b"), same("sha256"), "left_anti").drop("n"))
    new = numbered(b.alias("b").join(a.alias("a"), same("sha256"), "left_anti").drop("n"))
    status = F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "extra").otherwise("changed")
    return (lost.alias("a").join(new.alias("b"), same(), "full_outer")
            .select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("file", "nth", "page_id", "start", "end")],
                    F.col("a.sha256").alias("sha256"), F.col("b.sha256").alias("replica_sha256"), status.alias("status")))


def damaged(pages: DataFrame, file_pages: int = FILE_PAGES) -> DataFrame:
    """Index of a replica with known faults: in every 97th page the first character of the html is
    overwritten, and every seventh file has lost its last record."""
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    index = archive(pages, html, file_pages)
    last = F.max("nth").over(Window.partitionBy("file"))
    return index.withColumn("last", last).where((F.col("file") % 7 != 3) | (F.col("nth") < F.col("last"))).drop("last")
