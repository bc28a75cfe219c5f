"""Text archive formats read as distributed text jobs (A5 ARFF relational, A6 .ts), the
wide relevance matrix (A7) and result files located by path (A10).

ARFF relational line:  '<dim 0 values>\\n<dim 1 values>...',label   (values comma-separated, the two
characters backslash-n between dimensions, feature-major). The bag stands in single or double quotes, the
label may; a quote inside is escaped by a backslash.
.ts line:              <dim 0 values>:<dim 1 values>:...:label
'?', NaN and empty values count as 0; dimensions and samples may differ in length. Header lines start with
'@' (both), comments with '%' (ARFF) or '#' (.ts). The header is read once and says which labels there are; a
label that it does not declare is an error, raised when the line is read. A header without a declaration
takes any label. Positions (the archive numbers samples by line) are counted over all files in path order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoscope.functions.joins import bounded_broadcast

HEADER_LINES = 100_000
NAME = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^\s,{}]+"""


@dataclass(frozen=True)
class Header:
    """labels: the declared ones, or None. timestamps: values of a .ts file are (time, value) pairs."""
    labels: tuple[str, ...] | None = None
    timestamps: bool = False


def _unquoted(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name[1:-1]) if name[:1] in "'\"" and len(name) > 1 else name


def _header_lines(spark: SparkSession, path: str) -> list[str]:
    """The distinct header lines of all files (every one has the same few)."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value").startswith("@")).distinct().limit(HEADER_LINES + 1).collect()
    if len(lines) > HEADER_LINES:
        raise ValueError(f"more than {HEADER_LINES} different header lines")
    return sorted(r["value"] for r in lines)


def arff_header(spark: SparkSession, path: str) -> Header:
    """The values of the nominal attribute (`@attribute name {a, 'b c', ...}`); files that declare different
    ones are an error."""
    found = set()
    for line in _header_lines(spark, path):
        m = re.fullmatch(rf"@attribute\s+(?:{NAME})\s*\{{(.*)\}}\s*", line, re.IGNORECASE)
        if m:
            found.add(tuple(_unquoted(x) for x in re.findall(NAME, m[1])))
    if len(found) > 1:
        raise ValueError(f"several declarations of the label: {sorted(found)}")
    return Header(*found)


def ts_header(spark: SparkSession, path: str) -> Header:
    """`@classLabel true a b ...` and `@timestamps true`."""
    labels, timestamps = set(), False
    for line in _header_lines(spark, path):
        words = line.split()
        if words[0].lower() == "@classlabel" and len(words) > 1 and words[1].lower() == "true":
            labels.add(tuple(words[2:]))
        timestamps |= words[0].lower() == "@timestamps" and words[1:2] == ["true"]
    if len(labels) > 1:
        raise ValueError(f"several declarations of the label: {sorted(labels)}")
    return Header(labels.pop() if labels else None, timestamps)


def _ordered_lines(spark: SparkSession, path: str, comment_prefixes: tuple[str, ...]) -> DataFrame:
    """(sample_idx, value) of the data lines, sample_idx = 0-based position in (file, offset) order.

    The lines of a block of a file are read by one task, in order, so ids that grow along a task place them
    within the block; the lines are materialised with these ids, and everything else is counted from that
    table. Block counts become offsets by a window over the blocks of a file, and one over the files."""
    from chronoscope.session import materialize
    keep = F.length(F.trim("value")) > 0
    for p in comment_prefixes:
        keep = keep & ~F.ltrim("value").startswith(p)
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
             .where(keep).withColumn("_m", F.monotonically_increasing_id()))
    lines = materialize(lines)
    blocks = materialize(lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0")))
    in_file = blocks.withColumn("_in", F.coalesce(F.sum("_n").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = blocks.groupBy("_f").agg(F.sum("_n").alias("_n"))
    files = files.select("_f", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per file
    places = in_file.join(bounded_broadcast(files), "_f").select("_f", "_b", (F.col("_before") + F.col("_in") - F.col("_m0")).alias("_shift"))
    return lines.join(bounded_broadcast(places), ["_f", "_b"]).select((F.col("_m") + F.col("_shift")).alias("sample_idx"), "value")


def _to_double(s: Column) -> Column:
    d = F.trim(s).try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d)


def _checked(label: Column, header: Header) -> Column:
    if header.labels is None:
        return label
    message = F.concat(F.lit("label not declared in the header: "), F.coalesce(label, F.lit("null")))
    return F.when(F.array_contains(F.lit(list(header.labels)), label), label).otherwise(F.raise_error(message).cast("string"))


def _exploded(df: DataFrame, dims: Column, label: Column, timestamps: bool = False) -> DataFrame:
    rows = df.select("sample_idx", label.alias("target"), F.posexplode(dims).alias("feature", "_dim"))
    values = F.regexp_extract_all("_dim", F.lit(r"\([^()]*,\s*([^(),]*)\)"), F.lit(1)) if timestamps else F.split("_dim", ",")
    vals = rows.select("sample_idx", "target", "feature", F.posexplode(values).alias("t", "_v"))
    return vals.select(F.col("sample_idx").cast("bigint").alias("noun_id"), F.col("feature").cast("bigint"),
                       F.col("t").cast("bigint"), _to_double(F.col("_v")).alias("x"), "target")


def read_arff_relational(spark: SparkSession, path: str) -> DataFrame:
    """(noun_id = line position, feature, t, x, target). A line that is not a quoted bag and a label is an error."""
    header = arff_header(spark, path)
    lines = _ordered_lines(spark, path, ("@", "%"))
    line = r"""^\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")\s*,\s*(.*?)\s*$"""
    fits = F.regexp_like("value", F.lit(line))
    value = F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a relational line: "), F.left("value", F.lit(80)))).cast("string"))
    parts = lines.select("sample_idx", value.alias("value")).select("sample_idx", F.concat(F.regexp_extract("value", line, 1), F.regexp_extract("value", line, 2)).alias("bag"), F.regexp_extract("value", line, 3).alias("label"))
    quoted = F.regexp_like("label", F.lit(r"""^(?:'.*'|".*")$""")) & (F.length("label") > 1)
    label = F.when(quoted, F.regexp_replace(F.expr("substring(label, 2, length(label) - 2)"), r"\\(.)", "$1")).otherwise(F.col("label"))
    return _exploded(parts, F.split("bag", r"\\n"), _checked(label, header))


def read_ts(spark: SparkSession, path: str) -> DataFrame:
    """(noun_id = line position, feature, t, x, target); values with timestamps are taken in their order."""
    header = ts_header(spark, path)
    lines = _ordered_lines(spark, path, ("@", "#"))
    if header.timestamps:  # colons may stand in the times
        dims = F.regexp_extract_all("value", F.lit(r"((?:\([^()]*\),?)+)(?=:)"), F.lit(1))
        label = F.trim(F.regexp_extract("value", r":([^:()]*)$", 1))
        return _exploded(lines, dims, _checked(label, header), True)
    parts = F.split("value", ":")
    return _exploded(lines, F.slice(parts, 1, F.size(parts) - 1), _checked(F.trim(F.element_at(parts, -1)), header))


def _dims_text(cells: DataFrame, sep: str) -> DataFrame:
    """(noun_id, text of all dimensions joined by sep) with values in step order."""
    per_dim = cells.groupBy("noun_id", "feature").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda s: s["x"].cast("string")), ",").alias("_d"))
    return per_dim.groupBy("noun_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature", "_d"))), lambda s: s["_d"]), sep).alias("_bag"))


def write_arff_relational(cells: DataFrame, targets: DataFrame, path: str, relation: str = "signals") -> None:
    """Header + one line per sample, samples in noun_id order (range-partitioned part files)."""
    body = _dims_text(cells, "\\n").join(targets, "noun_id").select(
        "noun_id", F.concat(F.lit("'"), F.col("_bag"), F.lit("',"), F.col("target")).alias("value"))
    header = cells.sparkSession.createDataFrame(
        [(-2, f"@relation {relation}"), (-1, "@data")], "noun_id long, value string")
    header.unionByName(body).repartitionByRange("noun_id").sortWithinPartitions("noun_id").select("value") \
        .write.mode("overwrite").text(path)


def write_ts(cells: DataFrame, targets: DataFrame, path: str) -> None:
    body = _dims_text(cells, ":").join(targets, "noun_id").select(
        "noun_id", F.concat(F.col("_bag"), F.lit(":"), F.col("target")).alias("value"))
    header = cells.sparkSession.createDataFrame([(-2, "@problemName signals"), (-1, "@data")], "noun_id long, value string")
    header.unionByName(body).repartitionByRange("noun_id").sortWithinPartitions("noun_id").select("value") \
        .write.mode("overwrite").text(path)


def read_wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """CSV with rows = t and columns '{id}_feature_{f}' -> long (noun_id, feature, t, x)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    tcol = df.columns[0]
    vals = [c for c in df.columns if c != tcol]
    long = df.unpivot([tcol], vals, "col", "v")
    return long.select(F.regexp_extract("col", r"^(.*)_feature_\d+$", 1).alias("noun_id"),
                       F.regexp_extract("col", r"_feature_(\d+)$", 1).cast("bigint").alias("feature"),
                       F.col(tcol).cast("bigint").alias("t"), F.col("v").cast("double").alias("x"))


def read_results_by_path(spark: SparkSession, root: str) -> DataFrame:
    """A10: result CSVs anywhere below root; method, k and mask come from the file path
    (.../interpretability_<method>__<k>/.../mask=<top|bottom>/part-*.csv)."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(root)
    p = F.col("_metadata.file_path")
    return df.select("*",
                     F.regexp_extract(p, r"interpretability_(.+?)__[\d.]+", 1).alias("method"),
                     F.regexp_extract(p, r"__([\d.]+)/", 1).cast("double").alias("k"),
                     F.regexp_extract(p, r"(top|bottom)", 1).alias("mask"))


def write_wide_matrix(rel: DataFrame, path: str, value: str = "r") -> None:
    """rows = t, one column per '{noun_id}_feature_{f}' (the reference's relevance CSV layout).
    The column count grows with the number of samples, so this is an export for small selections;
    the library keeps results long."""
    col = F.concat(F.col("noun_id").cast("string"), F.lit("_feature_"), F.col("feature").cast("string"))
    wide = rel.withColumn("col", col).groupBy("t").pivot("col").agg(F.first(value))
    wide.orderBy("t").write.mode("overwrite").option("header", True).csv(path)
