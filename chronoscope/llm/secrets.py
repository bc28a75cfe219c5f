"""Secret scans with an incremental blob ledger. DataFrame operations only.

Every version of a text is addressed by its content (SHA-256). The ledger holds one row per blob and
rule version that has been scanned, with the findings (also empty ones). A scan looks only at distinct
blobs, and in each only for rules whose version the ledger does not have; findings then are joined
back to every path (row) that holds the blob. Raising a rule's version rescans that rule alone.

Offsets come from the regular expression functions: split() gives the pieces between matches and
regexp_extract_all() the matches, and both are leftmost and non-overlapping, so running sums of their
lengths (in code points) are the places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored


@dataclass(frozen=True)
class Rule:
    """A match counts if group `group` has at least `least` characters. `hint` is a cheap pattern that
    every counting match contains; texts without it are not searched further."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


# Kinds and patterns as specified; a keyword's letters in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 1, ASSIGN, 2, 6, r"(?i)(?:password|passwd|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
)
FINDING = "array<struct<start:int,end:int>>"


def blob_of(text: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find(text: Column, rule: Rule) -> Column:
    """Places of the counting matches: array of (start, end), code points, end exclusive."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.zip_with(matches, checked, lambda m, c: F.struct(F.char_length(m).alias("n"), F.char_length(c).alias("c")))
    numbered = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), pieces, lambda g, p: F.struct(F.char_length(g).alias("gap"), p["n"].alias("n"), p["c"].alias("c")))
    empty = F.array().cast("array<struct<start:int,end:int,c:int>>")
    walked = F.aggregate(numbered, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda a, p: F.struct(
        (a["at"] + p["gap"] + p["n"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["n"]).alias("end"), p["c"].alias("c")))).alias("out")))["out"]
    counting = F.transform(F.filter(walked, lambda x: x["c"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(text.rlike(rule.hint), counting).otherwise(F.array().cast(FINDING))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, kind, version, found) for every unseen pair of blob and rule version in
    versions(blob, text). Copies of a blob are dropped before the search, within each task first."""
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "kind", F.col("version").cast("string"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
    else:
        blobs = blobs.withColumn("seen", F.lit(None).cast("array<string>"))
    parts = []
    for r in rules:
        unseen = ~F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), f"{r.kind}/{r.version}")
        found = F.when(unseen, find(F.col("text"), r))
        parts.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), found.alias("found")))
    rows = blobs.select("blob", F.explode(F.array(*parts)).alias("x")).select("blob", "x.*")
    return rows.where(F.col("found").isNotNull())


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob: an array of (start, kind's place among the rules, kind, end), sorted, of the
    given rule versions."""
    rank = F.lit(None).cast("int")
    for k, r in enumerate(rules):
        rank = F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(k)).otherwise(rank)
    spans = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"), x["end"].alias("end")))
    return (ledger.withColumn("rank", rank).where(F.col("rank").isNotNull() & (F.size("found") > 0))
            .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans")))


def scanned(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after one more delivery: what it lacks of docs is scanned and stored as an increment of its
    own in the shared folder; what it has is neither read nor written again."""
    new = stored(scan(docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")), rules, ledger), "secret-ledger")
    return new if ledger is None else ledger.unionByName(new)


def deliveries(docs: DataFrame) -> list[DataFrame]:
    """The documents as two deliveries, by a hash of the id (a null id is in the first)."""
    second = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1, F.lit(False))
    return [docs.where(~second), docs.where(second)]


def secrets_of_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Findings of every row of docs: counts by kind, the digest of the base spans, and all spans as
    kind:start:end, comma-joined. Texts without findings, empty and null ones have counts 0 and the
    digest of the empty string. Rows that share a text share its findings; repeated rows stay. Other
    columns are ignored, an empty table gives an empty result."""
    versions = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    new = scan(versions.select("blob", "text"), rules, ledger)
    whole = new if ledger is None else new.unionByName(ledger.select("blob", "kind", "version", "found"))
    return findings_of_rows(versions.select("doc_id", "blob"), whole, rules)


def secrets_by_deliveries(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`secrets_of_documents` by way of a stored ledger that grows delivery by delivery: a blob that an earlier
    delivery held is not scanned again, and every row reads its findings from the ledger."""
    ledger = None
    for part in deliveries(docs.select("doc_id", "text")):
        ledger = scanned(part, ledger, rules)
    return findings_of_rows(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), ledger, rules)


def findings_of_rows(rows: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest and spans of rows(doc_id, blob) from the ledger."""
    found = findings_by_blob(ledger, rules)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return (rows.join(found, "blob", "left")
            .select("doc_id", *[count(r.kind) for r in rules], F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans")))
