"""Sharding by minimax contiguous partition of ordered atomic groups. DataFrame operations only.

Rows with equal texts form an atomic group; the groups are ordered by the SHA-256 of the text (null
texts: one group, first). The smallest capacity for which greedy filling needs no more than the wanted
shards is found by binary search, and the greedy cuts at that capacity are the shard bounds. Since the
order is by a hash, a shard is a range of hashes: rows find theirs by comparing with the cuts, without
a join.

The search needs no list of all groups. It starts from the sums of 65,536 hash cells, brackets the
capacity and the places where a cut can fall, and looks only there at finer cells, until single groups
are reached. What comes to the driver is bounded: the cells, and at most FETCH groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

ROW_BYTES = 16
DIGITS = 64
FIRST_DIGITS = 4
MORE_DIGITS = 2
FETCH = 200_000
SLOT_ROWS = 50_000
MOST_SLOT_CELLS = 4096
NO_TEXT = "!"  # before every hexadecimal digit


def group_key(text: str = "text"):
    return F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(NO_TEXT))


def sized(text: str = "text"):
    """UTF-8 bytes of the text plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


class Line:
    """Ordered cells (hash prefix, bytes, groups) as one line of bytes."""

    def __init__(self, cells: list[tuple[str, int, int]]):
        self.cells = cells
        self.ends = [0]
        for _, size, _ in cells:
            self.ends.append(self.ends[-1] + size)

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy filling with whole cells: the end of each shard, or None if they don't suffice."""
        at, out = 0, []
        for _ in range(shards):
            k = bisect_right(self.ends, self.ends[at] + capacity) - 1
            if k == at and k < len(self.cells):
                return None
            at = k
            out.append(at)
            if at == len(self.cells):
                return out
        return None

    def least(self, low: int, shards: int) -> int:
        """Smallest capacity >= low that suffices for whole cells."""
        high = max(low, 1)
        while self.cuts(high, shards) is None:
            high *= 2
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def reach(self, low: int, high: int, shards: int) -> set[int]:
        """Cells in which a cut can fall for some capacity from low to high, whatever is inside them."""
        found: set[int] = set()
        first, last = 0, 0
        for _ in range(shards):
            first = self.ends[max(0, bisect_right(self.ends, first + low) - 1)]
            last = min(last + high, self.ends[-1])
            found.update(range(max(0, bisect_right(self.ends, first) - 1), min(len(self.cells), bisect_right(self.ends, last))))
        return found


def shard_bounds(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Upper hash bounds (inclusive) of all shards but the last, and the capacity. groups: g, size."""
    def cells(digits: int, of: DataFrame) -> list[tuple[str, int, int]]:
        rows = of.groupBy(F.substring("g", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return sorted((r["p"], r["s"], r["n"]) for r in rows)

    line = Line(cells(FIRST_DIGITS, groups))
    total = line.ends[-1]
    if not total:
        return [], 0
    low = max(-(-total // shards), groups.agg(F.max("size")).first()[0])
    digits = FIRST_DIGITS
    while True:
        high = line.least(low, shards)
        reach = line.reach(low, high, shards)
        open_cells = [k for k in reach if len(line.cells[k][0]) < DIGITS and line.cells[k][0] != NO_TEXT]
        if not open_cells:
            break
        whole = sum(line.cells[k][2] for k in open_cells) <= FETCH
        digits = DIGITS if whole else digits + MORE_DIGITS
        prefixes = {line.cells[k][0] for k in open_cells}
        finer: list[tuple[str, int, int]] = []
        for length in sorted({len(p) for p in prefixes}):
            wanted = [p for p in prefixes if len(p) == length]
            finer += cells(digits, groups.where(F.substring("g", 1, length).isin(wanted)))
        line = Line(sorted([c for c in line.cells if c[0] not in prefixes] + finer))
    cuts = line.cuts(high, shards)
    bounds = [line.cells[k - 1][0] for k in cuts if k < len(line.cells)]
    # a bound may be the prefix of a cell that ends there: all hashes with that prefix belong to it
    return [b if b == NO_TEXT else b.ljust(DIGITS, "f") for b in bounds], high


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Adds size, shard (0 .. shards - 1) and slot (gapless from 0 in each shard) to every row; `keep`
    names the columns to carry along (default: all).

    Equal texts share a shard; null texts are one group. With few groups some shards stay empty. Slots
    follow hash cells and then `key`; repeated rows get slots of their own. Columns named size, shard
    or slot are replaced; others pass through. An empty table stays empty."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "shard", "slot")]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(key).alias("k"), group_key(text).alias("g"), sized(text).alias("size"))
    groups = stored(rows.groupBy("g").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    n_rows = groups.agg(F.sum("rows")).first()[0] or 0
    bounds, _ = shard_bounds(groups, shards)
    # how many bounds lie before the hash; plain comparisons, of which the optimiser can infer filters
    shard = sum(((F.col("g") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    n_cells = min(MOST_SLOT_CELLS, max(64, -(-n_rows // (SLOT_ROWS * shards))))
    placed = rows.select("row", "k", "size", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("k"), F.lit(n_cells)).cast("int").alias("cell"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")), "shard-cells")  # at most shards x cells rows
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k", "size"))
    return (placed.withColumn("nth", nth).join(offsets, ["shard", "cell"])
            .select("row.*", "size", "shard", (F.col("before") + F.col("nth") - 1).alias("slot")))


def shard_manifest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where every document goes, under the law `bytes`."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = shard_documents(rows, shards, keep=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
