"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target / source size (0 to 3).
Its whole part is taken as it is; the fractions are rounded to 0 or 1 by the pivotal method: two units
meet, and words move from one's expected copies to the other's, in a seeded random direction, until
one of them is integral; the other goes on to the next. The two directions have the probabilities that
leave every document's expected copies unchanged, and the words of the source never change but by the
rounding of the very last unit.

The work is a reduction tree: documents are dealt to leaf blocks of one source, one size class and a
hash chunk; each block rounds all but at most one unit; the left-over units of up to FAN_IN blocks of
a class meet at the next level, until a class has one. The last level, a source's left-over units of
its size classes, goes from the largest to the smallest, each against the pool of all smaller ones, so
that what is rounded last is small. No task sees more than a block.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import broadcast_if_small, stored

MOST_COPIES = 3.0
BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20
FAN_IN = 1024
CLASSES_PER_DOUBLING = 4
SEED = 11


def n_words(text: str = "text") -> Column:
    """Number of maximal runs of characters other than space and \\t \\n \\v \\f \\r; 0 for null."""
    separators = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(separators, " ", -1), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> weight and target. Sources in code point order, null last, weigh 1, 2, 3,
    repeating. A target is the source's share of all sizes, but no more than MOST_COPIES times its own
    size; the excess is shared again by weight. That is filling to a common level: the sources are
    capped in order of MOST_COPIES * size / weight for as long as the level of the rest exceeds it.
    One row per source, so the windows over it are small."""
    every = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", ((F.row_number().over(every) - 1) % 3 + 1).cast("double"))
    cap = F.lit(MOST_COPIES) * F.col("source_size")
    filling = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = ((F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    levelled = ranked.withColumn("_nth", F.row_number().over(filling)).withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("weight") > cap)
    # the first source that is not capped fixes the level of all that follow
    free = F.min(F.when(~F.col("_capped"), F.struct(F.col("_nth"), F.col("_level").alias("at")))).over(all_rows)
    return (levelled.withColumn("_free", free["at"])
            .withColumn("target", F.when(F.col("_capped") | F.col("_free").isNull(), cap).otherwise(F.col("_free") * F.col("weight")).cast("double"))
            .select(*sizes.columns, "weight", "target"))


def _draw(a: int, b: int) -> float:
    """Uniform in [0, 1) from two unit hashes."""
    full = (1 << 64) - 1
    x = ((a & full) * 0x9E3779B97F4A7C15 + (b & full) * 0xD6E8FEB86659FD93 + SEED) & full
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def _settled(p: float) -> float:
    return float(round(p)) if abs(p - round(p)) < 1e-9 else p


def round_pairwise(mass: list[float], words: list[float], unit: list[int]) -> None:
    """Rounds in place all but at most one unit."""
    held = -1
    for i in range(len(mass)):
        if not 0.0 < mass[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        up = min((1 - mass[held]) * words[held], mass[i] * words[i])
        down = min(mass[held] * words[held], (1 - mass[i]) * words[i])
        move = up if _draw(unit[held], unit[i]) * (up + down) < down else -down
        mass[held] = _settled(mass[held] + move / words[held])
        mass[i] = _settled(mass[i] - move / words[i])
        if not 0.0 < mass[held] < 1.0:
            held = i if 0.0 < mass[i] < 1.0 else -1


def round_pool(mass: list[float], words: list[float], unit: list[int]) -> None:
    """Rounds all units in place, largest first, each against the pool of the smaller ones: the pool's
    units move together, in proportion to their distance from the nearest integer."""
    for k, a in enumerate(sorted(range(len(mass)), key=lambda i: (-words[i], unit[i]))):
        rest = sorted(range(len(mass)), key=lambda i: (-words[i], unit[i]))[k + 1:]
        turn = 0
        while 0.0 < mass[a] < 1.0:
            pool = [j for j in rest if 0.0 < mass[j] < 1.0]
            turn += 1
            if not pool:
                mass[a] = float(_draw(unit[a], turn) < mass[a])
                break
            give = sum(min(mass[j], 1 - mass[j]) * words[j] for j in pool)
            up, down = min((1 - mass[a]) * words[a], give), min(mass[a] * words[a], give)
            move = up if _draw(unit[a], unit[pool[0]] + turn) * (up + down) < down else -down
            mass[a] = _settled(mass[a] + move / words[a])
            for j in pool:
                mass[j] = _settled(mass[j] - min(mass[j], 1 - mass[j]) * move / give)


def _round_block(order: list[str], leaf: bool = False, last: bool = False):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        mass, unit = rows["mass"].to_pylist(), rows["unit"].to_pylist()
        words = [max(1.0, float(w)) for w in rows["words"].to_pylist()]
        if last:
            round_pool(mass, words, unit)
        else:
            round_pairwise(mass, words, unit)
        rows = rows.set_column(rows.column_names.index("mass"), "mass", pa.array(mass, pa.float64()))
        rows = rows.append_column("left", pa.array([0.0 < m < 1.0 for m in mass]))
        return rows.append_column("at", pa.array(range(len(mass)), pa.int32())) if leaf else rows

    return run


def mix_documents(docs: DataFrame, size: Column | None = None, source: str = "source") -> DataFrame:
    """Adds size, source_size, target and copies to every row (copies may be 0). A null source is a
    source of its own; documents of size 0 get no copies if their whole source is empty, else they are
    rounded like others. Repeated rows are separate units; reruns agree. Columns of these names are
    replaced, others pass through; an empty table stays empty."""
    work = ["size", "source_size", "target", "copies"]
    kept = docs.drop(*work)
    words = (n_words() if size is None else size).cast("long")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in kept.columns else F.lit(64)
    rows = kept.select(F.struct(*kept.columns).alias("row"), F.col(source).alias("source"), words.alias("words"), weight.alias("bytes"), F.xxhash64(F.lit(SEED), *kept.columns).alias("unit"))
    rows = rows.withColumn("class", F.floor(F.log2(F.col("words") + 1.0) * CLASSES_PER_DOUBLING).cast("int"))
    classes = stored(rows.groupBy("source", "class").agg(F.sum("words").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("s").alias("source_size")))
    chunks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("b") / BLOCK_BYTES), F.lit(1)).cast("int")
    plan = (classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
            .select(F.col("c.source").alias("s"), F.col("class").alias("k"), chunks.alias("chunks"), "source_size", "target"))
    plan = broadcast_if_small(plan, classes.count())  # one row per source and size class
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))).drop("s", "k", "bytes")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST_COPIES))).otherwise(F.lit(0.0))
    leaf = (placed.withColumn("chunk", F.pmod(F.col("unit"), F.col("chunks")).cast("int")).drop("chunks")
            .withColumn("whole", F.floor(share + 1e-12)).withColumn("mass", F.greatest(share - F.col("whole"), F.lit(0.0))))
    schema = T.StructType([*leaf.schema.fields, T.StructField("left", T.BooleanType()), T.StructField("at", T.IntegerType())])
    rounded = stored(leaf.groupBy("source", "class", "chunk").applyInArrow(_round_block(["words", "unit"], leaf=True), schema), "mix-leaves")
    tops = _reduce(rounded.where("left").select("source", "class", "chunk", "at", "unit", "mass", "words"))
    place = [F.col("source").eqNullSafe(F.col("s")), F.col("class") == F.col("k"), F.col("chunk") == F.col("h"), F.col("at") == F.col("a"), F.col("left")]
    copies = (F.col("whole") + F.when(F.col("left"), F.coalesce("top", F.lit(0))).otherwise(F.col("mass"))).cast("long")
    tops = tops.select(F.col("source").alias("s"), F.col("class").alias("k"), F.col("chunk").alias("h"), F.col("at").alias("a"), "top")
    tops = broadcast_if_small(tops, tops.count())  # one row per block at most
    return (rounded.join(tops, place, "left")
            .select("row.*", F.col("words").alias("size"), "source_size", "target", copies.alias("copies")))


def _reduce(units: DataFrame) -> DataFrame:
    """The upper levels: units left over by the leaf blocks meet in groups of FAN_IN chunks of a class
    until a class has one group, then by source. Returns source, class, chunk, at, top (0 or 1)."""
    units = stored(units.withColumn("node", F.col("chunk").cast("long")), "mix-units")
    decided: list[DataFrame] = []
    columns = units.columns
    schema = T.StructType([*units.schema.fields, T.StructField("left", T.BooleanType())])
    last = False
    while not last:
        last = not units.agg(F.max("node").alias("n")).first()["n"]
        if not last:
            units = units.withColumn("node", F.floor(F.col("node") / FAN_IN))
        groups = ["source"] if last else ["source", "class", "node"]
        done = stored(units.groupBy(*groups).applyInArrow(_round_block(["class", "words", "unit"], last=last), schema), "mix-level")
        decided.append(done.where(~F.col("left")))
        units = done.where("left").select(*columns)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("source", "class", "chunk", "at", F.col("mass").cast("int").alias("top"))


def mixed_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document)."""
    slim = docs.select("doc_id", "source", n_words().alias("n"))
    return mix_documents(slim, F.col("n")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it."""
    out = mix_documents(docs.select(F.struct(*docs.columns).alias("doc"), "source", "text"))
    return out.where(F.col("copies") > 0).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
