"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the line of words,
repeated as often as the source may be repeated, is cut into blocks of equally many
words. Slot i of the mix takes the source in whose share of the cumulative target weights
the i-th van der Corput point falls, and the k-th slot of a source takes its k-th block,
so at every length the mix is as near its weights as a schedule can be. A source's last
block ends at its target. The few blocks that a schedule of just the needed length leaves
out (the discrepancy of the points, a few for each source) stand behind it.

Running totals go by levels (source, group of buckets, bucket), so a source with a third
of all rows is no window of its own. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import staged

BLOCK = 1_024
BUCKET_WORDS = 1 << 16
LEVEL = 1 << 10
CELLS = 4_096
BITS = 45


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
                   repeats: int = 2) -> DataFrame:
    """source, source_size, target, weight and no (place by code point, null last).

    The sources share `share` times all sizes by weight. A source takes at most `repeats`
    times its size; what is above goes to the others by weight until none is above: with
    r = cap / weight in rising order, the capped sources are the first ones, and the others
    get weight times the level that is left. There is one row for each source name here.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    named = one.withColumn("no", F.row_number().over(by_name) - 1).withColumn("weight", w)
    named = named.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "no")
    whole = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source whose cap is not below the level of those from it on sets the level.
    levels = named.withColumn("level", level).withColumn("open", F.col("ratio") >= F.col("level"))
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    return levels.withColumn("final", final).select(
        "source", "source_size", "weight", "no",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.col("weight") * F.col("final"))).alias("target"))


def _running(rows: DataFrame, key: str, bucket: str, value: str, out: str) -> DataFrame:
    """`out`: the sum of `value` over the smaller buckets of the same key, for each bucket."""
    one = rows.groupBy(key, bucket).agg(F.sum(value).alias("_v")).withColumn("_g", F.floor(F.col(bucket) / LEVEL))
    groups = one.groupBy(key, "_g").agg(F.sum("_v").alias("_t"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_t0", F.coalesce(F.sum("_t").over(before(Window.partitionBy(key).orderBy("_g"))), F.lit(0)))
    inner = F.coalesce(F.sum("_v").over(before(Window.partitionBy(key, "_g").orderBy(bucket))), F.lit(0))
    return one.withColumn("_v0", inner).join(groups, [key, "_g"]).select(key, bucket, (F.col("_t0") + F.col("_v0")).alias(out))


def corput(i: Column) -> Column:
    """The i-th van der Corput point: the binary digits of i mirrored at the point."""
    return F.conv(F.reverse(F.lpad(F.bin(i), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, no (of the source), k (its block) and words taken, for `targets` with no and
    target_words. Needs one number on the driver: how many slots there are."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("target_words")).first()[0] or 0
    n = -(-total // block)
    up = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    shares = targets.filter("target_words > 0").select(
        "no", "target_words", F.ceil(F.col("target_words") / block).alias("blocks"),
        (F.sum("target_words").over(up) / float(max(total, 1))).alias("hi"))
    shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("no")), F.lit(0.0)))
    cell = lambda x: F.floor(x * CELLS).cast("int")
    # A source stands in each cell of a fixed grid that its share touches: an equi-join
    # on the cell finds the share a point falls in.
    cells = shares.select("no", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), corput(F.col("id")).alias("x")).withColumn("cell", cell(F.col("x")))
    slots = slots.join(cells, "cell").filter("x >= lo and x < hi").select("slot", "no", F.floor(F.col("slot") / 4096).alias("chunk"))
    starts = _running(slots.withColumn("_one", F.lit(1)), "no", "chunk", "_one", "k0")
    ranked = slots.withColumn("_r", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(starts, ["no", "chunk"]).select("slot", "no", (F.col("k0") + F.col("_r")).alias("k"))
    made = ranked.groupBy("no").agg(F.count(F.lit(1)).alias("made"))
    left = shares.join(made, "no", "left").withColumn("made", F.coalesce("made", F.lit(0)))
    left = left.filter("made < blocks").select("no", F.explode(F.sequence(F.col("made"), F.col("blocks") - 1)).alias("k"))
    rest = left.select((F.lit(n) + F.col("k") * 65_536 + F.col("no")).alias("slot"), "no", "k")
    size = F.least(F.lit(block), F.col("target_words") - F.col("k") * block)
    return ranked.unionByName(rest).join(shares.select("no", "blocks", "target_words"), "no").filter("k < blocks").select(
        "slot", "no", "k", size.cast("long").alias("words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, repeats: int = 2,
        block: int = BLOCK, pieces: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words the mix takes of each
    row, repeats counted. With `pieces`: slot, doc_id, source, first and last word (end
    exclusive) of each piece in the order of the mix.

    Sizes are words; a null text has none. Null sources are one source, ids may be null or
    repeated: each row counts by itself. A source takes its target rounded to words (as far
    as it has words), no row more than `repeats` times its size, and reruns agree. `docs`
    may have any further columns; only doc_id, source and text are read.
    """
    rows = W.text_frame(docs, "doc_id", "source", "text").select(
        "doc_id", "source", W.word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    sized = staged(rows, "mix-sizes")
    targets = staged(source_targets(sized, weights, share, repeats).withColumn(
        "target_words", F.round("target").cast("long")), "mix-targets")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BUCKET_WORDS))
    placed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        sized["doc_id"], sized["source"], "size", "h", "source_size", "target", "no",
        F.pmod(F.xxhash64("h"), buckets).alias("bucket"))
    starts = _running(placed, "no", "bucket", "size", "start0")
    inside = Window.partitionBy("no", "bucket").orderBy("h", "doc_id", "size")
    placed = placed.withColumn("rn", F.row_number().over(inside)).withColumn(
        "inner", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(starts, ["no", "bucket"]).withColumn("start", F.col("start0") + F.col("inner"))
    lines = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "at", F.col("start") + F.col("turn") * F.col("source_size"))
    spans = lines.withColumn("k", F.explode(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))))
    slots = schedule(targets, block)
    joined = spans.join(slots, ["no", "k"], "inner" if pieces else "left")
    lo = F.greatest(F.col("at"), F.col("k") * block)
    hi = F.least(F.col("at") + F.col("size"), F.col("k") * block + F.col("words"))
    if pieces:
        return joined.filter(lo < hi).select("slot", "doc_id", "source", (lo - F.col("at")).alias("first"), (hi - F.col("at")).alias("last"))
    # Blocks that no slot takes have no words (least() would pass over the null).
    taken = F.sum(F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), hi - lo)).otherwise(0))
    return joined.groupBy("no", "bucket", "rn", "doc_id", "source", "size", "source_size", "target").agg(
        taken.cast("long").alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")
