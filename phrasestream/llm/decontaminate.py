"""Benchmark decontamination with SimHash windows.

A window has as many words as a benchmark item and gets the item's kind of fingerprint: a
64-bit SimHash of its weighted word shingles. Fingerprints are cut into radius + 1 blocks;
two within the radius agree in some block whole, so an equi-join on (item, block, value)
finds all of them. What is found is verified by the exact weighted Jaccard similarity of the
shingles, a shingle weighing more the fewer benchmark items have it.

A window that reaches the similarity asked for must share shingles with the item, so windows
are opened only where a shingle of an item stands in the text, at each offset that lines
the two shingles up; this filter loses nothing that the verification would keep. All of it
is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import staged

SHINGLE = 5
LEAST = 0.8
#: Similarity 0.8 is a cosine of 0.89, so 10 of 64 bits differ on average, with a standard
#: deviation of 3; 20 is more than three of those above.
RADIUS = 20
#: Item shingles that may be sent to all tasks; with more of them the join shuffles.
BROADCAST_ROWS = 1_000_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of each `size` words in a row; of all words if there are fewer, none if none."""
    def of(ws: Column) -> Column:
        n = F.size(ws)
        return F.when(n >= size, F.transform(
            F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, size)))).when(
            n > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))

    # Bound as a lambda's variable, the words are made once for a row, not for each place.
    return F.element_at(F.transform(F.array(words), of), 1)


def simhash(bag: str) -> Column:
    """64 bits: the sign of the weighted sum of each bit of the shingles' hashes. `bag`:
    name of a column of structs h, w, n."""
    return F.expr(f"""
        aggregate(transform(sequence(0, 63), j -> IF(
            aggregate({bag}, 0D, (acc, x) -> acc + IF((shiftright(x.h, j) & 1L) = 1L, x.w, -x.w) * x.n) > 0,
            shiftleft(1L, j), 0L)), 0L, (p, q) -> p | q)""")


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """(block, value) of radius + 1 blocks of bits that cover the fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
                     for i, (a, b) in enumerate(zip(cuts, cuts[1:]))))


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, size, hashes, fp, weights) and the weight of each item shingle."""
    read = W.text_frame(benchmark, "item_id", "text").withColumn("words", word_list(F.col("text")))
    read = read.withColumn("hashes", shingles(F.col("words"))).withColumn("size", F.size("words"))
    read = read.filter("size > 0 and item_id is not null").select("item_id", "size", "hashes")
    total = float(max(read.count(), 1))
    weights = read.select("item_id", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("df")).select("h", F.log1p(F.lit(total) / F.col("df")).alias("w"))
    return read, weights


def _weigh(rows: DataFrame, key: list[str], weights: DataFrame, heaviest: Column) -> DataFrame:
    """Rows of (key, hashes) with `bag`: structs h, w, n, one for each distinct shingle."""
    one = rows.select(*key, F.explode("hashes").alias("h")).groupBy(*key, "h").agg(F.count(F.lit(1)).alias("n"))
    return one.join(weights, "h", "left").groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("h", F.coalesce("w", heaviest).alias("w"), "n"))).alias("bag"))


def matching_windows(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, tid (hash of the text), item_id, at (first word of the window), words, hamming
    and similarity of each window that was verified."""
    items, weights = items_of(benchmark)
    items, weights = staged(items, "bench-items"), staged(weights, "bench-weights")
    index = items.select("item_id", F.col("size").alias("item_size"), F.posexplode("hashes").alias("ipos", "h"))
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    rows = W.text_frame(docs, "doc_id", "text").filter("text is not null").withColumn("tid", F.xxhash64("text"))
    hashes = rows.withColumn("hashes", shingles(word_list(F.col("text")))).select("doc_id", "tid", "hashes")
    hits = hashes.select("doc_id", "tid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h")).join(index, "h")
    # The window an aligned pair opens, kept inside the text.
    last = F.greatest(F.lit(0), F.col("n") + SHINGLE - 1 - F.col("item_size"))
    opened = hits.select("doc_id", "tid", "item_id", "item_size", F.least(F.greatest(F.col("pos") - F.col("ipos"), F.lit(0)), last).alias("at")).distinct()
    opened = staged(opened, "bench-windows")
    places = opened.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("item_id", "item_size", "at")).alias("places"))
    a, b = rows.alias("a"), places.alias("b")
    met = a.join(b, F.expr("a.tid = b.tid and a.doc_id <=> b.doc_id")).select(
        "a.doc_id", "a.tid", word_list(F.col("a.text")).alias("words"), "places").dropDuplicates(["doc_id", "tid"])
    windows = met.select("doc_id", "tid", "words", F.explode("places").alias("p")).select(
        "doc_id", "tid", "p.item_id", "p.item_size", "p.at",
        shingles(F.slice("words", F.col("p.at") + 1, F.col("p.item_size"))).alias("hashes"))
    heaviest = F.log1p(F.lit(float(max(items.count(), 1))))
    key = ["doc_id", "tid", "item_id", "item_size", "at"]
    windows = _weigh(windows, key, weights, heaviest)
    wanted = _weigh(items.select("item_id", "hashes"), ["item_id"], weights, heaviest)
    wanted = staged(wanted.select("item_id", simhash("bag").alias("item_fp"), F.col("bag").alias("item_bag")), "bench-prints")
    printed = staged(windows.withColumn("fp", simhash("bag")), "bench-printed")
    left = printed.select(*key, "fp", F.inline(blocks(F.col("fp"), radius)))
    right = wanted.select("item_id", "item_fp", F.inline(blocks(F.col("item_fp"), radius)))
    within = left.join(right, ["item_id", "block", "value"]).withColumn(
        "hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("hamming") <= radius)
    within = within.groupBy(*key).agg(F.min("hamming").alias("hamming"))
    cond = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key]
    pairs = within.alias("x").join(printed.alias("y"), cond).select("x.*", "y.bag").join(wanted, "item_id")
    both = F.map_from_entries(F.transform("item_bag", lambda x: F.struct(x["h"], x["n"])))
    n = lambda bag: F.aggregate(bag, F.lit(0.0), lambda acc, x: acc + x["w"] * x["n"])
    pairs = pairs.withColumn("counts", both)
    common = F.aggregate("bag", F.lit(0.0), lambda acc, x: acc + x["w"] * F.least(x["n"], F.coalesce(F.try_element_at(F.col("counts"), x["h"]), F.lit(0))))
    pairs = pairs.withColumn("common", common).withColumn(
        "similarity", F.col("common") / (n(F.col("bag")) + n(F.col("item_bag")) - F.col("common")))
    return pairs.filter(F.col("similarity") >= least).select(
        "doc_id", "tid", "item_id", "at", F.col("item_size").alias("words"), "hamming", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, at, words, hamming, similarity: for each document and item the most
    similar window (the first of equal ones) of `least` or more.

    Windows are of whole texts; a text shorter than an item is one window. Null or empty
    texts and items match nothing; null ids are kept as they are. Rows of equal id and
    text are one. Of `docs` only doc_id and text are read, of `benchmark` item_id and text.
    """
    found = matching_windows(docs, benchmark, least, radius)
    best = found.groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("at", "words", "hamming", "similarity"), F.struct("similarity", -F.col("at"))).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of `docs` whose text has no benchmark passage; all columns stay."""
    found = matching_windows(docs, benchmark, least).select("doc_id", "tid").distinct()
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["tid"])
    return docs.join(found, same, "left_anti")
