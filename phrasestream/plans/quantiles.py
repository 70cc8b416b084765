"""Exact linear-interpolation percentiles that survive one very large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LARGE_GROUP = 1_000_000
_ACCURACY = 10_000


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float],
    large_group: int = LARGE_GROUP,
) -> DataFrame:
    """keys + one column per name in `probabilities`.

    Groups up to `large_group` rows use Spark's `percentile`. Larger ones are
    bracketed by a bounded sketch first (`percentile_approx` guarantees its
    rank error), and only the values inside a bracket are ranked exactly.
    """
    values = df.select(*keys, value).filter(F.col(value).isNotNull())
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > large_group)
    names, probs = list(probabilities), list(probabilities.values())
    if large.isEmpty():
        whole = values.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        return whole.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])

    small = (
        values.join(large, keys, "left_anti")
        .groupBy(*keys)
        .agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        .select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    )

    slack = 2.0 / _ACCURACY
    bounds = [b for p in probs for b in (max(0.0, p - slack), min(1.0, p + slack))]
    hot = values.join(large, keys)
    sketch = hot.groupBy(*keys, "_n").agg(
        F.percentile_approx(value, [float(b) for b in bounds], _ACCURACY).alias("_s")
    )
    brackets = sketch.select(
        *keys, "_n",
        F.explode(F.array(*[
            F.struct(
                F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
                F.get("_s", F.lit(2 * i)).alias("lo"), F.get("_s", F.lit(2 * i + 1)).alias("hi"),
            ) for i, p in enumerate(probs)
        ])).alias("_b"),
    ).select(*keys, "_n", "_b.*")
    # Identical values collapse before the shuffle, so a hot value is one row.
    counted = hot.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = counted.join(brackets, keys)
    below = placed.filter(F.col(value) < F.col("lo")).groupBy(*keys, "i").agg(
        F.sum("_c").alias("_below")
    )
    inside = placed.filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    upto = Window.partitionBy(*keys, "i").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        inside.withColumn("_upto", F.sum("_c").over(upto))
        .join(below, [*keys, "i"], "left")
        .withColumn("_end", F.col("_upto") + F.coalesce("_below", F.lit(0)))
        .withColumn("_at", (F.col("_n") - 1) * F.col("p"))
        .withColumn("_lo_rank", F.floor("_at"))
        .withColumn("_hi_rank", F.least(F.col("_lo_rank") + 1, F.col("_n") - 1))
    )
    pick = lambda rank: F.min(F.when(F.col("_end") > F.col(rank), F.col(value)))
    picked = ranked.groupBy(*keys, "i", "_at", "_lo_rank").agg(
        pick("_lo_rank").alias("_a"), pick("_hi_rank").alias("_z")
    ).withColumn("_v", F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_at") - F.col("_lo_rank")))
    big = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)]
    )
    return small.unionByName(big)
