"""Ordered, per-key calculations that survive one very large key.

A window partitioned by session alone puts a whole session in one task. Here a
key with more than `target_rows` rows is cut into pieces along its order
column; each piece is an ordinary window partition, and what has to flow from
one piece to the next (a running total, the last few rows) is a small table
with one row per piece. Keys below the limit form one piece. The rows of each
key are counted when the plan is built; where no key is above the limit, the
plan has no branch for cut keys at all.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TARGET_ROWS = 200_000
# A key is cut along its own distribution of the order column, known at so many quantiles
# (at least and at most; otherwise as many as there are pieces) and taken as even between
# two of them.
QUANTILES, MOST_QUANTILES = 64, 4096
# The tables of cut keys are broadcast up to so many quantile values, else joined.
BROADCAST_VALUES = 1_000_000
PIECE, PIECES, SHARE = "_piece", "_pieces", "_share"


@dataclass(frozen=True)
class Cut:
    """Rows with `_piece`, `_pieces` and `_share` (position inside the piece).

    `rows` has every key, `large` only the keys that were cut; without `any` there are none.
    """

    rows: DataFrame
    large: DataFrame
    keys: list[str]
    target_rows: int
    any: bool
    # Whether rows already lie by keys and piece, as `neighbours` leaves them.
    laid_out: bool = False

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Cut:
        large = change(self.large) if self.any else change(self.rows).filter(F.lit(False))
        return replace(self, rows=change(self.rows), large=large)

    @property
    def place(self) -> list[str]:
        return [*self.keys, PIECE]

    def plain(self) -> DataFrame:
        return self.rows.drop(PIECE, PIECES, SHARE)


def cut_large_keys(df: DataFrame, keys: list[str], order: str, target_rows: int = TARGET_ROWS) -> Cut:
    kind = df.schema[order].dataType.typeName()
    at = F.col(order).cast("timestamp" if kind.startswith("timestamp") else "double").cast("double")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    many = counts.filter((F.col("_n") > target_rows) & (F.col("_hi") > F.col("_lo"))).select(
        *keys, F.ceil(F.col("_n") / target_rows).cast("int").alias(PIECES))
    found = many.agg(F.count(F.lit(1)).alias("keys"), F.max(PIECES).alias("pieces")).first()
    if not found["keys"]:
        rows = df.withColumns({PIECE: F.lit(0), SHARE: F.lit(0.0), PIECES: F.lit(1)})
        return Cut(rows, rows.filter(F.lit(False)), keys, target_rows, False)
    quantiles = min(max(QUANTILES, 1 << (found["pieces"] - 1).bit_length()), MOST_QUANTILES)
    few = found["keys"] * quantiles <= BROADCAST_VALUES
    near = F.broadcast if few else lambda table: table
    grid = F.percentile_approx(at, [i / quantiles for i in range(quantiles + 1)], F.lit(10_000))
    large = df.join(near(many), keys).groupBy(*keys).agg(
        grid.alias("_grid"), F.first(PIECES).alias(PIECES), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    # The sketch may miss the ends.
    ends = lambda g: F.concat(F.array("_lo"), F.slice(g, 2, quantiles - 1), F.array("_hi"))
    large = large.withColumn("_grid", ends(F.col("_grid"))).drop("_lo", "_hi")
    # The last quantile that is not above a row, by halving; then the way to the next.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((quantiles - 1).bit_length()))])
    cell = F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(
        (i + s < quantiles) & (F.get("_grid", i + s) <= at), s).otherwise(0))
    low, high = F.get("_grid", F.col("_cell")), F.get("_grid", F.col("_cell") + 1)
    way = F.when(high > low, F.least(F.lit(1.0), (at - low) / (high - low))).otherwise(0.0)
    spot = (F.col("_cell") + way) / quantiles * F.col(PIECES)
    piece = F.least(F.floor(spot), F.col(PIECES) - 1).cast("int")

    def mark(how: str) -> DataFrame:
        return (
            df.join(near(large), keys, how)
            .withColumn("_cell", F.when(F.col(PIECES).isNotNull(), cell))
            .withColumn(PIECE, F.coalesce(piece, F.lit(0)))
            .withColumn(SHARE, F.coalesce(spot - F.col(PIECE), F.lit(0.0)))
            .withColumn(PIECES, F.coalesce(PIECES, F.lit(1)))
            .drop("_grid", "_cell")
        )

    return Cut(mark("left"), mark("inner"), keys, target_rows, True)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Running aggregates per key in `order`: kind is sum, count, max, min,
    first or last (the last two skip nulls). `inclusive` counts the row itself.
    """
    cut = cut_large_keys(df, keys, order[0], target_rows)
    place = cut.place
    upto = Window.partitionBy(*place).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    local, totals, carries, results = {}, [], {}, {}
    for name, (kind, value) in outputs.items():
        mine, theirs = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "count":
            kind, value = "sum", F.when(value.isNotNull(), 1).otherwise(0).cast("bigint")
            results[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))
        elif kind == "sum":
            results[name] = F.coalesce(mine + theirs, mine, theirs)
        elif kind in ("max", "min"):
            results[name] = (F.greatest if kind == "max" else F.least)(mine, theirs)
        else:
            results[name] = F.coalesce(*([theirs, mine] if kind == "first" else [mine, theirs]))
        if kind in ("sum", "max", "min"):
            fn = getattr(F, kind)
            local[f"_l_{name}"] = fn(value).over(upto)
            totals.append(fn(value).alias(f"_c_{name}"))
            carries[f"_c_{name}"] = fn(f"_c_{name}").over(before)
        else:
            pick = F.first if kind == "first" else F.last
            extreme = F.min if kind == "first" else F.max
            at = F.struct(F.struct(*order).alias("p"), value.alias("v"))
            local[f"_l_{name}"] = pick(value, ignorenulls=True).over(upto)
            totals.append(
                extreme(F.when(value.isNotNull(), at)).getField("v").alias(f"_c_{name}")
            )
            carries[f"_c_{name}"] = pick(f"_c_{name}", ignorenulls=True).over(before)
    carried = cut.large.groupBy(*place).agg(*totals).withColumns(carries)
    # The explicit repartition keeps a layout by key alone from being reused.
    joined = cut.rows.repartition(*place).withColumns(local).join(carried, place, "left")
    return joined.withColumns(results).drop(
        PIECE, PIECES, SHARE, *[f"_l_{n}" for n in outputs], *[f"_c_{n}" for n in outputs]
    )


def neighbours(
    cut: Cut,
    order: list[str],
    outputs: Mapping[str, Callable[[WindowSpec], Column]],
    count: int,
    following: bool = False,
    before_windows: Callable[[DataFrame], DataFrame] = lambda df: df,
    drop: tuple[str, ...] = (),
) -> Cut:
    """Window expressions that look at most `count` rows back (or ahead).

    `outputs` maps a new column to a function of the window specification;
    later ones may use earlier ones, as long as all of them together look no
    further than `count` rows. Rows are shuffled once.
    Each piece of a cut key is given a copy of the `count` rows before it.
    `before_windows` adds row-local columns once the copies are in place, so
    that they need not be carried.
    """
    def windows(df: DataFrame, place: list[str]) -> DataFrame:
        # Rows are sorted before columns are added to them; the windows keep that order.
        out = before_windows(df.repartition(*place).sortWithinPartitions(*place, *order))
        spec = Window.partitionBy(*place).orderBy(*order)
        for name, make in outputs.items():
            out = out.withColumn(name, make(spec))
        return out

    if not cut.any:
        return replace(cut.map(lambda df: windows(df, cut.keys).drop(*drop)), laid_out=True)
    place, columns = cut.place, cut.large.columns
    towards = [F.col(c).asc() if following else F.col(c).desc() for c in order]
    edge = (
        cut.large.repartition(*place)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*place).orderBy(*towards)))
        .filter(F.col("_rank") <= count)
        .groupBy(*place)
        .agg(F.collect_list(F.struct(
            *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row")
        )).alias("_edge"))
    )
    span = Window.partitionBy(*cut.keys).orderBy(
        F.col(PIECE).desc() if following else F.col(PIECE)
    ).rowsBetween(-count, -1)
    near = F.slice(F.sort_array(F.flatten(F.collect_list("_edge").over(span)), asc=following), 1, count)
    copies = (
        edge.withColumn("_near", near)
        .select(F.col(PIECE).alias("_into"), F.explode("_near").alias("_n"))
        .select("_into", "_n.row.*")
        .withColumn(PIECE, F.col("_into"))
        .drop("_into")
        .withColumn("_copy", F.lit(True))
    )

    def look(df: DataFrame) -> DataFrame:
        together = df.withColumn("_copy", F.lit(False)).unionByName(copies)
        # An explicit layout: one by key alone, left by an earlier step, would
        # put a cut key back into one task.
        return windows(together, place).filter(~F.col("_copy")).drop("_copy", *drop)

    return replace(cut.map(look), laid_out=True)


def with_neighbours(
    df: DataFrame, keys: list[str], order: list[str],
    outputs: Mapping[str, Callable[[WindowSpec], Column]], count: int,
    following: bool = False, target_rows: int = TARGET_ROWS,
    before_windows: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    cut = cut_large_keys(df, keys, order[0], target_rows)
    return neighbours(cut, order, outputs, count, following, before_windows).plain()
