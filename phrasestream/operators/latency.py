"""Latency traces: clock anchor, first marks, per-chunk traces, percentiles."""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasestream.fixed_values import SAMPLE_CAP, SLO_SECONDS, STAGES
from phrasestream.plans.fold import Machine, ordered_fold
from phrasestream.plans.ordered import PIECE, PIECES, SHARE, TARGET_ROWS, cut_large_keys
from phrasestream.plans.stage import staged

CHUNK = ["session_id", "chunk_id", "language"]
PARTS = {
    "chunker": ("audio_end_wall", "committed"),
    "translate": ("committed", "translated"),
    "tts": ("translated", "tts_first_audio"),
    "publish": ("tts_first_audio", "published"),
}


def clock_epochs(frames: DataFrame) -> DataFrame:
    """T5: offset from audio to wall time, set by a session's first frame."""
    first = F.min(F.struct("seq", (F.col("t_wall") - F.col("t_audio")).alias("epoch")))
    return frames.groupBy("session_id").agg(first.getField("epoch").alias("epoch"))


def anchor_clock(rows: DataFrame, frames: DataFrame, t_audio: str = "t_audio_end") -> DataFrame:
    """T5: wall time of an audio position; null and flagged before an anchor."""
    joined = rows.join(clock_epochs(frames), "session_id", "left")
    return joined.withColumn("wall", F.col("epoch") + F.col(t_audio)).withColumn(
        "anchored", F.col("epoch").isNotNull()
    )


def first_marks_wide(
    marks: DataFrame, attach: Callable[[DataFrame], DataFrame] = lambda wide: wide
) -> DataFrame:
    """One row per opened chunk with the first (seq, t_wall) of each stage.

    A chunk opens at its first commit and closes at the first publication
    after that. One pre-aggregated pass finds the first mark of every stage and
    is written once; only where a chunk has a mark from before it was opened
    (normally none) are the marks read again, for such chunks. A flood of
    retries shrinks on the map side. `attach` adds columns before the writing.
    """
    def firsts(rows: DataFrame) -> DataFrame:
        mark = F.struct("seq", "t_wall")
        return rows.groupBy(*CHUNK).agg(
            *[F.min(F.when(F.col("stage") == s, mark)).alias(s) for s in STAGES]
        )

    summary = staged(attach(firsts(marks).filter(F.col("committed").isNotNull())), "first-marks")
    opened = F.col("committed.seq")
    others = [F.coalesce(F.col(f"{s}.seq") < opened, F.lit(False)) for s in STAGES[1:]]
    early = others[0] | others[1] | others[2]
    if not summary.filter(early).isEmpty():
        from_opened = (
            marks.join(summary.filter(early).select(*CHUNK, opened.alias("opened")).distinct(), CHUNK)
            .filter(F.col("seq") >= F.col("opened"))
        )
        summary = summary.filter(~early).unionByName(attach(firsts(from_opened)))
    closed = F.col("published.seq")
    inside = lambda s: F.when(closed.isNull() | (F.col(f"{s}.seq") <= closed), F.col(s))
    return summary.withColumns({s: inside(s) for s in STAGES})


def stage_first_marks(marks: DataFrame) -> DataFrame:
    """The first mark of each stage of a chunk, by arrival; marks from
    before a chunk opens or after it closes are ignored."""
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("m")) for s in STAGES])
    return (
        first_marks_wide(marks).select(*CHUNK, F.explode(each).alias("e"))
        .filter("e.m is not null").select(*CHUNK, "e.stage", "e.m.seq", "e.m.t_wall")
    )


def dropped_marks(marks: DataFrame) -> DataFrame:
    """Marks that came before a chunk was opened or after it was closed."""
    bounds = first_marks_wide(marks).select(
        *CHUNK, F.col("committed.seq").alias("opened"), F.col("published.seq").alias("closed")
    )
    outside = (
        F.col("opened").isNull() | (F.col("seq") < F.col("opened")) | (F.col("seq") > F.col("closed"))
    )
    return marks.join(bounds, CHUNK, "left").groupBy(*CHUNK).agg(
        F.count(F.lit(1)).alias("marks"), F.count_if(outside).alias("dropped")
    )


def assemble_traces(marks: DataFrame, chunks: DataFrame, slo: float = SLO_SECONDS) -> DataFrame:
    """T4: one row per opened chunk and language.

    `chunks` gives session_id, chunk_id, language and audio_end_wall.
    """
    # A chunk whose end is not known yet keeps its marks, without latencies.
    wide = first_marks_wide(marks, lambda wide: wide.join(chunks.select(*CHUNK, "audio_end_wall"), CHUNK, "left"))
    return trace_columns(wide.select(
        *CHUNK, "audio_end_wall", *[F.col(f"{s}.t_wall").alias(s) for s in STAGES],
        F.col("published.seq").alias("published_seq"),
    ), slo)


def trace_columns(wide: DataFrame, slo: float = SLO_SECONDS) -> DataFrame:
    g2g = F.col("published") - F.col("audio_end_wall")
    return wide.select(
        *CHUNK, "audio_end_wall", *STAGES, "published_seq",
        g2g.alias("glass_to_glass_s"),
        *[(F.col(b) - F.col(a)).alias(f"stage_{name}_s") for name, (a, b) in PARTS.items()],
        F.coalesce(g2g > slo, F.lit(False)).alias("slo_breach"),
        F.col("published").isNotNull().alias("finished"),
    )


def latest_samples(
    traces: DataFrame, cap: int = SAMPLE_CAP, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """The newest `cap` published traces of each session and language."""
    keys = ["session_id", "language"]
    cut = cut_large_keys(traces.filter("finished"), keys, "published_seq", target_rows)
    newest_first = Window.partitionBy(*cut.place).orderBy(
        F.col("published_seq").desc(), F.col("chunk_id").desc()
    )
    later = Window.partitionBy(*keys).orderBy(F.col(PIECE).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A piece of a large group gives way to the rows in later pieces.
    ahead = cut.large.groupBy(*cut.place).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_ahead", F.coalesce(F.sum("_n").over(later), F.lit(0))
    ).drop("_n")
    ranked = cut.rows.repartition(*cut.place).withColumn("_rank", F.row_number().over(newest_first))
    kept = ranked.join(ahead, cut.place, "left").filter(
        F.col("_rank") + F.coalesce("_ahead", F.lit(0)) <= cap
    )
    return kept.drop("_rank", "_ahead", PIECE, PIECES, SHARE)


def latency_stats(traces: DataFrame, slo: float = SLO_SECONDS, cap: int | None = None) -> DataFrame:
    """A1: exact percentiles over all samples, or the newest `cap` of each group."""
    three = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    samples = traces.filter("finished") if cap is None else latest_samples(traces, cap)
    grouped = samples.groupBy("session_id", "language").agg(
        F.count(F.lit(1)).alias("count"),
        F.percentile("glass_to_glass_s", three).alias("q"),
        F.max("glass_to_glass_s").alias("worst_s"),
        *[F.avg(f"stage_{name}_s").alias(f"mean_{name}_s") for name in PARTS],
    )
    return grouped.select(
        "session_id", "language", "count",
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p50_s", "p95_s", "p99_s"))],
        "worst_s", (F.get("q", F.lit(1)) > slo).alias("breached"),
        *[f"mean_{name}_s" for name in PARTS],
    )


def session_latency_summary(
    traces: DataFrame, chunks: DataFrame | None = None, slo: float = SLO_SECONDS
) -> DataFrame:
    """A2: breaches over all languages, unfinished chunks, and revisions
    when the committed chunks are given."""
    totals = traces.groupBy("session_id").agg(
        F.lit(float(slo)).alias("slo_seconds"),
        F.count_if(F.col("glass_to_glass_s") > slo).alias("slo_breaches"),
        F.count_if(~F.col("finished")).alias("unfinished_chunks"),
    )
    if chunks is None:
        return totals.withColumn("revisions_after_commit", F.lit(0).cast("bigint"))
    revised = chunks.groupBy("session_id").agg(
        F.count_if("revised_after_commit").alias("revisions_after_commit")
    )
    return totals.join(revised, "session_id", "left").withColumn(
        "revisions_after_commit", F.coalesce("revisions_after_commit", F.lit(0).cast("bigint"))
    )


class MedianMachine(Machine):
    """State: the newest `cap` values, in arrival order and sorted."""

    columns = ["chunk_id", "published_seq", "glass_to_glass_s"]
    output = "chunk_id bigint, published_seq bigint, running_p50_s double"

    def __init__(self, cap: int):
        self.cap = self.look_back = cap

    def start(self, lane):
        return ([], [])

    def step(self, lane, state, book, row, out):
        arrived, ranked = state
        arrived.append(row[2])
        bisect.insort(ranked, row[2])
        if len(arrived) > self.cap:
            del ranked[bisect.bisect_left(ranked, arrived.pop(0))]
        place = (len(ranked) - 1) * 0.5
        low = int(place)
        high = min(low + 1, len(ranked) - 1)
        out.append((row[0], row[1], ranked[low] + (ranked[high] - ranked[low]) * (place - low)))
        return state, book

    def freeze(self, state):
        return state[0]

    def thaw(self, frozen):
        return (list(frozen), sorted(frozen))

    def candidates(self, lane, rows):
        newest = [row[2] for row in rows][-self.cap:]
        return [(newest, sorted(newest))]


def running_latency_p50(
    traces: DataFrame, cap: int = SAMPLE_CAP, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """The median of a language's samples up to and including each
    published chunk, over at most the newest `cap`."""
    return ordered_fold(
        traces.filter("finished"), ["session_id", "language"], "published_seq",
        MedianMachine(cap), target_rows,
    )
