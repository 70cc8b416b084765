"""Session-level reports put together from the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_scorecard(
    sessions: DataFrame, chunks: DataFrame, backlog: DataFrame, heard: DataFrame,
    completeness: DataFrame, listeners: DataFrame, wer: DataFrame,
) -> DataFrame:
    """Tidy (session_id, check, ok, detail) rows.

    Inputs are small per session: A9 `backlog`, G2 `heard` per track, A4
    `completeness`, F2 `wer`; `chunks` and `listeners` are pre-aggregated.
    """
    base = sessions.select(
        "session_id", "status", "source_language", "target_languages",
        "billed_seconds", "billed_language_count",
    )
    row = lambda name, ok, detail: F.struct(
        F.lit(name).alias("check") if isinstance(name, str) else name.alias("check"),
        F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"),
    )
    chunk_counts = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks"))
    listener_counts = listeners.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("joined"), F.count_if(F.col("left_at").isNull()).alias("present")
    )
    wide = reduce(
        lambda left, right: left.join(right, "session_id", "left"),
        [chunk_counts, backlog.select("session_id", "frames_in", "frames_dropped"),
         listener_counts, wer.select("session_id", "wer")],
        base,
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    single = wide.select("session_id", F.inline(F.array(
        row("session ended cleanly", F.col("status") == "ended", F.col("status")),
        row("chunks produced", zero("chunks") > 0, zero("chunks").cast("string")),
        row("no audio shed", zero("frames_dropped") == 0,
            F.concat_ws(" of ", zero("frames_dropped").cast("string"), zero("frames_in").cast("string"))),
        row("listeners recorded", zero("joined") >= F.size("target_languages") + 1, zero("joined").cast("string")),
        row("listener departures recorded", zero("present") == 0, zero("present").cast("string")),
        row("billing settled",
            (F.col("status") == "ended") & (zero("billed_seconds") > 0)
            & (F.col("billed_language_count") == F.size("target_languages")),
            F.concat_ws(" x ", zero("billed_seconds").cast("string"), zero("billed_language_count").cast("string"))),
        row("transcript accuracy measured", F.col("wer") < 0.5, F.coalesce(F.bround("wer", 3).cast("string"), F.lit("no reference"))),
    )))
    targets = base.select("session_id", F.explode("target_languages").alias("language"))
    tracks = targets.unionByName(base.select("session_id", F.col("source_language").alias("language")))
    listened = tracks.join(heard.select("session_id", "language", "seconds", "peak"), ["session_id", "language"], "left").select(
        "session_id", F.concat(F.lit("listener heard "), F.col("language")).alias("check"),
        F.coalesce((F.col("seconds") > 1.0) & (F.col("peak") > 500), F.lit(False)).alias("ok"),
        F.concat(F.bround(F.coalesce("seconds", F.lit(0.0)), 1).cast("string"), F.lit("s peak "), zero("peak").cast("string")).alias("detail"),
    )
    stored = targets.join(completeness, ["session_id", "language"], "left").select(
        "session_id", F.concat(F.lit("transcripts stored for "), F.col("language")).alias("check"),
        F.coalesce("complete", F.lit(False)).alias("ok"),
        F.concat_ws(" of ", zero("translated").cast("string"), zero("chunks").cast("string")).alias("detail"),
    )
    return single.unionByName(listened).unionByName(stored)


def session_outcome(
    settled: DataFrame, chunks: DataFrame, latency: DataFrame, backlog: DataFrame, drift: DataFrame,
    end_reasons: DataFrame | None = None,
) -> DataFrame:
    """One row per settled session with nested latency, backlog, drift.

    A limit's reason is reported here although the ledger does not store it.
    Languages per session are few, so the nested maps are small.
    """
    def nest(df, name, skip=("session_id", "language")):
        entry = F.struct("language", F.struct(*[c for c in df.columns if c not in skip]).alias("stats"))
        return df.groupBy("session_id").agg(
            F.map_from_entries(F.sort_array(F.collect_set(entry))).alias(name)
        )

    counts = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("chunks"))
    queue = backlog.select("session_id", F.struct(*[c for c in backlog.columns if c != "session_id"]).alias("backlog"))
    out = (
        settled.select("session_id", "status", "failure_reason")
        .join(counts, "session_id", "left").join(nest(latency, "latency"), "session_id", "left")
        .join(queue, "session_id", "left").join(nest(drift, "drift"), "session_id", "left")
    )
    if end_reasons is not None:
        out = out.join(end_reasons.select("session_id", "end_reason"), "session_id", "left").withColumn(
            "failure_reason", F.coalesce("failure_reason", "end_reason")
        ).drop("end_reason")
    return out.withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("bigint")))
