"""Audio frame tables: levels, gates, quiet runs, utterances, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasestream.fixed_values import (
    MODEL_SAMPLE_RATE, QUIET_FRAME_RMS, SPEECH_PEAK, SPEECH_WINDOW_RMS, UTTERANCE_MAX_S,
    UTTERANCE_QUIET_S,
)
from phrasestream.functions import audio as pcm_functions
from phrasestream.functions.scalars import audio_duration
from phrasestream.plans.fold import Machine, ordered_fold
from phrasestream.plans.ordered import TARGET_ROWS, running


def resample_frames(frames: DataFrame, to: int = MODEL_SAMPLE_RATE) -> DataFrame:
    """G1: frames with `audio`, floats at the model's rate, instead of pcm."""

    def convert(pcm: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([pcm_functions.resample(p, r, to) for p, r in zip(pcm, rate)])

    audio = F.pandas_udf(convert, "array<float>")
    return frames.withColumn("audio", audio("pcm", "sample_rate")).drop("pcm")


def frame_levels(frames: DataFrame) -> DataFrame:
    """Per frame: duration, samples, peak, sum of squares and RMS in 0..1."""

    def measure(pcm: pd.Series) -> pd.DataFrame:
        rows = [pcm_functions.level(p) for p in pcm]
        return pd.DataFrame(rows, columns=["samples", "peak", "squares"])

    measured = F.pandas_udf(measure, "samples bigint, peak int, squares bigint")
    return (
        frames.withColumn("_l", measured("pcm"))
        .withColumn("duration", audio_duration(F.col("pcm"), F.col("sample_rate")))
        .select(*[c for c in frames.columns if c != "pcm"], "duration", "_l.*")
        .withColumn("rms", F.coalesce(F.sqrt(F.try_divide("squares", "samples")) / 32768, F.lit(0.0)))
    )


def audio_levels(frames: DataFrame, by: list[str]) -> DataFrame:
    """Seconds, peak and RMS in sample units; SPEECH needs a peak above
    the threshold, since an open track of silence also has a duration."""
    return frame_levels(frames).groupBy(*by).agg(
        F.sum("duration").alias("seconds"), F.max("peak").alias("peak"),
        F.floor(F.sqrt(F.coalesce(F.try_divide(F.sum("squares"), F.sum("samples")), F.lit(0.0)))).alias("rms"),
    ).withColumn("verdict", F.when(F.col("peak") > SPEECH_PEAK, "SPEECH").otherwise("SILENT"))


def published_seconds(frames: DataFrame) -> DataFrame:
    """Frames and seconds published per session and language."""
    return frames.groupBy("session_id", "language").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(audio_duration(F.col("pcm"), F.col("sample_rate"))).alias("seconds"),
    )


def energy_gate(windows: DataFrame, floor: float = SPEECH_WINDOW_RMS) -> DataFrame:
    """G3."""
    return windows.filter(F.col("rms") >= floor)


def quiet_runs(
    levels: DataFrame, rms_floor: float = QUIET_FRAME_RMS, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Seconds of quiet up to each frame since the last loud one. Loud frames
    number the islands between them; a total runs inside its island alone."""
    loud = F.col("rms") >= rms_floor
    numbered = running(
        levels, ["session_id"], ["seq"], {"_island": ("count", F.when(loud, 1))}, target_rows=target_rows)
    quiet = F.when(loud, 0.0).otherwise(F.col("duration"))
    return running(
        numbered, ["session_id", "_island"], ["seq"], {"quiet_s": ("sum", quiet)}, target_rows=target_rows
    ).drop("_island")


class UtteranceMachine(Machine):
    """State: open utterance (start, seconds, energy, passes), the quiet
    accumulated in it, and when the next recognition pass is due."""

    columns = ["t_audio", "t_wall", "duration", "rms"]
    output = (
        "utterance_id bigint, t_start double, t_end double, closed_by string, rms double, "
        "gated boolean, passes int"
    )
    look_back = 1024

    def __init__(self, quiet_s, max_s, frame_floor, window_floor, emit_interval):
        self.quiet_s, self.max_s = quiet_s, max_s
        self.frame_floor, self.window_floor, self.emit_interval = frame_floor, window_floor, emit_interval

    def start(self, lane):
        return [None, 0.0, 0.0]

    def new_book(self):
        return 0

    def merge_books(self, first, second):
        return first + second

    def step(self, lane, state, book, row, out):
        utterance, quiet, due = state
        t_audio, t_wall, duration, rms = row
        start, seconds, energy, passes = utterance or [t_audio, 0.0, 0.0, 0]
        seconds, energy = seconds + duration, energy + rms * rms * duration
        quiet = quiet + duration if rms < self.frame_floor else 0.0
        silent, overlong = quiet >= self.quiet_s, seconds >= self.max_s
        # A length cap closes what has something to say; a hum stays open.
        spoken = energy >= self.window_floor**2 * seconds
        closed_by = "quiet" if silent else "cap" if overlong and spoken else None
        if silent or overlong or t_wall >= due:
            passes, due = passes + 1, t_wall + self.emit_interval
        if closed_by is None:
            return [[start, seconds, energy, passes], quiet, due], book
        out.append(self._row(book, start, seconds, energy, passes, closed_by))
        return [None, 0.0 if closed_by else quiet, due], book + 1

    def _row(self, number, start, seconds, energy, passes, closed_by):
        rms = (energy / seconds) ** 0.5 if seconds > 0 else 0.0
        return (number, start, start + seconds, closed_by, rms, energy < self.window_floor**2 * seconds, passes)

    def finish(self, lane, state, book, row, out):
        if state[0] is not None:
            start, seconds, energy, passes = state[0]
            out.append(self._row(book, start, seconds, energy, passes + 1, "end"))

    def after_finish(self, lane, state, book, emitted):
        return [None, 0.0, state[2]], book + len(emitted)

    def candidates(self, lane, rows):
        """An utterance may have started at any of these frames."""
        found = []
        for first in range(1, len(rows) + 1):
            state = [None, 0.0, rows[first - 1][1] + self.emit_interval]
            for row in rows[first:]:
                state, _ = self.step(lane, state, 0, row, [])
                if state[0] is None:
                    break  # the rest is covered by a later start
            found.append(state)
        return found


def utterances(
    levels: DataFrame, quiet_s: float = UTTERANCE_QUIET_S, max_s: float = UTTERANCE_MAX_S,
    frame_floor: float = QUIET_FRAME_RMS, window_floor: float = SPEECH_WINDOW_RMS,
    emit_interval: float = 1.0, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Utterances closed by quiet, by the length cap or by the end.
    `gated` ones are too silent to recognise; beyond the length cap they stay
    open, with a pass at every frame, until they are loud enough or quiet.
    `passes` counts the recognition passes due while the utterance was open."""
    machine = UtteranceMachine(quiet_s, max_s, frame_floor, window_floor, emit_interval)
    return ordered_fold(levels, ["session_id"], "seq", machine, target_rows)


def context_windows(
    available: DataFrame, chunk: tuple[int, int] = (56, 56), shift: tuple[int, int] = (56, 56),
    cache: tuple[int, int] = (0, 8), drop: int = 1, flush: bool = True,
) -> DataFrame:
    """Encoder steps over `available` feature frames per session, each
    pair giving (first step, later steps). A step needs its whole chunk;
    `flush` adds what is left over at the end as one short step.

    The start of step k is arithmetic, so steps are generated, not iterated:
    0, then shift[0] + (k-1) * shift[1].
    """
    rows = _with_last_step(available, chunk, shift, flush)
    steps = rows.filter(F.col("_last") >= 0).select(
        "session_id", "available", "_full", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("step")
    )
    return steps.select("session_id", "step", *_window_of_step(chunk, shift, cache, drop))


def _start_of(step: Column, shift: tuple[int, int]) -> Column:
    return F.when(step == 0, 0).otherwise(shift[0] + (step - 1) * shift[1]).cast("bigint")


def _with_last_step(
    available: DataFrame, chunk: tuple[int, int], shift: tuple[int, int], flush: bool
) -> DataFrame:
    """`_full`, the number of whole steps, and `_last`, the last step (-1 for none)."""
    frames = F.col("available")
    later = F.floor((frames - chunk[1] - shift[0]) / shift[1]) + 1
    full = F.when(frames < chunk[0], 0).otherwise(1 + F.greatest(F.lit(0), later)).cast("bigint")
    left = F.lit(flush) & (frames > _start_of(F.col("_full"), shift))
    return available.withColumn("_full", full).withColumn("_last", F.col("_full") - F.when(left, 0).otherwise(1))


def _window_of_step(
    chunk: tuple[int, int], shift: tuple[int, int], cache: tuple[int, int], drop: int
) -> list[Column]:
    """start, end, cache_start, zero_pad and drop of the row's `step`."""
    start = _start_of(F.col("step"), shift)
    width = F.when(F.col("step") == 0, cache[0]).otherwise(cache[1])
    end = F.when(F.col("step") == F.col("_full"), F.col("available")).otherwise(
        start + F.when(F.col("step") == 0, chunk[0]).otherwise(chunk[1])
    )
    held = F.least(width, start)
    return [
        start.alias("start"), end.cast("bigint").alias("end"),
        (start - held).cast("bigint").alias("cache_start"), (width - held).cast("bigint").alias("zero_pad"),
        F.when(F.col("step") == 0, 0).otherwise(drop).cast("bigint").alias("drop"),
    ]


def covering_windows(
    available: DataFrame, frames: DataFrame, chunk: tuple[int, int] = (56, 56),
    shift: tuple[int, int] = (56, 56), cache: tuple[int, int] = (0, 8), drop: int = 1, flush: bool = True,
) -> DataFrame:
    """Each feature frame (session_id, frame) with every window of `context_windows` that
    covers it, cache included. The few steps that may cover a frame are arithmetic too, so
    sessions and frames are joined before any step is made, and steps without frames never
    are."""
    frame = F.col("frame")
    first = F.floor((frame - max(chunk) - shift[0]) / shift[1]) + 1
    final = F.floor((frame + max(cache) - shift[0]) / shift[1]) + 1
    low = F.greatest(F.lit(0), first).cast("bigint")
    high = F.least(F.col("_last"), F.greatest(F.lit(0), final)).cast("bigint")
    known = _with_last_step(available.select("session_id", "available"), chunk, shift, flush)
    met = frames.join(known, "session_id").withColumns({"_low": low, "_high": high})
    steps = met.filter(F.col("_low") <= F.col("_high")).withColumn("step", F.explode(F.sequence("_low", "_high")))
    columns = [c for c in frames.columns if c != "session_id"]
    return steps.select("session_id", *columns, "step", *_window_of_step(chunk, shift, cache, drop)).filter(
        (F.col("frame") >= F.col("cache_start")) & (F.col("frame") < F.col("end")))


def window_frames(windows: DataFrame, frames: DataFrame, hop: int) -> DataFrame:
    """Attach feature frames (session_id, frame) to the windows that cover
    them, cache included. Both sides are put in cells of `hop` frames, so the
    range join is an equality join on a key that is as fine as the data. The windows
    are many more than what they were made of, so they are not to be broadcast."""
    cells = windows.hint("merge").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("cache_start") / hop), F.floor((F.col("end") - 1) / hop)))
    )
    return cells.join(
        frames.withColumn("_cell", F.floor(F.col("frame") / hop)), ["session_id", "_cell"]
    ).filter(
        (F.col("frame") >= F.col("cache_start")) & (F.col("frame") < F.col("end"))
    ).drop("_cell")
