"""Flow control: input backlog, playout drift, session limits, pass costs."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasestream.fixed_values import (
    DEFAULT_POLICY, MAX_DURATION_S, MAX_IDLE_S, MAX_LAG_S, MEASURED_POLICIES, RECOVER_TO_S,
    WARN_AT_FRACTION, WARN_LAG_S, WATCHDOG_TICK_S,
)
from phrasestream.functions.scalars import playout_speed, round_even, should_skip
from phrasestream.plans.fold import Machine, ordered_fold
from phrasestream.plans.ordered import TARGET_ROWS, running, with_neighbours

# --- T6, A9 -------------------------------------------------------------------


class BacklogMachine(Machine):
    """State: (start, duration) of buffered frames, newest audio end, warned."""

    columns = ["seq", "kind", "t_audio", "duration"]
    output = (
        "seq bigint, kind string, t_audio double, lag_before_s double, lag_after_s double, "
        "dropped_frames int, dropped_s double, shed boolean, warned boolean, taken boolean"
    )
    look_back = 512

    def __init__(self, max_lag: float, recover_to: float, warn: float):
        if recover_to >= max_lag:
            raise ValueError("a backlog is shed down to recover_to, so that has to be less than max_lag")
        self.max_lag, self.recover_to, self.warn = max_lag, recover_to, warn

    def start(self, lane):
        return [deque(), 0.0, False]

    def freeze(self, state):
        return [list(state[0]), state[1], state[2]]

    def thaw(self, frozen):
        return [deque(tuple(f) for f in frozen[0]), frozen[1], frozen[2]]

    @staticmethod
    def _lag(buffer, newest):
        return max(0.0, newest - buffer[0][0]) if buffer else 0.0

    def step(self, lane, state, book, row, out):
        buffer, newest, warned = state
        seq, kind, t_audio, duration = row
        if kind != "push":
            before = self._lag(buffer, newest)
            taken = bool(buffer)
            if taken:
                buffer.popleft()
            out.append((seq, kind, t_audio, before, self._lag(buffer, newest), 0, 0.0, False, False, taken))
            return state, book
        newest = t_audio + duration
        buffer.append((t_audio, duration))
        lag = self._lag(buffer, newest)
        gone = self._surplus(buffer, newest) if lag >= self.max_lag else 0
        seconds = 0.0
        for _ in range(gone):
            seconds += buffer.popleft()[1]
        high = lag >= self.warn
        out.append((
            seq, kind, t_audio, lag, self._lag(buffer, newest), gone, seconds, gone > 0, high and not warned, False
        ))
        return [buffer, newest, high], book

    def _surplus(self, buffer, newest) -> int:
        """Frames before the first one that is recent enough; the last always stays."""
        recent = (k for k, (start, _) in enumerate(buffer) if newest - start <= self.recover_to)
        return next(recent, len(buffer) - 1)

    def candidates(self, lane, rows):
        pushes = [(row[2], row[3]) for row in rows if row[1] == "push"]
        newest = pushes[-1][0] + pushes[-1][1] if pushes else 0.0
        return [
            [deque(pushes[start:]), newest, warned]
            for start in range(len(pushes) + 1) for warned in (False, True)
        ]


def shed_backlog(
    events: DataFrame, max_lag: float = MAX_LAG_S, recover_to: float = RECOVER_TO_S,
    warn: float = WARN_LAG_S, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Replay a push/drain log through a bounded buffer. `taken` marks a
    drain that found a frame."""
    machine = BacklogMachine(max_lag, recover_to, warn)
    return ordered_fold(events, ["session_id"], "seq", machine, target_rows)


def backlog_summary(decisions: DataFrame) -> DataFrame:
    """A9."""
    pushed = F.col("kind") == "push"
    totals = decisions.groupBy("session_id").agg(
        F.count_if(pushed).alias("frames_in"),
        F.count_if("taken").alias("frames_out"),
        F.sum(F.col("dropped_frames").cast("bigint")).alias("frames_dropped"),
        F.bround(F.sum("dropped_s"), 2).alias("seconds_dropped"),
        F.count_if("shed").alias("shed_events"),
        F.bround(F.coalesce(F.max(F.when(pushed, F.col("lag_before_s"))), F.lit(0.0)), 2).alias("peak_lag_s"),
    )
    rate = F.coalesce(F.try_divide("frames_dropped", "frames_in"), F.lit(0.0))
    return totals.withColumn("drop_rate", F.bround(rate, 4))


# --- J7, W6, T7, A10 -------------------------------------------------------------

MAX_POLICIES = 10_000
POLICY = ["comfortable_s", "speedup_at_s", "skip_at_s", "max_speed"]


def measured_policies(spark) -> DataFrame:
    return spark.createDataFrame(
        MEASURED_POLICIES, "language string, " + ", ".join(f"{c} double" for c in POLICY)
    )


def check_policies(policies: DataFrame) -> DataFrame:
    """Q-2: one row per violated rule of a policy table."""
    rules = {
        "thresholds must increase":
            ~((F.col("comfortable_s") < F.col("speedup_at_s")) & (F.col("speedup_at_s") < F.col("skip_at_s"))),
        "max_speed below 1": F.col("max_speed") < 1.0,
        "ramp shorter than 0.5 s": F.col("skip_at_s") - F.col("speedup_at_s") < 0.5,
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return policies.select("language", F.explode(found).alias("rule"))


def resolve_policy(
    languages: DataFrame, explicit: DataFrame | None = None, default: tuple = DEFAULT_POLICY
) -> DataFrame:
    """The policy in force per language: explicit, measured, default.

    The measured table is a constant of this package, so it is broadcast; an
    explicit table of unknown size is left to adaptive execution.
    """
    def pack(df, name):
        return df.select("language", F.struct(*POLICY).alias(name))

    rows = languages.join(F.broadcast(pack(measured_policies(languages.sparkSession), "_m")), "language", "left")
    if explicit is not None:
        rows = rows.join(pack(explicit, "_e"), "language", "left")
    else:
        rows = rows.withColumn("_e", F.lit(None).cast("struct<" + ",".join(f"{c}:double" for c in POLICY) + ">"))
    fallback = F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(POLICY, default)])
    source = F.when(F.col("_e").isNotNull(), "explicit").when(F.col("_m").isNotNull(), "measured")
    return (
        rows.withColumn("policy_source", F.coalesce(source, F.lit("default")))
        .withColumn("_p", F.coalesce("_e", "_m", fallback))
        .select(*languages.columns, "_p.*", "policy_source")
    )


def running_peak(depths: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Depth clamped at 0 and its running peak per session and language."""
    clamped = depths.withColumn("queue_depth_s", F.greatest(F.lit(0.0), F.col("queue_depth_s")))
    return running(
        clamped, ["session_id", "language"], ["seq"],
        {"peak_depth_s": ("max", F.col("queue_depth_s"))}, target_rows=target_rows,
    )


def drift_control(
    depths: DataFrame, policies: DataFrame, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Speak or skip each phrase given the queue observed before it.

    `depths` has session_id, language, seq, chunk_id, queue_depth_s and
    seconds (the phrase's span); `policies` is keyed by language. A language
    without a policy is inert: normal speed, never skipped, not observed.
    """
    # One row for each language: sent to all tasks if there are as few as expected.
    if policies.limit(MAX_POLICIES + 1).count() <= MAX_POLICIES:
        policies = F.broadcast(policies)
    known = running_peak(depths, target_rows).join(policies, "language", "left")
    inert = F.col("skip_at_s").isNull()
    skip = ~inert & should_skip(F.col("queue_depth_s"), F.col("skip_at_s"))
    speed = F.when(inert, 1.0).otherwise(
        playout_speed(*[F.col(c) for c in ("queue_depth_s", "speedup_at_s", "skip_at_s", "max_speed")])
    )
    return known.select(
        "session_id", "language", "seq", "chunk_id",
        F.when(inert, 0.0).otherwise(F.col("queue_depth_s")).alias("queue_depth_s"),
        F.when(inert, 0.0).otherwise(F.col("peak_depth_s")).alias("peak_depth_s"),
        F.when(skip, "skip").otherwise("speak").alias("action"),
        F.when(~skip, speed).alias("speed"),
        (~inert & ~skip & (F.col("queue_depth_s") > F.col("speedup_at_s"))).alias("sped_up"),
        F.when(skip, F.col("seconds")).otherwise(0.0).alias("skipped_s"),
        "speedup_at_s", "skip_at_s", "policy_source",
    )


def drift_summary(
    decisions: DataFrame, languages: DataFrame, explicit: DataFrame | None = None
) -> DataFrame:
    """A10: every configured (session_id, language) appears, with the thresholds
    of the policy in force; `explicit` has those of the session's owner."""
    keys = ["session_id", "language"]
    totals = decisions.groupBy(*keys).agg(
        F.max(F.struct("seq", "queue_depth_s")).getField("queue_depth_s").alias("queue_depth_s"),
        F.max("peak_depth_s").alias("peak_depth_s"),
        F.count_if(F.col("action") == "skip").alias("skipped_phrases"),
        F.sum("skipped_s").alias("skipped_seconds"),
        F.count_if("sped_up").alias("speedup_phrases"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return resolve_policy(languages, explicit).join(totals, keys, "left").select(
        *keys,
        *[F.bround(F.coalesce(F.col(c), F.lit(0.0)), 2).alias(c) for c in ("queue_depth_s", "peak_depth_s")],
        zero("skipped_phrases").cast("bigint").alias("skipped_phrases"),
        F.bround(F.coalesce(F.col("skipped_seconds"), F.lit(0.0)), 2).alias("skipped_seconds"),
        zero("speedup_phrases").cast("bigint").alias("speedup_phrases"),
        "speedup_at_s", "skip_at_s",
    )


# --- T8 ---------------------------------------------------------------------------


def session_watchdog(
    heartbeats: DataFrame, starts: DataFrame, max_duration: float = MAX_DURATION_S,
    max_idle: float = MAX_IDLE_S, warn_at: float = WARN_AT_FRACTION, tick: float = WATCHDOG_TICK_S,
    target_rows: int = TARGET_ROWS, early: bool = False,
) -> DataFrame:
    """When and why each session is ended by a limit.

    The limits are looked at every `tick` seconds after the start; duration is
    tested before idleness. `starts` has session_id, started_at (seconds) and
    optionally closed_at, when the session ended by itself. Beats from before the
    start are ignored, unless `early` has them count as signs of life.
    """
    beats = heartbeats.select("session_id", "t_wall")
    base = starts.select(
        "session_id", "started_at",
        (F.col("closed_at") if "closed_at" in starts.columns else F.lit(None).cast("double")).alias("closed_at"),
    )
    # The start counts as the first sign of life.
    signs = beats.unionByName(base.select("session_id", F.col("started_at").alias("t_wall")))
    gaps = with_neighbours(
        signs, ["session_id"], ["t_wall"], {"next": lambda w: F.lead("t_wall").over(w)},
        count=1, following=True, target_rows=target_rows,
    )
    on_tick = lambda t: F.col("started_at") + tick * F.ceil((t - F.col("started_at")) / tick)
    idle_end = on_tick(F.col("t_wall") + max_idle)
    idle = gaps.filter(
        F.col("next").isNull() | (F.col("next") - F.col("t_wall") >= max_idle)
    ).join(base, "session_id").filter(
        (F.lit(early) | (F.col("t_wall") >= F.col("started_at")))
        & (F.col("next").isNull() | (idle_end <= F.col("next")))
    ).groupBy("session_id").agg(F.min(idle_end).alias("idle_end"))
    capped = on_tick(F.col("started_at") + max_duration)
    limit = F.least(capped, F.col("idle_end"))
    by_itself = F.col("closed_at").isNotNull() & (F.col("closed_at") < limit)
    ended = F.when(by_itself, F.col("closed_at")).otherwise(limit)
    warned = on_tick(F.col("started_at") + max_duration * warn_at)
    return base.join(idle, "session_id", "left").select(
        "session_id",
        ended.alias("ended_at"),
        F.when(by_itself, F.lit(None))
        .when(F.col("idle_end").isNull() | (capped <= F.col("idle_end")), f"reached max_duration_s ({max_duration}s)")
        .otherwise(f"no source audio for {max_idle}s").alias("end_reason"),
        F.lit("ended").alias("status"),
        F.when(warned < ended, warned).alias("warned_at"),
    )


# --- W7 -----------------------------------------------------------------------------


def unsustainable_passes(
    passes: DataFrame, emit_interval: float, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """The first time two passes in a row cost more than the interval,
    with what to change. Passes over an empty window do not count."""
    rows = with_neighbours(
        passes.filter(F.col("window_s") > 0), ["session_id"], ["seq"],
        {"before": lambda w: F.lag("elapsed_s").over(w)}, count=1, target_rows=target_rows,
    )
    hit = rows.filter((F.col("elapsed_s") > emit_interval) & (F.col("before") > emit_interval))
    first = hit.groupBy("session_id").agg(
        F.min(F.struct("seq", "elapsed_s", "window_s")).alias("p")
    ).select("session_id", "p.*")
    ratio = F.col("elapsed_s") / F.col("window_s")
    wide = F.col("window_s") >= 1.0
    return first.select(
        "session_id", "seq",
        round_even(F.col("elapsed_s"), 2).alias("pass_cost_s"),
        F.lit(float(emit_interval)).alias("emit_interval_s"),
        round_even(F.col("window_s"), 1).alias("window_s"),
        round_even(F.col("elapsed_s") * 1.2, 1).alias("raise_emit_interval_to_s"),
        F.when(wide, round_even(ratio, 3)).alias("cost_per_audio_second"),
        F.when(wide, round_even(emit_interval / ratio, 1)).alias("or_lower_window_to_s"),
    )
