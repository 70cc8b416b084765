"""The session ledger: tenancy, billing, listeners, transcripts, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasestream.fixed_values import (
    LANGUAGE_LABELS, LIVE_STATUSES, MAX_LANGUAGES, RESERVED_SCHEMA_NAMES, SCHEMA_NAME_PATTERN,
    SESSION_STATUSES, SOURCE_TRACK, TRACK_PREFIX,
)
from phrasestream.plans.ordered import TARGET_ROWS, running, with_neighbours

TRANSCRIPT_KEY = ["session_id", "chunk_id", "language"]


def tenant_scope(df: DataFrame, tenant_id) -> DataFrame:
    """Rows of one tenant. There is no default tenant."""
    if tenant_id is None or str(tenant_id).strip() == "":
        raise ValueError("name the tenant whose rows are wanted")
    return df.filter(F.col("tenant_id") == tenant_id)


def language_labels(spark) -> DataFrame:
    return spark.createDataFrame(
        LANGUAGE_LABELS, "label_code string, native string, english string, rtl boolean"
    )


def with_language_label(df: DataFrame, code: str = "code") -> DataFrame:
    """Native and English names and direction; unknown codes as themselves."""
    labels = F.broadcast(language_labels(df.sparkSession))  # a constant of 20 rows
    upper = F.upper(F.col(code))
    return df.join(labels, F.lower(F.col(code)) == F.col("label_code"), "left").select(
        *df.columns,
        F.coalesce("native", upper).alias("native"),
        F.coalesce("english", upper).alias("english"),
        F.coalesce("rtl", F.lit(False)).alias("rtl"),
    )


# --- S5 -------------------------------------------------------------------------


def resolve_transcripts(rows: DataFrame, version: list[str], lead: list[str] | None = None) -> DataFrame:
    """One row per (session, chunk, language) out of repeated writes: the
    first write fixes the row, later ones change only the translation, its
    latency and the revised flag. `version` orders the writes."""
    late = ["translated_text", "latency_s", "revised"]
    early = [c for c in rows.columns if c not in (*TRANSCRIPT_KEY, *late, *version)]
    at = F.struct(*version).alias("at")
    return (
        rows.groupBy(*TRANSCRIPT_KEY)
        .agg(
            F.min(F.struct(at, *early)).alias("first"),
            F.max(F.struct(at, *late)).alias("last"),
        )
        .select(*TRANSCRIPT_KEY, *[f"first.{c}" for c in early], *[f"last.{c}" for c in late])
    )


def upsert_transcripts(target: DataFrame, updates: DataFrame, version: str) -> DataFrame:
    """`target` has one row per key; `updates` may repeat keys, ordered by
    `version`."""
    old = target.withColumn("_new", F.lit(0)).withColumn("_v", F.lit(0).cast("bigint"))
    new = updates.withColumn("_new", F.lit(1)).withColumn("_v", F.col(version).cast("bigint"))
    both = old.unionByName(new.drop(*({version} - set(target.columns))))
    return resolve_transcripts(both, ["_new", "_v"])


# --- J1 - J5, J10, J12, T12 -------------------------------------------------------


def active_tenants(tenants: DataFrame) -> DataFrame:
    return tenants.filter("is_active").select("tenant_id", "slug", "schema_name")


def find_sessions(tenants: DataFrame, sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested sessions of active tenants. The tenant comes from the
    session row, never from the request."""
    wanted = sessions.join(ids.select("session_id").distinct(), "session_id", "left_semi")
    return wanted.join(active_tenants(tenants), "tenant_id").select(
        "session_id", "tenant_id", "slug", "event_name", "room_name", "source_language",
        "target_languages", "status", "started_at", "ended_at",
    )


def live_session_in_room(tenants: DataFrame, sessions: DataFrame) -> DataFrame:
    """Newest live session per room among active tenants, ties to the
    first tenant; an aggregate, so a busy room combines before the shuffle."""
    live = sessions.filter(F.col("status").isin(LIVE_STATUSES)).join(active_tenants(tenants), "tenant_id")
    age = -F.unix_micros(F.col("started_at").cast("timestamp"))
    newest = F.min(F.struct(age.alias("age"), "tenant_id", "session_id", "slug", "started_at"))
    return live.groupBy("room_name").agg(newest.alias("n")).select(
        "room_name", "n.session_id", "n.tenant_id", "n.slug", "n.started_at"
    )


def published_codes(tracks: DataFrame) -> DataFrame:
    """Language tracks (and the source track) published per session."""
    name = F.col("track_name")
    code = F.when(name.startswith(TRACK_PREFIX), F.substr(name, F.lit(len(TRACK_PREFIX) + 1))).when(
        name == SOURCE_TRACK, name
    )
    return tracks.select("session_id", code.alias("code")).filter("code is not null").distinct()


def language_availability(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """The language list of each live session, source first. A session
    whose live tracks are unknown shows every language as available."""
    live = sessions.filter(F.col("status").isin(LIVE_STATUSES)).select(
        "session_id",
        F.posexplode(F.concat(F.array("source_language"), F.col("target_languages"))).alias("position", "code"),
    )
    known = published_codes(tracks)
    any_known = known.select("session_id").distinct().withColumn("_known", F.lit(True))
    is_source = F.col("position") == 0
    listed = (
        live.withColumn("_track", F.when(is_source, F.lit(SOURCE_TRACK)).otherwise(F.col("code")))
        .join(known.select("session_id", F.col("code").alias("_track"), F.lit(True).alias("_on")),
              ["session_id", "_track"], "left")
        .join(any_known, "session_id", "left")
    )
    return with_language_label(listed).select(
        "session_id", "position", "code", "native",
        F.when(is_source, "original audio").otherwise(F.col("english")).alias("english"),
        "rtl",
        (F.col("_known").isNull() | F.col("_on").isNotNull()).alias("available"),
        is_source.alias("is_source"),
    )


def missing_languages(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Configured languages nobody publishes, where tracks are known."""
    known = published_codes(tracks)
    configured = sessions.select("session_id", F.explode("target_languages").alias("code"))
    reachable = configured.join(known.select("session_id").distinct(), "session_id", "left_semi")
    return reachable.join(known, ["session_id", "code"], "left_anti")


def tenant_lookup(rows: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with slug and schema, rejected rows with a reason).
    `rows` may be a stream; the tenant side is re-read per micro-batch."""
    marked = rows.join(
        tenants.select("tenant_id", "slug", "schema_name", F.col("is_active").alias("_active")),
        "tenant_id", "left",
    )
    accepted = marked.filter(F.coalesce("_active", F.lit(False))).drop("_active")
    rejected = marked.filter(~F.coalesce("_active", F.lit(False))).select(
        *rows.columns, F.when(F.col("_active").isNull(), "unknown tenant").otherwise("inactive tenant").alias("reason")
    )
    return accepted, rejected


def fan_out(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per chunk and target language."""
    targets = sessions.select("session_id", "source_language", "target_languages")
    return chunks.join(targets, "session_id").select(
        *chunks.columns, "source_language", F.explode("target_languages").alias("language")
    )


def orphans(child: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows whose session does not exist."""
    return child.join(sessions.select("session_id"), "session_id", "left_anti")


def reuse_live_session(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """A request for a room joins the tenant's newest live session there,
    else its own new one."""
    newest = sessions.filter(F.col("status").isin(LIVE_STATUSES)).groupBy("tenant_id", "room_name").agg(
        F.max(F.struct("started_at", "session_id")).getField("session_id").alias("live_id")
    )
    return requests.join(newest, ["tenant_id", "room_name"], "left").select(
        "request_id", "tenant_id", "room_name",
        F.coalesce("live_id", "new_session_id").alias("session_id"),
        F.col("live_id").isNotNull().alias("reused"),
    )


def superseded_rooms(sessions: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Live sessions ended by a later session in the same room. The end
    is recorded as failed, with "superseded" as the reason."""
    rows = with_neighbours(
        sessions.select("tenant_id", "room_name", "session_id", "started_at", "status"),
        ["tenant_id", "room_name"], ["started_at", "session_id"],
        {
            "superseded_at": lambda w: F.lead("started_at").over(w),
            "superseded_by": lambda w: F.lead("session_id").over(w),
        },
        count=1, following=True, target_rows=target_rows,
    )
    return rows.filter(F.col("status").isin(LIVE_STATUSES) & F.col("superseded_by").isNotNull()).select(
        "tenant_id", "room_name", "session_id", "superseded_at", "superseded_by",
        F.lit("failed").alias("status"), F.lit("superseded").alias("failure_reason"),
    )


# --- A3 - A6, A13 ------------------------------------------------------------------


def active_listeners(listeners: DataFrame) -> DataFrame:
    """A3."""
    return listeners.filter("left_at is null").groupBy("tenant_id", "session_id", "language").agg(
        F.count(F.lit(1)).alias("listeners")
    )


def transcript_completeness(transcripts: DataFrame) -> DataFrame:
    """A4."""
    return transcripts.groupBy("session_id", "language").agg(
        F.count(F.lit(1)).alias("chunks"), F.count("translated_text").alias("translated")
    ).withColumn("complete", (F.col("chunks") > 0) & (F.col("chunks") == F.col("translated")))


def _seconds_between(start: Column, end: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(end) - micros(start)) / 1_000_000


def settle_billing(sessions: DataFrame, closes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: (settled sessions, rejected close events).

    `closes` has session_id, tenant_id, closed_at and failure_reason. Only the
    first close of an open session of the same tenant settles it.
    """
    first = F.min(F.struct("closed_at", "failure_reason"))
    requested = closes.groupBy("session_id", "tenant_id").agg(
        first.alias("c"), F.count(F.lit(1)).alias("_closes")
    )
    open_sessions = sessions.filter("ended_at is null").select(
        "session_id", "tenant_id", "started_at", "target_languages"
    )
    failed = F.coalesce(F.col("c.failure_reason"), F.lit("")) != ""
    seconds = F.greatest(F.lit(0), F.ceil(_seconds_between(F.col("started_at"), F.col("c.closed_at")))).cast("int")
    languages = F.size("target_languages").cast("smallint")
    matched = requested.join(open_sessions, ["session_id", "tenant_id"])
    settled = matched.select(
        "session_id", "tenant_id",
        F.when(failed, "failed").otherwise("ended").alias("status"),
        F.col("c.closed_at").alias("ended_at"), F.col("c.failure_reason").alias("failure_reason"),
        seconds.alias("billed_seconds"), languages.alias("billed_language_count"),
        (seconds.cast("bigint") * languages).alias("language_seconds"),
    )
    rejected = requested.join(
        open_sessions.select("session_id", "tenant_id", F.lit(1).alias("_open")),
        ["session_id", "tenant_id"], "left",
    ).select(
        "session_id", "tenant_id",
        (F.col("_closes") - F.coalesce("_open", F.lit(0))).alias("rejected_closes"),
        F.when(F.col("_open").isNull(), "not found for tenant, or already ended")
        .otherwise("already ended").alias("reason"),
    ).filter("rejected_closes > 0")
    return settled, rejected


def billing_rollup(settled: DataFrame) -> DataFrame:
    """Language-seconds by tenant and day, with subtotals."""
    return settled.withColumn("day", F.date_format("ended_at", "yyyy-MM-dd")).rollup("tenant_id", "day").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("language_seconds").alias("language_seconds")
    )


def listeners_over_time(join_leave: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Concurrent listeners after each event. Repeated joins or leaves of
    one listener count once; a count is a floor, since leaves may be lost."""
    events = join_leave.groupBy("session_id", "language", "listener_id", "kind").agg(
        F.min("t_event").alias("t_event")
    )
    change = F.when(F.col("kind") == "join", 1).otherwise(-1).cast("bigint")
    return running(
        events, ["session_id", "language"], ["t_event", "listener_id", "kind"],
        {"listeners": ("sum", change)}, target_rows=target_rows,
    )


# --- O1 - O3 --------------------------------------------------------------------------


def transcript(transcripts: DataFrame, tenant_id, session_id: str, language: str) -> DataFrame:
    """O1."""
    return tenant_scope(transcripts, tenant_id).filter(
        (F.col("session_id") == session_id) & (F.col("language") == language)
    ).select(
        "chunk_id", "source_text", "translated_text", "t_audio_start", "t_audio_end",
        "latency_s", "commit_reason", "revised",
    ).orderBy("chunk_id")


def live_sessions(sessions: DataFrame, tenant_id) -> DataFrame:
    """O2: newest first."""
    return tenant_scope(sessions, tenant_id).filter(F.col("status").isin(LIVE_STATUSES)).select(
        "session_id", "event_name", "started_at", "target_languages"
    ).orderBy(F.col("started_at").desc(), "session_id")


def tenant_directory(tenants: DataFrame, sessions: DataFrame) -> DataFrame:
    """O3."""
    counts = sessions.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("sessions"))
    return tenants.join(counts, "tenant_id", "left").select(
        "slug", "schema_name", F.when(F.col("is_active"), "active").otherwise("inactive").alias("state"),
        "tenant_id", F.coalesce("sessions", F.lit(0).cast("bigint")).alias("sessions"),
    ).orderBy("slug")


# --- Q-1, Q-2 -----------------------------------------------------------------------------


def _violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()
    ]))
    return df.select(*key, F.explode(found).alias("rule"))


def validate_sessions(sessions: DataFrame, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Q-1: one row per violated rule."""
    targets = F.col("target_languages")
    return _violations(sessions, ["session_id"], {
        "no target language": F.size(targets) == 0,
        "too many target languages": F.size(targets) > max_languages,
        "duplicate target language": F.size(F.array_distinct(targets)) < F.size(targets),
        "source is also a target": F.array_contains(targets, F.col("source_language")),
        "unknown status": ~F.col("status").isin(SESSION_STATUSES),
        "ended before it started": F.col("ended_at") < F.col("started_at"),
        "failed without a reason": (F.col("status") == "failed") & F.col("failure_reason").isNull(),
    })


def validate_listeners(listeners: DataFrame) -> DataFrame:
    """Q-2."""
    return _violations(listeners, ["listener_id"], {"left before joining": F.col("left_at") < F.col("joined_at")})


def validate_transcripts(transcripts: DataFrame) -> DataFrame:
    """Q-2: audio span and uniqueness of (session, chunk, language)."""
    spans = _violations(transcripts, TRANSCRIPT_KEY, {"ends before it starts": F.col("t_audio_end") < F.col("t_audio_start")})
    repeated = transcripts.groupBy(*TRANSCRIPT_KEY).count().filter("count > 1").select(
        *TRANSCRIPT_KEY, F.lit("repeated key").alias("rule")
    )
    return spans.unionByName(repeated)


def validate_tenants(tenants: DataFrame) -> DataFrame:
    """Q-2: schema names are checked, never repaired."""
    name = F.col("schema_name")
    return _violations(tenants, ["tenant_id"], {
        "schema name is empty": F.coalesce(name, F.lit("")) == "",
        "schema name is not a safe identifier": (name != "") & ~name.rlike(SCHEMA_NAME_PATTERN),
        "schema name is reserved": name.isin(RESERVED_SCHEMA_NAMES),
    })
