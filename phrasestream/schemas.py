"""Fixed input schemas, as DDL strings usable by batch and streaming readers."""

WORDS = "array<struct<word:string,t_audio_start:double,t_audio_end:double>>"

HYPOTHESES = (
    "session_id string, seq bigint, text string, is_final boolean, t_audio_start double, "
    f"t_audio_end double, t_wall double, language string, confidence double, words {WORDS}"
)
CHUNKS = (
    "session_id string, chunk_id bigint, text string, t_audio_start double, t_audio_end double, "
    "t_wall_committed double, reason string, word_count int, stability_lag double, "
    "revised_after_commit boolean"
)
FRAMES = (
    "session_id string, seq bigint, pcm binary, sample_rate int, t_audio double, t_wall double"
)
MARKS = (
    "session_id string, seq bigint, chunk_id bigint, language string, stage string, t_wall double"
)
PUSHLOG = "session_id string, seq bigint, kind string, t_audio double, duration double"
TENANTS = (
    "tenant_id string, slug string, schema_name string, display_name string, "
    "is_active boolean, created_at timestamp"
)
SESSIONS = (
    "session_id string, tenant_id string, event_name string, room_name string, "
    "source_language string, target_languages array<string>, status string, "
    "started_at timestamp, ended_at timestamp, failure_reason string, billed_seconds int, "
    "billed_language_count smallint, latency_credible boolean, backend_stt string, "
    "backend_mt string, backend_tts string"
)
LISTENERS = (
    "listener_id string, session_id string, tenant_id string, language string, "
    "joined_at timestamp, left_at timestamp"
)
TRANSCRIPTS = (
    "session_id string, tenant_id string, chunk_id int, language string, source_text string, "
    "translated_text string, t_audio_start double, t_audio_end double, latency_s double, "
    "commit_reason string, revised boolean, created_at timestamp"
)
LEDGER = {"sessions": SESSIONS, "listeners": LISTENERS, "transcripts": TRANSCRIPTS}
