"""Session-shaped views over the driver's tables.

Each view is one SQL text for both engines; `@name(...)` marks the few places
where the dialects differ. Views are row-local (filters, expressions, unnest),
so they read whole tables in one pass and need no shuffle.
"""

from __future__ import annotations

import re
from functools import cache

TABLES = "nation orders lineitem events documents conversations benchmark labels".split()

SPARK = {
    "list": "array({0})",
    "add_seconds": "timestampadd(MICROSECOND, cast(floor(1000000 * ({1})) as bigint), cast({0} as timestamp))",
    "time": "cast({0} as timestamp)",
    "tokens": "filter(split({0}, '\\\\s+'), x -> x <> '')",
    "head": "slice({0}, 1, cast({1} as int))",
    "join": "array_join({0}, ' ')",
    "size": "size({0})",
    "steps": "explode(sequence(0, cast({0} as bigint) - 1))",
    "bytes": "encode({0}, 'UTF-8')",
    "text": "cast({0} as string)",
    "json": "to_json(named_struct({0}))",
}
DUCK = {
    "list": "list_value({0})",
    "add_seconds": "{0} + to_microseconds(cast(floor(1000000 * ({1})) as bigint))",
    "time": "{0}",
    "tokens": "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')",
    "head": "({0})[1:cast({1} as int)]",
    "join": "array_to_string({0}, ' ')",
    "size": "cast(len({0}) as int)",
    "steps": "unnest(range(0, cast({0} as bigint)))",
    "bytes": "encode({0})",
    "text": "cast({0} as varchar)",
    "json": "cast(json_object({0}) as varchar)",
}

VIEWS = {
    "fx_words": """
        SELECT conv_id * 100 + turn AS session_id, conv_id, turn, role, text, @tokens(text) AS toks
        FROM conversations""",
    "fx_steps": """
        SELECT session_id, toks, @size(toks) AS n, @steps(ceil(@size(toks) / 3.0)) AS k FROM fx_words""",
    "fx_hyps": """
        SELECT session_id, k AS seq, w = n AS is_final,
               CASE WHEN k % 2 = 0 AND w < n THEN @join(@head(toks, w)) || 'x' ELSE @join(@head(toks, w)) END AS text,
               cast(0.0 as double) AS t_audio_start, cast(w as double) * cast(0.35 as double) AS t_audio_end,
               cast(k as double) * cast(0.15 as double) AS t_wall
        FROM (SELECT *, least(3 * (k + 1), n) AS w FROM fx_steps)""",
    "fx_paused": """
        SELECT session_id, seq, is_final, text, t_audio_start, t_audio_end, t_wall + floor(seq / cast(4.0 as double)) * cast(0.9 as double) AS t_wall
        FROM fx_hyps""",
    "fx_line": """
        SELECT l_orderkey AS session_id, cast(l_linenumber as bigint) AS chunk_id, l_returnflag AS language,
               cast(round(l_extendedprice * 100) as bigint) * 1000 + l_linenumber * 10 AS base,
               cast(3.0 as double) * l_linenumber AS audio_end_wall,
               cast(10.0 as double) * (l_discount + 0.0) AS d1, l_tax AS d2, l_quantity / 100 AS d3,
               l_extendedprice / 1000000 AS d4, l_linestatus AS state
        FROM lineitem""",
    "fx_marks": """
        SELECT session_id, chunk_id, language, base AS seq, 'committed' AS stage, audio_end_wall + d1 AS t_wall FROM fx_line
        UNION ALL
        SELECT session_id, chunk_id, language, base + 1, 'translated', audio_end_wall + d1 + d2 FROM fx_line
        UNION ALL
        SELECT session_id, chunk_id, language, base + 2, 'tts_first_audio', audio_end_wall + d1 + d2 + d3 FROM fx_line
        UNION ALL
        SELECT session_id, chunk_id, language, base + 3, 'published', audio_end_wall + d1 + d2 + d3 + d4 FROM fx_line WHERE state <> 'O'""",
    "fx_ends": "SELECT DISTINCT session_id, chunk_id, language, audio_end_wall FROM fx_line",
    "fx_sessions": """
        SELECT o_orderkey AS session_id, o_custkey % 7 AS tenant_id, 'event ' || @text(o_custkey) AS event_name,
               o_orderpriority AS room_name, 'en' AS source_language,
               CASE o_orderkey % 4 WHEN 0 THEN @list('fr') WHEN 1 THEN @list('fr', 'ar')
                    WHEN 2 THEN @list('de', 'es', 'xx') ELSE @list('ar', 'te', 'en', 'ar') END AS target_languages,
               CASE WHEN o_orderstatus = 'O' THEN 'live' WHEN o_orderstatus = 'P' THEN 'starting'
                    WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'ended' END AS status,
               @time(o_orderdate) AS started_at,
               CASE WHEN o_orderstatus = 'F' THEN @add_seconds(o_orderdate, o_totalprice / 100 - 200) END AS ended_at,
               CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 = 0 THEN 'lost room' END AS failure_reason,
               CASE o_orderkey % 4 WHEN 0 THEN 'faster-whisper' WHEN 1 THEN 'fastconformer' WHEN 2 THEN 'qwen3-asr' ELSE 'other' END AS backend_stt,
               CASE o_orderkey % 3 WHEN 0 THEN 'opus-mt' WHEN 1 THEN 'nllb-200' ELSE 'routing' END AS backend_mt,
               CASE o_orderkey % 5 WHEN 0 THEN 'kokoro' WHEN 1 THEN 'chatterbox' ELSE 'piper' END AS backend_tts
        FROM orders""",
    "fx_closes": """
        SELECT o_orderkey AS session_id, (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 7 AS tenant_id,
               @add_seconds(o_orderdate, o_totalprice / 1000) AS closed_at,
               CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'crash' END AS failure_reason
        FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey % 7, @add_seconds(o_orderdate, o_totalprice / 1000 + 60), 'late' FROM orders WHERE o_orderkey % 5 = 0""",
    "fx_tenants": """
        SELECT cast(n_nationkey as bigint) AS tenant_id, lower(n_name) AS slug,
               CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name WHEN 2 THEN 'public' ELSE '' END AS schema_name,
               n_regionkey <> 0 AS is_active
        FROM nation""",
    "fx_asked": "SELECT event_id AS request_id, user_id % 30 AS tenant_id, cast(event_id as double) AS t FROM events",
    "fx_entries": """
        SELECT cast(n_nationkey as bigint) AS tenant_id, lower(n_name) AS slug,
               CASE n_nationkey % 6 WHEN 2 THEN 'public' WHEN 3 THEN n_name ELSE 'tenant_' || @text(n_nationkey) END AS schema_name,
               n_regionkey <> 0 AS is_active, cast(0.0 as double) AS t
        FROM nation
        UNION ALL
        SELECT n_nationkey, lower(n_name), 'tenant_' || @text(n_nationkey), n_regionkey = 0, cast(1000.5 as double) * (n_nationkey % 7 + 1)
        FROM nation""",
    "fx_tracks": """
        SELECT o_orderkey AS session_id, CASE o_orderkey % 5 WHEN 0 THEN 'lang-fr' WHEN 1 THEN 'lang-ar' WHEN 2 THEN 'source-audio' WHEN 3 THEN 'lang-te' ELSE 'screen' END AS track_name FROM orders
        UNION ALL
        SELECT o_orderkey, 'lang-de' FROM orders WHERE o_custkey % 3 = 0""",
    "fx_requests": """
        SELECT event_id AS request_id, user_id % 7 AS tenant_id,
               CASE user_id % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '5-LOW' ELSE 'room-9' END AS room_name,
               1000000000 + event_id AS new_session_id, user_id * 100 AS session_id
        FROM events""",
    "fx_listeners": """
        SELECT event_id AS listener_id, user_id AS session_id, user_id % 7 AS tenant_id, event_type AS language,
               @time(ts) AS joined_at,
               CASE WHEN value >= 50 THEN @add_seconds(ts, value - 100) END AS left_at
        FROM events""",
    "fx_joinleave": """
        SELECT user_id AS session_id, event_type AS language, event_id AS listener_id, 'join' AS kind, cast(event_id as double) AS t_event FROM events
        UNION ALL
        SELECT user_id, event_type, event_id, 'leave', event_id + value FROM events WHERE value >= 20
        UNION ALL
        SELECT user_id, event_type, event_id, 'leave', event_id + 2 * value FROM events WHERE value >= 30""",
    "fx_depths": """
        SELECT user_id AS session_id, event_id AS seq, event_id AS chunk_id,
               CASE event_type WHEN 'click' THEN 'fr' WHEN 'view' THEN 'ar' WHEN 'purchase' THEN 'de' WHEN 'signup' THEN 'hi' ELSE 'xx' END AS language,
               value / 20 - cast(0.2 as double) AS queue_depth_s, value / 100 AS seconds
        FROM events""",
    "fx_levels": """
        SELECT user_id AS session_id, event_id AS seq, event_id * cast(0.001 as double) AS t_audio,
               event_id * cast(0.001 as double) AS t_wall, CASE WHEN user_id % 5 = 0 THEN cast(0.4 as double) ELSE cast(0.1 as double) END AS duration,
               CASE WHEN user_id % 5 = 0 THEN cast(0.0052 as double) + value / 60000 ELSE value / 4000 END AS rms
        FROM events""",
    "fx_pushlog": """
        SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'drain' ELSE 'push' END AS kind,
               event_id * cast(0.001 as double) AS t_audio, cast(0.1 as double) AS duration
        FROM events""",
    "fx_anchor": """
        SELECT user_id AS session_id, event_id AS seq, event_id * cast(0.001 as double) AS t_audio,
               event_id * cast(0.001 as double) + value AS t_wall
        FROM events""",
    "fx_passes": """
        SELECT user_id AS session_id, event_id AS seq, value / 10 AS elapsed_s, value / 5 - 1 AS window_s FROM events""",
    "fx_beats": "SELECT user_id AS session_id, event_id * cast(8.0 as double) AS t_wall FROM events",
    "fx_starts": "SELECT DISTINCT user_id AS session_id, cast(user_id as double) AS started_at FROM events",
    "fx_segments": """
        SELECT doc_id AS segment_id, source AS source,
               CASE WHEN doc_id % 10 = 0 THEN 'Thank you.' WHEN doc_id % 10 = 5 THEN '  Bye. ' ELSE text END AS text,
               cast(doc_id * 37 % 100 as double) / 100 AS no_speech_prob, 0 - cast(doc_id * 53 % 150 as double) / 100 AS avg_logprob
        FROM documents""",
    "fx_translations": """
        SELECT doc_id AS session_id, cast(0 as bigint) AS chunk_id, CASE WHEN doc_id % 6 = 0 THEN 'hi' ELSE lang END AS language,
               'opus-mt' AS backend, text AS source_text, text AS translated_text FROM documents
        UNION ALL
        SELECT doc_id, 0, CASE WHEN doc_id % 6 = 0 THEN 'hi' ELSE lang END, 'nllb-200', text,
               CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN text || ' ' || text || ' ' || text || ' ' || text ELSE text || ' ' || lang END FROM documents""",
    "fx_transcripts": """
        SELECT l_orderkey AS session_id, l_suppkey % 7 AS tenant_id, cast(l_linenumber as int) AS chunk_id, l_returnflag AS language,
               'part ' || @text(l_partkey) AS source_text,
               CASE WHEN l_linestatus = 'F' THEN 'teil ' || @text(l_partkey) END AS translated_text,
               l_quantity AS t_audio_start, l_quantity + 20 * l_tax - 1 AS t_audio_end, (l_discount + 0.0) AS latency_s,
               CASE WHEN l_suppkey % 2 = 0 THEN 'clause' ELSE 'final' END AS commit_reason, l_tax > 0.05 AS revised,
               cast(round(l_extendedprice * 100) as bigint) AS version
        FROM lineitem""",
    "fx_stored": """
        SELECT conv_id AS session_id, turn AS chunk_id, 'fr' AS language, text AS source_text FROM conversations
        UNION ALL
        SELECT conv_id, turn, 'ar', text FROM conversations WHERE turn % 2 = 0""",
    "fx_refs": "SELECT conv_id AS session_id, text FROM conversations WHERE turn = 0",
    "fx_chunks": """
        SELECT conv_id AS session_id, turn AS chunk_id, text, cast(turn as double) AS t_audio_start,
               CASE WHEN turn % 4 = 2 THEN turn + cast(0.5 as double) ELSE turn + cast(1.0 as double) END AS t_audio_end,
               CASE @size(toks) % 5 WHEN 0 THEN 'final' WHEN 1 THEN 'max_words' WHEN 2 THEN 'silence' ELSE 'clause' END AS reason,
               @size(toks) AS word_count, cast(turn as double) * 2 AS t_wall_committed, @size(toks) % 3 = 0 AS revised_after_commit
        FROM fx_words""",
    "fx_pcm": """
        SELECT conv_id AS session_id, turn AS seq, CASE turn % 2 WHEN 0 THEN 'fr' ELSE 'ar' END AS language,
               @bytes(text) AS pcm, CASE conv_id % 2 WHEN 0 THEN 16000 ELSE 22050 END AS sample_rate
        FROM conversations""",
    "fx_spoken": "SELECT l_orderkey AS session_id, l_returnflag AS language, l_quantity AS seconds FROM lineitem",
    "fx_said": "SELECT o_orderkey AS session_id, o_totalprice / 1000 AS seconds FROM orders",
    "fx_available": "SELECT o_orderkey AS session_id, cast(floor(o_totalprice / 100) as bigint) AS available FROM orders",
    "fx_pairs": """
        SELECT a.session_id AS pair_id, a.role AS role, a.toks AS reference, b.toks AS hypothesis
        FROM fx_words a JOIN fx_words b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "fx_loglines": """
        SELECT CASE WHEN doc_kind = 0 THEN @json('severity', 'INFO', 'message', 'chunk published', 'logger', 'obs', 'time', '2024-01-01T00:00:00.000Z',
                   'session_id', @text(session_id), 'chunk_id', chunk_id, 'language', language, 'glass_to_glass_s', audio_end_wall,
                   'slo_breach', audio_end_wall > 9, 'stage_chunker_s', d1, 'stage_tts_s', d3)
               WHEN doc_kind = 1 THEN @json('severity', 'ERROR', 'message', 'audio dropped', 'logger', 'flow', 'time', '2024-01-01T00:00:01.000Z', 'lag_s', d3)
               ELSE 'not json ' || language END AS value
        FROM (SELECT *, session_id % 3 AS doc_kind FROM fx_line)""",
}

#: Spark's own form of a view that reads its table once instead of once a branch.
ONE_SCAN = {
    "fx_marks": """
        SELECT session_id, chunk_id, language, seq, stage, t_wall FROM fx_line
        LATERAL VIEW stack(4, base, 'committed', audio_end_wall + d1, base + 1, 'translated', audio_end_wall + d1 + d2,
                           base + 2, 'tts_first_audio', audio_end_wall + d1 + d2 + d3,
                           base + 3, 'published', audio_end_wall + d1 + d2 + d3 + d4) m AS seq, stage, t_wall
        WHERE stage <> 'published' OR state <> 'O'""",
}


def _expand(sql: str, dialect: dict[str, str]) -> str:
    """Replace @name(args) innermost first."""
    while found := list(re.finditer(r"@(\w+)\(", sql)):
        # The last call in the text has no call inside it after its own start,
        # except in its arguments, which are expanded first by going backwards.
        name, begin = found[-1].group(1), found[-1].end()
        depth, args, start, at = 1, [], begin, begin
        while depth:
            depth += (sql[at] == "(") - (sql[at] == ")")
            if depth == 1 and sql[at] == "," and name in ("add_seconds", "head"):
                args.append(sql[start:at].strip())
                start = at + 1
            at += 1
        args.append(sql[start:at - 1].strip())
        text = dialect[name]
        for i, arg in enumerate(args):
            text = text.replace("{%d}" % i, arg)
        sql = sql[: found[-1].start()] + text + sql[at:]
    return sql


def _needs(name: str) -> list[str]:
    """Views a view reads, in order of definition."""
    return [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]


@cache
def _closure(names: tuple[str, ...]) -> tuple[str, ...]:
    wanted, queue = set(), list(names)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue.extend(_needs(name))
    return tuple(v for v in VIEWS if v in wanted)


def duck_with(sql: str) -> str:
    """`sql` with the CTEs for every fx_ view it mentions."""
    names = tuple(v for v in VIEWS if re.search(rf"\b{v}\b", sql))
    ctes = ",\n".join(f"{v} AS ({_expand(VIEWS[v], DUCK)})" for v in _closure(names))
    if not ctes:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n" + sql.lstrip()[len("WITH RECURSIVE"):]
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {ctes},\n" + sql.lstrip()[len("WITH"):]
    return f"WITH {ctes}\n{sql}"


def load(spark, sf_dir: str, name: str, stream: bool = False):
    """A driver table or an fx_ view as a DataFrame (or a streaming one)."""
    if name in TABLES and stream:
        # A stream reads a folder or a pattern. The table may be a file or a folder of files;
        # this pattern is for either, and for nothing else.
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # The text tables come as one row group, which is one task however
        # many cores there are. Deal such a small input out; a large one is
        # already split by its files.
        cores = spark.sparkContext.defaultParallelism
        if name in ("documents", "conversations") and df.rdd.getNumPartitions() * 4 <= cores:
            df = df.repartition(cores)
        return df
    sql, inputs = _expand(ONE_SCAN.get(name, VIEWS[name]), SPARK), {}
    for source in [*TABLES, *VIEWS]:
        if source != name and re.search(rf"(FROM|JOIN)\s+{source}\b", sql):
            sql = re.sub(rf"(FROM|JOIN)(\s+){source}\b", rf"\1\2{{{source}}}", sql)
            inputs[source] = load(spark, sf_dir, source, stream)
    return spark.sql(sql, **inputs)
