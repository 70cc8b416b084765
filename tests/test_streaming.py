import random
import tempfile

import pytest
from pyspark.sql import functions as F

from phrasestream.fixed_values import STAGES
from phrasestream.operators import audio, chunking, flow, latency
from phrasestream.operators.audio import UtteranceMachine
from phrasestream.streaming import folds, live
from tests.test_chunking import DDL, random_session

# Kept off the epoch: a row at the initial watermark of 0 would count as late.
AT = "timestamp_millis(cast(round({} * 1000) as bigint) + 1000)"


def play(spark, batches, schema, build, time_expr, delay="0 seconds", mode="append", whole=False):
    """Feed lists of rows as separate files, one per micro-batch; returns rows."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/b{i:03d}")
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .option("latestFirst", False).parquet(f"{folder}/in")
        .withColumn("event_time", F.expr(AT.format(time_expr))).withWatermark("event_time", delay)
    )
    writer = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(f"{folder}/out")
        query.awaitTermination()
        out = spark.read.parquet(f"{folder}/out").collect()
        return (out, query, f"{folder}/ck") if whole else out
    last = {}
    query = writer.foreachBatch(lambda df, _: last.update({(r[0], r[1]): r[2] for r in df.collect()})).start()
    query.awaitTermination()
    return last


def in_batches(rows, count, flush):
    size = -(-len(rows) // count)
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]
    return [*parts, flush]


def test_phrases_stream_equals_batch_with_disorder(spark):
    rng = random.Random(4)
    rows = [r for s in range(3) for r in random_session(f"s{s}", rng, 40)]
    rows.sort(key=lambda r: r[6])
    for i in range(0, len(rows) - 4, 4):  # swap neighbours within the watermark
        rows[i], rows[i + 2] = rows[i + 2], rows[i]
    flush = [("flush", 0, "", False, 0.0, 0.0, 9000.0)]
    cfg = chunking.ChunkerConfig(max_words=9)
    got = play(spark, in_batches(rows, 4, flush), DDL, lambda s: folds.commit_phrases_stream(s, cfg), "t_wall", "20 seconds")
    want = chunking.commit_phrases(spark.createDataFrame(rows, DDL), cfg, silence=True, at_end="silence").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_backlog_stream_equals_batch(spark):
    rng = random.Random(8)
    ddl = "session_id string, seq bigint, kind string, t_audio double, duration double"
    rows = [(f"s{i % 3}", i, "drain" if rng.random() < 0.3 else "push", round(0.04 * i, 3), 0.1) for i in range(240)]
    flush = [("flush", 0, "push", 500.0, 0.1)]
    got = play(spark, in_batches(rows, 4, flush), ddl, folds.shed_backlog_stream, "t_audio")
    want = flow.shed_backlog(spark.createDataFrame(rows, ddl)).collect()
    assert sorted(tuple(r) for r in got if r.session_id != "flush") == sorted(map(tuple, want))


def test_utterances_stream_equals_batch(spark):
    rng = random.Random(6)
    ddl = "session_id string, seq bigint, t_audio double, t_wall double, duration double, rms double"
    rows = [(f"s{i % 2}", i, round(0.05 * i, 3), round(0.05 * i, 3), 0.1, rng.choice([0.001, 0.001, 0.02])) for i in range(200)]
    flush = [("flush", 0, 500.0, 500.0, 0.1, 0.1)]
    machine = UtteranceMachine(0.3, 2.0, 0.005, 0.006, 1.0)
    got = play(spark, in_batches(rows, 3, flush), ddl, lambda s: folds.utterances_stream(s, machine), "t_audio")
    want = audio.utterances(spark.createDataFrame(rows, ddl), 0.3, 2.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_traces_stream_equals_batch(spark):
    rng = random.Random(1)
    ddl = "session_id string, seq bigint, chunk_id bigint, language string, stage string, t_wall double, audio_end_wall double"
    rows, seq = [], 0
    for chunk in range(12):
        for language in ("fr", "ar"):
            stages = ["translated", "committed", "committed", "translated", "tts_first_audio", "published", "translated"]
            for k, stage in enumerate(stages[: rng.choice([3, 4, 5, 6, 7])]):
                rows.append(("s", seq, chunk, language, stage, round(100 + 0.2 * chunk + 0.01 * k, 3), 100.0 + 0.2 * chunk))
                seq += 1
    flush = [("flush", 0, 0, "fr", "translated", 500.0, 500.0)]
    got = play(spark, in_batches(rows, 3, flush), ddl, lambda s: live.assemble_traces_stream(s, 30.0), "t_wall", "10 seconds")
    df = spark.createDataFrame(rows, ddl)
    ends = df.select("session_id", "chunk_id", "language", "audio_end_wall").distinct()
    want = latency.assemble_traces(df, ends).collect()
    order = lambda rs: sorted(map(lambda r: tuple(str(v) for v in r), rs))
    assert order(got) == order(want)


def test_traces_of_marks_that_stay_together(spark):
    """Rows with the marks of all stages of a chunk, some of them missing, out of order, of one
    seq, or mixed with those of another row of the chunk; in a third of the state of single marks."""
    folds.use_rocksdb(spark)
    rng = random.Random(5)
    ddl = "session_id bigint, chunk_id bigint, language string, audio_end_wall double, t double, " + ", ".join(f"{s}_seq bigint, {s} double" for s in STAGES)
    rows, marks = [], []
    for k in range(600):
        session, chunk, base = rng.randrange(40), rng.randrange(9), 2**53 + 1 + 3 * rng.randrange(400)
        seqs = [base + i for i in range(4)] if rng.random() < 0.7 else [base + rng.randrange(4) for _ in STAGES]
        seqs = [s if rng.random() < 0.85 else None for s in seqs]
        walls = [float(rng.randrange(90)) for _ in STAGES]
        rows.append((session, chunk, "fr", 3.0 * chunk, 1.0, *[x for pair in zip(seqs, walls) for x in pair]))
        marks += [(session, s, chunk, "fr", stage, w, 3.0 * chunk, 1.0) for s, stage, w in zip(seqs, STAGES, walls) if s is not None]
    single = "session_id bigint, seq bigint, chunk_id bigint, language string, stage string, t_wall double, audio_end_wall double, t double"
    want = latency.assemble_traces(*[spark.createDataFrame(marks, single).select(*c).distinct() for c in (
        ["session_id", "seq", "chunk_id", "language", "stage", "t_wall"], ["session_id", "chunk_id", "language", "audio_end_wall"])]).collect()
    order = lambda rs: sorted(map(lambda r: tuple(str(v) for v in r), rs))
    waiting = {}
    for name, table, schema, flush in (("together", rows, ddl, (-1, 0, "fr", 0.0, 99.0, *[None] * 8)), ("single", marks, single, (-1, 0, 0, "fr", "translated", 0.0, 0.0, 99.0))):
        build = lambda s: live.assemble_traces_stream(s, 30.0, shards=2)  # noqa: B023, E731
        got, _, checkpoint = play(spark, [table, [flush]], schema, build, "t", whole=True)
        assert order(got) == order(want)
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").option("batchId", 0).load()
        waiting[name] = state.selectExpr("sum(octet_length(user_map_value.rows)) AS n").first().n
    assert waiting["together"] < waiting["single"] and waiting["single"] < 40 * len(marks)


def test_watchdog_stream_equals_batch(spark):
    rng = random.Random(7)
    ddl = "session_id string, t_wall double, started_at double"
    rows, starts = [], []
    for s in range(4):
        t = started = 10.0 * s
        starts.append((f"s{s}", started))
        for _ in range(40):
            t += rng.choice([3.0, 8.0, 20.0, 70.0 if s % 2 else 5.0])
            rows.append((f"s{s}", t, started))
    rows.sort(key=lambda r: r[1])
    flush = [("flush", 90000.0, 90000.0)]
    build = lambda s: live.session_watchdog_stream(s, 300.0, 60.0)
    got = [r for r in play(spark, in_batches(rows, 3, flush), ddl, build, "t_wall") if r.session_id != "flush"]
    df = spark.createDataFrame(rows, ddl)
    want = flow.session_watchdog(df, spark.createDataFrame(starts, "session_id string, started_at double"), 300.0, 60.0).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_windows_burst_equals_trickle(spark):
    ddl = "session_id string, seq bigint, frames bigint, t double"
    trickle = [("t", i, 7, 0.1 * i) for i in range(60)]
    burst = [("b", 0, 420, 0.0)]
    flush = [("flush", 0, 1, 500.0)]
    got = play(spark, in_batches(trickle + burst, 1, flush), ddl, live.context_windows_stream, "t")
    batch = audio.context_windows(spark.createDataFrame([("t", 420), ("b", 420)], "session_id string, available bigint")).collect()
    assert sorted(tuple(r) for r in got if r.session_id != "flush") == sorted(map(tuple, batch))


def test_anchor_is_set_once(spark):
    ddl = "session_id string, seq bigint, t_audio double, t_wall double"
    rows = [("s", 0, 5.0, 105.0), ("s", 1, 6.0, 120.0), ("s", 2, 7.0, 107.0)]
    got = play(spark, [rows, [("flush", 0, 0.0, 900.0)]], ddl, live.anchor_clock_stream, "t_wall", "60 seconds")
    assert sorted(r.wall for r in got if r.session_id == "s") == [105.0, 106.0, 107.0]


def test_listeners_stream(spark):
    ddl = "session_id string, language string, listener_id string, kind string, t double"
    rows = [("s", "fr", f"l{i}", "join", float(i)) for i in range(3)] + [("s", "ar", "l9", "join", 4.0)]
    leaves = [("s", "ar", "l9", "leave", 5.0), ("s", "ar", "l9", "leave", 6.0)]
    last = play(spark, [rows, leaves], ddl, live.active_listeners_stream, "t", "10 minutes", mode="update")
    assert last == {("s", "fr"): 3, ("s", "ar"): 0}


@pytest.mark.parametrize("active", [True, False])
def test_tenant_lookup_stream(spark, active):
    folder = tempfile.mkdtemp(prefix="spark-")
    from phrasestream import schemas

    spark.createDataFrame([("t1", "acme", "acme", "Acme", active, None)], schemas.TENANTS).write.parquet(f"{folder}/tenants")
    ddl = "tenant_id string, n int, t double"
    accepted = play(spark, [[("t1", 1, 0.0), ("t2", 2, 0.0)]], ddl, lambda s: live.tenant_lookup_stream(s, f"{folder}/tenants")[0], "t")
    assert [r.n for r in accepted] == ([1] if active else [])


# --- the end of sessions --------------------------------------------------------------------------

BEATS = "session_id string, seq bigint, kind string, t_audio double, duration double, over boolean"


def state_rows(spark, checkpoint):
    """Sessions that still have a fold, waiting rows or timers in the state store."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    keys = {r["k"] for name in ("fold", "waiting") for r in read(name).selectExpr("key.session_id AS k").collect()}
    timers = spark.read.format("statestore").option("path", checkpoint).option("readRegisteredTimers", True).load()
    return keys | {r["k"] for r in timers.selectExpr("key.session_id AS k").collect()}


def pushes(session, start, n, over_at=None):
    return [(session, i, "push", start + 0.1 * i, 0.1, i == over_at) for i in range(n)]


def test_state_of_ended_sessions_goes(spark):
    folds.use_rocksdb(spark)
    rows = [r for s in range(8) for r in pushes(f"s{s}", 10.0 * s, 12)]
    flush = [[("flush1", 0, "push", 300.0, 0.1, False)], [("flush2", 0, "push", 600.0, 0.1, False)], [("flush3", 0, "push", 602.0, 0.1, False)]]
    build = lambda s: folds.shed_backlog_stream(s, expire_s=60.0)
    got, query, checkpoint = play(spark, [rows[:50], rows[50:], *flush], BEATS, build, "t_audio", whole=True)
    want = flow.shed_backlog(spark.createDataFrame(rows, BEATS)).collect()
    assert sorted(tuple(r) for r in got if r.session_id[0] == "s") == sorted(map(tuple, want))
    assert state_rows(spark, checkpoint) <= {"flush2", "flush3"}
    counts = folds.counts_of(query)
    assert counts["state_rows"] < counts["most_state_rows"] and counts["late_rows"] == 0


def test_a_row_ends_its_session_and_a_later_one_begins_another(spark):
    rows = sorted(pushes("a", 0.0, 30, over_at=19) + pushes("b", 0.0, 30), key=lambda r: r[3])
    flush = [("flush", 0, "push", 100.0, 0.1, False)]
    build = lambda s: folds.shed_backlog_stream(s, ends="over", expire_s=1e6)
    got, _, checkpoint = play(spark, in_batches(rows, 3, flush), BEATS, build, "t_audio", whole=True)
    parts = [("a1", *r[1:]) if r[1] < 20 else ("a2", *r[1:]) for r in rows if r[0] == "a"]
    want = flow.shed_backlog(spark.createDataFrame(parts + [r for r in rows if r[0] == "b"], BEATS)).collect()
    assert sorted((r[0], *r[1:]) for r in got) == sorted((r[0][0], *r[1:]) for r in want)
    assert state_rows(spark, checkpoint) == {"a", "b", "flush"}


def test_every_stream_lets_go(spark):
    """Each operator's state of a session is gone once the session has expired."""
    folds.use_rocksdb(spark)
    rng = random.Random(3)
    plays = [
        (DDL, [r for s in range(3) for r in random_session(f"s{s}", rng, 20)], lambda at: ("f", 0, "", False, 0.0, 0.0, at), "t_wall",
         lambda s: folds.commit_phrases_stream(s, expire_s=30.0)),
        ("session_id string, seq bigint, t_audio double, t_wall double", [("s", i, float(i), 50.0 + i) for i in range(9)],
         lambda at: ("f", 0, 0.0, at), "t_wall", lambda s: live.anchor_clock_stream(s, expire_s=30.0)),
        ("session_id string, seq bigint, chunk_id bigint, language string, stage string, t_wall double, audio_end_wall double",
         [("s", i, i // 2, "fr", "committed" if i % 2 == 0 else "published", 1.0 + i, 1.0) for i in range(9)],
         lambda at: ("f", 0, 0, "fr", "translated", at, at), "t_wall", lambda s: live.assemble_traces_stream(s, 20.0, expire_s=30.0)),
        ("session_id string, t_wall double, started_at double", [("s", float(t), 0.0) for t in range(9)], lambda at: ("f", at, at), "t_wall",
         lambda s: live.session_watchdog_stream(s, 100.0, 20.0, expire_s=30.0)),
    ]
    for ddl, rows, marker, clock, build in plays:
        last = max(r[[c.split()[0] for c in ddl.split(", ")].index(clock)] for r in rows)
        ends = [[marker(last + t)] for t in (1000.0, 2000.0, 2001.0)]
        _, _, checkpoint = play(spark, [rows, *ends], ddl, build, clock, whole=True)
        left = state_rows(spark, checkpoint)
        assert not {k for k in left if k.startswith("s")}, (clock, left)


def test_late_rows_are_counted(spark):
    early = pushes("a", 100.0, 20)
    late = pushes("a", 10.0, 7) + pushes("late", 20.0, 4)
    counters = folds.StreamCounters()
    build = lambda s: folds.shed_backlog_stream(s, expire_s=1e6)
    _, query, _ = play(spark, [early, [("flush", 0, "push", 150.0, 0.1, False)], late, [("flush", 1, "push", 160.0, 0.1, False)]], BEATS, build, "t_audio", whole=True)
    assert folds.counts_of(query)["late_rows"] == 11
    for progress in query.recentProgress:
        counters.onQueryProgress(type("Event", (), {"progress": progress})())
    assert counters.counts[str(query.id)]["late_rows"] == 11


# --- T9, J4 ---------------------------------------------------------------------------------------


def test_listeners_over_time_stream_equals_batch(spark):
    from phrasestream.operators import ledger

    rng = random.Random(5)
    ddl = "session_id string, language string, listener_id string, kind string, t_event double"
    rows = []
    for i in range(80):
        who = (f"s{i % 2}", rng.choice(["fr", "ar"]), f"l{i}")
        at = float(rng.randrange(40))
        rows += [(*who, "join", at + k) for k in range(rng.choice([1, 1, 2]))]
        rows += [(*who, "leave", at + rng.randrange(1, 9) + k) for k in range(rng.choice([0, 1, 2]))]
    rng.shuffle(rows)
    flush = [("flush", "fr", "x", "join", 500.0)]
    got = play(spark, in_batches(rows, 3, flush), ddl, live.listeners_over_time_stream, "t_event", "60 seconds")
    want = ledger.listeners_over_time(spark.createDataFrame(rows, ddl)).select(*got[0].__fields__).collect()
    assert sorted(tuple(r) for r in got if r.session_id != "flush") == sorted(map(tuple, want))


def cached(requests, entries, ttl):
    """Plain form: one copy a tenant, taken anew when it is `ttl` old."""
    held, out = {}, []
    for t, tenant, request in sorted(requests):
        copy = held.get(tenant)
        if copy is None or t - copy[0] >= ttl:
            known = [e for e in sorted(entries, key=lambda e: e[4]) if e[0] == tenant and e[4] <= t]
            reason = "unknown tenant" if not known else "unsafe schema name" if known[-1][2] != known[-1][2].lower() else None
            if reason:
                held.pop(tenant, None)
                out.append((tenant, request, None, None, False, reason, None))
                continue
            copy = held[tenant] = (t, known[-1])
        _, slug, schema, active, _ = copy[1]
        out.append((tenant, request, slug, schema, active, None if active else "inactive tenant", copy[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 4])
def test_a_tenant_switched_off_is_refused_when_its_copy_is_old(spark, shards):
    rng = random.Random(9)
    entries = [("a", "acme", "acme", True, 0.0), ("a", "acme", "acme", False, 400.0), ("b", "bolt", "Bolt", True, 0.0), ("b", "bolt", "bolt", True, 900.0)]
    requests = [(float(t) + 0.25, rng.choice("abc"), n) for n, t in enumerate(sorted(rng.sample(range(2000), 150)))]
    if shards == 1:
        requests = [(t, w, n) for t, w, n in requests if w != "a" or t > 800] + [(110.0, "a", 900), (409.0, "a", 901), (410.0, "a", 902), (709.5, "a", 903), (710.5, "a", 904)]
    ddl = "kind string, tenant_id string, request_id bigint, slug string, schema_name string, is_active boolean, t double"
    rows = [("e", e[0], None, *e[1:4], e[4]) for e in entries] + [("r", w, n, None, None, None, t) for t, w, n in requests]
    rng.shuffle(rows)
    flush = [("r", "flush", -1, None, None, None, 99_000.0)]

    def build(stream):
        return live.tenant_cache_stream(stream.filter("kind = 'r'"), stream.filter("kind = 'e'"), shards=shards)

    got = sorted((tuple(r) for r in play(spark, in_batches(rows, 3, flush), ddl, build, "t", "1 hour") if r.tenant_id != "flush"), key=str)
    if shards == 1:
        assert got == cached(requests, entries, 300.0)
        by_id = {r[1]: r for r in got}
        assert by_id[901][4] and by_id[901][6] == 110.0          # switched off at 400, but the copy is 299 s old
        assert not by_id[902][4] and by_id[902][5] == "inactive tenant"  # 300 s old: taken anew
    else:
        assert len(got) == len(requests)
        assert not any(r[4] for r in got if r[0] == "a" and r[6] is not None and r[6] >= 400.0)
        assert all(r[4] for r in got if r[0] == "a" and r[6] is not None and r[6] < 400.0)
