"""Registered queries beside their SQL, on small tables that were too much for them."""

import random
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import registry
from checks.compare import compare
from checks.views import load
from phrasestream.functions import text
from phrasestream.operators import audio, flow
from phrasestream.streaming import folds, live
from tests.test_streaming import play


def beside_sql(spark, name, **tables):
    """What differs between a query and its SQL over these tables (as SQL)."""
    folder, con = tempfile.mkdtemp(prefix="spark-"), duckdb.connect()
    tables.setdefault("nation", "SELECT 0 AS n_nationkey, 'ALGERIA' AS n_name, 0 AS n_regionkey")
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return compare(spark, con, folder, registry.QUERIES[name], registry.SQL[name])[0]


def events(*rows):
    values = ", ".join(f"({e}::bigint, TIMESTAMP '2024-01-01', {u}::bigint, '{k}', {v}::double)" for e, u, k, v in rows)
    return f"SELECT * FROM (VALUES {values}) AS t(event_id, ts, user_id, event_type, value)"


@pytest.mark.parametrize("flush", [True, False])
def test_frames_meet_the_windows_that_cover_them(spark, flush):
    rng = random.Random(2)
    available = spark.createDataFrame([(i, rng.randrange(0, 400)) for i in range(40)], "session_id int, available bigint")
    frames = spark.createDataFrame([(i, f) for i in range(42) for f in rng.sample(range(420), 60)], "session_id int, frame int")
    for chunk, shift, cache in (((56, 56), (56, 56), (0, 8)), ((56, 60), (40, 40), (0, 8)), ((30, 90), (20, 70), (5, 33))):
        got = audio.covering_windows(available, frames, chunk, shift, cache, 1, flush)
        windows = audio.context_windows(available, chunk, shift, cache, 1, flush)
        want = windows.join(frames, "session_id").filter("frame >= cache_start and frame < end").select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recordings_of_conversations_of_many_turns(spark):
    talk = "SELECT c::bigint AS conv_id, t::bigint AS turn, 'user' AS role, 'turn ' || t || ' of ' || c AS text FROM range(0, 3) a(c), range(0, 1100) b(t)"
    assert not beside_sql(spark, "s4_read_audio_frames", conversations=talk)


def test_boundaries_of_documents_without_words_and_of_repeated_ids(spark):
    texts = [(1, "''"), (2, "NULL"), (3, "' \n '"), (4, "'one two.'"), (5, "'a b c d e, f and g'"), (5, "'a b c d e f and g'"), (5, "'h'"),
             (6, "'a b c d e f and g'"), (6, "'a b c d and e'"), (7, "'a b'"), (7, "'c d'"), ("NULL", "'a b c done.'")]
    docs = "SELECT * FROM (VALUES " + ", ".join(f"({i}::bigint, {t}::varchar)" for i, t in texts) + ") AS t(doc_id, text)"
    assert not beside_sql(spark, "p6_find_boundary", documents=docs)
    rows = spark.sql(docs.replace("::varchar", "::string")).withColumn("t", text.tokenise(F.col("text"))).withColumn("n", text.normalise_tokens(F.col("text")))
    cuts = {weak: sorted(r[0] for r in rows.select(text.find_boundary(F.col("t"), F.col("n"), F.lit(4), F.lit(weak))).collect()) for weak in (True, False)}
    assert cuts == {True: [0] * 7 + [4, 4, 5, 6, 6], False: [0] * 10 + [4, 5]}


def test_a_stream_reads_a_table_of_one_file_or_of_many(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.range(10).coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.range(10, 30).repartition(3).write.mode("append").parquet(f"{folder}/events.parquet")
    duckdb.sql(f"COPY (SELECT range AS id FROM range(7)) TO '{folder}/orders.parquet'")
    for table, rows in (("events", 30), ("orders", 7)):
        query = load(spark, folder, table, stream=True).writeStream.format("parquet").option("path", f"{folder}/out-{table}").option(
            "checkpointLocation", f"{folder}/ck-{table}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(f"{folder}/out-{table}").count() == rows


# Sessions start at their user_id and have a beat every 8 s an event_id counts: 5000 begins
# after four beats and has a long pause before its start, 700 one across it, 3 is plain.
BEATS = events((0, 5000, "view", 1), (2, 700, "view", 1), (100, 700, "view", 1), (9, 3, "view", 1), (500, 5000, "view", 1),
               (510, 5000, "view", 1), (612, 5000, "view", 1), (715, 5000, "view", 1), (620, 4000, "view", 1), (400, 4000, "view", 1))


def test_beats_from_before_a_start_as_the_sql_has_them(spark):
    assert not beside_sql(spark, "t8_session_watchdog", events=BEATS)


def test_beats_from_before_a_start_on_a_stream(spark):
    assert not beside_sql(spark, "t8_session_watchdog_stream", events=BEATS)


def test_listeners_of_far_apart_events_and_of_close_ones(spark):
    # The second pair leaves within a microsecond, the later joiner first.
    far = events((1, 7, "view", 1.5), (3_000_000, 7, "view", 25.0), (5_000_000, 7, "view", 1.5),
                 (9, 8, "view", 22.0000002), (10, 8, "view", 21.0000001))
    assert not beside_sql(spark, "t9_listeners_over_time_stream", events=far)


def test_passes_are_rounded_as_sql_does(spark):
    passes = spark.createDataFrame([("s", 0, 4.0, 2.0), ("s", 1, 211.35 / 10, 41.3)], "session_id string, seq bigint, elapsed_s double, window_s double")
    assert flow.unsustainable_passes(passes, 3.0).first().pass_cost_s == 21.14


def test_sessions_that_share_their_state(spark):
    """Streams with and without shards give the same rows, over several micro-batches, and
    in chunks that are read and written in part."""
    rng = random.Random(12)
    ddl = "session_id string, seq bigint, kind string, t_audio double, duration double"
    rows = [(f"s{rng.randrange(30)}", i, rng.choice(["push", "push", "drain"]), round(0.05 * i, 3), 0.1) for i in range(400)]
    rows.sort(key=lambda r: r[3] + rng.random())  # out of order, within the delay
    batches = [rows[:150], rows[150:290], rows[290:], [("flush", 0, "push", 900.0, 0.1)], [("flush", 1, "push", 910.0, 0.1)]]
    out = {}
    for shards in (None, 3):
        build = lambda s: folds.shed_backlog_stream(s, expire_s=60.0, shards=shards)  # noqa: B023, E731
        got = play(spark, batches, ddl, build, "t_audio", "2 seconds")
        out[shards] = sorted(tuple(r) for r in got if r.session_id != "flush")
    want = flow.shed_backlog(spark.createDataFrame(rows, ddl)).collect()
    assert out[3] == out[None] == sorted(map(tuple, want))


def test_quiet_sessions_of_one_shard_end_one_by_one(spark):
    ddl = "session_id string, seq bigint, frames bigint, t double"
    rows = [(f"s{i}", k, 30, 2.0 * i + 0.1 * k) for i in range(20) for k in range(4)]
    rows.sort(key=lambda r: r[3])
    batches = [rows[:30], rows[30:50], rows[50:], [("flush", 0, 1, 500.0)], [("flush", 1, 1, 502.0)]]
    got = play(spark, batches, ddl, lambda s: live.context_windows_stream(s, idle_s=3.0, shards=2), "t")
    want = audio.context_windows(spark.createDataFrame([(f"s{i}", 120) for i in range(20)], "session_id string, available bigint"))
    assert sorted(tuple(r) for r in got if r.session_id != "flush") == sorted(map(tuple, want.collect()))


def test_traces_of_lines_of_one_seq_and_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(folds, "PIECE_ROWS", 100, raising=False)
    rng = random.Random(9)
    rows = ", ".join(f"({rng.randrange(20)}::bigint, {rng.randrange(1, 4)}, '{rng.choice('AN')}', '{rng.choice('FO')}', {rng.choice(['10.0', '10.01', '20.0'])}::double, "
                     f"{rng.randrange(11) / 100}::double, {rng.randrange(9) / 100}::double, {rng.randrange(1, 51)}.0::double)" for _ in range(700))
    lines = f"SELECT * FROM (VALUES {rows}) AS t(l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_extendedprice, l_discount, l_tax, l_quantity)"
    assert not beside_sql(spark, "t4_assemble_traces_stream", lineitem=lines)
