import math
import random
import os
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasestream import schemas
from phrasestream.functions import text
from phrasestream.functions.audio import resample
from phrasestream.functions.wer import word_errors as count_errors
from phrasestream.operators import audio, chunking, flow, latency, ledger, quality, routing
from phrasestream.plans import fold, ordered
from phrasestream.plans.quantiles import exact_percentiles
from phrasestream.plans.stage import staged
from phrasestream.sources import files, transcripts
from tests import models


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- text ---------------------------------------------------------------------


def test_token_rules(spark):
    tokens = ["harbour.", "twice?", "splendid!", "जहाज।", "ashore,", "namely:", "therefore;", "سفينة،",
              "lanterns", "Prof.", "Jan.", "approx.", "Corp.", "Q.", "7.25", "9.", "-", "“But”", "Fußweg", "ﬂood", "ＵＮＴＩＬ", "పడవ", "he'd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    norm = text.normalise_token(F.col("t"))
    got = rows(df.select("i", norm.alias("n")).withColumn("t", F.col("n")), "i")
    assert [g[1] for g in got] == [models.norm(t) for t in tokens]
    strength = df.select("i", text.boundary_strength(F.col("t"), norm).alias("s"))
    assert [r[1] for r in rows(strength, "i")][:16] == [3, 3, 3, 3, 2, 2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0]
    weak = df.select("i", text.is_conjunction(norm).alias("c"))
    assert [tokens[r[0]] for r in rows(weak, "i") if r[1]] == ["therefore;", "“But”", "ＵＮＴＩＬ"]


def test_unicode_whitespace_and_blank_texts(spark):
    df = spark.createDataFrame([(0, " a b　c\x1fd \n"), (1, ""), (2, " \t "), (3, "-- x")], "i int, t string")
    got = rows(df.select("i", text.tokenise(F.col("t")), text.normalise_tokens(F.col("t"))), "i")
    assert [g[1] for g in got] == [["a", "b", "c", "d"], [], [], ["--", "x"]]
    assert [g[2] for g in got] == [["a", "b", "c", "d"], [], [], ["", "x"]]


# --- plans ----------------------------------------------------------------------


def test_running_and_neighbours_do_not_depend_on_the_cut(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), i, rng.choice([None, rng.randrange(50)])) for i in range(600)]
    df = spark.createDataFrame(data, "k int, seq bigint, v int")
    kinds = {n: (n, F.col("v")) for n in ("sum", "count", "max", "min", "first", "last")}
    around = {"back": lambda w: F.lag("v", 3).over(w), "mean": lambda w: F.sum("v").over(w.rowsBetween(-3, 0))}
    for inclusive in (True, False):
        whole = rows(ordered.running(df, ["k"], ["seq"], kinds, inclusive), "k", "seq")
        assert whole == rows(ordered.running(df, ["k"], ["seq"], kinds, inclusive, target_rows=23), "k", "seq")
    whole = rows(ordered.with_neighbours(df, ["k"], ["seq"], around, 3), "k", "seq")
    assert whole == rows(ordered.with_neighbours(df, ["k"], ["seq"], around, 3, target_rows=11), "k", "seq")
    ahead = {"next": lambda w: F.lead("v", 2).over(w)}
    whole = rows(ordered.with_neighbours(df, ["k"], ["seq"], ahead, 2, following=True), "k", "seq")
    assert whole == rows(ordered.with_neighbours(df, ["k"], ["seq"], ahead, 2, following=True, target_rows=11), "k", "seq")


def test_large_group_percentiles_are_exact(spark):
    rng = random.Random(2)
    data = [(k, round(rng.lognormvariate(0, 2), 3)) for k in range(3) for _ in range(400 * (k + 1))] + [(9, 1.5)]
    df = spark.createDataFrame(data, "k int, v double")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    small = rows(exact_percentiles(df, ["k"], "v", probs), "k")
    large = rows(exact_percentiles(df, ["k"], "v", probs, large_group=500), "k")
    assert [r[0] for r in small] == [r[0] for r in large] == [0, 1, 2, 9]
    assert np.allclose(np.array(small), np.array(large), rtol=0, atol=1e-12)


def test_pieces_of_a_long_key_are_folded_apart(spark):
    """The probed states normally contain the true one, so that a long session
    really is spread over tasks."""
    data = [("s", i, "push" if i % 3 else "drain", 0.05 * i, 0.1) for i in range(2000)]
    df = spark.createDataFrame(data, "session_id string, seq bigint, kind string, t_audio double, duration double")
    machine = flow.BacklogMachine(3.0, 1.0, 1.5)
    cut = ordered.cut_large_keys(df, ["session_id"], "seq", 400)
    linked = rows(fold._link(fold._probe(cut, "seq", machine), ["session_id"], machine), "_piece")
    assert [r[1] for r in linked] == [0, 1, 2, 3, 4] and all(r[3] for r in linked)


def test_pieces_of_unknown_states_are_probed_again(spark, monkeypatch):
    """A machine that names no states to try still has each piece folded by itself, from
    its true state; keys below the limit are folded as they are."""
    ddl = "session_id string, seq bigint, kind string, t_audio double, duration double"
    data = [(s, i, "push" if i % 3 else "drain", 0.05 * i, 0.1) for s, n in (("a", 900), ("b", 500), ("c", 90)) for i in range(n)]
    df = spark.createDataFrame(data, ddl)
    want = rows(flow.shed_backlog(df), "session_id", "seq")
    monkeypatch.setattr(flow.BacklogMachine, "candidates", lambda self, lane, rows: [])
    assert rows(flow.shed_backlog(df, target_rows=150), "session_id", "seq") == want
    cut = ordered.cut_large_keys(df, ["session_id"], "seq", 150)
    entries = rows(fold._entries(cut, "seq", flow.BacklogMachine(3.0, 1.0, 1.5)), "session_id", "_piece")
    assert [r[:2] for r in entries] == [("a", k) for k in range(6)] + [("b", k) for k in range(4)]
    sizes = cut.rows.groupBy("session_id", "_piece").count().collect()
    assert max(r["count"] for r in sizes) < 2 * 150


def test_many_keys_are_cut_without_a_cap(spark, monkeypatch):
    """Every key above the limit is cut, whatever its share; with many of them by a join."""
    monkeypatch.setattr(ordered, "BROADCAST_VALUES", 100)
    df = spark.range(12_000).select((F.col("id") % 40).alias("k"), F.col("id").alias("seq"), F.lit(1.0).alias("x"))
    cut = ordered.cut_large_keys(df, ["k"], "seq", 50)
    sizes = cut.rows.groupBy("k", "_piece").count().collect()
    assert len(sizes) == 40 * 6 and max(r["count"] for r in sizes) <= 100
    total = ordered.running(df, ["k"], ["seq"], {"n": ("count", F.col("x"))}, target_rows=50)
    assert total.filter("n <> floor(seq / 40) + 1").count() == 0
    plain = ordered.cut_large_keys(df, ["k"], "seq", 1000)
    assert not plain.any and plain.large.count() == 0 and "Join" not in plain.rows._jdf.queryExecution().optimizedPlan().toString()


# --- flow --------------------------------------------------------------------------

PUSHES = "session_id string, seq bigint, kind string, t_audio double, duration double"


@pytest.mark.parametrize("target", [200_000, 60])
def test_backlog_equals_the_model(spark, target):
    rng = random.Random(target)
    data = {s: [(i, rng.choices(["push", "drain"], [s + 2, 3])[0], round(0.1 * i, 3), 0.1) for i in range(400)] for s in range(4)}
    df = spark.createDataFrame([(str(s), *e) for s, es in data.items() for e in es], PUSHES)
    got = rows(flow.shed_backlog(df, target_rows=target), "session_id", "seq")
    want = [(str(s), *m) for s in data for m in models.backlog(data[s], 3.0, 1.0, 1.5)]
    assert [(g[0], g[1], *g[4:]) for g in got] == want


def test_backlog_cases(spark):
    fed = [("fed", i * 2 + k, kind, 0.1 * i, 0.1) for i in range(50) for k, kind in enumerate(("push", "drain"))]
    stuck = [("stuck", i, "push", 0.1 * i, 0.1) for i in range(200)]
    out = flow.shed_backlog(spark.createDataFrame(fed + stuck, PUSHES))
    by = {r.session_id: r for r in flow.backlog_summary(out).collect()}
    assert by["fed"].frames_dropped == 0 and by["fed"].frames_out == 50
    assert by["stuck"].frames_dropped > 0 and by["stuck"].shed_events < 20
    assert out.agg(F.max("lag_after_s")).first()[0] <= 3.0
    with pytest.raises(ValueError):
        flow.BacklogMachine(1.0, 1.0, 0.5)


def test_drift_cases(spark):
    depths = [1.5, 2.0, 3.0, 4.0, 5.0, 5.9, 6.0, 100.0, -3.0]
    df = spark.createDataFrame(
        [("s", lang, i, i, d, 1.0) for lang in ("fr", "ar", "xx") for i, d in enumerate(depths)],
        "session_id string, language string, seq bigint, chunk_id bigint, queue_depth_s double, seconds double")
    languages = spark.createDataFrame([("s", "fr"), ("s", "ar"), ("s", "de")], "session_id string, language string")
    policies = flow.resolve_policy(languages.select("language"))
    out = flow.drift_control(df, policies)
    fr = rows(out.filter("language = 'fr'").select("action", "speed", "queue_depth_s"))
    assert [f[0] for f in fr] == ["speak"] * 6 + ["skip", "skip", "speak"]
    speeds = [f[1] for f in fr[:6]]
    assert speeds[0] == 1.0 and speeds == sorted(speeds) and max(b - a for a, b in zip(speeds[1:5], speeds[2:5])) < 0.1
    assert fr[-1][2] == 0.0
    assert out.filter("language = 'xx' and (action <> 'speak' or speed <> 1.0)").count() == 0
    summary = {r.language: r for r in flow.drift_summary(out, languages).collect()}
    assert summary["de"].skipped_phrases == 0 and summary["fr"].skipped_seconds == 2.0


# --- latency ------------------------------------------------------------------------


def test_trace_cases(spark):
    marks = [("s", i, 0, "fr", st, t) for i, (st, t) in enumerate(
        [("committed", 1005.4), ("translated", 1005.6), ("translated", 1009.0), ("tts_first_audio", 1005.9), ("published", 1006.1)])]
    marks += [("s", 10, 1, "fr", "committed", 1000.2), ("s", 11, 2, "fr", "translated", 1000.3)]
    ends = spark.createDataFrame([("s", c, "fr", 1005.0 if c == 0 else 1000.0) for c in range(3)],
                                 "session_id string, chunk_id bigint, language string, audio_end_wall double")
    traces = latency.assemble_traces(spark.createDataFrame(marks, schemas.MARKS), ends).orderBy("chunk_id").collect()
    assert len(traces) == 2 and not traces[1].finished
    parts = [traces[0][f"stage_{p}_s"] for p in latency.PARTS]
    assert np.allclose(parts, [0.4, 0.2, 0.3, 0.2]) and math.isclose(sum(parts), traces[0].glass_to_glass_s)
    assert latency.dropped_marks(spark.createDataFrame(marks, schemas.MARKS)).agg(F.sum("dropped")).first()[0] == 1


def test_marks_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    marks = [(s, c, "fr", 10 * c + i, stage, float(c + i)) for s in range(3) for c in range(4)
             for i, stage in enumerate(("committed", "translated", "tts_first_audio", "published"))]
    columns = "session_id long, chunk_id long, language string, seq long, stage string, t_wall double"
    seen = spark.createDataFrame(marks, columns).mapInPandas(counted, columns)
    ends = spark.createDataFrame([(s, c, "fr", float(c)) for s in range(3) for c in range(4)],
                                 "session_id long, chunk_id long, language string, audio_end_wall double")
    medians = latency.running_latency_p50(latency.assemble_traces(seen, ends)).collect()
    assert len(medians) == 12 and {r.running_p50_s for r in medians} == {3.0}
    assert read.value == len(marks)


def test_latest_samples_and_median_survive_cutting(spark):
    rng = random.Random(3)
    ddl = "session_id string, chunk_id bigint, language string, published_seq bigint, glass_to_glass_s double, finished boolean"
    df = spark.createDataFrame([("s", i, "fr", i * 3, rng.random(), i % 7 != 0) for i in range(500)], ddl)
    newest = latency.latest_samples(df, 100)
    assert rows(newest, "chunk_id") == rows(latency.latest_samples(df, 100, target_rows=30), "chunk_id")
    assert newest.count() == 100 and newest.agg(F.max("chunk_id")).first()[0] == 499
    whole = rows(latency.running_latency_p50(df, 50), "chunk_id")
    assert whole == rows(latency.running_latency_p50(df, 50, target_rows=120), "chunk_id")
    values = [r.glass_to_glass_s for r in df.filter("finished").orderBy("chunk_id").collect()]
    assert math.isclose(whole[200][-1], float(np.percentile(values[151:201], 50)))


# --- quality --------------------------------------------------------------------------


def test_word_errors_equal_the_full_table(spark):
    rng = random.Random(4)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(0, 14))], [rng.choice("abcd") for _ in range(rng.randrange(0, 14))])
             for _ in range(500)]
    got = count_errors([p[0] for p in pairs], [p[1] for p in pairs])
    assert [tuple(g) for g in got] == [models.edits(*p) for p in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs[:60])], "pair_id bigint, reference array<string>, hypothesis array<string>")
    out = quality.word_errors(df).orderBy("pair_id").collect()
    assert [tuple(r)[1:5] for r in out] == [models.edits(*p) for p in pairs[:60]]


def test_one_pass_of_a_looped_session(spark):
    words = "the quick brown fox jumps over the lazy dog today".split()
    chunks = [("s", i, "fr", " ".join(words[(i * 5) % 10:(i * 5) % 10 + 5])) for i in range(6)]
    stored = spark.createDataFrame(chunks + [("s", 0, "de", "ignored")], "session_id string, chunk_id int, language string, source_text string")
    stored = stored.filter("language <> 'de'").unionByName(stored.filter("language = 'de'").withColumn("language", F.lit("zz")))
    refs = spark.createDataFrame([("s", " ".join(words))], "session_id string, text string")
    row = quality.score_sessions(stored, refs).collect()[0]
    assert (row.used, row.total, row.looped, row.distance) == (2, 6, True, 0)


def test_hallucination_cases(spark):
    # text, share of silence, log probability, whether it is kept: both limits of each rule from either side.
    cases = [("The ferry leaves at noon.", .85, -.6, False), ("The ferry leaves at noon.", .85, -.45, True), ("The ferry leaves at noon.", .75, -1.4, True),
             ("Bye.", .55, -.1, False), ("Bye.", .3, -.8, False), ("Bye.", .3, -.6, True), ("you", .1, -.75, False), ("See you at the pier", .6, -.9, True), ("\t", .1, -.1, False)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "segment_id bigint, text string, no_speech_prob double, avg_logprob double")
    assert [r.segment_id for r in quality.drop_hallucinations(df).orderBy("segment_id").collect()] == [i for i, c in enumerate(cases) if c[3]]


# --- audio -------------------------------------------------------------------------------


@pytest.mark.parametrize("target", [200_000, 70])
def test_utterances_equal_the_model(spark, target):
    rng = random.Random(5)
    data, loud = [], True
    for i in range(500):
        loud = loud if rng.random() < 0.9 else not loud
        hum = 150 <= i < 260  # too silent to recognise, too loud for quiet
        data.append((round(0.1 * i, 3), round(0.1 * i, 3), 0.1, 0.0055 if hum else 0.05 if loud else 0.001))
    df = spark.createDataFrame([("s", i, *f) for i, f in enumerate(data)], "session_id string, seq bigint, t_audio double, t_wall double, duration double, rms double")
    got = [r[1:] for r in rows(audio.utterances(df, max_s=3.0, target_rows=target), "utterance_id")]
    assert got == models.utterances(data, 0.7, 3.0, 0.005, 0.006, 1.0)
    assert not any(r[3] == "cap" and r[5] for r in got)


def test_levels_and_resampling(spark):
    tone = (8000 * np.sin(np.arange(2205) / 5)).astype("<i2").tobytes()
    assert len(resample(tone, 22050)) == 1600 and not resample(b"\0\0" * 100, 22050).any()
    assert 0.1 < float(np.sqrt(np.mean(resample(tone, 22050) ** 2))) < 0.5
    df = spark.createDataFrame([("s", 0, tone, 22050, 0.0, 0.0), ("q", 0, b"\0\0" * 2205, 22050, 0.0, 0.0)], schemas.FRAMES)
    verdicts = {r.session_id: r.verdict for r in audio.audio_levels(df, ["session_id"]).collect()}
    assert verdicts == {"s": "SPEECH", "q": "SILENT"}


def test_wav_frames(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with wave.open(f"{folder}/talk.wav", "wb") as out:
        out.setnchannels(1), out.setsampwidth(2), out.setframerate(16000)
        out.writeframes(b"\1\0" * 4000)
    got = rows(files.read_audio_frames(spark, folder).select(F.substring_index("session_id", "/", -1), "seq", F.octet_length("pcm"), "t_audio"), "seq")
    assert got == [("talk", 0, 3200, 0.0), ("talk", 1, 3200, 0.1), ("talk", 2, 1600, 0.2)]


# --- ledger and sources ---------------------------------------------------------------------


def test_tenant_is_mandatory(spark):
    with pytest.raises(ValueError):
        ledger.tenant_scope(spark.range(1).withColumn("tenant_id", F.lit("a")), " ")


def transcript_row(chunk, translated, tenant="t1", latency_s=1.24, source="hello"):
    return ("s1", tenant, chunk, "fr", source, translated, 0.0, 1.8, latency_s, "clause", False, None)


def test_transcript_log_upserts_isolates_and_compacts(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    make = lambda *r: spark.createDataFrame(list(r), schemas.TRANSCRIPTS)
    transcripts.write_batch(make(transcript_row(2, "deux"), transcript_row(0, "zero"), transcript_row(1, None)), f"{folder}/t", 0)
    for _ in range(2):  # a replayed batch replaces itself
        transcripts.write_batch(make(transcript_row(1, "un", latency_s=2.0, source="changed")), f"{folder}/t", 1)
    got = transcripts.read_transcripts(spark, f"{folder}/t", "t1").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.translated_text, r.source_text) for r in got] == [(0, "zero", "hello"), (1, "un", "hello"), (2, "deux", "hello")]
    assert transcripts.read_transcripts(spark, f"{folder}/t", "t2").count() == 0
    transcripts.compact(spark, f"{folder}/t", f"{folder}/t2")
    assert transcripts.read_transcripts(spark, f"{folder}/t2", "t1").count() == 3
    # A stream with a new checkpoint adds to the snapshot, also with its batch 0.
    make(transcript_row(2, "zwei", latency_s=3.0), transcript_row(7, "sept")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schemas.TRANSCRIPTS).parquet(f"{folder}/in")
    transcripts.transcript_sink(stream, f"{folder}/t2", f"{folder}/new-checkpoint").awaitTermination()
    got = transcripts.read_transcripts(spark, f"{folder}/t2", "t1").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.translated_text) for r in got] == [(0, "zero"), (1, "un"), (2, "zwei"), (7, "sept")]


def test_ledger_scan_is_pruned(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([transcript_row(0, "a"), transcript_row(0, "b", tenant="t2")], schemas.TRANSCRIPTS)
    files.write_ledger(df, folder, "transcripts")
    out = files.read_ledger(spark, folder, "transcripts", "t2")
    assert [r.translated_text for r in out.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(tenant_id" in out._jdf.queryExecution().toString()


def test_hypothesis_files_and_logs(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/talk.jsonl", "w") as out:
        out.write('{"text": "a b", "is_final": false, "t_audio_start": 0, "t_audio_end": 0.7, "t_wall": 100.0, "seq": 0}\n\n')
        out.write('{"text": "a b c", "is_final": true, "t_audio_start": 0, "t_audio_end": 1.05, "t_wall": 100.2, "seq": 1}\n')
    os.mkdir(f"{folder}/other")
    with open(f"{folder}/other/talk.jsonl", "w") as out:
        out.write('{"text": "no order"}\nnot json\n')
    hyps = files.read_hypotheses(spark, folder)
    assert rows(hyps.selectExpr("session_id LIKE '%/talk'", "seq", "is_final"), "seq") == [(True, 0, False), (True, 1, True)]
    bad = files.read_hypotheses(spark, f"{folder}/other")
    assert {r.corrupt for r in bad.collect()} == {'{"text": "no order"}', "not json"}
    both = hyps.unionByName(bad)
    assert both.select("session_id").distinct().count() == 2
    logs = tempfile.mkdtemp(prefix="spark-")
    with open(f"{logs}/app.log", "w") as out:
        out.write('{"severity": "INFO", "message": "chunk published", "logger": "x", "time": "2024-01-01T00:00:00.000Z", "chunk_id": 3, "language": "fr", "glass_to_glass_s": 1.1, "slo_breach": false, "stage_tts_s": 0.3}\nbroken\n')
    parsed = files.read_session_logs(spark, logs)
    assert parsed.filter("corrupt = 'broken'").count() == 1
    trace = files.traces_from_logs(parsed).collect()[0]
    assert (trace.chunk_id, trace.glass_to_glass_s, trace.stage_tts_s, trace.stages) == (3, 1.1, 0.3, {"stage_tts_s": 0.3})


def test_fanout_isolates_failures(spark):
    df = spark.createDataFrame([("s", i, "en", t, lang) for i, t in enumerate(["one", " ", "three"]) for lang in ("fr", "te", "hi")],
                               "session_id string, chunk_id bigint, source_language string, text string, language string")

    def good():
        return lambda texts, source, target: [f"{target}:{t}" for t in texts]

    def bad():
        raise RuntimeError("no model")

    out = routing.translate_fanout(df, {"opus-mt": good, "nllb-200": bad}).collect()
    by = {(r.chunk_id, r.language): (r.translated_text, r.error) for r in out}
    assert by[0, "fr"] == ("fr:one", None) and by[1, "fr"] == ("", None)
    assert by[0, "te"] == ("", "RuntimeError: no model")
    assert {r.language for r in routing.translate_fanout(df, {"opus-mt": good}).collect()} == {"fr"}
    assert {r.backend for r in routing.route_backend(df, {}).collect()} == {"opus-mt"}


def test_staged_tables_stay_in_the_shared_folder(spark):
    df = staged(spark.range(5), "numbers")
    assert spark.conf.get("spark.checkpoint.dir") + "/numbers-" in df.inputFiles()[0] and df.count() == 5


def test_pairs_are_resolved_most_specific_first(spark):
    pairs = [("en", "ta"), ("en", "te"), ("en", "fr"), ("fr", "te"), ("fr", "en"), ("en", "xx"), (None, "fr"), ("en", None)]
    df = spark.createDataFrame(pairs, "source_language string, language string")
    found = {(r[0], r[1]): tuple(r)[3:] for r in routing.resolve_models(df, models=["en-ta", "en-dra", "en-fr", "fr-dra"], routes={}).collect()}
    assert found[("en", "ta")] == ("en-ta", None, True)
    assert found[("en", "te")] == ("en-dra", ">>tel<<", True)
    assert found[("en", "fr")] == ("en-fr", None, True)
    for pair in [("fr", "te"), ("fr", "en"), ("en", "xx"), (None, "fr"), ("en", None)]:  # nothing is loaded for French
        assert found[pair] == (None, None, False), pair
    french = {(r[0], r[1]): r["model"] for r in routing.resolve_models(df, ["fr-dra"], {}, loaded_source="fr").collect()}
    assert french[("fr", "te")] == "fr-dra" and french[("en", "te")] is None
    routed = {(r[0], r[1]): tuple(r)[2:] for r in routing.resolve_models(df).collect()}
    assert routed[("en", "ta")] == ("nllb-200", "nllb-200", None, True) and routed[("en", "xx")] == ("opus-mt", None, None, False)
    assert not {r["language"] for r in routing.unsupported_pairs(df).collect()} & {"ta", "ml"}


def test_unsupported_targets_reach_no_translator(spark):
    asked = [("s", k, source, language, "one two") for k, (source, language) in enumerate([("en", "fr"), ("en", "it"), ("de", "fr"), ("en", "te")])]
    df = spark.createDataFrame(asked, "session_id string, chunk_id bigint, source_language string, language string, text string")

    def translator():
        def run(texts, source, target):
            assert (source, target) in {("en", "fr"), ("en", "te")}
            return [t.upper() for t in texts]
        return run

    out = routing.translate_fanout(df, {"opus-mt": translator, "nllb-200": translator}).collect()
    assert {(r.source_language, r.language, r.translated_text, r.error) for r in out} == {("en", "fr", "ONE TWO", None), ("en", "te", "ONE TWO", None)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fanout_holds_few_long_texts_at_a_time(spark):
    long = [(1, 0, "en", "fr", "a" * 3_000_000)] * 3
    df = spark.createDataFrame(long, "session_id long, chunk_id long, source_language string, language string, text string").coalesce(1)
    counting = lambda: lambda texts, source, target: [str(len(texts))] * len(texts)
    out = routing.translate_fanout(df, {"opus-mt": counting}).select("translated_text").collect()
    assert len(out) == 3 and max(int(r[0]) for r in out) < 3


def test_words_are_split_without_a_pattern_and_letters_counted_in_runs(spark):
    df = spark.createDataFrame([("hi", "a b\x1c c \n", "")], "language string, translated_text string, source_text string")
    words = df.select(text.tokenise(F.col("translated_text")).alias("t"))
    assert words.first().t == ["a", "b", "c"] and "split(translate(" in _plan(words)
    leak = quality.script_leak(df)
    assert r"\P{L}+" in _plan(leak) and leak.first().letters == 3


def test_clause_pieces_leave_the_task_as_rows(spark):
    df = spark.createDataFrame([(i, None if i == 1 else "one two three four, five") for i in range(200)], "doc_id long, text string")
    pieces = chunking.segment_clauses(df, "doc_id")
    assert "Generate" not in _plan(pieces)
    got = [tuple(r) for r in pieces.filter("doc_id in (0, 1)").orderBy("piece").collect()]
    assert got == [(0, 0, "one two three four,", 4), (0, 1, "five", 1)] and pieces.count() == 2 * 199
