import struct
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasestream.sources import files, wav


def sound(n, seed=0):
    return np.random.default_rng(seed).integers(-30_000, 30_000, n).astype("<i2").tobytes()


def riff(pcm, rate=8000, *, code=1, channels=1, bits=16, length=None, before=b"", form=b"RIFF", fmt_more=b""):
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * 2, 2, bits) + fmt_more
    return (form + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt
            + b"data" + struct.pack("<I", len(pcm) if length is None else length) + pcm)


def put(folder, name, data):
    with open(f"{folder}/{name}", "wb") as out:
        out.write(data)


def read(spark, path, **options):
    rows = files.read_audio_frames(spark, path, **options).orderBy("session_id", "seq").collect()
    found = {}
    for r in rows:
        found.setdefault(r["session_id"].rsplit("/", 1)[1], []).append(r)
    return found


def test_long_files_are_read_in_parts_and_short_ones_share_a_task(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    pcm = sound(80_001)
    with wave.open(f"{folder}/long.wav", "wb") as out:
        out.setnchannels(1), out.setsampwidth(2), out.setframerate(8000)
        out.writeframes(pcm)
    for i in range(6):
        put(folder, f"short{i}.wav", riff(sound(900, i)))
    put(folder, "notes.txt", b"not sound")
    df = files.read_audio_frames(spark, folder, frame_ms=100, split_bytes=16_000)
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("session_id").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("frames")).collect()
    by_name = {r["session_id"].rsplit("/", 1)[1]: r for r in tasks}
    assert by_name["long"]["tasks"] == 11 and by_name["long"]["frames"] == 101 and len(by_name) == 7
    # Opening a file counts as a MB, so in production short files fill tasks; here two open parts are the limit.
    monkeypatch.setattr(wav, "OPEN_BYTES", 0)
    parts = wav.WavReader(folder, 100, 16_000).partitions()
    assert max(sum((s.end - s.first) * 1600 for s in p.spans) for p in parts) <= 16_000
    assert len(parts) < sum(len(p.spans) for p in parts)
    got = read(spark, folder, split_bytes=16_000)["long"]
    assert b"".join(bytes(r["pcm"]) for r in got) == pcm
    assert [r["seq"] for r in got] == list(range(101)) and len(got[-1]["pcm"]) == 2
    assert [r["t_audio"] for r in got] == [k * 800 / 8000 for k in range(101)] and {r["sample_rate"] for r in got} == {8000}


def test_headers_of_many_kinds(spark):
    folder, pcm = tempfile.mkdtemp(prefix="spark-"), sound(1000)
    put(folder, "listed.wav", riff(pcm, before=b"LIST" + struct.pack("<I", 5) + b"abcde\0"))
    put(folder, "open_end.wav", riff(pcm, length=0xFFFFFFFF))
    put(folder, "cut_off.wav", riff(pcm[:501], length=2000))
    put(folder, "more_behind.wav", riff(pcm) + b"LIST\x04\0\0\0abcd")
    put(folder, "long_form.wav", riff(pcm, length=0xFFFFFFFF, form=b"RF64", before=b"ds64" + struct.pack("<IQQQI", 28, 0, 1200, 600, 0)))
    put(folder, "extended.wav", riff(pcm, code=0xFFFE, fmt_more=struct.pack("<HHIH", 22, 16, 4, 1) + bytes(14)))
    put(folder, "empty.wav", riff(b""))
    got = {k: b"".join(bytes(r["pcm"]) for r in v) for k, v in read(spark, folder, frame_ms=30).items()}
    assert got == {"listed": pcm, "open_end": pcm, "cut_off": pcm[:500], "more_behind": pcm, "long_form": pcm[:1200], "extended": pcm}
    assert set(read(spark, f"file://{folder}/*e*_*.wav")) == {"open_end", "more_behind"}
    assert set(read(spark, f"{folder}/listed.wav")) == {"listed"}


@pytest.mark.parametrize("data,why", [
    (b"ID3\x03 this is not sound at all", "not a WAV"), (riff(b"", channels=2), "16-bit mono"), (riff(b"", bits=8), "16-bit mono"),
    (riff(b"", code=3), "16-bit mono"), (b"RIFF\0\0\0\0WAVE", "no sound"), (b"RIFF\0\0\0\0WAVEdata\0\0\0\0", "before its format")])
def test_files_that_are_not_pcm_fail(spark, data, why):
    folder = tempfile.mkdtemp(prefix="spark-")
    put(folder, "bad.wav", data)
    with pytest.raises(Exception, match=why):
        files.read_audio_frames(spark, folder).count()


def test_empty_folders_and_wrong_paths(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    assert files.read_audio_frames(spark, folder).count() == 0
    with pytest.raises(Exception, match="absent"):
        files.read_audio_frames(spark, f"{folder}/absent").count()
    with pytest.raises(Exception, match="above 0"):
        files.read_audio_frames(spark, folder, frame_ms=0).count()


def test_recordings_round_trip(spark):
    rows = [(s, k, sound(rng, s * 7 + k), 16000) for s in range(5) for k, rng in enumerate([1, 300, 0, 1000])]
    frames = spark.createDataFrame(rows, "session_id int, seq bigint, pcm binary, sample_rate int").repartition(7)
    folder = "file://" + tempfile.mkdtemp(prefix="spark-") + "/made"
    made = wav.write_recordings(frames, folder).collect()
    assert sorted((r["session_id"], r["bytes"]) for r in made) == [(s, 2602) for s in range(5)]
    got = read(spark, folder, split_bytes=700)
    assert {k: b"".join(bytes(r["pcm"]) for r in v) for k, v in got.items()} == {
        str(s): b"".join(r[2] for r in rows if r[0] == s) for s in range(5)}
    with wave.open(folder[7:] + "/3.wav") as f:
        assert (f.getnframes(), f.getframerate()) == (1301, 16000)


def test_recordings_are_whole_when_a_join_becomes_a_broadcast_one(spark):
    rows = [(s, k, sound(50, s * 100 + k), 16000) for s in range(6) for k in range(40)]
    folder = "file://" + tempfile.mkdtemp(prefix="spark-") + "/made"
    spark.createDataFrame(rows, "session_id int, seq bigint, pcm binary, sample_rate int").repartition(7).write.parquet(folder[:-4] + "frames")
    frames = spark.read.parquet(folder[:-4] + "frames")
    # As over a large table: joins are planned with sorts, and their small side is known only when it is there.
    set_conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4k",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in set_conf.items():
        spark.conf.set(name, value)
    try:
        made = wav.write_recordings(frames, folder).collect()
    finally:
        for name in set_conf:
            spark.conf.unset(name)
    assert sorted((r["session_id"], r["bytes"]) for r in made) == [(s, 4000) for s in range(6)]
    assert {k: b"".join(bytes(r["pcm"]) for r in v) for k, v in read(spark, folder).items()} == {
        str(s): b"".join(r[2] for r in rows if r[0] == s) for s in range(6)}


def test_frames_without_sound_add_nothing_to_a_recording(spark):
    rows = [(1, 0, b"ab", 8000), (1, 1, None, 8000), (1, 2, b"cd", 8000), (2, 0, None, 8000), (3, 0, b"", 8000)]
    folder = "file://" + tempfile.mkdtemp(prefix="spark-") + "/made"
    made = wav.write_recordings(spark.createDataFrame(rows, "session_id int, seq bigint, pcm binary, sample_rate int"), folder).collect()
    assert sorted((r["session_id"], r["bytes"]) for r in made) == [(1, 4), (3, 0)]
    assert [bytes(r["pcm"]) for r in read(spark, folder)["1"]] == [b"abcd"]
