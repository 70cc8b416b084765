"""Readers for hypothesis files, logs, audio, the ledger and reference texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasestream import schemas
from phrasestream.functions.text import tokenise
from phrasestream.operators.ledger import tenant_scope
from phrasestream.operators.latency import PARTS
from phrasestream.sources import wav


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def _session_from_path(column: str = "_metadata.file_path"):
    """The whole path without its ending: files of one name in two folders differ."""
    return F.regexp_replace(F.col(column), r"\.[^./]*$", "")


def read_hypotheses(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines, one hypothesis each. Blank lines are skipped. Files
    without session_id take the file's path, one recording per file. A line that
    cannot be read, or has no text or seq, is kept whole in `corrupt`; readers of
    hypotheses filter on its absence."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    lines = _reader(spark, stream).text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", schemas.HYPOTHESES + ", corrupt string", options).alias("h"),
        "value", _session_from_path().alias("_path"))
    bad = F.col("h.corrupt").isNotNull() | F.col("h.text").isNull() | F.col("h.seq").isNull()
    return parsed.select("h.*", "_path", "value", bad.alias("_bad")).withColumns({
        "session_id": F.coalesce("session_id", "_path"),
        "corrupt": F.when(F.col("_bad"), F.col("value")),
    }).drop("_path", "value", "_bad")


def read_session_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON log lines with open extra fields at the top level. `extras`
    has them as strings; unreadable lines are kept in `corrupt`."""
    return parse_log_lines(_reader(spark, stream).text(path))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """S2 on a `value` column of lines."""
    fixed = "severity string, message string, logger string, time string, exception string, corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", fixed, options).alias("f"),
        F.from_json("value", "map<string,string>").alias("all"),
    )
    known = ["severity", "message", "logger", "time", "exception"]
    return parsed.select(
        *[F.col(f"f.{c}").alias(c) for c in ("severity", "message", "logger")],
        F.to_timestamp("f.time").alias("time"), F.col("f.exception").alias("exception"),
        F.map_filter("all", lambda k, v: ~k.isin(known)).alias("extras"), F.col("f.corrupt").alias("corrupt"),
    )


def traces_from_logs(logs: DataFrame) -> DataFrame:
    """S3: per-chunk latencies out of "chunk published" lines. `stages` keeps
    any stage the line names, with the usual four as columns too."""
    extra = lambda name, kind: F.col("extras")[name].cast(kind)
    seconds = F.map_filter("extras", lambda k, v: k.rlike("^stage_.*_s$"))
    return logs.filter(F.col("message") == "chunk published").select(
        F.col("extras")["session_id"].alias("session_id"),
        extra("chunk_id", "bigint").alias("chunk_id"), F.col("extras")["language"].alias("language"),
        extra("glass_to_glass_s", "double").alias("glass_to_glass_s"),
        extra("slo_breach", "boolean").alias("slo_breach"),
        *[extra(f"stage_{name}_s", "double").alias(f"stage_{name}_s") for name in PARTS],
        F.transform_values(seconds, lambda k, v: v.cast("double")).alias("stages"),
    )


def read_audio_frames(spark: SparkSession, path: str, frame_ms: int = 100, split_bytes: int = wav.SPLIT_BYTES) -> DataFrame:
    """WAV files (16-bit mono) to frames of `frame_ms`; t_audio comes from
    the number of samples before a frame. Sessions are named by their file's
    path. A file with more sound than `split_bytes` is read by several tasks."""
    spark.dataSource.register(wav.WavDataSource)
    options = {"frame_ms": frame_ms, "split_bytes": split_bytes}
    return spark.read.format(wav.WavDataSource.name()).options(**options).load(path)


def read_ledger(spark: SparkSession, path: str, kind: str, tenant_id) -> DataFrame:
    """One of the stored tables ("sessions", "listeners", "transcripts"),
    for one tenant. Tables are partitioned by tenant_id, so the mandatory
    predicate prunes the scan; a wrong tenant gives no rows."""
    table = spark.read.schema(schemas.LEDGER[kind]).parquet(f"{path}/{kind}")
    return tenant_scope(table, tenant_id)


def write_ledger(df: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("tenant_id").parquet(f"{path}/{kind}")


def read_reference_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file with its words."""
    whole = spark.read.text(path, wholetext=True)
    return reference_words(whole.select(
        _session_from_path().alias("doc"), F.col("value").alias("text")
    ))


def reference_words(texts: DataFrame) -> DataFrame:
    return texts.withColumn("words", tokenise(F.col("text")))
