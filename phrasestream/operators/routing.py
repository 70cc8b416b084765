"""Translation routing, coverage and fan-out to user-supplied functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from phrasestream.fixed_values import (
    BACKEND_CREDIBILITY, CLONED_VOICE_LANGUAGES, DEFAULT_BACKEND, DEFAULT_ROUTES, FAMILY_TARGETS, FLORES_CODES,
    PAIR_MODELS, VOICES,
)
from phrasestream.functions.text import strip

# All lookup tables here are constants of the package (at most 25 rows), so
# broadcasting them is bounded whatever the size of the data.

#: Characters of text whose translations a task holds at a time.
CHARACTERS_AT_ONCE = 4_000_000


def route_backend(rows: DataFrame, routes: dict[str, str] | None = None) -> DataFrame:
    """None means the default routes; {} means no exceptions at all."""
    table = list((dict(DEFAULT_ROUTES) if routes is None else routes).items())
    routed = rows.sparkSession.createDataFrame(table, "language string, _backend string")
    return rows.join(F.broadcast(routed), "language", "left").select(
        *rows.columns, F.coalesce("_backend", F.lit(DEFAULT_BACKEND)).alias("backend")
    )


def merge_translations(parts: list[DataFrame]) -> DataFrame:
    """Results of several backends as one table; parts are disjoint by
    language, so nothing needs to be compared."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def coverage_table(spark) -> DataFrame:
    """What each backend can produce, by target language."""
    codes = spark.createDataFrame(FLORES_CODES, "language string, flores string")
    voices = spark.createDataFrame(VOICES, "language string, voice string")
    cloned = spark.createDataFrame([(c, True) for c in CLONED_VOICE_LANGUAGES], "language string, cloned boolean")
    return codes.join(voices, "language", "full").join(cloned, "language", "full")


def _model_table(spark, models: list[str]) -> DataFrame:
    """source_language, language, _model, _token: what each model can translate. A model of
    the very pair comes before its family's, as it need not share what it learnt."""
    parts = [m.partition("-")[::2] for m in models]
    families = {(source, family) for source, family in parts}
    own = [(source, target, f"{source}-{target}", None) for source, target in parts]
    taken = {row[:2] for row in own}
    shared = [
        (source, target, f"{source}-{family}", token)
        for source in sorted({s for s, _ in parts}) for target, family, token in FAMILY_TARGETS
        if (source, family) in families and (source, target) not in taken
    ]
    return spark.createDataFrame([*own, *shared], "source_language string, language string, _model string, _token string")


def resolve_models(
    pairs: DataFrame, models: list[str] | None = None, routes: dict[str, str] | None = None,
    loaded_source: str = "en",
) -> DataFrame:
    """`pairs` (source_language, language) with `backend`, `model`, `target_token` and
    `translated`: whether the backend the target is routed to can translate this pair.
    The backends are loaded for one source language. Per-pair models need one for the pair
    or its family; the multilingual model needs a code for both languages."""
    spark = pairs.sparkSession
    table = _model_table(spark, PAIR_MODELS if models is None else models)
    coded = spark.createDataFrame(FLORES_CODES, "language string, _code string")
    sources = coded.select(F.col("language").alias("source_language"), F.col("_code").alias("_source_code"))
    rows = (
        route_backend(pairs, routes).join(F.broadcast(table), ["source_language", "language"], "left")
        .join(F.broadcast(coded), "language", "left").join(F.broadcast(sources), "source_language", "left")
    )
    large, own = F.col("backend") == "nllb-200", F.col("backend") == DEFAULT_BACKEND
    able = F.when(large, F.col("_code").isNotNull() & F.col("_source_code").isNotNull()).when(own, F.col("_model").isNotNull()).otherwise(False)
    loaded = F.coalesce(F.col("source_language") == loaded_source, F.lit(False))
    return rows.select(
        *pairs.columns, "backend", F.when(loaded & able & own, F.col("_model")).when(loaded & able, F.col("backend")).alias("model"),
        F.when(loaded & able & own, F.col("_token")).alias("target_token"), (loaded & able).alias("translated"),
    )


def unsupported_pairs(
    rows: DataFrame, models: list[str] | None = None, routes: dict[str, str] | None = None, loaded_source: str = "en"
) -> DataFrame:
    """The (source_language, language) pairs among `rows` that nothing loaded can translate."""
    pairs = rows.select("source_language", "language").distinct()
    return resolve_models(pairs, models, routes, loaded_source).filter("not translated").select("source_language", "language", "backend")


def backend_coverage(
    pairs: DataFrame, loaded_source: str = "en", models: list[str] | None = None, routes: dict[str, str] | None = None
) -> DataFrame:
    """Which parts of the chain support a (source, language) pair. A pair
    is supported when its source is the loaded one, its backend covers the
    pair and there is a voice; others are to be dropped, not faked."""
    resolved = resolve_models(pairs, models, routes, loaded_source)
    rows = resolved.join(F.broadcast(coverage_table(pairs.sparkSession)), "language", "left")
    spoken = F.col("voice").isNotNull() | F.coalesce("cloned", F.lit(False))
    return rows.select(
        *pairs.columns, "backend", "model", "target_token", "flores", "translated",
        F.col("voice").isNotNull().alias("voiced"),
        F.coalesce("cloned", F.lit(False)).alias("cloned_voice"),
        (F.col("translated") & spoken).alias("supported"),
    )


def flag_credible_sessions(sessions: DataFrame, device: str = "cpu") -> DataFrame:
    """Whether a session's latency figures may be quoted. `blocking` lists
    the backends that cannot meet the budget on this device, `unknown` those
    not in the registry."""
    spark = sessions.sparkSession
    out = sessions.select("session_id", "backend_stt", "backend_mt", "backend_tts")
    for kind in ("stt", "mt", "tts"):
        table = [(name, device in devices) for k, name, devices in BACKEND_CREDIBILITY if k == kind]
        registry = spark.createDataFrame(table, f"backend_{kind} string, _{kind} boolean")
        out = out.join(F.broadcast(registry), f"backend_{kind}", "left")
    kinds = ("stt", "mt", "tts")
    pick = lambda test: F.array_compact(F.array(*[F.when(test(k), F.col(f"backend_{k}")) for k in kinds]))
    unknown = pick(lambda k: F.col(f"_{k}").isNull())
    return out.select(
        "session_id",
        F.coalesce(F.col("_stt") & F.col("_mt") & F.col("_tts"), F.lit(False)).alias("latency_credible"),
        pick(lambda k: ~F.col(f"_{k}")).alias("blocking"),
        unknown.alias("unknown"),
        (F.size(unknown) > 0).alias("rejected"),
    )


def compare_backends(translations: DataFrame, backends: tuple[str, str] = ("opus-mt", "nllb-200")) -> DataFrame:
    """The same chunk through two backends, side by side."""
    first, second = backends
    text = lambda b: F.max(F.when(F.col("backend") == b, F.col("translated_text")))
    sides = translations.groupBy("session_id", "chunk_id", "language").agg(
        text(first).alias("first_text"), text(second).alias("second_text")
    )
    return sides.withColumn(
        "length_ratio", F.try_divide(F.length("first_text"), F.length("second_text"))
    )


def expansion_ratio(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Output seconds over source seconds, minus one, per language."""
    said = sources.groupBy("session_id").agg(F.sum("seconds").alias("source_s"))
    spoken = outputs.groupBy("session_id", "language").agg(F.sum("seconds").alias("output_s"))
    return spoken.join(said, "session_id", "left").groupBy("language").agg(
        F.sum("output_s").alias("output_s"), F.sum("source_s").alias("source_s")
    ).withColumn("expansion", F.try_divide("output_s", "source_s") - 1)


def skip_empty(translations: DataFrame) -> DataFrame:
    """Blank translations are neither spoken nor stored."""
    return translations.filter(strip(F.coalesce("translated_text", F.lit(""))) != "")


# --- U1, U2 -----------------------------------------------------------------------


def _with_strings(df: DataFrame, *names: str) -> StructType:
    return StructType([*df.schema.fields, *[StructField(n, StringType()) for n in names]])


Translator = Callable[[list[str], str, str], list[str]]


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch, few enough at a time that their texts and translations stay small."""
    sizes = frame["text"].fillna("").str.len().cumsum()
    for _, part in frame.groupby((sizes // CHARACTERS_AT_ONCE).astype("int64"), sort=True):
        yield part.reset_index(drop=True)


def translate_fanout(
    rows: DataFrame, backends: dict[str, Callable[[], Translator]],
    routes: dict[str, str] | None = None, spread: int = 64,
    models: list[str] | None = None, loaded_source: str = "en",
) -> DataFrame:
    """Translate (source_language, language, text) rows through user functions.

    Rows of pairs that no loaded model translates (`resolve_models`) give no rows: they
    are gated before the fan-out, so no worker is asked for them; `unsupported_pairs`
    names them.
    `backends` maps a name to a factory; the translator it returns is opened
    once per partition. Calls are batched by (backend, source, target). A call
    that raises gives "" and an error for its own rows only. Rows of a backend
    nobody supplied are dropped.

    Rows are dealt over partitions by backend, session and a salt of up to
    `spread`, so one long session can be shared by several workers.
    """
    schema = _with_strings(rows, "backend", "translated_text", "error")
    routed = resolve_models(rows, models, routes, loaded_source).filter("translated").drop("model", "target_token", "translated")
    routed = routed.filter(F.col("backend").isin(list(backends)))
    salt = F.pmod(F.xxhash64("chunk_id", "language"), F.lit(spread))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[str, Translator] = {}
        for frame in (part for whole in frames for part in _slices(whole)):
            frame["translated_text"], frame["error"] = "", None
            spoken = frame[frame["text"].fillna("").str.strip() != ""]
            for (name, source, target), part in spoken.groupby(["backend", "source_language", "language"]):
                try:
                    if name not in opened:
                        opened[name] = backends[name]()
                    result = opened[name](part["text"].tolist(), source, target)
                    if len(result) != len(part):
                        raise ValueError(f"{name} returned {len(result)} texts for {len(part)}")
                    frame.loc[part.index, "translated_text"] = result
                except Exception as error:  # one backend must not silence the others
                    frame.loc[part.index, "error"] = f"{type(error).__name__}: {error}"
            yield frame

    return routed.repartition("backend", "session_id", salt).mapInPandas(run, schema)


def transcribe_segments(
    segments: DataFrame, recogniser: Callable[[], Callable[[pd.DataFrame], list[str]]]
) -> DataFrame:
    """Text for ungated utterances from a user-supplied recogniser, opened
    once per partition; a batch that raises gives "" and an error."""
    schema = _with_strings(segments, "text", "error")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            frame["text"], frame["error"] = "", None
            heard = frame[~frame["gated"]] if "gated" in frame else frame
            try:
                model = model or recogniser()
                if len(heard):
                    frame.loc[heard.index, "text"] = model(heard)
            except Exception as error:
                frame.loc[heard.index, "error"] = f"{type(error).__name__}: {error}"
            yield frame

    return segments.mapInPandas(run, schema)
