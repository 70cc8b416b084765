"""Transcript quality: word errors, one-pass scoring, degenerate output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasestream.fixed_values import TARGET_SCRIPTS
from phrasestream.functions.scalars import is_hallucination
from phrasestream.functions.text import tokenise, wer_tokens
from phrasestream.functions.wer import word_errors as count_errors
from phrasestream.plans.ordered import TARGET_ROWS, running


def drop_hallucinations(segments: DataFrame) -> DataFrame:
    """P10: segments that look heard rather than invented."""
    return segments.filter(
        ~is_hallucination(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"))
    )


def suppressed_count(segments: DataFrame, by: list[str]) -> DataFrame:
    """P10: how many segments were dropped."""
    invented = is_hallucination(F.col("text"), F.col("no_speech_prob"), F.col("avg_logprob"))
    return segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(invented).alias("suppressed")
    )


def word_errors(pairs: DataFrame) -> DataFrame:
    """edit counts between `reference` and `hypothesis` word arrays."""

    def edits(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
        counts = count_errors([list(r) for r in reference], [list(h) for h in hypothesis])
        return pd.DataFrame(counts, columns=["sub", "del", "ins", "distance"])

    counted = F.pandas_udf(edits, "sub int, del int, ins int, distance int")
    size = F.size("reference")
    return (
        pairs.withColumn("_e", counted("reference", "hypothesis"))
        .select(*[c for c in pairs.columns if c not in ("reference", "hypothesis")],
                "_e.*", size.alias("reference_words"))
        .withColumn("wer", F.coalesce(F.try_divide("distance", "reference_words"), F.lit(0.0)))
    )


def wer_report(errors: DataFrame, by: list[str]) -> DataFrame:
    """A11."""
    return errors.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("sub", "del", "ins", "distance", "reference_words")]
    ).withColumn("wer", F.coalesce(F.try_divide("distance", "reference_words"), F.lit(0.0)))


def distinct_chunks(transcripts: DataFrame) -> DataFrame:
    """One row per chunk; among languages the first by name. An aggregate
    rather than a ranked window, so repeated rows combine before the shuffle."""
    return transcripts.groupBy("session_id", "chunk_id").agg(
        F.min(F.struct("language", "source_text")).alias("r")
    ).select("session_id", "chunk_id", "r.language", "r.source_text")


def one_pass(
    chunks: DataFrame, reference_words: DataFrame, slack: float = 1.25,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Chunks of each session up to one pass over its reference.

    Chunks are taken in order until the words so far plus the next chunk exceed
    `slack` times the reference; the first chunk with words is always taken.
    Words so far only grow, so the stop is the first chunk past the limit.
    """
    counted = chunks.withColumn("words", wer_tokens(F.col("source_text"))).withColumn(
        "_n", F.size("words").cast("bigint")
    )
    summed = running(counted, ["session_id"], ["chunk_id"], {"_upto": ("sum", F.col("_n"))},
                     target_rows=target_rows)
    limit = F.col("reference_words") * slack
    over = (F.col("_upto") > F.col("_n")) & (F.col("_upto") > limit)
    bounded = summed.join(reference_words, "session_id")
    stop = bounded.groupBy("session_id").agg(
        F.min(F.when(over, F.col("chunk_id"))).alias("_stop"), F.count(F.lit(1)).alias("total")
    )
    return bounded.join(stop, "session_id").select(
        "session_id", "chunk_id", "words", "total",
        (F.col("_stop").isNull() | (F.col("chunk_id") < F.col("_stop"))).alias("used"),
        F.col("_stop").isNotNull().alias("looped"),
    )


def score_sessions(transcripts: DataFrame, references: DataFrame) -> DataFrame:
    """word error rate of one pass over each session's reference text.

    `references` has session_id and text. The reference bounds what is
    gathered: at most `slack` times its length (plus one chunk) per session.
    """
    wanted = references.select("session_id", wer_tokens(F.col("text")).alias("reference"))
    lengths = wanted.select("session_id", F.size("reference").alias("reference_words"))
    passes = one_pass(distinct_chunks(transcripts), lengths)
    heard = passes.filter("used").groupBy("session_id").agg(
        F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("chunk_id", "words"))), lambda c: c["words"]
        )).alias("hypothesis"),
        F.count(F.lit(1)).alias("used"), F.first("total").alias("total"),
        F.first("looped").alias("looped"),
    )
    # A session that was never heard is all deletions.
    empty = F.array().cast("array<string>")
    scored = wanted.join(heard, "session_id", "left").withColumns({
        "hypothesis": F.coalesce("hypothesis", empty), "used": F.coalesce("used", F.lit(0)),
        "total": F.coalesce("total", F.lit(0)), "looped": F.coalesce("looped", F.lit(False)),
    })
    return word_errors(scored)


def repetition_flags(translations: DataFrame, max_ratio: float = 3.0, n: int = 3) -> DataFrame:
    """output much longer than its source, or repeated n-grams."""
    said, source = tokenise(F.col("translated_text")), tokenise(F.col("source_text"))
    rows = translations.withColumn("_t", said).withColumn("_s", F.size(source))
    size = F.greatest(F.lit(0), F.size("_t") - (n - 1))
    grams = F.slice("_t", 1, size)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice("_t", k + 1, size), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.withColumn("_g", grams)
    ratio = F.coalesce(F.try_divide(F.size("_t"), F.col("_s")), F.lit(0.0))
    repeated = F.size("_g") - F.size(F.array_distinct("_g"))
    return rows.select(
        *translations.columns, ratio.alias("length_ratio"), repeated.alias("repeated_ngrams"),
        (ratio > max_ratio).alias("too_long"), (repeated > 0).alias("repeats"),
    ).drop("translated_text", "source_text")


def script_leak(translations: DataFrame) -> DataFrame:
    """share of letters outside the script expected for the language; null for a
    language without a known script."""
    text = F.col("translated_text")
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    foreign = None
    for script in sorted({s for _, s in TARGET_SCRIPTS}):
        languages = [code for code, s in TARGET_SCRIPTS if s == script]
        own = "".join(rf"\p{{Is{name}}}" for name in script.split("+"))
        count = F.length(F.regexp_replace(text, rf"[\P{{L}}{own}]+", ""))
        test = F.col("language").isin(languages)
        foreign = F.when(test, count) if foreign is None else foreign.when(test, count)
    return translations.select(
        *[c for c in translations.columns if c not in ("translated_text", "source_text")],
        letters.alias("letters"), foreign.alias("foreign_letters"),
        F.when(foreign.isNotNull(), F.coalesce(F.try_divide(foreign, letters), F.lit(0.0))).alias("leak"),
    )
