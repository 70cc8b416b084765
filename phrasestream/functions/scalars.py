"""Scalar expressions on timings, levels, policies and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasestream.fixed_values import RESERVED_SCHEMA_NAMES, SCHEMA_NAME_PATTERN, STOCK_PHRASES
from phrasestream.functions.text import strip


def word_end_time(word_ends: Column, start: Column, end: Column, words: Column, index: Column) -> Column:
    """Audio end of the index-th word (1-based). The word's own timing if
    there is one, else linear interpolation over the hypothesis."""
    span = end - start
    own = F.when(
        (F.size(word_ends) > 0) & (index <= F.size(word_ends)), F.try_element_at(word_ends, index)
    )
    share = F.least(F.lit(1.0), index / words)
    spread = F.when((words <= 0) | (span <= 0), end).otherwise(start + span * share)
    return F.coalesce(own, spread)


def python_word_end(word_ends, start: float, end: float, words: int, index: int) -> float:
    """The same inside a task."""
    timed = word_ends[index - 1 : index] if word_ends else ()
    if len(timed):
        return timed[0]
    heard = min(1.0, index / words) if words > 0 and end > start else None
    return end if heard is None else start + (end - start) * heard


def audio_duration(pcm: Column, sample_rate: Column) -> Column:
    """Seconds of 16-bit mono audio."""
    return F.octet_length(pcm) / 2 / sample_rate


def is_hallucination(text: Column, no_speech: Column, logprob: Column) -> Column:
    """P10: blank, confidently not speech, or a stock phrase that is doubtful."""
    stripped = F.lower(strip(text))
    return (
        (stripped == "")
        | ((no_speech > 0.8) & (logprob < -0.5))
        | (stripped.isin(STOCK_PHRASES) & ((no_speech > 0.5) | (logprob < -0.7)))
    )


def round_even(x: Column, digits: int) -> Column:
    """Half-even on the scaled double, as SQL's round_even has it; `bround` looks at the
    decimal form instead, where 21.134999999999998 is no tie."""
    return F.rint(x * 10**digits) / 10**digits


def playout_speed(depth: Column, speedup_at: Column, skip_at: Column, max_speed: Column) -> Column:
    """1.0 up to the threshold, then a linear ramp to max_speed."""
    ramp = F.least(F.lit(1.0), (depth - speedup_at) / (skip_at - speedup_at))
    return F.when(depth <= speedup_at, 1.0).otherwise(F.bround(1.0 + ramp * (max_speed - 1.0), 3))


def should_skip(depth: Column, skip_at: Column) -> Column:
    """P12."""
    return depth >= skip_at


def safe_schema(name: str | None) -> bool:
    """A schema name that may be put into a statement, inside a task."""
    return bool(name and re.match(SCHEMA_NAME_PATTERN, name) and not name.endswith("\n") and name not in RESERVED_SCHEMA_NAMES)
