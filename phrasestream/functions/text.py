"""Token and clause expressions. All of them are Catalyst columns; Python is
used only for text outside the scripts the JVM can fold exactly."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasestream.fixed_values import (
    ABBREVIATIONS, CONJUNCTIONS, EDGE_KEEP, MEDIUM_MARKS, STRONG_MARKS, WHITESPACE,
)

_OTHER_SPACES = "".join(c for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " ")
# Punctuation at the start or the end of a word, in a text of single spaces.
_WORD_EDGES = f"(?<![^ ])[^{EDGE_KEEP} ]+|[^{EDGE_KEEP} ]+(?![^ ])"

# ASCII, Latin-1 letters and typographic quotes/dashes are fixed points of NFKC,
# and their case folding is lower() plus sharp s.
_PLAIN = r"^[\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF\x{2013}\x{2014}\x{2018}-\x{201E}]*$"


def tokenise(text: Column) -> Column:
    """Whitespace tokens, punctuation attached, no empties. Splitting at one plain
    space needs no pattern, so white space of other kinds becomes spaces first."""
    spaced = F.translate(text, _OTHER_SPACES, " " * len(_OTHER_SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def python_normalise(token: str) -> str:
    """P2 for one token in Python, used inside tasks for non-Latin text."""
    keep = lambda c: c == "_" or c.isalnum() or "\u0600" <= c <= "\u06ff" or "\u0900" <= c <= "\u097f"
    start, end = 0, len(token)
    while start < end and not keep(token[start]):
        start += 1
    while end > start and not keep(token[end - 1]):
        end -= 1
    return unicodedata.normalize("NFKC", token[start:end]).casefold()


def _normalise_texts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [python_normalise(w) for w in t.split()])


def _normalise(joined: Column, source: Column) -> Column:
    """P2 over tokens joined by single spaces; `source` is any text with the
    same tokens. Latin text takes one pass of one pattern; tokens of nothing
    but punctuation become empty. Only text in other scripts, the non-null
    cells sent to the Arrow UDF, pays for Python."""
    other_scripts = F.pandas_udf(_normalise_texts, "array<string>")
    folded = F.replace(F.lower(joined), F.lit("ß"), F.lit("ss"))
    plain = F.split(F.regexp_replace(folded, _WORD_EDGES, ""), " ")
    return F.coalesce(
        other_scripts(F.when(~source.rlike(_PLAIN), source)),
        F.when(source.rlike(rf"^[{WHITESPACE}]*$"), F.array().cast("array<string>")).otherwise(plain),
    )


def normalise_words(tokens: Column) -> Column:
    joined = F.array_join(tokens, " ")
    return _normalise(joined, joined)


def normalise_tokens(text: Column) -> Column:
    return _normalise(F.array_join(tokenise(text), " "), text)


def normalise_token(token: Column) -> Column:
    """P2 for one whitespace-free token."""
    return F.coalesce(F.get(normalise_tokens(token), F.lit(0)), F.lit(""))


def ends_sentence(token: Column, norm: Column) -> Column:
    """P4. A trailing '.' does not end a sentence after a digit, a single
    character, nothing, or an abbreviation. `norm` is the normalised token,
    equal to that of the token without its full stop."""
    last = F.right(token, F.lit(1))
    stem = F.substring(token, F.lit(1), F.length(token) - 1)
    full_stop = (F.length(stem) > 1) & ~stem.rlike(r"\p{Nd}") & ~norm.isin(ABBREVIATIONS)
    return F.when(last == ".", full_stop).otherwise(last.isin(STRONG_MARKS))


def boundary_strength(token: Column, norm: Column) -> Column:
    """3 after a sentence end, 2 after a clause mark, else 0."""
    last = F.right(token, F.lit(1))
    return (
        F.when(F.coalesce(token, F.lit("")) == "", 0)
        .when(ends_sentence(token, norm), 3)
        .when(last.isin(MEDIUM_MARKS), 2)
        .otherwise(0)
    )


def is_conjunction(norm: Column) -> Column:
    """P5, on the normalised token."""
    return norm.isin(CONJUNCTIONS)


def boundary_places(tokens: Column, norms: Column, min_words: Column) -> tuple[Column, Column]:
    """Ends of the longest pieces of `min_words` words and more: up to a mark, and before a
    conjunction. Null where there is none."""
    cut_after = F.zip_with(tokens, norms, lambda t, n: boundary_strength(t, n) >= 2)
    strong = F.array_max(
        F.transform(cut_after, lambda cut, i: F.when(cut & (i + 1 >= min_words), i + 1))
    )
    weak = F.array_max(
        F.transform(norms, lambda n, i: F.when(is_conjunction(n) & (i >= min_words), i))
    )
    return strong, weak


def find_boundary(tokens: Column, norms: Column, min_words: Column, allow_weak: Column) -> Column:
    """Exclusive end of the best cut in `tokens`, 0 when there is none."""
    strong, weak = boundary_places(tokens, norms, min_words)
    return F.when(F.size(tokens) < min_words, 0).otherwise(
        F.coalesce(strong, F.when(allow_weak, weak), F.lit(0))
    )


def common_prefix(left: Column, right: Column) -> Column:
    """Number of leading elements two arrays share; null if either is null."""
    same = F.zip_with(left, right, lambda a, b: a.eqNullSafe(b))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def wer_tokens(text: Column) -> Column:
    """Lower case, anything but letters, digits, spaces, apostrophes out."""
    cleaned = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{WHITESPACE}']", " ")
    return tokenise(cleaned)


def strip(text: Column) -> Column:
    """`text` without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


# --- the same clause rules inside a fold -----------------------------------------

_ABBREVIATION_SET, _CONJUNCTION_SET = frozenset(ABBREVIATIONS), frozenset(CONJUNCTIONS)
_CUT_SET = frozenset([*STRONG_MARKS, *MEDIUM_MARKS])
_DIGIT = re.compile(r"\d")


def python_cuts_after(token: str) -> bool:
    """Whether boundary_strength(token) >= 2, for one token inside a task."""
    last = token[-1:]
    if last not in _CUT_SET:
        return False
    if last != ".":
        return True
    stem = token[:-1]
    return len(stem) > 1 and not _DIGIT.search(stem) and python_normalise(stem) not in _ABBREVIATION_SET


def python_is_conjunction(token: str) -> bool:
    return python_normalise(token) in _CONJUNCTION_SET
