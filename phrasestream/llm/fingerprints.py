"""Document fingerprints by randomised edit embedding.

A text is walked character by character; at step t all texts share one random table that
says, for each class of characters, whether the walk moves on or writes the character once
more. Texts a small edit apart fall back into step, so edit distance becomes Hamming
distance of what the walks write. A fingerprint samples bits of that: up to `PER_BLOCK`
steps of each doubling block [2^a, 2^(a+1)), so all of the first 512 steps and a share of
later ones, one bit of the character written there. It is `length:bits`, in hexadecimal.

Likeness estimates the share of steps at which two walks write the same character. Bands
are keys of a few sampled bits each: texts that share a band are candidates, and the
likeness of their fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import staged

PER_BLOCK, BLOCKS, CLASSES, PERIOD = 256, 40, 64, 4096
BANDS, BAND_BITS = 16, 16
#: As few walks as this go on one by one.
FEW = 12


def _tables():
    rng = np.random.default_rng(20)
    moves = rng.random((CLASSES, PERIOD)) < 0.5
    stay = []
    for row in moves:
        ahead = np.flatnonzero(np.concatenate([row, row]))
        stay.append((ahead[np.searchsorted(ahead, np.arange(PERIOD))] - np.arange(PERIOD) + 1).astype(np.uint8).tobytes())
    written = rng.integers(0, 2, (CLASSES, PERIOD)).astype(np.uint8)
    at, begin = [0], []
    for a in range(BLOCKS):
        begin.append(len(at))
        span = 1 << a
        picked = np.arange(span) if span <= PER_BLOCK else np.unique(rng.integers(0, span, PER_BLOCK))
        at += (span + picked).tolist()
    begin[0] = 0
    return stay, written, np.array(at, np.int64), begin


STAY, WRITTEN, AT, BEGIN = _tables()
STAY_TABLE = np.stack([np.frombuffer(r, np.uint8) for r in STAY]).astype(np.int64)
SLOT = ((AT.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(PERIOD)).astype(np.int64)
_BLOCK = np.searchsorted(np.array(BEGIN), np.arange(len(AT)), side="right") - 1
_SIZES = np.bincount(_BLOCK, minlength=BLOCKS)
#: For each block, which of its samples make up each band.
PICKED = [np.stack([np.random.default_rng((a, b)).permutation(n)[:BAND_BITS] for b in range(BANDS)]) if n >= BAND_BITS else None
          for a, n in enumerate(_SIZES.tolist())]
WEIGHT = np.exp2(_BLOCK.astype(float)) / _SIZES[_BLOCK]


def codes(text: str) -> np.ndarray:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    return ((points * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(CLASSES)).astype(np.uint8)


def walks(chars: list[np.ndarray], start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The step at which each walk comes to each of its characters, and where it ends.
    All texts walk side by side, the longest first; the last few go on one by one."""
    sizes = np.array([len(c) for c in chars], np.int64)
    order = np.argsort(-sizes, kind="stable")
    offsets = np.cumsum(sizes[order]) - sizes[order]
    flat_ = np.concatenate([chars[i] for i in order]) if len(order) else np.zeros(0, np.uint8)
    times = np.zeros(len(flat_), np.int64)
    t = start[order].astype(np.int64)
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    last, stay = PERIOD - 1, STAY_TABLE.ravel()
    for i, n in enumerate(active.tolist()):
        if n <= FEW:
            for k in range(n):
                now, row = int(t[k]), []
                for c in flat_[offsets[k] + i : offsets[k] + sizes[order[k]]].tobytes():
                    row.append(now)
                    now += STAY[c][now & last]
                times[offsets[k] + i : offsets[k] + sizes[order[k]]] = row
                t[k] = now
            break
        at = offsets[:n] + i
        now = t[:n]
        times[at] = now
        t[:n] = now + stay[flat_[at].astype(np.int64) * PERIOD + (now & last)]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [times[offsets[k] : offsets[k] + n] for k, n in zip(back, sizes)], t[back]


def sampled(chars: np.ndarray, times: np.ndarray, t: int) -> np.ndarray:
    """The sampled bits of a walk of t steps."""
    end = int(np.searchsorted(AT, t))
    if not end:
        return np.zeros(0, np.uint8)
    at = np.searchsorted(times, AT[:end], side="right") - 1
    return WRITTEN[chars[at], SLOT[:end]]


def pack(t: int, bits: np.ndarray) -> str:
    return f"{t:x}:{np.packbits(bits).tobytes().hex()}"


def unpack(fingerprint: str) -> tuple[int, np.ndarray]:
    """Steps, and the sampled bits."""
    head, _, tail = fingerprint.partition(":")
    t = int(head, 16)
    return t, np.unpackbits(np.frombuffer(bytes.fromhex(tail), np.uint8))[: int(np.searchsorted(AT, t))]


def fingerprint(text: str) -> str:
    chars = codes(text)
    times, ends = walks([chars], np.zeros(1))
    return pack(int(ends[0]), sampled(chars, times[0], int(ends[0])))


def likeness_of(ta: int, x: np.ndarray, tb: int, y: np.ndarray) -> float:
    """0 to 1; 1 for equal walks, 0 for an empty text beside another."""
    if ta == tb and np.array_equal(x, y):
        return 1.0
    if not ta or not tb:
        return 0.0
    common, longer = sorted((len(x), len(y)))
    inside = WEIGHT[:common]
    same = inside @ (x[:common] == y[:common]) / inside.sum()
    return float(max(0.0, 2 * same - 1) * inside.sum() / WEIGHT[:longer].sum())


def likeness(a: str, b: str) -> float:
    return likeness_of(*unpack(a), *unpack(b))


def bands_of(t: int, bits: np.ndarray) -> list[int]:
    """Keys of sampled bits of the two highest full blocks: near texts share some."""
    top = max(t - 1, 1).bit_length() - 1
    keys = []
    for a in {max(top - 1, 0), max(top - 2, 0)}:
        block = bits[BEGIN[a] : BEGIN[a] + _SIZES[a]]
        if len(block) < _SIZES[a] or len(block) < BAND_BITS:
            whole = hashlib.blake2b(f"{t}:{a}:".encode() + bits.tobytes(), digest_size=7)
            keys.append(int.from_bytes(whole.digest(), "big"))
        else:
            keys += ((a << 24) + (np.arange(BANDS) << 16) + block[PICKED[a]].astype(np.int64) @ (1 << np.arange(BAND_BITS))).tolist()
    return keys


def bands(fingerprint_: str) -> list[int]:
    return bands_of(*unpack(fingerprint_))


def edited(text: str, following: str) -> str:
    """The last third of the characters gives way to the first as many of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_COLUMNS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "sha": pa.binary(), "t": pa.int64(), "bits": pa.binary(),
    "edited_t": pa.int64(), "edited_bits": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(),
    "bands_shared": pa.int64(), "part": pa.int32(), "first_text": pa.string(), "last_text": pa.string(),
}
_DDL = ("doc_id long, n_chars long, sha binary, t long, bits binary, edited_t long, edited_bits binary, "
        "near_edited double, near_next double, bands_shared long, part int, first_text string, last_text string")


def _rows(ids: list, texts: list[str], following: list[str], chained: bool) -> list[dict]:
    """The results of texts beside the texts that follow them. `chained`: each following
    text but the last is the next of `texts`, so its walk is at hand."""
    news = [edited(a, b) for a, b in zip(texts, following)]
    heads = [len(a) - len(a) // 3 for a in texts]
    every = [codes(a) for a in texts] + [codes(b) for b in (following[-1:] if chained else following)]
    times, ends = walks(every, np.zeros(len(every)))
    tails = [codes(b[h:]) for b, h in zip(news, heads)]
    begin = np.array([t[h] if h < len(t) else e for t, h, e in zip(times, heads, ends)], np.int64)
    tail_times, tail_ends = walks(tails, begin)
    prints = [(int(e), sampled(c, t, int(e))) for c, t, e in zip(every, times, ends)]
    out = []
    for i, new in enumerate(news):
        own, nxt = prints[i], prints[i + 1 if chained else len(texts) + i]
        t = int(tail_ends[i])
        bits = sampled(np.concatenate([every[i][: heads[i]], tails[i]]), np.concatenate([times[i][: heads[i]], tail_times[i]]), t)
        out.append({
            "doc_id": ids[i], "n_chars": len(texts[i]), "sha": hashlib.sha256(new.encode("utf-8", "replace")).digest(),
            "t": own[0], "bits": np.packbits(own[1]).tobytes(), "edited_t": t, "edited_bits": np.packbits(bits).tobytes(),
            "near_edited": likeness_of(*own, t, bits), "near_next": likeness_of(*own, *nxt),
            "bands_shared": len({*bands_of(*own)} & {*bands_of(t, bits)})})
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _COLUMNS.items()], list(_COLUMNS))


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the one behind it. The last row of a partition waits for
    the first of the next partition: both carry their texts."""
    part = TaskContext.get().partitionId()
    waiting = None  # id and text
    first = True
    for batch in W.slices(batches, most=16 << 20):
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        if waiting is not None:
            ids, texts = [waiting[0], *ids], [waiting[1], *texts]
        waiting = ids[-1], texts[-1]
        if len(ids) > 1:
            rows = _rows(ids[:-1], texts[:-1], texts[1:], chained=True)
            if first:
                rows[0] |= {"part": part, "first_text": texts[0]}
                first = False
            yield _batch(rows)
    if waiting is not None:
        yield _batch([{"doc_id": waiting[0], "part": part, "last_text": waiting[1], "first_text": waiting[1] if first else None}])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            yield _batch(_rows([r["doc_id"] for r in rows], [r["last_text"] for r in rows], [r["next_text"] for r in rows], chained=False))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, the edited text's sha256 and fingerprint, likeness to
    the edited and to the next text, and the number of bands shared with the edited text.

    `docs` has doc_id and text; other columns are not read. The next text is that of the
    next smaller id (null ids come last, equal ids go by text); after the last comes the
    first. A null text is empty; an empty table gives no rows. Texts are moved once, dealt
    out by ranges of ids; two texts for each partition are moved once more, to close the
    seams between ranges.
    """
    rows = W.text_frame(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    by_id = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(by_id).sortWithinPartitions(by_id, F.col("text").asc_nulls_first())
    made = staged(dealt.mapInArrow(_along, _DDL), "fingerprints")
    # One row for each partition.
    thin = made.filter("first_text is not null").select("part")
    behind = thin.select("part", F.coalesce(
        F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    lasts = made.filter("last_text is not null").select("doc_id", "last_text", "part")
    firsts = made.filter("first_text is not null").select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    seams = lasts.join(behind, "part").join(firsts, "next_part").mapInArrow(_seams, _DDL)
    shown = lambda t, bits: F.lower(F.concat(F.hex(t), F.lit(":"), F.hex(bits)))
    return made.filter("last_text is null").unionByName(seams).select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), shown("t", "bits").alias("fingerprint"),
        shown("edited_t", "edited_bits").alias("edited_fingerprint"), "near_edited", "near_next", "bands_shared")


def near_pairs(prints: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of different fingerprints that share a band and are alike: doc_id, other_id,
    near. Each fingerprint stands once, under its smallest id; in a band's bucket each is
    held against the smallest id only, so a bucket gives no more pairs than it has members.
    """
    once = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))

    @F.pandas_udf("array<long>")
    def keys(x: pd.Series) -> pd.Series:
        return x.map(bands)

    @F.pandas_udf("double")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(x, y)], dtype=float)

    banded = once.select("doc_id", "fingerprint", F.explode(keys("fingerprint")).alias("band"))
    heads = banded.groupBy("band").agg(F.min_by(F.struct("doc_id", "fingerprint"), "doc_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = banded.join(heads, "band").filter("doc_id != head.doc_id").select(
        F.col("head.doc_id").alias("doc_id"), F.col("doc_id").alias("other_id"),
        F.col("head.fingerprint").alias("x"), F.col("fingerprint").alias("y")).distinct()
    return pairs.withColumn("near", near("x", "y")).filter(F.col("near") >= least).select("doc_id", "other_id", "near")
