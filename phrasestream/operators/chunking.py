"""Transcript stabilisation: revisable hypotheses to committed phrases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from phrasestream.functions.scalars import python_word_end
from phrasestream.functions.text import (
    common_prefix, normalise_words, python_cuts_after, python_is_conjunction, python_normalise, tokenise,
)
from phrasestream.plans.fold import Machine, fold_cut
from phrasestream.plans.ordered import (
    PIECES, TARGET_ROWS, Cut, cut_large_keys, neighbours, running, with_neighbours,
)
from phrasestream.plans.quantiles import exact_percentiles
from phrasestream.plans.stage import staged

SESSION = ["session_id"]
#: Words of a session's true text in one row, where chunks are compared with it.
TRUTH_BLOCK = 256
#: Words of two hypotheses that are compared at once.
STRETCH = 16
#: Texts whose pieces a task holds at a time.
TEXTS_AT_ONCE = 64


@dataclass(frozen=True)
class ChunkerConfig:
    agreement_n: int = 2
    min_words: int = 4
    max_words: int = 25
    max_wait_s: float = 1.0
    silence_commit_s: float = 0.6
    allow_conjunction_boundary: bool = True
    conjunction_threshold: float = 0.7

    def __post_init__(self):
        if self.agreement_n < 1:
            raise ValueError("agreement needs one hypothesis or more")
        if self.max_words < 1:
            raise ValueError("a piece has to hold one word or more")


# --- W1, W2 -------------------------------------------------------------------


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", tokenise(F.col("text"))).withColumn("words_n", F.size("tokens"))


def _after(taken: str, tokens: str):
    return normalise_words(F.slice(tokens, F.col(taken) + 1, F.size(tokens)))


# Words of the previous hypothesis, and leading normalised words shared with
# it; null on a session's first hypothesis. Most of a transcript repeats word
# for word, so only what follows the verbatim part is normalised.
_SHARED = {
    "_before": lambda w: F.lag("tokens").over(w),
    "previous_n": lambda w: F.lag("words_n").over(w),
    "_verbatim": lambda w: common_prefix(F.col("_before"), F.col("tokens")),
    "_tail": lambda w: common_prefix(_after("_verbatim", "_before"), _after("_verbatim", "tokens")),
    "shared": lambda w: F.col("_verbatim") + F.col("_tail"),
}
_SCRATCH = ("_before", "_verbatim", "_tail")


def agreed_prefix(hyps: DataFrame, n: int = 2, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Words the last `n` hypotheses agree on."""
    return _agreed(hyps, n, target_rows).plain().withColumn("norm", normalise_words(F.col("tokens")))


def _agreed(hyps: DataFrame, n: int, target_rows: int) -> Cut:
    """W1 on rows cut by session.

    The prefix common to n lists is the least of the prefixes common to the
    n-1 neighbouring pairs, so one comparison per row serves every n. A final
    counts as n copies of itself: pairs up to it are worth its own length.
    """
    if n < 1:
        raise ValueError("agreement needs one hypothesis or more")
    pair = F.struct(
        F.col("seq").alias("seq"),
        F.when(F.col("is_final"), F.col("words_n")).otherwise(F.col("shared")).alias("pair"),
    )

    def agreed(w):
        if n == 1:
            return F.col("words_n")
        last_n = w.rowsBetween(-(n - 1), 0)
        recent = F.collect_list(pair).over(w.rowsBetween(-(n - 2), 0))
        final_seq = F.when(F.col("is_final"), F.col("seq"))
        last_final = F.max(final_seq).over(last_n)
        final_n = F.max_by("words_n", final_seq).over(last_n)
        since = F.filter(recent, lambda p: last_final.isNull() | (p["seq"] > last_final))
        least = F.array_min(F.transform(since, lambda p: p["pair"]))
        unknown = (F.size(recent) < n - 1) | F.exists(recent, lambda p: p["pair"].isNull())
        return (
            F.when(last_final.isNotNull(), F.least(final_n, least)).when(unknown, 0).otherwise(least)
        )

    cut = cut_large_keys(hyps, SESSION, "seq", target_rows)
    return neighbours(
        cut, ["seq"], {**_SHARED, "agreed": agreed}, count=max(1, n - 1), before_windows=_words,
        drop=_SCRATCH,
    )


def first_seen(agreed: DataFrame) -> DataFrame:
    """When each agreed length was first reached; it is never reset."""
    sightings = agreed.groupBy("session_id", "agreed").agg(
        F.min(F.struct("seq", "t_wall")).getField("t_wall").alias("first_seen")
    )
    return agreed.join(sightings, ["session_id", "agreed"])


def agreed_first_seen(hyps: DataFrame, n: int = 2, target_rows: int = TARGET_ROWS) -> DataFrame:
    """W1 and W2 together. Where no session is cut, sightings are found where the rows
    already lie; otherwise they are aggregated and joined."""
    cut = _agreed(hyps, n, target_rows)
    agreed = cut.plain().withColumn("norm", normalise_words(F.col("tokens")))
    if cut.any:
        return first_seen(agreed)
    reached = Window.partitionBy("session_id", "agreed").orderBy("seq", "t_wall")
    return agreed.withColumn("first_seen", F.first("t_wall").over(reached.rowsBetween(Window.unboundedPreceding, 0)))


# --- T1, T3 ---------------------------------------------------------------------


def best_cut(cfg: ChunkerConfig, tokens: list[str], low: int, high: int) -> int:
    """Words to take from tokens[low:high] at its best boundary, or 0."""
    pending = high - low
    # Sizes a piece may have, longest first: one that ends a clause is taken; a long
    # wait also lets one end before a conjunction.
    sizes = range(pending, cfg.min_words - 1, -1)
    for n in sizes:
        if python_cuts_after(tokens[low + n - 1]):
            return n
    if cfg.allow_conjunction_boundary and pending >= cfg.conjunction_threshold * cfg.max_words:
        for n in sizes[1:]:
            if python_is_conjunction(tokens[low + n]):
                return n
    return 0


def shared_words(before: list[str], words: list[str]) -> int:
    """Leading words that two hypotheses agree on. Words are only normalised where they are
    not the same verbatim; most of a transcript is, and is passed over in stretches."""
    least = min(len(before), len(words))
    for at in range(0, least, STRETCH):
        if before[at:at + STRETCH] == words[at:at + STRETCH]:
            continue
        for n in range(at, min(at + STRETCH, least)):
            if before[n] != words[n] and python_normalise(before[n]) != python_normalise(words[n]):
                return n
    return least


def with_shared(previous: tuple | None, row: tuple, split=str.split) -> tuple:
    """A row of `PhraseMachine` with the words it shares with the previous one."""
    before = None if previous is None else split(previous[0])
    words = split(row[0])
    shared = None if before is None else shared_words(before, words)
    return (*row[:5], shared, None if before is None else len(before), len(words), *row[8:])


class PhraseMachine(Machine):
    """Commit rules for one session under one or more configurations.

    State: committed word count, first sighting of each longer agreed length,
    and the last pair agreements. Book: next chunk id, audio cursor, and
    whether committed words have been contradicted since the last chunk.
    """

    columns = ["text", "is_final", "t_audio_start", "t_audio_end", "t_wall",
               "shared", "previous_n", "words_n", "word_ends", "next_wall"]
    output = (
        "config_id int, chunk_id bigint, text string, t_audio_start double, t_audio_end double, "
        "t_wall_committed double, reason string, word_count int, stability_lag double, "
        "revised_after_commit boolean"
    )
    reach = 64

    def __init__(self, configs: list[ChunkerConfig], silence: bool, at_end: str):
        self.configs, self.silence, self.at_end = configs, silence, at_end
        # Configurations that cut alike have one number.
        rules = [(c.min_words, c.max_words, c.allow_conjunction_boundary, c.conjunction_threshold) for c in configs]
        self.rules = [rules.index(r) for r in rules]
        self.split = (None, [])

    def lanes(self):
        return list(enumerate(self.configs))

    def enrich(self, previous, row):
        """Words shared with the previous hypothesis, where no window has counted them."""
        return row if row[7] is not None else with_shared(previous, row, self._words_of)

    def _words_of(self, text):
        """A text's words; those of the last text are at hand."""
        if self.split[0] is not text:
            self.split = (text, text.split())
        return self.split[1]

    def prepare(self, row):
        """The last entry keeps what one lane has found on this row for the others."""
        return (self._words_of(row[0]), *row[1:], {})

    def start(self, lane):
        return [0, {}, []]

    def new_book(self):
        return [0, None, False]

    def merge_books(self, first, second):
        if second[0]:
            return [first[0] + second[0], second[1], second[2]]
        return [first[0], first[1], first[2] or second[2]]

    def freeze(self, state):
        committed, seen, pairs = state
        return [committed, sorted((n, t) for n, t in seen.items() if n > committed), pairs]

    def thaw(self, frozen):
        return [frozen[0], {n: t for n, t in frozen[1]}, list(frozen[2])]

    @staticmethod
    def _agree(n, pairs, row):
        """Pair agreements after this row, and the agreed length."""
        words, found = row[7], row[10]
        if n == 1:
            return pairs, words
        known = found.get(n)
        if known is not None and known[0] == pairs:
            return known[1], known[2]
        before, shared = pairs, row[5]
        if row[1]:
            pairs = [words] * (n - 1)
        elif shared is not None:
            pairs = (pairs + [shared])[-(n - 1):]
        agreed = min(min(pairs), words) if len(pairs) == n - 1 else 0
        found[n] = (before, pairs, agreed)
        return pairs, agreed

    def _commit(self, config_id, row, committed, take, reason, now, since, book, out):
        """Emit a phrase of the next `take` words; (committed, book) after it."""
        tokens, stop = row[0], committed + take
        heard = python_word_end(row[8], row[2], row[3], len(tokens), stop)
        out.append((
            config_id, book[0], " ".join(tokens[committed:stop]),
            book[1] if book[1] is not None else 0.0, heard, now, reason, take,
            max(0.0, now - since), book[2],
        ))
        return stop, [book[0] + 1, heard, False]

    def step(self, lane, state, book, row, out):
        config_id, cfg = lane
        committed, seen, pairs = state
        previous_n, wall = row[6], row[4]
        if committed and (
            row[7] < committed
            or (previous_n is not None and previous_n >= committed and row[5] < committed)
        ):
            book = [book[0], book[1], True]
        pairs, agreed = self._agree(cfg.agreement_n, pairs, row)
        if agreed > committed:
            seen.setdefault(agreed, wall)
            since, pending = seen[agreed], agreed - committed
            next_wall, found = row[9], row[10]
            if row[1]:
                while agreed > committed:
                    committed, book = self._commit(config_id, row, committed, min(agreed - committed, cfg.max_words), "final", wall, since, book, out)
            elif pending >= cfg.max_words:
                committed, book = self._commit(config_id, row, committed, cfg.max_words, "max_words", wall, since, book, out)
            else:
                place = (committed, agreed, self.rules[config_id])
                cut = found.get(place)
                if cut is None:
                    cut = found[place] = best_cut(cfg, row[0], committed, agreed)
                if cut:
                    committed, book = self._commit(config_id, row, committed, cut, "clause", wall, since, book, out)
                elif wall - since >= cfg.max_wait_s and pending >= cfg.min_words:
                    committed, book = self._commit(config_id, row, committed, pending, "stability_timeout", wall, since, book, out)
            if self.silence and next_wall is not None and next_wall - wall >= cfg.silence_commit_s:
                while agreed > committed:
                    committed, book = self._commit(config_id, row, committed, min(agreed - committed, cfg.max_words), "silence", wall + cfg.silence_commit_s, since, book, out)
        if len(seen) > 32:
            seen = {n: t for n, t in seen.items() if n > committed}
        return [committed, seen, pairs], book

    def finish(self, lane, state, book, row, out):
        if self.at_end == "none":
            return
        config_id, cfg = lane
        committed, seen, pairs = state
        agreed = self._agree_now(cfg.agreement_n, pairs, row)
        now = row[4] + (cfg.silence_commit_s if self.at_end == "silence" else 0.0)
        while agreed > committed:
            committed, book = self._commit(config_id, row, committed, min(agreed - committed, cfg.max_words), self.at_end, now, seen.get(agreed, 0.0), book, out)

    def after_finish(self, lane, state, book, emitted):
        if not emitted:
            return state, book
        words = sum(row[7] for row in emitted)
        return [state[0] + words, state[1], state[2]], [book[0] + len(emitted), emitted[-1][4], False]

    @staticmethod
    def _agree_now(n, pairs, row):
        if n == 1:
            return row[7]
        return min(min(pairs), row[7]) if len(pairs) == n - 1 else 0

    def candidates(self, lane, rows):
        n = lane[1].agreement_n
        pairs, seen, top = [], {}, 0
        for row in rows:
            pairs, agreed = self._agree(n, pairs, row)
            seen.setdefault(agreed, row[4])
            top = max(top, agreed)
        return [
            [c, {k: t for k, t in seen.items() if k > c}, list(pairs)]
            for c in range(max(0, top - self.reach), top + 1)
        ]


class ReplayMachine(PhraseMachine):
    """The phrases of a whole session, one row a configuration, held until the last hypothesis
    is there to be compared with. A lane commits no more words than one hypothesis has, so
    each holds no more than the words of one row. Sessions must not be cut."""

    output = ("config_id int, sizes array<int>, late array<double>, given array<string>, "
              "wrong int, truth_n int")

    def new_book(self):
        return [super().new_book(), []]

    def step(self, lane, state, book, row, out):
        state, book[0] = super().step(lane, state, book[0], row, book[1])
        return state, book

    def finish(self, lane, state, book, row, out):
        chunks, truth = book[1], row[0]
        super().finish(lane, state, book[0], row, chunks)
        said = " ".join([c[2] for c in chunks]).split()
        out.append((
            lane[0], [c[7] for c in chunks], [c[5] - c[4] for c in chunks], [c[6] for c in chunks],
            sum(map(ne, said, truth)), len(truth),
        ))


def _fold_rows(hyps: DataFrame) -> DataFrame:
    has = hyps.columns
    ends = (
        F.transform("words", lambda w: w["t_audio_end"]) if "words" in has
        else F.lit(None).cast("array<double>")
    )
    return hyps.select(
        "session_id", "seq", "text", "is_final", "t_audio_start", "t_audio_end", "t_wall",
        ends.alias("word_ends"),
    )


def _fold_inputs(hyps: DataFrame, silence: bool, target_rows: int) -> Cut:
    return _with_shared(cut_large_keys(_fold_rows(hyps), SESSION, "seq", target_rows), silence)


def _with_shared(cut: Cut, silence: bool) -> Cut:
    if silence:
        cut = neighbours(
            cut, ["seq"], {"next_wall": lambda w: F.lead("t_wall").over(w)}, count=1, following=True
        )
    else:
        cut = cut.map(lambda df: df.withColumn("next_wall", F.lit(None).cast("double")))
    if not cut.any:  # the machine sees the previous row itself: texts move once
        missing = F.lit(None).cast("int")
        return cut.map(lambda df: df.withColumns({"shared": missing, "previous_n": missing, "words_n": missing}))
    return neighbours(
        cut, ["seq"], _SHARED, count=1, before_windows=_words, drop=(*_SCRATCH, "tokens")
    )


def commit_phrases(
    hyps: DataFrame, config: ChunkerConfig = ChunkerConfig(), silence: bool = False,
    at_end: str = "final", target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Committed phrases of every session.

    `silence` commits stable text when the next hypothesis is
    `silence_commit_s` or more away, as the streaming form does with a timer.
    `at_end` is what happens to stable text after the last hypothesis:
    "final", "silence" or "none".
    """
    if at_end not in ("final", "silence", "none"):
        raise ValueError(f"at_end must be final, silence or none, not {at_end!r}")
    machine = PhraseMachine([config], silence, at_end)
    return fold_cut(_fold_inputs(hyps, silence, target_rows), "seq", machine).drop("config_id")


def sweep_configs(
    agreement=(1, 2, 3), waits=(0.3, 0.6, 1.0, 1.5), min_words: int = 4, max_words: int = 25
) -> list[ChunkerConfig]:
    return [
        ChunkerConfig(agreement_n=a, max_wait_s=w, min_words=min_words, max_words=max_words)
        for a in agreement for w in waits
    ]


def sweep_chunks(
    hyps: DataFrame, configs: list[ChunkerConfig], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Phrases under every configuration. All configurations read each
    hypothesis once; nothing is multiplied before the shuffle."""
    machine = PhraseMachine(list(configs), False, "final")
    return fold_cut(_fold_inputs(hyps, False, target_rows), "seq", machine)


def sweep_metrics(
    hyps: DataFrame, configs: list[ChunkerConfig], target_rows: int = TARGET_ROWS
) -> DataFrame:
    """The replay metrics of every session's phrases under every configuration,
    held against its last hypothesis. Hypotheses move once and phrases not at all: a session
    leaves its task as one row a configuration. Only phrases of sessions above `target_rows`
    are written and joined with their transcripts."""
    cut = cut_large_keys(_fold_rows(hyps), SESSION, "seq", target_rows)
    whole = replace(cut, rows=cut.rows.filter(F.col(PIECES) == 1), any=False)
    sessions = fold_cut(_with_shared(whole, False), "seq", ReplayMachine(list(configs), False, "final"))
    metrics = session_metrics(sessions)
    if not cut.any:
        return metrics
    pieces = _with_shared(replace(cut, rows=cut.large), False)
    chunks = staged(fold_cut(pieces, "seq", PhraseMachine(list(configs), False, "final")), "sweep")
    long = replay_metrics(chunks, final_transcripts(cut.large), list(range(len(configs))))
    return metrics.unionByName(long)


def session_metrics(sessions: DataFrame) -> DataFrame:
    """A8 on the rows of `ReplayMachine`: what `replay_metrics` has, without a shuffle."""
    n = F.size("sizes")
    said = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    late = F.sort_array(F.transform("late", lambda x: F.greatest(F.lit(0.0), x)))

    def quantile(p):  # between two neighbours, as Spark's percentile weighs them
        at = (n - 1) * F.lit(p)
        below, above = F.floor(at).cast("int"), F.ceil(at).cast("int")
        low, high = F.get("_late", below), F.get("_late", above)
        return F.when(low == high, low).otherwise((above - at) * low + (at - below) * high)

    # Reasons in the order of their first phrases, with counts.
    counts = F.transform(F.array_distinct("given"), lambda r, i: F.struct(
        F.size(F.filter("given", lambda x: x == r)).cast("bigint").alias("n"), (-i).alias("first"), r.alias("reason")))
    reasons = F.sort_array(F.transform("_counts", lambda c: F.struct(c["reason"], c["n"])))
    rate = (F.col("wrong") + F.abs(said - F.col("truth_n"))) / F.col("truth_n")
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return sessions.withColumns({"_late": late, "_counts": counts}).select(
        "config_id", "session_id", n.cast("bigint").alias("chunks"), zero(said / n).alias("mean_words"),
        zero(quantile(0.5)).alias("p50"), zero(quantile(0.95)).alias("p95"), zero(F.get("_late", n - 1)).alias("max"),
        F.when(F.col("truth_n") > 0, rate).otherwise(0.0).alias("wrong_word_rate"),
        F.when(n > 0, F.map_from_entries(reasons)).alias("reasons"), F.array_max("_counts")["reason"].alias("top_reason"),
    )


def final_transcripts(hyps: DataFrame) -> DataFrame:
    """The words of each session's last hypothesis."""
    last = hyps.groupBy("session_id").agg(
        F.max(F.struct("seq", "text")).getField("text").alias("truth_text")
    )
    return last.select("session_id", tokenise(F.col("truth_text")).alias("truth"))


def truth_blocks(truth: DataFrame) -> DataFrame:
    """session_id, _block, _words: each session's words, `TRUTH_BLOCK` in a row."""
    last = F.floor((F.size("truth") - 1) / TRUTH_BLOCK).cast("int")
    blocks = truth.filter(F.size("truth") > 0).select("session_id", "truth", F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    return blocks.select("session_id", "_block", F.slice("truth", F.col("_block") * TRUTH_BLOCK + 1, F.lit(TRUTH_BLOCK)).alias("_words"))


def replay_metrics(
    chunks: DataFrame, truth: DataFrame, config_ids: list[int] | None = None
) -> DataFrame:
    """Latency and accuracy per session (and configuration, if given).

    The positional comparison needs each chunk's place in the committed text,
    a running word count; mismatches are then counted chunk by chunk, so no
    session's text is ever put together in one place. Sessions that committed
    nothing are reported with zeros and every truth word wrong.
    """
    keys = ["session_id"] if config_ids is None else ["config_id", "session_id"]
    late = F.greatest(F.lit(0.0), F.col("t_wall_committed") - F.col("t_audio_end"))
    timed = chunks.withColumn("latency", late)
    rows = running(
        timed, keys, ["chunk_id"],
        {"_before": ("sum", F.col("word_count"))}, inclusive=False,
    ).withColumn("_before", F.coalesce("_before", F.lit(0)).cast("int"))
    # A chunk meets the blocks of the truth that its words fall into, one or two of them.
    start, end = F.col("_before"), F.col("_before") + F.col("word_count")
    block_of = lambda word: F.floor(word / TRUTH_BLOCK).cast("int")
    pieces = rows.select(
        *keys, "word_count", "latency", "_before", "text",
        F.explode(F.sequence(block_of(start), F.greatest(block_of(end - 1), block_of(start)))).alias("_block"),
    ).withColumn("_first", F.col("_block") == block_of(start))
    # Where the block begins in the chunk (below 0 if it began before), and the chunk in the block.
    behind = F.col("_block") * TRUTH_BLOCK - start
    heard = F.slice(F.col("_words"), F.greatest(F.lit(1), 1 - behind), F.lit(TRUTH_BLOCK))
    said = F.slice(tokenise(F.col("text")), F.greatest(F.lit(1), 1 + behind), F.col("word_count"))
    wrong = F.size(F.filter(
        F.zip_with(said, heard, lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)),
        lambda differs: differs,
    ))
    compared = pieces.join(truth_blocks(truth), ["session_id", "_block"], "left")
    once = lambda value: F.when(F.col("_first"), value)
    totals = compared.groupBy(*keys).agg(
        F.count_if("_first").alias("chunks"),
        F.avg(once(F.col("word_count"))).alias("mean_words"),
        F.max("latency").alias("max"),
        F.sum(F.when(F.col("_words").isNotNull(), wrong)).alias("_wrong"),
        F.sum(once(F.col("word_count"))).alias("_said"),
    )
    sessions = truth.select("session_id", F.size("truth").alias("_truth"))
    if config_ids is not None:
        ids = F.array(*[F.lit(i).cast("int") for i in config_ids])
        sessions = sessions.select("session_id", "_truth", F.explode(ids).alias("config_id"))
    quantiles = exact_percentiles(timed, keys, "latency", {"p50": 0.5, "p95": 0.95})
    joined = (
        sessions.join(totals, keys, "left").join(quantiles, keys, "left")
        .join(reason_counts(chunks, keys), keys, "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = (zero("_wrong") + F.abs(zero("_said") - F.col("_truth"))) / F.col("_truth")
    return joined.select(
        *keys, zero("chunks").cast("bigint").alias("chunks"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mean_words", "p50", "p95", "max")],
        F.when(F.col("_truth") > 0, rate).otherwise(0.0).alias("wrong_word_rate"),
        "reasons", "top_reason",
    )


def reason_counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Reason counts per key, as a map, and the most frequent (first seen wins)."""
    per = chunks.groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first")
    )
    return per.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"),
        F.max_by("reason", F.struct(F.col("n"), -F.col("first"))).alias("top_reason"),
    )


def sweep_table(metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Configurations by p95, then wrong-word rate."""
    ranked = metrics.orderBy("p95", "wrong_word_rate", *[c for c in metrics.columns if c.endswith("_id")])
    return ranked if limit is None else ranked.limit(limit)


# --- A7, F5, F6, W9 ------------------------------------------------------------------


def commit_reason_mix(chunks: DataFrame) -> DataFrame:
    """Count and share per reason, flagging the most frequent one."""
    per = chunks.groupBy("session_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first")
    )
    session = Window.partitionBy("session_id")  # at most one row per reason
    top = F.row_number().over(session.orderBy(F.col("n").desc(), F.col("first")))
    return per.select(
        "session_id", "reason", "n",
        (F.col("n") / F.sum("n").over(session)).alias("share"),
        (top == 1).alias("is_top"),
    )


def revision_rate(chunks: DataFrame, by: list[str]) -> DataFrame:
    """F5."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("revised_after_commit").alias("revised"),
        F.avg(F.col("revised_after_commit").cast("int")).alias("revision_rate"),
    )


def pass_through_check(chunks: DataFrame, by: list[str]) -> DataFrame:
    """whether every commit was a final, so that chunking added nothing."""
    return chunks.groupBy(*by).agg(F.bool_and(F.col("reason") == "final").alias("pass_through"))


def span_contiguity(chunks: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Ids dense from 0, each start the previous end, end not before start."""
    rows = with_neighbours(
        chunks.select("session_id", "chunk_id", "t_audio_start", "t_audio_end"),
        SESSION, ["chunk_id"],
        {
            "_id": lambda w: F.lag("chunk_id").over(w),
            "_end": lambda w: F.lag("t_audio_end").over(w),
        },
        count=1, target_rows=target_rows,
    )
    return rows.select(
        "session_id", "chunk_id",
        (F.col("chunk_id") == F.coalesce(F.col("_id") + 1, F.lit(0))).alias("dense"),
        (F.col("t_audio_start") == F.coalesce("_end", F.lit(0.0))).alias("contiguous"),
        (F.col("t_audio_end") >= F.col("t_audio_start")).alias("ordered"),
    )


# --- P7 ---------------------------------------------------------------------------------


def segment_clauses(
    docs: DataFrame, id_column: str, min_words: int = 4, max_words: int = 25,
    conjunction_threshold: float = 0.7,
) -> DataFrame:
    """Cut each text into clause-aligned pieces, as a fully stable text
    would be: take the best boundary in the next `max_words` words, or all of
    them when there is none. One text is one row; a short loop over its words
    finds the cuts, and pieces leave the task after a few texts."""
    config = ChunkerConfig(
        min_words=min_words, max_words=max_words, conjunction_threshold=conjunction_threshold
    )

    def cut(text):
        tokens, at = (text or "").split(), 0
        while at < len(tokens):
            high = min(at + max_words, len(tokens))
            size = best_cut(config, tokens, at, high) or high - at
            yield " ".join(tokens[at:at + size]), size
            at += size

    result = StructType([docs.schema[id_column], *_parse_datatype_string("piece int, text string, word_count int").fields])
    arrow = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                rows = [(i, n, *piece) for i, text in enumerate(batch.column(1).to_pylist()) for n, piece in enumerate(cut(text))]
                if rows:
                    of, *columns = zip(*rows)
                    arrays = [batch.column(0).take(pa.array(of)), *map(pa.array, columns)]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return docs.select(id_column, "text").mapInArrow(run, result)


# --- W10 ----------------------------------------------------------------------------------


def restamp_words(hyps: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The audio end each word of each hypothesis is stamped with.

    A word keeps the stamp it got when the text up to and including it first
    appeared; any earlier difference re-stamps the whole tail. With `kept` the
    words a row shares with the row before, word i of row r is stamped at the
    latest row up to r with kept <= i.
    """
    slim = hyps.select("session_id", "seq", "text", "t_audio_end")
    cut = cut_large_keys(slim, SESSION, "seq", target_rows)
    if cut.any:
        cut = neighbours(
            cut, ["seq"],
            {"kept": lambda w: F.coalesce(common_prefix(F.lag("tokens").over(w), F.col("tokens")), F.lit(0))},
            count=1, before_windows=lambda df: df.withColumn("tokens", tokenise(F.col("text"))),
            drop=("tokens",),
        )
    else:  # the machine sees the previous row itself: texts move once
        cut = cut.map(lambda df: df.withColumn("kept", F.lit(None).cast("int")))
    stamps = lambda i: F.get("stamps", i)
    words = F.transform(tokenise(F.col("text")), lambda word, i: F.struct(
        word.alias("word"), F.when(i == 0, F.lit(0.0)).otherwise(stamps(i - 1)).alias("t_audio_start"),
        stamps(i).alias("t_audio_end")))
    return fold_cut(cut, "seq", StampMachine()).select("session_id", "seq", words.alias("words"))


class StampMachine(Machine):
    """State: runs of equal stamps as [first word, stamp], in word order."""

    columns = ["seq", "text", "kept", "t_audio_end"]
    output = "seq bigint, text string, stamps array<double>"
    look_back = 512

    def enrich(self, previous, row):
        if row[2] is not None:
            return row
        kept = 0
        if previous is not None:
            for before, word in zip(previous[1].split(), row[1].split()):
                if before != word:
                    break
                kept += 1
        return (*row[:2], kept, row[3])

    def prepare(self, row):
        return (*row[:3], len(row[1].split()), row[3])

    def start(self, lane):
        return []

    @staticmethod
    def _runs(state, row):
        _seq, _text, kept, words_n, end = row
        state = [run for run in state if run[0] < kept]
        if kept < words_n:
            state.append([kept, end])
        return state

    def step(self, lane, state, book, row, out):
        state, stamps = self._runs(state, row), []
        for (first, stamp), (after, _) in zip(state, [*state[1:], (row[3], None)]):
            stamps += [stamp] * (after - first)
        out.append((row[0], row[1], stamps))
        return state, book

    def candidates(self, lane, rows):
        state = []
        for row in rows:
            state = self._runs(state, row)
        return [state]
