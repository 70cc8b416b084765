"""LM scoring by prediction by partial matching (PPM).

Texts are lower-cased (A-Z) words and one end. The model codes them byte by byte: the words
with a space between two, then an end-of-text sign. A byte is predicted from the `ORDER` bytes
before it, across words (before a text's first byte stand start signs). A sign the context
has not been followed by is coded by an escape (method D: half a use of each different sign
is the escape's) to the next shorter context, in which the signs that the longer ones would
have predicted are excluded. Below the empty context all signs are equally likely.

A gram is a sign with its whole context. Texts are worked on in blocks; a block sends each of
its distinct grams once, with its uses in the block's training texts. Counts are over all
training texts and none is left out: the trie is a table of all contexts and signs, which grows
with the input. It is worked on order by order, dealt out by the next shorter context, so a
group has at most 256 x 257 rows. Costs go back to the blocks that asked, by shares of grams
of bounded size, and a block adds up what its texts' signs cost. No task and not the driver
holds the trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.llm.toxicity import LOWER
from phrasestream.plans.stage import staged

#: Bytes of context; with the sign they have to fit in 63 bits.
ORDER = 5
BLOCK_BYTES = 16 << 20
#: Signs worked on at once.
PIECE = 1 << 20
#: Distinct grams, and asked ones of all blocks, in a share of the costs.
SHARE_GRAMS, SHARE_ASKED = 200_000, 4_000_000
#: Signs that no word has: before a text, between words, end of a text.
START, SPACE, END_TEXT = 0x09, 0x20, 0x0A
SIGNS = 256
#: The end as a word of the word table.
END = b" "


def _packed(a: np.ndarray, effort: int = 1) -> bytes:
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=effort).compress(planes.tobytes())


def _unpacked(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Spans of bytes as a binary array."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def signs_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """All texts as signs, one after the other: `order` start signs, the words with a space
    between two, the end. Words are spans of `data`; `first`: where each text's words begin."""
    counts = np.diff(first)
    taken = np.append(0, np.cumsum(lengths + 1))
    sizes = order + np.maximum(taken[first[1:]] - taken[first[:-1]], 1)
    ends = np.cumsum(sizes) - 1
    begin = ends + 1 - sizes
    text = np.repeat(np.arange(len(counts)), counts)
    of_word = np.ones(int(sizes.sum()), bool)
    of_word[(begin + order - taken[first[:-1]])[text] + taken[1:] - 1] = False  # the place after each word
    of_word[ends] = False
    for j in range(order):
        of_word[begin + j] = False
    out = np.full(len(of_word), SPACE, np.uint8)
    for j in range(order):
        out[begin + j] = START
    out[ends] = END_TEXT
    # The words' bytes stand in the same order in both.
    to = int(starts[-1] + lengths[-1]) if len(starts) else 0
    out[of_word] = data[:to][~W.SPACES[data[:to]]]
    return out


def grams_of(signs: np.ndarray, a: int, b: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that end at places `a` to `b` of the signs (not at start signs), and these places."""
    a = max(a, order)  # a text begins with start signs
    at = a + np.flatnonzero(signs[a:b] != START)
    gram = np.zeros(max(b - a, 0), np.uint64)
    for j in range(order, -1, -1):
        gram = (gram << np.uint64(8)) | signs[a - j : b - j]
    return gram[at - a], at


def _merged(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and their sums."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    cuts = np.flatnonzero(np.diff(grams, prepend=grams[:1] + np.uint64(1)))
    return grams[cuts], np.add.reduceat(n, cuts) if len(cuts) else n


def counted(signs: np.ndarray, train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts, sorted, and their uses in the training ones (`train`, by text)."""
    found: list = []
    text = 0
    for a in range(0, len(signs), PIECE):
        b = min(a + PIECE, len(signs))
        gram, at = grams_of(signs, a, b, order)
        ends = np.cumsum(signs[a:b] == END_TEXT)
        who = text + ends[at - a] - (signs[at] == END_TEXT)
        text += int(ends[-1])
        keys = np.sort((gram << np.uint64(1)) | train[who].astype(np.uint64))
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
        uses = np.diff(np.append(cuts, len(keys)))
        found.append((keys[cuts] >> np.uint64(1), np.where(keys[cuts] & np.uint64(1), uses, 0)))
        if len(found) > 1:
            found = [_merged(*(np.concatenate(x) for x in zip(*found)))]
    return _merged(*found[0]) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


_BLOCKS = ("block long, ids array<long>, held array<boolean>, sizes binary, steps binary, words array<binary>, uses array<long>, "
           "signs binary, asked long, grams binary, counts binary")


def _blocks(order: int):
    """One row for each block of texts: their ids and sizes, their words as sorted places in
    the block's word list, that list, how often the training texts use each, the texts' signs,
    and their distinct grams with uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        for part in W.slices(batches, most=BLOCK_BYTES):
            yield _block(part, no, order)
            no += 1

    return run


def _block(part: pa.RecordBatch, no: int, order: int) -> pa.RecordBatch:
    data, offsets = W.flat(part.column("text"))
    data = LOWER[data]
    starts, lengths, first = W.words(data, offsets)
    train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    signs = signs_of(data, starts, lengths, first, order)
    grams, counts = counted(signs, train, order)
    h = W.hash_spans(data, starts, lengths)
    _, where, place = np.unique(h, return_index=True, return_inverse=True)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    uses = np.append(np.bincount(place[train[text]], minlength=len(where)), train.sum()).astype(np.int64)
    at = (np.sort(text << 32 | place) & 0xFFFFFFFF).astype(np.int64)
    step = np.diff(at, prepend=0)
    heads = first[:-1][sizes > 0]
    step[heads] = at[heads]
    listed = pa.concat_arrays([_strings(data, starts[where], lengths[where]), pa.array([END], pa.binary())])
    one = pa.array([0, len(listed)], pa.int32())
    rows = pa.array([0, part.num_rows], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([no]), pa.ListArray.from_arrays(rows, part.column("doc_id")), pa.ListArray.from_arrays(rows, part.column("held_out")),
         pa.array([_packed(sizes.astype(np.int32))]), pa.array([_packed(step.astype(np.uint32), 6)]),
         pa.ListArray.from_arrays(one, listed), pa.ListArray.from_arrays(one, pa.array(uses)),
         pa.array([_packed(signs, 6)]), pa.array([len(grams)]), pa.array([_packed(np.diff(grams, prepend=np.uint64(0)))]),
         pa.array([_packed(counts.astype(np.int64))])],
        [f.split()[0] for f in _BLOCKS.split(", ")])


def _gram_rows(batches):
    """(gram, n): grams of blocks and their uses, summed over the blocks at hand."""
    for grams, n in _bunches(batches):
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])


def _bunches(batches, most: int = 1_000_000):
    have, size = [], 0
    for batch in batches:
        for g, c in zip(batch.column("grams"), batch.column("counts")):
            have.append((np.cumsum(_unpacked(g.as_py(), np.uint64)), _unpacked(c.as_py(), np.int64)))
            size += len(have[-1][0])
            if size > most:
                have = [_merged(*(np.concatenate(x) for x in zip(*have)))]
                size = len(have[0][0])
                if size > most:
                    yield have[0]
                    have, size = [], 0
    if size:
        yield _merged(*(np.concatenate(x) for x in zip(*have)))


def level(grams: np.ndarray, n: np.ndarray, order: int, above: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the grams of one order (sorted, whole contexts; `n`: uses): what the sign costs
    where this context is the longest looked for, and what it costs below this context
    once that has been seen without it. `above`: the grams of the next shorter contexts
    (sorted, whole), their uses and their two logs; none for the empty context."""
    _, first, node = np.unique(grams >> np.uint64(8), return_index=True, return_inverse=True)
    mass, width = (np.add.reduceat(x.astype(np.float64), first) for x in (n, n > 0))
    if above is None:
        below = -np.log(np.maximum(SIGNS - width, 1))[node]
        unseen = below
    else:
        parents, pn, pcost, pbelow = above
        _, pfirst, pnode = np.unique(parents >> np.uint64(8), return_index=True, return_inverse=True)
        pmass, pwidth = (np.add.reduceat(x.astype(np.float64), pfirst) for x in (pn, pn > 0))
        at = np.searchsorted(parents, grams & np.uint64((1 << 8 * order) - 1))
        shared = np.add.reduceat(np.where(n > 0, pn[at], 0).astype(np.float64), first)
        over_node = pnode[at[first]]
        left = pwidth[over_node] - width
        over = np.maximum(pmass[over_node] - shared, 1e-300)
        step = np.where(left > 0, np.log(np.maximum(left, 1e-300) / 2 / over), 0.0)
        below = np.where(pn[at] > 0, np.log(np.maximum(pn[at], 1) - 0.5) - np.log(over)[node], step[node] + pbelow[at])
        unseen = pcost[at]
    total = np.maximum(mass, 1)
    hit = np.log(np.maximum(n, 1) - 0.5) - np.log(total)[node]
    escape = np.log(np.maximum(width, 1) / 2 / total)[node] + below
    return np.where(mass[node] > 0, np.where(n > 0, hit, escape), unseen), below


def _dealt(grams: np.ndarray, shares: int):
    """(share, places) of sorted grams, dealt out by hash; places keep their order."""
    share = (W.mix(grams) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    cuts = np.flatnonzero(np.diff(share[order], prepend=-1))
    return [(int(share[order[a]]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(order)])]


def _trie(order: int, shares: int | None = None):
    """(gram, n, cost, below) of the grams of one order, which come sorted by `key`, their
    next shorter context, with that context's grams, which have their logs. With `shares`, only
    grams and costs, packed by share."""

    def solved(waiting):
        gram, n, cost, below = (np.concatenate([b.column(x).to_numpy(zero_copy_only=False) for b in waiting]) for x in ("gram", "n", "cost", "below"))
        gram = gram.view(np.uint64)
        given = ~np.isnan(cost)
        at = np.argsort(gram[given])
        above = tuple(x[given][at] for x in (gram, n, cost, below)) if given.any() else None
        at = np.argsort(gram[~given])
        mine, uses = gram[~given][at], n[~given][at]
        cost, below = level(mine, uses, order, above)
        if shares is None:
            yield pa.RecordBatch.from_arrays([pa.array(mine.view(np.int64)), pa.array(uses), pa.array(cost), pa.array(below)],
                                             ["gram", "n", "cost", "below"])
            return
        for share, at in _dealt(mine, shares):
            yield pa.RecordBatch.from_arrays(
                [pa.array([share]), pa.array([_packed(np.diff(mine[at], prepend=np.uint64(0)))]), pa.array([_packed(cost[at].astype(np.float32))])],
                ["share", "grams", "costs"])

    def run(batches):
        waiting, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # what is before the last key is whole
            if size > 300_000 and (cut or key[0] != last):
                yield from solved([*waiting, *([batch.slice(0, cut)] if cut else [])])
                waiting, size, batch = [], 0, batch.slice(cut)
            waiting.append(batch)
            size += batch.num_rows
            last = key[-1]
        if waiting:
            yield from solved(waiting)

    return run


def costs_of(order: int, shares: int, grams: DataFrame) -> DataFrame:
    """(share, grams, costs): natural logs of all grams, packed. `grams`: those of the longest contexts."""
    tables = [grams]
    for k in range(order - 1, -1, -1):
        shorter = tables[0].groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        tables.insert(0, staged(shorter, f"lm-grams{k}"))
    made = None
    for k, table in enumerate(tables):
        context = F.shiftrightunsigned("gram", 8)
        rows = table.select("gram", "n", *(F.lit(float("nan")).alias(x) for x in ("cost", "below")),
                            context.bitwiseAND((1 << 8 * max(k - 1, 0)) - 1).alias("key"))
        if made is not None:
            rows = rows.unionByName(made.withColumn("key", context))
        rows = rows.repartition("key").sortWithinPartitions("key")
        if k == order:
            return rows.mapInArrow(_trie(k, shares), "share long, grams binary, costs binary")
        made = staged(rows.mapInArrow(_trie(k), "gram long, n long, cost double, below double"), f"lm-level{k}")


def _asks(shares: int):
    """(share, block, grams): the grams of each block, by share."""

    def run(batches):
        for batch in batches:
            for block, packed in zip(batch.column("block"), batch.column("grams")):
                grams = np.cumsum(_unpacked(packed.as_py(), np.uint64))
                for share, at in _dealt(grams, shares):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([share]), pa.array([block.as_py()]), pa.array([_packed(np.diff(grams[at], prepend=np.uint64(0)))])],
                        ["share", "block", "grams"])

    return run


def _answers(batches):
    """(block, share, costs): what is asked, in its order; a share's costs come before its asks."""
    now, pieces, grams, costs = None, [], None, None
    for batch in batches:
        for share, block, g, c in zip(*(batch.column(x).to_pylist() for x in ("share", "block", "grams", "costs"))):
            if share != now:
                now, pieces, grams = share, [], None
            g = np.cumsum(_unpacked(g, np.uint64))
            if block is None:
                pieces.append((g, _unpacked(c, np.float32)))
                continue
            if grams is None:
                grams, costs = (np.concatenate(x) for x in zip(*pieces))
                by = np.argsort(grams)
                grams, costs, pieces = grams[by], costs[by], []
            found = costs[np.searchsorted(grams, g)]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([share]), pa.array([_packed(found)])], ["block", "share", "costs"])


def _sent_back(batches):
    """Rows (block, places, counts) of the words' uses, packed for each block."""
    have, size = [], 0

    def rows():
        block, pos, c = (np.concatenate(x) for x in zip(*have))
        order = np.lexsort((pos, block))
        block, pos, c = block[order], pos[order], c[order]
        cuts = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        out = [(int(block[a]), _packed(np.diff(pos[a:b], prepend=0).astype(np.uint32)), _packed(c[a:b]))
               for a, b in zip(cuts, [*cuts[1:], len(block)])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["block", "places", "counts"])

    for batch in batches:
        if batch.num_rows:
            have.append([batch.column(k).to_numpy() for k in ("block", "pos", "c")])
            size += batch.num_rows
        if size > 1_000_000:
            yield rows()
            have, size = [], 0
    if have:
        yield rows()


def coded(signs: np.ndarray, grams: np.ndarray, costs: np.ndarray, texts: int, order: int) -> np.ndarray:
    """The cost of each text: the sum of its signs' costs."""
    out = np.zeros(texts)
    text = 0
    for a in range(0, len(signs), PIECE):
        b = min(a + PIECE, len(signs))
        gram, at = grams_of(signs, a, b, order)
        ends = np.cumsum(signs[a:b] == END_TEXT)
        who = text + ends[at - a] - (signs[at] == END_TEXT)
        text += int(ends[-1])
        by = np.argsort(gram)
        heads = np.flatnonzero(np.diff(gram[by], prepend=gram[by][:1] + np.uint64(1)))
        each = np.repeat(costs[np.searchsorted(grams, gram[by[heads]])], np.diff(np.append(heads, len(by))))
        cost = np.empty(len(by))
        cost[by] = each  # in the order of the text, so that equal texts have equal sums
        out += np.bincount(who, cost, texts)
    return out


def _summed(train_tokens: int, distinct: int, shares: int, order: int):
    norm = np.log10(train_tokens + 0.5 * (distinct + 1))

    def texts(row, c, answers):
        sizes = _unpacked(row["sizes"], np.int32).astype(np.int64)
        steps = _unpacked(row["steps"], np.uint32).astype(np.int64)
        n, end = len(sizes), len(c) - 1
        text = np.repeat(np.arange(n), sizes)
        total = np.cumsum(steps)
        begin = np.cumsum(sizes) - sizes
        base = np.zeros(n, np.int64)
        full = sizes > 0
        base[full] = total[begin[full]] - steps[begin[full]]
        at = total - base[text]
        weigh = np.log10(c + 0.5)
        grams = np.cumsum(_unpacked(row["grams"], np.uint64))
        costs = np.zeros(len(grams))
        for share, places in _dealt(grams, shares):
            costs[places] = answers[share]
        score = coded(_unpacked(row["signs"], np.uint8), grams, costs, n, order) / np.log(10)
        return pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes + 1),
             pa.array(np.bincount(text, c[at] > 0, n).astype(np.int64) + int(c[end] > 0)), pa.array(np.full(n, train_tokens)),
             pa.array(np.bincount(text, weigh[at], n) + weigh[end] - (sizes + 1) * norm), pa.array(score)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches):
        places, answers = [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["kind"] == 0:
                    places.append((np.cumsum(_unpacked(row["places"], np.uint32), dtype=np.int64), _unpacked(row["counts"], np.int64)))
                elif row["kind"] == 1:
                    answers[row["share"]] = _unpacked(row["costs"], np.float32)
                else:
                    c = np.zeros(sum(len(p) for p, _ in places), np.int64)
                    for place, counts in places:
                        c[place] = counts
                    yield texts(row, c, answers)
                    places, answers = [], {}

    return run


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    `docs`: doc_id, text, held_out; texts that are not held out are the training texts. A null
    text is empty, which is one end. Null ids stay, repeated rows count by themselves. Without
    training texts all signs are equally likely. Other columns are not read.
    """
    blocks = staged(W.text_frame(docs, "doc_id", "text", "held_out").mapInArrow(_blocks(order), _BLOCKS), "lm-blocks")
    used = blocks.select("block", F.posexplode(F.arrays_zip("words", "uses")).alias("pos", "x")).select(
        "block", "pos", F.col("x.words").alias("word"), F.col("x.uses").alias("c"))
    words = staged(used.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    grams = staged(blocks.select("grams", "counts").mapInArrow(_gram_rows, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")), "lm-grams")
    asked = blocks.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    shares = int(1 + max(grams.count() // SHARE_GRAMS, asked // SHARE_ASKED))
    none = F.lit(None)
    priced = costs_of(order, shares, grams).select("share", none.cast("long").alias("block"), "grams", "costs")
    asks = blocks.select("block", "grams").mapInArrow(_asks(shares), "share long, block long, grams binary").withColumn(
        "costs", none.cast("binary"))
    answers = priced.unionByName(asks).repartition("share").sortWithinPartitions("share", F.col("block").isNotNull()).mapInArrow(
        _answers, "block long, share long, costs binary")
    back = used.select("block", "pos", "word").join(words, "word").select("block", "pos", "c").mapInArrow(
        _sent_back, "block long, places binary, counts binary")
    last = blocks.select("block", "ids", "held", "sizes", "steps", "signs", "grams")
    rows = back.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(
        last.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        _summed(int(tokens), int(distinct), shares, order),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
