"""N-gram Jaccard join by chosen paths.

Each distinct set of word shingles is embedded as `COORDINATES` min-hashes, which are its
tokens. A run of the join sends a set down one chosen path: a node samples, by its own
hash, one coordinate, and splits its sets by the token they have there, so that sets that
share sampled tokens stay together. Nodes of at most `SMALL` sets end as leaves and are
compared by brute force; larger ones are split again, as long as the recall aimed at
(`RECALL`) is kept, which for 12 runs is 3 splits. Two sets of
similarity s stay together through d splits with probability s^d, and `RUNS` runs repeat
that, so that a pair of s = 0.8 meets in one of them with the chance `recall`.

What is left large at the greatest depth (a group of near copies) is not cut off: its sets
are dealt to blocks, and each pair of blocks is one unit of work, so no task holds a whole
group. A unit gives no pairs, only for each of its sets the number of links and the
smallest set it is connected with. A pair counts in the first run whose leaf both share.
Signatures decide which sets a unit needs; their exact shingles decide the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasestream.llm import words as W
from phrasestream.plans.stage import staged

SHINGLE = 5
LEAST = 0.8
COORDINATES = 64
RUNS = 12
SMALL = 128
#: Most splits, whatever the recall aimed at (equal sets never part).
DEPTH = 8
#: Recall aimed at for pairs at LEAST. Paths end where one more split would fall below it.
RECALL = 0.9995
#: Signature similarity below which a pair is not looked at: more than three standard
#: deviations under LEAST for 64 coordinates.
SKETCH = LEAST - 3.3 * (LEAST * (1 - LEAST) / COORDINATES) ** 0.5

_A = np.random.default_rng(5).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(depth: int, similarity: float = LEAST, runs: int = RUNS) -> float:
    """Chance that a pair shares a leaf in some run when paths are `depth` splits deep."""
    return 1 - (1 - similarity**depth) ** runs


def depth_for(aim: float, similarity: float = LEAST, runs: int = RUNS) -> int:
    """The most splits after which a pair is found with a chance of `aim` or more."""
    depth = 0
    while depth < DEPTH and recall(depth + 1, similarity, runs) >= aim:
        depth += 1
    if not depth:
        raise ValueError(f"{runs} runs do not reach a recall of {aim} at similarity {similarity}")
    return depth


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and the n + 1 places where each text's begin.
    A text of fewer words than `size` has one shingle of all its words; one without
    words has none."""
    data, offsets = W.flat(column)
    starts, lengths, first = W.words(data, offsets)
    h = W.hash_spans(data, starts, lengths)
    places, text = W.window_places(first, size)
    texts, hashes = [text], [W.windows(h, size)[places] if len(places) else np.zeros(0, np.uint64)]
    counts = np.diff(first)
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            texts.append(few)
            hashes.append(W.windows(h, n, seed=n)[first[few]])
    text, hashes = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


def signatures(h: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Min-hashes (rows: texts; uint32) of the shingles of texts with word hashes `h`; 0
    for texts without words."""
    counts = np.diff(first)
    out = np.zeros((len(counts), COORDINATES), np.uint32)
    places, _ = W.window_places(first, size)
    parts = [(np.flatnonzero(counts >= size), W.windows(h, size)[places] if len(places) else None)]
    parts += [(few, W.windows(h, n, seed=n)[first[few]]) for n in range(1, size) if len(few := np.flatnonzero(counts == n))]
    for k, (texts, hashes) in enumerate(parts):
        if not len(texts):
            continue
        each = counts[texts] - size + 1 if k == 0 else np.ones(len(texts), np.int64)
        begin = np.cumsum(each) - each
        for i in range(COORDINATES):
            x = hashes * _A[i]
            x = (x ^ (x >> np.uint64(29))) * _A[i - 1]
            out[texts, i] = (np.minimum.reduceat(x, begin) >> np.uint64(32)).astype(np.uint32)
    return out


def sequence_keys(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    counts = np.diff(first)
    inside = (np.arange(len(h)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    keys = []
    for seed in (11, 12):
        x = W.mix(h ^ W.mix(inside + np.uint64(seed << 48)))
        total = np.add.reduceat(np.append(x, np.uint64(0)), first[:-1]) if len(counts) else np.zeros(0, np.uint64)
        keys.append(np.where(counts > 0, total, np.uint64(0)).astype(np.uint64).view(np.int64))
    return keys


def _signed(batches):
    for part in W.slices(batches):
        data, offsets = W.flat(part.column("text"))
        starts, lengths, first = W.words(data, offsets)
        h = W.hash_spans(data, starts, lengths)
        key, key2 = sequence_keys(h, first)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(key), pa.array(key2),
             pa.array([r.tobytes() for r in signatures(h, first)], pa.binary())], ["doc_id", "n", "key", "key2", "sig"])


def _node(run, depth: int):
    """The coordinate a node samples, chosen by the node's own hash."""
    return F.pmod(F.xxhash64(run, F.lit(depth)), F.lit(COORDINATES))


def _token(sig, coordinate):
    return F.substring(sig, (coordinate * 4 + 1).cast("int"), F.lit(4))


def leaves(sets: DataFrame, depths: int) -> DataFrame:
    """set_id, run, leaf, members: where each set's path ends in each run, after at most
    `depths` splits, for leaves of two and more sets. `sets`: set_id, sig."""
    runs = sets.select("set_id", "sig", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
    # The first split: each run has a coordinate of its own.
    level = runs.select("set_id", "run", F.xxhash64("run", _token(F.col("sig"), F.col("run") * 5 % COORDINATES)).alias("node"))
    done = None
    for depth in range(1, depths + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        counted = staged(level.join(sizes, "node"), f"jaccard-level{depth}")
        ended = counted if depth == depths else counted.filter(F.col("members") <= SMALL)
        ended = ended.select("set_id", "run", F.col("node").alias("leaf"), "members")
        done = ended if done is None else done.unionByName(ended)
        large = counted.filter(F.col("members") > SMALL)
        if depth == depths or not large.limit(1).count():
            break
        level = large.join(sets.select("set_id", "sig"), "set_id").select(
            "set_id", "run", F.xxhash64("node", _token(F.col("sig"), _node(F.col("node"), depth))).alias("node"))
    return done


def _groups(batches: Iterator[pa.RecordBatch], key: str, wide: dict[str, type]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of one key at a time; rows come sorted by key, and a key has a bounded
    number of rows. `wide`: binary columns of equal length, read as rows of numbers."""

    def columns(batch):
        out = {}
        for name, column in zip(batch.schema.names, batch.columns):
            if name in wide:
                out[name] = np.frombuffer(b"".join(column.to_pylist()), wide[name]).reshape(batch.num_rows, -1)
            elif pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                out[name] = np.array(column.to_pylist(), object)
            else:
                out[name] = column.to_numpy(zero_copy_only=False)
        return out

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        if rest is not None:
            now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
        cuts = [0, *(np.flatnonzero(now[key][1:] != now[key][:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                yield {k: v[a:b] for k, v in now.items()}
        rest = {k: v[cuts[-1] :] for k, v in now.items()}
    if rest is not None and len(rest[key]) > 1:
        yield rest


def _first_pairs(got: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs of a unit's rows belong to it: the unit's run is the first whose leaf
    both share, and in a unit of two blocks they are of different blocks."""
    paths, run, block = got["leaves"], got["run"][0], got["block"]
    ok = ~np.eye(len(paths), dtype=bool)
    for r in range(run):
        ok &= (paths[:, None, r] != paths[None, :, r]) | (paths[:, None, r] == 0)
    if got["cross"][0]:
        ok &= block[:, None] != block[None, :]
    return ok


def _needed(batches):
    """(unit, set_id) of the sets of a unit that may have a link there, by their signatures."""
    units, ids = [], []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(units)), pa.array(np.concatenate(ids))], ["unit", "set_id"])

    for got in _groups(batches, "unit", {"sig": np.uint32, "leaves": np.int64}):
        ok = _first_pairs(got)
        a, b = np.nonzero(np.triu(ok))
        if not len(a):
            continue
        near = np.zeros(len(a), bool)
        for low in range(0, len(a), 8192):
            part = slice(low, low + 8192)
            near[part] = (got["sig"][a[part]] == got["sig"][b[part]]).sum(1) >= SKETCH * COORDINATES
        hit = np.unique(np.concatenate([a[near], b[near]]))
        if len(hit):
            units.append(got["unit"][hit])
            ids.append(got["set_id"][hit])
        if len(units) >= 4096:
            yield rows()
            units, ids = [], []
    if units:
        yield rows()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of each pair of sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1
    column, owner = column[often[column]], owner[often[column]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    if not len(column):
        return total
    _, column = np.unique(column, return_inverse=True)
    step = max(1, (8 << 20) // len(sets))
    for low in range(0, column.max() + 1, step):
        mine = (column >= low) & (column < low + step)
        block = np.zeros((len(sets), min(step, column.max() + 1 - low)), np.float32)
        block[owner[mine], column[mine] - low] = 1
        total += block @ block.T
    return total


def _linked(least: float):
    def run(batches):
        """For each set of a unit: the number of rows it links to there, and the smallest
        set it is connected with."""
        out: list[tuple] = []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["set_id", "links", "root"])

        for got in _groups(batches, "unit", {"leaves": np.int64}):
            _, once = np.unique(got["set_id"], return_index=True)  # repeated rows of the input
            got = {k: v[once] for k, v in got.items()}
            sets = [np.frombuffer(s, np.uint64) for s in got["shingles"]]
            sizes = np.array([len(s) for s in sets], np.float32)
            common = intersections(sets)
            link = _first_pairs(got) & (common >= least * (sizes[:, None] + sizes[None, :] - common) - 1e-4)
            counts = (link * got["copies"][None, :]).sum(1)
            root = got["set_id"].copy()
            while True:  # as many rounds as the longest path in the unit
                new = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(1))
                if (new == root).all():
                    break
                root = new
            out += [(int(a), int(b), int(c)) for a, b, c in zip(got["set_id"], counts, root) if b]
            if len(out) > 50_000:
                yield rows()
                out = []
        if out:
            yield rows()

    return run


def _with_shingles(batches):
    """The shingles of the rows that carry a set (a row of the same id may hold another)."""
    for part in W.slices(batches):
        data, offsets = W.flat(part.column("text"))
        starts, lengths, first = W.words(data, offsets)
        key = sequence_keys(W.hash_spans(data, starts, lengths), first)[0]
        hashes, cuts = shingle_sets(part.column("text"))
        mine = np.flatnonzero(key == part.column("set_id").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [part.column("set_id").take(pa.array(mine)), part.column("units").take(pa.array(mine)),
             pa.array([hashes[cuts[i] : cuts[i + 1]].tobytes() for i in mine], pa.binary())], ["set_id", "units", "shingles"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node each node is connected with. `edges`: a, b.

    Each round every node takes the smallest root among its own and its neighbours', then
    the root of that root, so distances halve; each round is written to the shared folder.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    for _ in range(rounds):
        around = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        near = roots.join(around, roots["node"] == around["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = staged(near.join(jump, "root").select("node", "old", F.least("root", "over").alias("root")), "roots")
        roots = new.select("node", "root")
        if not new.filter("old != root").limit(1).count():
            return roots
    raise RuntimeError("the links are longer paths than the rounds reach")


def similar_documents(docs: DataFrame, least: float = LEAST, aim: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, class_size of each row.

    Two rows are linked if the Jaccard similarity of their sets of five-word shingles is
    `least` or more; n_links counts the other rows a row is linked to, copies included, and
    class_id is the smallest doc_id of its connected group. Rows with fewer than five
    words have one shingle of all their words; rows without words (or a null text) link to
    nothing and are classes of their own, as are rows of null id. Repeated rows, also of one
    id, count as copies. A pair at `least` meets in a leaf with a chance of `aim` or more,
    however large its group. Other columns of `docs` are not read.
    """
    docs = W.text_frame(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.filter("doc_id is not null")
    signed = staged(known.mapInArrow(_signed, "doc_id long, n long, key long, key2 long, sig binary"), "jaccard-signed")
    full = signed.filter("n > 0")
    # Equal sequences of words stand once, carried by the row of the smallest id.
    sets = staged(full.groupBy(F.col("key").alias("set_id"), "key2").agg(
        F.min("doc_id").alias("carrier"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig")), "jaccard-sets")
    ended = staged(leaves(sets.select("set_id", "sig"), depth_for(aim, least)), "jaccard-leaves")
    paths = ended.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("run", "leaf"))).alias("m")).select(
        "set_id", F.concat(*(F.unhex(F.lpad(F.hex(F.coalesce(F.col("m")[r], F.lit(0))), 16, "0")) for r in range(RUNS))).alias("leaves"))
    dealt = ended.withColumn("blocks", F.ceil(F.col("members") / SMALL).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "set_id", "run", "block", (F.col("block") != F.col("other")).alias("cross"),
        F.xxhash64("leaf", F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    carried = paths.join(sets.select("set_id", "sig", "copies", "carrier"), "set_id")
    units = dealt.join(carried, "set_id")
    columns = ["unit", "set_id", "run", "block", "cross", "leaves"]
    needed = staged(units.select(*columns, "sig").repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _needed, "unit long, set_id long"), "jaccard-needed")
    wanted = needed.groupBy("set_id").agg(F.collect_list("unit").alias("units")).join(
        sets.select("set_id", F.col("carrier").alias("doc_id")), "set_id")
    with_sets = known.join(wanted, "doc_id").select("set_id", "units", "text").mapInArrow(
        _with_shingles, "set_id long, units array<long>, shingles binary")
    work = with_sets.select("set_id", F.explode("units").alias("unit"), "shingles").join(
        units.select(*columns, "copies"), ["unit", "set_id"])
    linked = staged(work.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _linked(least), "set_id long, links long, root long"), "jaccard-links")
    links = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(linked.filter("set_id != root").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    named = staged(sets.join(links, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "key2", "carrier", "copies", F.coalesce("root", "set_id").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-named")
    groups = named.groupBy("root").agg(F.min("carrier").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(groups, "root").select(F.col("set_id").alias("key"), "key2", "class_id", "n_links", "class_size")
    rows = full.select("doc_id", "key", "key2").join(named, ["key", "key2"]).select("doc_id", "class_id", "n_links", "class_size")

    def alone(df):
        return df.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                         F.lit(1).cast("long").alias("class_size"))

    return rows.unionByName(alone(signed.filter("n = 0"))).unionByName(alone(docs.filter("doc_id is null")))
