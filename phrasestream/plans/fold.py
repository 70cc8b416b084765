"""Ordered state machines over many keys, including very long ones.

Some rules are recurrences (where the next phrase starts depends on where the
last one was cut) and cannot be written as a window. `ordered_fold` runs such
a state machine inside tasks: rows are hash-partitioned by key, sorted by
Spark, and streamed through a small step function, so a task holds one state
and one Arrow batch, never a whole group.

A key above `target_rows` is cut into pieces that are folded in parallel:

1. *probe*: each piece but the last is run from every state it might start in
   (the machine names them from the few rows before the piece); states that
   meet are merged, so this soon costs about one run.
2. *link*: the pieces' "state in -> state out" rows, a small table, are walked
   per key to find each piece's true starting state.
3. *fold*: every piece is run from its true state and emits its rows.

If a piece turns out to start in a state that was not probed, it is probed once
more from just that state, and the pieces are linked again, until every piece
has its true state. Each round settles at least one more piece of a key and
works on one piece of it alone, so the result is the sequential one in every
case and no task ever folds more than a piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from phrasestream.plans.ordered import PIECE, PIECES, SHARE, TARGET_ROWS, Cut, cut_large_keys
from phrasestream.plans.stage import staged


class Machine:
    """A per-key state machine. `state` decides what happens next; `book`
    is bookkeeping (ids, cursors) that never influences the state.

    Subclasses set `columns` (inputs, in order), `output` (DDL of emitted
    columns, without the keys) and `look_back` (rows shown to `candidates`).
    A machine has one or more lanes (e.g. configurations) that see the same
    rows; `prepare` does the work they share.
    """

    columns: list[str] = []
    output: str = ""
    look_back: int = 256

    def lanes(self) -> list:
        return [None]

    def enrich(self, previous: tuple | None, row: tuple) -> tuple:
        """Fill in what a row takes from the one before it in its piece, if the plan has not."""
        return row

    def prepare(self, row: tuple):
        return row

    def start(self, lane):
        raise NotImplementedError

    def new_book(self):
        return None

    def step(self, lane, state, book, row, out: list):
        """Return (state, book); append output tuples to `out`."""
        raise NotImplementedError

    def finish(self, lane, state, book, row, out: list) -> None:
        """End of the key; `row` is the last prepared row."""

    def after_finish(self, lane, state, book, emitted: list):
        """(state, book) once `finish` emitted these rows and more rows come."""
        return state, book

    def candidates(self, lane, rows: list) -> list:
        """States a piece may start in, given the prepared rows before it."""
        return []

    def freeze(self, state):
        return state

    def thaw(self, frozen):
        return frozen

    def merge_books(self, first, second):
        return None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[[None] * len(c) if c.null_count == len(c) else c.to_pylist() for c in batch.columns])


class _Writer:
    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def take(self, limit: int) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= limit:
            columns = zip(*self.rows)
            arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, self.schema)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _key_fields(df: DataFrame, keys: list[str]) -> StructType:
    return StructType([df.schema[k] for k in keys])


def _arrow(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def ordered_fold(
    df: DataFrame, keys: list[str], order: str, machine: Machine, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Rows emitted by `machine` for every key, with the key columns in front."""
    rows = df.select(*dict.fromkeys([*keys, order, *machine.columns]))
    return fold_cut(cut_large_keys(rows, keys, order, target_rows), order, machine)


def fold_cut(cut: Cut, order: str, machine: Machine) -> DataFrame:
    keys, df = cut.keys, cut.rows
    if cut.any:
        started = df.join(_entries(cut, order, machine), [*keys, PIECE], "left")
    else:
        started = df.withColumn("_states", F.lit(None).cast("string"))
    lead = len(keys) + 4
    result = StructType(
        [*_key_fields(df, keys).fields, *_parse_datatype_string(machine.output).fields]
    )
    arrow = _arrow(result)
    placed = started.withColumn("_last", F.col(PIECE) == F.col(PIECES) - 1).select(
        *keys, PIECE, "_last", "_states", F.col(order).alias("_order"), *machine.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = machine.lanes()
        writer = _Writer(arrow)
        current, states, books, row, last, previous = None, [], [], None, False, None

        def close():
            if current is None or not last:
                return
            for i, lane in enumerate(lanes):
                out: list = []
                machine.finish(lane, states[i], books[i], row, out)
                writer.rows.extend(current[:-1] + o for o in out)

        for values in _rows(batches):
            key = values[: len(keys) + 1]
            if key != current:
                close()
                current, previous = key, None
                known = values[len(keys) + 2]
                if known is None:
                    states = [machine.start(lane) for lane in lanes]
                    books = [machine.new_book() for _ in lanes]
                else:
                    pairs = json.loads(known)
                    states = [machine.thaw(s) for s, _ in pairs]
                    books = [b for _, b in pairs]
            last = values[len(keys) + 1]
            row = machine.prepare(machine.enrich(previous, values[lead:]))
            previous = values[lead:]
            for i, lane in enumerate(lanes):
                out = []
                states[i], books[i] = machine.step(lane, states[i], books[i], row, out)
                if out:
                    writer.rows.extend(key[:-1] + o for o in out)
            yield from writer.take(8192)
        close()
        yield from writer.take(1)

    # Rows that a window by keys and piece has just left are not moved again.
    laid = placed if cut.laid_out and not cut.any else placed.repartition(*keys, PIECE)
    return laid.sortWithinPartitions(*keys, PIECE, "_order").mapInArrow(run, result)


def _entries(cut: Cut, order: str, machine: Machine) -> DataFrame:
    """(keys, piece, states): the state and book of every lane at the start of every piece
    of the cut keys."""
    keys = cut.keys
    probes = staged(_probe(cut, order, machine), "fold-probes")
    while True:
        linked = staged(_link(probes, keys, machine), "fold-links")
        unknown = linked.filter("not _known").select(*keys, PIECE, "_states")
        if unknown.isEmpty():
            return linked.select(*keys, PIECE, "_states")
        again = staged(_probe(cut, order, machine, unknown), "fold-probes")
        probes = probes.unionByName(again)


def _probe(cut: Cut, order: str, machine: Machine, known: DataFrame | None = None) -> DataFrame:
    """(keys, piece, pieces, lane, state in, state out, book) for all pieces
    but the last of every cut key; or for the pieces in `known` (keys, piece,
    states) only, from the states given there."""
    keys = cut.keys
    large = cut.large.filter(F.col(PIECE) < F.col(PIECES) - 1)
    if known is not None:
        shown = large.join(known, [*keys, PIECE]).withColumn("_copy", F.lit(False))
        return _probed(shown, cut, order, machine)
    near_end = (1 - F.col(SHARE)) * cut.target_rows <= machine.look_back * 1.5
    before = cut.large.filter(near_end & (F.col(PIECE) < F.col(PIECES) - 2)).withColumn(
        PIECE, F.col(PIECE) + 1
    )
    shown = large.withColumn("_copy", F.lit(False)).unionByName(before.withColumn("_copy", F.lit(True)))
    return _probed(shown.withColumn("_states", F.lit(None).cast("string")), cut, order, machine)


def _probed(shown: DataFrame, cut: Cut, order: str, machine: Machine) -> DataFrame:
    keys = cut.keys
    shown = shown.select(*keys, PIECE, PIECES, "_copy", "_states", F.col(order).alias("_order"), *machine.columns)
    lead = len(keys) + 5
    result = StructType(
        [*_key_fields(cut.rows, keys).fields,
         *_parse_datatype_string(
             f"{PIECE} int, {PIECES} int, _lane int, _in string, _out string, _book string"
         ).fields]
    )
    arrow = _arrow(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = machine.lanes()
        writer = _Writer(arrow)
        current, pieces, seen_before, tracks = None, None, [], None

        def emit():
            if tracks is None:
                return
            for i, track in enumerate(tracks):
                for start, state, book in track.results():
                    writer.rows.append(current + (pieces, i, start, state, book))

        for values in _rows(batches):
            key = values[: len(keys) + 1]
            if key != current:
                emit()
                current, seen_before, tracks = key, [], None
            pieces = values[len(keys) + 1]
            row = machine.prepare(values[lead:])
            if values[len(keys) + 2]:
                seen_before.append(row)
                if len(seen_before) > machine.look_back:
                    del seen_before[0]
                continue
            if tracks is None:
                first, given = current[-1] == 0, values[len(keys) + 3]
                true = [machine.thaw(s) for s, _ in json.loads(given)] if given else None
                tracks = [
                    _Track(machine, lane, [true[i]] if true else [machine.start(lane)] if first
                           else machine.candidates(lane, seen_before))
                    for i, lane in enumerate(lanes)
                ]
            for track in tracks:
                track.step(row)
            yield from writer.take(1024)
        emit()
        yield from writer.take(1)

    return (
        shown.repartition(*keys, PIECE)
        .sortWithinPartitions(*keys, PIECE, "_order")
        .mapInArrow(run, result)
    )


class _Track:
    """One lane of one piece, run from several starting states at once."""

    def __init__(self, machine: Machine, lane, states: list):
        self.machine, self.lane, self.count = machine, lane, 0
        # origins: frozen start -> [index into runs, book up to the last merge]
        self.runs, self.origins = [], {}
        for state in states:
            frozen = json.dumps(machine.freeze(state))
            if frozen not in self.origins:
                self.origins[frozen] = [len(self.runs), machine.new_book()]
                self.runs.append([state, machine.new_book()])

    def step(self, row) -> None:
        for run in self.runs:
            run[0], run[1] = self.machine.step(self.lane, run[0], run[1], row, [])
        self.count += 1
        if len(self.runs) > 1 and (self.count & (self.count - 1) == 0 or self.count % 64 == 0):
            self._merge()

    def _merge(self) -> None:
        for origin in self.origins.values():
            origin[1] = self.machine.merge_books(origin[1], self.runs[origin[0]][1])
        merged, index, moved = [], {}, []
        for state, _book in self.runs:
            frozen = json.dumps(self.machine.freeze(state))
            if frozen not in index:
                index[frozen] = len(merged)
                merged.append([state, self.machine.new_book()])
            moved.append(index[frozen])
        self.runs = merged
        for origin in self.origins.values():
            origin[0] = moved[origin[0]]

    def results(self):
        for start, (at, book) in self.origins.items():
            state, more = self.runs[at]
            yield (start, json.dumps(self.machine.freeze(state)),
                   json.dumps(self.machine.merge_books(book, more)))


def _link(probes: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """(keys, piece, states, known): the state and book of every lane at the start of each
    piece, as far as probes lead; `known` is false where the next piece's are missing."""
    result = StructType(
        [*_key_fields(probes, keys).fields,
         *_parse_datatype_string(f"{PIECE} int, _states string, _known boolean").fields]
    )
    arrow = _arrow(result)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = machine.lanes()
        writer = _Writer(arrow)
        key, pieces, at, table, now = None, 0, None, None, None

        def apply():
            """Move `now` across piece `at`; give up when a state is unknown."""
            nonlocal now
            if now is None:
                return
            states, moved = json.dumps([(json.loads(s), b) for s, b in now]), []
            for i, (state, book) in enumerate(now):
                found = table[i].get(state)
                if found is not None:
                    moved.append((found[0], machine.merge_books(book, json.loads(found[1]))))
            known = len(moved) == len(lanes)
            writer.rows.append(key + (at, states, known))
            now = moved if known else None

        def close():
            if key is None:
                return
            apply()
            if now is not None:
                writer.rows.append(key + (pieces - 1, json.dumps([(json.loads(s), b) for s, b in now]), True))

        for values in _rows(batches):
            if values[:width] != key:
                close()
                key, at = values[:width], None
                now = [(json.dumps(machine.freeze(machine.start(lane))), machine.new_book())
                       for lane in lanes]
            piece, pieces, lane, start, end, book = values[width:]
            if piece != at:
                if at is not None:
                    apply()
                at, table = piece, [{} for _ in lanes]
            table[lane][start] = (end, book)
            yield from writer.take(1024)
        close()
        yield from writer.take(1)

    return (
        probes.repartition(*keys)
        .sortWithinPartitions(*keys, PIECE)
        .mapInArrow(run, result)
    )
