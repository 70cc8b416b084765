"""Streaming forms of the ordered folds.

The same machines run here on live rows, one state per session in the state
store, so that a stream and a batch over the same rows give the same output.
Rows are held back until the watermark passes them and are then taken in
`order`; that makes the result independent of how rows arrive within the
watermark delay. Rows later than the watermark are dropped by Spark, and
counted (`StreamCounters`). What waits is kept in chunks by event time, so a
micro-batch reads and writes the chunks it touches, not all that waits.

Each group of rows costs a number of calls to the state store, whatever is in it.
With `shards`, sessions are dealt over so many groups, so that many short sessions
cost no more than their rows; a group then works on the sessions a micro-batch
touches, a few (`CELLS`) pieces of state at a time. Its rows that become due at once
are held in memory.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.types import BinaryType, LongType, StringType, StructType, _parse_datatype_string

from phrasestream.fixed_values import MAX_IDLE_S, MAX_LAG_S, RECOVER_TO_S, WARN_LAG_S
from phrasestream.operators.audio import UtteranceMachine
from phrasestream.operators.chunking import ChunkerConfig, PhraseMachine, with_shared
from phrasestream.operators.flow import BacklogMachine
from phrasestream.plans.fold import Machine

_FOLD = StructType().add("value", StringType())
_CHUNK = StructType().add("chunk", LongType())
_CELL = StructType().add("cell", LongType())
_FOLDS = StructType().add("folds", StringType())
_ROWS = StructType().add("rows", BinaryType())
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows wait for the end of their second.
SECOND_MS = 1000
#: Waiting rows in one piece of state.
CHUNK_ROWS = 1000
#: Rows a task deals over shards at a time, where rows move in pieces.
PIECE_ROWS = 1 << 19
#: Pieces of state over which the keys of a group are dealt.
CELLS = 64


def _packed(rows: pa.Table) -> bytes:
    """Rows as one compressed piece; their schema is known and not kept with them."""
    whole = rows.combine_chunks().to_batches()[0].serialize()
    return struct.pack("<q", whole.size) + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(piece: bytes, schema: pa.Schema) -> pa.Table:
    whole = pa.decompress(piece[8:], struct.unpack("<q", piece[:8])[0], codec="zstd")
    return pa.Table.from_batches([pa.ipc.read_record_batch(whole, schema)])


def _in_pieces(rows: DataFrame, schema: pa.Schema, event_time: str) -> DataFrame:
    """Rows with a `_shard` as compressed pieces of one shard: _shard, first and last time of
    its rows, the latest event_time, and the piece."""
    stamp = to_arrow_schema(rows.select(event_time).schema).field(0).type
    kinds = [("_shard", pa.int64()), ("first_ms", pa.int64()), ("last_ms", pa.int64()), (event_time, stamp), ("piece", pa.binary())]
    limit = PIECE_ROWS

    def pieces(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        shard, at, event = (table[c].cast(pa.int64()).to_numpy() for c in ("_shard", "at_ms", event_time))
        place = np.lexsort((at, shard))
        shard, at, event = shard[place], at[place], event[place]
        part = table.select(schema.names).take(place).cast(schema)
        starts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        ends = np.append(starts[1:], len(shard))
        packed = [_packed(part.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())]
        columns = [shard[starts], at[starts], at[ends - 1], np.maximum.reduceat(event, starts), packed]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) if k != pa.binary() else pa.array(c, k)
                                           for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= limit:
                yield pieces(held)
                held, count = [], 0
        if held:
            yield pieces(held)

    return rows.mapInArrow(run, f"_shard bigint, first_ms bigint, last_ms bigint, {event_time} timestamp, piece binary")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FoldProcessor(StatefulProcessor):
    """Runs one single-lane machine per key with event-time ordering. The state of a group
    is that of one key, or, with `shared`, of all keys dealt to a shard.

    `quiet_ms`, when set, ends the key with `machine.finish` after that much
    event time without a row, as a timer would in the live service; a later
    row continues from the state finish left behind.

    A key is over at a row that `ends` it, or `expire_ms` after its last row.
    Then it is finished (if it was not) and all of its state goes; rows that
    come later begin a new one.
    """

    def __init__(self, machine: Machine, columns: list[str], names: list[str], types: dict, expire_ms: int,
                 schema: pa.Schema, enrich: Callable | None = None, quiet_ms: int | None = None, ties: Callable | None = None,
                 keys: tuple[str, ...] = ("session_id",), shared: bool = False, apart: Callable | None = None):
        self.machine, self.columns, self.names, self.types = machine, columns, names, types
        self.keys, self.place = keys, lambda row: (row[0], ties(row[3]) if ties else 0)
        self.enrich, self.quiet_ms, self.expire_ms, self.shared = enrich, quiet_ms, expire_ms, shared
        self.width, self.apart = len(keys) if shared else 0, apart
        self.soon_ms = expire_ms if quiet_ms is None else min(quiet_ms, expire_ms)
        self.schema = pa.schema([schema.field(c) for c in (*keys[:self.width], "row_order", "at_ms", "ends", *columns)])

    def init(self, handle):
        self.handle, self.lane = handle, self.machine.lanes()[0]
        self.index = handle.getValueState("fold", _FOLD)
        self.cells = handle.getMapState("cells", _CELL, _FOLDS)
        self.waiting = handle.getMapState("waiting", _CHUNK, _ROWS)

    def _begin(self):
        """state, book and last row (order, at, values, whether finish was called) of a key at its start."""
        return [self.machine.start(self.lane), self.machine.new_book(), None]

    def _load(self):
        """The chunks of waiting rows (number, first and last time), the cells with the time
        their next key is due, and when the timer is set."""
        saved = self.index.get()
        if saved is None:
            return [], {}, None
        chunks, cells, wake = json.loads(saved[0])
        return chunks, {int(cell): at for cell, at in cells.items()}, wake

    def _store(self, chunks, cells, wake):
        seconds = [(first // SECOND_MS + 1) * SECOND_MS - 1 for _, first, _ in chunks]
        next_wake = min([*seconds, *cells.values()], default=None)
        if wake is not None and wake != next_wake:
            self.handle.deleteTimer(wake)
        if next_wake is None:
            self.index.clear()  # no chunk and no cell is left either
            return
        if wake != next_wake:
            self.handle.registerTimer(next_wake)
        self.index.update((json.dumps([chunks, cells, next_wake]),))

    def _wait(self, chunks, rows):
        """Keep rows until the watermark has passed them, in chunks in order of time."""
        rows = rows.sort_by("at_ms")
        number = max((chunk[0] for chunk in chunks), default=-1) + 1
        for number, first in enumerate(range(0, rows.num_rows, CHUNK_ROWS), number):
            part = rows.slice(first, CHUNK_ROWS)
            self.waiting.updateValue((number,), (_packed(part),))
            chunks.append([number, part["at_ms"][0].as_py(), part["at_ms"][-1].as_py()])

    def _due(self, chunks, mark):
        """Rows the watermark has passed, and the chunks left. Only chunks that have such
        rows are read."""
        if chunks and all(last <= mark for _, _, last in chunks):  # one read and one removal
            ready = [_unpacked(bytes(piece), self.schema) for _, (piece,) in self.waiting.iterator()]
            self.waiting.clear()
            return ready, []
        ready, left = [], []
        for number, first, last in chunks:
            if first > mark:
                left.append([number, first, last])
                continue
            rows = _unpacked(bytes(self.waiting.getValue((number,))[0]), self.schema)
            ready.append(rows.filter(pc.field("at_ms") <= mark))
            later = rows.filter(pc.field("at_ms") > mark)
            if later.num_rows:
                left.append([number, later["at_ms"][0].as_py(), last])
                self.waiting.updateValue((number,), (_packed(later),))
            else:
                self.waiting.removeKey((number,))
        return ready, left

    def _finish(self, fold, out):
        """Call `finish`, once for each last row."""
        state, book, last = fold
        if last is None or last[3]:
            return fold
        before = len(out)
        self.machine.finish(self.lane, state, book, self.machine.prepare(tuple(last[2])), out)
        state, book = self.machine.after_finish(self.lane, state, book, out[before:])
        return [state, book, [*last[:3], True]]

    def _until(self, fold, at, out):
        """What the time up to `at` does to a key without rows in it."""
        last = fold[2]
        if last and at - last[1] >= self.expire_ms:
            self._finish(fold, out)
            return self._begin()
        if last and self.quiet_ms is not None and at - last[1] >= self.quiet_ms:
            return self._finish(fold, out)
        return fold

    def _fold(self, fold, rows, mark, out):
        """A key after the rows that are due and the time up to the watermark."""
        if self.apart:
            rows = self.apart(rows)
        step, prepare, lane = self.machine.step, self.machine.prepare, self.lane
        state, book, last = fold
        for order, at, ends, values in sorted(rows, key=self.place):
            if last and at - last[1] >= self.soon_ms:
                state, book, last = self._until([state, book, last], at, out)
            if self.enrich:
                values = tuple(self.enrich(last[2] if last else None, values))
            state, book = step(lane, state, book, prepare(values), out)
            last = [order, at, values, False]
            if ends:
                self._finish([state, book, last], out)
                state, book, last = self._begin()
        # Rows still waiting are later than the watermark.
        return self._until([state, book, last], mark, out)

    def _next(self, last):
        """When time does something to a key."""
        if self.quiet_ms is not None and not last[3]:
            return last[1] + min(self.quiet_ms, self.expire_ms)
        return last[1] + self.expire_ms

    def _advance(self, key, mark, chunks, cells, wake, ready):
        """Take the rows that are due (`ready`, key by key) and what time has brought to keys
        without any, cell by cell."""
        dealt: dict[tuple, list] = {}
        for rows in ready:
            lists = [_values(column) for column in rows.columns]
            whose = zip(*lists[:self.width]) if self.width else [()] * rows.num_rows
            for who, row in zip(whose, zip(*lists[self.width:self.width + 3], zip(*lists[self.width + 3:]))):
                dealt.setdefault(who, []).append(row)
        found: dict[int, dict[str, list]] = {}
        while dealt:
            who, rows = dealt.popitem()
            who = json.dumps(who)
            found.setdefault(zlib.crc32(who.encode()) % CELLS, {})[who] = rows
        columns: list = []
        for cell in sorted({*found, *(cell for cell, at in cells.items() if at <= mark)}):
            known = json.loads(self.cells.getValue((cell,))[0]) if cell in cells else {}
            rows, kept, due = found.get(cell, {}), {}, []
            for who in {**known, **rows}:
                fold = self._begin()
                if who in known:
                    state, book, last = known[who]
                    fold = [self.machine.thaw(state), book, last]
                out: list = []
                state, book, last = self._fold(fold, rows.get(who, ()), mark, out)
                if last:
                    kept[who] = [self.machine.freeze(state), book, last]
                    due.append(self._next(last))
                if out:
                    place = tuple(json.loads(who)) if self.shared else tuple(key)
                    columns += [place + tuple(row) for row in out]
            if kept:
                self.cells.updateValue((cell,), (json.dumps(kept),))
                cells[cell] = min(due)
            elif cell in cells:
                self.cells.removeKey((cell,))
                del cells[cell]
        self._store(chunks, cells, wake)
        if columns:
            # Column by column: whole numbers beside nulls would go through doubles otherwise.
            yield pd.DataFrame({name: pd.Series(values, dtype=self.types.get(name, object))
                                for name, values in zip([*self.keys, *self.names], zip(*columns))})

    def handleInputRows(self, key, rows, timerValues):
        chunks, cells, wake = self._load()
        mark = timerValues.getCurrentWatermarkInMs()
        ready, chunks = self._due(chunks, mark)
        fresh = []
        for frame in rows:
            if "piece" not in frame:
                fresh.append(pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False))
                continue
            for first, last, piece in zip(frame["first_ms"].tolist(), frame["last_ms"].tolist(), frame["piece"]):
                if first > mark:  # waits as it came
                    number = chunks[-1][0] + 1 if chunks else 0
                    self.waiting.updateValue((number,), (bytes(piece),))
                    chunks.append([number, first, last])
                else:
                    fresh.append(_unpacked(bytes(piece), self.schema))
        ready += [rows.filter(pc.field("at_ms") <= mark) for rows in fresh]
        later = pa.concat_tables([rows.filter(pc.field("at_ms") > mark) for rows in fresh]) if fresh else None
        if later:
            self._wait(chunks, later)
        yield from self._advance(key, mark, chunks, cells, wake, ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        chunks, cells, wake = self._load()
        if wake == expiredTimerInfo.getExpiryTimeInMs():
            wake = None  # a timer that has gone off is gone
        mark = timerValues.getCurrentWatermarkInMs()
        ready, chunks = self._due(chunks, mark)
        yield from self._advance(key, mark, chunks, cells, wake, ready)

    def close(self):
        pass


class StreamCounters(StreamingQueryListener):
    """Late rows and state rows of all streams of a session, by query name (or id).

    Rows behind the watermark are dropped by Spark before a processor sees them; this keeps
    their number, and how many rows the state has and had at most.

        counters = StreamCounters(); spark.streams.addListener(counters)
    """

    def __init__(self):
        self.counts: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.add(event.progress.name or str(event.progress.id), event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def add(self, name, operators) -> None:
        mine = self.counts.setdefault(name, {"late_rows": 0, "state_rows": 0, "most_state_rows": 0})
        mine["late_rows"] += sum(op.numRowsDroppedByWatermark for op in operators)
        mine["state_rows"] = sum(op.numRowsTotal for op in operators)
        mine["most_state_rows"] = max(mine["most_state_rows"], mine["state_rows"])


def counts_of(query) -> dict[str, int]:
    """The same numbers for one query, from the progress it still remembers."""
    counters = StreamCounters()
    for progress in query.recentProgress:
        counters.add("", progress.stateOperators)
    return counters.counts.get("", {"late_rows": 0, "state_rows": 0, "most_state_rows": 0})


def _values(column: pa.ChunkedArray) -> list:
    """A column as Python's values."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy().tolist()
    return column.to_pylist()


def fold_stream(
    stream: DataFrame, machine: Machine, order: str, event_time: str,
    columns: list[str] | None = None, enrich: Callable | None = None, quiet_s: float | None = None,
    expire_s: float = MAX_IDLE_S, ends: str | None = None, ties: Callable | None = None,
    keys: tuple[str, ...] = ("session_id",), at_ms: str | None = None, shards: int | None = None,
    apart: Callable | None = None, pieces: str | None = None,
) -> DataFrame:
    """Run a machine over every session (or other `keys`) of a stream with a
    watermark on `event_time`. Rows are taken by `order`, then by what `ties`
    makes of their columns. `enrich` adds inputs the batch form gets from windows. A
    session's state goes at a row where the boolean column `ends` is true, and
    `expire_s` (`quiet_s`, if that is longer) after its last row: by then the
    watchdog has ended a session for want of audio. `at_ms` names a column with
    the time a row counts from, if it is later than its `event_time`. `shards`, for
    sessions that are many and short: see above; their keys have to be plain values. `apart`,
    for rows that stand for more than one, is given the rows of a key that are due, (order, time, ends,
    values), and returns them as they are to be taken.

    `pieces`, for an archive that is read at once into `shards`: a task deals its rows over the
    shards in compressed pieces, which move and wait as they are. It is the delay of the watermark,
    which `stream` must not have yet; rows of one piece are late together."""
    columns = columns or machine.columns
    quiet_ms = None if quiet_s is None else round(quiet_s * 1000)
    output = _parse_datatype_string(machine.output)
    kinds = {"bigint": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean"}
    fields = [*output, *(stream.schema[k] for k in keys)]
    types = {f.name: kinds[f.dataType.simpleString()] for f in fields if f.dataType.simpleString() in kinds}
    named = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    expire_ms = max(round(expire_s * 1000), quiet_ms or 0)
    over = F.lit(False) if ends is None else F.coalesce(F.col(ends), F.lit(False))
    rows = stream.select(
        *keys, (F.col(order)).cast("bigint").alias("row_order"),
        F.unix_millis(event_time).alias("at_ms") if at_ms is None else F.col(at_ms).alias("at_ms"), over.alias("ends"), event_time,
        *[F.col(c) for c in columns],
    )
    schema = to_arrow_schema(rows.drop(event_time).schema if event_time not in (*keys, *columns) else rows.schema)
    processor = FoldProcessor(machine, columns, output.names, types, expire_ms, schema, enrich, quiet_ms, ties, keys, shards is not None, apart)
    group = keys
    if shards is not None:
        rows, group = rows.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards))), ("_shard",)
    if pieces is not None:
        rows = _in_pieces(rows, processor.schema, event_time).withWatermark(event_time, pieces)
    return rows.groupBy(*group).transformWithStateInPandas(
        processor, f"{named}, {machine.output}", "Append", "EventTime"
    )


# --- T2 -------------------------------------------------------------------------


def _shared_with_previous(previous, values):
    """The machine's columns, without what it fills in from the row before."""
    row = (*values[:5], None, None, None, values[5], None)
    return list(with_shared(previous, row))


def commit_phrases_stream(
    hyps: DataFrame, config: ChunkerConfig = ChunkerConfig(), event_time: str = "event_time", **life
) -> DataFrame:
    """Committed phrases of a hypothesis stream with a watermark on
    `event_time`. Stable text is committed as "silence" once the watermark is
    `silence_commit_s` past the last hypothesis. The live service only looks
    for silence when a hypothesis arrives, so there such commits hardly ever
    happen; the timer here is a deliberate difference. `life` is what
    `fold_stream` takes on the end of a session (`expire_s`, `ends`)."""
    ends = (
        F.transform("words", lambda w: w["t_audio_end"]) if "words" in hyps.columns
        else F.lit(None).cast("array<double>")
    )
    machine = PhraseMachine([config], False, "silence")
    out = fold_stream(
        hyps.withColumn("word_ends", ends), machine, "seq", event_time,
        ["text", "is_final", "t_audio_start", "t_audio_end", "t_wall", "word_ends"],
        enrich=_shared_with_previous, quiet_s=config.silence_commit_s, **life,
    )
    return out.drop("config_id")


# --- T6, T10 -----------------------------------------------------------------------


def shed_backlog_stream(
    events: DataFrame, event_time: str = "event_time", expire_s: float = MAX_IDLE_S, ends: str | None = None,
    shards: int | None = None, **limits
) -> DataFrame:
    """T6 on a stream; state holds (start, duration) pairs, never audio."""
    machine = BacklogMachine(
        limits.get("max_lag", MAX_LAG_S), limits.get("recover_to", RECOVER_TO_S), limits.get("warn", WARN_LAG_S)
    )
    return fold_stream(events, machine, "seq", event_time, expire_s=expire_s, ends=ends, shards=shards)


def utterances_stream(
    levels: DataFrame, machine: UtteranceMachine, event_time: str = "event_time", idle_s: float = 5.0, **life
) -> DataFrame:
    """T10 on a stream; an open utterance ends after `idle_s` without frames."""
    return fold_stream(levels, machine, "seq", event_time, quiet_s=idle_s, **life)
