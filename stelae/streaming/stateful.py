"""Machines with state for each key: transitions and idempotent answers, on streams by stateful processors and in batch by their twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Stateful processors keep their state there; set it on the session before a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- transitions


class Machine(StatefulProcessor):
    """(key, state, accepted, refused) after each micro-batch, by moves (from, event, to); an event without a move is refused."""

    def __init__(self, key: str, moves: list[tuple[str, str, str]], start: str, event: str, order: tuple[str, ...]):
        self.key, self.moves, self.start, self.event, self.order = key, {(a, e): b for a, e, b in moves}, start, event, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("machine", "state string, accepted bigint, refused bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, accepted, refused = self.kept.get() if self.kept.exists() else (self.start, 0, 0)
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            to = self.moves.get((state, r[self.event]))
            state, accepted, refused = to or state, accepted + (to is not None), refused + (to is None)
        self.kept.update((state, accepted, refused))
        yield Row(**{self.key: key[0], "state": state, "accepted": accepted, "refused": refused})

    def close(self) -> None:
        pass


def state_stream(stream: DataFrame, key: str, moves: list[tuple[str, str, str]], start: str, event: str, ts: str, id_col: str) -> DataFrame:
    """The stream of each key's newest state (update mode). Events of a micro-batch are taken in order of (ts, id); micro-batches as they come,
    so results are those of :func:`last_state` where these do not overlap in time."""
    out = T.StructType([stream.schema[key], *T._parse_datatype_string("state string, accepted bigint, refused bigint").fields])
    return stream.select(key, ts, id_col, event).groupBy(key).transformWithState(Machine(key, moves, start, event, (ts, id_col)), out, "Update", "None")


def _after(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """One map after another: for each state before, the state after and what was accepted and refused on the way."""
    to, ok, no = first
    take = lambda x: np.take_along_axis(x, to, axis=1)
    return take(second[0]), ok + take(second[1]), no + take(second[2])


def composed(group: np.ndarray, maps: tuple[np.ndarray, ...]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(group, map) of the runs of equal groups: neighbours are composed in pairs until each group has one map."""
    while len(group) and (same := group[1:] == group[:-1]).any():
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        place = np.arange(len(group)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(group)]])))
        left = np.flatnonzero(place % 2 == 0)
        pair = left[(left + 1 < len(group)) & (np.append(group, -1)[left + 1] == group[left])]
        maps = tuple(x.copy() for x in maps)
        for x, y in zip(maps, _after(tuple(x[pair] for x in maps), tuple(x[pair + 1] for x in maps))):
            x[pair] = y
        group, maps = group[left], tuple(x[left] for x in maps)
    return group, maps


def _folded(spec: T.StructType, unpack, pack):
    """Rows in order of their first column to one row for each run of it: maps are unpacked, composed and packed; the last run waits for the next batch."""
    arrow = to_arrow_schema(spec)

    def work(batches):
        held = None  # (key as an array of one, map of one row)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, maps = batch.column(0), unpack(batch)
            ends = pc.run_end_encode(keys).run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            names = keys.take(pa.array(ends - 1))
            if held is not None:
                if names[0] == held[0][0] or (names[0].as_py() is None and held[0][0].as_py() is None):
                    group, maps = np.concatenate([[0], group]), tuple(np.concatenate([a, b]) for a, b in zip(held[1], maps))
                else:
                    yield pack(arrow, held[0], held[1])
            group, maps = composed(group, maps)
            if len(names) > 1:
                yield pack(arrow, names.slice(0, len(names) - 1), tuple(x[:-1] for x in maps))
            held = (names.slice(len(names) - 1, 1), tuple(x[-1:] for x in maps))
        if held is not None:
            yield pack(arrow, *held)

    return work


def last_state(df: DataFrame, key: str, moves: list[tuple[str, str, str]], start: str, event: str, ts: str, id_col: str) -> DataFrame:
    """(key, state, accepted, refused): the state of each key after its events in order of (ts, id); a move (from, event, to) that is not
    listed is refused, so terminal states stay.

    An event is a map from state to state, and maps compose: rows are dealt by ranges of (key, ts, id), each range gives one map for
    each of its keys, and a key's maps are composed in the order of ranges. So a key with a third of all events is many tasks' work,
    and no task holds more than a batch of them.
    """
    states = list(dict.fromkeys([start, *(s for a, _, b in moves for s in (a, b))]))
    events = list(dict.fromkeys(e for _, e, _ in moves))
    number = {s: i for i, s in enumerate(states)}
    to = np.tile(np.arange(len(states)), (len(events) + 1, 1))
    moved = np.zeros_like(to, bool)
    for a, e, b in moves:
        to[events.index(e), number[a]], moved[events.index(e), number[a]] = number[b], True
    code = F.coalesce(*[F.when(F.col(event) == e, F.lit(i)) for i, e in enumerate(events)], F.lit(len(events)))

    def single(batch):
        e = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        return to[e], moved[e].astype(np.int64), (~moved[e]).astype(np.int64)

    def stacked(batch):
        return tuple(batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(states)) for i in (1, 2, 3))

    def lists(arrow, keys, maps):
        return pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), *(pa.array(list(x), arrow.field(1).type) for x in maps)], schema=arrow)

    def last(arrow, keys, maps):
        a, ok, no = (x[:, 0] for x in maps)
        return pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), pa.array([states[i] for i in a.tolist()]), pa.array(ok.astype(np.int32)), pa.array(no.astype(np.int32))], schema=arrow)

    field = T.StructField(key, df.schema[key].dataType)
    ranged = df.select(key, code.alias("_e"), F.col(ts).alias("_t"), F.col(id_col).alias("_i")).repartitionByRange(key, "_t", "_i").sortWithinPartitions(key, "_t", "_i")
    spec = T.StructType([field, *T._parse_datatype_string("_to array<bigint>, _ok array<bigint>, _no array<bigint>").fields])
    maps = ranged.select(key, "_e").mapInArrow(_folded(spec, single, lists), spec).withColumn("_p", F.spark_partition_id())
    placed = maps.repartition(key).sortWithinPartitions(key, "_p").select(key, "_to", "_ok", "_no")  # a key's maps: one for each range that has it
    out = T.StructType([field, *T._parse_datatype_string("state string, accepted int, refused int").fields])
    return placed.mapInArrow(_folded(out, stacked, last), out)


# --- idempotent answers


class Answers(StatefulProcessor):
    """A store of first answers by request: a repeat within ``lifetime`` seconds of the first gets the first's answer, a later one is a first
    again; above ``most`` entries the quarter that expires first goes."""

    def __init__(self, request: str, response: str, ts: str, order: tuple[str, ...], columns: list[str], lifetime: float, most: int):
        self.request, self.response, self.ts, self.order, self.columns, self.lifetime, self.most = request, response, ts, order, columns, lifetime, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("answers", "request string", "expires double, response string")
        self.size = handle.getValueState("size", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = self.size.get()[0] if self.size.exists() else 0
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            name, now = (str(r[self.request]),), r[self.ts].timestamp()
            known = self.kept.getValue(name) if self.kept.containsKey(name) else None
            if known is not None and now <= known[0]:
                yield self._answered(r, known[1], True)
                continue
            n += known is None
            self.kept.updateValue(name, (now + self.lifetime, r[self.response]))
            if n > self.most:
                for gone, _ in sorted(self.kept.iterator(), key=lambda x: (x[1][0], x[0]))[: n // 4]:
                    self.kept.removeKey(gone)
                n -= n // 4
            yield self._answered(r, r[self.response], False)
        self.size.update((n,))

    def _answered(self, row: Row, answer: str, replayed: bool) -> Row:
        return Row(**{c: row[c] for c in self.columns}, answer=answer, replayed=replayed)

    def close(self) -> None:
        pass


def _answer_schema(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string("answer string, replayed boolean").fields])


def answer_stream(stream: DataFrame, store: str, request: str, response: str, ts: str, id_col: str, lifetime: float = 86_400, most: int = 1024) -> DataFrame:
    """The stream's rows with (answer, replayed), from one store of answers for each value of ``store`` (:class:`Answers`)."""
    made = Answers(request, response, ts, (ts, id_col), stream.columns, lifetime, most)
    return stream.groupBy(store).transformWithState(made, _answer_schema(stream), "Append", "None")


def answers(df: DataFrame, store: str, request: str, response: str, ts: str, id_col: str, lifetime: float = 86_400, most: int = 1024) -> DataFrame:
    """The batch twin of :func:`answer_stream`. A store is a machine whose every step depends on the one before, so its rows pass
    through one task, in order and one at a time; what it holds is ``most`` entries. Use :func:`first_answers` where stores stay small."""
    columns, spec = df.columns, _answer_schema(df)
    arrow = to_arrow_schema(spec)

    def work(batches):
        now, held = None, {}
        for batch in batches:
            out = []
            for group, name, at, said in zip(*(batch.column(c).to_pylist() for c in ("_s", "_r", "_t", "_a"))):
                if group != now:
                    now, held = group, {}
                known = held.get(name)
                if known is not None and at <= known[0]:
                    out.append((known[1], True))
                    continue
                held[name] = (at + lifetime, said)
                if len(held) > most:
                    for gone in sorted(held, key=lambda k: (held[k][0], k))[: len(held) // 4]:
                        del held[gone]
                out.append((said, False))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in columns), pa.array(a, pa.string()), pa.array(b, pa.bool_())], schema=arrow)

    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    keyed = df.select("*", F.col(store).cast("string").alias("_s"), F.col(request).cast("string").alias("_r"), seconds.alias("_t"), F.col(response).cast("string").alias("_a"))
    return keyed.repartition("_s").sortWithinPartitions("_s", "_t", id_col).mapInArrow(work, spec)


def first_answers(df: DataFrame, keys: list[str], response: str, ts: str, id_col: str, lifetime: float = 86_400) -> DataFrame:
    """The rows with (answer, replayed) where nothing is evicted: within a request's rows the first begins a lifetime, and so does the
    first after each. Requests are dealt by hash; each run of rows is cut by binary search for the next first, and only the
    live answer is held from batch to batch."""
    columns, spec = df.columns, _answer_schema(df)
    arrow = to_arrow_schema(spec)

    def work(batches):
        key, live, said = None, -np.inf, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at, own = batch.column("_k"), batch.column("_t").to_numpy(zero_copy_only=False), batch.column("_a").to_pylist()
            ends = pc.run_end_encode(names).run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
            answer, fresh, begin = [], np.zeros(batch.num_rows, bool), 0
            for end in ends.tolist():
                if (name := names[begin].as_py()) != key:
                    key, live, said = name, -np.inf, None
                i = begin
                while i < end:
                    j = begin + int(np.searchsorted(at[begin:end], live, "right"))  # rows up to j are repeats of the live answer
                    answer += [said] * (j - i)
                    if j == end:
                        break
                    live, said, fresh[j] = at[j] + lifetime, own[j], True
                    answer.append(said)
                    i = j + 1
                begin = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in columns), pa.array(answer, pa.string()), pa.array(~fresh)], schema=arrow)

    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    keyed = df.select("*", named.alias("_k"), seconds.alias("_t"), F.col(response).cast("string").alias("_a"))
    return keyed.repartition("_k").sortWithinPartitions("_k", "_t", id_col).mapInArrow(work, spec)
