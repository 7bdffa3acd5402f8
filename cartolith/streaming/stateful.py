"""Stateful stream jobs: thinning, key frames, windows by count, visits, chunk order, first sightings, idle keys, merges.

All but the last are stateful processors with a few numbers, at most one window of rows, or a map that forgets, for
a key. All of a key's rows of a trigger are put in order before they are looked at, however they come in batches: a
trigger's rows of one key must fit in a task, which maxFilesPerTrigger sees to. Across triggers rows must arrive in
order; what is late is flagged, not lost. State is kept in RocksDB: a session that names another store is
set to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cartolith.functions.time import micros
from cartolith.operators.shared import dropped, kept
from cartolith.sources.versions import VersionedTable

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _kind(text: str) -> T.StructType:
    """A schema from its DDL. Processors get schemas made beforehand, as there is no session in a worker to parse them."""
    return T.StructType.fromDDL(text)


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, timed: bool = False) -> DataFrame:
    conf = rows.sparkSession.conf
    if not conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, _kind(out), "Append", "ProcessingTime" if timed else "None")


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _Fold(StatefulProcessor):
    """One row of state a key; step takes key, ordered rows and state (None at first), and gives rows and state."""

    def __init__(self, by: list[str], state: str, step: Callable) -> None:
        self.by, self.kind, self.step = by, _kind(state), step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kind)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, state = self.step(key, _ordered(rows, self.by), tuple(self.state.get()) if self.state.exists() else None)
        self.state.update(state)
        yield out

    def close(self) -> None:
        pass


def thin(rows: DataFrame, key: str, ts: str, least_gap_s: float, slack_s: float = 1e-4, keep: list[str] = ()) -> DataFrame:
    """key, at (microseconds) and the columns `keep` of rows at least least_gap_s - slack_s after the last one kept."""
    least = int(round((least_gap_s - slack_s) * 1e6))
    timed = rows.select(key, micros(ts).alias("at"), *keep)
    kinds = dict(timed.dtypes)

    def step(k: tuple, found: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last = state[0] if state else None
        chosen = []
        for at in found["at"].tolist():
            good = last is None or at - last >= least
            last = at if good else last
            chosen.append(good)
        return found[chosen], (last,)

    return _stateful(timed, [key], _Fold(["at"], "last long", step), ", ".join(f"{c} {kinds[c]}" for c in timed.columns))


def key_frames(rows: DataFrame, key: str, order: str, value: str, tracked: str, least: float, least_tracked: int = 10) -> DataFrame:
    """key, order, value of rows that are admitted: the first, those whose value is more than least from the last one admitted, and those of fewer than least_tracked tracked points.

    Rows without a value are admitted only for want of tracked points, and then the next one is admitted too."""

    def step(k: tuple, found: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        known, last = (True, state[0]) if state else (False, None)
        chosen = []
        for v, n in zip(found[value].tolist(), found[tracked].tolist(), strict=True):
            missing = v is None or v != v
            good = n == n and n is not None and n < least_tracked or (not missing and (not known or last is None or abs(v - last) > least))
            if good:
                known, last = True, None if missing else float(v)
            chosen.append(good)
        return found.loc[chosen, [key, order, value]], (last,)

    kinds = dict(rows.dtypes)
    plain = rows.select(key, order, F.col(value).cast("double").alias(value), F.col(tracked).cast("double").alias(tracked))
    return _stateful(plain, [key], _Fold([order], "last double", step), f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double")


class _Windows(StatefulProcessor):
    """The rows of one unfinished window, and its number."""

    def __init__(self, order: str, size: int, overlap: int, idle_ms: int | None) -> None:
        self.order, self.size, self.overlap, self.idle_ms = order, size, overlap, idle_ms
        self.kinds = _kind("number long"), _kind("member long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", self.kinds[0])
        self.held = handle.getListState("held", self.kinds[1])

    def _state(self) -> tuple[int, list[int]]:
        return self.number.get()[0] if self.number.exists() else 0, [r[0] for r in self.held.get()] if self.held.exists() else []

    def _keep(self, number: int, held: list[int]) -> None:
        self.number.update((number,))
        if held:
            self.held.put([(v,) for v in held])
        else:
            self.held.clear()

    def _rest(self, number: int, held: list[int]) -> list[tuple]:
        """The unfinished window, if it holds more rows than the last one would have left it, and two at least."""
        return [(number, held, True)] if len(held) > max(1, self.overlap) else []

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in out], columns=[*(f"k{i}" for i in range(len(key))), "window", "members", "partial"])

    def _timers(self, timerValues) -> None:
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, held = self._state()
        out = []
        found = _ordered(rows, [self.order])
        for v, stop in zip(found[self.order].tolist(), found["stop"].tolist(), strict=True):
            held.append(int(v))
            if len(held) == self.size + self.overlap:
                out.append((number, held, False))
                number, held = number + 1, held[-self.overlap :] if self.overlap else []
            if stop:
                rest = self._rest(number, held)
                out += rest
                number, held = number + len(rest), []
        self._keep(number, held)
        self._timers(timerValues)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, held = self._state()
        rest = self._rest(number, held)
        self._keep(number + len(rest), [])
        yield self._frame(key, rest)

    def close(self) -> None:
        pass


def windows(rows: DataFrame, key: str, order: str, size: int, overlap: int, stop: str | None = None, idle_s: float | None = None) -> DataFrame:
    """key, window, members, partial: whenever size + overlap rows are there, their order values; the last overlap ones begin the next.

    An unfinished window is given out as partial, and forgotten, after a row whose column stop is true, and when no row has come for idle_s; one of
    a single row, or of no more than overlap rows, is forgotten only."""
    kinds = dict(rows.dtypes)
    marked = F.coalesce(F.col(stop).cast("boolean"), F.lit(False)) if stop else F.lit(False)
    plain = rows.select(F.col(key).alias("k0"), F.col(order).cast("long").alias(order), marked.alias("stop"))
    found = _stateful(plain, ["k0"], _Windows(order, size, overlap, int(idle_s * 1000) if idle_s else None), f"k0 {kinds[key]}, window long, members array<long>, partial boolean", timed=bool(idle_s))
    return found.withColumnRenamed("k0", key)


def visits(rows: DataFrame, key: str, ts: str, gap_s: float = 1800.0) -> DataFrame:
    """key, at, visit of each row; a gap of gap_s or more begins a new visit. A row before the last one seen has late true and stays in the visit."""
    gap = int(gap_s * 1e6)
    kinds = dict(rows.dtypes)

    def step(k: tuple, found: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, visit = state or (None, 0)
        out = []
        for at in found["at"].tolist():
            late = last is not None and at < last
            visit += 0 if late or (last is not None and at - last < gap) else 1
            last = at if last is None else max(last, at)
            out.append((k[0], at, visit, late))
        return pd.DataFrame(out, columns=[key, "at", "visit", "late"]), (last, visit)

    return _stateful(rows.select(key, micros(ts).alias("at")), [key], _Fold(["at"], "last long, visit long", step), f"{key} {kinds[key]}, at long, visit long, late boolean")


def chunk_order(rows: DataFrame, key: str, number: str, arrival: list[str]) -> DataFrame:
    """key, number, expected, in_order of each chunk, in the order of the columns arrival; what is expected next follows each chunk, also one that failed or came out of order."""
    kinds = dict(rows.dtypes)

    def step(k: tuple, found: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        expected = state[0] if state else None
        out = []
        for n in map(int, found[number].tolist()):
            want = n if expected is None else expected
            out.append((k[0], n, want, n == want))
            expected = n + 1
        return pd.DataFrame(out, columns=[key, number, "expected", "in_order"]), (expected,)

    plain = rows.select(*dict.fromkeys([key, *arrival, number])).withColumn(number, F.col(number).cast("long"))
    return _stateful(plain, [key], _Fold(arrival, "expected long", step), f"{key} {kinds[key]}, {number} long, expected long, in_order boolean")


class _Seen(StatefulProcessor):
    """A map of what was seen; an entry is forgotten some time after it was last seen."""

    def __init__(self, items: list[str], item_kind: str, ttl_ms: int | None) -> None:
        self.items, self.kinds, self.ttl_ms = items, (_kind(item_kind), _kind("n long")), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", *self.kinds, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            new = []
            for at, item in enumerate(b[self.items].itertuples(index=False, name=None)):
                item = tuple(None if v != v else v for v in item)
                known = self.seen.containsKey(item)
                self.seen.updateValue(item, ((self.seen.getValue(item)[0] if known else 0) + 1,))
                if not known:
                    new.append(at)
            yield b.iloc[new]

    def close(self) -> None:
        pass


def unseen(rows: DataFrame, keys: list[str], items: list[str], ttl_s: float | None = None) -> DataFrame:
    """keys and items of rows whose items (submap, frame and query, say) their key hasn't had yet, or not for ttl_s: what still is to be worked on."""
    kinds = dict(rows.dtypes)
    ddl = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return _stateful(rows.select(*keys, *items), keys, _Seen(items, ddl(items), int(ttl_s * 1000) if ttl_s else None), ddl([*keys, *items]), timed=bool(ttl_s))


class _Idle(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle_ms, self.kind = idle_ms, _kind("last long, n long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.kind)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.state.get() if self.state.exists() else (None, 0)
        for b in rows:
            last, n = int(b["at"].max()) if last is None else max(last, int(b["at"].max())), n + len(b)
        self.state.update((last, n))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"k0": [], "last": [], "n": []})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"k0": [key[0]], "last": [last], "n": [n]})

    def close(self) -> None:
        pass


def idle(rows: DataFrame, key: str, ts: str, idle_s: float) -> DataFrame:
    """key, last (microseconds) and n of each key for which no row has come for idle_s: its last time and how many rows it had. A later row begins anew."""
    kinds = dict(rows.dtypes)
    timed = rows.select(F.col(key).alias("k0"), micros(ts).alias("at"))
    return _stateful(timed, ["k0"], _Idle(int(idle_s * 1000)), f"k0 {kinds[key]}, last long, n long", timed=True).withColumnRenamed("k0", key)


def merged_into(rows: DataFrame, table: VersionedTable, name: str, full: str | None = None, recompute: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that merges each trigger's rows into table, each trigger once even if it is repeated; start() needs a checkpoint.

    full: a column that is true where a group (table.by) must be made anew: recompute takes the groups' keys and
    gives all of their rows, which replace those in the table. Other groups' rows are merged. The column itself isn't stored."""

    def merge(trigger: DataFrame, number: int) -> None:
        batch = kept(trigger, "trigger")  # it is read more than once
        new, anew = batch.drop(full) if full else batch, None
        if full:
            groups = batch.filter(full).select(*table.by).distinct()
            if not groups.isEmpty():
                anew = groups
                new = new.join(groups, table.by, "left_anti").unionByName(recompute(groups))
        table.upsert(new, (name, number), anew)
        dropped(batch)

    return rows.writeStream.queryName(name).foreachBatch(merge)


def once(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """rows without repeats of the same keys within the watermark's delay: a resend changes nothing."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def event_counts(rows: DataFrame, key: str, ts: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts by key and event-time window, final once the watermark has passed."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")
