"""Streaming jobs that keep typed state and event-time timers per key: admission in order, and expiry.

Both need the RocksDB state store (``STATE_STORE`` holds the setting) and a watermark, which decides when a time is over.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .activity import REQUEST_CAP, TTL_SECONDS, UNIT_CAP, WATERMARK

#: Setting under which these jobs run.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ADMITTED = "event_id bigint, seat string, day string, admitted boolean"
DAY_MS = 24 * 3600 * 1000
#: Keys of the state: shares of a day's seats and shares of the items, since a key of its own for each would cost more calls to the
#: state than work. State is found by them, so they must stay as they are for the life of a checkpoint.
SEAT_PARTS, ITEM_PARTS = 256, 4096


def _set_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The one timer of a key, which fires once the watermark has reached ``at``."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


def _put(state, rows: list[tuple]) -> None:
    """Rows as the columns of one value, or nothing if there are none."""
    if rows:
        state.update(tuple(map(list, zip(*rows))))
    elif state.exists():
        state.clear()


def _rows(state) -> Iterator[tuple]:
    return zip(*state.get()) if state.exists() else iter(())


class Admission(StatefulProcessor):
    """Requests of a day and a share of the seats, each seat's in time order, whatever order they arrive in.

    A request waits until the watermark has passed it, since an earlier one may still come. One that already has
    ``REQUEST_CAP`` requests of its seat before it is refused at once: what comes later can only add to them. So no seat holds more
    than that many, however many requests it gets, and a day's state goes when the watermark leaves the day.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "seat array<string>, requests array<bigint>, units array<bigint>")
        self.waiting = handle.getValueState(
            "waiting", "seat array<string>, us array<bigint>, unnamed array<boolean>, event_id array<bigint>, units array<bigint>")

    def _used(self) -> dict[str, tuple[int, int]]:
        return {seat: (requests, units) for seat, requests, units in _rows(self.used)}

    def _held(self) -> defaultdict[str, list[tuple]]:
        held = defaultdict(list)
        for seat, *request in _rows(self.waiting):
            held[seat].append(tuple(request))
        return held

    def _keep(self, day: str, held: dict[str, list[tuple]]) -> None:
        _put(self.waiting, [(seat, *request) for seat, line in held.items() for request in line])
        first = min((line[0][0] for line in held.values() if line), default=None)
        end = _end_ms(day)
        _set_timer(self.handle, end if first is None else min(-(-first // 1000), end))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, held = self._used(), self._held()
        for frame in rows:
            asked = frame["seat"].tolist()
            for seat, *request in zip(asked, *(frame[c].tolist() for c in ("us", "unnamed", "event_id", "units"))):
                held[seat].append(tuple(request))
            refused = []
            for seat in set(asked):
                held[seat].sort()
                room = max(REQUEST_CAP - used.get(seat, (0, 0))[0], 0)
                refused += [(seat, request, False) for request in held[seat][room:]]
                del held[seat][room:]
            if refused:
                yield _verdicts(key[0], refused)
        self._keep(key[0], held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        used, held, out = self._used(), self._held(), []
        for seat, line in held.items():
            requests, units = used.get(seat, (0, 0))
            passed = [request for request in line if request[0] <= now * 1000]
            for request in passed:
                free = requests < REQUEST_CAP and units < UNIT_CAP
                out.append((seat, request, free))
                if free:
                    requests, units = requests + 1, units + request[-1]
            if passed:
                used[seat] = requests, units
                del line[:len(passed)]
        if now >= _end_ms(key[0]):
            _put(self.used, [])     # rows of the day that come now are late
            _put(self.waiting, [])
            _set_timer(self.handle, None)
        else:
            _put(self.used, [(seat, *of_seat) for seat, of_seat in used.items()])
            self._keep(key[0], held)
        if out:
            yield _verdicts(key[0], out)

    def close(self) -> None:
        pass


def _end_ms(day: str) -> int:
    return int(pd.Timestamp(day, tz="UTC").timestamp() * 1000) + DAY_MS


def _verdicts(day: str, judged: list[tuple]) -> pd.DataFrame:
    ids = pd.array([None if unnamed else event_id for _, (_, unnamed, event_id, _), _ in judged], "Int64")
    return pd.DataFrame({"event_id": ids, "seat": [j[0] for j in judged], "day": day, "admitted": [j[2] for j in judged]})


def admit_stream(activity: DataFrame) -> DataFrame:
    """Verdicts of ``usage_admission`` on a stream, each once the watermark has passed its request or it is refused for good.

    Requests later than the watermark are dropped; those without a seat or a time take no part; null units cost nothing.
    """
    # a request that alone reaches the cap costs the same whatever is beyond it, and sums stay small
    cost = F.least(F.greatest(F.coalesce("units", F.lit(0)), F.lit(0)), F.lit(UNIT_CAP)).cast("bigint")
    rows = activity.filter("seat IS NOT NULL AND ts IS NOT NULL").select(
        F.coalesce("event_id", F.lit(0)).cast("bigint").alias("event_id"), F.col("event_id").isNull().alias("unnamed"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("seat").cast("string").alias("seat"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), cost.alias("units"))
    timed = rows.withWatermark("ts", WATERMARK).withColumn("us", F.unix_micros("ts")).withColumn(
        "part", F.pmod(F.xxhash64("seat"), F.lit(SEAT_PARTS)).cast("int"))
    return timed.groupBy("day", "part").transformWithStateInPandas(Admission(), ADMITTED, "Append", "EventTime")


class Expiry(StatefulProcessor):
    """A share of the items: when each was last stored, and who protects it. Expired and unprotected items are told and forgotten."""

    def __init__(self, ttl: int):
        self.ttl_ms = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "event_id array<bigint>, us array<bigint>")
        self.guards = handle.getValueState("guards", "event_id array<bigint>, name array<string>")

    def _wait(self, stored: dict[int, int], guards: Iterable[tuple[int, str]], now: int) -> None:
        guarded = {item for item, _ in guards}
        first = min((us for item, us in stored.items() if item not in guarded), default=None)
        # a released item may be past its time: the next watermark then takes it
        _set_timer(self.handle, None if first is None else max(first // 1000 + self.ttl_ms + 1, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = [c for frame in rows for c in zip(*(frame[name].tolist() for name in ("us", "event_id", "kind", "guard")))]
        stored, guards = dict(_rows(self.stored)), dict.fromkeys(_rows(self.guards))
        for us, item, kind, guard in sorted(changes, key=lambda c: c[0]):
            if kind == "store":
                stored[item] = max(us, stored.get(item, us))
            elif kind == "protect":
                guards[item, guard] = None
            elif kind == "release":
                guards.pop((item, guard), None)
        _put(self.stored, list(stored.items()))
        _put(self.guards, list(guards))
        self._wait(stored, guards, timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        stored, guards = dict(_rows(self.stored)), list(_rows(self.guards))
        guarded = {item for item, _ in guards}
        gone = [item for item, us in stored.items() if us < (now - self.ttl_ms) * 1000 and item not in guarded]
        for item in gone:
            del stored[item]
        _put(self.stored, list(stored.items()))
        self._wait(stored, guards, now)
        if gone:
            yield pd.DataFrame({"event_id": pd.array([None if key[0] < 0 else item for item in gone], "Int64")})

    def close(self) -> None:
        pass


def expire_stream(changes: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """event_id of items once the watermark is more than ``ttl`` seconds past when they were last stored.

    ``changes`` (event_id, ts, kind, guard): ``kind`` is store, protect or release; an item stays as long as any ``guard``
    protects it, and goes with the first watermark after the last release. A key holds a share of the items, for each
    a time and its guards; an item is gone from it once told, as is a guard once released. Changes without an event_id are of one item, with a
    key of its own (-1); those without a time take no part.
    """
    part = F.when(F.col("event_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(ITEM_PARTS))).cast("int")
    timed = changes.filter("ts IS NOT NULL").select(
        part.alias("part"), F.coalesce("event_id", F.lit(0)).cast("bigint").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("guard", F.lit("")).alias("guard"))
    timed = timed.withWatermark("ts", WATERMARK).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("part").transformWithStateInPandas(Expiry(ttl), "event_id bigint", "Append", "EventTime")
