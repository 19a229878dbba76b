"""Live forms of keyed operators, by ``transformWithStateInPandas``: several feeds in one state, timers, state that expires.

A feed's rows come in micro-batches, in any order within one. Each operator keeps, per key,
what it can't give out yet, and gives it out when time says so: event time by the watermark
(replayed feeds), or processing time by timers (a running collector). State is bounded by
what lies between the watermark and now, or by a few values; it is kept in RocksDB.

``spark.sql.streaming.stateStore.providerClass`` has to be the RocksDB provider
(``with_rocksdb``). Feeds are united to one stream first (``tagged``), so a key's feeds meet
in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND_MS = 1_000
#: How long after a boundary a row of its second may still be taken up, and is waited for.
DELAY_MS = 250
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Set the state store that the operators here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def tagged(feeds: Mapping[str, DataFrame], key: str, time: str, order: str = "sequence", lateness: str | None = None, named: Mapping[str, Column] | None = None) -> DataFrame:
    """Feeds as one stream (feed, key, ms, sequence, ts, body): ``body`` is a row's other columns as JSON, ``ts`` its time.

    With ``lateness`` the stream has a watermark that far behind its newest row. A feed in
    ``named`` has its rows once under each of the names in that array instead of its own.
    """
    out = None
    for name, df in feeds.items():
        body = F.to_json(F.struct(*(c for c in df.columns if c != key)))
        at = F.col(time).cast("long")
        feed = F.explode(named[name]) if named and name in named else F.lit(name)
        one = df.select(feed.alias("feed"), F.col(key).cast("string").alias("key"), at.alias("ms"), F.col(order).cast("long").alias("sequence"), F.timestamp_millis(at).alias("ts"), body.alias("body"))
        out = one if out is None else out.unionByName(one)
    return out.withWatermark("ts", lateness) if lateness else out


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple[int, int, str, str]]:
    """(ms, sequence, feed, body) of a batch, in order."""
    out: list[tuple[int, int, str, str]] = []
    for f in frames:
        out += zip(f["ms"].tolist(), f["sequence"].tolist(), f["feed"].tolist(), f["body"].tolist())
    return sorted(out)


def _text(rows: Sequence[Sequence[Any]]) -> str:
    return json.dumps(rows, separators=(",", ":"))


class CausalBars(StatefulProcessor):
    """One bar a second of a key over several feeds, from the rows received before the second's end.

    Rows are held by second, with one timer a second. A second is closed once the newest row
    of the stream is ``delay_ms`` past its end; the watermark lies ``grace_ms`` behind that, so
    that rows which come too late still get here and are counted.
    """

    def __init__(self, feeds: Sequence[str], delay_ms: int, grace_ms: int, step_ms: int = SECOND_MS, lasting: Sequence[str] = ()) -> None:
        self.lasting = set(lasting)
        self.feeds, self.step, self.after = list(feeds), step_ms, step_ms + delay_ms - grace_ms
        self.fields = ["key", "sample_second_ms", "late", "gap_ms", *(f"{f}_{x}" for f in feeds for x in ("rows", "last", "age_ms", "before", "total"))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", T.StructType([T.StructField("second", T.LongType())]), T.StructType([T.StructField("rows", T.StringType())]))
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.kept.get()[0]) if self.kept.exists() else {"done": None, "late": 0, "gap": None, "last": {}, "total": {}}
        fresh: dict[int, list] = {}
        for row in _rows(rows):
            second = row[0] - row[0] % self.step
            if kept["done"] is not None and second < kept["done"]:
                kept["late"] += 1  # its second is closed: the next bar tells
                if row[2] in self.lasting:
                    self.take(row, kept)
            else:
                fresh.setdefault(second, []).append(row)
        for second, more in fresh.items():
            if self.held.containsKey((second,)):
                more = [*map(tuple, json.loads(self.held.getValue((second,))[0])), *more]
            else:
                self.handle.registerTimer(second + self.after)
            self.held.updateValue((second,), (_text(sorted(more)),))
        self.kept.update((_text(kept),))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        second = expiredTimerInfo.getExpiryTimeInMs() - self.after
        if not self.held.containsKey((second,)):
            return
        kept, rows = json.loads(self.kept.get()[0]), json.loads(self.held.getValue((second,))[0])
        first = second if kept["done"] is None else kept["done"]
        for start in range(first, second, 10_000 * self.step):  # seconds before it that had no rows
            silent = range(start, min(start + 10_000 * self.step, second), self.step)
            yield pd.DataFrame([self.bar(key[0], s, [], kept) for s in silent], columns=self.fields)
        yield pd.DataFrame([self.bar(key[0], second, rows, kept)], columns=self.fields)
        kept["done"] = second + self.step
        self.held.removeKey((second,))
        self.kept.update((_text(kept),))

    def take(self, row: Sequence, kept: dict) -> None:
        """Make ``row`` its feed's last one, unless that is newer."""
        ms, _, feed, body = row
        if ms >= kept["last"].get(feed, (ms,))[0]:
            kept["last"][feed] = [ms, body]
        kept["total"][feed] = kept["total"].get(feed, 0) + 1

    def bar(self, key: str, second: int, rows: list, kept: dict) -> tuple:
        bodies: dict[str, list[str]] = {f: [] for f in self.feeds}
        before = {f: body for f, (_, body) in kept["last"].items()}
        for row in rows:
            bodies[row[2]].append(row[3])
            self.take(row, kept)
        if kept["late"]:
            kept["gap"] = second + self.step
        out: list = [key, second, kept["late"], kept["gap"]]
        kept["late"] = 0
        for f in self.feeds:
            ms, body = kept["last"].get(f, (None, None))
            out += [bodies[f], body, None if ms is None else second + self.step - ms, before.get(f), kept["total"].get(f, 0)]
        return tuple(out)

    def close(self) -> None:
        pass


def causal_bars(feeds: Mapping[str, DataFrame], key: str = "symbol", time: str = "received_ms", delay_ms: int = DELAY_MS, grace_ms: int = 60_000, names: Sequence[str] | None = None, named: Mapping[str, Column] | None = None, lasting: Sequence[str] = ()) -> DataFrame:
    """A bar for every second of every key from its first row on: each once, in order, silent ones too.

    For each feed: the second's rows (bodies as JSON, in order of time and sequence), the last
    body so far and its age at the second's end, the last body before the second, and how many
    rows there were so far. ``names`` and ``named`` (see ``tagged``): a feed under several names,
    each with columns of its own. ``late``: rows that came since the bar before
    for a second that was closed already; they are in no bar, but under a name in
    ``lasting`` count for what is last and how many there were. ``gap_ms``: the end of the newest
    second whose bar told of late rows. Rows more than ``grace_ms``
    behind the newest are dropped by Spark, which counts them in the query's progress.
    """
    names = list(names or feeds)
    parts = ", ".join(f"{f}_rows array<string>, {f}_last string, {f}_age_ms long, {f}_before string, {f}_total long" for f in names)
    stream = tagged(feeds, key, time, lateness=f"{grace_ms} milliseconds", named=named).groupBy("key")
    return stream.transformWithStateInPandas(
        statefulProcessor=CausalBars(names, delay_ms, grace_ms, lasting=lasting), outputStructType=f"key string, sample_second_ms long, late long, gap_ms long, {parts}", outputMode="Append", timeMode="EventTime"
    )


class AsofPairs(StatefulProcessor):
    """Rows of a left feed with the newest right row at or before them, at most ``tolerance`` older.

    Left rows wait for the watermark, right rows are dropped once no waiting or coming left
    row can reach them but through a newer one.
    """

    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        place = T.StructType([T.StructField("ms", T.LongType())])
        rows = T.StructType([T.StructField("rows", T.StringType())])
        self.left, self.right = handle.getMapState("left", place, rows), handle.getMapState("right", place, rows)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple[str, int], list] = {}
        for ms, sequence, feed, body in _rows(rows):
            fresh.setdefault((feed, ms), []).append([sequence, body])
        for (feed, ms), more in fresh.items():
            state = self.left if feed == "left" else self.right
            if state.containsKey((ms,)):
                more = json.loads(state.getValue((ms,))[0]) + more
            state.updateValue((ms,), (_text(sorted(more) if feed == "left" else [max(more)]),))
            self.handle.registerTimer(ms + 1 if feed == "left" else ms + self.tolerance + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - 1
        out = []
        if self.left.containsKey((due,)):
            own = json.loads(self.left.getValue((due,))[0])
            self.left.removeKey((due,))
            best = max((k[0] for k in self.right.keys() if due - self.tolerance <= k[0] <= due), default=None)
            right = json.loads(self.right.getValue((best,))[0])[0][1] if best is not None else None
            out = [(key[0], due, body, best, right) for _, body in own]
        old = (due - self.tolerance,)
        if self.right.containsKey(old):  # only a left row at this very time could still take it, and that has been given out
            waiting = [k[0] for k in self.left.keys() if k[0] <= due]
            if not waiting:
                self.right.removeKey(old)
        if out:
            yield pd.DataFrame(out, columns=["key", "ms", "left", "right_ms", "right"])

    def close(self) -> None:
        pass


def asof_pairs(left: DataFrame, right: DataFrame, key: str, time: str, tolerance_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """(key, ms, left, right_ms, right) of two streams, bodies as JSON; right ones null beyond the tolerance.

    A left row is given out once the watermark has passed its time, so that no right row at
    or before it can still come. Right rows of one time: the one of the greatest sequence.
    """
    stream = tagged({"left": left, "right": right}, key, time, lateness=lateness).groupBy("key")
    return stream.transformWithStateInPandas(
        statefulProcessor=AsofPairs(tolerance_ms), outputStructType="key string, ms long, left string, right_ms long, right string", outputMode="Append", timeMode="EventTime"
    )


class _Ticking(StatefulProcessor):
    """A key's processing-time clock: a timer at every boundary plus delay, each setting the next."""

    def __init__(self, step_ms: int, delay_ms: int) -> None:
        self.step, self.delay = step_ms, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("json", T.StringType())]))

    def wind(self, kept: dict, now: int) -> None:
        """Start the clock at the first boundary after ``now``."""
        if "next" not in kept:
            kept["next"] = now - now % self.step + self.step
            self.handle.registerTimer(kept["next"] + self.delay)

    def boundaries(self, kept: dict, now: int) -> list[int]:
        """Boundaries that are due, those missed since the last time too; the clock goes on to the next."""
        due = list(range(kept["next"], now - self.delay + 1, self.step))
        if due:
            kept["next"] = due[-1] + self.step
        self.handle.registerTimer(kept["next"] + self.delay)
        return due

    def close(self) -> None:
        pass


class Finalised(_Ticking):
    """A row for every boundary of a key's clock, whether rows came or not, with its jitter."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.kept.get()[0]) if self.kept.exists() else {"waiting": []}
        kept["waiting"] = sorted([*kept["waiting"], *([ms, 1] for ms, *_ in _rows(rows))])
        self.wind(kept, timerValues.getCurrentProcessingTimeInMs())
        self.kept.update((_text(kept),))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        kept, now = json.loads(self.kept.get()[0]), timerValues.getCurrentProcessingTimeInMs()
        out, due = [], self.boundaries(kept, now)
        for b in due:
            own = [x for x in kept["waiting"] if x[0] < b]
            kept["waiting"] = kept["waiting"][len(own) :]
            out.append((key[0], b, now, now - b - self.delay, b < due[-1], len(own)))
        self.kept.update((_text(kept),))
        if out:
            yield pd.DataFrame(out, columns=["key", "boundary_ms", "finalised_ms", "jitter_ms", "caught_up", "rows"])


def finalised_stream(events: DataFrame, key: str = "symbol", time: str = "received_ms", step_ms: int = SECOND_MS, delay_ms: int = DELAY_MS) -> DataFrame:
    """A row for every boundary of every key from its first row on, ``delay_ms`` after it, by the clock on the wall.

    ``rows`` are those received before the boundary and not counted yet. ``jitter_ms`` is how
    much later than due it was done; boundaries missed (a stopped or slow query) each get
    their row at the next one, ``caught_up``.
    """
    stream = tagged({"all": events}, key, time).drop("ts").groupBy("key")
    return stream.transformWithStateInPandas(
        statefulProcessor=Finalised(step_ms, delay_ms),
        outputStructType="key string, boundary_ms long, finalised_ms long, jitter_ms long, caught_up boolean, rows long", outputMode="Append", timeMode="ProcessingTime",
    )


class Sampler(_Ticking):
    """The last value of a key at every boundary, while it is fresh."""

    def __init__(self, step_ms: int, stale_ms: int) -> None:
        super().__init__(step_ms, 0)
        self.stale = stale_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        last = max([*([kept["last"]] if "last" in kept else []), *([ms, seq, body] for ms, seq, _, body in _rows(rows))])
        kept["last"] = last
        self.wind(kept, timerValues.getCurrentProcessingTimeInMs())
        self.kept.update((_text(kept),))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        kept, now = json.loads(self.kept.get()[0]), timerValues.getCurrentProcessingTimeInMs()
        ms, _, body = kept["last"]
        out = [(key[0], b, ms, b - ms, body) for b in self.boundaries(kept, now)[-1:] if b - ms <= self.stale]
        self.kept.update((_text(kept),))
        if out:
            yield pd.DataFrame(out, columns=["key", "sample_second_ms", "received_ms", "age_ms", "body"])


def sampled_stream(prices: DataFrame, key: str = "symbol", time: str = "received_ms", step_ms: int = SECOND_MS, stale_ms: int = 10_000) -> DataFrame:
    """The last value of every key at each second by the clock on the wall, also while its source is silent, until it is stale.

    Seconds missed by a slow query aren't made up: what a key was then worth is not known.
    """
    stream = tagged({"all": prices}, key, time).drop("ts").groupBy("key")
    return stream.transformWithStateInPandas(
        statefulProcessor=Sampler(step_ms, stale_ms), outputStructType="key string, sample_second_ms long, received_ms long, age_ms long, body string", outputMode="Append", timeMode="ProcessingTime"
    )


class Sessions(StatefulProcessor):
    """Connections: what each received until it closed or fell silent, and how long its key has to cool down."""

    FIELDS = ("key", "opened_ms", "closed_ms", "reason", "rows", "errors", "unhealthy_until_ms")

    def __init__(self, silent_ms: int, cool_ms: int) -> None:
        self.silent, self.cool = silent_ms, cool_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", T.StructType([T.StructField("ms", T.LongType())]), T.StructType([T.StructField("rows", T.StringType())]))
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list] = {}
        for ms, sequence, _, body in _rows(rows):
            fresh.setdefault(ms, []).append([sequence, json.loads(body).get("event")])
        for ms, more in fresh.items():
            if self.held.containsKey((ms,)):
                more += json.loads(self.held.getValue((ms,))[0])
            self.held.updateValue((ms,), (_text(sorted(more)),))
            self.handle.registerTimer(ms + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - 1
        s = json.loads(self.kept.get()[0]) if self.kept.exists() else {"opened": None, "last": None, "rows": 0, "errors": 0, "until": 0}
        out: list[tuple] = []

        def ended(at: int, reason: str) -> None:
            s["errors"] += reason == "close"
            s["until"] = max(s["until"], at + self.cool)
            out.append((key[0], s["opened"], at, reason, s["rows"], s["errors"], s["until"]))
            s["opened"], s["rows"] = None, 0

        if self.held.containsKey((due,)):
            for _, event in json.loads(self.held.getValue((due,))[0]):
                if event == "open":
                    if s["opened"] is not None:
                        ended(due, "reset")
                    s["opened"], s["until"] = due, max(s["until"], due + self.cool)
                elif event == "close" and s["opened"] is not None:
                    ended(due, "close")
                elif event == "gap" and s["opened"] is not None:
                    ended(due, "gap")  # totals start anew; the connection has to open again
                elif s["opened"] is not None:
                    s["rows"] += 1
            self.held.removeKey((due,))
            s["last"] = due
            if s["opened"] is not None:
                self.handle.registerTimer(due + self.silent + 1)
        elif s["opened"] is not None and s["last"] is not None and due >= s["last"] + self.silent:
            ended(s["last"] + self.silent, "silent")
        self.kept.update((_text(s),))
        if out:
            yield pd.DataFrame(out, columns=self.FIELDS)

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str = "connection_id", time: str = "received_ms", silent_ms: int = 30_000, cool_ms: int = 5_000, lateness: str = "0 seconds") -> DataFrame:
    """A row for every connection that ended: by close, a runtime gap, a new opening, or silence.

    ``events``: key, time, sequence, event (open, close, gap or anything else, which counts
    as a row). Openings and ends each start a cool-down; a close adds one error. Time is
    event time, so a replay gives the same rows.
    """
    schema = "key string, opened_ms long, closed_ms long, reason string, rows long, errors long, unhealthy_until_ms long"
    stream = tagged({"all": events}, key, time, lateness=lateness).groupBy("key")
    return stream.transformWithStateInPandas(statefulProcessor=Sessions(silent_ms, cool_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class Resolutions(StatefulProcessor):
    """Markets to be resolved: each wakes itself up after a delay that doubles, until it has its answer."""

    FIELDS = ("key", "status", "attempts", "due_ms", "body")

    def __init__(self, first_ms: int, most_ms: int, attempts: int) -> None:
        self.first, self.most, self.attempts = first_ms, most_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s = json.loads(self.kept.get()[0]) if self.kept.exists() else {"attempts": 0, "done": False}
        out = []
        for ms, _, feed, body in _rows(rows):
            if feed == "answers" and not s["done"]:
                s["done"] = True
                out.append((key[0], "resolved", s["attempts"], ms, body))
            elif feed == "markets" and "due" not in s and not s["done"]:
                s["due"] = ms
                self.handle.registerTimer(max(ms, timerValues.getCurrentProcessingTimeInMs()) + 1)
        if s["done"]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.kept.update((_text(s),))
        if out:
            yield pd.DataFrame(out, columns=self.FIELDS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        s, now = json.loads(self.kept.get()[0]), timerValues.getCurrentProcessingTimeInMs()
        out = []
        if not s["done"]:
            s["attempts"] += 1
            last = s["attempts"] >= self.attempts
            out = [(key[0], "given_up" if last else "ask", s["attempts"], s["due"], None)]
            s["done"] = last
            if not last:
                s["due"] = now + min(self.first * 2 ** (s["attempts"] - 1), self.most)
                self.handle.registerTimer(s["due"])
        self.kept.update((_text(s),))
        if out:
            yield pd.DataFrame(out, columns=self.FIELDS)

    def close(self) -> None:
        pass


def resolution_stream(markets: DataFrame, answers: DataFrame, key: str = "market_id", time: str = "due_ms", first_ms: int = 1_000, most_ms: int = 60_000, attempts: int = 20) -> DataFrame:
    """What is to be done about every market, by its own timers: ``ask`` again, ``resolved``, or ``given_up``.

    ``markets``: key, time (when it is first due), sequence. ``answers``: the same columns,
    and what was found. An answer ends a market's timers; until then it is asked for after
    ``first_ms``, twice that, and so on up to ``most_ms``. Nothing scans a list of due markets.
    """
    stream = tagged({"markets": markets, "answers": answers}, key, time).drop("ts").groupBy("key")
    return stream.transformWithStateInPandas(
        statefulProcessor=Resolutions(first_ms, most_ms, attempts), outputStructType="key string, status string, attempts long, due_ms long, body string", outputMode="Append", timeMode="ProcessingTime"
    )


class Generations(StatefulProcessor):
    """Rows of a key dealt to its current market and, for a while, to the one before it."""

    FIELDS = ("key", "market_ms", "phase", "ms", "sequence", "body")

    def __init__(self, width_ms: int, lead_ms: int, linger_ms: int) -> None:
        self.width, self.lead, self.linger = width_ms, lead_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        market, total = T.StructType([T.StructField("market_ms", T.LongType())]), T.StructType([T.StructField("rows", T.LongType()), T.StructField("last_ms", T.LongType())])
        self.open = handle.getMapState("open", market, total)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        mark = timerValues.getCurrentWatermarkInMs()
        for ms, sequence, _, body in _rows(rows):
            start = (ms - self.linger) // self.width * self.width
            while start - self.lead <= ms:
                end = start + self.width + self.linger
                if start - self.lead <= ms < end and end > mark:
                    if self.open.containsKey((start,)):
                        n, last = self.open.getValue((start,))
                    else:
                        n, last = 0, ms
                        self.handle.registerTimer(end)
                    self.open.updateValue((start,), (n + 1, max(last, ms)))
                    out.append((key[0], start, "early" if ms < start else "live" if ms < start + self.width else "late", ms, sequence, body))
                start += self.width
        if out:
            yield pd.DataFrame(out, columns=self.FIELDS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.linger - self.width
        out = []
        if self.open.containsKey((start,)):
            n, last = self.open.getValue((start,))
            self.open.removeKey((start,))
            out = [(key[0], start, "closed", last, n, None)]
        if out:
            yield pd.DataFrame(out, columns=self.FIELDS)

    def close(self) -> None:
        pass


def rollover_stream(messages: DataFrame, key: str = "asset", time: str = "received_ms", width_ms: int = 300_000, lead_ms: int = 45_000, linger_ms: int = 30_000, lateness: str = "0 seconds") -> DataFrame:
    """Messages with every market that is open at their time, and a ``closed`` row (rows in ``sequence``) when one's lingering ends.

    Two generations of state live side by side around a boundary; the old one is removed by a
    timer on event time ``linger_ms`` after its end.
    """
    schema = "key string, market_ms long, phase string, ms long, sequence long, body string"
    stream = tagged({"all": messages}, key, time, lateness=lateness).groupBy("key")
    return stream.transformWithStateInPandas(statefulProcessor=Generations(width_ms, lead_ms, linger_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
