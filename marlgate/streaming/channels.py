"""What lasts on a stream of job events: a client's view from when it joins, states that expire, totals as pages finish.

Each is there on a table too, with the same rows in the end.  State of a task goes an hour of event time after its last event, so
what a stream holds is bounded by the tasks of an hour, not by all there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marlgate.shipping import ship
from marlgate.streaming.jobs import FINAL, SHOWN, latest_state

ENDED = ["completed", "failed", "cancelled"]
#: How long results and states are kept, in seconds.
TTL = 3600
VIEW = "task_id bigint, place int, event_id bigint, ts timestamp, type string, percent double, status string, is_final boolean"


# A client's view


def _percent():
    return F.when(F.col("total_pages") > 0, F.col("current_page") / F.col("total_pages") * 100).otherwise(F.lit(0.0))


def client_view(events: DataFrame, clients: DataFrame) -> DataFrame:
    """What each client (client_id, task_id, joined) is shown: the state of its task when it joins, then later events.

    The snapshot (place 0) has the number of no event, the task's status and progress, and the time of its last event.  Later events
    (place 1) are those that a channel passes on, up to the first that ends the task.  A task that had no event yet has no snapshot; one
    that had ended shows nothing after it.
    """
    own = clients.select("client_id", F.col("task_id").alias("_task"), "joined")
    seen = events.join(own, F.col("task_id") == F.col("_task"))
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    past = seen.where("ts <= joined").groupBy("client_id", "task_id").agg(last("status"), last("progress"), F.max("ts").alias("ts"))
    over = F.coalesce(F.col("status").isin(ENDED), F.lit(False))
    none = F.lit(None).cast("bigint").alias("event_id")
    snapshot = past.select("client_id", "task_id", F.lit(0).alias("place"), none, "ts", F.lit("snapshot").alias("type"), F.coalesce("progress", F.lit(0.0)).alias("percent"), "status", over.alias("is_final"))
    ended = past.where(over).select(F.col("client_id").alias("_done"))
    later = seen.where((F.col("ts") > F.col("joined")) & F.col("type").isin(SHOWN)).join(ended, F.col("client_id") == F.col("_done"), "left_anti")
    final = F.col("type").isin(FINAL)
    end = F.min(F.when(final, at)).over(W.partitionBy("client_id"))
    kept = later.withColumn("_end", end).where(F.col("_end").isNull() | (at <= F.col("_end")))
    return snapshot.unionByName(kept.select("client_id", "task_id", F.lit(1).alias("place"), "event_id", "ts", "type", _percent().alias("percent"), "status", final.alias("is_final")))


class _Channel(StatefulProcessor):
    """Of each task: what is known, whether it was shown, whether the channel is closed."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, percent double, at bigint, event bigint, shown boolean, closed boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        status = None if pd.isna(row["status"]) else str(row["status"])
        percent = 0.0 if pd.isna(row["progress"]) else float(row["progress"])
        self.held.update((status, percent, int(row["last_micros"]), int(row["last_event"]), False, status in ENDED))
        self.handle.registerTimer(1)  # a task without later events is shown once time moves

    def _snapshot(self, key, state) -> pd.DataFrame:
        status, percent, at, _, _, closed = state
        return pd.DataFrame({"task_id": [key[0]], "place": [0], "event_id": [None], "ts": [pd.Timestamp(at, unit="us")], "type": ["snapshot"], "percent": [percent], "status": [status], "is_final": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        state = self.held.get() if self.held.exists() else None
        if state is not None and not state[4]:
            yield self._snapshot(key, state)
        status, percent, at, event, _, closed = state or (None, 0.0, -1, -1, True, False)
        frame = frame.assign(at=frame["ts"].astype("datetime64[us]").astype("int64")).sort_values(["at", "event_id"])
        frame = frame[(frame["at"] > at) | ((frame["at"] == at) & (frame["event_id"] > event))]
        if len(frame):
            at, event = int(frame["at"].iloc[-1]), int(frame["event_id"].iloc[-1])
            shown = frame[frame["type"].isin(SHOWN)] if not closed else frame.iloc[:0]
            ends = shown["type"].isin(FINAL).to_numpy().nonzero()[0]
            if len(ends):
                shown, closed = shown.iloc[: ends[0] + 1], True
            if len(shown):
                total = shown["total_pages"].fillna(0)
                done = (shown["current_page"] / total.where(total > 0) * 100).fillna(0.0)
                known = shown["status"].where(shown["status"].notna(), None)
                yield pd.DataFrame({"task_id": key[0], "place": 1, "event_id": shown["event_id"], "ts": shown["ts"], "type": shown["type"], "percent": done, "status": known, "is_final": shown["type"].isin(FINAL)})
        self.held.update((status, float(percent), at, event, True, bool(closed)))
        self.handle.registerTimer(max(at // 1000 + self.ttl * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.held.exists():
            return
        status, percent, at, event, shown, closed = state = self.held.get()
        if not shown:
            yield self._snapshot(key, state)
            self.held.update((status, percent, at, event, True, closed))
        ends = at // 1000 + self.ttl * 1000
        if ends <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
        elif expiredTimerInfo.getExpiryTimeInMs() < ends:
            self.handle.registerTimer(ends)

    def close(self) -> None:
        pass


def client_stream(events: DataFrame, history: DataFrame, late: str = "1 hour", ttl: int = TTL) -> DataFrame:
    """``client_view`` on a stream, for clients that join now: ``history`` has the events so far, ``events`` the stream.

    The state of each task starts as its last known one.  It is shown first, then events that are later than what it was made of: the
    stream may well begin before, nothing is shown twice.  Tasks without later events are shown when the watermark moves.  Needs the
    RocksDB state store (``use_rocksdb``).
    """
    ship(history.sparkSession)
    at = F.struct("ts", "event_id")
    known = latest_state(history).withColumn("last_micros", F.unix_micros("last_update"))
    last = history.groupBy(F.col("task_id").alias("_t")).agg(F.max(at)["event_id"].alias("last_event"))
    start = known.join(last, F.col("task_id") == F.col("_t")).select("task_id", "status", "progress", "last_micros", "last_event")
    rows = events.withWatermark("ts", late).select("task_id", "event_id", "ts", "type", "status", "current_page", "total_pages").groupBy("task_id")
    return rows.transformWithStateInPandas(_Channel(ttl), VIEW, "Append", "EventTime", initialState=start.groupBy("task_id"))


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful operators with an initial state or timers by name keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# States that expire

LIVE = "task_id bigint, status string, current_page int, total_pages int, progress double, last_update timestamp, expired boolean"
_FIELDS = ["status", "current_page", "total_pages", "progress"]


def live_states(events: DataFrame, ttl: int = TTL, late: str = "0 seconds") -> DataFrame:
    """``latest_state`` of a stream, with an end: a task without events for ``ttl`` seconds of event time expires.

    In update mode a task's row is sent on whenever its state changes, and once more with ``expired`` when the watermark has passed its
    time; its state is then dropped.  Events after such a gap begin a new state, whether the watermark passed in between or not.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap = pd.Timedelta(seconds=ttl)

    def row(key, values, micros, expired):
        status, page, total, progress = values
        frame = {"task_id": [key[0]], "status": [status], "current_page": [page], "total_pages": [total], "progress": [progress], "last_update": [pd.Timestamp(micros, unit="us")], "expired": [expired]}
        return pd.DataFrame(frame).astype({"current_page": "Int32", "total_pages": "Int32", "progress": "Float64"})

    def step(key, batches, held):
        if held.hasTimedOut:
            *values, micros = held.get
            held.remove()
            yield row(key, values, micros, True)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        *values, micros = held.get if held.exists else (None, None, None, None, None)
        before = rows["ts"].shift(fill_value=rows["ts"].iloc[0] if micros is None else pd.Timestamp(micros, unit="us"))
        breaks = (rows["ts"] - before > gap).to_numpy().nonzero()[0]
        if len(breaks):
            rows, values = rows.iloc[breaks[-1] :], [None] * 4
        for k, c in enumerate(_FIELDS):
            known = rows[c].dropna()
            if len(known):
                values[k] = [str, int, int, float][k](known.iloc[-1])
        last = max(int(rows["ts"].astype("datetime64[us]").astype("int64").iloc[-1]), -1 if micros is None or len(breaks) else micros)
        held.update((*values, last))
        held.setTimeoutTimestamp(max(last // 1000 + ttl * 1000, held.getCurrentWatermarkMs() + 1))
        yield row(key, values, last, False)

    rows = events.withWatermark("ts", late).select("task_id", "event_id", "ts", *_FIELDS).groupBy("task_id")
    return rows.applyInPandasWithState(step, LIVE, "status string, current_page int, total_pages int, progress double, micros bigint", "update", GroupStateTimeout.EventTimeTimeout)


def expired_states(events: DataFrame, ttl: int = TTL) -> DataFrame:
    """The rows that ``live_states`` ends with, from a table: what each task's last run of events without a gap says."""
    at = F.struct("ts", "event_id")
    before = W.partitionBy("task_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(before)) > ttl * 1_000_000
    run = F.sum(F.when(gap, 1).otherwise(0)).over(before)
    numbered = events.withColumn("_run", run)
    latest = F.max("_run").over(W.partitionBy("task_id"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    states = numbered.withColumn("_last", latest).where("_run = _last").groupBy("task_id").agg(*(last(c) for c in _FIELDS), F.max("ts").alias("last_update"))
    now = events.agg(F.max("ts").alias("_now"))
    millis = lambda c: F.floor(F.unix_micros(c) / 1000)  # noqa: E731  a watermark has milliseconds
    return states.crossJoin(F.broadcast(now)).withColumn("expired", millis("last_update") + ttl * 1000 < millis("_now")).drop("_now")  # one row


# Totals as pages finish

TOTALS = "doc_id bigint, page_index int, pages bigint, so_far_figures bigint, so_far_refs bigint, so_far_texts bigint"


def running_totals_stream(pages: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Figures, references and texts of a document so far, whenever one of its pages finishes, in the order in which they do.

    ``pages`` is a stream of doc_id, page_index, error, n_figures, n_refs and n_texts; ``order`` names columns that tell which of the
    pages of a micro-batch came first.  A page counts once however often it comes, and pages with an error add nothing.  What is kept
    of a document are three sums and a bit for each page; documents of near ids, up to 64, share a state and a call, which cost more than
    what is in them.
    """
    import json

    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, held):
        rows = pd.concat(list(batches))
        rows = rows.sort_values(order, kind="stable") if order else rows
        known = {doc: (sums, int(seen, 16)) for doc, sums, seen in json.loads(bytes(held.get[0]))} if held.exists else {}
        out = []
        for doc, page, error, *counts in rows[["doc_id", "page_index", "error", "n_figures", "n_refs", "n_texts"]].itertuples(index=False):
            doc = None if doc != doc else int(doc)  # noqa: PLR0124
            sums, seen = known.get(doc, ([0, 0, 0], 0))
            if seen >> int(page) & 1:
                continue
            seen |= 1 << int(page)
            if error is None or error != error:  # noqa: PLR0124  null, or not a number
                sums = [a + int(b) for a, b in zip(sums, counts, strict=True)]
            known[doc] = (sums, seen)
            out.append((doc, int(page), seen.bit_count(), *sums))
        held.update((json.dumps([(doc, sums, f"{seen:x}") for doc, (sums, seen) in known.items()]).encode(),))
        yield pd.DataFrame(out, columns=["doc_id", "page_index", "pages", "so_far_figures", "so_far_refs", "so_far_texts"]).astype({"doc_id": "Int64", "page_index": "int32"})

    names = list(dict.fromkeys(["doc_id", "page_index", "error", "n_figures", "n_refs", "n_texts", *(order or [])]))
    shared = pages.select(*names, F.shiftright("doc_id", 6).alias("_shared")).groupBy("_shared")
    return shared.applyInPandasWithState(step, TOTALS, "documents binary", "append", GroupStateTimeout.NoTimeout)
