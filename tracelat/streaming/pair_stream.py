"""PAIR-8: incremental entry/exit pairing on a stream, with keyed state.

``groupBy(key).transformWithStateInPandas`` keeps, per key, the pending
entry (its stamp and packed id) in a ``ValueState`` in the RocksDB state
store.  A key's rows of a micro-batch arrive as a series of Arrow batches.
Each is sorted by ``(ts_ns, seq)``, and a vectorised shift finds every row's
predecessor; the first one's is the last event before it.  A batch that
begins after all rows held so far lets those go, so a hot key costs the memory of
an Arrow batch or two, not of its whole micro-batch; batches whose times
overlap are held and sorted together, so their order doesn't matter.

The exits leave the processor with their ``_prev`` fields and then go through
the same projection as the batch operator, so stream and batch give the same
rows as long as each key's events arrive in order across micro-batches (one
kernel clock per host).

With ``max_pending_ns`` an entry is given up when that much time has passed
(:func:`tracelat.operators.pairing.pair` has the same rule): an exit that
comes later is an orphan, and an event-time timer clears the key's state once
the watermark is past the entry's last moment, so keys that never see an exit
leave nothing behind (what the bounded kernel map does by dropping).  Which
exits are orphans follows from the stamps alone, not from when timers fire.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.pairing import finish, prepare
from ..session import ensure_stateful_streaming
from ..sources.traces import write_batch
from ..specs import spec as get_spec

PENDING = T.StructType([T.StructField("ts_ns", T.LongType()), T.StructField("pid_tgid", T.LongType())])
PREV = [T.StructField("_prev_kind", T.StringType()), T.StructField("_prev_ts_ns", T.LongType()), T.StructField("_prev_pid_tgid", T.LongType())]


def in_order(frames) -> Iterator:
    """A key's frames as sorted frames, each after the one before; frames whose times overlap are joined."""
    import pandas as pd

    order = ["ts_ns", "seq"]
    held, last = [], None

    def sorted_held():
        if len(held) == 1:
            return held[0]
        return pd.concat(held, ignore_index=True).sort_values(order, kind="mergesort", ignore_index=True)

    for pdf in frames:
        if pdf.empty:
            continue
        pdf = pdf.sort_values(order, kind="mergesort", ignore_index=True) if len(pdf) > 1 else pdf.reset_index(drop=True)
        first, end = (tuple(pdf[c].iat[i] for c in order) for i in (0, -1))
        if held and first > last:
            yield sorted_held()
            held, last = [], None
        held.append(pdf)
        last = end if last is None else max(last, end)
    if held:
        yield sorted_held()


class PairProcessor(StatefulProcessor):
    def __init__(self, columns, max_pending_ns=None):
        self.columns = list(columns)
        self.max_pending_ns = max_pending_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)

    def handleInputRows(self, key, rows, timerValues=None):
        import numpy as np
        import pandas as pd

        was = prev = self.pending.get()          # None when the key has no pending entry
        for pdf in in_order(rows):
            kind = pdf["kind"].to_numpy(dtype=object)
            ts, pid = pdf["ts_ns"].astype("Int64").array, pdf["pid_tgid"].astype("Int64").array
            at = np.flatnonzero((pdf["kind"] == "exit").to_numpy(dtype=bool, na_value=False))
            before = prev
            # anything but an entry leaves nothing pending
            prev = (int(ts[-1]), None if pd.isna(pid[-1]) else int(pid[-1])) if kind[-1] == "entry" else None
            if len(at):
                out = pdf[self.columns].take(at)
                # masked arrays keep the integers (no float round trip)
                columns = [kind.take(at - 1), ts.take(at - 1), pid.take(at - 1)]
                if at[0] == 0:  # its predecessor came before this frame
                    for column, value in zip(columns, ("entry", *before) if before is not None else (None, None, None)):
                        column[0] = value
                for field, column in zip(PREV, columns):
                    out[field.name] = column
                yield out
        if prev is not None:
            self.pending.update(prev)
            if self.max_pending_ns is not None:
                self.handle.registerTimer((prev[0] + self.max_pending_ns) // 1_000_000 + 1)
        elif was is not None:
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The timer may be that of an earlier entry: a newer one has its own."""
        cur = self.pending.get()
        if cur is not None and (cur[0] + self.max_pending_ns) // 1_000_000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.pending.clear()
        return iter([])

    def close(self) -> None:
        pass


def pair_stream(raw_stream: DataFrame, probe: str, params: dict | None = None,
                effect: str = "reference", max_pending_ns: int | None = None,
                delay: str = "1 minute") -> DataFrame:
    """Streaming twin of :func:`tracelat.operators.pairing.pair`.  ``delay``
    (with ``max_pending_ns``) is the watermark's: how far behind the newest
    event seen so far those of the next micro-batch may be."""
    s = get_spec(probe)
    ensure_stateful_streaming(raw_stream.sparkSession)
    ev, post, _ = prepare(raw_stream, s, params, effect)
    out_schema = T.StructType(list(ev.schema.fields) + PREV)
    proc, mode = PairProcessor(ev.columns, max_pending_ns), "None"
    if max_pending_ns is not None:
        ev, mode = ev.withColumn("_event_time", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("_event_time", delay), "EventTime"
    paired = ev.groupBy(*s.key_cols).transformWithStateInPandas(proc, out_schema, "Append", mode)
    x = paired.withColumn("_prev", F.struct(F.col("_prev_kind").alias("kind"),
                                            F.col("_prev_ts_ns").alias("ts_ns"),
                                            F.col("_prev_pid_tgid").alias("pid_tgid")))
    return finish(x, s, post, max_pending_ns=max_pending_ns)


def start_pair_stream(raw_stream: DataFrame, probe: str, root: str, checkpoint: str, run_id: str,
                      available_now: bool = False, trigger_seconds: float | None = None, **kw) -> StreamingQuery:
    """Run :func:`pair_stream` into the probe's table: one folder a
    micro-batch, which a re-run of the micro-batch replaces."""
    def on_batch(rows, batch_id):
        write_batch(rows, root, probe, run_id, f"{batch_id:09d}")

    w = (pair_stream(raw_stream, probe, **kw).writeStream.foreachBatch(on_batch).outputMode("append")
         .option("checkpointLocation", checkpoint).queryName(f"keyed_{probe}_{run_id.replace('-', '_')}"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
