"""Entry/exit pairing: raw events -> one latency row per completed call.

Semantics shared by all twelve probes: an entry stores a pending start for
its key and overwrites an earlier one; an exit consumes the pending start of
its key.  Hence an exit pairs with its key's *immediately preceding event*
iff that event is an entry, which a single ``lag`` over
``partitionBy(key).orderBy(ts_ns, seq)`` expresses: one shuffle by key, a
sort inside each partition, no self-join and no UDF.

Filter placement follows where each probe checks a setting:

* ``entry``: the entry is dropped *before* the window (it neither stores nor
  overwrites a start).  For 'zero' probes its exit then shows latency 0.
* ``both``: entries and exits are dropped before the window (a filtered exit
  leaves the start pending).
* ``exit_post``: evaluated on the paired row; a mismatch discards the row
  but the start is consumed.

``effect='strict'`` additionally discards exits whose own attributes fail an
entry filter, so a non-matching call never leaves a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import as_u64, cstr, ntohl, pid_of, to_u32
from ..specs import TraceSpec, spec as get_spec
from . import carry
from .carry import carry_even, carry_last, chunk_of
from .filters import and_all, param_predicate, pushable_hint

MASK32 = 0xFFFFFFFF


def _output_exprs(s: TraceSpec, matched: Column, prev) -> dict[str, Column]:
    ts = F.col("ts_ns")
    lat = F.when(matched, ts - prev["ts_ns"]).otherwise(F.lit(0).cast("long"))
    start = F.when(matched, prev["ts_ns"]).otherwise(F.lit(0).cast("long"))
    if s.pid_mode == "packed":
        pid = F.col("pid_tgid")
    elif s.pid_from == "entry":
        pid = pid_of(prev["pid_tgid"])
    else:
        pid = pid_of(F.col("pid_tgid"))
    if s.xid_swap:
        xid = ntohl(F.coalesce(F.col("xid"), F.lit(0)))
    else:
        xid = F.coalesce(F.col("xid"), F.lit(0)).bitwiseAND(F.lit(MASK32))
    size = (as_u64(F.col("ret")) if s.probe.startswith("nfs_file")
            else F.coalesce(F.col("size"), F.lit(0)).bitwiseAND(F.lit(MASK32)).cast("decimal(20,0)"))
    e = {
        "pid": pid,
        s.latency_col: lat,
        "time_stamp": ts,
        "start_timestamp": start,
        "enter_time_stamp": start,
        "size": size,
        "offset": as_u64(F.coalesce(F.col("offset"), F.lit(0))),
        "xid": xid,
        "comm": cstr(F.col("comm"), s.comm_len, kernel_name=True),
        "file": F.coalesce(cstr(F.col("file"), s.file_len), F.lit("")),
        "ret": F.col("ret"),
        "status": F.col("ret").cast("int"),
        "syscall_id": to_u32(F.col("syscall_id")),
        "proc_name": F.coalesce(cstr(F.col("proc_name"), 16), F.lit("")),
    }
    return {n: e[n].cast(t).alias(n) for n, t in s.columns}


def _raw_needs(s: TraceSpec) -> list[str]:
    need = {"seq", "ts_ns", "kind", "pid_tgid", *s.key_cols}
    col_attr = {"comm": "comm", "file": "file", "ret": "ret", "status": "ret",
                "syscall_id": "syscall_id", "xid": "xid", "offset": "offset",
                "proc_name": "proc_name"}
    for n in s.names:
        if n in col_attr:
            need.add(col_attr[n])
    if "size" in s.names:
        need.add("ret" if s.probe.startswith("nfs_file") else "size")
    for f in s.filters:
        need.add({"filter_pid": "pid_tgid", "filter_comm": "comm",
                  "filter_file": "file", "filter_syscall_id": "syscall_id"}[f])
    return sorted(need)


def prepare(raw: DataFrame, s: TraceSpec, params: dict | None = None,
            effect: str = "reference", extra_cols: tuple = ()):
    """Project the needed raw columns and apply the pre-pairing filters.

    Returns ``(events, post_predicate, prev_fields)``; shared by the batch
    and the streaming pairing so both apply identical rules."""
    if effect not in ("reference", "strict"):
        raise ValueError("effect must be 'reference' or 'strict'")
    params = params or {}
    present = set(raw.columns)
    cols = [c for c in _raw_needs(s) if c in present] + [c for c in extra_cols if c in present]
    ev = raw.select(*dict.fromkeys(cols + [c for c in raw.columns if c.startswith("_p_")]))
    for c in _raw_needs(s):
        if c not in present:
            ev = ev.withColumn(c, F.lit(None).cast("string" if c in ("comm", "file", "proc_name") else "long"))

    entry_p, both_p, post_p, strict_p, entry_h, both_h = [], [], [], [], [], []
    for name, where in s.filters.items():
        if name not in params:
            continue
        p = param_predicate(s, name, params[name], F.col)
        if p is None:
            continue
        {"entry": entry_p, "both": both_p, "exit_post": post_p}[where].append(p)
        h = pushable_hint(s, name, params[name])
        if h is not None and where in ("entry", "both"):
            (entry_h if where == "entry" else both_h).append(h)
        if where == "entry" and s.orphan == "zero":
            strict_p.append(p)
    # exact rules, written as plain AND/OR so that the implied hints reach the scan
    not_entry = F.col("kind") != "entry"
    keep = and_all(both_p + both_h
                   + ([not_entry | and_all(entry_p)] if entry_p else [])
                   + ([not_entry | and_all(entry_h)] if entry_h else []))
    if keep is not None:
        ev = ev.where(keep)
    post = and_all(post_p + (strict_p if effect == "strict" else []))
    prev_fields = ["kind", "ts_ns"] + (["pid_tgid"] if s.pid_from == "entry" else [])
    return ev, post, prev_fields


def finish(x: DataFrame, s: TraceSpec, post, extra_cols: tuple = (), max_pending_ns: int | None = None) -> DataFrame:
    """Exit rows with their ``_prev`` event struct -> the probe's table."""
    prev = F.col("_prev")
    matched = F.coalesce(prev["kind"] == "entry", F.lit(False))
    if max_pending_ns is not None:
        matched = matched & (F.col("ts_ns") - prev["ts_ns"] <= max_pending_ns)
    if s.orphan == "drop":
        x = x.where(matched)
    if post is not None:
        x = x.where(post)
    out = _output_exprs(s, matched, prev)
    return x.select(*out.values(), *[F.col(c) for c in extra_cols if c in x.columns])


def pair(raw: DataFrame, probe: str | TraceSpec, params: dict | None = None,
         effect: str = "reference", extra_cols: tuple = (),
         chunk_ns: int | str | None = "auto", max_pending_ns: int | None = None,
         rows_per_chunk: int | None = None, total: int | None = None) -> DataFrame:
    """Pair raw entry/exit events of one probe into its trace table.

    ``raw`` follows :data:`tracelat.specs.RAW_SCHEMA` (unused attributes may
    be missing).  ``params`` maps parameter names to literals or Columns over
    ``raw`` (as-of settings).  ``extra_cols`` are raw columns carried from
    the exit row (e.g. ``seq`` for tests and joins).

    With ``chunk_ns='auto'`` (default) keys with more than
    ``rows_per_chunk`` events are cut into chunks of equal count that pair in
    parallel (:func:`tracelat.operators.carry.carry_even`), so a single hot
    thread or device isn't one task; without such a key it is one window.  A
    number makes chunks ``ts_ns div chunk_ns`` of every key
    (:func:`tracelat.operators.carry.carry_last`); ``None`` forces the single
    window.  All give the same rows.  ``total`` is the number of rows in
    ``raw``, or a larger one, if it is known; else they are counted.

    An entry pending for more than ``max_pending_ns`` is given up: its exit
    is an orphan.
    """
    s = get_spec(probe) if isinstance(probe, str) else probe
    if raw.isStreaming:
        raise TypeError("pair() is the batch operator; for a stream use "
                        "tracelat.streaming.pair_stream.pair_stream or streaming.ingest.start_ingest")
    ev, post, prev_fields = prepare(raw, s, params, effect, extra_cols)
    prev_struct = F.struct(*[F.col(c) for c in prev_fields])
    is_exit = F.col("kind") == "exit"
    if chunk_ns == "auto":
        x = carry_even(ev, s.key_cols, ["ts_ns", "seq"], {"_prev": prev_struct}, rows_per_chunk or carry.AUTO_CHUNK_ROWS, keep=is_exit, total=total)
    elif chunk_ns:
        x = carry_last(ev, s.key_cols, ["ts_ns", "seq"], {"_prev": prev_struct},
                       chunk=chunk_of("ts_ns", chunk_ns), keep=is_exit)
    else:
        w = Window.partitionBy(*s.key_cols).orderBy("ts_ns", "seq")
        x = ev.withColumn("_prev", F.lag(prev_struct).over(w)).where(is_exit)
    return finish(x, s, post, extra_cols, max_pending_ns)

