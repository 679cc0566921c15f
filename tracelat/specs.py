"""Registry of the twelve trace tables.

Each :class:`TraceSpec` states the fixed output schema of one probe table
(column order is the table's definition order), which column carries the
latency and which the stamp, how entries and exits are keyed, where the
process id comes from, what happens to an exit without a pending entry, and
which run-time filters the probe understands and where it checks them.
Every operator in the library is generic over these specs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

U32 = T.LongType()          # unsigned 32-bit fits a signed 64-bit long
U64 = T.LongType()          # ns counts fit a signed long for 292 years
U64_FULL = T.DecimalType(20, 0)   # full-range unsigned 64-bit (size, offset)
S64 = T.LongType()
S32 = T.IntegerType()
STR = T.StringType()


@dataclass(frozen=True)
class TraceSpec:
    probe: str
    columns: tuple            # ((name, DataType), ...) in table order
    latency_col: str
    ts_col: str
    ts_is_end: bool           # stamp is the exit time (else the entry time)
    key_cols: tuple           # pairing key in the raw event stream
    pid_mode: str | None      # stored pid column: 'process' (pid_tgid >> 32), 'packed', or None
    pid_from: str = "exit"    # which event the pid column is taken from
    orphan: str = "drop"      # 'zero' keeps orphan exits with latency 0
    comm_len: int = 32        # comm buffer size in bytes
    file_len: int = 16        # file buffer size in bytes
    # filter name -> where it is checked: 'entry', 'both', 'exit_post'
    filters: dict = field(default_factory=dict)
    file_match: str | None = None   # 'wildcard' | 'exact'
    xid_swap: bool = False    # byte-swap the raw xid to host order
    pid_filter: str = "process"   # what filter_pid is compared with: 'process' or 'packed'

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, True) for n, t in self.columns])

    @property
    def names(self) -> list:
        return [n for n, _ in self.columns]

    def ddl(self) -> str:
        return ", ".join(f"`{n}` {t.simpleString()}" for n, t in self.columns)


_RW = (("pid", U32), ("lat", U64), ("time_stamp", U64), ("size", U64_FULL),
       ("comm", STR), ("file", STR))
_NFSD_RW = (("pid", U64), ("lat", U64), ("time_stamp", U64), ("size", U64_FULL),
            ("offset", U64_FULL), ("xid", U32), ("comm", STR))
_NFSD_META = (("pid", U64), ("lat", U64), ("time_stamp", U64), ("xid", U32), ("comm", STR))

_RW_FILTERS = {"filter_pid": "entry", "filter_comm": "entry", "filter_file": "exit_post"}


def _rw(name):
    return TraceSpec(name, _RW, "lat", "time_stamp", True, ("pid_tgid",), "process",
                     orphan="zero", comm_len=32, filters=_RW_FILTERS, file_match="wildcard")


def _nfsd(name, cols):
    return TraceSpec(name, cols, "lat", "time_stamp", True, ("pid_tgid",), "packed",
                     orphan="zero", comm_len=32, filters={"filter_pid": "entry"}, pid_filter="packed")


SPECS: dict[str, TraceSpec] = {s.probe: s for s in [
    _rw("nfs_file_read"),
    _rw("nfs_file_write"),
    TraceSpec("nfs_getattr",
              (("pid", U64), ("lat", U64), ("time_stamp", U64), ("ret", S64),
               ("comm", STR), ("file", STR)),
              "lat", "time_stamp", True, ("pid_tgid",), "process", orphan="drop",
              filters={"filter_pid": "entry", "filter_file": "exit_post"}, file_match="exact"),
    TraceSpec("nfs_setattr",
              (("pid", U64), ("lat", U64), ("time_stamp", U64), ("ret", S64), ("comm", STR)),
              "lat", "time_stamp", True, ("pid_tgid",), "process", orphan="drop",
              filters={"filter_pid": "entry"}),
    _nfsd("nfsd4_read", _NFSD_RW),
    _nfsd("nfsd4_write", _NFSD_RW),
    _nfsd("nfsd4_access", _NFSD_META),
    _nfsd("nfsd4_getattr", _NFSD_META),
    TraceSpec("rpc_task_latency",
              (("pid", U32), ("xid", U32), ("proc_name", STR), ("latency", U64),
               ("start_timestamp", U64), ("status", S32)),
              "latency", "start_timestamp", False, ("obj",), "process", pid_from="entry",
              orphan="drop", comm_len=32,
              filters={"filter_pid": "entry", "filter_comm": "entry"}, xid_swap=True),
    TraceSpec("svc_rqst_latency",
              (("xid", U32), ("latency", U64), ("start_timestamp", U64)),
              "latency", "start_timestamp", False, ("obj",), None, orphan="drop",
              filters={}, xid_swap=True),
    TraceSpec("sys_call_trace",
              (("pid", U64), ("syscall_id", U32), ("ret", S64), ("duration", U64),
               ("enter_time_stamp", U64), ("comm", STR)),
              "duration", "enter_time_stamp", False, ("pid_tgid",), "packed",
              orphan="zero", comm_len=16,
              filters={"filter_pid": "both", "filter_syscall_id": "both", "filter_comm": "both"}),
    TraceSpec("block_io_latency",
              (("pid", U64), ("latency", U64), ("time_stamp", U64), ("comm", STR)),
              "latency", "time_stamp", True, ("dev", "sector"), "process", orphan="drop",
              comm_len=16, filters={"filter_pid": "entry", "filter_comm": "entry"}),
]}

PROBES = sorted(SPECS)


def spec(probe: str) -> TraceSpec:
    try:
        return SPECS[probe]
    except KeyError:
        raise KeyError(f"unknown probe {probe!r}; known: {', '.join(PROBES)}") from None


# Raw entry/exit event contract read by the pairing operators.  Not every
# probe uses every attribute; unused ones may be null or absent.
RAW_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),         # arrival order, tie-break for equal stamps
    T.StructField("ts_ns", T.LongType()),       # event time, ns
    T.StructField("kind", T.StringType()),      # 'entry' | 'exit'
    T.StructField("pid_tgid", T.LongType()),    # (tgid << 32) | tid
    T.StructField("comm", T.StringType()),
    T.StructField("obj", T.LongType()),         # kernel object id (rpc task, svc request)
    T.StructField("dev", T.LongType()),
    T.StructField("sector", T.LongType()),
    T.StructField("syscall_id", T.LongType()),
    T.StructField("ret", T.LongType()),         # return value / status
    T.StructField("size", T.LongType()),        # requested length (nfsd)
    T.StructField("offset", T.LongType()),
    T.StructField("xid", T.LongType()),         # as read from the kernel (network order)
    T.StructField("file", T.StringType()),
    T.StructField("proc_name", T.StringType()),
])
