"""Run-time filter predicates (process, task name, system call, file).

A parameter that is absent, ``0`` or empty is *off*; present parameters are
ANDed.  Values may be Python literals (a fixed setting) or Columns (a
setting that varies per row, e.g. joined as-of from a config log); the
Column form treats null, 0 and '' as off row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import byte_cap, cstr, pid_of, to_u32
from ..functions.wildcard import wildcard_match
from ..specs import TraceSpec, spec as get_spec

PARAM_NAMES = ("filter_pid", "filter_file", "filter_syscall_id", "filter_comm")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _off_literal(v) -> bool:
    return v is None or v == 0 or v == ""


def and_all(preds) -> Column | None:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def pid_predicate(s: TraceSpec, pid_tgid, value, mode: str | None = None) -> Column | None:
    """``filter_pid``: process id for most probes, the packed id for nfsd
    probes (``mode='process'`` forces the evident intent there)."""
    mode = mode or s.pid_filter
    target = pid_of(_col(pid_tgid)) if mode == "process" else _col(pid_tgid)
    if isinstance(value, Column):
        return value.isNull() | (value == 0) | (target == value)
    if _off_literal(value):
        return None
    return target == F.lit(int(value))


def comm_predicate(s: TraceSpec, comm, value) -> Column | None:
    """``filter_comm``: exact task name, the setting cut to the probe's buffer."""
    comm = cstr(_col(comm), s.comm_len, kernel_name=True)
    if isinstance(value, Column):
        return value.isNull() | (value == "") | (comm == byte_cap(value, s.comm_len))
    if _off_literal(value):
        return None
    return comm == byte_cap(F.lit(value), s.comm_len)


def syscall_predicate(s: TraceSpec, syscall_id, value) -> Column | None:
    """``filter_syscall_id``: id 0 means off, so call 0 cannot be selected."""
    if isinstance(value, Column):
        v = to_u32(value)
        return value.isNull() | (v == 0) | (to_u32(_col(syscall_id)) == v)
    if _off_literal(value) or (int(value) & 0xFFFFFFFF) == 0:
        return None
    return to_u32(_col(syscall_id)) == F.lit(int(value) & 0xFFFFFFFF)


def file_predicate(s: TraceSpec, file, value) -> Column | None:
    """``filter_file``: wildcard rule (read/write) or exact name (getattr)."""
    name = cstr(_col(file), s.file_len)
    if isinstance(value, Column):
        if s.file_match == "wildcard":
            m = wildcard_match(name, value)
        else:
            m = name == byte_cap(value, s.file_len)
        return value.isNull() | (value == "") | m
    if _off_literal(value):
        return None
    if s.file_match == "wildcard":
        return wildcard_match(name, value)
    return name == byte_cap(F.lit(value), s.file_len)


def pushable_hint(s: TraceSpec, name: str, value) -> Column | None:
    """A plain column predicate *implied* by a literal setting, added next to
    the exact one so the Parquet scan can skip row groups (the exact
    predicate cuts C strings and shifts bits, which no source can push)."""
    if isinstance(value, Column) or _off_literal(value):
        return None
    if name == "filter_pid":
        p = int(value)
        if s.pid_filter == "process":
            if not 0 <= p <= 0xFFFFFFFF:      # no process id can equal it
                return F.lit(False)
            return F.col("pid_tgid").between(F.lit(p << 32), F.lit((p << 32) | 0xFFFFFFFF))
        return F.col("pid_tgid") == F.lit(p)
    if name == "filter_comm":
        return F.col("comm").startswith(value.encode("utf-8")[:s.comm_len].decode("utf-8", "ignore"))
    return None


def param_predicate(s: TraceSpec, name: str, value, row) -> Column | None:
    """Predicate of one parameter over raw-event columns ``row(attr)``."""
    if name == "filter_pid":
        return pid_predicate(s, row("pid_tgid"), value)
    if name == "filter_comm":
        return comm_predicate(s, row("comm"), value)
    if name == "filter_syscall_id":
        return syscall_predicate(s, row("syscall_id"), value)
    if name == "filter_file":
        return file_predicate(s, row("file"), value)
    raise ValueError(f"unknown parameter {name}")


def filter_table(df: DataFrame, probe: str, params: dict) -> DataFrame:
    """Apply settings to a finished trace table (its own column names).

    The table's ``pid`` column is already a process id for 'process'
    probes and the packed id for the others, so it is compared as stored.
    """
    s = get_spec(probe)
    preds = []
    for name, value in params.items():
        if name not in s.filters:
            continue
        if name == "filter_pid":
            if not _off_literal(value):
                preds.append(F.col("pid") == F.lit(int(value)))
        elif name == "filter_comm":
            preds.append(comm_predicate(s, "comm", value))
            if not _off_literal(value) and not isinstance(value, Column):
                # implied by the exact rule and pushable to the scan
                preds.append(F.col("comm").startswith(
                    value.encode("utf-8")[:s.comm_len].decode("utf-8", "ignore")))
        elif name == "filter_syscall_id":
            preds.append(syscall_predicate(s, "syscall_id", value))
        elif name == "filter_file":
            preds.append(file_predicate(s, "file", value))
    p = and_all(preds)
    return df if p is None else df.where(p)
