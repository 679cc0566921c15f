"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each one runs a library operator over whole adapter tables built from the
generated data (see :mod:`tracelat.sources.fixtures`); the DuckDB twin of
every SQL-expressible query is in :mod:`tracelat.plans.sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_u64, ntohl, outcome, pid_of, tid_of
from ..operators import control as ctl
from ..operators import stats
from ..operators.asof import apply_config_asof, asof_join
from ..operators.catalog import all_probe_names, catalog_integrity, catalog_status, dedupe_catalog, missing_implementation, status_precedence
from ..operators.filters import filter_table
from ..operators.pairing import pair
from ..session import configure
from ..sources import fixtures as fx
from ..specs import PROBES

CALL_TIES = ["time_stamp", "pid", "size", "comm", "file"]
CHUNK_NS = 6 * 3600 * 10**9     # 6 h chunks: the fixture spans 30 days


def _calls(spark, d):
    configure(spark)
    return fx.calls(spark, d)


def _raw(spark, d):
    configure(spark)
    return fx.raw_calls(spark, d)


def _ctl(spark, d):
    configure(spark)
    return fx.control_log(spark, d)


def _implemented(spark) -> DataFrame:
    return ctl.names_frame(spark, PROBES, "name")


def _catalog_frame(spark) -> DataFrame:
    from ..sources.catalog_yaml import scan_catalog
    return scan_catalog(spark)


def q_trigger_vs_written(spark, d):
    raw = _raw(spark, d)
    hits = (raw.select(F.lit("nfs_file_read").alias("probe"))
            .unionByName(raw.select(F.lit("nfs_getattr").alias("probe"))))
    written = (pair(raw, "nfs_file_read").select(F.lit("nfs_file_read").alias("probe"))
               .unionByName(pair(raw, "nfs_getattr").select(F.lit("nfs_getattr").alias("probe"))))
    return stats.trigger_vs_written(hits, written)


def q_config_asof(spark, d):
    raw = _raw(spark, d)
    cfg = fx.config_log(spark, d)
    ev = raw.where(F.col("event_type") != "signup")
    return asof_join(ev, cfg, ["filter_pid"]).select("seq", "ts_ns", "kind",
                                                     F.col("_p_filter_pid").alias("filter_pid"))


def q_config_asof_partial(spark, d, **kw):
    ev = _raw(spark, d).where(F.col("event_type") != "signup")
    rows = asof_join(ev, fx.partial_config_log(spark, d), ["filter_pid", "filter_comm"], **kw)
    return rows.select("seq", "ts_ns", F.col("_p_filter_pid").alias("filter_pid"), F.col("_p_filter_comm").alias("filter_comm"))


def q_pair_rw_asof(spark, d, **kw):
    raw = _raw(spark, d)
    cfg = fx.config_log(spark, d)
    ev = raw.where(F.col("event_type") != "signup")
    return apply_config_asof(ev, cfg, "nfs_file_read", ["filter_pid"], **kw)


def _sizes(spark, d) -> DataFrame:
    """Reads with their unsigned 64-bit sizes; failed ones (wrapped negative codes) aside."""
    return pair(_raw(spark, d), "nfs_file_read").where(F.col("size") < 9 * 10**18)


def _sevenths(spark, d) -> DataFrame:
    """A double that no quantile of it is a tie in its third decimal."""
    configure(spark)
    return fx.table(spark, d, "events").select("event_type", (F.col("value") / 7).alias("value"))


def q_approx_error(spark, d):
    """AGG-5: the exact quantiles, and whether the sketch's are as close as it promises."""
    exact = stats.latency_summary_by(_calls(spark, d), "lat", "comm", method="exact").select("comm", *stats.QNAMES)
    approx = stats.latency_summary_by(_calls(spark, d), "lat", "comm", method="approx")
    near = [F.abs(F.col(f"a.{n}") - F.col(f"e.{n}")) <= F.col(f"e.{n}") / 256 + 0.001 for n in stats.QNAMES]
    within = near[0] & near[1] & near[2] & near[3]
    return (exact.alias("e").join(approx.alias("a"), F.col("a.comm").eqNullSafe(F.col("e.comm")), "left")
            .select("e.comm", F.coalesce(within, F.lit(False)).alias("within"), *[F.col(f"e.{n}") for n in stats.QNAMES]))


def q_error_chain_codes(spark, d):
    """CTL-3 over rows: the code each wrapped error is answered with."""
    configure(spark)
    return ctl.map_error(fx.error_chains(spark, d)).select("seq", "code")


def q_status_live_over_remembered(spark, d):
    """JOIN-3: what a third of the commands left behind, and the probes that all commands left attached."""
    log = _ctl(spark, d)
    live = ctl.latest_status(ctl.replay_control(log)).where("loaded")
    return status_precedence(ctl.latest_status(ctl.replay_control(log.where(F.col("seq") % 3 == 0))), live)


def q_catalog_gaps(spark, d):
    """CAT-4 over rows: what each entry lacks."""
    configure(spark)
    found = catalog_integrity(fx.described_with_gaps(spark, d))
    return found.select("type", F.array_join("issues", ",").alias("issues"), "ok")


def q_sample_rows_members(spark, d):
    """LIM-1: how many rows a sample has, and how many of them are rows of the table."""
    rows = pair(_raw(spark, d), "sys_call_trace")
    some = stats.sample_rows(rows, 5)
    packed = F.struct(*[F.col(c) for c in rows.columns])
    member = some.select(packed.alias("r")).join(rows.select(packed.alias("t")).distinct(), F.col("r").eqNullSafe(F.col("t")), "left")
    return member.agg(F.count("r").alias("sampled"), F.count("t").alias("members"))


def q_replay(spark, d, **kw):
    return ctl.replay_control(_ctl(spark, d), **kw)


def q_catalog_status(spark, d):
    status = ctl.latest_status(q_replay(spark, d))
    return catalog_status(_catalog_frame(spark), status)


def q_decode(spark, d, probe):
    from ..sources.decode import decode_samples, encode_rows
    rows = pair(_raw(spark, d), probe)
    return decode_samples(encode_rows(rows, probe), probe)


def q_param_updates(spark, d):
    configure(spark)
    return ctl.param_updates(fx.param_log(spark, d), "nfs_file_read").select(
        "seq", "filter_pid", "filter_file", "filter_comm", "error", "error_detail")


def q_param_history(spark, d):
    configure(spark)
    ups = ctl.param_updates(fx.param_log(spark, d), "nfs_file_read")
    return ctl.param_history(ups, ["probe"], "seq", ["filter_pid", "filter_file", "filter_comm"],
                             chunk_rows="auto", rows_per_chunk=1 << 16).select("seq", "filter_pid", "filter_file", "filter_comm")


def q_status_report(spark, d):
    from ..functions.scalars import json_report
    st = ctl.latest_status(q_replay(spark, d))
    return st.select("probe", json_report("state", "loaded", "last_error").alias("report"))


def queries() -> dict:
    q = {
        "latency_summary": lambda s, d: stats.latency_summary(_calls(s, d), "lat"),
        "latency_summary_radix": lambda s, d: stats.latency_summary(_calls(s, d), "lat", method="exact"),
        # ns durations summarised in ms (see block_io_summary_ms_by_comm)
        "syscall_duration_ms_summary": lambda s, d: stats.latency_summary(
            pair(_raw(s, d), "sys_call_trace").withColumn("duration_ms", F.expr("duration div 1000000")),
            "duration_ms"),
        # ns latencies summarised in ms: at ~1e14 ns the engines' interpolations differ in the last ulp
        "block_io_summary_ms_by_comm": lambda s, d: stats.latency_summary_by(
            pair(_raw(s, d), "block_io_latency").withColumn("latency_ms", F.expr("latency div 1000000")),
            "latency_ms", "comm", method="exact"),
        "error_chain_codes": q_error_chain_codes,
        "status_live_over_remembered": q_status_live_over_remembered,
        "described_once": lambda s, d: dedupe_catalog(fx.described(s, d)),
        "catalog_gaps": q_catalog_gaps,
        # decimals (an unsigned 64-bit size) and doubles, by keys in the same order
        "size_summary": lambda s, d: stats.latency_summary(_sizes(s, d), "size"),
        "size_summary_radix": lambda s, d: stats.latency_summary(_sizes(s, d), "size", method="exact"),
        "size_summary_by_comm_radix": lambda s, d: stats.latency_summary_by(_sizes(s, d), "size", "comm", method="exact"),
        "value_summary": lambda s, d: stats.latency_summary(_sevenths(s, d), "value"),
        "value_summary_radix": lambda s, d: stats.latency_summary(_sevenths(s, d), "value", method="exact"),
        "value_summary_by_type_radix": lambda s, d: stats.latency_summary_by(_sevenths(s, d), "value", "event_type", method="exact"),
        "latency_summary_approx": lambda s, d: stats.latency_summary(_calls(s, d), "lat", method="approx"),
        "latency_summary_by_comm": lambda s, d: stats.latency_summary_by(_calls(s, d), "lat", "comm"),
        # the hot-group-safe path, forced (every group goes through radix selection)
        "latency_summary_by_comm_radix": lambda s, d: stats.latency_summary_by(_calls(s, d), "lat", "comm",
                                                                               method="exact"),
        "latency_summary_by_comm_approx": lambda s, d: stats.latency_summary_by(_calls(s, d), "lat", "comm", method="approx"),
        "approx_error": q_approx_error,
        # one group with half of all rows beside as many groups as orders
        "latency_summary_hot_and_many": lambda s, d: stats.latency_summary_by(
            _calls(s, d).withColumn("grp", F.when(F.col("pid") % 2 == 0, 0).otherwise(F.expr("time_stamp div 8 + 1"))), "lat", "grp", method="exact"),
        "p99_row": lambda s, d: stats.p99_row(_calls(s, d), "lat", 0.99, CALL_TIES),
        "top_keys": lambda s, d: stats.top_keys(_calls(s, d), "pid", 10),
        "latest_rows": lambda s, d: stats.latest(_calls(s, d), 5, "time_stamp", ("comm", "pid")),
        "count_where": lambda s, d: stats.count_where(
            _calls(s, d), comm_rows=F.col("comm") == "NO", pid_rows=F.col("pid") == 42,
            other_pid_rows=F.col("pid") != 42),
        "filter_comm": lambda s, d: filter_table(_calls(s, d), "nfs_file_read", {"filter_comm": "RF"}),
        "filter_file_suffix": lambda s, d: filter_table(_calls(s, d), "nfs_file_read", {"filter_file": "*anvil"}),
        "filter_file_qmark": lambda s, d: filter_table(_calls(s, d), "nfs_file_read", {"filter_file": "blue b???"}),
        "filter_delta": lambda s, d: stats.filter_delta(_calls(s, d), 240000, "time_stamp", "comm"),
        "filter_leak": lambda s, d: stats.filter_leak(_calls(s, d), 42),
        "pid_of_tid_of": lambda s, d: _raw(s, d).select("seq", pid_of("pid_tgid").alias("pid"),
                                                         tid_of("pid_tgid").alias("tid")),
        "xid_swap": lambda s, d: _raw(s, d).select("seq", "xid", ntohl("xid").alias("xid_host")),
        "size_as_u64": lambda s, d: _raw(s, d).select("seq", "ret", as_u64("ret").alias("size")),
        "pair_rw": lambda s, d: pair(_raw(s, d), "nfs_file_read"),
        "pair_attr": lambda s, d: pair(_raw(s, d), "nfs_getattr"),
        "pair_setattr": lambda s, d: pair(_raw(s, d), "nfs_setattr"),
        "pair_nfsd": lambda s, d: pair(_raw(s, d), "nfsd4_read"),
        "pair_nfsd_meta": lambda s, d: pair(_raw(s, d), "nfsd4_access"),
        "pair_syscall": lambda s, d: pair(_raw(s, d), "sys_call_trace"),
        "pair_block_io": lambda s, d: pair(_raw(s, d), "block_io_latency"),
        "pair_rpc": lambda s, d: pair(_raw(s, d), "rpc_task_latency"),
        "pair_svc": lambda s, d: pair(_raw(s, d), "svc_rqst_latency"),
        "pair_rw_filtered_reference": lambda s, d: pair(
            _raw(s, d), "nfs_file_read", {"filter_comm": "proc3", "filter_file": "*.log"}),
        "pair_rw_filtered_strict": lambda s, d: pair(
            _raw(s, d), "nfs_file_read", {"filter_comm": "proc3", "filter_file": "*.log"}, effect="strict"),
        "pair_getattr_filtered": lambda s, d: pair(
            _raw(s, d).withColumn("_p_filter_pid",
                                  F.when(pid_of("pid_tgid") % 3 == 1, pid_of("pid_tgid")).otherwise(-1)),
            "nfs_getattr", {"filter_pid": F.col("_p_filter_pid"), "filter_file": "f4.log"}),
        "pair_syscall_filtered": lambda s, d: pair(
            _raw(s, d), "sys_call_trace", {"filter_syscall_id": 2, "filter_comm": "proc2"}),
        "pair_syscall_pid_filter": lambda s, d: pair(_raw(s, d), "sys_call_trace", {"filter_pid": 8}),
        "pair_nfsd_pid_filter": lambda s, d: pair(_raw(s, d), "nfsd4_write", {"filter_pid": (2 << 32) | 8}),
        "filter_leak_syscall": lambda s, d: stats.filter_leak(pair(_raw(s, d), "sys_call_trace"), 8,
                                                              packed=True),
        "row_validity": lambda s, d: stats.row_validity(pair(_raw(s, d), "sys_call_trace")),
        "top_syscalls": lambda s, d: stats.top_keys(pair(_raw(s, d), "sys_call_trace"), "syscall_id", 10),
        "trigger_vs_written": q_trigger_vs_written,
        "outcome_counts": lambda s, d: pair(_raw(s, d), "sys_call_trace")
            .groupBy(outcome("ret").alias("outcome")).agg(F.count(F.lit(1)).alias("cnt")),
        "sample_rows": lambda s, d: stats.sample_rows(pair(_raw(s, d), "sys_call_trace"), 5),
        "sample_rows_members": q_sample_rows_members,
        "param_updates": q_param_updates,
        "param_history": q_param_history,
        "status_report": q_status_report,
        "command_validity": lambda s, d: ctl.command_validity(fx.tool_calls(s, d)).select("seq", "tool", "error"),
        "config_asof": q_config_asof,
        "config_asof_partial": q_config_asof_partial,
        "config_asof_partial_large": lambda s, d: q_config_asof_partial(s, d, max_broadcast_rows=0),
        "pair_rw_asof": q_pair_rw_asof,
        "replay_control": q_replay,
        "latest_status": lambda s, d: ctl.latest_status(q_replay(s, d)),
        "catalog_status": q_catalog_status,
        "error_level": lambda s, d: ctl.error_level(q_replay(s, d)).select("seq", "code", "level"),
        "dry_run_answers": lambda s, d: ctl.dry_run_answers(_ctl(s, d)),
        "missing_implementation": lambda s, d: missing_implementation(
            _ctl(s, d).select(F.col("probe").alias("type")).distinct(), _implemented(s)),
        "all_probe_names": lambda s, d: all_probe_names(_ctl(s, d).select(F.col("probe").alias("name")),
                                                        _implemented(s)),
        "decode_samples": lambda s, d: q_decode(s, d, "nfs_file_read"),
        "decode_samples_syscall": lambda s, d: q_decode(s, d, "sys_call_trace"),
        # Skew-safe variants: same answers through the chunked two-level scans.
        "pair_rw_single_window": lambda s, d: pair(_raw(s, d), "nfs_file_read", chunk_ns=None),
        "pair_rw_chunked": lambda s, d: pair(_raw(s, d), "nfs_file_read", rows_per_chunk=32),
        "pair_rw_chunked_by_time": lambda s, d: pair(_raw(s, d), "nfs_file_read", chunk_ns=CHUNK_NS),
        "pair_block_io_chunked": lambda s, d: pair(_raw(s, d), "block_io_latency", rows_per_chunk=32),
        "replay_control_chunked": lambda s, d: q_replay(s, d, rows_per_chunk=512),
        "pair_rw_asof_large_config": lambda s, d: q_pair_rw_asof(s, d, max_broadcast_rows=0),
    }
    return q
