"""Registered queries that exercise streams and sinks end to end.

Each one runs over the whole ``events`` table, writes into a fresh folder
under the session's shared checkpoint directory and returns the written
table read back as a batch DataFrame.  Stream = batch is the correctness
claim, so their oracle is the batch pairing SQL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, configure
from ..sources import fixtures as fx
from ..sources.traces import append_trace, compact_run, scan_trace, stream_trace
from .ingest import ingest_progress, start_ingest, stop_ingest


def _workdir(spark: SparkSession, tag: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex[:12]}")


RUN = "20260101-000000"
SLICES = 4
PENDING_NS = 6 * 3600 * 10**9


def _ingest_slices(spark: SparkSession, sf_dir: str, probe: str, root: str, ck: str, run_id: str, src: str) -> None:
    """The events arrive in ``SLICES`` slices of time; after each one the run's
    query starts again from its checkpoint, reads it as one micro-batch and
    stops.  Pending entries go from each slice to the next."""
    events = fx.table(spark, sf_dir, "events")
    lo, hi = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(lo)) * SLICES / F.lit((hi or 0) - (lo or 0) + 1))
    for i in range(SLICES):
        events.where(part == i).write.mode("append").parquet(src)
        raw = fx.raw_calls_from(stream_trace(spark, src, events.schema))
        stop_ingest(start_ingest(raw, probe, root, ck, run_id, available_now=True))


def q_pair_stream(spark: SparkSession, sf_dir: str):
    configure(spark)
    wd = _workdir(spark, "pair_stream")
    root = os.path.join(wd, "tables")
    _ingest_slices(spark, sf_dir, "nfs_file_read", root, os.path.join(wd, "ckpt"), RUN, os.path.join(wd, "src"))
    return scan_trace(spark, root, "nfs_file_read").drop("probe", "run_id")


def q_pair_stream_keyed(spark: SparkSession, sf_dir: str, max_pending_ns: int | None = PENDING_NS):
    """PAIR-8: the events arrive in ``SLICES`` slices of time; after each one
    the query starts again from its checkpoint and reads it as one micro-batch;
    pending entries stay in the keyed state in between."""
    from .pair_stream import start_pair_stream
    configure(spark)
    wd = _workdir(spark, "pair_stream_keyed")
    events = fx.table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(micros), F.max(micros)).first()
    part = F.floor((micros - F.lit(lo)) * SLICES / F.lit((hi or 0) - (lo or 0) + 1))
    src = os.path.join(wd, "src")
    root = os.path.join(wd, "tables")
    for i in range(SLICES):
        events.where(part == i).write.mode("append").parquet(src)
        raw = fx.raw_calls_from(stream_trace(spark, src, events.schema))
        stop_ingest(start_pair_stream(raw, "nfs_file_read", root, os.path.join(wd, "ckpt"), RUN, available_now=True, max_pending_ns=max_pending_ns))
    return scan_trace(spark, root, "nfs_file_read").drop("probe", "run_id")


def _two_probes(spark: SparkSession, sf_dir: str):
    configure(spark)
    wd = _workdir(spark, "ingest")
    root, ck = os.path.join(wd, "tables"), os.path.join(wd, "ckpt")
    qs = {}
    for probe in ("sys_call_trace", "rpc_task_latency"):
        raw = fx.raw_calls_from(fx.events_stream(spark, sf_dir))
        qs[probe] = start_ingest(raw, probe, root, ck, RUN, available_now=True)
    return root, ck, qs


def q_start_ingest(spark: SparkSession, sf_dir: str):
    root, _, qs = _two_probes(spark, sf_dir)
    for q in qs.values():
        stop_ingest(q)
    return scan_trace(spark, root, "sys_call_trace").drop("probe", "run_id")


def q_ingest_progress(spark: SparkSession, sf_dir: str):
    _, ck, qs = _two_probes(spark, sf_dir)
    rows = []
    for probe, q in qs.items():
        stop_ingest(q)
        p = ingest_progress(spark, ck, probe, RUN, q)
        rows.append((probe, p["rows_in"], p["rows_written"], p["entries"], p["exits"], p["last_error"]))
    return spark.createDataFrame(rows, "probe string, rows_in long, rows_written long, entries long, exits long, last_error string")


def q_runs_side_by_side(spark: SparkSession, sf_dir: str):
    """SRC-1/SNK-1/SNK-4/STR-2: append run 0, stream run 1, append run 2, a
    restarted stream as run 3, compact run 1, scan all."""
    from ..operators.pairing import pair
    configure(spark)
    wd = _workdir(spark, "runs")
    root, ck, probe = os.path.join(wd, "tables"), os.path.join(wd, "ckpt"), "nfs_file_read"
    rows = pair(fx.raw_calls(spark, sf_dir), probe)
    for i, run in enumerate(RUNS):
        if i % 2:
            _ingest_slices(spark, sf_dir, probe, root, ck, run, os.path.join(wd, f"src{i}"))
        else:
            append_trace(rows, root, probe, run)
    compact_run(spark, root, probe, RUNS[1])
    return scan_trace(spark, root, probe).drop("probe")


RUNS = tuple(f"20260101-00000{i}" for i in range(4))


def q_append_compact(spark: SparkSession, sf_dir: str):
    """SNK-1/2/4 + SRC-1: append a run in two parts, compact it, scan it."""
    from ..operators.pairing import pair
    configure(spark)
    root = os.path.join(_workdir(spark, "append"), "tables")
    rows = pair(fx.raw_calls(spark, sf_dir), "nfs_file_read")
    append_trace(rows.where(F.col("time_stamp") % 2 == 0), root, "nfs_file_read", "20260101-000000")
    append_trace(rows.where(F.col("time_stamp") % 2 == 1), root, "nfs_file_read", "20260101-000000")
    append_trace(rows.limit(0), root, "nfs_file_read", "20260101-000001")
    compact_run(spark, root, "nfs_file_read", "20260101-000000", files=2)
    return scan_trace(spark, root, "nfs_file_read", "20260101-000000").drop("probe", "run_id")


def q_stored_summaries(spark: SparkSession, sf_dir: str):
    """AGG-5 over runs: run 0 is sketched in two batches and compacted, run 1
    sketched, run 2 not yet; the summary of each and of all (in milliseconds)."""
    from ..operators.pairing import pair
    from ..sources.sketch_store import store_sketches, stored_summary
    configure(spark)
    root, probe = os.path.join(_workdir(spark, "sketches"), "tables"), "nfs_file_read"
    rows = pair(fx.raw_calls(spark, sf_dir), probe).withColumn("lat", F.expr("lat div 1000000"))
    part = F.expr("time_stamp div 1000 % 4")
    append_trace(rows.where(part == 0), root, probe, RUNS[0])
    append_trace(rows.where(part == 1), root, probe, RUNS[0])
    append_trace(rows.where(part == 2), root, probe, RUNS[1])
    store_sketches(spark, root, probe)
    compact_run(spark, root, probe, RUNS[0])
    append_trace(rows.where(part == 3), root, probe, RUNS[2])
    return (stored_summary(spark, root, probe, by_run=True)
            .unionByName(stored_summary(spark, root, probe).withColumn("run_id", F.lit("all"))))


def q_hot_settings_stream(spark: SparkSession, sf_dir: str):
    """Settings that change while the stream runs: the config log (derived
    from the data) is a table re-read at every micro-batch."""
    from .hot_config import start_ingest_hot
    configure(spark)
    wd = _workdir(spark, "hot")
    cfg_path = os.path.join(wd, "config")
    fx.config_log(spark, sf_dir).write.mode("overwrite").parquet(cfg_path)
    raw = fx.raw_calls_from(fx.events_stream(spark, sf_dir)).where(F.col("event_type") != "signup")
    q = start_ingest_hot(raw, "nfs_file_read", os.path.join(wd, "tables"), os.path.join(wd, "ckpt"),
                         "20260101-000000", config_path=cfg_path, params=["filter_pid"], available_now=True)
    stop_ingest(q)
    return scan_trace(spark, os.path.join(wd, "tables"), "nfs_file_read").drop("probe", "run_id")


def streaming_queries() -> dict:
    return {
        "pair_stream": q_pair_stream,
        "pair_stream_keyed": q_pair_stream_keyed,
        "start_ingest": q_start_ingest,
        "ingest_progress": q_ingest_progress,
        "append_compact_scan": q_append_compact,
        "runs_side_by_side": q_runs_side_by_side,
        "hot_settings_stream": q_hot_settings_stream,
        "stored_summaries": q_stored_summaries,
    }


def streaming_oracle_sql() -> dict:
    from ..plans.sql import _sketch_summary, oracle_sql
    o = oracle_sql()
    parts = (f"SELECT * REPLACE (lat // 1000000 AS lat), CASE (time_stamp // 1000) % 4 WHEN 2 THEN '{RUNS[1]}' WHEN 3 THEN '{RUNS[2]}' ELSE '{RUNS[0]}' END AS run_id "
             f"FROM ({o['pair_rw']})")
    runs = ", ".join(f"('{r}')" for r in RUNS)
    progress = " UNION ALL ".join(
        f"SELECT '{probe}' AS probe, (SELECT count(*) FROM events) AS rows_in, (SELECT count(*) FROM ({o[q]})) AS rows_written, "
        "(SELECT count(*) FROM events WHERE event_type IN ('view', 'click')) AS entries, (SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click')) AS exits, "
        "CAST(NULL AS VARCHAR) AS last_error" for probe, q in (("sys_call_trace", "pair_syscall"), ("rpc_task_latency", "pair_rpc")))
    return {"pair_stream": o["pair_rw"], "pair_stream_keyed": f"SELECT * REPLACE (CASE WHEN lat <= {PENDING_NS} THEN lat ELSE 0 END AS lat) FROM ({o['pair_rw']})",
            "start_ingest": o["pair_syscall"], "ingest_progress": progress,
            "runs_side_by_side": f"SELECT p.*, r.run_id FROM ({o['pair_rw']}) p CROSS JOIN (VALUES {runs}) r(run_id)",
            "stored_summaries": f"{_sketch_summary(parts, 'run_id')} UNION ALL BY NAME SELECT *, 'all' AS run_id FROM ({_sketch_summary(parts)})",
            "append_compact_scan": o["pair_rw"], "hot_settings_stream": o["pair_rw_asof"]}
