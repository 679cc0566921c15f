"""Stream = batch: stateful pairing across several micro-batches."""

import os
import tempfile

from pyspark.sql import functions as F

from tracelat.operators.pairing import pair
from tracelat.sources import fixtures as fx
from tracelat.sources.traces import scan_trace, stream_trace
from tracelat.specs import RAW_SCHEMA
from tracelat.streaming.ingest import ingest_progress, start_ingest, stop_ingest


def test_pairing_across_micro_batches(spark, sf_dir):
    raw = fx.raw_calls(spark, sf_dir).select(*[f.name for f in RAW_SCHEMA.fields])
    src = tempfile.mkdtemp(prefix="tracelat-src-")
    # four files by time range, so keys have entries pending across batches
    bounds = raw.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    lo, hi = bounds[0], bounds[1] + 1
    step = (hi - lo) // 4 + 1
    for i in range(4):
        part = raw.where((F.col("ts_ns") >= lo + i * step) & (F.col("ts_ns") < lo + (i + 1) * step))
        part.coalesce(1).write.parquet(os.path.join(src, f"batch={i:02d}"))
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    flat = tempfile.mkdtemp(prefix="tracelat-flat-")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{i:03d}.parquet"))
    stream = stream_trace(spark, flat, RAW_SCHEMA, max_files_per_trigger=1)
    wd = tempfile.mkdtemp(prefix="tracelat-sink-")
    for probe in ("nfs_file_read", "rpc_task_latency", "sys_call_trace"):
        q = start_ingest(stream, probe, os.path.join(wd, "t"), os.path.join(wd, "ck"), "20260101-000000",
                         params={"filter_comm": "proc3"}, available_now=True)
        q.processAllAvailable()
        stop_ingest(q)
        prog = ingest_progress(spark, os.path.join(wd, "ck"), probe, "20260101-000000", q)
        assert prog["batches"] >= 4 and prog["rows_in"] == raw.count()
        got = scan_trace(spark, os.path.join(wd, "t"), probe).drop("probe", "run_id")
        want = pair(raw, probe, {"filter_comm": "proc3"})
        assert prog["rows_written"] == want.count()
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_settings_stream_equals_batch_asof(spark, sf_dir):
    from tracelat.operators.asof import apply_config_asof
    from tracelat.streaming.hot_config import start_ingest_hot
    raw = fx.raw_calls(spark, sf_dir)
    ev = raw.where(F.col("event_type") != "signup").select(*[f.name for f in RAW_SCHEMA.fields])
    cfg_dir = tempfile.mkdtemp(prefix="tracelat-cfg-")
    fx.config_log(spark, sf_dir).write.mode("overwrite").parquet(os.path.join(cfg_dir, "cfg"))
    src = tempfile.mkdtemp(prefix="tracelat-hsrc-")
    b = ev.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    step = (b[1] + 1 - b[0]) // 4 + 1
    for i in range(4):
        part = ev.where((F.col("ts_ns") >= b[0] + i * step) & (F.col("ts_ns") < b[0] + (i + 1) * step))
        part.coalesce(1).write.parquet(os.path.join(src, f"d{i}"))
    flat = tempfile.mkdtemp(prefix="tracelat-hflat-")
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{i:03d}.parquet"))
    wd = tempfile.mkdtemp(prefix="tracelat-hot-")
    stream = stream_trace(spark, flat, RAW_SCHEMA, max_files_per_trigger=1)
    q = start_ingest_hot(stream, "nfs_file_read", os.path.join(wd, "t"), os.path.join(wd, "ck"),
                         "20260101-000000", config_path=os.path.join(cfg_dir, "cfg"),
                         params=["filter_pid"], available_now=True)
    q.processAllAvailable()
    q.stop()
    got = scan_trace(spark, os.path.join(wd, "t"), "nfs_file_read").drop("probe", "run_id")
    want = apply_config_asof(ev, fx.config_log(spark, sf_dir), "nfs_file_read", ["filter_pid"])
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_pair_stream_with_state_ttl(spark, sf_dir):
    """With a state TTL (processing-time mode) far above the run time the
    rows equal the batch pairing."""
    wd = tempfile.mkdtemp(prefix="tracelat-ttl-")
    raw = fx.raw_calls_from(fx.events_stream(spark, sf_dir))
    q = start_ingest(raw, "block_io_latency", os.path.join(wd, "t"), os.path.join(wd, "ck"),
                     "20260101-000000", ttl_ms=3_600_000, available_now=True)
    stop_ingest(q)
    got = scan_trace(spark, os.path.join(wd, "t"), "block_io_latency").drop("probe", "run_id")
    want = pair(fx.raw_calls(spark, sf_dir), "block_io_latency")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _sliced(spark, df, n, ts="ts_ns"):
    """The rows as files in order of time, to be read one a micro-batch."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    src = tempfile.mkdtemp(prefix="tracelat-slices-")
    part = F.floor((F.col(ts) - F.lit(lo)) * F.lit(n) / F.lit(hi - lo + 1))
    for i in range(n):
        df.where(part == i).coalesce(1).write.mode("append").parquet(os.path.join(src, "raw"))
    return stream_trace(spark, os.path.join(src, "raw"), df.schema, max_files_per_trigger=1)


def test_keyed_state_equals_batch_pairing(spark, sf_dir):
    """pair_stream() over five micro-batches, with and without a limit on how long an entry is pending."""
    from tracelat.streaming.pair_stream import start_pair_stream
    raw = fx.raw_calls(spark, sf_dir).select(*[f.name for f in RAW_SCHEMA.fields])
    stream = _sliced(spark, raw, 5)
    for probe, limit in (("nfs_file_read", None), ("nfs_file_read", 3600 * 10**9), ("block_io_latency", 3600 * 10**9)):
        wd = tempfile.mkdtemp(prefix="tracelat-keyed-")
        q = start_pair_stream(stream, probe, wd, os.path.join(wd, "ck"), "r", available_now=True, max_pending_ns=limit, params={"filter_comm": "proc3"})
        stop_ingest(q)
        batches = [p for p in q.recentProgress if p["numInputRows"]]
        assert len(batches) >= 4 and sum(p["numInputRows"] for p in batches) == raw.count()
        got = scan_trace(spark, wd, probe).drop("probe", "run_id")
        want = pair(raw, probe, {"filter_comm": "proc3"}, max_pending_ns=limit)
        free = pair(raw, probe, {"filter_comm": "proc3"})
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert limit is None or want.exceptAll(free).count() + free.exceptAll(want).count() > 0  # the limit decides something


def test_timers_clear_entries_that_never_see_an_exit(spark):
    """200 entries without an exit, then a later busy key: the old keys' state goes once the watermark is past their time."""
    from tracelat.streaming.pair_stream import pair_stream
    sec = 10**9
    rows = [(i, i * 1000, "entry", (i + 1) << 32, "c", 1) for i in range(200)]
    rows += [(1000 + i, (i + 1) * 600 * sec, "exit" if i % 2 else "entry", 5000 << 32, "c", 1) for i in range(12)]
    rows += [(2000, 7300 * sec, "exit", 1 << 32, "c", 1)]
    df = spark.createDataFrame(rows, "seq long, ts_ns long, kind string, pid_tgid long, comm string, ret long")
    stream = _sliced(spark, df, 6)
    out = []
    q = (pair_stream(stream, "nfs_file_read", max_pending_ns=60 * sec).writeStream.outputMode("append")
         .foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start())
    q.processAllAvailable()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    want = [r for r in pair(df, "nfs_file_read", max_pending_ns=60 * sec).collect()]
    assert sorted(map(tuple, out)) == sorted(map(tuple, want))
    assert max(states) >= 190 and states[-1] <= 10, states


def test_frames_of_a_key_in_any_order():
    import random

    import pandas as pd

    from tracelat.streaming.pair_stream import in_order
    rng = random.Random(2)
    for n, mixed in ((0, False), (1, False), (40, False), (40, True)):
        rows = [(rng.randrange(30), i) for i in range(n)]
        rows = rows if mixed else sorted(rows)
        cuts = [0, *sorted(rng.sample(range(n + 1), min(n, 5))), n]
        frames = [pd.DataFrame(rows[a:b], columns=["ts_ns", "seq"]) for a, b in zip(cuts, cuts[1:])]
        got = list(in_order(iter(frames)))
        assert [tuple(r) for pdf in got for r in pdf.itertuples(index=False)] == sorted(rows)
        assert mixed or len(got) == sum(not f.empty for f in frames)


def test_a_batch_writes_what_it_changes(spark, monkeypatch):
    """1 000 events over 200 000 pending keys: few rows are written; results and pending entries equal one batch's, also
    over merges of the versions and a re-run."""
    from tracelat.streaming import hot_config
    monkeypatch.setattr(hot_config, "COMPACT_AFTER", 3)
    n, sec = 200_000, 10**9
    wd = tempfile.mkdtemp(prefix="tracelat-pending-")
    first = spark.range(n).selectExpr("id AS seq", "id * 1000 AS ts_ns", "'entry' AS kind", "(id + 1) << 32 AS pid_tgid", "'c' AS comm", "'f' AS file", "1L AS ret", "0L AS offset")
    batches = [first]
    for b in range(1, 9):
        part = first.where((F.col("seq") % 200 == b) | (F.col("seq") % 8000 == 7))
        kind = F.when(F.col("seq") % 3 == 0, "entry").otherwise("exit")
        batches.append(part.withColumn("kind", kind).withColumn("ts_ns", F.col("ts_ns") + b * sec).withColumn("seq", F.col("seq") + b * n))
    go = lambda i: hot_config.process_batch(batches[i], i, "nfs_file_read", wd, f"{wd}/state", "r", None, [])
    for i in range(len(batches)):
        go(i)
        written = spark.read.parquet(f"{wd}/state/pending/batch_id={i}").count()
        assert written == n if i == 0 else written <= 0.05 * n
        if i == 5:
            go(i)  # again, after a failure
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    got, want = scan_trace(spark, wd, "nfs_file_read").drop("probe", "run_id"), pair(whole, "nfs_file_read")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert hot_config._children(spark, f"{wd}/state/pending", "full")[-1] in (6, 7, 8)
    schema = spark.read.parquet(f"{wd}/state/pending/batch_id=8").schema
    left = hot_config._latest(hot_config._pending_versions(spark, f"{wd}/state/pending", 9, schema), ["pid_tgid"], None)
    last = whole.groupBy("pid_tgid").agg(F.max_by("kind", "ts_ns").alias("kind")).where("kind = 'entry'")
    assert left.count() == last.count() and left.join(last, "pid_tgid", "left_anti").count() == 0


def test_batch_pair_rejects_streams_and_fixed_settings_engine(spark, sf_dir):
    import pytest
    from tracelat.streaming.hot_config import start_ingest_hot
    stream = fx.raw_calls_from(fx.events_stream(spark, sf_dir))
    with pytest.raises(TypeError, match="pair_stream"):
        pair(stream, "nfs_file_read")
    wd = tempfile.mkdtemp(prefix="tracelat-fixed-")
    q = start_ingest_hot(stream, "sys_call_trace", os.path.join(wd, "t"), os.path.join(wd, "ck"),
                         "20260101-000000", fixed={"filter_comm": "proc2"}, available_now=True)
    stop_ingest(q)
    got = scan_trace(spark, os.path.join(wd, "t"), "sys_call_trace").drop("probe", "run_id")
    want = pair(fx.raw_calls(spark, sf_dir), "sys_call_trace", {"filter_comm": "proc2"})
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_compaction_shows_each_row_once(spark, sf_dir):
    """At every point of a compaction - also one that broke off - a scan sees each row once."""
    import pytest
    from tracelat.sources import traces
    wd = tempfile.mkdtemp(prefix="tracelat-compact-")
    with pytest.raises(ValueError, match="does not exist"):
        scan_trace(spark, wd, "sys_call_trace")
    rows = pair(fx.raw_calls(spark, sf_dir), "sys_call_trace").cache()
    n = rows.count()
    for run in ("r1", "r1", "r2"):
        traces.append_trace(rows, wd, "sys_call_trace", run)
    traces.write_batch(rows, wd, "sys_call_trace", "r1", traces.COMPACT + "unpublished")
    assert scan_trace(spark, wd, "sys_call_trace").count() == 3 * n
    traces.compact_run(spark, wd, "sys_call_trace", "r1")
    traces.append_trace(rows, wd, "sys_call_trace", "r1")
    assert scan_trace(spark, wd, "sys_call_trace", "r1").count() == 3 * n
    traces.compact_run(spark, wd, "sys_call_trace", "r1", files=1)
    assert scan_trace(spark, wd, "sys_call_trace", "r1").count() == 3 * n and scan_trace(spark, wd, "sys_call_trace").count() == 4 * n
    assert scan_trace(spark, wd, "sys_call_trace", "r2").drop("probe", "run_id").exceptAll(rows).count() == 0


def test_readers_planned_before_a_compaction_survive_it(spark, sf_dir):
    """Replaced batches stay for the retention; a plan names what is still there, not every compaction ever made."""
    from tracelat.sources import traces
    wd = tempfile.mkdtemp(prefix="tracelat-snapshots-")
    rows = pair(fx.raw_calls(spark, sf_dir), "sys_call_trace").cache()
    n, run = rows.count(), "r1"
    for _ in range(3):
        traces.append_trace(rows, wd, "sys_call_trace", run)
    early = scan_trace(spark, wd, "sys_call_trace")
    traces.compact_run(spark, wd, "sys_call_trace", run, files=1)
    late = scan_trace(spark, wd, "sys_call_trace")
    traces.append_trace(rows, wd, "sys_call_trace", run)
    traces.compact_run(spark, wd, "sys_call_trace", run, files=1)
    assert early.count() == 3 * n and late.count() == 3 * n and scan_trace(spark, wd, "sys_call_trace").count() == 4 * n
    batches = lambda: set(os.listdir(os.path.join(wd, "probe=sys_call_trace", "run_id=r1")))
    assert len([b for b in batches() if b.startswith("batch_id=")]) == 6  # 4 appends, 2 compactions
    assert len(traces.vacuum(spark, wd, "sys_call_trace", run, retention=0)) == 5
    assert len([b for b in batches() if b.startswith("batch_id=")]) == 1 and scan_trace(spark, wd, "sys_call_trace", run).count() == 4 * n
    sizes = []
    for _ in range(5):  # many compactions: the plan stays as long
        traces.append_trace(rows.limit(1), wd, "sys_call_trace", run)
        traces.compact_run(spark, wd, "sys_call_trace", run, files=1, retention=0)
        sizes.append(len(scan_trace(spark, wd, "sys_call_trace")._jdf.queryExecution().optimizedPlan().toString()))
    assert max(sizes) - min(sizes) <= 40 and scan_trace(spark, wd, "sys_call_trace").count() == 4 * n + 5
    assert traces.vacuum(spark, wd, "sys_call_trace", "other") == []
