"""Plan-shape checks: the physical plans the scale design relies on."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracelat.operators.asof import asof_join
from tracelat.operators.control import replay_control
from tracelat.operators.pairing import pair
from tracelat.operators.stats import latest, p99_row, top_keys
from tracelat.sources import fixtures as fx
from tracelat.sources.traces import append_trace, scan_trace
from tracelat.specs import RAW_SCHEMA


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    root = tempfile.mkdtemp(prefix="tracelat-plans-")
    fx.raw_calls(spark, sf_dir).select(*[f.name for f in RAW_SCHEMA.fields]).write.parquet(os.path.join(root, "raw"))
    raw = spark.read.parquet(os.path.join(root, "raw"))
    append_trace(pair(raw, "sys_call_trace"), os.path.join(root, "t"), "sys_call_trace", "20260101-000000")
    append_trace(pair(raw, "sys_call_trace"), os.path.join(root, "t"), "sys_call_trace", "20260101-000001")
    return root, raw


def test_pairing_is_one_shuffle_with_pushed_filters(stored):
    _, raw = stored
    df = pair(raw, "sys_call_trace", {"filter_pid": 8, "filter_comm": "proc7"}, chunk_ns=None)
    plan, text = _plan(df), _formatted(df)
    assert plan.count("Exchange hashpartitioning(pid_tgid") == 1
    assert "GreaterThanOrEqual(pid_tgid,34359738368)" in text
    assert "StringStartsWith(comm,proc7)" in text
    assert "ReadSchema: struct<seq:bigint,ts_ns:bigint,kind:string,pid_tgid:bigint,comm:string" in text
    assert "file" not in text.split("ReadSchema:")[1].split("\n")[0]     # pruned


def test_chunked_pairing_shuffles_the_data_once(spark, stored):
    """Even when the carry table is too big to broadcast, the event rows are
    shuffled once: the window, the summary and the join back share the same
    (surrogate key, chunk) partitioning."""
    _, raw = stored
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = pair(raw, "nfs_file_read", chunk_ns=10 ** 12)
        df.write.format("noop").mode("overwrite").save()
        lines = _plan(df).splitlines()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    exchanges = [ln for ln in lines if "Exchange hashpartitioning" in ln]
    assert not any("coalesce(" in ln for ln in exchanges)
    join = next(i for i, ln in enumerate(lines) if "SortMergeJoin" in ln)
    big_side = []
    for ln in lines[join + 1:]:                # the left (streamed) input of the join
        if ln.lstrip().startswith("+-") and "Exchange" in ln and ":" not in ln[:ln.index("+-")]:
            break
        if "Exchange" in ln:
            big_side.append(ln)
    assert len(big_side) == 1 and "_chunk" in big_side[0]


def test_even_chunks_read_one_table(spark, sf_dir):
    """Rows and summary of the chunked scan come from the one table that the windowed exchange was written to."""
    frames = [pair(fx.raw_calls(spark, sf_dir), "nfs_file_read", rows_per_chunk=4), replay_control(fx.control_log(spark, sf_dir), rows_per_chunk=20)]
    for df in frames:
        plan = _plan(df)
        assert plan.count("FileScan") == 1 and "tracelat-carry" in plan and "Exchange hash" not in plan


def test_p99_row_pushes_the_bound_and_takes_top1_per_partition(spark, stored):
    root, _ = stored
    t = scan_trace(spark, os.path.join(root, "t"), "sys_call_trace", "20260101-000001")
    df = p99_row(t, "duration")
    text = _formatted(df)
    assert "GreaterThanOrEqual(duration," in text
    assert "PartitionFilters: [isnotnull(run_id" in text
    assert "TakeOrderedAndProject" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_top_k_reports_are_partial_top_k(spark, stored):
    root, _ = stored
    t = scan_trace(spark, os.path.join(root, "t"), "sys_call_trace")
    assert "TakeOrderedAndProject" in _plan(top_keys(t, "syscall_id", 10))
    assert "TakeOrderedAndProject" in _plan(latest(t, 5, "enter_time_stamp", ("comm", "pid")))


def test_replay_scans_share_one_shuffle(spark, sf_dir):
    df = replay_control(fx.control_log(spark, sf_dir), chunk_rows=None)
    plan = _plan(df)
    assert plan.count("Exchange") == 1 and plan.count("Window [") == 2


def test_asof_is_a_bucketed_broadcast_equi_join(spark, sf_dir):
    raw = fx.raw_calls(spark, sf_dir).where(F.col("event_type") != "signup")
    df = asof_join(raw, fx.config_log(spark, sf_dir), ["filter_pid"])
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
