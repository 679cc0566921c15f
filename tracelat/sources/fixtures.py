"""Adapters that build trace-shaped inputs from the generated test tables.

* :func:`raw_calls`  — raw entry/exit events (from ``events``);
* :func:`calls`      — finished latency rows (``lineitem`` joined to ``part``);
* :func:`control_log` — probe lifecycle commands (from ``orders``);
* :func:`config_log` — parameter updates over time (from ``raw_calls``).

Each has a DuckDB twin in :mod:`tracelat.plans.sql` so every query can be
checked against an independent engine.  The adapters are plain projections
(and one join) that Catalyst folds into the queries built on them, so
column pruning and filter pushdown reach the Parquet scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import PROBES

UNKNOWN_PROBE = "no_such_probe"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_calls_from(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The ``events`` file of ``sf_dir`` read as a file stream."""
    from .traces import stream_trace
    schema = table(spark, sf_dir, "events").schema
    return stream_trace(spark, sf_dir, schema, "parquet", max_files_per_trigger, glob="events.parquet")


def raw_calls_from(e: DataFrame) -> DataFrame:
    """Raw entry/exit events from an ``events`` frame (batch or stream)."""
    k = F.get_json_object("props", "$.k").cast("long")
    uid = F.col("user_id")
    return e.select(
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.when(F.col("event_type").isin("view", "click"), "entry").otherwise("exit").alias("kind"),
        # four threads a process; block requests, system calls and task names don't follow the thread
        ((F.floor(uid / 4) + 1) * 4294967296 + (uid + 1)).alias("pid_tgid"),
        (k % 3).alias("dev"),
        (k % 50).alias("sector"),
        (uid % 37).alias("obj"),
        F.concat(F.lit("proc"), ((uid + k % 2) % 8).cast("string")).alias("comm"),
        ((uid + k) % 5).alias("syscall_id"),
        k.alias("k"),
        F.when(F.col("event_type") == "error", -1 - (k % 5))
         .otherwise(F.round(F.col("value") * 100).cast("long")).alias("ret"),
        F.concat(F.lit("f"), (k % 10).cast("string"),
                 F.when(k % 2 == 0, ".log").otherwise(".txt")).alias("file"),
        ((F.col("event_id") * 2654435761) % 4294967296).alias("xid"),
        (k * 512).alias("size"),
        (F.col("event_id") * 4096).alias("offset"),
        F.when(k % 4 == 0, "READ").when(k % 4 == 1, "WRITE").when(k % 4 == 2, "GETATTR")
         .alias("proc_name"),
        F.col("event_type"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    # No broadcast hint: part grows with the scale factor; AQE switches to
    # a broadcast join at run time only when the measured side is small.
    j = li.join(pa, F.col("p_partkey") == F.col("l_partkey"))
    return j.select(
        (F.col("l_suppkey") + 1).alias("pid"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("lat"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("time_stamp"),
        F.round(F.col("l_quantity")).cast("long").alias("size"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("comm"),
        F.col("p_name").alias("file"),
    )


def control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    names = F.array(*[F.lit(p) for p in PROBES], F.lit(UNKNOWN_PROBE))
    op = (F.when(F.col("o_orderkey") % 4 == 0, "load").when(F.col("o_orderkey") % 4 == 1, "unload")
          .when(F.col("o_orderkey") % 4 == 2, "update").otherwise("status"))
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.element_at(names, (F.col("o_custkey") % 13 + 1).cast("int")).alias("probe"),
        op.alias("op"),
        F.when(F.col("o_orderstatus") == "P", "fail").otherwise("ok").alias("outcome"),
        (F.col("o_orderkey") % 11 == 0).alias("dry_run"),
    )


def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_calls(spark, sf_dir)
    return r.where(F.col("event_type") == "signup").select(
        F.col("ts_ns").alias("from_ns"),
        F.when(F.col("k") % 3 == 0, F.lit(0)).otherwise(F.col("k") % 150 + 1).cast("long").alias("filter_pid"),
    )


def partial_config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates of two parameters: each leaves some as they are, and stamps are cut to ten minutes, so that
    several updates share one and apply in the order of ``seq``."""
    r = raw_calls(spark, sf_dir).where(F.col("event_type") == "signup")
    k = F.col("k")
    return r.select(
        (F.col("ts_ns") - F.pmod("ts_ns", F.lit(600 * 10**9))).alias("from_ns"), "seq",
        F.when(k % 3 != 0, k % 150 + 1).cast("long").alias("filter_pid"),
        F.when(k % 4 != 1, F.concat(F.lit("proc"), (k % 8).cast("string"))).alias("filter_comm"),
    )


def param_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter updates (JSON objects, some with wrong types or negative
    values) derived from the ``signup`` events."""
    r = raw_calls(spark, sf_dir).where(F.col("event_type") == "signup")
    k = F.col("k")
    pid = (F.when(k % 5 == 0, F.lit('"invalid"'))
           .when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string")))
           .when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".7")))
           .otherwise(k.cast("string")))
    file = F.when(k % 4 == 0, F.lit("3")).otherwise(F.concat(F.lit('"*.'), (k % 3).cast("string"), F.lit('"')))
    comm = F.when(k % 7 == 0, F.lit("7")).otherwise(F.concat(F.lit('"proc'), (k % 8).cast("string"), F.lit('"')))
    params = F.concat(F.lit('{"filter_pid": '), pid, F.lit(', "filter_file": '), file,
                      F.lit(', "filter_comm": '), comm, F.lit("}"))
    return r.select("seq", F.lit("nfs_file_read").alias("probe"), params.alias("params"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls (some malformed) derived from ``orders`` via the control log."""
    c = control_log(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey"), "seq")
    seq = F.col("seq")
    return c.select(
        "seq",
        F.when(seq % 3 == 0, "customize").otherwise("control").alias("tool"),
        F.when(F.col("o_custkey") % 17 == 0, F.lit("")).otherwise(F.col("probe")).alias("name"),
        F.when(seq % 5 == 4, F.lit("restart")).when(seq % 3 == 0, F.lit(None)).otherwise(F.col("op"))
         .alias("operation"),
        F.when(seq % 3 != 0, F.lit(None)).when(seq % 7 == 0, F.lit("[1]")).when(seq % 7 == 1, F.lit(None))
         .otherwise(F.concat(F.lit('{"filter_pid": '), F.col("o_custkey").cast("string"), F.lit("}")))
         .alias("params"),
        (seq % 13 != 0).alias("args_present"),
    )


def error_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as wrapped by their callers, outermost first: up to three, each with a code, a known message or neither."""
    from ..operators.control import BASE_ERROR_CODES, ERROR_LEVELS
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    codes, messages = F.array(*[F.lit(c) for c, _ in ERROR_LEVELS]), F.array(*[F.lit(m) for m, _ in BASE_ERROR_CODES])

    def error(i):
        return F.struct(F.when((u + i) % 4 == 0, F.get(codes, ((k + i) % len(ERROR_LEVELS)).cast("int"))).alias("code"),
                        F.when((k + i) % 3 == 0, "wrapped").otherwise(F.get(messages, ((u + i) % len(BASE_ERROR_CODES)).cast("int"))).alias("message"))

    chain = F.slice(F.array(*[error(i) for i in range(3)]), F.lit(1), (k % 4).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("seq"), chain.alias("errors"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries of which many describe one type, in several files."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("probe"), (F.col("o_custkey") % 500).cast("string")).alias("type"),
                                                 F.concat(F.lit("file"), (k % 7).cast("string"), F.lit(".yaml")).alias("source_file"),
                                                 k.alias("pos"), F.concat(F.lit("title "), k.cast("string")).alias("title"))


def described_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries some of which lack fields or have empty ones."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    param = F.struct(F.when(u % 9 == 0, "").otherwise("filter_pid").alias("name"), F.lit("u64").alias("type"),
                     F.when(u % 4 != 0, "process").alias("description"))
    field = lambda n: F.struct(F.lit(n).alias("name"), F.when(k % 10 == 0, "  ").otherwise("u64").alias("type"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("probe"), k.cast("string")).alias("type"), F.when(k % 5 != 0, "title").alias("title"), F.when(k % 7 == 0, "").otherwise("VFS").alias("layer"),
        F.lit("L1").alias("level"), F.lit("scene").alias("scene"), F.when(u % 11 == 0, " ").otherwise("none").alias("risks"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 6 == 0, F.array(F.lit("vfs_read"), F.lit(""))).otherwise(F.array(F.lit("vfs_read"))).alias("entrypoints"),
        F.array(param).alias("params"), F.struct(F.when(u % 17 != 0, F.array(field("pid"), field("lat"))).alias("fields")).alias("outputs"))
