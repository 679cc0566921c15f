"""Probe lifecycle as a table: replay a control log of commands.

Input ``control_log(seq, probe, op, outcome, dry_run[, params])`` with
``op in load|unload|update|status`` and ``outcome in ok|fail`` (whether the
command's action succeeded when it was executed).

Replay rules (CTL-1):

* unknown probe -> ``PROBE_NOT_FOUND`` (load also needs an implementation);
* ``attached`` before a row = the last successful load (true) / unload
  (false) before it.  A rejected command never changes attachment, and a
  rejected load/unload can only happen when attachment already has the value
  it would set, so the flag needs no knowledge of rejections;
* load when attached -> ``PROBE_ALREADY_LOADED``; unload/update when not ->
  ``PROBE_NOT_LOADED``;
* an executed command that fails -> state ``error`` with
  ``PROBE_START_FAILED`` / ``PROBE_STOP_FAILED`` / ``PROBE_UPDATE_FAILED``;
  success -> ``loaded`` / ``unloaded`` / ``loaded`` and the error is cleared;
* rejected commands, ``status`` and dry-run updates leave the state.

Both passes are ``last(ignorenulls)`` scans per probe; a busy probe is cut
into chunks of equal count (:func:`carry_even`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_fixed_string, to_u32, to_uint64
from ..specs import PROBES, SPECS
from . import carry
from .carry import carry_even, carry_last, chunk_of
from .catalog import maybe_broadcast

# Error codes and their log levels.
ERROR_LEVELS = [
    ("INVALID_ARGUMENT", "WARN"), ("MISSING_ARGUMENT", "WARN"),
    ("PERMISSION_DENIED", "WARN"), ("QUOTA_EXCEEDED", "WARN"),
    ("PROBE_NOT_FOUND", "WARN"), ("PROBE_NOT_LOADED", "WARN"), ("PROBE_ALREADY_LOADED", "WARN"),
    ("PROBE_START_FAILED", "ERROR"), ("PROBE_STOP_FAILED", "ERROR"), ("PROBE_UPDATE_FAILED", "ERROR"),
    ("INVALID_CONFIG", "WARN"), ("DB_CONNECTION_FAILED", "ERROR"), ("DB_OPERATION_FAILED", "ERROR"),
    ("RUNTIME_FAILURE", "ERROR"), ("CONFLICT", "WARN"), ("NOT_SUPPORTED", "ERROR"),
]
# Base errors -> code (anything else is RUNTIME_FAILURE).
BASE_ERROR_CODES = [
    ("probe not found", "PROBE_NOT_FOUND"),
    ("probe already loaded", "PROBE_ALREADY_LOADED"),
    ("probe not loaded", "PROBE_NOT_LOADED"),
    ("probe is not started", "RUNTIME_FAILURE"),
    ("invalid filter value", "INVALID_ARGUMENT"),
    ("negative value", "INVALID_ARGUMENT"),
    ("unsupported type", "INVALID_ARGUMENT"),
    ("database is nil", "DB_CONNECTION_FAILED"),
    ("db opener not configured", "DB_CONNECTION_FAILED"),
    ("connection is not a duckdb.Conn", "DB_CONNECTION_FAILED"),
    ("controller is required", "INVALID_CONFIG"),
    ("auth token is required", "PERMISSION_DENIED"),
    ("http port is required for http transport", "INVALID_CONFIG"),
    ("invalid transport", "INVALID_CONFIG"),
    ("unsupported transport", "INVALID_CONFIG"),
]
VALID_OPS = ("load", "unload", "update", "status")


def names_frame(spark: SparkSession, names, col: str = "name") -> DataFrame:
    """A one-column table of fixed names, built JVM-side."""
    arr = F.array(*[F.lit(n) for n in names])
    return spark.range(len(names)).select(F.element_at(arr, (F.col("id") + 1).cast("int")).alias(col))


def replay_control(log: DataFrame, catalog: DataFrame | None = None,
                   implemented=None, chunk_rows: int | str | None = "auto",
                   rows_per_chunk: int | None = None) -> DataFrame:
    """CTL-1/CTL-4: per command, the answer code and the state after it.

    Output: ``seq, probe, op, outcome, dry_run, attached_before, code,
    state, last_error, loaded, reply_loaded``.  ``state`` is null for
    unknown probes.  ``catalog`` (``type`` column) adds described-only
    probes; ``implemented`` defaults to the library's twelve specs.
    ``chunk_rows='auto'`` cuts probes with more than ``rows_per_chunk``
    commands into chunks of equal count (:func:`carry_even`); a number cuts
    every probe by ``seq div chunk_rows``; None forces the single window.
    """
    impl_names = sorted(implemented or SPECS)
    has_impl = F.col("probe").isin(*impl_names)          # a fixed literal set, no join
    x = log
    if catalog is not None:
        # described probes come from data: a size-checked broadcast join
        described = catalog.select(F.col("type").alias("_desc")).distinct()
        x = x.join(maybe_broadcast(described), F.col("probe") == F.col("_desc"), "left")
        known = has_impl | F.col("_desc").isNotNull()
    else:
        known = has_impl | F.col("probe").isin(*PROBES)
    op, ok = F.col("op"), F.col("outcome") == "ok"
    dry = F.coalesce(F.col("dry_run"), F.lit(False)) & (op == "update")
    flag = (F.when(has_impl & (op == "load") & ok, F.lit(True))
            .when(known & (op == "unload") & ok, F.lit(False)))

    def scan(rows: DataFrame, values: dict[str, Column], inclusive: bool) -> DataFrame:
        if chunk_rows == "auto":
            return carry_even(rows, ["probe"], ["seq"], values, rows_per_chunk or carry.AUTO_CHUNK_ROWS, inclusive=inclusive)
        return carry_last(rows, ["probe"], ["seq"], values, chunk=chunk_of("seq", chunk_rows), inclusive=inclusive)

    x = scan(x, {"_att": flag}, False)
    att = F.coalesce(F.col("_att"), F.lit(False))
    not_found = F.when(op == "load", ~has_impl).otherwise(~known)
    code = (F.when(dry, F.lit(None))
            .when(~op.isin(*VALID_OPS), F.lit("INVALID_ARGUMENT"))
            .when(not_found, F.lit("PROBE_NOT_FOUND"))
            .when((op == "load") & att, F.lit("PROBE_ALREADY_LOADED"))
            .when(op.isin("unload", "update") & ~att, F.lit("PROBE_NOT_LOADED"))
            .when((op == "load") & ~ok, F.lit("PROBE_START_FAILED"))
            .when((op == "unload") & ~ok, F.lit("PROBE_STOP_FAILED"))
            .when((op == "update") & ~ok, F.lit("PROBE_UPDATE_FAILED")))
    executed = (~dry & known & ~not_found
                & (((op == "load") & ~att) | (op.isin("unload", "update") & att)))
    state_w = (F.when(executed & ~ok, F.lit("error"))
               .when(executed & op.isin("load", "update"), F.lit("loaded"))
               .when(executed & (op == "unload"), F.lit("unloaded")))
    err_w = F.when(executed, F.coalesce(code, F.lit("")))
    x = x.withColumn("attached_before", att).withColumn("code", code) \
         .withColumn("_sw", state_w).withColumn("_ew", err_w)
    x = scan(x, {"_state": F.col("_sw"), "_err": F.col("_ew")}, True)
    state = F.when(known, F.coalesce(F.col("_state"), F.lit("unloaded")))
    return x.select(
        "seq", "probe", "op", "outcome", F.coalesce(F.col("dry_run"), F.lit(False)).alias("dry_run"),
        "attached_before", "code", state.alias("state"),
        F.when(known, F.nullif(F.col("_err"), F.lit(""))).alias("last_error"),
        F.when(known, state == "loaded").alias("loaded"),
        F.when(F.col("code").isin("PROBE_STOP_FAILED", "PROBE_UPDATE_FAILED"), F.lit(True))
         .otherwise(state == "loaded").alias("reply_loaded"),
    )


def latest_status(replayed: DataFrame) -> DataFrame:
    """CTL-6: current state per known probe (the state after its last
    command), ``loaded`` true only in state ``loaded``.  A map-side combined
    ``max_by`` per probe."""
    s = replayed.where(F.col("state").isNotNull()).groupBy("probe").agg(
        F.max_by(F.struct("state", "last_error"), F.col("seq")).alias("s"))
    return s.select("probe", F.col("s.state").alias("state"),
                    (F.col("s.state") == "loaded").alias("loaded"),
                    F.col("s.last_error").alias("last_error"))


def error_level(df: DataFrame, code_col: str = "code") -> DataFrame:
    """CTL-2: code -> WARN / ERROR (unknown codes are ERROR).  The level
    table is a fixed 16-row literal map evaluated in the projection."""
    m = F.create_map(*[F.lit(x) for kv in ERROR_LEVELS for x in kv])
    c = F.col(code_col)
    return df.withColumn("level", F.when(c.isNotNull(), F.coalesce(m[c], F.lit("ERROR"))))


def map_error(df: DataFrame, chain_col: str = "errors") -> DataFrame:
    """CTL-3: an error chain (array of ``{code, message}`` from outermost to
    innermost; ``code`` null for uncoded errors) -> the protocol code: the
    outermost coded error wins, else the first known base message, else
    ``RUNTIME_FAILURE``."""
    base = F.create_map(*[F.lit(x) for kv in BASE_ERROR_CODES for x in kv])
    chain = F.col(chain_col)
    coded = F.filter(chain, lambda e: e["code"].isNotNull())
    known = F.filter(F.transform(chain, lambda e: base[e["message"]]), lambda c: c.isNotNull())
    code = F.coalesce(F.try_element_at(coded, F.lit(1))["code"], F.try_element_at(known, F.lit(1)),
                      F.lit("RUNTIME_FAILURE"))
    return df.withColumn("code", F.when(F.size(chain) > 0, code))


def dry_run_answers(log: DataFrame) -> DataFrame:
    """CTL-4: dry-run updates are accepted without any check or effect."""
    return log.where(F.coalesce(F.col("dry_run"), F.lit(False)) & (F.col("op") == "update")).select(
        "seq", "probe", F.lit(True).alias("accepted"), F.lit("dry run").alias("reason"),
        F.lit("unchanged").alias("new_state"))


def command_validity(cmds: DataFrame) -> DataFrame:
    """CTL-5: the first problem of each tool call, null when valid.

    Columns: ``tool`` ('control' | 'customize'), ``name``, ``operation``,
    ``params`` (JSON text or null), ``args_present``."""
    name, opn, params = F.col("name"), F.col("operation"), F.col("params")
    pv = F.try_parse_json(params)
    is_obj = F.coalesce(F.schema_of_variant(pv).startswith("OBJECT"), F.lit(False))
    ctl = (F.when(~F.col("args_present"), "arguments are required")
           .when(F.coalesce(name, F.lit("")) == "", "probeName must be a non-empty string")
           .when(opn.isNull(), "operation must be a string")
           .when(~opn.isin("load", "unload", "status"), "operation must be one of load|unload|status"))
    cus = (F.when(~F.col("args_present"), "arguments are required")
           .when(F.coalesce(name, F.lit("")) == "", "name must be a non-empty string")
           .when(~is_obj, "params must be an object"))
    return cmds.withColumn("error", F.when(F.col("tool") == "control", ctl).otherwise(cus))


def param_updates(updates: DataFrame, probe: str) -> DataFrame:
    """CTL-7/SCL-7..9: coerce one probe's parameter updates.

    ``updates(seq, params)`` with ``params`` the JSON object text.  Keys are
    applied in the probe's order (pid, then file or syscall id, then comm);
    the first bad key fails the update with ``INVALID_ARGUMENT`` and leaves
    the keys before it applied.  Output per update: the applied value of
    each known key (null = not given or not applied) and ``error``.
    """
    s = SPECS[probe]
    order = [k for k in ("filter_pid", "filter_file", "filter_syscall_id", "filter_comm") if k in s.filters]
    v = F.parse_json(F.col("params"))
    coerced = {}
    for k in order:
        raw = F.try_variant_get(v, f"$.{k}", "variant")
        if k == "filter_pid":
            coerced[k] = to_uint64(raw)
        elif k == "filter_syscall_id":
            c = to_uint64(raw)
            coerced[k] = F.struct(to_u32(c["value"]).alias("value"), c["error"].alias("error"))
        elif k == "filter_file":
            coerced[k] = to_fixed_string(raw, s.file_len)
        else:
            coerced[k] = to_fixed_string(raw, s.comm_len)
    out = updates
    for k in order:
        out = out.withColumn(f"_c_{k}", coerced[k])
    ok_so_far: Column = F.lit(True)
    cols = []
    first_err = F.lit(None).cast("string")
    for k in order:
        err = F.col(f"_c_{k}.error")
        cols.append(F.when(ok_so_far & err.isNull(), F.col(f"_c_{k}.value").cast("string")).alias(k))
        first_err = F.coalesce(first_err, F.when(ok_so_far & err.isNotNull(), F.lit(f"invalid {k}")))
        ok_so_far = ok_so_far & err.isNull()
    return out.select(*updates.columns, *cols,
                      F.when(first_err.isNotNull(), F.lit("INVALID_ARGUMENT")).alias("error"),
                      first_err.alias("error_detail"))


def param_history(applied: DataFrame, keys=("probe",), order="seq", params=None,
                  chunk_rows: int | str | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """CTL-7: the full setting in force after each update: every parameter
    keeps its last applied value (updates are partial).  ``chunk_rows``: see
    :func:`replay_control`."""
    params = params or [c for c in applied.columns if c.startswith("filter_")]
    if chunk_rows == "auto":
        return carry_even(applied, list(keys), [order], {p: F.col(p) for p in params}, rows_per_chunk or carry.AUTO_CHUNK_ROWS, inclusive=True)
    return carry_last(applied, list(keys), [order], {p: F.col(p) for p in params},
                      chunk=chunk_of(order, chunk_rows), inclusive=True)


__all__ = ["replay_control", "latest_status", "error_level", "map_error", "dry_run_answers",
           "command_validity", "param_updates", "param_history", "names_frame"]
