"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code (plain SQL over the generated
tables) so that the correctness check compares two engines.  Shared
adapters are CTEs; :func:`with_ctes` prefixes only the ones a query uses.
"""

from __future__ import annotations

from ..specs import PROBES

U64 = "DECIMAL(20,0)"

CTE = {
    "raw_calls": """raw_calls AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns,
         CASE WHEN event_type IN ('view', 'click') THEN 'entry' ELSE 'exit' END AS kind,
         (user_id // 4 + 1) * 4294967296 + (user_id + 1) AS pid_tgid,
         k % 3 AS dev, k % 50 AS sector, user_id % 37 AS obj,
         concat('proc', CAST((user_id + k % 2) % 8 AS VARCHAR)) AS comm,
         (user_id + k) % 5 AS syscall_id, k,
         CASE WHEN event_type = 'error' THEN -1 - (k % 5) ELSE CAST(round(value * 100) AS BIGINT) END AS ret,
         concat('f', CAST(k % 10 AS VARCHAR), CASE WHEN k % 2 = 0 THEN '.log' ELSE '.txt' END) AS file,
         (event_id * 2654435761) % 4294967296 AS xid,
         k * 512 AS size, event_id * 4096 AS "offset",
         CASE k % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' WHEN 2 THEN 'GETATTR' END AS proc_name,
         event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e)""",
    "calls": """calls AS (
  SELECT l_suppkey + 1 AS pid, CAST(round(l_extendedprice * 100) AS BIGINT) AS lat,
         l_orderkey * 8 + l_linenumber AS time_stamp, CAST(round(l_quantity) AS BIGINT) AS size,
         concat(l_returnflag, l_linestatus) AS comm, p_name AS file
  FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "control_log": """control_log AS (
  SELECT o_orderkey AS seq,
         ([%s])[CAST(o_custkey %% 13 AS INTEGER) + 1] AS probe,
         CASE o_orderkey %% 4 WHEN 0 THEN 'load' WHEN 1 THEN 'unload' WHEN 2 THEN 'update' ELSE 'status' END AS op,
         CASE WHEN o_orderstatus = 'P' THEN 'fail' ELSE 'ok' END AS outcome,
         o_orderkey %% 11 = 0 AS dry_run
  FROM orders)""" % ", ".join(f"'{p}'" for p in PROBES + ["no_such_probe"]),
    "config_log": """config_log AS (
  SELECT ts_ns AS from_ns, CAST(CASE WHEN k % 3 = 0 THEN 0 ELSE (k % 150) + 1 END AS BIGINT) AS filter_pid
  FROM raw_calls WHERE event_type = 'signup')""",
}
CTE["param_log"] = """param_log AS (
  SELECT seq, 'nfs_file_read' AS probe,
         concat('{"filter_pid": ',
                CASE WHEN k % 5 = 0 THEN '"invalid"' WHEN k % 5 = 1 THEN concat('-', CAST(k AS VARCHAR))
                     WHEN k % 5 = 2 THEN concat(CAST(k AS VARCHAR), '.7') ELSE CAST(k AS VARCHAR) END,
                ', "filter_file": ',
                CASE WHEN k % 4 = 0 THEN '3' ELSE concat('"*.', CAST(k % 3 AS VARCHAR), '"') END,
                ', "filter_comm": ',
                CASE WHEN k % 7 = 0 THEN '7' ELSE concat('"proc', CAST(k % 8 AS VARCHAR), '"') END,
                '}') AS params
  FROM raw_calls WHERE event_type = 'signup')"""
CTE["tool_calls"] = """tool_calls AS (
  SELECT c.seq,
         CASE WHEN c.seq % 3 = 0 THEN 'customize' ELSE 'control' END AS tool,
         CASE WHEN o.o_custkey % 17 = 0 THEN '' ELSE c.probe END AS name,
         CASE WHEN c.seq % 5 = 4 THEN 'restart' WHEN c.seq % 3 = 0 THEN NULL ELSE c.op END AS operation,
         CASE WHEN c.seq % 3 <> 0 THEN NULL WHEN c.seq % 7 = 0 THEN '[1]' WHEN c.seq % 7 = 1 THEN NULL
              ELSE concat('{"filter_pid": ', CAST(o.o_custkey AS VARCHAR), '}') END AS params,
         c.seq % 13 <> 0 AS args_present
  FROM control_log c JOIN orders o ON o.o_orderkey = c.seq)"""
DEPS = {"config_log": ["raw_calls"], "param_log": ["raw_calls"], "tool_calls": ["control_log"]}

PARAM_COERCE = """coerced AS (
  SELECT seq, probe,
    json_type(params, '$.filter_pid') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
      AND TRY_CAST(json_extract(params, '$.filter_pid') AS DOUBLE) >= 0 AS pid_ok,
    CAST(CAST(floor(TRY_CAST(json_extract(params, '$.filter_pid') AS DOUBLE)) AS BIGINT) AS VARCHAR) AS pid_v,
    json_type(params, '$.filter_file') = 'VARCHAR' AS file_ok,
    left(json_extract_string(params, '$.filter_file'), 16) AS file_v,
    json_type(params, '$.filter_comm') = 'VARCHAR' AS comm_ok,
    left(json_extract_string(params, '$.filter_comm'), 32) AS comm_v
  FROM param_log),
applied AS (
  SELECT seq, probe,
    CASE WHEN pid_ok THEN pid_v END AS filter_pid,
    CASE WHEN pid_ok AND file_ok THEN file_v END AS filter_file,
    CASE WHEN pid_ok AND file_ok AND comm_ok THEN comm_v END AS filter_comm,
    CASE WHEN NOT (pid_ok AND file_ok AND comm_ok) THEN 'INVALID_ARGUMENT' END AS error,
    CASE WHEN NOT pid_ok THEN 'invalid filter_pid' WHEN NOT file_ok THEN 'invalid filter_file'
         WHEN NOT comm_ok THEN 'invalid filter_comm' END AS error_detail
  FROM coerced)"""


def with_ctes(sql: str, *names: str) -> str:
    order = []
    for n in names:
        for d in DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    extra = sql.strip()
    if extra.upper().startswith("WITH "):
        return "WITH " + ",\n".join(CTE[n] for n in order) + ",\n" + extra[5:]
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n" + extra


def u64(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN CAST(CAST({x} AS HUGEINT) + 18446744073709551616 AS {U64}) ELSE CAST({x} AS {U64}) END"


def ntohl(x: str) -> str:
    return (f"((({x}) & 255) << 24) | (((({x}) >> 8) & 255) << 16) | "
            f"(((({x}) >> 16) & 255) << 8) | ((({x}) >> 24) & 255)")


def lagged(src: str, key: str, extra_lag: str = "") -> str:
    return (f"lagged AS (SELECT *, lag(kind) OVER w AS pk, lag(ts_ns) OVER w AS pt{extra_lag} "
            f"FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY ts_ns, seq))")


LAT = "CASE WHEN pk = 'entry' THEN ts_ns - pt ELSE 0 END"
START = "CASE WHEN pk = 'entry' THEN pt ELSE 0 END"

RW_COLS = (f"pid_tgid >> 32 AS pid, {LAT} AS lat, ts_ns AS time_stamp, {u64('ret')} AS size, "
           "comm, file")
NFSD_RW_COLS = (f"pid_tgid AS pid, {LAT} AS lat, ts_ns AS time_stamp, "
                f"CAST(size & 4294967295 AS {U64}) AS size, {u64('\"offset\"')} AS \"offset\", "
                "xid & 4294967295 AS xid, comm")
SYSCALL_COLS = (f"pid_tgid AS pid, syscall_id & 4294967295 AS syscall_id, ret, {LAT} AS duration, "
                f"{START} AS enter_time_stamp, comm")
QS = [(0.50, "p50_latency"), (0.90, "p90_latency"), (0.95, "p95_latency"), (0.99, "p99_latency")]


def _summary_cols(c: str = "lat") -> str:
    return (f"count(*) AS total_rows, count({c}) AS non_null_latency_rows, min({c}) AS min_latency, "
            f"max({c}) AS max_latency, round(CAST(sum({c}) AS DOUBLE) / count({c}), 3) AS avg_latency, "
            + ", ".join(f"round(quantile_cont({c}, {q}), 3) AS {n}" for q, n in QS))


def _sketch_summary(src: str, keys: str = "", c: str = "lat") -> str:
    """The summary by log-linear buckets of 256 parts a power of two, of the rows of ``src``."""
    by = f"PARTITION BY {keys}" if keys else ""
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    place = "CAST(n - 1 AS DOUBLE) * CAST({q} AS DOUBLE)"

    def at(rank):
        return (f"max(CASE WHEN {rank} >= below AND {rank} < below + cnt THEN CAST(lo AS DOUBLE) + "
                f"(CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * ({rank} - below) / greatest(cnt - 1, 1) END)")

    cols = []
    for q, name in QS:
        h = place.format(q=q)
        a, b = at(f"floor({h})"), at(f"ceil({h})")
        cols.append(f"round({a} + (max({h}) - floor(max({h}))) * ({b} - {a}), 3) AS {name}")
    return f"""
SELECT {k}CAST(sum(cnt) AS BIGINT) AS total_rows, CAST(sum(cnt) AS BIGINT) AS non_null_latency_rows, min(lo) AS min_latency, max(hi) AS max_latency,
       round(CAST(sum(total) AS DOUBLE) / CAST(sum(cnt) AS DOUBLE), 3) AS avg_latency, {", ".join(cols)}
FROM (SELECT *, CAST(sum(cnt) OVER ({by}) AS BIGINT) AS n,
             CAST(coalesce(sum(cnt) OVER ({by} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below
      FROM (SELECT {k}bucket, count(*) AS cnt, min({c}) AS lo, max({c}) AS hi, sum({c}) AS total
            FROM (SELECT *, shift * 256 + (m >> CAST(shift AS INTEGER)) AS bucket
                  FROM (SELECT *, CAST({c} AS BIGINT) AS m, greatest(length(bin(CAST({c} AS BIGINT))) - 9, 0) AS shift FROM ({src}) WHERE {c} IS NOT NULL))
            GROUP BY {k}bucket)) {g}"""


def _pair(src: str, key: str, cols: str, where: str = "", extra_lag: str = "") -> str:
    cond = "kind = 'exit'" + (f" AND {where}" if where else "")
    return with_ctes(f"WITH {lagged(src, key, extra_lag)} SELECT {cols} FROM lagged WHERE {cond}", "raw_calls")


def _replay_sql() -> str:
    impl = ", ".join(f"'{p}'" for p in PROBES)
    return with_ctes(f"""
WITH k AS (
  SELECT *, probe IN ({impl}) AS has_impl, probe IN ({impl}) AS known,
         op = 'update' AND coalesce(dry_run, false) AS dry
  FROM control_log),
f AS (
  SELECT *, CASE WHEN has_impl AND op = 'load' AND outcome = 'ok' THEN true
                 WHEN known AND op = 'unload' AND outcome = 'ok' THEN false END AS flag
  FROM k),
a AS (
  SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY probe ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS att
  FROM f),
c AS (
  SELECT *,
    CASE WHEN dry THEN NULL
         WHEN op NOT IN ('load', 'unload', 'update', 'status') THEN 'INVALID_ARGUMENT'
         WHEN (op = 'load' AND NOT has_impl) OR (op <> 'load' AND NOT known) THEN 'PROBE_NOT_FOUND'
         WHEN op = 'load' AND att THEN 'PROBE_ALREADY_LOADED'
         WHEN op IN ('unload', 'update') AND NOT att THEN 'PROBE_NOT_LOADED'
         WHEN op = 'load' AND outcome <> 'ok' THEN 'PROBE_START_FAILED'
         WHEN op = 'unload' AND outcome <> 'ok' THEN 'PROBE_STOP_FAILED'
         WHEN op = 'update' AND outcome <> 'ok' THEN 'PROBE_UPDATE_FAILED' END AS code,
    NOT dry AND known AND ((op = 'load' AND has_impl AND NOT att) OR (op IN ('unload', 'update') AND att)) AS executed
  FROM a),
w AS (
  SELECT *,
    CASE WHEN executed AND outcome <> 'ok' THEN 'error'
         WHEN executed AND op IN ('load', 'update') THEN 'loaded'
         WHEN executed AND op = 'unload' THEN 'unloaded' END AS sw,
    CASE WHEN executed THEN coalesce(code, '') END AS ew
  FROM c),
s AS (
  SELECT *,
    last_value(sw IGNORE NULLS) OVER (PARTITION BY probe ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st,
    last_value(ew IGNORE NULLS) OVER (PARTITION BY probe ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS er
  FROM w),
replayed AS (
  SELECT seq, probe, op, outcome, coalesce(dry_run, false) AS dry_run, att AS attached_before, code,
         CASE WHEN known THEN coalesce(st, 'unloaded') END AS state,
         CASE WHEN known THEN nullif(er, '') END AS last_error,
         CASE WHEN known THEN coalesce(st, 'unloaded') = 'loaded' END AS loaded,
         CASE WHEN code IN ('PROBE_STOP_FAILED', 'PROBE_UPDATE_FAILED') THEN true
              ELSE CASE WHEN known THEN coalesce(st, 'unloaded') = 'loaded' END END AS reply_loaded
  FROM s)
""", "control_log")


def _latest_status_sql() -> str:
    return (_replay_sql() + """,
latest AS (
  SELECT probe, state, last_error FROM replayed WHERE state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY probe ORDER BY seq DESC) = 1)
""")


# Catalogue titles/layers/levels of the shipped YAML files.
CATALOG_ROWS = [
    ("block_io_latency", "Block I/O", "Disk", "L1"),
    ("nfs_file_read", "NFS client file read", "nfs-client", "L2"),
    ("nfs_file_write", "NFS client file write", "nfs-client", "L2"),
    ("nfs_getattr", "NFS client attribute read", "nfs-client", "L2"),
    ("nfs_setattr", "NFS client attribute change", "nfs-client", "L2"),
    ("nfsd4_access", "NFS server access check", "nfsd", "L2"),
    ("nfsd4_getattr", "NFS server attribute read", "nfsd", "L2"),
    ("nfsd4_read", "NFS server read", "nfsd", "L2"),
    ("nfsd4_write", "NFS server write", "nfsd", "L2"),
    ("rpc_task_latency", "RPC client task", "RPC", "L2"),
    ("svc_rqst_latency", "RPC server request", "SVC", "L2"),
    ("sys_call_trace", "System calls", "Sys-call", "L1"),
]

ASOF = """cfg AS (SELECT * FROM config_log),
ev AS (SELECT * FROM raw_calls WHERE event_type <> 'signup'),
j AS (SELECT ev.*, cfg.filter_pid AS fp FROM ev ASOF LEFT JOIN cfg ON ev.ts_ns >= cfg.from_ns)"""


def _error_chain_sql() -> str:
    """Chains of up to three errors: the outermost code wins, then the first known message."""
    from ..operators.control import BASE_ERROR_CODES, ERROR_LEVELS
    codes = ", ".join(f"'{c}'" for c, _ in ERROR_LEVELS)
    known = ", ".join(f"('{m}', '{c}')" for m, c in BASE_ERROR_CODES)
    messages = ", ".join(f"'{m}'" for m, _ in BASE_ERROR_CODES)
    n, m = len(ERROR_LEVELS), len(BASE_ERROR_CODES)
    return f"""
WITH base(message, code) AS (VALUES {known}),
c AS (SELECT o_orderkey AS seq, e.i AS i,
             CASE WHEN (o_custkey + e.i) % 4 = 0 THEN ([{codes}])[CAST((o_orderkey + e.i) % {n} + 1 AS INT)] END AS code,
             CASE WHEN (o_orderkey + e.i) % 3 = 0 THEN 'wrapped' ELSE ([{messages}])[CAST((o_custkey + e.i) % {m} + 1 AS INT)] END AS message
      FROM orders CROSS JOIN (VALUES (0), (1), (2)) e(i) WHERE e.i < o_orderkey % 4)
SELECT o.o_orderkey AS seq, CASE WHEN o.o_orderkey % 4 > 0 THEN coalesce(
    (SELECT min_by(c.code, c.i) FROM c WHERE c.seq = o.o_orderkey AND c.code IS NOT NULL),
    (SELECT min_by(b.code, c.i) FROM c JOIN base b ON b.message = c.message WHERE c.seq = o.o_orderkey), 'RUNTIME_FAILURE') END AS code
FROM orders o"""


def oracle_sql() -> dict[str, str]:
    calls = lambda s: with_ctes(s, "calls")
    q = {}
    q["latency_summary"] = calls(f"SELECT {_summary_cols()} FROM calls WHERE lat IS NOT NULL")
    q["latency_summary_by_comm"] = calls(
        f"SELECT comm, {_summary_cols()} FROM calls WHERE lat IS NOT NULL GROUP BY comm")
    q["value_summary"] = q["value_summary_radix"] = f"SELECT {_summary_cols('value')} FROM (SELECT value / 7 AS value FROM events) WHERE value IS NOT NULL"
    q["value_summary_by_type_radix"] = f"SELECT event_type, {_summary_cols('value')} FROM (SELECT event_type, value / 7 AS value FROM events) WHERE value IS NOT NULL GROUP BY event_type"
    q["latency_summary_approx"] = calls(_sketch_summary("SELECT * FROM calls"))
    q["latency_summary_by_comm_approx"] = calls(_sketch_summary("SELECT * FROM calls", "comm"))
    q["approx_error"] = calls(
        f"SELECT comm, true AS within, {', '.join(f'round(quantile_cont(lat, {x}), 3) AS {n}' for x, n in QS)} FROM calls WHERE lat IS NOT NULL GROUP BY comm")
    q["latency_summary_hot_and_many"] = calls(
        f"SELECT CASE WHEN pid % 2 = 0 THEN 0 ELSE time_stamp // 8 + 1 END AS grp, {_summary_cols()} FROM calls WHERE lat IS NOT NULL GROUP BY 1")
    q["p99_row"] = calls(
        "SELECT * FROM calls WHERE lat >= (SELECT quantile_cont(lat, 0.99) FROM calls WHERE lat IS NOT NULL) "
        "ORDER BY lat, time_stamp, pid, size, comm, file LIMIT 1")
    q["top_keys"] = calls("SELECT pid, count(*) AS cnt FROM calls GROUP BY pid ORDER BY cnt DESC, pid LIMIT 10")
    q["latest_rows"] = calls(
        "SELECT comm, pid, time_stamp FROM calls ORDER BY time_stamp DESC, comm, pid LIMIT 5")
    q["count_where"] = calls(
        "SELECT count(*) AS total, count_if(comm = 'NO') AS comm_rows, count_if(pid = 42) AS pid_rows, "
        "count_if(pid <> 42) AS other_pid_rows FROM calls")
    q["filter_comm"] = calls("SELECT * FROM calls WHERE comm = 'RF'")
    q["filter_file_suffix"] = calls("SELECT * FROM calls WHERE suffix(file, 'anvil')")
    q["filter_file_qmark"] = calls("SELECT * FROM calls WHERE file LIKE 'blue b___'")
    q["filter_delta"] = calls(
        "SELECT comm, count_if(time_stamp < 240000) AS before, count_if(time_stamp >= 240000) AS after, "
        "count_if(time_stamp >= 240000) - count_if(time_stamp < 240000) AS increase FROM calls GROUP BY comm")
    q["filter_leak"] = calls(
        "SELECT count_if(pid = 42) AS target_rows, count_if(pid <> 42) AS other_rows, "
        "count_if(pid <> 42) > 10 * count_if(pid = 42) AS leak FROM calls")

    raw = lambda s: with_ctes(s, "raw_calls")
    q["pid_of_tid_of"] = raw("SELECT seq, pid_tgid >> 32 AS pid, pid_tgid & 4294967295 AS tid FROM raw_calls")
    q["xid_swap"] = raw(f"SELECT seq, xid, {ntohl('xid')} AS xid_host FROM raw_calls")
    q["size_as_u64"] = raw(f"SELECT seq, ret, {u64('ret')} AS size FROM raw_calls")
    q["pair_rw"] = _pair("raw_calls", "pid_tgid", RW_COLS)
    q["pair_attr"] = _pair("raw_calls", "pid_tgid",
                           f"pid_tgid >> 32 AS pid, {LAT} AS lat, ts_ns AS time_stamp, ret, comm, file",
                           "pk = 'entry'")
    q["pair_setattr"] = _pair("raw_calls", "pid_tgid",
                              f"pid_tgid >> 32 AS pid, {LAT} AS lat, ts_ns AS time_stamp, ret, comm",
                              "pk = 'entry'")
    q["pair_nfsd"] = _pair("raw_calls", "pid_tgid", NFSD_RW_COLS)
    q["pair_nfsd_meta"] = _pair("raw_calls", "pid_tgid",
                                f"pid_tgid AS pid, {LAT} AS lat, ts_ns AS time_stamp, "
                                "xid & 4294967295 AS xid, comm")
    q["pair_syscall"] = _pair("raw_calls", "pid_tgid", SYSCALL_COLS)
    q["pair_block_io"] = _pair("raw_calls", "dev, sector",
                               f"pid_tgid >> 32 AS pid, {LAT} AS latency, ts_ns AS time_stamp, comm",
                               "pk = 'entry'")
    q["pair_rpc"] = _pair("raw_calls", "obj",
                          f"ppid >> 32 AS pid, {ntohl('xid')} AS xid, coalesce(proc_name, '') AS proc_name, "
                          f"{LAT} AS latency, {START} AS start_timestamp, CAST(ret AS INTEGER) AS status",
                          "pk = 'entry'", ", lag(pid_tgid) OVER w AS ppid")
    q["pair_svc"] = _pair("raw_calls", "obj",
                          f"{ntohl('xid')} AS xid, {LAT} AS latency, {START} AS start_timestamp",
                          "pk = 'entry'")
    filt_ref = "filtered AS (SELECT * FROM raw_calls WHERE kind = 'exit' OR comm = 'proc3')"
    q["pair_rw_filtered_reference"] = with_ctes(
        f"WITH {filt_ref}, {lagged('filtered', 'pid_tgid')} SELECT {RW_COLS} FROM lagged "
        "WHERE kind = 'exit' AND suffix(file, '.log')", "raw_calls")
    q["pair_rw_filtered_strict"] = with_ctes(
        f"WITH {filt_ref}, {lagged('filtered', 'pid_tgid')} SELECT {RW_COLS} FROM lagged "
        "WHERE kind = 'exit' AND suffix(file, '.log') AND comm = 'proc3'", "raw_calls")
    q["pair_getattr_filtered"] = with_ctes(
        f"WITH filtered AS (SELECT * FROM raw_calls WHERE kind = 'exit' OR (pid_tgid >> 32) % 3 = 1), "
        f"{lagged('filtered', 'pid_tgid')} SELECT pid_tgid >> 32 AS pid, {LAT} AS lat, ts_ns AS time_stamp, "
        "ret, comm, file FROM lagged WHERE kind = 'exit' AND pk = 'entry' AND file = 'f4.log'", "raw_calls")
    q["pair_syscall_filtered"] = with_ctes(
        "WITH filtered AS (SELECT * FROM raw_calls WHERE syscall_id = 2 AND comm = 'proc2'), "
        f"{lagged('filtered', 'pid_tgid')} SELECT {SYSCALL_COLS} FROM lagged WHERE kind = 'exit'", "raw_calls")
    q["pair_syscall_pid_filter"] = with_ctes(
        "WITH filtered AS (SELECT * FROM raw_calls WHERE (pid_tgid >> 32) = 8), "
        f"{lagged('filtered', 'pid_tgid')} SELECT {SYSCALL_COLS} FROM lagged WHERE kind = 'exit'", "raw_calls")
    q["pair_nfsd_pid_filter"] = with_ctes(
        f"WITH filtered AS (SELECT * FROM raw_calls WHERE kind = 'exit' OR pid_tgid = {(2 << 32) | 8}), "
        f"{lagged('filtered', 'pid_tgid')} SELECT {NFSD_RW_COLS} FROM lagged WHERE kind = 'exit'", "raw_calls")
    q["filter_leak_syscall"] = with_ctes(
        f"WITH {lagged('raw_calls', 'pid_tgid')}, t AS (SELECT {SYSCALL_COLS} FROM lagged WHERE kind = 'exit') "
        "SELECT count_if((pid >> 32) = 8) AS target_rows, count_if((pid >> 32) <> 8) AS other_rows, "
        "count_if((pid >> 32) <> 8) > 10 * count_if((pid >> 32) = 8) AS leak FROM t", "raw_calls")
    q["row_validity"] = with_ctes(
        f"WITH {lagged('raw_calls', 'pid_tgid')}, t AS (SELECT {SYSCALL_COLS} FROM lagged WHERE kind = 'exit') "
        "SELECT count(*) AS rows, count_if(pid = 0) AS zero_pid, count_if(coalesce(comm, '') = '') AS empty_comm, "
        "count_if(enter_time_stamp = 0) AS zero_stamp, "
        "count_if(pid = 0 OR coalesce(comm, '') = '' OR enter_time_stamp = 0) AS invalid_rows FROM t",
        "raw_calls")
    q["top_syscalls"] = with_ctes(
        f"WITH {lagged('raw_calls', 'pid_tgid')}, t AS (SELECT {SYSCALL_COLS} FROM lagged WHERE kind = 'exit') "
        "SELECT syscall_id, count(*) AS cnt FROM t GROUP BY syscall_id ORDER BY cnt DESC, syscall_id LIMIT 10",
        "raw_calls")
    q["trigger_vs_written"] = with_ctes(
        f"WITH {lagged('raw_calls', 'pid_tgid')}, "
        "h AS (SELECT count(*) AS hits FROM raw_calls), "
        "wr AS (SELECT count_if(kind = 'exit') AS rw, count_if(kind = 'exit' AND pk = 'entry') AS ga FROM lagged) "
        "SELECT 'nfs_file_read' AS probe, hits, rw AS written, round(rw / hits, 6) AS written_per_hit FROM h, wr "
        "UNION ALL SELECT 'nfs_getattr', hits, ga, round(ga / hits, 6) FROM h, wr", "raw_calls")
    parts = ", ".join(
        f"{p} AS (SELECT from_ns, arg_max({p}, seq) AS {p} FROM pcfg WHERE {p} IS NOT NULL GROUP BY from_ns)" for p in ("filter_pid", "filter_comm"))
    q["config_asof_partial"] = q["config_asof_partial_large"] = with_ctes(
        "WITH pcfg AS (SELECT ts_ns - ts_ns % 600000000000 AS from_ns, seq, CASE WHEN k % 3 <> 0 THEN CAST(k % 150 + 1 AS BIGINT) END AS filter_pid, "
        "CASE WHEN k % 4 <> 1 THEN concat('proc', CAST(k % 8 AS VARCHAR)) END AS filter_comm FROM raw_calls WHERE event_type = 'signup'), "
        f"{parts}, ev AS (SELECT * FROM raw_calls WHERE event_type <> 'signup') "
        "SELECT ev.seq, ev.ts_ns, p.filter_pid, c.filter_comm FROM ev ASOF LEFT JOIN filter_pid p ON ev.ts_ns >= p.from_ns "
        "ASOF LEFT JOIN filter_comm c ON ev.ts_ns >= c.from_ns", "raw_calls")
    q["config_asof"] = with_ctes(
        f"WITH {ASOF} SELECT seq, ts_ns, kind, fp AS filter_pid FROM j", "config_log")
    q["pair_rw_asof"] = with_ctes(
        f"WITH {ASOF}, f AS (SELECT * FROM j WHERE kind = 'exit' OR fp IS NULL OR fp = 0 OR (pid_tgid >> 32) = fp), "
        f"{lagged('f', 'pid_tgid')} SELECT {RW_COLS} FROM lagged WHERE kind = 'exit'", "config_log")
    q["replay_control"] = _replay_sql() + " SELECT * FROM replayed"
    q["latest_status"] = (_latest_status_sql()
                          + " SELECT probe, state, state = 'loaded' AS loaded, last_error FROM latest")
    cat_values = ", ".join(f"('{t}', '{ti}', '{la}', '{le}')" for t, ti, la, le in CATALOG_ROWS)
    q["catalog_status"] = (
        _latest_status_sql()
        + f", cat(type, title, layer, level) AS (VALUES {cat_values}) "
        "SELECT cat.type, title, layer, level, coalesce(latest.state, 'unloaded') AS state, "
        "coalesce(latest.state = 'loaded', false) AS loaded, latest.last_error, "
        "(SELECT count(*) FROM cat) AS count "
        "FROM cat LEFT JOIN latest ON latest.probe = cat.type ORDER BY cat.type")
    q["error_level"] = (
        _replay_sql()
        + " SELECT seq, code, CASE WHEN code IS NULL THEN NULL "
        "WHEN code IN ('INVALID_ARGUMENT', 'MISSING_ARGUMENT', 'PERMISSION_DENIED', 'QUOTA_EXCEEDED', "
        "'PROBE_NOT_FOUND', 'PROBE_NOT_LOADED', 'PROBE_ALREADY_LOADED', 'INVALID_CONFIG', 'CONFLICT') "
        "THEN 'WARN' ELSE 'ERROR' END AS level FROM replayed")
    q["dry_run_answers"] = with_ctes(
        "SELECT seq, probe, true AS accepted, 'dry run' AS reason, 'unchanged' AS new_state "
        "FROM control_log WHERE dry_run AND op = 'update'", "control_log")
    impl = ", ".join(f"'{p}'" for p in PROBES)
    q["missing_implementation"] = with_ctes(
        f"SELECT DISTINCT probe AS type FROM control_log WHERE probe NOT IN ({impl})", "control_log")
    q["all_probe_names"] = with_ctes(
        f"SELECT probe AS name FROM control_log UNION SELECT unnest([{impl}]) AS name", "control_log")
    q["decode_samples"] = q["pair_rw"]
    q["decode_samples_syscall"] = q["pair_syscall"]
    q["latency_summary_by_comm_radix"] = q["latency_summary_by_comm"]
    q["latency_summary_radix"] = q["latency_summary"]
    q["syscall_duration_ms_summary"] = with_ctes(
        f"WITH {lagged('raw_calls', 'pid_tgid')}, t AS (SELECT ({LAT}) // 1000000 AS duration_ms "
        "FROM lagged WHERE kind = 'exit') "
        f"SELECT {_summary_cols('duration_ms')} "
        "FROM t WHERE duration_ms IS NOT NULL", "raw_calls")
    q["block_io_summary_ms_by_comm"] = with_ctes(
        f"WITH {lagged('raw_calls', 'dev, sector')}, t AS (SELECT ({LAT}) // 1000000 AS latency_ms, comm "
        "FROM lagged WHERE kind = 'exit' AND pk = 'entry') "
        f"SELECT comm, {_summary_cols('latency_ms')} "
        "FROM t WHERE latency_ms IS NOT NULL GROUP BY comm", "raw_calls")
    q["outcome_counts"] = with_ctes(
        f"WITH {lagged('raw_calls', 'pid_tgid')}, t AS (SELECT {SYSCALL_COLS} FROM lagged WHERE kind = 'exit') "
        "SELECT CASE WHEN ret < 0 THEN 'error' ELSE 'ok' END AS outcome, count(*) AS cnt FROM t GROUP BY 1",
        "raw_calls")
    q["param_updates"] = with_ctes(
        f"WITH {PARAM_COERCE} SELECT seq, filter_pid, filter_file, filter_comm, error, error_detail FROM applied",
        "param_log")
    q["param_history"] = with_ctes(
        f"WITH {PARAM_COERCE} SELECT seq, "
        + ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY probe ORDER BY seq ROWS BETWEEN "
                    f"UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("filter_pid", "filter_file", "filter_comm"))
        + " FROM applied", "param_log")
    q["status_report"] = (
        _latest_status_sql()
        + " SELECT probe, CASE WHEN last_error IS NULL "
        "THEN json_object('state', state, 'loaded', state = 'loaded') "
        "ELSE json_object('state', state, 'loaded', state = 'loaded', 'last_error', last_error) END::VARCHAR "
        "AS report FROM latest")
    q["command_validity"] = with_ctes(
        "SELECT seq, tool, CASE WHEN tool = 'control' THEN "
        "CASE WHEN NOT args_present THEN 'arguments are required' "
        "WHEN coalesce(name, '') = '' THEN 'probeName must be a non-empty string' "
        "WHEN operation IS NULL THEN 'operation must be a string' "
        "WHEN operation NOT IN ('load', 'unload', 'status') THEN 'operation must be one of load|unload|status' END "
        "ELSE CASE WHEN NOT args_present THEN 'arguments are required' "
        "WHEN coalesce(name, '') = '' THEN 'name must be a non-empty string' "
        "WHEN coalesce(json_type(params) = 'OBJECT', false) = false THEN 'params must be an object' END END AS error "
        "FROM tool_calls", "tool_calls")
    sizes = f"SELECT comm, size, CAST(size AS DOUBLE) AS x FROM ({q['pair_rw']}) WHERE size < 9000000000000000000"
    of_size = _summary_cols("x").replace("min(x)", "min(size)").replace("max(x)", "max(size)")
    q["size_summary"] = q["size_summary_radix"] = f"SELECT {of_size} FROM ({sizes})"
    q["size_summary_by_comm_radix"] = f"SELECT comm, {of_size} FROM ({sizes}) GROUP BY comm"
    q["error_chain_codes"] = _error_chain_sql()
    q["status_live_over_remembered"] = f"""
WITH a AS (SELECT * FROM ({q['latest_status']})),
r AS (SELECT * FROM ({q['latest_status'].replace("FROM control_log)", "FROM control_log WHERE seq % 3 = 0)")}))
SELECT coalesce(l.probe, r.probe) AS probe, CASE WHEN l.probe IS NOT NULL THEN l.state ELSE r.state END AS state,
       CASE WHEN l.probe IS NOT NULL THEN l.loaded ELSE r.loaded END AS loaded, CASE WHEN l.probe IS NOT NULL THEN l.last_error ELSE r.last_error END AS last_error
FROM r FULL JOIN (SELECT * FROM a WHERE loaded) l ON l.probe = r.probe"""
    q["described_once"] = """
SELECT type, source_file, pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY type ORDER BY source_file DESC, pos DESC) AS n FROM (
    SELECT concat('probe', CAST(o_custkey % 500 AS VARCHAR)) AS type, concat('file', CAST(o_orderkey % 7 AS VARCHAR), '.yaml') AS source_file,
           o_orderkey AS pos, concat('title ', CAST(o_orderkey AS VARCHAR)) AS title FROM orders) c) WHERE n = 1"""
    q["catalog_gaps"] = """
WITH c AS (SELECT o_orderkey AS k, o_custkey AS u FROM orders),
i AS (SELECT concat('probe', CAST(k AS VARCHAR)) AS type, list_filter([
    CASE WHEN k % 5 = 0 THEN 'title' END, CASE WHEN k % 7 = 0 THEN 'layer' END, CASE WHEN u % 11 = 0 THEN 'risks' END,
    CASE WHEN k % 13 = 0 THEN 'entrypoints' END, CASE WHEN k % 13 <> 0 AND k % 6 = 0 THEN 'entrypoint' END,
    CASE WHEN u % 9 = 0 THEN 'param.name' END, CASE WHEN u % 4 = 0 THEN 'param.description' END,
    CASE WHEN u % 17 = 0 THEN 'outputs' END, CASE WHEN u % 17 <> 0 AND k % 10 = 0 THEN 'output.type' END], lambda x: x IS NOT NULL) AS issues FROM c)
SELECT type, array_to_string(issues, ',') AS issues, len(issues) = 0 AS ok FROM i"""
    q["pair_rw_chunked"] = q["pair_rw_chunked_by_time"] = q["pair_rw"]
    q["pair_rw_single_window"] = q["pair_rw"]
    q["sample_rows_members"] = f"SELECT least(count(*), 5) AS sampled, least(count(*), 5) AS members FROM ({q['pair_syscall']})"
    q["pair_block_io_chunked"] = q["pair_block_io"]
    q["replay_control_chunked"] = q["replay_control"]
    q["pair_rw_asof_large_config"] = q["pair_rw_asof"]
    return q
