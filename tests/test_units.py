"""Scalars, decoding, parameter coercion, catalogue and quantile operators."""

import json
import math
import os
import random
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelat.functions.scalars import as_s64, as_u64, cstr, ntohl, pid_of, tid_of
from tracelat.operators.catalog import (catalog_integrity, catalog_outputs, catalog_params,
                                        dedupe_catalog, schema_conformance)
from tracelat.operators.control import (command_validity, error_level, map_error, param_history,
                                        param_updates)
from tracelat.operators.quantiles import exact_quantiles
from tracelat.operators.stats import latency_summary, p99_row
from tracelat.sources.catalog_yaml import scan_catalog
from tracelat.sources.decode import LAYOUTS, decode_samples
from tracelat.specs import PROBES, SPECS


def test_scalars(spark):
    df = spark.createDataFrame([((7 << 32) | 9, 0x11223344, -5, "ab\u0000cd", "abcdefghijklmnopqrstuvwxyz")],
                               "p long, x long, r long, s string, t string")
    r = df.select(pid_of("p").alias("pid"), tid_of("p").alias("tid"), ntohl("x").alias("x"),
                  as_u64("r").alias("u"), as_s64(as_u64("r")).alias("back"),
                  cstr("s", 16).alias("s"), cstr("t", 16).alias("t"),
                  cstr("t", 32, kernel_name=True).alias("k")).first()
    assert (r.pid, r.tid, r.x) == (7, 9, 0x44332211)
    assert int(r.u) == 2 ** 64 - 5 and r.back == -5
    assert r.s == "ab" and r.t == "abcdefghijklmno" and r.k == "abcdefghijklmno"


def _pack_sys(pid, sid, ret, dur, enter, comm):
    return struct.pack("<QI4xqQQ16s", pid, sid, ret, dur, enter, comm.encode())


def test_decode_samples_edge_cases(spark):
    good = _pack_sys((5 << 32) | 6, 3, -2, 2 ** 63 + 1, 10, "bash")
    extra = good + b"\xff" * 7                     # trailing bytes ignored
    short = good[:55]                              # too short: dropped
    assert len(good) == LAYOUTS["sys_call_trace"][1]
    df = spark.createDataFrame([(bytearray(good),), (bytearray(extra),), (bytearray(short),)], "sample binary")
    rows = decode_samples(df, "sys_call_trace").collect()
    assert len(rows) == 2
    r = rows[0]
    assert r.pid == (5 << 32) | 6 and r.syscall_id == 3 and r.ret == -2 and r.comm == "bash"
    assert r.enter_time_stamp == 10
    # full-range unsigned size survives in the read/write layout
    rec = struct.pack("<I4xQQQ32s16s", 42, 1, 2, 2 ** 64 - 5, b"cat", b"f.log")
    rw = decode_samples(spark.createDataFrame([(bytearray(rec),)], "sample binary"), "nfs_file_read").first()
    assert int(rw["size"]) == 2 ** 64 - 5 and rw.pid == 42 and rw.file == "f.log"


def test_decode_schema_matches_spec(spark):
    empty = spark.createDataFrame([], "sample binary")
    for p in PROBES:
        assert decode_samples(empty, p).schema == SPECS[p].schema


def test_param_coercion(spark):
    ups = spark.createDataFrame([
        (1, json.dumps({"filter_pid": 1234})),
        (2, json.dumps({"filter_pid": "invalid_string"})),
        (3, json.dumps({"filter_pid": -1})),
        (4, json.dumps({"filter_pid": 12.7, "filter_file": "*.log", "filter_comm": "nginx"})),
        (5, json.dumps({"filter_pid": 5678, "filter_file": 3, "filter_comm": "testapp"})),
        (6, json.dumps({"filter_comm": "x" * 40})),
    ], "seq long, params string")
    r = {x.seq: x for x in param_updates(ups, "nfs_file_read").collect()}
    assert r[1].filter_pid == "1234" and r[1].error is None
    assert r[2].filter_pid is None and r[2].error == "INVALID_ARGUMENT"
    assert r[3].error == "INVALID_ARGUMENT"
    assert (r[4].filter_pid, r[4].filter_file, r[4].filter_comm) == ("12", "*.log", "nginx")
    # a bad later key leaves the earlier ones applied
    assert (r[5].filter_pid, r[5].filter_file, r[5].filter_comm) == ("5678", None, None)
    assert r[5].error == "INVALID_ARGUMENT"
    assert r[6].filter_comm == "x" * 32
    s = {x.seq: x for x in param_updates(
        spark.createDataFrame([(1, json.dumps({"filter_syscall_id": 4294967298}))], "seq long, params string"),
        "sys_call_trace").collect()}
    assert s[1].filter_syscall_id == "2"
    hist = param_history(param_updates(ups, "nfs_file_read").withColumn("probe", F.lit("p")))
    last = {x.seq: x for x in hist.collect()}[6]
    assert (last.filter_pid, last.filter_file, last.filter_comm) == ("5678", "*.log", "x" * 32)


def test_error_mapping(spark):
    df = spark.createDataFrame([("PROBE_NOT_FOUND",), ("PROBE_STOP_FAILED",), ("WHATEVER",), (None,)], "code string")
    assert [r.level for r in error_level(df).collect()] == ["WARN", "ERROR", "ERROR", None]
    chains = spark.createDataFrame([
        ([{"code": None, "message": "probe not loaded"}],),
        ([{"code": "PROBE_UPDATE_FAILED", "message": "update probe x"}, {"code": "INVALID_ARGUMENT", "message": "y"}],),
        ([{"code": None, "message": "boom"}],),
    ], "errors array<struct<code:string,message:string>>")
    assert [r.code for r in map_error(chains).collect()] == ["PROBE_NOT_LOADED", "PROBE_UPDATE_FAILED",
                                                             "RUNTIME_FAILURE"]


def test_command_validity(spark):
    df = spark.createDataFrame([
        ("control", "nfs_file_read", "load", None, True),
        ("control", "nfs_file_read", "restart", None, True),
        ("control", "", "load", None, True),
        ("control", "x", None, None, True),
        ("customize", "nfs_file_read", None, '{"filter_pid": 1}', True),
        ("customize", "nfs_file_read", None, '[1]', True),
        ("customize", "nfs_file_read", None, None, True),
        ("customize", None, None, None, False),
    ], "tool string, name string, operation string, params string, args_present boolean")
    errs = [r.error for r in command_validity(df).collect()]
    assert errs[0] is None and errs[4] is None
    assert errs[1] == "operation must be one of load|unload|status"
    assert errs[2] == "probeName must be a non-empty string"
    assert errs[3] == "operation must be a string"
    assert errs[5] == errs[6] == "params must be an object"
    assert errs[7] == "arguments are required"


def test_catalog(spark):
    cat = scan_catalog(spark)
    assert sorted(r.type for r in cat.collect()) == PROBES
    bad = [r for r in catalog_integrity(cat).collect() if not r.ok]
    assert bad == []
    assert catalog_params(cat).where("type = 'svc_rqst_latency'").count() == 0
    assert catalog_outputs(cat).count() == sum(len(s.columns) for s in SPECS.values())
    empty = spark.createDataFrame([], SPECS["nfs_file_read"].schema)
    for p in PROBES:
        r = schema_conformance(spark.createDataFrame([], SPECS[p].schema), cat, p).first()
        assert r.missing == [] and r.extra == [], p
    r = schema_conformance(empty.withColumnRenamed("lat", "lat_ns"), cat, "nfs_file_read").first()
    assert r.missing == ["lat"] and r.extra == ["lat_ns"]


def test_catalog_dedupe_and_skips(spark):
    d = tempfile.mkdtemp(prefix="tracelat-cat-")
    os.mkdir(os.path.join(d, "sub.yaml"))
    with open(os.path.join(d, "a.yaml"), "w") as f:
        f.write("probes:\n  - type: p1\n    title: first\n  - type: ''\n    title: skipped\n")
    with open(os.path.join(d, "b.yml"), "w") as f:
        f.write("probes:\n  - type: p1\n    title: second\n  - type: p1\n    title: third\n")
    with open(os.path.join(d, "c.txt"), "w") as f:
        f.write("probes:\n  - type: p9\n")
    cat = scan_catalog(spark, d)
    assert cat.count() == 3
    rows = dedupe_catalog(cat).collect()
    assert [(r.type, r.title) for r in rows] == [("p1", "third")]


def _np_quantile(v, q):
    return float(np.quantile(np.asarray(v, dtype=np.float64), q, method="linear"))


@pytest.mark.parametrize("kind", ["uniform", "skewed", "wide", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = random.Random(3)
    if kind == "uniform":
        v = [rng.randint(0, 10 ** 7) for _ in range(5000)]
    elif kind == "skewed":   # one value holds a third of the rows
        v = [123456] * 2000 + [rng.randint(0, 10 ** 9) for _ in range(4000)]
    elif kind == "wide":
        v = [rng.randint(-2 ** 62, 2 ** 62) for _ in range(3000)]
    else:
        v = [5]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v long")
    qs = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    n, got = exact_quantiles(df, "v", qs, small_rows=0)
    assert n == len(v)
    srt = sorted(v)
    for q, g in zip(qs, got):
        h = (n - 1) * q
        lo, hi = int(np.floor(h)), int(np.ceil(h))
        want = srt[lo] + (h - lo) * (srt[hi] - srt[lo])
        assert abs(g - want) <= max(1e-9 * abs(want), 1e-6), (q, g, want)


def test_quantiles_of_decimals_and_doubles(spark):
    """By keys in the same order: negative, huge and tiny values, both zeros, unsigned 64-bit sizes, decimals with a scale."""
    import random
    from decimal import Decimal

    from tracelat.operators.quantiles import exact_quantiles, exact_quantiles_by
    rng = random.Random(3)
    doubles = [rng.choice([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 5e-324, rng.uniform(-1, 1), rng.gauss(0, 1e9)]) for _ in range(700)]
    sizes = [Decimal(rng.choice([0, 4096, 2**64 - 1 - rng.randrange(9), rng.randrange(2**64)])) for _ in range(700)]
    prices = [Decimal(rng.randrange(-10**9, 10**9)).scaleb(-2) for _ in range(700)]
    rows = [(rng.choice(["a", "b", None]), *r) for r in zip(doubles, sizes, prices)] + [("c", None, None, None)]
    df = spark.createDataFrame(rows, "k string, d double, u decimal(20,0), p decimal(12,2)").repartition(3)
    qs = [0.0, 0.25, 0.5, 0.77, 1.0]

    def plain(values):
        values = sorted(values)
        out = []
        for q in qs:
            h = (len(values) - 1) * q
            lo, hi = values[math.floor(h)], values[math.ceil(h)]
            out.append(float(lo) if math.floor(h) == math.ceil(h) else float(lo) + (h - math.floor(h)) * (float(hi) - float(lo)))
        return out

    for i, col in enumerate(("d", "u", "p"), 1):
        values = [r[i] for r in rows if r[i] is not None]
        for small in (0, 1000):
            stats = {}
            assert exact_quantiles(df, col, qs, small_rows=small, stats=stats) == (700, plain(values))
            assert (stats["min"], stats["max"]) == (min(values), max(values)) and math.isclose(float(stats["sum"]), float(sum(values)), rel_tol=1e-9)
        got = {r.k: r for r in exact_quantiles_by(df, "k", col, qs, nbuckets=64 if col == "p" else None).collect()}
        for k in ("a", "b", None):
            mine = [r[i] for r in rows if r[0] == k and r[i] is not None]
            assert np.allclose([got[k][f"q{j}"] for j in range(len(qs))], plain(mine), rtol=1e-12, atol=0) and got[k].n == len(mine)
            assert (got[k]["min"], got[k]["max"]) == (min(mine), max(mine))
    with pytest.raises(TypeError, match="no quantiles"):
        exact_quantiles(df, "k", qs)


def test_summary_methods_agree(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.randint(0, 10 ** 6),) for _ in range(3000)], "lat long")
    a = latency_summary(df, "lat", "exact").first().asDict()
    b = latency_summary(df, "lat", "percentile").first().asDict()
    assert a == b
    row = p99_row(df, "lat").first()
    assert row.lat >= a["p99_latency"]
    with pytest.raises(ValueError, match="latency column not found"):
        latency_summary(df, "nope")


def test_grouped_exact_quantiles_with_hot_group(spark):
    rng = random.Random(21)
    rows = [("hot", rng.randint(0, 10 ** 9)) for _ in range(3000)]          # a third of the rows
    rows += [("hot", 777)] * 500                                             # ties inside it
    rows += [(f"g{rng.randint(0, 40)}", rng.randint(-10 ** 6, 10 ** 12)) for _ in range(6000)]
    rows += [("single", 5)]
    df = spark.createDataFrame(rows + [("hot", None)], "k string, lat long")
    from tracelat.operators.stats import latency_summary_by
    a = {r.k: r.asDict() for r in latency_summary_by(df, "lat", "k", method="exact").collect()}
    b = {r.k: r.asDict() for r in latency_summary_by(df, "lat", "k", method="percentile").collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            assert (v == w) or abs(v - w) <= 1e-6 * max(1.0, abs(w)), (k, c, v, w)


def test_approx_summary_close_to_exact(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.randint(0, 10 ** 6),) for _ in range(5000)], "lat long")
    a = latency_summary(df, "lat", "approx").first().asDict()
    e = latency_summary(df, "lat", "exact").first().asDict()
    for k in ("p50_latency", "p90_latency", "p95_latency", "p99_latency"):
        assert abs(a[k] - e[k]) <= 0.002 * 10 ** 6, k


def test_table_exists_and_status_precedence(spark):
    from tracelat.operators.catalog import status_precedence, table_exists
    d = tempfile.mkdtemp(prefix="tracelat-exists-")
    assert table_exists(spark, d) and not table_exists(spark, os.path.join(d, "missing"))
    rem = spark.createDataFrame([("a", "error", False, "PROBE_STOP_FAILED"), ("b", "unloaded", False, None)],
                                "probe string, state string, loaded boolean, last_error string")
    live = spark.createDataFrame([("a", "loaded", True, None)],
                                 "probe string, state string, loaded boolean, last_error string")
    got = {r.probe: (r.state, r.loaded, r.last_error) for r in status_precedence(rem, live).collect()}
    assert got == {"a": ("loaded", True, None), "b": ("unloaded", False, None)}


def test_encoders_agree_and_round_trip(spark):
    from decimal import Decimal
    from tracelat.sources.decode import encode_rows
    rows = [(7, 100, 200, Decimal(2 ** 64 - 5), "cat", "a.log"),
            (8, 0, 1, Decimal(0), "ünïcode-name-long-enough-to-cut-it", "ß" * 20),
            (9, 5, 6, None, None, None)]
    df = spark.createDataFrame(rows, SPECS["nfs_file_read"].schema)
    a = [bytes(r.sample) for r in encode_rows(df, "nfs_file_read").collect()]
    b = [bytes(r.sample) for r in encode_rows(df, "nfs_file_read", engine="sql").collect()]
    assert a == b and all(len(x) == LAYOUTS["nfs_file_read"][1] for x in a)
    back = decode_samples(encode_rows(df, "nfs_file_read"), "nfs_file_read").collect()
    assert int(back[0]["size"]) == 2 ** 64 - 5 and back[0].comm == "cat" and back[0].file == "a.log"


def test_probe_info_not_found(spark):
    from tracelat.operators.catalog import ProbeNotFound, probe_info
    cat = scan_catalog(spark)
    st = spark.createDataFrame([("nfs_getattr", "loaded", True, None)],
                               "probe string, state string, loaded boolean, last_error string")
    r = probe_info(cat, st, "nfs_getattr").first()
    assert (r.state, r.loaded, r["count"]) == ("loaded", True, 1)
    with pytest.raises(ProbeNotFound):
        probe_info(cat, st, "no_such_probe")


def test_asof_with_negative_stamps_both_plans(spark):
    from tracelat.operators.asof import asof_join
    ev = spark.createDataFrame([(i, t) for i, t in enumerate([-9, -5, -4, -1, 0, 3, 7, 100])], "seq long, ts_ns long")
    cfg = spark.createDataFrame([(-5, 1), (-1, 2), (3, 0)], "from_ns long, filter_pid long")
    want = {0: None, 1: 1, 2: 1, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0}
    for mb in (10, 0):      # broadcast bucket join, then the union scan
        got = {r.seq: r._p_filter_pid for r in asof_join(ev, cfg, ["filter_pid"], max_broadcast_rows=mb).collect()}
        assert got == want, mb


def test_grouped_quantiles_keep_null_group(spark):
    from tracelat.operators.stats import latency_summary_by
    rows = [(None, i) for i in range(50)] + [("a", i * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, lat long")
    a = {r.k: r.asDict() for r in latency_summary_by(df, "lat", "k", method="exact").collect()}
    b = {r.k: r.asDict() for r in latency_summary_by(df, "lat", "k", method="percentile").collect()}
    assert a == b and None in a


def test_scale_conf_and_checkpoint_dir(spark):
    from tracelat.session import checkpoint_dir, scale_conf
    c = scale_conf(100 * 2 ** 40)                    # 100 TB of input
    assert int(c["spark.sql.shuffle.partitions"]) == 200_000
    assert c["spark.sql.files.maxPartitionBytes"] == c["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "256m"
    assert int(scale_conf(10 ** 6)["spark.sql.shuffle.partitions"]) == 200
    # the folder named by the session is used as is
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def _asof_plain(events, config, params):
    """Latest value of each parameter at or before each event, one update after the other."""
    out = {}
    for seq, ts in events:
        now = dict.fromkeys(params)
        for u in sorted(config, key=lambda u: (u[0], u[1])):
            if u[0] <= ts:
                now.update({p: v for p, v in zip(params, u[2:]) if v is not None})
        out[seq] = tuple(now[p] for p in params)
    return out


def test_asof_partial_updates_both_plans(spark, monkeypatch):
    """Partial updates, equal stamps, bursts and outliers: both plans give the plain answer, and an event meets few intervals."""
    import random

    from tracelat.operators import asof
    rng = random.Random(11)
    config = [(rng.choice([15, 45, 75, rng.randrange(-50, 2000), 10_000_000]), i, rng.choice([None, rng.randrange(9)]), rng.choice([None, "bash", "cat"])) for i in range(300)]
    events = [(i, rng.randrange(-100, 2100)) for i in range(400)] + [(400, 10_000_001)]
    cfg = spark.createDataFrame(config, "from_ns long, seq long, filter_pid long, filter_comm string")
    ev = spark.createDataFrame(events, "seq long, ts_ns long")
    want = _asof_plain(events, config, ["filter_pid", "filter_comm"])
    for ranges, limit in ((4096, 1000), (7, 1000), (4096, 10)):
        monkeypatch.setattr(asof, "RANGES", ranges)
        got = asof.asof_join(ev, cfg, ["filter_pid", "filter_comm"], max_broadcast_rows=limit)
        assert {r.seq: (r._p_filter_pid, r._p_filter_comm) for r in got.collect()} == want
    burst = spark.range(2000).selectExpr("id + 1000000000 as from_ns", "id as seq", "id as filter_pid").union(spark.createDataFrame([(0, -1, 1)], "from_ns long, seq long, filter_pid long"))
    monkeypatch.setattr(asof, "RANGES", 100)
    per = asof.intervals(burst.withColumnRenamed("seq", "_seq"), ["filter_pid"], "from_ns", 2001).groupBy("_range").count()
    assert max(r["count"] for r in per.collect()) <= 21


def test_shipped_catalogue_needs_no_folder_on_executors(spark):
    from tracelat.sources.catalog_yaml import BUILTIN_DIR, scan_catalog
    shipped = scan_catalog(spark)
    assert shipped.inputFiles() == []
    key = lambda r: (r.source_file, r.pos)
    assert sorted(shipped.collect(), key=key) == sorted(scan_catalog(spark, BUILTIN_DIR).collect(), key=key)
