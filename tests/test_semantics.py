"""Operators against sequential simulations on random input."""

import random

import pytest
from pyspark.sql import functions as F

from tests.sim import c_wildcard, simulate_control, simulate_pairing
from tracelat.functions.wildcard import wildcard_match
from tracelat.operators.control import replay_control
from tracelat.operators.pairing import pair
from tracelat.specs import PROBES, RAW_SCHEMA, SPECS


# --- wildcard rule ------------------------------------------------------------

def _rand_word(rng, alphabet, lo, hi):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))


def test_wildcard_literal_and_column_match_simulation(spark):
    rng = random.Random(7)
    alpha = "ab.*?x"
    pats = {"*", "*.log", "a?b", "?", "*?", "a*b", "x" * 16, "*" + "a" * 16, "ab.x"}
    pats |= {_rand_word(rng, alpha, 1, 18) for _ in range(120)}
    names = {"", "a", "ab", "a*b", "aab", "x" * 15, "x" * 20, "f.log", "ab.x", "a?b"}
    names |= {_rand_word(rng, "ab.x*?", 0, 18) for _ in range(60)}
    # names and patterns with characters of several bytes: the rule counts bytes, and cuts inside characters
    pats |= {"?.log", "??.log", "é.log", "*é", "*.lögg", "????", "é?", "ä" * 9, "*" + "€" * 6} | {_rand_word(rng, "aé?€*", 1, 9) for _ in range(30)}
    names |= {"é.log", "é", "aé", "€", "x.lögg", "éa", "ä" * 8, "€" * 6, "é€"} | {_rand_word(rng, "aé€", 0, 8) for _ in range(30)}
    rows = [(p, n) for p in sorted(pats) for n in sorted(names)]
    df = spark.createDataFrame(rows, "pattern string, name string")
    name15 = F.expr("substring(cast(name as binary), 1, 15)").cast("string")
    got_col = {(r["pattern"], r["name"]): r["m"] for r in
               df.select("pattern", "name", wildcard_match(name15, F.col("pattern")).alias("m")).collect()}
    # literal patterns (compiled on the driver), all in one projection
    lit_m = F.coalesce(*[F.when(F.col("pattern") == p, wildcard_match(name15, p)) for p in sorted(pats)])
    got_lit = {(r["pattern"], r["name"]): r["m"] for r in
               df.select("pattern", "name", lit_m.alias("m")).collect()}
    for p in pats:
        for n in names:
            want = c_wildcard(p.encode(), n.encode())
            assert got_lit[(p, n)] == want, (p, n)
            assert got_col[(p, n)] == want, (p, n)


# --- pairing ----------------------------------------------------------------

def _random_events(rng, n=400):
    comms = ["dd", "fio", "proc1", "a_very_long_task_name_exceeding"]
    files = ["x.log", "y.txt", "abcdefghijklmnopq.log", "t?.log"]
    ev = []
    for i in range(n):
        tgid = rng.choice([100, 200, 300])
        ev.append({
            "seq": i, "ts_ns": rng.randint(1, 60) * 1000, "kind": rng.choice(["entry", "exit", "exit"]),
            "pid_tgid": (tgid << 32) | rng.choice([tgid, tgid + 1]), "comm": rng.choice(comms),
            "obj": rng.randint(0, 4), "dev": rng.randint(0, 1), "sector": rng.randint(0, 3),
            "syscall_id": rng.choice([0, 1, 2, 4294967298]), "ret": rng.choice([-5, 0, 4096, 10]),
            "size": rng.choice([0, 4096, 1 << 33]), "offset": rng.choice([0, 8192]),
            "xid": rng.randint(0, 2 ** 32 - 1), "file": rng.choice(files),
            "proc_name": rng.choice([None, "READ", "LOOKUP"]),
        })
    return ev


PARAM_CASES = [
    {},
    {"filter_pid": 200},
    {"filter_pid": (200 << 32) | 200},
    {"filter_comm": "fio"},
    {"filter_comm": "a_very_long_task_name_exceeding"},
    {"filter_file": "*.log"},
    {"filter_file": "x.l?g"},
    {"filter_file": "abcdefghijklmno"},
    {"filter_syscall_id": 2},
    {"filter_syscall_id": 4294967298},
    {"filter_pid": 100, "filter_comm": "dd", "filter_syscall_id": 1},
]


@pytest.fixture(scope="module")
def raw_events(spark):
    ev = _random_events(random.Random(11))
    return ev, spark.createDataFrame([tuple(e[f.name] for f in RAW_SCHEMA.fields) for e in ev], RAW_SCHEMA)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def _spark_rows(df):
    return [tuple(int(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, float)) else v
                  for v in r) for r in df.collect()]


@pytest.mark.parametrize("probe", PROBES)
def test_pairing_matches_simulation(spark, raw_events, probe):
    """All settings cases, both effect modes and the chunked scan, in one job."""
    ev, raw = raw_events
    s = SPECS[probe]
    frames, want = [], []
    for i, case in enumerate(PARAM_CASES):
        params = {k: v for k, v in case.items() if k in s.filters}
        for j, (effect, chunk) in enumerate((("reference", None), ("strict", "auto"), ("reference", 7000))):
            tag = i * 10 + j
            frames.append(pair(raw, probe, params, effect=effect, chunk_ns=chunk)
                          .withColumn("_case", F.lit(tag)))
            want += [(tag,) + r for r in simulate_pairing(ev, s, params, effect)]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    got = [(r[-1],) + r[:-1] for r in _spark_rows(df)]
    assert _sorted(got) == _sorted(want), probe


def test_filter_effect_table(spark, raw_events):
    """A non-matching call: latency-0 row (read/write, nfsd) vs no row (others)."""
    ev, raw = raw_events
    n_exit = sum(1 for e in ev if e["kind"] == "exit")
    # zero-latency probes keep every exit under an entry-side filter
    assert pair(raw, "nfs_file_read", {"filter_pid": 999}).count() == n_exit
    assert pair(raw, "nfs_file_read", {"filter_pid": 999}).where("lat <> 0").count() == 0
    assert pair(raw, "nfsd4_read", {"filter_pid": 999}).where("lat <> 0").count() == 0
    # suppressing probes leave nothing
    for probe in ("nfs_getattr", "nfs_setattr", "rpc_task_latency", "block_io_latency", "sys_call_trace"):
        assert pair(raw, probe, {"filter_pid": 999}).count() == 0, probe
    # strict mode suppresses for the zero-latency probes too
    assert pair(raw, "nfs_file_read", {"filter_pid": 999}, effect="strict").count() == 0
    # svc ignores settings
    assert pair(raw, "svc_rqst_latency", {"filter_pid": 999}).count() == pair(raw, "svc_rqst_latency").count()


# --- control log ----------------------------------------------------------------

def test_replay_matches_sequential_controller(spark):
    rng = random.Random(5)
    probes = PROBES[:3] + ["ghost"]
    cmds = [{"seq": i, "probe": rng.choice(probes), "op": rng.choice(["load", "unload", "update", "status"]),
             "outcome": rng.choice(["ok", "ok", "fail"]), "dry_run": rng.random() < 0.1}
            for i in range(600)]
    df = spark.createDataFrame(cmds, "seq long, probe string, op string, outcome string, dry_run boolean")
    want = simulate_control(cmds, set(PROBES), set(PROBES))
    for chunk in (None, 37):
        got = {r["seq"]: (r["code"], r["state"], r["last_error"], r["attached_before"])
               for r in replay_control(df, chunk_rows=chunk).collect()}
        assert got == want


def test_auto_chunking_kicks_in_for_large_inputs(spark, raw_events, monkeypatch):
    """With a tiny row budget the automatic width chunks the scan; same rows."""
    import tracelat.operators.carry as carry
    ev, raw = raw_events
    monkeypatch.setattr(carry, "AUTO_CHUNK_ROWS", 50)
    assert carry.auto_chunk_width(raw, "ts_ns", 50) is not None
    s = SPECS["nfs_file_read"]
    got = _spark_rows(pair(raw, "nfs_file_read"))
    assert _sorted(got) == _sorted(simulate_pairing(ev, s))


def test_hot_key_is_split_and_exact(spark, monkeypatch):
    """One thread holds half of all events: the automatic width cuts it into
    many (key, chunk) groups and the result still equals the simulation."""
    import tracelat.operators.carry as carry
    rng = random.Random(17)
    ev = _random_events(rng, 1200)
    hot = (500 << 32) | 500
    for e in ev[::2]:
        e["pid_tgid"] = hot
    raw = spark.createDataFrame([tuple(e[f.name] for f in RAW_SCHEMA.fields) for e in ev], RAW_SCHEMA)
    monkeypatch.setattr(carry, "AUTO_CHUNK_ROWS", 100)
    cut = carry.even_chunks(raw, ["pid_tgid"], ["ts_ns", "seq"], 100).where("_chunk > 0")
    sizes = [r["count"] for r in cut.groupBy("pid_tgid", "_chunk").count().collect()]
    assert cut.select("pid_tgid").distinct().count() == 1 and len(sizes) >= 5 and max(sizes) <= 200
    width = carry.auto_chunk_width(raw, "ts_ns", 100)
    assert width is not None
    chunks = raw.where(F.col("pid_tgid") == hot).select(F.expr(f"ts_ns div {width}")).distinct().count()
    assert chunks >= 5
    for probe in ("nfs_file_read", "sys_call_trace"):
        got = _spark_rows(pair(raw, probe, {"filter_pid": 500} if probe == "sys_call_trace" else {}))
        want = simulate_pairing(ev, SPECS[probe], {"filter_pid": 500} if probe == "sys_call_trace" else {})
        assert _sorted(got) == _sorted(want), probe


def test_chunks_are_even_with_outliers_and_bursts(spark):
    """Heavy keys with an outlying stamp, a burst of close stamps, very many rows of one stamp, and both ends of the
    range: no chunk exceeds twice the target, chunks follow the order, light keys stay whole."""
    import tracelat.operators.carry as carry
    rng, target = random.Random(5), 500
    rows = [("outlier", 10**9 + 7 * i, i) for i in range(6000)] + [("outlier", 8 * 10**18, 6000)]
    rows += [("burst", 10**15 * i, i) for i in range(1500)] + [("burst", 7 * 10**17 + i, 2000 + i) for i in range(6000)]
    rows += [("stamp", 10**6 * rng.randrange(10**6), i) for i in range(1500)] + [("stamp", 5 * 10**11, 2000 + i) for i in range(6000)]
    rows += [("ends", -9 * 10**18 + i, i) for i in range(1500)] + [("ends", 9 * 10**18 + i, 2000 + i) for i in range(1500)]
    rows += [("mostly", 5, i) for i in range(4000)] + [("mostly", 6, 4000)] + [(f"light{i % 40}", i, i) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, s long").repartition(5)
    got = carry.even_chunks(df, ["k"], ["t", "s"], target).collect()
    of = {}
    for r in got:
        of.setdefault(r.k, []).append((r.t, r.s, r._chunk))
    assert sorted((r.k, r.t, r.s) for r in got) == sorted(rows)
    for k, mine in of.items():
        mine.sort()
        chunks = [c for *_, c in mine]
        assert chunks == sorted(chunks), k
        if k.startswith("light"):
            assert set(chunks) == {0}
            continue
        sizes = {c: chunks.count(c) for c in set(chunks)}
        assert 0 not in sizes and max(sizes.values()) <= 2 * target, (k, max(sizes.values()))
        assert len(sizes) <= 3 * (len(mine) // target + 2), (k, len(sizes))
    assert carry.even_chunks(df, ["k"], ["t", "s"], len(rows)) is None
    # values are carried across chunks, also into those that have none themselves, nulls included
    from pyspark.sql import Window
    v = F.when(F.col("s") % 1700 == 3, F.col("s"))
    for inclusive in (False, True):
        w = Window.partitionBy("k").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        want = df.withColumn("x", F.last(v, ignorenulls=True).over(w)).where("s % 3 = 0")
        even = carry.carry_even(df, ["k"], ["t", "s"], {"x": v}, target, inclusive=inclusive, keep=F.col("s") % 3 == 0)
        assert even.columns == want.columns and want.exceptAll(even).count() == 0 and even.exceptAll(want).count() == 0
