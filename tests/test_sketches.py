"""Mergeable sketches, their store, and grouped exact quantiles beyond the broadcast bound."""
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelat.operators import quantiles
from tracelat.operators.sketches import SUB_BITS, bucket_of, merge_sketches, quantile_sketch, sketch_quantiles
from tracelat.session import checkpoint_dir
from tracelat.sources import sketch_store
from tracelat.sources.sketch_store import _parts, _split, merge_parts, store_sketches, stored_summary
from tracelat.sources.traces import append_trace, batch_names, compact_run
from tracelat.specs import spec

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def plain_quantile(values, q):
    values = sorted(values)
    h = (len(values) - 1) * q
    lo, hi = values[math.floor(h)], values[math.ceil(h)]
    return float(lo) if math.floor(h) == math.ceil(h) else lo + (h - math.floor(h)) * (hi - lo)


def test_bucket_numbers_follow_bit_lengths(spark):
    """Around every power of two, both signs: rising, and as long division by the bit length has them."""
    values = sorted({s * (2**e + d) for e in range(63) for d in range(-3, 4) for s in (1, -1)} | {2**63 - 1, -2**63, 0})
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).orderBy("v").select(bucket_of(F.col("v")).alias("b")).collect()]

    def plain(v):
        m = v if v >= 0 else ~v
        shift = max(m.bit_length() - 1 - SUB_BITS, 0)
        n = shift * 2**SUB_BITS + (m >> shift)
        return n if v >= 0 else -n - 1

    assert got == [plain(v) for v in values] and got == sorted(got)


def test_sketches_merge_to_the_sketch_of_all_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(7), rng.choice("ab"), rng.choice([rng.randrange(300), rng.randrange(10**6), -rng.randrange(10**15), None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "part int, k string, lat long")
    whole = quantile_sketch(df, "lat", ["k"])
    twice = merge_sketches(merge_sketches(quantile_sketch(df, "lat", ["part", "k"]).withColumn("half", F.col("part") % 2), ["half", "k"]), ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, twice.select(whole.columns).collect()))
    got = {r.k: r for r in sketch_quantiles(twice, T.LongType(), QS, ["k"]).collect()}
    for k in "ab":
        mine = [v for _, x, v in rows if x == k and v is not None]
        assert (got[k].n, got[k].low, got[k].high, got[k].total) == (len(mine), min(mine), max(mine), sum(mine))
        for i, q in enumerate(QS):
            want = plain_quantile(mine, q)
            if q in (0.0, 1.0):
                assert got[k][f"q{i}"] == want
            else:   # between two ranks of either sign the larger one's bound holds
                near = sorted(mine)[math.floor((len(mine) - 1) * q):][:2]
                assert abs(got[k][f"q{i}"] - want) <= max(map(abs, near)) / 2**SUB_BITS
    empty = sketch_quantiles(quantile_sketch(df.limit(0), "lat", ["k"]), T.LongType(), QS, ["k"])
    assert empty.collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_grouped_quantiles_beyond_the_broadcast(spark, monkeypatch, wide):
    """One group with half of the rows, one value with many ties, many small
    groups, a null group; cells joined by shuffle, hot ones by broadcast, several passes."""
    monkeypatch.setattr(quantiles, "SMALL_STATE_ROWS", 0)
    monkeypatch.setattr(quantiles, "HOT_CELLS", 200)
    rng = random.Random(11)
    rows = [("hot", rng.choice([777, rng.randrange(10**6), 10**15 + rng.randrange(10**9)])) for _ in range(4000)]
    rows += [(f"g{rng.randrange(900)}", rng.randrange(-10**12, 10**12)) for _ in range(3500)] + [(None, rng.randrange(50)) for _ in range(300)]
    kind = "decimal(20,0)" if wide else "long"
    df = spark.createDataFrame(rows, "k string, v long").select("k", F.col("v").cast(kind).alias("v")).repartition(5)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    got = {r.k: r for r in quantiles.exact_quantiles_by(df, "k", "v", QS, nbuckets=64, list_rows=20).collect()}
    assert got.keys() == groups.keys()
    for k, mine in groups.items():
        assert got[k].n == len(mine) and (got[k]["min"], got[k]["max"]) == (min(mine), max(mine))
        for i, q in enumerate(QS):
            assert math.isclose(got[k][f"q{i}"], plain_quantile(mine, q), rel_tol=1e-12, abs_tol=1e-6), (k, q)


def test_grouped_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v long")
    assert quantiles.exact_quantiles_by(df, "k", "v", QS).collect() == []


def test_stored_sketches_cover_what_a_scan_returns(spark, monkeypatch):
    probe, names = "nfs_file_read", spec("nfs_file_read").names
    root = f"{checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    latency = spec(probe).latency_col

    def batch(lo, hi):
        return spark.range(lo, hi).select(*[(F.col("id") * 1000 if n == latency else F.lit(1)).cast(spec(probe).schema[n].dataType).alias(n) for n in names])

    def check(**want):
        got = {r.run_id: r for r in stored_summary(spark, root, probe, by_run=True).collect()}
        assert {k: (r.total_rows, int(r.min_latency), int(r.max_latency)) for k, r in got.items()} == want
        whole = stored_summary(spark, root, probe).first()
        assert whole.total_rows == sum(n for n, _, _ in want.values())

    with pytest.raises(ValueError, match="does not exist"):
        stored_summary(spark, root, probe)
    append_trace(batch(0, 100), root, probe, "r1")
    append_trace(batch(100, 150), root, probe, "r1")
    check(r1=(150, 0, 149000))                                       # nothing stored: read from the rows
    assert store_sketches(spark, root, probe) == 2 and store_sketches(spark, root, probe) == 0
    append_trace(batch(500, 600), root, probe, "r2")
    check(r1=(150, 0, 149000), r2=(100, 500000, 599000))             # one stored, one not
    compact_run(spark, root, probe, "r1")
    assert [b for _, b in batch_names(spark, root, probe, "r1")][0].startswith("compact-")
    assert len(_split(spark, root, probe, "r1")[1]) == 1             # passed on, not sketched again
    compact_run(spark, root, probe, "r2")
    assert len(_split(spark, root, probe, "r2")[2]) == 1             # no sketch to pass on
    check(r1=(150, 0, 149000), r2=(100, 500000, 599000))
    assert store_sketches(spark, root, probe) == 1
    assert all("/_sketches/" in f for f in stored_summary(spark, root, probe).inputFiles())   # no row is read again
    check(r1=(150, 0, 149000), r2=(100, 500000, 599000))
    # merged into one full part: readers planned before still work until the retention is over
    before = stored_summary(spark, root, probe, by_run=True)
    assert merge_parts(spark, root, probe) == [] and len(_parts(spark, root, probe)[0]) == 1
    assert {r.run_id: r.total_rows for r in before.collect()} == {"r1": 150, "r2": 100}
    check(r1=(150, 0, 149000), r2=(100, 500000, 599000))
    monkeypatch.setattr(sketch_store, "MAX_PARTS", 1)
    append_trace(batch(600, 620), root, probe, "r2")
    assert store_sketches(spark, root, probe) == 1 and len(_parts(spark, root, probe)[0]) == 1
    assert len(merge_parts(spark, root, probe, retention=0)) >= 3 and _parts(spark, root, probe)[1] == []
    assert _split(spark, root, probe, None)[2] == []
    check(r1=(150, 0, 149000), r2=(120, 500000, 619000))
