"""One test for each finding of the round that changed code."""

import glob
import random
from collections import Counter

from pyspark.sql import functions as F

from tracelat.llm import alignment, merkle


def test_merkle_few_rows_make_few_ranges(spark, monkeypatch):
    """op13: ranges of few rows are read as one; before, each shuffle partition wrote a file of its own."""
    seen = []
    keep = merkle.stored
    monkeypatch.setattr(merkle, "stored", lambda df, name, **kw: seen.append((name, keep(df, name, **kw))) or seen[-1][1])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(500).select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("g"))
        got = {(r.g, r.id): (r.pos, r.n) for r in merkle.positions(rows, "g", ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {(f"s{i % 3}", i): (i // 3, len(range(i % 3, 500, 3))) for i in range(500)}
    dealt = dict(seen)["dealt"]
    assert len(dealt.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism


def test_alignment_encodes_pieces_once(vocabulary):
    """op12: B's ids of a piece come from the cache; before, the library encoded every text."""
    own = alignment.Pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    model, calls = own.b, []

    class Counting:
        def encode(self, texts, **kw):
            calls.append(texts)
            return model.encode(texts, **kw)

    own.a.model = own.b = Counting()
    rng = random.Random(5)
    said = [" ", " ", "  ", "\n", "\t", "▁", "a", "the", "é", "日本", "x", "\x00", "=", "--", "😀", "<s>", "1"]
    texts = ["".join(rng.choice(said) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    own.a.limit = 300  # the caches shrink several times
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for text, got, want in zip(part, own.encode(part), model.encode(part)):
            same = text and b"".join(own.bytes_b[i] for i in want) == (" " + text).encode()
            assert (got and got[1].tolist()) == (want if same else None), repr(text)
    plain = ["the cat sat on the mat", "the mat"]
    own.encode(plain)
    calls.clear()
    own.encode(plain)
    assert calls == []


def test_keyed_stream_slices_are_written_by_all_tasks(spark, tmp_path):
    """before, one task wrote each slice of the events as one file."""
    from tracelat.operators.pairing import pair
    from tracelat.session import checkpoint_dir
    from tracelat.sources import fixtures
    from tracelat.streaming import queries

    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 60_000_000).cast("timestamp_ntz")
    kinds = F.element_at(F.array(*map(F.lit, ("view", "purchase", "click", "error", "view"))), (F.col("id") % 5 + 1).cast("int"))
    events = spark.range(240, numPartitions=3).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 4).alias("user_id"),
                                                      kinds.alias("event_type"), (F.col("id") * 0.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 6).alias("props"))
    # each file has events of all times
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    base = checkpoint_dir(spark).removeprefix("file:")
    old = set(glob.glob(f"{base}/pair_stream_keyed-*"))
    got = Counter(tuple(r) for r in queries.q_pair_stream_keyed(spark, str(tmp_path)).collect())
    rows = pair(fixtures.raw_calls(spark, str(tmp_path)), "nfs_file_read", max_pending_ns=queries.PENDING_NS)
    own, = set(glob.glob(f"{base}/pair_stream_keyed-*")) - old
    assert got and sum(got.values()) == rows.count()
    columns = [c for c in rows.columns if c not in ("probe", "run_id")]
    assert Counter(r.lat for r in rows.select(*columns).collect()) == Counter(r[1] for r in got.elements())
    assert len(glob.glob(f"{own}/src/*.parquet")) > queries.SLICES
