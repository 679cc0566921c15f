"""what is pending from earlier micro-batches is worked out once in each."""

from tracelat.operators.pairing import pair
from tracelat.sources.traces import scan_trace
from tracelat.streaming import hot_config

SCHEMA = "seq long, ts_ns long, kind string, pid_tgid long, comm string, file string, ret long, offset long"


def _rows(spark, rows):
    return spark.createDataFrame([(seq, ts, kind, key, "c", "f", 1, 0) for seq, ts, kind, key in rows], SCHEMA)


def test_pending_entries_are_read_once(spark, tmp_path, monkeypatch):
    """Pairing and the pending table start from stored rows; before, each worked out from all versions what is pending.
    Batches without rows, without keys met before, with a null key and a repeated row among them."""
    batches = [[(1, 10, "entry", 1 << 32), (2, 11, "entry", 2 << 32), (3, 12, "entry", None)],
               [(4, 20, "exit", 1 << 32), (4, 20, "exit", 1 << 32), (5, 21, "exit", None), (6, 22, "entry", 1 << 32)],
               [],
               [(7, 30, "exit", 9 << 32)],
               [(8, 40, "exit", 2 << 32), (9, 41, "exit", 1 << 32)]]
    root, state, seen = str(tmp_path / "t"), str(tmp_path / "s"), []

    def watched(raw, *a, **kw):
        seen.append((raw.inputFiles(), raw.count(), kw.get("total")))
        return pair(raw, *a, **kw)

    monkeypatch.setattr(hot_config, "pair", watched)
    for i, rows in enumerate(batches):
        hot_config.process_batch(_rows(spark, rows), i, "nfs_file_read", root, state, "r", None, [])
    got = scan_trace(spark, root, "nfs_file_read").drop("probe", "run_id")
    want = pair(_rows(spark, [r for b in batches for r in b]), "nfs_file_read")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [n for _, n, _ in seen] == [total for *_, total in seen] == [3, 6, 0, 1, 4]
    assert not any("/pending/" in f for files, *_ in seen for f in files)
    assert not any((tmp_path / "s" / "work").iterdir())  # nothing is left there
