"""Boilerplate at the limits used in production."""

import random


def hosts():
    """A host of 12 documents and one of 3 000, each with a line on every page and one on 11 pages, and one on 10."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for host, n in (("small", 12), ("large", 3_000)):
        for i in range(n):
            lines = [" ".join(word() for _ in range(30)), f"Subscribe to the letter of {host}"]
            lines += ["on eleven pages"] * (i < 11) + ["on ten pages"] * (i < 10)
            rows.append((len(rows) + 1, "\n".join(lines), host))
    return rows


def test_op1_and_quality_stage_remove_lines_at_production_limits(spark, tmp_path):
    import corpus_pipeline
    from tests.llm import brute
    from tracelat.llm import line_frequency
    from tracelat.llm.queries import op1_line_frequency

    rows = hosts()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute.quality(rows, line_frequency.MAX_DOCS, line_frequency.MAX_SHARE)
    got = {r.doc_id: r for r in op1_line_frequency(spark, str(tmp_path)).collect()}
    assert {d: len(gone) for d, *_, gone in want} == {d: r.removed_lines for d, r in got.items()}
    # all but the first page of each host lose the first line, the first eleven the second one too
    assert [sum(got[d].removed_lines for d, _, h in rows if h == host) for host in ("small", "large")] == [11 + 10, 2_999 + 10]
    texts = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, df, "").collect()}
    assert len(texts) == len(rows) and sum("Subscribe" in t for t in texts.values()) == 2
    assert sum("on eleven pages" in t for t in texts.values()) == 2 and sum("on ten pages" in t for t in texts.values()) == 20


def test_limit_is_a_share_on_large_hosts(spark, monkeypatch):
    """On a host of 30 000 documents a line needs more than 30 of them; on one of 100, more than ten.  With and without
    broadcast lines the same ones go."""
    from tracelat.llm import line_frequency

    profile = "doc_id long, host string, text_hash long, lines array<struct<i:int,hash:long,words:int>>"
    rows = []
    for host, n in (("small", 100), ("large", 30_000)):
        for i in range(n):
            own = [(0, 1_000_000 + len(rows), 30)]
            own += [(1, 1, 3)] * (i < 12) + [(2, 2, 3)] * (i < 31) + [(3, 3, 3)] + [(4, 4, 3)] * (i < 10) + [(5, 5, 3)] * (i < 30)
            rows.append((len(rows), host, len(rows), own))
    profiles = spark.createDataFrame(rows, profile).repartition(4)
    want = {("small", 1): 12, ("small", 2): 31, ("small", 3): 100, ("small", 5): 30, ("large", 2): 31, ("large", 3): 30_000}
    for heavy in (100_000, 2):
        monkeypatch.setattr(line_frequency, "HEAVY", heavy)
        frequent = line_frequency.frequent_lines(profiles)
        assert {(r["host"], r["hash"]): r["n_docs"] for r in frequent.collect()} == want
        gone = line_frequency.removed_lines(profiles, frequent).collect()
        assert sum(len(r.removed) for r in gone) == sum(n - 1 for n in want.values())
