"""Near copies: what the search within a radius finds, and the ids it tells."""

import random

from tracelat.llm import simhash


def near_copies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for g in range(12):
        base = [word() for _ in range(300)]
        rows.append((100 * g, " ".join(base)))
        for k, changed in enumerate((0, 1, 3, 6, 10, 60), 1):
            copy = list(base)
            for i in rng.sample(range(300), changed):
                copy[i] = word()
            rows.append((100 * g + k, " ".join(copy)))
    return rows


def test_simhash_finds_near_copies_and_tells_their_ids(spark):
    """The search is exact within a radius that near copies of the stated similarity are in."""
    radius = simhash.radius_for(0.8)
    assert 20 <= radius <= 30
    df = spark.createDataFrame(near_copies(), "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.report(df, radius=radius).collect()}
    apart = lambda a, b: (int(got[a].fingerprint, 16) ^ int(got[b].fingerprint, 16)).bit_count()
    smallest = {}
    for d in sorted(got):
        smallest.setdefault(got[d].fingerprint, d)
    for d in got:
        assert got[d].n_near == sum(apart(d, x) <= radius for x in got) - 1
        assert got[d].near_ids == sorted(x for x in smallest.values() if x != d and apart(d, x) <= radius)
    # with up to ten of 300 words changed, nearly all are found, by their ids
    pairs = [(100 * g, 100 * g + k) for g in range(12) for k in (2, 3, 4, 5)]
    assert sum(b in got[a].near_ids for a, b in pairs) >= 0.9 * len(pairs) > 2 * sum(apart(a, b) <= 3 for a, b in pairs)


def test_op7_uses_the_radius_of_the_stated_similarity(spark, tmp_path):
    from tracelat.llm.queries import op7_simhash

    spark.createDataFrame(near_copies(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_simhash(spark, str(tmp_path)).collect()}
    assert sum(100 * g + 3 in got[100 * g].near_ids for g in range(12)) >= 11 and got[1].near_ids is None


def test_block_radii_cover_every_radius():
    for radius in range(0, 64):
        assert sum(r + 1 for r in simhash.block_radii(radius)) == radius + 1
