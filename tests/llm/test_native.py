"""Pseudonyms, secret scans and fingerprints against plain versions."""

import hashlib
import re

import pytest

from tests.llm import brute
from tests.llm.conftest import ROWS
from tracelat.llm import pseudonyms, secret_index, simhash


def text_of(rows):
    return sorted(((r[0], r[1]) for r in rows), key=repr)


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_pseudonyms(table, request):
    df = request.getfixturevalue(table)
    out = pseudonyms.pseudonymise(df, "k")
    assert out.columns == df.columns
    want = [(r.doc_id, brute.pseudonymised(r.text, pseudonyms.KINDS, "k")) for r in df.collect()]
    assert text_of(out.select("doc_id", "text").collect()) == text_of(want)


def test_pseudonyms_link_and_stay_valid(spark):
    rows = [(1, "4041894974608795 and 4041-8949-7460-8795"), (2, "4041894974608795"), (3, "2024-05-31 31.05.2024 05/31/2024")]
    out = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    a, b = out[1].split(" and ")
    assert a == b.replace("-", "") == out[2] != rows[1][1] and brute.luhn([int(c) for c in a]) == 0
    iso, dotted, us = out[3].split()
    y, m, d = iso.split("-")
    assert dotted == f"{d}.{m}.{y}" and us == f"{m}/{d}/{y}" and iso != "2024-05-31"


def test_pseudonyms_are_a_permutation():
    got = {brute.pseudonym("ssn", f"{a:03d}-12-0001", "k") for a in range(1, 900) if a != 666}
    assert len(got) == 898 and all(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", x) for x in got)
    days = {tuple(brute.feistel([a, b], [319, 229], "date", "k")) for a in range(0, 319, 7) for b in range(229)}
    assert len(days) == len(range(0, 319, 7)) * 229


def test_pseudonym_counts_and_empty(edges, empty):
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(edges, "k", counts=True).filter("doc_id in (1, 10, 11, 12)").collect()}
    assert (got[10].pii_email, got[10].pii_card, got[11].pii_ip, got[11].pii_date, got[11].pii_ssn, got[12].pii_phone, got[12].pii_iban, got[1].pii_card) == (2, 2, 1, 3, 1, 4, 2, 0)
    assert pseudonyms.pseudonymise(empty, "k").count() == 0


def secrets_of(text):
    found = []
    # the contract's base kinds as they are worded there
    base = [(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    for k, (pattern, group, length) in enumerate(base + [(r.pattern, r.group, r.length) for r in secret_index.MORE]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= length]
    told = lambda spans: ",".join(f"{secret_index.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(spans))
    base = [s for s in found if s[1] < 3]
    return (*(sum(s[1] == k for s in found) for k in range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(found))


@pytest.mark.parametrize("table,broadcast", [("docs", 200_000), ("edges", 200_000), ("edges", 0)])
def test_secrets(table, broadcast, request):
    df = request.getfixturevalue(table)
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_index.report(df, broadcast=broadcast).collect()]
    assert sorted(got, key=repr) == sorted(((r.doc_id, *secrets_of(r.text)) for r in df.collect()), key=repr)


def test_secrets_empty(empty):
    assert secret_index.report(empty).count() == 0


@pytest.mark.parametrize("pattern,holds,lacks", [
    (r"foo(bar|baz)+", "xfoobarx", "xfooarx"), (r"ab?cdef[0-9]*", "acdef", "abcde"), (r"(?i)Key_[xy]z{2}", "KEY_YZZ", "key_z"), (r"[a-z]+", "a", None), (r"(abc|d)e", "de", None)])
def test_trigram_queries(pattern, holds, lacks):
    query = secret_index.trigram_query(pattern)
    fits = lambda text: all(any(all(t in text.lower() for t in option) for option in clause) for clause in query)
    assert re.search(pattern, holds) and fits(holds)
    assert not fits(lacks) if lacks else not query


def test_rules_without_trigrams_scan_everything():
    assert not secret_index.trigram_query(r"[0-9a-f]{24,}")
    assert all(secret_index.trigram_query(r.pattern) for r in secret_index.RULES if r.kind != "hex")


def fingerprint_bits(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: (r.fp0, r.fp1) for r in simhash.fingerprints(rows, ["i"]).collect()}


def test_votes(spark):
    """All bits against votes counted one by one over the same term hashes."""
    texts = ["a b c a b", "one", "", "A B C", "\t\n", "the cat sat on the mat the cat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    from pyspark.sql import functions as F

    hashes = {r.i: r for r in rows.select("i", simhash.terms(F.col("text")).alias("h")).select("i", "h", F.transform("h", lambda h: F.xxhash64(F.lit(128), h)).alias("g")).collect()}
    for i, fp in fingerprint_bits(spark, texts).items():
        for got, votes in zip(fp, (hashes[i].h or [], hashes[i].g or [])):
            want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))
            assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_report(table, request):
    df = request.getfixturevalue(table)
    rows = sorted({(r.doc_id, r.text or "") for r in df.collect()}, key=repr)
    got = {(r.doc_id, r.edited_sha256): r for r in simhash.report(df).collect()}
    first = {}
    for d, t in rows:
        if d is not None:
            first[d] = min(t, first.get(d, t))
    ids = sorted(first)
    seen = 0
    for d, t in rows:
        k = len(t) // 3
        after = "" if d is None else first[ids[ids.index(d) - 1]]
        edited = t[: len(t) - k] + after[:k]
        r = got[d, hashlib.sha256(edited.encode()).hexdigest()]
        near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert (r.n_chars, r.near_edited) == (len(t), near(r.fingerprint, r.edited_fingerprint))
        others = [x.fingerprint for x in got.values()]
        assert r.n_near == sum((int(r.fingerprint, 16) ^ int(f, 16)).bit_count() <= 3 for f in others) - 1
        if d is None:
            assert r.near_next is None
        seen += 1
    assert seen == len(got)


def test_equal_texts_have_equal_fingerprints(edges):
    got = {r.doc_id: r for r in simhash.report(edges).collect()}
    assert got[5].fingerprint == got[6].fingerprint and got[2].fingerprint == "0" * 32


def test_simhash_empty(empty):
    assert simhash.report(empty).count() == 0


def test_block_tables_miss_nothing():
    """Any two fingerprints at most 3 bits apart share a block choice."""
    import itertools

    for flips in itertools.combinations(range(4), 3):
        assert any(not set(chosen) & set(flips) for chosen in itertools.combinations(range(4), 1))


def test_edge_rows_are_as_described():
    assert len([r for r in ROWS if r[0] == 8]) == 3
