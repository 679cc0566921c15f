"""Quality rules, sharding, token files, packing, near-duplicates, encoding and counts against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute
from tracelat.llm import best_fit, bpe, encode, line_frequency, minhash, shard_table, token_counts, wavelet

TRICKY = ["", " ", "  a", "a  b", "a b ", " a\n b \n\n c", "x<|endoftext|> y <|startoftext|>", "it's 12 3,4 ÀB é́ \x1c q \xa0z", "A  \t\n B's  ", "\n\n a", " a",
          "İstanbul ΣΑΣ ß ﬁ ½ ² don't I'LL", "a.\nB", "foo,bar. x, y.. z", "日本語テキスト 안녕 😀😀", "a" * 40, "\x00\x01   ----------====="]


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


# quality rules

@pytest.mark.parametrize("table,limits", [("docs", (2, 0.0)), ("docs", (1, 0.5)), ("edges", (1, 0.0)), ("edges", (100, 0.01))])
def test_quality(table, limits, request):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    want = brute.quality(rows, *limits)
    got = line_frequency.judge(df, max_docs=limits[0], max_share=limits[1]).collect()
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept, tuple(r.removed)) for r in got) == \
        Counter((d, m, failed, kept, tuple(gone)) for d, m, failed, kept, gone in want)
    if limits == (2, 0.0):
        assert any(gone for *_, gone in want)


def test_quality_clean(edges, docs):
    for df, limits in ((docs, (2, 0.0)), (edges, (1, 0.0))):
        rows = df.collect()
        verdicts = brute.quality([(r.doc_id, r.text, r.source) for r in rows], *limits)
        got = line_frequency.clean(df, max_docs=limits[0], max_share=limits[1])
        assert got.columns == df.columns
        want = [(r.doc_id, "\n".join(line for i, line in enumerate((r.text or "").split("\n")) if i not in gone) if gone else r.text)
                for r, (_, _, _, kept, gone) in zip(rows, verdicts) if kept]
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_repeated_words():
    w = lambda s: s.encode().split()
    assert line_frequency.repeated_words(w("a b c d e f g h " * 2)) == 16
    assert line_frequency.repeated_words(w("a " * 9)) == 9
    assert line_frequency.repeated_words(w("a b c d e f g h x a b c d e f g")) == 0


# sharding

def test_lookup_table():
    table = shard_table.lookup_table([f"s{i}" for i in range(7)], 101)
    assert sorted(Counter(table.tolist()).values()) == [14] * 4 + [15] * 3
    names = [f"s{i}" for i in range(20)]
    big, less = shard_table.lookup_table(names, 65537), shard_table.lookup_table(names[:-1], 65537)
    others = big != 19
    assert (big != less)[others].mean() < 0.1  # few slots of the others change hands
    weighted = Counter(shard_table.lookup_table(["a", "b"], 1009, [1, 3]).tolist())
    assert abs(weighted[1] - 3 * weighted[0]) <= 4
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            shard_table.lookup_table(*wrong)


def test_place(edges, empty):
    names = [f"s{i}" for i in range(5)]
    table = shard_table.lookup_table(names, 1009)
    got = shard_table.place(edges, names, size=1009).collect()
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert len(got) == edges.count() and shard_table.place(empty, names).count() == 0


# encoding

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(vocabulary, plain, name, monkeypatch):
    monkeypatch.setattr(encode, "LIMIT", 3000)  # caches overflow
    texts = [t for _, t, _ in plain[:60]] + TRICKY
    own = encode.Cached(encode.Library(vocabulary(name)).encode_new, encode.Library(vocabulary(name)).specials)
    for _ in range(2):
        for i in range(0, len(texts), 11):
            ids, counts = own.encode(texts[i : i + 11])
            want = library(vocabulary(name), texts[i : i + 11])
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_other_vocabulary_files_are_encoded_whole(vocabulary, tmp_path):
    """A file whose pre-tokenizer isn't one of those that pieces are cut for, and one with too many ids."""
    import json

    from tokenizers import Tokenizer

    said = json.loads(open(vocabulary("byte_bpe_50k.json")).read())
    said["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    own = encode.encoder(str(path))
    ids, counts = own.encode(TRICKY)
    want = library(str(path), TRICKY)
    assert isinstance(own, encode.Whole) and counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
    assert encode.Library(vocabulary("byte_bpe_50k.json")).known and encode.Library(vocabulary("word_bpe_49k.json")).known
    assert want != library(vocabulary("byte_bpe_50k.json"), TRICKY) and Tokenizer.from_file(str(path))
    encode.forget()


def test_chunks_follow_the_text():
    """Slices of a batch: every row once, few bytes at a time, a row larger than the budget alone."""
    import pyarrow as pa

    texts = ["é" * 30, "", "x" * 500, "", "y", "z" * 3_000_000, "", "w" * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    for budget in (100, 2_000_000):
        got = list(encode.chunks([batch, batch.slice(0, 0), batch.slice(3)], budget))
        assert [t for _, part in got for t in part] == texts + texts[3:]
        assert [i for b, _ in got for i in b.column(0).to_pylist()] == [*range(8), *range(3, 8)]
        assert all(len(part) == 1 or sum(len(t.encode()) for t in part) <= budget for _, part in got)


def test_bpe_is_the_library(vocabulary):
    from tokenizers import Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(1)
    tokenizer = Tokenizer.from_file(path)
    codec, own = bpe.codec(path)
    texts = TRICKY + ["".join(rng.choice("abcdehilnorst   éñ.,!-=\n1") for _ in range(300)) for _ in range(200)]
    texts += ["".join(rng.choice(["an", "th", "in", "er", "s", "e", " ", "tion"]) for _ in range(60)) for _ in range(100)]
    ids, counts = own.encode(texts)
    want = library(path, texts)
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
    assert codec.decode(ids, counts) == [tokenizer.decode(w, skip_special_tokens=False) for w in want]
    words = [codec.bytes[i].decode("latin-1") for i in range(0, 50000, 7)]
    raw = [w.encode("latin-1") for w in words]
    for w, r in zip(words, raw):
        try:
            text = r.decode()
        except UnicodeDecodeError:
            continue
        if text.strip() and codec.pretokens.findall(text) == [text]:
            assert codec.encode_words([text]) == [tokenizer.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("table", ["edges", "docs"])
def test_digests_and_counts(table, vocabulary, request):
    from tokenizers import Tokenizer

    df, path = request.getfixturevalue(table), vocabulary("byte_bpe_50k.json")
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    ids, tokenizer = library(path, [t for _, t in rows]), Tokenizer.from_file(path)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    got = Counter(tuple(r) for r in bpe.digests(df, path).collect())
    assert got == Counter((d, len(i), sha(np.array(i, "<u4").tobytes()), sha(tokenizer.decode(i, skip_special_tokens=False).encode())) for (d, _), i in zip(rows, ids))
    got = Counter(tuple(r) for r in token_counts.token_counts(df, path).collect())
    assert got == Counter((d, len(t.encode()), len(i), len(i) > 1024) for (d, t), i in zip(rows, ids))


def test_round_trip(edges, vocabulary):
    got = bpe.round_trip(edges, vocabulary("byte_bpe_50k.json")).collect()
    assert Counter((r.doc_id, r.decoded) for r in got) == Counter((r.doc_id, r.text or "") for r in edges.collect())
    assert all(len(r.ids) == r.n_tokens for r in got)


# token files

@pytest.mark.parametrize("n,m", [(0, 5), (1, 1), (5000, 50257), (3000, 7), (513, 2), (512, 300), (700, 70000)])
def test_wavelet_matrix(n, m):
    a = np.random.default_rng(n).integers(0, m, n)
    names, counts, w = wavelet.from_file(wavelet.to_file([None, 5, 9], [0, n, 0], a))
    assert names == [None, 5, 9] and counts.tolist() == [0, n, 0] and (w.tokens() == a).all()
    assert [w.access(i) for i in range(0, n, 97)] == a[::97].tolist()
    for t in set(a[:20].tolist()) | {0, m + 3}:
        assert w.count(t) == (a == t).sum() and w.rank(t, n // 2) == (a[: n // 2] == t).sum()
        assert w.occurrences(t) == np.nonzero(a == t)[0].tolist()


@pytest.mark.parametrize("table,shard", [("docs", 5000), ("edges", 1 << 20)])
def test_token_files(table, shard, vocabulary, request):
    df, path = request.getfixturevalue(table), vocabulary("byte_bpe_50k.json")
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r))
    files = wavelet.write_shards(df, path, shard=shard)
    assert shard > 5000 or files.count() > 20
    got = sorted(wavelet.read_shards(files).collect(), key=lambda r: r.start)
    start, want = 0, []
    for (d, _), ids in zip(rows, library(path, [t for _, t in rows])):
        ids = np.array([*ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_empty(empty, vocabulary):
    assert wavelet.read_shards(wavelet.write_shards(empty, vocabulary("byte_bpe_50k.json"))).count() == 0


# packing

@pytest.mark.parametrize("limits", [{}, {"rule": "dot"}, {"docs": 3}, {"cost": 2048 * 1024}, {"docs": 2, "cost": 2048 * 1024, "rule": "dot"}])
def test_best_fit(limits):
    lengths = np.random.default_rng(0).integers(1, 1400, 800)
    bins, offsets = best_fit.best_fit(lengths, **limits)
    for b in range(bins.max() + 1):
        mine = np.nonzero(bins == b)[0]
        order = mine[np.argsort(offsets[mine])]
        assert (offsets[order] == np.cumsum(lengths[order]) - lengths[order]).all()
        assert lengths[mine].sum() <= 2048 and len(mine) <= limits.get("docs", 2048) and (lengths[mine] ** 2).sum() <= limits.get("cost", 2048**2)
    if not limits:
        assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 2048) + 1


def check_packing(got, texts, path):
    """texts: (doc_id, text) of all rows."""
    want = []
    for (d, _), ids in zip(texts, library(path, [t or "" for _, t in texts])):
        ids = np.array([*ids, 0], "<u4")
        want += [(d, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append((r.offset, r.length))
    for rows in of.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(of) <= 1.03 * -(-sum(w[3] for w in want) // 2048) + 2


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_pack(table, vocabulary, request):
    df, path = request.getfixturevalue(table), vocabulary("word_bpe_49k.json")
    check_packing(best_fit.pack(df, path).collect(), [(r.doc_id, r.text) for r in df.collect()], path)


def test_pack_empty(empty, vocabulary):
    assert best_fit.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


# near-duplicates

@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, plain, width):
    got = minhash.near_duplicates(docs, width=width).collect()
    want = brute.components([(d, t) for d, t, _ in plain], width)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(brute.shingles(t, width)) for r, (_, t, _) in zip(sorted(got), sorted(plain)))


def test_chains_and_hot_group(spark):
    """A chain of texts, each close to the next only, and a group of copies that are close to their origin only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows, chain = [(0, " ".join(base))], list(base)
    for i in range(1, 12):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((i, " ".join(chain)))
    origin = [word() for _ in range(150)]
    for i in range(100, 250):
        copy = list(origin)
        for k in rng.sample(range(150), rng.choice([1, 3, 6, 9, 14])):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    rows += [(300 + i, "Same Text" if i % 2 else "same text") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width=2).collect()}
    assert got == brute.components(rows)


def test_near_duplicates_edges(edges, empty):
    got = minhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    of = {r.doc_id: r for r in got}
    assert of[2].n_shingles == of[3].n_shingles == 0 and of[2].component_id == 2 and of[4].n_shingles == 1
    assert of[6].component_id == of[7].component_id == 5 and of[5].kept and not of[6].kept
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = minhash.deduplicate(edges)
    assert kept.columns == edges.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[8] == 2 and 6 not in ids and 7 not in ids and ids[5] == ids[1] == ids[2] == 1
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_no_coincidence_loses_a_link(spark, monkeypatch):
    """With hashes of which many coincide in the bits that step 4 compares, the components stay those of the full sets."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    origin, rows = [word() for _ in range(400)], []
    for i in range(60):  # close to some others, seldom to the pivot
        copy = list(origin)
        for k in rng.sample(range(400), 24):
            copy[k] = word()
        rows.append((i, " ".join(copy)))
    mixed = minhash._mixed
    monkeypatch.setattr(minhash, "_mixed", lambda x: mixed(x) & ~np.uint64(0x7FFFFF80))  # 7 of the 31 bits are left
    sets = [minhash.shingle_hashes(t, 2) for _, t in rows]
    assert all(len(set((s & np.uint64(0x7FFFFFFF)).tolist())) <= 128 for s in sets)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == brute.components(rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(30)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    top = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {x: t for x, t in top.items() if any(x in e and e[0] != e[1] for e in edges)}
