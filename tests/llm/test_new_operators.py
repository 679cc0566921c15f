"""Toxicity, alignment of two tokenizers and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracelat.llm import alignment, merkle, toxicity

# Merkle manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, kept string, n double"


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node the (before, after) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for path, i in zip(paths, at):
            run = runs[i // 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes, at = [H(*r) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def audited(rows):
    of, out = defaultdict(list), []
    for r in rows:
        of[r[1]].append(r)
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        of[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in of[s]]) for s in sources]
    root, above = tree([t[0] for t in trees]) if trees else ("", [])
    for s, (sub, paths), up in zip(sources, trees, above):
        for r, path in zip(of[s], paths):
            now, even = leaf_of(r), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            if even and r[4] is not None:
                now = leaf_of((*r[:4], r[4].replace("\n", "")))
            for before, after in path + up:
                now = H(before, now, after)
            out.append((r[0], leaf_of(r), sub, root, H(*(b + a for b, a in path + up)), now, now == root))
    return Counter(out)


def dataset(rng, n_sources, most):
    rows = []
    for s in [None, "", "é", "B", "a", "a b", *(f"s{i}" for i in range(n_sources))]:
        for _ in range(rng.choice([1, 2, 3, 4, 9, 10, most])):
            text = rng.choice([None, "", "plain", "two\nlines", "a\n\nb é 😀"])
            rows.append((rng.choice([None, len(rows), len(rows), -len(rows)]), s, rng.choice([None, "en", ""]), rng.choice([None, 3]), text))
    return rows + rows[:5]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels, monkeypatch):
    """Rounds of few levels join blocks to the next round's nodes; one round of eight holds all."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = dataset(random.Random(levels), 8 if levels > 1 else 2, 70 if levels > 1 else 20)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], COLUMNS).repartition(3)
    got = Counter(tuple(r) for r in merkle.audit(df).collect())
    assert got == audited(rows)
    if levels == 8:  # a lone row, and no rows
        one = spark.createDataFrame([(5, None, "en", 1, "a\nb", None, None)], COLUMNS)
        assert Counter(tuple(r) for r in merkle.audit(one).collect()) == audited([(5, None, "en", 1, "a\nb")])
        assert merkle.audit(df.limit(0)).count() == 0


def test_manifest_of_the_table(docs):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = [tuple(r) for r in merkle.audit(docs).collect()]
    assert Counter(got) == audited(rows) and 0 < sum(r[-1] for r in got) < len(got)


# alignment

def plain_groups(a, b):
    ends = sorted(set(a) & set(b))
    return [sum(x <= e for x in a) for e in ends], [sum(x <= e for x in b) for e in ends]


def test_groups():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 40, 150):
        for share in (0.02, 0.5, 0.9, 0.99, 1.0):
            for _ in range(20):
                a = sorted({*rng.sample(range(1, n + 1), max(1, int(n * share))), n})
                b = sorted({*(x for x in a if rng.random() < share), *rng.sample(range(1, n + 1), max(1, int(n * (1 - share)))), n})
                assert alignment.groups(a, b) == plain_groups(a, b)
    assert alignment.groups([], []) == ([], [])


def test_links_of_large_groups(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 200)
    of_a, of_b = np.array([1, 150, 151, 300]), np.array([1, 101, 103, 200])
    want = Counter((int(x) << 32) + int(y) for i, j, k, m in zip([0, *of_a], of_a, [0, *of_b], of_b) for x in a[i:j] for y in b[k:m])
    for most in (4096, 1, 1 << 20):
        monkeypatch.setattr(alignment, "SPELLED", most)
        pairs, times = alignment.linked(a, b, of_a, of_b)
        assert dict(zip(pairs.tolist(), times.tolist())) == want and (np.diff(pairs) > 0).all()


def plain_alignment(rows, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    t.encode_special_tokens = True
    letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    found, counts, best = [], Counter(), Counter()
    for doc, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        spell_a = [bytes(letter[c] for c in t.id_to_token(i)) for i in a]
        spell_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("\u2581", " ").encode() for p in map(sp.id_to_piece, b)]
        if not text or b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            found.append((doc, 0, 0, 0, Counter(), ""))
            continue
        of_a, of_b = plain_groups(np.cumsum(list(map(len, spell_a))).tolist(), np.cumsum(list(map(len, spell_b))).tolist())
        spans = [(a[i:j], b[k:m]) for i, j, k, m in zip([0, *of_a], of_a, [0, *of_b], of_b)]
        links = Counter((x, y) for xs, ys in spans for x in xs for y in ys)
        counts.update(set(links))
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in spans)
        found.append((doc, len(a), len(b), len(spans), links, H(said)))
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter((doc, a, b, g, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), said)
                   for doc, a, b, g, links, said in found)


@pytest.mark.parametrize("table,heavy", [("edges", 200_000), ("docs", 200_000), ("docs", 30)])
def test_alignment(table, heavy, vocabulary, request, monkeypatch):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    df = request.getfixturevalue(table)
    if table == "edges":
        more = ["\u2581x y", "a  b   c", " lead", "trail ", "tab\tand\r\n", "<s> </s> <unk> <0x41>", "日本語 안녕 😀", "=" * 50 + "-" * 77, "\x00\x01", "Ā̶", "\u3000wide\u00a0no"]
        extra = df.sparkSession.createDataFrame([(50 + i, t, None, None, None, None) for i, t in enumerate(more)], df.schema)
        df = df.unionByName(extra)
    else:
        df = df.limit(60)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    if table == "edges":  # plain_groups is quadratic: one copy of the long texts
        rows = [(d, t) for d, t in rows if d not in (6, 7)]
        df = df.filter("doc_id IS NULL OR doc_id NOT IN (6, 7)")
        rows = [(d, t if d != 5 else t[:3000]) for d, t in rows]
        from pyspark.sql import functions as F
        df = df.withColumn("text", F.when(F.col("doc_id") == 5, F.substring("text", 1, 3000)).otherwise(F.col("text")))
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    got = Counter(tuple(r) for r in alignment.report(df, *paths).collect())
    assert got == plain_alignment(rows, *paths)


def test_alignment_empty(empty, vocabulary):
    assert alignment.report(empty, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 0


# toxicity

def test_terms():
    terms = toxicity.Terms()
    assert terms.of("Fool, FOOL fool!") == sorted(set(toxicity.buckets("fool"))) and len(toxicity.buckets("fools")) == 4
    assert terms.of("12 ?! _") == [] == terms.of("") and toxicity.words("a1b É_x") == {"a", "b", "é", "x"}


def test_scores_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Model(np.arange(30), -0.5, rng.normal(0, 0.3, 30), rng.normal(0, 0.3, (30, 4)))
    inputs = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 9, 30)]
    for x, s in zip(inputs, m.scores(inputs)):
        total = m.w0 + sum(m.w[i] for i in x) + sum(m.v[i] @ m.v[j] for i in x for j in x if i < j)
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-12


def test_pairs_are_learned():
    """Neither term says anything alone, both together decide: additive weights can't tell."""
    rng = np.random.default_rng(4)
    inputs = [[i for i in range(12) if rng.random() < 0.5] for _ in range(3000)]
    y = np.array([(0 in x) == (1 in x) for x in inputs], np.float32)
    m = toxicity.trained(toxicity.Model(np.arange(12), 0.0, np.zeros(12), np.zeros((12, toxicity.FACTORS))), pa.array(inputs, pa.list_(pa.int32())), y)
    assert ((m.scores(inputs) >= 0.5) == (y > 0)).mean() > 0.95


def test_toxicity_on_held_out_rows(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/labels.parquet")
    every = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    got = {r.doc_id: r for r in toxicity.judged(every, labels).collect()}
    assert len(got) == every.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    known = [(r.toxic, got[r.doc_id]) for r in labels.collect() if r.doc_id in got]
    toxic = [g.predicted for t, g in known if t and g.held_out]
    clean = [g.predicted for t, g in known if not t and g.held_out]
    assert len(toxic) > 50 and np.mean(toxic) > 0.75 and np.mean(clean) < 0.01


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (5, 1, "x"), (5, 0, "x"), (6, 1, "x"), (7, 1, "x"), (8, 0, "x"), (9, 0, "x"), (10, 0, "x"), (None, 1, "x"), (11, None, "x"), (777, 1, "x")],
                                   "doc_id long, toxic int, text string")
    got = toxicity.judged(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    by_text = {r.doc_id: r.score for r in got}
    assert by_text[1] == by_text[2] == by_text[3] and by_text[5] > by_text[4]
    assert toxicity.judged(empty, labels).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in toxicity.judged(edges, none).collect()} == {0}
    assert toxicity.fit(edges, labels, rows=3).w0 == toxicity.fit(edges.repartition(2), labels, rows=3).w0
