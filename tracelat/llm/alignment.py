"""Alignment of two tokenizers' tokens by diagonal run skipping.

A space and a text are encoded by A (a byte-level BPE file of the tokenizers library) and the text by B (a SentencePiece
model, which adds the space), without special tokens; both token sequences spell the same bytes.  The byte offsets
where tokens of both end cut them into groups.  Where the model allows it, each worker keeps B's ids of pieces beside A's.

Tokens' ends are two ascending arrays.  Where i tokens of A and j of B are done, the arrays are compared along the current
shift j - i: stretches of 1, 2, 4, ... equal ends are jumped as long as they agree, and halves of the last one find where
they stop; all tokens jumped are groups of one to one.  The group that follows is irregular: the sequence that is behind takes its
next token until both end at one place; that sets the shift anew.

Links are all pairs of an A and a B token of one group.  A pair of ids counts once for each document that has it linked.
Counts are pre-aggregated in the map tasks.  Fewer than ``HEAVY`` pairs can be in more than a ``HEAVY``-th of all
documents' pairs each: these are broadcast, so no other key of the shuffled join can be hot, and they take most rows.

A null or empty text, or one whose tokens of either kind spell other bytes (characters that a model lacks or changes), has no
tokens: zeros.  Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import stored, texts
from tracelat.llm.encode import Cached, Library, Pool, Whole, _IRREGULAR, _places, byte_letters, chunks, kept

#: Bound of the pairs that are broadcast.
HEAVY = 200_000
#: Links of a group that are written out one by one; beyond, its distinct ids are paired.
SPELLED = 4096
#: pairs: the linked id pairs, A's id * 2 ** 32 + B's; times: how often each is linked.
ROWS = ("uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each sequence are done at the end of each group; ``a`` and ``b`` are the tokens' ends and have the
    same last one."""
    of_a, of_b = _groups(a, b)
    return of_a.tolist(), of_b.tolist()


def _groups(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    i, j, n, at_a, at_b, runs = 0, 0, len(a), [], [], []
    while i < n:
        # the next group's end, then the run of groups of one to one behind it
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        at_a.append(i + 1)
        at_b.append(j + 1)
        run = step = 1
        while (part := a[i + run : i + run + step]) and part == b[j + run : j + run + step]:
            run += len(part)
            step *= 2
        while step > 1:  # the stretch that didn't agree, by halves
            step //= 2
            if (part := a[i + run : i + run + step]) and part == b[j + run : j + run + step]:
                run += len(part)
        runs.append(run)
        i, j = i + run, j + run
    runs = np.array(runs, np.int64)
    return _places(np.array(at_a, np.int64), runs), _places(np.array(at_b, np.int64), runs)


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked id pairs, ascending, and how often each is linked."""
    size_a, size_b = np.diff(of_a, prepend=0), np.diff(of_b, prepend=0)
    count = size_a * size_b
    few = count <= SPELLED
    n, start_a, start_b, wide = count[few], (of_a - size_a)[few], (of_b - size_b)[few], size_b[few]
    ends = np.cumsum(n)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    wide = np.repeat(wide, n)
    keys = (a[np.repeat(start_a, n) + nth // wide].astype(np.int64) << 32) + b[np.repeat(start_b, n) + nth % wide]
    pairs, times = np.unique(keys, return_counts=True)
    for g in np.nonzero(~few)[0]:
        x, nx = np.unique(a[of_a[g] - size_a[g] : of_a[g]], return_counts=True)
        y, ny = np.unique(b[of_b[g] - size_b[g] : of_b[g]], return_counts=True)
        pairs = np.concatenate([pairs, ((x.astype(np.int64) << 32)[:, None] + y).ravel()])
        pairs, back = np.unique(pairs, return_inverse=True)
        times = np.bincount(back, np.concatenate([times, (nx[:, None] * ny).ravel()])).astype(np.int64)
    return pairs, times


def by_pieces(model) -> bool:
    """Whether a SentencePiece model encodes a text as its pieces, cut before each space that stands alone: characters stay
    as they are, and no entry joins a space to what is before it, other than spaces."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:  # it needs protobuf
        return False
    said = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    how, trained = said.normalizer_spec, said.trainer_spec
    return (trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix and not how.precompiled_charsmap and how.add_dummy_prefix
            and how.escape_whitespaces and not how.remove_extra_whitespaces and len(said.pieces) <= 65536
            and not any("▁" in p.piece.lstrip("▁") or p.type == p.USER_DEFINED for p in said.pieces))


class Both(Cached):
    """A's cache, with B's ids of the same pieces beside; its texts begin with the space that B adds."""

    def __init__(self, encode_new, model):
        self.model = model
        super().__init__(encode_new, {})

    def clear(self) -> None:
        super().clear()
        self.pool_b = Pool()

    def shrink(self) -> np.ndarray:
        old = self.pool_b
        kept = super().shrink()
        self.pool_b.copy(old, kept)
        return kept

    def flush(self) -> None:
        if self.pool.new:
            ids = self.model.encode([p[1:] for p in self.pool.new], num_threads=1)
            self.pool_b.add(list(itertools.chain.from_iterable(ids)), list(map(len, ids)))
        super().flush()

    def encode_both(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of each text."""
        rows, of_text = self.looked_up(texts)
        a, b = (np.split(ids, np.cumsum(counts)[:-1]) for ids, counts in (self.pool.ids_of(rows, of_text), self.pool_b.ids_of(rows, of_text)))
        for i, text in enumerate(texts):
            if _IRREGULAR.search(text):  # B may join spaces where pieces are cut
                b[i] = np.array(self.model.encode(text[1:]), np.int64)
        return a, b


class Pair:
    """Both tokenizers, and what their tokens spell."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        library = Library(path_a, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.both = library.known and by_pieces(self.b)
        self.a = Both(library.encode_new, self.b) if self.both else Cached(library.encode_new, {}) if library.known else Whole(library.tokenizer)
        letters = {c: n for n, c in byte_letters().items()}
        vocabulary = library.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # then A spells every text
        self.lossless = library.known and not library.lower and set(letters) <= set(vocabulary)
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # a token's decimal id with what follows it: in its group, and at its end
        self.said_a = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))]
        self.said = self.said_a + [f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Each text's ids; None if they don't spell a space and the text."""
        spaced = [" " + t for t in texts]
        if self.both:
            of_a, of_b = self.a.encode_both(spaced)
        else:
            ids, counts = self.a.encode(spaced)
            of_a, of_b = np.split(ids, np.cumsum(counts)[:-1]), [np.array(b, np.int64) for b in self.b.encode(texts, num_threads=1)]
        out = []
        for t, a, b in zip(texts, of_a, of_b):
            raw = b" " + t.encode()
            same = t and (self.lossless or b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw) and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw
            out.append((a.astype(np.int64), b.astype(np.int64)) if same else None)
        return out

    def spelled(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        """The groups: ids of A, ids of B, group after group."""
        size_a, size_b = np.diff(of_a, prepend=0), np.diff(of_b, prepend=0)
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[of_a - 1], last_b[of_b - 1] = len(self.bytes_a), len(self.bytes_b)
        codes[np.arange(len(a)) + np.repeat(of_b - size_b, size_a)] = a + last_a
        codes[np.arange(len(b)) + np.repeat(of_a, size_b)] = b + last_b + len(self.said_a)
        return "".join(map(self.said.__getitem__, codes.tolist()))[:-1]

    def row(self, ids) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of a text."""
        if ids is None:
            return 0, 0, 0, 0, "", [], []
        a, b = ids
        of_a, of_b = _groups(np.cumsum(self.size_a[a]).tolist(), np.cumsum(self.size_b[b]).tolist())
        pairs, times = linked(a, b, of_a, of_b)
        return len(a), len(b), len(of_a), int(times.sum()), hashlib.sha256(self.spelled(a, b, of_a, of_b).encode()).hexdigest(), pairs, times


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document's groups and linked id pairs (``ROWS``); uid tells rows apart."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        from pyspark import TaskContext

        own, uid = kept(("alignment", path_a, path_b), lambda: Pair(path_a, path_b)), TaskContext.get().partitionId() << 40
        for part, text in chunks(batches, 500_000):
            rows = list(zip(*map(own.row, own.encode(text))))
            columns = [range(uid, uid + len(text)), part.column(0), *rows]
            uid += len(text)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts(docs).mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, docs (documents that have it linked) and best (none of its A id's pairs has more)."""
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))  # as many rows as A has ids
    return counts.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's most frequent one), count_sum
    (the sum of the links' pairs' counts) and groups_sha256."""
    rows = stored(aligned(docs, path_a, path_b), "aligned", compression="zstd")
    counts = stored(pair_counts(rows), "pairs")
    every = counts.agg(F.sum("docs")).first()[0] or 0
    heavy = F.col("docs") * HEAVY > every  # fewer than HEAVY pairs
    links = rows.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("uid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    known = counts.filter(heavy)
    found = links.join(F.broadcast(known), "pair")
    others = links.join(F.broadcast(known.select("pair")), "pair", "left_anti").join(counts.filter(~heavy), "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    both = found.groupBy("uid").agg(*sums).unionByName(others.groupBy("uid").agg(*sums)).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(both, "uid", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
