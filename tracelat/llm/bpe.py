"""Exact byte-pair encoding in linear time, and decoding by an offset table.

Encoding.  Merging by rank gives the one sequence of tokens in which every neighbouring pair is *compatible*: merging
the bytes of the two alone gives back just these two.  So the merges need not be replayed.  One pass of an Aho-Corasick
automaton over all new pieces finds the longest token that starts at each byte; the encoder takes it if it is
compatible with the token before, else the longest token that is a prefix of it, and so on; with none left it takes
back the token before and marks the place it ended at as one that can't be reached.  Each place is marked at most once.

Compatibility is looked up in a table that fills as pairs are met: a pair fails if, while the two are undone merge by
merge from the latest, some merge would have joined across the boundary earlier.

Decoding.  All tokens' bytes lie in one array, with offsets: ids become bytes by one gather.

Nulls and empty texts have no tokens; special strings in a text are their single tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelat.llm.base import texts
from tracelat.llm.encode import Cached, byte_letters, chunks, kept

#: Stands between pieces in the automaton's input; no token has it.
GAP = "Ā"
#: Pairs in a worker's compatibility table.
PAIRS = 1_000_000

#: Pre-tokens, and pieces, whose ids a worker keeps: the own encoder's misses cost more than the library's.
WORDS = 500_000


class Bpe:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        to_byte = {c: b for b, c in byte_letters().items()}
        self.specials = {t["content"]: t["id"] for t in said["added_tokens"]}
        vocab = {"".join(chr(to_byte[c]) for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.specials}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = token.encode("latin-1")
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        # merges: the rank of each pair, and the pair and rank that make each token
        self.rank, self.parts, self.made = {}, [None] * self.size, [-1] * self.size
        for rank, merge in enumerate(said["model"]["merges"]):
            left, right = (vocab["".join(chr(to_byte[c]) for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            token = vocab[(self.bytes[left] + self.bytes[right]).decode("latin-1")]
            self.rank[left * 65536 + right] = rank
            if self.parts[token] is None:
                self.parts[token], self.made[token] = (left, right), rank
        self.compatible: dict[int, bool] = {}
        # the automaton, and for each token the longest token that is a shorter prefix of it
        self.automaton, self.shorter = ahocorasick.Automaton(), [-1] * self.size
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        for token, i in vocab.items():
            self.automaton.add_word(token, i)
            for n in range(len(token) - 1, 0, -1):
                if (j := vocab.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.buffer = np.frombuffer(b"".join(self.bytes), np.uint8)
        # a fixed value: the vocabulary's pre-token pattern
        self.pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.words: dict[str, list[int]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, alone, are encoded as these two."""
        key = left * 65536 + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # The two tokens that touch the boundary at some time, from the end of the merging backwards, and the rank of
        # the merge that ended that time.  A merge across the boundary takes place if its rank is below that.  Where
        # the ranks are equal, merges run from the left: one that made the left token came before a join to its right.
        until, until_is_left = len(self.rank), False
        while True:
            rank = self.rank.get(left * 65536 + right)
            if rank is not None and (rank < until or rank == until and not until_is_left):
                return False
            made_left, made_right = self.made[left], self.made[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right or made_left == made_right and made_right < 0:
                until, until_is_left, left = made_left, True, self.parts[left][1]
            else:
                until, until_is_left, right = made_right, False, self.parts[right][0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each pre-token."""
        raw = [w.encode().decode("latin-1") for w in words]
        joined = GAP.join(raw)
        found = np.fromiter(self.automaton.iter(joined), np.dtype([("end", np.int32), ("token", np.int32)]))
        longest = np.full(len(joined) + 1, -1, np.int64)
        order = np.argsort(self.length[found["token"]], kind="stable")  # of tokens with one start the longest stays
        end, token = found["end"][order], found["token"][order]
        longest[end - self.length[token] + 1] = token
        longest, at, out = longest.tolist(), 0, []
        for w in raw:
            first = longest[at]
            out.append([first] if len(w) == len(self.bytes[first]) else self._walk(longest, at, at + len(w)))
            at += len(w) + 1
        return out

    def _walk(self, longest: list[int], at: int, stop: int) -> list[int]:
        compatible, shorter, sizes, out, dead = self.compatible, self.shorter, self.bytes, [], set()
        token = longest[at]
        while True:
            end = at + len(sizes[token])
            if end not in dead and (not out or (f if (f := compatible.get(out[-1] * 65536 + token)) is not None else self.fits(out[-1], token))):
                out.append(token)
                if end == stop:
                    return out
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= len(sizes[token])
                token = shorter[token]

    def encode_new(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """For ``Cached``: pieces are cut into pre-tokens, and the new ones of all pieces are encoded together."""
        cut = [self.pretokens.findall(p) for p in pieces]
        new = list({w for words in cut for w in words if w not in self.words})
        if len(self.words) + len(new) > WORDS:
            self.words.clear()
            new = list({w for words in cut for w in words})
        for w, ids in zip(new, self.encode_words(new) if new else ()):
            self.words[w] = ids
        flat, sizes = [], []
        for words in cut:
            before = len(flat)
            for w in words:
                flat += self.words[w]
            sizes.append(len(flat) - before)
        return flat, sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ``counts`` ids."""
        length = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.buffer[np.repeat(self.offsets[ids] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        at = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def codec(path: str) -> tuple[Bpe, Cached]:
    """This worker's tables for a vocabulary file."""
    def make():
        bpe = Bpe(path)
        return bpe, Cached(bpe.encode_new, bpe.specials, WORDS)

    return kept(("codec", path), make)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Each document's tokens and decoded text: doc_id, n_tokens, ids (array of int), decoded."""
    return _mapped(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded string", _ids_and_text)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Each document's token count, the SHA-256 of its ids (little-endian, 32 bits) and of its decoded text."""
    return _mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _sums)


def _ids_and_text(of_doc, decoded):
    return [pa.array([x.tolist() for x in of_doc], pa.list_(pa.int32())), pa.array(decoded, pa.string())]


def _sums(of_doc, decoded):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return [pa.array([sha(x.astype("<u4").tobytes()) for x in of_doc]), pa.array([sha(x.encode()) for x in decoded])]


def _mapped(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        bpe, encoder = codec(path)
        for part, text in chunks(batches):
            ids, counts = encoder.encode(text)
            of_doc = np.split(ids, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *columns(of_doc, bpe.decode(ids, counts))], names)

    return texts(docs).mapInArrow(run, schema)
