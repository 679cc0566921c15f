"""Whole texts to token ids with the tokenizers library, through a cache of pieces in each Python worker.

A text is cut before each space that a non-space follows.  The pre-tokenizers of the vocabularies used here never
join characters across such a place, so the ids of a text are the ids of its pieces one after the other (the tests
compare with the library on whole texts).  Words repeat, so nearly all pieces come from the cache; the library
encodes the others.  When the cache holds more than ``LIMIT`` pieces, those met only once since the last such time go.
``Joined`` keeps each piece's ids as bytes, so a text's ids are joined from them without a number for each piece; it
serves those that want ids alone.  ``Cached`` keeps them in a pool of rows, for those that keep more with each piece.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in a worker's cache, and pre-tokens beside them: measured together, about 75 MB when full.
LIMIT, WORDS = 300_000, 100_000
#: Pieces in each of the two generations of ``Joined``: over 104 MB of text a process peaked 30 to 48 MB higher than with ``Cached``.
GENERATION = 400_000

#: A space before a space or the end: then the text isn't cut at every space.
_IRREGULAR = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
#: Pieces that are one pre-token.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: Pieces whose pre-tokens the patterns below give.
_SIMPLE = re.compile(r"[\x20-\x7E\nÀ-ÖØ-öø-ÿ]+\Z")
# The vocabularies' pre-token patterns, with letters and digits of the characters above.
_BYTE_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
# The normalisers and pre-tokenizers of files that the patterns are for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_LOWER_CASE = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_LOWER_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {**_BYTE_LEVEL, "use_regex": False}]}
_LOWER_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")


def cut(text: str) -> list[str]:
    """Pieces; before each but the first stood one space."""
    return _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for themselves,
    the others, in order, for the code points from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Piece to its row in the pool; a new piece gets the next row and waits in ``new`` to be encoded."""

    def __init__(self, pool: "Pool", lead: str):
        super().__init__()
        self.pool, self.lead = pool, lead

    def __missing__(self, piece: str) -> int:
        row = self[piece] = self.pool.rows
        self.pool.rows += 1
        self.pool.new.append(self.lead + piece)
        return row


class Pool:
    """Ids of cached pieces, one after the other: row r is ids[at[r] : at[r] + length[r]]."""

    def __init__(self):
        self.rows, self.new = 0, []
        self.ids = np.empty(1 << 16, np.uint16)
        self.at, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.met = np.zeros(1 << 15, np.int64)
        self.filled = self.used = 0

    def count(self, rows: np.ndarray) -> None:
        met = np.bincount(rows, minlength=0)
        self.met[: len(met)] += met

    def add(self, flat, sizes) -> None:
        """The next rows: their ids one after the other, and how many each has."""
        flat, sizes = np.asarray(flat, np.uint16), np.asarray(sizes, np.int64)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.filled + len(sizes) > len(self.at):
            self.at, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.met))
        self.ids[self.used : self.used + len(flat)] = flat
        rows = slice(self.filled, self.filled + len(sizes))
        self.length[rows] = sizes
        self.at[rows] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.filled += len(sizes)

    def ids_of(self, rows: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one after the other, and how many each text has."""
        length = self.length[rows]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.ids[_places(self.at[rows], length)], np.diff(ends[of_text])

    def copy(self, old: "Pool", kept: np.ndarray) -> None:
        """These rows of another pool as the next ones."""
        size = old.length[kept]
        self.add(old.ids[_places(old.at[kept], size)], size)


class Cached:
    """Encodes texts through the cache; ``encode_new`` takes new pieces, each with its leading space, to their
    ids one after the other (all below 65 536) and how many each has; ``specials`` maps strings that are one token wherever they occur to their ids."""

    def __init__(self, encode_new, specials: dict[str, int], limit: int | None = None):
        self.encode_new, self.specials, self.limit = encode_new, specials, limit
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.clear()

    def clear(self) -> None:
        self.pool = Pool()
        self.first, self.rest = Pieces(self.pool, ""), Pieces(self.pool, " ")

    def shrink(self) -> np.ndarray:
        """Keep the pieces that were met more than once since the last time, half of the limit at most; their rows."""
        old, kept, limit = self.pool, [], self.limit or LIMIT
        rows = np.nonzero(old.met[: old.filled] > 1)[0]
        again = np.zeros(old.filled, bool)
        again[rows if 2 * len(rows) <= limit else rows[np.argsort(-old.met[rows], kind="stable")[: limit // 2]]] = True
        caches = (self.first, self.rest)
        self.clear()
        for cache, now in zip(caches, (self.first, self.rest)):
            for piece, row in cache.items():
                if again[row]:
                    now[piece] = self.pool.rows
                    self.pool.rows += 1
                    kept.append(row)
        kept = np.array(kept, np.int64)
        self.pool.copy(old, kept)
        return kept

    def rows(self, text: str) -> np.ndarray:
        """The rows of a text's pieces."""
        if self.split and any(s in text for s in self.specials):
            return np.concatenate([np.array([self.special(part)]) if part in self.specials else self.rows(part) for part in self.split.split(text)])
        pieces = cut(text)
        rows = np.empty(len(pieces), np.int64)
        rows[1:] = np.fromiter(map(self.rest.__getitem__, itertools.islice(pieces, 1, None)), np.int64, len(pieces) - 1)
        if not pieces[0]:
            return rows[1:]
        rows[0] = self.first[pieces[0]]
        return rows

    def special(self, string: str) -> int:
        """Its row; kept under a name that no piece can have."""
        if (name := (string,)) not in self.first:
            self.flush()
            self.first[name] = self.pool.rows
            self.pool.rows += 1
            self.pool.add([self.specials[string]], [1])
        return self.first[name]

    def flush(self) -> None:
        if self.pool.new:
            self.pool.add(*self.encode_new(self.pool.new))
            self.pool.new = []

    def looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all texts' pieces one after the other, and where each text's begin and end."""
        if self.pool.rows > (self.limit or LIMIT):
            self.shrink()
        rows = [self.rows(text) for text in texts]
        of_text = np.cumsum([0, *map(len, rows)])
        self.flush()
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.pool.count(rows)
        return rows, of_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        rows, of_text = self.looked_up(texts)  # may put another pool in place
        return self.pool.ids_of(rows, of_text)


def _places(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (length[0] of them), at[1], ..."""
    ends = np.cumsum(length)
    return np.repeat(at - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def chunks(batches, budget: int = 2_000_000):
    """(record batch, its rows' texts) in slices of about ``budget`` bytes of text; only a slice's texts are Python
    strings at a time, so memory follows neither the size of a batch nor its rows.  At the end what was allocated for
    the texts goes back to the system, so an idle worker holds no more than its caches."""
    try:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.empty(0, np.int64)
            start = 0
            while start < len(column):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + budget, "right")))
                yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
                start = stop
    finally:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


#: What this worker keeps between tasks: the caches of one operator, the last that asked.
_KEPT: dict = {}


def kept(name, make):
    """The worker's cache ``name``, made at need; those of other operators are given up for it."""
    if name not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Give up all that this worker keeps."""
    _KEPT.clear()
    give_back()


class Words(dict):
    """Pre-token to its ids (16-bit numbers in bytes), by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.space = byte_letters()[0x20]

    def ids(self, word: str) -> list[int]:
        # of the characters of pre-tokens in ASCII only white space has another letter
        letters = word.replace(" ", self.space) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(letters)]

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("H", self.ids(word)).tobytes()
        return ids


class Library:
    """The tokenizers library on pieces.  Pieces of printable ASCII, Latin letters and line ends are cut into
    pre-tokens here, and only the library's model runs, once for each pre-token that isn't cached; all other
    pieces go through the library's whole pipeline.  Without ``specials`` the strings of special tokens are plain text."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        self.specials = {t["content"]: t["id"] for t in said["added_tokens"]} if specials else {}
        self.tokenizer.encode_special_tokens = not specials
        form = (said["normalizer"], said["pre_tokenizer"])
        self.lower = form == (_LOWER_CASE, _LOWER_SPLIT)
        plain = all(not t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and said["post_processor"] is None
        #: Whether pieces may be encoded one by one: the file is of a form that the patterns are for.
        self.known = (self.lower or form == (None, _BYTE_LEVEL)) and plain and said["model"]["type"] == "BPE" and self.tokenizer.get_vocab_size() <= 65536
        self.pretokens = (_LOWER_WORDS if self.lower else _BYTE_WORDS).findall
        self.words = Words(self.tokenizer.model)

    def encode_new(self, pieces: list[str]) -> tuple[array, list[int]]:
        flat, sizes, words, pretokens, lower, model = array("H"), [], self.words, self.pretokens, self.lower, self.words.ids
        if len(words) > WORDS:
            words.clear()
        for piece in pieces:
            before = len(flat)
            if _PLAIN.match(piece):  # one pre-token; it is kept with the pieces
                flat.extend(model(piece.lower().strip(" ") if lower else piece))
            elif _SIMPLE.match(piece):
                for word in pretokens(piece.lower() if lower else piece):
                    flat.frombytes(words[word])
            else:
                flat.extend(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            sizes.append(len(flat) - before)
        return flat, sizes


class Ids(dict):
    """Piece to its ids (16-bit numbers in bytes); what neither this generation nor the one before has is encoded."""

    def __init__(self, encode_one, lead: str, before: dict):
        super().__init__()
        self.encode_one, self.lead, self.before = encode_one, lead, before

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode_one(self.lead + piece)
        self[piece] = ids
        return ids

    def next(self) -> "Ids":
        """The next generation; the one before this goes."""
        self.before = {}
        return Ids(self.encode_one, self.lead, self)


class Joined:
    """Encodes texts by joining the ids of their pieces, which the library (one of a known form) gives for new ones.  A
    generation that has more than ``GENERATION`` pieces becomes the one before, and of that one only pieces that are
    met again stay."""

    def __init__(self, library: Library):
        self.library, specials = library, library.specials
        self.specials = {string: array("H", [i]).tobytes() for string, i in specials.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.first, self.rest = Ids(self.encode_one, "", {}), Ids(self.encode_one, " ", {})

    def encode_one(self, piece: str) -> bytes:
        """A new piece's ids; the model runs once for a word, alone or with other characters around it."""
        library = self.library
        if _PLAIN.match(piece):
            return array("H", library.words.ids(piece.lower().strip(" ") if library.lower else piece)).tobytes()
        if not _SIMPLE.match(piece):
            return array("H", library.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        words, rest = library.words, self.rest
        if len(words) > WORDS:
            words.clear()
        # a word that may have a space before it is a plain piece
        if library.lower:
            return b"".join([rest[w] if w.isalpha() else words[w] for w in library.pretokens(piece.lower())])
        return b"".join([rest[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w] for w in library.pretokens(piece)])

    def ids(self, text: str) -> bytes:
        if self.split and any(s in text for s in self.specials):
            return b"".join([self.specials.get(part) or self.ids(part) for part in self.split.split(text)])
        pieces = cut(text)
        lead = self.first[pieces[0]] if pieces[0] else b""
        return lead + b"".join(map(self.rest.__getitem__, itertools.islice(pieces, 1, None)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.first) + len(self.rest) > GENERATION:
            self.first, self.rest = self.first.next(), self.rest.next()
        ids = [self.ids(text) for text in texts]
        return np.frombuffer(b"".join(ids), np.uint16), np.fromiter(map(len, ids), np.int64, len(ids)) // 2


class Whole:
    """Encodes whole texts by the library, for files of any other form."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def encoder(path: str) -> Joined | Whole:
    """This worker's encoder for a vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def make():
        library = Library(path)
        return Joined(library) if library.known else Whole(library.tokenizer)

    return kept(("encoder", path), make)
