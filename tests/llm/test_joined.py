"""Ids joined from pieces: the library's, with few calls of its model, and a cache of bounded size."""

import pytest

from tracelat.llm import encode
from tests.llm.test_free import TRICKY, library


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_joined_ids_are_the_library_s(vocabulary, plain, name, monkeypatch):
    monkeypatch.setattr(encode, "GENERATION", 1500)  # generations go
    monkeypatch.setattr(encode, "WORDS", 200)
    texts = [t for _, t, _ in plain[:60]] + TRICKY + ["", " ", "Àé stant, Stant.\nStant's stant5 <|endoftext|>"]
    own, most = encode.Joined(encode.Library(vocabulary(name))), 0
    for _ in range(2):
        for i in range(0, len(texts), 11):
            ids, counts = own.encode(texts[i : i + 11])
            want = library(vocabulary(name), texts[i : i + 11])
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
            most = max(most, len(own.rest.before))
    assert most > 1500 and not own.rest.before.before  # a generation went, and none is held behind the one before
    assert own.encode([])[0].tolist() == [] and own.encode([""])[1].tolist() == [0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_the_model_runs_once_for_a_word(vocabulary, name):
    """op5_wavelet_files, op6_best_fit: a word with signs around it is the same word."""
    encode.forget()
    own = encode.encoder(vocabulary(name))
    words = own.library.words
    model, asked = words.tokenize, []
    words.tokenize = lambda letters: asked.append(letters) or model(letters)
    text = "x oughtiness oughtiness, (oughtiness oughtiness. oughtiness!\nx oughtiness$$$ oughtiness"
    ids, _ = own.encode([text, text])
    encode.forget()
    assert ids.tolist() == library(vocabulary(name), [text])[0] * 2
    assert sum("oughtiness" in a for a in asked) <= (1 if own.library.lower else 2)  # with a space before it, and without
