"""Long texts with runs that aren't valid: the same pseudonyms, in a time that follows the length."""

import random
import time

from tests.llm import brute
from tests.llm.test_advice_r02_numbers import CARD, IBAN, pieces

RUN = "1234 5678 9012 3456 7890"


def text_of(n_values, n_runs, seed=3):
    rng = random.Random(seed)
    every = [rng.choice([CARD, "4041894974608795", "2024-05-31", "a.b1@mail9.org", "+1 988 555 2485", "10.0.0.1"]) for _ in range(n_values)]
    for i in rng.sample(range(n_values), n_runs):
        every[i] = rng.choice([RUN, f"{RUN} {CARD}", f"{CARD} 12 {CARD} 99", f"{IBAN} EUR 77"])
    return every


def expected(text):
    return "".join(brute.pseudonym(kind, v, "k") if kind else v for v, kind in pieces(text))


def test_windows_find_what_one_search_finds(spark):
    from tracelat.llm import pseudonyms

    rng = random.Random(4)
    texts = []
    for seps in ([" "], [" ", "-", " "], [" ", ", ", "\n", " x ", " y: ", "  ", " é", "😀"]):
        for seed in range(12):
            values = text_of(40, 8, seed) + ["12", "999", "EUR", "1234 5678"] * 5
            rng.shuffle(values)
            texts.append("".join(v + rng.choice(seps) for v in values))
    texts.append(" ".join(str(rng.randrange(10 ** rng.randrange(1, 9))) for _ in range(700)))  # one stretch of numbers
    texts.append("é".join(text_of(30, 10)) + " " + "9" * 700 + " " + "-".join(["1234"] * 60) + f" {CARD} 1")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    for i, text in enumerate(texts):
        assert got[i] == expected(text), i


def test_time_follows_the_length(spark, tmp_path):
    from tracelat.llm import pseudonyms

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    took = {}
    for name, runs in (("warm", 100), ("plain", 0), ("runs", 100)):
        text = " ".join(f"{word()} {word()} {word()} {word()} {word()} {word()} {word()} {word()} {word()} {word()} {word()} {v}" for v in text_of(10_000, runs))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        got = pseudonyms.pseudonymise(df, "k").collect()[0].text
        took[name] = time.perf_counter() - began
        assert len(text) > 1_000_000 and got.count(" ") == text.count(" ")
        if name == "runs":
            assert got == expected(text)
    assert took["runs"] <= 2 * took["plain"] + 1, took
