"""Cards and IBANs that other groups follow, against an independent scan."""

import random

CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"


def pieces(text):
    """(value, kind or None) in order: an independent scan that tries every prefix of a run at its separators."""
    import re

    from tests.llm import brute
    from tracelat.llm.pseudonyms import KINDS

    every, at, out = re.compile("|".join(KINDS.values())), 0, []
    valid = {"card": lambda v: brute.luhn([int(c) for c in v if c.isdigit()]) == 0,
             "iban": lambda v: brute.mod97(v.replace(" ", "")[4:] + v.replace(" ", "")[:4]) == 1}
    while hit := every.search(text, at):
        m = hit[0]
        kind = next(k for k, p in KINDS.items() if re.fullmatch(p, m))
        out.append((text[at : hit.start()], None))
        if kind not in valid or valid[kind](m) or not re.search("[ -]", m):
            out.append((m, kind))
            at = hit.end()
            continue
        cuts = [m[: x.start()] for x in re.finditer("[ -]", m)]
        good = [c for c in cuts if re.fullmatch(KINDS[kind], c) and valid[kind](c) and (kind == "card" or len(c.replace(" ", "")) == {"ES": 24, "DE": 22, "GB": 22}[c[:2]])]
        out.append((max(good, key=len), kind) if good else (cuts[0], None))
        at = hit.start() + len(out[-1][0])
    return [*out, (text[at:], None)]


def test_numbers_before_other_groups_are_found(spark):
    from tests.llm import brute
    from tracelat.llm import pseudonyms

    texts = [f"card {CARD} 12/27", "card 4111111111111111 123", f"{IBAN} EUR", f"{IBAN.replace(' ', '')} EUR and {CARD.replace(' ', '-')}-99",
             f"order 12 {CARD} 12/27/2025 then {CARD}", f"{IBAN} {CARD} 123", f"{IBAN} 4111111111111111", "1234 5678 9012 3456 7890 no card",
             "DE89 3704 0044 0532 0130 00 USD 5 GB82 WEST 1234 5698 7654 32 OK", f"né 😀 {CARD} 1 mail a1@b2.org {CARD} 05 ip 10.0.0.1", "4111 1111 1111 1112 12"]
    rng = random.Random(9)
    tokens = [CARD, IBAN, "4041894974608795", "12", "999", "EUR", "1234", "2024-05-31", "12/27/2025", "x", "+1 988 555 2485", "123-45-6789", "é", "77777"]
    texts += [rng.choice([" ", "-", " "]).join(rng.choice(tokens) for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k", counts=True).collect()}
    for i, text in enumerate(texts):
        want = [(brute.pseudonym(kind, v, "k") if kind else v) for v, kind in pieces(text)]
        assert got[i].text == "".join(want), text
    for i in range(7):
        assert "1111 1111" not in got[i].text and "0418 4502" not in got[i].text and "4111111111111111" not in got[i].text
    assert (got[0].pii_card, got[2].pii_iban, got[4].pii_card, got[4].pii_date, got[5].pii_iban, got[5].pii_card) == (1, 1, 2, 1, 1, 1)
