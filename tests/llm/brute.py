"""Plain versions of the operators, one document or pair after the other."""

import datetime
import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


# quality rules

def measures(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def plain_line(line):
    return SPACE.sub(" ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def quality(docs, max_docs, max_share, min_left=0.2):
    """docs: (doc_id, text, host).  For each: measures, base_failed, kept, indexes of removed lines."""
    holders, hosts = defaultdict(dict), defaultdict(set)
    for d, text, host in docs:
        hosts[host].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                of = holders[host, plain_line(line)].setdefault(text or "", [])
                if d is not None:
                    of.append(d)
    first = {}
    for (host, line), by_text in holders.items():
        if len(by_text) > max_docs and len(by_text) > max_share * len(hosts[host]):
            ids = [d for ds in by_text.values() for d in ds]
            first[host, line] = min(ids) if ids else None
    out = []
    for d, text, host in docs:
        m = measures(text)
        gone = [i for i, line in enumerate((text or "").split("\n")) if d is not None and words(line)
                and first.get((host, plain_line(line)), d) != d]
        lines = (text or "").split("\n")
        lost = sum(len(words(lines[i])) for i in gone)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        depleted = lost > 0 and (m[0] - lost < 20 or m[0] - lost < min_left * m[0])
        out.append((d, m, failed, not failed and not depleted, gone))
    return out


# near-duplicates

def shingles(text, width=2):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(docs, width=2):
    """docs: (doc_id, text).  For each id its component."""
    top = {d: d for d, _ in docs}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    sets = [(d, shingles(t, width)) for d, t in docs]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * min(len(s), len(t)) >= 80 * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {d: find(d) for d in top}


# pseudonyms

def feistel(values, ranges, tweak, key):
    half = len(values) // 2
    left, right, rl, rr = values[:half], values[half:], ranges[:half], ranges[half:]
    for k in range(8):
        moving, other, r = (left, right, rl) if k % 2 == 0 else (right, left, rr)
        by = f"{key},{tweak},{k},{'.'.join(map(str, other))}"
        moved = [(v + int(hashlib.sha256(f"{by}:{i}".encode()).hexdigest()[:12], 16)) % n for i, (v, n) in enumerate(zip(moving, r))]
        left, right = (moved, right) if k % 2 == 0 else (left, moved)
    return left + right


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10


def refill(form, digits):
    digits = iter(digits)
    return re.sub("[0-9]", lambda _: str(next(digits)), form)


def mod97(chars):
    return int("".join(str(int(c, 36)) for c in chars)) % 97


def pseudonym(kind, m, key):
    digits = [int(c) for c in m if c in "0123456789"]
    if kind == "card":
        if luhn(digits):
            return m
        new = feistel(digits[:-1], [10] * (len(digits) - 1), "card", key)
        return refill(m, [*new, -luhn([*new, 0]) % 10])
    if kind == "phone":
        kept = max(0, len(digits) - 10)
        if not 7 <= len(digits) <= 15:
            return m
        return refill(m, digits[:kept] + feistel(digits[kept:], [10] * len(digits[kept:]), "phone", key))
    if kind == "ip":
        return ".".join(map(str, feistel([int(x) for x in m.split(".")], [256] * 4, "ip", key)))
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        a, g, s = feistel([a - 1 - (a > 666), g - 1, s - 1], [898, 99, 9999], "ssn", key)
        return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{s + 1:04d}"
    if kind == "date":
        form = "%Y-%m-%d" if "-" in m else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
        try:
            day = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= day < 319 * 229:
            return m
        a, b = feistel([day // 229, day % 229], [319, 229], "date", key)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 229 + b)).strftime(form)
    if kind == "email":
        name, domain = m.split("@")
        low = name.lower()
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in low]
        value = [int(c) if c.isdigit() else ord(c) - 97 if c.isalpha() else 0 for c in low]
        new = feistel(value, radix, "email" + re.sub("[a-z0-9]", "", low), key)
        return "".join(str(v) if c.isdigit() else chr(v + (97 if c.islower() else 65)) if c.isalpha() else c for c, v in zip(name, new)) + "@" + domain
    if kind == "iban":
        plain = m.replace(" ", "")
        if mod97(plain[4:] + plain[:4]) != 1:
            return m
        body = plain[4:]
        form = re.sub("[A-Z]", "A", re.sub("[0-9]", "0", body))
        new = feistel([int(c) if c.isdigit() else ord(c) - 65 for c in body], [10 if c.isdigit() else 26 for c in body], "iban" + plain[:2] + form, key)
        new = "".join(str(v) if c.isdigit() else chr(65 + v) for c, v in zip(body, new))
        whole = iter(f"{plain[:2]}{98 - mod97(new + plain[:2] + '00'):02d}{new}")
        return re.sub("[^ ]", lambda _: next(whole), m)


def pseudonymised(text, kinds, key):
    def new(found):
        m = found[0]
        return pseudonym(next(k for k, p in kinds.items() if re.fullmatch(p, m)), m, key)

    return None if text is None else re.sub("|".join(kinds.values()), new, text)
