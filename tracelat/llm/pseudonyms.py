"""Format-preserving pseudonyms of personal data, by a keyed Feistel permutation in DataFrame functions.

A value is a list of positions, each with the number of values it may take (10 for a digit, 26 for a letter, 256 for a
part of an address, ...).  The list is cut in two halves; in each round every position of one half is moved, within its
own range, by a keyed hash of the other half.  That can be undone step by step, so it is a permutation of the values of
that form, and equal values get equal pseudonyms in all documents.

What is found, and what its positions are:

* e-mail addresses: letters and digits before the @ (case kept; the domain stays);
* bank accounts (IBAN, check digits right): all after the country and the check digits, which are set anew;
* IPv4 addresses: the four numbers;
* dates (real ones, 1900 to 2099, as 2024-05-31, 31.05.2024 or 05/31/2024): the day's number, as two positions whose
  ranges multiply to the number of days;
* social security numbers (ranges valid): area, group and serial number;
* telephone numbers (international, or ten digits as in (555) 010-0199): the last ten digits, or all of fewer;
* payment cards (13 to 19 digits, Luhn sum right): all digits but the last, which is set anew.

Separators stay.  A value that isn't valid stays as it is.  A run of groups that isn't a valid card or IBAN may hold one
and more (an expiry date, an amount, a currency): of its prefixes that end before a separator and are valid, the longest
is the value (of an IBAN, with its country's length); without one, its first group stays.  In both cases the search goes
on right there.  Only texts with such a run are searched value by value, and only in windows of bounded length between
places that no value spans, so the time stays proportional to the length of the text (a single word of very many such
runs joined by hyphens is one window).  The key is a parameter; it is part of the query plan, so
keep plans and event logs as safe as the key.

A null text stays null.  Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31: 319 * 229.
DAYS, DAY_RANGES = 73049, (319, 229)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,4}[0-9]?|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(KINDS.values())
#: Characters of an IBAN by country; other countries' may have any length.
IBAN_LENGTHS = {int(n): tuple(countries.split()) for n, countries in (
    line.split(":") for line in (
        "15:NO", "16:BE", "18:DK FI FO GL NL SD FK", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
        "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM TL SO", "24:AD CZ ES MD PK RO SA SE SK TN VG",
        "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HU LB NI PL SV", "29:BR EG PS QA UA",
        "30:JO KW MU", "31:MT SC", "32:LC", "33:RU"))}
_LOWER, _UPPER, _NUMBER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _with(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _moved(values: Column, ranges: Column, other: Column, tag: Column) -> Column:
    """Each position of ``values`` moved within its range by a keyed hash of ``other``."""
    def moved(by):
        def move(x, i):
            n = F.conv(F.substring(F.sha2(F.concat_ws(":", by, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.pmod(x + n, F.element_at(ranges, i + 1))

        return F.transform(values, move)

    return _with(F.concat_ws(",", tag, F.array_join(other.cast("array<string>"), ".")), moved)


def permuted(values: Column, ranges: Column, tweak: Column, key: str) -> Column:
    """The Feistel permutation of an array of long; position i takes values below ranges[i]."""
    def halves(p):
        half = F.floor(F.size(p["v"]) / 2).cast("int")
        left = lambda a: F.slice(a, 1, half)
        right = lambda a: F.slice(a, half + 1, F.size(p["v"]) - half)
        return F.struct(left(p["v"]).alias("l"), right(p["v"]).alias("r"), left(p["n"]).alias("ln"), right(p["n"]).alias("rn"), p["tag"].alias("tag"))

    def rounds(p):
        def turn(s, k):
            tag = F.concat_ws(",", p["tag"], k.cast("string"))
            return F.when(k % 2 == 0, F.struct(_moved(s["l"], p["ln"], s["r"], tag).alias("l"), s["r"].alias("r"))).otherwise(
                F.struct(s["l"].alias("l"), _moved(s["r"], p["rn"], s["l"], tag).alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(p["l"].alias("l"), p["r"].alias("r")), turn, lambda s: F.concat(s["l"], s["r"]))

    parts = F.struct(values.alias("v"), ranges.alias("n"), F.concat_ws(",", F.lit(key), tweak).alias("tag"))
    return _with(parts, lambda p: _with(halves(p), rounds))


def _alike(values: Column, n: int) -> Column:
    return F.transform(values, lambda _: F.lit(n).cast("long"))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _digits(text: Column) -> Column:
    return F.filter(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c != "").cast("array<long>")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits, in order, from an array."""
    def put(s, c, new):
        number = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(number, F.element_at(new, s["at"] + 1).cast("string")).otherwise(c)).alias("out"),
                        F.when(number, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return _with(digits, lambda new: F.aggregate(_chars(form), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
                                                 lambda s, c: put(s, c, new), lambda s: s["out"]))


def _email(m: Column, key: str) -> Column:
    name, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    chars = _chars(name)
    ranges = F.transform(chars, lambda c: F.when(c.between("0", "9"), 10).when(c.between("A", "Z") | c.between("a", "z"), 26).otherwise(1).cast("long"))
    values = F.transform(chars, lambda c: _value(F.lower(c)))
    new = permuted(values, ranges, F.concat(F.lit("email"), F.regexp_replace(F.lower(name), "[a-z0-9]", "")), key)
    out = F.zip_with(chars, new, lambda c, v: F.when(c.between("0", "9"), _letter(_NUMBER, v)).when(c.between("a", "z"), _letter(_LOWER, v))
                     .when(c.between("A", "Z"), _letter(_UPPER, v)).otherwise(c))
    return F.concat(F.array_join(out, ""), F.lit("@"), domain)


def _letter(alphabet: str, v: Column) -> Column:
    return F.substr(F.lit(alphabet), (v + 1).cast("int"), F.lit(1))


def _value(c: Column) -> Column:
    """A digit's number, a letter's place in the alphabet, else 0."""
    return F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("a", "z"), F.ascii(c) - 97).otherwise(0).cast("long")


def _mod97(chars: Column) -> Column:
    """Of the number that capital letters (as 10 to 35) and digits spell."""
    return F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: F.when(c.between("0", "9"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97)


def _valid_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return _mod97(_chars(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)))) == 1


def _iban(m: Column, key: str) -> Column:
    def spaced(whole):
        return F.aggregate(_chars(m), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(
            F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(whole, s["at"], F.lit(1)))).alias("out"),
            (s["at"] + F.when(c == " ", 0).otherwise(1)).alias("at")), lambda s: s["out"])

    def moved(p):
        body, country = F.substr(p, F.lit(5)), F.substring(p, 1, 2)
        chars = _chars(body)
        ranges = F.transform(chars, lambda c: F.when(c.between("0", "9"), 10).otherwise(26).cast("long"))
        form = F.regexp_replace(F.regexp_replace(body, "[0-9]", "0"), "[A-Z]", "A")
        new = permuted(F.transform(chars, lambda c: _value(F.lower(c))), ranges, F.concat(F.lit("iban"), country, form), key)
        new = F.array_join(F.zip_with(chars, new, lambda c, v: F.when(c.between("0", "9"), _letter(_NUMBER, v)).otherwise(_letter(_UPPER, v))), "")
        check = lambda x: F.lpad((98 - _mod97(_chars(F.concat(x, country, F.lit("00"))))).cast("string"), 2, "0")
        return _with(_with(new, lambda x: F.concat(country, check(x), x)), spaced)

    return F.when(_valid_iban(m), _with(F.regexp_replace(m, " ", ""), moved))


def _ip(m: Column, key: str) -> Column:
    values = F.split(m, r"\.").cast("array<long>")
    return F.array_join(permuted(values, _alike(values, 256), F.lit("ip"), key).cast("array<string>"), ".")


def _date(m: Column, key: str) -> Column:
    form = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    day = F.coalesce(*[F.when(form == f, F.try_to_date(m, f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")])
    first = F.to_date(F.lit("1900-01-01"))
    n = F.datediff(day, first).cast("long")
    new = permuted(F.array(F.floor(n / DAY_RANGES[1]).cast("long"), n % DAY_RANGES[1]), F.array(*[F.lit(r).cast("long") for r in DAY_RANGES]), F.lit("date"), key)
    moved = _with(new, lambda x: F.date_add(first, (F.element_at(x, 1) * DAY_RANGES[1] + F.element_at(x, 2)).cast("int")))
    out = _with(moved, lambda d: F.coalesce(*[F.when(form == f, F.date_format(d, f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")]))
    return F.when((n >= 0) & (n < DAYS), out)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    new = permuted(F.array(area - 1 - (area > 666).cast("long"), group - 1, serial - 1), F.array(*[F.lit(r).cast("long") for r in (898, 99, 9999)]), F.lit("ssn"), key)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    area_of = lambda x: F.element_at(x, 1) + 1 + (F.element_at(x, 1) >= 665).cast("long")
    out = _with(new, lambda x: F.concat_ws("-", pad(area_of(x), 3), pad(F.element_at(x, 2) + 1, 2), pad(F.element_at(x, 3) + 1, 4)))
    return F.when(valid, out)


def _phone(m: Column, key: str) -> Column:
    def moved(digits):
        n = F.size(digits)
        kept = F.when(n > 10, n - 10).otherwise(0)
        values = F.slice(digits, kept + 1, F.least(n, F.lit(10)))
        new = permuted(values, _alike(values, 10), F.lit("phone"), key)
        return F.when((n >= 7) & (n <= 15), _refilled(m, F.concat(F.slice(digits, F.lit(1), kept), new)))

    return _with(_digits(m), moved)


def _luhn(digits: Column) -> Column:
    """The sum that a valid number has at 0 modulo 10: from the right, every second digit is doubled."""
    return _with(F.reverse(digits), lambda back: F.aggregate(
        F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0).cast("long"), lambda s, d: s + d) % 10)


def _card(m: Column, key: str) -> Column:
    def moved(digits):
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        check = lambda x: F.pmod(-_luhn(F.concat(x, F.array(F.lit(0).cast("long")))), F.lit(10).cast("long"))
        whole = _with(permuted(body, _alike(body, 10), F.lit("card"), key), lambda x: F.concat(x, F.array(check(x))))
        return F.when(_luhn(digits) == 0, _refilled(m, whole))

    return _with(_digits(m), moved)


_PERMUTE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """The first kind whose whole pattern a found value has."""
    kind = F
    for name, pattern in KINDS.items():
        kind = kind.when(m.rlike(f"^(?:{pattern})$"), F.lit(name))
    return kind


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a found value; null if it isn't valid."""
    out = F
    for name, permute in _PERMUTE.items():
        out = out.when(kind == name, permute(m, key))
    return out


def _is_run(m: Column, kind: Column) -> Column:
    """Whether a found value is groups that aren't a valid card or IBAN."""
    return kind.isin("card", "iban") & m.rlike("[ -]") & ~F.when(kind == "card", _luhn(_digits(m)) == 0).otherwise(_valid_iban(m))


def _prefix(m: Column, kind: Column) -> Column:
    """The longest valid prefix of a run that ends before a separator; null if there is none."""
    ends = F.filter(F.sequence(F.lit(1), F.length(m) - 1), lambda i: F.substr(m, i + 1, F.lit(1)).isin(" ", "-"))
    prefixes = F.reverse(F.transform(ends, lambda i: F.substr(m, F.lit(1), i)))

    def valid(p):
        country, n = F.substring(p, 1, 2), F.length(F.regexp_replace(p, " ", ""))
        fits = F
        for length, countries in IBAN_LENGTHS.items():
            fits = fits.when(country.isin(*countries), n == length)
        return F.when(kind == "card", p.rlike(f"^(?:{KINDS['card']})$") & (_luhn(_digits(p)) == 0)).otherwise(
            p.rlike(f"^(?:{KINDS['iban']})$") & fits.otherwise(F.lit(True)) & _valid_iban(p))

    return F.try_element_at(F.filter(prefixes, valid), F.lit(1))


#: Places that no value spans and that look to the patterns like the text's start and end: beside a space next to a small
#: letter, between two spaces, and after a character that no pattern has.
CUTS = r"(?<=[a-z] )|(?= [a-z])|(?<= )(?= )|(?<=[^A-Za-z0-9._%+@ ()/-])"
#: Characters of a window (whole words), and how many must follow a value's start to tell the value: more than any value
#: with spaces has, and a window has whole words.
WINDOW, AHEAD = 256, 100
_ENTRIES = "array<struct<b:string,m:string,kind:string>>"


def _entry(before: Column, m: Column | None = None, kind: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(before.alias("b"), (null if m is None else m).alias("m"), (null if kind is None else kind).alias("kind"))


def _window(rest: Column, last: Column) -> Column:
    """The entries (b: what stands before a value, m, kind) of a window, one after the other, with a new search after each value or
    skipped group, and what is left of it (``rest``): nothing of the ``last`` one.  A window keeps one character before it,
    where no value may start, for the patterns' looks behind."""
    pattern = F.lit(f"(?!^)(?:{ANY})")
    start = F.struct(F.lit("").alias("done"), rest.alias("rest"), F.array().cast(_ENTRIES).alias("out"), F.lit(False).alias("over"))

    def step(s, _):
        def after(f):
            """Past what is taken or skipped (f.part) of the first value found (f.m)."""
            head = F.concat(s["done"], F.substr(f["before"], F.lit(2)))
            rest = F.concat(F.substring(f["part"], -1, 1), F.substr(f["m"], F.length(f["part"]) + 1), f["behind"])
            return F.struct(F.when(f["taken"], F.lit("")).otherwise(F.concat(head, f["part"])).alias("done"), rest.alias("rest"),
                            F.when(f["taken"], F.concat(s["out"], F.array(_entry(head, f["part"], f["kind"])))).otherwise(s["out"]).alias("out"), F.lit(False).alias("over"))

        def part(f):
            """A value as it is, a run's valid prefix, or the run's first group, which isn't a value."""
            run = _is_run(f["m"], f["kind"])
            prefix = F.when(run, _prefix(f["m"], f["kind"]))
            return _with(prefix, lambda p: F.struct(f["before"].alias("before"), f["m"].alias("m"), f["behind"].alias("behind"), f["kind"].alias("kind"),
                                                    (~run | p.isNotNull()).alias("taken"), F.when(~run, f["m"]).otherwise(F.coalesce(p, F.regexp_extract(f["m"], "^[^ -]+", 0))).alias("part")))

        def over(before):
            """The search ends; ``before`` is past."""
            n = F.length(before)
            return F.struct(F.concat(s["done"], F.substr(before, F.lit(2))).alias("done"), F.concat(F.substr(before, n, F.lit(1)), F.substr(s["rest"], n + 1)).alias("rest"),
                            s["out"].alias("out"), F.lit(True).alias("over"))

        m = F.regexp_substr(s["rest"], pattern)  # places in the text are of no use: Spark's are UTF-16 units
        one = _with(F.struct(m.alias("m"), F.split(s["rest"], pattern, 2).alias("parts")), lambda f: F.struct(
            f["parts"][0].alias("before"), f["m"].alias("m"), F.try_element_at(f["parts"], F.lit(2)).alias("behind"), kind_of(f["m"]).alias("kind")))
        kept = F.when(last, F.length(s["rest"])).otherwise(F.greatest(F.length(s["rest"]) - AHEAD, F.lit(1)))  # without a value
        return F.when(s["over"], s).otherwise(_with(one, lambda f: F.when(f["m"].isNull(), over(F.substr(s["rest"], F.lit(1), kept))).when(
            ~last & (F.length(f["m"]) + F.length(f["behind"]) < AHEAD), over(f["before"])).otherwise(_with(part(f), after))))

    # every step but the last passes a digit or an @
    steps = F.sequence(F.lit(0), F.regexp_count(rest, F.lit("[0-9@]")))
    return F.aggregate(steps, start, step, lambda s: F.struct(F.concat(s["out"], F.array(_entry(s["done"]))).alias("out"), s["rest"].alias("rest")))


def _scanned(piece: Column) -> Column:
    """The entries of a piece of text between ``CUTS``, window after window; the last entry is what follows the values."""
    def scan(windows):
        start = F.struct(F.array().cast(_ENTRIES).alias("out"), F.lit("\n").alias("rest"))

        def step(s, i):
            return _with(_window(F.concat(s["rest"], F.element_at(windows, i)), i == F.size(windows)),
                         lambda w: F.struct(F.concat(s["out"], w["out"]).alias("out"), w["rest"].alias("rest")))

        return F.aggregate(F.sequence(F.lit(1), F.size(windows)), start, step, lambda s: s["out"])

    return _with(F.regexp_extract_all(piece, F.lit(f"(?s).{{1,{WINDOW}}}[^ ]*"), F.lit(0)), scan)


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__pii``: the text as entries of what the patterns find (m, kind) and what stands before (b), the
    last without a value.  Null if nothing is found."""
    text = F.col(text_col)
    some = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    rows = docs.withColumn("__pii", F.when(text.rlike("[0-9@]"), some))  # every kind has a digit or an @
    values = F.transform("__pii", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    rows = rows.withColumn("__pii", F.when(F.coalesce(F.size("__pii"), F.lit(0)) > 0, values))
    # only a text with a run that isn't valid is searched step by step
    pieces = F.transform(F.split(text, CUTS, -1), lambda p: F.when(p.rlike("[0-9@]"), _scanned(p)).otherwise(F.array(_entry(p))))
    rows = rows.withColumn("__scan", F.when(F.exists("__pii", lambda v: _is_run(v["m"], v["kind"])), F.flatten(pieces)))
    plain = F.zip_with(F.split(text, ANY, -1), "__pii", lambda b, v: _entry(b, v["m"], v["kind"]))
    return rows.withColumn("__pii", F.when(F.col("__scan").isNotNull(), F.col("__scan")).when(F.col("__pii").isNotNull(), plain)).drop("__scan")


def _replaced(kind: str) -> Column:
    mine = F.filter("__pii", lambda v: (v["kind"] == kind) & v["new"].isNotNull())
    return F.coalesce(F.size(mine), F.lit(0)).cast("long")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text; with ``counts``, also ``pii_<kind>`` (values replaced) for each kind."""
    rows = found(docs, text_col)
    named = F.transform("__pii", lambda v: F.struct(v["b"].alias("b"), v["m"].alias("m"), v["kind"].alias("kind"),
                                                    F.when(v["m"].isNotNull(), pseudonym(v["m"], v["kind"], key)).alias("new")))
    rows = rows.withColumn("__pii", named)
    text = F.array_join(F.transform("__pii", lambda v: F.concat(v["b"], F.coalesce(v["new"], v["m"], F.lit("")))), "")
    out = rows.withColumn(text_col, F.when(F.col("__pii").isNull(), F.col(text_col)).otherwise(text))
    if counts:
        for kind in KINDS:
            out = out.withColumn(f"pii_{kind}", _replaced(kind))
    return out.drop("__pii")
