"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: a conjunction of clauses, each an alternative
of trigram sets of which one must occur whole in any text that matches (``trigram_query``).  The index holds a row for
each trigram of the rules and document that contains it, in folded case; a rule's candidates are the documents whose
postings satisfy its query.  Only candidates are verified with the expression itself; rules from which no trigram
follows scan every document.

All of it runs as DataFrame functions.  The texts are read twice (index, verification) and moved only if the candidates
are more than ``BROADCAST`` documents, so that they can't be broadcast.

A null text is empty.  Rows that repeat an id share postings and are verified each on its own text; a row without an
id is verified for every rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C  # the names of a parsed expression's nodes
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelat.llm.base import stored, texts

#: Candidate documents that may be broadcast (ids and names of rules, about 100 bytes each).
BROADCAST = 200_000
#: Strings that a part of an expression is spelled out to.
SPELLED = 64
#: Matches whose places are added up in one go.
CHUNK = 256
#: Stands between trigrams; no rule has it.
MARK = "\x01"
SPAN = "array<struct<start:int,rank:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``length``: characters that a match (or its capture group ``group``) must have, else it is dropped."""
    kind: str
    pattern: str
    group: int = 0
    length: int = 0


#: Fixed values of the contract: the three base kinds, in the order listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of 24 and more: shorter ones would only be dropped again
)
#: Widely used forms of keys.
MORE = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"(sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$-]+@"),
)
RULES = BASE + MORE

Clause = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> frozenset[Clause]:
    """Clauses that all hold for any text with a match; each: one of its trigram sets occurs whole (folded case).
    Empty if nothing follows from the expression."""
    return _Deriver().run(_parser.parse(pattern))


class _Deriver:
    """Walks a parsed expression.  While the strings that its parts can spell are few, they are carried on as a set;
    where they can't be, the set so far becomes a clause."""

    def run(self, parsed) -> frozenset[Clause]:
        exact, clauses = self.sequence(parsed)
        return frozenset(clauses | self.clause(exact))

    def clause(self, exact: set[str] | None) -> set[Clause]:
        if not exact or any(len(s) < 3 for s in exact):
            return set()
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
        return {frozenset(o for o in options if not any(other < o for other in options))}  # a smaller option stands for a larger

    def sequence(self, nodes) -> tuple[set[str] | None, set[Clause]]:
        """(all strings it can spell, or None if some part can't be spelled out; clauses).  With None, the clauses
        hold what its runs of spelled parts give."""
        run, clauses, whole = {""}, set(), True
        for node in nodes:
            exact, more = self.node(*node)
            clauses |= more
            joined = {a + b for a in run for b in exact} if exact is not None and len(run) * len(exact) <= SPELLED else None
            if joined is not None:
                run = joined
                continue
            whole = False
            clauses |= self.clause(run)
            run = exact if exact is not None else {""}
        if whole:
            return run, clauses
        return None, clauses | self.clause(run)

    def node(self, op, arg) -> tuple[set[str] | None, set[Clause]]:
        if op is C.LITERAL:
            return {chr(arg).lower()}, set()
        if op is C.IN:
            letters = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    letters.add(chr(value).lower())
                elif kind is C.RANGE and value[1] - value[0] < SPELLED:
                    letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None, set()
            return (letters if len(letters) <= 8 else None), set()  # larger classes tell little
        if op is C.SUBPATTERN:
            return self.sequence(arg[-1])
        if op is C.AT:
            return {""}, set()
        if op is C.BRANCH:
            parts = [self.sequence(branch) for branch in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= SPELLED:
                return set().union(*(e for e, _ in parts)), set()
            return None, set()
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            exact, more = self.sequence(inner)
            if exact is not None and (low, high) == (0, 1):
                return exact | {""}, set()
            if exact is not None and low == high and len(exact) ** low <= SPELLED:
                spelled = {""}
                for _ in range(low):
                    spelled = {a + b for a in spelled for b in exact}
                return spelled, set()
            return None, (more | self.clause(exact) if low else set())
        return None, set()


def queries_of(rules: tuple[Rule, ...]) -> dict[str, frozenset[Clause]]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings: trigram, doc_id - a row for each trigram of the rules' queries and document that contains it."""
    trigrams = sorted({t for q in queries_of(rules).values() for clause in q for option in clause for t in option})
    folded = texts(docs).select("doc_id", F.lower("text").alias("folded"))
    # one string of those held: plain expressions over the folded text, which is folded once
    held = F.concat_ws(MARK, *[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams])
    rows = folded.select("doc_id", held.alias("held")).select(F.explode_outer(F.split("held", MARK)).alias("trigram"), "doc_id")
    return rows.filter(F.col("trigram") != "")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the kinds whose queries its postings satisfy (documents with one at least)."""
    # a document has as many postings as the rules have trigrams at most
    held = index.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    kinds = [F.when(_holds(query, F.col("held")), F.lit(kind)) for kind, query in queries_of(rules).items() if query]
    return held.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def _holds(query: frozenset[Clause], held: Column) -> Column:
    out = F.lit(True)
    for clause in sorted(query, key=repr):
        some = F.lit(False)
        for option in sorted(clause, key=sorted):
            wanted = F.array(*[F.lit(t) for t in sorted(option)])
            some = some | (F.size(F.array_except(wanted, held)) == 0)
        out = out & some
    return out


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches that are long enough: structs of start, ``rank`` and end, in code points."""
    part = (lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group))) if rule.group else F.char_length

    def places(found):
        between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        items = F.zip_with(found, between, lambda m, b: F.struct(
            F.char_length(b).alias("gap"), F.char_length(m).alias("n"), (part(m) >= rule.length).alias("kept")))
        return F.when(F.size(found) > 0, _once(items, lambda i: _placed(i, rank))).otherwise(F.array().cast(SPAN))

    return _once(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), places)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(items: Column, rank: int) -> Column:
    """Places by adding up gaps and lengths, ``CHUNK`` matches at a time: an array that grows by one match at a time
    would be copied as often as there are matches."""
    none = F.array().cast(SPAN)

    def step(s, m):
        start = s["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + m["n"]).alias("end"))
        return F.struct((start + m["n"]).alias("at"), F.when(m["kept"], F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def chunk(s, i):
        done = F.aggregate(F.slice(items, i, F.lit(CHUNK)), F.struct(s["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(s["all"], F.array(done["out"])).alias("all"))

    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("all")), chunk, lambda s: F.flatten(s["all"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id and ``spans`` (sorted structs of start, rank of the kind in ``rules`` and end) of each row."""
    found = stored(candidates(stored(build_index(docs, rules), "postings"), rules), "candidates").withColumnRenamed("doc_id", "__id")
    few = found.limit(broadcast + 1).count() <= broadcast
    rows = texts(docs).join(F.broadcast(found) if few else found, F.col("doc_id") == F.col("__id"), "left")
    queries = queries_of(rules)
    none = F.array().cast(SPAN)
    parts = []
    for rank, rule in enumerate(rules):
        every = spans(F.col("text"), rule, rank)
        due = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        parts.append(F.when(due, every).otherwise(none) if queries[rule.kind] else every)
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def _told(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """For each row: doc_id, matches of each base kind, the SHA-256 of the base spans and all spans as a string."""
    rows = scan(docs, RULES, **options)
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return rows.select("doc_id", *[of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
                       F.sha2(_told(base, RULES), 256).alias("base_sha256"), _told(F.col("spans"), RULES).alias("spans"))
