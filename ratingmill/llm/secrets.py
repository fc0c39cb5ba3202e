"""Secrets: a trigram inverted index narrows the texts of each rule before its regular expression runs. SQL functions only.

For each rule a Boolean query over trigrams is derived from its regular expression: every match contains a string that the query
accepts. The index holds the postings (trigram, text) of the trigrams that the rules' queries use, of all texts in lower case; a text
is named by 128 bits of hash, so copies share their postings. A query is a union of clauses, and a clause the intersection of its
trigrams' postings: a text that is in all of them is found as often as the clause has trigrams. Only what the index gives is a
candidate, and only candidates are verified by the regular expression. A rule without mandatory trigrams (hex) scans all texts.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.common import stash
from ratingmill.llm.spans import Rule, annotate, digest

BASE = ("assign", "access", "hex")
#: Strings that a part of a pattern may stand for before they are turned into trigrams.
MOST_STRINGS = 64

ALL = ("all",)


def _and(*qs: tuple) -> tuple:
    flat = [x for q in qs for x in (q[1] if q[0] == "and" else (q,)) if x != ALL]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(qs: list[tuple]) -> tuple:
    flat = list(dict.fromkeys(x for q in qs for x in (q[1] if q[0] == "or" else (q,))))
    return ALL if ALL in flat or not flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of(strings: set[str]) -> tuple:
    return _or([_and(*[("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    """(the strings that it matches in lower case, if they are few; else the query of what it matches)."""
    if op is sre.LITERAL:
        return ({chr(arg).lower()}, ALL)
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 4:
                chars |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 4 else (None, ALL)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, sub = arg
        strings, q = _sequence(sub)
        if low == 0:
            return ({""} | strings, ALL) if high == 1 and strings is not None else (None, ALL)
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return reduce(lambda a, b: {x + y for x in a for y in b}, [strings] * low), ALL
        return None, q if strings is None else _of(strings)
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.ATOMIC_GROUP:
        return _sequence(arg)
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*[s for s, _ in parts]), ALL
        return None, _or([q if s is None else _of(s) for s, q in parts])
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ALL
    return None, ALL


def _sequence(items) -> tuple[set[str] | None, tuple]:
    exact: set[str] | None = {""}
    whole, queries = True, []
    for op, arg in items:
        strings, q = _node(op, arg)
        if strings is not None and exact is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        whole = False
        queries += [_of(exact) if exact else ALL, q]
        exact = strings if strings is not None else {""}
    return (exact, ALL) if whole else (None, _and(*queries, _of(exact) if exact else ALL))


def trigram_query(pattern: str) -> tuple:
    """ALL, ("has", trigram), ("and", queries) or ("or", queries): what the lower-case text of every match satisfies."""
    strings, q = _sequence(parser.parse(pattern))
    return q if strings is None else _of(strings)


def trigrams(q: tuple) -> set[str]:
    return {q[1]} if q[0] == "has" else set() if q == ALL else set().union(*map(trigrams, q[1]))


def clauses(q: tuple) -> list[frozenset[str]]:
    """The query as a union of intersections; a clause that another one is part of is left out."""
    if q[0] == "has":
        return [frozenset((q[1],))]
    parts = [clauses(x) for x in q[1]]
    found = {c for p in parts for c in p} if q[0] == "or" else reduce(lambda a, b: {x | y for x in a for y in b}, parts, {frozenset()})
    return sorted((c for c in found if not any(d < c for d in found)), key=sorted)


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

RULES = (
    Rule("assign", _ASSIGN, lambda t: F.lit(True), lambda m: F.length(F.regexp_replace(m, _HEAD, "")) >= 6),
    Rule("access", "AKIA[A-Z0-9]+", lambda t: F.lit(True), lambda m: F.length(m) >= 20),
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{24,}+", lambda t: F.lit(True)),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", lambda t: F.lit(True)),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}", lambda t: F.lit(True)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda t: F.lit(True)),
)
QUERIES = {r.kind: trigram_query(r.pattern) for r in RULES}


#: Candidate texts that are broadcast at most (some 100 MB as a hash table); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
NAME = ("__rm_h1", "__rm_h2")


def _named(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the text's name."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias(NAME[0]), F.xxhash64(F.lit(1), text).alias(NAME[1]))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: (trigram, name) of every text that has the trigram in lower case; copies in a task as one."""
    low = docs.select(*NAME, F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    there = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("low", g))  # a loop, not code for each trigram
    return low.select(*NAME, F.explode(there).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, tuple]) -> DataFrame:
    """(name, rules): the rules whose query the text's postings satisfy; texts with none are left out."""
    bits = {g: 1 << k for k, g in enumerate(sorted(set().union(*map(trigrams, queries.values()))))}
    wanted = [(rule, i, g, bits[g], len(c)) for rule, q in queries.items() for i, c in enumerate(clauses(q)) for g in sorted(c)]
    names = ("rule", "clause", "trigram", "bit", "size")
    each = F.array(*[F.struct(*[F.lit(v).cast("long" if n == "bit" else "string" if n in ("rule", "trigram") else "int").alias(n) for n, v in zip(names, w)]) for w in wanted])
    lists = F.broadcast(index.sparkSession.range(1).select(F.explode(each).alias("w")).select("w.*"))
    # a trigram of a text counts once, however many rows have the text
    met = index.join(lists, "trigram").groupBy(*NAME, "rule", "clause").agg(F.bit_count(F.bit_or("bit")).alias("n"), F.first("size").alias("size"))
    return met.where("n = size").groupBy(*NAME).agg(F.collect_set("rule").alias("__rm_rules"))


def find(docs: DataFrame, out: str = "secrets") -> DataFrame:
    """(doc_id, text, out): out is an array of (start, rank, kind, end, text, score) by start, then rule.

    Null and empty texts have no span. A text's spans depend on the text alone: rows with the same or no doc_id are told apart.
    Equal rows are kept each; an empty table gives no row; other columns are not looked at.
    """
    docs = _named(docs)
    indexed = {k: q for k, q in QUERIES.items() if q != ALL}
    grams = sorted(set().union(*map(trigrams, indexed.values())))
    if len(grams) > 63:
        raise ValueError("more trigrams than a long has bits")
    found = stash(candidates(postings(docs, grams), indexed))
    few = found.count() <= MOST_BROADCAST
    ahead = docs.join(F.broadcast(found) if few else found, list(NAME), "left")
    ahead = ahead.select("doc_id", "text", F.coalesce("__rm_rules", F.array().cast("array<string>")).alias("__rm_rules"))
    rules = [
        Rule(r.kind, r.pattern, (lambda t, k=r.kind: F.array_contains("__rm_rules", k)) if r.kind in indexed else r.needs, r.valid)
        for r in RULES
    ]
    return annotate(ahead, F.col("text"), rules, out).drop("__rm_rules")


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document; null, empty and equal texts as in find."""
    return digest(find(docs, "__rm_secrets"), "__rm_secrets", BASE)
