"""License scans by template markup.

A template is the wording of a license or of a notice, in words as below, with markup:

- a plain word is mandatory, `a|b` is a mandatory word with equivalents,
- `[ ... ]` is an optional region, which may hold markup itself,
- `<2-9>` is a replaceable region: any 2 to 9 words, as a name has them.

All templates are compiled into one automaton over words, which reads each word of a text once. Its deterministic states (sets of
places in templates) are made when they are first met. A template is found where its mandatory wording stands exactly, in its order.
A second automaton, of the template read backwards, tells where a match with optional or replaceable regions begins.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became lower case: ASCII letters and digits, and all that is not ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ratingmill.llm.common import filtered, release, tune

#: States that a worker keeps; when there are more it starts anew, which costs time and changes no result.
MOST_STATES = 20_000
#: A match with this many mandatory words has a score of one half.
HALF = 4


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    markup: str


# fixed values: phrases and labels that the contract names
BASE = (
    Template("base-mit", "mit", "under the mit license"),
    Template("base-apache-2", "apache-2", "apache license version 2"),
    Template("base-cc-by-nc", "cc-by-nc", "cc by nc"),
)
# fixed values: the wording of public licenses and their notices
TEMPLATES = (
    *BASE,
    Template("mit-text", "mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
        sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the
        software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall <1-12> be liable for any claim damages or
        other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software"""),
    Template("apache-2-notice", "apache-2", """licensed under the apache license version 2 0 [the license] you may not use <1-6> except in compliance with the license
        you may obtain a copy of the license at <1-12> unless required by applicable law or agreed to in writing"""),
    Template("bsd-2-text", "bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by <1-12> as is"""),
    Template("bsd-3-text", "bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution [3] neither the name of <1-12> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission this software is provided by <1-12> as is"""),
    Template("isc-text", "isc", """permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies"""),
    Template("zlib-text", "zlib", """this software is provided as is without any express or implied warranty in no event will <1-8> be held liable for any damages
        arising from the use of this software"""),
    Template("unlicense-text", "unlicense", "this is free and unencumbered software released into the public domain"),
    Template("gpl-2-notice", "gpl-2", "under the [terms of the] gnu general public license|licence [as published by the free software foundation [either]] version 2"),
    Template("gpl-3-notice", "gpl-3", "under the [terms of the] gnu general public license|licence [as published by the free software foundation [either]] version 3"),
    Template("lgpl-notice", "lgpl", "under the [terms of the] gnu lesser|library general public license|licence"),
    Template("agpl-3-notice", "agpl-3", "under the [terms of the] gnu affero general public license|licence [as published by the free software foundation [either]] version 3"),
    Template("mpl-2-notice", "mpl-2", "[subject to] [the] terms of the mozilla public license|licence [v] [version] 2"),
    Template("cc-by-nc-name", "cc-by-nc", "creative commons attribution noncommercial|non [commercial] [4 0] [international] license|licence"),
    Template("cc-by-sa-name", "cc-by-sa", "creative commons attribution share|sharealike [alike] [3|4 0] [international|unported] license|licence"),
    Template("cc-by-name", "cc-by", "creative commons attribution [3|4 0] [international|unported] license|licence"),
    Template("cc0-name", "cc0", "cc0 1 0 universal"),
    Template("mit-name", "mit", "licensed under [the terms of] [the] mit [x11] license|licence"),
    Template("reserved", "all-rights-reserved", "copyright [c|©] <1-10> all rights reserved"),
)

_TOKEN = re.compile(r"\[|\]|<\d+-\d+>|[^\s\[\]<>]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def parse(markup: str) -> list[tuple]:
    """A template's regions: ("word", equivalents), ("any", least, most), ("optional", regions)."""
    stack: list[list[tuple]] = [[]]
    for token in _TOKEN.findall(markup):
        if token == "[":
            stack.append([])
        elif token == "]":
            if len(stack) < 2:
                raise ValueError(f"a region ends that has not begun: {markup[:80]}")
            inner = stack.pop()
            if inner:
                stack[-1].append(("optional", inner))
        elif token[0] == "<":
            least, most = map(int, token[1:-1].split("-"))
            if least > most:
                raise ValueError(f"no length fits {token}")
            stack[-1].append(("any", least, most))
        elif found := [w for x in token.split("|") for w in words_of(x)]:
            stack[-1].append(("word", tuple(dict.fromkeys(found))))
    if len(stack) > 1:
        raise ValueError(f"a region does not end: {markup[:80]}")
    top = stack[0]
    if not any(x[0] == "word" for x in top):
        raise ValueError("a template needs mandatory wording")
    if top[0][0] == "any" or top[-1][0] != "word":
        raise ValueError("a template begins with wording and ends with a mandatory word")
    return top


def mandatory(regions: Sequence[tuple]) -> int:
    return sum(x[0] == "word" for x in regions)


def backwards(regions: Sequence[tuple]) -> list[tuple]:
    return [("optional", backwards(x[1])) if x[0] == "optional" else x for x in reversed(regions)]


class _State(dict):
    """A deterministic state: word -> next state, for words met so far; nodes are places in templates, ends the templates found."""

    __slots__ = ("ends", "nodes")


class Automaton:
    """Templates as one automaton over words. anchored: matches begin at the first word read."""

    def __init__(self, templates: Sequence[Sequence[tuple]], anchored: bool = False):
        self.edges: list[tuple[frozenset[int] | None, int] | None] = []  # None as a word: any
        self.free: list[list[int]] = []
        self.end: dict[int, int] = {}
        self.number: dict[bytes, int] = {}
        starts = []
        for k, regions in enumerate(templates):
            last = self._node()
            self.end[last] = k
            starts.append(self._built(regions, last))
        self.first, self.anchored = self._closed(starts), anchored
        self._anew()

    def _node(self, edge=None, free=()) -> int:
        self.edges.append(edge)
        self.free.append(list(free))
        return len(self.edges) - 1

    def _built(self, regions: Sequence[tuple], after: int) -> int:
        """The first node of the regions, whose last one leads to the node `after`."""
        for x in reversed(regions):
            if x[0] == "word":
                after = self._node((frozenset(self.number.setdefault(w, len(self.number) + 1) for w in x[1]), after))
            elif x[0] == "optional":
                after = self._node(free=(self._built(x[1], after), after))
            else:
                (_, least, most), done = x, after
                for spent in range(most - 1, -1, -1):  # the node after so many words of the region
                    after = self._node((None, after), (done,) if spent >= least else ())
        return after

    def _closed(self, nodes) -> frozenset[int]:
        seen, todo = set(), list(nodes)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.free[n]
        return frozenset(n for n in seen if self.edges[n] is not None or n in self.end)

    def _anew(self) -> None:
        self.states: dict[frozenset[int], _State] = {}
        self.start = self._state(self.first)

    def _state(self, nodes: frozenset[int]) -> _State:
        found = self.states.get(nodes)
        if found is None:
            found = self.states[nodes] = _State()
            found.nodes, found.ends = nodes, tuple(sorted(self.end[n] for n in nodes if n in self.end))
        return found

    def step(self, state: _State, word: int) -> _State:
        """The state after a word that the state has not met yet; 0 is a word of no template."""
        if len(self.states) >= MOST_STATES:
            self._anew()
        reached = [e[1] for e in map(self.edges.__getitem__, state.nodes) if e and (e[0] is None or word in e[0])]
        nodes = self._closed(reached)
        found = state[word] = self._state(nodes if self.anchored else nodes | self.first)
        return found

    def ends(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(template, place after its last word) of all matches, by place."""
        state = self.start
        for at, w in enumerate(words, 1):
            after = state.get(w)
            state = self.step(state, w) if after is None else after
            if state.ends:
                for k in state.ends:
                    yield k, at
            elif not state.nodes:
                return


class Scanner:
    def __init__(self, templates: Sequence[Template]):
        parsed = [parse(t.markup) for t in templates]
        self.all = Automaton(parsed)
        self.length = [len(x) if all(r[0] == "word" for r in x) else 0 for x in parsed]
        self.back = [None if n else Automaton([backwards(x)], anchored=True) for n, x in zip(self.length, parsed, strict=True)]

    def spans(self, words: Sequence[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end) in words by end, the end exclusive. Each end is given once, with the nearest start."""
        number = self.all.number
        coded = [number.get(w, 0) for w in words]
        out = []
        for k, end in self.all.ends(coded):
            if self.length[k]:
                out.append((k, end - self.length[k], end))
            else:
                own = self.back[k].number
                before = (own.get(words[i], 0) for i in range(end - 1, -1, -1))
                out.append((k, end - next(self.back[k].ends(before))[1], end))
        return out


@lru_cache(maxsize=8)
def _scanner(templates: tuple[Template, ...]) -> Scanner:
    return Scanner(templates)


def find(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, spans) of every document; spans: (template, label, start, end) in words, ends exclusive, by end and template.

    Null, empty and wordless texts have no span. Equal rows and rows without doc_id are given each, doc_id keeps its type; an empty
    table gives no row; other columns are not looked at. Texts are read whole, whatever their length.
    """
    tune(docs.sparkSession)
    templates = tuple(templates)
    names, labels = [t.name for t in templates], [t.label for t in templates]
    span = pa.struct([("template", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    rows = docs.select("doc_id", "text")
    own = to_arrow_schema(rows.schema).field("doc_id").type

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates)
        for b in batches:
            counts, found = [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                counts.append(len(words))
                found.append([{"template": names[k], "label": labels[k], "start": s, "end": e} for k, s, e in scanner.spans(words)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(own), pa.array(counts, pa.int64()), pa.array(found, pa.list_(span))], names=["doc_id", "n_words", "spans"])
        release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, n_words long, spans array<struct<template:string,label:string,start:long,end:long>>")


def _listed(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    n_base counts all places of the base phrases, first_word and last_word are their smallest and largest start (null without one).
    labels are those of all templates found, base ones included. score: m / (m + 4) for the longest template found, m its mandatory
    words: the more wording agrees, the less it agrees by chance; 0 where nothing is found. Nulls, empty texts, equal rows and empty
    tables as in find.
    """
    own = lambda s: s["template"].isin(*[t.name for t in BASE])
    parts = F.create_map(*[F.lit(x) for t in TEMPLATES for x in (t.name, mandatory(parse(t.markup)))])
    starts = F.transform(F.filter("spans", own), lambda s: s["start"])
    longest = F.coalesce(F.array_max(F.transform("spans", lambda s: parts[s["template"]])), F.lit(0))
    found = find(docs).withColumns({"starts": starts, "longest": longest})
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        _listed(F.transform(F.filter("spans", own), lambda s: s["label"])).alias("base_labels"),
        _listed(F.transform("spans", lambda s: s["label"])).alias("labels"),
        (F.col("longest") / (F.col("longest") + HALF)).alias("score"),
    )


def without(docs: DataFrame, labels: Sequence[str], templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """The rows of docs, with all columns as they are, in whose texts no license with one of the labels is found."""
    templates, gone = tuple(templates), frozenset(labels)

    def keep(texts: list[str | None]) -> list[bool]:
        scanner = _scanner(templates)
        return [not any(templates[k].label in gone for k, _, _ in scanner.spans(words_of(t))) for t in texts]

    return filtered(docs, keep)
