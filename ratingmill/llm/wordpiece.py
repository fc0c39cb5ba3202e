"""Token counts by a linear longest-match automaton.

A word (white-space bounded, ASCII lower case) is a start mark and its UTF-8 bytes. Greedy word-piece cuts it into the longest
vocabulary entries from the left: the first piece begins with the start mark, later ones do not. The vocabulary is a trie. Where
a node has no child for the next byte, its failure link leads to the node of what is left after the pieces that greedy matching
would cut from the node's string, and a precomputed count says how many pieces these are. So each byte is read once, no piece is
built and no prefix is tried twice; a failure chain is as long as the number of pieces it counts.

Every byte is a piece of its own in the byte-level vocabularies, so that each word has a count.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.common import arrow_rows, tune

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The byte before a word; entries that begin with it start a word.
START = 0x20
#: Words whose counts a worker remembers at most.
REMEMBER = 300_000


class Automaton:
    """Trie over vocabulary entries (bytes) with failure links and popped-piece counts."""

    def __init__(self, entries):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node; the root is 0
        ends, parent, via = [False], [0], [0]
        for e in sorted({x for x in entries if x}):
            at = 0
            for byte in e:
                key = at * 256 + byte
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = len(ends)
                    ends.append(False)
                    parent.append(at)
                    via.append(byte)
                at = nxt
            ends[at] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for n in range(1, len(ends)):  # a parent has the smaller number
            depth[n] = depth[parent[n]] + 1
        for n in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[n]:  # the node's whole string is one piece
                self.fail[n], self.popped[n] = 0, 1
                continue
            up = parent[n]
            link, count, byte = self.fail[up], self.popped[up], via[n]
            while link >= 0:
                nxt = self.step.get(link * 256 + byte)
                if nxt is not None:
                    self.fail[n], self.popped[n] = nxt, count
                    break
                count += self.popped[link]
                link = self.fail[link]

    def count(self, word: bytes) -> int:
        """Pieces of a word (with its start mark); 0 for the empty string, -1 if some part matches no entry."""
        step, fail, popped = self.step, self.fail, self.popped
        at, n = 0, 0
        for byte in word:
            nxt = step.get(at * 256 + byte)
            while nxt is None:
                link = fail[at]
                if link < 0:
                    return -1
                n += popped[at]
                at = link
                nxt = step.get(at * 256 + byte)
            at = nxt
        while at:  # what is left at the end
            if fail[at] < 0:
                return -1
            n += popped[at]
            at = fail[at]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(bytes([START]) + word)
        if len(self) < REMEMBER:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counts:
    with open(path, "rb") as f:
        return _Counts(Automaton(base64.b64decode(line.split()[0]) for line in f))


def token_counts(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of every document; null, empty and blank texts have no word and no token.

    The vocabulary file is read by each worker; what a worker remembers of words is bounded. Equal rows and rows without doc_id
    are counted each; other columns of docs are not looked at.
    """
    tune(docs.sparkSession)
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)

    def each(c: dict) -> dict:
        known = _counter(path)
        out = {"doc_id": c["doc_id"], "n_words": [], "n_tokens": [], "n_bytes": []}
        for t in c["text"]:
            b = (t or "").encode("utf-8", "surrogatepass")
            w = b.lower().split()
            out["n_words"].append(len(w))
            out["n_tokens"].append(sum(map(known.__getitem__, w)))
            out["n_bytes"].append(len(b))
        return out

    names = ["doc_id", "n_words", "n_tokens", "n_bytes"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(arrow_rows(each, schema), ", ".join(f"{n} long" for n in names))
