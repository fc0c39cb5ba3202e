"""Best-fit packing of tokenised documents into sequences: hierarchical residual packing.

Documents are tokenised once and cut into pieces of at most `size` tokens. Only (piece, length) go on. A round deals the items
(pieces at first, underfull bins later) out to groups, packs each group best-fit with the longest first, and emits the bins whose
residual is at most `slack`; the underfull bins go to the next round as items of their filled length, in fewer groups, with a
larger slack. Items are dealt out by a hash of their number, so all groups of a round see like mixtures of lengths. The tree ends
when all that is left fits one group of `group_rows` items, which is packed and emitted whole. No group ever has more than
`group_rows` items, so a task's memory is bounded for any input, and the number of items shrinks from round to round.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.common import arrow_rows, cut, stash, tune

VOCABULARY = "byte_bpe_50k"
#: Words whose ids a worker remembers at most.
REMEMBER = 300_000


class _Words(dict):
    """The ids of a word, with what stands before it, as little-endian 32-bit numbers; remembered up to a bound."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.before + word)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBER:
            self[word] = out
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """text -> its ids as bytes, as the tokenizer of a byte-level BPE file (JSON) makes them, without adding special tokens.

    Ranks of the same name (.tiktoken) lie beside the file. The pattern never joins what stands before a single space to what
    stands after it, so a text without two white-space characters in a row is encoded word by word, each with the space before it.
    A text that holds the string of a special token goes to the tokenizer itself, which gives that string its own id.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        special = [x["content"] for x in json.load(f)["added_tokens"]]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first_words, words, run = _Words(encode, ""), _Words(encode, " "), re.compile(r"\s\s|^\s|\s$")

    def ids(text: str) -> bytes:
        if any(x in text for x in special):
            x = whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(x)}I", *x)
        if run.search(text):
            x = encode(text)
            return struct.pack(f"<{len(x)}I", *x)
        first, *rest = text.split(" ")
        return (first_words[first] if first else b"") + b"".join(map(words.__getitem__, rest))

    return ids


def pieces(docs: DataFrame, size: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its end id 0 included; the first piece takes the remainder."""
    tune(docs.sparkSession)
    path = tokenizer_path or public_tokenizers.path(f"{VOCABULARY}.json")

    def each(c: dict) -> dict:
        ids, out = tokenizer(path), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(c["doc_id"], c["text"]):
            b = ids(text or "") + b"\0\0\0\0"
            n = len(b) // 4
            cuts = [0, *range(n % size or min(n, size), n, size), n]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                for name, v in zip(out, (doc, k, x, y - x, zlib.crc32(b[4 * x : 4 * y]))):
                    out[name].append(v)
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow_rows(each, schema), ddl)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin that has room for it, else into a new one."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[int] = []  # the distinct residuals, sorted
    bins: dict[int, list[int]] = {}
    made = 0
    for i in order:
        n = int(lengths[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            at = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[k]
        else:
            room, at, made = size, made, made + 1
        where[i], offset[i] = at, size - room
        if left := room - n:
            if left not in bins:
                bins[left] = []
                bisect.insort(rooms, left)
            bins[left].append(at)
    return where, offset


def _group(size: int, keep: int, round_: int):
    """Packs one group; a bin is done when its residual is at most `keep`."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "item"], kind="stable")
        length = pdf["length"].to_numpy(np.int64)
        at, offset = best_fit(length, size)
        filled = np.bincount(at, weights=length).astype(np.int64)
        bin_id = (np.int64(round_ + 1) << 56) | (np.int64(pdf["g"].iloc[0]) << 28) | at
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "parent": bin_id, "offset": offset, "filled": filled[at], "done": size - filled[at] <= keep})

    return each


def pack(items: DataFrame, size: int = 2048, group_rows: int = 40_000, slack: int = 8) -> DataFrame:
    """items (item string or long, unique; length 1..size) with sequence_id and offset.

    Each round keeps a link (child, parent, offset) for every item; a bin's id is its round, group and number. The links of all
    rounds are followed upwards to place each item in its last bin.
    """
    spark = items.sparkSession
    level = items.select(F.col("item"), F.col("length"))
    chain, round_ = [], 0
    while True:
        n = level.count()
        groups = max(1, -(-n // group_rows))
        last = groups == 1
        keep = size if last else slack << round_

        # a hash deals items out evenly, copies of a length included: no group depends on a document, source or text
        dealt = level.withColumn("g", F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(groups)).cast("int"))
        ddl = "item long, parent long, offset long, filled long, done boolean"
        if not last:
            dealt = dealt.repartition(groups, "g")
        links = stash(dealt.groupBy("g").applyInPandas(_group(size, keep, round_), ddl))
        chain.append(links)
        if last:
            break
        level = cut(links.where("not done").groupBy(F.col("parent").alias("item")).agg(F.first("filled").alias("length")))
        round_ += 1
    out = None
    for links in reversed(chain):  # from the last bins down to the items
        if out is None:
            out = links.select("item", F.col("parent").alias("sequence_id"), "offset")
        else:
            up = out.select(F.col("item").alias("parent"), F.col("sequence_id").alias("top"), F.col("offset").alias("base"))
            out = links.join(up, "parent", "left").select(
                "item", F.coalesce("top", "parent").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
            )
    return out


def pack_documents(docs: DataFrame, size: int = 2048, group_rows: int = 40_000, slack: int = 8, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is the end id alone. Rows with the same doc_id, or none, are packed each. Full pieces are sequences of
    their own. Other columns of docs are not looked at; an empty table gives no row.
    """
    # a row's number within its partition is fixed by the table written here, not by the order in which a later job reads it
    found = stash(pieces(docs, size, tokenizer_path).withColumn("item", F.monotonically_increasing_id()))
    full = found.where(F.col("length") == size).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pack(found.where(F.col("length") < size).select("item", "length"), size, group_rows, slack)
    placed = full.unionAll(short)
    return found.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, size: int = 2048) -> DataFrame:
    """(sequence_id, n_tokens, pieces): each sequence with its pieces in order; at most `size` of them, so a row is bounded."""
    placed = pack_documents(docs, size)
    part = F.struct("offset", "doc_id", "piece", "start", "length")
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("pieces"))
