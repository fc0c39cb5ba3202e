"""Synthetic conversations: users with drawn styles, rewrite requests for every second turn, all-or-nothing assembly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.functions.text import fill, join_messages, style_phrase
from ratingmill.operators import conversations as conv
from ratingmill.operators import expand
from ratingmill.operators.scoring import Generator, valid

REWRITE = "Conversation so far:\n{context}\nMessage:\n{message}\nRewrite the message in this style:\n{style}\n"


def users(spark, splits: dict[str, int], names: Sequence[str], per_user: int, seed: int, factor: float = 1.05) -> DataFrame:
    """(split, user_idx, user_ord, attributes): more users of each split than wanted; user_idx starts anew in each split."""
    out, base = None, 0
    for split, n in splits.items():
        n = expand.oversampled(n, factor)
        part = spark.range(n).select(F.lit(split).alias("split"), F.col("id").cast("int").alias("user_idx"), (F.col("id") + base).alias("user_ord"))
        out, base = part if out is None else out.unionAll(part), base + n
    return expand.sampled_attributes(out, ["split", "user_idx"], names, per_user, seed)


def requests(users: DataFrame, corpus: DataFrame, per_user: int, sources: int) -> DataFrame:
    """A row for each turn to rewrite. corpus: (source_ord, messages); texts are joined after the users' slots are dealt out."""
    dealt = expand.slots(users, F.col("user_ord"), per_user, sources)
    turns = conv.user_turns(dealt.join(corpus, "source_ord"), ["split", "user_idx", "slot", "source_ord", "attributes"])
    prompt = fill(REWRITE, context=join_messages(F.col("context")), message=F.col("content"), style=style_phrase(F.col("attributes")))
    return turns.withColumn("prompt", prompt)


def valid_users(responses: DataFrame, key: Sequence[str] = ("split", "user_idx")) -> DataFrame:
    """The users all of whose requests are valid."""
    return responses.groupBy(*key).agg(F.bool_and(valid(F.col("response"))).alias("ok")).where("ok").select(*key)


def first_valid(users: DataFrame, wanted: Column, split: str = "split", order: str = "user_idx") -> DataFrame:
    """The first wanted users of each split; the rank needs no more than that many rows of a split at once."""
    w = Window.partitionBy(split).orderBy(order)
    return users.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= wanted).drop("__rank")


def back_filled(originals: DataFrame, responses: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, turn, role, text): the originals' turns; those that have a response are the user's, with its content."""
    new = responses.select(*key, "turn", F.col("response.content").alias("__new"))
    both = originals.join(new, [*key, "turn"], "left")
    role = F.when(F.col("__new").isNotNull(), "user").otherwise(F.col("role"))
    return both.withColumns({"role": role, "text": F.coalesce("__new", "text")}).drop("__new")


def assemble(users: DataFrame, corpus: DataFrame, generate: Generator, per_user: int, sources: int, wanted: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(users_json rows with split, counts by split). A user is kept if all requests are valid, up to the wanted number."""
    key = ["split", "user_idx"]
    done = generate(requests(users, corpus, per_user, sources))
    ok = valid_users(done)
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("split"))
    kept = first_valid(ok, cap)
    counts = users.groupBy("split").count().join(ok.groupBy("split").agg(F.count("*").alias("valid")), "split", "left")
    counts = counts.select("split", F.coalesce("valid", F.lit(0)).alias("valid"), (F.col("count") - F.coalesce("valid", F.lit(0))).alias("discarded"))
    return rewritten(users.join(kept, key), corpus, done, per_user, sources), counts


def rewritten(chosen: DataFrame, corpus: DataFrame, responses: DataFrame, per_user: int, sources: int) -> DataFrame:
    """users_json rows with split: the chosen users' conversations, turns that were asked for replaced by their responses."""
    key = ["split", "user_idx"]
    slots = expand.slots(chosen, F.col("user_ord"), per_user, sources).join(corpus, "source_ord")
    flat = conv.flatten(slots, [*key, "slot", "source_ord"])
    filled = back_filled(flat, responses.select(*key, "slot", F.col("turn").cast("long").alias("turn"), "response"), [*key, "slot"])
    nested = conv.nest(filled, [*key, "slot", "source_ord"])
    each = F.struct("slot", F.col("source_ord").cast("string").alias("conversation_id"), "messages")
    ordered = F.transform(F.array_sort(F.collect_list(each)), lambda c: F.struct(c["conversation_id"].alias("conversation_id"), c["messages"].alias("messages")))
    out = nested.groupBy(*key).agg(ordered.alias("conversations")).join(chosen.select(*key, F.col("attributes").alias("rewrite_style_attributes")), key)
    return out.select("split", "user_idx", "rewrite_style_attributes", "conversations")


def dataset(users: DataFrame) -> DataFrame:
    """users_json rows as items: the last conversation is current, the others are history. The key is (split, user_id)."""
    past, current = conv.history_and_current(F.transform("conversations", lambda c: c["messages"]))
    return users.select("split", F.col("user_idx").cast("string").alias("user_id"), F.col("rewrite_style_attributes").alias("user_attributes"), past.alias("conversation_history"), current.alias("current_messages"))


#: Requests of a segment, in chunks; a task deals with the users of one segment at once.
SEGMENT = 1000
#: Requests of a segment at most, and so its users, whatever the size of chunks.
MOST_REQUESTS = 1_500_000
#: Rows that the driver takes to look up where chunks close; more stay where they are and are asked for one by one.
MOST_ROWS = 100_000


def _closes(total: np.ndarray, size: int) -> np.ndarray:
    """For users by running total (their own requests included): the user that closes the chunk after one that each closes."""
    return np.searchsorted(total, total + size)


def chunked(users: DataFrame, order: Sequence[Column], requests: Column, size: int) -> DataFrame:
    """users with the chunk in which each falls: a chunk ends with the user whose requests bring it to `size` or more, and the next
    starts from zero.

    Where a chunk ends depends on all before it, so it is found in three passes. Users are split into segments of SEGMENT chunks or
    MOST_REQUESTS requests by the running total. For each user that may close a segment's first chunk (those of its first `size`
    requests) the segment tells how many chunks end in it from there and where the last one does. From segment to segment (or, where
    chunks are larger, from chunk to chunk) the driver looks up one such row; then each segment numbers its users from where its first
    chunk began. Requests are one or more for each user."""
    rows = conv.running_total(users.withColumn("__n", requests.cast("long")), order, "__n", "__before")
    rows = rows.withColumn("__segment", F.floor(F.col("__before") / min(size * SEGMENT, MOST_REQUESTS)).cast("long"))
    ddl = "segment long, reach long, closed long, last long"

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__before")
        start, total = int(pdf["__before"].iloc[0]), (pdf["__before"] + pdf["__n"]).to_numpy(np.int64)
        after, n = _closes(total, size), len(total)
        closed, last = np.ones(n, np.int64), total.copy()
        for i in range(int(np.searchsorted(after, n)) - 1, -1, -1):
            closed[i], last[i] = closed[after[i]] + 1, last[after[i]]
        first = int(np.searchsorted(total, start + size)) + 1
        return pd.DataFrame({"segment": pdf["__segment"].iloc[0], "reach": total[:first], "closed": closed[:first], "last": last[:first]})

    own = rows.select("__segment", "__before", "__n")
    tables = own.groupBy("__segment").applyInPandas(table, ddl).persist()
    begun, chunk, starts = 0, 0, []  # where the chunk that is open began, and its number
    try:
        few = tables.limit(MOST_ROWS + 1).toPandas()
        few = few.sort_values("reach") if len(few) <= MOST_ROWS else None

        def closing(x: int):
            """(reach, closed, last, segment) of the first user that closes a chunk which ends at x or later."""
            if few is None:
                return tables.where(F.col("reach") >= x).agg(F.min(F.struct("reach", "closed", "last", "segment")).alias("r")).first().r
            k = int(np.searchsorted(few["reach"].to_numpy(), x))
            return tuple(int(few[c].iloc[k]) for c in ("reach", "closed", "last", "segment")) if k < len(few) else None

        while (found := closing(begun + size)) is not None:
            starts += [(s, begun, chunk) for s in range(len(starts), found[3] + 1)]
            begun, chunk = found[2], chunk + found[1]
        end = tables.agg(F.max("segment")).first()[0]
        starts += [(s, begun, chunk) for s in range(len(starts), -1 if end is None else end + 1)]
    finally:
        tables.unpersist()
    began = users.sparkSession.createDataFrame(starts, "__segment long, __begun long, __chunk long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__before")
        total = (pdf["__before"] + pdf["__n"]).to_numpy(np.int64)
        after, chunk = _closes(total, size), np.zeros(len(total), np.int64)
        at = int(np.searchsorted(total, int(pdf["__begun"].iloc[0]) + size))
        while at < len(total):
            chunk[at + 1 : at + 2] += 1
            at = int(after[at])
        return pd.DataFrame({"__before": pdf["__before"].to_numpy(), "chunk": int(pdf["__chunk"].iloc[0]) + np.cumsum(chunk)})

    numbers = own.join(F.broadcast(began), "__segment").groupBy("__segment").applyInPandas(number, "__before long, chunk long")
    return rows.join(numbers, "__before").drop("__n", "__before", "__segment")
