"""Places of regular expressions' matches, with DataFrame functions only.

The pieces between matches (split) and the matches (regexp_extract_all) alternate, so running sums of their lengths in code points
are the places. Sums are kept per block of BLOCK matches, so that a text with very many matches costs little more than one with
few. Each step is a projection of its own: expressions used more than once are then evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Code points before and after a match that its context has.
CONTEXT = 40
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>"


@dataclass(frozen=True)
class Rule:
    """kind: name; pattern: what proposes matches, leftmost and non-overlapping (Java); needs: is false only where there is no
    match (a cheap guard on the text); valid: which matches are kept (match -> boolean); score: (match, before, after) -> double;
    least: a match with a smaller score is dropped."""

    kind: str
    pattern: str
    needs: Callable[[Column], Column]
    valid: Callable[[Column], Column] = lambda m: F.lit(True)
    score: Callable[[Column, Column, Column], Column] = lambda m, before, after: F.lit(1.0)
    least: float | None = None


def spare(df: DataFrame, name: str) -> str:
    """A name, or the beginning of names, that no column of df has."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def annotate(df: DataFrame, text: Column, rules: Sequence[Rule], out: str) -> DataFrame:
    """df with the column `out`: spans of all rules by start, then by the rules' order; ends are exclusive, code points."""
    prefix = spare(df, "__rm_")
    name = lambda what, i: f"{prefix}{what}{i}"
    every = range(len(rules))
    df = df.withColumn(f"{prefix}text", F.coalesce(text, F.lit("")))
    t = F.col(f"{prefix}text")
    none = F.array().cast("array<string>")
    df = df.withColumns({name("hit", i): F.when(r.needs(t), F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))).otherwise(none) for i, r in enumerate(rules)})
    df = df.withColumns({name("gap", i): F.when(F.size(name("hit", i)) > 0, F.split(t, r.pattern, -1)).otherwise(none) for i, r in enumerate(rules)})
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    df = df.withColumns({name("len", i): F.zip_with(name("gap", i), name("hit", i), lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0))) for i in every})

    def base(i: int) -> Column:
        """The length of all before each block."""
        length = F.col(name("len", i))
        blocks = F.sequence(F.lit(0), F.greatest(F.size(length) - 1, F.lit(0)), F.lit(BLOCK))
        return F.aggregate(blocks, F.array(F.lit(0)), lambda acc, at: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(length, at + 1, BLOCK)))))

    df = df.withColumns({name("base", i): base(i) for i in every})

    def spans(i: int, r: Rule) -> Column:
        gap, length, base = (F.col(name(x, i)) for x in ("gap", "len", "base"))

        def one(m: Column, k: Column) -> Column:
            inside = k % BLOCK
            start = F.get(base, F.floor(k / BLOCK).cast("int")) + total(F.slice(length, k - inside + 1, inside)) + F.length(F.get(gap, k))
            score = r.score(m, F.right(F.get(gap, k), F.lit(CONTEXT)), F.left(F.get(gap, k + 1), F.lit(CONTEXT)))
            keep = r.valid(m) if r.least is None else r.valid(m) & (score >= r.least)
            return F.when(keep, F.struct(
                start.cast("int").alias("start"), F.lit(i).alias("rank"), F.lit(r.kind).alias("kind"), (start + F.length(m)).cast("int").alias("end"),
                m.alias("text"), score.cast("double").alias("score"),
            ))

        return F.filter(F.transform(name("hit", i), one), lambda x: x.isNotNull())

    df = df.withColumns({name("span", i): spans(i, r) for i, r in enumerate(rules)})
    df = df.withColumn(out, F.array_sort(F.concat(*[F.col(name("span", i)) for i in every])).cast(SPAN))
    return df.drop(f"{prefix}text", *[name(x, i) for x in ("hit", "gap", "len", "base", "span") for i in every])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, spans: str, base: Sequence[str], scores: bool = False) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and all spans, and their scores if asked for."""
    own = F.filter(spans, lambda s: s["kind"].isin(*base))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    more = [F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores")] if scores else []
    return df.select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"), *more)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first span in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.concat(acc["out"], F.array(before, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        inside = s["start"] < acc["at"]
        at = F.greatest(acc["at"], s["end"])
        return F.struct(at.alias("at"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)
