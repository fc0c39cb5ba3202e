"""The model boundary: scorers and generators as functions from request tables to request tables.

A scorer adds `score` (nullable double) to each request, a generator adds `response` (schema.RESPONSE). What stands behind is a SQL
expression, a pandas UDF or mapInPandas; here it is a surrogate, since no model is part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingmill.functions.portable import surrogate_score
from ratingmill.functions.text import fill, parse_rating, render_messages, split_reasoning
from ratingmill.operators import conversations as conv

Scorer = Callable[[DataFrame], DataFrame]
Generator = Callable[[DataFrame], DataFrame]

RESPONSE_TEMPLATE = "Conversation:\n{conversation}\nHow {attribute} is the assistant's last message? Give a whole number from 1 to 10.\n"
PROMPT_TEMPLATE = "Conversation:\n{conversation}\nHow {attribute} is the user's last message? Give a whole number from 1 to 10.\n"
# fixed value: what makes a model that was cut off while thinking give its rating
FORCED = "</think>\n\nRating: "
SYSTEM = {True: "You rate conversations. Think first, then answer with the rating.", False: "You rate conversations. Answer with the rating only."}


@dataclass(frozen=True)
class JudgeOptions:
    """retries: attempts in all; force_rating: cut thinking short when the budget ends; default: what an unparsable answer scores.
    delay_s: a pause before each remote request. temperature, max_tokens, top_p, the penalties and the ids of the yes and no tokens are for the
    models behind the generators."""

    retries: int = 3
    force_rating: bool = True
    thinking: bool = False
    default: float | None = None
    temperature: float = 0.0
    max_tokens: int = 8192
    yes_token: int = 9642
    no_token: int = 2822
    concurrency: int = 50
    api_retries: int = 6
    backoff_s: float = 5.0
    delay_s: float = 0.0
    top_p: float = 1.0
    presence_penalty: float = 0.0
    repetition_penalty: float = 1.0


def by_path(dotted: str):
    """A factory named module.attribute."""
    module, _, name = dotted.rpartition(".")
    return getattr(import_module(module), name)


def response_requests(df: DataFrame, options: JudgeOptions = JudgeOptions()) -> DataFrame:
    """Requests (messages, attribute) with system and prompt; raises unless the assistant has the last word after the user."""
    df = conv.checked(df, conv.ends_with_answer(F.col("messages")), "the conversation must end with a user's and an assistant's message")
    return _rendered(df, RESPONSE_TEMPLATE, options)


def prompt_requests(df: DataFrame, options: JudgeOptions = JudgeOptions()) -> DataFrame:
    """Requests about the user's last message; raises unless the user has the last word."""
    df = conv.checked(df, conv.ends_with_question(F.col("messages")), "the conversation must end with a user's message")
    return _rendered(df, PROMPT_TEMPLATE, options)


def _rendered(df: DataFrame, template: str, options: JudgeOptions) -> DataFrame:
    prompt = fill(template, conversation=render_messages(F.col("messages")), attribute=F.col("attribute"))
    return df.withColumns({"system": F.lit(SYSTEM[options.thinking]), "prompt": prompt})


def raw_requests(df: DataFrame, prompt: Column, options: JudgeOptions = JudgeOptions()) -> DataFrame:
    """Requests whose prompts are already written, as they are; raises where one is missing."""
    df = conv.checked(df, prompt.isNotNull(), "a prompt is missing")
    return df.withColumns({"system": F.lit(SYSTEM[options.thinking]), "prompt": prompt})


def surrogate_scorer(*keys: str) -> Scorer:
    """Scores by a hash of the keys; the same request has the same score."""
    return lambda df: df.withColumn("score", surrogate_score(*[F.col(k) for k in keys]))


def surrogate_generator(*keys: str, fails: int = 0) -> Generator:
    """Echoes the keys; of `fails` in a hundred requests the response is cut off."""

    def generate(df: DataFrame) -> DataFrame:
        from ratingmill.functions.portable import draw

        raw = F.concat(F.lit("re: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))
        stop = draw(100, *[F.col(k) for k in keys], "stop") >= fails
        parts = split_reasoning(raw)
        return df.withColumn("response", F.struct(parts["content"].alias("content"), parts["reasoning"].alias("reasoning"), raw.alias("raw_text"), stop.alias("finish_reason_stop")))

    return generate


def parsed_rating(generate: Generator, options: JudgeOptions = JudgeOptions(), short: Generator | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Scorer:
    """Scores by the rating in a generator's response.

    A response that was cut off is asked for its rating alone, if options say so: its text so far and the end of thinking are put after
    the prompt, and `short` (a generator of a few tokens; the same one if not given) goes on from there. Without that it has no score.
    keep: writes the responses and reads them back, as a model's answers must not be made twice."""

    def score(df: DataFrame) -> DataFrame:
        out = keep(generate(df))
        ended = F.coalesce(F.col("response.finish_reason_stop"), F.lit(False))
        value = parse_rating(F.col("response.content")).cast("double")
        whole = out.where(ended).withColumn("score", value).drop("response")
        cut = out.where(~ended)
        if not options.force_rating:
            return whole.unionByName(cut.withColumn("score", F.lit(None).cast("double")).drop("response"))
        so_far = F.concat("prompt", F.coalesce("response.raw_text", F.lit("")), F.lit(FORCED))
        again = (short or generate)(cut.withColumns({"__prompt": F.col("prompt"), "prompt": so_far}).drop("response"))
        forced = again.withColumn("score", value).withColumn("prompt", F.col("__prompt"))
        return whole.unionByName(forced.select(whole.columns))

    return score


def retried(
    score: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame], DataFrame], options: JudgeOptions = JudgeOptions(), report: Callable[[int, int, int], None] | None = None
) -> Scorer:
    """A scorer that asks again for the requests without a score, `retries` times in all, then gives the default. keep: writes a
    round's result and reads it back, as a model's answers must not be made twice. report: gets the attempt, how many requests have a
    score so far, and how many there are."""

    def run(df: DataFrame) -> DataFrame:
        done, pending, columns = [], df, [*df.columns, "score"]
        scored, total = 0, None
        for attempt in range(max(1, options.retries)):
            result = keep(score(pending, attempt).select(columns))
            done.append(result.where("score is not null"))
            if report is not None:
                n = result.agg(F.count("score").alias("scored"), F.count("*").alias("asked")).first()
                scored, total = scored + n.scored, n.asked if total is None else total
                report(attempt, scored, total)
            pending = result.where("score is null").drop("score")
            if pending.isEmpty():
                break
        value = F.lit(options.default).cast("double")
        return reduce(DataFrame.unionByName, [*done, pending.withColumn("score", value).select(columns)])

    return run


def asked(ask: Callable[[str], str], options: JudgeOptions = JudgeOptions(default=5.0), asks: int = 4, errors: tuple[type[Exception], ...] = (Exception,)) -> Scorer:
    """Scores by a remote model: a task asks for `concurrency` prompts at a time; an error of the given kinds is tried again `api_retries`
    times, after pauses that double, an answer without a rating is asked for again `asks` times, and then the default holds.
    remote.remote has a budget for the whole job, and a log."""
    from ratingmill.operators.remote import called

    def one(prompt: str) -> float | None:
        import re

        for _ in range(asks + 1):
            found = re.findall(r"\b(10|[1-9])\b", called(ask, prompt, options, errors).strip())
            if found:
                return float(found[-1])
        return options.default

    def run(df: DataFrame) -> DataFrame:
        def each(batches):
            with ThreadPoolExecutor(options.concurrency) as pool:
                for b in batches:
                    yield b.assign(score=list(pool.map(one, b["prompt"])))

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(each, f"{ddl}, score double")

    return run


def deduplicated(score: Scorer, keys: Sequence[str]) -> Scorer:
    """Asks once for equal requests; for scorers whose answer depends on the keys alone."""

    def run(df: DataFrame) -> DataFrame:
        scored = score(df.dropDuplicates(list(keys))).select(*keys, "score")
        return df.join(scored, list(keys), "left")

    return run


def by_judge(df: DataFrame, judges: dict[str, Scorer]) -> DataFrame:
    """The requests scored by each judge: (judge, …)."""
    return reduce(DataFrame.unionByName, [s(df.withColumn("judge", F.lit(j))) for j, s in judges.items()])


def valid(response: Column) -> Column:
    """Whether a response has content and came to its end."""
    return F.coalesce((response["content"] != "") & response["finish_reason_stop"], F.lit(False))
