"""Ratings by a remote model: a budget of open requests for the whole job, pauses between errors, and a log of answers.

A round asks for every request that has no rating yet. Its requests go by key to a fixed number of tasks, and the budget is divided
among these, so that all of them together keep within it however many executors there are (speculative execution would run tasks
twice and is refused). A task logs its answers, some at a time, in a folder of its own in the shared log; a task that is run again, or
a job that is started again with the same log, asks only for what the log does not have. Ratings are read from the log.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.functions.text import parse_rating
from ratingmill.operators.scoring import JudgeOptions, Scorer

LOG = "key string, round int, answer string"


def called(ask: Callable[[str], str], prompt: str, options: JudgeOptions, errors: tuple[type[Exception], ...]) -> str:
    """The answer to a prompt, after a delay; an error of the given kinds is tried again, api_retries times, after pauses that double."""
    if options.delay_s:
        time.sleep(options.delay_s)
    for attempt in range(options.api_retries + 1):
        try:
            return ask(prompt) or ""
        except errors:
            if attempt == options.api_retries:
                raise
            time.sleep(options.backoff_s * 2**attempt)
    raise AssertionError("not reached")


def shares(budget: int, tasks: int) -> list[int]:
    """The budget divided among tasks; fewer tasks if it has less than one for each."""
    tasks = max(1, min(budget, tasks))
    return [budget // tasks + (i < budget % tasks) for i in range(tasks)]


def _known(store: fs.FileSystem, folder: str) -> set[str]:
    out = set()
    for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if x.base_name.endswith(".json"):
            with store.open_input_stream(x.path) as f:
                out |= {json.loads(line)["key"] for line in f.read().decode().splitlines()}
    return out


def _log(store: fs.FileSystem, folder: str, rows: list[dict]) -> None:
    """A file that is there whole or not at all."""
    name = uuid.uuid4().hex
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/_{name}") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
    store.move(f"{folder}/_{name}", f"{folder}/{name}.json")


def remote(
    ask: Callable[[str], str], keys: Sequence[str], log: str, options: JudgeOptions = JudgeOptions(default=5.0, retries=5), errors: tuple[type[Exception], ...] = (Exception,), log_every: int = 64
) -> Scorer:
    """Scores requests (keys, prompt) by the rating in a remote model's answer: `retries` answers at most, then the default.

    keys tell requests apart. log: a folder that driver and executors share, empty or of an earlier run of the same requests. At most
    `concurrency` requests are open at once in the job. A lost task asks again for `log_every` answers at most."""

    def asked_for(pending: DataFrame, number: int) -> None:
        spark = pending.sparkSession
        if spark.sparkContext.getConf().get("spark.speculation", "false") == "true":
            raise ValueError("speculative execution would ask twice")
        share = shares(options.concurrency, spark.sparkContext.defaultParallelism)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            task = TaskContext.get().partitionId()
            store, top = fs.FileSystem.from_uri(log)
            folder = f"{top}/round-{number}/task-{task}"
            known, n = _known(store, folder), 0
            with ThreadPoolExecutor(share[task]) as pool:
                for b in batches:
                    rows = [r for r in zip(b["key"], b["prompt"], strict=True) if r[0] not in known]
                    for i in range(0, len(rows), log_every):
                        part = rows[i : i + log_every]
                        answers = pool.map(lambda r: called(ask, r[1], options, errors), part)
                        _log(store, folder, [{"key": k, "round": number, "answer": a} for (k, _), a in zip(part, answers, strict=True)])
                        n += len(part)
            yield pd.DataFrame({"n": [n]})

        pending.repartition(len(share), "key").mapInPandas(each, "n long").agg(F.sum("n")).collect()

    def run(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        store, top = fs.FileSystem.from_uri(log)
        store.create_dir(top, recursive=True)
        keyed = df.withColumn("__key", F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])))
        answers = lambda: spark.read.schema(LOG).option("recursiveFileLookup", "true").json(log, mode="FAILFAST")
        rated = lambda: answers().withColumn("rating", parse_rating(F.col("answer")).cast("double"))
        for number in range(max(1, options.retries)):
            over = rated().where(F.col("rating").isNotNull() | (F.col("round") >= number)).select("key").distinct()
            pending = keyed.select(F.col("__key").alias("key"), "prompt").join(over, "key", "left_anti")
            if pending.isEmpty():
                continue  # all are rated, or an earlier run has asked for this round
            asked_for(pending, number)
        first = rated().where("rating is not null").groupBy(F.col("key").alias("__key")).agg(F.min_by("rating", "round").alias("score"))
        out = keyed.join(first, "__key", "left").drop("__key")
        return out.withColumn("score", F.coalesce("score", F.lit(options.default).cast("double")))

    return run
