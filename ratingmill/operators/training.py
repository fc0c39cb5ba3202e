"""Training by epochs: mini-batches in a keyed order, accumulated gradients, AdamW, losses by epoch.

The model is a softmax over hashed words. Features of texts, the counts of their hashed words, are made once, by all tasks. For an epoch
rows are put in the order of a hash of their key, the epoch and the seed, as parts by range that tasks sort and pack at once, about
PART bytes each however many rows there are. A step is the rows of `accumulate` mini-batches and needs the model of the step before, so
parts are trained on one after the other, each where it lies: a job for each part takes the model and the rows of the unfinished step
from the part before, reads its own rows step by step, and hands both on through the driver; their size is set by options alone. Steps
have the same rows and sums however the parts are cut, so the result is the same, bit by bit, for any number of them. A lost executor
costs the part that is running, and its own parts are made again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill.functions.portable import order_key


#: Bytes of features in a part of an epoch, about: a part costs a job.
PART = 128_000_000
#: Bytes of features that are packed or judged at once, about, or one row.
BLOCK = 4_000_000


@dataclass(frozen=True)
class EpochOptions:
    """rate, decay, betas, epsilon: of AdamW. max_length: words of a text that are read; None: all. tasks: that put an epoch's rows in
    order, at least; None: as many as the session's default parallelism."""

    width: int = 1 << 14
    epochs: int = 3
    batch_size: int = 8
    accumulate: int = 8
    rate: float = 0.01
    decay: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    max_length: int | None = None
    seed: int = 42
    tasks: int | None = None


@dataclass
class Weights:
    """A softmax model with AdamW's moments, a row for each class; the last column is the bias."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: int = 0

    @classmethod
    def zero(cls, width: int, classes: int) -> "Weights":
        return cls(*(np.zeros((classes, width + 1)) for _ in range(3)))

    def copy(self) -> "Weights":
        return Weights(self.w.copy(), self.m.copy(), self.v.copy(), self.steps)

    def update(self, gradient: np.ndarray, o: EpochOptions) -> None:
        """One step of AdamW, in place."""
        self.steps += 1
        self.m *= o.beta1
        self.m += (1 - o.beta1) * gradient
        self.v *= o.beta2
        gradient *= gradient
        gradient *= 1 - o.beta2
        self.v += gradient
        scale = self.v / (1 - o.beta2**self.steps)
        np.sqrt(scale, out=scale)
        scale += o.epsilon
        change = self.m / (1 - o.beta1**self.steps)
        change /= scale
        change += o.decay * self.w
        change *= o.rate
        self.w -= change


@dataclass
class Texts:
    """Texts by their features: labels, how many places each text has, and (place, count) of all texts one after the other."""

    labels: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray

    @classmethod
    def none(cls) -> "Texts":
        return cls(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, 2), np.int32))

    @classmethod
    def of(cls, labels, features: Sequence[bytes]) -> "Texts":
        """labels: None where only the features matter."""
        sizes = np.fromiter(map(len, features), np.int64, len(features)) // 8
        return cls(np.zeros(len(sizes), np.int32) if labels is None else labels, sizes, np.frombuffer(b"".join(features), np.int32).reshape(-1, 2))

    def __len__(self) -> int:
        return len(self.labels)

    def __add__(self, other: "Texts") -> "Texts":
        return Texts(*(np.concatenate(x) for x in ((self.labels, other.labels), (self.sizes, other.sizes), (self.pairs, other.pairs))))

    def split(self, n: int) -> tuple["Texts", "Texts"]:
        """The first n and the others."""
        at = self.sizes[:n].sum()
        return Texts(self.labels[:n], self.sizes[:n], self.pairs[:at]), Texts(self.labels[n:], self.sizes[n:], self.pairs[at:])


class _Batch:
    """Texts ready for judging: counts are scaled to a length of one for each text, and every text has the bias."""

    def __init__(self, texts: Texts):
        self.labels, self.row = texts.labels, np.repeat(np.arange(len(texts)), texts.sizes)
        self.at, self.n = texts.pairs[:, 0].astype(np.int64), texts.pairs[:, 1].astype(float)
        length = np.sqrt(np.bincount(self.row, self.n * self.n, len(texts)))
        self.length = np.where(length > 0, length, 1.0)

    def logs(self, w: np.ndarray) -> np.ndarray:
        """The log probabilities of each text's classes."""
        z = np.stack([np.bincount(self.row, c[self.at] * self.n, len(self.labels)) / self.length + c[-1] for c in w], 1)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradient(self, residuals: np.ndarray, width: int) -> np.ndarray:
        """The gradient of a model, of (texts, classes) residuals."""
        out = np.empty((residuals.shape[1], width + 1))
        for own, r in zip(out, residuals.T):
            own[:] = np.bincount(self.at, (r / self.length)[self.row] * self.n, width + 1)
            own[width] = r.sum()
        return out


def features(hashed: Sequence[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text by its words' hashes: counts, of length one together, and the bias."""
    at, n = np.unique(np.asarray(hashed, np.int64), return_counts=True)
    x = n / np.sqrt((n * n).sum()) if len(n) else n.astype(float)
    return np.append(at, width), np.append(x, 1.0)


def hashed_words(text, options: EpochOptions):
    """A text's words, lower case, as hashes below the width; none of a null text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda x: x != "")
    words = words if options.max_length is None else F.slice(words, 1, options.max_length)
    return F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(options.width)).cast("int"))


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of rows, of about so much together or one row."""
    inner = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    places = [0, *inner.tolist(), len(sizes)]
    return ((a, b) for a, b in zip(places, places[1:]) if b > a)


def counted(text, options: EpochOptions):
    """A text's features: its hashed words as (place, count) in 32-bit numbers, by place."""
    width = options.width

    @F.arrow_udf("binary")
    def made(words: pa.Array) -> pa.Array:
        sizes, every, out, begin = np.asarray(words.value_lengths(), np.int64), words.flatten(), [], 0
        for a, b in _cuts(sizes, BLOCK // 8):
            n = int(sizes[a:b].sum())
            row = np.repeat(np.arange(b - a), sizes[a:b])
            found, count = np.unique(row * width + every.slice(begin, n).to_numpy(), return_counts=True)
            begin += n
            pairs = np.stack([found % width, count], 1).astype(np.int32)
            ends = np.cumsum(np.bincount(found // width, minlength=b - a)).tolist()
            out += [pairs[i:j].tobytes() for i, j in zip([0, *ends], ends)]
        return pa.array(out, pa.binary())

    return made(hashed_words(text, options))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, features) as few rows of many, in their order."""
    for b in batches:
        labels, found = b.column(0).to_numpy().astype(np.int32), b.column(1).to_pylist()
        for first, end in _cuts(np.fromiter(map(len, found), np.int64, len(found)), BLOCK):
            t = Texts.of(labels[first:end], found[first:end])
            yield pa.RecordBatch.from_pydict({k: pa.array([x.tobytes()], pa.binary()) for k, x in (("labels", t.labels), ("sizes", t.sizes), ("pairs", t.pairs))})


@dataclass
class _Progress:
    """What a part hands on to the next: the model, the rows of the step that is not complete, and the sum of losses up to it."""

    state: Weights
    done: int = 0
    lost: float = 0.0
    rest: Texts | None = None

    def train(self, texts: Texts, n: int, o: EpochOptions) -> None:
        """Goes on by more of an epoch's n rows, as far as they complete steps."""
        rest, group = texts if self.rest is None else self.rest + texts, o.batch_size * o.accumulate
        while len(rest) and len(rest) >= min(group, n - self.done):
            now, rest = rest.split(min(group, n - self.done))
            batch, own = _Batch(now), np.arange(len(now))
            begin = (self.done + own) // o.batch_size * o.batch_size
            size = np.minimum(o.batch_size, n - begin)  # of the row's mini-batch
            logs = batch.logs(self.state.w)
            self.lost -= float((logs[own, now.labels] / size).sum())
            residuals = np.exp(logs)
            residuals[own, now.labels] -= 1
            self.state.update(batch.gradient(residuals / (size * o.accumulate)[:, None], o.width), o)
            self.done += len(now)
        self.rest = rest


def _epoch(blocks: DataFrame, n: int, state: Weights, o: EpochOptions) -> tuple[Weights, float]:
    """One epoch over n rows, packed and in order: the new state, and the mean of the mini-batches' losses."""
    sc, rows, now = blocks.sparkSession.sparkContext, blocks.rdd, _Progress(state)
    for part in range(rows.getNumPartitions()):
        sent = sc.broadcast(now)

        def each(own: Iterator) -> Iterator[_Progress]:
            p = replace(sent.value, state=sent.value.state.copy())
            for r in own:
                p.train(Texts(np.frombuffer(r.labels, np.int32), np.frombuffer(r.sizes, np.int64), np.frombuffer(r.pairs, np.int32).reshape(-1, 2)), n, o)
            yield p

        (now,) = sc.runJob(rows, each, [part])
        sent.destroy()
    return now.state, now.lost / (n / o.batch_size)


class EpochClassifier:
    """Text to label by a softmax over hashed words, trained by epochs. Labels are numbers from 0; texts without words are judged by the bias."""

    def __init__(self, options: EpochOptions = EpochOptions(), weights: np.ndarray | None = None, history: Sequence[tuple] = ()):
        self.options, self.weights, self.history = options, weights, list(history)

    def train(self, df: DataFrame, validation: DataFrame | None = None, key: Sequence[str] = ("text", "label")) -> "EpochClassifier":
        """df, validation: (text, label int). key: tells the rows apart in the order of an epoch; rows that are equal in it must be equal.

        history has (epoch, train_loss, val_loss, val_accuracy); the last two are null without validation, and for an empty one."""
        o, spark = self.options, df.sparkSession
        made, keys = (F.col("label").cast("int").alias("label"), counted(F.col("text"), o).alias("features")), [f"k{i}" for i in range(len(key))]
        # texts are dealt out before they are split, as a file may be one row group
        deal = lambda x: x.repartition(*(key if set(key) <= set(x.columns) else ("text", "label")))
        rows = deal(df).select(*made, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(key, keys)]).persist()
        held = None if validation is None else deal(validation).select(*made).persist()
        try:
            seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("features")), F.lit(0)).alias("room"), F.max("label").alias("top"), F.count_if(F.col("label").isNull() | (F.col("label") < 0)).alias("bad")).first()
            if seen.bad:
                raise ValueError(f"{seen.bad} rows have no label")
            state, self.history = Weights.zero(o.width, (seen.top or 0) + 1), []
            self.weights = state.w.T
            parts = max(o.tasks or spark.sparkContext.defaultParallelism, seen.room // PART)
            for epoch in range(o.epochs):
                if not seen.n:
                    break
                shuffled = rows.withColumn("o", order_key(*map(F.col, keys), epoch, o.seed)).repartitionByRange(parts, "o", *keys).sortWithinPartitions("o", *keys)
                blocks = shuffled.select("label", "features").mapInArrow(_pack, "labels binary, sizes binary, pairs binary").persist()
                try:
                    blocks.count()  # all parts at once
                    state, loss = _epoch(blocks, seen.n, state, o)
                finally:
                    blocks.unpersist()
                self.weights = state.w.T
                told = self._loss(held).first() if held is not None else None
                self.history.append((epoch, loss, told.loss if told else None, told.accuracy if told else None))
        finally:
            rows.unpersist()
            if held is not None:
                held.unpersist()
        return self

    def _judged(self, df: DataFrame, found) -> DataFrame:
        """found: the column of features."""
        sent = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(self.weights.T))

        @F.arrow_udf("array<double>")
        def logs(found: pa.Array) -> pa.Array:
            every, out = found.to_pylist(), []
            for a, b in _cuts(np.fromiter(map(len, every), np.int64, len(every)), BLOCK):
                out += _Batch(Texts.of(None, every[a:b])).logs(sent.value).tolist()
            return pa.array(out, pa.list_(pa.float64()))

        return df.withColumn("__logs", logs(found))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with its prediction: the likeliest class, of several the smallest."""
        best = F.array_position("__logs", F.array_max("__logs")) - 1
        return self._judged(df, counted(F.col("text"), self.options)).withColumn("prediction", best.cast("int")).drop("__logs")

    def loss(self, df: DataFrame) -> DataFrame:
        """(loss, accuracy, n) on labelled rows: the mean negative log probability of the label. A label that training had not seen has
        the least probability there is."""
        return self._loss(df.select("label", counted(F.col("text"), self.options).alias("features")))

    def _loss(self, df: DataFrame) -> DataFrame:
        """loss of (label, features)."""
        out = self._judged(df, F.col("features"))
        own = F.coalesce(F.try_element_at("__logs", F.col("label").cast("int") + 1), F.lit(float(np.log(1e-300))))
        right = F.array_position("__logs", F.array_max("__logs")) - 1 == F.col("label")
        return out.agg(F.avg(-own).alias("loss"), F.avg(right.cast("double")).alias("accuracy"), F.count("*").alias("n"))

    def losses(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double, val_accuracy double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Options, history and the weights that are not zero, as Parquet."""
        about = json.dumps({"options": asdict(self.options), "history": self.history, "classes": self.weights.shape[1]})
        at, label = np.nonzero(self.weights)
        table = pa.table({"place": at, "label": label, "weight": self.weights[at, label]})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        spark.createDataFrame(table.to_pandas(), "place long, label long, weight double").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EpochClassifier":
        about = json.loads(spark.read.parquet(f"{path}/about").first().about)
        options = EpochOptions(**about["options"])
        weights = np.zeros((options.width + 1, about["classes"]))
        own = spark.read.parquet(f"{path}/weights").toPandas()  # as many as options and classes allow
        weights[own["place"], own["label"]] = own["weight"]
        return cls(options, weights, [tuple(h) for h in about["history"]])
