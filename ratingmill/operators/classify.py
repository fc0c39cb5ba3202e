"""A text classifier for labels, and the system that learns from rewards which attribute to give a user.

The classifier is hashed words, inverse document frequency and logistic regression: another family than a fine-tuned transformer,
with the same train, predict, save and load.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingmill.functions.text import decode_label, render_history, signed_name
from ratingmill.operators import expand, reward
from ratingmill.operators.scoring import Generator, Scorer


#: The column of a text's words as hashed counts.
COUNTS = "__tf"


@dataclass(frozen=True)
class ClassifierOptions:
    width: int = 1 << 14
    rounds: int = 50
    regularisation: float = 0.01
    max_length: int | None = None


def truncation(lengths: Column, most: int) -> list[Column]:
    """Aggregates: how many are too long, of how many, and by how much on average."""
    over = lengths > most
    return [F.count_if(over).alias("over"), F.count("*").alias("total"), F.avg(F.when(over, lengths - most)).alias("mean_excess")]


class TextClassifier:
    def __init__(self, model: PipelineModel | None = None, options: ClassifierOptions = ClassifierOptions()):
        self.model, self.options = model, options

    def _cut(self, df: DataFrame) -> DataFrame:
        return df if self.options.max_length is None else df.withColumn("text", F.substring("text", 1, self.options.max_length))

    def _counters(self) -> list:
        words = RegexTokenizer(inputCol="text", outputCol="__words", pattern=r"\W+")
        return [words, HashingTF(inputCol="__words", outputCol=COUNTS, numFeatures=self.options.width)]

    def counted(self, df: DataFrame) -> DataFrame:
        """df with the counts of its texts' words in place of the texts, as train and predict take them: for texts that are used again."""
        return PipelineModel(self._counters()).transform(self._cut(df)).drop("text", "__words")

    def train(self, df: DataFrame) -> "TextClassifier":
        """df: (text, label int), or counted. Texts are split and counted once, whatever the number of passes over their counts."""
        o = self.options
        counted = (df if COUNTS in df.columns else self.counted(df.select("text", "label"))).select(COUNTS, "label").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            steps = [IDF(inputCol=COUNTS, outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="label", maxIter=o.rounds, regParam=o.regularisation)]
            learned = Pipeline(stages=steps).fit(counted)
        finally:
            counted.unpersist()
        self.model = PipelineModel([*self._counters(), *learned.stages])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction; df: (text), which stays, or counted."""
        if COUNTS in df.columns:
            out = PipelineModel(self.model.stages[2:]).transform(df)
        else:
            out = self.model.transform(self._cut(df))
        return out.withColumn("prediction", F.col("prediction").cast("int")).drop("__words", COUNTS, "__x", "rawPrediction", "probability")

    def accuracy(self, df: DataFrame) -> DataFrame:
        return self.predict(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))

    def loss(self, df: DataFrame) -> DataFrame:
        """(loss, accuracy, n) on labelled rows, as for validation: the mean negative log probability of the label."""
        out = self.model.transform(self._cut(df))
        p = F.get(vector_to_array("probability"), F.col("label"))
        right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
        return out.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"), right.alias("accuracy"), F.count("*").alias("n"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "TextClassifier":
        return cls(PipelineModel.load(path))


class PersonalizationSystem(ABC):
    """What a system must do: learn from rewards, then answer; evaluate starts from a saved state where a path is given."""

    @abstractmethod
    def train(self, items: DataFrame, user_attributes: DataFrame, generate: Generator, scorer: Scorer, keep) -> DataFrame: ...

    @abstractmethod
    def evaluate(self, items: DataFrame, generate: Generator, load_path: str | None = None) -> DataFrame: ...


class AttributeSystem(PersonalizationSystem):
    """Learns from rewards which attribute, followed or avoided, suits a user's history; answers with it in the prompt.

    Answers with each attribute and histories by their words do not depend on what users want: tried and counted make them once for many
    systems of the same options, whose learn and answer start from them."""

    def __init__(self, names: list[str], options: ClassifierOptions = ClassifierOptions()):
        self.names, self.classifier = names, TextClassifier(options=options)

    def tried(self, items: DataFrame, generate: Generator) -> DataFrame:
        """(split, user_id, attr_ord, tried, content): each user's answers with each attribute, without the conversations."""
        answers = generate(expand.by_attribute(items, self.names))
        return answers.select("split", "user_id", "attr_ord", F.col("attribute").alias("tried"), F.col("response.content").alias("content"))

    def counted(self, items: DataFrame) -> DataFrame:
        """items with their histories' words, counted."""
        return self.classifier.counted(items.withColumn("text", render_history(F.col("conversation_history"))))

    def train(self, items: DataFrame, user_attributes: DataFrame, generate: Generator, scorer: Scorer, keep) -> DataFrame:
        """items: (split, user_id, conversation_history, current_messages). keep: writes a table and reads it back; responses and scores
        are made once. Gives the labels."""
        labels = self.learn(self.counted(items), keep(self.tried(items, generate)), user_attributes, scorer, keep)
        return items.select("split", "user_id", render_history(F.col("conversation_history")).alias("text")).join(labels, ["split", "user_id"])

    def learn(self, counted: DataFrame, tried: DataFrame, user_attributes: DataFrame, scorer: Scorer, keep) -> DataFrame:
        """Trains on users' counted histories and answers with each attribute. Gives the labels."""
        rewards = keep(reward.judge_users(tried, user_attributes, scorer, ["attr_ord", "tried"]))
        labels = keep(reward.best_attribute(rewards, ["split", "user_id"], len(self.names)))
        self.classifier.train(counted.select("split", "user_id", COUNTS).join(labels.select("split", "user_id", "label"), ["split", "user_id"]))
        return labels

    def evaluate(self, items: DataFrame, generate: Generator, load_path: str | None = None) -> DataFrame:
        if load_path is not None:
            self.classifier = TextClassifier.load(load_path)
        return self.answer(items.withColumn("text", render_history(F.col("conversation_history"))), generate)

    def answer(self, items: DataFrame, generate: Generator) -> DataFrame:
        """items: with the text of their history, or counted."""
        chosen = decode_label(F.col("prediction"), len(self.names))
        table = F.array(*[F.lit(n) for n in self.names])
        out = self.classifier.predict(items).withColumn("chosen", chosen)
        attribute = signed_name(F.element_at(table, F.col("chosen.ordinal") + 1), F.col("chosen.side"))
        return generate(out.withColumn("attribute", attribute).drop("chosen", "text"))
