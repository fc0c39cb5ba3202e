"""Request tables: conversations crossed with small parameter tables, every row with a key of its own.

Parameter tables (attributes, sides, models, pairs) are as long as their lists in the configuration, whose length is checked before
they are broadcast; the large side is never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingmill.functions.portable import draw, order_key
from ratingmill.functions.text import AVOID, FOLLOW, signed_name

#: Rows of a parameter table.
MOST_PARAMETERS = 100_000
#: Bytes of its texts and lists.
MOST_BYTES = 64 << 20


def parameters(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    if len(rows) > MOST_PARAMETERS:
        raise ValueError(f"{len(rows)} rows are no parameter table")
    return F.broadcast(spark.createDataFrame(list(rows), ddl))


def _fits(df: DataFrame) -> bool:
    """Whether the rows are few and, where columns have no fixed width, their values few bytes as JSON."""
    wide = [c for c, t in df.dtypes if t in ("string", "binary") or t.startswith(("array", "map", "struct"))]
    if not wide:
        return True  # the limit of rows is one of bytes
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))
    found = df.limit(MOST_PARAMETERS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found.n <= MOST_PARAMETERS and found.bytes <= MOST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, made once and broadcast, if it proves to be no longer than a parameter table, in rows and in bytes; else as it is, for a join
    that shuffles."""
    if not _fits(df):
        return df
    rows = df.limit(MOST_PARAMETERS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= MOST_PARAMETERS else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all tasks: a small file is read by one, which would then make all that its rows are multiplied by."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def with_each(df: DataFrame, table: DataFrame) -> DataFrame:
    """Each row with each row of a parameter table, which is broadcast; raises if the table proves too large for that, as two sides that
    both grow have no plan but a Cartesian product. The rows are dealt out to all tasks before they are multiplied."""
    found = small(table)
    if found is table:
        raise ValueError(f"more than {MOST_PARAMETERS} rows or {MOST_BYTES} bytes are no parameter table")
    return spread(df).crossJoin(found)


def with_each_in_turn(df: DataFrame, table: DataFrame, rows: int = 250) -> DataFrame:
    """with_each, where a row of the table goes with up to `rows` rows of df before the next one does: what they share lies together."""
    own = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"))
    blocks = spread(own).groupBy(F.floor(F.monotonically_increasing_id() / rows).alias("__block")).agg(F.collect_list("__row").alias("__rows"))
    return with_each(blocks.select("__rows"), table).select(F.inline("__rows"), *table.columns)


def attributes(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return parameters(spark, list(enumerate(names)), "attr_ord int, attribute string")


def by_attribute(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each row with each attribute: (…, attr_ord, attribute)."""
    return df.crossJoin(attributes(df.sparkSession, names))


def by_signed_attribute(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each row with each attribute to follow and to avoid: (…, attr_ord, attribute, side, phrase)."""
    out = by_attribute(df, names).withColumn("side", F.explode(F.array(F.lit(FOLLOW), F.lit(AVOID))))
    return out.withColumn("phrase", signed_name(F.col("attribute"), F.col("side")))


def by_run(df: DataFrame, models: Sequence[str], system_prompts: Sequence[str]) -> DataFrame:
    """Each row with each model and system prompt, as two columns."""
    rows = [(m, s) for m in models for s in system_prompts]
    return df.crossJoin(parameters(df.sparkSession, rows, "model string, system_prompt string"))


def round_robin(df: DataFrame, ordinal: Column, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Row number ord goes with pair ord mod P, once for each pole: (…, pair_ord, pair, rep, slot, attribute)."""
    n = len(pairs)
    table = parameters(df.sparkSession, [(i, f"{a}/{b}", [a, b]) for i, (a, b) in enumerate(pairs)], "pair_ord int, pair string, poles array<string>")
    out = df.withColumns({"pair_ord": F.pmod(ordinal, F.lit(n)).cast("int"), "rep": F.floor(ordinal / n).cast("long")}).join(table, "pair_ord")
    return out.select("*", F.posexplode("poles").alias("slot", "attribute")).drop("poles")


def known_pairs(spark: SparkSession, pairs: Sequence[tuple[str, str]], first: Sequence[str], second: Sequence[str] | None = None) -> DataFrame:
    """(pair_ord, a, b) of the pairs whose names are both listed; pair_ord counts all pairs, so that leaving one out moves no other."""
    a, b = set(first), set(first if second is None else second)
    return parameters(spark, [(i, x, y) for i, (x, y) in enumerate(pairs) if x in a and y in b], "pair_ord int, a string, b string")


def even_limit(limit: int | Column, pairs: int) -> int | Column:
    """The largest multiple of the pairs' number within the limit."""
    return F.floor(limit / pairs).cast("long") * pairs if isinstance(limit, Column) else limit // pairs * pairs


def slots(users: DataFrame, user_ord: Column, per_user: int, sources: int, base: int = 0) -> DataFrame:
    """Each user with its slots: (…, slot, source_ord); the sources are dealt out in turn and the turn goes on over all splits."""
    out = users.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per_user - 1))))
    return out.withColumn("source_ord", F.pmod(F.lit(base) + user_ord.cast("long") * per_user + F.col("slot"), F.lit(sources)))


def sampled_attributes(users: DataFrame, keys: Sequence[str], names: Sequence[str], m: int, seed: int) -> DataFrame:
    """Users with m attributes drawn without replacement, each with a drawn side: attributes array<struct<attribute,side>>."""
    if m > len(names):
        raise ValueError("more attributes wanted than there are")
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    named = F.array(*[F.struct(order_key(key, n, seed).alias("o"), F.lit(n).alias("attribute")) for n in names])
    drawn = F.slice(F.array_sort(named), 1, m)
    side = lambda a: F.when(draw(2, key, a["attribute"], seed, "side") == 0, FOLLOW).otherwise(AVOID)
    return users.withColumn("attributes", F.transform(drawn, lambda a: F.struct(a["attribute"].alias("attribute"), side(a).alias("side"))))


def drawn_attribute(key: Column, names: Sequence[str], seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (draw(len(names), key, seed) + 1).cast("int"))


def oversampled(n: int | Column, factor: float = 1.05) -> int | Column:
    return F.floor(n * F.lit(factor)).cast("long") if isinstance(n, Column) else int(n * factor)


def join_attributes(requests: DataFrame, user_attributes: DataFrame, key: Sequence[str] = ("split", "user_id")) -> DataFrame:
    """Requests with the signed attributes of their user, a row each; a user without attributes raises."""
    out = requests.join(user_attributes, list(key), "left")
    unknown = F.raise_error(F.concat(F.lit("no attributes for user "), F.col(key[-1])))
    return out.withColumn("attribute", F.coalesce("attribute", unknown.cast("string")))
