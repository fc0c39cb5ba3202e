"""Queries over parts of datasets: first rows of a windowed shuffle, rows by ordinal, matrices by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingmill.plans import roundtrips  # noqa: F401  (its SQL is used here)
from ratingmill.plans.catalog import NAMES, ORACLES, PAIRS, SCORED, SEED, pair_scores, query, rated, scratch, table
from ratingmill.sources import access, arrays

PARTS = "CASE WHEN c_custkey%3=0 THEN '' ELSE trim(c_mktsegment) END, CASE WHEN c_custkey%2=0 THEN NULL ELSE trim(c_name) END"


@query(f"""WITH c AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey)-1)//300 AS w, list_filter([{PARTS}], lambda x: x<>'') AS p FROM customer)
SELECT (row_number() OVER (ORDER BY w, md5(c_custkey::VARCHAR||'|{SEED}'), c_custkey::VARCHAR)-1)::INT AS persona_id, array_to_string(p, ' ') AS persona FROM c WHERE len(p)>0 QUALIFY persona_id<400""")
def streamed_personas(spark, sf_dir):
    """The first personas of a windowed shuffle; the scan ends when they are there."""
    at = f"{scratch(spark)}/personas"
    c = table(spark, sf_dir, "customer")
    parts = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("persona"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")).alias("hobbies"))
    parts.coalesce(1).sortWithinPartitions("c_custkey").write.option("maxRecordsPerFile", 200).parquet(at)
    return access.streamed_personas(spark, at, "c_custkey", 400, ["persona", "hobbies"], SEED, 300)


@query("""WITH o AS (SELECT c_custkey, c_name, (row_number() OVER (ORDER BY c_custkey)-1)::BIGINT AS ord FROM customer), n AS (SELECT count(*) AS n FROM o)
SELECT t.place, ord, c_custkey, c_name FROM (SELECT (c_custkey%17-8)::BIGINT AS place FROM customer GROUP BY 1) t CROSS JOIN n JOIN o ON ord=CASE WHEN place<0 THEN n+place ELSE place END""")
def indexed_items(spark, sf_dir):
    """Rows by ordinal through the index, counted from both ends."""
    at = f"{scratch(spark)}/indexed"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    access.write_indexed(c, [F.col("c_custkey")], at, 100)
    items = access.Indexed(spark, at)
    places = [r.place for r in c.select((F.col("c_custkey") % 17 - 8).alias("place")).distinct().collect()]  # 17 at most
    out = None
    for p in places:
        one = items.at(p).select(F.lit(p).cast("long").alias("place"), "ord", "c_custkey", "c_name")
        out = one if out is None else out.unionAll(one)
    return out


@query(ORACLES["rating_matrix"])
def rating_matrix_npy(spark, sf_dir):
    """A rating matrix as one npy file, NaN for what is missing, read back by byte ranges."""
    at = f"{scratch(spark)}/ratings.npy"
    arrays.ratings_npy(rated(spark, sf_dir), at)
    return arrays.read_ratings_npy(spark, at, NAMES).groupBy("attr_ord", "attribute").agg(F.count("score").alias("n"), F.sum("score").alias("total"))


@query(f"WITH {SCORED.replace('SELECT judge, pair,', 'SELECT judge, pair, ord,')} SELECT judge, pair, count(*)::BIGINT*2 AS n, sum(x) AS first, sum(y) AS second FROM w WHERE ord<(SELECT count(*)//{len(PAIRS)}*{len(PAIRS)} FROM o) GROUP BY judge, pair")
def judge_cubes_npz(spark, sf_dir):
    """Cubes of all judges, an npz archive each, of the repetitions that all pairs have; of an empty folder there is none."""
    at, scores = scratch(spark), pair_scores(spark, sf_dir)
    reps = scores.groupBy("judge", "pair").agg(F.max("rep").alias("last")).agg(F.min("last")).first()[0]
    arrays.cubes_npz(scores.where(F.col("rep") <= reps), f"{at}/some")
    got = arrays.read_cubes_npz(spark, f"{at}/some")
    of = lambda s: F.sum(F.when(F.col("slot") == s, F.col("score")))
    return got.groupBy("judge", "pair").agg(F.count("*").alias("n"), of(0).alias("first"), of(1).alias("second"))
