"""Queries over results that SQL can't make, held to what must be true of them: rotated loadings reproduce the correlations, spectra
keep trace and squares, models judge every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingmill.operators import factors
from ratingmill.operators.classify import TextClassifier
from ratingmill.plans import catalog
from ratingmill.plans.catalog import NAMES, NESTED, OK, ORACLES, N, embedded, query, rated, table

CORRELATED = f"cm AS ({ORACLES['correlation_matrix']})"


def close(c, name: str, digits: int = 4):
    """Rounded; no negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def rotated(spark, sf_dir):
    """All components of the ratings' correlations, rotated."""
    r, attributes = factors.matrix(factors.correlations(factors.imputed(rated(spark, sf_dir))))
    return factors.components(spark, r, dict(enumerate(NAMES)), attributes, [len(attributes)])


@query(f"WITH {CORRELATED} SELECT i, j, round(r,4)+0.0 AS r FROM cm")
def rotated_reproduce(spark, sf_dir):
    """The products of two attributes' rotated loadings over all components are their correlation."""
    c = rotated(spark, sf_dir)
    a, b = c.select("comp", F.col("attr_ord").alias("i"), F.col("loading").alias("x")), c.select("comp", F.col("attr_ord").alias("j"), F.col("loading").alias("y"))
    return a.join(b, "comp").groupBy("i", "j").agg(close(F.sum(F.col("x") * F.col("y")), "r"))


@query(f"WITH {CORRELATED} SELECT {N}::BIGINT AS components, {N}::BIGINT AS tops, round(sum(r*r) FILTER (i=j),4) AS communality, true AS ordered FROM cm")
def rotated_report(spark, sf_dir):
    """Rotated components by their squared loadings: ranks, tops and communalities fit together."""
    c = rotated(spark, sf_dir)
    tops = factors.top_loadings(c, 1).select("comp", F.abs("loading").alias("top"))
    by = c.groupBy("comp", "rank", "ssl").agg(F.sum(F.col("loading") ** 2).alias("own"), F.max(F.abs("loading")).alias("most")).join(tops, "comp")
    by = by.select("rank", "ssl", "own", (F.col("top") == F.col("most")).alias("fits"))
    higher = by.alias("a").join(by.alias("b"), F.expr("a.rank + 1 = b.rank"), "left").select("a.*", F.expr("coalesce(a.ssl >= b.ssl, true)").alias("falls"))
    return higher.agg(F.count("*").alias("components"), F.count_if("fits").alias("tops"), close(F.sum("own"), "communality"), (F.every(F.col("falls")) & F.every(F.abs(F.col("ssl") - F.col("own")) < 1e-9)).alias("ordered"))


VECTORS = "z AS (SELECT vec_id, i, (x-avg(x) OVER (PARTITION BY i))/stddev_pop(x) OVER (PARTITION BY i) AS z FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"
PAIRED = f"{VECTORS}, r AS (SELECT a.i, b.i AS j, CASE WHEN a.i=b.i THEN 1 ELSE sum(a.z*b.z)/(count(*)-1) END AS r FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i)"


@query(f"WITH {PAIRED} SELECT count(*) FILTER (i=j)::BIGINT AS ranks, round(sum(r) FILTER (i=j),4) AS trace, round(sum(r*r),4) AS squares, true AS thresholds_fall FROM r")
def spectrum_invariants(spark, sf_dir):
    """Eigenvalues of the embeddings' correlations and the thresholds of noise beside them."""
    t = catalog.parallel_analysis(spark, sf_dir)
    nxt = t.select((F.col("rank") - 1).alias("rank"), F.col("threshold").alias("next"))
    falls = F.every(F.coalesce(F.col("threshold") > F.col("next"), F.lit(True)))
    return t.join(nxt, "rank", "left").agg(F.count("*").alias("ranks"), close(F.sum("value"), "trace"), close(F.sum(F.col("value") ** 2), "squares"), falls.alias("thresholds_fall"))


@query(f"WITH {PAIRED} SELECT i::INT-1 AS attr_ord, round(sum(r),4)+0.0 AS total FROM r GROUP BY i")
def leading_components(spark, sf_dir):
    """Leading components by subspace iteration, as many as there are attributes: they give the correlations' row sums."""
    value, vector, attributes = factors.leading(factors.standardised(embedded(spark, sf_dir)), 64)
    total = vector @ (value * vector.sum(0))
    rows = spark.createDataFrame([(int(a), float(t)) for a, t in zip(attributes, total, strict=True)], "attr_ord int, total double")
    return rows.select("attr_ord", close(F.col("total"), "total"))


@query("SELECT CASE WHEN lang='en' THEN 1 ELSE 0 END::INT AS label, count(*)::BIGINT AS n, count(*)::BIGINT AS judged, true AS learned FROM documents GROUP BY 1")
def classifier_counts(spark, sf_dir):
    """Every document is judged; the classifier tells both labels of its own rows apart in nine of ten."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))
    out = TextClassifier().train(d).predict(d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction").isin(0, 1)).alias("judged"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"))
    return out.select("label", "n", "judged", (F.col("right") > 0.9).alias("learned"))


@query(f"WITH {OK}, {NESTED.replace('WITH ', '')} SELECT w::BIGINT AS world, count(*)::BIGINT AS n, 1.0::DOUBLE AS rates, round(avg(length('re: test '||conv_id||' ')),4) AS length_plain FROM ok CROSS JOIN range(2) r(w) WHERE conv_id%2=1 GROUP BY w")
def benchmark_counts(spark, sf_dir):
    """Worlds of the benchmark: users of the test split, rates that add up to one, and the length of answers without an attribute."""
    out = catalog.benchmark_worlds(spark, sf_dir)
    return out.select(F.col("world").cast("long").alias("world"), F.col("n").cast("long").alias("n"), F.round(F.col("win_rate") + F.col("tie_rate") + F.col("loss_rate"), 6).alias("rates"), F.round("length_plain", 4).alias("length_plain"))
