"""Queries over summaries: intervals of runs' means, and the lines that a report prints of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingmill.functions import stats
from ratingmill.functions.text import persona
from ratingmill.operators import expand, scoring
from ratingmill.plans.catalog import BIASED, T975, biased, h, query, r6, table

# the quantile of Student's t for many degrees of freedom: the normal one and four terms of Cornish and Fisher's expansion
Z = 1.959963984540054
TERMS = [(Z**3 + Z) / 4, (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96, (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384, (79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160]
WIDE = f"({Z!r}::DOUBLE" + "".join(f"+{c!r}::DOUBLE/power(rows-1,{i + 1})" for i, c in enumerate(TERMS)) + ")"


def interval(keys: str, of: str) -> str:
    return f"""SELECT {keys}, avg(score) AS mean, stddev_samp(score) AS sd, count(score) AS n, count(*) AS rows FROM {of} GROUP BY ALL"""


@query(f"""WITH {BIASED}, {T975}, g AS ({interval("model, system_prompt, 'all' AS taken", 'b')} UNION ALL {interval("model, system_prompt, 'scored' AS taken", '(SELECT * FROM b WHERE score IS NOT NULL)')})
SELECT model, system_prompt, taken, round(mean,6) AS mean, CASE WHEN n=rows AND rows>1 THEN round(coalesce(q, {WIDE})*sd/sqrt(rows),6) END AS ci95, n::BIGINT AS count FROM g LEFT JOIN t ON df=rows-1""")
def run_intervals(spark, sf_dir):
    """Mean, 95 % interval and count of each run, over all answers (a missing score leaves no interval) and over those with a score."""
    b = biased(spark, sf_dir)
    both = b.withColumn("taken", F.explode(F.when(F.col("score").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("scored")))))
    out = stats.mean_ci95(both, ["model", "system_prompt", "taken"], "score")
    return out.select("model", "system_prompt", "taken", r6("mean", "mean"), r6("ci95", "ci95"), "count")


SIDES = "p AS (SELECT c_custkey, trim(c_mktsegment)||' '||trim(c_name) AS persona FROM customer)"


@query(f"WITH {SIDES} SELECT c_custkey, 'You rate conversations. Answer with the rating only.' AS system, persona||chr(10)||'Rate the answer.' AS prompt, (1+{h(chr(39) + 'raw' + chr(39), 'c_custkey')}%10)::DOUBLE AS score FROM p")
def raw_prompts(spark, sf_dir):
    """Ratings of prompts that are already written: nothing is rendered and no conversation is asked for."""
    c = table(spark, sf_dir, "customer").select("c_custkey", persona(F.col("c_mktsegment"), F.col("c_name")).alias("persona"))
    asked = scoring.raw_requests(c, F.concat("persona", F.lit("\nRate the answer.")))
    return scoring.surrogate_scorer("kind", "c_custkey")(asked.withColumn("kind", F.lit("raw"))).select("c_custkey", "system", "prompt", "score")


@query("""WITH n AS (SELECT n_nationkey AS k, trim(n_name) AS name, lead(trim(n_name)) OVER (ORDER BY n_nationkey) AS partner FROM nation)
SELECT c.c_custkey, n.name AS a, p.name AS b FROM customer c JOIN n ON n.k=c.c_nationkey JOIN (SELECT DISTINCT trim(n_name) AS name FROM nation WHERE n_nationkey%3<>0) p ON p.name=n.partner""")
def known_pairs(spark, sf_dir):
    """Rows with the pair of their attribute; a pair is left out unless both of its names are listed."""
    nations = [(r.n_nationkey, r.n_name.strip()) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25
    pairs = [(a, b) for (_, a), (_, b) in zip(nations, nations[1:])]
    listed = [b for k, b in nations if k % 3 != 0]
    known = expand.known_pairs(spark, pairs, [a for _, a in nations], listed)
    c = table(spark, sf_dir, "customer").join(expand.parameters(spark, nations, "c_nationkey int, a string"), "c_nationkey")
    return c.join(known, "a").select("c_custkey", "a", "b")
