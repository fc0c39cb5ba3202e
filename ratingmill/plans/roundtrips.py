"""Queries over readers and writers: tables are written in each form and read back, and must be as they were; and over the parts of
the engine that no query of the catalog shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingmill.functions.portable import draw, surrogate_score
from ratingmill.operators import conversations as conv
from ratingmill.operators import expand, factors, reward, scoring, synthetic
from ratingmill.plans.catalog import NAMES, NESTED, ORACLES, RATED, SCORED, SEED, N, h, nested, pair_scores, query, rated, scratch, table, values
from ratingmill.sources import corpus, sinks


@query(f"WITH {NESTED} SELECT conv_id::VARCHAR AS prompt_id, len(m)::INT AS messages, m[1].content AS prompt FROM c WHERE conv_id%2=1")
def corpus_by_split(spark, sf_dir):
    at = scratch(spark)
    df = corpus.nested(table(spark, sf_dir, "conversations")).withColumn("split", F.when(F.col("prompt_id").cast("long") % 2 == 0, "train").otherwise("test"))
    df.write.partitionBy("split").parquet(f"{at}/corpus")
    return corpus.corpus(spark, f"{at}/corpus", "test").select("prompt_id", F.size("messages").alias("messages"), "prompt")


@query(f"WITH {NESTED} SELECT count(*)::BIGINT AS n FROM c WHERE len(m)>=2 AND m[1].role='user' AND m[2].role='assistant'")
def no_limit(spark, sf_dir):
    """A limit of zero keeps all."""
    return corpus.conversations(corpus.nested(table(spark, sf_dir, "conversations")), limit=0).agg(F.count("*").alias("n"))


@query("SELECT (row_number() OVER (ORDER BY md5(c_custkey::VARCHAR||'|42'), c_custkey)-1)::INT AS persona_id, trim(c_mktsegment)||' '||trim(c_name) AS persona FROM customer QUALIFY persona_id<100")
def first_personas(spark, sf_dir):
    return corpus.personas(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"], "c_custkey", 100, SEED)


def users_of(spark, sf_dir):
    c = nested(spark, sf_dir).select(F.col("conv_id").cast("int").alias("user_idx"), F.array(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), "messages")).alias("conversations"))
    own = F.array(F.struct(F.lit("warm").alias("attribute"), F.when(F.col("user_idx") % 3 == 0, "avoid").otherwise("follow").alias("side")))
    return c.select("user_idx", own.alias("rewrite_style_attributes"), "conversations")


@query(f"WITH {NESTED} SELECT conv_id::INT AS user_idx, CASE WHEN conv_id%3=0 THEN 'avoid' ELSE 'follow' END AS side, len(m)::INT AS messages, m[1].content AS first FROM c")
def users_json_lines(spark, sf_dir):
    at = f"{scratch(spark)}/users"
    sinks.users_json(users_of(spark, sf_dir), at)
    m = F.col("conversations")[0]["messages"]
    return corpus.users_json(spark, at).select("user_idx", F.col("rewrite_style_attributes")[0]["side"].alias("side"), F.size(m).alias("messages"), m[0]["content"].alias("first"))


ITEMS = f"{NESTED}, s AS (SELECT conv_id, len(m) AS n, row_number() OVER (ORDER BY conv_id)-1 AS ord FROM c WHERE conv_id%2=1)"


def items_at(spark, sf_dir) -> str:
    at = f"{scratch(spark)}/items"
    users = users_of(spark, sf_dir).withColumn("split", F.when(F.col("user_idx") % 2 == 0, "train").otherwise("test"))
    sinks.split_dataset(synthetic.dataset(users), at)
    return at


def listed(df, name: str, order: str) -> list[str]:
    """A parameter list from a table; raises if it is longer than one may be."""
    rows = df.orderBy(order).select(name).limit(expand.MOST_PARAMETERS + 1).collect()
    if len(rows) > expand.MOST_PARAMETERS:
        raise ValueError("no parameter list")
    return [r[0] for r in rows]


@query(f"WITH {ITEMS} SELECT ord::BIGINT AS ord, conv_id::VARCHAR AS user_id, 1 AS attributes, 0 AS history, (n-1)::INT AS messages FROM s WHERE ord<20")
def labelled_split(spark, sf_dir):
    got = corpus.labelled_items(spark, items_at(spark, sf_dir), "test", limit=20)
    return got.select("ord", "user_id", F.size("user_attributes").alias("attributes"), F.size("conversation_history").alias("history"), F.size("current_messages").alias("messages"))


@query(f"WITH {ITEMS} SELECT ord::BIGINT AS ord, conv_id::VARCHAR AS user_id, 'ord,user_id,conversation_history,current_messages' AS columns FROM s WHERE ord IN (0, 3, (SELECT max(ord) FROM s))")
def items_by_place(spark, sf_dir):
    """Rows of a dataset without labels by ordinal, the last one by -1."""
    df = corpus.unlabelled(corpus.labelled_items(spark, items_at(spark, sf_dir), "test"))
    rows = [corpus.item(df, i) for i in (0, 3, -1)]
    return spark.createDataFrame([(r.ord, r.user_id, ",".join(df.columns)) for r in rows], "ord long, user_id string, columns string")


@query(f"WITH {SCORED} SELECT judge, pair, round(avg(x+y),4) AS mean_sum, CASE WHEN pair<>'warm/cold' THEN round(stddev_pop(x+y),4) END AS std_sum FROM w GROUP BY judge, pair")
def rounded_table(spark, sf_dir):
    """A table as CSV with four digits; what is missing is empty."""
    at = f"{scratch(spark)}/table"
    total = pair_scores(spark, sf_dir).groupBy("judge", "pair", "rep").agg(F.sum("score").alias("s")).groupBy("judge", "pair")
    out = total.agg(F.avg("s").alias("mean_sum"), F.stddev_pop("s").alias("std_sum"))
    sinks.rounded_csv(out.withColumn("std_sum", F.when(F.col("pair") != "warm/cold", F.col("std_sum"))), at)
    return spark.read.schema("judge string, pair string, mean_sum double, std_sum double").csv(at, header=True)


@query("SELECT doc_id::INT AS id, 1 AS prompt_id, lang AS attribute, 'follow' AS side, 'say \"x\", y' AS prompt, chr(13)||text||chr(92) AS response FROM documents")
def generated_table(spark, sf_dir):
    """Responses with quotes, commas, line ends of both kinds and backslashes as CSV."""
    at = f"{scratch(spark)}/generated"
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("int").alias("id"), F.lit(1).alias("prompt_id"), F.col("lang").alias("attribute"), F.lit("follow").alias("side"),
        F.lit('say "x", y').alias("prompt"), F.concat(F.lit("\r"), "text", F.lit("\\")).alias("response"),
    )
    sinks.plain_csv(rows, at)
    return corpus.generated_csv(spark, at)


@query(f"SELECT 'm1' AS model, 'plain' AS system_prompt, c_custkey::INT AS persona_id, c_name AS persona, item_id::INT AS prompt_id, text AS prompt, 'a, \"b\"' AS response, (1+{h('c_custkey', 'item_id')}%10)::INT AS score FROM benchmark CROSS JOIN customer")
def bias_table(spark, sf_dir):
    at = f"{scratch(spark)}/bias"
    df = expand.with_each_in_turn(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "benchmark"))
    sinks.bias_csv(df.select(
        F.lit("m1").alias("model"), F.lit("plain").alias("system_prompt"), F.col("c_custkey").cast("int").alias("persona_id"), F.col("c_name").alias("persona"),
        F.col("item_id").cast("int").alias("prompt_id"), F.col("text").alias("prompt"), F.lit('a, "b"').alias("response"), surrogate_score(F.col("c_custkey"), F.col("item_id")).cast("int").alias("score"),
    ), at, "gzip")
    return corpus.bias_csv(spark, at)


@query(f"WITH {RATED} SELECT attr_ord::INT AS attr_ord, attribute, count(score)::BIGINT AS n, sum(score) AS total FROM r GROUP BY ALL")
def rating_matrix(spark, sf_dir):
    """A rating matrix, missing scores and all, read back and checked against its list."""
    at = f"{scratch(spark)}/matrix"
    sinks.matrix(rated(spark, sf_dir).select("conv_ord", "attr_ord", "attribute", "score"), at)
    return corpus.ratings(spark, at, NAMES).groupBy("attr_ord", "attribute").agg(F.count("score").alias("n"), F.sum("score").alias("total"))


@query(f"WITH {SCORED} SELECT judge, count(*)::BIGINT*2 AS n, sum(x+y) AS total FROM w GROUP BY judge")
def judge_cubes(spark, sf_dir):
    """Cubes of all judges, a folder each; of an empty folder there is none."""
    at = scratch(spark)
    sinks.judge_scores(pair_scores(spark, sf_dir), f"{at}/some")
    pair_scores(spark, sf_dir).limit(0).write.parquet(f"{at}/none")
    if corpus.judge_scores(spark, f"{at}/none") is not None:
        raise ValueError("an empty folder has no cube")
    return corpus.judge_scores(spark, f"{at}/some").groupBy("judge").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("SELECT (row_number() OVER (PARTITION BY form ORDER BY p_type)-1)::INT AS ord, p_type AS attribute, form FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN (VALUES ('json'), ('list'), ('yaml')) f(form)")
def attribute_lists(spark, sf_dir):
    """A list of attributes, here the parts' types, as JSON, as YAML and as it is."""
    at = scratch(spark)
    own = corpus.attributes(spark, listed(table(spark, sf_dir, "part").select("p_type").distinct(), "p_type", "p_type"))
    sinks.attributes_json(own, f"{at}/json")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "attribute"))), lambda a: F.concat(F.lit("  - "), a["attribute"])), "\n")
    own.agg(F.concat(F.lit("# attributes\nattributes:\n"), lines).alias("value")).write.text(f"{at}/yaml")
    forms = {"json": corpus.attributes_json(spark, f"{at}/json"), "yaml": corpus.attributes_yaml(spark, f"{at}/yaml"), "list": own}
    out = None
    for form, df in forms.items():
        part = df.select("ord", "attribute", F.lit(form).alias("form"))
        out = part if out is None else out.unionByName(part)
    return out


CORRELATED = f"cm AS ({ORACLES['correlation_matrix']}), named AS (SELECT i, j, r, attribute FROM cm JOIN (VALUES {values(enumerate(NAMES))}) a(k, attribute) ON j=k)"


def loadings(spark, sf_dir):
    """Correlations in the place of loadings: a component for each attribute."""
    c = factors.correlations(factors.imputed(rated(spark, sf_dir))).select(F.lit(N).alias("k"), F.col("i").alias("comp"), F.col("j").alias("attr_ord"), F.round("r", 6).alias("loading"))
    return c.join(expand.attributes(spark, NAMES), "attr_ord").withColumns({"rank": F.col("comp") + 1, "ssl": F.lit(1.5)})


@query(f"WITH {CORRELATED} SELECT i AS comp, attribute, r AS loading, (row_number() OVER (PARTITION BY i ORDER BY abs(r) DESC, j))::INT AS place FROM named QUALIFY place<=5")
def top_loadings(spark, sf_dir):
    return factors.top_loadings(loadings(spark, sf_dir)).select("comp", "attribute", "loading", "place")


@query(f"WITH {CORRELATED}, t AS (SELECT i, attribute, r, row_number() OVER (PARTITION BY i ORDER BY abs(r) DESC, j) AS place FROM named) SELECT printf('RC%-3d %6.2f  %-24s %+.3f', (i+1)::INT, 1.5::DOUBLE, attribute, r) AS line FROM t WHERE place=2")
def component_report(spark, sf_dir):
    """A report of fixed width, a file of text."""
    at = f"{scratch(spark)}/report"
    sinks.report(factors.top_loadings(loadings(spark, sf_dir), 2).where("place = 2"), sinks.component_line(), [F.col("comp")], at)
    return spark.read.text(at).withColumnRenamed("value", "line")


@query(f"SELECT a AS attribute, k::INT AS comp FROM (VALUES {values(enumerate(NAMES))}) t(k, a)")
def representatives(spark, sf_dir):
    """Of correlations, each attribute represents itself; as YAML and read back."""
    at = f"{scratch(spark)}/yaml"
    spark.createDataFrame([(sinks.representatives_yaml(factors.representatives(loadings(spark, sf_dir))),)], "value string").write.text(at)
    return corpus.attributes_yaml(spark, at).select("attribute", F.col("ord").alias("comp"))


@query(f"WITH {CORRELATED} SELECT a.i, a.j, CASE WHEN a.i=a.j THEN 0.0 ELSE round(1-(abs(a.r)+abs(b.r))/2,4) END::DOUBLE AS distance FROM cm a JOIN cm b ON a.i=b.j AND a.j=b.i")
def attribute_distances(spark, sf_dir):
    d = factors.distances(factors.correlations(factors.imputed(rated(spark, sf_dir))).withColumn("r", F.round("r", 6)))
    return d.select("i", "j", F.round("distance", 4).alias("distance"))


def normal(tag: tuple[str, ...], *parts: str) -> str:
    """The portable normal draw of SQL expressions."""
    u, v = [f"(({h(*parts, chr(39) + t + chr(39))}+0.5)/4294967296.0)" for t in tag]
    return f"sqrt(-2*ln({u}))*cos(2*pi()*{v})"


FLAT = f"{RATED}, e AS (SELECT conv_ord, attr_ord, attribute, CASE WHEN attr_ord=0 THEN 5.0 ELSE score END AS score FROM f), s AS (SELECT attr_ord, avg(score) AS mu, stddev_pop(score) AS sd FROM e GROUP BY attr_ord)"


def with_flat(spark, sf_dir):
    return factors.imputed(rated(spark, sf_dir)).withColumn("score", F.when(F.col("attr_ord") == 0, 5.0).otherwise(F.col("score")))


@query(f"WITH {FLAT} SELECT conv_ord, attribute, round(CASE WHEN sd<=1e-10 THEN {normal(('a', 'b'), 'conv_ord', 'attr_ord', '42')} ELSE (score-mu)/sd END, 5)+0.0 AS z FROM e JOIN s USING (attr_ord)")
def noise_for_flat(spark, sf_dir):
    """An attribute without spread gets normal noise, so that it correlates with nothing."""
    return factors.standardised(with_flat(spark, sf_dir), noise=SEED).select("conv_ord", "attribute", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query(f"WITH {FLAT} SELECT attr_ord::INT AS attr_ord, sd<=1e-10 AS flat FROM s")
def flat_attributes(spark, sf_dir):
    return factors.attribute_stats(with_flat(spark, sf_dir)).select("attr_ord", "flat")


@query(f"SELECT i::INT AS i, j::INT AS j, round({normal(('a', 'b'), 'i', 'j', '7')}, 6)+0.0 AS w FROM (SELECT row_number() OVER ()-1 AS i FROM supplier) a CROSS JOIN (SELECT row_number() OVER ()-1 AS j FROM nation) b")
def dense_world(spark, sf_dir):
    """A world with as many user attributes as suppliers and as many response attributes as nations."""
    size = lambda name: table(spark, sf_dir, name).count()
    return reward.dense_world(spark, size("supplier"), size("nation"), 7).select("i", "j", (F.round("w", 6) + F.lit(0.0)).alias("w"))


@query("SELECT event_id::BIGINT AS n, floor(event_id*1.05::DOUBLE)::BIGINT AS oversampled, (event_id//6*6)::BIGINT AS even FROM events")
def whole_numbers(spark, sf_dir):
    n = F.col("n")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("n"))
    return rows.select("n", expand.oversampled(n).alias("oversampled"), expand.even_limit(n, 6).alias("even"))


@query("""WITH s AS (SELECT c_mktsegment AS split, floor(count(*)*1.05::DOUBLE)::BIGINT AS n FROM customer GROUP BY 1), o AS (SELECT split, n, (sum(n) OVER (ORDER BY split)-n)::BIGINT AS base FROM s)
SELECT split, i::INT AS user_idx, (base+i)::BIGINT AS user_ord, 3 AS attributes FROM (SELECT split, base, unnest(range(n)) AS i FROM o)""")
def users_by_split(spark, sf_dir):
    """More users of each split than wanted; a split for each of the customers' few segments, as many users as it has."""
    wanted = {r.c_mktsegment: r["count"] for r in table(spark, sf_dir, "customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()}
    made = synthetic.users(spark, wanted, NAMES, 3, SEED)
    return made.select("split", "user_idx", "user_ord", F.size("attributes").alias("attributes"))


@query(f"WITH {NESTED} SELECT conv_id, thinking, CASE WHEN thinking THEN 'You rate conversations. Think first, then answer with the rating.' ELSE 'You rate conversations. Answer with the rating only.' END AS system, 'Conversation:'||chr(10)||array_to_string(list_transform(m, lambda x: '<message role='''||x.role||'''>'||x.content||'</message>'||chr(10)), '')||chr(10)||'How warm is the user''s last message? Give a whole number from 1 to 10.'||chr(10) AS prompt FROM c CROSS JOIN (VALUES (true), (false)) t(thinking) WHERE m[-1].role='user'")
def prompt_judge_requests(spark, sf_dir):
    df = nested(spark, sf_dir).where(conv.ends_with_question(F.col("messages"))).withColumn("attribute", F.lit("warm"))
    ask = lambda t: scoring.prompt_requests(df, scoring.JudgeOptions(thinking=t)).select("conv_id", F.lit(t).alias("thinking"), "system", "prompt")
    return ask(True).unionByName(ask(False))


@query("SELECT * FROM (VALUES ('first', (SELECT count(*) FROM events WHERE event_id%2=0)::BIGINT), ('both', (SELECT count(*) FROM events)::BIGINT), ('after reset', (SELECT count(*) FROM events WHERE event_id%2=1)::BIGINT)) t(step, requests)")
def judge_request_counter(spark, sf_dir):
    """Users' requests are counted, not the ratings that their attributes ask for."""
    own = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("attribute", F.explode(F.array(F.lit("warm"), F.lit("terse")))).withColumn("side", F.lit("follow"))
    judge = reward.RewardJudge(own, scoring.surrogate_scorer("event_id", "attribute"), ["user_id"])
    events, said = table(spark, sf_dir, "events").select("user_id", "event_id"), []
    for step, odd in (("first", 0), ("both", 1)):
        judge.judge(events.where(F.col("event_id") % 2 == odd), ["event_id"])
        said.append((step, judge.statistics()["num_judge_requests"]))
    judge.reset()
    judge.judge(events.where(F.col("event_id") % 2 == 1), ["event_id"])
    return spark.createDataFrame([*said, ("after reset", judge.statistics()["num_judge_requests"])], "step string, requests long")


M, S = h("item_id"), h("item_id", "'s'")


@query(f"SELECT item_id, printf('%.2f ± %.2f', ({M}%1000)/8.0::DOUBLE, ({S}%1000)/16.0::DOUBLE) AS spread, printf('%.1f%%', ({M}%1000)/16.0::DOUBLE) AS share FROM benchmark")
def formatted(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumns({"m": draw(1000, F.col("item_id")) / 8.0, "s": draw(1000, F.col("item_id"), "s") / 16.0})
    return b.withColumn("p", F.col("m") / 200).select("item_id", sinks.mean_line("m", "s").alias("spread"), sinks.share_line("p").alias("share"))
