"""Queries over the provided tables, an operator or a group of operators each, with the same rows as SQL.

Scores come from the surrogate scorer, so that both engines can make them; doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingmill import schema
from ratingmill.functions import logprobs, stats, text
from ratingmill.functions.portable import draw, portable_hash, surrogate_score
from ratingmill.operators import conversations as conv
from ratingmill.operators import expand, factors, reward, scoring, synthetic
from ratingmill.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PAIRS = schema.ANTONYMS
NAMES = [p for pair in PAIRS for p in pair]
JUDGES = ("judge_a", "judge_b")
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def h(*parts: str) -> str:
    """The portable hash of SQL expressions."""
    joined = "||'|'||".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x'||substr(md5({joined}),1,8))::BIGINT"


def score(*parts: str) -> str:
    return f"(1+{h(*parts)}%10)::DOUBLE"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OK = "ok AS (SELECT conv_id FROM conversations WHERE (turn=0 AND role='user') OR (turn=1 AND role='assistant') GROUP BY conv_id HAVING count(*)=2)"
ORD = f"{OK}, o AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id)-1)::BIGINT AS ord FROM ok)"
NESTED = "c AS (SELECT conv_id, list(struct_pack(role:=role, content:=text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"
ATTRS = f"attrs(attr_ord, attribute) AS (VALUES {values(enumerate(NAMES))})"
SCORED = f"""{ORD}, pairs(pair_ord, pair, a, b) AS (VALUES {values((i, f"{a}/{b}", a, b) for i, (a, b) in enumerate(PAIRS))}), judges(judge) AS (VALUES {values((j,) for j in JUDGES)}),
w AS (SELECT judge, pair, {score('conv_id', 'a', 'judge')} AS x, {score('conv_id', 'b', 'judge')} AS y FROM o JOIN pairs ON ord % {len(PAIRS)} = pair_ord CROSS JOIN judges)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.nest(table(spark, sf_dir, "conversations"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(judge, pair_ord, pair, rep, slot, score): a conversation is rated by both poles of its pair."""
    ok = conv.flat_opens_well(table(spark, sf_dir, "conversations"))
    dealt = expand.round_robin(conv.numbered(ok, [F.col("conv_id")], "ord"), F.col("ord"), PAIRS)
    return scoring.by_judge(dealt, {j: scoring.surrogate_scorer("conv_id", "attribute", "judge") for j in JUDGES}).select("judge", "pair_ord", "pair", "rep", "slot", "score")


def both_slots(scores: DataFrame) -> DataFrame:
    of = lambda s: F.max(F.when(F.col("slot") == s, F.col("score")))
    return scores.groupBy("judge", "pair", "rep").agg(of(0).alias("x"), of(1).alias("y"))


def balance(wide: DataFrame) -> DataFrame:
    total, overall = F.col("x") + F.col("y"), F.grouping("pair") == 1
    out = wide.groupingSets([["judge", "pair"], ["judge"]], "judge", "pair").agg(
        F.grouping("pair").alias("all_pairs"), F.count("*").alias("n"), F.avg(total).alias("mean_sum"), F.stddev_pop(total).alias("std_sum"),
        F.avg(F.abs(total - 11)).alias("mean_l1_from_11"), F.when(~overall, stats.pearson(F.col("x"), F.col("y"))).alias("corr"),
    )
    return out.withColumn("pair", F.when(F.col("all_pairs") == 1, "overall").otherwise(F.col("pair"))).drop("all_pairs")


BALANCE = """count(*)::BIGINT AS n, round(avg(x+y),6) AS mean_sum, round(stddev_pop(x+y),6) AS std_sum, round(avg(abs(x+y-11)),6) AS mean_l1_from_11"""
CORR = "CASE WHEN stddev_pop(x)*stddev_pop(y)>0 AND count(*)>1 THEN round(covar_pop(x,y)/(stddev_pop(x)*stddev_pop(y)),6) END"


@query(f"WITH {SCORED} SELECT judge, pair, {BALANCE}, {CORR} AS corr FROM w GROUP BY judge, pair UNION ALL SELECT judge, 'overall', {BALANCE}, NULL FROM w GROUP BY judge")
def judge_balance(spark, sf_dir):
    out = balance(both_slots(pair_scores(spark, sf_dir)))
    return out.select("judge", "pair", "n", *[r6(c, c) for c in ("mean_sum", "std_sum", "mean_l1_from_11", "corr")])


# Student's t: with t = tan(a) * sqrt(df), its density is that of cos(a) ** (df - 1); both integrals by Simpson's rule
SIMPSON = "list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN k=0 OR k=4000 THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END * pow(cos({top}*k/4000), n-3)))*{top}"


@query(f"""WITH {SCORED}, c AS (SELECT judge, pair, count(*)::BIGINT AS n, CASE WHEN stddev_pop(x)*stddev_pop(y)>0 AND count(*)>1 THEN covar_pop(x,y)/(stddev_pop(x)*stddev_pop(y)) END AS r FROM w GROUP BY judge, pair),
a AS (SELECT *, CASE WHEN n>2 AND abs(r)<1 THEN atan(abs(r)/sqrt(1-r*r)) END AS alpha FROM c)
SELECT judge, pair, n, round(r,6) AS corr, CASE WHEN r IS NULL THEN NULL WHEN n=2 THEN 1.0 WHEN abs(r)>=1 THEN 0.0 ELSE round(1-({SIMPSON.format(top='alpha')})/({SIMPSON.format(top='(pi()/2)')}),6) END::DOUBLE AS pval FROM a""")
def judge_correlation_pvalues(spark, sf_dir):
    out = balance(both_slots(pair_scores(spark, sf_dir))).where("pair <> 'overall'")
    return out.select("judge", "pair", "n", r6("corr", "corr"), r6(stats.p_value(F.col("corr"), F.col("n")), "pval"))


@query(f"WITH {SCORED} SELECT judge, round(avg(abs(x+y-11)),6) AS mean_l1, row_number() OVER (ORDER BY round(avg(abs(x+y-11)),6) DESC, judge)::BIGINT AS place FROM w GROUP BY judge")
def judge_ranking(spark, sf_dir):
    rows = balance(both_slots(pair_scores(spark, sf_dir))).where("pair = 'overall'").select("judge", r6("mean_l1_from_11", "mean_l1"))
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_l1"), "judge")).cast("long"))  # a row for each judge


@query(f"""WITH {SCORED}, v AS (SELECT judge, pair, x+y AS s FROM w WHERE x+y BETWEEN -0.5 AND 20.5), g AS (SELECT judge, pair, least(floor(s+0.5), 20)::INT AS bin, count(*)::BIGINT AS n FROM v GROUP BY ALL)
SELECT judge, pair, bin, n, round(100.0*n/sum(n) OVER (PARTITION BY judge, pair),6) AS percent, (max(n) OVER ())::BIGINT AS most FROM g""")
def sum_histogram(spark, sf_dir):
    wide = both_slots(pair_scores(spark, sf_dir)).withColumn("s", F.col("x") + F.col("y"))
    bins = stats.histogram(wide, ["judge", "pair"], "s", -0.5, 20.5, 21)
    most = bins.agg(F.max("count").alias("most"))
    return bins.crossJoin(F.broadcast(most)).select("judge", "pair", "bin", F.col("count").alias("n"), r6(F.col("share") * 100, "percent"), "most")


@query(f"WITH {NESTED} SELECT conv_id, len(m)::INT AS messages, m[1].content AS prompt, m[2].content AS response FROM c WHERE len(m)>=2 AND m[1].role='user' AND m[2].role='assistant'")
def conversation_filter(spark, sf_dir):
    m = F.col("messages")
    kept = nested(spark, sf_dir).where(conv.opens_well(m))
    return kept.select("conv_id", F.size(m).alias("messages"), F.get(m, F.lit(0))["content"].alias("prompt"), F.get(m, F.lit(1))["content"].alias("response"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id::VARCHAR LIKE '1%' OR conv_id::VARCHAR LIKE '2%'")
def prefix_filter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.where(text.any_prefix(F.col("conv_id").cast("string"), ["1", "2"])).select("conv_id", "turn", "role")


@query(f"WITH {NESTED} SELECT conv_id::VARCHAR AS prompt_id, m[1].content AS prompt FROM c ORDER BY md5(conv_id::VARCHAR||'|42'), conv_id::VARCHAR LIMIT 10")
def seeded_prompts(spark, sf_dir):
    return corpus.prompts(corpus.nested(table(spark, sf_dir, "conversations")), limit=10, seed=SEED)


@query(f"WITH {NESTED} SELECT conv_id::VARCHAR AS prompt_id, m[1].content AS prompt, m[2].content AS response FROM c WHERE len(m)>=2 AND m[1].role='user' AND m[2].role='assistant' ORDER BY md5(conv_id::VARCHAR||'|42'), conv_id::VARCHAR LIMIT 12")
def seeded_pairs(spark, sf_dir):
    return corpus.prompt_response_pairs(corpus.nested(table(spark, sf_dir, "conversations")), limit=12, seed=SEED)


@query(f"WITH {NESTED} SELECT conv_id::VARCHAR AS prompt_id, len(m)::INT AS messages FROM c WHERE len(m)>=2 AND m[1].role='user' AND m[2].role='assistant' AND (conv_id::VARCHAR LIKE '3%' OR conv_id::VARCHAR LIKE '4%')")
def conversations_with_ids(spark, sf_dir):
    out = corpus.conversations(corpus.nested(table(spark, sf_dir, "conversations")), ["3", "4"], limit=0)
    return out.select("prompt_id", F.size("messages").alias("messages"))


@query(f"WITH {NESTED}, k AS (SELECT *, len(m)//2 AS half FROM c) SELECT conv_id, CASE WHEN half<1 THEN 0 ELSE 2*(1+{h('conv_id', '42')}%greatest(half,1)) END::INT AS messages, CASE WHEN half<1 THEN 0 ELSE 2*(1+{h('conv_id', '42')}%greatest(half,1))-1 END::INT AS to_user FROM k")
def random_truncation(spark, sf_dir):
    cut = lambda u: F.size(conv.random_truncation(F.col("messages"), F.col("conv_id"), SEED, u))
    return nested(spark, sf_dir).select("conv_id", cut(False).alias("messages"), cut(True).alias("to_user"))


@query(f"WITH {OK}, {ATTRS} SELECT conv_id, attr_ord::INT AS attr_ord, attribute, {score('conv_id', 'attribute')} AS score FROM ok CROSS JOIN attrs")
def cross_attributes(spark, sf_dir):
    ok = conv.flat_opens_well(table(spark, sf_dir, "conversations"))
    return scoring.surrogate_scorer("conv_id", "attribute")(expand.by_attribute(ok, NAMES))


@query(f"WITH {ATTRS} SELECT item_id, attribute, side, CASE side WHEN 'avoid' THEN 'not '||attribute ELSE attribute END AS phrase FROM benchmark CROSS JOIN attrs CROSS JOIN (VALUES ('follow'),('avoid')) s(side)")
def signed_cross(spark, sf_dir):
    return expand.by_signed_attribute(table(spark, sf_dir, "benchmark").select("item_id"), NAMES).select("item_id", "attribute", "side", "phrase")


@query("SELECT item_id, model, system_prompt FROM benchmark CROSS JOIN (VALUES ('m1'),('m2')) m(model) CROSS JOIN (VALUES ('plain'),('kind')) s(system_prompt)")
def run_cross(spark, sf_dir):
    return expand.by_run(table(spark, sf_dir, "benchmark").select("item_id"), ["m1", "m2"], ["plain", "kind"])


@query(f"WITH {ORD}, pairs(pair_ord, pair, a, b) AS (VALUES {values((i, f'{a}/{b}', a, b) for i, (a, b) in enumerate(PAIRS))}) SELECT conv_id, pair_ord::INT AS pair_ord, replace(pair,'/','_') AS pair, (ord//{len(PAIRS)})::BIGINT AS rep, slot::INT AS slot, CASE slot WHEN 0 THEN a ELSE b END AS attribute FROM o JOIN pairs ON ord%{len(PAIRS)}=pair_ord CROSS JOIN (VALUES (0),(1)) s(slot)")
def round_robin_pairs(spark, sf_dir):
    ok = conv.numbered(conv.flat_opens_well(table(spark, sf_dir, "conversations")), [F.col("conv_id")], "ord")
    out = expand.round_robin(ok, F.col("ord"), PAIRS)
    return out.select("conv_id", "pair_ord", text.file_safe(F.col("pair")).alias("pair"), "rep", "slot", "attribute")


@query("SELECT conv_id, turn, len(list(text) OVER w)::INT AS before, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)".replace("len(list(text) OVER w)", "coalesce(count(*) OVER w, 0)"))
def prefix_context(spark, sf_dir):
    out = conv.prefix_context(table(spark, sf_dir, "conversations"))
    chars = F.aggregate(F.transform("context", F.length), F.lit(0), lambda a, x: a + x).cast("long")
    return out.select("conv_id", "turn", F.size("context").alias("before"), chars.alias("chars"))


@query(f"WITH {NESTED}, t AS (SELECT conv_id, m, unnest(range(0, len(m), 2)) AS i FROM c) SELECT conv_id, i::INT AS turn, m[i+1].role AS role, m[i+1].content AS content, i::INT AS context FROM t")
def user_turns(spark, sf_dir):
    return conv.user_turns(nested(spark, sf_dir), ["conv_id"]).withColumn("context", F.size("context"))


@query(f"WITH {NESTED} SELECT conv_id, array_to_string(list_transform(m, lambda x: '<message role='''||x.role||'''>'||x.content||'</message>'||chr(10)), '') AS rendered, array_to_string(list_transform(m, lambda x: '<message role='''||x.role||'''>'||x.content||'</message>'), chr(10)) AS joined FROM c")
def render_messages(spark, sf_dir):
    m = F.col("messages")
    return nested(spark, sf_dir).select("conv_id", text.render_messages(m).alias("rendered"), text.join_messages(m).alias("joined"))


ANSWERS = ["8", "Rating: 8/10", "10/10", "7.5", "100", "0", "", "11 then 3", "score: ten", "-3", "7th", "9\n", "I would say 6 or 7.", "1_0", "4 out of 5 stars"]


@query(f"WITH a(k, answer) AS (VALUES {values(enumerate(ANSWERS))}), q AS (SELECT item_id, replace(answer, '8', (1+item_id%10)::VARCHAR) AS answer FROM benchmark JOIN a ON item_id%{len(ANSWERS)}=k) SELECT item_id, answer, regexp_extract_all(answer, '\\b(10|[1-9])\\b', 1)[-1]::INT AS rating FROM q".replace("\n'", "'||chr(10)"))
def parse_rating(spark, sf_dir):
    a = expand.parameters(spark, list(enumerate(ANSWERS)), "k int, answer string")
    q = table(spark, sf_dir, "benchmark").withColumn("k", F.pmod("item_id", F.lit(len(ANSWERS))).cast("int")).join(a, "k")
    answer = F.replace(F.col("answer"), F.lit("8"), (1 + F.pmod("item_id", F.lit(10))).cast("string"))
    return q.select("item_id", answer.alias("answer")).withColumn("rating", text.parse_rating(F.col("answer")))


@query("""WITH r AS (SELECT item_id, CASE item_id%3 WHEN 0 THEN '<think> '||text||' </think> ok '||item_id WHEN 1 THEN 'analysis'||text||' assistantfinal yes '||item_id ELSE '  '||text END AS raw FROM benchmark),
p AS (SELECT *, strpos(raw,'assistantfinal') AS f, strpos(raw,'<think>') AS a, strpos(raw,'</think>') AS b FROM r)
SELECT item_id, CASE WHEN f>0 THEN trim(substr(raw,9,greatest(f-9,0)), E' \\n\\t') WHEN a>0 AND b>a THEN trim(substr(raw,a+7,b-a-7), E' \\n\\t') END AS reasoning, CASE WHEN f>0 THEN trim(substr(raw,f+14), E' \\n\\t') WHEN a>0 AND b>a THEN trim(substr(raw,b+8), E' \\n\\t') ELSE raw END AS content FROM p""")
def split_reasoning(spark, sf_dir):
    k, t, i = F.pmod("item_id", F.lit(3)), F.col("text"), F.col("item_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("<think> "), t, F.lit(" </think> ok "), i)).when(k == 1, F.concat(F.lit("analysis"), t, F.lit(" assistantfinal yes "), i)).otherwise(F.concat(F.lit("  "), t))
    return table(spark, sf_dir, "benchmark").select("item_id", text.split_reasoning(raw).alias("p")).select("item_id", "p.reasoning", "p.content")


DRAWN = f"""{ATTRS}, drawn AS (SELECT user_id, attribute, md5(user_id||'|'||attribute||'|42') AS o FROM u CROSS JOIN attrs),
picked AS (SELECT user_id, attribute, o, row_number() OVER (PARTITION BY user_id ORDER BY o, attribute) AS place, CASE {h('user_id', 'attribute', '42', "'side'")}%2 WHEN 0 THEN 'follow' ELSE 'avoid' END AS side FROM drawn QUALIFY place<=3)"""
USERS = "u AS (SELECT DISTINCT user_id FROM events)"


def user_attributes(spark, sf_dir) -> DataFrame:
    """(user_id, attributes): three signed attributes for each user of events."""
    return expand.sampled_attributes(table(spark, sf_dir, "events").select("user_id").distinct(), ["user_id"], NAMES, 3, SEED)


@query(f"WITH {USERS}, {DRAWN} SELECT user_id, concat_ws(chr(10), CASE WHEN count(*) FILTER (side='follow')>0 THEN 'VERY: '||string_agg(attribute, ', ' ORDER BY place) FILTER (side='follow') END, CASE WHEN count(*) FILTER (side='avoid')>0 THEN 'NOT AT ALL: '||string_agg(attribute, ', ' ORDER BY place) FILTER (side='avoid') END) AS style FROM picked GROUP BY user_id")
def style_phrase(spark, sf_dir):
    return user_attributes(spark, sf_dir).select("user_id", text.style_phrase(F.col("attributes")).alias("style"))


@query(f"WITH {USERS}, {DRAWN} SELECT e.event_id, e.user_id, round(avg(CASE side WHEN 'avoid' THEN -1 ELSE 1 END * {score('event_id', 'attribute')}),6) AS reward, 0::BIGINT AS missing FROM events e JOIN picked p ON e.user_id=p.user_id GROUP BY e.event_id, e.user_id")
def signed_reward(spark, sf_dir):
    signed = user_attributes(spark, sf_dir).select("user_id", F.explode("attributes").alias("a")).select("user_id", "a.attribute", "a.side")
    requests = table(spark, sf_dir, "events").select("event_id", "user_id")
    out = reward.judge_users(requests, signed, scoring.surrogate_scorer("event_id", "attribute"), ["event_id"], ["user_id"])
    return out.select("event_id", "user_id", r6("reward", "reward"), "missing")


@query(f"WITH x AS (SELECT c_custkey, {score('c_custkey', chr(39) + 'a' + chr(39))} AS a, {score('c_custkey', chr(39) + 'b' + chr(39))} AS b FROM customer) SELECT round(avg((a>b)::INT),6) AS win_rate, round(avg((a=b)::INT),6) AS tie_rate, round(1-avg((a>b)::INT)-avg((a=b)::INT),6) AS loss_rate, round(avg(a),6) AS mean_personalised, round(stddev_samp(a),6) AS std_personalised, round(avg(b),6) AS mean_plain, round(stddev_samp(b),6) AS std_plain, count(*)::BIGINT AS n FROM x")
def win_tie_loss(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    of = lambda tag: c.withColumn("reward", surrogate_score(F.col("c_custkey"), tag))
    out = reward.compare(of("a"), of("b"), ["c_custkey"])
    return out.select(*[r6(x, x) for x in out.columns if x != "n"], "n")


@query(f"""WITH {ATTRS}, x AS (SELECT item_id, attr_ord, {score('item_id', 'attribute')} - 5.5 AS v FROM benchmark CROSS JOIN attrs), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(v) DESC, attr_ord) AS k FROM x)
SELECT item_id, attr_ord::INT AS attr_ord, v AS reward, (attr_ord + CASE WHEN v>=0 THEN {len(NAMES)} ELSE 0 END)::INT AS label, CASE WHEN v>=0 THEN 'follow' ELSE 'avoid' END AS side, attr_ord::INT AS decoded FROM b WHERE k=1""")
def label_encode_decode(spark, sf_dir):
    df = expand.by_attribute(table(spark, sf_dir, "benchmark").select("item_id"), NAMES)
    df = df.select("item_id", "attr_ord", (surrogate_score(F.col("item_id"), F.col("attribute")) - 5.5).alias("reward"))
    out = reward.best_attribute(df, ["item_id"], len(NAMES))
    return out.withColumn("decoded", text.decode_label(F.col("label"), len(NAMES))["ordinal"])


N = len(NAMES)
WORLD = f"""world AS (SELECT i, (row_number() OVER (ORDER BY md5(i||'|42'))-1)::INT AS j, CASE {h('i', '42', "'sign'")}%2 WHEN 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS w FROM range({N}) r(i))"""


@query(f"WITH {USERS}, {DRAWN}, {WORLD} SELECT user_id, j::INT AS j, sum(w*CASE side WHEN 'follow' THEN 1 ELSE -1 END)::DOUBLE AS value FROM picked JOIN attrs USING (attribute) JOIN world ON attr_ord=i GROUP BY ALL")
def world_apply(spark, sf_dir):
    names = expand.attributes(spark, NAMES).withColumnRenamed("attr_ord", "i")
    own = user_attributes(spark, sf_dir).select("user_id", F.explode("attributes").alias("a")).select("user_id", "a.attribute", "a.side").join(names, "attribute")
    return reward.apply_world(own, reward.permutation_world(spark, N, N, SEED), ["user_id"])


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE*((i-1)%5-2))), 5)+0.0 AS u, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE*((i-1)%3-1))), 5)+0.0 AS v FROM embeddings")
def matrix_vector(spark, sf_dir):
    rows = [[float(i % 5 - 2) for i in range(64)], [float(i % 3 - 1) for i in range(64)]]
    m = F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])
    out = table(spark, sf_dir, "embeddings").select("vec_id", reward.apply_matrix(m, F.col("embedding").cast("array<double>")).alias("y"))
    return out.select("vec_id", *[(F.round(F.get("y", F.lit(i)), 5) + F.lit(0.0)).alias(n) for i, n in enumerate("uv")])


VECTOR = f"{ATTRS}, x AS (SELECT item_id, attr_ord AS j, ({h('item_id', 'attribute')}%7-3)::DOUBLE AS v FROM benchmark CROSS JOIN attrs)"


@query(f"WITH {VECTOR} SELECT item_id, j::INT AS j, CASE WHEN v>0 THEN 'follow' ELSE 'avoid' END AS side, 0::INT AS rank FROM x WHERE v<>0 UNION ALL SELECT item_id, j::INT, CASE WHEN v>0 THEN 'follow' ELSE 'avoid' END, (row_number() OVER (PARTITION BY item_id ORDER BY abs(v) DESC, j))::INT AS rank FROM x QUALIFY rank<=4")
def topm_attributes(spark, sf_dir):
    df = expand.by_attribute(table(spark, sf_dir, "benchmark").select("item_id"), NAMES)
    vector = df.select("item_id", F.col("attr_ord").alias("j"), (draw(7, F.col("item_id"), F.col("attribute")) - 3).cast("double").alias("value"))
    free = reward.attributes_of(vector, ["item_id"]).withColumn("rank", F.lit(0))
    return free.unionByName(reward.attributes_of(vector, ["item_id"], 4))


RATED = f"""{ATTRS}, r AS (SELECT doc_id AS conv_ord, attr_ord, attribute, CASE WHEN {h('doc_id', 'attribute', "'gone'")}%9=0 THEN NULL ELSE (1+{h('doc_id', 'attribute')}%(CASE WHEN attr_ord%4=3 THEN 2 ELSE 10 END))::DOUBLE END AS score FROM documents CROSS JOIN attrs),
f AS (SELECT conv_ord, attr_ord, attribute, coalesce(score, avg(score) OVER (PARTITION BY attr_ord)) AS score FROM r)"""


def rated(spark, sf_dir) -> DataFrame:
    """A rating matrix with gaps: documents by attributes, every fourth attribute with two values only."""
    df = expand.by_attribute(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_ord")), NAMES)
    key = (F.col("conv_ord"), F.col("attribute"))
    drawn = 1 + F.when(F.col("attr_ord") % 4 == 3, draw(2, *key)).otherwise(draw(10, *key))
    return df.withColumn("score", F.when(draw(9, *key, "gone") != 0, drawn.cast("double")))


@query(f"WITH {RATED} SELECT conv_ord, attribute, round(score,6) AS score FROM f")
def mean_impute(spark, sf_dir):
    return factors.imputed(rated(spark, sf_dir)).select("conv_ord", "attribute", r6("score", "score"))


ENTROPY = "e AS (SELECT attr_ord, -sum(p*log2(p+1e-12)) AS entropy FROM (SELECT attr_ord, count(*)*1.0/sum(count(*)) OVER (PARTITION BY attr_ord) AS p FROM f GROUP BY attr_ord, round_even(score,0)) GROUP BY attr_ord)"


@query(f"WITH {RATED}, {ENTROPY} SELECT attribute, attr_ord::INT AS attr_ord, count(*)::BIGINT AS n, round(avg(score),6) AS mean, round(stddev_pop(score),6) AS std, round(any_value(entropy),6) AS entropy, (any_value(entropy)>=1.5) AS kept FROM f JOIN e USING (attr_ord) GROUP BY attribute, attr_ord")
def entropy_filter(spark, sf_dir):
    full = factors.imputed(rated(spark, sf_dir))
    s = factors.attribute_stats(full)
    return s.select("attribute", "attr_ord", "n", r6("mean", "mean"), r6("std", "std"), r6("entropy", "entropy"), (F.col("entropy") >= 1.5).alias("kept"))


@query(f"WITH {RATED}, {ENTROPY} SELECT attribute FROM e JOIN attrs USING (attr_ord) WHERE entropy<1.5")
def removed_attributes(spark, sf_dir):
    return factors.informative(factors.imputed(rated(spark, sf_dir)))[1].select("attribute")


@query(f"WITH {RATED}, s AS (SELECT attr_ord, avg(score) AS mu, stddev_pop(score) AS sd FROM f GROUP BY attr_ord) SELECT conv_ord, attribute, round((score-mu)/CASE WHEN sd>1e-10 THEN sd ELSE 1 END,5)+0.0 AS z FROM f JOIN s USING (attr_ord)")
def zscore(spark, sf_dir):
    return factors.standardised(factors.imputed(rated(spark, sf_dir))).select("conv_ord", "attribute", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query(f"WITH {RATED}, s AS (SELECT attr_ord, avg(score) AS mu, stddev_pop(score) AS sd FROM f GROUP BY attr_ord), z AS (SELECT conv_ord, attr_ord, (score-mu)/sd AS z FROM f JOIN s USING (attr_ord)) SELECT a.attr_ord::INT AS i, b.attr_ord::INT AS j, CASE WHEN a.attr_ord=b.attr_ord THEN 1.0 ELSE round(sum(a.z*b.z)/(count(*)-1),6) END::DOUBLE AS r FROM z a JOIN z b USING (conv_ord) GROUP BY a.attr_ord, b.attr_ord")
def correlation_matrix(spark, sf_dir):
    return factors.correlations(factors.imputed(rated(spark, sf_dir))).select("i", "j", r6("r", "r"))


@query(f"WITH {RATED}, p(pair_ord, a, b) AS (VALUES {values((i, a, b) for i, (a, b) in enumerate(PAIRS))}), w AS (SELECT pair_ord, p.a, p.b, x.score AS x, y.score AS y FROM p JOIN f x ON x.attribute=p.a JOIN f y ON y.attribute=p.b AND x.conv_ord=y.conv_ord) SELECT pair_ord::INT AS pair_ord, a, b, {CORR} AS corr, round(avg(x),6) AS mean_a, round(stddev_pop(x),6) AS std_a, round(avg(y),6) AS mean_b, round(stddev_pop(y),6) AS std_b, round(avg(x+y),6) AS mean_sum, round(stddev_pop(x+y),6) AS std_sum, round(min(x+y),6) AS min_sum, round(max(x+y),6) AS max_sum FROM w GROUP BY pair_ord, a, b")
def antonym_correlation(spark, sf_dir):
    out = factors.antonyms(factors.imputed(rated(spark, sf_dir)), [*PAIRS, ("warm", "unrated")])
    return out.select("pair_ord", "a", "b", *[r6(c, c) for c in ("corr", "mean_a", "std_a", "mean_b", "std_b", "mean_sum", "std_sum", "min_sum", "max_sum")])


@query(f"WITH {RATED}, g AS (SELECT attribute, least(floor(score-0.5),9)::INT AS bin, count(*)::BIGINT AS n FROM r WHERE score BETWEEN 0.5 AND 10.5 GROUP BY ALL) SELECT attribute, bin, n, round(n*1.0/sum(n) OVER (PARTITION BY attribute),6) AS share FROM g")
def score_histogram(spark, sf_dir):
    return stats.histogram(rated(spark, sf_dir), ["attribute"], "score", 0.5, 10.5, 10).select("attribute", "bin", F.col("count").alias("n"), r6("share", "share"))


SPECTRUM = "v AS (SELECT i, var_pop(x) AS value FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i), s AS (SELECT value, row_number() OVER (ORDER BY value DESC)-1 AS rank FROM v)"


@query(f"WITH {SPECTRUM} SELECT rank::INT AS rank, round(value,6) AS value, round(sum(value) OVER (ORDER BY rank)/sum(value) OVER (),6)::DOUBLE AS explained FROM s")
def explained_variance(spark, sf_dir):
    """The variances of the embeddings' components, the largest first, and the share that they explain."""
    s = factors.spreads(embedded(spark, sf_dir)).select((F.col("std") ** 2).alias("value"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"))) - 1)  # a row for each component
    return s.select("rank", r6("value", "value"), r6(factors.explained(F.col("value"), F.col("rank")), "explained"))


JUDGED = f"""{ATTRS}, x AS (SELECT item_id, attribute AS response_attr, attrs.attr_ord, {h('item_id', "'42'")}%{N} AS gt, {score('item_id', 'attribute')} AS score FROM benchmark CROSS JOIN attrs),
y AS (SELECT item_id, max(score) FILTER (attr_ord=gt) AS own, max(score) AS top, avg(score) AS mean, count(*) FILTER (score=t) AS tops FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS t FROM x) GROUP BY item_id)"""


@query(f"WITH {JUDGED} SELECT round(avg((own=top)::INT),6) AS accuracy, round(avg((own=top AND tops=1)::INT),6) AS strict_accuracy, round(avg(own-mean),6) AS mean_margin, count(*)::BIGINT AS prompts FROM y")
def gt_accuracy(spark, sf_dir):
    from ratingmill.operators import recovery

    df = expand.by_attribute(table(spark, sf_dir, "benchmark").select("item_id"), NAMES)
    df = scoring.surrogate_scorer("item_id", "attribute")(df).withColumn("gt_attr", expand.drawn_attribute(F.col("item_id"), NAMES, SEED))
    out = recovery.accuracy(df.withColumnRenamed("attribute", "response_attr"), "item_id")
    return out.select(*[r6(c, c) for c in ("accuracy", "strict_accuracy", "mean_margin")], "prompts")


BIASED = f"b AS (SELECT model, system_prompt, c_custkey AS persona_id, item_id AS prompt_id, CASE WHEN {h('model', 'system_prompt', 'c_custkey', 'item_id')}%50=0 THEN NULL ELSE {score('model', 'system_prompt', 'c_custkey', 'item_id')} END AS score FROM benchmark CROSS JOIN (SELECT c_custkey FROM customer) CROSS JOIN (VALUES ('m1'),('m2')) m(model) CROSS JOIN (VALUES ('plain'),('kind')) s(system_prompt))"


def biased(spark, sf_dir) -> DataFrame:
    """Scores of each run's answers by each persona. Prompts and runs are parameter tables; the personas are dealt out to all tasks."""
    runs = expand.by_run(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id")), ["m1", "m2"], ["plain", "kind"])
    # the parts of the key that each side has are written once, and a row has one hash
    runs = runs.withColumns({"__before": F.concat("model", F.lit("|"), "system_prompt", F.lit("|")), "__after": F.concat(F.lit("|"), F.col("prompt_id").cast("string"))})
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_custkey").cast("string").alias("__own"))
    df = expand.with_each(own, runs).withColumn("__hash", portable_hash(F.concat("__before", "__own", "__after")))
    score = F.when(F.col("__hash") % 50 != 0, (F.col("__hash") % 10 + 1).cast("double"))
    return df.select("model", "system_prompt", "persona_id", "prompt_id", score.alias("score"))


T975 = f"t(df, q) AS (VALUES {values((k, round(stats.t_quantile(0.975, k), 9)) for k in range(1, 400))})"


@query(f"WITH {BIASED} SELECT model, system_prompt, round(avg(score),6) AS mean, count(score)::BIGINT AS count, round(stddev_samp(score)/sqrt(count(score)),6) AS sem FROM b GROUP BY ALL")
def persona_bias(spark, sf_dir):
    out = biased(spark, sf_dir).groupBy("model", "system_prompt").agg(F.avg("score").alias("mean"), F.count("score").alias("count"), (F.stddev_samp("score") / F.sqrt(F.count("score"))).alias("sem"))
    return out.select("model", "system_prompt", r6("mean", "mean"), "count", r6("sem", "sem"))


@query(f"WITH {BIASED}, {T975}, g AS (SELECT model, system_prompt, persona_id, avg(score) AS mean, stddev_samp(score) AS sd, count(score) AS n, count(*) AS rows FROM b GROUP BY ALL) SELECT model, system_prompt, persona_id, round(mean,6) AS mean, CASE WHEN n=rows AND rows>1 THEN round(q*sd/sqrt(rows),6) END AS ci95, n::BIGINT AS count FROM g LEFT JOIN t ON df=rows-1")
def persona_bias_ci(spark, sf_dir):
    out = stats.mean_ci95(biased(spark, sf_dir), ["model", "system_prompt", "persona_id"], "score")
    return out.select("model", "system_prompt", "persona_id", r6("mean", "mean"), r6("ci95", "ci95"), "count")


@query(f"WITH {BIASED} SELECT 'P'||lpad(persona_id::VARCHAR, greatest(2, length(persona_id::VARCHAR))::INT, '0') AS persona, round(avg(score) FILTER (model='m1' AND system_prompt='plain'),6) AS m1_plain, round(avg(score) FILTER (model='m1' AND system_prompt='kind'),6) AS m1_kind, round(avg(score) FILTER (model='m2' AND system_prompt='plain'),6) AS m2_plain, round(avg(score) FILTER (model='m2' AND system_prompt='kind'),6) AS m2_kind FROM b GROUP BY persona_id")
def persona_bias_pivot(spark, sf_dir):
    df = biased(spark, sf_dir).withColumn("run", F.concat_ws("_", "model", "system_prompt"))
    runs = ["m1_plain", "m1_kind", "m2_plain", "m2_kind"]
    out = df.groupBy("persona_id").pivot("run", runs).agg(F.avg("score"))
    return out.select(F.format_string("P%02d", "persona_id").alias("persona"), *[r6(c, c) for c in runs])


@query("SELECT c_custkey AS persona_key, array_to_string(list_filter([trim(c_mktsegment), CASE WHEN c_nationkey%2=0 THEN '' ELSE trim(c_name) END], lambda x: x<>''), ' ') AS persona FROM customer")
def persona_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    second = F.when(F.col("c_nationkey") % 2 == 0, F.lit("  ")).otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("persona_key"), text.persona(F.col("c_mktsegment"), second).alias("persona"))


REQUESTS = f"req AS (SELECT user_id, event_id, CASE WHEN {h('event_id', "'empty'")}%400=0 THEN '' ELSE 'x' END AS content, {h('event_id', "'stop'")}%400<>0 AS stop FROM events)"


def user_requests(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    content = F.when(draw(400, e, "empty") == 0, "").otherwise("x")
    response = F.struct(content.alias("content"), (draw(400, e, "stop") != 0).alias("finish_reason_stop"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", response.alias("response"))


@query(f"WITH {REQUESTS} SELECT user_id FROM req GROUP BY user_id HAVING bool_and(content<>'' AND stop)")
def all_or_nothing_users(spark, sf_dir):
    return synthetic.valid_users(user_requests(spark, sf_dir), ["user_id"])


@query(f"WITH {REQUESTS}, v AS (SELECT user_id, user_id%2 AS split FROM req GROUP BY user_id HAVING bool_and(content<>'' AND stop)) SELECT user_id, split::BIGINT AS split FROM v QUALIFY row_number() OVER (PARTITION BY split ORDER BY user_id)<=5")
def first_n_valid(spark, sf_dir):
    ok = synthetic.valid_users(user_requests(spark, sf_dir), ["user_id"]).withColumn("split", F.pmod("user_id", F.lit(2)).cast("long"))
    return synthetic.first_valid(ok, F.lit(5), order="user_id")


@query(f"WITH {REQUESTS}, v AS (SELECT user_id, bool_and(content<>'' AND stop) AS ok FROM req GROUP BY user_id) SELECT (user_id%2)::BIGINT AS split, count(*) FILTER (ok)::BIGINT AS kept, count(*) FILTER (NOT ok)::BIGINT AS discarded FROM v GROUP BY ALL")
def split_counters(spark, sf_dir):
    per = user_requests(spark, sf_dir).groupBy("user_id").agg(F.bool_and(scoring.valid(F.col("response"))).alias("ok"))
    return per.groupBy(F.pmod("user_id", F.lit(2)).cast("long").alias("split")).agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("discarded"))


@query("SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'user' ELSE role END AS role, CASE WHEN turn%2=0 THEN 'new '||conv_id||'/'||turn ELSE text END AS text FROM conversations")
def backfill_turns(spark, sf_dir):
    flat = table(spark, sf_dir, "conversations")
    made = flat.where("turn % 2 = 0").select("conv_id", "turn", F.struct(F.format_string("new %d/%d", "conv_id", "turn").alias("content")).alias("response"))
    return synthetic.back_filled(flat, made, ["conv_id"])


@query(f"WITH {NESTED}, g AS (SELECT conv_id//5 AS user_id, list(len(m) ORDER BY conv_id) AS n FROM c GROUP BY ALL) SELECT user_id::BIGINT AS user_id, (len(n)-1)::INT AS history, least(len(n)-1, 2)::INT AS cut, n[-1]::INT AS current, (n[-1]-1)::INT AS stripped, CASE WHEN len(n)>1 THEN round(list_avg(n[1:len(n)-1]),6) END AS mean_length FROM g")
def history_split(spark, sf_dir):
    users = nested(spark, sf_dir).groupBy(F.floor(F.col("conv_id") / 5).cast("long").alias("user_id")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "messages"))).alias("c"))
    past, current = conv.history_and_current(F.transform("c", lambda x: x["messages"]))
    out = users.select("user_id", past.alias("past"), current.alias("now"))
    mean = F.try_divide(F.aggregate(F.transform("past", F.size), F.lit(0), lambda a, x: a + x).cast("double"), F.size("past"))
    return out.select("user_id", F.size("past").alias("history"), F.size(F.slice("past", 1, 2)).alias("cut"), F.size("now").alias("current"), F.size(conv.without_last(F.col("now"))).alias("stripped"), r6(mean, "mean_length"))


@query(f"WITH p AS (SELECT item_id, list_transform(range(1, 11), lambda i: 1 + ('0x'||substr(md5(item_id||'|'||i),1,8))::BIGINT % 10) AS w FROM benchmark) SELECT item_id, round(list_sum(list_transform(w, lambda x, i: x*i))/list_sum(w)::DOUBLE, 6) AS rating, false AS low FROM p")
def weighted_rating(spark, sf_dir):
    w = F.array(*[(1 + draw(10, F.col("item_id"), i)).cast("double") for i in range(1, 11)])
    b = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    p = b.select("item_id", F.transform("w", lambda x: x / total).alias("p"))
    return p.select("item_id", r6(logprobs.weighted_rating(F.col("p")), "rating"), logprobs.low_mass(F.col("p")).alias("low"))


DIGITS = [f"(1+{h('item_id', str(d))}%9)/100.0" for d in range(1, 10)]


@query(f"SELECT item_id, round({DIGITS[0]}*(1-0.95),6) AS p1, {', '.join(f'round({x},6) AS p{i}' for i, x in enumerate(DIGITS[1:], 2))}, round({DIGITS[0]}*0.9,6) AS p10 FROM benchmark")
def rating_distribution(spark, sf_dir):
    first = F.create_map(*[x for d in range(1, 10) for x in (F.lit(d), F.log((1 + draw(9, F.col("item_id"), d)) / 100.0))])
    second = F.create_map(F.lit(0), F.log(F.lit(0.9)), F.lit(5), F.log(F.lit(0.05)))
    d = table(spark, sf_dir, "benchmark").select("item_id", logprobs.rating_distribution(first, second).alias("d"))
    return d.select("item_id", *[r6(F.get("d", F.lit(i)), f"p{i + 1}") for i in range(10)])


@query(f"WITH p AS (SELECT item_id, (1+{h('item_id')}%98)/100.0 AS y FROM benchmark) SELECT item_id, round(1/(1+exp(ln(0.99-y*0.99)-ln(y*0.99))),6) AS yes FROM p")
def yes_no_score(spark, sf_dir):
    y = (1 + draw(98, F.col("item_id"))) / 100.0
    return table(spark, sf_dir, "benchmark").select("item_id", r6(logprobs.yes_probability(F.log(y * 0.99), F.log(0.99 - y * 0.99)), "yes"))


@query("SELECT lang, count(*) FILTER (length(text)>2000)::BIGINT AS over, count(*)::BIGINT AS total, round(avg(length(text)-2000) FILTER (length(text)>2000),6) AS mean_excess, round(avg(length(text)),6) AS mean_length FROM documents GROUP BY lang")
def truncation_stats(spark, sf_dir):
    from ratingmill.operators.classify import truncation

    n = F.char_length("text")
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(*truncation(n, 2000), F.avg(n).alias("mean_length"))
    return out.select("lang", "over", "total", r6("mean_excess", "mean_excess"), r6("mean_length", "mean_length"))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS name, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def display_name_default(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return out.select("lang", text.display_name(F.col("lang"), {"en": "English", "de": "German"}).alias("name"), "n")


@query("SELECT DISTINCT source, count(*) OVER (PARTITION BY source)::BIGINT AS n FROM documents")
def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id)-1 AS g FROM (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id)) SELECT user_id, slot::INT AS slot, ((g*3+slot)%7)::BIGINT AS source_ord FROM s CROSS JOIN range(3) r(slot)")
def slot_assignment(spark, sf_dir):
    users = conv.numbered(table(spark, sf_dir, "events").select("user_id").distinct(), [F.col("user_id")], "ord")
    return expand.slots(users, F.col("ord"), 3, 7).select("user_id", "slot", F.col("source_ord").cast("long").alias("source_ord"))


@query("""WITH RECURSIVE n AS (SELECT user_id, count(*)::BIGINT AS n, row_number() OVER (ORDER BY user_id) AS k FROM events GROUP BY user_id),
c AS (SELECT k, n AS held, 0::BIGINT AS chunk FROM n WHERE k=1 UNION ALL SELECT n.k, CASE WHEN held>=500 THEN n.n ELSE held+n.n END, CASE WHEN held>=500 THEN chunk+1 ELSE chunk END FROM c JOIN n ON n.k=c.k+1)
SELECT user_id, n AS requests, chunk FROM c JOIN n USING (k)""")
def chunk_boundaries(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("requests"))
    return synthetic.chunked(n, [F.col("user_id")], F.col("requests"), 500).select("user_id", "requests", "chunk")


@query("WITH t AS (SELECT event_type, value, max(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, round(ln(sum(exp(value-m))),6) AS excess FROM t GROUP BY event_type")
def log_sum_exp(spark, sf_dir):
    out = logprobs.log_sum_exp(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", r6(F.col("log_sum") - F.col("top"), "excess"))


@query("SELECT item_id, '{\"item_id\":'||item_id||'}' AS encoded, item_id AS decoded FROM benchmark")
def json_round_trip(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct("item_id")).alias("encoded"))
    return b.withColumn("decoded", F.from_json("encoded", "item_id long")["item_id"])


@query(f"WITH {NESTED} SELECT conv_id, 'Conversation:'||chr(10)||array_to_string(list_transform(m, lambda x: '<message role='''||x.role||'''>'||x.content||'</message>'||chr(10)), '')||chr(10)||'How warm is the assistant''s last message? Give a whole number from 1 to 10.'||chr(10) AS prompt FROM c WHERE len(m)>=2 AND m[-1].role='assistant' AND m[-2].role='user'")
def judge_requests(spark, sf_dir):
    sound = nested(spark, sf_dir).where(conv.ends_with_answer(F.col("messages"))).withColumn("attribute", F.lit("warm"))
    return scoring.response_requests(sound).select("conv_id", "prompt")


FAILS = [h("item_id", str(k), "'fails'") for k in range(3)]


def kept(spark):
    """Writes a table to a folder of its own and reads it back."""
    at, made = scratch(spark), []

    def keep(df: DataFrame) -> DataFrame:
        made.append(f"{at}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    return keep


def attempted(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("score", F.when(draw(3, F.col("item_id"), k, "fails") != 0, surrogate_score(F.col("item_id"))))


@query(f"SELECT item_id, CASE WHEN {' OR '.join(f'{x}%3<>0' for x in FAILS)} THEN {score('item_id')} ELSE 5.0 END AS score FROM benchmark")
def ratings_retry(spark, sf_dir):
    return scoring.retried(attempted, kept(spark), scoring.JudgeOptions(retries=3, default=5.0))(table(spark, sf_dir, "benchmark").select("item_id"))


@query(f"SELECT attempt::INT AS attempt, (count(*) FILTER (CASE attempt WHEN 0 THEN {FAILS[0]}%3<>0 WHEN 1 THEN {FAILS[0]}%3<>0 OR {FAILS[1]}%3<>0 ELSE {' OR '.join(f'{x}%3<>0' for x in FAILS)} END))::BIGINT AS scored, count(*)::BIGINT AS asked FROM benchmark CROSS JOIN (VALUES (0), (1), (2)) a(attempt) GROUP BY attempt")
def scores_by_attempt(spark, sf_dir):
    said = []
    scoring.retried(attempted, kept(spark), scoring.JudgeOptions(retries=3), lambda *x: said.append(x))(table(spark, sf_dir, "benchmark").select("item_id"))
    return spark.createDataFrame(said, "attempt int, scored long, asked long")


@query(f"SELECT item_id, CASE WHEN {h('item_id', "'cut'")}%4=0 THEN 1+{h('item_id', "'forced'")}%10 ELSE 1+{h('item_id')}%10 END::DOUBLE AS score FROM benchmark")
def forced_rating(spark, sf_dir):
    """Responses that were cut off hold numbers, which are no ratings; a short second response gives it."""
    item = F.col("item_id")

    def said(df, raw, stop):
        parts = text.split_reasoning(raw)
        return df.withColumn("response", F.struct(parts["content"].alias("content"), parts["reasoning"].alias("reasoning"), raw.alias("raw_text"), stop.alias("finish_reason_stop")))

    def generate(df):
        cut = draw(4, item, "cut") == 0
        return said(df, F.when(cut, "<think>3 or 4, of 10").otherwise(F.concat(F.lit("<think>9?</think> Rating: "), surrogate_score(item).cast("int").cast("string"))), ~cut)

    def short(df):
        asked = F.col("prompt") == F.concat(F.lit("Rate "), item.cast("string"), F.lit("<think>3 or 4, of 10"), F.lit(scoring.FORCED))
        return said(df, F.when(asked, (1 + draw(10, item, "forced")).cast("string")), F.lit(False))

    df = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Rate "), item.cast("string")).alias("prompt"))
    return scoring.parsed_rating(generate, short=short, keep=kept(spark))(df).select("item_id", "score")


def embedded(spark, sf_dir) -> DataFrame:
    """Embeddings as a rating matrix: all components are attributes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_ord"), F.posexplode("embedding").alias("attr_ord", "score"))
    return e.withColumns({"attribute": F.format_string("d%02d", "attr_ord"), "score": F.col("score").cast("double")})


@query()
def varimax_components(spark, sf_dir):
    e = embedded(spark, sf_dir)
    r, attributes = factors.matrix(factors.correlations(e))
    k95, _ = factors.parallel_analysis(spark, factors.spectrum(r)[0], e.select("conv_ord").distinct().count())
    return factors.components(spark, r, {a: f"d{a:02d}" for a in attributes}, attributes, factors.schedule(k95))


@query()
def parallel_analysis(spark, sf_dir):
    e = embedded(spark, sf_dir)
    r, _ = factors.matrix(factors.correlations(e))
    return factors.parallel_analysis(spark, factors.spectrum(r)[0], e.select("conv_ord").distinct().count())[1]


@query()
def classifier_predict(spark, sf_dir):
    from ratingmill.operators.classify import TextClassifier

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", 1).otherwise(0).alias("label"))
    return TextClassifier().train(d).predict(d).select("doc_id", "label", "prediction")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; a temporary one only where all runs in this process."""
    import tempfile
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="ratingmill-")


@query(f"WITH {REQUESTS} SELECT user_id, event_id, (content<>'' AND stop) AS ok FROM req")
def stream_chunks(spark, sf_dir):
    from ratingmill.streaming import chunks

    at, schema_of = scratch(spark), table(spark, sf_dir, "events").schema
    requests = spark.readStream.schema(schema_of).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parq*")

    def respond(df):
        e = F.col("event_id")
        response = F.struct(F.when(draw(400, e, "empty") == 0, "").otherwise("x").alias("content"), (draw(400, e, "stop") != 0).alias("finish_reason_stop"))
        return df.select("user_id", "event_id", response.alias("response"))

    chunks.process(requests, respond, f"{at}/out", f"{at}/checkpoint", lambda df: df.select("user_id", "event_id", "ok")).awaitTermination()
    return spark.read.schema("user_id long, event_id long, ok boolean").parquet(f"{at}/out")


@query(f"""WITH {NESTED}, n AS (SELECT row_number() OVER (ORDER BY conv_id)-1 AS source_ord, len(m) AS turns FROM c), k AS (SELECT count(*) AS total FROM n), {USERS}, s AS (SELECT user_id, row_number() OVER (ORDER BY user_id)-1 AS g FROM u),
d AS (SELECT user_id, slot, (g*3+slot)%total AS source_ord FROM s CROSS JOIN range(3) r(slot) CROSS JOIN k) SELECT user_id, slot::INT AS slot, ((turns+1)//2)::BIGINT AS requests FROM d JOIN n USING (source_ord)""")
def synthetic_requests(spark, sf_dir):
    source = conv.numbered(nested(spark, sf_dir), [F.col("conv_id")], "source_ord").select("source_ord", "messages")
    users = conv.numbered(user_attributes(spark, sf_dir), [F.col("user_id")], "user_ord")
    users = users.select(F.lit("train").alias("split"), F.col("user_id").alias("user_idx"), "user_ord", "attributes")
    made = synthetic.requests(users, source, 3, source.count())
    return made.groupBy(F.col("user_idx").alias("user_id"), "slot").agg(F.count("prompt").alias("requests"))


@query()
def benchmark_worlds(spark, sf_dir):
    from ratingmill.operators import benchmark

    c = nested(spark, sf_dir).where(conv.opens_well(F.col("messages"))).withColumnRenamed("conv_id", "user_id")
    own = expand.sampled_attributes(c, ["user_id"], NAMES, 3, SEED)
    items = own.select(
        F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("split"), F.col("user_id").cast("string").alias("user_id"), F.col("attributes").alias("user_attributes"),
        F.array("messages").alias("conversation_history"), conv.without_last(F.col("messages")).alias("current_messages"),
    )
    keep = kept(spark)
    generate, scorer = scoring.surrogate_generator("split", "user_id", "attribute"), scoring.surrogate_scorer("content", "attribute")
    return benchmark.run(keep(items), NAMES, {k: reward.permutation_world(spark, N, N, k) for k in (0, 1)}, generate, scorer, keep)
