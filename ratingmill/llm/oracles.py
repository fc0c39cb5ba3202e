"""SQL of the operators that SQL can express, for DuckDB: the plain definitions, without indexes or cells."""

from __future__ import annotations

from ratingmill.llm import clusters, licenses, pii, secrets

# base patterns, as the queries' contracts give them, and those that the operators add; then what a match x must satisfy
_LUHN = """list_sum(list_transform(range(1, length(d)+1), lambda k: CASE WHEN (length(d)-k)%2=1 THEN 2*substr(d,k,1)::INT - CASE WHEN substr(d,k,1)::INT>4 THEN 9 ELSE 0 END ELSE substr(d,k,1)::INT END))%10=0"""
_IBAN = """list_reduce(list_concat([0::BIGINT], list_transform(range(1, length(c)+1), lambda k: CASE WHEN substr(c,k,1) BETWEEN '0' AND '9' THEN substr(c,k,1)::BIGINT ELSE ascii(substr(c,k,1))::BIGINT-55 END)), lambda a, v: CASE WHEN v<10 THEN (a*10+v)%97 ELSE (a*100+v)%97 END)=1"""
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x,'.'), lambda p: length(ltrim(p,'0'))>3 OR (length(ltrim(p,'0'))=3 AND ltrim(p,'0')>'255')))=0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length(d) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 10 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", f"length(c) BETWEEN 15 AND 34 AND {_IBAN}"),
    ("ssn", r"[0-9][0-9-]*", f"regexp_matches(x, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') AND NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, '{pii.CONTEXT['ssn']}')"),
)
_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_replace(x, '" + _HEAD.replace("'", "''") + "', ''))>=6"),
    ("access", "AKIA[A-Z0-9]+", "length(x)>=20"),
    ("hex", "[0-9a-f]+", "length(x)>=24"),
    *[(r.kind, r.pattern, "true") for r in secrets.RULES[3:]],
)


def _spans(kinds: tuple, base: tuple[str, ...], score: str = "") -> str:
    hits = " UNION ALL ".join(
        "SELECT r, {0} AS rank, '{1}' AS kind, regexp_extract_all(t, '{2}') AS m, string_split_regex(t, '{2}') AS g FROM d WHERE regexp_matches(t, '{2}')".format(i, k, p.replace("'", "''"))
        for i, (k, p, _) in enumerate(kinds)
    )
    ok = " ".join(f"WHEN '{k}' THEN {v}" for k, _, v in kinds)
    counts = ", ".join(f"(count(*) FILTER (kind='{k}'))::BIGINT AS n_{k}" for k in base)
    own = ", ".join(f"'{k}'" for k in base)
    scores = ", coalesce(string_agg(score::VARCHAR, ',' ORDER BY pos, rank), '') AS scores" if score else ""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS t FROM documents), h AS ({hits}),
s AS (SELECT r, rank, kind, m, g, unnest(range(1, len(m)+1)) AS i FROM h),
p AS (SELECT r, rank, kind, m[i] AS x, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))),0))::BIGINT AS pos, lower(concat_ws(' ', right(g[i],40), left(g[i+1],40))) AS near,
  regexp_replace(m[i], '[^0-9]', '', 'g') AS d, substr(replace(m[i],' ',''),5)||substr(replace(m[i],' ',''),1,4) AS c FROM s),
k AS (SELECT r, rank, kind, pos, kind||':'||pos||':'||(pos+length(x)) AS span{', ' + score if score else ''} FROM p WHERE CASE kind {ok} END)
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY pos, rank) FILTER (kind IN ({own})), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY pos, rank), '') AS spans{scores}
FROM d LEFT JOIN k USING (r) GROUP BY r"""


_FOR = " ".join(f"WHEN '{k}' THEN {a}::DOUBLE+CASE WHEN regexp_matches(near, '{pii.CONTEXT[k]}') THEN {b} ELSE 0 END" for k, (a, b) in pii.SCORES.items())
_SCORE = f"round(least(greatest(CASE kind {_FOR} END - CASE WHEN regexp_matches(near, '{pii.AGAINST}') THEN {pii.LESS} ELSE 0 END, 0), 1), 3) AS score"

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(embedding, lambda x: x<>0))>0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label=b.label AND a.vec_id<>b.vec_id AND len(a.e)=len(b.e) WHERE list_inner_product(a.e,b.e)/(sqrt(list_inner_product(a.e,a.e))*sqrt(list_inner_product(b.e,b.e)))>=0.98),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y=l.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x=vec_id)::BIGINT AS n_links, least(vec_id, coalesce((SELECT min(y) FROM r WHERE r.x=vec_id), vec_id))::BIGINT AS component_id, (vec_id = least(vec_id, coalesce((SELECT min(y) FROM r WHERE r.x=vec_id), vec_id))) AS kept FROM embeddings"""

ORACLES = {
    "op3_personal_data": _spans(PII, pii.BASE, _SCORE),
    "op5_trigram_secrets": _spans(SECRETS, secrets.BASE),
    "op8_pivot_range_join": VECTORS,
}

# strings of 50 bytes as 100 hex digits; runs of removed bytes are those that overlap or touch
REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text,''))) AS x FROM documents),
w AS (SELECT r, doc_id, unnest(range(0, length(x)//2-49)) AS i, x FROM d), s AS (SELECT r, doc_id, i, substr(x, 2*i+1, 100) AS s FROM w),
m AS (SELECT s, min(doc_id) AS low FROM s GROUP BY s), c AS (SELECT r, i FROM s JOIN m USING (s) WHERE low<doc_id),
g AS (SELECT r, i, CASE WHEN i-lag(i) OVER (PARTITION BY r ORDER BY i)<=50 THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g), runs AS (SELECT r, min(i) AS a, max(i)+50 AS b FROM k GROUP BY r, k),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS done FROM runs),
o AS (SELECT r, sum(b-a)::BIGINT AS gone, count(*) AS n, max(b) AS last, string_agg(substr(x, 2*done+1, 2*(a-done)), '' ORDER BY a) AS kept FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(x)//2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '')||substr(x, 2*coalesce(last, 0)+1))) AS kept_sha256 FROM d LEFT JOIN o USING (r)"""

ORACLES["op6_repeated_passages"] = REPEATS


def _wording(regions: list) -> str:
    """A template as a regular expression over words that each follow one blank."""
    out = ""
    for x in regions:
        if x[0] == "word":
            out += " (?:" + "|".join(w.decode() for w in x[1]) + ")"
        elif x[0] == "optional":
            out += f"(?:{_wording(x[1])})?"
        else:
            out += f"(?: [^ ]+){{{x[1]},{x[2]}}}"
    return out


_LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses() -> str:
    parsed = {t: licenses.parse(t.markup) for t in licenses.TEMPLATES}
    found = ", ".join(f"CASE WHEN regexp_matches(x, '{_wording(p)} ') THEN {{'label': '{t.label}', 'm': {licenses.mandatory(p)}}} END" for t, p in parsed.items())
    at = " OR ".join("(" + " AND ".join(f"w[i+{k}]='{x[1][0].decode()}'" for k, x in enumerate(parsed[t])) + ")" for t in licenses.BASE)
    base = ", ".join(f"CASE WHEN regexp_matches(x, '{_wording(parsed[t])} ') THEN '{t.label}' END" for t in licenses.BASE)
    listed = lambda a: f"array_to_string(list_sort(list_distinct(list_filter({a}, lambda y: y IS NOT NULL))), ',')"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT doc_id, w, ' '||array_to_string(w, ' ')||' ' AS x FROM d), p AS (SELECT doc_id, x, len(w) AS n, list_filter(range(1, len(w)+1), lambda i: {at}) AS s FROM k),
f AS (SELECT *, [{found}] AS f FROM p)
SELECT doc_id, n::BIGINT AS n_words, len(s)::BIGINT AS n_base, (list_min(s)-1)::BIGINT AS first_word, (list_max(s)-1)::BIGINT AS last_word, {listed(f'[{base}]')} AS base_labels, {listed('list_transform(f, lambda y: y.label)')} AS labels,
coalesce(list_max(list_transform(f, lambda y: y.m)), 0)::DOUBLE / (coalesce(list_max(list_transform(f, lambda y: y.m)), 0) + {licenses.HALF}) AS score FROM f"""


ORACLES["op11_template_licenses"] = _licenses()


def _clusters(k: int = clusters.CLUSTERS, rounds: int = clusters.ROUNDS) -> str:
    """The rounds one after the other; a vector's nearest centroid is the least (distance, number)."""
    near = "SELECT r, any_value(v.v) AS v, min({{'d': list_sum(list_transform(list_zip(v.v, c.m), lambda z: (z[1]-z[2])*(z[1]-z[2])))::BIGINT, 'c': c.c}}) AS b FROM v, c{0} c GROUP BY r".format
    parts = []
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({near(i)})")
        if i < rounds:
            sums = f"SELECT b.c AS c, i, sum(v[i]) AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {clusters.DIMS + 1}) t(i) GROUP BY b.c, i"
            means = f"SELECT c, list(((s-((s%n)+n)%n)//n)::BIGINT ORDER BY i) AS m FROM ({sums}) GROUP BY c"
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(x.m, o.m) AS m FROM c{i} o LEFT JOIN ({means}) x USING (c))")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE}*x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding)={clusters.DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:'||vec_id), v)-1 AS c, v AS m FROM v ORDER BY sha256('{clusters.SEED}:'||vec_id), v LIMIT {k}),
{', '.join(parts)}
SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.c=b.c"""


ORACLES["op12_centroid_clusters"] = _clusters()


COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k=1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, f AS a, k AS m, string_split(phrase, ' ') AS w FROM f WHERE k>1 AND f>=10),
x AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, w FROM c), y AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS left_part, array_to_string(w[k+1:], ' ') AS right_part FROM x),
s AS (SELECT y.lang, y.phrase, y.a, y.k, l.f AS l, r.f AS r, 1000000*y.a*y.a//(l.f*r.f) AS score FROM y JOIN f l ON l.lang=y.lang AND l.phrase=y.left_part JOIN f r ON r.lang=y.lang AND r.phrase=y.right_part),
b AS (SELECT lang, phrase, any_value(a) AS a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS t FROM s GROUP BY lang, phrase),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1]||' '||w[2], w[2]||' '||w[3]]) AS phrase FROM c WHERE m=3) GROUP BY ALL),
k AS (SELECT lang, phrase, a, t, row_number() OVER (PARTITION BY lang ORDER BY t.score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100*longer<50*a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, t.l::BIGINT AS l, t.r::BIGINT AS r, n, t.score::BIGINT AS score FROM k JOIN n USING (lang) WHERE rank<=2000"""

ORACLES["op13_sketch_collocations"] = COLLOCATIONS
