"""Quality classifier from weak labels.

Heuristic labellers vote on each document (1: bad, 0: good, -1: no opinion), on two questions: low quality and toxicity; rows of
`labels`, where given, are one more labeller. How often each pattern of votes occurs is counted over all documents. From these
counts, whose number is bounded by 3 to the power of the labellers, expectation-maximisation estimates what each labeller says of
good documents and of each kind of bad ones, and so the posterior of each pattern. Posterior labels train a linear scorer over hashed words and
hashed statistics, which then judges every document by its whole text; the heuristics themselves decide nothing.

The scorer is fitted on a bounded sample: for each question at most `fit_rows` documents, half of them with a posterior of at
least one half, the first ones in the order of a hash of doc_id and text.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.common import arrow_rows, filtered, release, stash, tune

WIDTH = 1 << 18
FIT_ROWS = 8000
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#$%&*|!@^~<>=+_{}[]\\"
EDGES = b".,;:!?\"'()"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
# fixed values: words of abuse, by what they say
PERSONS = (b"idiot", b"moron", b"loser", b"clown", b"fool", b"imbecile", b"jerk")
JUDGEMENTS = (b"stupid", b"pathetic", b"worthless", b"disgusting", b"dumb", b"useless")
DEHUMANISING = (b"scum", b"trash", b"garbage", b"vermin", b"filth", b"freak")
ABUSE = (PERSONS, JUDGEMENTS, DEHUMANISING)
# fixed values: words by which English is told; the words of abuse say nothing of other languages
ENGLISH = frozenset((b"the", b"of", b"and", b"to", b"in", b"is", b"that", b"for", b"it", b"with"))
#: Votes "good" on good documents that each labeller is presumed to have given.
PRESUMED = 20
#: Lengths of the word beginnings that are features.
STEMS = (4, 6)

#: Statistic, then from which value it speaks for low quality, and below which for good quality; between: no opinion.
QUALITY = (
    ("symbols", 0.05, 0.01),
    ("marked", 0.2, 0.05),
    ("capitals", 0.3, 0.1),
    ("repeats", 0.1, 0.04),
    ("sameness", 0.7, 0.5),
    ("lines", 0.4, 0.2),
    ("bars", 0.1, 0.01),
    ("shouts", 0.5, 0.1),
)


def statistics(b: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares in [0, 1], or more for shouts; short documents give no sameness or lines."""
    n, ink = max(len(words), 1), max(len(b.translate(None, SPACE)), 1)
    lost = lambda chars: ink - len(b.translate(None, SPACE + chars)) if words else 0
    lines = [x for x in b.split(b"\n") if x]
    return {
        "symbols": lost(SYMBOLS) / ink,
        "marked": sum(w[-1] in SYMBOLS for w in words) / n,
        "capitals": lost(UPPER) / ink,
        "repeats": sum(map(operator.eq, words, islice(words, 1, None))) / n if n >= 20 else 0.0,
        "sameness": 1 - len(set(words)) / n if n >= 50 else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) >= 5 else 0.0,
        "bars": b.count(b"|") / n,
        "shouts": b.count(b"!") / n,
        "digits": lost(DIGITS) / ink,
    }


def normal(words: list[bytes]) -> set[bytes]:
    return {w.strip(EDGES) for w in words}


def votes(text: str | None) -> tuple[str, str]:
    """The heuristic labellers' votes on low quality and on toxicity, a letter each: b(ad), g(ood), - (no opinion)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    s = statistics(b, b.split())
    quality = "".join("b" if s[k] >= bad else "g" if s[k] < good else "-" for k, bad, good in QUALITY)
    words = b.lower().split()
    own = normal(words)
    hits = [sum(w in own for w in group) for group in ABUSE]
    none = "g" if sum(w in ENGLISH for w in words) >= 0.05 * max(len(words), 1) else "-"
    return quality, "".join("b" if h else none for h in hits) + ("b" if sum(hits) >= 2 else none)


def features(text: str | None) -> np.ndarray:
    """Hashed features, sorted and distinct: the words, their beginnings, and each statistic's bucket."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = normal(b.lower().split())
    words |= {w[:n] + b"*" for w in words for n in STEMS if len(w) > n}
    out = {zlib.crc32(w) % WIDTH for w in words}
    out |= {zlib.crc32(f"\0{k}:{int(np.ceil(np.sqrt(min(v, 1.0)) * 10))}".encode()) % WIDTH for k, v in statistics(b, b.split()).items()}
    return np.array(sorted(out), np.int32)


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of bad for each pattern, how labellers that have an opinion say: class x labeller x "gb", share of each class).

    Documents are bad in several ways, and a labeller that knows one way calls the others good. So the classes are good (0) and one
    kind of bad for each labeller, at first the documents that it is the first to call bad. A document is bad by what its kinds
    have together.
    """
    says = np.array([["gb-".index(c) for c in p] for p in patterns])
    n = says.shape[1]
    called = says == 1
    r = np.full((len(says), n + 1), 0.02 / n)
    r[:, 0] = np.where(called.any(1), 0.02, 0.98)
    r[called.any(1), 1 + called.argmax(1)[called.any(1)]] += 0.96
    p = None
    for _ in range(rounds):
        r /= r.sum(1, keepdims=True)
        if p is not None and np.abs(1 - r[:, 0] - p).max() < 1e-9:
            break
        p = 1 - r[:, 0]
        weight = (r * counts[:, None]).T
        table = np.ones((n + 1, n, 2))  # votes that are presumed; no opinion says nothing
        table[0, :, 0] = PRESUMED
        for v in range(2):
            table[:, :, v] += weight @ (says == v)
        table /= table.sum(2, keepdims=True)
        share = (weight.sum(1) + 1) / (counts.sum() + n + 1)
        log = np.log(share)[None, :] + sum(np.where(says[:, [k]] < 2, np.log(table[:, k, np.minimum(says[:, k], 1)].T), 0) for k in range(n))
        r = np.exp(log - log.max(1, keepdims=True))
    return p, table, share


@dataclass(frozen=True)
class Model:
    """Weights by question; reads a document's whole text."""

    weights: np.ndarray
    bias: np.ndarray

    def score(self, text: str | None) -> np.ndarray:
        z = np.clip(self.bias + self.weights[:, features(text)].sum(1), -50, 50)
        return 1 / (1 + np.exp(-z))


def fit(rows: list[np.ndarray], y: np.ndarray, rounds: int = 60, rate: float = 0.3, shrink: float = 0.08) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features with soft labels, classes of equal weight; weights are shrunk towards zero, so that
    words without evidence add nothing however long a text is. One class only: the bias alone."""
    w, bias = np.zeros(WIDTH), 0.0
    if not len(rows) or min(y.sum(), (1 - y).sum()) < 0.5:
        return w, 4.0 if len(rows) and y.mean() > 0.5 else -4.0
    ends = np.cumsum([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=WIDTH) >= 4
    shrink /= np.sqrt(len(rows))
    flat, owner = flat[seen[flat]], owner[seen[flat]]
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    past, past_b = np.full(WIDTH, 1e-10), 1e-10
    for _ in range(rounds):
        z = bias + np.bincount(owner, weights=w[flat], minlength=len(ends))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = np.bincount(flat, weights=g[owner], minlength=WIDTH)
        past += grad * grad
        past_b += g.sum() ** 2
        step = rate / np.sqrt(past)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        bias -= rate * g.sum() / np.sqrt(past_b)
    return w, float(bias)


QUESTIONS = ("quality", "toxic")


def train(docs: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """The scorer of docs (doc_id, text), with labels (doc_id, quality 0/1, toxic 0/1) as one more labeller where given.

    At most fit_rows different texts are gathered for each question. Rows with the same id and text count once there; rows with the
    same id and other texts are rows of their own, each with its own text (a label of the id holds for all of them)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("own"))

    def vote(c: dict) -> dict:
        got = [votes(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "own": c["own"], "quality": [q for q, _ in got], "toxic": [t for _, t in got]}

    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("quality", pa.string()), ("toxic", pa.string())])
    said = docs.mapInArrow(arrow_rows(vote, schema), "doc_id long, own long, quality string, toxic string")
    if labels is not None:
        seen = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lq"), F.max("toxic").alias("lt"))
        said = said.join(seen, "doc_id", "left").select(
            "doc_id",
            "own",
            F.concat("quality", F.expr("case lq when 0 then 'b' when 1 then 'g' else '-' end")).alias("quality"),
            F.concat("toxic", F.expr("case lt when 1 then 'b' when 0 then 'g' else '-' end")).alias("toxic"),
        )
    said = stash(said)
    weights, biases = [], []
    for k, q in enumerate(QUESTIONS):
        seen = said.groupBy(q).count().orderBy(q).collect()  # bounded by the number of patterns
        if not seen:
            return Model(np.zeros((2, WIDTH)), np.full(2, -4.0))
        p, _, _ = expectation_maximisation([r[0] for r in seen], np.array([r[1] for r in seen], float))
        posterior = dict(zip([r[0] for r in seen], p.tolist()))
        bad = [x for x, v in posterior.items() if v >= 0.5]
        order = F.xxhash64("doc_id", "own", F.lit(k))
        is_bad = F.col("says").isin(bad) if bad else F.lit(False)
        rows = said.where("doc_id is not null").groupBy("doc_id", "own").agg(F.min(q).alias("says"))
        halves = [rows.where(x).orderBy(order, "doc_id", "own").limit(fit_rows // 2) for x in (is_bad, ~is_bad)]
        picked = halves[0].unionAll(halves[1])

        def encode(c: dict) -> dict:
            return {"says": c["says"], "x": [features(t).tobytes() for t in c["text"]]}

        schema = pa.schema([("says", pa.string()), ("x", pa.binary())])
        rows = docs.join(F.broadcast(picked), ["doc_id", "own"])  # at most fit_rows ids and texts
        rows = rows.groupBy("doc_id", "own").agg(F.first("says").alias("says"), F.first("text").alias("text")).select("says", "text")
        got = rows.mapInArrow(arrow_rows(encode, schema), "says string, x binary").collect()
        got.sort(key=lambda r: (r.says, bytes(r.x)))
        w, b = fit([np.frombuffer(r.x, np.int32) for r in got], np.array([posterior[r.says] for r in got]))
        weights.append(w)
        biases.append(b)
        del got
        release()  # the driver's Python outlives the fit
    return Model(np.array(weights), np.array(biases))


def _judge(model: Model):
    def each(c: dict) -> dict:
        p = np.array([model.score(t) for t in c["text"]]).reshape(-1, 2)
        return {"doc_id": c["doc_id"], "low_quality": p[:, 0], "toxicity": p[:, 1], "keep": (p < 0.5).all(1)}

    return each


def classify(docs: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, low_quality, toxicity, keep) of every document; keep: both probabilities are below one half.

    Null and empty texts have no word and are judged by the bias and their statistics. Equal rows and rows without doc_id are
    judged each; an empty table gives no row; other columns of docs are not looked at.
    """
    model = train(docs, labels, fit_rows)
    schema = pa.schema([("doc_id", pa.int64()), ("low_quality", pa.float64()), ("toxicity", pa.float64()), ("keep", pa.bool_())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(arrow_rows(_judge(model), schema), "doc_id long, low_quality double, toxicity double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with all columns, that the classifier keeps. Null, empty and equal texts are judged as in classify; an empty
    table gives no row."""
    model = train(docs, labels, fit_rows)
    return filtered(docs, lambda texts: [bool((model.score(t) < 0.5).all()) for t in texts])
