"""Toxic passages as maximum-scoring segments of token log-odds.

Training takes a bounded sample of labelled documents. Their distinct lines (so copies count once; a line seen in a
clean document is clean) give token counts by class, and each token's log-odds under a Dirichlet prior taken from both
classes together, with its z-score. Tokens that tell toxic texts are counted again by the words they follow, each
such context once, which takes away what near copies of one document repeat. Those that still do
carry their log-odds, all others a small loss.

A scan linear in the words finds all maximal segments of positive score. A segment's score is put on the scale of the
largest score that a clean text of the same length would show (Gumbel: lambda from the clean token distribution, K by
maximum likelihood from the clean documents of the sample); the evidence of the significant segments is added up and a
logistic curve, fitted on the sample, makes it a probability.

Defined results: a null or empty text has no evidence and gets the lowest score; without labels of both classes every
document gets the smoothed share of toxic labels; labels other than 0 and 1, or without id, are left out; a document
labelled twice counts as toxic if one label says so; repeated rows each get their result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_column, ascii_words, kept, per_text, rows_held

#: Labelled documents taken for training, chosen by a hash of their id.
MAX_TRAIN_DOCS = 20_000
#: The prior's weight, as a share of all counted tokens.
PRIOR_SHARE = 0.1
MIN_Z = 4.5
#: Least log-odds: words that are merely a little commoner in toxic texts don't mark passages.
MIN_WEIGHT = 1.0
GAP_LOSS = 0.2
SIGNIFICANT = 0.05
MAX_EVIDENCE = 60.0
THRESHOLD = 0.3

_PASSAGE = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p", pa.float64())])
_OUT = pa.struct([("score", pa.float64()), ("evidence", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(_PASSAGE))])
_OUT_SQL = (
    "struct<score: double, evidence: double, n_words: bigint, "
    "passages: array<struct<first: bigint, last: bigint, score: double, p: double>>>"
)


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    spread: float = 1.0  # K
    intercept: float = 0.0
    slope: float = 0.0


def maximal_segments(places: list[int], scores: list[float], loss: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments: scored words at places, every other word costs the loss."""
    stack: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest one that starts lower
    total, reached = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        total -= loss * (place - reached)
        reached = place + 1
        if score <= 0:
            total += score
            continue
        low, high, first = total, total + score, place
        total = high
        while True:
            near = len(stack) - 1
            while near >= 0 and stack[near][0] >= low:
                near = stack[near][4]
            if near < 0 or stack[near][1] >= high:
                stack.append((low, high, first, place + 1, near))
                break
            low, first = stack[near][0], stack[near][2]
            del stack[near:]
    return [(first, last, high - low) for low, high, first, last, _ in stack]


def passages(words: list[bytes], model: Model) -> list[dict]:
    """The significant segments of a text."""
    weights = model.weights
    places = [i for i, word in enumerate(words) if word in weights]
    found = []
    for first, last, score in maximal_segments(places, [weights[words[i]] for i in places], GAP_LOSS):
        p = -math.expm1(-model.spread * len(words) * math.exp(-model.scale * score))
        if p < SIGNIFICANT:
            found.append({"first": first, "last": last, "score": score, "p": p})
    return found


def assess(text: str, model: Model) -> dict:
    words = ascii_words(text, lower_all=True)
    found = passages(words, model) if model.weights else []
    evidence = min(MAX_EVIDENCE, sum(-math.log(max(s["p"], 1e-300)) for s in found))
    score = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.intercept + model.slope * evidence))))
    return {"score": score, "evidence": evidence, "n_words": len(words), "passages": found}


def assessed(text: Column, model) -> Column:
    return arrow_column(per_text(lambda value: assess(value, model.value), _OUT), _OUT_SQL, text)


def _solve_scale(chances: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) over clean tokens is one."""
    rest = max(0.0, 1 - chances.sum())

    def excess(x: float) -> float:
        return float((chances * np.exp(x * weights)).sum() + rest * math.exp(-x * GAP_LOSS) - 1)

    high = 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    low = 0.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _fit_logistic(evidence: np.ndarray, toxic: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge."""
    x = np.stack([np.ones_like(evidence), evidence], 1)
    beta, ridge = np.zeros(2), np.array([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (counts * (toxic - p)) - ridge * beta
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def _words_of_line(batches):
    for lines in batches:
        yield pa.array([[w.decode("utf-8", "replace") for w in set(ascii_words(x.as_py() or "", lower_all=True))] for x in lines], pa.list_(pa.string()))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """A model from labels (doc_id, toxic) and the texts of at most about `max_docs` of them (every label if fewer)."""
    spark = docs.sparkSession
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("_toxic"))
        .filter("doc_id is not null and _toxic in (0, 1)").groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    )
    total = marks.count()
    if total > max_docs:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < max_docs)
    # the sample is bounded, so its ids may be sent to all executors
    sample = kept(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "_toxic"), "toxic-sample")
    lines = sample.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"), "_toxic").groupBy("line").agg(F.min("_toxic").alias("_toxic"))
    tokens = lines.select(F.explode(arrow_column(_words_of_line, "array<string>", F.col("line"))).alias("token"), "_toxic")
    counts = kept(tokens.groupBy("token").agg(F.sum("_toxic").alias("y1"), F.sum(1 - F.col("_toxic")).alias("y0")), "toxic-tokens")
    by_class = dict(sample.groupBy("_toxic").count().collect())
    toxic_docs, clean_docs = by_class.get(1, 0), by_class.get(0, 0)
    base = (toxic_docs + 0.5) / (toxic_docs + clean_docs + 10)
    model = Model(intercept=math.log(base / (1 - base)))
    n1, n0 = counts.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return model
    strength = PRIOR_SHARE * (n1 + n0)

    def that_tell(table: DataFrame) -> list:
        prior = F.lit(strength) * (F.col("y1") + F.col("y0")) / F.lit(n1 + n0)
        odds = [F.log((F.col(y) + prior) / (F.lit(n + strength) - F.col(y) - prior)) for y, n in (("y1", n1), ("y0", n0))]
        sd = F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
        rated = table.select("token", "y0", (odds[0] - odds[1]).alias("weight"), sd.alias("sd"))
        return rated.filter((F.col("weight") >= MIN_WEIGHT) & (F.col("weight") >= MIN_Z * F.col("sd"))).collect()  # tokens of the bounded sample

    marked = spark.sparkContext.broadcast({r["token"].encode() for r in that_tell(counts)})

    def contexts(batches):
        for texts in batches:
            found = []
            for value in texts:
                words = ascii_words(value.as_py() or "", lower_all=True)
                pairs = {(w, words[i - 1] if i else b"") for i, w in enumerate(words) if w in marked.value}
                found.append([{"token": w.decode("utf-8", "replace"), "after": v.decode("utf-8", "replace")} for w, v in pairs])
            yield pa.array(found, pa.list_(pa.struct([("token", pa.string()), ("after", pa.string())])))

    around = lines.select(F.explode(arrow_column(contexts, "array<struct<token: string, after: string>>", F.col("line"))).alias("c"), "_toxic")
    by_context = around.groupBy("c").agg(F.min("_toxic").alias("_toxic")).groupBy(F.col("c.token").alias("token"))
    telling = that_tell(by_context.agg(F.sum("_toxic").alias("y1"), F.sum(1 - F.col("_toxic")).alias("y0")))
    if not telling:
        return model
    model.weights = {r["token"].encode(): r["weight"] for r in telling}
    chances = np.array([(r["y0"] + 0.5) / (n0 + 0.5 * len(telling)) for r in telling])
    weights = np.array([r["weight"] for r in telling])
    # the drift must be downwards
    chances *= min(1.0, 0.5 * GAP_LOSS / max(1e-12, float((chances * (weights + GAP_LOSS)).sum())))
    model.scale = _solve_scale(chances, weights)

    def extremes(batches):
        shared = sent.value
        for texts in batches:
            out = []
            for value in texts:
                words = ascii_words(value.as_py() or "", lower_all=True)
                places = [i for i, w in enumerate(words) if w in shared.weights]
                best = max((s for _, _, s in maximal_segments(places, [shared.weights[words[i]] for i in places], GAP_LOSS)), default=0.0)
                out.append(len(words) * math.exp(-shared.scale * best))
            yield pa.array(out, pa.float64())

    sent = spark.sparkContext.broadcast(model)
    clean = sample.filter("_toxic = 0").select(arrow_column(extremes, "double", F.col("text")).alias("x")).agg(F.count("x"), F.sum("x")).first()
    model.spread = (clean[0] + 1) / (clean[1] + 1) if clean[0] else 1.0
    sent = spark.sparkContext.broadcast(model)
    fitted = sample.select("_toxic", assessed(F.col("text"), sent).alias("_r")).select("_toxic", F.round("_r.evidence", 1).alias("e"))
    bins = fitted.groupBy("_toxic", "e").count().collect()  # at most 10 * MAX_EVIDENCE rows a class
    model.intercept, model.slope = _fit_logistic(*(np.array([float(r[i]) for r in bins]) for i in (1, 0, 2)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `_toxicity`: score, evidence, n_words and passages [first, last) in words."""
    return docs.withColumn("_toxicity", assessed(F.col("text"), docs.sparkSession.sparkContext.broadcast(model)))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    return score(rows_held(docs), model).filter(F.col("_toxicity.score") < threshold).select("row.*")
