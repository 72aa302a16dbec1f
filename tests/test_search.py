"""Ranked place search against a plain scan of all places."""

import math
import random

from pyspark.sql import functions as F

from pathloom.operators import search as X

WORDS = ["a", "ab", "abc", "abd", "b", "ba", "bar", "barn", "c", "cafe", "cab", "d", "dab", "e", "east", "x1", "x12"]


def corpus(rng, count):
    return [(i, " ".join(rng.choices(WORDS, weights=[40 // (k + 1) + 1 for k in range(len(WORDS))], k=rng.randint(1, 12)))) for i in range(count)]


def brute(places, query, depth):
    """The best matches of a query: (place, relevance)."""
    texts = {p: t.split() for p, t in places}
    tokens = query.split()
    average = sum(map(len, texts.values())) / len(texts)
    scores = {}
    for token in tokens:
        tf = {p: sum(w.startswith(token) for w in ws) for p, ws in texts.items()}
        tf = {p: n for p, n in tf.items() if n}
        idf = max(1e-6, math.log((len(texts) - len(tf) + 0.5) / (len(tf) + 0.5)))
        for p, n in tf.items():
            score = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(texts[p]) / average))
            scores.setdefault(p, []).append(score)
    whole = sorted((-round(sum(s), 9), p) for p, s in scores.items() if len(s) == len(tokens))
    return {p: n + 1 for n, (_, p) in enumerate(whole[:depth])}, len(whole)


def test_block_skipping_gives_the_ranks_of_a_scan(spark):
    rng = random.Random(3)
    places = corpus(rng, 4000)
    frame = spark.createDataFrame([(p, t, None, None, None) for p, t in places], "place_id long, name string, name_he string, subtitle string, category string")
    postings = X.build_postings(frame, ("name", "name_he", "subtitle"), ())
    asked = [(i, q, rng.choice([1, 5, 7, 20])) for i, q in enumerate(["a", "x1", "ab b", "cafe dab", "c e x", "ba ba", "zz", "zz a", "x12 east bar cab", "", "abc", "b c"])]
    queries = spark.createDataFrame(asked, "query_id long, query string, limit int")
    effort = []
    got = {}
    for r in X.best_matches(queries, postings, effort).collect():
        got.setdefault(r["query_id"], {})[r["place_id"]] = r["_relevance"]
    matches, plain = 0, 0
    for number, query, limit in asked:
        want, n = brute(places, query, max(50, 8 * limit)) if query else ({}, 0)
        assert got.get(number, {}) == want, query
        matches += n
        plain += n if len(query.split()) == 1 else 0
    scored = [r["query_id"] for t in effort for r in t.collect()]
    single = {number for number, query, _ in asked if len(query.split()) == 1}
    assert len(scored) < 0.6 * matches and sum(q in single for q in scored) < 0.4 * plain
    everything = {(r["query_id"], r["place_id"]) for r in X.match(queries, postings).collect()}
    assert len(everything) == matches


def test_hot_word_is_dealt_over_tasks(spark):
    frame = spark.range(3000).select(F.col("id").alias("place_id"), F.lit("the").alias("name"), *[F.lit(None).cast("string").alias(n) for n in ("name_he", "subtitle", "category")])
    postings = X.build_postings(frame, ("name", "name_he", "subtitle"), ())
    hits = X.token_hits(spark.createDataFrame([("t",), ("the",), ("thee",)], "token string"), postings)
    assert {(r["token"], r["count"]) for r in hits.groupBy("token").count().collect()} == {("t", 3000), ("the", 3000)}
