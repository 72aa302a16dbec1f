"""Bilingual place search: index build, prefix-AND matching, relevance and proximity ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geo import haversine_m
from pathloom.functions.rules import in_categories
from pathloom.functions.text import fold_text
from pathloom.operators.rounds import RoundState, dealt
from pathloom.operators.selection import top_k

c = F.col

WORDS = "([\\p{L}\\p{N}]+)"
# relevance constants of the usual full-text ranking: saturation, length normalisation, least term weight
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
#: Blocks of a token's postings to a unit of impact, and tasks that share the postings of one word.
LEVELS, SPREAD = 32, 8
#: Places whose words one task counts; a place has some ten of them.
PLACES_PER_TASK = 50_000


def _words(text):
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(1))


def build_postings(places: DataFrame, fields: tuple[str, ...] = ("name", "name_he", "subtitle"), plain: tuple[str, ...] = ("category",)) -> DataFrame:
    """(term, place_id, tf, doc_len). ``plain`` fields are only lower-cased, the others folded."""
    folded = F.concat_ws(" ", fold_text(F.concat_ws(" ", *fields)), *[F.lower(p) for p in plain])
    # dealt by place first: a place's words are counted where they are cut
    words = dealt(places, "place_id", rows=PLACES_PER_TASK).select("place_id", _words(folded).alias("_w"))
    exploded = words.select("place_id", F.size("_w").alias("doc_len"), F.explode("_w").alias("term"))
    return exploded.groupBy("term", "place_id").agg(F.count("*").alias("tf"), F.first("doc_len").cast("long").alias("doc_len"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token_no, token, n_tokens); queries without any word have no rows."""
    tokens = queries.select("query_id", _words(fold_text("query")).alias("_t"))
    return tokens.select("query_id", F.size("_t").alias("n_tokens"), F.posexplode("_t").alias("token_no", "token"))


def token_hits(tokens: DataFrame, postings: DataFrame) -> DataFrame:
    """(token, place_id, tf, doc_len): occurrences of any word behind each distinct token count as its occurrences.

    The vocabulary is cut to the lengths that tokens have, so a token meets its words by equality. Postings of one
    word are dealt over several tasks.
    """
    asked = tokens.select("token").distinct()
    lengths = [row[0] for row in asked.select(F.length("token")).distinct().collect()]
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("term"))
    heads = postings.select("term").distinct().select("term", F.explode(fitting).alias("_n"))
    behind = heads.select("term", c("term").substr(F.lit(1), c("_n")).alias("token")).join(asked, "token")
    dealt = behind.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = postings.withColumn("_part", F.pmod(F.xxhash64("place_id"), F.lit(SPREAD)).cast("int")).join(dealt, ["term", "_part"])
    return met.groupBy("token", "place_id").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len"))


def _with_impact(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """Hits with ``norm``, what the term frequency is divided by, and ``impact``, their score without the token's weight."""
    stats = postings.groupBy("place_id").agg(F.first("doc_len").alias("_l")).agg(F.count("*").alias("n_docs"), F.avg("_l").alias("avg_len"))
    rated = hits.crossJoin(F.broadcast(stats)).withColumn("norm", c("tf") + K1 * (1 - B + B * c("doc_len") / c("avg_len")))
    return rated.withColumn("impact", c("tf") * (K1 + 1) / c("norm")).drop("doc_len", "avg_len")


def _weight(n_docs, df):
    return F.greatest(F.lit(MIN_IDF), F.log((n_docs - df + 0.5) / (df + 0.5)))


def match(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, place_id, score) of all places holding, for every token, a word that starts with it."""
    tokens = query_tokens(queries)
    hits = RoundState(queries.sparkSession, "hits").keep(_with_impact(token_hits(tokens, postings), postings), "all")
    weights = hits.groupBy("token").agg(_weight(F.first("n_docs"), F.count("*")).alias("idf"))
    scored = tokens.join(weights, "token").join(hits, "token").withColumn("_s", c("idf") * c("tf") * (K1 + 1) / c("norm"))
    total = scored.groupBy("query_id", "n_tokens", "place_id").agg(F.count("*").alias("_n"), F.sum("_s").alias("score"))
    return total.filter(c("_n") == c("n_tokens")).select("query_id", "place_id", "score")


def best_matches(queries: DataFrame, postings: DataFrame, effort: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, place_id, score, _relevance) of each query's best ``max(8 * limit, 50)`` matches.

    A token's postings lie in blocks of like impact, each with its greatest one. A query is led by its rarest token.
    The lead's best blocks, for about twice the places that are wanted, are scored first; the last wanted score among
    them is a bound. Of the lead's other blocks only those are scored whose greatest impact, with the other tokens'
    greatest, can still reach it. So what is scored follows the places wanted, not all that match; ``effort`` gets the
    tables of (query_id, place_id) that were scored.
    """
    state = RoundState(queries.sparkSession, "ranked")
    tokens = query_tokens(queries)
    # limits go up to 20, so 160 is the deepest any query looks
    depth = queries.select("query_id", F.greatest(F.lit(50), c("limit") * 8).alias("depth"))
    leveled = _with_impact(token_hits(tokens, postings), postings).withColumn("level", F.floor(c("impact") * LEVELS))
    hits = state.keep(leveled, "hits")
    blocks = state.keep(hits.groupBy("token", "level").agg(F.count("*").alias("n"), F.max("impact").alias("top"), F.first("n_docs").alias("n_docs")), "blocks")
    weights = blocks.groupBy("token").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.first("n_docs").alias("n_docs"))
    weighed = tokens.join(weights, "token").withColumn("idf", _weight(c("n_docs"), c("df"))).withColumn("most", c("idf") * c("top"))
    weighed = weighed.select("query_id", "token_no", "n_tokens", "token", "df", "idf", "most")
    lead = weighed.groupBy("query_id", "n_tokens").agg(F.count("*").alias("_k"), F.sum("most").alias("_all"), F.min(F.struct("df", "token_no", "token", "idf", "most")).alias("_l"))
    lead = lead.filter(c("_k") == c("n_tokens")).select("query_id", "n_tokens", "_l.token_no", "_l.token", "_l.idf", (c("_all") - c("_l.most")).alias("others"))
    lead = lead.join(depth, "query_id")
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(c("level").desc()))
    ladder = lead.join(blocks.select("token", "level", "n", "top"), "token").withColumn("_before", upto - c("n"))
    ladder = state.keep(ladder.withColumn("early", c("_before") < 2 * c("depth")), "ladder")

    def scored(chosen: DataFrame) -> DataFrame:
        """Scores of the places in some of the leads' blocks that hold all other tokens as well."""
        led = chosen.select("query_id", "n_tokens", "token_no", "token", "level", "idf").join(hits, ["token", "level"])
        first = led.select("query_id", "n_tokens", "token_no", "place_id", (c("idf") * c("tf") * (K1 + 1) / c("norm")).alias("_s"))
        further = first.select("query_id", c("token_no").alias("_lead"), "place_id", "n_tokens").join(weighed.select("query_id", "token_no", "token", "idf"), "query_id")
        further = further.filter(c("token_no") != c("_lead")).join(hits.select("token", "place_id", "tf", "norm"), ["token", "place_id"])
        rest = further.select("query_id", "n_tokens", "token_no", "place_id", (c("idf") * c("tf") * (K1 + 1) / c("norm")).alias("_s"))
        total = first.union(rest).groupBy("query_id", "n_tokens", "place_id").agg(F.count("*").alias("_n"), F.sum("_s").alias("score"))
        return total.select("query_id", "place_id", "score", (c("_n") == c("n_tokens")).alias("whole"))

    early = state.keep(scored(ladder.filter("early")), "early")
    ranked = top_k(early.filter("whole"), ["query_id"], [c("score").desc()], 160, "_r").join(depth, "query_id")
    bound = ranked.filter(c("_r") == c("depth")).select("query_id", c("score").alias("_bound"))
    late = ladder.filter(~c("early")).join(bound, "query_id", "left")
    # room for rounding: equal scores are told apart by place
    late = scored(late.filter(c("_bound").isNull() | (c("idf") * c("top") + c("others") >= c("_bound") - 1e-8)))
    if effort is not None:
        effort += [early, late]
    both = early.union(late).filter("whole").withColumn("_round", F.round("score", 9)).join(depth, "query_id")
    best = top_k(both, ["query_id"], [c("_round").desc(), c("place_id")], 160, "_relevance")
    return best.filter(c("_relevance") <= c("depth")).select("query_id", "place_id", "score", "_relevance")


def search(queries: DataFrame, places: DataFrame, postings: DataFrame) -> DataFrame:
    """Ranked results. Queries: (query_id, query, limit, category or null, lat, lon or null).

    The best ``max(8 * limit, 50)`` matches by relevance are taken first; category and proximity only see those.
    """
    asked = queries.select("query_id", "limit", c("category").alias("wanted"), c("lat").alias("q_lat"), c("lon").alias("q_lon"))
    best = best_matches(queries, postings).join(asked, "query_id")
    detail = best.join(places.select("place_id", "category", "lat", "lon"), "place_id")
    kept = detail.filter(in_categories(c("category"), c("wanted")))
    near = F.when(c("q_lat").isNotNull(), F.round(haversine_m(c("lat"), c("lon"), c("q_lat"), c("q_lon")), 6))
    ranked = top_k(kept.withColumn("_near", near), ["query_id"], [c("_near"), c("_relevance")], 20)
    return ranked.filter(c("rank") <= c("limit")).select("query_id", "place_id", "rank")


def _grams(text):
    """All distinct substrings of one to three characters."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(text)),
                lambda i: F.array(*[F.substr(text, i, F.lit(n)) for n in (1, 2, 3)]),
            )
        )
    )


def offline_search(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Substring search on names: the first 20 places by id, then the nearest 8 by squared degrees.

    The first three characters of a pattern are looked up among the substrings of the names; the full pattern is
    tested on those places only.
    """
    asked = queries.withColumn("_p", F.lower(F.trim("query"))).withColumn("_gram", F.substring("_p", 1, 3))
    named = places.withColumn("_n", F.lower("name"))
    grams = named.select(
        "place_id", F.explode(F.array_distinct(F.concat(_grams(c("_n")), F.coalesce(_grams(c("name_he")), F.array().cast("array<string>"))))).alias("_gram")
    )
    hits = grams.join(asked.filter(c("_p") != ""), "_gram").join(named, "place_id")
    hits = hits.filter(c("_n").contains(c("_p")) | F.coalesce(c("name_he").contains(c("_p")), F.lit(False)))
    first = top_k(hits, ["query_id"], [c("place_id")], 20, "_first")
    squared = (c("lat") - c("q_lat")) * (c("lat") - c("q_lat")) + (c("lon") - c("q_lon")) * (c("lon") - c("q_lon"))
    return top_k(first.withColumn("_d", squared), ["query_id"], [c("_d"), c("place_id")], 8).select("query_id", "place_id", "rank")
