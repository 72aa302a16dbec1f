"""URL filters: host and path rules, and for urls that no rule fits a naive Bayes over words found in hosts and paths.

Hosts often run words together. A unigram model of the words in the pages' texts splits every part of a host into its
likeliest words (Viterbi). A multinomial naive Bayes over these words and the path's tokens learns from the urls that
rules decide and judges the others.

Work follows distinct values: host parts are split once, hosts and paths (digits as 0) are scored once, and pages are
joined to both with salted keys, since one host may hold a third of all pages. The words that can occur in a part are
found by an equi-join of its substrings, as long as the longest word, with the word counts, so no vocabulary is sent
around.

Defined results: a null url, or one without `://`, has an empty host and path; empty hosts have no tokens; without
rule-decided urls the method allows; repeated rows each get their verdict; extra columns are left aside.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_column, kept, salted_join

RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    host, path = (F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def word_counts(texts: Column, frame: DataFrame) -> DataFrame:
    """(word, n): the letters-only words of marked-up texts, lower-cased."""
    plain = F.regexp_replace(F.lower(texts), r"<[^>]*>|[^\p{L}]+", " ")
    return frame.select(F.explode(F.split(plain, " +")).alias("word")).filter("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def segment(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a part: known words by their share, unknown runs at a price that grows with their length.

    Of all beginnings of an unknown run up to a place, the best one stays the best further on, so it is kept along the
    way; known words are tried by their lengths. Of equal choices the longest last word wins.
    """
    lengths = sorted({len(word) for word in counts}, reverse=True)
    per_letter, unknown = math.log(10), math.log(1 / (total + 1))
    best, begin = [0.0], [0]
    run, run_start = 0.0, 0
    for end in range(1, len(part) + 1):
        cost, start = unknown + run - end * per_letter, run_start
        for length in lengths:
            if length <= end and (n := counts.get(part[end - length : end])):
                known = best[end - length] + math.log(n / total)
                if known > cost or (known == cost and end - length < start):
                    cost, start = known, end - length
        best.append(cost)
        begin.append(start)
        if cost + end * per_letter > run:
            run, run_start = cost + end * per_letter, end
    words, end = [], len(part)
    while end:
        words.append(part[begin[end] : end])
        end = begin[end]
    return words[::-1]


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for distinct hosts."""
    total, longest_word = counts.agg(F.sum("n"), F.max(F.length("word"))).first()
    total = total or 1
    parts = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"([^.\-_0-9]+)"), F.lit(1))).alias("at", "part"))
    single = parts.select("part").distinct()
    starts = single.select("part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("i"))
    longest = F.least(F.lit(longest_word or 1), F.length("part") - F.col("i") + 1)
    runs = starts.select("part", "i", F.explode(F.sequence(F.lit(1), longest)).alias("l")).select("part", F.expr("substring(part, i, l)").alias("word")).distinct()
    known = runs.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches):
        for batch in batches:
            rows = (row.as_py() for row in batch)
            yield pa.array([segment(r["part"], {k["word"]: k["n"] for k in r["known"] or ()}, total) for r in rows], pa.list_(pa.string()))

    words = single.join(known, "part", "left").select("part", arrow_column(split, "array<string>", F.struct("part", "known")).alias("words"))
    placed = salted_join(parts, words, ["part"], F.col("host"))
    listed = placed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
    return listed.select("host", F.flatten(F.col("w.words")).alias("words"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds), one row for each page; log_odds above 0 says block."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    judged = split.withColumn("rule", rule).withColumn("_says", says).withColumn("_shape", F.regexp_replace("path", "[0-9]+", "0"))
    tally = [
        F.count(F.when(F.col("_says") == "block", 1)).alias("b"), F.count(F.when(F.col("_says") == "allow", 1)).alias("a"),
    ]
    by_host = kept(judged.groupBy("host").agg(*tally), "url-hosts")
    by_path = judged.groupBy("_shape").agg(*tally)
    counts = kept(word_counts(F.col("html"), pages), "url-words") if "html" in pages.columns else word_counts(F.col("url"), pages)
    host_words = segmented(by_host.select("host"), counts)
    host_tokens = by_host.join(host_words, "host").select(
        F.col("host").alias("of"), F.lit("h").alias("kind"), F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("token"), "b", "a"
    )
    path_tokens = by_path.select(
        F.col("_shape").alias("of"), F.lit("p").alias("kind"),
        F.explode(F.transform(F.regexp_extract_all("_shape", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.concat(F.lit("p:"), w))).alias("token"), "b", "a",
    )
    tokens = kept(host_tokens.union(path_tokens), "url-tokens")
    table = tokens.groupBy("token").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    seen, blocked, allowed = table.agg(F.count("*"), F.sum("b"), F.sum("a")).first()
    classes = by_host.agg(F.sum("b"), F.sum("a")).first()
    blocked, allowed, seen = blocked or 0, allowed or 0, seen or 1
    prior = math.log(((classes[0] or 0) + 0.5) / ((classes[1] or 0) + 1))
    weight = F.log((F.col("b") + 1) / F.lit(blocked + seen)) - F.log((F.col("a") + 1) / F.lit(allowed + seen))
    scored = salted_join(tokens.select("of", "kind", "token"), table.select("token", weight.alias("w")), ["token"], F.col("of"))
    sums = scored.groupBy("of", "kind").agg(F.sum("w").alias("w"))
    hosts = sums.filter("kind = 'h'").select(F.col("of").alias("host"), F.col("w").alias("_hw"))
    paths = sums.filter("kind = 'p'").select(F.col("of").alias("_shape"), F.col("w").alias("_pw"))
    # any column may hold nulls, so the row itself spreads a hot host
    out = salted_join(judged, hosts, ["host"], F.struct("page_id", "path"), "left")
    out = salted_join(out, paths, ["_shape"], F.struct("page_id", "host"), "left")
    odds = F.round(F.lit(prior) + F.coalesce("_hw", F.lit(0.0)) + F.coalesce("_pw", F.lit(0.0)), 6)
    return out.select("page_id", "host", "path", "rule", "_says", odds.alias("log_odds")).select(
        "page_id", "host", "path", "rule", F.coalesce("_says", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds"
    )
