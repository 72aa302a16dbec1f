"""Quality rules as weak supervision: rules vote or abstain, EM estimates how good each is, the posterior decides.

Each rule looks at one figure of a text and votes good, bad or not at all. The votes of all documents are counted by
pattern (at most 3^rules patterns, however many documents), and expectation-maximisation over the patterns estimates
for each rule how often it votes which way on good and on bad documents, and the share of good ones. Documents that
fail the base (too short, or repeats) are decided already and don't take part. A document's
verdict is the posterior of its pattern. Figures are taken from whole texts where they are read; they are written to
the shared folder once, small, because both the estimate and the verdicts need them.

Defined results: a null or empty text has no words and fails the base; a document on which every rule abstains gets
the prior; an empty table gives no rows; repeated rows each get their result; extra columns are left aside.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_column, kept, per_text

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_POSTERIOR = 0.5
ROUNDS = 200
MAX_FALSE_ALARM = 0.02
#: First guess of a rule's votes (bad, none, good) on bad and on good documents, and how many documents it counts for.
START = ((0.3, 0.1, 0.6), (0.02, 0.18, 0.8))
PRIOR_DOCS = 5.0

FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_distinct", "n_shouts", "n_bars",
    "n_ends", "n_stutter",
)
_STRUCT = pa.struct([(name, pa.int64()) for name in FIGURES])

_BLANKS = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(b for b in range(256) if b >= 128 or not chr(b).isalpha())
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence too."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(count, np.uint64)
        for i in range(window):
            rolled = (rolled ^ (rolled >> np.uint64(29))) * _BASE + hashes[i : i + count]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(count, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.nonzero(twice)[0]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    count = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            count += line in seen
            seen.add(line)
    return count


def figures(text: str) -> dict:
    data = text.encode("utf-8", "replace")
    words = data.split()
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, _BLANKS)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
        "n_upper": len(data) - len(data.translate(None, _UPPER)),
        "n_letters": len(data.translate(None, _NOT_LETTERS)),
        "n_distinct": len(set(words)),
        "n_shouts": text.count("!"),
        "n_bars": text.count("|"),
        "n_stutter": sum(map(eq, words, words[1:])),
        "n_ends": text.count(". ") + text.count(".\n") + text.endswith("."),
    }




def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, figures), one row for each row of the documents."""
    kind = "struct<" + ", ".join(f"{name}: bigint" for name in FIGURES) + ">"
    return docs.select("doc_id", arrow_column(per_text(figures, _STRUCT), kind, F.col("text")).alias("_f")).select("doc_id", "_f.*")


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 none."""
    symbols = _ratio("n_symbols", "n_words")
    lines = _ratio("n_dup_lines", "n_words")
    repeats = _ratio("n_repeat_words", "n_words")
    length = _ratio("word_chars", "n_words")
    upper = _ratio("n_upper", "n_letters")
    distinct = _ratio("n_distinct", "n_words")
    shouts = _ratio("n_shouts", "n_words")
    bars = _ratio("n_bars", "n_words")
    ends = _ratio("n_ends", "n_words")
    stutter = _ratio("n_stutter", "n_words")
    few = F.col("n_words") < MIN_WORDS
    return {
        "symbols": _vote(symbols, symbols < 0.02, symbols > 0.1),
        "dup_lines": _vote(lines, lines < 0.002, lines > 0.03),
        "repeats": _vote(repeats, repeats < 0.05, repeats > 0.3),
        "word_length": _vote(length, length.between(3, 10), (length < 2) | (length > 15)),
        "upper": _vote(upper, upper < 0.15, upper > 0.4),
        "distinct": F.when(few, 0).otherwise(_vote(distinct, distinct > 0.25, distinct < 0.12)),
        "shouts": _vote(shouts, shouts < 0.02, shouts > 0.2),
        "bars": _vote(bars, bars < 0.01, bars > 0.2),
        "stutter": _vote(stutter, stutter < 0.03, stutter > 0.2),
        "sentences": F.when(few, 0).otherwise(_vote(ends, ends > 0.01, ends < 0.002)),
    }


def posteriors(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    logs = np.log(table)
    rules = np.arange(patterns.shape[1])
    bad, good = (logs[c][rules, patterns + 1].sum(1) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad - good + math.log((1 - share) / share), -700, 700)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(share of good documents, class x rule x vote probabilities) from vote patterns and their counts.

    Starts from START: good documents hardly ever get a bad vote, bad ones get some and good votes from the rules that
    look at something else. A rule's false alarms on good documents stay at MAX_FALSE_ALARM at most, which is what the
    rules are made for and keeps the good class from taking in what only one rule sees.
    """
    rules = patterns.shape[1]
    start = np.repeat(np.array(START)[:, None, :], rules, 1)
    table, share = start.copy(), 0.5
    before = None
    for _ in range(rounds):
        good = posteriors(patterns, share, table)
        if before is not None and np.max(np.abs(good - before), initial=0) < 1e-9:
            break
        before = good
        share = float(np.clip(((good * counts).sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            for r in range(rules):
                table[c, r] = np.bincount(patterns[:, r] + 1, weight, 3) + PRIOR_DOCS * start[c, r]
            table[c] /= table[c].sum(1, keepdims=True)
        alarms = np.minimum(table[1, :, :1], MAX_FALSE_ALARM)
        table[1] = np.concatenate([alarms, table[1, :, 1:] * (1 - alarms) / table[1, :, 1:].sum(1, keepdims=True)], 1)
    return share, table


def judge(docs: DataFrame, keep: float = KEEP_POSTERIOR) -> DataFrame:
    """(doc_id, figures, base_failed, posterior, kept), one row for each row of the documents."""
    spark = docs.sparkSession
    rules = votes()
    code = sum(((vote + 1) * F.lit(3**i) for i, vote in enumerate(rules.values())), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    figured = kept(measured(docs).withColumn("_code", code.cast("int")).withColumn("base_failed", failed), "figures")
    # at most 3^rules rows; the method learns from what the base leaves to it
    counted = figured.groupBy("_code").agg(F.count(F.when(~F.col("base_failed"), 1))).collect()
    codes = np.array([r[0] for r in counted], np.int64)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(rules))], 1) if len(codes) else np.zeros((0, len(rules)), np.int64)
    posterior = posteriors(patterns, *estimate(patterns, np.array([r[1] for r in counted], float)))
    verdicts = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posterior, strict=True)], "_code int, posterior double")
    return (
        figured.join(F.broadcast(verdicts), "_code")  # one row for each vote pattern
        .select("doc_id", *FIGURES, "base_failed", "posterior")
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))
    )
