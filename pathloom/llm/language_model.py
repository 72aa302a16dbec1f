"""Quality classifier: an interpolated modified Kneser-Ney model of letter n-grams, trained on trusted texts.

Letters are code points of 21 bits; an n-gram of up to five is two longs (three letters in the lower one), so its
context is a shift and its shorter n-gram a mask; inside a task n-grams are told apart by a 64-bit hash of both. Counts are taken over all trusted texts and summed in shuffles by
n-gram; continuation counts, context totals and discounts follow by aggregation, and every n-gram's probability by
joins of the count tables on context and shorter n-gram, order by order.

Documents are scored where they are read. The probability table goes to the executors in shards by the last two
letters of the context, which hold all that a position can ask for; a shard has at most about SHARD_ROWS entries, and a
larger table takes a pass for each shard, whose sums are added up by document.

A document is kept if its perplexity is at most a quantile of the trusted documents' perplexities in its language. For
that quantile the trusted documents are dealt into FOLDS folds by a hash of doc_id, and each fold is scored by a model
of the others, as a document not trained on would be; these models are made side by side from one table
of counts by fold. Trusted documents with no others to be scored by take the whole model. Perplexities are drawn towards the language's mean as if PRIOR_LETTERS letters more had been read, so that
short texts are not judged by a few letters.

Defined results: a null or empty text has no letters, perplexity null, and is kept; a null language is a language of
its own; a language without trusted documents takes the threshold over all of them; without any trusted text
everything is kept; rows alike in doc_id and text get the same result; extra columns are left aside.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import SLICE_CHARS, arrow_column, blocks_for, in_slices, kept, salted_join, slices, small_batches, with_key

ORDER = 5
BITS = 21
IN_LONG = 3
SHARD_ROWS = 4_000_000
#: Labels sent to all executors at most; more are joined by a shuffle.
MAX_SENT_LABELS = 1_000_000
QUANTILE = 0.995
#: Folds of trusted documents; the model without a fold bears its number, the model of all of them WHOLE.
FOLDS = 4
WHOLE = -1
PRIOR_LETTERS = 100

_MASK = [(1 << (BITS * n)) - 1 for n in range(IN_LONG + 1)]
_KEY = "struct<hi: bigint, lo: bigint>"
_SUM = pa.struct([("bits", pa.float64()), ("n", pa.int64())])


def letter_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1  # 0 stands before the text


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of full order for every letter as a row of two longs, text it is in)."""
    codes = [letter_codes(t) for t in texts]
    before = np.zeros(ORDER - 1, np.int64)
    line = np.concatenate([x for c in codes for x in (before, c)]) if codes else before
    sizes = np.array([len(c) for c in codes], np.int64)
    grams = np.zeros((len(line), 2), np.int64)
    for back in range(ORDER):
        grams[back:, 1 - back // IN_LONG] |= line[: len(line) - back] << (BITS * (back % IN_LONG))
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    places = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return grams[places], np.repeat(np.arange(len(texts)), sizes)


def _hashed(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram, without collisions up to three letters."""
    high, low = grams[:, 0].astype(np.uint64), grams[:, 1].astype(np.uint64)
    mixed = high * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return low * np.uint64(0x94D049BB133111EB) + (mixed ^ (mixed >> np.uint64(32)))


def _last(grams: np.ndarray, order: int) -> np.ndarray:
    """The last letters of n-grams."""
    out = grams.copy()
    out[:, 0] &= _MASK[max(0, order - IN_LONG)]
    out[:, 1] &= _MASK[min(order, IN_LONG)]
    return out


def _before(grams: np.ndarray) -> np.ndarray:
    """The n-grams without their last letter."""
    out = grams >> BITS
    out[:, 1] |= (grams[:, 0] & _MASK[1]) << (BITS * (IN_LONG - 1))
    return out


def _last_of(gram: str, order: int) -> Column:
    high, low = (F.col(f"{gram}.{x}").bitwiseAND(F.lit(_MASK[n]).cast("long")) for x, n in (("hi", max(0, order - IN_LONG)), ("lo", min(order, IN_LONG))))
    return F.struct(high.alias("hi"), low.alias("lo"))


def _before_of(gram: str) -> Column:
    carried = F.shiftleft(F.col(f"{gram}.hi").bitwiseAND(F.lit(_MASK[1]).cast("long")), BITS * (IN_LONG - 1))
    return F.struct(F.shiftright(f"{gram}.hi", BITS).alias("hi"), F.shiftright(f"{gram}.lo", BITS).bitwiseOR(carried).alias("lo"))


def _counts(batches):
    for batch in batches:
        folds, at = batch.column(0).to_numpy(), 0
        for part, _ in slices([batch.column(1)], SLICE_CHARS):
            mine, at = folds[at : at + len(part)], at + len(part)
            for fold in np.unique(mine):
                grams = text_grams([t for t, f in zip(part, mine, strict=True) if f == fold])[0]
                _, places, counts = np.unique(_hashed(grams), return_index=True, return_counts=True)
                found = [pa.array(np.full(len(places), fold, np.int32)), *(pa.array(grams[places, i], pa.int64()) for i in (0, 1)), pa.array(counts.astype(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(found, ["fold", "hi", "lo", "c"])


def _by_fold(values: dict[int, Column]) -> Column:
    return F.coalesce(*(F.when(F.col("fold") == fold, value) for fold, value in values.items()))


def _discounts(table: DataFrame) -> dict[int, tuple[float, float, float]]:
    """What is taken off counts of one, two and more, by fold."""
    out = {}
    for row in table.groupBy("fold").agg(*(F.count(F.when(F.col("c") == i, 1)) for i in range(1, 5))).collect():
        n1, n2, n3, n4 = (float(x) for x in row[1:])
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        taken = [i - (i + 1) * y * b / a if a else 0.5 * i for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        out[row[0]] = tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(taken, 1))
    return out


def train(texts: DataFrame, name: str = "text", fold: Column | None = None) -> DataFrame | None:
    """The model as rows (fold, kind, order, key, value): kind p, log2 probability of an n-gram; kind g, log2 back-off of
    a context. With a column that deals texts into FOLDS folds, also the models without each fold."""
    small_batches()
    counted = texts.select((F.lit(0) if fold is None else fold).cast("int").alias("fold"), F.coalesce(name, F.lit(""))).mapInArrow(_counts, "fold int, hi long, lo long, c long")
    left_out = [F.sum(F.when(F.col("fold") != f, F.col("c")).otherwise(0)) for f in range(FOLDS if fold is not None else 0)]
    models = F.array(*(F.struct(F.lit(f).alias("fold"), c.alias("c")) for f, c in enumerate([F.sum("c"), *left_out], WHOLE)))
    top = kept(counted.groupBy("hi", "lo").agg(models.alias("m")).select(F.struct("hi", "lo").alias("gram"), F.inline("m")).filter("c > 0"), "kn-counts")
    tables = {ORDER: top}
    for order in range(ORDER - 1, 0, -1):
        # in how many ways an n-gram is continued to the left
        above = tables[order + 1]
        tables[order] = kept(above.groupBy("fold", _last_of("gram", order).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
    symbols = dict(tables[1].groupBy("fold").count().collect())
    if not symbols:
        return None
    rows: list[DataFrame] = []
    shorter = None
    for order in range(1, ORDER + 1):
        table = tables[order]
        taken = _by_fold({f: F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3) for f, (d1, d2, d3) in _discounts(table).items()})
        keyed = table.withColumn("context", _before_of("gram")).withColumn("d", taken)
        contexts = keyed.groupBy("fold", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("loss"))
        if order == 1:
            sums = {r["fold"]: r for r in contexts.collect()}  # one row a fold
            unseen = {f: r["loss"] / r["total"] / (symbols[f] + 1) for f, r in sums.items()}
            found = table.select("fold", "gram", _by_fold({f: (F.col("c") - taken) / r["total"] + unseen[f] for f, r in sums.items()}).alias("p"))
            zero = [(f, "p", 0, (0, 0), float(np.log2(u))) for f, u in unseen.items()]
            rows.append(texts.sparkSession.createDataFrame(zero, f"fold int, kind string, order int, key {_KEY}, value double"))
        else:
            below = shorter.select("fold", F.col("gram").alias("_short"), F.col("p").alias("_p"))
            joined = keyed.join(contexts, ["fold", "context"]).withColumn("_short", _last_of("gram", order - 1)).join(below, ["fold", "_short"])
            found = joined.select("fold", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("loss") / F.col("total") * F.col("_p")).alias("p"))
            rows.append(contexts.select("fold", F.lit("g"), F.lit(order), "context", F.log2(F.col("loss") / F.col("total"))))
        shorter = kept(found, "kn-p")
        rows.append(shorter.select("fold", F.lit("p"), F.lit(order), "gram", F.log2("p")))
    return kept(reduce(DataFrame.union, rows), "kn-model")


def _shard(key: Column, order: Column, kind: Column, shards: int) -> Column:
    """Shard of an entry: its context's last two letters; -1 for short ones, which every shard has."""
    pair = F.when(kind == "p", _before_of("key")["lo"]).otherwise(key["lo"]).bitwiseAND(F.lit(_MASK[2]))
    return F.when(order >= 3, pair % shards).otherwise(-1)


class Tables:
    """One shard of the model as sorted arrays."""

    def __init__(self, rows: pa.Table) -> None:
        kinds = np.asarray(rows.column("kind").to_pylist(), object) == "p"
        orders, values = (rows.column(c).to_numpy() for c in ("order", "value"))
        high, low = rows.column("key").combine_chunks().flatten()
        keys = _hashed(np.stack([high.to_numpy(), low.to_numpy()], 1))
        self.tables = {}
        for kind in (True, False):
            for order in range(ORDER + 1):
                mine = (kinds == kind) & (orders == order)
                ranked = np.argsort(keys[mine])
                self.tables[kind, order] = keys[mine][ranked], values[mine][ranked]

    def look(self, kind: bool, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0)."""
        known, values = self.tables[kind, order]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[place] == keys
        return found, np.where(found, values[place], 0.0)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last letter of each n-gram."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            keys = _last(grams[left], order)
            found, value = self.look(True, order, _hashed(keys))
            out[left[found]] += value[found]
            left, keys = left[~found], keys[~found]
            if order > 1:
                out[left] += self.look(False, order, _hashed(_before(keys)))[1]
        out[left] += self.tables[True, 0][1][0]
        return -out


def _scored(texts: list[str], tables: Tables, shards: int, shard: int) -> list[dict]:
    grams, owner = text_grams(texts)
    if shards > 1:
        mine = (_before(grams)[:, 1] & _MASK[2]) % shards == shard
        grams, owner = grams[mine], owner[mine]
    _, places, back = np.unique(_hashed(grams), return_index=True, return_inverse=True)
    bits = np.bincount(owner, tables.bits(grams[places])[back], len(texts)) if len(grams) else np.zeros(len(texts))
    counts = np.bincount(owner, minlength=len(texts))
    return [{"bits": float(b), "n": int(n)} for b, n in zip(bits, counts, strict=True)]


def score(docs: DataFrame, model: DataFrame, shard_rows: int = SHARD_ROWS, fold: int = WHOLE) -> DataFrame:
    """(doc_id, lang, bits, n): the documents' total -log2 probability and letters, one row for each row."""
    spark: SparkSession = docs.sparkSession
    model = model.filter(F.col("fold") == fold)
    shards = blocks_for(model.count(), shard_rows)
    shard_of = _shard(F.col("key"), F.col("order"), F.col("kind"), shards)

    def passed(number: int) -> DataFrame:
        entries = model.filter(shard_of.isin(-1, number)) if shards > 1 else model
        tables = spark.sparkContext.broadcast(Tables(entries.toArrow()))
        summed = in_slices(lambda texts: _scored(texts, tables.value, shards, number), _SUM)
        keyed = with_key(docs.select("doc_id", "lang", "text"))
        return keyed.select("doc_id", "lang", "_doc", "_text", arrow_column(summed, "struct<bits: double, n: bigint>", F.col("text")).alias("_s"))

    if shards == 1:
        return passed(0).select("doc_id", "lang", "_s.bits", "_s.n")
    parts = [kept(passed(n).select("_doc", "_text", "_s.bits", "_s.n").dropDuplicates(["_doc", "_text"]), "kn-scores") for n in range(shards)]
    total = reduce(DataFrame.union, parts).groupBy("_doc", "_text").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n"))
    return with_key(docs.select("doc_id", "lang", "text")).drop("text").join(total, ["_doc", "_text"]).select("doc_id", "lang", "bits", "n")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def fold_of(doc_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def _with_trusted(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    few = trusted.count() <= MAX_SENT_LABELS
    return docs.join(F.broadcast(trusted) if few else trusted, "doc_id", how)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, n_letters, perplexity, judged, threshold, kept), one row for each row of the documents.

    ``judged`` is the perplexity drawn towards the language's mean by PRIOR_LETTERS letters, so that a few letters don't
    decide; a document is kept if it is no more than the threshold.
    """
    trusted = kept(trusted_ids(labels), "trusted")
    texts = _with_trusted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), trusted, "left_semi")
    model = train(texts, fold=fold_of("doc_id"))
    none = F.lit(None).cast("double")
    if model is None:
        return docs.select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_letters"), none.alias("perplexity"), none.alias("judged"), none.alias("threshold"), F.lit(True).alias("kept"))
    scored = kept(score(docs, model, shard_rows).withColumn("_lang", F.coalesce("lang", F.lit(""))), "kn-scores")
    modelled = {r[0] for r in model.select("fold").distinct().collect()}
    unseen = [score(texts.filter(fold_of("doc_id") == f), model, shard_rows, f if f in modelled else WHOLE) for f in range(FOLDS)]
    marked = kept(reduce(DataFrame.union, unseen).filter("n > 0").withColumn("_lang", F.coalesce("lang", F.lit(""))), "kn-unseen")
    whole = marked.agg(F.sum("bits"), F.sum("n")).first()
    mean_all = (whole[0] or 0.0) / (whole[1] or 1)
    means = kept(marked.groupBy("_lang").agg((F.sum("bits") / F.sum("n")).alias("_mean")), "kn-means")

    def drawn(frame: DataFrame) -> DataFrame:
        mean = F.coalesce("_mean", F.lit(mean_all))
        return salted_join(frame, means, ["_lang"], F.struct("bits", "n"), "left").withColumn("_h", (F.col("bits") + PRIOR_LETTERS * mean) / (F.col("n") + PRIOR_LETTERS))

    cut = F.percentile_approx("_h", quantile, 10_000)
    rated = kept(drawn(marked).select("_lang", "_h"), "kn-trusted")
    limits = rated.groupBy("_lang").agg(cut.alias("_limit"))
    limit_all = rated.agg(cut).first()[0]
    out = salted_join(drawn(scored), limits, ["_lang"], F.struct("bits", "n"), "left")
    limit = F.coalesce("_limit", F.lit(limit_all))

    def perplexity(bits: Column) -> Column:
        return F.when(F.col("n") > 0, F.round(F.pow(F.lit(2.0), bits), 4))

    rows = out.select(
        "doc_id", "lang", F.col("n").alias("n_letters"), perplexity(F.col("bits") / F.col("n")).alias("perplexity"),
        perplexity(F.col("_h")).alias("judged"), F.round(F.pow(F.lit(2.0), limit), 4).alias("threshold"),
    )
    return rows.withColumn("kept", (F.col("n_letters") == 0) | (F.col("judged") <= F.col("threshold")))
