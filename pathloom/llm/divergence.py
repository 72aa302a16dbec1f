"""Source divergence audit by run-length columns.

Terms are runs of letters A-Z, lower-cased, and of anything beyond ASCII. A language keeps the terms that MIN_DOCS of
its documents hold. Every source of the language, and the language as a whole, gives each kept term an integer share
p = 1 + floor(SCALE * (count + 1) / (N + V)); how far p is from another q is f = floor((p - q) * (p - q) / q).

- Tasks count terms by source before anything is shuffled, in tables of bounded size. One shuffle by (language, term)
  then sums them and tells which terms are kept.
- Sources are compared in shards of the vocabulary: a shard's terms are put into the order of their counts, so that
  equal counts lie together, and every source's column is run-length encoded. For a pair of sources the boundaries of
  both columns are united; between two boundaries both counts stay the same, so f is computed once there and multiplied
  by the number of terms. Terms that no source of a shard's block has are one run of zeros and never listed.
- A shard holds about SHARD_TERMS terms and two blocks of at most BLOCK sources, whatever the corpus; the sums of the
  shards are added up by pair.

All arithmetic is on integers (decimals where a product may leave 64 bits).

Defined results: null text, language or source count as ''; a text without terms, or an empty one, still makes its
group occur; repeated rows are documents of their own; a language without kept terms gives pairs of value 0 and no
terms; equal values are ranked by item in the order of UTF-8 bytes; an empty table gives no rows; extra columns are
left aside.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_rows, ends_shuffles, kept, salted_join

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
SHARD_TERMS = 1 << 13
BLOCK = 64
#: Entries of a task's tables before they are given on.
FLUSH = 400_000
#: Groups whose totals are sent to all executors; more are joined by a salted shuffle.
MAX_SENT_GROUPS = 50_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counted(batches):
    """Rows (lang, source, term, n, df) of a task's documents."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (total, docs) in tables.items():
            for start in range(0, len(total), 100_000):
                terms = list(total)[start : start + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                        pa.array(map(total.__getitem__, terms), pa.int64()), pa.array(map(docs.__getitem__, terms), pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "df"],
                )
        tables.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            words = terms_of(text)
            total, docs = tables.setdefault((lang, source), (Counter(), Counter()))
            size -= len(total)
            total.update(words)
            docs.update(set(words))
            size += len(total)
            if size > FLUSH:
                yield from rows()
                size = 0
    yield from rows()


def _documents(docs: DataFrame) -> DataFrame:
    blank = F.lit("")
    return docs.select(*(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source", "text")))


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, first): counts above 0 of the kept terms; total is the language's count, first
    marks one source of each term."""
    texts = _documents(docs).select("lang", "source", F.col("text").cast("binary"))
    found = arrow_rows(texts, _counted, "lang string, source string, term binary, n long, df long")
    found = found.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "df").repartition("lang", "term")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    whole = summed.withColumns({"_df": F.sum("df").over(term), "total": F.sum("n").over(term), "_least": F.min("source").over(term)})
    return whole.filter(F.col("_df") >= min_docs).select("lang", "source", "term", "n", "total", (F.col("source") == F.col("_least")).alias("first"))


def _share(count: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / size), without overflow."""
    wide = "cast({} as decimal(38, 0))"
    return F.call_function("div", F.expr(wide.format(SCALE)) * (count.cast("decimal(20, 0)") + 1), size.cast("decimal(20, 0)")).cast("long") + 1


def exact_shares(counts: np.ndarray, size: int) -> np.ndarray:
    """The same for an array of counts."""
    if len(counts) and int(counts.max()) >= 2**63 // SCALE - 1:
        return np.array([1 + SCALE * (int(c) + 1) // size for c in counts], np.int64)
    return 1 + SCALE * (counts + 1) // size


def shard_sums(counts: np.ndarray, rest: int, sizes: list[int]) -> np.ndarray:
    """(sources, sources) sums of f over the rows of a matrix of counts (terms x sources) and `rest` rows of zeros."""
    terms, sources = counts.shape
    out = np.zeros((sources, sources), np.int64)
    if rest:
        counts = np.vstack([counts, np.zeros((1, sources), np.int64)])
    if not len(counts):
        return out
    many = np.ones(len(counts), np.int64)
    if rest:
        many[-1] = rest
    # the fullest column first: later ones are ordered within its runs
    by_size = np.argsort((counts > 0).sum(axis=0), kind="stable")
    order = np.lexsort(counts[:, by_size].T)
    counts = counts[order]
    upto = np.concatenate([[0], np.cumsum(many[order])])
    starts = np.ones(counts.shape, bool)
    starts[1:] = counts[1:] != counts[:-1]
    run = np.cumsum(starts, axis=0) - 1
    share = [exact_shares(counts[starts[:, i], i], sizes[i]) for i in range(sources)]
    for i in range(sources):
        for j in range(i + 1, sources):
            begin = np.flatnonzero(starts[:, i] | starts[:, j])
            length = np.diff(upto[np.append(begin, len(counts))])
            p, q = share[i][run[begin, i]], share[j][run[begin, j]]
            square = (p - q) * (p - q)
            out[i, j] = ((square // q) * length).sum()
            out[j, i] = ((square // p) * length).sum()
    return out


PAIR_SUMS = "lang string, source string, item string, value long"


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pair sums of one shard and pair of blocks: left are its counts, right its sources."""
    sources = right.column("source").to_pylist()
    blocks = right.column("block").to_pylist()
    a, b = right.column("block_a")[0].as_py(), right.column("block_b")[0].as_py()
    sizes = [n + v for n, v in zip(right.column("group_n").to_pylist(), right.column("v").to_pylist(), strict=True)]
    place = {s: i for i, s in enumerate(sources)}
    terms, index = np.unique(np.array(left.column("term").to_pylist(), object), return_inverse=True) if left.num_rows else ([], np.zeros(0, int))
    counts = np.zeros((len(terms), len(sources)), np.int64)
    counts[index, [place[s] for s in left.column("source").to_pylist()]] = left.column("n").to_numpy()
    sums = shard_sums(counts, right.column("terms")[0].as_py() - len(terms), sizes)
    wanted = [(i, j) for i in range(len(sources)) for j in range(len(sources)) if i != j and (a == b or blocks[i] != blocks[j])]
    lang = right.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang] * len(wanted), pa.string()), "source": pa.array([sources[i] for i, _ in wanted], pa.string()),
        "item": pa.array([sources[j] for _, j in wanted], pa.string()), "value": pa.array([int(sums[i, j]) for i, j in wanted], pa.int64()),
    })


def _pair_sums(entries: DataFrame, groups: DataFrame, shard_terms: int, block: int) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    shards = F.greatest(F.lit(1), F.ceil(F.col("v") / shard_terms))
    blocks = F.ceil(F.col("sources") / block)

    def keyed(frame: DataFrame) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        return frame.withColumn("_o", other).withColumns({"block_a": F.least("block", "_o"), "block_b": F.greatest("block", "_o")})

    placed = entries.withColumns({"shard": F.pmod(F.xxhash64("term"), shards), "block": F.floor(F.col("place") / block)})
    held = placed.filter("first").groupBy("lang", "shard").agg(F.count("*").alias("terms"))
    sides = groups.withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)), "block": F.floor(F.col("place") / block)})
    sides = keyed(sides.join(held, ["lang", "shard"], "left").withColumn("terms", F.coalesce("terms", F.lit(0))))
    key = ["lang", "shard", "block_a", "block_b"]
    left = keyed(placed).select(*key, "source", "term", "n").groupBy(*key)
    right = sides.select(*key, "source", "block", "group_n", "v", "terms").groupBy(*key)
    return left.cogroup(right).applyInArrow(_compared, PAIR_SUMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, block: int = BLOCK
) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by value (part `pair`), and the terms
    a source has more often than its language, by value up to rank `top` (part `term`)."""
    with ends_shuffles(docs.sparkSession):
        counts = kept(kept_counts(docs, min_docs), "term-counts")
        of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("v"))
        occurring = _documents(docs).select("lang", "source").distinct()
        groups = occurring.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "lang_n", "v")))
        lang = Window.partitionBy("lang")
        groups = groups.withColumns({"place": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)})
        groups = kept(groups, "term-groups")
        if groups.count() <= MAX_SENT_GROUPS:
            entries = counts.join(F.broadcast(groups), ["lang", "source"])
        else:
            entries = salted_join(counts, groups, ["lang", "source"], F.col("term"))
        pairs = kept(_pair_sums(entries, groups, shard_terms, block), "source-pairs")
        shares = entries.withColumns({
            "p": _share(F.col("n"), F.col("group_n") + F.col("v")), "q": _share(F.col("total"), F.col("lang_n") + F.col("v")),
        }).filter(F.col("p") > F.col("q"))
        over = F.col("p") - F.col("q")
        rated = shares.select("lang", "source", F.col("term").alias("item"), F.call_function("div", over * over, F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        terms = rated.withColumn("rank", rank).filter(F.col("rank") <= top)
        parts = [frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, frame in (("pair", pairs.withColumn("rank", rank)), ("term", terms))]
        return parts[0].unionByName(parts[1])
