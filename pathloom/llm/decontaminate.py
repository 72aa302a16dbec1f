"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of the benchmark items (an item of fewer words is one window).
All windows of one length share a search: a table of word pairs tells how far the window may jump before any pattern
can end there, pairs that end a pattern lead to a bucket of patterns, and patterns of the bucket with the right first
words are compared word by word. Texts stay where they are read; only the tables travel, and only within a bound: a
larger benchmark is searched in blocks of items, one pass each.

Item ids are strings, in the order of their bytes. Defined results: a null or empty text has no words and no hits; items
without words are never found; repeated items each count, rows with one id once; all rows without an id are one item,
which comes last and has no name; repeated documents each get their result; extra columns of the items are left aside,
those of the documents are left aside or, where documents are returned, kept.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_column, ascii_words, blocks_for, document_key, kept, per_text, rows_held, word_parts

WINDOW = 10
BLOCK = 2
#: UTF-8 bytes of item texts whose tables are sent to executors at once.
MAX_ITEM_BYTES = 16 << 20

_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
_SPANS_SQL = "array<struct<first: bigint, last: bigint>>"
_FOUND_SQL = "struct<n_words: bigint, items: array<string>, spans: array<struct<first: bigint, last: bigint>>>"


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    length = min(window, len(words))
    return [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]


class WuManber:
    """Search for all patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str | None]], length: int, block: int = BLOCK) -> None:
        self.length = length
        self.block = min(block, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[pattern[-self.block :]][pattern[: self.block]].append((pattern, items))
        self.buckets = {suffix: dict(heads) for suffix, heads in self.buckets.items()}

    def scan(self, words: list[bytes]):
        """(first word, items) of every occurrence, in order."""
        length, block, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        end, total = length, len(words)
        while end <= total:
            suffix = tuple(words[end - block : end])
            jump = shift.get(suffix, far)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, items in buckets[suffix].get(tuple(words[start : start + block]), ()):
                if pattern == tuple(words[start:end]):
                    yield start, items
            end += 1


def search_tables(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[WuManber]:
    patterns: dict[int, dict[tuple[bytes, ...], list[str | None]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        for pattern in set(item_windows(ascii_words(text or ""), window)):
            patterns[len(pattern)][pattern].append(item)
    return [WuManber(found, length) for length, found in sorted(patterns.items())]


def search_text(text: str, tables: list[WuManber]) -> dict:
    """Number of words, items found and the word ranges they cover."""
    items: set[str | None] = set()
    spans: list[tuple[int, int]] = []
    overlap = max((t.length for t in tables), default=1) - 1
    before: list[bytes] = []
    passed = 0
    for part in word_parts(text):
        words = before + part
        base = passed - len(before)
        for search in tables:
            # what lies whole in the words carried over has been found already
            skip = max(0, len(before) - search.length + 1)
            for start, found in search.scan(words[skip:]):
                items.update(found)
                spans.append((base + skip + start, base + skip + start + search.length))
        passed += len(part)
        before = words[max(0, len(words) - overlap) :] if overlap else []
    return {"n_words": passed, "items": sorted(items, key=lambda i: (i is None, i)), "spans": merge_spans(spans)}


def merge_spans(spans: list[tuple[int, int]]) -> list[dict]:
    merged: list[dict] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1]["last"]:
            merged[-1]["last"] = max(merged[-1]["last"], last)
        else:
            merged.append({"first": first, "last": last})
    return merged


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The documents with a column `_found`: n_words, items (sorted ids) and spans [first, last) of hit words.

    All columns of the documents are kept; none may begin with an underscore.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks_for(size, max_item_bytes)

    def searched(frame: DataFrame, number: int) -> DataFrame:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        tables = spark.sparkContext.broadcast(search_tables([(r[0], r[1]) for r in mine.collect()], window))
        found = arrow_column(per_text(lambda text: search_text(text, tables.value), _FOUND), _FOUND_SQL, F.col("text"))
        return frame.withColumn("_found", found)

    if blocks == 1:
        return searched(docs, 0)
    # one pass a block; what was found is joined to the documents afterwards
    counted = arrow_column(per_text(lambda text: search_text(text, []), _FOUND), _FOUND_SQL, F.col("text"))
    passes = [
        kept(
            searched(docs.select("doc_id", "text"), n)
            .filter("size(_found.items) > 0").select(*document_key(), "_found").distinct(),
            "passages",
        )
        for n in range(blocks)
    ]
    # spans in order, each begun anew or added to the one before
    begun = F.array().cast(_SPANS_SQL)

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (span["first"] <= F.element_at(done, F.greatest(-F.size(done), F.lit(-1)))["last"]), joined).otherwise(F.concat(done, F.array(span)))

    together = reduce(DataFrame.union, passes).groupBy("_doc", "_text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found.items")))).alias("_items"),
        F.aggregate(F.array_sort(F.flatten(F.collect_list("_found.spans"))), begun, add).alias("_spans"),
    )
    plain = docs.withColumn("_found", counted).withColumns(dict(zip(("_doc", "_text"), document_key(), strict=True)))
    return plain.join(together, ["_doc", "_text"], "left").withColumn(
        "_found",
        F.struct(
            F.col("_found.n_words").alias("n_words"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("_spans", begun).alias("spans"),
        ),
    ).drop("_doc", "_text", "_items", "_spans")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated), one row for each row of the documents."""
    found = find_passages(docs.select("doc_id", "text"), items, **options)
    covered = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), covered.alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"), F.col("_found.items").alias("items"),
        F.col("_found.spans").alias("spans"), (F.size("_found.items") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return find_passages(rows_held(docs), items, **options).filter("size(_found.items) = 0").select("row.*")
