"""Token counts by byte-pair merging with a heap and a linked list, without making any ids.

The pieces of a text are merged on their own: adjacent pairs wait in a heap by rank and place, the lowest is taken
again and again, and the two symbols become one in a linked list. A piece counts its bytes less its merges. A worker
keeps the counts of the pieces it has seen, in bounded memory. Texts are counted where they are read: no shuffle.

Defined results: a null or empty text has no tokens; special strings inside a text are one token each; repeated rows
each get their count; extra columns are left aside.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import CACHE_WORD_CHARS, Merges, byte_pieces, load, trim_cache, words_of
from pathloom.llm.common import CACHES, arrow_column


def merged_length(symbols: list[int], merges: Merges) -> int:
    """Symbols left when no adjacent pair merges any more."""
    size = len(symbols)
    if size < 2:
        return size
    rank, result = merges.rank, merges.result
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = [(r, i) for i in range(size - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapify(heap)
    left = size
    while heap:
        r, i = heappop(heap)
        j = after[i]
        if symbols[i] < 0 or j >= size or rank.get(symbols[i] << 20 | symbols[j]) != r:
            continue
        symbols[i], symbols[j] = result[r], -1
        k = after[i] = after[j]
        left -= 1
        if k < size:
            before[k] = i
            if (x := rank.get(symbols[i] << 20 | symbols[k])) is not None:
                heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := rank.get(symbols[h] << 20 | symbols[i])) is not None:
            heappush(heap, (x, h))
    return left


class _Counts(dict):
    def __init__(self, merges: Merges) -> None:
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        count = merged_length(self.merges.symbols(piece, False), self.merges)
        if len(piece) <= CACHE_WORD_CHARS:
            self[piece] = count
        return count


_seen: dict[str, _Counts] = CACHES.setdefault("counts", {})


def count_text(text: str, path: str) -> int:
    counts = _seen.get(path)
    if counts is None:
        counts = _seen[path] = _Counts(load(path))
    trim_cache(counts)
    get = counts.__getitem__
    total = 0
    for special, part in counts.merges.sections(text):
        total += 1 if special is not None else sum(map(get, words_of(part, path, byte_pieces)))
    return total


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of the documents."""

    def run(batches):
        for texts in batches:
            yield pa.array([count_text(x.as_py() or "", path) for x in texts], pa.int64())

    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        arrow_column(run, "bigint", F.col("text"), "counts").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
