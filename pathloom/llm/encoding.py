"""BPE encoding and decoding with an index of pair occurrences.

The words of a slice of a partition that were not seen before are laid out one after the other. An index maps each
mergeable pair to all its positions in that slice; the active ranks are taken in ascending order, every listed position
still holding the pair is merged, and the pairs this makes next to it go to the lists of their ranks. So one pass over
the index encodes all words at once. Encoded words stay in the worker's memory, in bounded number.

Ids are carried as little-endian unsigned 32-bit integers in one binary value, which Spark can hash as it stands.

Defined results: a null or empty text has no ids and decodes to an empty text; a null list of ids decodes as an empty
one; special strings inside a text become their ids; repeated rows each get their result.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import CACHE_WORD_CHARS, CACHE_WORDS, Merges, load, lower_words, trim_cache
from pathloom.llm.common import CACHES, FORGET, arrow_column, in_slices

#: Words remembered by a worker; their ids are kept as well, so fewer than where only a count is.
MAX_SEEN = CACHE_WORDS * 5 // 8


def encode_words(words: list[str], merges: Merges) -> list[bytes]:
    """Packed ids of each word."""
    rank, left, right, result = merges.rank, merges.left, merges.right, merges.result
    symbols: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts = []
    for word in words:
        ids = merges.symbols(word, True)
        base = len(symbols)
        starts.append(base)
        symbols += ids
        before += range(base - 1, base + len(ids) - 1)
        after += range(base + 1, base + len(ids) + 1)
        if ids:
            before[base] = after[-1] = -1
    index: dict[int, list[int]] = {}
    for i, j in enumerate(after):
        if j >= 0 and (r := rank.get(symbols[i] << 20 | symbols[j])) is not None:
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
    active = list(index)
    heapify(active)

    def note(r: int, place: int) -> None:
        if r in index:
            index[r].append(place)
        else:
            index[r] = [place]
            heappush(active, r)

    while active:
        r = heappop(active)
        a, b, new = left[r], right[r], result[r]
        for i in sorted(index.pop(r)):
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank.get(new << 20 | symbols[k])) is not None:
                    note(x, i)
            if (h := before[i]) >= 0 and (x := rank.get(symbols[h] << 20 | new)) is not None:
                note(x, h)
    kept = np.array(symbols, dtype=np.int64)
    alive = kept >= 0
    data = kept[alive].astype("<u4").tobytes()
    places = np.concatenate([[0], np.cumsum(alive)]) * 4
    bounds = places[np.array([*starts, len(symbols)])].tolist()
    return [data[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


_seen: dict[str, dict[str, bytes]] = CACHES.setdefault("encoding", {})
#: Words of parts of texts beyond ASCII.
_split: dict[bytes, list[str]] = {}
FORGET.append(({"encoding"}, _split.clear))


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Packed ids of each text of a slice."""
    merges = load(path)
    seen = _seen.setdefault(path, {})
    trim_cache(seen, MAX_SEEN)
    trim_cache(_split, MAX_SEEN // 4)
    parts = [[(special, lower_words(part, path, _split) if part else []) for special, part in merges.sections(text)] for text in texts]
    new = list({word for text in parts for _, words in text for word in words if word not in seen})
    fresh = dict(zip(new, encode_words(new, merges), strict=True))
    seen.update(fresh)
    get = seen.__getitem__
    coded = [b"".join(pack("<I", special) if special is not None else b"".join(map(get, words)) for special, words in text) for text in parts]
    for word in new:
        if len(word) > CACHE_WORD_CHARS:
            del seen[word]
    return coded


def encoded(text: Column, path: str) -> Column:
    """The packed ids of a text column."""
    return arrow_column(in_slices(lambda texts: encode_texts(texts, path), pa.binary()), "binary", text, "encoding")


def decode_ids(ids: bytes, names: list[str]) -> str:
    """The text of packed ids: the names of all tokens, special ones too, with a blank between."""
    return " ".join(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of packed ids."""

    def run(batches):
        names = load(path).names
        for values in batches:
            yield pa.array((decode_ids(v.as_py() or b"", names) for v in values), pa.string())

    return arrow_column(run, "string", ids, "encoding")


_CODED = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row for each row of the documents.

    The ids are decoded where they were made: a function of their own for it would take a second worker in each task,
    with the vocabulary once more.
    """

    def both(texts: list[str]) -> list[tuple[bytes, str]]:
        names = load(path).names
        return [(ids, decode_ids(ids, names)) for ids in encode_texts(texts, path)]

    made = arrow_column(in_slices(both, _CODED), "struct<ids: binary, decoded: string>", F.col("text"), "encoding")
    coded = docs.select("doc_id", made.alias("_c")).select("doc_id", "_c.ids", "_c.decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
