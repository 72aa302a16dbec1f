"""Token files: ids bit-packed at the fewest bits of the vocabulary, in ascending document order.

A data set is a folder of segments, one row each, written and committed by Spark: up to SEGMENT_IDS ids of whole
documents (a longer document is a segment of its own). A segment holds the ids of its documents as one bit stream, the
byte offset of every block of BLOCK_IDS ids, and the documents' ids and lengths. Blocks start at whole bytes, so numpy
unpacks them without looking at others, and any id range is found by arithmetic and one slice.

Documents are dealt out by ranges of (doc_id, hash of the text), so one id with very many rows is split as well; the
totals of the shards, one number each, give every shard's first position.

Defined results: a null or empty text is a document of the end id alone; null ids come first; rows with one id are
ordered by the hash of their text; repeated rows are documents of their own; an empty table gives no documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.bpe import CACHE_WORD_CHARS, byte_letters, library, load, trim_cache
from pathloom.llm.common import CACHES, NO_ID, arrow_column, slices, small_batches

SEGMENT_IDS = 1 << 16
SEGMENT_DOCS = 1 << 12
BLOCK_IDS = 1 << 12
#: Shards (one for each writing task) whose starts are sent to all executors; more are joined by a shuffle.
MAX_SENT_SHARDS = 200_000
#: Words remembered by a worker: asking the library again costs more than the memory of their ids.
MAX_SEEN = 1_200_000

SEGMENT = (
    "shard int, first long, bits int, n_ids long, doc_ids array<long>, lengths array<long>, block_offsets array<long>, payload binary"
)


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> tuple[bytes, list[int]]:
    """(bit stream, byte offset of each block)."""
    parts, offsets, size = [], [], 0
    for start in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[start : start + BLOCK_IDS], dtype="<u4")
        if bits % 8 == 0:  # whole bytes
            data = block.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
            offsets.append(size)
            parts.append(data)
            size += len(data)
            continue
        spread = np.unpackbits(block.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        data = np.packbits(spread, bitorder="little").tobytes()
        offsets.append(size)
        parts.append(data)
        size += len(data)
    return b"".join(parts), offsets


def unpack_ids(payload: bytes, offsets: list[int], bits: int, start: int, count: int) -> np.ndarray:
    """The ids [start, start + count) of a segment; only the blocks that hold them are read."""
    if count <= 0:
        return np.zeros(0, "<u4")
    first, last = start // BLOCK_IDS, (start + count - 1) // BLOCK_IDS
    parts = []
    for block in range(first, last + 1):
        end = offsets[block + 1] if block + 1 < len(offsets) else len(payload)
        if bits % 8 == 0:
            wide = np.zeros(((end - offsets[block]) // (bits // 8), 4), np.uint8)
            wide[:, : bits // 8] = np.frombuffer(payload, np.uint8, end - offsets[block], offsets[block]).reshape(len(wide), -1)
            parts.append(wide.view("<u4").ravel())
            continue
        stream = np.unpackbits(np.frombuffer(payload, np.uint8, end - offsets[block], offsets[block]), bitorder="little")
        n = len(stream) // bits
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = stream[: n * bits].reshape(n, bits)
        parts.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    ids = np.concatenate(parts)
    return ids[start - first * BLOCK_IDS : start - first * BLOCK_IDS + count]


#: The lower-case vocabulary's word pattern on ASCII bytes.
_ASCII_WORDS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\x09-\x0d \x30-\x39a-z]+")


class _Parts(dict):
    """Packed ids of what stands between ASCII white space, as the tokenizers library gives them.

    A-Z are lower-case already. A word by itself is a part of one word, so the words of a part are looked up like parts.
    """

    def __init__(self, path: str) -> None:
        whole = library(path)
        self.tokenize = whole.model.tokenize
        self.normal, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})

    def _word(self, letters: str) -> bytes:
        return b"".join([token.id.to_bytes(4, "little") for token in self.tokenize(letters)])

    def __missing__(self, part: bytes) -> bytes:
        if not part.isascii():
            ids = b"".join([self._word(word) for word, _ in self.split(self.normal(part.decode()))])
        elif (words := _ASCII_WORDS.findall(part)) == [part]:
            plain = part.decode()  # printable ASCII stands for itself in byte-level letters
            ids = self._word(plain if plain.isprintable() else plain.translate(self.letters))
        else:
            ids = b"".join([self[word] for word in words])
        if len(part) <= CACHE_WORD_CHARS:
            self[part] = ids
        return ids


_seen: dict[str, _Parts] = CACHES.setdefault("library", {})


def library_ids(text: str, path: str) -> bytes:
    """Packed ids of a text as the tokenizers library gives them.

    What stands between ASCII white space is encoded by itself, which gives the same ids: white space is dropped, and
    no pattern or composition of marks reaches across it. The library's model gets each word, and its normaliser each
    part beyond ASCII, once as long as the worker remembers it.
    """
    parts = _seen.get(path)
    if parts is None:
        parts = _seen[path] = _Parts(path)
    out = []
    for special, section in load(path).sections(text):
        if special is not None:
            out.append(special.to_bytes(4, "little"))
        else:
            out += map(parts.__getitem__, section.encode("utf-8", "replace").lower().split())
    return b"".join(out)


def _segments(path: str, end_id: int, bits: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        shard, first = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        size = 0

        def segment():
            payload, offsets = pack_ids(np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([bits], pa.int32()), pa.array([size], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([offsets], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
                ],
                ["shard", "first", "bits", "n_ids", "doc_ids", "lengths", "block_offsets", "payload"],
            )

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts, _ in slices([batch.column(1)]):
                if path in _seen:
                    trim_cache(_seen[path], MAX_SEEN)
                for ids in (library_ids(text, path) for text in texts):
                    count = len(ids) // 4 + 1
                    if docs and (size + count > SEGMENT_IDS or len(docs) >= SEGMENT_DOCS):
                        yield segment()
                        first += size
                        docs, lengths, parts, size = [], [], [], 0
                    docs.append(next(names))
                    lengths.append(count)
                    parts += (ids, end)
                    size += count
        if docs:
            yield segment()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """Encode whole documents and write them, each followed by the end id, in ascending doc_id order."""
    bits = bits_for(max(load(path).size, end_id + 1))
    order = [F.coalesce("doc_id", F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))]
    small_batches()
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.col("doc_id").cast("long"), "text").mapInArrow(_segments(path, end_id, bits), SEGMENT).write.parquet(folder)


def _unpacked(batches):
    for batch in batches:
        rows = []
        for row in batch:
            s = row.as_py()
            found, place = [], 0
            ids = unpack_ids(s["payload"], s["block_offsets"], s["bits"], 0, sum(s["lengths"]))
            for doc, length in zip(s["doc_ids"], s["lengths"], strict=True):
                found.append({"doc_id": doc, "place": place, "ids": ids[place : place + length].astype("<u4").tobytes()})
                place += length
            rows.append(found)
        yield pa.array(rows, pa.list_(pa.struct([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all documents before it."""
    files = spark.read.parquet(folder)
    # a segment tells where it starts in its shard, and the shards' totals where each of them starts
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("_total"))
    shards = shards.select("shard", (F.sum("_total").over(Window.orderBy("shard")) - F.col("_total")).alias("_before"))
    few = shards.count() <= MAX_SENT_SHARDS
    kind = "array<struct<doc_id: bigint, place: bigint, ids: binary>>"
    opened = files.join(F.broadcast(shards) if few else shards, "shard").select(
        (F.col("_before") + F.col("first")).alias("_first"),
        F.explode(arrow_column(_unpacked, kind, F.struct("payload", "block_offsets", "bits", "doc_ids", "lengths"))).alias("_d"),
    )
    return opened.select(
        F.col("_d.doc_id").alias("doc_id"), (F.col("_first") + F.col("_d.place")).alias("start"),
        (F.octet_length("_d.ids") / 4).cast("long").alias("n_tokens"), F.col("_d.ids").alias("ids"),
    )
