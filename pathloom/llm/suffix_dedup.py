"""Removal of repeated stretches of bytes, by a hash-compared suffix sort in buckets.

A byte goes if a stretch of LENGTH bytes that covers it also starts earlier: in a smaller document, or in the same one.

Suffixes are only worth sorting next to suffixes that may agree with them, so they meet in buckets chosen by their own
bytes. Of all grams of GRAM bytes in a stretch, the leftmost one with the least hash is its anchor; equal stretches have
equal anchors at equal places. Neighbouring stretches with one anchor are one row, the span, told apart by the prefix
hashes of the gram and of the span (128 bits together; equal ones are taken for equal spans).

1. Spans whose gram occurs nowhere else are dropped (counts by gram, a semi-join).
2. Equal spans: all but the first go whole, found by partial minima and a join. So copies and near copies, however many,
   come down to one row for each different span.
3. Different spans with one gram: their suffixes, each the start of a stretch, are sorted (`suffix_sort`: mergesort,
   comparisons by binary search over prefix hashes, verified byte by byte); neighbours that agree over LENGTH bytes are
   equal stretches, all but the first of which go.
4. A gram with more than CHUNK different spans, as at the edges of a passage that very many documents share, is sorted
   in chunks; what is left of each chunk, one row for each different stretch, meets in an aggregation by the stretch.

Order is by doc_id (null first), hash of the text, byte. Defined results: a null text counts as empty; texts shorter
than a stretch stay; rows alike in doc_id and text are one document and get the same result; an empty table gives no
rows; extra columns are left aside. What is kept may be cut inside a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import arrow_column, arrow_rows, document_key, dropped, ends_shuffles, kept
from pathloom.llm.suffix_sort import HashedText, mixed, suffix_classes

LENGTH = 100
GRAM = 32
#: Different spans of one gram that are sorted together; more are sorted in chunks.
CHUNK = 2048
#: Bytes hashed at once, and spans sorted at once, inside a task.
SLICE_BYTES = 1 << 19
SORT_SPANS = 1 << 12
KEY = ["_doc", "_text"]
#: A place packs the first byte, the number of equal spans in a row, the stretches of a span and the anchor in it.
_RUN, _WIDTH = 14, 7
_MOST_RUN = (1 << 17) - 1


def spans_of(parts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(part, start, stretches, anchor, gram hash, span hash) of the spans of some texts, each at least `length` long."""
    sizes = np.array([len(p) for p in parts])
    text = HashedText(b"".join(parts))
    ends = np.repeat(np.cumsum(sizes), sizes)
    hashes = mixed(text.grams(gram))
    packed = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    least, width, wanted = packed, 1, length - gram + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = len(packed) - wanted + 1
    least = np.minimum(least[:count], least[wanted - width : wanted - width + count])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    whole = ends[:count] - np.arange(count) >= length
    begins = whole.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(np.append(begins | ~whole, True))
    stop = stop[np.searchsorted(stop, start, side="right")]
    part = np.searchsorted(np.cumsum(sizes), start, side="right")
    at = anchor[start]
    span = mixed(text.hashes(start, stop - start + length - 1) + mixed((stop - start).astype(np.uint64)))
    return part, start - (np.cumsum(sizes) - sizes)[part], stop - start, at - start, hashes[at].view(np.int64), span.view(np.int64)


_SPANS = "g long, s long, _doc long, _text long, place long"


def _packed(start, run, width, off):
    return start << (14 + 17) | run << 14 | width << 7 | off


def _span_rows(length: int, gram: int):
    """Rows of the spans of documents; equal spans that follow each other in a document are one row."""

    def made(parts: list[bytes], owner: list[int], shift: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        part, start, width, off, g, s = spans_of(parts, length, gram)
        again = np.zeros(len(part), bool)
        again[1:] = (part[1:] == part[:-1]) & (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (start[1:] == start[:-1] + width[:-1])
        head = np.flatnonzero(~again)
        # a longer row of equal spans is cut; its pieces are equal spans of one document like any others
        run = np.diff(np.append(head, len(part)))
        pieces = (run + _MOST_RUN - 1) // _MOST_RUN
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        head, run = np.repeat(head, pieces) + nth * _MOST_RUN, np.minimum(np.repeat(run, pieces) - nth * _MOST_RUN, _MOST_RUN)
        own = np.array(owner)[part[head]]
        place = _packed(start[head] + np.array(shift)[part[head]], run, width[head], off[head])
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (g[head], s[head], keys[0][own], keys[1][own], place)], ["g", "s", "_doc", "_text", "place"]
        )

    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            parts: list[bytes] = []
            owner: list[int] = []
            shift: list[int] = []
            size = 0
            for i, value in enumerate(batch.column(2)):
                body = value.as_py()
                for begin in range(0, max(1, len(body) - length + 1), SLICE_BYTES):
                    piece = body[begin : begin + SLICE_BYTES + length - 1]
                    if parts and size + len(piece) > SLICE_BYTES:
                        yield made(parts, owner, shift, keys)
                        parts, owner, shift, size = [], [], [], 0
                    parts.append(piece)
                    owner.append(i)
                    shift.append(begin)
                    size += len(piece)
            if parts:
                yield made(parts, owner, shift, keys)

    return run


def _start() -> Column:
    return F.shiftright("place", 31)


def _run() -> Column:
    return F.shiftright("place", _RUN).bitwiseAND(_MOST_RUN)


def _width() -> Column:
    return F.shiftright("place", _WIDTH).bitwiseAND(127)


_SORTED = "_doc long, _text long, start long, stop long, stretch binary"


def _bucket_rows(length: int):
    """Rows of spans, ordered by bucket, to (start, stop) of stretches that are not the first of their class in the
    bucket, and, where the bucket is a chunk of several, the stretches that are (with their bytes)."""

    def solved(rows: dict[str, np.ndarray], bodies: list[bytes]) -> pa.RecordBatch:
        doc, text, place, group, chunked = (rows[c] for c in ("_doc", "_text", "place", "bucket", "chunked"))
        size = np.array([len(b) for b in bodies])
        base = np.cumsum(size) - size
        data = HashedText(b"".join(bodies))
        width, off, begin = (place >> 7) & 127, place & 127, place >> 31
        owner = np.repeat(np.arange(len(place)), width)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
        # only stretches with the anchor at one place in them can be equal
        order, cls = suffix_classes(data, base[owner] + nth, group[owner] * 128 + off[owner] - nth, length)
        # of a class, the first in the order of documents stays
        by = np.lexsort((begin[owner[order]] + nth[order], text[owner[order]], doc[owner[order]], cls))
        order, cls = order[by], cls[by]
        head = np.ones(len(cls), bool)
        head[1:] = cls[1:] != cls[:-1]
        first = order[np.flatnonzero(head)][np.cumsum(head) - 1]

        def key(i):
            return doc[owner[i]], text[owner[i]], begin[owner[i]] + nth[i]

        later = np.zeros(len(order), bool)
        for x, y in zip(key(order), key(first), strict=True):
            later |= x != y
        gone = np.zeros(len(order), bool)
        gone[order] = later
        # neighbouring stretches of a span go as one
        opens = gone.copy()
        opens[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
        closes = gone.copy()
        closes[:-1] &= ~(gone[1:] & (owner[1:] == owner[:-1]))
        a, z = np.flatnonzero(opens), np.flatnonzero(closes)
        left = np.flatnonzero(~gone & chunked[owner])
        own = np.concatenate([owner[a], owner[left]])
        start = np.concatenate([nth[a], nth[left]]) + begin[own]
        stop = np.concatenate([nth[z], nth[left]]) + begin[own] + length
        at = base[owner[left]] + nth[left]
        whole = data.bytes.tobytes() if len(left) else b""
        stretch = [None] * len(a) + [whole[i : i + length] for i in at.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[own]), pa.array(text[own]), pa.array(start), pa.array(stop), pa.array(stretch, pa.binary())],
            ["_doc", "_text", "start", "stop", "stretch"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []

        def rows(table: pa.Table):
            columns = {c: table.column(c).to_numpy() for c in ("_doc", "_text", "place")}
            g, chunk = table.column("g").to_numpy(), table.column("chunk").to_numpy()
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (chunk[1:] != chunk[:-1])
            columns["bucket"] = np.cumsum(new)
            columns["chunked"] = table.column("chunks").to_numpy() > 1
            return columns

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < SORT_SPANS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            columns = rows(table)
            open_ = int(np.searchsorted(columns["bucket"], columns["bucket"][-1]))  # the last bucket may go on
            if open_:
                done = table.slice(0, open_)
                yield solved({c: v[:open_] for c, v in columns.items()}, done.column("body").to_pylist())
                held = table.slice(open_).to_batches()
                count -= open_
            else:
                held = table.to_batches()
        if count:
            table = pa.Table.from_batches(held).combine_chunks()
            yield solved(rows(table), table.column("body").to_pylist())

    return run


def _bodies(docs: DataFrame) -> DataFrame:
    """(_doc, _text, doc_id, body)"""
    return docs.select(*document_key(), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """(_doc, _text, start, stop): stretches of bytes to remove, which may overlap."""
    if not 0 <= length - gram < 127:
        raise ValueError("a stretch may be up to 126 bytes longer than a gram")
    bodies = _bodies(docs).select(*KEY, "body")
    spans = arrow_rows(bodies.filter(F.octet_length("body") >= length), _span_rows(length, gram), _SPANS)
    with ends_shuffles(docs.sparkSession):
        twice = kept(spans.groupBy("g").agg(F.sum(F.least(_run(), F.lit(2))).alias("n")).filter("n > 1").select("g"), "grams")
        places = kept(spans.join(twice.hint("merge"), "g", "left_semi"), "spans")
        dropped(twice)
        place = F.struct(*KEY, "place")
        met = places.groupBy("g", "s").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        single = kept(met.select("g", "s", "first.*", (F.col("first") != F.col("last")).alias("again")), "span-firsts")
        firsts = single.filter("again").select("g", "s", place.alias("first")).hint("merge")
        whole = places.join(firsts, ["g", "s"]).filter(place != F.col("first"))
        cut = whole.select(*KEY, _start().alias("start"), (_start() + _width() * _run() + length - 1).alias("stop"))
        follow = places.filter(_run() > 1)
        cut = cut.union(follow.select(*KEY, (_start() + _width()).alias("start"), (_start() + _width() * _run() + length - 1).alias("stop")))
        cut = kept(cut, "span-copies")
        dropped(places)
        mixed_ = single.groupBy("g").agg(F.min("s").alias("_x"), F.max("s").alias("_y"), F.count("*").alias("_m")).filter("_x != _y")
        chunks = F.ceil(F.col("_m") / chunk)
        several = single.join(mixed_.select("g", chunks.alias("chunks")).hint("merge"), "g")
        several = several.select(*KEY, "g", F.pmod("s", "chunks").alias("chunk"), "chunks", "place")
        body = F.expr("substring(body, cast(shiftright(place, 31) as int) + 1, cast(shiftright(place, 7) & 127 as int) + {})".format(length - 1))
        texts = several.join(bodies, KEY).select("g", "chunk", "chunks", *KEY, "place", body.alias("body"))
        ordered = texts.repartition("g", "chunk").sortWithinPartitions("g", "chunk")
        found = kept(arrow_rows(ordered, _bucket_rows(length), _SORTED), "sorted-spans")
        dropped(single)
        at = F.struct(*KEY, "start")
        rest = found.filter("stretch is not null")
        least = rest.groupBy("stretch").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first != last").select("stretch", "first")
        across = rest.join(least.hint("merge"), "stretch").filter(at != F.col("first"))
        return cut.union(found.filter("stretch is null").drop("stretch")).union(across.select(*KEY, "start", "stop"))


_KEPT = pa.struct([("removed", pa.int64()), ("spans", pa.int64()), ("kept", pa.binary())])


def without_stretches(body: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left)."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    opens = np.ones(len(starts), bool)
    opens[1:] = starts[1:] > stops[:-1]
    a, z = starts[opens], stops[np.append(opens[1:], True)]
    parts, at = [], 0
    for x, y in zip(a.tolist(), z.tolist(), strict=True):
        parts.append(body[at:x])
        at = y
    parts.append(body[at:])
    return int((z - a).sum()), len(a), b"".join(parts)


def _cut(batches: Iterator[pa.StructArray]) -> Iterator[pa.Array]:
    for batch in batches:
        bodies, lists = batch.field(0), batch.field(1)
        out = []
        for body, cuts in zip(bodies, lists, strict=True):
            if cuts.is_valid and len(cuts.values):
                out.append(without_stretches(body.as_py(), cuts.values.field(0).to_numpy(), cuts.values.field(1).to_numpy()))
            else:
                out.append((0, 0, body.as_py()))
        yield pa.array([dict(zip(("removed", "spans", "kept"), x, strict=True)) for x in out], _KEPT)


def dedup_bytes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row for each row of the documents; kept is what is left of the
    text's UTF-8 bytes."""
    cuts = repeated_bytes(docs, **options).groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    marked = _bodies(docs).join(cuts, KEY, "left")
    made = arrow_column(_cut, "struct<removed: bigint, spans: bigint, kept: binary>", F.struct("body", "cuts"))
    done = marked.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), made.alias("_c"))
    return done.select("doc_id", "n_bytes", F.col("_c.removed").alias("n_removed"), F.col("_c.spans").alias("n_spans"), F.col("_c.kept").alias("kept"))
