"""Cross-tokenizer alignment with inverted pair bitmaps.

Every text is encoded by two tokenizers. Byte offsets where a token of either ends cut both lists into groups; tokens
of one group are linked. How good a link is depends on the corpus: in how many documents the pair of ids is linked.

- A task encodes its documents in slices and writes postings for each block of up to BLOCK_DOCS of them: for each pair
  the set of its documents in the block, compressed (sorted 16-bit numbers, or a bitmap where that is smaller), and
  bit planes of how often each of these documents has the link.
- Blocks hold different documents, so the document sets of a pair are united by putting their blocks side by side, and
  the popcounts of the blocks add up to the pair's count. The highest count of each id of the first tokenizer follows.
- The counts are joined to the postings by pair, and the postings go back to their blocks, where their bits add the
  counts to the documents' scores. So links are never rows; what is shuffled is compressed sets.

Neither tokenizer has a token that goes on after a letter into a single space, so texts are cut there (where that does
not hold, whole texts are the parts): both libraries get each part once as long as the worker remembers its groups and
links, and a text's groups and links are those of its parts.

Token bytes: byte-level letters stand for bytes in the first vocabulary; in the second, U+2581 is a space and <0xHH> a
byte. The first tokenizer is given a space and the text, the second adds a space by itself; special strings inside a
text are ordinary text.

Defined results: texts that are null, empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros
and an empty hash; every row is a document of its own, also repeated ones; an empty table gives no rows; extra columns
are left aside.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm.bpe import byte_letters
from pathloom.llm.common import FORGET, arrow_column, arrow_rows, dropped, ends_shuffles, kept, slices

#: Documents of a block; their numbers take 16 bits.
BLOCK_DOCS = 1 << 16
#: Distinct links (pair, document) a task holds before it writes a block.
BLOCK_LINKS = 6_000_000
SLICE = 1 << 19
#: Parts of texts a worker remembers, and the characters of the longest of them.
MAX_PARTS, PART_CHARS = 400_000, 64

#: Texts encoded as one.
JOINED = 2000

_CUT = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        names = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.first_bytes[i] = bytes(letters[x] for x in name) if all(x in letters for x in name) else name.encode()
        self.second_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.second_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = [np.array([len(x) for x in names], np.int64) for names in (self.first_bytes, self.second_bytes)]
        # each id with what follows it: inside its side of a group, at the end of the side, at the end of a text
        self.named = [f"{i}{mark}" for i in range(len(self.first_bytes)) for mark in ",|"]
        # a cut is safe where a space begins a piece of the first and a token of the second
        config = json.loads(self.first.to_str())
        split = config["pre_tokenizer"] or {}
        self.cuts = (
            config["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(" " in name.decode("utf-8", "replace").lstrip(" ") for name in self.second_bytes)
        )
        self.second_names = len(self.named)
        self.named += [f"{i}{mark}" for i in range(len(self.second_bytes)) for mark in ",;\n"]

    def parts(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both; none where a text doesn't come back byte by byte."""
        first = self._first_joined(texts) if self.cuts else self._first(texts)
        second = self.second.encode(texts, out_type=int, num_threads=1)
        join, names = b"".join, self.second_bytes.__getitem__
        return [
            (x, y) if x is not None and join(map(names, y)) == (" " + text).encode("utf-8", "replace") else ([], [])
            for text, x, y in zip(texts, first, second, strict=True)
        ]

    def _first(self, texts: list[str]) -> list[list[int] | None]:
        names = self.first_bytes.__getitem__
        coded = [x.ids for x in self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [x if b"".join(map(names, x)) == (" " + t).encode("utf-8", "replace") else None for t, x in zip(texts, coded, strict=True)]

    def _first_joined(self, texts: list[str]) -> list[list[int] | None]:
        """The same for texts between which a cut is safe: the library takes many at once, and ids are told apart by bytes."""
        out: list[list[int] | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and not t[0].isspace() and not t[-1].isspace()]
        rest = set(range(len(texts))).difference(plain)
        for begin in range(0, len(plain), JOINED):
            part = plain[begin : begin + JOINED]
            whole = " " + " ".join(texts[i] for i in part)
            ids = self._first([whole[1:]])[0]
            bounds = np.cumsum([len(texts[i].encode("utf-8", "replace")) + 1 for i in part])
            ends = np.cumsum(self.lengths[0][ids]) if ids else bounds[:0]
            last = np.searchsorted(ends, bounds)
            if not len(ends) or last[-1] >= len(ends) or (ends[last] != bounds).any():
                rest.update(part)
                continue
            at = [0, *(last + 1).tolist()]
            for i, a, z in zip(part, at[:-1], at[1:], strict=True):
                out[i] = ids[a:z]
        single = sorted(rest)
        for i, ids in zip(single, self._first([texts[i] for i in single]), strict=True):
            out[i] = ids
        return out


class Aligned:
    """Groups and links of encoded texts."""

    def __init__(self, coded: list[tuple[list[int], list[int]]], tokens: Tokens) -> None:
        count = len(coded)
        self.n = [np.array([len(x[side]) for x in coded], np.int64) for side in (0, 1)]
        ids = [np.fromiter((i for x in coded for i in x[side]), np.int64, int(self.n[side].sum())) for side in (0, 1)]
        ends = [np.cumsum(tokens.lengths[side][ids[side]]) for side in (0, 1)]
        size = int(ends[0][-1]) if len(ends[0]) else 0
        marks = np.zeros(size + 1, np.uint8)
        for e in ends:
            marks[e] += 1
        both = marks == 2
        before = np.cumsum(both) - both
        group = [before[e] for e in ends]
        many = [np.bincount(g, minlength=int(both.sum())) for g in group]
        owner = [np.repeat(np.arange(count), n) for n in self.n]
        closes = [both[e] for e in ends]
        self.n_groups = np.bincount(owner[0][closes[0]], minlength=count)
        # the n-th token of the first side in place among the tokens of both, and the other way round
        upto = [np.concatenate([[0], np.cumsum(m)]) for m in many]
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        last = [np.arange(len(g)) == upto[side][g + 1] - 1 for side, g in enumerate(group)]
        final = np.zeros(len(ids[1]), bool)
        final[np.cumsum(self.n[1])[self.n[1] > 0] - 1] = True
        codes[np.arange(len(ids[0])) + upto[1][group[0]]] = ids[0] * 2 + last[0]
        codes[np.arange(len(ids[1])) + upto[0][group[1] + 1]] = tokens.second_names + ids[1] * 3 + last[1] + final
        #: `a1,a2|b1;a3|b2,b3` for each text
        written = iter("".join(map(tokens.named.__getitem__, codes.tolist())).split("\n"))
        self.groups = [next(written) if n else "" for n in self.n[0].tolist()]
        times = many[1][group[0]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = np.repeat(upto[1][group[0]], times) + nth
        self.doc = np.repeat(owner[0], times)
        self.pair = np.repeat(ids[0], times) * len(tokens.second_bytes) + ids[1][other]
        self.n_links = np.bincount(self.doc, minlength=count)


class Remembered:
    """Groups and links of parts of texts, by part, in arrays that grow."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens = tokens
        self.place: dict[str, int] = {}
        self.names: list[str] = []
        self.figures = np.zeros((0, 4), np.int64)  # tokens of both, groups, links
        self.known = np.zeros(0, bool)
        self.links = np.zeros(0, np.int64)
        self.link_start = np.zeros(1, np.int64)

    def learn(self, parts: list[str]) -> None:
        coded = self.tokens.encoded(parts)
        found = Aligned(coded, self.tokens)
        self.place.update(zip(parts, range(len(self.names), len(self.names) + len(parts)), strict=True))
        self.names += found.groups
        self.figures = np.concatenate([self.figures, np.stack([*found.n, found.n_groups, found.n_links], axis=1)])
        self.known = np.concatenate([self.known, [bool(a) for a, _ in coded]])
        self.links = np.concatenate([self.links, found.pair])
        self.link_start = np.concatenate([self.link_start, self.link_start[-1] + np.cumsum(found.n_links)])

    def forget(self, keep: int) -> None:
        """Keep the parts learnt first."""
        for part in [p for p, i in self.place.items() if i >= keep]:
            del self.place[part]
        del self.names[keep:]
        self.figures, self.known = self.figures[:keep].copy(), self.known[:keep].copy()
        self.links, self.link_start = self.links[: self.link_start[keep]].copy(), self.link_start[: keep + 1].copy()

    def texts(self, texts: list[str]) -> AlignedTexts:
        if len(self.names) > MAX_PARTS:
            self.forget(MAX_PARTS * 3 // 4)
        split = [self.tokens.parts(text) if text else [] for text in texts]
        new = sorted({part for parts in split for part in parts if part not in self.place}, key=lambda part: len(part) > PART_CHARS)
        short = len(self.names) + sum(len(part) <= PART_CHARS for part in new)
        if new:
            self.learn(new)
        found = AlignedTexts(self, split)
        if short < len(self.names):
            self.forget(short)
        return found


class AlignedTexts:
    """Figures, group strings and links of texts made of remembered parts; a text with a part that didn't come back byte
    by byte has none."""

    def __init__(self, memory: Remembered, split: list[list[str]]) -> None:
        many = np.array([len(parts) for parts in split], np.int64)
        place = np.fromiter((memory.place[part] for parts in split for part in parts), np.int64, int(many.sum()))
        owner = np.repeat(np.arange(len(split)), many)
        bad = np.bincount(owner[~memory.known[place]], minlength=len(split)) > 0
        good = ~bad[owner]
        place, owner = place[good], owner[good]
        self.figures = np.zeros((len(split), 4), np.int64)
        np.add.at(self.figures, owner, memory.figures[place])
        bounds = np.searchsorted(owner, np.arange(len(split) + 1)).tolist()
        names = list(map(memory.names.__getitem__, place.tolist()))
        self.groups = [";".join(names[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        count = memory.figures[place, 3]
        first = np.repeat(memory.link_start[place] - (np.cumsum(count) - count), count)
        self.pair = memory.links[first + np.arange(len(first))]
        self.doc = np.repeat(owner, count)


@lru_cache(maxsize=1)
def load(first: str, second: str) -> Tokens:
    return Tokens(first, second)


@lru_cache(maxsize=1)
def memory(first: str, second: str) -> Remembered:
    return Remembered(load(first, second))


FORGET += [({"alignment"}, load.cache_clear), ({"alignment"}, memory.cache_clear)]


def pack_postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(pairs, documents of each, their sets, planes of how often) from links in the order of (pair, doc).

    A set is a bitmap over the block's documents, or their numbers in 16 bits each where that takes less. A plane holds
    a bit of (times - 1) for each document of the set; there are as many planes as the largest one needs.
    """
    head = np.ones(len(pair), bool)
    head[1:] = pair[1:] != pair[:-1]
    start = np.flatnonzero(head)
    n = np.diff(np.append(start, len(pair)))
    wide = (block + 7) // 8
    dense = n * 2 > wide
    length = np.where(dense, wide, n * 2)
    at = np.concatenate([[0], np.cumsum(length)])
    sets = np.zeros(at[-1], np.uint8)
    for i in np.flatnonzero(dense):
        bits = np.zeros(wide * 8, np.uint8)
        bits[doc[start[i] : start[i] + n[i]]] = 1
        sets[at[i] : at[i + 1]] = np.packbits(bits, bitorder="little")
    nth = np.arange(len(pair)) - np.repeat(start, n)
    sparse = np.repeat(~dense, n)
    place = (np.repeat(at[:-1], n) + nth * 2)[sparse]
    sets[place], sets[place + 1] = doc[sparse] & 255, doc[sparse] >> 8
    more = times - 1
    most = np.maximum.reduceat(more, start) if len(start) else np.zeros(0, np.int64)
    levels = np.zeros(len(start), np.int64)
    while (over := most >> levels > 0).any():
        levels[over] += 1
    width = (n + 7) // 8
    plane_at = np.concatenate([[0], np.cumsum(width * levels)])
    planes = np.zeros(plane_at[-1], np.uint8)
    for level in range(int(levels.max(initial=0))):
        has = np.repeat(levels > level, n) & (more >> level & 1).astype(bool)
        byte = np.repeat(plane_at[:-1] + level * width, n)[has] + (nth[has] >> 3)
        np.bitwise_or.at(planes, byte, (1 << (nth[has] & 7)).astype(np.uint8))
    return pair[start], n, _binary(sets, at), _binary(planes, plane_at)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpack_postings(n: np.ndarray, sets: list[bytes], planes: list[bytes], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, how often each) of all sets, one after the other."""
    wide = (block + 7) // 8
    docs = [
        np.flatnonzero(np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little")) if c * 2 > wide else np.frombuffer(s, "<u2")
        for c, s in zip(n.tolist(), sets, strict=True)
    ]
    times = np.ones(int(n.sum()), np.int64)
    begin = 0
    for c, p in zip(n.tolist(), planes, strict=True):
        if p:
            bits = np.unpackbits(np.frombuffer(p, np.uint8).reshape(-1, (c + 7) // 8), axis=1, bitorder="little")[:, :c]
            times[begin : begin + c] += (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(axis=0)
        begin += c
    return np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64), times


_MADE = (
    "block long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, n int, docs binary, planes binary, block_docs int"
)
_NAMES = [part.split()[0] for part in _MADE.split(", ")]


def _aligner(first: str, second: str):
    """Rows for documents, and rows of postings (with a pair) for the blocks they make up."""

    def table(length: int, **columns) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[part.split()[1]] for part in _MADE.split(", ")]
        arrays = [pa.nulls(length, t) if columns.get(c) is None else pa.array(columns[c], t) if not isinstance(columns[c], pa.Array) else columns[c] for c, t in zip(_NAMES, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, _NAMES)

    def run(batches):
        remembered = memory(first, second)
        block, docs, links = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def postings():
            key, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            key, times = key[order], times[order]
            pairs, n, sets, planes = pack_postings(key >> 16, key & 0xFFFF, times, docs)
            for start in range(0, len(pairs), 20_000):
                part = slice(start, start + 20_000)
                yield table(len(pairs[part]), block=np.full(len(pairs[part]), block), pair=pairs[part], n=n[part], docs=sets[part], planes=planes[part], block_docs=np.full(len(pairs[part]), docs))

        for batch in batches:
            ids = batch.column(0)
            done = 0
            for texts, _ in slices([batch.column(1)], SLICE):
                if docs + len(texts) > BLOCK_DOCS or links > BLOCK_LINKS:
                    if held:
                        yield from postings()
                    block, docs, links, held = block + 1, 0, 0, []
                found = remembered.texts(texts)
                hashes = [sha256(groups.encode()).hexdigest() if groups else "" for groups in found.groups]
                n_a, n_b, n_groups, n_links = found.figures.T
                yield table(
                    len(texts), block=np.full(len(texts), block), number=np.arange(docs, docs + len(texts)), doc_id=ids.slice(done, len(texts)),
                    n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=hashes,
                )
                key, times = np.unique(found.pair << 16 | (found.doc + docs), return_counts=True)
                if len(key):
                    held.append((key, times))
                docs, links, done = docs + len(texts), links + len(key), done + len(texts)
        if held:
            yield from postings()

    return run


_SCORED = "block long, number int, n_best long, count_sum long"


def _scores(batches):
    """Rows of postings with their pair's count, ordered by block, to the scores of the block's documents."""
    block, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows():
        number = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(number), block)), pa.array(number.astype(np.int32)), pa.array(best[number]), pa.array(total[number])],
            ["block", "number", "n_best", "count_sum"],
        )

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for begin, end in _stretches(blocks):
            part = batch.slice(begin, end - begin)
            if blocks[begin] != block:
                if block is not None:
                    yield rows()
                block, size = int(blocks[begin]), part.column("block_docs")[0].as_py()
                best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
            n = part.column("n").to_numpy().astype(np.int64)
            docs, times = unpack_postings(n, part.column("docs").to_pylist(), part.column("planes").to_pylist(), len(total))
            np.add.at(total, docs, times * np.repeat(part.column("count").to_numpy(), n))
            np.add.at(best, docs, times * np.repeat(part.column("top").to_numpy(), n))
    if block is not None:
        yield rows()


def _stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of equal neighbours."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    at = [0, *cut.tolist(), len(values)]
    return [(a, z) for a, z in zip(at[:-1], at[1:], strict=True) if z > a]


def pair_counts(postings: DataFrame, seconds: int) -> DataFrame:
    """(pair, count, top): documents of each pair of ids, and whether no pair of its first id has more (1 or 0)."""
    counts = postings.groupBy("pair").agg(F.sum("n").alias("count"))
    # an id of the first vocabulary has one row for each id of the second at most
    highest = F.max("count").over(Window.partitionBy(F.call_function("div", F.col("pair"), F.lit(seconds))))
    return counts.withColumn("top", (F.col("count") == highest).cast("long"))


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of the documents."""
    spark = docs.sparkSession
    with ends_shuffles(spark):
        made = kept(arrow_rows(docs.select(F.col("doc_id").cast("long"), "text"), _aligner(first, second), _MADE, "alignment"), "alignment")
        postings = made.filter("pair is not null")
        counted = kept(pair_counts(postings, len(load(first, second).second_bytes)), "pair-counts")
        rated = postings.select("block", "block_docs", "pair", "n", "docs", "planes").join(counted.hint("merge"), "pair")
        rated = rated.select("block", "block_docs", "n", "docs", "planes", "count", "top").repartition("block").sortWithinPartitions("block")
        scored = kept(arrow_rows(rated, _scores, _SCORED), "alignment-scores")
        dropped(counted)
        rows = made.filter("pair is null").join(scored.hint("merge"), ["block", "number"], "left")
        return rows.select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"
        )


def group_text(column, first: str, second: str):
    """The groups of a text column, like `a1,a2|b1;a3|b2,b3`; empty without tokens."""

    def run(batches):
        for batch in batches:
            out: list[str] = []
            for texts, _ in slices([batch], SLICE):
                out += memory(first, second).texts(texts).groups
            yield pa.array(out, pa.string())

    return arrow_column(run, "string", column, "alignment")
