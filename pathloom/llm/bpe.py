"""Byte-pair encodings from the files of public tokenizers: vocabulary, merges and word splitting."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from tokenizers import Tokenizer

from pathloom.llm.common import FORGET, SPACE

WORD_END = "</w>"
#: Words kept in a worker's memory; longer words are encoded each time.
CACHE_WORDS = 500_000
CACHE_WORD_CHARS = 64
_PART_CHARS = 1 << 18


def trim_cache(words: dict, limit: int = CACHE_WORDS) -> None:
    """Drop the latest quarter of a full cache: frequent words come early, and stay."""
    if len(words) > limit:
        for word in list(islice(words, limit * 3 // 4, None)):
            del words[word]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Merges:
    """Ids of the first symbols and, for each pair of ids that merges, its rank and the id it gives.

    Merging by ascending rank is exact if a pair holding a symbol ranks behind the merge that makes the symbol;
    the constructor checks it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = self.vocabulary | self.special
        self.size = max(self.ids.values()) + 1
        self.names = [""] * self.size
        for name, i in self.ids.items():
            self.names[i] = name
        self.rank: dict[int, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.result: list[int] = []
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]):
            left, right, new = self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]
            self.rank.setdefault(left << 20 | right, rank)
            self.left.append(left)
            self.right.append(right)
            self.result.append(new)
            made[new] = rank
        for rank, (left, right) in enumerate(zip(self.left, self.right, strict=True)):
            if made.get(left, -1) >= rank or made.get(right, -1) >= rank:
                raise ValueError(f"{path}: merge {rank} uses a symbol that a later merge makes")
        letters = byte_letters()
        self.first = [self.vocabulary[x] for x in letters]
        self.last = [self.vocabulary.get(x + WORD_END, -1) for x in letters]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def symbols(self, word: str, ends: bool) -> list[int]:
        """Ids of the word's bytes; the last one carries the word end if the vocabulary has word ends."""
        data = word.encode("utf-8", "replace")
        ids = [self.first[b] for b in data]
        if ends and ids:
            ids[-1] = self.last[data[-1]]
        return ids

    def sections(self, text: str):
        """(special id or None, text) in order: special strings are found in the raw text."""
        start = 0
        for hit in self.cut.finditer(text) if self.cut and "<|" in text else ():
            if hit.start() > start:
                yield None, text[start : hit.start()]
            yield self.special[hit[0]], ""
            start = hit.end()
        if start < len(text):
            yield None, text[start:]


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


#: The word patterns of the two vocabularies.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """For each code point, whether this Python's Unicode tables give it no meaning; other tables may class it otherwise."""
    return np.fromiter((unicodedata.category(chr(code)) == "Cn" for code in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=1)
def _reordered() -> np.ndarray:
    """Those, and the combining marks, which other tables may order otherwise."""
    marks = np.fromiter((unicodedata.combining(chr(code)) > 0 for code in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return marks | _unassigned()


def has_unassigned(text: str, marks: bool = False) -> bool:
    """Whether a text holds such a code point (or a combining mark), looked up in parts of bounded size."""
    if text.isascii():
        return False
    unknown = _reordered() if marks else _unassigned()
    for start in range(0, len(text), _PART_CHARS):
        codes = np.frombuffer(text[start : start + _PART_CHARS].encode("utf-32-le", "replace"), "<u4")
        if unknown[codes].any():
            return True
    return False


@lru_cache(maxsize=1)
def letter_bytes() -> dict[str, int]:
    return {letter: byte for byte, letter in enumerate(byte_letters())}


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


FORGET += [({"encoding", "counts", "library"}, forget) for forget in (load.cache_clear, library.cache_clear)]


def words_by_library(text: str, path: str) -> list[str]:
    """Words as the tokenizer's own normaliser and splitter give them, for texts with unassigned code points."""
    tokenizer = library(path)
    letters = letter_bytes()
    normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
    return [bytes(letters[x] for x in word).decode() for word, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


def words_of(text: str, path: str, split) -> list[str]:
    """Words by one of the splitters below, or by the library where code points are unassigned."""
    return words_by_library(text, path) if has_unassigned(text) else split(text)


def lower_words(text: str, path: str, seen: dict[bytes, list[str]]) -> list[str]:
    """Words of the lower-case vocabulary with word ends: NFC, letters lower-cased one by one; no word holds white space.

    In texts with combining marks or unassigned code points, what stands between ASCII white space is split by itself:
    no pattern and no composition of marks reaches across. Parts beyond ASCII take the tokenizer's own normaliser and
    splitter there, once as long as `seen` has them.
    """
    if not has_unassigned(text, marks=True):
        return normal_words(text)
    words: list[str] = []
    for part in text.encode("utf-8", "replace").split():
        if part.isascii():
            words += _WORDS.findall(part.decode().lower())
            continue
        found = seen.get(part)
        if found is None:
            found = words_by_library(part.decode(), path)
            if len(part) <= CACHE_WORD_CHARS:
                seen[part] = found
        words += found
    return words


def normal_words(text: str) -> list[str]:
    """Words of a text without combining marks."""
    return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def byte_pieces(text: str) -> list[str]:
    """Pieces of the byte-level vocabulary; they make up the whole text."""
    return _PIECES.findall(text)
