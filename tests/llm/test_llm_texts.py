"""Operators that work text by text: decontamination, encoding, token files, token counts, quality rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm import bpe, decontaminate, encoding, quality_rules, token_count, token_files
from pathloom.llm.common import shared_folder

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

POOL = "aAbB sS'tTdDreVLmM  \n\t\x1c\x85\xa0ΑΣσςİıßẞéñ你好한ก12½²☃😀<|>\x00\x7f.,!?\u0558\ua7cb\u200b"


def odd_texts(count, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(count)]
    return texts + ["", "   ", "x<|endoftext|>y <|startoftext|><|endoftext|> z", "<|endoftext", "a  <|endoftext|>  b", "ab" * 3000, "Word " * 2000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(odd_texts(150))]
    rows += [(None, None, None, None, None), (3, "again", None, None, 5), (3, "again", None, None, 5), (7, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash")).withColumn("_found", F.lit(1)).withColumn("n_tokens", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple((v is not None, v) for v in row)


def test_encoding_equals_the_library(docs, empty):
    library = Tokenizer.from_file(WORD)
    rows = encoding.encode_documents(docs, WORD).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert encoding.encode_documents(docs, WORD).count() == docs.count()
    for row in rows:
        if row["doc_id"] in (3, 7):
            continue
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert encoding.encode_documents(empty, WORD).count() == 0


def test_null_ids_decode_as_empty(spark):
    frame = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert [r[0] for r in frame.select(encoding.decoded(F.col("ids"), WORD)).collect()] == ["", ""]


def test_counts_equal_the_library(docs, empty):
    library = Tokenizer.from_file(BYTE)
    got = sorted((key(r) for r in token_count.count_tokens(docs, BYTE, 40).collect()))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = [(d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 40) for d, t in texts]
    assert got == sorted(map(key, want))
    assert token_count.count_tokens(empty, BYTE).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for count in (0, 1, 4095, 4096, 4097, 10000):
        ids = rng.integers(0, 2**bits, count, dtype=np.uint64).astype("<u4")
        payload, offsets = token_files.pack_ids(ids, bits)
        assert len(payload) <= (count * bits + 7) // 8 + len(offsets)
        assert (token_files.unpack_ids(payload, offsets, bits, 0, count) == ids).all()
        for start, size in ((count // 3, count // 2), (max(0, count - 1), min(1, count)), (0, 0)):
            assert (token_files.unpack_ids(payload, offsets, bits, start, size) == ids[start : start + size]).all()


def test_token_files(spark, docs, empty):
    library = Tokenizer.from_file(WORD)
    folder = shared_folder(spark, "test-tokens")
    token_files.write_token_files(docs, folder, WORD, 1)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == docs.count()
    start = 0
    for row in rows:
        assert row["start"] == start
        start += row["n_tokens"]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] not in (3,)}
    for row in rows:
        if row["doc_id"] in texts and row["doc_id"] != 7:
            want = np.array([*library.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 1], "<u4").tobytes()
            assert row["ids"] == want and zlib.crc32(want) == zlib.crc32(row["ids"])
    folder = shared_folder(spark, "test-tokens")
    token_files.write_token_files(empty, folder, WORD, 1)
    assert token_files.read_token_files(spark, folder).count() == 0


def brute_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    covered, names = set(), set()
    for item, item_text in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item_text or ""))
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[i : i + size]:
                    covered.update(range(p, p + size))
                    names.add(item)
    return len(words), len(covered), len(names)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, limit):
    rng = random.Random(3)
    words = ["the", "OF", "a1", "é", "b", "to"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 10, 11, 14])))) for i in range(12)]
    items = [(f"q{i}" if i % 2 else str(i), t) for i, t in items]
    items += [("50", ""), ("51", None), (None, "the of"), (None, "é b"), ("52", "... !"), ("q1", items[1][1])]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"x {items[5][1]}, y", "", None, "...", texts[0], (items[2][1] + ". ") * 50]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = sorted(key((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"])) for r in decontaminate.report(docs, bench, max_item_bytes=limit).collect())
    want = [(r["doc_id"], *(h := brute_hits(r["text"], items)), h[1] > 0) for r in docs.collect()]
    assert got == sorted(map(key, want))
    for row in decontaminate.report(docs, bench, max_item_bytes=limit).collect():
        named = [i for i in row["items"] if i is not None]
        assert named == sorted(named) and row["items"] == named + [None] * (len(row["items"]) - len(named))
        assert row["spans"] == sorted(row["spans"]) and all(a["last"] < b["first"] for a, b in zip(row["spans"], row["spans"][1:]))
    clean = decontaminate.clean_documents(docs, bench, max_item_bytes=limit)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontaminate.report(docs, bench.limit(0), max_item_bytes=limit).filter("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench, max_item_bytes=limit).count() == 0


def test_very_long_text_is_searched_in_parts(monkeypatch):
    from pathloom.llm import common

    rng = random.Random(9)
    words = ["the", "of", "a", "b"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([2, 5, 10, 12, 15])]
    text = " ".join(rng.choice(words) for _ in range(3000)) + " " + items[4][1]
    tables = decontaminate.search_tables(items)
    whole = decontaminate.search_text(text, tables)
    monkeypatch.setattr(common, "_CUT", 37)
    assert decontaminate.search_text(text, tables) == whole
    assert (whole["n_words"], sum(s["last"] - s["first"] for s in whole["spans"]), len(whole["items"])) == brute_hits(text, items)


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for places in windows.values() if len(places) > 1 for p in places for j in range(p, p + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside)


def test_quality_figures(spark, docs, empty):
    extra = [(900 + i, t, None, None, None) for i, t in enumerate(["a b c d e f g h " * 4, "x\nx\n\n\n \nx ", "w " * 30, "one two three four five six seven eight nine\n" * 3])]
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, DOCS))
    got = sorted(key((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in quality_rules.judge(frame).collect())
    want = []
    for row in frame.collect():
        f = brute_figures(row["text"])
        want.append((row["doc_id"], *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert got == sorted(map(key, want))
    assert quality_rules.judge(empty).count() == 0


def test_em_finds_the_bad_documents():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.9
    chance = np.where(truth[:, None], 0.005, np.where(rng.random((4000, 8)) < 0.4, 0.9, 0.02))
    patterns = np.where(rng.random((4000, 8)) < chance, -1, 1)
    distinct, back, counts = np.unique(patterns, axis=0, return_inverse=True, return_counts=True)
    good = quality_rules.posteriors(distinct, *quality_rules.estimate(distinct, counts.astype(float)))[back.ravel()]
    assert ((good >= 0.5) == truth).mean() > 0.95 and (good[truth] >= 0.5).mean() > 0.99


def test_kept_needs_the_base(spark):
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert rows and not any(r["kept"] and r["base_failed"] for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)


def test_digest_columns(spark):
    from pathloom.llm import queries

    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {d: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for d, t in texts.items()}
    coded = queries.op4_bpe(spark, folder).collect()
    assert len(coded) == len(texts)
    for row in coded:
        mine = ids[row["doc_id"]]
        assert row["n_tokens"] == len(mine) and row["ids_sha256"] == hashlib.sha256(mine.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(mine.tolist(), skip_special_tokens=False).encode()).hexdigest()
    start = 0
    packed = {r["doc_id"]: r for r in queries.op7_token_files(spark, folder).collect()}
    for doc in sorted(texts):
        whole = np.append(ids[doc], 1).astype("<u4")
        assert (packed[doc]["start"], packed[doc]["n_tokens"], packed[doc]["ids_crc32"]) == (start, len(whole), zlib.crc32(whole.tobytes()))
        start += len(whole)


def test_unassigned_code_points_are_found_anywhere():
    assert not any(map(bpe.has_unassigned, ["", "plain", "é漢😀\n\u2028", "\ue000"]))
    assert bpe.has_unassigned("\u0378") and bpe.has_unassigned("é" * (2 * bpe._PART_CHARS) + "\U000e0fff")
    assert not bpe.has_unassigned("é" * (2 * bpe._PART_CHARS))


def test_combining_marks_as_the_library_has_them():
    """All combining marks beside two common ones, in words of their own: ids of both ways to encode are the library's."""
    import unicodedata

    from pathloom.llm import encoding

    library = Tokenizer.from_file(WORD)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))] + ["\u07fd", "\u0898", "\u08ca", "\u09fe", "\u1df9", "\ua82c"]
    texts = ["q\u0309" + m + " A" + m + "\u0323 \u00a0" + m + "x " + m + "\n" + m for m in marks]
    texts.append(" ".join(texts[::7]) + " <|endoftext|>" + " ".join(texts[::5]))
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoding.encode_texts(texts, WORD) == want
    assert [token_files.library_ids(t, WORD) for t in texts] == want


def test_ascii_controls_as_the_library_has_them():
    from pathloom.llm import encoding

    library = Tokenizer.from_file(WORD)
    texts = [f"a{chr(c)}b {chr(c)} é{chr(c)}É\u03a3 it's{chr(c)}'s 12" for c in [*range(1, 256), 0x1680, 0x180E, 0x2028, 0x200B, 0x3000, 0xFEFF]]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoding.encode_texts(texts, WORD) == want
    assert [token_files.library_ids(t, WORD) for t in texts] == want
