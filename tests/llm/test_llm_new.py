"""Source divergence, byte dedup and cross-tokenizer alignment against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathloom.llm import alignment, divergence, suffix_dedup
from pathloom.llm.bpe import byte_letters

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], DOCS)


# byte dedup

def brute_bytes(rows, length):
    """doc_id -> (bytes, removed, runs, hash of the rest), for distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            stretch = data[i : i + length]
            if stretch in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(stretch)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def cut(docs, **options):
    found = suffix_dedup.dedup_bytes(docs, **options).withColumn("sha", F.sha2("kept", 256))
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in found.collect()}


@pytest.mark.parametrize(("length", "gram", "chunk"), [(20, 8, 2048), (20, 8, 3), (30, 5, 5), (12, 12, 2)])
def test_byte_dedup_against_brute_force(spark, length, gram, chunk):
    rng = random.Random(length + chunk)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices("abcdefg ", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(200, rows[7][1]), (201, None), (202, ""), (None, rows[9][1]), (203, "x" * 500), (204, "ab" * 300 + "x" * 90), (-3, rows[11][1] + "!")]
    got = cut(frame(spark, rows).withColumn("cuts", F.lit(1)).withColumn("_doc", F.lit("x")).withColumn("s", F.lit(2)), length=length, gram=gram, chunk=chunk)
    want = brute_bytes(rows, length)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_byte_dedup_long_texts_over_slices(spark, monkeypatch):
    rng = random.Random(5)
    block = "".join(rng.choices("abcdefghij ", k=9000))
    rows = [(1, block * 3 + "tail"), (2, "head" + block[500:4000]), (3, "".join(rng.choices("klmn", k=20_000))), (4, "y" * 700_000)]
    rows.append((5, rows[2][1][3000:]))
    assert cut(frame(spark, rows)) == brute_bytes(rows, 100)


def test_byte_dedup_repeated_rows_and_empty_tables(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=400))
    found = suffix_dedup.dedup_bytes(frame(spark, [(1, text), (1, text), (2, text), (2, text), (1, text[:200] + "zz")]))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found.collect())[2:] != []
    by_id = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in found.collect())
    assert by_id[-2:] == [(2, 400, 400), (2, 400, 400)]
    # one of the two different texts of document 1 comes first, by the hash of its text
    assert [r for r in by_id if r[0] == 1] in ([(1, 202, 0), (1, 400, 200), (1, 400, 200)], [(1, 202, 200), (1, 400, 0), (1, 400, 0)])
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert suffix_dedup.dedup_bytes(frame(spark, []).limit(0)).count() == 0


# cross-tokenizer alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows):
    """Rows by the definition, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {x: bytes([i]) for i, x in enumerate(byte_letters())}
    found, holders = [], defaultdict(set)
    for number, (doc, text) in enumerate(rows):
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")]
        names = [
            [b"".join(letters[x] for x in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]],
        ]
        if not text or any(b"".join(n) != (" " + text).encode() for n in names):
            found.append((doc, 0, 0, [], []))
            continue
        ends = [list(itertools.accumulate(map(len, n))) for n in names]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for c in common:
            groups.append(tuple([i for i, e in zip(ids[s], ends[s], strict=True) if low < e <= c] for s in (0, 1)))
            low = c
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        for link in set(links):
            holders[link].add(number)
        found.append((doc, len(ids[0]), len(ids[1]), groups, links))
    count = {link: len(x) for link, x in holders.items()}
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        best = sum(count[k] == top[k[0]] for k in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(count[k] for k in links), sha256(text.encode()).hexdigest() if groups else "", text))
    return sorted(out, key=str)


def test_alignment_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    odd = ["", " ", "  two  spaces ", "\ttab\n\nlines \r\n", "<|endoftext|> <s> </s> <unk>", "naïve café ﬁ ½", "日本語 한국어 🙂👍🏽", "▁ under", "a▁b", "x" * 300, "y" * 90 + " " + "z" * 90, "a\u180e b \u180ec \x1c d", "\x00 nul", "don't we'll 1234567 3.14", "é" * 90, " nb　sp"]
    pool = ["the", "house", "unbelievably", "Straße", "été", "of", "2024", "...", "naïveté", "\n"]
    rows = list(enumerate(odd)) + [(100 + i, " ".join(rng.choices(pool, k=rng.randint(1, 60)))) for i in range(70)]
    rows += [(5, odd[5]), (None, "the house"), (400, None), (401, "the of " * 3000)]
    docs = frame(spark, rows).withColumn("pair", F.lit(1)).withColumn("block", F.lit("b")).repartition(3)
    got = alignment.align(docs, A, B)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment(rows)
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == [x[:-1] for x in want]
    texts = docs.select(alignment.group_text(F.col("text"), A, B).alias("g"))
    assert sorted(r["g"] for r in texts.collect()) == sorted(x[-1] for x in want)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_remembered_parts_give_what_whole_texts_give(monkeypatch):
    """Over every code point next to a cut, with a memory that fills up and with none at all."""
    rng = random.Random(17)
    tokens = alignment.load(A, B)
    letters = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["\U0001f642", "\U000e0fff", "漢"]
    texts = ["a" + x + " " + x + "b 's" + x + " 1" + x for x in letters]
    texts += ["".join(rng.choices([" ", "  ", "\n", "ab", "é", "<|endoftext|>", "x" * 70, "9", "!"], k=rng.randint(1, 40))) for _ in range(300)]
    whole = [alignment.Aligned(tokens.encoded([t]) if t else [([], [])], tokens) for t in texts]
    monkeypatch.setattr(alignment, "MAX_PARTS", 300)
    remembered = alignment.Remembered(tokens)
    for begin in range(0, len(texts), 50):
        found = remembered.texts(texts[begin : begin + 50])
        for i, one in enumerate(whole[begin : begin + 50]):
            assert found.groups[i] == one.groups[0], texts[begin + i]
            assert found.figures[i].tolist() == [int(one.n[0][0]), int(one.n[1][0]), int(one.n_groups[0]), int(one.n_links[0])]
            assert sorted(found.pair[found.doc == i].tolist()) == sorted(one.pair.tolist())
    assert len(remembered.names) <= 400


def test_postings_round_trip():
    rng = np.random.default_rng(7)
    for block in (1, 9, 700, 65_536):
        rows = sorted({(int(p), int(d)) for p, d in zip(rng.geometric(0.05, 3000), rng.integers(0, block, 3000), strict=True)})
        pair, doc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        times = rng.geometric(0.3, len(pair)) + (rng.random(len(pair)) < 0.01) * 5000
        pairs, n, sets, planes = alignment.pack_postings(pair, doc, times, block)
        got, often = alignment.unpack_postings(n, sets.to_pylist(), planes.to_pylist(), block)
        assert np.array_equal(got, doc) and np.array_equal(often, times) and np.array_equal(np.repeat(pairs, n), pair)
        assert all(len(s) <= min(2 * c, (block + 7) // 8) for s, c in zip(sets.to_pylist(), n.tolist(), strict=True))


# source divergence

def brute_divergence(rows, min_docs, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, holders, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        words = word.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    for lang in holders:
        terms = [t for t, n in holders[lang].items() if n >= min_docs]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def share(count):
            size = sum(count[t] for t in terms) + len(terms)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // size for t in terms}

        q, p = share(whole), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms), o) for o in groups if o != s]
            best = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in terms if groups[s][t] and p[s][t] > q[t]]
            for part, values, limit in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("shard_terms", "block", "limit"), [(8192, 64, 50_000), (5, 2, 0)])
def test_divergence_against_brute_force(spark, monkeypatch, shard_terms, block, limit):
    monkeypatch.setattr(divergence, "MAX_SENT_GROUPS", limit)
    rng = random.Random(11)
    pool = ["Aa", "aa", "über", "x-y", "nb sp", "Straße", "日本", "ÉTÉ", "end.", "z9z", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(" ".join(rng.choices(pool, weights=range(1, 37), k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "B", "ü", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "xx", "one"), (None, "xx", "two"), ("rare", "yy", None), ("the " * 40_000, "en", "a")] + rows[:5]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("n"))
    got = sorted(tuple(r) for r in divergence.divergence(docs, top=7, shard_terms=shard_terms, block=block).collect())
    assert got == brute_divergence(rows, 3, 7)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_exact_shares_beyond_64_bits():
    counts = np.array([3, 2**40], np.int64)
    assert divergence.exact_shares(counts, 2**41).tolist() == [1 + 10**9 * (int(c) + 1) // 2**41 for c in counts]
