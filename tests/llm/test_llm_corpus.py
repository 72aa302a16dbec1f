"""Operators that compare documents or learn from them: line dedup, URL filter, toxicity, near-dedup, language model."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import decontaminate, language_model, line_dedup, near_dedup, toxicity, url_filter
from pathloom.llm.common import ascii_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], DOCS)


#: Names that operators use themselves; a caller's columns of these names stay as they are.
CLASHING = (
    "ranges", "removed", "row", "rest", "_removed", "_lines", "_gaps", "_doc", "_text", "_found", "_items", "_spans", "_toxicity", "node", "class_doc",
    "fp", "no", "words", "a.b",
)


def clashing(docs):
    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


def unharmed(docs):
    return all(r[name] == f"own {name}" for r in docs.collect() for name in CLASHING)


def test_stages_leave_other_columns_alone(spark):
    rng = random.Random(12)
    texts = [words(rng, 120) for _ in range(4)]
    docs = clashing(frame(spark, [(1, texts[0]), (2, texts[1]), (2, texts[1]), (3, texts[1] + " end"), (4, None), (5, ""), (6, texts[2] + "\n" + texts[3])]))
    items = spark.createDataFrame([("x", texts[2])], "item_id string, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"))
    stages = [
        toxicity.keep_clean(docs, model), line_dedup.without_repeats(docs), near_dedup.first_of_each(docs),
        decontaminate.clean_documents(docs, items), decontaminate.clean_documents(docs, items.union(items), max_item_bytes=100),
    ]
    for left in stages:
        assert left.columns == docs.columns and unharmed(left) and left.count() >= 3


def words(rng, count, pool=200):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(count))


# line dedup

def rule_lines(rows, run_words):
    """Text and removed lines by the rule, for distinct ids: the later one of any two equal runs of enough words goes."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [(d, i, x.strip(" \t\r")) for d, t in order if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    where, gone = defaultdict(list), defaultdict(set)
    for place, (_, _, line) in enumerate(lines):
        where[line].append(place)

    def follows(p):
        return p + 1 < len(lines) and lines[p + 1][0] == lines[p][0]

    for places in where.values():
        for n, y in enumerate(places):
            for x in places[:n]:
                if x and lines[x - 1][::2] == (lines[x][0], lines[y - 1][2]) and lines[y - 1][0] == lines[y][0]:
                    continue  # the match began earlier
                size, total = 1, lines[x][2].count(" ") + 1
                while follows(x + size - 1) and follows(y + size - 1) and lines[x + size][2] == lines[y + size][2]:
                    total += lines[x + size][2].count(" ") + 1
                    size += 1
                if total >= run_words:
                    gone[lines[y][0]].update(range(lines[y][1], lines[y + size - 1][1] + 1))
    return {d: (None, 0) if t is None else ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in order}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = [words(rng, rng.randint(1, 9), 50) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (None, rows[5][1]), (103, "\n".join([pool[0]] * 30))]
    docs = clashing(frame(spark, rows))
    left = line_dedup.dedup_lines(docs, 12, 6)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in left.collect()}
    assert got == rule_lines(rows, 12)
    assert sum(n for _, n in got.values()) > 50
    assert left.columns == [*docs.columns, "n_removed"] and unharmed(left)


def test_line_dedup_repeated_rows_and_empty_tables(spark):
    rng = random.Random(1)
    text = "\n".join(words(rng, 30) for _ in range(3))
    docs = frame(spark, [(1, text), (1, text), (2, text), (3, "short")])
    got = Counter((r["doc_id"], r["text"] == text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == {(1, True): 2, (2, False): 1, (3, False): 1}
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 1, 3]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_removes_whole_matches(spark):
    rng = random.Random(8)
    passage = "\n".join(words(rng, n) for n in (30, 30, 15))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, [(1, passage), (2, passage + "\nforeign"), (3, "own\n" + passage)])).collect()}
    assert got == {1: passage, 2: "foreign", 3: "own"}
    pool = [words(rng, rng.choice([1, 2, 3, 5, 8, 12, 15]), 60) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(0, 14)))) for i in range(50)]
    rows += [(100 + i, "x y z\n" + rows[i][1] + "\nz y x") for i in range(0, 50, 5)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(spark, rows), 12, 6).collect()}
    assert got == rule_lines(rows, 12)


# near-dedup

def brute_classes(rows, similarity=0.8):
    sets, key = [], []
    for doc, text in rows:
        w = ascii_words(text or "")
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        key.append(doc)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(key[i])
    return {d: min(g) for g in groups.values() for d in g}


def test_near_classes_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for group in range(25):
        base = words(rng, rng.choice([3, 6, 40, 120]), 5000).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) * 7, " ".join(copy)))
    rows += [(5001, ""), (5002, None), (5003, " . "), (5004, rows[0][1].upper())]
    docs = frame(spark, rows).withColumn("node", F.lit("x")).withColumn("class_id", F.lit(1))
    report = near_dedup.report(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in report} == brute_classes(rows)
    first = near_dedup.first_of_each(docs)
    assert first.columns == docs.columns
    assert sorted(r["doc_id"] for r in first.collect()) == sorted({*brute_classes(rows).values()})


def test_near_dedup_repeated_rows_and_empty_tables(spark):
    docs = frame(spark, [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "A, B c"), (None, None), (None, None)])
    rows = near_dedup.report(docs).collect()
    assert len(rows) == 6 and sum(r["kept"] for r in rows) == 4
    assert Counter((r["doc_id"], r["text"]) for r in near_dedup.first_of_each(docs).collect()) == {(None, "A, B c"): 1, (1, "d e f"): 1, (None, None): 1}
    assert near_dedup.report(docs.limit(0)).count() == 0


def test_dart_entries_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    u = rng.integers(0, 6, 300).astype(float)
    v = np.where(rng.random(300) < 0.7, u, rng.integers(0, 6, 300))
    x, y = u > 0, v > 0
    entries = near_dedup.dart_entries(
        np.concatenate([items[x], items[y]]), np.concatenate([u[x], v[y]]), np.repeat([0, 1], [x.sum(), y.sum()]), 2, 2000
    )
    assert abs((entries[0] == entries[1]).mean() - np.minimum(u, v).sum() / np.maximum(u, v).sum()) < 0.04


# URL filter

def brute_judge(rows, rules):
    """host, path, rule and verdict of urls, one after the other: rules, then Viterbi and naive Bayes over plain lists."""
    import re

    texts = [re.sub(r"<[^>]*>|[\W\d_]+", " ", html.lower()).split() for _, _, html in rows if html is not None]
    counts = Counter(w for t in texts for w in t)
    total = sum(counts.values())

    def cut(part):
        best = [(0.0, [])]
        for end in range(1, len(part) + 1):
            tried = []
            for start in range(end):
                word = part[start:end]
                cost = math.log(counts[word] / total) if word in counts else math.log(1 / (total + 1)) - len(word) * math.log(10)
                tried.append((best[start][0] + cost, -start, [*best[start][1], word]))
            cost, _, split = max(tried)
            best.append((cost, split))
        return best[-1][1]

    judged = []
    for page, url, _ in rows:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), found[2]) if found else ("", "")
        fits = [(len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule, says = (max(fits)[1:]) if fits else (None, None)
        tokens = ["h:" + w for part in re.findall(r"[^.\-_0-9]+", host) for w in cut(part)] + ["p:" + w for w in re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", path))]
        judged.append((page, host, path, rule, says, tokens))
    table = defaultdict(lambda: [0, 0])
    for *_, says, tokens in judged:
        for t in tokens:
            table[t][0] += says == "block"
            table[t][1] += says == "allow"
    blocked, allowed = (sum(v[i] for v in table.values()) for i in (0, 1))
    n = [sum(j[4] == v for j in judged) for v in ("block", "allow")]
    seen = len(table) or 1
    out = {}
    for page, host, path, rule, says, tokens in judged:
        odds = math.log((n[0] + 0.5) / (n[1] + 1)) + sum(math.log((table[t][0] + 1) / (blocked + seen)) - math.log((table[t][1] + 1) / (allowed + seen)) for t in tokens)
        out[page] = (host, path, rule, says or ("block" if round(odds, 6) > 0 else "allow"), round(odds, 4))
    return out


def test_url_verdicts_against_brute_force(spark):
    rng = random.Random(31)
    vocabulary = ["news", "cheap", "pills", "garden", "tools", "casino", "win", "blog", "a" * 30]
    rows = []
    for i in range(160):
        host = ".".join("".join(rng.choices(vocabulary, k=rng.randint(1, 3))) + rng.choice(["", "7", "-x", "Qq" * 20]) for _ in range(rng.randint(1, 2)))
        tail = rng.choice([".com", ".net", ".org", ".EXAMPLE.com", ".io"])
        path = rng.choice(["", "/", "/es/win", "/fr/2024/casino?x=/es/", "/en/blog-9", "/tools/garden#win"])
        rows.append((i, rng.choice(["http", "https"]) + "://" + host + tail + path, "<p>" + " ".join(rng.choices(vocabulary, k=12)) + "</p>"))
    rows += [(900, None, None), (901, "no scheme", "text"), (902, "://", ""), (903, "x://" + "z" * 300 + ".org/", "long")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("token", F.lit(1)).withColumn("host", F.lit("h"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], round(r["log_odds"], 4)) for r in url_filter.judge(pages).collect()}
    want = brute_judge(rows, url_filter.RULES)
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}
    assert all(got[k][4] == pytest.approx(want[k][4], abs=2e-4) for k in want)
    assert len({v[3] for k, v in got.items() if v[2] is None}) == 2


def test_url_rules(spark):
    urls = {
        "http://www.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/2#t": ("m.example.com", "/en/2", "example.com/en/", "block"),
        "https://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "https://com": ("com", "", None, None),
        "https://a.net/es/x": ("a.net", "/es/x", "net/es/", "block"),
        "https://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "https://a.net?u=/fr/": ("a.net", "", None, None),
        "no scheme.com/": ("", "", None, None),
        None: ("", "", None, None),
        "://x.com/a://b/c": ("x.com", "/a://b/c", "com/", "allow"),
        "http://x.com/a\nb": ("x.com", "/a\nb", "com/", "allow"),
        "": ("", "", None, None),
    }
    rows = [(i, u, "<p>ab cd ab</p>") for i, u in enumerate(urls)] + [(None, "https://a.net/fr/", None), (0, "https://com", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("token", F.lit(1))
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got if r["page_id"]}
    for i, (url, want) in enumerate(urls.items()):
        if i:
            row = by_id[i]
            assert (row["host"], row["path"], row["rule"]) == want[:3], url
            assert row["verdict"] == want[3] if want[3] else row["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_segmentation_is_the_best_of_all():
    counts, total = {"the": 50, "rest": 9, "there": 4, "st": 3, "a": 20, "art": 6, "red": 5}, 97

    def cost(word):
        n = counts.get(word)
        return math.log(n / total) if n else math.log(1 / (total + 1)) - len(word) * math.log(10)

    def best(text):
        return 0.0 if not text else max(cost(text[:i]) + best(text[i:]) for i in range(1, len(text) + 1))

    for text in ("therestart", "xthered", "aaart", "q", "zzthezz"):
        split = url_filter.segment(text, counts, total)
        assert "".join(split) == text and math.isclose(sum(map(cost, split)), best(text))


def test_method_learns_from_rules(spark):
    rows = [(i, f"https://badshop.net/es/{i}", "<b>bad good shop news</b>") for i in range(20)]
    rows += [(100 + i, f"https://goodnews.com/{i}", "") for i in range(20)] + [(200, "https://badbad.org/es/7", ""), (201, "https://newsgood.org/9", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[200] == "block" and got[201] == "allow"


# toxicity

def brute_best_segments(scores):
    """All maximal segments by the recursive definition: the best one, then left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = round(sum(scores[i:j]), 9)
            if total > 0 and (best is None or total > best[2] or (total == best[2] and (j - i) < best[1] - best[0])):
                best = (i, j, total)
    if best is None:
        return []
    left = brute_best_segments(scores[: best[0]])
    right = [(a + best[1], b + best[1], s) for a, b, s in brute_best_segments(scores[best[1] :])]
    return [*left, best, *right]


def test_maximal_segments():
    rng = random.Random(6)
    for _ in range(150):
        scored = {i: rng.choice([3.13, 2.07, 4.51, 1.03]) for i in range(30) if rng.random() < 0.3}
        scores = [scored.get(i, -0.9) for i in range(30)]
        got = toxicity.maximal_segments(list(scored), list(scored.values()), 0.9)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_best_segments(scores)]


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    bad = ["vile", "nasty", "awful"]
    rows, labels = [], []
    for i in range(800):
        text = words(rng, rng.randint(5, 120), 3000).split()
        toxic = i % 8 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, "\n".join([" ".join(text)])))
        labels.append((i, int(toxic)))
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (None, "vile nasty"), (1, rows[1][1])]).withColumn("token", F.lit(1))
    marks = spark.createDataFrame([*((d, t) for d, t in labels if d % 2 == 0), (None, 1), (4, None), (6, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert {w.decode() for w in model.weights} == set(bad)
    got = toxicity.score(docs, model).select("doc_id", "text", "_toxicity.*").collect()
    truth = dict(labels)
    assert all((r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth)
    assert all(0 <= r["score"] < 0.3 for r in got if not r["text"])
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 101
    blank = toxicity.train(docs, marks.filter("toxic = 0"))
    assert not blank.weights and toxicity.score(docs, blank).filter("_toxicity.score >= 0.3").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs, marks.limit(0))).count() == 0


# language model

def brute_model(texts):
    """Interpolated modified Kneser-Ney probabilities by the definition, over letters."""
    order = language_model.ORDER
    grams = Counter()
    for text in texts:
        line = (0,) * (order - 1) + tuple(map(int, language_model.letter_codes(text)))
        for i in range(order - 1, len(line)):
            grams[line[i - order + 1 : i + 1]] += 1
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    off = {}
    for n, table in tables.items():
        n1, n2, n3, n4 = (sum(v == i for v in table.values()) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [i - (i + 1) * y * b / a if a else 0.5 * i for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        off[n] = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)]
    context = {n: defaultdict(list) for n in tables}
    for n, table in tables.items():
        for g, c in table.items():
            context[n][g[:-1]].append(c)

    def chance(gram):
        n = len(gram)
        if not n:
            return 1 / (len(tables[1]) + 1)
        counts = context[n].get(gram[:-1])
        if not counts:
            return chance(gram[1:])
        loss = sum(off[n][min(c, 3) - 1] for c in counts)
        c = tables[n].get(gram, 0)
        return (c - off[n][min(c, 3) - 1] if c else 0) / sum(counts) + loss / sum(counts) * chance(gram[1:])

    def bits(text):
        line = (0,) * (order - 1) + tuple(map(int, language_model.letter_codes(text)))
        return -sum(math.log2(chance(line[i - order + 1 : i + 1])) for i in range(order - 1, len(line)))

    return bits


@pytest.mark.parametrize("shard_rows", [10**6, 150])
def test_language_model_against_brute_force(spark, shard_rows):
    rng = random.Random(12)
    trusted = [words(rng, rng.randint(1, 30), 40) for _ in range(25)] + ["é你", ""]
    other = [words(rng, 10, 90), "zzz qqq", "\x00\x01", "", None, trusted[0], "w1"]
    model = language_model.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    docs = frame(spark, [*enumerate(other), (0, other[0]), (None, "w2 w3")])
    bits = brute_model(trusted)
    got = language_model.score(docs, model, shard_rows).collect()
    assert len(got) == docs.count()
    want = {d: (bits(t or ""), len(t or "")) for d, t in [*enumerate(other), (None, "w2 w3")]}
    for row in got:
        assert row["n"] == want[row["doc_id"]][1] and abs(row["bits"] - want[row["doc_id"]][0]) < 1e-6


def test_language_model_verdicts(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 60, 300)) for i in range(120)] + [(500, "@@##$$ " * 40), (501, None), (502, "")]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("n", F.lit("x"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100)] + [(None, 1), (500, 0), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in language_model.judge(docs, labels).collect()}
    assert [d for d, keep in got.items() if not keep] == [500] and len(got) == len(rows)
    assert language_model.judge(docs, labels.limit(0)).filter("not kept").count() == 0
    assert language_model.judge(docs.limit(0), labels).count() == 0


def test_letters_of_any_script_are_told_apart(spark):
    texts = ["的一是不了人我在有他", "가나다라마바사아자차", "“a”—b…🙂", "\x00\x01"]
    twins = ["".join(chr(ord(x) + 64) for x in t) for t in texts]
    model = language_model.train(frame(spark, enumerate(texts)))
    bits = brute_model(texts)
    got = {r["doc_id"]: r["bits"] for r in language_model.score(frame(spark, enumerate(texts + twins)), model).collect()}
    assert all(abs(got[i] - bits(t)) < 1e-6 for i, t in enumerate(texts + twins))
    assert all(got[i + 4] > got[i] + 1 for i in range(3))


def test_threshold_is_a_quantile_of_unseen_documents(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(20, 60), 300)) for i in range(40)] + [(500, "w1 " * 60)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    folds = {r[0]: r[1] for r in docs.select("doc_id", language_model.fold_of("doc_id")).collect()}
    scored = []
    for fold in range(language_model.FOLDS):
        bits = brute_model([t for d, t in rows if d < 40 and folds[d] != fold])
        scored += [(bits(t), len(t)) for d, t in rows if d < 40 and folds[d] == fold]
    mean = sum(b for b, _ in scored) / sum(n for _, n in scored)
    prior = language_model.PRIOR_LETTERS
    drawn = sorted((b + prior * mean) / (n + prior) for b, n in scored)
    got = {r["doc_id"]: r for r in language_model.judge(docs, labels, 0.9).collect()}
    assert abs(got[0]["threshold"] - 2 ** drawn[35]) < 1e-3
    assert all(r["kept"] == (r["judged"] <= r["threshold"]) for r in got.values())
    lone = language_model.judge(docs, labels.filter("doc_id = 7")).filter("doc_id = 7").first()
    assert lone["kept"]


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {d: t for d, t in left.items() if toxicity.assess(t or "", model)["score"] < toxicity.THRESHOLD}
    cut = rule_lines(list(left.items()), line_dedup.RUN_WORDS)
    left = {d: t for d, (t, n) in cut.items() if not n or t.strip()}
    classes = brute_classes(list(left.items()))
    left = {d: t for d, t in left.items() if classes[d] == d}
    tables = decontaminate.search_tables(items)
    left = {d: t for d, t in left.items() if not decontaminate.search_text(t or "", tables)["items"]}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert sorted(got) == sorted(left)


def test_entry_adds_the_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_signatures_do_not_depend_on_what_is_thrown_together(monkeypatch):
    rng = random.Random(5)
    texts = ["", *(words(rng, rng.randrange(30)) for _ in range(200))]
    few = near_dedup.signatures(texts, False, near_dedup.BANDS, near_dedup.BAND_ROWS)
    monkeypatch.setattr(near_dedup, "SQUARES", 1)
    one = near_dedup.signatures(texts, False, near_dedup.BANDS, near_dedup.BAND_ROWS)
    for a, b in zip(few, one, strict=True):
        assert a["node"] == b["node"]
        assert (a["bands"] is None and b["bands"] is None) or a["bands"].tolist() == b["bands"].tolist()
