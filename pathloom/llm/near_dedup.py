"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a set of shingles of five words (A-Z lower-cased; fewer words make one shingle), each with a weight: one,
or its number of occurrences. DartMinHash throws darts, fixed by hashes, at the plane of weight and rank of every
shingle: each unit square holds a Poisson(1) number of them. A document is hit by the darts below its shingles'
weights and below a rank that lets about k ln k + 2k darts through; each dart belongs to one of k coordinates, and the
earliest dart of a coordinate is its entry. The work is in proportion to shingles plus darts, not shingles times
coordinates. Documents that leave a coordinate empty are thrown at again to twice the rank.

Entries equal with probability the (weighted) Jaccard similarity. They are joined in BANDS bands of BAND_ROWS; two
documents at 0.8 share no band in (1 - 0.8^4)^25 = 2 in a million cases. Then the exact similarity decides.

- Texts of the same words are one class from the start, so copies never meet each other.
- In a bucket every class is compared with one leader only (as many links as rows), the class that meets most others,
  and linked classes are components. Where a bucket then still holds more than one component, the pairs across its
  components that can reach the similarity at all, by sizes, items of the leader and items no other set has, are compared
  as well. So no link between different texts that share a bucket is missed, and a group of near copies is not paired
  with itself.
- Shingle sets are made for classes that share a bucket only.

Defined results: documents without words (null, empty, blanks) are classes of their own; rows alike in doc_id and text
are one document (one row stays); the class id is the least doc_id of the class, a document without id comes first;
extra columns are left aside or, where documents are returned, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import NO_ID, SLICE_CHARS, arrow_column, ascii_words, in_slices, kept, rows_held, salted_join, with_key
from pathloom.operators.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
BAND_ROWS = 4
SEED = 0x5851F42D4C957F2D
#: Unit squares thrown at together. Even a document of one shingle needs some hundreds, so characters don't bound them.
SQUARES = 1 << 18

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIGNATURE = pa.struct([("node", pa.binary()), ("bands", pa.list_(pa.int64()))])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def shingles(words: list[bytes], counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, weights) of a text's shingles."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    rolled = np.full(count, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            rolled = mix(rolled * _GOLD + hashes[i : i + count])
    items, counts = np.unique(rolled, return_counts=True)
    return items, counts.astype(np.float64) if counted else np.ones(len(items))


#: Chances that a unit square holds at most 0, 1, 2, ... darts.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def dart_entries(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """(owners, k) entries: the id of the earliest dart of every coordinate. Every owner needs an item."""
    out = np.zeros((owners, k), np.uint64)
    total = np.bincount(owner, weights, owners)
    depth = (k * math.log(k) + 2 * k) / total
    todo = np.ones(owners, bool)
    while todo.any():
        mine = todo[owner]
        h, w, o = items[mine], weights[mine], owner[mine]
        deep = np.ceil(depth[o]).astype(np.int64)
        squares = np.ceil(w).astype(np.int64) * deep
        which = np.repeat(np.arange(len(h)), squares)
        within = np.arange(len(which)) - np.repeat(np.cumsum(squares) - squares, squares)
        across, down = within // deep[which], within % deep[which]
        with np.errstate(over="ignore"):
            square = mix(h[which] ^ mix((across.astype(np.uint64) << np.uint64(32)) + down.astype(np.uint64) + np.uint64(SEED)))
            darts = np.searchsorted(_POISSON, _unit(square), side="right")
            dart = np.repeat(np.arange(len(which)), darts)
            number = (np.arange(len(dart)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
            first = mix(square[dart] + (number + np.uint64(1)) * _GOLD)
            second = mix(first + _GOLD)
            third = mix(second + _GOLD)
        place = across[dart] + _unit(first)
        rank = down[dart] + _unit(second)
        element = which[dart]
        hit = (place < w[element]) & (rank < depth[o[element]])
        slot = o[element][hit] * k + (third[hit] % np.uint64(k)).astype(np.int64)
        rank, name = rank[hit], third[hit]
        order = np.lexsort((name, rank, slot))
        slot, name = slot[order], name[order]
        earliest = np.ones(len(slot), bool)
        earliest[1:] = slot[1:] != slot[:-1]
        slot, name = slot[earliest], name[earliest]
        full = np.bincount(slot // k, minlength=owners) == k
        done = full[slot // k]
        out.reshape(-1)[slot[done]] = name[done]
        todo &= ~full
        depth = np.where(todo, depth * 2, depth)
    return out


def band_keys(entries: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(owners, bands) keys; a key also tells its band."""
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(entries), bands)).copy()
    with np.errstate(over="ignore"):
        for row in range(rows):
            keys = mix(keys * _GOLD + entries[:, row::rows][:, :bands])
    return keys.view(np.int64)


def _thrown_together(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[list[int]]:
    """Places of the sets with items, in lists of about SQUARES unit squares."""
    part, squares = [], 0.0
    for i, (items, weights) in enumerate(sets):
        if not len(items):
            continue
        need = k * math.log(k) + 2 * k + weights.sum()
        if part and squares + need > SQUARES:
            yield part
            part, squares = [], 0.0
        part.append(i)
        squares += need
    if part:
        yield part


def signatures(texts: list[str], counted: bool, bands: int, rows: int) -> list[dict]:
    split = [ascii_words(t) for t in texts]
    sets = [shingles(words, counted) for words in split]
    out: list[dict] = [{"node": None, "bands": None}] * len(texts)
    for part in _thrown_together(sets, bands * rows):
        owner = np.repeat(np.arange(len(part)), [len(sets[i][0]) for i in part])
        entries = dart_entries(np.concatenate([sets[i][0] for i in part]), np.concatenate([sets[i][1] for i in part]), owner, len(part), bands * rows)
        keys = band_keys(entries, bands, rows)
        for place, i in enumerate(part):
            out[i] = {"node": xxhash.xxh3_128_digest(b" ".join(split[i])), "bands": keys[place]}
    return out


def _rated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, alike) for pairs (a, b): items in common, and that over items in either."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.select("a", "b", "common", (F.col("common") / (F.size("x") + F.size("y") - F.col("common"))).alias("alike"))


def set_items(text: str, counted: bool) -> np.ndarray:
    """A text's shingles for the exact comparison; one that counts n times is n items, so weights become set sizes."""
    items, weights = shingles(ascii_words(text), counted)
    if counted:
        counts = weights.astype(np.int64)
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            items = mix(np.repeat(items, counts) + number.astype(np.uint64) * _GOLD)
    return items.view(np.int64)


def _item_sets(docs: DataFrame, named: DataFrame, nodes: DataFrame, counted: bool) -> DataFrame:
    """(node, items) for some nodes, from the text of one document of each."""
    one = named.join(nodes, "node").select("_doc", "_text", "node")
    texts = with_key(docs.select("doc_id", "text")).join(one, ["_doc", "_text"]).select("node", "text").dropDuplicates(["node"])
    made = in_slices(lambda part: [set_items(text, counted) for text in part], pa.list_(pa.int64()), SLICE_CHARS // 4)
    return texts.select("node", arrow_column(made, "array<bigint>", F.col("text")).alias("items"))


def _open_pairs(placed: DataFrame, sets: DataFrame, rated: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) from different components that share a bucket and may be similar, from (bucket, leader, node, c).

    Two sets of n and m items that are similar have at least (n + m) * similarity / (1 + similarity) in common. What
    they can have in common at most: of the leader's items, no more than either has in common with the leader; of all
    other items, no more than either has that any other of these sets has too. A set for which that fails even against
    the bucket's smallest one is left out before sets are paired.
    """
    share = similarity / (1 + similarity)
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("_x"), F.max("c").alias("_y")).filter("_x != _y").select("bucket")
    rows = kept(salted_join(placed, mixed, ["bucket"], F.col("node")), "near-open")
    mine = sets.join(rows.select("node").distinct(), "node")
    items = mine.select("node", F.explode("items").alias("item"))
    single = items.groupBy("item").agg(F.count("*").alias("_n"), F.min("node").alias("node")).filter("_n = 1")
    own = single.groupBy("node").agg(F.count("*").alias("_own"))
    measured = kept(mine.join(own, "node", "left").select("node", F.size("items").alias("n"), F.coalesce("_own", F.lit(0)).alias("own")), "near-sizes")
    sized = salted_join(rows, measured, ["node"], F.col("bucket"))
    sized = sized.withColumns({"a": F.least("node", "leader"), "b": F.greatest("node", "leader")}).join(rated.select("a", "b", "common"), ["a", "b"], "left")
    inside = F.when(F.col("node") == F.col("leader"), F.col("n")).otherwise(F.col("common"))
    sized = sized.select("bucket", "node", "c", "n", inside.alias("inside"), F.greatest(F.lit(0), F.col("n") - inside - F.col("own")).alias("outside"))
    least = sized.groupBy("bucket").agg(F.min("n").alias("_least"))
    able = salted_join(sized, least, ["bucket"], F.col("node")).filter(F.col("inside") + F.col("outside") >= share * (F.col("n") + F.col("_least")))
    able = kept(able.drop("_least"), "near-able")
    left = able.select("bucket", *(F.col(x).alias(f"_{x}") for x in ("node", "c", "n", "inside", "outside")))
    may = (F.col("_node") < F.col("node")) & (F.col("c") != F.col("_c"))
    enough = F.least("inside", "_inside") + F.least("outside", "_outside") >= share * (F.col("n") + F.col("_n"))
    return left.join(able, "bucket").filter(may & enough).select(F.col("_node").alias("a"), F.col("node").alias("b")).distinct()


def near_classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = BAND_ROWS, counted: bool = False
) -> DataFrame:
    """(_doc, _text, class_doc, class_text, class_size), one row for each row of the documents."""
    kind = "struct<node: binary, bands: array<bigint>>"
    made = arrow_column(in_slices(lambda texts: signatures(texts, counted, bands, rows), _SIGNATURE, SLICE_CHARS // 4), kind, F.col("text"))
    signed = kept(with_key(docs.select("doc_id", "text")).select("_doc", "_text", made.alias("_s")).select("_doc", "_text", "_s.*"), "signatures")
    key = F.struct("_doc", "_text")
    named = kept(
        signed.filter("node is not null").groupBy("node")
        .agg(F.min(key).alias("k"), F.count("*").alias("n"), F.first("bands").alias("bands"))
        .select("node", "k._doc", "k._text", "n", "bands"), "near-nodes",
    )
    entries = named.select("node", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("_m")).filter("_m > 1")
    shared = kept(salted_join(entries, sizes, ["bucket"], F.col("node")), "near-buckets")
    # the leader of a bucket is the class that meets most others anywhere: the middle of its group
    met = shared.groupBy("node").agg(F.sum("_m").alias("_met"))
    leaders = shared.join(met, "node").groupBy("bucket").agg(F.max(F.struct("_met", "node")).alias("_l")).select("bucket", F.col("_l.node").alias("leader"))
    leaders = kept(leaders, "near-leaders")
    led = salted_join(shared, leaders, ["bucket"], F.col("node")).filter("node != leader")
    pairs = kept(led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "near-pairs")
    sets = kept(_item_sets(docs, named, shared.select("node").distinct(), counted), "near-sets")
    rated = kept(_rated(pairs, sets), "near-rated")
    links = rated.filter(F.col("alike") >= similarity).select("a", "b")
    parts = _components(links)
    placed = salted_join(salted_join(shared, leaders, ["bucket"], F.col("node")), parts.withColumnRenamed("id", "node"), ["node"], F.col("bucket"), "left")
    placed = placed.select("bucket", "leader", "node", F.coalesce("component", "node").alias("c"))
    open_ = _open_pairs(placed, sets, rated, similarity).join(pairs, ["a", "b"], "left_anti")
    more = kept(_rated(open_, sets).filter(F.col("alike") >= similarity).select("a", "b"), "near-links")
    if not more.isEmpty():
        parts = _components(links.union(more))
    whole = named.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = whole.groupBy("component").agg(F.min(key).alias("_head"), F.sum("n").alias("class_size"))
    of_node = salted_join(whole.select("component", "node"), heads, ["component"], F.col("node")).select("node", "_head", "class_size")
    out = salted_join(signed.select("_doc", "_text", "node"), of_node, ["node"], key, "left")
    return out.select(
        "_doc", "_text", F.coalesce("_head._doc", "_doc").alias("class_doc"), F.coalesce("_head._text", "_text").alias("class_text"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def _components(links: DataFrame) -> DataFrame:
    """(id, component) of linked nodes."""
    nodes = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    if links.isEmpty():
        return nodes.select("id", F.col("id").alias("component"))
    return connected_components(nodes, links)


def _given(doc: Column) -> Column:
    return F.when(doc != NO_ID, doc)


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size, kept), one row for each row of the documents."""
    found = near_classes(docs, **options)
    first = (F.col("_doc") == F.col("class_doc")) & (F.col("_text") == F.col("class_text"))
    return found.select(_given(F.col("_doc")).alias("doc_id"), _given(F.col("class_doc")).alias("class_id"), "class_size", first.alias("kept"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that come first in their class, with their own columns."""
    found = kept(near_classes(docs, **options), "near-classes")
    gone = found.filter((F.col("_doc") != F.col("class_doc")) | (F.col("_text") != F.col("class_text"))).select("_doc", "_text").distinct()
    keyed = with_key(rows_held(docs))
    rest = keyed.join(gone, ["_doc", "_text"], "left_anti")
    again = found.groupBy("_doc", "_text").count().filter("count > 1").select("_doc", "_text")
    if again.isEmpty():
        return rest.select("row.*")
    single = rest.join(again, ["_doc", "_text"], "left_anti")
    return single.union(rest.join(again, ["_doc", "_text"], "left_semi").dropDuplicates(["_doc", "_text"]).select(*single.columns)).select("row.*")
