"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are trimmed and hashed; blank lines are passed over. A gram is the shortest run of whole lines from a line on
with at least GRAM_WORDS words. Of all grams that start within WINDOW_WORDS words from a line, the one with the least
hash is that line's fingerprint. Both cuts depend on the lines alone, so a passage of RUN_WORDS words or more that two
places share (GRAM_WORDS + WINDOW_WORDS = RUN_WORDS) shows the same fingerprint in both: only fingerprints found at two
positions or more have to be looked at. There the match is extended both ways: the shortest runs of RUN_WORDS words
that start at a line and those that end at one are compared by the hashes of all their lines (every line of a longer
match lies in one of them), equal runs are joined to the first of them, and overlapping later runs are put together.
Their lines go; the first occurrence stays.

Order is by doc_id (null first), hash of the text, line. A line goes if it lies in a run of at least RUN_WORDS words
that has an equal run starting earlier. Words of a line are its blanks after trimming plus one.

Every step is an aggregation with partial sums or a join to one row per key with salted keys, so a passage in a third of
all documents is neither listed in one place nor paired with itself. The only group held together is the lines of one
document.

Defined results: a null text stays null; empty texts and texts without long enough repeats are left as they are;
rows alike in doc_id and text are one document and get the same result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import kept, rows_held, salted_join, with_key

RUN_WORDS = 50
GRAM_WORDS = 25
KEY = ["_doc", "_text"]


def line_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(_doc, _text, no, fp, at, run, run2, end): the shortest runs from each line on and up to each line, and the
    fingerprint of the line they start at."""
    lines = with_key(docs.select("doc_id", "text")).select(*KEY, F.posexplode(F.split(F.col("text"), "\n", -1)).alias("no", "line"))
    lines = lines.select(*KEY, "no", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).filter("line != ''")
    lines = lines.select(
        *KEY, "no", F.xxhash64("line").alias("h"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words")
    )
    lines = lines.repartition(*KEY).dropDuplicates([*KEY, "no"])
    document = Window.partitionBy(*KEY)
    started = F.sum("words").over(document.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    placed = lines.withColumn("s", started).withColumn("t", F.col("s") + F.col("words"))

    def ahead(words: int):
        return document.orderBy("s").rangeBetween(0, words - 1)

    gram, run, window = ahead(gram_words), ahead(run_words), ahead(run_words - gram_words)
    up_to, line_before = document.orderBy("t").rangeBetween(1 - run_words, 0), document.orderBy("t")
    grams = placed.select(
        *KEY, "no", "s", "t", "h", "words",
        F.when(F.sum("words").over(gram) >= gram_words, F.xxhash64(F.collect_list("h").over(gram))).alias("gram"),
        F.when(F.sum("words").over(run) >= run_words, F.collect_list("h").over(run)).alias("list"),
        F.max("no").over(run).alias("end"),
    )
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "no"))).over(window)
    marked = grams.withColumn("_f", least)
    start = F.struct("no", "_f", "end", "h", "words")
    ended = marked.withColumns({
        "_from": F.first(start).over(up_to), "_back": F.collect_list("h").over(up_to),
        "_full": F.sum("words").over(up_to) >= run_words, "_prev": F.lag(start).over(line_before),
    })

    def found(begin, mark, hashes, end):
        return F.struct(
            begin.alias("no"), mark["gram"].alias("fp"), mark["no"].alias("at"), F.xxhash64(hashes).alias("run"),
            F.xxhash64(F.lit(1), hashes).alias("run2"), end.alias("end"),
        )

    onward = F.when(F.col("list").isNotNull(), found(F.col("no"), F.col("_f"), F.col("list"), F.col("end")))
    # a run that is also the shortest from its first line on is there already
    before = F.when(F.col("_full") & (F.col("_from.end") < F.col("no")), found(F.col("_from.no"), F.col("_from._f"), F.col("_back"), F.col("no")))
    # two lines that are runs by themselves: blank lines between them lie in the run of both
    both = F.when(
        (F.col("words") >= run_words) & (F.col("_prev.words") >= run_words),
        found(F.col("_prev.no"), F.col("_prev._f"), F.array("_prev.h", "h"), F.col("no")),
    )
    return ended.select(*KEY, F.explode(F.array_compact(F.array(onward, before, both))).alias("_r")).select(*KEY, "_r.*")


def repeated_ranges(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(_doc, _text, ranges): line ranges [first, last] to delete, for documents that have any."""
    runs = kept(line_runs(docs, run_words, gram_words), "line-runs")
    spot = F.struct("_doc", "_text", "at")
    twice = runs.groupBy("fp").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).filter("x != y").select("fp")
    near = salted_join(runs, twice, ["fp"], F.struct("_doc", "_text"))
    place = F.struct("_doc", "_text", "no")
    first = near.groupBy("run", "run2").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x != y").select("run", "run2", "x")
    later = salted_join(near, first, ["run", "run2"], F.struct("_doc", "_text")).filter(place != F.col("x")).select(*KEY, "no", "end")
    document = Window.partitionBy(*KEY).orderBy("no")
    before = F.max("end").over(document.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("_new").over(document.rowsBetween(Window.unboundedPreceding, 0))
    cut = later.withColumn("_new", F.when(F.col("no") <= before + 1, 0).otherwise(1)).withColumn("_island", island)
    merged = cut.groupBy(*KEY, "_island").agg(F.min("no").alias("first"), F.max("end").alias("last"))
    return merged.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def _cut(docs: DataFrame, run_words: int, gram_words: int) -> DataFrame:
    """(row, rest, removed): the documents as they are, their text without later repeated runs, the lines taken out."""
    marked = with_key(rows_held(docs)).join(repeated_ranges(docs, run_words, gram_words), KEY, "left")
    lines = F.split(F.col("text"), "\n", -1)
    # what lies between the ranges, in order
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("ranges")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get("ranges", i - 1)["last"] + 1).alias("from"),
            F.when(i == F.size("ranges"), F.size("_lines")).otherwise(F.get("ranges", i)["first"]).alias("to"),
        ),
    )
    rest = F.flatten(F.transform("_gaps", lambda g: F.slice("_lines", g["from"] + 1, g["to"] - g["from"])))
    cut = marked.withColumn("_lines", F.when(F.col("ranges").isNotNull(), lines)).withColumn("_gaps", F.when(F.col("ranges").isNotNull(), gaps))
    removed = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    left = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return cut.select("row", left.alias("rest"), F.coalesce(removed, F.lit(0)).cast("long").alias("removed"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """The documents without later repeated runs of lines, and `n_removed`, the number of lines taken out (a column of
    the documents with that name is replaced)."""
    others = [F.col("rest").alias("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns if name != "n_removed"]
    return _cut(docs, run_words, gram_words).select(*others, F.col("removed").alias("n_removed"))


def without_repeats(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """The documents with their own columns; a document of which no words are left is itself a repeat and goes."""
    cut = _cut(docs, run_words, gram_words).filter((F.col("removed") == 0) | F.col("rest").rlike(r"[^ \t\r\n]"))
    return cut.select(*[F.col("rest").alias("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns])
