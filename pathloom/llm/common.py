"""Helpers of the corpus operators: Arrow columns, shared files, text splitting.

Rows are identified by (doc_id, hash of the text) where an operator has to group lines or links by document: rows alike
in both are one document and get the same result, rows with the same id and different texts are different documents.
"""

from __future__ import annotations

import ctypes
import math
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import ensure_checkpoint_dir

#: Ids of documents without one; they sort first.
NO_ID = -(2**63)
#: Texts are handled in slices of about this many characters inside a task.
SLICE_CHARS = 1 << 20
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """A frame written to the shared folder and read back: computed once, safe when executors are lost."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    _KEPT_AT[id(table)] = (weakref.ref(table), path)
    return table


_KEPT_AT: dict[int, tuple[weakref.ref, str]] = {}


def dropped(table: DataFrame) -> None:
    """Delete a kept table that nothing reads any more."""
    found, path = _KEPT_AT.pop(id(table))
    if found() is not table:
        raise ValueError("not a kept table")
    folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches() -> None:
    """Lower the bytes of an Arrow batch to BATCH_BYTES where the session allows more, so that a worker's memory doesn't
    follow the length of texts times the default number of rows."""
    conf = SparkSession.active().conf
    if int(conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))


@contextmanager
def ends_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: Spark removes them when the write is done, not when the
    driver happens to collect its garbage. The session's setting is put back at the end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(frame: DataFrame, function: Callable[[Iterator], Iterator], schema: str, cache: str | None = None) -> DataFrame:
    """Rows made from Arrow batches by a function on iterators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release(cache)
        yield from function(batches)
        _release(cache)

    small_batches()
    return frame.mapInArrow(run, schema)


#: What workers remember between tasks, by name; a worker that turns to other work forgets it.
CACHES: dict[str, dict] = {}
#: Called by a worker that turns to other work than any of the names.
FORGET: list[tuple[set[str], Callable[[], None]]] = []


def _release(cache: str | None) -> None:
    """Give a worker's unused memory back, as it may wait between stages for long."""
    for name, remembered in CACHES.items():
        if name != cache:
            remembered.clear()
    for names, forget in FORGET:
        if cache not in names:
            forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_column(function: Callable[[Iterator], Iterator], kind: str, source: Column, cache: str | None = None) -> Column:
    """A column computed from another by a function on iterators of Arrow arrays; only that column goes to Python.

    It counts as non-deterministic so that a filter on its result doesn't compute it a second time.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _release(cache)
        yield from function(batches)
        _release(cache)

    small_batches()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()(source)


def per_text(function: Callable[[str], object], kind: pa.DataType) -> Callable[[Iterator], Iterator]:
    """One value for each text; a null text counts as empty."""

    def run(batches):
        for texts in batches:
            yield pa.array((function(text.as_py() or "") for text in texts), type=kind)

    return run


def slices(batches: Iterator[pa.Array], limit: int = SLICE_CHARS) -> Iterator[tuple[list[str], bool]]:
    """Texts in lists of a bounded number of characters; the flag tells the last list of a batch."""
    for texts in batches:
        part, size = [], 0
        for value in texts:
            text = value.as_py() or ""
            if part and size + len(text) > limit:
                yield part, False
                part, size = [], 0
            part.append(text)
            size += len(text)
        yield part, True


def in_slices(function: Callable[[list[str]], list], kind: pa.DataType, limit: int = SLICE_CHARS) -> Callable[[Iterator], Iterator]:
    """Values for lists of texts of bounded size; a null text counts as empty."""

    def run(batches):
        done: list = []
        for part, last in slices(batches, limit):
            done += function(part)
            if last:
                yield pa.array(done, type=kind)
                done = []

    return run


def document_key() -> list[Column]:
    """(_doc, _text): what tells documents apart, without nulls."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"),
    ]


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else 32 for b in bytes(range(256)).translate(_LOWER))
_CUT = 4_000_000


def ascii_words(text: str, lower_all: bool = False) -> list[bytes]:
    """UTF-8 words of letters, digits and everything beyond ASCII; A-Z are lower-cased (all letters if asked to)."""
    return (text.lower() if lower_all else text).encode("utf-8", "replace").translate(_WORD_BYTES).split()


def word_parts(text: str) -> Iterator[list[bytes]]:
    """The words of `ascii_words` in lists of bounded size, for very long texts."""
    data = text.encode("utf-8", "replace").translate(_WORD_BYTES)
    start = 0
    while len(data) - start > _CUT:
        end = data.find(b" ", start + _CUT)
        if end < 0:
            break
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def blocks_for(size: int, limit: int) -> int:
    return max(1, math.ceil(size / limit))


#: White space of the tokenizers' patterns (their library's \s), as a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Copies of the small side of a join whose key may hold a third of the other side's rows.
SALTS = 8


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Join rows to one row per key, with the rows of a hot key dealt over several tasks by another column.

    It always shuffles: Spark's estimate of the small side doesn't count the copies, so it would broadcast too much.
    """
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def rows_held(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): documents with all their columns held together, so that no name clashes with an operator's."""
    names = [F.col(f"`{name}`") for name in docs.columns]
    return docs.select("doc_id", "text", F.struct(*names).alias("row"))


def with_key(frame: DataFrame) -> DataFrame:
    """The frame with `_doc` and `_text` added."""
    return frame.withColumns(dict(zip(("_doc", "_text"), document_key(), strict=True)))
