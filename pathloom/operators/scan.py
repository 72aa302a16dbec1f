"""Ordered scans that do not send a whole key through one task.

A plain window over a key sorts all of the key's rows in one task. Here every key is cut into chunks of consecutive
positions first, each chunk is scanned on its own, and a small per-chunk summary carries state across chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def with_neighbour(
    frame: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], step: int = -1, prefix: str = "prev_"
) -> DataFrame:
    """Add the columns of the neighbouring row (``index + step``) of a dense integer index as ``prefix + name``.

    The edge row of each chunk is copied into the chunk that needs it, so one shuffle on (keys, chunk) is enough.
    """
    home = F.floor(F.col(index) / CHUNK)
    needed_by = F.floor((F.col(index) - step) / CHUNK)
    spread = frame.withColumn("_chunk", F.explode(F.array_distinct(F.array(home, needed_by))))
    order = Window.partitionBy(*keys, "_chunk").orderBy(index)
    for name in columns:
        neighbour = F.lag(name).over(order) if step < 0 else F.lead(name).over(order)
        spread = spread.withColumn(prefix + name, neighbour)
    return spread.filter(F.col("_chunk") == home).drop("_chunk")


def running_sums(
    frame: DataFrame,
    keys: Sequence[str],
    index: str,
    sums: dict[str, Column],
    inclusive: bool = True,
    chunk: Column | None = None,
) -> DataFrame:
    """Prefix sums per key in index order; ``chunk`` must grow with the index (default: 4096 positions)."""
    chunk = F.floor(F.col(index) / CHUNK) if chunk is None else chunk
    work = frame.withColumn("_chunk", chunk)
    for name, value in sums.items():
        work = work.withColumn(f"_v_{name}", value)
    last = 0 if inclusive else -1
    within = Window.partitionBy(*keys, "_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, last)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = work.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = offsets.select(*keys, "_chunk", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    for name in sums:
        work = work.withColumn(f"_w_{name}", F.sum(f"_v_{name}").over(within))
    joined = work.join(offsets, [*keys, "_chunk"], "left")
    for name in sums:
        zero = F.lit(0)
        joined = joined.withColumn(
            name, F.coalesce(F.col(f"_w_{name}"), zero) + F.coalesce(F.col(f"_o_{name}"), zero)
        )
    return joined.select(*frame.columns, *sums)


def previous_row(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column, depth: int = 1
) -> DataFrame:
    """Add columns of the previous 1..depth rows of a key in an order that is not dense.

    ``chunk`` is any expression that is monotone in the order (a time bucket, a row-number range). The last ``depth``
    rows of every chunk are carried over to the first rows of the key's later chunks. New columns are named
    ``prev{d}_{name}``.
    """
    work = frame.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    work = work.withColumn("_rank", F.row_number().over(inside))
    for d in range(1, depth + 1):
        work = work.withColumn(f"_p{d}", F.lag(payload, d).over(inside))
    # at most ``depth`` rows per chunk survive here (a group limit runs before the shuffle)
    latest = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(o).desc() for o in order])
    tails = (
        frame.withColumn("_chunk", chunk)
        .withColumn("_back", F.row_number().over(latest))
        .filter(F.col("_back") <= depth)
        .groupBy(*keys, "_chunk")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_back", payload.alias("_row")))), lambda s: s["_row"]).alias("_tail"))
    )
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = F.lag("_tail", 1).over(chunks)
    for d in range(2, depth + 1):
        carried = F.concat(carried, F.coalesce(F.lag("_tail", d).over(chunks), F.array().cast(f"array<{_row_type(frame, columns)}>")))
    tails = tails.select(*keys, "_chunk", F.slice(carried, 1, depth).alias("_carry"))
    joined = work.join(tails, [*keys, "_chunk"], "left")
    for d in range(1, depth + 1):
        source = F.coalesce(F.col(f"_p{d}"), F.get(F.col("_carry"), F.lit(d) - F.col("_rank")))
        for name in columns:
            joined = joined.withColumn(f"prev{d}_{name}", source[name])
    return joined.select(*frame.columns, *[f"prev{d}_{n}" for d in range(1, depth + 1) for n in columns])


def _row_type(frame: DataFrame, columns: Sequence[str]) -> str:
    fields = ",".join(f"{c}:{frame.schema[c].dataType.simpleString()}" for c in columns)
    return f"struct<{fields}>"


def keep_first(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an order, as a partial aggregation (a hot key is reduced before the shuffle)."""
    rest = [c for c in frame.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    best = frame.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(o) for o in order])).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*frame.columns)
