"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.sources.stages import checkpoint_dir, cut, drop_folder, read_table as table

__all__ = ["BROADCAST_ROWS", "SALTS", "ascii_lower", "beside_text", "checkpoint_dir", "cut", "drop_folder", "freed", "join_dimension", "named", "others", "packed", "shards_for", "table", "text_beside", "trimmed", "unpacked"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only; ``lower`` would also fold non-ASCII letters."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def named(column: str) -> Column:
    """A column of exactly this name, dots, spaces and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def others(frame: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns of ``frame`` but those that an operator adds itself, whatever their case."""
    own = {c.lower() for c in added}
    return [c for c in frame.columns if c.lower() not in own]


def packed(frame: DataFrame, **own: Column) -> DataFrame:
    """All columns of ``frame`` as one struct, row, beside columns of the operator's own, whose names nothing can then clash with."""
    return frame.select(F.struct(*map(named, frame.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


def unpacked(frame: DataFrame, columns: Iterable[str], **added: Column) -> DataFrame:
    """The named columns out of row, then what the operator adds."""
    return frame.select(*(F.col("row").getField(c).alias(c) for c in columns), *(c.alias(n) for n, c in added.items()))


def text_beside(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns but text as one struct, row, beside text: for functions in Python, to which a text should go once."""
    spare = F.lit(0).alias("_" * (1 + max(map(len, frame.columns))))
    return frame.select(F.struct(*(named(c) for c in columns if c.lower() != "text"), spare).alias("row"), F.col("text"))


def beside_text(columns: Iterable[str]) -> list[Column]:
    """The named columns, out of what ``text_beside`` makes."""
    return [(F.col("text") if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in columns]


def freed(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``work`` on one group or two, whose memory goes back before the next."""

    def one(rows: pa.Table) -> pa.Table:
        out = work(rows)
        give_back()
        return out

    def two(rows: pa.Table, others: pa.Table) -> pa.Table:
        out = work(rows, others)
        give_back()
        return out

    # Spark goes by the number of parameters.
    return one if work.__code__.co_argcount == 1 else two


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _TRIM = None


def give_back() -> None:
    """Return memory that nothing holds any more to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a Python worker that waits for its next task holds little memory beside the executor's."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return inner


def shards_for(total: int, per_shard: int, least: int = 1) -> int:
    """Number of shards that keeps each near ``per_shard``; grows in proportion to the data, without a cap."""
    return max(least, -(-int(total or 0) // per_shard))


#: Rows of a dimension that may be broadcast; counted before use.
BROADCAST_ROWS = 100_000
SALTS = 32


def join_dimension(rows: DataFrame, dimension: DataFrame, key: str, dimension_key: str) -> DataFrame:
    """Null-safe inner join with a materialised dimension, whatever share of ``rows`` one key holds.

    A dimension of at most ``BROADCAST_ROWS`` rows is broadcast; a larger one is repeated ``SALTS`` times under a salt, by
    which a hot key of ``rows`` is spread."""
    if dimension.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(dimension), F.col(key).eqNullSafe(F.col(dimension_key))).drop(dimension_key)
    salted = dimension.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("__salt_of", F.pmod(F.xxhash64(*(named(c) for c in rows.columns)), F.lit(SALTS)).cast("int"))
    same = F.col(key).eqNullSafe(F.col(dimension_key)) & (F.col("__salt_of") == F.col("__salt"))
    return spread.join(salted, same).drop(dimension_key, "__salt", "__salt_of")
