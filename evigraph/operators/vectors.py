"""Vector similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from evigraph.functions import text as T

#: Rows of a block, and numbers in one, at most; a task multiplies two of them.
BLOCK_ROWS, BLOCK_NUMBERS = 32_768, 2**21
#: Rows that meet a whole block at once.
ROWS_AT_ONCE = 256


def similar_pairs_by_expression(rows: DataFrame, least: float, order: str = "id", vector: str = "embedding") -> DataFrame:
    """The same join by higher-order functions, for tests and as the plain statement of what is meant."""
    a, b = rows.select(F.col(order).alias("a"), F.col(vector).alias("va")), rows.select(F.col(order).alias("b"), F.col(vector).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("similarity", T.cosine(F.col("va"), F.col("vb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def similar_pairs(rows: DataFrame, least: float, order: str = "id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, most: int | None = None) -> DataFrame:
    """(a, b, similarity): pairs a < b of rows with equally long vectors and a cosine of ``least`` or more.

    Rows are hashed to blocks; each pair of blocks meets in one task as matrix products of a few rows with a block, so memory is
    bounded by two blocks and no matrix is broadcast.  Vectors travel once for each block, as they are stored.  With ``most``, a
    pair of blocks gives only pairs that may be among so many of the largest similarity.  Null and empty vectors match nothing; a
    vector of norm 0 has cosine 0."""
    kind = rows.schema[vector].dataType.elementType
    plain = F.col(vector) if isinstance(kind, (FloatType, DoubleType)) else F.transform(vector, lambda v: v.cast("double"))
    usable = rows.where(F.size(vector) > 0).select(F.col(order).cast("bigint").alias("key"), plain.alias("vector"))
    n, numbers = usable.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    blocks = max(1, -(-n // block_rows), -(-(numbers or 0) // BLOCK_NUMBERS), min(8, n // 256))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    # A row of block i meets blocks j >= i as the left side, and blocks j <= i as the right.
    met = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    dealt = usable.withColumn("block", block).select("key", "vector", "block", F.explode(met).alias("pair")).select("key", "vector", "block", "pair.i", "pair.j")

    def multiply(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (x.as_py() for x in group)
        table = pa.Table.from_batches(list(batches))
        keys, of = table.column("key").to_numpy(), table.column("block").to_numpy()
        vectors = table.column("vector").combine_chunks()
        begins, sizes = vectors.offsets.to_numpy()[:-1], np.diff(vectors.offsets.to_numpy())
        flat = vectors.values.to_numpy(zero_copy_only=False)
        found, held, floor = [], 0, least
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            matrix = flat[begins[mine][:, None] + np.arange(size)].astype(np.float64)
            norms = np.sqrt((matrix * matrix).sum(axis=1))
            matrix /= np.where(norms > 0, norms, 1)[:, None]
            right = np.flatnonzero(of[mine] == j)
            left = right if i == j else np.flatnonzero(of[mine] == i)
            if not len(left) or not len(right):
                continue
            left, right = (x[np.argsort(keys[mine[x]], kind="stable")] for x in (left, right))
            key_left, key_right, turned = keys[mine[left]], keys[mine[right]], np.ascontiguousarray(matrix[right].T)
            for at in range(0, len(left), ROWS_AT_ONCE):
                product = matrix[left[at : at + ROWS_AT_ONCE]] @ turned
                x, y = np.divmod(np.flatnonzero(product >= floor), len(right))
                a, b, s = key_left[at + x], key_right[y], product[x, y]
                keep = a < b if i == j else a != b
                part = np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]
                if most is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["a", "b", "similarity"])
                    continue
                found.append(part)
                held += len(part[0])
                if held > 2 * most + ROWS_AT_ONCE:
                    # Equals of the least that stays also stay.
                    a, b, s = (np.concatenate(c) for c in zip(*found))
                    floor = np.partition(s, len(s) - most)[len(s) - most]
                    some = s >= floor
                    found, held = [(a[some], b[some], s[some])], int(some.sum())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b", "similarity"])

    return dealt.groupBy("i", "j").applyInArrow(multiply, "a bigint, b bigint, similarity double")


def in_blocks(frame: DataFrame, number: str, rows: int, on: tuple[str, ...]) -> tuple[DataFrame, int]:
    """``frame`` with a block number by the hash of ``on``, so many rows to a block, and how many blocks there are."""
    blocks = max(1, -(-frame.count() // rows))
    return frame.withColumn(number, F.pmod(F.xxhash64(*on), F.lit(blocks)).cast("int")), blocks


def top_pairs(pairs: DataFrame, most: int) -> DataFrame:
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(most)
