"""Connected components as an iterative DataFrame operator."""

from __future__ import annotations

from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from evigraph.sources.stages import cut

#: Edges that one task thins out, or follows to the end.
THINNED = 200_000


def root_of(above: dict[Hashable, Hashable], x: Hashable) -> Hashable:
    """The node that ``x`` hangs on in the end; the way there is halved."""
    while (up := above.get(x, x)) != x:
        above[x] = above.get(up, up)
        x = up
    return x


def _pair_schema(kind, *names: str) -> StructType:
    return StructType([StructField(n, kind) for n in names])


def spanning(edges: DataFrame) -> DataFrame:
    """Edges (x, y) with the same components, fewer of them: spanning forests of what each task holds, where it is; a forest begins
    anew when it has ``THINNED`` nodes."""
    kind, most = edges.schema["x"].dataType, THINNED

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        for batch in batches:
            if len(above) > most:
                above = {}
            ends = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
            names, of = ends.dictionary.to_pylist(), ends.indices.to_numpy().reshape(2, -1)
            # Most edges link what hangs together already; only others are looked at one by one.
            number: dict = {}
            roots = np.fromiter((number.setdefault(root_of(above, n), len(number)) for n in names), np.int64, len(names))[of]
            kept = []
            for at in np.flatnonzero(roots[0] != roots[1]).tolist():
                x, y = root_of(above, names[of[0, at]]), root_of(above, names[of[1, at]])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    kept.append(at)
            yield batch.take(pa.array(kept, pa.int64()))

    return edges.mapInArrow(span, _pair_schema(kind, "x", "y"))


def thinned(edges: DataFrame) -> DataFrame:
    """``spanning`` of ``THINNED`` edges or so at a time."""
    return spanning(edges.repartition(max(1, -(-edges.count() // THINNED))))


def _followed(edges: DataFrame) -> DataFrame:
    """(node, component) of at most ``THINNED`` edges, in one task."""
    kind = edges.schema["x"].dataType

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root_of(above, a), root_of(above, b)
                low, high = min(x, y), max(x, y)
                above[low], above[high] = low, low
        nodes = list(above)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, type_), pa.array([root_of(above, x) for x in some], type_)], names=["node", "component"])

    return cut(edges.coalesce(1).mapInArrow(follow, _pair_schema(kind, "node", "component")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges to (node, component), the smallest node reachable; null ends and self-loops link nothing.

    Tasks first thin the edges they hold to spanning forests, so that of many edges few are ever moved, and again as long as that
    leaves half of them at most.  What one task holds in the end it follows; of more, rounds of star steps do."""
    start = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    current = cut(spanning(start.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))))
    count = current.count()
    while count > THINNED:
        current, before = cut(thinned(current)), count
        count = current.count()
        if 2 * count > before:
            return components_by_rounds(cut(current.distinct()))
    return _followed(current)


def components_by_rounds(edges: DataFrame) -> DataFrame:
    """``connected_components`` of distinct edges (x, y), x over y.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each shuffles the edges on a node, keeps at most
    as many of them, and after O(log^2 n) rounds every node hangs on its component's smallest.  The minimum of a node is
    found by an aggregate that is combined before the shuffle, and dealt out anew, so that adaptive execution may split
    the join of a hub.  Each round is cut to the checkpoint folder."""
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    current, before = edges, None
    while True:
        both = current.union(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # Large star: larger neighbours of x hang on the smallest of x and its neighbours.
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")).repartition(tasks)
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # Small star: x and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        met = large.join(least.repartition(tasks), "x")
        small = met.select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        current = cut(small)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = current.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return current.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots)
