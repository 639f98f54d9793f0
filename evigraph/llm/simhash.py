"""SimHash near-duplicates linked through a Golay code.

The binary Golay code [23, 12, 7] has balls of radius 3 that tile the space of 23-bit vectors.  A segment of a fingerprint
is decoded together with its 23 neighbours at distance 1; the codeword indices found are its keys, 1 or 6 of them.
Segments that differ in at most 2 bits share a key, since both or one of them reach a vector between them.

``near_duplicates`` links 64-bit fingerprints at 3 differing bits or fewer, exactly.  Two of them agree in at least one of
four 16-bit parts, and of the other 48 bits, two halves of 24, the first differs in at most 2 bits or else the second not
at all.  So a fingerprint has the keys

* (part, its bits, first half, codeword index), for a first half that differs in at most 2 bits, and
* (part, its bits, second half's bits), for a first half that differs in all 3.

``near_copies`` links texts whose sets of five-word shingles are similar at 0.8 or more, exactly.  That is some 15 differing bits
in 100, too many for a guarantee, so the sets' fingerprints have 256 bits, 11 segments, and meet if a segment shares a codeword
index and some bits of another segment are equal, in any of 22 such pairs; a segment of a pair at 0.8 differs in at most 2 bits
three times in ten.  There are 6 of those bits or more: their number grows with the logarithm of the fingerprints, so that a
key has a handful of unrelated members at any size, while the pairs that such keys find grow more alike.  Fingerprints meet as
well if the smallest hashes of three ranges of hashes are equal, in any of 12 such triples; at 0.8 a triple is equal half the
time, at every size.  ``WIDE_MOST`` of all 256 bits may differ in what is gone through.

That finds most, and which ones depends on the keys and their number; an exact way finds the rest.  Two sets similar at 0.8
or more are so in one at least of the pieces that ranges of hashes cut them into, and such pieces share one of the first
n - ceil(0.8 n) + 1 of their hashes, in whatever order.  Pieces meet by those, common hashes last; parities of their hashes,
112 bits, differ in at most as many bits as the pieces do in hashes, a ninth of both sizes, which parts unlike ones.
Components of all that met are then gone through by the exact Jaccard similarity of their sets, and only links at 0.8 or more
stay: all of them, whatever else the table holds.

Fingerprints meet by key and are verified by counting the bits that differ; nothing is capped.  Equal fingerprints are one
before keys are made.  What is emitted are edges of spanning forests rather than all pairs.  A key or component with many
members is dealt out as blocks, each with a forest of its own; what is left to compare are the members outside its largest
tree with all others, again block by block, so that a large group of copies costs little more than its rows.

Cases: a null text has no words; texts without words have fingerprint 0 and link like any other; a text of fewer than
``shingle`` words is one shingle; repeated rows share a component; a null doc_id gets a fingerprint, and is never the
smallest id of a component that holds another; an empty table gives an empty result; extra columns pass through
``drop_near_copies`` and aren't carried by the others.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import BROADCAST_ROWS, checkpoint_dir, cut, drop_folder, join_dimension, packed, table, trimmed, unpacked
from evigraph.operators.components import connected_components
from evigraph.sources.stages import write_stage

BITS, PARTS, PART_BITS, MOST = 64, 4, 16, 3
SEED = 42
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101


def words_of(text: str | None) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the rows of uint64 words have each bit, most significant first."""
    counts = np.zeros(words.shape[1] * 64, np.int64)
    for at in range(0, len(words), 255 * 64):
        bits = np.unpackbits(words[at : at + 255 * 64].astype(">u8").view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255
        # Up to 255 ones fit a byte.
        counts += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return counts


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the space-joined shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes as rows of ``words`` independent uint64, the first as it is."""
    columns = [hashes]
    for i in range(1, words):
        z = hashes + np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        columns.append(z ^ (z >> np.uint64(31)))
    return np.stack(columns, axis=1)


def fingerprint(words: list[bytes], shingle: int, width: int = 1) -> np.ndarray:
    """``width`` uint64 of the bits that are set in over half of the shingles' hashes; zeros without words."""
    return fingerprint_of(shingle_hashes(words, shingle), width)


def fingerprint_of(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``fingerprint`` of shingle hashes."""
    counts = bit_counts(widened(hashes, width)) if len(hashes) else np.zeros(64 * width, np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int, width: int = 1, sets: bool = False, common: np.ndarray | None = None) -> DataFrame:
    """Columns of ``docs`` but text, with fp0, fp1, ... and id, their identity: one row for each row; texts are read in place and
    never shuffled.  ``sets`` counts repeated shingles once, and adds set_id, a hash of their set, n, its size, bands, and pieces,
    in whose keys the hashes in ``common``, sorted, come last."""
    names = [*(f"fp{i}" for i in range(width)), "id", *(["set_id", "n", "bands", "pieces"] if sets else [])]
    common = np.empty(0, np.uint64) if common is None else common
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, told, bands = np.zeros((batch.num_rows, width), np.uint64), np.zeros((batch.num_rows, 2), np.uint64), ([], [])
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                hashes = shingle_hashes(words_of(text.as_py()), shingle)
                if sets:
                    hashes = np.unique(hashes)
                    told[i] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED), len(hashes)
                    bands[0].append(band_keys(hashes))
                    bands[1].append(piece_keys(hashes, common))
                fps[i] = fingerprint_of(hashes, width)
            columns = [*(pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(width)), pa.array(identity(fps))]
            columns += [pa.array(np.ascontiguousarray(told[:, i]).view(np.int64)) for i in range(2 * sets)]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in bands] if sets else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} array<bigint>" if n in ("bands", "pieces") else f"{n} bigint" for n in names)])
    return docs.select(*(f.name for f in kept), "text").mapInArrow(trimmed(run), schema)


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """Codeword index (12 message bits) of every 23-bit vector."""

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
        return x

    # Each of the 2048 syndromes belongs to one error of weight 3 at most.
    leaders = np.zeros(2048, np.int64)
    singles = [1 << i for i in range(23)]
    errors = [0, *singles, *(a | b for i, a in enumerate(singles) for b in singles[:i])]
    errors += [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]]
    errors = np.array(errors, np.int64)
    leaders[remainder(errors)] = errors
    found = np.empty(1 << 23, np.uint16)
    for at in range(0, 1 << 23, 1 << 17):
        vectors = np.arange(at, at + (1 << 17), dtype=np.int64)
        found[at : at + (1 << 17)] = (vectors ^ leaders[remainder(vectors)]) >> 11
    return found


def golay_keys(half: np.ndarray) -> np.ndarray:
    """n x 24 codeword indices of 23-bit vectors and their neighbours, sorted along each row."""
    code = golay_table()
    return np.sort(np.stack([code[half], *(code[half ^ (1 << i)] for i in range(23))], axis=1), axis=1)


def codes_of(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of 23-bit segments, each index once for a row."""
    codes = golay_keys(segment)
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, column = np.nonzero(fresh)
    return row, codes[row, column].astype(np.uint64)


def strict_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of 64-bit fingerprints, n x 1, that meet at 3 differing bits or fewer."""
    fps = fps[:, 0]
    rows, keys = [], []
    every = np.arange(len(fps))
    for part in range(PARTS):
        shift = np.uint64(part * PART_BITS)
        bits = (fps >> shift) & np.uint64(0xFFFF)
        low = fps & ((np.uint64(1) << shift) - np.uint64(1))
        high = (fps >> (shift + np.uint64(16))) << shift if part < PARTS - 1 else np.zeros_like(fps)
        rest = low | high
        head, tail = rest & np.uint64(0x7FFFFF), rest >> np.uint64(24)
        tag = (bits << np.uint64(3)) | np.uint64(part << 1)
        at, code = codes_of(head.astype(np.int64))
        rows += [at, every]
        keys += [(code << np.uint64(19)) | tag[at], (tail << np.uint64(19)) | tag | np.uint64(1)]
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


WIDE, SEGMENTS, MATES, MATE_BITS = 4, 11, (1, 5), 6


def mate_bits_for(fingerprints: int) -> int:
    """Bits beside a codeword index that leave a key a handful of unrelated members."""
    return max(MATE_BITS, fingerprints.bit_length() - 12)


def wide_keys(fps: np.ndarray, mate_bits: int = MATE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of 256-bit fingerprints, n x 4: a segment's codeword index beside some bits of other segments."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1)
    weights = 1 << np.arange(22, -1, -1, dtype=np.int64)
    places = np.arange(mate_bits)
    rows, keys = [], []
    for i in range(SEGMENTS):
        at, code = codes_of(bits[:, 23 * i : 23 * i + 23] @ weights)
        for j, mate in enumerate(MATES):
            beside = bits[:, (23 * (i + mate) + j * MATE_BITS + places) % (23 * SEGMENTS)] @ (1 << places)
            rows.append(at)
            keys.append(((code << np.uint64(mate_bits)) | beside[at].astype(np.uint64)) << np.uint64(5) | np.uint64(i * len(MATES) + j))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def identity(payload: np.ndarray) -> np.ndarray:
    """One bigint for n x words fingerprints: the word itself, or a 64-bit mix of several."""
    z = payload[:, 0].copy()
    for i in range(1, payload.shape[1]):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + payload[:, i]
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z.view(np.int64)


BANDS, BAND_ROWS = 12, 3
RANGES = np.array([(i << 64) // (BANDS * BAND_ROWS) for i in range(BANDS * BAND_ROWS)], np.uint64)


def band_keys(known: np.ndarray) -> np.ndarray:
    """Keys of a set of sorted hashes: the smallest hashes of each three ranges, but of three empty ones."""
    begins = np.searchsorted(known, RANGES)
    some = np.diff(begins, append=len(known)) > 0
    smallest = np.zeros(len(RANGES), np.uint64)
    smallest[some] = known[begins[some]]
    triples = smallest.reshape(BANDS, BAND_ROWS)
    # The five low bits tell them from ``wide_keys``.
    return identity(triples[triples.any(axis=1)]) | np.int64(31)


#: Least similarity of a link, in tenths.
TENTHS = 8
#: Hashes of a piece at most, about, and by how much more pieces there are from one level to the next; bits of its parities.
PIECE, FINER, PARITIES = 128, 4, 112


def levels_of(n: int) -> list[int]:
    """Levels at which a set of ``n`` hashes is cut: its own, and that of the smallest set that may be similar."""

    def level(n: int) -> int:
        k = 0
        while n > PIECE * FINER**k:
            k += 1
        return k

    return sorted({level(n), level(-(-n * TENTHS // 10))})


def piece_prefix(n):
    """How many first hashes of a piece of ``n`` are keys: two that are similar share one of them."""
    return n + (-n * TENTHS) // 10 + 1


def piece_keys(known: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Pieces of a set of sorted hashes one after another: two words, the parities of its hashes and its size in the last 16 bits,
    then its keys."""
    out = []
    place = np.searchsorted(common, known)
    last = np.zeros(len(known), bool) if not len(common) else common[np.minimum(place, len(common) - 1)] == known
    for level in levels_of(len(known)) if len(known) else ():
        pieces = FINER**level
        # 4 ** level ranges: the first two bits a level.
        piece = (known >> np.uint64(64 - 2 * level)).astype(np.int64) if level else np.zeros(len(known), np.int64)
        sizes = np.bincount(piece, minlength=pieces)
        bits = np.zeros((pieces, 128), np.uint8)
        bits[:, :PARITIES] = (np.bincount(piece * PARITIES + (known % np.uint64(PARITIES)).astype(np.int64), minlength=pieces * PARITIES) & 1).reshape(pieces, -1)
        words = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
        words[:, 1] |= sizes.astype(np.uint64)
        order = np.lexsort((known, last, piece))
        # A key tells its level by the low bits.
        keys = (known[order] & ~np.uint64(15)) | np.uint64(level & 15)
        begin = 0
        for i, n in enumerate(sizes.tolist()):
            if n:
                out += [words[i], keys[begin : begin + piece_prefix(n)]]
            begin += n
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def pieces_of(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(two words, keys) of each piece that ``piece_keys`` made."""
    at = 0
    while at < len(flat):
        keys = at + 2 + piece_prefix(int(flat[at + 1]) & 0xFFFF)
        yield flat[at : at + 2], flat[at + 2 : keys]
        at = keys


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def may_be_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two pieces' words leave it open that they are similar at ``TENTHS`` / 10."""
    size = np.uint64(0xFFFF)
    n, m = (a[..., 1] & size).astype(np.int64), (b[..., 1] & size).astype(np.int64)
    differ = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int64) + np.bitwise_count((a[..., 1] ^ b[..., 1]) & ~size)
    return (10 + TENTHS) * np.maximum(differ, np.abs(n - m)) <= (10 - TENTHS) * (n + m)


def alike(a: np.ndarray, b: np.ndarray, most: int | None) -> np.ndarray:
    """Rows that differ in at most ``most`` bits; None: pieces that may be similar."""
    return may_be_similar(a, b) if most is None else apart(a, b) <= most


def forest(fps: np.ndarray, most: int | None) -> list[tuple[int, int]]:
    """Edges (rows) of a spanning forest over the links of at most ``most`` differing bits, or of ``alike``.

    Smaller fingerprints come first, so that keys with the same members give the same edges."""
    edges, left = [], np.lexsort(fps.T[::-1])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop(0)
            near = alike(fps[left], fps[one], most)
            if near.any():
                met = left[near]
                edges += [(one, other) for other in met]
                queue.extend(met)
                left = left[~near]
    return edges


#: Of keys with more members than this, a forest is emitted; of others, all links.
SMALL = 16


def linked(key: np.ndarray, fps: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked within equal keys; ``key`` is sorted."""
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cuts)
    size_of_row = np.repeat(sizes, sizes)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    few = np.flatnonzero((size_of_row > 1) & (size_of_row <= SMALL))
    for lag in range(1, SMALL):
        few = few[few + lag < len(key)]
        few = few[key[few] == key[few + lag]]
        if not len(few):
            break
        near = few[alike(fps[few], fps[few + lag], most)]
        left.append(near)
        right.append(near + lag)
    for a, b in zip(cuts[:-1][sizes > SMALL].tolist(), cuts[1:][sizes > SMALL].tolist()):
        edges = np.array(forest(fps[a:b], most), np.int64).reshape(-1, 2)
        left.append(edges[:, 0] + a)
        right.append(edges[:, 1] + a)
    return np.concatenate(left), np.concatenate(right)


def of_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows one after another that agree in the first ``keys`` columns, without these."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, group in groupby(rows, key=lambda row: row[:keys]):
        yield [row[keys:] for row in group]


def edge_batch(ends: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(e) for e in ends], pa.int64()), pa.array([max(e) for e in ends], pa.int64())], names=["a", "b"])


def across(members: DataFrame, key: str, edges: DataFrame, block: int, near: Callable[[list[bytes], list[bytes]], Iterator[np.ndarray]]) -> DataFrame:
    """Further edges between the members of a key: of those outside the key's largest tree with all others, where their trees differ.

    ``members`` are (key, block, id, payload), dealt to blocks whose own links are in ``edges``; ``near`` yields, for each of some
    payloads, which of others are linked to it."""
    trees = connected_components(edges).select(F.col("node").alias("of"), F.col("component").alias("tree"))
    placed = cut(members.join(trees, F.col("id") == F.col("of"), "left").select(key, "block", "id", "payload", F.coalesce("tree", "id").alias("tree")))
    sizes = placed.groupBy(F.col(key).alias("k"), "tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("k").agg(F.max_by("tree", F.struct("n", "tree")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest"))
    blocks = members.groupBy(F.col(key).alias("bk")).agg((F.max("block") + 1).alias("blocks"))
    sizes = cut(sizes.where("rest > 0").join(blocks, F.col("k") == F.col("bk")).select("k", "largest", "blocks", F.ceil(F.col("rest") / block).cast("int").alias("parts")))
    met = join_dimension(placed, sizes, key, "k")
    counters = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    every = met.select(key, "block", F.explode(counters(F.col("parts"))).alias("part"), F.lit(False).alias("outside"), "id", "tree", "payload")
    rest = met.where("tree <> largest").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rest = rest.select(key, F.explode(counters(F.col("blocks"))).alias("block"), "part", F.lit(True).alias("outside"), "id", "tree", "payload")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_group(batches, 3):
            left, right = [r for r in rows if r[0]], [r for r in rows if not r[0]]
            if not left or not right:
                continue
            tree = np.array([r[2] for r in right], np.int64)
            found = []
            for (_, one, own, _), linked_to in zip(left, near([r[3] for r in left], [r[3] for r in right])):
                hit = np.flatnonzero(linked_to & (tree != own))
                found += [(one, right[hit[i]][1]) for i in np.unique(tree[hit], return_index=True)[1]]
            if found:
                yield edge_batch(found)

    return every.unionByName(rest).repartition(key, "block", "part").sortWithinPartitions(key, "block", "part").mapInArrow(trimmed(link), "a bigint, b bigint")


#: One fingerprint in so many tells which keys have more than ``CROWD`` members; those are dealt to blocks of that many.
SAMPLED, CROWD = 64, 8192


def near_pairs(distinct: DataFrame, width: int, keys_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], shown: int, most: int | None, sampled: int = SAMPLED, crowd: int = CROWD) -> DataFrame:
    """(a, b) edges between identities of distinct fingerprints fp0..., whose components are those of all links.

    ``shown`` words of a fingerprint go along with each key, by which links are verified.  Further keys may come as an array
    beside the fingerprints, bands.  ``most`` is that of ``alike``."""
    further = ["bands"] if "bands" in distinct.columns else []
    names = [f"fp{i}" for i in range(shown)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns[:width]], axis=1)
            for at in range(0, len(fps), 1_000):
                some = fps[at : at + 1_000]
                rows, keys = keys_of(some)
                for bands in batch.columns[width:]:
                    bands = bands.slice(at, 1_000)
                    rows = np.concatenate((rows, np.repeat(np.arange(len(some)), bands.value_lengths().to_numpy())))
                    keys = np.concatenate((keys, bands.flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(some[rows, i]).view(np.int64)) for i in range(shown))], names=["key", *names])

    def keyed(some: DataFrame) -> DataFrame:
        return some.select(*(f"fp{i}" for i in range(width)), *further).mapInArrow(trimmed(spread), "key bigint, " + ", ".join(f"{n} bigint" for n in names))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a key come one after another; what is held is the pieces of the key that reaches into the next batch.
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def edges() -> Iterator[pa.RecordBatch]:
            key, fps = (np.concatenate(parts) for parts in zip(*held))
            left, right = linked(key, fps, most)
            if len(left):
                ids = identity(fps)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[left], ids[right])), pa.array(np.maximum(ids[left], ids[right]))], names=["a", "b"])

        for batch in batches:
            key = batch.column(0).to_numpy()
            fps = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1 : 1 + shown]], axis=1)
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])
            if last:
                held.append((key[:last], fps[:last]))
                yield from edges()
                held = []
            elif held and held[-1][0][-1] != key[0]:
                yield from edges()
                held = []
            held.append((key[last:], fps[last:]))
        if held:
            yield from edges()

    counted = keyed(distinct.where(F.pmod(F.xxhash64("fp0"), F.lit(sampled)) == 0)).groupBy(F.col("key").alias("hot")).count().where(F.col("count") * sampled > crowd)
    hot = cut(counted.select("hot", F.ceil(F.col("count") * sampled / crowd).cast("int").alias("blocks")))
    if hot.isEmpty():
        return keyed(distinct).repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(meet), "a bigint, b bigint").distinct()
    known = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    met = keyed(distinct).join(known, F.col("key") == F.col("hot"), "left")
    quiet = met.where("hot is null").select("key", *names).repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(meet), "a bigint, b bigint")
    loud = cut(met.where("hot is not null").select("key", *names, F.pmod(F.xxhash64("key", *names), F.col("blocks")).cast("int").alias("block")))
    # A block of a key is a key of its own here.
    inside = loud.select(F.xxhash64("key", "block").alias("key"), *names).repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(meet), "a bigint, b bigint")
    edges = cut(quiet.unionByName(inside).distinct())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[2:]], axis=1)
            payload = pa.array([row.tobytes() for row in fps], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(identity(fps)), payload], names=["key", "block", "id", "payload"])

    def near(left: list[bytes], right: list[bytes]) -> Iterator[np.ndarray]:
        fps = np.frombuffer(b"".join(right), np.uint64).reshape(len(right), -1)
        for one in left:
            yield alike(fps, np.frombuffer(one, np.uint64), most)

    members = loud.select("key", "block", *names).mapInArrow(trimmed(named), "key bigint, block int, id bigint, payload binary")
    return edges.unionByName(across(members, "key", edges, crowd, near)).distinct()


def dealt_anew(frame: DataFrame) -> DataFrame:
    """An aggregate in partitions of its own, so that adaptive execution may split the join with a key that a third of all rows have."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


def components_of(prints: DataFrame, first: Column, width: int, keys_of, shown: int, most: int) -> DataFrame:
    """(id, first) for each distinct fingerprint identity of materialised rows with id and fp0...: the smallest ``first`` (an
    aggregate) of its component."""
    classes = cut(prints.groupBy("id", *(f"fp{i}" for i in range(width))).agg(first.alias("first")))
    reached = connected_components(near_pairs(classes, width, keys_of, shown, most))
    firsts = classes.groupBy("id").agg(F.min("first").alias("first"))
    # Fingerprints that no other is near are their own component.
    named = firsts.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = dealt_anew(named.groupBy("component").agg(F.min("first").alias("first")))
    return dealt_anew(named.select("id", "component").join(smallest, "component").select("id", "first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id reachable over links of ``most`` bits at most, 3 or fewer."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), shingle))
    named = components_of(prints, F.min("doc_id"), 1, strict_keys, 1, most)
    return prints.join(named, "id").select("doc_id", F.col("id").alias("fp"), F.col("first").alias("component_id"))


#: Of 256 bits: 39 differ on average at a similarity of 0.8, half of them between unrelated texts.
WIDE_MOST = 72
#: Sets and shingles that a block of a component holds at most, about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Columns of ``docs`` but text, with the text's sorted distinct shingle hashes as bytes."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(words_of(text.as_py()), shingle)).tobytes() for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "shingles binary"])
    return docs.select(*(f.name for f in kept), "text").mapInArrow(trimmed(run), schema)


def similar_forest(sets: list[np.ndarray], tenths: int = TENTHS) -> list[tuple[int, int]]:
    """Edges (rows) of a spanning forest over the pairs of sets whose Jaccard similarity is ``tenths`` / 10 or more, exactly."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, np.int64)
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    own = [codes[b - n : b] for n, b in zip(sizes.tolist(), ends.tolist())]
    marked = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    edges, left = [], np.flatnonzero(sizes > 0)

    def laid(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([own[r] for r in rows]), np.cumsum(sizes[rows]) - sizes[rows]

    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        flat, begins = laid(left)
        while queue and len(left):
            one = queue.pop(0)
            marked[own[one]] = 1
            shared = np.add.reduceat(marked[flat], begins)
            marked[own[one]] = 0
            # shared / (a + b - shared) >= tenths / 10
            near = (10 + tenths) * shared >= tenths * (sizes[left] + sizes[one])
            if near.any():
                met = left[near]
                edges += [(one, other) for other in met]
                queue.extend(met)
                left = left[~near]
                if len(left):
                    flat, begins = laid(left)
    return edges


def similar_rows(left: list[bytes], right: list[bytes], tenths: int = TENTHS) -> Iterator[np.ndarray]:
    """For each set of the one list, which of the other are similar at ``tenths`` / 10 or more."""
    sets = [np.frombuffer(x, np.uint64) for x in (*right, *left)]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets], np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = codes[: begins[len(right)]]
    marked = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    for i in range(len(right), len(sets)):
        own = codes[begins[i] : begins[i] + sizes[i]]
        marked[own] = 1
        shared = np.add.reduceat(marked[flat], begins[: len(right)])
        marked[own] = 0
        yield (10 + tenths) * shared >= tenths * (sizes[: len(right)] + sizes[i])


def similar_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) edges between sets (component, set_id, n, shingles) of a component, none empty, whose components are those of all
    its pairs similar at ``TENTHS`` / 10 or more."""
    totals = sets.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    totals = cut(totals.select("c", blocks.alias("blocks")))
    dealt = join_dimension(sets, totals, "component", "c").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))

    def forests(members: DataFrame) -> DataFrame:
        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in of_group(batches, 2):
                found = similar_forest([np.frombuffer(r[1], np.uint64) for r in rows])
                if found:
                    yield edge_batch([(rows[x][0], rows[y][0]) for x, y in found])

        dealt = members.select("component", "block", "set_id", "shingles").repartition("component", "block").sortWithinPartitions("component", "block")
        return dealt.mapInArrow(trimmed(verify), "a bigint, b bigint")

    edges = cut(forests(dealt))
    if totals.where("blocks > 1").isEmpty():
        return edges
    large = cut(dealt.where("blocks > 1").select("component", "block", F.col("set_id").alias("id"), F.col("shingles").alias("payload")))
    # The trees' roots first: those of a group of copies are copies too, and make it one tree.
    trees = connected_components(edges).select(F.col("node").alias("of"), F.col("component").alias("tree"))
    roots = large.join(trees, F.col("id") == F.col("of"), "left").where(F.coalesce("tree", "id") == F.col("id"))
    counts = cut(roots.groupBy(F.col("component").alias("c")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("few")))
    roots = join_dimension(roots.select("component", "id", "payload"), counts, "component", "c")
    roots = roots.select("component", F.pmod(F.xxhash64("id", F.lit(1)), F.col("few")).cast("int").alias("block"), F.col("id").alias("set_id"), F.col("payload").alias("shingles"))
    edges = cut(edges.unionByName(forests(roots)).distinct())
    return edges.unionByName(across(large, "component", edges, BLOCK_SETS, similar_rows)).distinct()


#: In so many texts a shingle is common; how many of them are known at most.  That decides by which keys pieces meet, not whether.
COMMON, COMMON_KNOWN = 1024, 100_000


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of the commonest shingles, as one text in ``SAMPLED`` tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(words_of(text.as_py()), shingle)).view(np.int64))], names=["hash"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(trimmed(run), "hash bigint")
    often = some.groupBy("hash").count().where(F.col("count") * SAMPLED > COMMON).orderBy(F.desc("count"), "hash").limit(COMMON_KNOWN)
    return np.sort(np.array([r.hash for r in often.select("hash").collect()], np.int64).view(np.uint64))


#: Collections after which the JVM has let go of a frame that is gone: the third at the latest, as measured, and one more.
COLLECTIONS = 4


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more, those of the last query too."""
    for _ in range(COLLECTIONS):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def pieces_told(prints: DataFrame) -> DataFrame:
    """(id, fp0, fp1, piece, bands) of the pieces of each row: its two words, their identity, its keys."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(1), []
            words, keys = [], []
            for at, one in enumerate(flat):
                for word, some in pieces_of(one.values.to_numpy()):
                    ends.append(at)
                    words.append(word)
                    keys.append(some)
            if ends:
                fps = np.stack(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ends)), pa.array(np.ascontiguousarray(fps[:, 0])), pa.array(np.ascontiguousarray(fps[:, 1])), pa.array(identity(fps.view(np.uint64))), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp0", "fp1", "piece", "bands"])

    return prints.where("n > 0").select("id", "pieces").mapInArrow(trimmed(told), "id bigint, fp0 bigint, fp1 bigint, piece bigint, bands array<bigint>")


def pieces_met(prints: DataFrame, folder: str) -> DataFrame:
    """(a, b) edges between identities of fingerprints, of ``fingerprints`` with sets: those of sets similar at ``TENTHS`` / 10
    or more are connected, all of them.

    ``prints`` are the table of that name in ``folder``; it goes before the search, and the table of distinct pieces after it."""
    spark = prints.sparkSession
    each = pieces_told(prints)
    distinct = write_stage(each.groupBy("piece", "fp0", "fp1").agg(F.min("id").alias("root"), F.any_value("bands").alias("bands")), folder, "pieces")
    roots = distinct.select(F.col("piece").alias("of"), "root")
    whole = cut(each.select("id", "piece").distinct().join(dealt_anew(roots), F.col("piece") == F.col("of")).select(F.col("id").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    drop_folder(spark, f"{folder}/prints")
    collect_garbage(spark)
    no_keys = lambda fps: (np.empty(0, np.int64), np.empty(0, np.int64))
    pairs = near_pairs(distinct.select("fp0", "fp1", "bands"), 2, no_keys, 2, None)
    pairs = pairs.join(roots.select(F.col("of").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("of").alias("b"), F.col("root").alias("rb")), "b")
    met = cut(whole.unionByName(pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).where("a <> b").distinct())
    drop_folder(spark, f"{folder}/pieces")
    return met


def near_copies(docs: DataFrame, shingle: int = 5, most: int = WIDE_MOST) -> DataFrame:
    """(doc_id, digest, first) for each row; components link texts whose sets of shingles are similar at 0.8 or more, and
    first is the row (without an id?, doc_id, digest) that comes first in its component.

    Texts with equal sets are one set.  ``most`` bits bound the search by fingerprints, pieces of sets complete it; what they find
    is verified by the sets themselves.  Pieces come first, so that their tables are gone when fingerprints meet."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/near-copies-{uuid.uuid4()}"
    keyed = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    prints = write_stage(fingerprints(keyed, shingle, WIDE, sets=True, common=common_shingles(docs, shingle)), folder, "prints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("digest"))
    names = [f"fp{i}" for i in range(WIDE)]
    rows = cut(prints.select("doc_id", "digest", "set_id"))
    classes = cut(prints.groupBy("set_id", "n", "id", "bands", *names).agg(F.min(row).alias("first")))
    met = pieces_met(prints, folder)
    # A search's shuffle goes before the next.
    collect_garbage(spark)
    keys_of = partial(wide_keys, mate_bits=mate_bits_for(classes.count()))
    met = cut(met.unionByName(near_pairs(classes.select(*names, "bands").distinct(), WIDE, keys_of, WIDE, most)))
    collect_garbage(spark)
    drop_folder(spark, folder)
    reached = connected_components(met)
    # Sets with company: in a component of fingerprints, or with the same fingerprint.
    grouped = classes.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    crowded = dealt_anew(grouped.groupBy("component").count().where("count > 1").select("component"))
    members = cut(grouped.join(crowded, "component").where("n > 0").select("component", "set_id", "n", F.col("first.digest").alias("of_digest"), F.col("first.doc_id").alias("of_id")))
    # One text of each set, found in place where its id and digest are few enough to be sent along.
    few = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    texts = keyed.join(few, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    sets = cut(shingle_sets(texts.select("component", "set_id", "n", "text"), shingle).dropDuplicates(["component", "set_id"]))
    linked_sets = connected_components(similar_pairs(sets)).select(F.col("node").alias("set_id"), "component")
    named = classes.groupBy("set_id").agg(F.min("first").alias("first")).join(linked_sets, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = dealt_anew(named.groupBy("component").agg(F.min("first").alias("first")))
    named = dealt_anew(named.select("set_id", "component").join(smallest, "component").select("set_id", "first"))
    return rows.join(named, "set_id").select("doc_id", "digest", "first")


def drop_near_copies(docs: DataFrame, shingle: int = 5, most: int = WIDE_MOST) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies, that of the smallest doc_id (null last).

    Rows that go are told by id and a hash of their text; the texts are dealt out at most once, to meet them."""
    found = cut(near_copies(docs.select("doc_id", "text"), shingle, most))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    base = packed(docs, doc_id=F.col("doc_id"), digest=F.xxhash64("text"))
    as_key = [F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest")]
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))
    gone = found.where(~stays).select(*as_key).distinct()
    repeated = cut(found.where(stays).groupBy("doc_id", "digest").count().where("count > 1").select(*as_key))
    kept = base.join(gone, same, "left_anti")
    if repeated.isEmpty():
        return unpacked(kept, docs.columns)
    # Rows of the id and text that stay: the first of them, by all their columns.
    once = kept.join(repeated, same, "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.md5(F.col("row").cast("string"))).alias("row"))
    return unpacked(kept.join(repeated, same, "left_anti").select("row").unionByName(once.select("row")), docs.columns)


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
