"""Substring dedup with suffix arrays by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.  Suffixes
live in q-gram buckets that are spread over the cluster and refined there:

1. Every window of ``LENGTH`` bytes belongs to the bucket of its minimizer, the q-gram of smallest hash in it.  Equal
   windows have equal minimizers, so they meet in one bucket.  Documents are read in groups of about ``GROUP_BYTES``; a
   group sends 5 bytes for each distinct bucket it has to the shard that owns the bucket.
2. Shards answer which buckets two documents share.  All others hold no repeat and are dropped.
3. Groups send the stretches of text of the shared buckets, equal stretches of a group once, with the smallest doc_id.
4. A shard builds the suffix array of its stretches to depth ``LENGTH``: initial buckets of 8 bytes are sorted on the bucket
   pointers of later offsets, 8, 16 and then 18 bytes on, each round using the pointers that the last one refined, and
   only buckets of several members are refined.  Suffixes with the same final pointer are equal windows; the smallest
   doc_id among them decides.
5. Groups get the windows that go, and paint and cut their documents.

Texts move once, in an exchange that steps 1, 3 and 5 share.  Exact copies are known by a digest beforehand and take no
part in steps 1 to 4.  A bucket that a third of all documents share has one entry for each group in steps 1 and 2 and
one for each distinct stretch of a group in steps 3 and 4.

Cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a null doc_id counts as larger than all others;
rows of one doc_id don't make each other lose anything, and are reported each; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import SALTS, freed, shards_for, table

LENGTH, GRAM = 50, 20
GROUP_BYTES = 4_000_000
#: Bytes of text for each shard of step 2; about 1 in 16 begins a bucket's stretch.
SHARD_BYTES = 16_000_000
LAST = np.iinfo(np.int64).max
LOW40 = np.uint64((1 << 40) - 1)
#: Minimizers are compared by their hash's upper half, the same for all groups; the lower half gives way to the position.
PLACE = np.uint64((1 << 32) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes that begin at each position with so many left."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = lambda i, kind: np.ndarray((n,), kind, data.data, i, (1,))
    h = at(0, "<u8") * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += at(8, "<u8")
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += at(16, "<u4")
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` values in a row, by doubling."""
    reach, current = 1, values
    while reach * 2 <= width:
        current = np.minimum(current[:-reach], current[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(current[: len(current) - rest], current[rest:]) if rest else current


class Group:
    """The documents of one group, in a fixed order, as one byte array."""

    def __init__(self, rows: pa.Table) -> None:
        ids, texts, kinds = (rows.column(c).to_pylist() for c in ("doc_id", "text", "kind"))
        copies = {(i, t) for i, t, k in zip(ids, texts, kinds) if k}
        whole = sorted(((LAST if i is None else i, (t or "").encode("utf-8", "surrogatepass")) for i, t, k in zip(ids, texts, kinds) if not k))
        marked = {i for i, _ in copies}
        self.copy = [i in marked and (i, hashlib.sha256(t).hexdigest()) in copies for i, t in whole]
        self.texts = [t for _, t in whole]
        self.ids = np.array([i for i, _ in whole], np.int64)
        taking = [b"" if c else t for t, c in zip(self.texts, self.copy)]
        self.bytes = b"".join(taking)
        self.sizes = np.fromiter(map(len, taking), np.int64, len(taking))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of consecutive windows with one minimizer: its hash, first and last window, row."""
        data = np.frombuffer(self.bytes, np.uint8)
        if len(data) < LENGTH:
            return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
        hashes = gram_hashes(data)
        packed = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (window_minima(packed, LENGTH - GRAM + 1) & PLACE).astype(np.int64)
        del packed
        # Windows that reach into the next document aren't any.
        whole = np.zeros(len(place) + 1, np.int8)
        long = np.flatnonzero(self.sizes >= LENGTH)
        np.add.at(whole, self.begins[long], 1)
        np.add.at(whole, self.begins[long] + self.sizes[long] - LENGTH + 1, -1)
        windows = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
        place = place[windows]
        fresh = np.ones(len(windows), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
        start = np.flatnonzero(fresh)
        stop = np.append(start[1:], len(windows))
        first, last = windows[start], windows[stop - 1]
        return hashes[place[start]], first, last, np.searchsorted(self.begins, first, "right") - 1


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def distinct_buckets(hashes: np.ndarray, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets by (shard, low 40 bits): shard, bits, whether two documents of the group share it, and each stretch's."""
    key = (shard_of(hashes, shards).astype(np.uint64) << np.uint64(40)) | (hashes & LOW40)
    distinct, inverse = np.unique(key, return_inverse=True)
    low, high = np.full(len(distinct), LAST), np.full(len(distinct), -LAST - 1)
    np.minimum.at(low, inverse, ids)
    np.maximum.at(high, inverse, ids)
    return (distinct >> np.uint64(40)).astype(np.int64), distinct & LOW40, low < high, inverse


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(shards) else np.empty(0, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(shards[a]), a, b


def pack40(bits: np.ndarray) -> bytes:
    return bits.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes) -> np.ndarray:
    rows = np.zeros((len(data) // 5, 8), np.uint8)
    rows[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return rows.view("<u8").ravel()


def refine(data: np.ndarray, spots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers at depth ``length`` (32 to 64 bytes) of the suffixes at ``spots``; equal pointers, equal windows.

    ``data`` must go on for 64 bytes after the last window."""
    n = len(data) - 8
    first = np.ndarray((n,), ">u8", data.data, 0, (1,)).astype(np.uint64)
    pointers = np.unique(first, return_inverse=True)[1].astype(np.int64)
    reach = 8
    for ahead in (8, 16):
        crowded = np.bincount(pointers, minlength=n)[pointers] > 1
        crowded[len(pointers) - ahead :] = False
        active = np.flatnonzero(crowded)
        order, parts = _split(pointers, active, active + ahead)
        pointers[order] = parts + n * (reach // 8)
        # Pointers of crowded buckets are renamed above all others, so that none meets an old one.
        pointers = np.unique(pointers, return_inverse=True)[1].astype(np.int64)
        reach += ahead
    order, parts = _split(pointers, spots, spots + (length - reach))
    out = np.empty(len(spots), np.int64)
    out[np.searchsorted(spots, order)] = parts
    return out


def _split(pointers: np.ndarray, spots: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort ``spots`` on their own and a later offset's pointer; the spots in that order, and their new buckets' numbers."""
    if not len(spots):
        return spots, spots
    # Both pointers are below the number of positions; the pair is one number where it fits.
    own, other = pointers[spots], pointers[later]
    order = np.lexsort((other, own)) if int(own.max()) * int(pointers.max() + 1) > 1 << 62 else np.argsort(own * (int(pointers.max()) + 1) + other, kind="stable")
    own, other = own[order], other[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
    return spots[order], np.cumsum(fresh) - 1


def crowded_buckets(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which stretches share their bucket, the minimizer that all their windows have, with another stretch."""
    hashes = gram_hashes(data)
    packed = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    # Grams that reach over a stretch's end don't count.
    bounds = np.stack((begins, begins + sizes - GRAM + 1), axis=1).ravel()
    place = (np.minimum.reduceat(packed, bounds)[::2] & PLACE).astype(np.int64)
    _, inverse, counts = np.unique(hashes[place], return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def repeated_windows(stretches: list[bytes], firsts: np.ndarray) -> np.ndarray:
    """For each window of distinct stretches: the smallest document that any equal window is from.

    The windows of a stretch that is alone in its bucket equal no others, and aren't sorted."""
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    smallest = np.repeat(firsts, sizes - LENGTH + 1)
    data = np.frombuffer(b"".join(stretches) + bytes(72), np.uint8)
    crowded = crowded_buckets(data, np.cumsum(sizes) - sizes, sizes)
    if not crowded.any():
        return smallest
    into = np.repeat(crowded, sizes - LENGTH + 1)
    some = [x for x, c in zip(stretches, crowded.tolist()) if c]
    sizes, firsts = sizes[crowded], firsts[crowded]
    data = np.frombuffer(b"".join(some) + bytes(72), np.uint8)
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(some)), counts)
    spots = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + (np.cumsum(sizes) - sizes)[owner]
    pointers = refine(data, spots)
    least = np.full(int(pointers.max()) + 1, LAST)
    np.minimum.at(least, pointers, firsts[owner])
    smallest[into] = least[pointers]
    return smallest


def _batch(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def mark_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed runs as (start, end) in bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    groups, shards = shards_for(total, GROUP_BYTES), shards_for(total, SHARD_BYTES)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    narrow = docs.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull()).select("doc_id", digest.alias("digest"))
    known = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # A text that a third of all rows have is spread over salts.
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = narrow.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).where("doc_id > first").select("doc_id", "digest").distinct()
    # Dealt by id and text, so that neither an id nor a text that many rows have gathers all of them.
    group = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(groups)).cast("int").alias("grp")
    whole = docs.select("doc_id", "text", digest.alias("digest")).select(group, F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).alias("kind"))
    both = whole.unionByName(copies.select(group, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("digest").alias("text"), F.lit(1).alias("kind")))

    def announce(rows: pa.Table) -> pa.Table:
        group = Group(rows)
        hashes, _, _, row = group.buckets()
        shard, bits, shared, _ = distinct_buckets(hashes, group.ids[row], shards)
        grp = rows.column("grp")[0].as_py()
        out = [(s, grp, pack40(bits[a:b]), np.packbits(shared[a:b]).tobytes()) for s, a, b in by_shard(shard)]
        return _batch(["shard", "grp", "buckets", "shared"], out, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def answer(rows: pa.Table) -> pa.Table:
        blobs = [unpack40(x) for x in rows.column("buckets").to_pylist()]
        sizes = [len(b) for b in blobs]
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows.column("shared").to_pylist(), sizes)]).astype(bool)
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        shared = own[order]
        # A bucket of several groups is shared; so is one that any group knows to be.
        shared[1:] |= same
        shared[:-1] |= same
        own[order] = shared
        cuts = np.cumsum([0, *sizes]).tolist()
        shard = rows.column("shard")[0].as_py()
        out = [(g, shard, np.packbits(own[a:b]).tobytes()) for g, a, b in zip(rows.column("grp").to_pylist(), cuts, cuts[1:]) if own[a:b].any()]
        return _batch(["grp", "shard", "shared"], out, [pa.int32(), pa.int32(), pa.binary()])

    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        names = ["shard", "grp", "stretches", "sizes", "firsts", "entries", "rows", "starts", "own"]
        if not rows.num_rows or not answers.num_rows:
            return _batch(names, [], kinds)
        group = Group(rows)
        hashes, first, last, row = group.buckets()
        shard, bits, _, inverse = distinct_buckets(hashes, group.ids[row], shards)
        shared = np.zeros(len(bits), bool)
        said = dict(zip(answers.column("shard").to_pylist(), answers.column("shared").to_pylist()))
        for s, a, b in by_shard(shard):
            if s in said:
                shared[a:b] = np.unpackbits(np.frombuffer(said[s], np.uint8), count=b - a)
        some = np.flatnonzero(shared[inverse])
        some = some[np.argsort(shard[inverse[some]], kind="stable")]
        out, grp = [], rows.column("grp")[0].as_py()
        for s, a, b in by_shard(shard[inverse[some]]):
            mine = some[a:b]
            known: dict[bytes, int] = {}
            entry = np.fromiter((known.setdefault(group.bytes[x:y], len(known)) for x, y in zip(first[mine].tolist(), (last[mine] + LENGTH).tolist())), np.uint32, len(mine))
            ids = group.ids[row[mine]]
            least = np.full(len(known), LAST)
            np.minimum.at(least, entry, ids)
            starts = (first[mine] - group.begins[row[mine]]).astype(np.uint32)
            sizes = np.fromiter(map(len, known), np.uint8, len(known))
            out.append((s, grp, b"".join(known), sizes.tobytes(), least.tobytes(), entry.tobytes(), row[mine].astype(np.uint32).tobytes(), starts.tobytes(), np.packbits(ids == least[entry]).tobytes()))
        return _batch(names, out, kinds)

    def decide(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        known: dict[bytes, int] = {}
        least: list[int] = []
        entries = []
        for r in held:
            at, mine = 0, []
            for size, first in zip(r["sizes"], np.frombuffer(r["firsts"], np.int64).tolist()):
                text = r["stretches"][at : at + size]
                at += size
                i = known.setdefault(text, len(known))
                if i == len(least):
                    least.append(first)
                elif first < least[i]:
                    least[i] = first
                mine.append(i)
            entries.append(np.array(mine, np.int64))
        counts = np.fromiter(map(len, known), np.int64, len(known)) - LENGTH + 1
        ends = np.cumsum(counts)
        smallest = repeated_windows(list(known), np.array(least, np.int64))
        out = []
        for r, mine in zip(held, entries):
            firsts = np.frombuffer(r["firsts"], np.int64)
            size = counts[mine]
            flat = np.repeat(ends[mine] - size, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            gone = smallest[flat] < np.repeat(firsts, size)
            place = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
            bits = np.bitwise_or.reduceat(gone.astype(np.uint64) << place, np.cumsum(size) - size)
            full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
            entry = np.frombuffer(r["entries"], np.uint32)
            own = np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(entry)).astype(bool)
            verdict = np.where(own, bits[entry], full[entry])
            keep = verdict > 0
            if keep.any():
                row, start = np.frombuffer(r["rows"], np.uint32)[keep], np.frombuffer(r["starts"], np.uint32)[keep]
                out.append((r["grp"], row.tobytes(), start.tobytes(), verdict[keep].astype(np.uint32).tobytes()))
        return _batch(["grp", "rows", "starts", "windows"], out, [pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    def cut_out(rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        if not rows.num_rows:
            return _batch(names, [], kinds)
        group = Group(rows)
        gone = np.zeros(len(group.bytes) + LENGTH + 1, np.int32)
        for r in verdicts.to_pylist():
            row, start, bits = (np.frombuffer(r[c], np.uint32) for c in ("rows", "starts", "windows"))
            at = group.begins[row] + start
            for j in range(LENGTH - GRAM + 1):
                hit = at[(bits >> np.uint32(j)) & np.uint32(1) > 0] + j
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + LENGTH, -1)
        covered = np.cumsum(gone) > 0
        out = []
        for i, (text, copy) in enumerate(zip(group.texts, group.copy)):
            n = len(text)
            mask = np.ones(n, bool) if copy else covered[group.begins[i] : group.begins[i] + n]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
            spans = edge.reshape(-1, 2).tolist()
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if spans else text
            doc_id = int(group.ids[i])
            out.append((None if doc_id == LAST else doc_id, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        return _batch(names, out, kinds)

    announce, answer, send, decide, cut_out = map(freed, (announce, answer, send, decide, cut_out))
    per_group = both.groupBy("grp")
    said = per_group.applyInArrow(announce, "shard int, grp int, buckets binary, shared binary")
    answers = said.groupBy("shard").applyInArrow(answer, "grp int, shard int, shared binary")
    sent = per_group.cogroup(answers.groupBy("grp")).applyInArrow(send, "shard int, grp int, stretches binary, sizes binary, firsts binary, entries binary, rows binary, starts binary, own binary")
    verdicts = sent.groupBy("shard").applyInArrow(decide, "grp int, rows binary, starts binary, windows binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return per_group.cogroup(verdicts.groupBy("grp")).applyInArrow(cut_out, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
