"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

Terms are words (A-Z lower-cased, parted by ASCII white space), weighted by how often they occur.  For sample k, a term with
weight w draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from its own hash, and from them t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1).  The sample is the (term, t) of the smallest a.  Two texts agree in a sample with a probability
equal to the generalised Jaccard similarity of their weights, so the share of agreeing samples is its estimate.

The thin query also needs each document's successor by descending doc_id.  Rows are dealt to ranges of (doc_id, hash of the
text) of about equal length, with bounds from a sample, and placed by the range's number; each range is sorted and streamed
through Python, one batch at a time, and is given the first document of the next range as a guest at its end.  The sample
is chosen by hash, so reruns agree; how ids are spread doesn't matter.

Cases: a null text is empty; an empty text has the fingerprint of zeros, like only to itself; ties in doc_id are ordered by
a hash of their text; null ids come last; the last document is followed by the first, a single one by itself; an empty
table gives an empty result; extra columns pass through ``fingerprint_texts`` unless they carry a name that it adds.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evigraph.llm.common import beside_text, others, shards_for, table, text_beside

SAMPLES, SEED = 64, 42
#: Characters of a range; how many ranges there are at most, which are then longer (they are streamed); sampled rows for each.
RANGE_CHARS, MOST_RANGES, PER_RANGE = 4_000_000, 20_000, 32
FIRST_KEY = -(1 << 63)
#: Texts whose terms are drawn together.
TOGETHER = 128


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middles of 2**16 equal shares, and its logarithm, by bisection of 1 - (1 + x) exp(-x)."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low.astype(np.float32), np.log(low).astype(np.float32)


GAMMA, LOG_GAMMA = _quantiles()


class Sampler:
    """Signatures of texts; terms that several texts of one call share are drawn once."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        self.salts = np.random.default_rng(SEED).integers(1, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def draws(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """r, b, ln c and a 16-bit name, terms x samples, from 64 bits for each."""
        z = hashes[:, None] * self.salts
        z ^= z >> np.uint64(31)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(32)
        parts = z.view(np.uint16).reshape(*z.shape, 4)
        return GAMMA[parts[..., 0]], (parts[..., 1] + np.float32(0.5)) / np.float32(1 << 16), LOG_GAMMA[parts[..., 2]], parts[..., 3]

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """texts x samples of 16-bit samples."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        number: dict[bytes, int] = {}
        terms = [np.array([number.setdefault(w, len(number)) for w in text.lower().split()], np.int64) for text in texts]
        if not number:
            return out
        r, b, log_c, names = self.draws(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number)))
        single = log_c - r * (1 - b)
        every = np.arange(self.samples)
        for i, mine in enumerate(terms):
            if not len(mine):
                continue
            counts = np.bincount(mine)
            rows = np.flatnonzero(counts)
            counts = counts[rows]
            once, often = rows[counts == 1], rows[counts > 1]
            best = np.full(self.samples, np.inf, np.float32)
            if len(once):
                values = single[once]
                at = values.argmin(axis=0)
                best, out[i] = values[at, every], names[once[at], every]
            if len(often):
                of_r, of_b = r[often], b[often]
                step = np.floor(np.log(counts[counts > 1]).astype(np.float32)[:, None] / of_r + of_b)
                values = log_c[often] - of_r * (step - of_b + 1)
                at = values.argmin(axis=0)
                name = names[often[at], every] + (step[at, every].astype(np.int64) * 40503).astype(np.uint16)
                out[i] = np.where(values[at, every] < best, name, out[i])
        return out


def to_hex(signatures: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signatures]


def likeness(a: str, b: str) -> float:
    """Share of samples in which two fingerprints agree."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def fingerprint_texts(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs`` with ``fingerprint``; texts are read in place and nothing is shuffled."""
    kept = others(docs, ["fingerprint"])
    frame = text_beside(docs, kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(1)]
            signed = [h for at in range(0, len(texts), TOGETHER) for h in to_hex(sampler.signatures(texts[at : at + TOGETHER]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return frame.mapInArrow(run, StructType([*frame.schema.fields, StructField("fingerprint", StringType())])).select(*beside_text(kept), "fingerprint")


def range_bounds(keyed: DataFrame, per_range: int = RANGE_CHARS, most: int = MOST_RANGES) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds (key, hash), ascending, of all ranges but the last, of about equal characters; ``keyed`` has key, hash, chars."""
    rows, chars = keyed.agg(F.count(F.lit(1)), F.sum("chars")).first()
    parts = min(shards_for(chars, per_range), most)
    if parts <= 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # About ``PER_RANGE`` rows a range come to the driver.
    rate = max(1, rows // (parts * PER_RANGE))
    sample = keyed.where(F.pmod(F.xxhash64("key", "hash", F.lit(SEED)), F.lit(rate)) == 0).groupBy("key", "hash").agg(F.sum("chars").alias("chars")).toPandas()
    key, hash_, weight = (sample[c].to_numpy(np.int64) for c in ("key", "hash", "chars"))
    order = np.lexsort((hash_, key))
    reached = np.cumsum(weight[order])
    at = np.unique(np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts)) if len(reached) else np.empty(0, np.int64)
    return key[order][at], hash_[order][at]


def range_of(bounds: tuple[np.ndarray, np.ndarray]) -> Column:
    """The number of a row's range, by its key and hash; the highest keys are in range 0.  A binary search among the bounds."""
    many = len(bounds[0])
    listed = F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in zip(bounds[0].tolist(), bounds[1].tolist())])), "array<struct<k:bigint,h:bigint>>")

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        bound = F.try_element_at(listed, middle + 1)
        under = (bound["k"] < F.col("key")) | ((bound["k"] == F.col("key")) & (bound["h"] < F.col("hash")))
        low = F.when(under, middle + 1).otherwise(state["low"])
        return F.when(state["low"] < state["high"], F.struct(low.alias("low"), F.when(under, state["high"]).otherwise(middle).alias("high"))).otherwise(state)

    whole = F.struct(F.lit(0).alias("low"), F.lit(many).alias("high"))
    return (F.lit(many) - F.aggregate(F.sequence(F.lit(1), F.lit(many.bit_length() + 1)), whole, halve)["low"]).cast("int")


def with_next(docs: DataFrame, per_range: int = RANGE_CHARS) -> DataFrame:
    """(part, guest, key, doc_id, text) rows dealt by part and sorted: descending key, then hash and text, a guest at the end."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_KEY)).alias("key"), F.xxhash64(text).alias("hash"), "doc_id", text.alias("text"))
    bounds = range_bounds(keyed.select("key", "hash", F.length("text").cast("bigint").alias("chars")), per_range)
    part = range_of(bounds)
    # The first row of each range that has any is also sent to the one before; the very first to the last.  They are as few as ranges.
    tops = keyed.select("key", "hash").withColumn("part", part).groupBy("part").agg(F.max(F.struct("key", "hash")).alias("top"))
    filled = sorted((r.part, r.top.key, r.top.hash) for r in tops.collect())
    guests = docs.sparkSession.createDataFrame([(filled[i - 1][0], key, hash_) for i, (_, key, hash_) in enumerate(filled)], "part int, key bigint, hash bigint")
    firsts = keyed.join(F.broadcast(guests), ["key", "hash"]).groupBy("part", "key", "hash").agg(F.min(F.struct("text", "doc_id")).alias("row"))
    guests = firsts.select("part", F.lit(1).alias("guest"), "key", "hash", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    rows = keyed.withColumn("part", part).select("part", F.lit(0).alias("guest"), "key", "hash", "doc_id", "text").unionByName(guests)
    dealt = rows.repartitionById(len(bounds[0]) + 1, "part").sortWithinPartitions("part", "guest", F.col("key").desc(), F.col("hash").desc(), "text")
    return dealt.select("part", "guest", "key", "doc_id", "text")


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES, per_range: int = RANGE_CHARS) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The last floor(n / 2) characters are replaced by as many first ones of the next document."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held, before = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                rows = list(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(3).to_pylist(), some.column(4).to_pylist()))
                done, edits, follows = [], [], []
                for i, (part, guest, doc_id, text) in enumerate(rows):
                    if held is not None and held[0] == part and not held[1]:
                        n = len(held[3])
                        done.append(held)
                        edits.append((held[3][: n - n // 2] + text[: n // 2]).encode("utf-8", "surrogatepass"))
                        follows.append(i)
                    held = (part, guest, doc_id, text)
                signatures = sampler.signatures([t.encode("utf-8", "surrogatepass") for *_, t in rows] + edits)
                own, edited = signatures[: len(rows)], signatures[len(rows) :]
                # The row before the first of a slice was signed with the slice before.
                of_row = [own[i - 1] if i else before for i in follows]
                before = own[-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([h[2] for h in done], batch.schema.field(3).type),
                        pa.array([len(h[3]) for h in done], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                        pa.array([s.astype(">u2").tobytes().hex() for s in of_row], pa.string()),
                        pa.array(to_hex(edited), pa.string()),
                        pa.array([float((s == e).mean()) for s, e in zip(of_row, edited)], pa.float64()),
                        pa.array([float((s == own[i]).mean()) for s, i in zip(of_row, follows)], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs.select("doc_id", "text"), per_range).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
