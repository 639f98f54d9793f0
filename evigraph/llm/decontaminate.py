"""Benchmark decontamination with suffix arrays of the training text.

The training documents are read in place, in shards of about ``SHARD_WORDS`` words.  Each shard gets a sorted array of its
word suffixes (compared over as many words as a window can have); a suffix whose first words no test text holds
can't match and is left out of the sort.  Every test suffix is binary-searched in the array of every shard, which yields
its occurrences and the length of its longest verbatim match.  Windows of ``WINDOW`` words that occur make the document's
words hit; a test item of fewer words is one window.  Nothing is shuffled: a document's result is complete in its shard.

``decontaminate`` removes a document of any length that holds a window of ``WINDOW`` words; items of fewer words, which may
be found by chance, only count by the share of words that are hit, ``contaminated``.

The test words are sent to the executors in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark takes several
passes whose results are merged by document position.

Cases: null texts have no words; empty texts neither; texts of any length are taken whole, a document is never split;
repeated items and ties count once per item_id; items with a null id are one item, apart from one called ``null``; repeated
documents are reported each; empty tables give an empty result or zero counts; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from evigraph.llm.common import beside_text, table, text_beside, trimmed, unpacked

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_WORDS = 1_000_000
#: Every byte but 0-9, a-z and those of non-ASCII characters parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Tests:
    """Test windows as word numbers: row i of ``windows`` holds ``lengths[i]`` of them, then -1; ``items`` names its item."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.ids = sorted({i for i, w in items if w}, key=lambda i: (i is not None, i))
        number = {x: n for n, x in enumerate(self.ids)}
        rows, owners = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for item, words in items:
            if not words:
                continue
            codes = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int32, len(words))
            if len(codes) < window:
                codes = np.concatenate((codes, np.full(window - len(codes), -1, np.int32)))
            rows.append(np.lib.stride_tricks.sliding_window_view(codes, window))
            owners.append(np.full(len(rows[-1]), number[item]))
        self.windows, self.items = np.concatenate(rows), np.concatenate(owners)
        self.lengths = (self.windows >= 0).sum(axis=1)
        # Windows of one word make a word a start on its own; of longer ones, the first two words must follow each other.
        size = max(1, len(self.vocabulary))
        self.size = size
        self.pairs = np.unique(self.windows[self.lengths > 1, 0].astype(np.int64) * size + self.windows[self.lengths > 1, 1])
        self.singles = np.unique(self.windows[self.lengths == 1, 0])

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Positions at which some window can begin."""
        pair = codes[:-1].astype(np.int64) * self.size + codes[1:]
        pair[(codes[:-1] < 0) | (codes[1:] < 0)] = -1
        can = np.zeros(len(codes), bool)
        if len(self.pairs) and len(pair):
            can[:-1] = self.pairs[np.searchsorted(self.pairs, pair).clip(max=len(self.pairs) - 1)] == pair
        if len(self.singles):
            can |= np.isin(codes, self.singles)
        return np.flatnonzero(can)


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` sorted by the ``depth`` words that follow them, and those words as rows of big-endian bytes.

    ``codes`` must end with ``depth`` separators (-1); a row of words is compared as one byte string."""
    keys = as_keys(codes[at[:, None] + np.arange(depth)] + 1) if len(at) else np.empty(0, f"S{4 * depth}")
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def as_keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def search(keys: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) in the array of the suffixes that begin with each window."""
    # -1, past the end of a short item, becomes the least word; the greatest word there bounds it from above.
    low = as_keys(tests.windows + 1)
    first = np.searchsorted(keys, low, "left")
    last = np.searchsorted(keys, low, "right")
    short = np.flatnonzero(tests.lengths < tests.window)
    if len(short):
        high = tests.windows[short].astype(np.int64) + 1
        high[high == 0] = 0xFFFFFFFF
        last[short] = np.searchsorted(keys, as_keys(high), "right")
    return first, last


def scan_shard(texts: list[list[bytes]], tests: Tests) -> list[tuple[int, int, list[int], list[tuple[int, int, int, int]]]]:
    """Per document: words, hit words, items, and maximal verbatim runs (item, first word, words, words of its longest window)."""
    get = tests.vocabulary.get
    apart = [-1] * tests.window
    flat: list[int] = []
    begins = []
    for words in texts:
        begins.append(len(flat))
        flat += [get(w, -1) for w in words]
        flat += apart
    codes = np.array(flat, np.int32)
    place, keys = suffix_array(codes, tests.starts(codes), tests.window)
    first, last = search(keys, tests)
    some = np.flatnonzero(last > first)
    # One row for each occurrence of a window.
    counts = (last - first)[some]
    which = np.repeat(some, counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place[np.repeat(first[some], counts) + offset] if len(some) else np.empty(0, np.int64)
    length, item = tests.lengths[which], tests.items[which]
    hit = np.zeros(len(codes) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + length, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
    owner = np.searchsorted(np.array(begins), at, "right") - 1
    order = np.lexsort((at, item, owner))
    owner, item, at, length = owner[order], item[order], at[order], length[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for d, words in enumerate(texts):
        mine = slice(bounds[d], bounds[d + 1])
        runs: list[tuple[int, int, int, int]] = []
        for i, a, n in zip(item[mine].tolist(), (at[mine] - begins[d]).tolist(), length[mine].tolist()):
            if runs and runs[-1][0] == i and a <= runs[-1][1] + runs[-1][2] - n + 1:
                runs[-1] = (i, runs[-1][1], max(runs[-1][2], a + n - runs[-1][1]), max(runs[-1][3], n))
            elif not runs or runs[-1][:3] != (i, a, n):
                runs.append((i, a, n, n))
        out.append((len(words), int(covered[begins[d] + len(words)] - covered[begins[d]]), sorted({r[0] for r in runs}), runs))
    return out


def blocks_of(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Benchmark items, read through the driver a partition at a time, in blocks of bounded size."""
    held, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((row[0], words_of(row[1])))
        words += len(held[-1][1])
        if words >= most:
            yield held
            held, words = [], 0
    yield held


ADDED = StructType().add("n_words", "long").add("n_hit", "long").add("matches", ArrayType(StructType().add("item_id", "string").add("first_word", "long").add("n_words", "long").add("window", "long")))


def _find(frame: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int, shard_words: int, with_text: bool) -> DataFrame:
    """``frame``, whose last column is the text, with n_words, n_hit and matches; without the text unless it is asked for."""
    tests = frame.sparkSession.sparkContext.broadcast(Tests(items, window))
    passed = len(frame.columns) - (not with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("window", pa.int64())]))
        for batch in batches:
            texts, total, begun = [], 0, 0
            for row in range(batch.num_rows):
                texts.append(words_of(batch.column(batch.num_columns - 1)[row].as_py()))
                total += len(texts[-1])
                if total < shard_words and row + 1 < batch.num_rows:
                    continue
                found, ids = scan_shard(texts, tests.value), tests.value.ids
                matches = [[{"item_id": ids[i], "first_word": a, "n_words": n, "window": w} for i, a, n, w in f[3]] for f in found]
                made = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(matches, run_type)]
                columns = [batch.column(i).slice(begun, len(texts)) for i in range(passed)]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names[:passed], *ADDED.names])
                texts, total, begun = [], 0, row + 1

    return frame.mapInArrow(trimmed(run), StructType([*frame.schema.fields[:passed], *ADDED.fields]))


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, n_words, n_hit, matches): row is a struct of the columns ``keep`` (all by default) of ``docs``, matches are the
    runs of words that overlapping windows of one item cover.

    With several blocks of items, the texts pass through one scan a block, and a document's hits are united from its runs."""
    blocks = blocks_of(benchmark)
    block, following = next(blocks), next(blocks, [])
    wanted = docs.columns if keep is None else keep
    frame, with_text = text_beside(docs, wanted), any(c.lower() == "text" for c in wanted)
    before = False
    while True:
        found = _find(frame, block, window, shard_words, bool(following) or with_text)
        if before:
            found = found.withColumn("matches", F.concat("before", "matches")).withColumn("n_hit", _united(F.col("matches")))
        if not following:
            return found.select(F.struct(*beside_text(wanted)).alias("row"), "n_words", "n_hit", "matches")
        frame = found.select("row", F.col("matches").alias("before"), "text")
        block, following, before = following, next(blocks, []), True


def _united(matches):
    """Words that runs cover, overlaps once."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["first_word"].alias("a"), (m["first_word"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    return F.aggregate(ordered, zero, step, lambda s: s["n"])


def contaminated() -> Column:
    """Over a twentieth of the words, and at least one, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without rows that hold ``WINDOW`` words of the benchmark in a row, or that are contaminated."""
    leaks = F.exists("matches", lambda m: m["window"] >= WINDOW)
    return unpacked(find_matches(docs, benchmark).where(~leaks & ~contaminated()), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = F.array_distinct(F.transform("matches", lambda m: m["item_id"]))
    return find_matches(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ",", "null"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
