"""Toxicity: a convolutional text classifier trained in numpy.

Words, and their beginnings and ends, are hashed to rows of an embedding table; a word's embedding is the mean of its
pieces'.  Filters of several widths slide over the words; each filter keeps its
largest response over the text, and a logistic layer weighs those and gives a score.  As a filter is a sum of one product
for each of its words, every product of a table row and a filter's slot is worked out once, after training; scoring a text
is then a gather and a sum, over the whole text in bounded blocks.

The model is fitted in one task, on a sample of at most ``TRAIN_DOCS`` labelled rows of ``TRAIN_BYTES`` in all: those with the
smallest hash of their id, so the bounds hold at every size and reruns agree.  Training and scoring see whole texts.  A
threshold for each language is calibrated on the calibration fold of the sample, that of best F1 within ``BOUNDS``; scores
themselves know nothing but the text.

Cases: a null or empty text has no words and gets the score of no response; labels of null are left out; a text with
several labels counts with the largest; of rows that share an id, the one of the least text is in the sample; without any
labelled row every score is 0.5; repeated rows score alike; an empty table gives an empty result; columns of any name pass
through ``reject``, and through ``score`` but for one called toxicity.
"""

from __future__ import annotations

import pickle
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evigraph.llm.common import beside_text, cut, table, text_beside, trimmed

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 16
#: Pieces of a word that have embeddings: the word itself, and its first and last bytes in these numbers.
HEADS, TAILS = (3, 4, 5, 6), (3, 5)
PIECES = 1 + len(HEADS) + len(TAILS)
TRAIN_DOCS, VISITS, EPOCHS, RATE, DECAY, BATCH, SEED = 5000, 20_000, 40, 0.01, 3e-4, 32, 7
#: Bytes of text that the sample holds; it always has a first row.
TRAIN_BYTES = 64_000_000
THRESHOLD = 0.3
#: Calibrated thresholds stay between these.
BOUNDS = (0.2, 0.8)
#: Distinct words that a task remembers.
REMEMBERED = 60_000
#: Texts that are scored in one call.
TOGETHER = 256
#: Every byte but letters, digits and those of non-ASCII characters parts words; A-Z lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def pieces_of(word: bytes) -> list[int]:
    """Table rows of a word's pieces, always as many; a word shorter than a piece has itself in its place."""
    crc = zlib.crc32
    return [crc(word) % BUCKETS, *(crc(b"<" + word[:n]) % BUCKETS for n in HEADS), *(crc(word[-n:] + b">") % BUCKETS for n in TAILS)]


class Vocabulary:
    """Numbers for words, and the pieces of each; number 0 is no word."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.pieces = array("i", [BUCKETS] * PIECES)

    def numbers(self, text: str | None) -> np.ndarray:
        number, out = self.number, []
        for word in words_of(text):
            n = number.get(word)
            if n is None:
                n = number[word] = len(number)
                self.pieces.extend(pieces_of(word))
            out.append(n)
        return np.array(out, np.int32)

    def taken(self) -> np.ndarray:
        """The pieces of the words numbered since the last call."""
        pieces, self.pieces = self.pieces, array("i")
        return np.frombuffer(pieces, np.int32).reshape(-1, PIECES) if pieces else np.zeros((0, PIECES), np.int32)


@dataclass
class Model:
    """The fitted network: a table of embeddings, its last row zero, the filters of each width, and the logistic layer."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @cached_property
    def products(self) -> np.ndarray:
        """For a table row, its product with every filter's every slot."""
        return np.concatenate([self.table @ slot for width in self.filters for slot in width], axis=1)

    def __getstate__(self) -> dict:
        # The products are a dozen times the rest, and soon worked out again.
        return {k: v for k, v in self.__dict__.items() if k != "products"}

    def scorer(self, block: int = 20_000) -> Callable[[list[str | None]], np.ndarray]:
        """A function from texts to scores that remembers the products of words; works in blocks of about ``block`` words."""
        vocabulary, table_ = Vocabulary(), np.zeros((0, self.products.shape[1]), np.float32)

        def score(texts: list[str | None]) -> np.ndarray:
            nonlocal vocabulary, table_
            pooled, held, total = [], [], 0
            for i, text in enumerate(texts):
                held.append(vocabulary.numbers(text))
                total += len(held[-1])
                if total < block and i + 1 < len(texts):
                    continue
                fresh = vocabulary.taken()
                if len(fresh):
                    table_ = np.concatenate((table_, *(self.products[fresh[at : at + 2_000]].mean(axis=1) for at in range(0, len(fresh), 2_000))))
                pooled.append(pool(held, table_) + self.bias)
                held, total = [], 0
                if len(table_) > REMEMBERED:
                    vocabulary, table_ = Vocabulary(), table_[:0]
            if not pooled:
                return np.zeros(0)
            logit = np.maximum(np.concatenate(pooled), 0) @ self.out + self.out_bias
            return 1 / (1 + np.exp(-logit.astype(np.float64)))

        return score


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each followed by no words, as many as the widest filter has; and where each begins."""
    between = np.zeros(max(WIDTHS), np.int32)
    rows = np.concatenate([x for t in texts for x in (t, between)])
    return rows, np.cumsum([0, *(len(t) + len(between) for t in texts[:-1])])


def pool(texts: list[np.ndarray], products: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text; ``products`` by word number."""
    rows, starts = layout(texts)
    ends = np.append(starts[1:], len(rows))
    pooled, column = [], 0
    for width in WIDTHS:
        response = products[rows, column : column + FILTERS]
        for slot in range(1, width):
            column += FILTERS
            response[:-slot] += products[rows[slot:], column : column + FILTERS]
            response[ends - slot] = -np.inf  # it would reach into the next text
        column += FILTERS
        pooled.append(np.maximum.reduceat(response, starts, axis=0))
    return np.concatenate(pooled, axis=1)


def fit(texts: list[np.ndarray], pieces: np.ndarray, labels: np.ndarray, visits: int = VISITS, rate: float = RATE, seed: int = SEED) -> Model:
    """Adam on the logistic loss, until texts have been visited ``visits`` times in all or ``EPOCHS`` times each; the gradient of a maximum goes to
    the words that gave it.

    ``texts`` are word numbers, ``pieces`` has the table rows of each number."""
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    table_[BUCKETS] = 0
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    out_bias = np.array([np.log((share + 1e-3) / (1 - share + 1e-3))], np.float32)
    parameters = [table_, *filters, bias, out, out_bias]
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    step, epochs = 0, min(EPOCHS, -(-visits // max(1, len(texts))))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rows, starts = layout([texts[i] for i in some])
            ends = np.append(starts[1:], len(rows))
            present, local = np.unique(rows, return_inverse=True)
            vectors = table_[pieces[present]].mean(axis=1)
            embedded = vectors[local]
            tops, winners = [], []
            for w, width in enumerate(WIDTHS):
                parts = [vectors @ filters[w][slot] for slot in range(width)]
                response = parts[0][local]
                for slot in range(1, width):
                    response[:-slot] += parts[slot][local[slot:]]
                    response[ends - slot] = -np.inf
                winner = np.stack([response[a:b].argmax(axis=0) + a for a, b in zip(starts, ends)])
                tops.append(np.take_along_axis(response, winner, axis=0))
                winners.append(winner)
            hidden = np.concatenate(tops, axis=1) + bias
            active = np.maximum(hidden, 0)
            score = 1 / (1 + np.exp(-(active @ out + out_bias)))
            gap = (score - labels[some]).astype(np.float32) / len(some)
            back = (gap[:, None] * out) * (hidden > 0)
            grads, words, pulls = [], [], []
            for w, width in enumerate(WIDTHS):
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                grad = np.zeros_like(filters[w])
                for slot in range(width):
                    place = np.minimum(winners[w] + slot, len(rows) - 1)
                    grad[slot] = np.einsum("nfd,nf->df", embedded[place], g)
                    words.append(rows[place].ravel())
                    pulls.append((g[:, :, None] * filters[w][slot].T[None]).reshape(-1, DIM))
                grads.append(grad + DECAY * filters[w])
            grads += [back.sum(axis=0), active.T @ gap + DECAY * out, gap.sum(keepdims=True)]
            step += 1
            # Each piece of a word gets its share of the word's gradient.
            of_word = pieces[np.concatenate(words)]
            touched, inverse = np.unique(of_word, return_inverse=True)
            pulled = DECAY * table_[touched]
            np.add.at(pulled, inverse.ravel(), np.repeat(np.concatenate(pulls) / of_word.shape[1], of_word.shape[1], axis=0))
            pulled[touched == BUCKETS] = 0
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            pace = rate * (1 - epoch / epochs) * fix
            for p, m, v, g, where in [(table_, first[0], second[0], pulled, touched), *((p, m, v, g, slice(None)) for p, m, v, g in zip(parameters[1:], first[1:], second[1:], grads))]:
                m[where] = 0.9 * m[where] + 0.1 * g
                v[where] = 0.999 * v[where] + 0.001 * g * g
                p[where] -= pace * m[where] / (np.sqrt(v[where]) + 1e-7)
    return Model(table_, filters, bias, out, float(out_bias[0]))


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 5) -> dict[str, float]:
    """The threshold of best F1 for each language with at least ``least`` toxic rows, and for all under ''."""

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        s = s[order]
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        # Tied scores fall on one side together.
        last = np.append(s[1:] != s[:-1], True)
        i = int(np.argmax(np.where(last, f1, -1)))
        return float(np.clip((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2, *BOUNDS))

    found = {"": best(scores, labels) if labels.sum() >= least else THRESHOLD}
    of = np.array(langs, object)
    for lang in sorted({x for x in langs if x}):
        mine = of == lang
        if labels[mine].sum() >= least:
            found[lang] = best(scores[mine], labels[mine])
    return found


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learned(ids: list[int], texts: list[str | None], langs: list[str | None], toxic: list[int]) -> Model:
    """The model of a sample; a fifth of it only calibrates the thresholds."""
    vocabulary = Vocabulary()
    numbers = [vocabulary.numbers(t) for t in texts]
    pieces = vocabulary.taken()
    marks = (np.array(toxic) > 0).astype(np.float32)
    fold = np.array([zlib.crc32(b"fold" + str(i).encode()) % 5 == 0 for i in ids])
    if fold.all() or not fold.any():
        fold[:] = False
    learn = np.flatnonzero(~fold)
    model = fit([numbers[i] for i in learn], pieces, marks[learn])
    proof = np.flatnonzero(fold) if fold.any() else learn
    model.thresholds = calibrate(model.scorer()([texts[i] for i in proof]), marks[proof], [langs[i] for i in proof])
    return model


def sample_of(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, lang, toxic) of the rows to learn from."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    # The sample is the ids of smallest hash: a top-k that each task bounds before anything moves.
    place = F.xxhash64("of", F.lit(SEED))
    chosen = marked.orderBy(place, "of").limit(most)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), lang.cast("string").alias("lang")).alias("row"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).groupBy("doc_id", "toxic").agg(F.min("row").alias("row"))
    # At most ``most`` rows are left to order.
    size = F.sum(F.octet_length("row.text")).over(Window.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))
    return found.withColumn("size", size).where((F.col("size") <= most_bytes) | (F.col("size") == F.octet_length("row.text"))).select("doc_id", "row.text", "row.lang", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``most`` labelled rows that aren't held out, in a task of its own; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: r[0])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned(*map(list, zip(*rows))))], pa.binary())], names=["model"])

    found = cut(sample_of(docs, labels, most)).coalesce(1).mapInArrow(trimmed(run), "model binary").collect()
    if found:
        return pickle.loads(found[0].model)
    none = np.zeros(FILTERS * len(WIDTHS), np.float32)
    return Model(np.zeros((BUCKETS + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], none, none, 0.0)


def _scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, as ``text_beside`` has them, with score; texts are read in place."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = text_beside(docs, columns)
    passed = 1 + any(c.lower() == "text" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = sent.value.scorer()
        for batch in batches:
            # A few texts at a time are Python objects.
            found = [scores(batch.column(1).slice(at, TOGETHER).to_pylist()) for at in range(0, batch.num_rows, TOGETHER)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())], names=[*batch.schema.names[:passed], "score"])

    return frame.mapInArrow(trimmed(run), StructType([*frame.schema.fields[:passed], StructField("score", DoubleType())]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) of ``docs`` with ``toxicity``, a score from 0 to 1."""
    wanted = [c for c in (docs.columns if keep is None else keep) if c.lower() != "toxicity"]
    return _scored(docs, model, wanted).select(*beside_text(wanted), F.col("score").alias("toxicity"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold."""
    limits = F.create_map(*(F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair)) if model.thresholds else None
    lang = next((F.col("row").getField(c) for c in docs.columns if c.lower() == "lang"), F.lit(""))
    limit = F.lit(THRESHOLD) if limits is None else F.coalesce(F.try_element_at(limits, F.coalesce(lang.cast("string"), F.lit(""))), F.try_element_at(limits, F.lit("")))
    return _scored(docs, model, docs.columns).where(F.col("score") < limit).select(*beside_text(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted")
    )
