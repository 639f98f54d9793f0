"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` marks it begins with, blanks between them or not.  Runs of lines of one level are passages.  A quoted
passage is normalised (A-Z lower-cased, white space collapsed) and hashed, whole, by line and by sentence, and meets the
unquoted passages, lines and sentences of earlier messages of its conversation by hash; each hash resolves to the latest
earlier message that has it.  Whole passages decide over lines, lines over sentences (which find a quote of a part that
was wrapped anew), then the message that most of them name over others, and the later over the earlier.  A message
replies to the origin of its first resolved passage of the lowest level; without one, to the turn before.  A quote that
begins or ends inside a sentence, and holds no whole line or sentence besides, resolves to nothing.

Messages that reply to the turn before form runs.  The reply order of a conversation is depth-first: a run, then the
branches that leave it, those that leave last first.  ``reply_key``, a number, sorts a conversation's messages in that order.
It is a run's place in a tour of the tree of runs, found by pointer doubling: the number of rounds is the logarithm of
the runs of the longest conversation, however deep they branch.

The latest earlier message is found in two levels, over blocks of turns and inside a block, so a conversation or a line
that holds a third of all rows is dealt over many tasks.  Only conversations with quotes take part in any of this.

``chat`` is ``<|role|>``, the body and ``<|end|>``; a ``<|`` in a body is written ``<||``, and a role has no ``<``, ``|`` or ``>``, so that
no message can forge a turn.

Cases: a null text is empty; messages with a null turn come last, reply to none and are no one's origin; a null conv_id is a
conversation of its own; repeated rows are kept, each; quotes without an origin are removed all the same; an empty table
gives an empty result; extra columns pass through ``link_quotes`` unless they carry a name that it adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph.llm.common import cut, others, packed, table, unpacked

BLOCK = 512
QUOTED = r"(?m)^[ \t]*>"
MARKS = re.compile(r"[ \t]*((?:>[ \t]*)*)")
SENTENCE = re.compile(rb"(?<=[.!?]) ")
#: What a hash is of.
SENTENCES, LINES, PASSAGES = range(3)


def last_before(events: DataFrame, keys: list[str], order: str, value: str, inclusive: bool, block: int = BLOCK) -> DataFrame:
    """``events`` with ``last``: the greatest non-null ``value`` at a smaller ``order`` (or the same one, if inclusive) of the same keys."""
    blocked = events.withColumn("__block", F.floor(F.col(order) / block))
    tops = blocked.groupBy(*keys, "__block").agg(F.max(value).alias("__top"))
    before = tops.withColumn("__before", F.max("__top").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__block"])]
    before = before.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__block"])), "__before")
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = blocked.withColumn("__inside", F.max(value).over(inside)).join(before, same, "left")
    latest = F.greatest("__inside", "__before")
    return joined.withColumn("last", latest).drop("__block", "__inside", "__before", *(f"__k{i}" for i in range(len(keys) + 1)))


def body_of(text: Column) -> Column:
    """A text without its quoted lines."""
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~F.rlike(line, F.lit(r"^[ \t]*>")))
    return F.when(F.rlike(text, F.lit(QUOTED)), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(text)


def normalised(text: str) -> bytes:
    """A-Z lower-cased, white space collapsed."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def passages(text: str) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of lines of one quote level: the level, and the normalised lines that aren't blank."""
    before, lines = None, []
    for line in text.split("\n"):
        marks = MARKS.match(line)
        level = marks[1].count(">")
        if level != before:
            if lines:
                yield before, lines
            before, lines = level, []
        words = normalised(line[marks.end() :] if level else line)
        if words:
            lines.append(words)
    if lines:
        yield before, lines


def quote_hashes(messages: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, kind, hash) of each passage, its lines and its sentences; ``messages`` has conv, turn, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for number, (level, lines) in enumerate(passages(text)):
                    whole = b" ".join(lines)
                    for kind, parts in ((PASSAGES, [whole]), (LINES, lines), (SENTENCES, SENTENCE.split(whole))):
                        found += [(row, number, level, kind, hashlib.sha256(part).hexdigest()) for part in parts]
            rows, numbers, levels, kinds, hashes = zip(*found) if found else [()] * 5
            own = batch.take(pa.array(rows, pa.int64()))
            made = [pa.array(numbers, pa.int32()), pa.array(levels, pa.int32()), pa.array(kinds, pa.int32()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([*own.columns[:2], *made], names=["conv", "turn", "passage", "level", "kind", "hash"])

    narrow = messages.select("conv", "turn", "text")
    schema = StructType(narrow.schema.fields[:2]).add("passage", "integer").add("level", "integer").add("kind", "integer").add("hash", "string")
    return narrow.mapInArrow(run, schema)


def quote_origins(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to) of messages that quote an earlier one; ``messages`` has conv, turn, text of whole conversations."""
    keys = quote_hashes(messages).withColumn("origin", F.when(F.col("level") == 0, F.col("turn")))
    quoted = last_before(keys, ["conv", "kind", "hash"], "turn", "origin", inclusive=False).where("level > 0 and last is not null")
    votes = quoted.groupBy("conv", "turn", "passage", "level", "kind", "last").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("conv", "turn", "passage", "level").agg(F.max_by("last", F.struct("kind", "votes", "last")).alias("origin"))
    return best.groupBy("conv", "turn").agg(F.min_by("origin", F.struct("level", "passage")).alias("reply_to"))


def runs_of(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, turn, reply_to, run) of each turn, and the runs: (conv, run, above, left, size), with the run and the turn that
    they leave, null for those that reply to none.  ``messages`` has conv, turn and the reply_to of quotes."""
    turns = messages.groupBy("conv", "turn").agg(F.max("reply_to").alias("quoted"))
    previous = turns.select(F.col("conv").alias("c"), (F.col("turn") + 1).alias("t"), F.lit(True).alias("follows"))
    met = turns.join(previous, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")
    reply = F.coalesce("quoted", F.when(F.col("follows"), F.col("turn") - 1))
    met = met.select("conv", "turn", reply.alias("reply_to"))
    head = F.when(F.col("reply_to").isNull() | (F.col("reply_to") != F.col("turn") - 1), F.col("turn"))
    # The run of a message is the latest head at or before it; so is that of the message that a head replies to.
    inside = cut(last_before(met.withColumn("head", head), ["conv"], "turn", "head", inclusive=True).select("conv", "turn", "reply_to", "head", F.col("last").alias("run")))
    at = inside.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("run").alias("above"))
    heads = inside.where("head is not null").join(at, F.col("conv").eqNullSafe(F.col("c")) & (F.col("reply_to") == F.col("t")), "left")
    sizes = inside.groupBy(F.col("conv").alias("c"), F.col("run").alias("r")).agg(F.count(F.lit(1)).alias("size"))
    runs = heads.select("conv", F.col("head").alias("run"), "above", F.when(F.col("above").isNotNull(), F.col("reply_to")).alias("left"))
    runs = runs.join(sizes, F.col("conv").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).drop("c", "r")
    return inside.select("conv", "turn", "reply_to", "run"), runs


def tour_of(runs: DataFrame) -> DataFrame:
    """(conv, at, out, to, to_out, rest): each run's entry and exit in a depth-first tour, what comes next, and the turns that
    are entered there.  Of the runs that leave one, those that leave last come first, and of equal ones the earlier."""
    # The next run that leaves at the same turn; after the last of them, the first that leaves the run earlier.
    behind = last_before(runs.withColumn("minus", -F.col("run")), ["conv", "above", "left"], "minus", "minus", inclusive=False).select("conv", "run", "above", "left", "size", (-F.col("last")).alias("twin"))
    places = runs.where("above is not null").groupBy("conv", "above", "left").agg(F.min("run").alias("first"))
    earlier = last_before(places, ["conv", "above"], "left", "left", inclusive=False).select("conv", "above", "left", F.col("last").alias("before"))
    of = lambda frame, names: frame.select(*(F.col(c).alias(f"{c}_{names}") for c in frame.columns))
    step = of(places, "p")
    earlier = earlier.join(step, F.col("conv").eqNullSafe(F.col("conv_p")) & (F.col("above") == F.col("above_p")) & (F.col("before") == F.col("left_p"))).select("conv", "above", "left", F.col("first_p").alias("aunt"))
    step = of(earlier, "e")
    met = behind.join(step, F.col("conv").eqNullSafe(F.col("conv_e")) & (F.col("above") == F.col("above_e")) & (F.col("left") == F.col("left_e")), "left")
    met = met.select("conv", "run", "above", "size", F.coalesce("twin", "aunt_e").alias("next"))
    child = places.groupBy(F.col("conv").alias("c"), F.col("above").alias("a")).agg(F.max_by("first", "left").alias("child"))
    met = met.join(child, F.col("conv").eqNullSafe(F.col("c")) & (F.col("run") == F.col("a")), "left")
    enter = met.select("conv", F.col("run").alias("at"), F.lit(False).alias("out"), F.coalesce("child", "run").alias("to"), F.col("child").isNull().alias("to_out"), F.col("size").alias("rest"))
    leave = met.select("conv", F.col("run").alias("at"), F.lit(True).alias("out"), F.coalesce("next", "above").alias("to"), F.col("next").isNull().alias("to_out"), F.lit(0).cast("bigint").alias("rest"))
    return enter.union(leave)


def reply_order(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, place): ``messages`` has conv, turn and the reply_to of quotes; place counts the turns before in
    reply order."""
    inside, runs = runs_of(messages)
    tour = cut(tour_of(cut(runs)))
    # Each round a stop looks twice as far ahead; rest sums what is entered from it on, up to there.
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select(F.col("conv").alias("c"), F.col("at").alias("a"), F.col("out").alias("o"), F.col("to").alias("far"), F.col("to_out").alias("far_out"), F.col("rest").alias("more"))
        met = tour.join(ahead, F.col("conv").eqNullSafe(F.col("c")) & (F.col("to") == F.col("a")) & (F.col("to_out") == F.col("o")), "left")
        tour = cut(met.select("conv", "at", "out", F.col("far").alias("to"), F.col("far_out").alias("to_out"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")))
    total = tour.groupBy(F.col("conv").alias("c")).agg(F.max("rest").alias("total"))
    starts = tour.where(~F.col("out")).join(total, F.col("conv").eqNullSafe(F.col("c"))).select(F.col("conv").alias("cc"), F.col("at").alias("aa"), (F.col("total") - F.col("rest")).alias("start"))
    placed = inside.join(starts, F.col("conv").eqNullSafe(F.col("cc")) & (F.col("run") == F.col("aa")))
    return placed.select("conv", "turn", "reply_to", (F.col("start") + F.col("turn") - F.col("run")).alias("place"))


ADDED = ("body", "reply_to", "reply_key", "chat")


def link_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with body, reply_to, reply_key and chat."""
    kept = others(messages, ADDED)
    base = packed(messages, conv=F.col("conv_id"), turn=F.col("turn").cast("bigint"), role=F.col("role"), text=F.coalesce("text", F.lit("")))
    narrow = base.select("conv", "turn", "text").where("turn is not null")
    quoting = cut(narrow.where(F.rlike("text", F.lit(QUOTED))).select(F.col("conv").alias("c")).distinct())
    is_quoting = F.col("conv").eqNullSafe(F.col("c"))

    def out(frame: DataFrame, reply_to: Column, reply_key: Column) -> DataFrame:
        frame = frame.withColumn("body", body_of(F.col("text")))
        role = F.regexp_replace(F.coalesce("role", F.lit("user")), "[<|>]", "")
        chat = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(F.col("body"), F.lit("<|"), F.lit("<||")), F.lit("\n<|end|>\n"))
        return unpacked(frame, kept, body=F.col("body"), reply_to=reply_to, reply_key=reply_key, chat=chat)

    # Without quotes a turn answers the one before, where there is one, and turns are in order.
    present = narrow.select("conv", "turn").distinct().select(F.col("conv").alias("pc"), (F.col("turn") + 1).alias("pt"))
    plain = base.join(quoting, is_quoting, "left_anti").join(present, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("turn") == F.col("pt")), "left")
    found = out(plain, F.when(F.col("pt").isNotNull(), F.col("pt") - 1), F.col("turn"))
    if quoting.isEmpty():
        return found
    whole = cut(narrow.join(quoting, is_quoting, "left_semi"))
    origins = quote_origins(whole).select(F.col("conv").alias("oc"), F.col("turn").alias("ot"), "reply_to")
    order = reply_order(whole.join(origins, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("turn") == F.col("ot")), "left").select("conv", "turn", "reply_to"))
    order = order.select(F.col("conv").alias("oc"), F.col("turn").alias("ot"), "reply_to", "place")
    linked = base.join(quoting, is_quoting, "left_semi").join(order, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("turn") == F.col("ot")), "left")
    return found.unionByName(out(linked, F.col("reply_to"), F.col("place")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "reply_to", "reply_key", "body", "chat")
