"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source is due ``target / source_size`` copies, at most 3.  Whole copies are given outright; the
fraction is rounded by a pivotal method that keeps words: two documents exchange probability in inverse proportion to
their sizes until one of them is 0 or 1, so the source's expected words never change.  Documents meet in blocks of
about ``BLOCK``; what a block leaves undecided, one document at most, goes on to the next level of the tree, where blocks
hold ``BLOCK`` times as many sources' documents, until one is left per source.  That one is rounded by its own
probability.  So a source misses its target by less than one document.  All draws come from md5 of the document's id
and level; reruns agree.

Cases: a null text has size 0, and such documents are taken 0 times.  A null source is a source of its own, last in
order.  Rows that repeat (doc_id, source, size) form one entry whose copies are dealt to its rows as evenly as can be.
An empty table gives an empty result.  Extra columns pass through ``mix`` whatever their names, and through ``take_copies``
unless they carry one of the names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm.common import cut, join_dimension, others, packed, shards_for, table, unpacked

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
TINY = 1e-9
#: Undecided entries that a task settles, about, if that gives more tasks than there are cores.
SETTLED = 100_000


def size_of(text: Column) -> Column:
    """Number of words, runs of other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows to (source, source_size, target).

    Water-filling: with sources ordered by the level at which they reach their limit, ``most * size / weight``, the
    common level is found from running sums.  One row a source remains here; sources, not documents, are ordered."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = totals.withColumn("weight", weight).withColumn("fills", F.col("source_size") * most / F.col("weight"))
    by_level = Window.orderBy("fills", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.sum(F.col("source_size") * most).over(by_level.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(capped, F.lit(0))) / left)
    # The first source that its level does not fill sets the level for all after it.
    levels = levels.withColumn("place", F.row_number().over(by_level))
    common = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("place", "level"))).over(everything)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("weight") * F.col("common.level"), F.col("source_size") * F.lit(float(most))))
    return levels.withColumn("common", common).select("source", "source_size", target.alias("target"))


def _draw(level: int, *cols: str) -> Column:
    """A uniform number in [0, 1) from an entry's identity."""
    key = F.concat_ws("|", F.lit(f"pivot{level}"), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(16**12)


ITEM = "struct<doc_id:{id},size:bigint,p:double,u:double>"


def _duel(a: Column, b: Column) -> Column:
    """Two undecided entries to (winner still undecided or not, the other decided), words kept."""
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    rises = b["u"] * (up + down) < down
    words = F.when(rises, up).otherwise(-down)

    def snapped(p: Column) -> Column:
        return F.when(p < TINY, F.lit(0.0)).when(p > 1 - TINY, F.lit(1.0)).otherwise(p)

    return F.struct(
        F.struct(a["doc_id"].alias("doc_id"), a["size"].alias("size"), snapped(a["p"] + words / a["size"]).alias("p"), a["u"].alias("u")).alias("x"),
        F.struct(b["doc_id"].alias("doc_id"), b["size"].alias("size"), snapped(b["p"] - words / b["size"]).alias("p"), b["u"].alias("u")).alias("y"),
    )


def _settle(items: Column, item_type: str) -> Column:
    """Fold a block: the entry that is still undecided is carried along, decided ones are put aside."""
    none, empty = F.lit(None).cast(item_type), F.array().cast(f"array<{item_type}>")

    def step(state: Column, item: Column) -> Column:
        pair = _duel(state["open"], item)
        undecided = lambda e: (e["p"] > 0) & (e["p"] < 1)
        # Of a pair, at least one is decided; the other, decided or not, is looked at again.
        after = F.transform(
            F.array(pair),
            lambda d: F.struct(
                F.when(undecided(d["x"]), d["x"]).when(undecided(d["y"]), d["y"]).cast(item_type).alias("open"),
                F.concat(state["done"], F.filter(F.array(d["x"], d["y"]), lambda e: ~undecided(e))).cast(f"array<{item_type}>").alias("done"),
            ),
        )
        return F.when(state["open"].isNull(), F.struct(item.cast(item_type).alias("open"), state["done"].alias("done"))).otherwise(F.element_at(after, 1))

    return F.aggregate(items, F.struct(none.alias("open"), empty.alias("done")), step)


def round_entries(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, p) with 0 < p < 1 and size > 0 to the same rows with p 0 or 1, by a reduction tree.

    Blocks are dealt by a hash of the entry, in numbers that follow the source's rows, so a source with a third of all
    rows has as many more blocks.  Each level leaves one entry a block.  A level's tables have no more tasks than their rows
    need: each task writes a file, and on a local file system Hadoop starts processes for each to set its permissions."""
    cores = entries.sparkSession.sparkContext.defaultParallelism
    id_type = entries.schema["doc_id"].dataType.simpleString()
    item_type = ITEM.format(id=id_type)
    done: DataFrame | None = None
    level, open_ = 0, entries.select("doc_id", "source", "size", "p")
    while True:
        counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), F.ceil(F.col("n") / block).alias("blocks"))
        counts = cut(counts.coalesce(cores))
        most, total = counts.agg(F.max("blocks"), F.sum("blocks")).first()
        if most is None:
            return open_ if done is None else done
        spread = F.pmod(F.xxhash64(F.lit(level), "doc_id", "size"), F.col("blocks"))
        dealt = join_dimension(open_, counts, "source", "s").withColumn("block", spread)
        item = F.struct(F.col("doc_id"), F.col("size"), F.col("p"), _draw(level, "doc_id", "source", "size").alias("u")).cast(item_type)
        blocks = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
        settled = cut(blocks.select("source", _settle(F.col("items"), item_type).alias("state")).coalesce(shards_for(total * block, SETTLED, cores)))
        closed = settled.select("source", F.inline("state.done")).select("doc_id", "source", "size", "p")
        done = closed if done is None else done.unionByName(closed)
        rest = settled.where(F.col("state.open").isNotNull()).select(F.col("state.open.doc_id").alias("doc_id"), "source", F.col("state.open.size").alias("size"), F.col("state.open.p").alias("p"))
        if most <= 1:
            last = rest.withColumn("p", F.when(_draw(-1, "doc_id", "source", "size") < F.col("p"), 1.0).otherwise(0.0))
            return done.unionByName(last)
        level, open_ = level + 1, rest


def allot(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size) rows to one row per distinct entry: n rows, copies for all of them, source_size, target."""
    entries = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(entries.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    targets = cut(targets.withColumnRenamed("source", "s"))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n")
    due = join_dimension(entries, targets, "source", "s").withColumn("due", F.when(F.col("size") > 0, due).otherwise(F.lit(0.0)))
    due = due.withColumn("whole", F.floor(F.col("due") + TINY)).withColumn("p", F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)))
    decided = round_entries(due.where(F.col("p") > TINY).select("doc_id", "source", "size", "p"), block)
    decided = decided.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("p").alias("extra"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("bigint")
    return due.join(decided, same, "left").select("doc_id", "source", "size", "n", "source_size", "target", copies.alias("copies"))


ADDED = ("size", "source_size", "target", "copies")


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """(row, size, source_size, target, copies) for each row of ``docs``; row is a struct of its columns."""
    base = packed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=size_of(F.col("text")))
    text = F.col("row").getField(next(c for c in docs.columns if c.lower() == "text"))
    shares = allot(base.select("doc_id", "source", "size"), weights, most, block)
    shares = shares.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", F.col("copies").alias("all"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    met = base.join(shares, same)
    columns = ["row", *ADDED]
    single = met.where("n = 1").withColumn("copies", F.col("all"))
    # Repeated rows: the first of them, in the order of their texts' hashes, take one copy more than the rest.
    place = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64(text)))
    repeated = met.where("n > 1").withColumn("copies", F.floor(F.col("all") / F.col("n")) + F.when(place <= F.col("all") % F.col("n"), 1).otherwise(0))
    return single.select(*columns).unionByName(repeated.select(*columns))


def take_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``most``) for each row."""
    return unpacked(_taken(docs, weights, most, block), others(docs, ADDED), **{c: F.col(c) for c in ADDED})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, columns as they are."""
    taken = _taken(docs, weights, most, block).where("copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    shares = allot(sized)
    base, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    rows = shares.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("row"))
    return rows.select("doc_id", "size", "source_size", "target", ((base + F.when(F.col("row") <= extra, 1).otherwise(0)) * F.col("size")).cast("bigint").alias("taken"))
