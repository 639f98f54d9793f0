"""Sharding by extendible hashing (DataFrame functions only).

A row's key is the first 60 bits of md5(doc_id).  The directory is indexed by the leading bits of the key; a bucket is
split on its next bit only while it holds more than ``limit`` bytes.  Splits are found without touching the texts: the
bytes are summed per leading ``step`` bits, each sum is rolled up to every shorter prefix, and a bucket is the shortest
prefix that fits.  Cells that are still too large at that depth are counted again with ``step`` more bits, alone.

Cases: a null text has no bytes; a null doc_id is hashed as an empty string, apart from ids by its prefix ``null``.  A
single row over the limit can't be split: it gets a shard of its own.  Rows that share all 60 bits (rows repeated
under one id) and are over the limit together go to a second directory, its shards marked ``+``, by a hash of all their
columns; of rows that are equal throughout, numbered pages hold as many as fit.  Names follow from the rows' values alone.
An empty table gives an empty result.  Extra columns pass through ``shard`` unless they carry a name that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm.common import cut, join_dimension, others, packed, table, unpacked

BITS = 60
#: Bytes of text in a shard.
LIMIT = 1_000_000
STEP = 12


def key_of(doc_id: Column) -> Column:
    """60 hash bits of an id, as a bigint."""
    text = F.coalesce(F.concat(F.lit("id"), doc_id.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def prefix_of(key: Column, depth: int | Column) -> Column:
    return F.call_function("shiftright", key, F.lit(BITS) - depth if isinstance(depth, Column) else F.lit(BITS - depth))


def label_of(prefix: Column, depth: Column) -> Column:
    """The bits of a prefix as text; the root is an empty string."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def directory(keys: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """(key, n_bytes) rows to buckets (depth, prefix, bytes, full).

    Buckets tile the key space.  ``full`` marks buckets at the last bit that are still over the limit.  Sums are combined
    before each shuffle and have at most 2**step rows a cell, whatever the number of documents."""
    found: DataFrame | None = None
    rest, top = keys, 0
    while True:
        bottom = min(top + step, BITS)
        cells = cut(rest.groupBy(prefix_of(F.col("key"), bottom).alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        # Each cell is rolled up to all its ancestors down to the depth where this round began.
        above = F.sequence(F.lit(top), F.lit(bottom))
        nodes = (
            cells.select("cell", "bytes", F.explode(above).alias("depth"))
            .groupBy("depth", F.call_function("shiftright", "cell", F.lit(bottom) - F.col("depth")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"), F.col("bytes").alias("parent_bytes"))
        # Below the first round, the node at the top is known to be over the limit.
        known = nodes.join(parent, ["depth", "prefix"], "left").withColumn("parent_bytes", F.coalesce("parent_bytes", F.lit(0)))
        fits = (F.col("bytes") <= limit) & ((F.col("parent_bytes") > limit) | (F.col("depth") == 0))
        done = cut(known.where(fits | ((F.col("depth") == bottom) & (F.col("bytes") > limit))).select("depth", "prefix", "bytes"))
        if bottom == BITS:
            done = done.withColumn("full", F.col("bytes") > limit)
            return done if found is None else found.unionByName(done)
        small = done.where(F.col("bytes") <= limit).withColumn("full", F.lit(False))
        found = small if found is None else found.unionByName(small)
        large = done.where(F.col("bytes") > limit).select(F.col("prefix").alias("cell"))
        if large.isEmpty():
            return found
        rest = rest.join(large, prefix_of(F.col("key"), bottom) == F.col("cell"), "left_semi")
        top = bottom


ADDED = ("n_bytes", "shard", "shard_depth", "shard_bytes")


def placed(keys: DataFrame, limit: int, step: int) -> tuple[DataFrame, bool]:
    """(key, n_bytes) rows to (key, depth, prefix, bytes, full), the bucket of each distinct key; and whether any is full."""
    buckets = cut(directory(keys, limit, step))
    # The depths in use are at most 61 numbers; a key meets the directory by its prefix at each of them.
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())
    at = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix_of(F.col("key"), d).alias("prefix")) for d in depths or [0])))
    found = keys.select("key").distinct().select("key", at.alias("at")).select("key", "at.depth", "at.prefix").join(buckets, ["depth", "prefix"])
    return found, not buckets.where("full").isEmpty()


def _numbered(equal: DataFrame, limit: int) -> DataFrame:
    """(row, n_bytes, label, depth, page, bytes): materialised rows that all their hash bits don't part, in pages within the limit.

    Such rows are the same in every column, so it doesn't matter which of them is on which page, and pages of a fixed number
    of rows come out alike whatever task holds them.  Rows are counted by task, and numbered on from the tasks before."""
    dealt = cut(equal.withColumn("task", F.spark_partition_id()))
    sizes = dealt.groupBy("key", "task").agg(F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy("key")
    sizes = sizes.select("key", "task", before.alias("before"), F.sum("n").over(every).alias("total"), F.max("most").over(every).alias("each"))
    nth = F.row_number().over(Window.partitionBy("key", "task").orderBy("n_bytes"))
    met = dealt.withColumn("nth", nth).join(sizes, ["key", "task"])
    held = F.greatest(F.floor(F.lit(limit) / F.greatest("each", F.lit(1))), F.lit(1))
    met = met.withColumn("held", held).withColumn("page", F.floor((F.col("before") + F.col("nth") - 1) / F.col("held")))
    bytes_ = F.least(F.col("held"), F.col("total") - F.col("page") * F.col("held")) * F.col("each")
    return met.select("row", "n_bytes", "label", "depth", "page", bytes_.alias("bytes"))


def shard(docs: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """``docs`` with n_bytes, shard (bits, with a page where a bucket overflows), shard_depth and shard_bytes."""
    kept = others(docs, ADDED)
    sized = packed(docs, key=key_of(F.col("doc_id")), n_bytes=F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    label = label_of(F.col("prefix"), F.col("depth"))

    def out(frame: DataFrame, name: Column) -> DataFrame:
        return unpacked(frame, kept, n_bytes=F.col("n_bytes"), shard=name, shard_depth=F.col("depth").cast("int"), shard_bytes=F.col("bytes").cast("bigint"))

    # The mapping is worked out on keys alone, one row for each, and then meets the rows; texts are never repeated.
    buckets, overflows = placed(sized.select("key", "n_bytes"), limit, step)
    met = sized.join(buckets, "key")
    found = out(met.where(~F.col("full")), label)
    if not overflows:
        return found
    # What one id has over the limit: a single row is a shard, more rows go to a second directory by a hash of all they hold.
    whole = F.conv(F.substring(F.md5(F.col("row").cast("string")), 1, BITS // 4), 16, 10).cast("bigint")
    over = cut(met.where("full").withColumn("whole", whole))
    counts = cut(over.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("n")))
    over = join_dimension(over, counts, "key", "of")
    crowd = over.where("n > 1").select("row", "n_bytes", F.col("whole").alias("key"))
    buckets, equal = placed(crowd.select("key", "n_bytes"), limit, step)
    inner = crowd.join(buckets, "key").withColumn("label", F.concat(F.lit("+"), label))
    found = found.unionByName(out(over.where("n = 1"), label)).unionByName(out(inner.where(~F.col("full")), F.col("label")))
    if not equal:
        return found
    pages = _numbered(inner.where("full").select("row", "n_bytes", "key", "label", "depth"), limit)
    return found.unionByName(out(pages, F.concat(F.col("label"), F.lit("."), F.col("page").cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes")


ORACLE_SQL = f"""
WITH keys AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
  ('0x' || substr(md5(coalesce('id' || doc_id::VARCHAR, 'null')), 1, {BITS // 4}))::BIGINT AS key FROM documents),
cells AS (SELECT key >> {BITS - 2 * STEP} AS cell, sum(n_bytes)::BIGINT AS bytes FROM keys GROUP BY 1),
nodes AS (SELECT depth, cell >> ({2 * STEP} - depth) AS prefix, sum(bytes)::BIGINT AS bytes FROM cells, (SELECT unnest(range({2 * STEP + 1}))::INTEGER AS depth) GROUP BY 1, 2),
buckets AS (SELECT n.depth, n.prefix, n.bytes FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix >> 1
  WHERE n.bytes <= {LIMIT} AND (n.depth = 0 OR p.bytes > {LIMIT}))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END AS shard, depth AS shard_depth, bytes AS shard_bytes
FROM keys JOIN buckets ON key >> ({BITS} - depth) = prefix
"""
