"""The engine's inputs, derived from the driver's tables; each beside the same view in DuckDB SQL.

The tables have no dates, keys or citations, so these are worked out from ids, alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions.constants import PATTERN_TYPES
from evigraph.operators.patterns import BLIND_SPOT, EVIDENCE
from evigraph.sources.stages import read_table as table


def src_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources.  Titles are whole first lines, abstracts whole texts."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    family = F.element_at(F.array(*map(F.lit, ("scholarly", "code", "web", "social"))), F.substring("source", 4, 10).cast("int") % 4 + 1)
    date = F.date_add(F.lit("2018-01-01").cast("date"), ((F.col("doc_id") * 7) % 2555).cast("int")).cast("string")
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    peer = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("doc_ord"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        family.alias("source_family"),
        line.alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("authors"),
        date.alias("publication_date"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.md5("text")).alias("doi"),
        F.lit(None).cast("string").alias("openalex_id"),
        F.lit(None).cast("string").alias("s2_id"),
        ((F.col("doc_id") * 31) % 997).alias("cited_by_count"),
        peer.alias("is_peer_reviewed"),
    )


SRC_DOCUMENTS = """src AS (SELECT d.doc_id AS doc_ord, 'd' || d.doc_id::VARCHAR AS id,
  CASE substr(d.source, 4)::INTEGER % 4 WHEN 0 THEN 'scholarly' WHEN 1 THEN 'code' WHEN 2 THEN 'web' ELSE 'social' END AS source_family,
  split_part(d.text, chr(10), 1) AS title, d.text AS abstract, CASE WHEN d.doc_id % 4 = 0 THEN [] ELSE [d.source] END AS authors,
  (DATE '2018-01-01' + ((d.doc_id * 7) % 2555)::INTEGER)::VARCHAR AS publication_date,
  CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE md5(d.text) END AS doi, (d.doc_id * 31) % 997 AS cited_by_count,
  coalesce(l.quality, 0) = 1 AND coalesce(l.toxic, 0) = 0 AS is_peer_reviewed
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
tiered AS (SELECT *, CASE WHEN is_peer_reviewed THEN 1 WHEN source_family IN ('scholarly', 'code') THEN 2 WHEN source_family = 'web' THEN 3 ELSE 4 END AS source_tier FROM src)"""


def vec_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as nodes: concepts and artifacts by parity."""
    kind = F.when(F.col("vec_id") % 2 == 0, "concept").otherwise("artifact")
    name = F.concat(F.lit("node "), F.col("vec_id").cast("string"))
    description = F.concat(F.lit("about "), F.repeat(F.lit("x"), (F.col("vec_id") % 7).cast("int")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("node_ord"), kind.alias("node_type"), name.alias("name"), description.alias("description"), "embedding", "label")


VEC_PAIRS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
pairs AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS similarity FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= {least})"""


def vec_edges_of_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, edges) of pairs of vectors: typed edges in the order of their ends, of some pairs both ways."""
    kind = F.element_at(F.array(*map(F.lit, ("co_occurs", "extends", "supports"))), ((F.col("a") + F.col("b")) % 3 + 1).cast("int"))
    edge = lambda ord, src, dst, kind: F.struct(ord.alias("edge_ord"), F.col(src).alias("src"), F.col(dst).alias("dst"), kind.alias("edge_type"))
    number = F.col("a") * 1000000 + F.col("b")
    forth, back = edge(number, "a", "b", kind), edge(number + 10**15, "b", "a", F.lit("involves"))
    return pairs.select("a", "b", F.when((F.col("a") + F.col("b")) % 5 == 0, F.array(forth, back)).otherwise(F.array(forth)).alias("edges"))


def vec_edges(pairs: DataFrame) -> DataFrame:
    """The edges of ``vec_edges_of_pairs``, one by one; pairs are worked out once for both ways."""
    return vec_edges_of_pairs(pairs).select(F.explode("edges").alias("edge")).select("edge.*")


VEC_EDGES = """edges AS (SELECT a * 1000000 + b AS edge_ord, a AS src, b AS dst, CASE (a + b) % 3 WHEN 0 THEN 'co_occurs' WHEN 1 THEN 'extends' ELSE 'supports' END AS edge_type FROM pairs
  UNION ALL SELECT a * 1000000 + b + 1000000000000000, b, a, 'involves' FROM pairs WHERE (a + b) % 5 = 0)"""


def event_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Views and clicks recommend a topic of a day, purchases and sign-ups carry it out; users are the sources."""
    events = table(spark, sf_dir, "events")
    topic = F.concat(F.lit("topic "), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit(" "), F.to_date("ts").cast("string"))
    kind = F.when(F.col("event_type").isin("view", "click"), "recommends").when(F.col("event_type") == "purchase", "produces").when(F.col("event_type") == "signup", "evaluates")
    user = F.col("user_id").cast("string")
    edges = events.select(
        F.col("event_id").alias("edge_ord"), user.alias("src"), topic.alias("dst"), kind.alias("edge_type"), user.alias("source"), F.concat(F.lit("user/"), user).alias("source_url"),
        (F.col("user_id") % 4 + 1).cast("int").alias("source_tier"),
    ).where("edge_type is not null")
    return edges, edges.select(F.col("dst").alias("id"), F.col("dst").alias("name"), F.lit("concept").alias("node_type")).distinct()


def planned_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics out of documents: some words of theirs, some with code or research words, in all depths and focuses."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    words = F.array_join(F.slice(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " "), 1, 6), " ")
    return docs.select(
        F.col("doc_id").alias("topic_ord"), F.concat_ws(" ", words, pick(_TAILS)).alias("topic"), pick(_DEPTHS).alias("depth"), pick(_FOCUSES).alias("focus"), pick(_RANGES).alias("time_range"),
        (F.col("doc_id") % 300).cast("int").alias("max_documents"),
    )


_TAILS = ("", "Framework", "neural Search", "of the SDK", "GPT", "survey", "a, b and model")
_DEPTHS, _FOCUSES, _RANGES = ("quick", "standard", "deep", "other"), ("all", "drift", "gaps", "bridges", "contradictions"), ("2019-2021", "2020", " 2018 - 2019-x")
_pick = lambda values: f"[{', '.join(repr(v) for v in values)}][(doc_id % {len(values)} + 1)::INTEGER]"
TOPICS = f"""topics AS (SELECT doc_id AS topic_ord, concat_ws(' ', array_to_string(string_split(split_part(text, chr(10), 1), ' ')[1:6], ' '), {_pick(_TAILS)}) AS topic,
  {_pick(_DEPTHS)} AS depth, {_pick(_FOCUSES)} AS focus, {_pick(_RANGES)} AS time_range, (doc_id % 300)::INTEGER AS max_documents FROM documents)"""


EVENT_EDGES = """e AS (SELECT event_id AS edge_ord, user_id::VARCHAR AS source, 'topic ' || coalesce(props::JSON ->> '$.k', '') || ' ' || (ts::DATE)::VARCHAR AS dst,
  CASE WHEN event_type IN ('view', 'click') THEN 'recommends' WHEN event_type = 'purchase' THEN 'produces' WHEN event_type = 'signup' THEN 'evaluates' END AS edge_type,
  'user/' || user_id::VARCHAR AS source_url, (user_id % 4 + 1)::INTEGER AS source_tier FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')),
g AS (SELECT dst, count(DISTINCT source) FILTER (edge_type = 'recommends') AS n_sources, count(*) FILTER (edge_type = 'recommends') AS n_recommends,
  count(*) FILTER (edge_type <> 'recommends') AS n_executions FROM e GROUP BY dst),
gap AS (SELECT * FROM g WHERE n_sources >= 2 AND n_executions <= 1)"""


def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of all four types: their lines are evidence, every third one against, of few documents, urls and tiers."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    against = F.col("l_linenumber") % 3 == 0
    doc = F.when(F.col("l_suppkey") % 5 == 0, F.lit("")).otherwise((F.col("l_suppkey") % 5).cast("string"))
    url = F.when(F.col("l_suppkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("s/"), (F.col("l_suppkey") % 4).cast("string")))
    item = F.struct(
        F.concat(key.cast("string"), F.lit("."), F.col("place").cast("string")), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), doc, url, (F.col("l_partkey") % 4 + 1).cast("int"),
        F.when(against, "counters").otherwise("supports"),
    ).cast(EVIDENCE)
    side = lambda wanted: F.transform(F.sort_array(F.collect_list(F.when(wanted, F.struct("place", item.alias("item"))))), lambda x: x["item"])
    whole = lines.withColumn("place", place).groupBy("l_orderkey").agg(side(~against).alias("evidence"), side(against).alias("against"))
    kind = F.element_at(F.array(*map(F.lit, PATTERN_TYPES)), (key % 4 + 1).cast("int"))
    countered = F.when((key % 4 == 1) | (key % 3 == 0), F.col("against")).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    spot = F.struct(F.concat(F.lit("spot "), key.cast("string")), F.lit("minor"), F.lit(None).cast("string")).cast(BLIND_SPOT)
    details = F.create_map(F.lit("gap_node"), F.concat(F.lit("g"), key.cast("string")), F.lit("recommendation_count"), F.size("evidence").cast("string"), F.lit("bridge_node_u"), F.when(key % 8 == 0, F.lit("")).otherwise(F.lit("left")), F.lit("bridge_node_v"), F.lit("right"), F.lit("from_window"), F.lit("2001"), F.lit("to_window"), F.lit("2002"))
    return whole.select(
        key.cast("string").alias("id"), kind.alias("pattern_type"), F.concat(F.lit("Order "), key.cast("string")).alias("title"), F.concat(F.lit("measured "), (key % 10).cast("string")).alias("measured_pattern"),
        "evidence", countered.alias("counter_evidence"), F.when(key % 2 == 0, F.array(spot)).otherwise(F.array().cast(f"array<{BLIND_SPOT}>")).alias("blind_spots"),
        ((key % 10).cast("double") / 10).alias("confidence"), details.alias("details"),
    )


LINE_PATTERNS = """lines AS (SELECT l_orderkey AS k, l_partkey, l_suppkey, l_linenumber % 3 = 0 AS against, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem),
items AS (SELECT k, place, against, k || '.' || place AS node, 'part ' || l_partkey AS said, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE (l_suppkey % 5)::VARCHAR END AS doc,
  CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 's/' || (l_suppkey % 4) END AS url, (l_partkey % 4 + 1)::INTEGER AS tier FROM lines),
shown AS (SELECT * FROM items WHERE NOT against OR k % 4 = 1 OR k % 3 = 0),
sums AS (SELECT k, ['bridge', 'contradiction', 'drift', 'gap'][k % 4 + 1] AS kind, (k % 10) / 10.0::DOUBLE AS confidence, count(*) FILTER (NOT against) AS n, count(*) FILTER (against) AS m,
  count(DISTINCT doc) FILTER (NOT against AND doc <> '') AS docs, coalesce(list(DISTINCT url) FILTER (NOT against), []) AS all_urls, coalesce(list(DISTINCT url) FILTER (NOT against AND url <> ''), []) AS urls,
  coalesce(list(DISTINCT url) FILTER (against AND url <> ''), []) AS against_urls, coalesce(list(DISTINCT tier) FILTER (NOT against), []) AS tiers, coalesce(list(DISTINCT tier) FILTER (against), []) AS against_tiers FROM (SELECT DISTINCT k FROM items) LEFT JOIN shown USING (k) GROUP BY k),
judged AS (SELECT *, concat_ws('; ',
  CASE WHEN kind = 'contradiction' THEN CASE WHEN n = 0 OR m = 0 THEN 'one side has no evidence' WHEN len(urls) = 0 OR len(against_urls) = 0 THEN 'one side has no source url' WHEN list_sort(urls) = list_sort(against_urls) THEN 'both sides have the same sources' END
    WHEN kind = 'drift' THEN CASE WHEN n < 2 THEN 'fewer than 2 evidence items' END
    WHEN kind = 'gap' THEN CASE WHEN n < 2 THEN 'fewer than 2 evidence items' WHEN docs < 2 THEN 'fewer than 2 source documents' END
    ELSE CASE WHEN n < 3 THEN 'fewer than 3 evidence items' END END,
  CASE WHEN NOT (len(CASE WHEN kind = 'contradiction' THEN list_distinct(tiers || against_tiers) ELSE tiers END) >= 2
    OR len(CASE WHEN kind = 'contradiction' THEN list_distinct(urls || against_urls) ELSE urls END) >= CASE WHEN kind = 'bridge' THEN 3 ELSE 2 END) THEN 'too few kinds of sources' END,
  CASE WHEN confidence < 0.4 THEN 'score below 0.4' END) AS why,
  CASE WHEN kind = 'contradiction' THEN CASE WHEN n + m >= 2 AND len(list_distinct(all_urls || against_urls)) >= 2 THEN CASE WHEN len(list_distinct(tiers || against_tiers)) >= 2 AND list_contains(tiers || against_tiers, 1) THEN 'high' ELSE 'medium' END ELSE 'low' END
    WHEN m > 0 AND confidence < 0.6 THEN 'unresolved' WHEN n >= 5 AND len(tiers) >= 2 AND list_contains(tiers, 1) AND m = 0 THEN 'high' WHEN n >= 3 AND (len(tiers) >= 2 OR len(all_urls) >= 3) THEN 'medium' ELSE 'low' END AS level FROM sums),
gate AS (SELECT k, k::VARCHAR AS id, kind, n, m, confidence, CASE WHEN why = '' THEN 'promoted' ELSE 'exploratory' END AS status, nullif(why, '') AS withheld_reason, CASE WHEN why = '' THEN level ELSE 'low' END AS confidence_level FROM judged)"""
