"""Source plans as projections over a table of topics.

Topics come as rows (topic_ord, topic, depth, focus, time_range, max_documents); a run has one, a sweep has many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import constants as C
from evigraph.functions import text as T

TOPIC = "topic_ord bigint, topic string, depth string, focus string, time_range string, max_documents int"
QUERIES, ASKED = 8, 10


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def is_research(topic: Column) -> Column:
    """Some key word is in the lower-cased topic; key words in capitals never are."""
    return F.exists(_words(C.RESEARCH_KEYWORDS), lambda word: F.contains(F.lower(topic), word))


def is_code(topic: Column) -> Column:
    return F.exists(_words(C.CODE_WORDS), lambda word: F.contains(F.lower(topic), word))


def key_words(topic: Column) -> Column:
    split = F.split(F.translate(F.lower(topic), ",", " "), r"(?U)\s+")
    return F.filter(split, lambda w: (F.length(w) > 2) & ~F.array_contains(_words(C.FILLERS), w))


def topic_queries(topics: DataFrame, most: int = QUERIES) -> DataFrame:
    """(topic_ord, place, query): the topic, neighbouring key words, its surveys and reviews; the first of equal ones, ``most`` in all."""
    words = key_words(F.col("topic"))
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    neighbours = F.zip_with(F.slice("words", 1, rest), F.slice("words", 2, rest), lambda a, b: F.concat_ws(" ", a, b))
    said = F.concat(F.array("topic"), neighbours, F.array(*(F.concat_ws(" ", "topic", F.lit(e)) for e in C.ENDINGS)))
    asked = topics.withColumn("words", words).select("topic_ord", F.posexplode(said).alias("at", "said"))
    asked = asked.withColumn("query", T.strip(F.col("said"))).where("query <> ''")
    firsts = asked.groupBy("topic_ord", F.lower("query").alias("folded")).agg(F.min(F.struct("at", "query")).alias("first"))
    place = F.row_number().over(Window.partitionBy("topic_ord").orderBy("first.at"))
    return firsts.select("topic_ord", place.alias("place"), F.col("first.query").alias("query")).where(F.col("place") <= most)


def years_of(time_range: Column) -> Column:
    """A range split at its first hyphen; null without one."""
    parts = F.split(time_range, "-", 2)
    return F.when(F.contains(time_range, F.lit("-")), F.struct(T.strip(parts[0]).alias("first"), T.strip(parts[1]).alias("last")))


def source_plans(topics: DataFrame) -> DataFrame:
    """``topics`` with documents, connectors, queries, per_connector_limit, expansion_budget and years."""
    own = topic_queries(topics).groupBy(F.col("topic_ord").alias("of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "query"))), lambda x: x["query"]).alias("own"))
    wanted = F.when(F.col("focus").isin("drift", "all"), _words(C.ALWAYS_ASKED + C.DRIFT_ASKED)).otherwise(_words(C.ALWAYS_ASKED))
    extra = F.transform(wanted, lambda w: F.concat_ws(" ", "topic", w))
    fresh = F.filter(extra, lambda q: ~F.exists("own", lambda o: F.lower(o) == F.lower(q)))
    depth = F.create_map(*(F.lit(x) for pair in C.DEPTHS.items() for x in pair))
    plain = [c for c in C.CONNECTOR_KEYS if c != "github"]
    coded = [c for c in C.CONNECTOR_KEYS]
    planned = topics.join(own, F.col("topic_ord") == F.col("of"), "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    planned = planned.withColumns({"documents": F.coalesce(F.try_element_at(depth, F.col("depth")), F.col("max_documents")), "connectors": F.when(is_code(F.col("topic")), _words(tuple(coded))).otherwise(_words(tuple(plain)))})
    return planned.select(
        *topics.columns,
        "documents",
        "connectors",
        F.slice(F.concat("own", fresh), 1, ASKED).alias("queries"),
        F.greatest(F.lit(10), F.floor(F.col("documents") / F.size("connectors"))).cast("int").alias("per_connector_limit"),
        F.greatest(F.lit(20), F.floor(F.col("documents") / 3)).cast("int").alias("expansion_budget"),
        years_of(F.col("time_range")).alias("years"),
    )


def plan(spark: SparkSession, topic: str, depth: str = "standard", focus: str = "all", time_range: str | None = None, max_documents: int = 100) -> Row:
    """The plan of one topic."""
    return source_plans(spark.createDataFrame([(0, topic, depth, focus, time_range, max_documents)], TOPIC)).first()


def connectors_for(keys: dict[str, str]) -> tuple[str, ...]:
    """The connectors that a run may ask: those that need no key, and those whose key is there."""
    return tuple(name for name, key in C.CONNECTOR_KEYS.items() if key is None or keys.get(key))
