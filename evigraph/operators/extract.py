"""Extraction answers to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import constants as C
from evigraph.functions import text as T
from evigraph.sources.schemas import RESPONSE, VERDICT


def _elements(text: Column) -> Column:
    """The objects of a JSON array, as text; null where the array can't be read."""
    return F.filter(F.from_json(text, "array<string>"), lambda x: F.startswith(F.ltrim(x), F.lit("{")))


def with_payload(frame: DataFrame, raw: str = "raw") -> DataFrame:
    """``frame`` with ``payload``, the objects (as text) of a model's answer: an array, or one object.

    Fences are stripped.  Of an answer that is neither, what stands between its outermost brackets or braces is read, whichever
    open first; null where that fails too."""
    bare = frame.withColumn("__bare", T.stripped_fences(F.col(raw)))
    opens = F.regexp_extract("__bare", r"[\[{]", 0)
    inside = F.when(opens == "[", F.regexp_extract("__bare", r"(?s)(\[.*\])", 1)).when(opens == "{", F.concat(F.lit("["), F.regexp_extract("__bare", r"(?s)(\{.*\})", 1), F.lit("]")))
    is_array, is_object = (F.startswith("__bare", F.lit(x)) for x in "[{")
    whole = F.when(is_array, F.col("__bare")).when(is_object, F.concat(F.lit("["), "__bare", F.lit("]")))
    first = bare.withColumn("__first", _elements(whole))
    # The search runs for answers that couldn't be read as they are.
    return first.withColumn("payload", F.when(F.col("__first").isNotNull(), F.col("__first")).otherwise(_elements(T.missing_as_null(inside)))).drop("__bare", "__first")


def parsed(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """``answers``, one for each document, with ``response``, their first object."""
    return with_payload(answers, raw).withColumn("response", F.from_json(F.try_element_at("payload", F.lit(1)), RESPONSE)).drop("payload")


def refinement(raw: Column) -> Column:
    """A model's verdict on a contradiction: one object, fenced or between other words."""
    bare = T.stripped_fences(raw)
    body = F.when(F.startswith(bare, F.lit("{")), bare).otherwise(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    return F.from_json(body, VERDICT)


def prompts(docs: DataFrame, batches: DataFrame, prefix: str = "") -> DataFrame:
    """(batch, prompt, ords): each batch's documents, numbered, with title and abstract, after ``prefix``."""
    block = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.coalesce(T.missing_as_null(F.col("abstract")), F.lit("(no abstract)")), F.lit("\n"))
    rows = docs.select("doc_ord", block.alias("block")).join(batches, "doc_ord").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("doc_ord", "block"))).alias("rows"))
    numbered = F.transform("rows", lambda r, i: F.concat(F.lit("--- DOCUMENT "), (i + 1).cast("string"), F.lit(" ---\n"), r["block"]))
    return rows.select("batch", F.concat(F.lit(prefix), F.array_join(numbered, "\n")).alias("prompt"), F.transform("rows", lambda r: r["doc_ord"]).alias("ords"))


def answered(asked: DataFrame) -> DataFrame:
    """(doc_ord, response) of (ords, raw) batches: the answer's objects by place; a document without one, or whose batch failed,
    has a response without anything."""
    read = with_payload(asked, "raw")
    nothing = F.from_json(F.lit("{}"), RESPONSE)
    each = read.select(F.posexplode("ords").alias("at", "doc_ord"), "payload")
    response = F.when(F.col("payload").isNotNull(), F.from_json(F.try_element_at("payload", F.col("at") + 1), RESPONSE))
    return each.select("doc_ord", F.coalesce(response, nothing).alias("response"), (response.isNotNull()).alias("answered"))


def node_id(doc: Column, kind: str, place: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", doc.cast("string"), F.lit(kind), place.cast("string")), 256)


def nodes_of(answers: DataFrame) -> DataFrame:
    """(doc_ord, pos, id, node_type, name, description): the document, its assertions, its entities, as they came.

    ``answers``: doc_ord, title, abstract, response.  Without an answer a document gives no nodes."""
    base = answers.where("response is not null")
    doc = base.select("doc_ord", F.lit(0).alias("kind"), F.lit(0).alias("at"), node_id(F.col("doc_ord"), "doc", F.lit(0)).alias("id"), F.lit("source_document").alias("node_type"), F.col("title").alias("name"), F.substring("abstract", 1, 500).alias("description"))
    said = base.select("doc_ord", F.posexplode("response.assertions").alias("at", "x")).withColumn("text", T.strip(F.coalesce("x.text", F.lit("")))).where("text <> ''")
    said = said.select("doc_ord", F.lit(1).alias("kind"), "at", node_id(F.col("doc_ord"), "assertion", F.col("at")).alias("id"), F.lit("assertion").alias("node_type"), F.substring("text", 1, 100).alias("name"), F.col("text").alias("description"))
    named = base.select("doc_ord", F.posexplode("response.entities").alias("at", "x")).withColumn("name", T.strip(F.coalesce("x.name", F.lit("")))).where("name <> ''")
    kind = T.entity_type(F.coalesce("x.entity_type", F.lit("concept")))
    named = named.select("doc_ord", F.lit(2).alias("kind"), "at", node_id(F.col("doc_ord"), "entity", F.col("at")).alias("id"), kind.alias("node_type"), "name", F.coalesce("x.description", F.lit("")).alias("description"))
    return doc.union(said).union(named)


def edges_of(answers: DataFrame, nodes: DataFrame, phrases: tuple[str, ...] = C.FUTURE_WORK, least_name: int = 4) -> DataFrame:
    """(doc_ord, kind, at, src, dst, edge_type): asserts, associated_with, relationships whose two names the document has,
    and recommends from assertions of future work to the entities that they name."""
    doc = nodes.where("kind = 0").select("doc_ord", F.col("id").alias("src"))
    own = nodes.where("kind > 0").join(doc, "doc_ord").select("doc_ord", "kind", "at", "src", F.col("id").alias("dst"), F.when(F.col("kind") == 1, "asserts").otherwise("associated_with").alias("edge_type"))
    # The last node of a name is the one meant.
    of_name = nodes.where("kind > 0").groupBy("doc_ord", "name").agg(F.max_by("id", F.struct("kind", "at")).alias("id"))
    rel = answers.where("response is not null").select("doc_ord", F.posexplode("response.relationships").alias("at", "x"))
    rel = rel.select("doc_ord", "at", T.strip(F.coalesce("x.source_name", F.lit(""))).alias("s"), T.strip(F.coalesce("x.target_name", F.lit(""))).alias("t"), T.edge_type(F.coalesce("x.relationship_type", F.lit("co_occurs"))).alias("edge_type"))
    to = lambda c, out: of_name.select("doc_ord", F.col("name").alias(c), F.col("id").alias(out))
    related = rel.join(to("s", "src"), ["doc_ord", "s"]).join(to("t", "dst"), ["doc_ord", "t"]).select("doc_ord", F.lit(3).alias("kind"), "at", "src", "dst", "edge_type")
    return own.union(related).union(future_work(nodes, phrases, least_name))


def future_work(nodes: DataFrame, phrases: tuple[str, ...] = C.FUTURE_WORK, least_name: int = 4) -> DataFrame:
    marked = nodes.where("kind = 1").where(T.marks_future_work(F.col("description"), phrases)).select("doc_ord", F.col("at").alias("place"), F.col("id").alias("src"), F.lower("description").alias("text"))
    named = nodes.where("kind = 2").where(F.col("node_type").isin("concept", "artifact")).withColumn("name", T.strip(F.col("name")))
    entity = named.where(F.length("name") >= least_name).select("doc_ord", F.col("at").alias("entity"), F.col("id").alias("dst"), F.lower("name").alias("name"))
    # A document's own assertions and entities only, as many as one answer holds.
    met = marked.join(entity, "doc_ord").where(F.contains("text", F.col("name")))
    once = met.groupBy("doc_ord", "src", "dst").agg(F.min(F.struct("place", "entity")).alias("first"))
    at = F.row_number().over(Window.partitionBy("doc_ord").orderBy("first")) - 1
    return once.select("doc_ord", F.lit(4).alias("kind"), at.alias("at"), "src", "dst", F.lit("recommends").alias("edge_type"))
