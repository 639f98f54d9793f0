"""A whole run: documents to judged patterns and reports, in stages that can be resumed.

Each stage is written to the run's folder and read again, so a later stage starts from a table and not from a long plan.
A stage that fails is recorded, and what stood before it goes on."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.functions import constants as C
from evigraph.functions import models, planning
from evigraph.functions import text as T
from evigraph.functions.packs import PACKS, DomainPack
from evigraph.operators import community, corpus, extract, graph, patterns, report, verify
from evigraph.sources.stages import read_stages, write_stage

GRAPH_STAGES = ("documents", "nodes", "edges")
#: Tables that a run leaves behind, in order, for a look at each step.
NUMBERED = ("01_documents", "02_corpus_stats", "03_coverage", "04_extraction", "05_graph_stats", "06_candidates", "07_evidence_table", "07_patterns_summary")


@dataclass
class Run:
    """``documents`` need doc_ord, title, abstract and the columns that dedup and tiers use; answers come with them, as ``raw``, or
    ``ask`` gives them, a function from a prompt to a model's answer."""

    spark: SparkSession
    folder: str
    topic: str = ""
    topic_vector: list[float] = field(default_factory=list)
    max_documents: int = 100
    focus: tuple[str, ...] = C.PATTERN_TYPES
    #: Types whose matching names lead to one node; assertions among them may merge with their short negations.
    resolve_types: tuple[str, ...] = tuple(t for t in C.NODE_TYPES if t != "source_document")
    resume: bool = True
    #: Look for patterns anew where a resumed run has its candidates.
    remine: bool = False
    pack: DomainPack = PACKS["research"]
    ask: Callable[[str], str] = models.sentence_extractor
    #: Documents that cite some others, from the most cited ones; none are looked for without it.
    expand: Callable[[DataFrame], DataFrame] | None = None
    expansion_budget: int = 50
    embed: Callable[[Column], Column] = models.hashed_embedding
    scorer: Callable[[Column, Column], Column] = models.negation_scorer
    #: A second look at contradictions: a struct as ``schemas.VERDICT`` has it.
    verdict: Callable[[], Column] | None = None
    thresholds: dict[str, float] = field(default_factory=lambda: {"merge": C.MERGE_COSINE, "pair": C.PAIR_COSINE, "duplicate": C.DUPLICATE_COSINE, "relevance": C.RELEVANCE})
    errors: list[tuple[str, str]] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)

    def attempt(self, step: str, work: Callable[[], DataFrame], before: DataFrame | None) -> DataFrame | None:
        """The step's table, or what stood before it; Spark's errors come when the table is written."""
        began = time.monotonic()
        try:
            return write_stage(work(), self.folder, step)
        except (PySparkException, ValueError) as e:
            self.errors.append((step, str(e)[:4000]))
            return before
        finally:
            self.seconds[step] = round(time.monotonic() - began, 1)

    # Documents

    def _relevant(self, docs: DataFrame, step: str) -> DataFrame:
        if not self.topic_vector:
            return docs
        # Equal texts are embedded once.
        text = T.text_of(F.col("abstract"), F.col("title"))
        keyed = docs.withColumn("__key", F.sha2(text, 256))
        vectors = keyed.groupBy("__key").agg(F.min(text).alias("__text")).select("__key", self.embed(F.col("__text")).alias("embedding"))
        near = lambda: corpus.relevant(keyed.drop("embedding").join(vectors, "__key"), self.topic_vector, self.thresholds["relevance"]).drop("__key", "embedding")
        return self.attempt(step, near, docs)

    def _unique(self, docs: DataFrame, step: str) -> DataFrame:
        key = T.dedup_key(F.col("doi"), F.col("openalex_id"), F.col("s2_id"))
        winners = corpus.keyed_dedup(docs).select(F.col("id").alias("__winner"))
        unique = docs.where(key.isNull()).unionByName(docs.where(key.isNotNull()).join(winners, F.col("id") == F.col("__winner"), "left_semi"))
        return self.attempt(step, lambda: corpus.fuzzy_dedup(unique), docs)

    def clean(self, docs: DataFrame) -> DataFrame:
        docs = self._relevant(self._unique(docs, "clean_dedup"), "clean_relevance")
        return corpus.round_robin(docs, self.max_documents).withColumn("source_tier", self.pack.classify_tier(docs))

    def expanded(self, docs: DataFrame) -> DataFrame:
        """``docs`` and what cites the most cited of them, new ones only and at most the budget; cleaned again, not capped."""
        if self.expand is None:
            return docs
        new = corpus.unseen(self.expand(corpus.expansion_seeds(docs)), docs, "source_id").orderBy("source_id").limit(self.expansion_budget)
        last = docs.agg(F.max("doc_ord")).first()[0]
        if last is None:
            return docs
        # New documents come after all others; they are as few as the budget.
        new = new.withColumn("doc_ord", F.lit(last) + F.row_number().over(Window.orderBy("source_id"))).withColumn("source_tier", self.pack.classify_tier(new))
        both = self.attempt("expansion", lambda: docs.unionByName(new, allowMissingColumns=True), docs)
        return self._relevant(self._unique(both, "expansion_dedup"), "expansion_relevance")

    # Graph

    def answers(self, docs: DataFrame) -> DataFrame:
        """(doc_ord, title, abstract, response): answers that came along, or those of ``ask`` to batches of documents with text."""
        shown = docs.select("doc_ord", "title", F.substring("abstract", 1, 500).alias("abstract"))
        if "raw" in docs.columns:
            return shown.join(extract.parsed(docs.select("doc_ord", "raw")).drop("raw"), "doc_ord")
        prompts = extract.prompts(docs, corpus.batches(docs), self.pack.prompt)
        asked = write_stage(prompts.select("ords", models.asked(F.col("prompt"), self.ask).alias("raw")), self.folder, "asked")
        # Documents without an answer give nothing, not even themselves.
        return shown.join(extract.answered(asked).where("answered"), "doc_ord")

    def build(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        answers = write_stage(self.answers(docs), self.folder, "answers")
        found = write_stage(extract.nodes_of(answers), self.folder, "nodes_found")
        # Places in a document are below 2^31, so that ordinals follow document, kind and place.
        place = lambda: F.col("doc_ord") * 2**34 + F.col("kind") * 2**31 + F.col("at")
        found = found.withColumn("node_ord", place())
        edges = extract.edges_of(answers, found)
        number = lambda c: found.select(F.col("id").alias(c), F.col("node_ord").alias(f"{c}_ord"))
        edges = edges.join(number("src"), "src").join(number("dst"), "dst")
        tiers = docs.select("doc_ord", F.col("id").alias("source"), "source_url", "source_tier")
        edges = edges.join(tiers, "doc_ord").select(place().alias("edge_ord"), F.col("src_ord").alias("src"), F.col("dst_ord").alias("dst"), "edge_type", "source", "source_url", "source_tier")
        meta = docs.select("doc_ord", F.col("id").alias("source_document_id"), "source_url", "source_tier", "publication_date")
        nodes = found.join(meta, "doc_ord").withColumn("id", F.col("node_ord")).drop("doc_ord", "kind", "at")
        led = graph.resolve_entities(nodes.where(F.col("node_type").isin(*self.resolve_types)).select("node_ord", "node_type", "name")).where("node_ord <> leader")
        nodes, edges = self._merged(nodes, edges, led.select(F.col("node_ord").alias("id"), "leader"), "names")
        nodes = write_stage(nodes.withColumn("embedding", self.embed(T.text_of(F.col("description"), F.col("name"), 8000))), self.folder, "nodes_embedded")
        some = nodes.where(F.col("node_type").isin("concept", "artifact"))
        mapping = graph.embedding_mapping(some, self.thresholds["merge"])
        return self._merged(nodes, edges, mapping.where("id <> leader"), "vectors")

    def _merged(self, nodes: DataFrame, edges: DataFrame, mapping: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Contracted nodes with the leader's other columns, and edges between them."""
        nodes, mapping = write_stage(nodes, self.folder, f"nodes_before_{name}"), write_stage(mapping, self.folder, f"mapping_{name}")
        merged, moved = graph.contract(nodes, edges, mapping)
        own = nodes.drop("node_type", "name", "description", "embedding")
        return merged.drop("members").join(own, "id"), write_stage(moved, self.folder, f"edges_{name}")

    # Patterns

    def _pattern(self, rows: DataFrame, kind: str, key: Column, title: Column, measured: Column, evidence: Column, counter: Column | None, spots: Column | None, confidence: Column, details: dict[str, Column]) -> DataFrame:
        none = F.array().cast(f"array<{patterns.EVIDENCE}>")
        told = F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string"))))
        return rows.select(
            F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("id"), F.lit(kind).alias("pattern_type"), title.alias("title"), measured.alias("measured_pattern"), evidence.alias("evidence"),
            (none if counter is None else counter).alias("counter_evidence"), (F.array() if spots is None else F.array(spots)).cast(f"array<{patterns.BLIND_SPOT}>").alias("blind_spots"),
            confidence.cast("double").alias("confidence"), told.alias("details"),
        )

    def _items(self, nodes: DataFrame, key: str, role: str = "supports", length: int = 300) -> DataFrame:
        """(key, key_item): nodes as evidence."""
        text = F.substring(F.coalesce(T.missing_as_null(F.col("description")), F.col("name")), 1, length)
        item = F.struct(F.col("id").cast("string"), text, F.col("source_document_id"), F.col("source_url"), F.col("source_tier"), F.lit(role)).cast(patterns.EVIDENCE)
        return nodes.select(F.col("id").alias(key), item.alias(f"{key}_item"))

    def _sourced(self, said: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Assertions with the source that they name, or else that of the first document beside them."""
        docs = nodes.where("node_type = 'source_document'").select(F.col("id").alias("doc"), F.struct(F.col("source_document_id").alias("id"), F.col("source_url").alias("url"), F.col("source_tier").alias("tier")).alias("of"))
        beside = graph.neighbours(graph.bundles(edges)).join(docs, F.col("neighbour") == F.col("doc")).groupBy(F.col("id").alias("near")).agg(F.min_by("of", "doc").alias("of"))
        met = said.join(beside, F.col("id") == F.col("near"), "left")
        found = T.source_of(F.col("source_url"), F.col("source_document_id"), F.col("source_tier"), F.col("of"))
        return met.withColumn("from", found).drop("near", "of").withColumns({"source_document_id": F.col("from.id"), "source_url": F.col("from.url"), "source_tier": F.col("from.tier")}).drop("from")

    def gaps(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        found = patterns.gaps(edges, nodes.select("id", "name", "node_type"))
        measured = F.concat(F.col("name"), F.lit(" is recommended by "), F.col("n_sources").cast("string"), F.lit(" sources and carried out "), F.col("n_executions").cast("string"), F.lit(" times."))
        details = {"gap_node": F.col("name"), "recommendation_count": F.col("n_sources"), "execution_count": F.col("n_executions")}
        spot = patterns.blind_spot(F.lit("Results may be published where no connector looked."), F.lit("moderate"))
        return self._pattern(found, "gap", F.col("dst"), F.concat(F.lit("Gap: "), F.col("name")), measured, F.col("evidence"), None, spot, F.col("confidence"), details)

    def contradictions(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        said = write_stage(self._sourced(nodes.where("node_type = 'assertion'"), nodes, edges), self.folder, "assertions")
        found = write_stage(patterns.scored_pairs(said, self.scorer, self.thresholds["pair"]), self.folder, "contradictions_found")
        # Up to three assertions on either side follow the two that contradict each other.
        more = patterns.corroborators(found, said).join(self._items(said, "k", length=200), "k")
        turned = F.col("k_item").withField("role", F.when(F.col("side") == "a", "supports").otherwise("counters"))
        side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct((-F.col("similarity")).alias("s"), F.col("k"), turned.alias("item"))))), lambda x: x["item"])
        more = more.groupBy("a", "b").agg(side("a").alias("with_a"), side("b").alias("with_b"))
        met = found.join(self._items(said, "a"), "a").join(self._items(said, "b", "counters"), "b").join(more, ["a", "b"], "left")
        none = F.array().cast(f"array<{patterns.EVIDENCE}>")
        met = met.withColumns({"a_items": F.concat(F.array("a_item"), F.coalesce("with_a", none)), "b_items": F.concat(F.array("b_item"), F.coalesce("with_b", none))})
        key = F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))
        measured = F.concat(F.lit("Two statements of similarity "), F.format_number("similarity", 2), F.lit(" contradict each other with probability "), F.format_number("p", 2), F.lit("."))
        details = {"nli_confidence": F.col("p"), "similarity": F.col("similarity")}
        out = self._pattern(met, "contradiction", key, F.concat(F.lit("Contradiction "), key), measured, F.col("a_items"), F.col("b_items"), None, F.col("confidence"), details)
        return patterns.refine(out, self.verdict() if self.verdict else None)

    def drift(self, nodes: DataFrame) -> DataFrame:
        dated = nodes.where(F.col("node_type").isin("source_document", "assertion")).withColumn("year", T.year_of(F.col("publication_date"))).where("year is not null")
        clustered = write_stage(community.density_clusters(dated, "year", "id"), self.folder, "clusters")
        moves = patterns.transitions(clustered)
        said = dated.where("node_type = 'assertion'")
        own = clustered.join(said.select(F.col("id").alias("key")), "key", "left_semi")
        shown = patterns.drift_evidence(own, moves).join(self._items(said, "key", length=200), "key")
        items = F.transform(F.sort_array(F.collect_list(F.struct("at", "label", "key", "key_item"))), lambda x: x["key_item"])
        # A year is a window, so there are few of them.
        windows = F.array_join(F.sort_array(F.collect_set("window")), ", ")
        years = dated.agg(F.count_distinct("year").alias("years")).first().years
        every = clustered.agg(windows.alias("w")).first().w or ""
        found = moves.join(shown.groupBy("previous", "window").agg(items.alias("evidence")), ["previous", "window"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(f"array<{patterns.EVIDENCE}>")))
        title = F.concat(F.col("previous"), F.lit(" to "), F.col("window"), F.lit(": "), F.col("direction"))
        measured = F.concat(F.lit("Clusters went from "), F.col("n_before").cast("string"), F.lit(" to "), F.col("n_now").cast("string"), F.lit(" between "), F.col("previous"), F.lit(" and "), F.col("window"), F.lit(" ("), F.col("direction"), F.lit(")."))
        spot = patterns.blind_spot(F.lit(f"Analysis covers {years} year bins only."), F.lit("moderate"))
        details = {"from_window": F.col("previous"), "to_window": F.col("window"), "cluster_delta": F.col("delta"), "all_windows": F.lit(every), "transitions": measured}
        return self._pattern(found, "drift", F.col("window"), title, measured, F.col("evidence"), None, spot, F.lit(0.5), details)

    def bridges(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        pairs = write_stage(graph.bundles(edges), self.folder, "pairs")
        parts = write_stage(community.communities(pairs), self.folder, "communities")
        central = community.betweenness(pairs, nodes, community.MOST_EDGES)
        best = write_stage(patterns.capped_bridges(patterns.bridge_candidates(pairs, nodes, parts, central)), self.folder, "bridges_found")
        found = best.join(patterns.bridge_evidence(best, nodes, parts), ["u", "v"])
        key = F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string"))
        measured = F.concat(F.lit("They link two communities with similarity "), F.format_number("similarity", 2), F.lit(" and betweenness "), F.format_number("centrality", 3), F.lit("."))
        shown = F.concat(F.col("n_assertions").cast("string"), F.lit(" community assertions; "), F.size("evidence").cast("string"), F.lit(" shown"))
        spot = patterns.blind_spot(shown, F.when(F.col("n_assertions") >= 3, "moderate").otherwise("major"))
        details = {"bridge_node_u": F.col("name_u"), "bridge_node_v": F.col("name_v"), "community_u": F.col("community_u"), "community_v": F.col("community_v"), "semantic_similarity": F.col("similarity"), "betweenness_centrality": F.col("centrality")}
        return self._pattern(found, "bridge", key, F.concat_ws(" and ", "name_u", "name_v"), measured, F.col("evidence"), None, spot, F.least("similarity", F.lit(0.95)), details)

    def _deduped(self, judged: DataFrame) -> DataFrame:
        """``judged`` with one promoted contradiction of each group of near ones, which has the evidence of all."""
        both = (F.size("evidence") > 0) & (F.size("counter_evidence") > 0)
        promoted = judged.where("pattern_type = 'contradiction' and status = 'promoted'").where(both)
        if promoted.limit(2).count() < 2:
            return judged
        end = lambda c: F.substring(F.coalesce(F.try_element_at(F.col(c), F.lit(1))["assertion_text"], F.lit("")), 1, 2000)
        p = F.coalesce(F.try_element_at("details", F.lit("nli_confidence")).cast("double"), F.col("confidence"))
        found = write_stage(promoted.select(F.col("cand_ord").alias("cand"), "id", "evidence", "counter_evidence", p.alias("p"), end("evidence").alias("ta"), end("counter_evidence").alias("tb")), self.folder, "contradictions_promoted")
        numbered = found.select("cand", F.xxhash64("ta").alias("a"), F.xxhash64("tb").alias("b"), "p")
        texts = found.select(F.explode(F.array("ta", "tb")).alias("text")).distinct().select(F.xxhash64("text").alias("id"), self.embed(F.col("text")).alias("embedding"))
        groups = write_stage(patterns.contradiction_groups(numbered, write_stage(texts, self.folder, "contradiction_texts"), self.thresholds["duplicate"]), self.folder, "contradiction_groups")
        write_stage(patterns.dedup_stats(groups), self.folder, "contradiction_dedup_stats")
        merged = patterns.merged_contradictions(found, groups).select(F.col("cand").alias("cand_ord"), F.col("evidence").alias("all_for"), F.col("counter_evidence").alias("all_against"), "merged")
        gone = groups.where("cand <> keeper").select(F.col("cand").alias("cand_ord"))
        noted = F.map_concat("details", F.create_map(F.lit("merged"), F.array_join("merged", ","), F.lit("group_size"), (F.size("merged") + 1).cast("string")))
        left = judged.join(gone, "cand_ord", "left_anti").join(merged, "cand_ord", "left")
        fresh = {"evidence": F.coalesce("all_for", "evidence"), "counter_evidence": F.coalesce("all_against", "counter_evidence"), "details": F.when(F.size("merged") > 0, noted).otherwise(F.col("details"))}
        return left.withColumns(fresh).select(*judged.columns)

    def mine(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Candidates of all the types in focus, in the order of types and ids, numbered by ``cand_ord``."""
        detectors = {"gap": lambda: self.gaps(nodes, edges), "contradiction": lambda: self.contradictions(nodes, edges), "drift": lambda: self.drift(nodes), "bridge": lambda: self.bridges(nodes, edges)}
        found = [self.attempt(f"patterns_{k}", detectors[k], None) for k in C.PATTERN_TYPES if k in self.focus]
        candidates = None
        for part in (f for f in found if f is not None):
            candidates = part if candidates is None else candidates.unionByName(part)
        if candidates is None:
            raise ValueError(f"no detector gave a result: {self.errors}")
        place = F.array_position(F.array(*map(F.lit, C.PATTERN_TYPES)), F.col("pattern_type"))
        # Detectors bound what they return, so numbering is one small sort.
        numbered = candidates.withColumn("cand_ord", F.row_number().over(Window.orderBy(place, F.desc("confidence"), "id")).cast("bigint"))
        return write_stage(numbered, self.folder, "candidates")

    def execute(self, documents: DataFrame) -> DataFrame:
        """Judged patterns; reports are written beside the stages by ``write_reports``."""
        stages = read_stages(self.spark, self.folder, GRAPH_STAGES) if self.resume else None
        if stages is None:
            docs = write_stage(self.expanded(write_stage(self.clean(documents), self.folder, "documents_capped")), self.folder, "documents")
            nodes, edges = self.build(docs)
            nodes, edges = write_stage(nodes, self.folder, "nodes"), write_stage(edges, self.folder, "edges")
        else:
            docs, nodes, edges = (stages[s] for s in GRAPH_STAGES)
        known = read_stages(self.spark, self.folder, ("candidates",)) if stages is not None and not self.remine else None
        candidates = known["candidates"] if known is not None and not known["candidates"].isEmpty() else self.mine(nodes, edges)
        judged = write_stage(verify.verify(candidates, self.pack.interpret()), self.folder, "judged")
        return self.attempt("patterns", lambda: self._deduped(judged), judged)

    def write_reports(self, judged: DataFrame) -> dict[str, str]:
        """Reports as text by file name; the tables are written as stages, numbered as the run made them."""
        stage = lambda name: self.spark.read.parquet(f"{self.folder}/{name}")
        docs, nodes, edges = (stage(s) for s in GRAPH_STAGES)
        covered = report.coverage(docs)
        pairs = graph.bundles(edges)
        tables = {
            "01_documents": docs, "02_corpus_stats": corpus.corpus_stats(docs), "03_coverage": covered, "04_extraction": nodes.groupBy("node_type").count(), "05_graph_stats": graph.graph_stats(nodes, edges),
            "06_candidates": stage("candidates"), "07_evidence_table": report.evidence_table(judged), "07_patterns_summary": report.patterns_summary(judged),
        }
        written = {name: write_stage(tables[name], self.folder, name) for name in NUMBERED}
        stats = write_stage(report.result_stats(judged, docs, nodes, edges), self.folder, "result_stats")
        parts = read_stages(self.spark, self.folder, ("communities",))
        drawn = nodes.join(parts["communities"], "id", "left") if parts is not None else nodes
        snapshot = {
            "topic": self.topic, "domain": self.pack.domain, "focus": list(self.focus), "resume": self.resume, "corpus": written["02_corpus_stats"], "graph": written["05_graph_stats"], "results": stats,
            "patterns": report.patterns_by_type(judged), "seconds": self.seconds, "estimated_cost": models.run_cost(docs.count(), nodes.count()),
        }
        return {
            "report.md": report.markdown(judged, self.topic, written["03_coverage"]),
            "coverage.md": report.coverage_markdown(written["03_coverage"]),
            "summary.json": report.run_summary(snapshot, self.errors),
            "graph.html": report.graph_html(drawn, report.graph_links(pairs, nodes, judged)),
        }


def run_topic(spark: SparkSession, folder: str, topic: str, search: Callable[[tuple[str, ...], tuple[str, ...], int], DataFrame], keys: dict[str, str] | None = None, depth: str = "standard", focus: str = "all", **options) -> DataFrame:
    """Plan a topic's sources, search them and run: ``search`` takes connectors, queries and a limit, and returns documents."""
    plan = planning.plan(spark, topic, depth, focus, options.pop("time_range", None), options.get("max_documents", 100))
    asked = tuple(plan.queries[: planning.QUERIES])
    types = C.PATTERN_TYPES if focus == "all" else tuple(t for t in C.PATTERN_TYPES if f"{t}s" == focus or t == focus)
    pack = options.pop("pack", PACKS["research"])
    docs = search(pack.connectors(keys or {}), asked, plan.per_connector_limit)
    return Run(spark, folder, topic, focus=types, pack=pack, expansion_budget=plan.expansion_budget, **options).execute(docs)
