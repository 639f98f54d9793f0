"""Pattern detectors: gaps, contradictions, drift, bridges; and their dedup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import constants as C
from evigraph.functions import text as T
from evigraph.operators.components import connected_components
from evigraph.operators.graph import sent
from evigraph.operators.vectors import in_blocks, similar_pairs, top_pairs
from evigraph.sources.stages import cut

BLIND_SPOT = "struct<description:string,severity:string,missing_source_family:string>"
EVIDENCE = "struct<assertion_node_id:string,assertion_text:string,source_document_id:string,source_url:string,source_tier:int,role:string>"


def gaps(edges: DataFrame, targets: DataFrame, least: int = 2, most_executions: int = 1, top: int | None = C.TOP, shown: int = 5) -> DataFrame:
    """Targets that many sources recommend and few carry out.

    ``edges``: edge_ord, src, dst, edge_type, source (document or else node), source_url, source_tier; ``targets``: id, name,
    node_type.  Only the first ``shown`` recommenders of a target are gathered, as evidence."""
    fit = targets.where(F.col("node_type").isin("concept", "artifact") & (F.length("name") >= 4) & (F.size(F.split(F.trim("name"), r"\s+")) >= 2))
    about = edges.join(fit.select(F.col("id").alias("dst"), "name"), "dst")
    is_rec = F.col("edge_type") == "recommends"
    counted = about.groupBy("dst", "name").agg(
        F.count_distinct(F.when(is_rec, F.col("source"))).alias("n_sources"),
        F.count_if(is_rec).alias("n_recommends"),
        F.count_if(F.col("edge_type").isin("evaluates", "produces")).alias("n_executions"),
        F.min(F.when(is_rec, F.col("edge_ord"))).alias("first"),
    )
    kept = counted.where((F.col("n_sources") >= least) & (F.col("n_executions") <= most_executions))
    if top is not None:
        kept = kept.orderBy(F.desc("n_sources"), "first").limit(top)
    place = F.row_number().over(Window.partitionBy("dst").orderBy("edge_ord"))
    first = about.where(is_rec).join(kept.select("dst"), "dst", "left_semi").withColumn("place", place).where(F.col("place") <= shown)
    item = F.struct(F.col("src").cast("string"), F.concat(F.lit("Recommends: "), F.col("name")), F.col("source").cast("string"), F.col("source_url"), F.col("source_tier"), F.lit("supports")).cast(EVIDENCE)
    evidence = first.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("evidence"))
    return kept.join(evidence, "dst").withColumn("confidence", F.least(F.col("n_sources") / 5, F.lit(0.9)))


def scored_pairs(assertions: DataFrame, scorer, least: float = C.PAIR_COSINE, most: int = C.PAIR_LIMIT, threshold: float = C.CONTRADICTION_P, order: str = "id") -> DataFrame:
    """(a, b, similarity, p): the most similar pairs that ``scorer`` (two text columns to a struct with label and
    p_contradiction) calls contradictions.  Scoring comes after the cut, on at most ``most`` pairs, which are found once."""
    best = cut(top_pairs(similar_pairs(assertions, least, order, most=most), most))
    text = assertions.select(F.col(order).alias("k"), T.text_of(F.col("description"), F.col("name")).alias("t"))
    both = best.join(text.withColumnsRenamed({"k": "a", "t": "text_a"}), "a").join(text.withColumnsRenamed({"k": "b", "t": "text_b"}), "b")
    verdict = both.withColumn("verdict", scorer(F.col("text_a"), F.col("text_b")))
    return verdict.where((F.col("verdict.label") == "contradiction") & (F.col("verdict.p_contradiction") >= threshold)).select(
        "a", "b", "similarity", F.col("verdict.p_contradiction").alias("p"), (0.8 * F.col("verdict.p_contradiction")).alias("confidence")
    )


#: Candidates and assertions that meet in one task.
CANDIDATE_ROWS, ASSERTION_ROWS = 1024, 4096


def corroborators(candidates: DataFrame, assertions: DataFrame, least: float = 0.6, margin: float = 0.05, most: int = 3, order: str = "id") -> DataFrame:
    """(a, b, side, k, similarity): for each side of a candidate, the assertions nearest to it that are clearly nearer to it
    than to the other side, one for each text.

    Blocks of candidates meet blocks of assertions in matrix products; only assertions that a side can use leave a task."""
    vector = F.transform("embedding", lambda v: v.cast("double"))
    rows = assertions.where(F.size("embedding") > 0).select(F.col(order).cast("bigint").alias("k"), T.text_of(F.col("description"), F.col("name"), 200).alias("text"), vector.alias("vector"))
    end = lambda c: rows.select(F.col("k").alias(c), F.col("vector").alias(f"v{c}"))
    pairs = candidates.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct().join(end("a"), "a").join(end("b"), "b").where(F.size("va") == F.size("vb"))
    pairs, pair_blocks = in_blocks(cut(pairs), "i", CANDIDATE_ROWS, ("a", "b"))
    rows, row_blocks = in_blocks(rows.where("text <> ''"), "j", ASSERTION_ROWS, ("k",))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs, rows = pairs.withColumn("j", every(row_blocks)), rows.withColumn("i", every(pair_blocks))

    def unit(vectors: list[list[float]], mine: list[int]) -> np.ndarray:
        matrix = np.array([vectors[x] for x in mine])
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / np.where(norms > 0, norms, 1)

    def sides(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, va, vb = (pairs.column(c).to_pylist() for c in ("a", "b", "va", "vb"))
        k, text, vectors = (rows.column(c).to_pylist() for c in ("k", "text", "vector"))
        found = []
        for size in {len(v) for v in va} & {len(v) for v in vectors}:
            left, right = [x for x in range(len(a)) if len(va[x]) == size], [y for y in range(len(k)) if len(vectors[y]) == size]
            matrix = unit(vectors, right).T
            to_a, to_b = unit(va, left) @ matrix, unit(vb, left) @ matrix
            for side, own, other in (("a", to_a, to_b), ("b", to_b, to_a)):
                for x, y in zip(*np.nonzero((own > other + margin) & (own > least))):
                    one, near = left[x], right[y]
                    if k[near] not in (a[one], b[one]):
                        found.append((a[one], b[one], side, k[near], text[near], float(own[x, y])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()]
        columns = list(zip(*found)) if found else [()] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "side", "k", "text", "similarity"])

    picked = pairs.groupBy("i", "j").cogroup(rows.groupBy("i", "j")).applyInArrow(sides, "a bigint, b bigint, side string, k bigint, text string, similarity double")
    once = picked.groupBy("a", "b", "side", "text").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "k")).alias("best"))
    place = F.row_number().over(Window.partitionBy("a", "b", "side").orderBy("best"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("a", "b", "side", "best.k", (-F.col("best.far")).alias("similarity"))


def transitions(clustered: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """(window, previous, n_before, n_now, delta, direction) between consecutive clustered windows whose cluster counts differ.

    ``clustered``: window, label; noise is -1, and a window of noise alone still counts, with no cluster."""
    counts = clustered.groupBy("window").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n"))
    by_time = Window.orderBy("window")
    steps = counts.select("window", F.col("n").alias("n_now"), F.lag("window").over(by_time).alias("previous"), F.lag("n").over(by_time).alias("n_before"))
    moved = steps.where("previous is not null and n_now <> n_before").withColumn("delta", F.col("n_now") - F.col("n_before"))
    return moved.select("previous", "window", "n_before", "n_now", "delta", F.when(F.col("delta") > 0, "grew").otherwise("consolidated").alias("direction"))


def drift_evidence(clustered: DataFrame, moves: DataFrame, each: int = 3, most: int = 10) -> DataFrame:
    """(previous, window, at, label, key): the first assertions of each cluster of both windows of a transition."""
    ranked = clustered.where("label >= 0").withColumn("r", F.row_number().over(Window.partitionBy("window", "label").orderBy("key"))).where(F.col("r") <= each)
    both = moves.select("previous", "window", F.explode(F.array("previous", "window")).alias("at"))
    met = both.join(ranked.select(F.col("window").alias("at"), "label", "key", "r"), "at")
    place = F.row_number().over(Window.partitionBy("previous", "window").orderBy("at", "label", "r"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("previous", "window", "at", "label", "key")


def bridge_candidates(pairs: DataFrame, nodes: DataFrame, community: DataFrame, centrality: DataFrame, band: tuple[float, float] = C.BRIDGE_BAND, least: int = 3, least_nodes: int = 6) -> DataFrame:
    """(u, v, similarity, centrality, score): edges between concepts of different communities of ``least`` members or more
    whose names share nothing and whose vectors are neither near nor far; none in a graph of fewer than ``least_nodes`` nodes.

    ``pairs`` that have a similarity keep it, and vectors needn't travel; else the ends' vectors are compared and come along."""
    large = community.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = community.join(large, "community", "left_semi")
    if nodes.limit(least_nodes).count() < least_nodes:
        pairs = pairs.limit(0)
    compared = "similarity" in pairs.columns
    own = [] if compared else ["embedding"]
    concept = nodes.where("node_type = 'concept'").select("id", "name", *own).join(kept, "id").join(centrality, "id")
    concept = concept.withColumn("low", F.lower("name")).withColumn("words", T.long_words(F.col("low")))
    concept = sent(cut(concept)) if compared else concept
    end = lambda e: concept.select(*(F.col(c).alias(f"{c}_{e}") for c in ("id", "name", "low", "words", *own, "community", "centrality")))
    if compared:
        pairs = pairs.where(F.col("similarity").between(*band))
    met = pairs.join(end("u"), F.col("a") == F.col("id_u")).join(end("v"), F.col("b") == F.col("id_v")).where("community_u <> community_v")
    met = met.where(~T.words_shared(F.col("low_u"), F.col("words_u"), F.col("low_v"), F.col("words_v")))
    if not compared:
        met = met.where(F.size("embedding_u") == F.size("embedding_v")).withColumn("similarity", T.cosine(F.col("embedding_u"), F.col("embedding_v"))).where(F.col("similarity").between(*band))
    top = F.greatest("centrality_u", "centrality_v")
    columns = ["name_u", "name_v", *(f"{c}_{e}" for c in own for e in "uv"), "community_u", "community_v"]
    return met.select(F.col("a").alias("u"), F.col("b").alias("v"), *columns, "similarity", top.alias("centrality"), (0.6 * F.col("similarity") + 0.4 * top).alias("score"))


def _cosine(a, b) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    norms = float(np.linalg.norm(x) * np.linalg.norm(y)) if x.shape == y.shape else 0.0
    return float(x @ y) / norms if norms else 0.0


def capped_bridges(candidates: DataFrame, hub: int = 2, top: int = C.TOP, near: float = C.BRIDGE_NEAR, at_once: int = 1000, nodes: DataFrame | None = None) -> DataFrame:
    """The best candidates, with each name in at most ``hub`` and no pair of ends near to that of a better one.  Vectors are the
    candidates' own or those of ``nodes``; without any, no pair is near another.

    Taking is greedy, so it is replayed in order of score: first the hub cap, then nearness to those that stay, straight or
    crossed.  Rows come ``at_once`` at a time, each time those after the last, and without names that are taken up."""
    shown = [c for c in candidates.columns if not c.startswith("embedding_")]
    known = len(shown) < len(candidates.columns) or nodes is not None
    vector = lambda e: nodes.select(F.col("id").alias(e), F.col("embedding").alias(f"embedding_{e}"))
    best = lambda rows: rows.orderBy(F.desc("score"), "u", "v")
    candidates = cut(candidates) if nodes is not None else candidates
    used: dict[str, int] = {}
    kept: list = []
    left = candidates
    while len(kept) < top:
        rows = best(left).limit(at_once)
        rows = best(rows.join(vector("u"), "u", "left").join(vector("v"), "v", "left") if nodes is not None else rows).collect()
        for row in rows:
            if len(kept) == top:
                break
            if max(used.get(row.name_u, 0), used.get(row.name_v, 0)) >= hub:
                continue
            for name in (row.name_u, row.name_v):
                used[name] = used.get(name, 0) + 1
            ends = [(row.embedding_u, row.embedding_v), (row.embedding_v, row.embedding_u)] if known else []
            if not any(_cosine(x, k.embedding_u) > near and _cosine(y, k.embedding_v) > near for k in kept for x, y in ends):
                kept.append(row)
        if len(rows) < at_once:
            break
        last = rows[-1]
        end = lambda c: F.lit(last[c]).cast(candidates.schema[c].dataType)  # noqa: E731, B023
        later = (F.col("u") > end("u")) | ((F.col("u") == end("u")) & (F.col("v") > end("v")))
        left = candidates.where((F.col("score") < last.score) | ((F.col("score") == last.score) & later))
        # Names that are taken up, at most two of each row that was taken in.
        full = [(name,) for name, n in used.items() if n >= hub]
        if full:
            taken = F.broadcast(candidates.sparkSession.createDataFrame(full, "taken string"))
            for name in ("name_u", "name_v"):
                left = left.join(taken, F.col(name) == F.col("taken"), "left_anti")
    return candidates.sparkSession.createDataFrame([tuple(r[c] for c in shown) for r in kept], candidates.select(*shown).schema)


def _item(text: Column, role: str = "supports") -> Column:
    return F.struct(F.col("id").cast("string"), text, F.col("source_document_id"), F.col("source_url"), F.col("source_tier"), F.lit(role)).cast(EVIDENCE)


def bridge_evidence(bridges: DataFrame, nodes: DataFrame, community: DataFrame, each: int = 5, scanned: int = 10, most: int = 10) -> DataFrame:
    """(u, v, evidence, n_assertions) of ``bridges`` (u, v, name_u, name_v, community_u, community_v).

    Of the assertions of an endpoint's community, those come first that mention its name or a word of it of four letters or more,
    then the nearest to it; of the first ``scanned``, those of a new text are taken, ``each`` at most.  Both endpoints' are united.
    If there are none, the assertions of both communities are ranked by nearness to the mean of the endpoints.  ``nodes`` have
    node_ord, description, name, embedding and source columns; those of an assertion may be null."""
    said = nodes.where("node_type = 'assertion'").join(community, "id").withColumn("text", F.substring(F.coalesce(T.missing_as_null(F.col("description")), F.col("name"), F.lit("")), 1, 200))
    vector = nodes.select(F.col("id").alias("end"), F.col("embedding").alias("of"))
    side = lambda n, s: bridges.select("u", "v", F.lit(n).alias("side"), F.col(s).alias("end"), F.lower(F.coalesce(f"name_{s}", F.lit(""))).alias("about"), F.col(f"community_{s}").alias("community"))
    # Bridges are few, at most as many as were asked for.
    ends = side(0, "u").union(side(1, "v")).join(vector, "end", "left")
    whole = F.lower(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("name", F.lit(""))))
    words = F.filter(F.split("about", r"(?U)\s+"), lambda w: F.length(w) > 3)
    mention = ((F.col("about") != "") & F.contains("whole", F.col("about"))) | F.exists("words", lambda w: F.contains(F.col("whole"), w))
    near = lambda of: F.when((F.size("embedding") > 0) & (F.size("embedding") == F.size(of)), T.cosine(F.col("embedding"), F.col(of))).otherwise(F.lit(-1.0))
    met = ends.join(said, "community").withColumn("whole", whole).withColumn("words", words).withColumn("mention", F.coalesce(mention, F.lit(False)))
    met = met.withColumn("far", F.when(F.col("mention") | (F.coalesce(F.size("of"), F.lit(0)) <= 0), F.lit(0.0)).otherwise(-near("of")))
    by_place = F.row_number().over(Window.partitionBy("u", "v", "side").orderBy(F.desc("mention"), "far", "node_ord"))
    first = met.withColumn("place", by_place).where((F.col("place") <= scanned) & (F.col("text") != ""))
    fresh = F.row_number().over(Window.partitionBy("u", "v", "side", "text").orderBy("place"))
    nth = F.row_number().over(Window.partitionBy("u", "v", "side").orderBy("place"))
    taken = first.withColumn("fresh", fresh).where("fresh = 1").withColumn("nth", nth).where(F.col("nth") <= each)
    once = taken.groupBy("u", "v", "id").agg(F.min(F.struct("side", "nth", _item(F.col("text")).alias("item"))).alias("x"))
    listed = lambda rows, order: F.transform(F.slice(F.sort_array(F.collect_list(rows)), 1, most), lambda x: x[order]["item"] if order else x["item"])
    merged = once.groupBy("u", "v").agg(listed(F.struct("x"), "x").alias("evidence"))
    counted = met.groupBy("u", "v").agg(F.count_distinct("id").alias("n_assertions"))
    out = bridges.select("u", "v").join(counted, ["u", "v"], "left").join(merged, ["u", "v"], "left")
    mean = bridges.select("u", "v").join(vector.withColumnsRenamed({"end": "u", "of": "vu"}), "u").join(vector.withColumnsRenamed({"end": "v", "of": "vv"}), "v")
    mean = mean.select("u", "v", F.when(F.size("vu") == F.size("vv"), F.zip_with("vu", "vv", lambda x, y: (x.cast("double") + y.cast("double")) / 2)).alias("mean"))
    left = out.where("evidence is null").select("u", "v").join(mean, ["u", "v"])
    back = met.dropDuplicates(["u", "v", "id"]).join(left, ["u", "v"]).withColumn("far", F.when(F.coalesce(F.size("mean"), F.lit(0)) <= 0, F.lit(0.0)).otherwise(-near("mean")))
    ranked = back.withColumn("nth", F.row_number().over(Window.partitionBy("u", "v").orderBy("far", "node_ord"))).where(F.col("nth") <= most)
    fallen = ranked.groupBy("u", "v").agg(listed(F.struct("nth", _item(F.col("text")).alias("item")), None).alias("fallback"))
    out = out.join(fallen, ["u", "v"], "left")
    return out.select("u", "v", F.coalesce("evidence", "fallback", F.array().cast(f"array<{EVIDENCE}>")).alias("evidence"), F.coalesce("n_assertions", F.lit(0)).alias("n_assertions"))


def contradiction_groups(candidates: DataFrame, assertions: DataFrame, least: float = C.DUPLICATE_COSINE, order: str = "id") -> DataFrame:
    """(cand, keeper, first, members): candidates (cand, a, b, p) linked when any side of one is nearer than ``least`` to any side
    of another; of each group, the one of largest p stays, the first of equals."""
    ends = candidates.select("cand", F.explode(F.array("a", "b")).alias("k"))
    used = ends.select("k").distinct().join(assertions.select(F.col(order).alias("k"), "embedding"), "k")
    near = similar_pairs(used, least, "k").where(F.col("similarity") > least).select("a", "b")
    # Candidates that share an assertion are linked through the first that has it, and so are those of linked assertions;
    # that closes to the same groups as all pairs of candidates would.
    first = lambda c, n: ends.groupBy(F.col("k").alias(c)).agg(F.min("cand").alias(n))
    across = near.join(first("a", "x"), "a").join(first("b", "y"), "b").select("x", "y")
    within = ends.join(first("f", "x"), F.col("k") == F.col("f")).select("x", F.col("cand").alias("y"))
    groups = connected_components(across.union(within), "x", "y").select(F.col("node").alias("cand"), "component")
    labelled = candidates.select("cand", "p").join(groups, "cand", "left").withColumn("component", F.coalesce("component", "cand"))
    kept = labelled.groupBy(F.col("component").alias("first")).agg(F.max_by("cand", F.struct("p", -F.col("cand"))).alias("keeper"), F.count(F.lit(1)).alias("members"))
    return labelled.join(kept, F.col("component") == F.col("first")).select("cand", "keeper", "first", "members")


def dedup_contradictions(candidates: DataFrame, assertions: DataFrame, least: float = C.DUPLICATE_COSINE, order: str = "id") -> DataFrame:
    """(cand, first, members): the candidates that stay, with the first of their group and its size."""
    return contradiction_groups(candidates, assertions, least, order).where("cand = keeper").select("cand", "first", "members")


def first_of_each_url(items: Column) -> Column:
    """Evidence items in order, the first for each url; those without a url by their node."""
    keys = F.transform(items, lambda e: T.url_key(e["source_url"], e["assertion_node_id"]))
    keyed = F.arrays_zip(items.alias("item"), keys.alias("key"))
    return F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: x["item"])


def merged_contradictions(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(cand, evidence, counter_evidence, merged) of the keepers of ``groups``: the items of all members in order of cand, the first
    for each url; merged are the other members' ids.  ``found``: cand, id, evidence, counter_evidence."""
    member = F.struct("cand", "id", "evidence", "counter_evidence")
    told = found.join(groups.select("cand", "keeper"), "cand").groupBy("keeper").agg(F.sort_array(F.collect_list(member)).alias("members"))
    items = lambda c: first_of_each_url(F.flatten(F.transform("members", lambda m: m[c])))
    others = F.transform(F.filter("members", lambda m: m["cand"] != F.col("keeper")), lambda m: m["id"])
    return told.select(F.col("keeper").alias("cand"), items("evidence").alias("evidence"), items("counter_evidence").alias("counter_evidence"), others.alias("merged"))


def dedup_stats(groups: DataFrame) -> DataFrame:
    """(before, after, merged, groups): candidates, those that stay, those folded into them, groups of several."""
    kept = F.col("cand") == F.col("keeper")
    return groups.agg(
        F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"), F.count_if(~kept).alias("merged"), F.count_if(kept & (F.col("members") > 1)).alias("groups")
    )


def blind_spot(description: Column, severity: Column) -> Column:
    return F.struct(description, severity, F.lit(None).cast("string")).cast(BLIND_SPOT)


def refine(found: DataFrame, verdict: Column | None = None) -> DataFrame:
    """Contradictions after a second look: those that ``verdict`` (a struct of classification, reasoning and the conditions of
    either claim) calls apparent go, others have it in their details, their text and a blind spot.  Where the verdict is
    null, or without one, a contradiction stays as it is.  ``found``: measured_pattern, details, blind_spots and what verdict reads."""
    if verdict is None:
        return found
    said = lambda field: T.strip(F.coalesce(F.col("__verdict").getField(field), F.lit("")))
    looked = found.withColumn("__verdict", verdict)
    kind, why = F.lower(said("classification")), said("reasoning")
    there = F.col("__verdict").isNotNull()
    looked = looked.where(~there | ~kind.isin(*C.DROPPED_VERDICTS))
    notes = {"llm_contradiction_classification": F.coalesce(T.missing_as_null(kind), F.lit("unknown")), "llm_contradiction_reasoning": why}
    conditions = {c: T.missing_as_null(said(c)) for c in ("conditions_for_claim_a", "conditions_for_claim_b")}
    added = F.map_filter(F.create_map(*(x for k, v in {**notes, **conditions}.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    review = F.when(why != "", F.concat(F.lit(" Review ("), kind, F.lit("): "), why)).otherwise(F.concat(F.lit(" Review: "), kind, F.lit(".")))
    spot = F.array(blind_spot(F.lit("Second look: apparent or real contradiction."), F.lit("minor")))
    own = F.map_filter(F.coalesce("details", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(added, k))
    return looked.withColumns(
        {
            "details": F.when(there, F.map_concat(own, added)).otherwise(F.col("details")),
            "measured_pattern": F.when(there, F.concat(F.coalesce("measured_pattern", F.lit("")), review)).otherwise(F.col("measured_pattern")),
            "blind_spots": F.when(there, F.concat(F.coalesce("blind_spots", F.array().cast(f"array<{BLIND_SPOT}>")), spot)).otherwise(F.col("blind_spots")),
        }
    ).drop("__verdict")
