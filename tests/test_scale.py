"""What keeps queries bounded as their tables grow, at the same results."""

import random
import re
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as T
from evigraph.operators import community, fuzzy, graph, patterns, report, vectors
from evigraph.plans import views as V
from evigraph.plans import queries as plans
from evigraph.plans.queries import ORACLES, QUERIES

EDGE = "edge_ord long, src long, dst long, edge_type string"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(map(str, frame.collect()))


def vectors_at(spark, folder, ids, seed=0, dimensions=8):
    rng = np.random.default_rng(seed)
    data = [(i, [float(x) for x in rng.normal(size=dimensions)], n % 3) for n, i in enumerate(ids)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def by_sql(folder, name, columns):
    con = pytest.importorskip("duckdb").connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_vectors_travel_as_they_are_stored(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(120 + i, [1.0] * 6) for i in range(5)], "id long, embedding array<float>")
    assert "double" not in plan(vectors.similar_pairs(frame, 0.2)).split("FlatMapGroups")[-1]
    every = vectors.similar_pairs(frame, 0.2, block_rows=40)
    for most in (3, 10, 40):
        few = vectors.similar_pairs(frame, 0.2, block_rows=40, most=most)
        assert rows(vectors.top_pairs(few, most)) == rows(vectors.top_pairs(every, most))


def test_long_ids_are_no_names_within_each_other(spark, tmp_path):
    ids = [10024, 100240, 100242, 12346, 112346, 123460, 2, 24, 246, 40000, 400002, 140000]
    folder = vectors_at(spark, tmp_path, ids, seed=3)
    got = sorted((r.u, r.v, r.similarity) for r in QUERIES["bridge_edges_by_label"](spark, folder).collect())
    want = by_sql(folder, "bridge_edges_by_label", ("u", "v", "similarity"))
    assert want and got == want


def test_gathered_edges_are_bundled_in_place(spark, tmp_path):
    folder = vectors_at(spark, tmp_path, range(60))
    pairs = vectors.similar_pairs(V.vec_nodes(spark, folder), 0.3)
    assert rows(graph.bundled(V.vec_edges_of_pairs(pairs))) == rows(graph.bundles(V.vec_edges(pairs)))
    # Only vectors are dealt out; edges stay where they were found.
    assert len(re.findall("FlatMapGroups", plan(V.vec_edges(pairs)))) == 1
    found = QUERIES["edge_bundle"](spark, folder)
    assert "hashpartitioning(a" not in physical(found) and "hashpartitioning(least" not in physical(found) and "SortMergeJoin" not in physical(found)
    assert sorted((r.a, r.b, r.edge_type, r.n) for r in found.collect()) == by_sql(folder, "edge_bundle", ("a", "b", "edge_type", "n"))


def test_statistics_work_edges_out_once(spark, tmp_path):
    folder = vectors_at(spark, tmp_path, range(60))
    found = QUERIES["graph_stats"](spark, folder)
    assert "FlatMapGroups" not in plan(found)
    assert sorted((r.stat, r.key, r.n) for r in found.collect()) == by_sql(folder, "graph_stats", ("stat", "key", "n"))


def test_contraction_leaves_edges_in_place(spark):
    nodes = spark.createDataFrame([(i, i, "concept", f"n{i}", "") for i in range(6)], "id long, node_ord long, node_type string, name string, description string")
    edges = spark.createDataFrame([(i, i, (i + 1) % 6, "extends") for i in range(6)], EDGE)
    mapping = spark.createDataFrame([(1, 0), (0, 0), (5, 4), (4, 4)], "id long, leader long")
    moved = graph.contract(nodes, edges, mapping)[1]
    assert sorted((r.src, r.dst) for r in moved.collect()) == [(0, 2), (2, 3), (3, 4), (4, 0)]
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in physical(graph.contract(nodes, edges, mapping)[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_scored_pairs_are_found_once(spark):
    rng = np.random.default_rng(4)
    said = spark.createDataFrame([(i, "", f"t{i}", [float(x) for x in rng.normal(size=4)]) for i in range(30)], "id long, description string, name string, embedding array<float>")
    sure = lambda a, b: F.struct(F.lit("contradiction").alias("label"), F.lit(0.9).alias("p_contradiction"))
    found = patterns.scored_pairs(said, sure, least=0.3, most=20)
    assert "FlatMapGroups" not in plan(found) and found.count() == 20
    best = vectors.top_pairs(vectors.similar_pairs(said, 0.3), 20)
    assert rows(found.select("a", "b")) == rows(best.select("a", "b"))


def test_pairs_meet_patterns_once(spark):
    names = ["x", "y", "x", "z", None, "w"]
    nodes = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    pairs = spark.createDataFrame([(0, 1, "a"), (1, 2, ""), (2, 3, None), (3, 5, "b"), (0, 2, "c"), (1, 5, "d"), (4, 5, "e")], "a long, b long, edge_type string")
    item = lambda i: [(str(i), "t", "d", "u", 1, "supports")]
    told = [("bridge", [], [], {"bridge_node_u": "y", "bridge_node_v": "x"}), ("contradiction", item(2), item(0), {}), ("contradiction", item(2), item(1), {}), ("contradiction", item(9), item(1), {})]
    found = report.graph_links(pairs, nodes, spark.createDataFrame(told, f"pattern_type string, evidence array<{patterns.EVIDENCE}>, counter_evidence array<{patterns.EVIDENCE}>, details map<string,string>"))
    from evigraph.functions.constants import LINK_COLOURS as colour

    want = {(0, 1): "bridge", (1, 2): "contradiction", (2, 3): "plain", (3, 5): "plain", (0, 2): "contradiction", (1, 5): "plain", (4, 5): "plain"}
    assert {(r.a, r.b): r.colour for r in found.collect()} == {k: colour[v] for k, v in want.items()}
    assert len(re.findall("LeftOuter", plan(found))) == 1


def test_known_similarity_is_kept(spark):
    nodes = spark.createDataFrame([(i, "concept", f"{'abcdefgh'[i] * 5}", [1.0, float(i)]) for i in range(8)], "id long, node_type string, name string, embedding array<float>")
    pairs = spark.createDataFrame([(0, 1, 0.5), (0, 5, 0.6), (2, 7, 0.9)], "a long, b long, similarity double")
    parts, none = nodes.select("id", (F.col("id") % 2).alias("community")), nodes.select("id", F.lit(0.0).alias("centrality"))
    found = patterns.bridge_candidates(pairs, nodes, parts, none, (0.4, 0.8))
    assert sorted((r.u, r.v, r.similarity) for r in found.collect()) == [(0, 1, 0.5), (0, 5, 0.6)] and not [c for c in found.columns if c.startswith("embedding")]
    best = patterns.capped_bridges(found, nodes=nodes, near=2.0)
    assert [(r.u, r.v) for r in best.collect()] == [(0, 5), (0, 1)]


def test_texts_are_turned_in_place(spark, monkeypatch):
    monkeypatch.setattr(plans, "TEXTS_AT_ONCE", 2)
    texts = ["a b a", "", None, " a  b ", "b", None, "c\nc c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    turned = plans.inverted(frame)
    assert "Exchange" not in physical(turned) and "Join" not in physical(turned)
    want = {}
    for i, text in enumerate(texts):
        want[i] = None if text is None else {}
        for at, word in enumerate(text.split(" ") if text is not None else ()):
            want[i].setdefault(word, []).append(at)
    assert {r.doc_id: r["index"] for r in turned.collect()} == want
    assert {r.doc_id: r.t for r in turned.select("doc_id", plans.T.rebuilt_abstract(F.col("index")).alias("t")).collect()} == dict(enumerate(texts))


def test_clusters_within_clusters_without_end():
    """Triples of near points at ever larger gaps: each cluster lies in the next."""
    k, at, gap, points = 1500, 0.0, 1e-4, []
    for g in range(k):
        points += [at, at + 1e-7 * (1 + g / k), at + 2.1e-7 * (1 + g / k)]
        gap *= 1 + 4 / k
        at += gap
    turn = np.array(points) / max(points) * 1.5
    assert len(np.unique(community.hdbscan(np.stack((np.cos(turn), np.sin(turn)), axis=1)))) > 100


def random_links(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, n, (m, 2)) if p[0] != p[1]})
    return [(a * 7 + 3, b * 7 + 3) for a, b in pairs]


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_by_arrays_is_louvain_by_dicts(monkeypatch, seed):
    links = random_links(seed, 120, 900)
    by_dicts = community.louvain(links)
    monkeypatch.setattr(community, "FEW", 0)
    monkeypatch.setattr(community, "LINKS_AT_ONCE", 50)
    assert community.louvain(links) == by_dicts and 1 < len(set(by_dicts.values())) < 60


@pytest.mark.parametrize("cells", [10**8, 0])
def test_labels_of_a_component_are_those_of_the_rounds(spark, monkeypatch, cells):
    monkeypatch.setattr(community, "CELLS", cells)
    links = random_links(5, 60, 110) + [(10_001, 10_003), (10_003, 10_009)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = community.label_communities(frame)
    assert len(plan(found)) < 20_000
    assert rows(found) == rows(community.label_communities_by_rounds(frame))


def test_betweenness_of_many_links_is_in_a_file(spark, monkeypatch):
    links = spark.createDataFrame(random_links(6, 40, 120), "a long, b long")
    held = {r.id: r.centrality for r in community.betweenness(links).collect()}
    monkeypatch.setattr(community, "HELD_LINKS", 0)
    monkeypatch.setattr(community, "LINKS_AT_ONCE", 9)
    monkeypatch.setattr(community, "MOST_EDGES", 10)
    filed = {r.id: r.centrality for r in community.betweenness(links).collect()}
    assert held.keys() == filed.keys() and max(held.values()) > 0 and all(abs(held[k] - filed[k]) < 1e-12 for k in held)
    with pytest.raises(ValueError):
        community.betweenness(links, most=community.MOST_EDGES)


def test_no_match_is_longer_than_it_may_reach():
    """What a matcher may match in a long text is bounded by its rare letters, without looking at all of the rest."""
    rng = random.Random(0)
    short = 0
    for _ in range(150):
        base = [rng.choice("aaaabbbbccccdddd" + "efghijklmnopqrstuvwxyz") for _ in range(rng.randint(200, 420))]
        other = list(base)
        for _ in range(rng.randint(0, 60)):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = [rng.choice("abcdxyz")] * rng.randint(0, 1)
        matcher = SequenceMatcher(None, "".join(other), "".join(base))
        most = T.reached(matcher, "".join(other))
        assert sum(m.size for m in matcher.get_matching_blocks()) <= most
        short += most < len(base)
    assert short > 10


def test_long_texts_meet_only_those_as_long(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK", 3)
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (60, 75, 130, 260, 400)]
    texts = sorted({b[:at] + rng.choice("xyz") + b[at + 1 :] for b in base for at in range(5, 55, 9)} | set(base) | {"", "ab"})
    got = {(r.x, r.y) for r in fuzzy.candidate_pairs(spark.createDataFrame([(t,) for t in texts], "s string"), [], "s", 0.9).collect()}
    # Texts of one base differ in two letters at most; others don't share half of their grams.
    assert got == {(x, y) for x, y in combinations(texts, 2) if len(x) == len(y) > 2}
