"""A whole run over planted documents, then a resumed one."""

import json

import pytest

from evigraph.plans.run import Run, run_topic

KIND = (
    "doc_ord long, id string, title string, abstract string, doi string, openalex_id string, s2_id string, source_family string, is_peer_reviewed boolean, cited_by_count long,"
    " source_url string, publication_date string, raw string"
)


def planted():
    rows = []
    for i in range(12):
        claim = f"Sparse training {'does not help' if i % 2 else 'does help'} large networks a lot number {i}"
        answer = {
            "assertions": [{"text": claim}, {"text": "Sparse training remains to be studied in future work"}],
            "entities": [{"name": "Sparse training", "entity_type": "method"}, {"name": f"Corpus {chr(97 + i) * 6}", "entity_type": "dataset"}],
            "relationships": [{"source_name": "Sparse training", "target_name": f"Corpus {chr(97 + i) * 6}", "relationship_type": "related_to"}],
        }
        title = " ".join([chr(97 + i) * 5, chr(110 + i) * 4, str(i * 7919)])
        rows.append((i, f"d{i}", title, "text " * (i + 1), f"10.1/{i}", None, None, "scholarly" if i % 3 else "web", i % 4 == 0, i, f"http://s/{i}", f"{2018 + i % 2}-01-01", json.dumps(answer)))
    rows.append((12, "d12", "copy", "", "10.1/3", None, None, "web", False, 0, "http://s/c", "2019-01-01", "{}"))
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("run"))


def test_run_finds_what_was_planted(spark, folder):
    run = Run(spark, folder, topic="sparse training", resolve_types=("concept", "artifact"), thresholds={"merge": 0.85, "pair": 0.4, "duplicate": 0.999, "relevance": 0.1})
    judged = run.execute(spark.createDataFrame(planted(), KIND))
    assert run.errors == []
    rows = judged.collect()
    kinds = {r.pattern_type for r in rows}
    assert {"gap", "contradiction"} <= kinds
    (gap,) = [r for r in rows if r.pattern_type == "gap" and "Sparse training" in r.title]
    assert len(gap.evidence) >= 2 and gap.status == "promoted"
    assert spark.read.parquet(f"{folder}/documents").count() == 12
    assert all(r.interpretation for r in rows)
    found = run.write_reports(judged)
    assert found["report.md"].startswith("# sparse training") and json.loads(found["summary.json"])["errors"] == [] and "total" in found["coverage.md"]


def test_reports_show_all_of_it(spark, folder):
    run = Run(spark, folder, topic="sparse training")
    judged = run.execute(spark.createDataFrame([], KIND))
    found = run.write_reports(judged)
    rows = judged.collect()
    assert all(f"]: {r.title}" in found["report.md"] for r in rows) and "**Blind spots:**" in found["report.md"] and "## Coverage" in found["report.md"]
    assert json.loads(found["summary.json"])["estimated_cost"] > 0 and '"colour": "#999"' in found["graph.html"]
    assert spark.read.parquet(f"{folder}/07_patterns_summary").count() == len(rows) and spark.read.parquet(f"{folder}/01_documents").count() == 12


def test_run_resumes_from_its_stages(spark, folder):
    empty = spark.createDataFrame([], KIND)
    before = {r.id for r in Run(spark, folder, focus=("gap",)).execute(empty).collect()}
    # Candidates are taken as they are, whatever is in focus, until they are to be looked for anew.
    assert {i.split(":")[0] for i in before} >= {"gap", "contradiction"}
    assert {r.pattern_type for r in Run(spark, folder, focus=("gap",), remine=True).execute(empty).collect()} == {"gap"}


def test_near_contradictions_become_one(spark, tmp_path):
    run = Run(spark, str(tmp_path), resolve_types=("concept", "artifact"), thresholds={"merge": 0.85, "pair": 0.4, "duplicate": 0.5, "relevance": 0.1}, focus=("contradiction",))
    judged = run.execute(spark.createDataFrame(planted(), KIND))
    (one,) = [r for r in judged.collect() if r.status == "promoted"]
    # The evidence of all members, once for each source.
    urls = [e.source_url for e in one.evidence]
    assert len(urls) == len(set(urls)) > 3 and int(one.details["group_size"]) > 3
    stats = spark.read.parquet(f"{tmp_path}/contradiction_dedup_stats").first()
    assert stats.after == 1 and stats.merged == stats.before - 1 and stats.groups == 1


def test_run_asks_and_expands(spark, tmp_path):
    prompts = []
    texts = ["Sparse Nets help Big Models. More research on Sparse Nets is needed.", "Sparse Nets don't help. Big Models need future work.", ""]
    kind = KIND.replace(", raw string", ", source_id string")
    rows = [(i, f"d{i}", f"{'abc'[i] * 9} title", t, f"10.1/{i}", None, None, "scholarly", False, i, f"http://s/{i}", "2019-01-01", f"s{i}") for i, t in enumerate(texts)]
    new = [(0, "n1", "newly found", "Sparse Nets again. Open question.", "10.1/n", None, None, "web", False, 0, "http://s/n", "2020-01-01", "n1"), (0, "n2", "known", "x", "10.1/1", None, None, "web", False, 0, "http://s/1", "2020-01-01", "s1")]
    seeds = []

    def expand(found):
        seeds.extend(r.source_id for r in found.collect())
        return spark.createDataFrame(new, kind)

    run = Run(spark, str(tmp_path), expand=expand, focus=("gap",))
    run.execute(spark.createDataFrame(rows, kind))
    assert seeds == ["s2", "s1", "s0"] and run.errors == []
    docs = {r.id: r for r in spark.read.parquet(f"{tmp_path}/documents").collect()}
    assert set(docs) == {"d0", "d1", "d2", "n1"} and docs["n1"].doc_ord == 3 and docs["n1"].source_tier == 3
    nodes = spark.read.parquet(f"{tmp_path}/nodes").collect()
    # The document without a text gives no node.
    assert {r.name for r in nodes if r.node_type == "source_document"} == {"aaaaaaaaa title", "bbbbbbbbb title", "newly found"} and any(r.name == "Sparse Nets" for r in nodes)


def test_a_topic_is_planned_and_searched(spark, tmp_path):
    asked = []

    def search(connectors, queries, limit):
        asked.append((connectors, queries, limit))
        return spark.createDataFrame(planted(), KIND)

    found = run_topic(spark, str(tmp_path), "sparse training framework", search, focus="gaps", depth="quick")
    assert {r.pattern_type for r in found.collect()} == {"gap"}
    ((connectors, queries, limit),) = asked
    assert connectors == ("openalex", "semantic_scholar", "arxiv") and queries[0] == "sparse training framework" and len(queries) <= 8 and limit == 10


def test_run_goes_on_after_a_failed_detector(spark, folder):
    def broken(a, b):
        raise ValueError("no model")

    run = Run(spark, folder, focus=("contradiction", "gap"), scorer=broken, remine=True)
    assert {r.pattern_type for r in run.execute(spark.createDataFrame([], KIND)).collect()} == {"gap"}
    assert [step for step, _ in run.errors] == ["patterns_contradiction"]
