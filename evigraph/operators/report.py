"""Reports: tables as DataFrames, cards as text, pages on the driver from rows that detectors bound."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import constants as C
from evigraph.functions import text as T
from evigraph.operators.graph import bundles, sent
from evigraph.sources.stages import cut


def evidence_table(patterns: DataFrame) -> DataFrame:
    """One row for each item of evidence, then of counter-evidence, of every pattern."""
    items = patterns.select("id", "pattern_type", "status", F.posexplode(F.concat("evidence", "counter_evidence")).alias("place", "item"))
    return items.select("id", "pattern_type", "status", "place", "item.*")


def patterns_summary(patterns: DataFrame) -> DataFrame:
    """One record a pattern, as dashboards read it."""
    text = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in patterns.columns else F.lit("")).alias(c)
    return patterns.select(
        "id", "pattern_type", text("title"), F.col("status").alias("promotion_status"), F.coalesce("confidence_level", F.lit("")).alias("confidence"), F.size("evidence").alias("evidence_count"),
        F.size("counter_evidence").alias("counter_evidence_count"), text("measured_pattern"), text("interpretation"), text("withheld_reason"),
    )


def patterns_by_type(patterns: DataFrame) -> DataFrame:
    """(pattern_type, status, confidence_level, n)."""
    return patterns.groupBy("pattern_type", "status", "confidence_level").agg(F.count(F.lit(1)).alias("n"))


def _lines(items: Column, most: int) -> Column:
    line = lambda e: F.concat(F.lit("- [tier "), F.coalesce(e["source_tier"].cast("string"), F.lit("?")), F.lit("] "), F.substring(F.coalesce(e["assertion_text"], F.lit("")), 1, 200))
    return F.array_join(F.transform(F.slice(items, 1, most), line), "\n")


def cards(patterns: DataFrame) -> DataFrame:
    """(id, status, card): Markdown with type, title, level, reason for withholding, what was measured, at most 5 items of evidence
    and 3 against, interpretation and blind spots; sections without content are left out."""
    here = lambda c: F.col(c) if c in patterns.columns else F.lit(None).cast("string")
    said = lambda label, c: F.when(F.coalesce(here(c), F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), here(c)))
    listed = lambda label, items, text: F.when(F.size(items) > 0, F.concat(F.lit(f"**{label}:**\n"), text))
    heading = F.concat(F.lit("### ["), F.initcap("pattern_type"), F.lit("]: "), F.col("title"))
    level = F.concat(F.lit("**Confidence:** "), F.coalesce("confidence_level", F.lit("unscored")))
    withheld = F.when(F.col("status") == "exploratory", said("Withheld", "withheld_reason"))
    sections = [heading, level, withheld, said("Measured pattern", "measured_pattern"), listed("Supporting evidence", "evidence", _lines(F.col("evidence"), 5)), listed("Counterevidence", "counter_evidence", _lines(F.col("counter_evidence"), 3))]
    sections.append(said("Interpretation", "interpretation"))
    if "blind_spots" in patterns.columns:
        sections.append(listed("Blind spots", "blind_spots", F.array_join(F.transform("blind_spots", lambda b: F.concat(F.lit("- ["), b["severity"], F.lit("] "), b["description"])), "\n")))
    return patterns.select("id", "status", F.concat_ws("\n", *sections).alias("card"))


def coverage(docs: DataFrame) -> DataFrame:
    """(families_used, families_missing, total_documents, documents_per_tier) of documents with source_tier, as one row."""
    used = F.sort_array(F.collect_set("source_family"))
    whole = docs.agg(used.alias("families_used"), F.count(F.lit(1)).alias("total_documents"), *(F.count_if(F.col("source_tier") == t).alias(f"tier_{t}") for t in range(1, 5)))
    per_tier = F.map_filter(F.create_map(*(x for t in range(1, 5) for x in (F.lit(t), F.col(f"tier_{t}")))), lambda k, v: v > 0)
    missing = F.array_except(F.array(*map(F.lit, C.FAMILIES)), F.col("families_used"))
    return whole.select("families_used", missing.alias("families_missing"), "total_documents", per_tier.alias("documents_per_tier"))


def coverage_markdown(found: DataFrame) -> str:
    row = found.first()
    tiers = ", ".join(f"{t}: {n}" for t, n in sorted(row.documents_per_tier.items()))
    lines = [f"- Documents in total: {row.total_documents}", f"- Sources used: {', '.join(row.families_used) or 'none'}", f"- Sources missing: {', '.join(row.families_missing) or 'none'}"]
    return "\n".join(["# Coverage", *lines, *([f"- Documents by tier: {tiers}"] if tiers else [])]) + "\n"


def markdown(patterns: DataFrame, topic: str, covered: DataFrame | None = None) -> str:
    """The report: all promoted cards, then all exploratory ones, a row at a time; then the coverage."""
    counts = {r.status: r["count"] for r in patterns.groupBy("status").count().collect()}
    parts = [f"# {topic}", f"{counts.get('promoted', 0)} promoted, {counts.get('exploratory', 0)} exploratory"]
    listed = cards(patterns)
    for status in ("promoted", "exploratory"):
        if counts.get(status):
            parts.append(f"## {status.capitalize()}")
            parts += [r.card for r in listed.where(F.col("status") == status).orderBy("id").toLocalIterator()]
    if covered is not None:
        parts.append(coverage_markdown(covered).replace("# ", "## ", 1).rstrip("\n"))
    return "\n\n".join(parts) + "\n"


def result_tables(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promoted and exploratory patterns as result rows."""
    row = patterns_summary(patterns).select(F.col("pattern_type").alias("type"), "title", "confidence", "evidence_count", "interpretation", "withheld_reason", "promotion_status")
    return tuple(row.where(F.col("promotion_status") == status).drop("promotion_status") for status in ("promoted", "exploratory"))


def result_stats(patterns: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(stat, n): what a run found and what it read."""
    promoted = F.col("status") == "promoted"
    counted = patterns.agg(F.count_if(promoted).alias("patterns_found"), F.count_if(~promoted).alias("exploratory_leads"), F.count_if(promoted & (F.col("confidence_level") == "high")).alias("high_confidence"))
    found = counted.unpivot([], counted.columns, "stat", "n")
    for stat, frame in (("documents_analyzed", docs), ("graph_nodes", nodes), ("graph_edges", bundles(edges))):
        found = found.union(frame.agg(F.lit(stat).alias("stat"), F.count(F.lit(1)).alias("n")))
    return found


def run_summary(snapshot: dict, errors: Iterable[tuple[str, str]] = ()) -> str:
    """What a run was asked, resolved and found, as JSON; DataFrames by their rows."""
    plain = {k: [r.asDict(True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in snapshot.items()}
    failed = [{"step": s, "message": m[:4000]} for s, m in errors]
    return json.dumps(plain | {"errors": failed}, indent=2, sort_keys=True, default=str)


def graph_links(pairs: DataFrame, nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(a, b, edge_type, colour) of pairs: a contradiction's where an item of either side is at the ends, a bridge's where the ends
    have the names of one.  ``patterns``: pattern_type, evidence, counter_evidence, details."""
    colour = C.LINK_COLOURS
    key = lambda x, y: (F.least(x, y), F.greatest(x, y))
    detail = lambda k: F.try_element_at("details", F.lit(k))
    low, high = key(detail("bridge_node_u"), detail("bridge_node_v"))
    bridges = patterns.where("pattern_type = 'bridge'").select(low.alias("low_name"), high.alias("high_name"), F.lit(True).alias("is_bridge")).where("low_name <> ''").distinct()
    sides = patterns.where("pattern_type = 'contradiction'").select(F.explode("evidence").alias("e"), "counter_evidence").select(F.col("e.assertion_node_id").alias("x"), F.explode("counter_evidence").alias("c"))
    low, high = key(F.col("x"), F.col("c.assertion_node_id"))
    against = sides.select(low.alias("low_id"), high.alias("high_id"), F.lit(True).alias("is_against")).distinct()
    # Names go by the least id that has them, so that numbers meet, and pairs move once for both kinds of patterns.
    known = cut(nodes.select("id", "name").join(nodes.groupBy("name").agg(F.min("id").alias("number")), "name", "left"))
    names, ids = sent(known.where("id = number")), sent(known)
    number = lambda c, n: names.select(F.col("name").alias(c), F.col("number").alias(n))
    one = lambda c, n: ids.select(F.col("id").cast("string").alias(c), F.col("id").alias(n), F.col("number").alias(f"{n}_number"))
    low, high = key(F.col("x"), F.col("y"))
    bridges = bridges.join(number("low_name", "x"), "low_name").join(number("high_name", "y"), "high_name").select(low.alias("low"), high.alias("high"), "is_bridge", F.lit(None).alias("ends"))
    low, high = key(F.col("x_number"), F.col("y_number"))
    against = against.join(one("low_id", "x"), "low_id").join(one("high_id", "y"), "high_id").select(low.alias("low"), high.alias("high"), F.lit(None).alias("is_bridge"), F.struct(*key(F.col("x"), F.col("y"))).alias("ends"))
    marks = bridges.union(against).groupBy("low", "high").agg(F.max("is_bridge").alias("is_bridge"), F.collect_set("ends").alias("ends"))
    name = lambda c: ids.select(F.col("id").alias(c), F.col("number").alias(f"number_{c}"))
    low, high = key(F.col("number_a"), F.col("number_b"))
    met = pairs.join(name("a"), "a").join(name("b"), "b").withColumns({"low": low, "high": high})
    # Ends that are the numbers themselves, as most are, needn't be moved beside them.
    met = met.select("low", "high", F.nullif("a", "low").alias("a"), F.nullif("b", "high").alias("b"), "edge_type").join(marks, ["low", "high"], "left").withColumns({"a": F.coalesce("a", "low"), "b": F.coalesce("b", "high")})
    met = met.withColumn("is_against", F.array_contains("ends", F.struct(*key(F.col("a"), F.col("b")))))
    drawn = F.when(F.col("is_against"), colour["contradiction"]).when(F.col("is_bridge"), colour["bridge"]).otherwise(colour["plain"])
    return met.select("a", "b", F.coalesce(T.missing_as_null(F.col("edge_type")), F.lit("co_occurs")).alias("edge_type"), drawn.alias("colour"))


#: Draws nodes on rings by community, and links in their colours.
SCRIPT = """
const g = JSON.parse(document.getElementById("graph").textContent), svg = document.querySelector("svg"), at = {};
const groups = [...new Set(g.nodes.map(n => n.community))], make = (k, o) => { const e = document.createElementNS(svg.namespaceURI, k); for (const x in o) e.setAttribute(x, o[x]); return svg.appendChild(e); };
const members = {}; g.nodes.forEach(n => (members[n.community] ||= []).push(n));
groups.forEach((c, i) => { const t = 2 * Math.PI * i / groups.length, r = groups.length > 1 ? 330 : 0;
  members[c].forEach((n, j) => { const s = 2 * Math.PI * j / members[c].length, q = 12 + 2 * members[c].length; at[n.id] = [500 + r * Math.cos(t) + q * Math.cos(s), 500 + r * Math.sin(t) + q * Math.sin(s), i]; }); });
g.links.forEach(l => make("line", {x1: at[l.a][0], y1: at[l.a][1], x2: at[l.b][0], y2: at[l.b][1], stroke: l.colour, "stroke-opacity": 0.5}));
g.nodes.forEach(n => { const e = make("circle", {cx: at[n.id][0], cy: at[n.id][1], r: 5, fill: `hsl(${at[n.id][2] * 137 % 360} 60% 55%)`}), t = document.createElementNS(svg.namespaceURI, "title"); t.textContent = `${n.name} (${n.type}) ${n.description}`; e.appendChild(t); });
"""


def graph_html(nodes: DataFrame, links: DataFrame, most_nodes: int = 500, most_links: int = 2000) -> str:
    """A page of the first nodes, coloured by ``community`` where they have one, and of the first ``links`` (``graph_links``) among them."""
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in nodes.columns else F.lit(default)
    shown = nodes.select("id", F.substring("name", 1, 40).alias("name"), optional("node_type", "").alias("type"), optional("community", 0).alias("community"), F.substring(optional("description", ""), 1, 200).alias("description"), "node_ord")
    kept = shown.orderBy("node_ord").limit(most_nodes)
    ids = kept.select("id")
    drawn = links.join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi").orderBy("a", "b").limit(most_links)
    data = {
        "nodes": [{"id": str(r.id), "name": r.name, "type": r.type, "community": str(r.community), "description": r.description} for r in kept.collect()],
        "links": [{"a": str(r.a), "b": str(r.b), "type": r.edge_type, "colour": r.colour} for r in drawn.collect()],
    }
    text = json.dumps(data).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><svg viewBox="0 0 1000 1000"></svg><script id="graph" type="application/json">{text}</script><script>{SCRIPT}</script>\n'
