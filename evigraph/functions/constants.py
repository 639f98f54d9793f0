"""Closed domains and fixed word lists of the data model."""

# Node, edge, tier, confidence and pattern domains.
NODE_TYPES = ("source_document", "assertion", "actor", "concept", "artifact", "metric", "event")
EDGE_TYPES = ("asserts", "supports", "contradicts", "involves", "produces", "evaluates", "associated_with", "extends", "co_occurs", "precedes", "bridges_to", "recommends")
PATTERN_TYPES = ("bridge", "contradiction", "drift", "gap")
FAMILIES = ("scholarly", "code", "web", "social")

# Names that extraction may use for node types.
ENTITY_TYPES = {
    "paper": "source_document", "claim": "assertion", "author": "actor", "lab": "actor", "organization": "actor", "method": "concept", "technique": "concept", "algorithm": "concept",
    "dataset": "artifact", "benchmark": "artifact", "model": "artifact", "repository": "artifact", "tool": "artifact", "citation_count": "metric", "accuracy": "metric", "f1_score": "metric",
    "publication": "event", "benchmark_release": "event",
}
# Names that stand for themselves where the table above has none.
ENTITY_FALLBACK = ("concept", "actor", "artifact", "metric")
# Names that extraction may use for edge types.
EDGE_NAMES = {
    "cites": "asserts", "claims": "asserts", "authored_by": "involves", "evaluated_on": "evaluates", "implemented_in": "produces", "builds_on": "extends", "related_to": "co_occurs",
    "suggests_future_work": "recommends",
}
# Tiers by kind of source, a dimension for users.
TIER_RULES = {
    "peer_reviewed": 1, "official_benchmark": 1, "official_documentation": 1, "first_party_report": 1, "arxiv_preprint": 2, "credible_analysis": 2, "implementation_writeup": 2,
    "benchmark_replication": 2, "vendor_blog": 3, "newsletter": 3, "general_article": 3, "forum_post": 4, "social_media": 4, "unverified_commentary": 4,
}
# Phrases that mark future work.
FUTURE_WORK = (
    "future work", "future research", "should be explored", "remains to be", "open problem", "further research", "has not been", "yet to be", "underexplored", "under-explored", "needs further",
    "warrants further", "calls for", "promising direction", "promising avenue", "not yet been", "largely unexplored", "remains unclear", "limited attention", "deserves more", "gap in",
    "challenge remains", "challenges remain", "not well understood", "poorly understood", "more research is needed", "open challenge", "open question", "unresolved", "worth investigating",
    "worth exploring", "important direction",
)
# Words that make a topic one of research; some never match a lower-cased topic.
RESEARCH_KEYWORDS = (
    "research", "paper", "study", "algorithm", "framework", "model", "benchmark", "dataset", "architecture", "neural", "transformer", "machine learning", "deep learning", "NLP", "computer vision",
    "reinforcement learning", "optimization", "distributed systems", "database", "compiler", "operating system", "network protocol", "security", "cryptography", "software engineering", "API",
    "microservice", "kubernetes", "cloud", "serverless", "edge computing", "LLM", "GPT", "BERT", "diffusion", "generative", "agent", "retrieval", "RAG", "knowledge graph", "embedding",
    "fine-tuning", "evaluation", "scaling", "inference", "training", "pretraining",
)
# Words that queries leave out, and words that call for code hosts.
FILLERS = ("and", "or", "the", "of", "in", "for", "with", "vs", "versus", "a", "an", "to", "on", "debate")
CODE_WORDS = ("framework", "library", "tool", "sdk", "api", "implementation")
# Verdicts by which refinement drops a contradiction.
DROPPED_VERDICTS = ("apparent", "non_contradiction", "not_contradictory", "none", "no")
# Kinds of work that count as peer-reviewed.
REVIEWED_TYPES = ("journal-article", "proceedings-article")
# Names of the one domain, the empty one included.
DOMAIN_ALIASES = {"": "research", "technical": "research", "papers": "research", "scholarly": "research", "science": "research", "default": "research"}
# Connectors in the order that they are asked in, each with the key that it can't do without.
CONNECTOR_KEYS = {"openalex": None, "semantic_scholar": None, "arxiv": None, "github": "GITHUB_TOKEN", "web_search": "TAVILY_API_KEY"}
# Documents at most by depth of a search; queries that a topic gets besides its own.
DEPTHS = {"quick": 50, "standard": 100, "deep": 200}
ENDINGS, ALWAYS_ASKED, DRIFT_ASKED = ("survey", "review"), ("benchmark evaluation",), ("recent advances", "emerging trends")
# Colours of links in the graph page.
LINK_COLOURS = {"plain": "#999", "bridge": "#EF9F27", "contradiction": "#E24B4A"}

TITLE_RATIO, NAME_RATIO, MERGE_COSINE, RELEVANCE = 0.9, 0.75, 0.85, 0.25
PAIR_COSINE, CONTRADICTION_P, PAIR_LIMIT, DUPLICATE_COSINE = 0.4, 0.7, 2000, 0.8
BRIDGE_BAND, BRIDGE_NEAR, TOP = (0.4, 0.8), 0.7, 10
