"""Domain packs: the dictionaries, rules and templates by which a run reads one domain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import constants as C
from evigraph.functions import models, planning
from evigraph.functions import text as T

PROMPT = (
    "List what the documents claim. Answer with a JSON array of one object a document, in order, each with assertions (text, conditions, polarity), entities (name, entity_type, description)"
    " and relationships (source_name, target_name, relationship_type); nothing else.\n"
)


def research_tier(docs: DataFrame) -> Column:
    return T.source_tier(F.col("source_family"), F.col("is_peer_reviewed"), F.col("source_type") if "source_type" in docs.columns else None)


@dataclass(frozen=True)
class DomainPack:
    """What differs between domains; all of it as data or as Columns, so that plans stay declarative."""

    domain: str
    entity_types: dict[str, str] = field(default_factory=lambda: dict(C.ENTITY_TYPES))
    edge_types: dict[str, str] = field(default_factory=lambda: dict(C.EDGE_NAMES))
    tier_rules: dict[str, int] = field(default_factory=lambda: dict(C.TIER_RULES))
    prompt: str = PROMPT
    templates: dict[str, str] = field(default_factory=lambda: dict(models.TEMPLATES))
    connectors: Callable[[dict[str, str]], tuple[str, ...]] = planning.connectors_for
    classify_tier: Callable[[DataFrame], Column] = research_tier
    #: Prose made of a filled template; the template itself where there is no writer, or where it fails.
    write: Callable[[Column], Column] | None = None

    def interpret(self) -> Column:
        """The interpretation of a pattern, over its columns."""
        filled = models.interpretation(self.templates)
        return filled if self.write is None else F.coalesce(T.missing_as_null(self.write(filled)), filled)

    def schema(self, spark: SparkSession) -> DataFrame:
        """(kind, name, value): the dictionaries as a dimension table."""
        kinds = {"entity_type": self.entity_types, "edge_type": self.edge_types, "tier_rule": self.tier_rules, "template": self.templates}
        return spark.createDataFrame([(kind, name, str(value)) for kind, names in kinds.items() for name, value in names.items()], "kind string, name string, value string")


PACKS: dict[str, DomainPack] = {"research": DomainPack("research")}


def domain_key(raw: Column) -> Column:
    """A domain's name: trimmed, lower-cased, with hyphens for blanks and underscores, aliases resolved."""
    folded = F.regexp_replace(T.strip(F.lower(F.coalesce(raw, F.lit("")))), r"(?U)[\s_]+", "-")
    known = F.create_map(*(F.lit(x) for pair in C.DOMAIN_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, folded), folded)


def resolve_pack(spark: SparkSession, domain: str | None = None) -> DomainPack:
    """The pack of a domain; the first one for a name that has none."""
    key = spark.range(1).select(domain_key(F.lit(domain)).alias("key")).first().key
    return PACKS.get(key, next(iter(PACKS.values())))
