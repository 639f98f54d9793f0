"""Deterministic stand-ins for the models that a run takes as parameters."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evigraph.functions import text as T

DIM = 64


def hashed_embedding(text: Column) -> Column:
    """A unit vector of hashed words; zeros for a text without any."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            vector = np.zeros(DIM, np.float32)
            for word in (t or "").lower().split():
                h = zlib.crc32(word.encode())
                vector[h % DIM] += 1 if h >> 16 & 1 else -1
            norm = np.linalg.norm(vector)
            out.append((vector / norm if norm else vector).tolist())
        return pd.Series(out)

    return embed(text)


def negation_scorer(a: Column, b: Column) -> Column:
    """Calls two texts a contradiction if one of them alone holds a negation."""
    negated = lambda x: F.rlike(F.lower(x), F.lit(r"\b(not|no|never|cannot|without|fails?)\b"))
    odd = negated(a) != negated(b)
    return T.classified(F.array(F.when(odd, 3.0).otherwise(0.0), F.lit(1.0), F.lit(0.5)))


def sentence_extractor(prompt: str) -> str:
    """An answer to an extraction prompt, in place of a model's: sentences are assertions, capitalised words are concepts."""
    answers = []
    for block in re.split(r"^--- DOCUMENT \d+ ---$", prompt, flags=re.M)[1:]:
        text = block.partition("Abstract: ")[2].strip()
        said = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]
        named = list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*", text)))
        relations = [{"source_name": a, "target_name": b, "relationship_type": "related_to"} for a, b in zip(named, named[1:])]
        answers.append({"assertions": [{"text": s} for s in said], "entities": [{"name": n, "entity_type": "method"} for n in named], "relationships": relations})
    return json.dumps(answers)


def asked(prompt: Column, ask: Callable[[str], str]) -> Column:
    """A model's answer to each prompt; null where it fails."""

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            try:
                out.append(ask(p))
            except (ValueError, KeyError, TypeError, OSError):
                out.append(None)
        return pd.Series(out, dtype="object")

    return answer(prompt)


def run_cost(documents: int, nodes: int, input_price: float = 0.25, output_price: float = 1.25) -> float:
    """Estimated dollars of an extraction: 200 tokens read a document and 50 written a node, at prices a million."""
    return (documents * 200 * input_price + nodes * 50 * output_price) / 1_000_000


#: A sentence or two for each pattern type; placeholders are named after what fills them.
TEMPLATES = {
    "bridge": "{community_a} and {community_b} meet at {bridge_entity}. {measured_pattern}",
    "contradiction": "'{assertion_a}' ({source_a}) against '{assertion_b}' ({source_b}).",
    "drift": "Over {time_windows}, clusters changed: {transitions}",
    "gap": "{gap_description}: recommended by {recommender_count} sources, carried out {execution_count} times.",
}


def pick(*values: Column) -> Column:
    """The first that is there and not empty, else a question mark."""
    return F.coalesce(*map(T.missing_as_null, values), F.lit("?"))


def context() -> dict[str, Column]:
    """What a pattern's columns and details have to say, by placeholder; what the details name themselves comes first."""
    detail = lambda key: F.try_element_at("details", F.lit(key))
    item = lambda items, at, key: F.try_element_at(F.col(items), F.lit(at)).getField(key)
    text = lambda items, at: F.when(F.size(items) >= at, F.substring(F.coalesce(item(items, at, "assertion_text"), F.lit("")), 1, 500))
    url = lambda items, at: F.when(F.size(items) >= at, F.coalesce(T.missing_as_null(item(items, at, "source_url")), F.lit("unknown")))
    u, v = pick(detail("bridge_node_u")), pick(detail("bridge_node_v"))
    windows = F.concat(pick(detail("from_window")), F.lit(" to "), pick(detail("to_window")))
    of = lambda kind, value: F.when(F.col("pattern_type") == kind, value)
    return {
        "title": F.col("title"),
        "measured_pattern": F.coalesce("measured_pattern", F.lit("")),
        "community_a": of("bridge", pick(detail("bridge_node_u"), detail("community_u"))),
        "community_b": of("bridge", pick(detail("bridge_node_v"), detail("community_v"))),
        "bridge_entity": of("bridge", F.when((u != "?") & (v != "?"), F.concat(u, F.lit(" and "), v)).otherwise(F.col("title"))),
        "assertion_a": of("contradiction", text("evidence", 1)),
        "source_a": of("contradiction", url("evidence", 1)),
        # A contradiction without a second side has it in the first one's second item.
        "assertion_b": of("contradiction", F.coalesce(text("counter_evidence", 1), text("evidence", 2))),
        "source_b": of("contradiction", F.coalesce(url("counter_evidence", 1), url("evidence", 2))),
        "time_windows": of("drift", F.coalesce(T.missing_as_null(detail("all_windows")), windows)),
        "transitions": of("drift", F.coalesce(detail("transitions"), F.lit(""))),
        "recommender_count": of("gap", pick(detail("recommendation_count"))),
        "execution_count": of("gap", pick(detail("execution_count"))),
        "gap_description": of("gap", F.coalesce(T.missing_as_null(detail("gap_node")), F.col("title"))),
    }


def interpretation(templates: dict[str, str] = TEMPLATES) -> Column:
    """The template of a pattern's type, filled from its details and columns; placeholders that nothing fills stay.

    Over the columns title, measured_pattern, pattern_type, evidence, counter_evidence and details (a map of strings)."""
    by_type = F.create_map(*(F.lit(x) for pair in sorted(templates.items()) for x in pair))
    template = F.coalesce(F.try_element_at(by_type, F.col("pattern_type")), F.lit(""))
    own = F.coalesce("details", F.create_map().cast("map<string,string>"))
    known = context()
    stays = lambda name: F.lit("{" + name + "}")
    filled = T.filled(template, {name: F.coalesce(F.try_element_at(own, F.lit(name)), value, stays(name)) for name, value in known.items()})
    # The rest of the details, under their own names.
    entries = F.filter(F.map_entries(own), lambda e: ~e["key"].isin(*known))
    return F.aggregate(entries, filled, lambda out, e: F.replace(out, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
