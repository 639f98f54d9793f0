"""Scalar functions as Column expressions; one Arrow function where Spark has no counterpart."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evigraph.functions import constants as C


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def missing_as_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def norm_title(x: Column) -> Column:
    return F.regexp_replace(strip(F.lower(x)), r"\.+$", "")


def norm_name(x: Column) -> Column:
    """Stripped before hyphens and underscores become spaces."""
    return F.translate(strip(F.lower(x)), "-_", "  ")


def dedup_key(doi: Column, openalex_id: Column, s2_id: Column) -> Column:
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    return (
        F.when(has(doi), F.concat(F.lit("doi:"), strip(F.lower(doi))))
        .when(has(openalex_id), F.concat(F.lit("oa:"), openalex_id))
        .when(has(s2_id), F.concat(F.lit("s2:"), s2_id))
    )


def source_of(own_url: Column, own_id: Column, own_tier: Column, of_document: Column) -> Column:
    """(id, url, tier) that an assertion is from: its own, or without a url the document's (a struct of the same names), or nothing."""
    whole = lambda i, u, t: F.struct(F.coalesce(i, F.lit("")).alias("id"), F.coalesce(u, F.lit("")).alias("url"), F.coalesce(t, F.lit(2)).cast("int").alias("tier"))
    none = whole(F.lit(""), F.lit(""), F.lit(2))
    own = F.coalesce(own_url, F.lit("")) != ""
    return F.when(own, whole(own_id, own_url, own_tier)).when(of_document.isNotNull(), whole(of_document["id"], of_document["url"], of_document["tier"])).otherwise(none)


def source_tier(family: Column, peer_reviewed: Column, kind: Column | None = None) -> Column:
    journal = F.lit(False) if kind is None else F.coalesce(kind == "journal", F.lit(False))
    first = F.coalesce(peer_reviewed, F.lit(False)) | journal
    return F.when(first, 1).when(family.isin("scholarly", "code"), 2).when(family == "web", 3).when(family == "social", 4).otherwise(3)


def _mapped(x: Column, names: dict[str, str], own: tuple[str, ...], default: str) -> Column:
    known = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    low = F.lower(x)
    return F.coalesce(F.try_element_at(known, low), F.when(low.isin(*own), low), F.lit(default))


def entity_type(x: Column) -> Column:
    return _mapped(x, C.ENTITY_TYPES, C.ENTITY_FALLBACK, "concept")


def edge_type(x: Column) -> Column:
    return _mapped(x, C.EDGE_NAMES, C.EDGE_TYPES, "co_occurs")


def text_of(description: Column, name: Column, length: int = 2000) -> Column:
    return F.substring(F.coalesce(missing_as_null(description), name), 1, length)


def year_of(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4))


def marks_future_work(text: Column, phrases: tuple[str, ...] = C.FUTURE_WORK) -> Column:
    return F.rlike(F.lower(text), F.lit("|".join(re.escape(p).replace("\\ ", " ") for p in phrases)))


def url_key(url: Column, node_id: Column) -> Column:
    return F.coalesce(missing_as_null(F.trim(url)), F.concat(F.lit("id:"), node_id))


def softmax(logits: Column) -> Column:
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


LABELS = ("contradiction", "entailment", "neutral")


def classified(logits: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The label of the largest logit (the first of equal ones) and each label's probability."""
    scores = softmax(logits)
    label = F.element_at(F.array(*map(F.lit, labels)), F.array_position(logits, F.array_max(logits)).cast("int"))
    return F.struct(label.alias("label"), *(F.element_at(scores, i + 1).alias(f"p_{x}") for i, x in enumerate(labels)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def long_words(x: Column, length: int = 5) -> Column:
    return F.filter(F.split(x, r"(?U)\W+"), lambda w: F.length(w) >= length)


def shares_words(a: Column, b: Column, length: int = 5) -> Column:
    """One name holds the other, or a word of at least ``length`` letters of one is in the other."""
    low_a, low_b = F.lower(a), F.lower(b)
    return words_shared(low_a, long_words(low_a, length), low_b, long_words(low_b, length))


def words_shared(low_a: Column, words_a: Column, low_b: Column, words_b: Column) -> Column:
    """``shares_words`` of names in lower case and their long words, worked out before."""
    return F.contains(low_a, low_b) | F.contains(low_b, low_a) | F.exists(words_a, lambda w: F.contains(low_b, w)) | F.exists(words_b, lambda w: F.contains(low_a, w))


def rebuilt_abstract(index: Column) -> Column:
    """Words to positions, to the text; equal positions by word."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(spots), lambda s: s["word"]), " ")


def letter_counts(strings: list[str], classes: int = 64) -> np.ndarray:
    """How often each class of letters is in each string."""
    return np.array([np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) % classes, minlength=classes) for s in strings], np.int32).reshape(-1, classes)


def likely_matches(new: list[str], existing: list[str], least: float, at_once: int = 20_000) -> np.ndarray:
    """Which pairs share enough letters, in whatever order, for their ratio to pass ``least``; none that does is left out."""
    number: dict[str, int] = {}
    left, right = (np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings)) for strings in (new, existing))
    counts = letter_counts(list(number))
    sizes = counts.sum(axis=1)
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), at_once):
        x, y = left[at : at + at_once], right[at : at + at_once]
        out[at : at + at_once] = 2 * np.minimum(counts[x], counts[y]).sum(axis=1) > least * (sizes[x] + sizes[y]) - 1e-9
    return out


def reached(matcher: SequenceMatcher, a: str, most: int = 4000) -> int:
    """How many letters of its second string, b, a matcher may match with ``a``, at most.

    In a long b it looks only for rare letters, so a block has one of them, or else is where both strings begin alike.  A block
    reaches no further from its rare letter than b and a agree around it, for any place of that letter in a."""
    b, rare = matcher.b, matcher.b2j
    places: dict[str, list[int]] = {}
    for i, letter in enumerate(a):
        if letter in rare:
            places.setdefault(letter, []).append(i)
    if sum(len(p) * len(rare[x]) for x, p in places.items()) > most:
        return len(b)
    shorter, first = min(len(a), len(b)), 0
    while first < shorter and a[first] == b[first]:
        first += 1
    spans = [(0, first)]
    for letter, found in places.items():
        for j in rare[letter]:
            left = right = 0
            for i in found:
                n = 1
                while n <= i and n <= j and a[i - n] == b[j - n]:
                    n += 1
                left, n = max(left, n - 1), 1
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                right = max(right, n)
            spans.append((j - left, j + right))
    total, end = 0, 0
    for begin, till in sorted(spans):
        total += max(0, till - max(begin, end))
        end = max(end, till)
    return total


def match_above(new: Column, existing: Column, least: float) -> Column:
    """The Ratcliff-Obershelp ratio where it passes ``least``, else 0; not symmetric, the new string comes first.

    Upper bounds come before the ratio itself: by letters, for all pairs at once, and for long strings by what a matcher looks at."""

    @F.pandas_udf(DoubleType())
    def ratio(new: pd.Series, existing: pd.Series) -> pd.Series:
        out = np.zeros(len(new))
        both = np.flatnonzero((new.notna() & existing.notna()).to_numpy())
        a, b = new.iloc[both].tolist(), existing.iloc[both].tolist()
        likely = np.flatnonzero(likely_matches(a, b, least))
        matcher, last = SequenceMatcher(), None
        # The second string is the one that a matcher prepares.
        for i in sorted(likely.tolist(), key=lambda i: b[i]):
            if b[i] != last:
                matcher.set_seq2(b[i])
                last = b[i]
            if len(b[i]) >= 200 and 2 * reached(matcher, a[i]) <= least * (len(a[i]) + len(b[i])):
                continue
            matcher.set_seq1(a[i])
            found = matcher.ratio()
            if found > least:
                out[both[i]] = found
        return pd.Series(out)

    return ratio(new, existing)


def may_match(a: Column, b: Column, ratio: float) -> Column:
    """An upper bound of ``match_ratio`` by length passes ``ratio``."""
    return 2 * F.least(F.length(a), F.length(b)) > ratio * (F.length(a) + F.length(b))


def stripped_fences(raw: Column, times: int = 5) -> Column:
    """A model's answer without its code fences; answers without any are only stripped."""
    bare = strip(raw)
    out = bare
    for _ in range(times):
        out = strip(F.regexp_replace(F.regexp_replace(out, r"^```[A-Za-z]*", ""), r"```$", ""))
    return F.when(F.startswith(bare, F.lit("```")), out).otherwise(bare)


def message_text(blocks: Column) -> Column:
    """The text blocks of a message, (type, text) structs, as one text."""
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    return strip(F.array_join(F.transform(texts, lambda b: b["text"]), ""))


def stringified(value: Column, kind: str) -> Column:
    """A template value as text: nested ones as JSON, null as nothing."""
    nested = kind.startswith(("array", "map", "struct"))
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders of known names replaced; others stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template
