"""Secret scan over a trigram inverted index (DataFrame functions only).

Each rule's regex is compiled, on the driver, to a Boolean query over trigrams of the lower-cased text: a disjunction of
sets of trigrams, one set for each string that a mandatory part of the regex can spell.  The index holds a posting
(trigram, doc_id) for every document and every trigram that any rule asks for.  Postings are intersected by counting, per
document and set, the trigrams found; a full set makes the document a candidate of the rule.  Candidates are verified with
the regex itself.  Rules without mandatory trigrams are run on every document.

Cases: a null text is empty; a null doc_id is indexed as an id of its own; rows repeated under one id share postings and
are verified one by one, so the result is the same as theirs alone; very long texts are scanned whole; an empty table
gives an empty result; extra columns pass through ``scan`` unless they carry a name that it adds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import BROADCAST_ROWS, ascii_lower, cut, others, packed, table, unpacked


@dataclass(frozen=True)
class Rule:
    """A regex in the syntax that Java, Python and RE2 share; ``group`` must have at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


def either_case(words: str) -> str:
    """A regex of lower-case letters with each letter matching in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


RULES = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", "[0-9a-f]{32,}", 0, 32, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
#: A part of a regex that can spell more strings than this is not written out.
MOST_STRINGS = 64


#: Escapes that stand for one character; those that stand for a place between two.
ESCAPES, EDGES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v"}, "bBAzZ"


class Pattern:
    """A regex as a tree: a sequence is a list of nodes, which are

    ("one", characters it may be, lower-cased, or None), ("edge",), ("group", sequences to choose from) and ("repeat", node, least, most or None)."""

    def __init__(self, regex: str) -> None:
        self.regex, self.at = regex, 0
        self.tree = self._choice()
        if self.at < len(regex):
            raise ValueError(f"unbalanced regex: {regex}")

    def _next(self) -> str:
        return self.regex[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.regex[self.at - 1 : self.at]

    def _choice(self) -> tuple:
        choices = [self._sequence()]
        while self._next() == "|":
            self._take()
            choices.append(self._sequence())
        return "group", choices

    def _sequence(self) -> list[tuple]:
        nodes = []
        while self._next() and self._next() not in "|)":
            nodes.append(self._repeated(self._node()))
        return nodes

    def _node(self) -> tuple:
        c = self._take()
        if c == "(":
            if self._next() == "?":
                if self.regex[self.at : self.at + 2] != "?:":
                    raise ValueError(f"not understood at {self.at}: {self.regex}")
                self.at += 2
            node = self._choice()
            if self._take() != ")":
                raise ValueError(f"unbalanced regex: {self.regex}")
            return node
        if c == "[":
            return self._class()
        if c == "\\":
            return self._escape()
        if c in "^$":
            return ("edge",)
        return "one", None if c == "." else frozenset(c.lower())

    def _escape(self) -> tuple:
        c = self._take()
        if c == "x":
            self.at += 2
            return "one", frozenset(chr(int(self.regex[self.at - 2 : self.at], 16)).lower())
        if c in EDGES:
            return ("edge",)
        return "one", frozenset(ESCAPES[c]) if c in ESCAPES else None if c.isalnum() else frozenset(c)

    def _class(self) -> tuple:
        """Characters in brackets; of ranges and classes, and of all but some, there are too many to write out."""
        found, many = set(), self._next() == "^"
        self.at += many
        first = True
        while first or self._next() != "]":
            c = self._take()
            if not c:
                raise ValueError(f"unbalanced regex: {self.regex}")
            one = self._escape()[1] if c == "\\" else frozenset(c.lower())
            if self._next() == "-" and self.regex[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                if self._take() == "\\":
                    self._escape()
                many = True
            many, first = many or one is None, False
            found |= one or frozenset()
        self._take()
        return "one", None if many else frozenset(found)

    def _repeated(self, node: tuple) -> tuple:
        while True:
            c = self._next()
            count = re.match(r"\{(\d+)(,?)(\d*)\}", self.regex[self.at :])
            if c and c in "?*+":
                self.at += 1
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            elif count:
                self.at += count.end()
                least = int(count[1])
                most = int(count[3]) if count[3] else None if count[2] else least
            else:
                return node
            # A mark that makes the repeat lazy changes which match is taken, not what is in it.
            if self._next() == "?":
                self._take()
            node = "repeat", node, least, most


def _strings(node: tuple) -> list[str] | None:
    """All lower-cased strings that a node can spell, or None if there are too many."""
    kind, *value = node
    if kind == "edge":
        return [""]
    if kind == "one":
        return None if value[0] is None else sorted(value[0])
    if kind == "group":
        each = [_spelled(sequence) for sequence in value[0]]
        return None if any(e is None for e in each) else sorted({s for e in each for s in e})
    inner, least, most = value
    one = _spelled([inner]) if most is not None and most <= 5 else None
    if one is None:
        return None
    found, run = set(), {""}
    for times in range(most + 1):
        if times >= least:
            found |= run
        run = {a + b for a in run for b in one}
        if len(found | run) > MOST_STRINGS:
            return None
    return sorted(found)


def _spelled(sequence: list[tuple]) -> list[str] | None:
    found = [""]
    for node in sequence:
        more = _strings(node)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = [a + b for a in found for b in more]
    return sorted(set(found))


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Sets of trigrams, one of which every match contains in full; None if no part of the regex demands any."""
    best: list[frozenset[str]] | None = None
    run: list[str] = [""]

    def close() -> None:
        nonlocal best
        sets = {trigrams(s) for s in run}
        if frozenset() in sets:
            return
        smallest = [s for s in sets if not any(t < s for t in sets)]
        if best is None or min(map(len, smallest)) > min(map(len, best)):
            best = smallest

    def walk(sequence: list[tuple]) -> None:
        nonlocal run
        for node in sequence:
            more = _strings(node)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = [a + b for a in run for b in more]
                continue
            close()
            run = [""]
            if more is not None:
                run = more
            elif node[0] == "group" and len(node[1]) == 1:
                walk(node[1][0])
            elif node[0] == "repeat" and node[2] >= 1:
                walk([node[1]])
                close()
                run = [""]

    walk([Pattern(regex).tree])
    close()
    return None if best is None else sorted(best, key=sorted)


def postings(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(doc_id, trigram) for every trigram of the vocabulary that a document's lower-cased text holds."""
    lower = docs.select("doc_id", ascii_lower("text").alias("lower"))
    # Spelled out, so that the text is lower-cased once and not for each trigram.
    held = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in vocabulary)))
    return lower.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """(doc_id, kinds): rules whose trigram query a document's postings satisfy; None if no rule has a query."""
    terms = [(rule.kind, f"{rule.kind}#{i}", t, len(s)) for rule in rules for i, s in enumerate(trigram_query(rule.regex) or ()) for t in s]
    if not terms:
        return None
    index = postings(docs, sorted({t for _, _, t, _ in terms}))
    # A posting is joined with the sets that want its trigram; the query side is as long as the rules, not the corpus.
    wanted = {}
    for kind, clause, trigram, size in terms:
        wanted.setdefault(trigram, []).append((kind, clause, size))
    entries = F.create_map(
        *(
            x
            for trigram, uses in sorted(wanted.items())
            for x in (F.lit(trigram), F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(n).alias("size")) for k, c, n in uses)))
        )
    )
    uses = index.select("doc_id", "trigram", F.inline(F.element_at(entries, F.col("trigram"))))
    # One document has at most as many postings as there are terms; sums are combined before the shuffle.
    full = uses.groupBy("doc_id", "kind", "clause", "size").agg(F.count_distinct("trigram").alias("found")).where("found = size")
    return full.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


SPAN = "array<struct<start:int,place:int,kind:string,stop:int,base:boolean>>"


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches with a long enough group.

    The pieces between matches and the matches tile the text, so their lengths give every position."""
    regex = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    groups = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matches
    lengths = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.length).alias("match"), F.transform(groups, F.length).alias("group"))
    none = F.array().cast(SPAN)
    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + F.coalesce(x["match"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), stop.alias("stop"), F.lit(rule.base).alias("base"))
        found = F.when(x["group"] >= rule.least, F.array(span).cast(SPAN)).otherwise(none)
        return F.struct(stop.alias("at"), F.concat(state["spans"], found).cast(SPAN).alias("spans"))

    # Most texts have no match, which one search tells.
    return F.when(F.rlike(text, regex), F.aggregate(lengths, empty, step, lambda s: s["spans"])).otherwise(none)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``found``: spans ordered by start, then by the rules' order.

    Candidates are few as long as secrets are; up to ``BROADCAST_ROWS``, counted first, they are sent to the texts.  More of them are
    joined, with the texts alone that hold any posting.  Rules without a trigram query run where the text is."""
    kept = others(docs, ["found"])
    whole = packed(docs, doc_id=F.col("doc_id"), text=F.coalesce("text", F.lit("")))
    none = F.array().cast(SPAN)

    def verified(frame: DataFrame, kinds: Column | None) -> DataFrame:
        spans = []
        for i, rule in enumerate(rules):
            if trigram_query(rule.regex) is None:
                spans.append(rule_spans(F.col("text"), rule, i))
            elif kinds is not None:
                spans.append(F.when(F.array_contains(kinds, rule.kind), rule_spans(F.col("text"), rule, i)).otherwise(none))
        return unpacked(frame, kept, found=F.array_sort(F.concat(*spans)) if spans else none)

    wanted = candidates(whole.select("doc_id", "text"), rules)
    if wanted is None:
        return verified(whole, None)
    wanted = cut(wanted.select(F.col("doc_id").alias("of"), "kinds"))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    if wanted.count() <= BROADCAST_ROWS:
        return verified(whole.join(F.broadcast(wanted), same, "left"), F.col("kinds"))
    terms = sorted({t for rule in rules for s in trigram_query(rule.regex) or () for t in s})
    lowered = whole.withColumn("lower", ascii_lower("text"))
    holds = F.array_contains(F.array(*(F.contains("lower", F.lit(t)) for t in terms)), True)
    return verified(lowered.where(holds).join(wanted, same, "left"), F.col("kinds")).unionByName(verified(lowered.where(~holds), None))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in RULES if r.base),
        F.sha2(span_text(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
    )


def _sql_spans(i: int, rule: Rule) -> str:
    regex = rule.regex.replace("'", "''")
    group = f"regexp_extract_all(t, '{regex}', {rule.group})"
    return f"""
  SELECT doc_id, row, {i} AS place, '{rule.kind}' AS kind, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS start, length(m[k]) AS n, {str(rule.base).lower()} AS base
  FROM (SELECT doc_id, row, m, g, c, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT doc_id, row, regexp_extract_all(t, '{regex}') AS m, {group} AS c, string_split_regex(t, '{regex}') AS g FROM texts)) WHERE length(c[k]) >= {rule.least}"""


_BASE = [(i, r) for i, r in enumerate(RULES) if r.base]
ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
spans AS ({' UNION ALL '.join(_sql_spans(i, r) for i, r in enumerate(RULES))}),
told AS (SELECT row, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for _, r in _BASE)},
  coalesce(string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, place) FILTER (base), '') AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, place) AS spans FROM spans GROUP BY row)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for _, r in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (row)
"""
