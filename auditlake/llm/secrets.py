"""Secret scans behind a trigram inverted index, in DataFrame operations only.

Each rule's regex gives a Boolean query: the trigrams that any match must hold, as alternatives of conjunctions. The
index posts documents under those trigrams; intersecting postings gives each rule's candidates, and only they are
verified. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize


@dataclass(frozen=True)
class Rule:
    """kind, a regex that Java and Python read alike, the group to measure and its least length in code points."""

    kind: str
    regex: str
    group: int
    least: int


#: Fixed patterns: the three base kinds, then further vendor shapes.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", r"-----BEGIN[A-Z\x20]*PRIVATE KEY-----", 0, 27),
)


def _strings(tree, limit: int = 64) -> list[str]:
    """Alternatives for what a match holds, in lower case: literals, with NUL where anything may stand."""
    out = [""]
    for op, arg in tree:
        if op is sre.LITERAL:
            more = [chr(arg).lower()]
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            more = sorted({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            more = _strings(arg[3], limit)
        elif op is sre.BRANCH:
            more = [s for branch in arg[1] for s in _strings(branch, limit)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            once = _strings(inner, limit)
            more = ["", *once] if (least, most) == (0, 1) else [s + ("" if most == 1 else "\0") for s in once] if least else ["\0"]
        elif op is sre.AT:
            more = [""]
        else:
            more = ["\0"]
        out = [a + b for a in out for b in more] if len(out) * len(more) <= limit else [a + "\0" for a in out]
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives of trigrams (in lower case) that a text with a match holds all of; [] if a match need not hold any."""
    grams = {frozenset(part[i : i + 3] for part in s.split("\0") for i in range(len(part) - 2)) for s in _strings(sre_parse.parse(regex))}
    if not grams or frozenset() in grams:
        return []
    return sorted((g for g in grams if not any(other < g for other in grams)), key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str) -> DataFrame:
    """(key, rules): for rows that hold all trigrams of some alternative of a rule, the places of those rules."""
    clauses = [(i, c) for i, rule in enumerate(rules) for c in trigram_query(rule.regex)]
    grams = sorted(set().union(*(c for _, c in clauses)))
    held = F.filter(F.lit(grams), lambda g: F.contains(F.col("low"), g))
    postings = docs.select(key, F.lower("text").alias("low")).select(key, F.explode(held).alias("gram"))
    asked = docs.sparkSession.createDataFrame([(n, i, len(c), g) for n, (i, c) in enumerate(clauses) for g in sorted(c)], "clause int, rule int, needed int, gram string")
    met = postings.join(F.broadcast(asked), "gram")  # as many rows as the rules have trigrams
    full = met.groupBy(key, "clause", "rule", "needed").agg(F.count("*").alias("n")).where("n = needed")
    return full.groupBy(key).agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, place: int, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule that are long enough: array of (start, place, end) in code points."""
    matches, parts = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    measured = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,place:int,end:int>>)").alias("s"))

    def step(a, x):
        start = a["at"] + F.length(x["part"])
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["group"]) >= rule.least, F.concat(a["s"], one)).otherwise(a["s"]).alias("s"))

    zipped = F.filter(F.arrays_zip(parts.alias("part"), matches.alias("match"), measured.alias("group")), lambda x: x["match"].isNotNull())
    return F.aggregate(zipped, empty, step, lambda a: a["s"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's doc_id, text and ``found``: array of (start, place, end), by start and then place of the rule.

    Null texts are empty. One row for each row of docs, whatever the doc_ids: texts that share a doc_id share candidates. Rules read as the base
    kinds say: matches that are too short are dropped and not retried.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<struct<start:int,place:int,end:int>>)")
    # written first: so its size is known, and a small table of candidates meets the texts where they are
    marked = materialize(candidates(docs.where("doc_id is not null"), rules, "doc_id"), "candidates")
    joined = docs.join(marked, "doc_id", "left")
    found = []
    for place, rule in enumerate(rules):
        if trigram_query(rule.regex):
            test = F.array_contains("rules", place) | F.col("doc_id").isNull()
        else:
            whole = rule.regex[:-1] if rule.regex.endswith("+") and rule.group == 0 else None  # a run of one class
            test = F.col("text").rlike(f"{whole}{{{rule.least}}}") if whole else F.lit(True)
        found.append(F.when(F.coalesce(test, F.lit(False)), spans(F.col("text"), place, rule)).otherwise(none))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"))


def joined(found: Column, rules: tuple[Rule, ...], only: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    names = F.lit([r.kind for r in rules])
    some = found if only is None else F.filter(found, lambda s: F.element_at(names, s["place"] + 1).isin(*only))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"], s["end"])), ",")


def count(found: Column, place: int) -> Column:
    return F.size(F.filter(found, lambda s: s["place"] == place)).cast("long")
