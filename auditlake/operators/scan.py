"""Text scans for secrets and prompt-injection markers."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import REF, ref
from .folding import variants

#: Fixed patterns: the families of secrets in their fixed order.
SECRETS = {
    "aws-access-key-id": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "jwt": r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}\b",
    "pem-private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "sk-prefixed-api-key": r"\bsk-[A-Za-z0-9_-]{10,}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "github-fine-grained-pat": r"\bgithub_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}\b",
    "github-fine-grained-pat-defensive": r"\bgithub_pat_(?=[A-Za-z0-9_]{40,}\b)(?=[A-Za-z0-9_]*[0-9])(?=[A-Za-z0-9_]*[a-z])(?=[A-Za-z0-9_]*[A-Z])[A-Za-z0-9_]+\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "bearer-header": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}",
    "url-userinfo": r"(?<=://)[^\s:/?#@]{1,128}:[^\s/?#@]{1,128}(?=@(?:\[[0-9A-Fa-f:.]{2,45}\]|[\w.-]{1,255})(?::\d{1,5})?(?![\w.:-]))",
    "secret-assignment": r"""(?i)(?<![\w-])-{0,2}(?:password|passwd|secret|token|api[_-]?key)["']?\s*[:=]\s*(?:"[^"\s]+"|'[^'\s]+'|\S+)""",
    "secret-assignment-affixed": r"""(?i)(?<![\w-])(?:[A-Za-z0-9_-]{0,62}[_-])?(?:password|passwd|secret|token|api[_-]?key)(?:[_-][A-Za-z0-9_-]{0,62})?["']?\s*[:=]\s*(?:["'](?:(?=[^\s"']{0,255}\d)[^\s"']{8,}|[^\s"']{16,})["']|(?=\S{0,255}\d)\S{8,}|\S{16,})""",
    "secret-assignment-camel": r"""(?:(?<![\w-])(?:password|passwd|secret|token|credential)|Password|Passwd|Secret|Token|ApiKey|Credential)(?:[A-Z0-9][A-Za-z0-9]{0,62})?["']?\s*[:=]\s*(?:["'](?:(?=[^\s"']{0,255}\d)[^\s"']{8,}|[^\s"']{16,})["']|(?=\S{0,255}\d)\S{8,}|\S{16,})""",
    "credential-flag-value": r"(?i)(?<![\w-])-{1,2}(?:[A-Za-z0-9-]{0,62}-)?(?:password|passwd|secret|token|api-?key)(?:-[A-Za-z0-9-]{0,62})?[ \t]+(?:(?=\S{0,255}\d)[^\s<$]\S{5,}|[^\s<$]\S{15,})",
}
#: Those that look around their match, which not every regular expression engine can.
_AROUND = ("github-fine-grained-pat-defensive", "url-userinfo", "secret-assignment", "secret-assignment-affixed", "secret-assignment-camel", "credential-flag-value")
SECRET_FAMILIES = {n: p for n, p in SECRETS.items() if n not in _AROUND}
CONTEXT_FAMILIES = {n: p for n, p in SECRETS.items() if n in _AROUND}
ALL_SECRETS = SECRETS

#: Fixed patterns: phrases that try to steer a model.
INJECTION_FAMILIES = {
    "ignore-previous-instructions": r"(?i)\bignore\s+(?:all\s+|any\s+|the\s+|your\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?)\b",
    "disregard-previous-instructions": r"(?i)\bdisregard\s+(?:all\s+|any\s+|the\s+|your\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?)\b",
    "forget-previous-instructions": r"(?i)\bforget\s+(?:all\s+|any\s+|the\s+|your\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?)\b",
    "system-override": r"(?i)\bsystem\s+override\b",
    "developer-mode": r"(?i)\byou\s+are\s+now\s+(?:in\s+)?(?:developer|debug|god|unrestricted|jailbreak)\s+mode\b",
    "hide-this-instruction": r"(?i)\bdo\s+not\s+(?:mention|tell|reveal|disclose|show)\s+(?:this|these|the\s+above|the\s+following)\s+(?:steps?|instructions?|messages?|notes?)\b",
    "html-comment-directive": r"(?i)<!--[^<>]{0,300}?\b(?:instructions?|must|override|ignore|disregard)\b[^<>]{0,300}?-->",
    "important-directive": r"(?i)\bIMPORTANT:\s*(?:you\s+must|always|never|do\s+not)\b",
    "new-instructions": r"(?i)\byour\s+(?:new|real|actual|true)\s+(?:instructions?|task|objective|goal)\s+(?:is|are)\b",
    "reveal-system-prompt": r"(?i)\b(?:reveal|print|show|repeat|output|display|leak)\s+(?:your|the)\s+(?:system|initial|hidden)\s+(?:prompt|instructions?)\b",
    "exfiltrate-to-url": r"(?i)\b(?:exfiltrate|send|post|upload|forward|transmit)\s+(?:all\s+|the\s+|these\s+|this\s+|any\s+)?(?:contents?|files?|data|secrets?|keys?|tokens?|credentials|results?|conversation|history)\s+to\s+https?://",
    "address-the-ai": r"(?i)\bif\s+you\s+are\s+an?\s+(?:ai|llm|language\s+model|(?:ai\s+)?assistant|agent)\b",
}


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def column_name(family: str) -> str:
    return "n_" + family.replace("-", "_")


def family_counts(rows: DataFrame, text: str, families: dict[str, str]) -> DataFrame:
    """rows with a count column for each family; null texts hold none. A family's pattern is only tried on texts that have what it needs."""
    lowered = rows.withColumn("_lower", F.lower(text))
    count = lambda name, p: F.when(_has_literal(F.col("_lower"), {name: p}), F.regexp_count(F.col(text), F.lit(p)))
    return lowered.select(*rows.columns, *[F.coalesce(count(name, p), F.lit(0)).alias(column_name(name)) for name, p in families.items()])


#: The text in place of an injection, the digits of a reference kept in a marker, the references kept of a result.
INJECTION_MARKER = "[gateway: suspected prompt injection removed]"
MARKER_DIGITS, MOST_REFS = 16, 8
#: What an assigned value is when it is no secret: a template or a shell variable, a mere sign, a type or another word, a piece of
#: code. The value is looked at as it stands and within its quotes, and only so far as the last number says.
_ASSIGNED = re.compile(r"[:=]\s*(?P<value>.*)", re.ASCII | re.DOTALL)
_QUOTED = re.compile(r"""(["'])(?P<inner>.*)\1""", re.DOTALL)
_TEMPLATE = re.compile(r"\$[{(]|<|\$[A-Z_][A-Za-z0-9_]*\W*$", re.ASCII)
_SIGNS = re.compile(r"[^A-Za-z0-9]*")
_WORD = {True: re.compile(r"[A-Za-z]+\W*", re.ASCII), False: re.compile(r"[A-Za-z]+\W+", re.ASCII)}  # by whether any value may be one
_CALL = re.compile(r"[A-Za-z0-9_$][ \t]*[(\[]")
_CODE = re.compile(r"[.,;'\"`${}\s]|[)\]]$", re.ASCII)
_SHAPE_CAP = 512


def is_code(matched: str, bare: bool) -> bool:
    """Whether an assignment's value is code, a placeholder or a type rather than a secret; ``bare``: the family without demands on the value."""
    found = _ASSIGNED.search(matched)
    if not found:
        return False
    value = found["value"]
    quoted = _QUOTED.fullmatch(value)
    inner = quoted["inner"] if quoted else value
    head = inner[:_SHAPE_CAP]
    return (
        any(_TEMPLATE.match(v) for v in (value, inner))
        or bool(_SIGNS.fullmatch(value))
        or len(value) <= _SHAPE_CAP and bool(_WORD[bare].fullmatch(value))
        or "`" in head
        or bool(_CALL.search(head) and _CODE.search(head))
    )


#: Where matches of the families can begin, as their patterns have it: at one of the literals; behind one; or at the start of a run
#: of word characters and dashes that holds one near its start. Lower-case literals of patterns that ignore case.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api-key", "api_key")
_CAMEL = ("password", "passwd", "secret", "token", "credential", "Password", "Passwd", "Secret", "Token", "ApiKey", "Credential")
STARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "aws-access-key-id": ("at", ("AKIA", "ASIA")),
    "jwt": ("run-once", ("eyJ",)),
    "pem-private-key": ("at", ("-----BEGIN ",)),
    "sk-prefixed-api-key": ("at", ("sk-",)),
    "github-token": ("at", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    "github-fine-grained-pat": ("at", ("github_pat_",)),
    "github-fine-grained-pat-defensive": ("at", ("github_pat_",)),
    "slack-token": ("at", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-")),
    "bearer-header": ("any-case", ("bearer",)),
    "url-userinfo": ("behind", ("://",)),
    "secret-assignment": ("run", _KEYWORDS),
    "secret-assignment-affixed": ("run", _KEYWORDS),
    "secret-assignment-camel": ("at", _CAMEL),
    "credential-flag-value": ("run", _KEYWORDS),
    "ignore-previous-instructions": ("any-case", ("ignore",)),
    "disregard-previous-instructions": ("any-case", ("disregard",)),
    "forget-previous-instructions": ("any-case", ("forget",)),
    "system-override": ("any-case", ("system",)),
    "developer-mode": ("any-case", ("you",)),
    "hide-this-instruction": ("any-case", ("do",)),
    "html-comment-directive": ("any-case", ("<!--",)),
    "important-directive": ("any-case", ("important:",)),
    "new-instructions": ("any-case", ("your",)),
    "reveal-system-prompt": ("any-case", ("reveal", "print", "show", "repeat", "output", "display", "leak")),
    "exfiltrate-to-url": ("any-case", ("exfiltrate", "send", "post", "upload", "forward", "transmit")),
    "address-the-ai": ("any-case", ("if",)),
}
_KNOWN = {**SECRETS, **INJECTION_FAMILIES}
#: Lower-case literals of which a text needs one to hold a secret of any family.
SECRET_LITERALS = tuple(sorted({w.lower() for f in SECRETS for w in STARTS[f][1]}))
_RUN = re.compile(r"[\w-]*", re.ASCII)
_FAR = 70  # beyond what a pattern allows between the start of a run and its literal


def _in_run(c: str) -> bool:
    return c in "-_" or c.isascii() and c.isalnum()


class HeldText:
    """A text with its lower-case form and where literals stand in it, found once."""

    def __init__(self, text: str):
        self.text = text
        self.lower = text.lower()
        if len(self.lower) != len(text):
            self.lower = "".join(c.lower() if c.isascii() else c for c in text)
        self.places: dict[tuple, list[int]] = {}

    def starts(self, how: str, literals: tuple[str, ...]) -> list[int]:
        key = (how in ("any-case", "run"), literals, how)
        if key not in self.places:
            text, out = self.lower if key[0] else self.text, []
            for w in literals:
                i = text.find(w)
                while i >= 0:
                    out.append(i + (len(w) if how == "behind" else 0))
                    i = text.find(w, i + 1)
            out.sort()
            self.places[key] = self._runs(out) if how == "run" else out
        return self.places[key]

    def _runs(self, places: list[int]) -> list[int]:
        out, end = [], 0
        for p in places:
            if p >= end:
                s, end = p, _RUN.match(self.text, p).end()
                while s > 0 and p - s <= _FAR and _in_run(self.text[s - 1]):
                    s -= 1
                if s == 0 or not _in_run(self.text[s - 1]):
                    out.append(s)
        return out

    def matches(self, family: str, pattern: str):
        """The matches of a family's pattern, as finditer gives them."""
        compiled = _compiled(pattern)
        if _KNOWN.get(family) != pattern:
            yield from (m for m in compiled.finditer(self.text) if m.end() > m.start())
            return
        how, literals = STARTS[family]
        end = 0
        for p in self.starts(how, literals):
            if p < end:
                continue
            if m := compiled.match(self.text, p):
                yield m
                end = m.end()
            elif how == "run-once" and (p == 0 or not _in_run(self.text[p - 1]) or self.text[p - 1] == "-"):
                end = _RUN.match(self.text, p).end()  # a later start in the run meets the same end


def may_hold(text: Column, families: dict[str, str]) -> Column:
    """Whether a text has a literal that one of the families has to have; without it no match is possible."""
    return _has_literal(F.lower(text), families)


def _has_literal(lower: Column, families: dict[str, str]) -> Column:
    literals = sorted({w.lower() for f in families if f in STARTS for w in STARTS[f][1]}) if all(f in STARTS for f in families) else []
    literals = [w for w in literals if not any(v != w and v in w for v in literals)]
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in literals]), F.lit(False)) if literals else lower.isNotNull()


_UNFOLDED = r"[^\x09-\x0D\x20-\x7E]"  # characters that folding drops or turns into others


@dataclass(frozen=True)
class Scanner:
    """Finds secrets and injections in texts. ``synthetic``: a prefix of placeholder tokens that are never secrets."""

    secrets: tuple[tuple[str, str], ...] = tuple(SECRETS.items())
    injections: tuple[tuple[str, str], ...] = tuple(INJECTION_FAMILIES.items())
    synthetic: str | None = None

    def raw_secrets(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, family) of each family's matches in turn, without those that are code or overlap a placeholder token."""
        out, held = [], HeldText(text)
        for family, pattern in self.secrets:
            for m in held.matches(family, pattern):
                if not (family.startswith("secret-assignment") and is_code(m[0], family == "secret-assignment")):
                    out.append((m.start(), m.end(), family))
        if self.synthetic and out:
            taken = [m.span() for m in re.finditer(re.escape(self.synthetic) + "[A-Za-z0-9_-]*", text)]
            out = [s for s in out if not _meets(taken, s[0], s[1])]
        return out

    def sieve(self, text: Column, secrets: bool = True, injections: bool = False) -> Column:
        """The text if it may hold what is looked for, else null: only such texts go to Python."""
        may = may_hold(text, dict(self.secrets)) if secrets else F.lit(False)
        if injections:
            may = may | may_hold(text, dict(self.injections)) | F.coalesce(text.rlike(_UNFOLDED), F.lit(False))
        return F.when(may, text)

    def secret_spans(self, text: str) -> list[tuple[int, int]]:
        return merged([(a, b) for a, b, _ in self.raw_secrets(text)])

    def injection_spans(self, text: str) -> list[tuple[int, int]]:
        """Merged spans of injections in all folded forms of the text, at their places in the text."""
        found = []
        for form in variants(text):
            held = HeldText(form.text)
            found += [form.back(m.start(), m.end()) for family, p in self.injections for m in held.matches(family, p)]
        return merged(found)

    def redacted(self, text: str, secrets: bool = True, injections: bool = False) -> str:
        """Each secret by the head of its own reference, each injection by a fixed text; where they overlap, as a secret."""
        found = self.secret_spans(text) if secrets else []
        out, at = [], 0
        for start, end in merged(found + (self.injection_spans(text) if injections else [])):
            secret = _meets(found, start, end)
            mark = f"[redacted:{REF}{hashlib.sha256(text[start:end].encode()).hexdigest()[:MARKER_DIGITS]}]" if secret else INJECTION_MARKER
            out += [text[at:start], mark]
            at = end
        return "".join(out) + text[at:]


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the spans, sorted and apart, overlaps the range."""
    i = bisect_right(spans, start, key=lambda s: s[1])
    return i < len(spans) and spans[i][0] < end


@lru_cache(maxsize=256)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one; touching ones stay apart."""
    out: list[tuple[int, int]] = []
    for start, back in sorted((a, -b) for a, b in spans if b > a):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], -back))
        else:
            out.append((start, -back))
    return out


def span_columns(text: Column, scanner: Scanner = Scanner()) -> Column:
    """Secret spans of a text with their families, as they match: array of (start, end, family) in code points."""

    @F.arrow_udf("array<struct<start:int,end:int,family:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string())]))
        return pa.array([[{"start": a, "end": b, "family": f} for a, b, f in scanner.raw_secrets(t)] if t else [] for t in texts.to_pylist()], kind)

    return spans(scanner.sieve(text))


def redact(text: Column, scanner: Scanner = Scanner(), secrets: bool = True, injections: bool = False) -> Column:
    """The text with its secrets (and injections) replaced."""

    @F.arrow_udf("string")
    def marked(texts: pa.Array) -> pa.Array:
        return pa.array([scanner.redacted(t, secrets, injections) if t else t for t in texts.to_pylist()], pa.string())

    return F.coalesce(marked(scanner.sieve(text, secrets, injections)), text)


def redact_with_refs(text: Column, families: dict[str, str]) -> Column:
    """The text with each merged span of matches replaced by the first 16 hex digits of its own reference."""
    return redact(text, Scanner(tuple(families.items())))


def verdict(slots: DataFrame, message: str, text: str, secrets: str = "redact", injection: str = "flag", most_bytes: int = 1 << 20, on_oversize: str = "flag", scanner: Scanner = Scanner()) -> DataFrame:
    """Each message's findings over its content slots, and the action: block before redact before flag before none.

    ``secrets`` and ``injection`` are redact, block, flag or off (not looked for). A message with more than ``most_bytes`` (the
    filter's own limit) in all is not scanned: it is flagged or blocked, as ``on_oversize`` says. Counts are of merged spans;
    secret_refs holds up to 8 references of matches, by family order within a slot.
    """
    kind = pa.struct([("s", pa.int64()), ("i", pa.int64()), ("refs", pa.list_(pa.string()))])

    def one(t: str | None) -> dict:
        raw = scanner.raw_secrets(t) if t and secrets != "off" else []
        refs = list(dict.fromkeys(REF + hashlib.sha256(t[a:b].encode()).hexdigest() for a, b, _ in raw))[:MOST_REFS]
        return {"s": len(merged([(a, b) for a, b, _ in raw])), "i": len(scanner.injection_spans(t)) if t and injection != "off" else 0, "refs": refs}

    @F.arrow_udf("struct<s:bigint,i:bigint,refs:array<string>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], kind)

    size = slots.groupBy(message).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("bytes"))
    large = size.where(F.col("bytes") > most_bytes).select(F.col(message).alias("large"))
    same = F.col(message).eqNullSafe(F.col("large"))
    per = slots.join(large, same, "left_anti").select(message, found(scanner.sieve(F.col(text), secrets != "off", injection != "off")).alias("f"))
    scanned = per.groupBy(message).agg(F.sum("f.s").alias("secrets_found"), F.sum("f.i").alias("injection_found"), F.slice(F.array_distinct(F.flatten(F.collect_list("f.refs"))), 1, MOST_REFS).alias("secret_refs"))
    wants = lambda action: ((F.col("secrets_found") > 0) & F.lit(secrets == action)) | ((F.col("injection_found") > 0) & F.lit(injection == action))
    scanned = scanned.select("*", F.lit(False).alias("oversize"), F.when(wants("block"), "block").when(wants("redact"), "redact").when(wants("flag"), "flag").otherwise("none").alias("action"))
    none = F.lit(0).cast("long")
    over = large.select(F.col("large").alias(message), none.alias("secrets_found"), none.alias("injection_found"), F.expr("cast(array() as array<string>)").alias("secret_refs"), F.lit(True).alias("oversize"), F.lit(on_oversize).alias("action"))
    return scanned.unionByName(over)


def merge_spans(spans: DataFrame, by: str) -> DataFrame:
    """Overlapping (start, end) of each group as one; touching ones stay apart.

    Both windows go over one sort, so rows of equal spans keep their places between them: the first one opens an island.
    """
    w = Window.partitionBy(by).orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("island")


def token_refs(rows: DataFrame, key: str, text: str, families: dict[str, str]) -> DataFrame:
    """(key, family, ref) of every distinct match."""
    hits = F.explode(F.array(*[F.struct(F.lit(n).alias("family"), tokens(F.col(text), p).alias("t")) for n, p in families.items()])).alias("x")
    return rows.where(F.col(text).isNotNull()).select(key, hits).select(key, "x.family", F.explode("x.t").alias("t")).select(key, "family", ref(F.col("t")).alias("ref")).distinct()
