"""Column functions for canonical JSON, value references and name shapes."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first previous-hash of every chain.
GENESIS_HASH = "707996e896e3e9a4b1e8d1e25fa74b8e0559541bb89243d2da7ae1f1f18cff27"
REF = "sha256:"

#: Fixed patterns: value shapes that may stay readable.
SHAPES = {
    "identifier": r"^[A-Za-z][A-Za-z0-9_./:-]*$",
    "version": r"^v?[0-9]+(\.[0-9A-Za-z-]+)*$",
    "protocol_version": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}


def length16(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def canonical(json: Column) -> Column:
    """Keys sorted at each level, no white space. Null for text that is not JSON."""
    return F.to_json(F.try_parse_json(json))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)


def _cut(text: str, marker: str, depth: int) -> str:
    """JSON text whose containers below so many others are the marker."""
    out, at, level, start = [], 0, 0, None
    for m in _TOKEN.finditer(text):
        if m[0] in "[{":
            if level == depth:
                start = m.start()
            level += 1
        elif m[0] in "]}":
            level -= 1
            if level == depth and start is not None:
                out += [text[at:start], json.dumps(marker)]
                at, start = m.end(), None
    return "".join(out) + text[at:]


def bounded_canonical(json_: Column, marker: str, depth: int = 256) -> Column:
    """struct of text and capped: canonical JSON in which what lies below ``depth`` containers is the marker, and whether anything does.

    What is cut off isn't checked; the rest has to be JSON, else the text is null. Only texts with so many brackets go to Python.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _cut(t, marker, depth) for t in texts.to_pylist()], pa.string())

    deep = F.when(F.length(F.regexp_replace(json_, r"[^\[{]", "")) > depth, json_)
    short = cut(deep)
    return F.struct(canonical(F.coalesce(short, json_)).alias("text"), F.coalesce(short != json_, F.lit(False)).alias("capped"))


def ref(text: Column) -> Column:
    """Content reference of a text."""
    return F.concat(F.lit(REF), F.sha2(F.encode(text, "UTF-8"), 256))


def record_hash(prev: Column, canon: Column) -> Column:
    return F.sha2(F.encode(F.concat(prev, F.lit("\n"), canon), "UTF-8"), 256)


def structural(text: Column, shape: str, most: int = 128) -> Column:
    """The text if it is short and of the shape, else its reference."""
    return F.when((length16(text) <= most) & text.rlike(SHAPES[shape]), text).otherwise(ref(text))


def identity_fingerprint(*parts: Column) -> Column:
    """One reference over NUL-separated parts; a null part is empty."""
    out = F.coalesce(parts[0].cast("string"), F.lit(""))
    for p in parts[1:]:
        out = F.concat(out, F.lit("\0"), F.coalesce(p.cast("string"), F.lit("")))
    return ref(out)


def tool_parts(name: Column) -> tuple[Column, Column]:
    """(server, tool) of names like mcp__server__tool; an empty server for built-in tools."""
    pattern = r"^mcp__(.+?)__(.+)$"
    return F.regexp_extract(name, pattern, 1), F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 2)).otherwise(name)


def scrub_keys(fields: Column, secret: str) -> Column:
    """Map keys stay if they look like identifiers and not like secrets; else they become references."""
    return F.transform_keys(fields, lambda k, v: F.when(k.rlike(SHAPES["identifier"]) & ~k.rlike(secret), k).otherwise(ref(k)))


def secret_refs(text: Column, patterns: list[str], most: int = 8) -> Column:
    """References of the pattern matches inside a longer text, in pattern and then position order, at most ``most``."""
    hits = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))
    refs = F.array_except(F.transform(F.array_distinct(hits), ref), F.array(ref(text)))
    return F.when(length16(text) >= 8, F.slice(refs, 1, most)).otherwise(F.expr("cast(array() as array<string>)"))


def origin_url(url: Column, keep: list[str]) -> Column:
    """scheme, host and path of an http(s) URL of up to 2048 characters; path segments outside ``keep`` become references."""
    scheme, host, path = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    segments = F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: F.when((s == "") | s.isin(*keep), s).otherwise(ref(s)))
    return F.when(F.lower(scheme).isin("http", "https") & (F.length(url) <= 2048), F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.array_join(segments, "/")))


#: Fixed patterns: path segments that stay readable, unless they are ids or look like secrets.
_PATH_WORD = r"^[A-Za-z0-9._-]{1,32}$"
_PATH_ID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9_-]{16,}$"
MAX_ORIGIN = 2048


def _origin(url: Column, secret: str) -> Column:
    part = lambda p: F.try_parse_url(url, F.lit(p))
    scheme, host = F.lower(part("PROTOCOL")), F.lower(part("HOST"))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), ":([0-9]+)$", 1)
    usual = F.when(scheme == "http", "80").otherwise("443")
    hidden = lambda s: ~s.rlike(_PATH_WORD) | s.rlike(_PATH_ID) | s.rlike(secret)
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    kept = F.array_join(F.transform(F.split(path, "/"), lambda s: F.when((s != "") & hidden(s), ref(s)).otherwise(s)), "/")
    whole = F.concat(scheme, F.lit("://"), host, F.when((port != "") & (port != usual), F.concat(F.lit(":"), port)).otherwise(""), kept)
    return F.when(scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != "") & (F.length(whole) <= MAX_ORIGIN), F.struct(host.alias("host"), whole.alias("url")))


def scrubbed_origin(url: Column, secret: str) -> Column:
    """struct of host and url of an http(s) address: no user, query or fragment, ids and odd or secret path segments as references.

    An address of a relay gives way to the one in its parameter mcp_url, if that is one. ``secret`` is a pattern of what looks like a
    secret. Addresses of more than 2048 characters when scrubbed give null, as do all others.
    """
    inner = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("mcp_url")))
    return F.coalesce(_origin(inner, secret), _origin(url, secret))
