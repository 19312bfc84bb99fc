"""Blast radius: which events and sessions a set of values touched."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import ref
from ..sources.shared import ROWS_PER_TASK, dealt, written

#: Fixed order: strongest match first.
PRIORITY = ("ref", "result_hash", "args_hash", "credential", "name", "plain")


def index(events: DataFrame, refs: dict[str, tuple[str, str]], names: dict[str, str]) -> DataFrame:
    """All references and names of all events as rows (matched_on, path, key, event_id, session_id): search is an equi-join.

    ``refs`` maps a path to (class, column of a reference); ``names`` a path to a column of names.
    """
    hashed = [F.struct(F.lit(kind).alias("matched_on"), F.lit(path).alias("path"), F.col(c).alias("key")) for path, (kind, c) in refs.items()]
    named = [F.struct(F.lit("name").alias("matched_on"), F.lit(path).alias("path"), F.lower(c).alias("key")) for path, c in names.items()]
    return events.select("event_id", "session_id", F.explode(F.array(*hashed, *named)).alias("r")).select("event_id", "session_id", "r.*").where("key is not null")


_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_HASH = re.compile(r"sha256:[0-9a-f]{64}")
_LEAVES = "matched_on string, path string, key string"


def _segment(key: str) -> str:
    return "." + key if _IDENTIFIER.fullmatch(key) else "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def leaves(value, path: str = "$"):
    """(class, path, key) of a JSON value, depth first: plain texts, references, references within a leaf, hashed keys."""
    stack = [(value, path)]
    while stack:
        node, at = stack.pop()
        if isinstance(node, str):
            yield "plain", at, node
        elif isinstance(node, list):
            stack.extend((x, f"{at}[{i}]") for i, x in reversed(list(enumerate(node))))
        elif isinstance(node, dict):
            if node.get("redacted") is True and isinstance(node.get("ref"), str) and isinstance(node.get("len"), (int, float)) and not isinstance(node["len"], bool):
                yield "ref", at, node["ref"]
                inner = node.get("secret_refs")
                yield from (("ref", f"{at}.secret_refs[{i}]", r) for i, r in enumerate(inner if isinstance(inner, list) else []) if isinstance(r, str))
            else:
                yield from (("ref", at + _segment(k) + "#key", k) for k in node if _HASH.fullmatch(k))
                stack.extend((x, at + _segment(k)) for k, x in reversed(node.items()))


def _get(value, *path):
    for p in path:
        value = value.get(p) if isinstance(value, dict) else None
    return value


def _event_rows(event: dict):
    """All that a needle can meet in an event, strongest last resort included, in the order of the walk."""
    yield from leaves(event)
    kind, tool, method = event.get("kind"), event.get("tool"), event.get("method")
    if kind in ("tool_call", "rpc") and isinstance(event.get("result_hash"), str):
        yield "result_hash", "$.result_hash", event["result_hash"]
    if kind == "policy_decision" and isinstance(event.get("args_hash"), str):
        yield "args_hash", "$.args_hash", event["args_hash"]
    prints = _get(event, "identity", "credential_fingerprints")
    yield from (("credential", f"$.identity.credential_fingerprints[{i}].ref", c["ref"]) for i, c in enumerate(prints if isinstance(prints, list) else []) if isinstance(_get(c, "ref"), str))
    found = _get(event, "gateway", "boundary", "secret_refs")
    if kind == "tool_call":
        yield from (("ref", f"$.gateway.boundary.secret_refs[{i}]", r) for i, r in enumerate(found if isinstance(found, list) else []) if isinstance(r, str))
    named = {"$.tool": tool if kind in ("tool_call", "policy_decision") else None, "$.method": method if kind in ("rpc", "notification") else None}
    for path, name in named.items():
        if isinstance(name, str):
            yield "name", path, name.lower()
            if _HASH.fullmatch(name):
                yield "ref", path, name
    server = _get(event, "server", "name")
    if isinstance(server, str):
        yield "name", "$.server.name", server.lower()


def _indexed(batches):
    for batch in batches:
        out = []
        for event_id, session, text in zip(*(batch[c].to_pylist() for c in ("event_id", "session_id", "event"))):
            try:
                event = json.loads(text) if text else None
            except (ValueError, RecursionError):
                event = None
            if isinstance(event, dict):
                out += [(event_id, session, n, *row) for n, row in enumerate(_event_rows(event))]
        columns = list(zip(*out)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("event_id").type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["event_id", "session_id", "place", "matched_on", "path", "key"])


def event_index(events: DataFrame) -> DataFrame:
    """(event_id, session_id, place, matched_on, path, key) of JSON events (event_id, session_id, event): every leaf, reference and name once."""
    kind = f"event_id {events.schema['event_id'].dataType.simpleString()}, session_id string, place int, {_LEAVES}"
    return events.select("event_id", "session_id", "event").mapInArrow(_indexed, kind)


#: Characters of a gram, and of the parts into which long texts are cut so that a row's grams stay few.
_GRAM, _PART = 4, 4096
#: Grams of needles, or needles, up to which they are sent to every task.
_MOST_BROADCAST = 200_000
#: Rows of one key from which they are dealt to several tasks, and the share of rows that is looked at to find such keys.
_FREQUENT, _SHARE = ROWS_PER_TASK // 5, 0.001


def _grams(text: Column, size: int) -> Column:
    """All substrings of so many characters, by one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _parts(text: Column) -> Column:
    """A text in parts of bounded length, each with as much of the next one as a gram can reach into."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))
    return F.transform(parts, lambda part, i: F.concat(part, F.coalesce(F.substring(F.get(parts, i + 1), 1, _GRAM - 1), F.lit(""))))


def _met(rows: DataFrame, held: DataFrame, key: str, total: int) -> DataFrame:
    """rows (so many) with the rows of held that have the same key.

    A frequent key's rows are dealt to several tasks, and its rows of held to each of these; which keys are frequent is estimated, which
    moves rows to other tasks but leaves none out.
    """
    if total <= ROWS_PER_TASK:
        return rows.join(held, key)
    seen = rows.select(key).sample(_SHARE, 1).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= _FREQUENT * _SHARE / 2)
    frequent = F.broadcast(written(seen.select(key, F.ceil(F.col("n") / (_FREQUENT * _SHARE)).cast("int").alias("parts")), "frequent-keys"))
    own = F.pmod(F.xxhash64("event_id", "path"), F.col("parts")).cast("int")
    some = rows.join(frequent, key, "left").withColumn("part", F.coalesce(own, F.lit(0))).drop("parts")
    each = held.join(frequent, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt(some, total, key, "part").join(dealt(each, total, key, "part"), [key, "part"]).drop("part")


def _plain(needles: DataFrame, texts: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Texts (with a column key; so many of them) that hold a needle, without the key; and how many rows these are.

    Each distinct text is looked at once. The texts' grams are posted by the number of the text alone, and only those that some
    needle has. A needle's rarest gram names the texts in which it is then looked for; a needle with a gram that no text has is in none.
    """
    n = needles.where("needle <> ''").withColumn("size", F.least(F.length("needle"), F.lit(_GRAM)))
    sizes = sorted(r.size for r in n.select("size").distinct().collect())  # at most _GRAM of them
    if not sizes:
        return texts.drop("key").join(n.select("needle").limit(0), F.lit(False)), 0
    rows = texts.where("key is not null").withColumn("digest", F.md5("key"))
    distinct = written(rows.groupBy("digest", "key").agg(F.count("*").alias("rows")).withColumn("id", F.monotonically_increasing_id()), "texts")
    own = reduce(lambda rest, s: F.when(F.col("size") == s, _grams(F.col("needle"), s)).otherwise(rest), sizes[:-1], _grams(F.col("needle"), sizes[-1]))
    asked = written(n.select("needle", F.explode(F.array_distinct(own)).alias("gram")), "needle-grams")
    wanted = asked.select("gram").distinct()
    few = wanted.count() <= _MOST_BROADCAST
    small = lambda df: F.broadcast(df) if few else df
    every = F.array_distinct(F.flatten(F.array(*[_grams(F.col("part"), s) for s in sizes])))
    posted = distinct.select("id", F.explode(_parts(F.col("key"))).alias("part")).select("id", F.explode(every).alias("gram"))
    postings = written(posted.join(small(wanted), "gram", "left_semi").distinct(), "postings")
    seen = F.coalesce("texts", F.lit(0))
    rare = asked.join(small(postings.groupBy("gram").agg(F.count("*").alias("texts"))), "gram", "left").select("needle", F.struct(seen.alias("texts"), "gram").alias("r"))
    rare = dealt(rare, asked.count(), "needle").groupBy("needle").agg(F.min("r").alias("r"))
    candidates = rare.where("r.texts > 0").select("needle", "r.gram").join(postings, "gram").select("needle", "id")
    held = written(candidates.join(distinct, "id").where(F.contains("key", F.col("needle"))).select("needle", "digest", "rows"), "held")
    matches = held.agg(F.sum("rows").alias("n")).first().n or 0
    return _met(rows.drop("key"), held.drop("rows"), "digest", total).drop("digest"), matches


def touched(needles: DataFrame, indexed: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The strongest match of each needle in each event, over an ``index`` or ``event_index``.

    Empty needles match nothing by name or text. ``texts`` (event_id, session_id, path, text) adds plain texts to those of the
    index; a needle meets them by equal grams, not one by one. Rows are counted first, so that each task sorts a bounded number of them.
    """
    n = needles.select("needle").distinct()
    place = F.col("place") if "place" in indexed.columns else F.lit(0).alias("place")
    rows = indexed.select("event_id", "session_id", place, "matched_on", "path", "key")
    total, few = rows.count(), n.count() <= _MOST_BROADCAST
    meet = lambda some, keyed: some.join(F.broadcast(keyed), "key") if few else _met(some, keyed, "key", total)
    by_ref = meet(rows.where("matched_on not in ('name', 'plain')"), n.withColumn("key", ref(F.col("needle"))))
    by_name = meet(rows.where("matched_on = 'name'"), n.where("needle <> ''").withColumn("key", F.lower("needle")))
    found = by_ref.drop("key").unionByName(by_name.drop("key"))
    plain = [rows.where("matched_on = 'plain'")] if "place" in indexed.columns else []  # an ``index`` holds no texts
    if texts is not None:
        plain.append(texts.select("event_id", "session_id", F.lit(0).alias("place"), F.lit("plain").alias("matched_on"), "path", F.col("text").alias("key")))
        total += texts.count()
    if plain:
        held, matches = _plain(n, reduce(DataFrame.unionByName, plain), total)
        found, total = found.unionByName(held), total + matches
    rank = F.array_position(F.lit(list(PRIORITY)), F.col("matched_on"))
    own = found.select("needle", "event_id", "session_id", F.struct(rank.alias("rank"), "place", "path", "matched_on").alias("m"))
    best = dealt(own, total, "needle", "event_id", "session_id").groupBy("needle", "event_id", "session_id").agg(F.min("m").alias("m"))
    return best.select("needle", "event_id", "session_id", "m.matched_on", "m.path")


def touched_sessions(sessions: DataFrame, matches: DataFrame) -> DataFrame:
    return sessions.join(matches, "session_id", "left_semi")
