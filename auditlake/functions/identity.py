"""Who acted, and under which names events are known elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What claims of an identity token may say, the size of a token, and by how many seconds clocks may differ.
KINDS, RUN_AS, PROVIDERS, HOSTS = ("human", "job"), ("user", "owner"), ("okta", "entra", "google", "test"), ("vercel", "lambda", "other", "local")
MOST_BYTES, SKEW = 16 * 1024, 30
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _segment(text: Column) -> Column:
    """A token's segment as parsed JSON; null if it is none."""
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.try_parse_json(F.try_to_binary(padded, F.lit("base64")).cast("string"))


#: The claims that are looked at, in the order in which a fault of theirs is told.
_STRINGS = ("iss", "aud", "sub", "tenant_id", "kind", "run_as", "idp", "idp_sub", "tool.id", "tool.name", "tool.version", "host.origin", "host.kind", "jti", "tenant", "email", "role")
_NUMBERS = ("iat", "exp")


def with_actor(rows: DataFrame, token: str, issuer: str, audience: str, now: Column) -> DataFrame:
    """rows with ``actor``, what an identity token (a compact JWS) claims: struct of user, tool, host, run_as and error.

    The first thing that is wrong is the error, and all else is null: empty, too_large, segments, header, alg, payload, the name of the
    first claim that is missing or says something else, expired or future (by ``now`` in seconds, give or take 30). Null tokens give
    a null struct. Signatures aren't looked at here. Each claim is looked up once, in a projection of its own.
    """
    text = F.trim(token)
    parts = F.split(text, r"\.")
    parsed = rows.withColumn("_header", _segment(F.get(parts, F.lit(0)))).withColumn("_claims", _segment(F.get(parts, F.lit(1))))
    at = lambda c: F.try_variant_get("_claims", "$." + c, "variant")
    typed = lambda v, kinds, to: F.when(F.schema_of_variant(v).rlike(kinds), F.try_variant_get(v, "$", to))
    read = parsed.withColumn("_strings", F.array(*map(at, _STRINGS))).withColumn("_numbers", F.array(*map(at, _NUMBERS)))
    read = read.withColumn("_strings", F.transform("_strings", lambda v: typed(v, "^STRING$", "string"))).withColumn("_numbers", F.transform("_numbers", lambda v: typed(v, "^(BIGINT|DECIMAL.*|DOUBLE)$", "double")))
    string, number = (lambda c: F.col("_strings")[_STRINGS.index(c)]), (lambda c: F.col("_numbers")[_NUMBERS.index(c)])
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    one_of = lambda c, *values: string(c).isin(*values)
    filled = lambda *claims: reduce(lambda a, b: a & b, [string(c) != "" for c in claims])
    tests = {
        "empty": text != "",
        "too_large": F.octet_length(text) <= MOST_BYTES,
        "segments": F.size(parts) == 3,
        "header": is_object("_header"),
        "alg": F.try_variant_get("_header", "$.alg", "string") == "EdDSA",
        "payload": is_object("_claims"),
        "iss": one_of("iss", issuer),
        "aud": one_of("aud", audience),
        "sub": string("sub").rlike(_UUID),
        "tenant_id": string("tenant_id").rlike(_UUID),
        "kind": one_of("kind", *KINDS),
        "run_as": one_of("run_as", *RUN_AS),
        "idp": one_of("idp", *PROVIDERS),
        "idp_sub": string("idp_sub").isNotNull(),
        "tool": string("tool.id").rlike(_UUID) & filled("tool.name", "tool.version"),
        "host": filled("host.origin") & one_of("host.kind", *HOSTS),
        "jti": filled("jti"),
        **{c: number(c).isNotNull() for c in _NUMBERS},
        **{c: filled(c) for c in ("tenant", "email", "role")},
        "expired": number("exp") > now - SKEW,
        "future": number("iat") <= now + SKEW,
    }
    told = read.withColumn("_error", F.coalesce(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]))
    fine = F.col("_error").isNull()
    named = lambda **claims: F.when(fine, F.struct(*[string(c).alias(n) for n, c in claims.items()]))
    actor = F.struct(named(id="sub", email="email", idp="idp", idp_sub="idp_sub").alias("user"), named(id="tool.id", name="tool.name", version="tool.version").alias("tool"), named(origin="host.origin", kind="host.kind").alias("host"), F.when(fine, string("run_as")).alias("run_as"), F.col("_error").alias("error"))
    return told.select(*rows.columns, F.when(F.col(token).isNotNull(), actor).alias("actor"))


def attributes(kind: Column, tool: Column, method: Column, request_id: Column, error_type: Column, decision: Column, rule_id: Column, namespace: str) -> Column:
    """An event's attributes under the names of the semantic conventions: a map without absent ones.

    Decision and rule have no such name and stand under ``namespace``.
    """
    call, rpc = kind == "tool_call", kind.isin("rpc", "initialize")
    values = {
        "gen_ai.operation.name": F.when(call, "execute_tool"),
        "gen_ai.tool.name": F.when(call, tool),
        "gen_ai.tool.call.id": F.when(call, request_id),
        "rpc.system": F.when(call | rpc | (kind == "notification"), "jsonrpc"),
        "rpc.jsonrpc.request_id": F.when(rpc, request_id),
        "mcp.method.name": F.when(call, "tools/call").when(kind.isin("rpc", "initialize", "notification"), method),
        "error.type": F.when(call | (kind == "rpc"), error_type),
        f"{namespace}.policy.decision": F.when(call | (kind == "policy_decision"), decision),
        f"{namespace}.policy.rule_id": F.when(call | (kind == "policy_decision"), rule_id),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
