"""The registered queries, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, fingerprint, hard_negatives, mixing, near_dedup, packing, pii, secrets, simhash, substring_dedup, topk, toxicity, warc

#: Rows without a doc_id have no label and aren't held out.
HELD_OUT = "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, false)"
THRESHOLD = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(~F.expr(HELD_OUT)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    out = warc.round_trip(pages)
    return out.select(F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+):', 1) as long)").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.expr("try_cast(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+):', 1) as long)").alias("refers_to"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tuple(r.kind for r in secrets.RULES[:3])
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count(F.col("found"), i).alias(f"n_{k}") for i, k in enumerate(base)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("found"), secrets.RULES, base), 256).alias("base_sha256"), secrets.joined(F.col("found"), secrets.RULES).alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose floor leaves 64 bits are held at the ends of that range, as floor() does."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    whole = rows.select("vec_id", F.expr("transform(embedding, x -> floor(64 * cast(x as double)))").alias("v"))
    return topk.top_k(whole, whole.where("vec_id % 20 = 0"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components whose floor leaves 64 bits are held at the ends of that range, as floor() does."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as long) + 1) % 10 else label end")
    whole = rows.select("vec_id", label.alias("label"), F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("v"))
    return hard_negatives.mine(whole, F.expr("vec_id % 50 = 0"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1,
    "op2_source_mixing": op2,
    "op3_syncmer_fingerprints": op3,
    "op4_minhash_near_dedup": op4,
    "op5_toxicity": op5,
    "op6_warc_round_trip": op6,
    "op7_secret_scan": op7,
    "op8_personal_data": op8,
    "op9_best_fit_packing": op9,
    "op10_top_k": op10,
    "op11_hard_negatives": op11,
    "op12_simhash_near_dedup": op12,
    "op13_filter_audit": op13,
}

_WORDS = r"list_filter(regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '')"


def _spans_sql() -> str:
    """Spans of each rule from the pieces between its matches."""
    arms = []
    for i, rule in enumerate(secrets.RULES):
        q = rule.regex.replace("'", "''")
        arms.append(f"""SELECT row, {i} AS place, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, p, {rule.least} AS least FROM (
            SELECT row, regexp_extract_all(text, '{q}') AS m, regexp_extract_all(text, '{q}', {rule.group}) AS g, string_split_regex(text, '{q}') AS p FROM docs)""")
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    hits AS ({' UNION ALL '.join(arms)}),
    placed AS (SELECT row, place, kind, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n FROM hits WHERE length(g[i]) >= least),
    texts AS (SELECT row, s, place, kind || ':' || s || ':' || (s + n) AS t FROM placed)
    SELECT d.doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
        sha256(coalesce(string_agg(t, ',' ORDER BY s, place) FILTER (place < 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY s, place), '') AS spans
    FROM docs d LEFT JOIN texts USING (row) GROUP BY d.row, d.doc_id"""


ORACLE_SQL = {
    "op1_substring_dedup": f"""
    WITH docs AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, i + o AS i FROM again, range(20) AS r(o)),
    spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs d LEFT JOIN (SELECT s.doc_id, count(g.i) AS n, string_agg(s.w[s.i], ' ' ORDER BY s.i) FILTER (g.i IS NULL) AS kept FROM spot s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i GROUP BY s.doc_id) k ON k.doc_id = d.doc_id""",
    "op4_minhash_near_dedup": f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0))),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
    FROM docs d LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.a = d.doc_id""",
    "op6_warc_round_trip": """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h, url FROM pages),
    d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS r, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k, array_to_string(list_transform(range(8), lambda g: list_transform(['0x' || substr(h, (1 + 5 * g)::INT, 5)], lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((x::BIGINT >> s) & 31))::INT, 1)), ''))[1]), '') AS digest FROM p)
    SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN r END AS refers_to FROM d""",
    "op7_secret_scan": _spans_sql(),
    "op10_top_k": """
    WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.n AS query_row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s)
    SELECT query_id, k::INT AS rank, vec_id, score FROM r WHERE k <= 20""",
    "op11_hard_negatives": """
    WITH v AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.n AS a, a.vec_id AS anchor_id, c.n AS c, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON c.n <> a.n AND len(c.v) = len(a.v) WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
    r AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS k, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, k::INT AS rank, negative_id, positive_score, negative_score FROM r WHERE k <= 3""",
    "op13_filter_audit": f"""
    WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format(text='text')} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
    d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM t LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, list_sum(list_transform(range(5), lambda i: CASE WHEN fails[i + 1] THEN 1 << i ELSE 0 END))::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY 1, 2),
    letters AS (SELECT i::INT AS i, chr(65 + i::INT) AS c FROM range(5) AS r(i)),
    orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    steps AS (SELECT filter_order, k AS step, 1 << o[k] AS bit, coalesce(list_sum(list_transform(o[1:k-1], lambda i: 1 << i)), 0)::INT AS before FROM orders, range(1, 6) AS r(k))
    SELECT part, filter_order, step::INT AS step, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN mask & bit > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
    FROM m, steps GROUP BY ALL""",
}
