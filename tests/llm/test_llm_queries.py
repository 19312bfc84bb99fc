"""The registered queries and the pipeline's stages on a table with nulls, repeated and empty rows."""

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from auditlake.llm import near_dedup, packing, queries, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = [text(rng.choice([4, 40, 120])) for _ in range(30)]
    texts = base + [base[0], base[1] + " end", None, "", " \t\n", "token=abcdefghijkl0123 mail a@b.example", "call +44 20 7946 0958 AKIA" + "Z" * 16, "deadbeef" * 3]
    out = [(i + 1, t, "en", None if i % 9 == 0 else "" if i % 9 == 1 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out + [(None, base[2], "en", "s1", 3), (None, None, None, None, None), (5, base[3], "en", "s2", 3), (5, base[3], "en", "s2", 3)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(1, 30)] + [(None, 1, 1), (31, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def every(rows):
    return sorted(str(r[0]) for r in rows)


def test_query_columns_and_rows(spark, folder, rows, every):
    assert _ids(queries.op1(spark, folder)) == every
    mixed = queries.op2(spark, folder)
    assert mixed.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and _ids(mixed) == every
    by_source = {}
    for _, t, _, s, _ in rows:
        by_source[s] = by_source.get(s, 0) + len(WORD.findall(t or ""))
    got = mixed.collect()
    assert sorted({r.source_size for r in got}) == sorted(set(by_source.values())) and all(0 <= r.taken <= 3 * r.size for r in got)
    prints = queries.op3(spark, folder)
    assert _ids(prints) == every
    same = {}
    text_of = {}
    for i, t, *_ in rows:
        text_of.setdefault(i, set()).add(t or "")
    for r in prints.where("doc_id is not null").collect():
        if len(text_of[r.doc_id]) == 1:
            same.setdefault(next(iter(text_of[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in same.values()) and same[""] == {""}
    scored = queries.op5(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in scored) == every
    for r in scored:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_scans_equal_brute_force(spark, folder, rows):
    def joined(t, chosen):
        found = [(m.start(), place, m.end(), rule.kind) for place, rule in enumerate(secrets.RULES) if rule.kind in chosen for m in re.finditer(rule.regex, t, re.ASCII) if len(m[rule.group]) >= rule.least]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))

    base = ("assign", "access", "hex")
    want = sorted((str(i), hashlib.sha256(joined(t or "", base).encode()).hexdigest(), joined(t or "", [r.kind for r in secrets.RULES])) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.spans) for r in queries.op7(spark, folder).collect()) == want
    from test_operators import _base_entities

    personal = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in queries.op8(spark, folder).collect())
    expected = []
    for i, t, *_ in rows:
        spans = _base_entities(t or "")
        expected.append((str(i), *(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert personal == sorted(expected)


def test_pipeline_stages(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert near.columns == columns
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null")
    assert sorted(r.doc_id for r in near.where("doc_id is not null").collect()) == sorted(r.doc_id for r in kept.collect()) and near.where("doc_id is null").count() == 2
    assert 31 not in {r.doc_id for r in near.collect()}  # a copy of 1
    masked = corpus_pipeline.mask_personal_data(spark, docs, folder)
    assert masked.columns == columns and masked.count() == len(rows)
    texts = [r.text or "" for r in masked.collect()]
    assert not any("a@b.example" in t or "7946" in t for t in texts) and any("[email]" in t for t in texts)
    untouched = sorted(t or "" for _, t, *_ in rows if "@" not in (t or "") and "+" not in (t or ""))
    assert [t for t in untouched if t not in texts] == []
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == columns
    taken = queries.op2(spark, folder).groupBy("doc_id").sum("taken").collect()
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    assert {r.doc_id: r["sum(taken)"] for r in taken if r["sum(taken)"]} == {k: v for k, v in got.items() if v}
    calm = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert calm.columns == columns and sorted(str(r.doc_id) for r in calm.collect()) == sorted(str(r.doc_id) for r in queries.op5(spark, folder).where("predicted = 0").collect())


def test_pipeline_runs_whole(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and all(r.length <= 4096 for r in pieces)
    spans = {}
    for r in pieces:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in spans.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 4, 9, 3)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7)]
