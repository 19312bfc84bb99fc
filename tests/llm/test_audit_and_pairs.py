"""Hard negatives, SimHash near-duplicates and the filter audit against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from auditlake.llm import filter_audit, hard_negatives, queries, simhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, fingerprint string, n long"


def _mined(rows, positives=5, negatives=3):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, m) for c, (i, m, w) in enumerate(rows) if c != a and len(w) == len(v)]
        same = sorted((key(s, i), s, i) for s, i, m in scored if m == label)[:positives]
        for _, ps, p in same:
            found = sorted((key(s, i), s, i) for s, i, m in scored if m != label and 50 * ps <= 100 * s <= 95 * ps)[:negatives]
            out += [(anchor, p, n, i, ps, s) for n, (_, s, i) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [3, 200, 1 << 40])
def test_hard_negatives_equal_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    rng = random.Random(scale)
    rows = [(i, rng.randrange(3), [rng.randrange(-scale, scale + 1) for _ in range(11)]) for i in range(0, 400, 5)]
    rows += [rows[0], rows[3], (None, 1, rows[4][2]), (None, 2, rows[5][2]), (50, None, rows[0][2]), (100, 1, None), (150, 1, [1, None, 2]), (200, 1, [5, 6]), (201, 1, [5, 6]), (203, 2, [4, 3]), (250, 0, []), (251, 0, []), (252, 1, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, v array<long>, score string").repartition(3)
    got = sorted([(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, F.expr("vec_id % 50 = 0")).collect()], key=str)
    hold = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert got == sorted([(*r[:4], hold(r[4]), hold(r[5])) for r in _mined(rows)], key=str) and got


def test_hard_negatives_of_empty_and_anchorless_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, v array<long>")
    assert hard_negatives.mine(none, F.expr("vec_id % 50 = 0")).count() == 0
    one = spark.createDataFrame([(3, 1, [1, 2])], "vec_id long, label int, v array<long>")
    assert hard_negatives.mine(one, F.expr("vec_id % 50 = 0")).count() == 0


def test_four_russians_scores_are_inner_products():
    rng = np.random.default_rng(3)
    a, c = rng.integers(-400, 400, (7, 19)), rng.integers(-1, 300, (33, 19))
    for matrix in (c, np.zeros((2, 19), np.int64), -np.ones((2, 19), np.int64), np.full((1, 19), -256)):
        assert (hard_negatives.scores(hard_negatives.subset_sums(a, np.int32), hard_negatives.bit_planes(matrix)) == a @ matrix.T).all()


def test_op11_reads_odd_vectors(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randrange(10), [rng.uniform(-1, 1) for _ in range(8)]) for i in range(0, 700, 7)] + [(i, rng.randrange(10), [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1, 300, 4)]
    odd = [(50, 1, [math.nan] * 8), (100, 2, [math.inf] * 8), (150, None, [0.5] * 8), (None, 3, [0.25] * 8), (200, 3, None), (250, 4, [None] * 8)]
    spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    f32 = lambda x: float(np.float32(x))
    whole = [(i, (m + 1) % 10 if i is not None and i % 7 == 0 else m, [math.floor(256 * f32(x)) for x in v]) for i, m, v in rows + odd[3:4]]
    got = queries.op11(spark, str(tmp_path)).collect()
    assert sorted([tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got], key=str) == _mined(whole)


def _fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, prints, radius):
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            least[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(root(i), []).append(r)
    return [min((x for x in ids[root(i)] if x is not None), default=None) for i in range(len(rows))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"W{i}é" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 90, 400]))) for _ in range(60)]
    for t in list(texts):  # near copies: a word of a long text changed
        parts = t.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts += [" ".join(parts), t.upper().replace(" ", "\t\n")]
    texts += [None, "", " \r\n", "a", "A", "b c", "B  c", "x" * 100_000, "y " * 50_000, "É é é é"]
    rows = [(None if i % 17 == 0 else i // 2 if i % 13 == 0 else i, t, "en", "clash", 1) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [_fingerprint(t) for t in texts]
    want = _components([r[0] for r in rows], prints, 3)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, want)), key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("shard", [4, 64, 4096])
def test_links_tie_what_all_pairs_tie(spark, shard):
    """Dense groups, full shards that fall into chunks, and lonely fingerprints."""
    rng = random.Random(shard)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b for b in base} | {base[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {base[1] ^ rng.getrandbits(9) for _ in range(150)} | {0, (1 << 64) - 1}
    values |= {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (2, 3, 4, 5)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 3, shard).collect()
    place = {v: i for i, v in enumerate(signed)}
    want = _components(list(range(len(values))), values, 3)
    least = list(range(len(values)))
    for _ in range(len(values)):
        before = list(least)
        for r in found:
            i, j = place[r.a], place[r.b]
            assert want[i] == want[j]
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert least == want


def test_tree_searches_are_whole():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(5), rng.integers(0, 1 << 12, 300, dtype=np.uint64)]))
    tree = simhash.Tree(values)
    for radius in (0, 1, 3):
        q, n = tree.within(values, radius)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
        assert sorted(zip(q.tolist(), n.tolist())) == [tuple(x) for x in np.argwhere(near).tolist()]
    assert len(simhash.Tree(values[:0]).within(values, 3)[0]) == 0


def _audited(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    shapley = {(p, f): 0 for p in docs for f in "ABCDE"}
    out = {}
    for p, held in docs.items():
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [d for d in held if f in d[0] and not d[0] & set(order[:k])]
                shapley[p, f] += len(here)
                out[p, "".join(order), k + 1] = [sum(not d[0] & set(order[: k + 1]) for d in held), len(here), sum(f in d[0] for d in held) - len(here), sum(d[0] == {f} for d in held), sum(d[1] for d in here), sum(d[2] for d in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 2000)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["Über", "Ünder", "ABC", "#x", "100%"]
    texts = [" ".join(rng.choices(words if i % 3 else words[:90] + ["Cap"], k=rng.choice([0, 1, 150, 199, 200, 260, 500]))) for i in range(60)]
    texts += texts[:25] + [None, "", " \t", "x" * 200_000, "word " * 30_000, "$", "é" * 40 + "A", "a" * 32 + "A", "a" * 33 + "A"]
    rows = [(None if i % 19 == 5 else i // 3 if i % 11 == 4 else i, t, rng.choice(["en", "de", None, "", "xx"]), "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (2, rows[3][1], "en", None, 0)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13(spark, str(tmp_path)).collect()
    want = _audited(rows, labels)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == want and len(got) == len(want)


def test_filter_audit_of_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(none, labels).count() == 0
    one = filter_audit.interactions(spark.createDataFrame([(1, None, None, None, None)], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120


def test_matrix_holds_each_count(spark):
    rows = [(1, "a b a", "en", None, 0), (2, "b c  c\nc", "en", None, 0), (3, None, "en", None, 0)]
    dictionary, shards = filter_audit.matrix(spark.createDataFrame(rows, DOCS).coalesce(1))
    word = {r.number: r.word for r in dictionary.collect()}
    got = {}
    for s in shards.collect():
        bounds, columns, counts = np.frombuffer(s.bounds, np.int64), np.frombuffer(s.columns, np.int64), filter_audit.unpacked(s.counts)
        for d, a, b in zip(s.docs, bounds, bounds[1:]):
            got[d.doc_id] = {word[c]: n for c, n in zip(columns[a:b].tolist(), counts[a:b].tolist())}
    assert got == {1: {"a": 2, "b": 1}, 2: {"b": 1, "c": 3}, 3: {}}
