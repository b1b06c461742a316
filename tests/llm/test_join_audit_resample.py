"""N-gram Jaccard join, filter audit and resampling against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.llm import common, filter_audit, ngram_join, resampling
from herdlens.llm import queries as Q

from conftest import SF_SMALL
from test_llm import odd, rows_of  # noqa: F401


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


# ---------------------------------------------------------------- n-gram Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def smallest_reachable(rows, linked):
    """Component of each row (id, set): the smallest id reachable; None is no id."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(rows)]


def joined(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def family(rng, n, words, edits):
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
        out.append(" ".join(w[:rng.randrange(words * 8 // 10, words + 1)]))
    return out


@pytest.fixture(scope="module")
def families():
    rng = random.Random(5)
    texts = [*family(rng, 40, 120, 6), *family(rng, 30, 60, 3), *family(rng, 12, 9, 1), *family(rng, 6, 600, 20)]
    passage = " ".join(f"common{k}" for k in range(30))
    texts += [passage + " " + " ".join(f"own{k}x{rng.randrange(10 ** 6)}" for _ in range(rng.choice([2, 5, 40]))) for k in range(25)]
    texts += texts[:20] + ["", None, "  ", "one two", "One TWO", "one two three"]
    return list(enumerate(texts))


def test_join_equals_brute_force(spark, families):
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(5)
    want = sorted(smallest_reachable([(d, shingles(t)) for d, t in families], joined))
    assert sum(c != d for d, _, c in want) > 60 and len({c for _, _, c in want}) > 20
    got = sorted(tuple(r) for r in ngram_join.op11_query(df).collect())
    assert got == want
    # Cells in pairs of blocks, groups by their cells, joins without broadcast: the same links.
    split = ngram_join.jaccard_components(df, cell_rows=3, group_tokens=600, broadcast_rows=0)
    assert sorted(tuple(r) for r in split.collect()) == want


def test_join_odd_rows(spark, odd):  # noqa: F811
    rows = [(r.doc_id, shingles(r.text)) for r in odd.collect()]
    got = sorted(map(tuple, ngram_join.op11_query(odd).collect()), key=str)
    assert got == sorted(smallest_reachable(rows, joined), key=str)
    assert ngram_join.op11_query(odd.limit(0)).collect() == []


def test_traversal_finds_every_component():
    rng = random.Random(2)
    sets = [np.unique(np.array([hash((s, 1)) & (1 << 64) - 1 for s in shingles(t)], np.uint64)) for t in family(rng, 150, 80, 5)]
    want = smallest_reachable(list(enumerate(set(s.tolist()) for s in sets)), joined)
    forest = ngram_join.Forest(len(sets))
    for i, j in ngram_join.exact_edges(sets, 80):
        assert joined(set(sets[i].tolist()), set(sets[j].tolist())) and forest.unite(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [c for _, _, c in want]
    # The bitmaps alone connect at least what is linked.
    wide = [ngram_join.width_of(len(s)) for s in sets]
    loose = ngram_join.Forest(len(sets))
    for i, j in ngram_join.candidate_edges(np.array([len(s) for s in sets]), [ngram_join.bitmap(s, w).to_bytes(w // 8, "little") for s, w in zip(sets, wide)], 80):
        loose.unite(i, j)
    assert all(loose.root(i) == loose.root(c) for i, _, c in want)


def test_folding_keeps_the_bits():
    tokens = np.array([3, 130, 700, 2 ** 63 + 5], np.uint64)
    assert ngram_join.folded(ngram_join.bitmap(tokens, 1024), 1024, 128) == ngram_join.bitmap(tokens, 128)


def test_least_overlap():
    for a in range(1, 60):
        for b in range(1, 60):
            assert ngram_join.least_overlap(a, b, 80) == min(i for i in range(a + b + 1) if 100 * i >= 80 * (a + b - i))


# ---------------------------------------------------------------- filter audit


def brute_audit(docs, labels):
    def fails(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and any(x is not None and x < d and (u or "") == t for x, u, _ in docs)}

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(d, fails(d, t or "")) for d, t, s in docs if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                out[part, order, k + 1] = [len(left), len(gone), sum(m[f] for _, m in mine) - len(gone),
                                           sum(m[f] and sum(m.values()) == 1 for _, m in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    total = Counter()
    for (part, order, k), v in out.items():
        total[part, order[k - 1]] += v[1]
    return {(p, o, k): (*v, total[p, o[k - 1]]) for (p, o, k), v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force(spark, odd):  # noqa: F811
    rng = random.Random(3)
    words = ["tell", "Tell", "TELL", "a#b", "c|d", "fine", *(f"w{k}" for k in range(80))]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([5, 49, 50, 60, 90]))), rng.choice(["a", "b", None, ""])) for k in range(60)]
    docs += [(100 + k, docs[k % 7][1], "b") for k in range(14)] + [(None, docs[0][1], "a"), (3, docs[3][1], "a"), (200, None, "a"), (201, "", None)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, _, _ in docs] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(filter_audit.op12_query(df, lf)) == brute_audit(docs, labels)
    assert filter_audit.op12_query(df.limit(0), lf).collect() == []
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    named = odd.withColumnsRenamed({"score": "mask", "size": "good", "key": "toxic"}).withColumn("first", F.lit(1)).withColumn("same", F.lit(2))
    assert audited(filter_audit.op12_query(named, lf.limit(0))) == brute_audit(rows, [])


def test_gray_walk_equals_each_subset():
    rng = np.random.default_rng(1)
    m, counts = np.arange(32), rng.integers(0, 9, (32, 3))
    states = filter_audit.gray_states(m, counts, 5)
    for s in range(32):
        assert (states[s] == counts[m & s == 0].sum(axis=0)).all()


# ---------------------------------------------------------------- resampling


def brute_resample(docs, target):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for d, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[2], r[1]))
    for k, r in enumerate(best[:25 * len(best) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    got = Q.QUERIES["op13_resampling"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == want
    # A head of any size gives the same result.
    for words, pairs in ((0, 0), (50, 20)):
        got = resampling.resample(docs.repartition(3), bench, head_words=words, head_pairs=pairs)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_resampling_odd_rows(spark, odd, monkeypatch):  # noqa: F811
    named = odd.withColumnsRenamed({"score": "weight", "size": "rank", "key": "words"})
    target = spark.createDataFrame([("one two three",), (None,), ("É x é",), ("",)], "text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_resample(docs, [r.text for r in target.collect()])
    assert sorted(map(tuple, resampling.op13_query(named, target).collect()), key=str) == want
    assert resampling.op13_query(odd.limit(0), target).collect() == []
    empty = sorted(map(tuple, resampling.op13_query(odd, target.limit(0)).collect()), key=str)
    assert empty == brute_resample(docs, [])


def test_blocks_cut_nowhere(monkeypatch):
    texts = [b"a b c d e f g", b"", b"h", b"i j k l", b"x " * 9]
    whole = Counter()
    head = resampling.Head([b"a", b"x", b"c"], [(b"x", b"x")], 10_000)
    for bucket, of in head.blocks(texts):
        whole.update(zip(bucket.tolist(), of.tolist()))
    for size in (2, 3, 5):
        monkeypatch.setattr(resampling, "BLOCK", size)
        cut = Counter()
        for bucket, of in head.blocks(texts):
            cut.update(zip(bucket.tolist(), of.tolist()))
        assert cut == whole
    want = Counter()
    for k, t in enumerate(texts):
        w = t.split()
        want.update((zlib.crc32(x) % 10_000, k) for x in w + [a + b" " + b for a, b in zip(w, w[1:])])
    assert whole == want
