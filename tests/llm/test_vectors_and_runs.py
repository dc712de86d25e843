"""Hard negatives, periodic runs and near-duplicate vectors against brute force: nulls, empties, ties, repeated rows, clashing columns, dense groups."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewalk.llm import hard_negatives, periodic_runs, queries, vector_dedup


def _runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(r.randint(1, 5)):
            k = r.choice([1, 2, 2, 3, 5, 30])
            w = [r.randrange(k) for _ in range(r.randint(0, 120))]
            for _ in range(r.randint(0, 4)):
                p, a = r.randint(1, 12), r.randrange(len(w) + 1)
                w[a:a] = ([r.randrange(k) for _ in range(p)] * 9)[: r.randint(p, 9 * p)]
            texts.append(w)
        want = []
        for k, w in enumerate(texts):
            before = sum(map(len, texts[:k]))
            want += [(s + before, n, q) for s, n, q in _runs(w)]
        start, end, period = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in texts]))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == sorted(want)


def test_long_repetitive_texts_take_few_rounds():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 60_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    one = np.zeros(200_000, np.int64)
    assert [x.tolist() for x in periodic_runs.runs_of(one, one)] == [[0], [200_000], [1]]
    block = np.tile(np.random.default_rng(1).permutation(30_000), 5)
    assert [x.tolist() for x in periodic_runs.runs_of(block, block * 0)] == [[0], [150_000], [30_000]]
    words = np.array(fibonacci[-1])
    assert len(periodic_runs.runs_of(words, words * 0)[0]) == 0  # no fourth powers


TEXTS = ["a b " * 40, None, "", " \t\n", "x", "A a " * 6 + "b", "go go go go go go", "go go go go go", "one two three\nfour " * 5 + "tail", "ü  " * 9, "w " + "p q r s " * 6 + "p q z", "the end " * 30_000]


def test_op12(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, t, "t", 1, "c") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(x for _ in range(r.randint(1, 60)) for x in r.choices("abcdefgh", k=r.randint(1, 3)) * r.choice([1, 1, 1, 5])), None, 2, "d") for i in range(60)]
    rows += [rows[0], (None, TEXTS[0], None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, runs string, n_words int, collapsed string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = _runs(words) if n < 10_000 else [(0, n, 2)]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[1] for x in want) > 20
    empty = spark.createDataFrame([], schema)
    assert periodic_runs.periodic_runs(empty).collect() == []


@pytest.mark.parametrize("size,scale", [(3, 20), (64, 255), (65, 30_000), (300, 400), (5, 2**40), (7, 2**100)])
def test_products_by_residues_are_exact(size, scale):
    r = random.Random(size)
    a, b = ([[r.randint(-scale, scale) for _ in range(size)] for _ in range(n)] for n in (7, 11))
    a, b = ([[int(float(x)) for x in row] for row in m] for m in (a, b))
    bound = size * max(abs(x) for row in a for x in row) * max(abs(x) for row in b for x in row)
    found = hard_negatives.products(np.array(a, float), np.array(b, float), bound)
    assert [[int(x) for x in row] for row in found] == [[sum(x * y for x, y in zip(u, v)) for v in b] for u in a]


def _mined(rows, anchors, k=5):
    vectors = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[i] = min(vectors.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in vectors.items()}
    out = []
    for a in filter(anchors, whole):
        label, v = whole[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in whole.items() if len(w) == len(v)}
        score = {i: s for i, s in score.items() if -(1 << 63) <= s < 1 << 63}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:k]  # noqa: E731, B023
        for p in first(i for i in score if whole[i][0] == label and i != a):
            inside = [i for i in score if whole[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(first(inside))]
    return sorted(out)


def _vectors(n=400, size=6, seed=5):
    r = random.Random(seed)
    v = lambda: [float(np.float32(r.gauss(0.2, 0.3))) for _ in range(size)]
    rows = [(i, r.randrange(3), v()) for i in range(n)]
    rows += [(n + i, r.choice([0, 1]), list(rows[7][2])) for i in range(120)]  # a hot vector: ties
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, v()), (1001, 1, None), (1002, 1, [nan] + v()[1:]), (1003, 1, [inf] + v()[1:]), (1004, 1, [None] + v()[1:]), (None, 1, v()), (1005, 1, []), (1100, 2, []), (1200, 2, [])]
    rows += [(1300, 1, [1e30] * size), (1301, 1, [1e30] * size), (1302, 2, [1e30] * size), (1400, 0, [1e4] * size), (1401, 0, [1e4] * size), (1402, 1, [9e3] * size), (1500, 0, [0.5, 0.5]), (1501, 0, [0.5, 0.4]), (1502, 1, [0.4, 0.5]), (1503, 1, [0.0, 0.0])]
    rows = [(i, label, v and [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    return rows + [rows[100], rows[100], rows[3], (200, 2, rows[5][2]), (5, 0, rows[9][2])]


SCHEMA = "vec_id long, label int, embedding array<float>, down string, across int, score int, rank int, row string, positives int"


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "SMALL", 100)
    rows = _vectors()
    table = spark.createDataFrame([(*x, "d", 1, 2, 3, "r", 4) for x in rows], SCHEMA).repartition(3)
    out = hard_negatives.mine(table, F.col("vec_id") % 100 == 0)
    want = _mined(rows, lambda i: i % 100 == 0)
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect()) == want
    assert len(want) > 60 and any(x[0] == 1400 for x in want) and any(x[0] == 1500 for x in want)
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def _linked(rows, threshold):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    near = [[j for j in range(n) if i != j and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in near[i]]) for i in range(n)]
        if new == label:
            break
        label = new
    name = {}
    for i, (vec_id, _) in enumerate(rows):
        name[label[i]] = min(name.get(label[i], (True, 0)), (vec_id is None, vec_id or 0))
    out = []
    for i, (vec_id, _) in enumerate(rows):
        c = name[label[i]]
        c = None if c[0] else c[1]
        out.append((vec_id, len(near[i]), c, vec_id == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,rounds", [(256, 4), (16, 2), (8, 0)])
def test_near_vectors(spark, block, rounds):
    """With small blocks dense groups get cores, or are compared in pairs of blocks."""
    r = np.random.default_rng(8)
    v = lambda: r.standard_normal(12)
    base, other = v(), v()
    rows = [(i, v()) for i in range(60)]
    rows += [(100 + i, base + r.standard_normal(12) * s) for i, s in enumerate(np.repeat([0.001, 0.05, 0.12, 0.3], 20))]
    rows += [(200 + i, other * (1 + i % 3)) for i in range(30)] + [(300, other + 0.08 * v()), (301, base + (other - base) * 0.15)]
    rows = [(i, [float(x) for x in w]) for i, w in rows]
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [None, *[1.0] * 11]), (405, [0.0, 1.0]), (406, [0.0, 2.0]), (407, [1e300] * 12), (408, [1e-300] * 12), (None, rows[61][1]), (None, None), rows[62], rows[3], (None, rows[5][1]), (None, [3.0, 0.0]), (7, [2.0] * 12)]
    table = spark.createDataFrame([(i, w, "v", 1, "c") for i, w in rows], "vec_id long, embedding array<double>, v string, core int, bucket string").repartition(3)
    out = vector_dedup.near_vectors(table, 0.95, block, rounds)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    scale = [(i, w if w is None or not w or abs(w[0] or 1) not in (1e300, 1e-300) else [x / w[0] for x in w]) for i, w in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == _linked(scale, 0.95)
    assert vector_dedup.near_vectors(table.limit(0)).collect() == []


def test_pairs_at_the_threshold_are_found():
    """The chance that a table misses a pair, and what all of them miss at the threshold."""
    k, tables = vector_dedup.plan(50_000, 0.95)
    r = np.random.default_rng(2)
    a = r.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = r.standard_normal((4000, 32))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * side
    directions, shift = vector_dedup._directions(32, k, tables)
    steps = [np.floor((x @ directions + shift) / vector_dedup.WIDTH).reshape(4000, tables, k) for x in (a, b)]
    met = (steps[0] == steps[1]).all(2)
    near = vector_dedup.same_step(math.sqrt(0.1)) ** k
    assert abs(met.mean() - near) < 0.01 and (~met.any(1)).mean() < 0.004
