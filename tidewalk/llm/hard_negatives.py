"""Hard negatives by exact integer scores: residue-number-system products of matrices, then windowed selection.

Components become floor(``SCALE`` * x). Blocks of anchors are multiplied with blocks of rows modulo several small primes, each time
as a float32 product of residues about 0: so few components at a time that every sum stays below 2**24 and is exact. Chinese
remaindering gives the signed scores; as many primes are taken as the block's largest components ask for, so a score is right
whatever its size. A first pass finds each anchor's best rows of its own label, a second one, for each of these, the best rows of other
labels whose scores lie in the window that it opens; blocks keep only what can be among the first ones, and ranks over the few
left of each block settle the rest.

Anchors and rows meet as blocks of a grid: a hash of ``vec_id`` deals anchors to columns and rows to rows, each anchor goes once to each
row of the grid and each row once to each column. A task holds one block of either, whatever the labels and however often a
vector stands there.

Defined results: rows with a null ``vec_id`` or label, a null vector, or null or non-finite components take no part, neither do those with
components of 2**700 or more; of rows of equal ``vec_id`` the one of least label, then least vector, counts; vectors of unequal
lengths aren't compared, empty ones score 0 with each other; a pair whose score no long holds is left out; equal scores are ranked by
``vec_id``; an anchor without positives or a positive without negatives in its window gives no row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.llm.scratch import cut
from tidewalk.llm.vectors import matrices

SCALE = 256
#: Anchors and rows of a block of the grid.
ANCHORS, ROWS = 8192, 32768
#: Rows of the smaller blocks into which few rows are dealt.
SMALL = 1024
#: Rows, and anchors, that are multiplied at once.
TILE_ROWS, TILE_ANCHORS = 4096, 512
#: Scores up to this take the way of 64-bit integers; beyond it, Python's.
NARROW = 1 << 46
LARGEST = 2.0**700
EXACT = 1 << 24


def _primes(below: int) -> list[int]:
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for k in range(2, math.isqrt(below) + 1):
        sieve[k * k :: k] = False
    return np.flatnonzero(sieve)[::-1].tolist()


PRIMES = _primes(1024)


def _residues(values: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p about 0, as float32."""
    r = np.mod(values, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """All inner products of rows of a and b, matrices of whole numbers as float64; none may exceed ``bound``.

    The result is of int64, or of Python's integers if the bound is beyond ``NARROW``.
    """
    kind = np.int64 if bound <= NARROW else object
    out, modulus = np.zeros((len(a), len(b)), kind), 1
    for p in PRIMES:
        if modulus > 2 * bound:
            break
        r, s, step = _residues(a, p), _residues(b, p), EXACT // (p // 2) ** 2
        dot = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], step):
            dot += (r[:, k : k + step] @ s[:, k : k + step].T).astype(np.int64)
        more = (dot - (out % p).astype(np.int64)) % p * pow(modulus, -1, p) % p
        out += more.astype(kind) * modulus
        modulus *= p
    if modulus <= 2 * bound:
        raise ValueError("components are too large for the primes")
    return np.where(out > modulus // 2, out - modulus, out)


def _blocks(left: pa.Table, right: pa.Table):
    """anchors (indices), their whole components, rows (indices), theirs, bound on scores: pairs of blocks of one length, for narrow and wide ones."""

    def split(table):
        for rows, matrix in matrices(table.column("embedding")):
            whole = np.floor(matrix * SCALE)
            most = np.abs(whole).max(1)
            fits = most < LARGEST
            wide = most * most * matrix.shape[1] > NARROW
            for part in (~wide & fits, wide & fits):
                if part.any():
                    yield rows[part], whole[part], int(most[part].max())
        empty = np.flatnonzero(np.asarray([x == 0 for x in table.column("embedding").combine_chunks().value_lengths().to_pylist()], bool))
        if len(empty):
            yield empty, np.zeros((len(empty), 0)), 0

    rights = list(split(right))
    for anchors, a, most in split(left):
        for rows, b, largest in rights:
            if a.shape[1] == b.shape[1]:
                yield anchors, a, rows, b, most * largest * a.shape[1]


def _keys(a: np.ndarray, b: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Scores with places in one number, larger for larger scores and then smaller places; and one less than any of them."""
    scores, n = products(a, b, bound), len(b)
    least = -(bound + 1) * n
    keys = scores * n + np.arange(n - 1, -1, -1)
    if scores.dtype == object:
        keys[(scores > (1 << 63) - 1) | (scores < -(1 << 63))] = least
    return keys, least


def _decoded(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places."""
    return keys // n, n - 1 - keys % n


def _tiles(left: pa.Table, right: pa.Table):
    """_blocks in parts of which a product is held in memory."""
    for anchors, a, rows, b, bound in _blocks(left, right):
        for i in range(0, len(a), TILE_ANCHORS):
            for j in range(0, len(b), TILE_ROWS):
                yield anchors[i : i + TILE_ANCHORS], a[i : i + TILE_ANCHORS], rows[j : j + TILE_ROWS], b[j : j + TILE_ROWS], bound


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("vec_id").combine_chunks()


def _positives(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """anchor_id, vec_id, score: each anchor's first k rows of its label in a block."""
    left, right = _sorted(left), _sorted(right)
    ids, labels, own, own_labels = (np.asarray(t.column(c)) for t, c in ((right, "vec_id"), (right, "label"), (left, "vec_id"), (left, "label")))
    out: list[list] = [[], [], []]
    for anchors, a, rows, b, bound in _tiles(left, right):
        for label in np.unique(own_labels[anchors]).tolist():
            x, y = np.flatnonzero(own_labels[anchors] == label), np.flatnonzero(labels[rows] == label)
            if not len(y):
                continue
            keys, least = _keys(a[x], b[y], bound)
            keys[own[anchors[x]][:, None] == ids[rows[y]][None, :]] = least
            keys = np.sort(np.partition(keys, len(y) - k, 1)[:, -k:] if len(y) > k else keys, 1)[:, ::-1]
            i, j = np.nonzero(keys > least)
            score, place = _decoded(keys[i, j], len(y))
            out[0].append(own[anchors[x[i]]])
            out[1].append(ids[rows[y[place.astype(np.int64)]]])
            out[2].append(score.astype(np.int64))
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], names=["anchor_id", "vec_id", "score"])


def _negatives(left: pa.Table, right: pa.Table, k: int, lower: int, upper: int) -> pa.Table:
    """anchor_id, positive_id, positive_score, vec_id, score: the first k rows of other labels in each positive's window in a block."""
    left, right = _sorted(left), _sorted(right)
    ids, labels, own, own_labels = (np.asarray(t.column(c)) for t, c in ((right, "vec_id"), (right, "label"), (left, "vec_id"), (left, "label")))
    positives = left.column("positives").to_pylist()
    out: list[list] = [[], [], [], [], []]
    for anchors, a, rows, b, bound in _tiles(left, right):
        n = len(rows)
        keys, least = _keys(a, b, bound)
        keys[own_labels[anchors][:, None] == labels[rows][None, :]] = least
        keys.sort(1)
        clip = lambda x: max(-bound, min(bound + 1, x)) * n  # noqa: E731, B023
        for i, anchor in enumerate(anchors.tolist()):
            for p in positives[anchor]:
                low = -((-lower * p["score"]) // 100)
                edges = np.array([max(clip(low), least + 1), clip(upper * p["score"] // 100 + 1)], keys.dtype)
                first, last = np.searchsorted(keys[i], edges).tolist()
                found = keys[i, max(first, last - k) : last] if last > first else keys[i, :0]
                score, place = _decoded(found, n)
                out[0] += [own[anchor]] * len(found)
                out[1] += [p["vec_id"]] * len(found)
                out[2] += [p["score"]] * len(found)
                out[3] += ids[rows[place.astype(np.int64)]].tolist()
                out[4] += score.tolist()
    return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])


def _firsts(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group by score and vec_id, with their rank; Spark limits groups before it shuffles them."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchors, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings: vec_id, label, embedding. anchors: a condition on these. A negative's score lies between ``lower`` and ``upper`` percent of
    the positive's.
    """
    spark = embeddings.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    rows = cut(rows, "vectors")
    queries = rows.filter(anchors)
    n, wide = rows.count(), max(1, -(-queries.count() // ANCHORS))
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deep = max(1, -(-n // ROWS), min(2 * parallel, n // SMALL))
    place = lambda size: F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = rows.withColumn("down", place(deep)).withColumn("across", every(wide)).groupBy("down", "across")
    dealt = lambda own: own.withColumn("across", place(wide)).withColumn("down", every(deep)).groupBy("down", "across")

    found = dealt(queries).cogroup(grid).applyInArrow(lambda left, right: _positives(left, right, positives), "anchor_id long, vec_id long, score long")
    own = _firsts(found, ["anchor_id"], positives).groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asked = cut(queries.join(own, F.col("anchor_id") == F.col("vec_id")).drop("anchor_id"), "asked")
    found = dealt(asked).cogroup(grid).applyInArrow(lambda left, right: _negatives(left, right, negatives, lower, upper), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    out = _firsts(found, ["anchor_id", "positive_id"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
