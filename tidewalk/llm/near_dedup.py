"""Near-duplicate components by a chosen-path set similarity join on MinHash values.

A document is the set of its distinct shingles of five words (A-Z in lower case, parted by ASCII white space), or of its
whole sequence if it has fewer words. Equal sets become one vertex. In each of ``TREES`` independent trees a path first chooses
two hash functions and follows the tokens (shingles) of least hash under them; a node of more than ``BLOCK`` members
branches on, each time on the least tokens under two further functions that its path chooses, and a small node is
compared exhaustively. At similarity s a pair meets in one tree's first node with chance s**2 and survives a deeper level
with chance 1 - (1 - s)**2, so sixteen trees miss fewer than one pair in a million at 0.8.

Nodes are compared on 128 MinHash values, which only drops pairs that agree in fewer places than a pair at the threshold does
with a chance below 1 in 100,000. What is similar by them makes clusters, equal ones of different trees count once, and
in each cluster the full shingle sets confirm links. A walk from member to linked member tests only those not yet
reached and hands on the links it walked, so a dense group yields a tree of links and not all its pairs. No node, pair
or partner is capped: a node that is still large at the last level is compared in pairs of blocks.

Defined results: null or wordless texts have 0 shingles and are linked with nothing, not even each other; a null
``doc_id`` is no component's name unless there is no other; documents of equal ``doc_id`` share what their texts give each;
repeated rows give repeated results; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewalk.llm.bytesets import SPACED, U, Words, mixed, slices
from tidewalk.llm.columns import fresh
from tidewalk.llm.scratch import cut

SHINGLE = 5
COORDINATES, TREES = 128, 16
#: Members of a node that are compared exhaustively; levels of branching.
BLOCK, LEVELS = 2048, 6
#: Shingles of the sets that a task confirms together; a cluster with more goes in pairs of parts.
TOGETHER = 4_000_000
#: Copies of a joined row that the rows of a hot key are dealt to.
SALT = 8
#: Documents whose names are broadcast to fetch their texts; beyond it the texts are shuffled.
BROADCAST_NAMES = 200_000

_random = np.random.default_rng(85)
_XOR = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    hashes, at = Words(data, at, SPACED).shingles(SHINGLE)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][at[:-1] < at[1:]]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def _sketch(batches):
    """doc_id, th, n, s1, s2 (hashes of the whole set), paths (first node in each tree), sig."""
    for batch in batches:
        for i, j, data, at in slices(batch.column(2), 1 << 20):
            hashes, at = shingle_sets(data, at)
            n = np.diff(at)
            full = np.flatnonzero(n)
            starts = at[full]
            paths = np.zeros((len(n), TREES), U)
            sig = np.zeros((len(n), COORDINATES), np.uint16)
            sums = np.zeros((2, len(n)), U)
            if len(full):
                for k in range(2):
                    run = np.concatenate([np.zeros(1, U), np.cumsum(mixed(hashes ^ U(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)), dtype=U)])
                    sums[k] = mixed(run[at[1:]] - run[at[:-1]])
                low = (hashes >> U(32)).astype(np.uint32)
                for k in range(COORDINATES):
                    least = np.minimum.reduceat((low ^ _XOR[k]) * _TIMES[k], starts)
                    sig[full, k] = (least & np.uint32(0xFFFF)).astype(np.uint16)
                    if k < 2 * TREES:
                        paths[full, k // 2] = mixed(paths[full, k // 2] ^ least.astype(U) + U(k))
            own = [batch.column(c).slice(i, j - i) for c in range(2)]
            yield pa.RecordBatch.from_arrays([
                *own, pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TREES), pa.array(paths.ravel().view(np.int64))),
                pa.array([bytes(x) for x in sig.view(np.uint8).reshape(len(n), -1)], pa.binary()),
            ], names=["doc_id", "th", "n", "s1", "s2", "paths", "sig"])


def _salted(left: DataFrame, right: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Inner join in which the rows of a hot key of ``left`` are dealt to several tasks by a hash of ``spread``."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    return left.join(right.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT))))), [*on, "salt"]).drop("salt")


def least_agreement(threshold: float) -> int:
    return max(0, math.floor(COORDINATES * threshold - 4.3 * math.sqrt(COORDINATES * threshold * (1 - threshold))))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COORDINATES)


def _groups(batches, key: int = 0):
    """Tables of all rows of one value of column ``key``, from batches sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if table.num_rows:
            ids = np.asarray(table.column(key))
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield table.slice(a, b - a)
            rest = table.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _agreeing(sig: np.ndarray, least: int, k: int, others: np.ndarray) -> np.ndarray:
    return others[(sig[others] == sig[k]).sum(1) >= least]


def _walk(n: int, linked):
    """Links of a forest that joins what ``linked(k, others)`` links: each member asks only for members not yet reached."""
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            k = todo.pop()
            found = linked(k, left)
            if len(found):
                left = left[~np.isin(left, found, True)]
                todo += found.tolist()
                yield from ((k, int(x)) for x in found)


def _parts(own: np.ndarray, size: np.ndarray, together: int) -> list[np.ndarray]:
    """The members as one group or, with more than ``together`` shingles, as all pairs of parts of half that size."""
    if size.sum() <= together or len(own) <= 2:
        return [own]
    part = np.cumsum(size) * 2 // together
    parts = [own[part == k] for k in np.unique(part)]
    return [np.concatenate([a, b]) for k, a in enumerate(parts) for b in parts[k + 1 :]] or [own]


def _clusters(batches, least: int, together: int):
    """cluster, v from node, v, sig, n sorted by node: members of a node that MinHash values join."""
    clusters, members = [], []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(np.array(clusters, np.int64)), pa.array(np.array(members, np.int64))], names=["cluster", "v"])
        clusters.clear()
        members.clear()
        return batch

    for table in _groups(batches):
        v, sig, size = np.asarray(table.column(1)), _matrix(table.column(2).combine_chunks()), np.asarray(table.column(3))
        root = np.arange(len(v))
        for a, b in _walk(len(v), lambda k, others: _agreeing(sig, least, k, others)):
            root[b] = root[a]
        order = np.argsort(root, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(root[order])) + 1, [len(v)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            joined = order[a:b][np.argsort(v[order[a:b]])]
            for own in _parts(v[joined], size[joined], together):
                name = int(mixed(np.bitwise_xor.reduce(mixed(own.astype(U)), keepdims=True) + U(len(own))).view(np.int64)[0])
                clusters += [name] * len(own)
                members += own.tolist()
        if len(members) > 100_000:
            yield out()
    yield out()


def _links(batches, least: int, percent: int):
    """a, b from cluster, v, sig, text sorted by cluster: confirmed links that join what is linked."""
    for table in _groups(batches):
        v, first = np.unique(np.asarray(table.column(1)), return_index=True)
        table = table.take(pa.array(first))
        sig = _matrix(table.column(2).combine_chunks())
        sets, at = [], [np.zeros(1, np.int64)]
        for _, _, data, own in slices(table.column(3), 1 << 20):
            hashes, own = shingle_sets(data, own)
            sets.append(hashes)
            at.append(own[1:] + at[-1][-1])
        at = np.concatenate(at)
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        size, mark = np.diff(at), np.zeros(len(names), np.int64)

        def linked(k, others):
            others = _agreeing(sig, least, k, others)
            others = others[100 * np.minimum(size[others], size[k]) >= percent * np.maximum(size[others], size[k])]
            if not len(others):
                return others
            n = size[others]
            offset = np.cumsum(n) - n
            mark[ids[at[k] : at[k + 1]]] = 1
            both = np.add.reduceat(mark[ids[np.arange(n.sum()) - np.repeat(offset - at[others], n)]], offset)
            mark[ids[at[k] : at[k + 1]]] = 0
            return others[100 * both >= percent * (n + size[k] - both)]

        pairs = np.array(list(_walk(len(v), linked)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(v[pairs[:, 0]]), pa.array(v[pairs[:, 1]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """v and label, the least vertex that it reaches: least labels of neighbours, with a jump to the label's label."""
    both = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))), "edges")
    labels = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        new = labels.join(near, "v").select("v", F.least("label", "near").alias("near"), F.col("label").alias("was"))
        jump = labels.select(F.col("v").alias("near"), F.col("label").alias("far"))
        new = cut(new.join(jump, "near").select("v", F.least("near", "far").alias("label"), "was"), "labels")
        if not new.filter("label < was").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _branches(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Children of large nodes by the least tokens under two hash functions that the node's path chooses."""
    rows = members.select("key", "v").join(sets.select("v", "sig"), "v")
    which = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(level), F.lit(k)), F.lit(COORDINATES)).cast("int") for k in range(2)]))
    rows = rows.select("key", "v", "sig", which.alias("i"))
    return rows.select(F.xxhash64("key", "i", F.substring(F.col("sig"), F.col("i") * 2 + 1, F.lit(2))).alias("key"), "v").distinct()


def _shared(nodes: DataFrame) -> DataFrame:
    """key, v, m of the nodes of at least two members."""
    return _salted(nodes, nodes.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), ["key"], "v")


def _block_pairs(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes of about ``block`` members in place of larger ones: every pair of blocks of half that size makes one."""
    blocks = F.ceil(F.col("m") / F.lit(max(1, block // 2))).cast("int")
    rows = nodes.withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("home", "other"), F.greatest("home", "other")).alias("key"), "v")


def near_duplicates(documents: DataFrame, threshold: float = 0.8, block: int = BLOCK, levels: int = LEVELS, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked with it, itself included), kept (doc_id is that), th (xxhash64 of the text) and leads.

    ``leads`` holds for one document of each component, the kept one of least th where several texts have its doc_id (and
    for all its repeated rows).
    """
    hashed = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sketches = cut(hashed.mapInArrow(_sketch, "doc_id long, th long, n long, s1 long, s2 long, paths array<long>, sig binary"), "sketches")
    full = sketches.filter("n > 0")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th", "n", "paths", "sig")  # rows without id come last
    sets = full.groupBy("s1", "s2").agg(F.min(row).alias("row"))
    sets = cut(sets.select("s1", "s2", "row.*").withColumn("v", F.monotonically_increasing_id()), "sets")

    least, percent = least_agreement(threshold), round(threshold * 100)
    nodes = cut(_shared(sets.select("v", F.posexplode("paths").alias("tree", "path")).select(F.xxhash64("tree", "path").alias("key"), "v")), "nodes")
    leaves = [nodes.filter(F.col("m") <= block).select("key", "v")]
    for level in range(levels):
        large = nodes.filter(F.col("m") > block)
        if not large.limit(1).count():
            break
        nodes = cut(_shared(_branches(large, sets, level)), "nodes")
        leaves.append(nodes.filter(F.col("m") <= block).select("key", "v"))
    else:
        leaves.append(_block_pairs(nodes.filter(F.col("m") > block), block))
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    small = small.join(sets.select("v", "sig", "n"), "v").select("key", "v", "sig", "n").repartition("key").sortWithinPartitions("key")
    clusters = cut(small.mapInArrow(lambda rows: _clusters(rows, least, together), "cluster long, v long").distinct(), "clusters")

    wanted = clusters.select("v").distinct().join(sets.select("v", F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "v")
    wanted = cut(wanted, "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    texts = hashed.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_NAMES else wanted, same).groupBy("v").agg(F.any_value("text").alias("text"))  # once for rows that repeat
    texts = clusters.join(texts, "v").join(sets.select("v", "sig"), "v").select("cluster", "v", "sig", "text")
    texts = texts.repartition("cluster").sortWithinPartitions("cluster")
    links = texts.mapInArrow(lambda rows: _links(rows, least, percent), "a long, b long").distinct()

    labels = components(cut(links, "links"))
    named = sets.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    names = named.groupBy("label").agg(F.min(F.struct("nameless", "doc_id", "th")).alias("name"))
    named = named.select("s1", "s2", "label").join(names, "label").select("s1", "s2", "name.*").withColumnsRenamed({"doc_id": "component_id", "th": "leader_th"}).drop("nameless")
    rows = _salted(full.select("doc_id", "th", "n", "s1", "s2"), named, ["s1", "s2"], "doc_id")
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("leader_th"))).alias("leads")]
    empty = sketches.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("leader_th", F.col("th"))
    return rows.select(*out).unionByName(empty.select(*out))


def one_of_each(documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the leading document, and one of its rows if they repeat.

    Documents without words are no component and stay, but of rows equal in doc_id and text one is left too: the least
    by the JSON of all columns.
    """
    id_, th, copies, row = fresh(documents, "id", "th", "copies", "row")
    found = cut(near_duplicates(documents, threshold), "near")
    named = found.select(F.col("doc_id").alias(id_), F.col("th").alias(th), "leads")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(th))
    kept = documents.join(named.filter(~F.col("leads")).drop("leads").distinct(), same, "left_anti")
    again = named.filter("leads").groupBy(id_, th).agg(F.count("*").alias(copies)).filter(F.col(copies) > 1).drop(copies)
    repeated = kept.join(again, same, "left_semi")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    repeated = repeated.groupBy(F.col("doc_id").alias(id_), F.xxhash64("text").alias(th)).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias(row)).select(f"{row}.*")
    return kept.join(again, same, "left_anti").unionByName(repeated)
