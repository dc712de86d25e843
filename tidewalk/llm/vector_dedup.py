"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length 1; equal ones become one vertex. In each of several tables a vertex' bucket is a tuple of projections on random
normal directions, shifted and cut to steps of ``WIDTH``: two vectors share a step with a chance that only depends on their distance.
From the number of vertices follows how many projections make a bucket (so that a vertex seldom meets an unrelated one in it) and from
these how many tables are asked for (so that a pair at the threshold is missed with a chance of ``MISS`` at most; nearer pairs far less
often). Vectors that share a bucket are compared in double precision.

Large buckets come from dense groups, whose pairs are never listed: a few rounds choose a pivot in each of them, and the vertices
within half of the threshold's angle of it make a core, in which all are linked with all (the triangle inequality of angles). Then
buckets that hold a single core are done, and others compare only what isn't of one core, in blocks where they are still large.
A pair counts in the first table that has it in one bucket, so links are counted, not listed and made distinct.

Defined results: vectors that are null, empty or zero, or have null or non-finite components link with nothing; vectors of unequal
lengths neither; copies are vectors of their own and count as links of each other, also in repeated rows; a null ``vec_id`` is no
component's name unless there is no other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewalk.llm.bytesets import U, _stirred, mixed
from tidewalk.llm.near_dedup import _groups, _salted, components
from tidewalk.llm.scratch import cut
from tidewalk.llm.vectors import matrices, units

WIDTH, MISS = 2.0, 0.001
#: Vertices for which there are buckets at least; buckets for each vertex, so that few hold unrelated ones, whose vectors would be shuffled.
LEAST_VERTICES, ROOM = 1000, 16
#: Members of a bucket that are compared in one group; rounds in which larger ones get cores.
BLOCK, ROUNDS = 256, 4
#: Angles that are nearer to a core's bound than this are compared.
SLACK = 1e-6
#: Vectors whose projections are taken together.
TOGETHER = 4096


def same_step(distance: float, width: float = WIDTH) -> float:
    """The chance that a projection puts two vectors of this distance in one step."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(vertices: int, threshold: float) -> tuple[int, int]:
    """Projections of a bucket, and tables."""
    near, far = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2))
    k = max(1, math.ceil(math.log(ROOM * max(vertices, LEAST_VERTICES)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-(near**k))))


@functools.lru_cache(4)
def _directions(n: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors of n components."""
    r = np.random.default_rng([n, k, tables, 13])
    return r.standard_normal((n, k * tables)), r.uniform(0, WIDTH, k * tables)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _named(batches):
    """vec_id, name: a digest of the scaled vector, null without a direction; unit: its components."""
    for batch in batches:
        names, rows = [None] * batch.num_rows, [None] * batch.num_rows
        for at, matrix in matrices(batch.column(1)):
            some, scaled = units(matrix)
            for i, x in zip(at[some].tolist(), scaled):
                rows[i] = data = x.tobytes()
                names[i] = hashlib.blake2b(data, digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(rows, pa.binary())], names=["vec_id", "name", "unit"])


def _units(column: pa.Array | pa.ChunkedArray):
    """Rows and matrix of the vectors of each length."""
    data = column.to_pylist()
    size = np.array([len(x) // 8 for x in data])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, np.frombuffer(b"".join(data[i] for i in rows), np.float64).reshape(len(rows), n)


def _buckets(batches, k: int, tables: int):
    """v and buckets (one of each table) of v, unit."""
    for batch in batches:
        for part in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(part, TOGETHER)
            out = np.zeros((rows.num_rows, tables), U)
            for at, matrix in _units(rows.column(1)):
                directions, shift = _directions(matrix.shape[1], k, tables)
                steps = np.floor((matrix @ directions + shift) / WIDTH).astype(np.int64).view(U).reshape(len(at), tables, k)
                h = np.tile(np.arange(tables).astype(U) + U(matrix.shape[1] << 20), (len(at), 1))
                for j in range(k):
                    h = mixed(_stirred(h, steps[:, :, j]))
                out[at] = h
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(out.view(np.int64))], names=["v", "buckets"])


def _angles(batches):
    """v, pivot, angle of v, pivot, unit, other."""
    for batch in batches:
        angle = np.full(batch.num_rows, np.pi)
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i, (x, y) in enumerate(zip(a, b)):
            if len(x) == len(y):
                angle[i] = math.acos(max(-1.0, min(1.0, float(np.frombuffer(x) @ np.frombuffer(y)))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angle)], names=["v", "pivot", "angle"])


def _compared(batches, threshold: float):
    """v, n (copies of what it is linked with), core, other (a core that is reached from its own) of tile, side, t, v, core, copies, unit, buckets sorted by tile.

    Members of side 1 are compared with those of side 2, those of side 0 with each other; a tile has either.
    """
    for table in _groups(batches):
        side, v, core, copies = (np.asarray(table.column(c)) for c in (1, 3, 4, 5))
        t = int(table.column(2)[0].as_py())
        buckets = np.asarray(table.column(7).combine_chunks().flatten()).reshape(len(v), -1)
        label = np.arange(len(v))
        linked = np.zeros(len(v), np.int64)
        for rows, matrix in _units(table.column(6)):
            near = matrix @ matrix.T >= threshold
            near &= (core[rows][:, None] != core[rows][None, :]) & (np.arange(len(rows))[:, None] < np.arange(len(rows)))
            if side.any():
                near &= side[rows][:, None] != side[rows][None, :]
            i, j = np.nonzero(near)
            i, j = rows[i], rows[j]
            first = np.ones(len(i), bool)
            for part in range(0, len(i), TOGETHER):
                own = slice(part, part + TOGETHER)
                first[own] = ~(buckets[i[own], :t] == buckets[j[own], :t]).any(1)
            i, j = i[first], j[first]
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
            while len(i):
                least = np.minimum(label[i], label[j])
                if (least == label[i]).all() and (least == label[j]).all():
                    break
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
        some = np.flatnonzero(linked)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (v, linked, core, core[label])], names=["v", "n", "core", "other"])


def _cores(vertices: DataFrame, entries: DataFrame, threshold: float, block: int, rounds: int) -> DataFrame:
    """v and core (a pivot) of the vertices within half of the threshold's angle of a pivot; there are pivots in buckets of more than ``block`` others."""
    spark = vertices.sparkSession
    cores = None
    for _ in range(rounds):
        free = entries if cores is None else entries.join(cores, "v", "left_anti")
        hot = cut(free.groupBy("t", "bucket").agg(F.count("*").alias("m"), F.min("v").alias("pivot")).filter(F.col("m") > block), "hot")
        if not hot.limit(1).count():
            break
        # each vertex in the largest of its buckets
        near = _salted(free, hot, ["t", "bucket"], "v").groupBy("v").agg(F.max(F.struct("m", "pivot")).alias("to")).select("v", "to.pivot")
        pivots = near.select("pivot").distinct().join(vertices.select(F.col("v").alias("pivot"), F.col("unit").alias("other")), "pivot")
        both = _salted(near.join(vertices.select("v", "unit"), "v"), pivots, ["pivot"], "v").select("v", "pivot", "unit", "other")
        angle = math.acos(threshold) / 2 - SLACK
        found = both.mapInArrow(_angles, "v long, pivot long, angle double").filter(F.col("angle") <= angle).select("v", F.col("pivot").alias("core"))
        cores = cut(found if cores is None else cores.unionByName(found), "cores")
    return cores if cores is not None else spark.createDataFrame([], "v long, core long")


def _tiles(entries: DataFrame, block: int) -> DataFrame:
    """tile, side, t, v, core: what is to be compared, from t, bucket, v, core (null for vertices of none)."""
    own = F.coalesce("core", "v")
    sizes = entries.groupBy("t", "bucket").agg(F.count("*").alias("m"), F.min(own).alias("low"), F.max(own).alias("high"))
    rows = cut(_salted(entries, sizes.filter("low < high").select("t", "bucket", "m"), ["t", "bucket"], "v"), "shared")
    small = rows.filter(F.col("m") <= block).select(F.xxhash64("t", "bucket").alias("tile"), F.lit(0).alias("side"), "t", "v", "core")
    large = rows.filter(F.col("m") > block).withColumn("part", F.coalesce("core", F.lit(-1)))
    parts = large.groupBy("t", "bucket", "part").agg(F.ceil(F.count("*") / F.lit(max(1, block // 2))).cast("int").alias("of"))
    blocks = cut(parts.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("of") - 1))), "blocks")
    key = lambda side: F.struct(F.col(f"{side}.part"), F.col(f"{side}.nth"))
    a, b = blocks.alias("a"), blocks.alias("b")
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.bucket") == F.col("b.bucket"))
    pairs = a.join(b, same & (key("a") <= key("b")) & ((F.col("a.part") != F.col("b.part")) | (F.col("a.part") == -1)))
    tile = F.xxhash64("a.t", "a.bucket", "a.part", "a.nth", "b.part", "b.nth")
    member = lambda side, n: F.struct(F.col(f"{side}.part").alias("part"), F.col(f"{side}.nth").alias("nth"), F.lit(n).alias("side"))
    members = F.when(key("a") == key("b"), F.array(member("a", 0))).otherwise(F.array(member("a", 1), member("b", 2)))
    members = pairs.select(F.col("a.t").alias("t"), F.col("a.bucket").alias("bucket"), tile.alias("tile"), F.explode(members).alias("x")).select("t", "bucket", "tile", "x.*")
    large = large.join(parts, ["t", "bucket", "part"]).withColumn("nth", F.pmod(F.xxhash64("v"), F.col("of")).cast("int"))
    large = large.join(members, ["t", "bucket", "part", "nth"]).select("tile", "side", "t", "v", "core")
    return small.unionByName(large)


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, n_links (other rows whose cosine is at least the threshold), component_id (least vec_id reached by links, itself included), kept (vec_id is that)."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = cut(embeddings.select("vec_id", "embedding").mapInArrow(_named, f"vec_id {kind}, name binary, unit binary"), "named")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("nameless"), "vec_id")).alias("first")
    vertices = rows.filter("name is not null").groupBy("name").agg(first, F.count("*").alias("copies"), F.any_value("unit").alias("unit"))
    vertices = cut(vertices.withColumn("v", F.monotonically_increasing_id()), "vertices")
    k, tables = plan(vertices.count(), threshold)
    hashed = cut(vertices.select("v", "unit").mapInArrow(lambda batches: _buckets(batches, k, tables), "v long, buckets array<long>"), "buckets")
    entries = cut(hashed.select("v", F.posexplode("buckets").alias("t", "bucket")), "entries")

    cores = _cores(vertices, entries, threshold, block, rounds)
    cored = cut(vertices.select("v", "copies", "first").join(cores, "v", "left"), "cored")
    tiles = _tiles(entries.join(cored.select("v", "core"), "v", "left"), block).withColumn("core", F.coalesce("core", "v"))
    full = tiles.join(vertices.select("v", "copies", "unit"), "v").join(hashed, "v").select("tile", "side", "t", "v", "core", "copies", "unit", "buckets")
    full = full.repartition("tile").sortWithinPartitions("tile")
    found = cut(full.mapInArrow(lambda batches: _compared(batches, threshold), "v long, n long, core long, other long"), "links")

    edges = found.filter("core <> other").select(F.col("core").alias("a"), F.col("other").alias("b")).distinct()
    labels = components(edges)
    linked = found.groupBy("v").agg(F.sum("n").alias("n"))
    cored = cored.withColumn("own", F.coalesce("core", "v"))
    groups = cored.groupBy("own").agg(F.sum("copies").alias("total"), F.min("first").alias("first"))
    groups = groups.join(labels.withColumnRenamed("v", "own"), "own", "left").withColumn("label", F.coalesce("label", "own"))
    names = groups.groupBy("label").agg(F.min("first").alias("to"))
    groups = _salted(groups.select("own", "total", "label"), names, ["label"], "own").select("own", "total", F.col("to.vec_id").alias("component_id"))
    of = _salted(cored.select("v", "own"), groups, ["own"], "v").select("v", "total", "component_id")
    of = vertices.select("v", "name").join(of, "v").join(linked, "v", "left")
    of = of.select("name", (F.col("total") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = _salted(rows.filter("name is not null").select("vec_id", "name"), of, ["name"], "vec_id")
    none = rows.filter("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(none)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
