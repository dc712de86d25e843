"""Mix sources to target weights with a low-discrepancy schedule.

The documents of a source, shuffled by a hash, form a line of words that is cut into blocks of equal length. Slots of
the mix are golden-ratio points that fall through the cumulative weights onto sources; the r-th slot of a source takes
its r-th block, and starts over after the last. Ranks and positions come from two-level prefix sums (within a bucket,
then over the few buckets of a source), so that a hot source never meets in one task.

Defined results: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, after
all others; a null ``doc_id`` is kept; repeated rows are documents of their own, and rows equal in ``doc_id``, source and
size are interchangeable; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewalk.llm.scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast to the documents; beyond it the join is shuffled with salted keys.
BROADCAST_SOURCES = 10_000
#: Buckets of a source's shuffled documents, and slots that are ranked together.
DOC_BUCKETS, SLOT_CHUNK = 4096, 65_536
#: Golden-ratio step as a fraction of 2**31: slot k lies at k * STEP mod 2**31.
STEP, POINTS = 1_327_217_885, 1 << 31
#: Equal parts of [0, 1) by which points find the source that they fall on.
GRID = 4096
SALT = 16


def word_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of each document."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Sources in order of code points (null last) get the weights in turn. The targets share ``share`` times all words;
    none is above ``max_repeats`` times its source. Sharing the excess by weight until none is above means a common
    level L with target = min(cap, weight * L); with sources in order of cap / weight, L is the largest of
    (total - caps before) / (weights from here on).
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("sid", F.row_number().over(by_code_point) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    rows = rows.withColumn("before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("left")).over(everything))
    return rows.select("sid", "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _with_source(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    if n_sources <= BROADCAST_SOURCES:
        return sizes.join(F.broadcast(sources), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    salted = sources.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALT)).cast("int"))
    return sizes.join(salted, sizes["source"].eqNullSafe(salted["source"]) & (sizes["salt"] == salted["salt"])).drop(salted["source"], "salt")


def shuffled_positions(sizes: DataFrame) -> DataFrame:
    """sizes (with sid) plus lo and hi: the words of the source's shuffled line that a document holds."""
    hashed = sizes.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    hashed = hashed.withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % DOC_BUCKETS).cast("int"))
    sums = hashed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_lo"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("end", F.sum("size").over(within)).join(sums, ["sid", "bucket"])
    return placed.withColumn("hi", F.col("bucket_lo") + F.col("end")).withColumn("lo", F.col("hi") - F.col("size")).drop("h", "bucket", "end", "bucket_lo")


def slot_schedule(sources: DataFrame, block_tokens: int) -> DataFrame:
    """The mix in order: slot, sid, block, begin, end (a range of the source's shuffled line).

    A source needs ``need`` slots: whole rounds over its blocks, then blocks up to the rest of its target, the last
    one cut. Ranks beyond that are dropped, and ranks that the points leave out follow at the end.
    """
    size, target = F.col("source_size"), F.col("want")
    rows = sources.withColumn("want", F.floor("target").cast("long")).filter("source_size > 0 and want > 0")
    rows = rows.withColumn("rounds", F.floor(target / size)).withColumn("rest", target - F.col("rounds") * size)
    rows = rows.withColumn("blocks", F.ceil(size / F.lit(block_tokens)))
    rows = rows.withColumn("need", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(block_tokens)))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(rows.withColumn("to", F.sum("need").over(upto)).withColumn("from", F.col("to") - F.col("need")), "mix-need")
    n = rows.agg(F.max("to")).first()[0] or 0
    parts = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * GRID / F.lit(n)), F.floor((F.col("to") - 1) * GRID / F.lit(n))))) if n else rows.withColumn("cell", F.lit(0))
    points = rows.sparkSession.range(n).select(F.col("id").alias("k"), (((F.col("id") + 1) % POINTS * STEP % POINTS) / F.lit(POINTS) * n).alias("x"))
    points = points.withColumn("at", F.floor("x")).withColumn("cell", F.floor(F.col("at") * GRID / F.lit(max(n, 1))))
    hits = points.join(parts.select("cell", "sid", "from", "to"), "cell").filter("at >= `from` and at < `to`").withColumn("chunk", F.floor(F.col("k") / SLOT_CHUNK)).select("k", "chunk", "sid")
    counts = hits.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "chunk").orderBy("k")
    ranked = hits.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["sid", "chunk"]).select("sid", "k", (F.col("r") + F.col("offset")).alias("rank"))
    ranked = ranked.join(rows, "sid").filter("rank < need")
    had = counts.groupBy("sid").agg(F.sum("n").alias("had"))
    late = rows.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need").withColumn("rank", F.explode(F.sequence("had", F.col("need") - 1)))
    late = late.withColumn("k", F.lit(n) + F.col("from") + F.col("rank"))
    slots = ranked.unionByName(late.select(*ranked.columns))
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("begin", F.col("block") * block_tokens)
    end = F.least(F.col("begin") + block_tokens, size)
    return slots.select(F.col("k").alias("slot"), "sid", "block", "begin", F.when((F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0), F.col("rest")).otherwise(end).alias("end"))


def mix_pieces(documents: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, block_tokens: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The mix itself, and the placed documents.

    Pieces: slot (their order), doc_id, sid, lo, begin, end: the slot takes the words from ``begin`` to ``end`` of the
    document, counted from 0. Placed: doc_id, sid, source, size, source_size, target, lo, hi.
    """
    sizes = cut(word_sizes(documents), "mix-sizes")
    sources = cut(source_targets(sizes, weights, share, max_repeats), "mix-sources")
    n_sources = sources.count()
    placed = cut(shuffled_positions(_with_source(sizes, sources, n_sources)), "mix-placed")
    slots = slot_schedule(sources, block_tokens)
    pieces = placed.filter("size > 0").select("sid", "doc_id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block_tokens), F.floor((F.col("hi") - 1) / block_tokens))).alias("block"))
    pieces = pieces.join(slots, ["sid", "block"])
    pieces = pieces.withColumn("b", F.greatest("lo", "begin")).withColumn("e", F.least("hi", "end")).filter("b < e")
    return pieces.select("slot", "doc_id", "sid", "lo", (F.col("b") - F.col("lo")).alias("begin"), (F.col("e") - F.col("lo")).alias("end")), placed


def mix(documents: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, source. Options: ``mix_pieces``."""
    pieces, placed = mix_pieces(documents, **options)
    taken = pieces.groupBy("sid", "lo").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    full = placed.filter("size > 0").join(taken, ["sid", "lo"], "left")
    out = ["doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "source"]
    return full.select(*out).unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0)).select(*out))
