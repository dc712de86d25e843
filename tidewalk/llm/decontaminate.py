"""Benchmark decontamination by winnowing.

Texts are words of digits, letters (A-Z in lower case) and characters from U+0080. In each window of 13 words the k-gram
of least hash is kept as a fingerprint, for documents and items alike, so every shared span of 13 words shares one.
Items of fewer words are one window each, and documents are winnowed at those lengths too.

The items' fingerprints, as bits of a map of fixed size, go to the tasks that scan the documents; fingerprints that can't be an item's stay
there. Those left are extended to all windows that choose them and joined with the items' windows as tables, by
fingerprint and 128 bits of hashes over all words of the window (two sums of unrelated hashes of the words). A frequent passage is
dealt to several tasks; Spark broadcasts the items' side if it is small. One pass over the documents serves any size of
benchmark: a larger one only lets more windows pass the map.

Defined results: null and empty texts have no words and no hits; items without words match nothing; items of equal id
count once, an item without id as the empty string; rows equal in ``doc_id`` and text get equal results; an empty table on
either side gives no hits; further columns stay, but those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewalk.llm.bytesets import ALNUM, U, Words, mixed, prefix_sums, slices, sliding_min, span_hashes
from tidewalk.llm.columns import fresh
from tidewalk.llm.scratch import cut

WINDOW, K = 13, 5
#: Bits of the map of the items' fingerprints (a power of two).
MAP_BITS = 26
#: Parts that the rows of a frequent window are dealt to.
SALT = 8
RESULTS = ["n_words", "hits", "items", "n_hit", "contaminated"]
KEY = ["fingerprint", "n", "h1", "h2"]


def _windows(words: Words, n: int) -> np.ndarray:
    """Starts of all runs of n words that lie in one text."""
    counts = np.maximum(np.diff(words.at) - n + 1, 0)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - words.at[:-1], counts)


class _Winnowed:
    """Fingerprints and hashes of the windows of a run of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.words = Words(data, at, ALNUM)
        self.sums = [prefix_sums(self.words.hash), prefix_sums(self.words.hashes(1))]

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of n words and, for each, the hash of its least k-gram."""
        starts, k = _windows(self.words, n), min(K, n)
        if not len(starts):
            return starts, np.zeros(0, U)
        at = np.arange(len(self.words.hash) - k + 1)
        grams = span_hashes(self.sums[0], at, at + k)
        return starts, grams[sliding_min(grams, n - k + 1)[starts]]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [span_hashes(s, start, end) for s in self.sums]


def _bit(fingerprints: np.ndarray, n) -> np.ndarray:
    return (mixed(fingerprints + np.asarray(n).astype(U)) >> U(64 - MAP_BITS)).astype(np.int64)


def _item_windows(batches):
    """item, fingerprint, n (words of the window), h1, h2, bit of every item window."""
    for batch in batches:
        ids = batch.column(0).cast(pa.string()).fill_null("")
        for i, j, data, at in slices(batch.column(1)):
            texts = _Winnowed(data, at)
            size = np.diff(texts.words.at)
            for n in np.unique(np.minimum(size, WINDOW))[:].tolist():
                if not n:
                    continue
                starts, fps = texts.fingerprints(n)
                text = np.searchsorted(texts.words.at, starts, "right") - 1
                own = (size[text] == n) | (n == WINDOW)  # shorter windows only of items of that length
                starts, fps, text = starts[own], fps[own], text[own]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i).take(pa.array(text)), pa.array(fps.view(np.int64)), pa.array(np.full(len(starts), n, np.int32)),
                    *[pa.array(h.view(np.int64)) for h in texts.hashes(starts, starts + n)], pa.array(_bit(fps, n)),
                ], names=["item", *KEY, "bit"])


def _fingerprint_map(windows: DataFrame) -> np.ndarray:
    """The bits of all fingerprints, 64 in a value; it has 2**MAP_BITS bits whatever the number of items."""
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = windows.groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), U)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(U)
    return out


def _scan(batches, known: np.ndarray, lengths: list[int]):
    """doc_id, th, n_words, windows (those whose fingerprint may be an item's) of each text."""
    for batch in batches:
        for i, j, data, at in slices(batch.column(2)):
            texts = _Winnowed(data, at)
            starts, sizes, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for n in lengths:
                start, fp = texts.fingerprints(n)
                bit = _bit(fp, n)
                hit = np.flatnonzero(known[bit >> 6] >> (bit & 63).astype(U) & U(1))
                starts.append(start[hit])
                sizes.append(np.full(len(hit), n))
                fps.append(fp[hit])
            start, n, fp = np.concatenate(starts), np.concatenate(sizes), np.concatenate(fps)
            order = np.argsort(start, kind="stable")
            start, n, fp = start[order], n[order], fp[order]
            text = np.searchsorted(texts.words.at, start, "right") - 1
            h1, h2 = texts.hashes(start, start + n)
            windows = pa.StructArray.from_arrays([
                pa.array((start - texts.words.at[text]).astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
            ], ["s", *KEY])
            offsets = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
            own = [batch.column(c).slice(i, j - i) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(texts.words.at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), windows)], names=["doc_id", "th", "n_words", "windows"])


def _merged(runs: Column) -> Column:
    """Number of words in the union of the runs."""
    total = F.aggregate(
        F.array_sort(runs), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, r: F.struct(F.greatest(a["to"], r["e"]).alias("to"), (a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(a["to"], r["s"]))).alias("n")),
    )
    return F.when(F.size(runs) == 0, F.lit(0)).otherwise(total["n"])


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document without its text: doc_id, th (xxhash64 of the text), n_words, hits (windows of hit words, start and end), items, n_hit, contaminated.

    contaminated: at least one word is hit, and at least 5 % are.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    windows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_item_windows, "item string, fingerprint long, n int, h1 long, h2 long, bit long")
    windows = cut(windows.distinct(), "item-windows")
    known = documents.sparkSession.sparkContext.broadcast(_fingerprint_map(windows))
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most WINDOW of them
    texts = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    schema = f"doc_id {kind}, th long, n_words long, windows array<struct<s:int,fingerprint:long,n:int,h1:long,h2:long>>"
    scanned = cut(texts.mapInArrow(lambda batches: _scan(batches, known.value, lengths), schema), "scanned")

    found = scanned.select("doc_id", "th", F.explode("windows").alias("w")).select("doc_id", "th", "w.*")
    found = found.withColumn("salt", F.pmod(F.hash("th", "s"), F.lit(SALT)))
    # windows that the same items hold have one name for these (two xors of 64-bit hashes), so that a passage of many items meets them once a document, not once a window
    keys = windows.groupBy(*KEY).agg(F.bit_xor(F.xxhash64("item")).alias("i1"), F.bit_xor(F.xxhash64(F.lit("items"), "item")).alias("i2"))
    keys = cut(keys, "item-keys")
    dealt = keys.select(*KEY, "i1", "i2", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    found = found.join(dealt, [*KEY, "salt"]).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    found = cut(found.agg(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e"))).alias("hits"), F.collect_set(F.struct("i1", "i2")).alias("sets")), "hits")
    first = keys.groupBy("i1", "i2").agg(F.min(F.struct(*KEY)).alias("key")).select("i1", "i2", "key.*")
    members = first.join(windows, KEY).select("i1", "i2", "item")
    named = found.select("_id", "_th", F.explode("sets").alias("i")).select("_id", "_th", "i.*", F.pmod(F.xxhash64("_id", "_th"), F.lit(SALT)).cast("int").alias("salt"))
    members = members.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    named = named.join(members, ["i1", "i2", "salt"]).groupBy(F.col("_id").alias("_own"), F.col("_th").alias("_own_th")).agg(F.collect_set("item").alias("items"))
    found = found.join(named, F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_th") == F.col("_own_th"))).select("_id", "_th", "hits", "items")
    out = scanned.drop("windows").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    out = out.select("doc_id", "th", "n_words", F.coalesce("hits", empty).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = out.withColumn("n_hit", _merged(F.col("hits")).cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def find_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents plus n_words, hits, items, n_hit and contaminated (see ``contamination``)."""
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in RESULTS]
    documents = documents.select(*kept)
    id_, th = fresh(documents, "id", "th")
    found = contamination(documents, benchmark).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias(id_), F.col("th").alias(th), *RESULTS)
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(th))).drop(id_, th)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    id_, th = fresh(documents, "id", "th")
    gone = contamination(documents, benchmark).filter("contaminated").select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
    return documents.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(th)), "left_anti")
