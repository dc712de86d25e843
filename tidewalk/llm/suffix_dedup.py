"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``MATCH`` bytes covers it that also starts earlier (smaller ``doc_id``, or same document and earlier
start), that is, if the longest previous factor of its position or of one shortly before it reaches so far. Suffix orders are
made only where that can be so:

1. Each window of ``MATCH`` bytes has an anchor, its ``GRAM``-byte gram of least hash. Equal windows have equal anchors at equal
   places. Consecutive windows with one anchor form a block; blocks are dealt to tasks by the anchor's hash.
2. Equal blocks (128 bits of hashes: the anchor's and the block's) are aggregated before and after that shuffle to their first
   one: the longest previous factor of any position in a later copy ends where the block ends, at least. A block whose anchor
   stands in no other kind of block has no further match.
3. For anchors in several kinds of blocks, the bytes of the first block of each kind are brought together. The suffixes that
   start in them are ordered by prefix doubling; in that order the nearest suffixes of smaller position before and after
   each one are found, and the longer common prefix with those two is its longest previous factor (counted up to ``MATCH``).
4. An anchor in more than ``SPLIT`` kinds of blocks, or one that a sample of the documents shows in more than ``HOT_SHARE`` of all
   blocks, has its blocks cut into single windows, to which step 2 applies again (128 bits of hashes, the least position of
   each aggregated before the shuffle): then no two kinds are left that could share ``MATCH`` bytes. Its blocks never meet in one task.

Tasks work on runs of bounded size: groups of step 3 have at most ``SPLIT`` blocks of less than 2 * ``MATCH`` bytes.

Defined results: null and empty texts have 0 bytes and the hash of nothing; texts shorter than ``MATCH`` stay whole; a null
``doc_id`` comes before all others; rows equal in ``doc_id`` and text count as one document and get equal results, unequal
texts of one ``doc_id`` are told apart and ordered by the 64-bit hash of the text; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewalk.llm.bytesets import U, byte_sums, mixed, slices, sliding_min, span_hashes, text_bytes
from tidewalk.llm.scratch import cut

MATCH, GRAM = 100, 24
#: Kinds of blocks of one anchor that a task orders together; bytes of blocks that it orders at once.
SPLIT, CHUNK = 20_000, 1 << 20
#: Bytes of texts whose blocks are made at once.
SLICE = 2 << 20
#: Share of the blocks from which an anchor counts as hot, documents in the sample that finds it, and blocks there at least.
HOT_SHARE, SAMPLE, LEAST = 1e-4, 0.01, 50
#: Parts that a hot anchor's blocks are dealt to; repeated blocks that a task remembers.
PARTS, REMEMBERED = 64, 50_000
SALT = 8
PLAIN, KNOWN, HOT = 0, 1, 2
LATER, SORTED, WIDE = 0, 1, 2
# A place is the start of a run of windows (upper bits) and its number of windows (8 bits).


def _keys(ids: list, hashes: list) -> list[tuple]:
    return [(i is not None, i if i is not None else 0, h) for i, h in zip(ids, hashes)]


class _Remembered:
    """First places of blocks that repeat, by hash, as far as a task has seen them: combines what several slices repeat."""

    def __init__(self):
        self.first, self.sorted = {}, np.zeros(0, U)

    def known(self, blocks: np.ndarray, keys: list[tuple], starts: np.ndarray) -> np.ndarray:
        """Indices of the blocks that a block of an earlier slice equals and precedes."""
        if not len(self.sorted):
            return np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.sorted, blocks), len(self.sorted) - 1)
        out = []
        for k in np.flatnonzero(self.sorted[at] == blocks).tolist():
            name, place = int(blocks[k]), (*keys[k], int(starts[k]))
            if self.first[name] < place:
                out.append(k)
            else:
                self.first[name] = place
        return np.array(out, int)

    def add(self, blocks: np.ndarray, keys: list[tuple], starts: np.ndarray) -> None:
        if len(self.first) + len(blocks) > REMEMBERED:
            self.first.clear()
        for k, name in enumerate(blocks.tolist()):
            place = (*keys[k], int(starts[k]))
            self.first[name] = min(self.first.get(name, place), place)
        self.sorted = np.sort(np.fromiter(self.first, U, len(self.first)))


def _blocks(batches, hot: np.ndarray):
    """doc_id, th, place, anchor, block, flag of each block; KNOWN: an earlier one that this task has seen equals it."""
    remembered = _Remembered()
    for batch in batches:
        for i, j, data, at in slices(batch.column(2), SLICE):
            n = len(data)
            if n < MATCH:
                continue
            sums = byte_sums(data)
            grams = np.arange(n - GRAM + 1)
            grams = span_hashes(sums, grams, grams + GRAM)
            anchor = sliding_min(grams, MATCH - GRAM + 1)
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
            inside = np.arange(len(anchor)) + MATCH <= at[text + 1]
            new = inside.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
            start = np.flatnonzero(new)
            last = inside.copy()
            last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
            end = np.flatnonzero(last) + 1
            own, at_anchor = text[start], anchor[start]
            gram = grams[at_anchor]
            block = mixed(span_hashes(sums, start, end - 1 + MATCH) + (at_anchor - start).astype(U))
            ids, hashes = batch.column(0).slice(i, j - i), np.asarray(batch.column(1).slice(i, j - i))
            keys = _keys(ids.to_pylist(), hashes.tolist())
            place_of = {k: n for n, k in enumerate(sorted(set(keys)))}
            rank = np.array([place_of[k] for k in keys], np.int64)[own]
            at_text = start - at[own]
            order = np.lexsort((at_text, rank, block))
            first = np.ones(len(order), bool)
            first[1:] = block[order][1:] != block[order][:-1]
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            known = np.zeros(len(order), bool)
            known[order] = (rank[order] != rank[lead]) | (at_text[order] != at_text[lead])
            leads = np.flatnonzero(~known)
            known[leads[remembered.known(block[leads], [keys[k] for k in own[leads].tolist()], at_text[leads])]] = True
            again = order[first][np.diff(np.append(np.flatnonzero(first), len(order))) > 1]
            remembered.add(block[again], [keys[k] for k in own[again].tolist()], at_text[again])
            place = at_text << 8 | (end - start)
            flag, to = np.where(known, KNOWN, PLAIN), np.where(known, mixed(block + place.astype(U)), gram)
            if len(hot):
                warm = ~known & (hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram)
                flag[warm] = HOT
                to[warm] = mixed(gram[warm] + block[warm] % U(PARTS))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(own)), pa.array(hashes[own]), pa.array(place), pa.array(to.view(np.int64)), pa.array(block.view(np.int64)), pa.array(flag.astype(np.int8)),
            ], names=["doc_id", "th", "place", "anchor", "block", "flag"])


def _codes(table: pa.Table) -> np.ndarray:
    """Numbers that tell the rows' doc_ids apart."""
    return np.asarray(table.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1))


def _judge(batches, split: int):
    """doc_id, th, place, anchor, kind: later copies, and the first blocks of anchors with several kinds.

    Rows come in order of anchor, block and position. What is kept between batches is the open kind's first row and, up to
    ``split``, the first rows of the open anchor.
    """
    names = ["doc_id", "th", "place", "anchor"]

    def out(table: pa.Table, kind):
        kinds = pa.array(np.broadcast_to(np.asarray(kind, np.int8), table.num_rows))
        return table.select(names).append_column("kind", kinds).combine_chunks().to_batches()

    lead, held, sent = None, None, None  # first row of the open kind, first rows and name of the open anchor; sent: its rows go out at once
    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = np.asarray(table.column(5)) == KNOWN
        if known.any():
            yield from out(table.filter(pa.array(known)), LATER)
            table = table.filter(pa.array(~known))
        if not table.num_rows:
            continue
        carried = lead is not None
        table = (pa.concat_tables([lead, table]) if carried else table).combine_chunks()
        anchor, block, th, place, flag = (np.asarray(table.column(c)) for c in (3, 4, 1, 2, 5))
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
        at = np.maximum.accumulate(np.where(first, np.arange(len(anchor)), 0))
        code = _codes(table)
        same = (place == place[at]) & (th == th[at]) & (code == code[at])  # the same row twice
        if not same.all():
            yield from out(table.filter(pa.array(~same)), LATER)
        lead = table.slice(int(at[-1]), 1)
        firsts = np.flatnonzero(first)[carried:]
        found = table.take(pa.array(firsts))
        if held is not None:
            found = pa.concat_tables([held, found])
        if not found.num_rows:
            continue
        anchor, flag = np.asarray(found.column(3)), np.asarray(found.column(5))
        cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        kinds = np.diff(cuts)
        kind = np.where(kinds > split, WIDE, np.where(kinds > 1, SORTED, -1))
        kind[flag[cuts[:-1]] == HOT] = WIDE
        if sent is not None and anchor[0] == sent:
            kind[0] = WIDE
        stop = int(cuts[-2])
        if kind[-1] == WIDE:
            stop, sent = len(anchor), anchor[-1]
        held = found.slice(stop) if stop < len(anchor) else None
        kind = np.repeat(kind, kinds)[:stop]
        yield from out(found.slice(0, stop).filter(pa.array(kind >= 0)), kind[kind >= 0])
    if held is not None and held.num_rows > 1:
        yield from out(held, SORTED)


def _block_bytes(batches):
    """doc_id, th, place, anchor, kind, bytes of each wanted block of a text."""
    for batch in batches:
        for k in range(batch.num_rows):
            wanted = batch.column(3)[k].as_py()
            data = batch.column(2)[k].as_py().encode()
            starts = [w["place"] >> 8 for w in wanted]
            body = [data[s : s + (w["place"] & 0xFF) - 1 + MATCH] for s, w in zip(starts, wanted)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array([k] * len(wanted))) for c in (0, 1)], *[pa.array([w[c] for w in wanted], t) for c, t in (("place", pa.int64()), ("anchor", pa.int64()), ("kind", pa.int8()))], pa.array(body, pa.binary()),
            ], names=["doc_id", "th", "place", "anchor", "kind", "bytes"])


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranked = keys[order]
    step = np.ones(len(keys), U)
    step[0] = 0
    step[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), U)
    out[order] = np.cumsum(step, dtype=U)
    return out


def previous_smaller(v: np.ndarray, jumps: int = 64) -> np.ndarray:
    """For each place of v the nearest place before it with a smaller value, or -1.

    All places jump at once over what their last stop has jumped over; long chains are walked one by one, in linear time.
    """
    before, low = np.arange(-1, len(v) - 1), np.append(v, -1)
    todo = np.flatnonzero(low[before] > v)
    for _ in range(jumps):
        if not len(todo):
            return before
        before[todo] = before[before[todo]]
        todo = todo[low[before[todo]] > v[todo]]
    if len(todo):
        values, out = v.tolist(), []
        for k, x in enumerate(values):
            at = k - 1
            while at >= 0 and values[at] > x:
                at = out[at]
            out.append(at)
        before = np.array(out)
    return before


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each place of v the nearest place after it with a smaller value, or -1."""
    found = previous_smaller(v[::-1])[::-1]
    return np.where(found < 0, -1, len(v) - 1 - found)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For suffixes of ``data``, in order of position: how many bytes, up to MATCH, stand at the start of an earlier one too.

    Each start has at least MATCH bytes after it. Ranks of all positions by their first 8, 16, 32 and 64 bytes order the
    suffixes and give the common prefix of any two; it is longest with one of the two neighbours in the order that have
    smaller positions. Of suffixes that agree in MATCH bytes all but the first have their predecessor as such a neighbour.
    """
    padded = np.concatenate([data, np.zeros(MATCH, np.uint8)])
    n = len(data)
    key = np.zeros(n, U)
    for k in range(8):
        key = key << U(8) | padded[k : k + n].astype(U)
    rank = {8: key, 4: key >> U(32), 2: key >> U(48), 1: key >> U(56)}
    last = _dense(key)
    for width in (8, 16, 32):
        shifted = np.zeros(n, U)
        shifted[: n - width] = last[width:] + U(1)
        last = rank[2 * width] = _dense(last << U(32) | shifted)
    prefix = last[starts] << U(32) | last[np.minimum(starts + MATCH - 64, n - 1)]
    order = np.argsort(prefix, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = prefix[order][1:] != prefix[order][:-1]
    out = np.full(len(starts), MATCH, np.int64)
    lead = order[new]  # the first of each set of suffixes with equal prefixes, in suffix order
    best = np.zeros(len(lead), np.int64)
    for near in (previous_smaller(lead), next_smaller(lead)):
        own = np.flatnonzero(near >= 0)
        a, b = starts[lead[own]], starts[lead[near[own]]]
        shared = np.zeros(len(own), np.int64)
        for width in (64, 32, 16, 8, 4, 2, 1):
            r = rank[width]
            shared += width * (r[np.minimum(a + shared, n - 1)] == r[np.minimum(b + shared, n - 1)])
        best[own] = np.maximum(best[own], np.minimum(shared, MATCH))
    out[lead] = best
    return out


def _whole_groups(batches, key: int):
    """Tables that end where the value of column ``key`` changes, from batches sorted by it; groups are small."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        ids = np.asarray(table.column(key))
        stop = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
        if stop:
            yield table.slice(0, stop)
        rest = table.slice(stop)
    if rest is not None and rest.num_rows:
        yield rest


def _factors(batches):
    """doc_id, th, place: runs of windows of the blocks whose longest previous factors reach MATCH bytes."""
    for table in _whole_groups(batches, 3):
        code, th, place = _codes(table), np.asarray(table.column(1)), np.asarray(table.column(2))
        once = np.ones(len(code), bool)  # repeated rows of one document give a block twice
        once[1:] = (code[1:] != code[:-1]) | (th[1:] != th[:-1]) | (place[1:] != place[:-1])
        table = table.filter(pa.array(once)) if not once.all() else table
        anchor = np.asarray(table.column(3))
        data, at = text_bytes(table.column(4))
        cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        k = 0
        while k < len(cuts) - 1:
            stop = max(k + 1, int(np.searchsorted(at[cuts], at[cuts[k]] + CHUNK, "right")) - 1)
            a, b = int(cuts[k]), int(cuts[stop])
            place = np.asarray(table.column(2))[a:b]
            n = place & 0xFF
            block = np.repeat(np.arange(b - a), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            factors = longest_previous_factors(data[at[a] : at[b]], (at[a:b] - at[a])[block] + step)
            yield _runs(table.slice(a, b - a), place, block, step, factors >= MATCH)
            k = stop


def _runs(table: pa.Table, place: np.ndarray, block: np.ndarray, step: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    near = np.zeros(len(found), bool)
    near[1:] = found[:-1] & (block[1:] == block[:-1])
    far = np.zeros(len(found), bool)
    far[:-1] = found[1:] & (block[1:] == block[:-1])
    first, last = np.flatnonzero(found & ~near), np.flatnonzero(found & ~far)
    own = place[block[first]]
    out = (own & ~0xFF) + (step[first] << 8) | (step[last] - step[first] + 1)
    keys = [table.column(c).combine_chunks().take(pa.array(block[first])) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(out)], names=["doc_id", "th", "place"])


def _window_hashes(batches):
    """doc_id, th, place, h1, h2 of each window of the blocks of wide anchors."""
    for batch in batches:
        data, at = text_bytes(batch.column(3))
        place = np.asarray(batch.column(2))
        n = place & 0xFF
        block = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = at[:-1][block] + step
        h = [span_hashes(byte_sums(x), start, start + MATCH) for x in (data, data ^ np.uint8(0x5A))]
        out = (place[block] & ~0xFF) + (step << 8) | 1
        keys = [batch.column(c).take(pa.array(block)) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(out), *[pa.array(x.view(np.int64)) for x in h]], names=["doc_id", "th", "place", "h1", "h2"])


def hot_anchors(hashed: DataFrame, blocks: str, sample: float = SAMPLE) -> np.ndarray:
    """Sorted anchors with more than HOT_SHARE of a sample's blocks (so fewer than 1 / HOT_SHARE of them); they only choose a way, not a result."""
    rows = hashed.sample(sample, 4).mapInArrow(lambda batches: _blocks(batches, np.zeros(0, U)), blocks)
    counts = cut(rows.filter(F.col("flag") == PLAIN).groupBy("anchor").agg(F.count("*").alias("n")), "anchors")
    least = max(LEAST, (counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE)
    return np.sort(np.array([r.anchor for r in counts.filter(F.col("n") > least).select("anchor").collect()], np.int64).view(U))


def removed_spans(documents: DataFrame, split: int = SPLIT, sample: float = SAMPLE) -> DataFrame:
    """doc_id, th (hash of the text), places: runs of windows of each text that start earlier too."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    hashed = documents.filter(F.octet_length("text") >= MATCH).select("doc_id", F.xxhash64("text").alias("th"), "text")
    schema = f"doc_id {kind}, th long, place long, anchor long, block long, flag byte"
    hot = hot_anchors(hashed, schema, sample)
    blocks = hashed.mapInArrow(lambda batches: _blocks(batches, hot), schema)
    blocks = blocks.repartition("anchor").sortWithinPartitions("anchor", "block", "doc_id", "th", "place")
    judged = cut(blocks.mapInArrow(lambda batches: _judge(batches, split), f"doc_id {kind}, th long, place long, anchor long, kind byte"), "judged")

    wanted = judged.filter(F.col("kind") != LATER).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("place", "anchor", "kind")).alias("wanted"))
    found = hashed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "text", "wanted")
    found = cut(found.mapInArrow(_block_bytes, f"doc_id {kind}, th long, place long, anchor long, kind byte, bytes binary"), "candidates")
    near = found.filter(F.col("kind") == SORTED).select("doc_id", "th", "place", "anchor", "bytes")
    near = near.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "th", "place").mapInArrow(_factors, f"doc_id {kind}, th long, place long")
    wide = found.filter(F.col("kind") == WIDE).select("doc_id", "th", "place", "bytes").mapInArrow(_window_hashes, f"doc_id {kind}, th long, place long, h1 long, h2 long")
    place = F.struct("doc_id", "th", "place")
    first = wide.groupBy("h1", "h2").agg(F.min(place).alias("first")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    wide = wide.withColumn("salt", F.pmod(F.xxhash64("th", "place"), F.lit(SALT)).cast("int")).join(first, ["h1", "h2", "salt"])
    wide = wide.filter(place > F.col("first")).select("doc_id", "th", "place")
    places = judged.filter(F.col("kind") == LATER).select("doc_id", "th", "place").unionByName(near).unionByName(wide)
    return places.groupBy("doc_id", "th").agg(F.collect_set("place").alias("places"))


def _kept(data: bytes, places: list[int] | None) -> tuple[int, int, bytes]:
    if not places:
        return 0, 0, data
    packed = np.array(places, np.int64)
    start = packed >> 8
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + (packed & 0xFF) - 1 + MATCH, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def dedup_bytes(documents: DataFrame, split: int = SPLIT, sample: float = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), kept_sha256."""
    spans = removed_spans(documents, split, sample).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "places")
    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = documents.select("doc_id", F.xxhash64("text").alias("th"), "text")
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("doc_id", "text", "places")

    def finish(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for text, places in zip(part.column(1), part.column(2)):
                    data = (text.as_py() or "").encode()
                    rows.append((len(data), *_kept(data, places.as_py())))
                size, gone, runs, kept = (list(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[pa.array(x, pa.int64()) for x in (size, gone, runs)], pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
