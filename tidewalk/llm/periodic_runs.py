"""Runs of repeated words by grammar compression.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least ``LEAST`` words and
``EXPONENT`` periods, that no neighbouring word extends. The words of a batch of texts get exact numbers, and then:

1. Stretches in which a run may lie are kept: in a run each three words in a row stand three times or more, so stretches are
   cut where they stand less often in what is left of their text, a few times over.
2. Re-Pair compresses all stretches together: pairs of neighbouring symbols that occur twice or more become rules, the most frequent
   first. Pairs that don't overlap a more frequent one are replaced in the same round, so rounds are few. What is left of a stretch,
   in which no pair repeats, is folded into a balanced tree of rules that occur once.
3. Each rule's boundary is looked at once, at the rule's first place: for each period the words beside the boundary tell whether two
   periods lie on one side of it, as at least two of a run's four do, and if so how far the period goes within the rule. Substrings are
   compared by exact numbers of all substrings of a power of two of words. A run lies in a lowest rule, whose boundary it crosses.
4. Runs go to all places that the rule derives, the pieces of one period that overlap by a period are merged to maximal
   intervals, and of equal intervals the one of least period stays.

A text stays within one task; a batch is about 4 MB or one longer text, and takes memory in proportion to its words (times the logarithm of
the longest stretch for those that repeat).

Defined results: null, empty and wordless texts have no words, no runs and the empty string; rows are judged one by one, so
null or repeated ids and rows, and copies, give each row its result; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewalk.llm.bytesets import SPACED, U, mixed, slices, word_spans

LEAST, EXPONENT = 6, 4
#: Words in a row that must stand ``OFTEN`` times where a run may lie; passes over what is left.
GRAM, OFTEN, PASSES = 3, 3, 8
#: Pairs of a rule and a period that are looked at together.
TOGETHER = 1 << 20


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, and no others, have equal numbers."""
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[SPACED[data]])])
    return np.asarray(words.dictionary_encode().indices, np.int64)


def _counts(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    codes = np.asarray(pa.array(keys).dictionary_encode().indices)
    return np.bincount(codes)[codes] if len(codes) else np.zeros(0, np.int64)


def stretches(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` that may lie in a run, and the number of the stretch that each belongs to."""
    place, part = np.arange(len(words)), text
    for _ in range(PASSES):
        n = len(place)
        if n < LEAST:
            return place[:0], part[:0]
        w = words[place].astype(U)
        key = part[: n - 2].astype(U)
        for k in range(GRAM):
            key = mixed(key * U(3) + w[k : n - 2 + k])  # equal keys of different grams only keep more
        often = (_counts(key) >= OFTEN) & (part[: n - 2] == part[2:])
        linked = np.zeros(n, bool)  # with the next place
        linked[: n - 2] |= often
        linked[1 : n - 1] |= often
        new = np.ones(n, bool)
        new[1:] = ~linked[:-1]
        own = np.cumsum(new) - 1
        long = np.bincount(own)[own] >= LEAST
        same = long.all() and own[-1] == len(np.unique(part)) - 1
        place, part = place[long], own[long]
        if same:
            break
    return place, part


class Grammar:
    """Rules over the words of stretches: size, first (place) and cut (where the right half begins) of each rule; rule and place of all that is derived."""

    def __init__(self, words: np.ndarray, part: np.ndarray):
        self.sizes, self.firsts, self.cuts, self.rules, self.places, self.n = [], [], [], [], [], 0
        _, symbol = np.unique(words, return_inverse=True)
        free = int(symbol.max()) + 1 if len(symbol) else 0
        place = np.arange(len(words))
        while len(symbol) > 1:
            key = (symbol[:-1].astype(U) << U(32)) | symbol[1:].astype(U)
            inside = part[:-1] == part[1:]
            repeat = np.zeros(len(key), bool)
            repeat[1:] = (key[1:] == key[:-1]) & inside[1:] & inside[:-1]
            at = np.arange(len(key))
            begun = np.maximum.accumulate(np.where(repeat, 0, at))
            inside &= (at - begun) % 2 == 0  # of a symbol's own run every second pair
            where = np.flatnonzero(inside)
            _, code, count = np.unique(key[where], return_inverse=True, return_counts=True)
            rank = np.zeros(len(key) + 2, U)
            rank[where + 1] = np.where(count[code] > 1, (count[code].astype(U) << U(40)) | (mixed(key[where]) >> U(24)), U(0))
            taken = np.flatnonzero((rank[1:-1] > 0) & (rank[1:-1] >= rank[:-2]) & (rank[1:-1] > rank[2:]))
            if not len(taken):
                break
            symbol, part, place, free = self._replace(symbol, part, place, taken, np.unique(key[taken], return_inverse=True)[1], free)
        while len(symbol) > 1:  # fold what is left of each stretch
            same = part[1:] == part[:-1]
            begin = np.concatenate([[True], ~same])
            nth = np.arange(len(part)) - np.maximum.accumulate(np.where(begin, np.arange(len(part)), 0))
            taken = np.flatnonzero(same & (nth[:-1] % 2 == 0))
            if not len(taken):
                break
            symbol, part, place, free = self._replace(symbol, part, place, taken, np.arange(len(taken)), free)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.size, self.first, self.cut, self.rule, self.place = map(join, (self.sizes, self.firsts, self.cuts, self.rules, self.places))
        self.ends = len(words)

    def _replace(self, symbol, part, place, taken, code, free):
        """The sequence in which pairs at ``taken`` are rules, numbered by ``code``."""
        over = np.concatenate([place[1:], place[-1:]])  # where the right half begins
        end = np.concatenate([place[1:], [0]])
        end = np.where(np.concatenate([part[1:] == part[:-1], [False]]), end, self._ends(place, part))
        _, first = np.unique(code, return_index=True)
        self.sizes.append(end[taken + 1][first] - place[taken][first])
        self.firsts.append(place[taken][first])
        self.cuts.append(over[taken][first])
        self.rules.append(code + self.n)
        self.places.append(place[taken])
        self.n += len(first)
        symbol = symbol.copy()
        symbol[taken] = free + code
        stays = np.ones(len(symbol), bool)
        stays[taken + 1] = False
        return symbol[stays], part[stays], place[stays], free + len(first)

    def _ends(self, place, part):
        """For the last symbol of each stretch the place after it."""
        if not hasattr(self, "last"):
            self.last = np.searchsorted(part, np.arange(part[-1] + 2 if len(part) else 1))[1:]
        return self.last[part]


def substring_numbers(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to ``longest``: exact numbers of the substrings of so many words, by where they begin."""
    out, size, n = [np.unique(words, return_inverse=True)[1].astype(np.int32)], 1, len(words)
    while 2 * size <= longest:
        last = out[-1].astype(np.int64)
        number = np.full(n, -1, np.int32)
        both = (last[: n - size] << 32) | (last[size:] & 0xFFFFFFFF)
        number[: n - 2 * size + 1] = np.unique(both[: n - 2 * size + 1], return_inverse=True)[1]
        out.append(number)
        size *= 2
    return out


class _Substrings:
    def __init__(self, words: np.ndarray, longest: int):
        levels = substring_numbers(words, longest)
        self.table, self.n, self.levels = np.concatenate(levels), len(words), len(levels)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        level = np.frexp(size.astype(float))[1] - 1
        row, back = level * self.n, size - (1 << level)
        t = self.table
        return (t[row + a] == t[row + b]) & (t[row + a + back] == t[row + b + back])

    def forward(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from a and b on are equal, up to ``end`` of those from b (a < b)."""
        out = np.zeros(len(a), np.int64)
        for level in range(self.levels - 1, -1, -1):
            fits = np.flatnonzero(b + out + (1 << level) <= end)
            x, y, row = a[fits] + out[fits], b[fits] + out[fits], level * self.n
            out[fits[self.table[row + x] == self.table[row + y]]] += 1 << level
        return out

    def backward(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before a and b are equal, down to ``begin`` of those before a."""
        out = np.zeros(len(a), np.int64)
        for level in range(self.levels - 1, -1, -1):
            fits = np.flatnonzero(a - out - (1 << level) >= begin)
            x, y, row = a[fits] - out[fits] - (1 << level), b[fits] - out[fits] - (1 << level), level * self.n
            out[fits[self.table[row + x] == self.table[row + y]]] += 1 << level
        return out


def _least_period(rule: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Indices of the rows of least period among those of equal rule, start and end."""
    order = np.lexsort((period, end, start, rule))
    r, s, e = rule[order], start[order], end[order]
    first = np.ones(len(order), bool)
    first[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return order[first]


def boundary_runs(grammar: Grammar, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """rule, offset in it, length, period of the runs about each rule's boundary, within the rule."""
    wide = np.flatnonzero(grammar.size >= LEAST)
    periods = grammar.size[wide] // EXPONENT
    longest = int(grammar.size.max()) if len(wide) else 0
    found = [[np.zeros(0, np.int64)] * 4]
    substrings = _Substrings(words, longest) if longest else None
    total = np.cumsum(periods)
    a = 0
    while a < len(wide):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TOGETHER, "right")))
        n = periods[a:b]
        rule = np.repeat(wide[a:b], n)
        q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        x0, m = grammar.first[rule], grammar.cut[rule]
        x1 = x0 + grammar.size[rule]
        for fits, j in ((m + 2 * q <= x1, m), (m - 2 * q >= x0, m - q)):
            near = np.flatnonzero(fits)
            i, k = j[near], q[near]
            side = np.where(j is m, i, i - k)
            near = near[substrings.equal(side, side + k, k)]
            i, k, lo, hi = j[near], q[near], x0[near], x1[near]
            start, end = i - substrings.backward(i, i + k, lo), i + k + substrings.forward(i, i + k, hi)
            long = end - start >= np.maximum(LEAST, EXPONENT * k)
            found.append([rule[near][long], (start - lo)[long], (end - start)[long], k[long]])
        a = b
    rule, offset, length, period = (np.concatenate(x) for x in zip(*found))
    own = _least_period(rule, offset, offset + length, period)
    return rule[own], offset[own], length[own], period[own]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by a period or more as one, and of equal intervals the one of least period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    s, e, q = start[order], end[order], period[order]
    span = int(e.max()) + 1
    reach = np.maximum.accumulate(e + q * span)  # larger periods lie behind all smaller ones
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] + q[1:] * span) > reach[:-1] - q[1:]
    begin = np.flatnonzero(new)
    s, q = s[begin], q[begin]
    e = np.maximum.reduceat(e, begin)
    own = _least_period(np.zeros(len(s), np.int64), s, e, q)
    return s[own], e[own], q[own]


def runs_of(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period, by start and period, of all runs in ``words``; none goes over a change of ``text``."""
    place, part = stretches(words, text)
    if not len(place):
        return place, place, place
    part = np.unique(part, return_inverse=True)[1]
    grammar = Grammar(words[place], part)
    rule, offset, length, period = boundary_runs(grammar, words[place])
    order = np.argsort(grammar.rule, kind="stable")
    low, high = (np.searchsorted(grammar.rule[order], rule, side) for side in ("left", "right"))
    n = high - low
    own = np.repeat(np.arange(len(rule)), n)
    at = grammar.place[order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[own]]]
    start = at + offset[own]
    start, end, period = merged(start, start + length[own], period[own])
    start, end = place[start], place[end - 1] + 1
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _find(batches):
    """doc_id, n_words, runs, collapsed of doc_id, text."""
    for batch in batches:
        for i, j, data, at in slices(batch.column(1)):
            begin, stop, word_at = word_spans(data, at, SPACED)
            counts = np.diff(word_at)
            text = np.repeat(np.arange(j - i), counts)
            start, end, period = runs_of(word_numbers(data, begin, stop), text)
            owner = text[start] if len(start) else start
            gone = np.zeros(len(begin) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, end, -1)
            kept = np.cumsum(gone)[:-1] == 0
            # the bytes of kept words, and for each but a text's last one the space behind it
            keep = np.zeros(len(data) + 1, np.int8)
            keep[begin[kept]] += 1
            keep[stop[kept]] -= 1
            keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
            later = np.flatnonzero(kept)
            later = later[:-1][text[later[:-1]] == text[later[1:]]] if len(later) else later
            data = data.copy()
            data[stop[later]] = 0x20
            keep[stop[later]] = True
            offsets = np.concatenate([[0], np.cumsum(keep)])[at]
            collapsed = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[keep])])
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - word_at[owner], end - start, period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts.astype(np.int64)), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start and period) and collapsed of each document.

    collapsed: the words that no run contains after its first period, joined by one space.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(_find, schema)
