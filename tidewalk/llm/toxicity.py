"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: one for the word itself and the mean of those of its character n-grams, both hashed to
buckets that training has seen often enough (others are zero). Two gated recurrent layers read a window of words
forwards and backwards, attention pools their states, and a logistic unit scores the window. Windows overlap by
half and cover the whole text; the text's score is that of its most toxic window.

``fit`` trains on the driver with a bounded sample of labelled rows (``rows_per_class`` of either label, chosen by a hash of
``doc_id``, texts of up to ``longest`` characters). Only document labels are known, so a document's logit in training is
the smooth maximum of its windows' logits. Scoring runs in tasks over all documents; what a word adds to the gates is
worked out once per distinct word.

Defined results: null and wordless texts score 0; a null ``doc_id`` counts as held out; rows with a null label aren't learned
from; without rows of both labels every score is 0; repeated rows are scored each; an empty table gives an empty
result; ``score`` keeps the columns that it is told to.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewalk.llm.bytesets import U, mixed, powers
from tidewalk.llm.columns import fresh
from tidewalk.llm.language_id import held_out

WORD = re.compile(r"\w+")
LONGEST_WORD = 40
WINDOW, STEP = 64, 32
NGRAMS, NGRAM_BUCKETS, WORD_BUCKETS = (3, 4, 5), 1 << 16, 1 << 15
CHARS, WORDS, HIDDEN, ATTENTION = 16, 8, 8, 8
#: Training documents that must hold a word or n-gram before it counts.
SEEN = 4
KEPT_WORDS = 200_000


def text_words(text: str | None) -> list[str]:
    out = WORD.findall(text.lower()) if text else []
    if out and max(map(len, out)) > LONGEST_WORD:
        out = [w[k : k + LONGEST_WORD] for w in out for k in range(0, len(w), LONGEST_WORD)]
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all words' n-grams, and the word of each."""
    own, grams, whose = np.zeros(len(words), np.int64), [], []
    size = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        codes = np.full((len(at), length + 2), ord("<"), np.uint32)
        codes[:, 1:-1] = np.array([words[k] for k in at.tolist()], f"<U{length}").view(np.uint32).reshape(len(at), length)
        codes[:, -1] = ord(">")
        up, down = powers(length + 3)
        sums = np.zeros((len(at), length + 3), U)
        np.cumsum(mixed(codes.astype(U)) * up[: length + 2], axis=1, dtype=U, out=sums[:, 1:])
        own[at] = (mixed((sums[:, -1] - sums[:, 0]) + U(length)) % U(WORD_BUCKETS)).astype(np.int64)
        for n in NGRAMS:
            for i in range(length + 3 - n):
                grams.append((mixed((sums[:, i + n] - sums[:, i]) * down[i] + U(n)) % U(NGRAM_BUCKETS)).astype(np.int64))
                whose.append(at)
    empty = np.zeros(0, np.int64)
    return own, np.concatenate(grams) if grams else empty, np.concatenate(whose) if whose else empty


def _sum_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Weights, and passes over windows. A window's words are columns: arrays are (word, window, unit)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h = CHARS + WORDS, HIDDEN
        self.grams = np.zeros((NGRAM_BUCKETS, CHARS), np.float32)
        self.words = np.zeros((WORD_BUCKETS, WORDS), np.float32)
        self.gram_known, self.word_known = np.zeros(NGRAM_BUCKETS, bool), np.zeros(WORD_BUCKETS, bool)
        self.dense = {"a": f(2 * h, ATTENTION), "v": f(ATTENTION), "out": f(2 * h), "bias": np.array([-2.0], np.float32)}
        for side in "fb":
            self.dense |= {f"w{side}": f(d, 3 * h), f"u{side}": f(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """A row for each distinct word, and what its gradient needs."""
        own, grams, whose = features(words)
        seen = self.gram_known[grams]
        grams, whose = grams[seen], whose[seen]
        n = np.maximum(np.bincount(whose, minlength=len(words)), 1).astype(np.float32)
        chars = _sum_rows(whose, self.grams[grams], len(words)) / n[:, None]
        return np.concatenate([chars, self.words[own] * self.word_known[own][:, None]], 1), (own, grams, whose, n)

    def _side(self, side: str, gates: np.ndarray, mask: np.ndarray, keep: list | None):
        h, u = HIDDEN, self.dense[f"u{side}"]
        steps = range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1)
        state = np.zeros((gates.shape[1], h), np.float32)
        out = np.empty((*gates.shape[:2], h), np.float32)
        for t in steps:
            rec = state @ u
            zr = _sigmoid(gates[t, :, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * rec[:, 2 * h :])
            after = new + z * (state - new)
            m = mask[t][:, None]
            after = after if m is None else np.where(m, after, state)
            if keep is not None:
                keep.append((t, state, rec[:, 2 * h :], z, r, new, m))
            state = out[t] = after
        return out

    def forward(self, forwards: np.ndarray, backwards: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from their gates' inputs."""
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._side("f", forwards, mask, tapes["f"]), self._side("b", backwards, mask, tapes["b"])], 2)
        inner = np.tanh(states @ self.dense["a"])
        energy = np.where(mask, inner @ self.dense["v"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"tapes": tapes, "states": states, "inner": inner, "weight": weight, "pooled": pooled}
        return pooled @ self.dense["out"] + self.dense["bias"][0]

    def backward(self, slope: np.ndarray, keep: dict) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the dense weights and of both sides' gate inputs, from those of the logits."""
        h, g = HIDDEN, {}
        states, weight, inner = keep["states"], keep["weight"], keep["inner"]
        g["out"], g["bias"] = slope @ keep["pooled"], slope.sum(keepdims=True)
        pooled = slope[:, None] * self.dense["out"]
        dstates = weight[:, :, None] * pooled
        dweight = (states * pooled).sum(2)
        denergy = weight * (dweight - (weight * dweight).sum(0))
        g["v"] = np.einsum("tb,tbk->k", denergy, inner)
        dinner = denergy[:, :, None] * self.dense["v"] * (1 - inner**2)
        g["a"] = np.tensordot(states, dinner, ((0, 1), (0, 1)))
        dstates += dinner @ self.dense["a"].T
        out = []
        for k, side in enumerate("fb"):
            u = self.dense[f"u{side}"]
            gates = np.zeros((*states.shape[:2], 3 * h), np.float32)
            du, later = np.zeros_like(u), np.zeros((states.shape[1], h), np.float32)
            for t, state, rec, z, r, new, m in reversed(keep["tapes"][side]):
                d = (dstates[t, :, k * h : k * h + h] + later) * m
                skip = (dstates[t, :, k * h : k * h + h] + later) * ~m
                dnew = d * (1 - z) * (1 - new**2)
                dz = d * (state - new) * z * (1 - z)
                dr = dnew * rec * r * (1 - r)
                gates[t] = np.concatenate([dz, dr, dnew], 1)
                drec = np.concatenate([dz, dr, dnew * r], 1)
                du += state.T @ drec
                later = d * z + drec @ u.T + skip
            g[f"u{side}"], g[f"c{side}"] = du, gates.sum((0, 1))
            out.append(gates)
        return g, *out

    def gate_table(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(rows @ self.dense[f"w{s}"] + self.dense[f"c{s}"] for s in "fb")


def _windows(ids: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids (word, window), mask and text of the windows that cover each non-empty text."""
    size = np.diff(at)
    n = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - step)) // step)), 0)
    text = np.repeat(np.arange(len(n)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    place = first + np.arange(WINDOW)[:, None]
    mask = place < size[text]
    return np.where(mask, ids[np.minimum(place + at[:-1][text], len(ids) - 1)], 0) if len(ids) else place, mask, text


def train(texts: list[str], labels: np.ndarray, steps: int = 350, seed: int = 7, rate: float = 0.01, guess: bool = True) -> Network:
    """Fit a network to whole documents' labels; with ``guess`` one column of the embeddings starts as each word's surplus in toxic documents."""
    net, index, ids, at = Network(seed), {}, [], [0]
    for text in texts:
        ids += [index.setdefault(w, len(index)) for w in text_words(text)]
        at.append(len(ids))
    words, ids, at = list(index), np.array(ids, np.int64), np.array(at)
    own, grams, whose = features(words)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    pairs = np.unique(doc * len(words) + ids)
    in_docs = np.bincount(pairs % len(words), minlength=len(words))
    net.word_known = np.bincount(own, in_docs, WORD_BUCKETS) >= SEEN
    net.gram_known = np.bincount(grams, in_docs[whose], NGRAM_BUCKETS) >= SEEN
    share = max(1e-3, labels.mean())
    toxic = np.bincount(pairs % len(words), labels[pairs // len(words)], len(words))
    for table, spots, which in ((net.words, own, slice(None)), (net.grams, grams, whose)):  # a first guess: surplus in toxic documents
        n, hits = np.bincount(spots, in_docs[which], len(table)), np.bincount(spots, toxic[which], len(table))
        surplus = (hits - n * share) / np.sqrt(n * share * (1 - share) + 1)
        if guess:
            table[:, 0] = np.where((n >= SEEN) & (np.abs(surplus) >= 2), np.clip(surplus / 3, -2, 2), 0)
    order = np.argsort(whose, kind="stable")
    grams, gram_at = grams[order], np.searchsorted(whose[order], np.arange(len(words) + 1))
    r, step = np.random.default_rng(seed), 0
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.dense.items()}
    gram_scale, word_scale = np.full(NGRAM_BUCKETS, 1e-6, np.float32), np.full(WORD_BUCKETS, 1e-6, np.float32)
    parts = max(1, len(texts) // 48)
    for _ in range(-(-steps // parts)):
        for part in np.array_split(r.permutation(len(texts)), parts):
            part = part[np.diff(at)[part] > 0]
            if not len(part):
                continue
            size = np.diff(at)[part]
            flat = np.concatenate([ids[at[k] : at[k + 1]] for k in part])
            used, local = np.unique(flat, return_inverse=True)
            word_of, mask, text = _windows(local, np.concatenate([[0], np.cumsum(size)]), WINDOW)
            n = gram_at[used + 1] - gram_at[used]
            g_ids = grams[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - gram_at[used], n)]
            g_word = np.repeat(np.arange(len(used)), n)
            seen = net.gram_known[g_ids]
            g_ids, g_word = g_ids[seen], g_word[seen]
            count = np.maximum(np.bincount(g_word, minlength=len(used)), 1).astype(np.float32)[:, None]
            known = net.word_known[own[used]][:, None]
            rows = np.concatenate([_sum_rows(g_word, net.grams[g_ids], len(used)) / count, net.words[own[used]] * known], 1)
            keep: dict = {}
            tables = net.gate_table(rows)
            logit = net.forward(tables[0][word_of], tables[1][word_of], mask, keep)
            top = np.full(len(part), -np.inf, np.float32)
            np.maximum.at(top, text, logit)
            e = np.exp(logit - top[text])
            total = np.bincount(text, e, len(part))
            whole = top + np.log(total)
            y = labels[part]
            slope = (_sigmoid(whole) - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(part)
            g, *gates = net.backward((slope[text] * e / total[text]).astype(np.float32), keep)
            drows, spot = 0, word_of.ravel()
            for side, d in zip("fb", gates):
                own_words = _sum_rows(spot, d.reshape(-1, 3 * HIDDEN) * mask.reshape(-1, 1), len(used))
                g[f"w{side}"] = rows.T @ own_words
                drows = drows + own_words @ net.dense[f"w{side}"].T
            step += 1
            for k, d in g.items():
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                net.dense[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            for table, scale, spots, d in (
                (net.grams, gram_scale, g_ids, (drows[:, :CHARS] / count)[g_word]), (net.words, word_scale, own[used], drows[:, CHARS:] * known),
            ):
                touched, inverse = np.unique(spots, return_inverse=True)
                d = _sum_rows(inverse, d, len(touched))
                scale[touched] += (d * d).mean(1)
                table[touched] -= 5 * rate * d / np.sqrt(scale[touched])[:, None]
    return net


def fit(documents: DataFrame, labels: DataFrame, *, rows_per_class: int = 1200, longest: int = 20_000, guess: bool = True) -> Network | None:
    """Train on rows that are not held out; None if one of the labels is missing. ``guess``: see ``train``."""
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    short = documents.filter((F.length("text") <= longest) & F.col("doc_id").isNotNull())
    rows = rows.join(short.select("doc_id").distinct(), "doc_id")
    mix = F.xxhash64("doc_id", F.lit("toxicity"))
    rows = rows.filter("toxic = 1").orderBy(mix, "doc_id").limit(rows_per_class).unionByName(rows.filter("toxic = 0").orderBy(mix, "doc_id").limit(rows_per_class))
    sample = short.join(F.broadcast(rows), "doc_id").orderBy(mix, "doc_id", F.xxhash64("text"), "toxic").limit(2 * rows_per_class).select("text", "toxic").toArrow()
    y = sample["toxic"].to_numpy().astype(np.float32)
    return train(sample["text"].to_pylist(), y, guess=guess) if len(np.unique(y)) == 2 else None


def score(documents: DataFrame, net: Network | None, columns: list[str]) -> DataFrame:
    """The given columns of documents and score, the chance that the most toxic window is toxic."""
    sent = documents.sparkSession.sparkContext.broadcast(net)

    def scan(batches):
        net, index = sent.value, {}
        tables = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2
        for whole in batches:
            for k in range(0, whole.num_rows, 300):
                batch = whole.slice(k, 300)
                best = np.full(batch.num_rows, -np.inf, np.float32)
                if net is not None:
                    if len(index) > KEPT_WORDS:
                        index.clear()
                        tables = [t[:0] for t in tables]
                    ids, at = [], [0]
                    for text in batch.column(batch.num_columns - 1):
                        ids += [index.setdefault(w, len(index)) for w in text_words(text.as_py())]
                        at.append(len(ids))
                    if new := list(index)[len(tables[0]) :]:
                        tables = [np.concatenate([t, x]) for t, x in zip(tables, net.gate_table(net.inputs(new)[0]))]
                    ids, at = np.array(ids, np.int64), np.array(at)
                    word_of, mask, text = _windows(ids, at, STEP)
                    for a in range(0, word_of.shape[1], 1024):
                        w, m = word_of[:, a : a + 1024], mask[:, a : a + 1024]
                        np.maximum.at(best, text[a : a + 1024], net.forward(tables[0][w], tables[1][w], m))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(columns))], pa.array(_sigmoid(best.astype(np.float64)))], names=[*columns, "score"])

    out = T.StructType([*[documents.schema[c] for c in columns], T.StructField("score", T.DoubleType())])
    return documents.select(*[f"`{c}`" for c in columns], F.col("text").alias(fresh(documents, "text")[0])).mapInArrow(scan, out)
