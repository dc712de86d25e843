"""Language identification with segmentation-marginalised unigrams.

Each language is a unigram model over the pieces of a fixed public vocabulary. The chance of a word is the sum over all
its segmentations into pieces, which a forward algorithm takes; a text's score is the product over its words, and the
prediction is the language of largest posterior under equal priors. Piece probabilities are fitted by
expectation-maximisation to the word counts of all labelled documents: Spark counts words by language and sums the
expected piece counts, and only the pieces' totals (vocabulary times languages) meet on the driver.

Words are runs of word characters that are no digits, in lower case behind a word-start mark, whatever their length: those of
more than ``SHORT`` characters are summed one by one in logarithms, in memory in proportion to the word, the others side by
side. A character that is no piece has a small fixed chance.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where no language was learned; rows with a
null ``lang`` or ``doc_id`` are not learned from; a null ``doc_id`` counts as held out; repeated rows are learned from and
predicted each; an empty table gives an empty result; ``predict`` keeps further columns.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewalk.llm.bytesets import U, mixed, powers
from tidewalk.llm.columns import fresh
from tidewalk.llm.scratch import cut

WORD = re.compile(r"[^\W\d_]+")
#: Characters of words that are summed side by side (longer ones could fall below the least double); characters of longer words, and their bytes, that are looked at together.
SHORT, BLOCK, TOGETHER = 31, 4096, 80 << 20
#: Chance of a character that is no piece, and the count that every piece has besides its own.
UNKNOWN, SMOOTHING = 1e-9, 0.05
ROUNDS = 2
#: Mask of the hash bits that pick a piece's slot.
SLOTS, LATE_SLOTS = np.uint64((1 << 21) - 1), np.uint64((1 << 18) - 1)
#: Distinct words that a task keeps with their scores.
KEPT_WORDS = 400_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of the rows of a matrix of code points."""
    up, _ = powers(codes.shape[1] + 1)
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), U)
    np.cumsum(mixed(codes.astype(U) + U(1)) * up[: codes.shape[1]], axis=1, dtype=U, out=out[:, 1:])
    return out


def _spans(sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Of one word's sums: hashes of the spans of one length from each start."""
    return mixed((sums[start + length] - sums[start]) * powers(len(sums))[1][start] + U(length))


def _span(sums: np.ndarray, i: int, j: int) -> np.ndarray:
    return mixed((sums[:, j] - sums[:, i]) * powers(sums.shape[1])[1][i] + U(j - i))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length)


@lru_cache(2)
def longest_piece(path: str) -> int:
    """Characters of the longest piece of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return max(len(model.id_to_piece(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


@lru_cache(2)
def vocabulary_pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the pieces of a sentencepiece model, and their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p: i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (p := model.id_to_piece(i))}
    hashes, ids = [], []
    for length in range(1, longest_piece(path) + 1):
        if own := [p for p in pieces if len(p) == length]:
            hashes.append(_span(_hashes(_codes(own, length)), 0, length))
            ids += [pieces[p] for p in own]
    order = np.argsort(found := np.concatenate(hashes))
    return found[order], np.array(ids)[order]


@lru_cache(2)
def piece_slots(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """A direct table from the low bits of a hash to a piece, and one from other bits for pieces whose slot another one has."""
    hashes, ids = vocabulary_pieces(path)
    slots, n = np.zeros(int(SLOTS) + 1, np.int32), np.arange(len(hashes))
    slots[(hashes & SLOTS).astype(np.int64)] = n
    lost = np.flatnonzero(slots[(hashes & SLOTS).astype(np.int64)] != n)
    lost = lost if len(lost) else n[:1]
    bits = lambda shift: (hashes[lost] >> U(shift) & LATE_SLOTS).astype(np.int64)
    shift = next(k for k in range(20, 44) if len(np.unique(bits(k))) == len(lost))
    late = np.zeros(int(LATE_SLOTS) + 1, np.int32)
    late[bits(shift)] = np.arange(len(lost))
    return slots, hashes, ids, (U(shift), late, hashes[lost], ids[lost])


class Forward:
    """Sums over all segmentations of words. chance: a row for each piece (the last: unknown) and a column for each language."""

    def __init__(self, path: str, chance: np.ndarray):
        self.slots, self.hashes, self.ids, self.late = piece_slots(path)
        self.chance = np.concatenate([chance, np.zeros((1, chance.shape[1]))])
        self.none, self.longest = len(chance), longest_piece(path)

    def _pieces(self, h: np.ndarray, length: int) -> np.ndarray:
        """The pieces, or unknown for a single character, or none, of hashes of spans of one length."""
        at = self.slots[(h & SLOTS).astype(np.int64)]
        out = np.where(self.hashes[at] == h, self.ids[at], self.none - 1 if length == 1 else self.none)
        shift, slots, hashes, ids = self.late
        at = slots[(h >> shift & LATE_SLOTS).astype(np.int64)]
        return np.where(hashes[at] == h, ids[at], out)

    def _lengths(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size[size <= SHORT]).tolist():
            own = np.flatnonzero(size == length)
            step = max(1, TOGETHER // (8 * length * min(length, self.longest)))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                sums = _hashes(_codes([words[x] for x in part.tolist()], length))
                yield part, length, {(i, j): self._pieces(_span(sums, i, j), j - i) for j in range(1, length + 1) for i in range(max(0, j - self.longest), j)}

    def _blocks(self, word: str, columns: np.ndarray | slice, backward: bool = False):
        """first, pieces and logarithms of their chances, by length and start, of runs of starts in a long word."""
        sums = _hashes(_codes([word], len(word)))[0]
        starts = range(0, len(word), BLOCK)
        with np.errstate(divide="ignore"):
            logs = np.log(self.chance[:, columns])
        for a in reversed(starts) if backward else starts:
            start = np.arange(a, min(a + BLOCK, len(word)))
            pieces = np.full((self.longest, len(start)), self.none)
            for length in range(1, self.longest + 1):
                own = start[start + length <= len(word)]
                pieces[length - 1, : len(own)] = self._pieces(_spans(sums, own, length), length)
            yield a, pieces, logs[pieces]

    def _long(self, word: str, columns: np.ndarray | slice) -> np.ndarray:
        """Logarithms of the forward sums before each character of a long word and after the last one, with room behind."""
        n = self.chance[:1, columns].shape[1]
        alpha = np.full((len(word) + 1 + self.longest, n), -np.inf)
        alpha[0] = 0
        for a, _, logs in self._blocks(word, columns):
            for i in range(a, a + logs.shape[1]):
                alpha[i + 1 : i + 1 + self.longest] = np.logaddexp(alpha[i + 1 : i + 1 + self.longest], alpha[i] + logs[:, i - a])
        return alpha

    def _expected_long(self, word: str, language: int, freq: float, out: np.ndarray) -> None:
        """Add a long word's expected pieces to ``out``, by piece and language."""
        alpha = self._long(word, slice(language, language + 1))[:, 0]
        total, beta = alpha[len(word)], np.full(len(word) + 1 + self.longest, -np.inf)
        beta[len(word)] = 0
        for a, pieces, logs in self._blocks(word, slice(language, language + 1), backward=True):
            logs = logs[:, :, 0]
            for i in range(a + logs.shape[1] - 1, a - 1, -1):
                beta[i] = np.logaddexp.reduce(logs[:, i - a] + beta[i + 1 : i + 1 + self.longest])
            for length in range(1, self.longest + 1):
                at = np.arange(a, a + logs.shape[1])
                share = np.exp(alpha[at] + logs[length - 1] + beta[at + length] - total) * freq
                np.add.at(out, pieces[length - 1] * self.chance.shape[1] + language, share)

    def _alpha(self, part, length, pieces, column=None):
        n = 1 if column is not None else self.chance.shape[1]
        alpha = np.zeros((length + 1, len(part), n))
        alpha[0] = 1
        weight = {}
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                ids = pieces[i, j]
                if i + 1 < j and not (ids < self.none).any():
                    continue
                weight[i, j] = self.chance[ids] if column is None else self.chance[ids, column][:, None]
                alpha[j] += alpha[i] * weight[i, j]
        return alpha, weight

    def log_chances(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.chance.shape[1]))
        for part, length, pieces in self._lengths(words):
            out[part] = np.log(self._alpha(part, length, pieces)[0][length])
        for k, word in enumerate(words):
            if len(word) > SHORT:
                out[k] = self._long(word, slice(None))[len(word)]
        return out

    def expected(self, words: list[str], language: np.ndarray, freq: np.ndarray) -> np.ndarray:
        """Expected number of times that each language's words use each piece."""
        n = self.chance.shape[1]
        out = np.zeros(self.chance.shape[0] * n)
        for part, length, pieces in self._lengths(words):
            own = language[part]
            alpha, weight = self._alpha(part, length, pieces, own)
            beta = np.zeros_like(alpha)
            beta[length] = 1
            for j in range(length, 0, -1):
                for i in range(max(0, j - self.longest), j):
                    if (i, j) in weight:
                        beta[i] += weight[i, j] * beta[j]
            scale = (freq[part] / alpha[length][:, 0])[:, None]
            for (i, j), w in weight.items():
                np.add.at(out, pieces[i, j] * n + own, (alpha[i] * w * beta[j] * scale)[:, 0])
        for k, word in enumerate(words):
            if len(word) > SHORT:
                self._expected_long(word, int(language[k]), float(freq[k]), out)
        return out.reshape(-1, n)[:-1]


def text_words(text: str | None) -> list[str]:
    """Words of a text, without the word-start mark."""
    return WORD.findall(text.lower()) if text else []


def _word_counts(batches):
    total: dict = {}

    def rows():
        lang, word, freq = [], [], []
        for language, counts in total.items():
            lang += [language] * len(counts)
            word += counts.keys()
            freq += counts.values()
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(freq, pa.int64())], names=["lang", "word", "freq"])

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            total.setdefault(language, Counter()).update(text_words(text.as_py()))
            if sum(map(len, total.values())) >= KEPT_WORDS:
                yield rows()
    yield rows()


class LanguageModel:
    """Languages and the chances of pieces; small enough for any machine: vocabulary times languages."""

    def __init__(self, vocabulary: str, languages: list[str], chance: np.ndarray):
        self.vocabulary, self.languages, self.chance = vocabulary, languages, chance


def fit(documents: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from all rows with text and lang that are not held out."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=vocabulary).get_piece_size() + 1
    labelled = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = labelled.mapInArrow(_word_counts, "lang string, word string, freq long").groupBy("lang", "word").agg(F.sum("freq").alias("freq"))
    counts = cut(counts, "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    chance = np.full((size, max(1, len(languages))), 1 / size)
    chance[-1] = UNKNOWN
    for _ in range(rounds if languages else 0):
        sent = counts.sparkSession.sparkContext.broadcast(chance)

        def expect(batches, sent=sent):
            forward, place, total = Forward(vocabulary, sent.value), {x: k for k, x in enumerate(languages)}, 0
            for batch in batches:
                words = ["▁" + w for w in batch.column(1).to_pylist()]
                language = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                total = total + forward.expected(words, language, batch.column(2).to_numpy().astype(float))
            if not np.isscalar(total):
                piece, language = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], names=["piece", "language", "n"])

        sums = counts.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        total = np.full(chance.shape, SMOOTHING)
        total[sums["piece"].to_numpy(), sums["language"].to_numpy()] += sums["n"].to_numpy()
        chance = total / total[:-1].sum(0)
        chance[-1] = UNKNOWN
    return LanguageModel(vocabulary, languages, chance)


def predict(documents: DataFrame, model: LanguageModel, columns: list[str] | None = None) -> DataFrame:
    """The given columns of documents (all if none are given), lang_pred and score (posterior chance)."""
    columns = columns or [c for c in documents.columns if c not in ("lang_pred", "score")]
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = sent.value
        forward = Forward(model.vocabulary, model.chance)
        index = defaultdict(count().__next__)
        logs = np.zeros((0, len(model.languages)))
        names = pa.array(model.languages, pa.string())
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                if len(index) > KEPT_WORDS:
                    index = defaultdict(count().__next__)
                    logs = logs[:0]
                ids, counts, at = [], [], [0]
                for text in batch.column(batch.num_columns - 1):
                    own = Counter(text_words(text.as_py()))
                    if any(map(str.isalpha, own)) or any(c.isalpha() for w in own for c in w):
                        ids += map(index.__getitem__, own)
                        counts += own.values()
                    at.append(len(ids))
                new = list(index)[len(logs) :]
                logs = np.concatenate([logs, forward.log_chances(["▁" + w for w in new])]) if new and model.languages else logs
                n = np.diff(at)
                best, score = np.zeros(len(n), np.int64), np.zeros(len(n))
                if full := np.flatnonzero(n).tolist() if model.languages else []:
                    total = np.add.reduceat(logs[ids] * np.array(counts)[:, None], np.array(at)[full], axis=0)
                    total = np.exp(total - total.max(1, keepdims=True))
                    best[full] = total.argmax(1)
                    score[full] = total.max(1) / total.sum(1)
                found = np.zeros(len(n), bool)
                found[full] = True
                pred = names.take(pa.array(best)) if len(names) else pa.nulls(len(n), pa.string())
                pred = pc.if_else(pa.array(found), pred, "und")
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(columns))], pred, pa.array(score)], names=[*columns, "lang_pred", "score"])

    out = T.StructType([*[documents.schema[c] for c in columns], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(fresh(documents, "text")[0])).mapInArrow(scan, out)
