"""The registered queries without SQL, on a folder of small tables with nulls, empty, repeated and long texts, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidewalk.llm import language_id, mpeg, queries, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, r = str(tmp_path_factory.mktemp("tables")), random.Random(11)
    words = {"en": "the of and river stone light walk house green".split(), "de": "der die und fluss stein licht gehen haus grün".split()}
    rows, labels = [], []
    for i in range(220):
        lang = r.choice(["en", "de"])
        w = [r.choice(words[lang]) + r.choice(["", "", "s"]) for _ in range(r.randint(1, 220))]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(len(w)) : 0] = [r.choice(["vileone", "viletwo", "vilest"]) for _ in range(2)]
        rows.append((i, " ".join(w), lang if i % 9 else None, f"s{i % 3}"))
        labels.append((i, int(toxic) if i % 7 else None))
    passage = rows[3][1] + " " + rows[5][1] + " " + rows[9][1]
    rows += [(300, None, "en", None), (301, "", None, "s1"), (302, "12 ½² !?\n", "de", "s1"), (303, passage, None, "s0"), (304, "x" + passage, None, "s0"), (305, "the river TAG " * 9000, "en", "s2"), rows[10], (306, "<|endoftext|> 'll ½", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (300, 1), (999, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, dict(labels)


def _held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op4(spark, tables):
    folder, rows, _ = tables
    seen, want = set(), {}
    for i, text, *_ in sorted(set(rows), key=lambda x: x[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            gone[s : s + 100] |= data[s : s + 100] in seen
            seen.add(data[s : s + 100])
        want[i] = (len(data), int(gone.sum()), int(np.diff(np.concatenate([[0], gone])).clip(0).sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    out = queries.op4_suffix_dedup(spark, folder).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted((x[0], *want[x[0]]) for x in rows)
    assert want[304][1] > 500 and want[305][1] > 100_000


def test_op8(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, _ = tables
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 512))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_counts(spark, folder).collect()) == sorted(want)
    assert any(w[3] for w in want)


def _walk(data: bytes) -> tuple[list[int], int]:
    """Offsets of the Layer III frames of a file, by a reader that knows no more than headers and lengths; and where they end."""
    at, out = 0, []
    if data[:3] == b"ID3":
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    rates = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xFE == 0xFA:
        out.append(at)
        at += 144_000 * rates[data[at + 2] >> 4] // (44_100, 48_000, 32_000)[data[at + 2] >> 2 & 3] + (data[at + 2] >> 1 & 1)
    return out, at


def test_op9(spark, tables):
    folder, rows, _ = tables
    got = sorted(tuple(r) for r in queries.op9_mpeg_audio(spark, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature").collect())
    media = {r.doc_id: bytes(r.media) for r in mpeg.with_media(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    want = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b"\0" * (max(1, -(-len(data) // 64)) * 64 - len(data))
        offsets, end = _walk(media[i])
        assert end == len(media[i])  # whole frames to the last byte
        assert payload[:50] in media[i] and len(media[i]) >= len(payload)
        played = [x for x in offsets if b"Xing" not in media[i][x : x + 60] and b"Info" not in media[i][x : x + 60]]
        seek = zlib.crc32(",".join(map(str, played)).encode())
        parts = [f"n_frames={len(played)}", f"samples={1152 * len(played)}", "sample_rate=44100", f"duration_s={1152 * len(played) / 44100!r}", "table_fits=true", f"n_checked={len(played)}", "n_broken=0", "n_skipped=0", f"seek={seek}"]
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), ";".join(parts)))
    number = lambda x: re.sub(r"duration_s=([^;]*)", lambda m: f"duration_s={float(m[1]):.9f}", x[-1])
    assert [(*x[:-1], number(x)) for x in got] == [(*x[:-1], number(x)) for x in sorted(want)]


def _slow_score(net, text):
    """Gates, states, attention and pooling of each window, a word and a unit at a time."""
    words, h, best = toxicity.text_words(text), toxicity.HIDDEN, -np.inf
    if not words or net is None:
        return 0.0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    windows = max(1, -(-(len(words) - (toxicity.WINDOW - toxicity.STEP)) // toxicity.STEP))
    rows = {w: net.inputs([w])[0][0].astype(float) for w in set(words)}
    for k in range(windows):
        window, sides = words[k * toxicity.STEP : k * toxicity.STEP + toxicity.WINDOW], []
        for side in "fb":
            w, u, c = (net.dense[x + side].astype(float) for x in "wuc")
            state, states = np.zeros(h), []
            for word in window if side == "f" else reversed(window):
                x, rec = rows[word] @ w + c, state @ u
                z, r = sigmoid(x[:h] + rec[:h]), sigmoid(x[h : 2 * h] + rec[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * rec[2 * h :])
                states.append(state)
            sides.append(states if side == "f" else states[::-1])
        both = np.array([np.concatenate(x) for x in zip(*sides)])
        energy = np.tanh(both @ net.dense["a"]) @ net.dense["v"]
        weight = np.exp(energy - energy.max())
        best = max(best, (weight / weight.sum()) @ both @ net.dense["out"] + net.dense["bias"][0])
    return float(sigmoid(best))


def test_op7(spark, tables, monkeypatch):
    folder, rows, labels = tables
    fit, nets = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda *given: nets.append(fit(*given)) or nets[-1])
    out = queries.op7_toxicity(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == sorted(x[0] for x in rows)
    texts = {x[0]: x[1] for x in rows}
    for r in out:
        assert r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id % 6 == 0 or r.doc_id >= 300:
            assert abs(r.score - _slow_score(nets[0], texts[r.doc_id])) < 1e-3, r.doc_id
    judged = [r.predicted == labels[r.doc_id] for r in out if r.held_out and labels.get(r.doc_id) is not None]
    assert len(judged) > 20 and np.mean(judged) > 0.9
    again = {r.doc_id: r.score for r in out}
    assert len(again) == len(rows) - 1 and all(r.score == again[r.doc_id] for r in out)  # repeated rows agree


def test_op7_takes_nothing_but_texts_and_labels_of_other_rows(spark, tables, tmp_path):
    folder, rows, labels = tables
    changed = [(i, text, "xx", "zz") for i, text, _, _ in rows]
    spark.createDataFrame(changed, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    other = [(i, 1 - y if _held(i) else y) for i, y in labels.items() if y is not None]
    spark.createDataFrame([*other, (300, 1), (999, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = lambda folder: {r.doc_id: r.score for r in queries.op7_toxicity(spark, folder).collect()}
    assert score(folder) == pytest.approx(score(str(tmp_path)), abs=1e-6)


def test_op10(spark, tables):
    folder, rows, _ = tables
    out = queries.op10_language_id(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    forward = language_id.Forward(model.vocabulary, model.chance)
    assert sorted(r.doc_id for r in out) == sorted(x[0] for x in rows)
    texts, langs = {x[0]: x[1] for x in rows}, {x[0]: x[2] for x in rows}
    words = sorted({w for t in texts.values() for w in language_id.text_words(t)})
    logs, right = dict(zip(words, forward.log_chances(["▁" + w for w in words]))), []
    for r in out:
        text = texts[r.doc_id]
        assert r.held_out == _held(r.doc_id) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum(logs[w] for w in language_id.text_words(text))
        chance = np.exp(total - total.max())
        assert r.lang_pred == model.languages[int(total.argmax())] and abs(r.score - chance.max() / chance.sum()) < 1e-9, r.doc_id
        right += [r.lang_pred == langs[r.doc_id]] if r.held_out and langs[r.doc_id] else []
    assert len(right) > 20 and np.mean(right) > 0.95
