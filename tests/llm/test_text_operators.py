"""The operators on texts against brute force, on a fixture with copies, ties, nulls, empty and long texts, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidewalk.llm import decontaminate, language_id, line_dedup, mixing, mpeg, near_dedup, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, key string, v long, salt int, _id string, _th long, _lines string, _starts int, hits string, items int, n_hit string, m map<string,int>"


def _texts(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    text = lambda lines=6: "\n".join(line(r.randint(3, 25)) for _ in range(lines))
    passage, base = "\n".join(line(20) for _ in range(4)), text(12)
    out = [text() for _ in range(12)]
    out += [base] * 3 + [base.replace(" ", "  ", 1), base + "\nfin", base.upper()]
    for _ in range(8):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [text(2) + "\n" + passage + "\n" + text(2) for _ in range(6)]
    out += [None, "", " \t\n", "a", "a b c", "a b c", "x" * 1000, "aaaa " * 400, "12 34 ½ !!", "don't <|endoftext|>'ll՘ tail   ", text(900), "\n\n\n\n\n", "É" * 150]
    return out


TEXTS = _texts()
BENCHMARK = [(1, " ".join(TEXTS[0].split()[:30])), (2, "A b C"), (10, " ".join(TEXTS[3].split()[4:17])), (3, None), (4, ""), (10, "a"), (5, " ".join(TEXTS[20].split()[:14])), (None, "c")]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "", None]), 7, 1, "k", 2, 3, "i", 4, "l", 5, "h", 6, None, {"a": i, "b": 1}) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[12], (None, TEXTS[2], *[None] * 15), (None, None, *[None] * 15), (None, TEXTS[20], *[None] * 15), (3, TEXTS[14], *[None] * 15)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def _words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_duplicates(docs, threshold):
    rows = _rows(docs)
    sets = []
    for _, text in rows:
        w = _words(text, SPACED)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= round(threshold * 100) * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    name = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = sorted((repr(i), len(sets[k]), repr(name[find(k)]), i == name[find(k)]) for k, (i, _) in enumerate(rows))
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in near_dedup.near_duplicates(docs, threshold).collect())
    assert got == want
    assert len({x[2] for x in want}) < len(rows) - 8


def _components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(sets))]


@pytest.mark.parametrize("block,levels,together", [(8, 1, 10**9), (8, 6, 300), (3, 0, 10**9), (2048, 6, 150)])
def test_large_nodes_branch_and_large_clusters_split(spark, block, levels, together):
    r = random.Random(block)
    words = [f"w{k}" for k in range(400)]
    base, rows = [r.choice(words) for _ in range(60)], []
    for k in range(60):
        w = list(base)
        w[r.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for k in range(60)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    root = _components(sets, 80)
    least = {g: min(rows[k][0] for k in range(len(rows)) if root[k] == g) for g in set(root)}
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, block, levels, together)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: least[root[k]] for k, (i, _) in enumerate(rows)}
    assert len(set(root)) < 110


def test_one_row_of_each_component_stays(docs):
    rows = [(r.doc_id, r.th, r.text) for r in docs.selectExpr("doc_id", "xxhash64(text) as th", "text").collect()]
    sets = []
    for _, _, text in rows:
        w = _words(text, SPACED)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    groups, want = defaultdict(list), set()
    for k, g in enumerate(_components(sets, 80)):
        groups[g].append(k)
    for members in groups.values():
        want |= {rows[min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))]}
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == sorted(repr((i, t)) for i, _, t in want)


def test_walk_reaches_all_and_tests_little():
    links = {(a, b) for a in range(0, 60) for b in range(0, 60) if a != b and a % 3 == b % 3}
    asked = []

    def linked(k, others):
        asked.append(len(others))
        return np.array([x for x in others if (k, int(x)) in links], int)

    forest = list(near_dedup._walk(60, linked))
    assert len(forest) == 57 and set(forest) <= links and sum(asked) < 60 * 59 / 2


def test_mixing(docs):
    got = mixing.mix(docs, block_tokens=16).collect()
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = [(r.source, len(re.findall(SPACED, r.text or ""))) for r in rows]
    assert len(got) == len(rows)
    total, by = sum(n for _, n in sizes), defaultdict(int)
    for s, n in sizes:
        by[s] += n
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight, target, open_, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set(by), 1.5 * total
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * by[s]}
        for s in full or open_:
            target[s] = 2 * by[s] if full else weight[s] * unit
            left -= target[s]
        open_ -= full or set(open_)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in by)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5), block_tokens=16).collect()))
    assert sorted((r.target, r.taken) for r in mixing.mix(docs, block_tokens=1000).groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "taken", "target").collect() if r.target) != []


def test_mix_order_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    pieces, placed = mixing.mix_pieces(docs, block_tokens=50)
    order = [r.sid for r in pieces.join(placed.select("doc_id", "source"), "doc_id").orderBy("slot", "begin").collect()]
    for end in (100, 200, 400):
        assert all(abs(order[:end].count(s) / end - order.count(s) / len(order)) < 0.05 for s in range(3))


def _line_dedup_brute_force(rows):
    """Lines of each (doc_id, hash, text) and the numbers of those removed."""
    seen, out = set(), {}
    for known, i, th, text in sorted({(i is not None, i or 0, th, t) for i, th, t in rows if t is not None}):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        out[i if known else None, text] = (lines, gone)
    return out


def test_line_dedup(docs):
    rows = docs.selectExpr("doc_id", "xxhash64(text)", "text", "m['a']").collect()
    found, want = _line_dedup_brute_force([tuple(r)[:3] for r in rows]), []
    for i, _, text, a in rows:
        lines, gone = found.get((i, text), ([], set()))
        kept = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append(repr((i, a, len(lines), len(gone), sum(k - 1 not in gone for k in gone), kept)))
    out = line_dedup.dedup_lines(docs)
    assert sorted(repr((r.doc_id, (r.m or {}).get("a"), r.n_lines, r.n_removed, r.n_spans, r.text)) for r in out.collect()) == sorted(want)
    assert set(docs.columns) | {"n_lines", "n_removed", "n_spans"} == set(out.columns)
    plain = line_dedup.dedup_lines(docs, counts=False, drop_emptied=True)
    assert set(plain.columns) == set(docs.columns) and "Python" not in plain._jdf.queryExecution().toString()
    left = lambda lines, gone: "".join(x for k, x in enumerate(lines) if k not in gone)
    emptied = sum(bool(found[i, t][1]) and not left(*found[i, t]).strip() for i, _, t, _ in rows if t is not None)
    assert emptied >= 3 and plain.count() == len(rows) - emptied and {r.n_lines for r in plain.select("n_lines").collect()} == {1, None}


def _suffix_brute_force(docs):
    """Rows that op4 has to give, as a sorted list: texts of one id are in order of their hash."""
    rows = [(r.doc_id, r.th, r.text or "") for r in docs.selectExpr("doc_id", "xxhash64(text) as th", "text").collect()]
    seen, out = set(), {}
    for known, i, th, text in sorted({(i is not None, i or 0, th, text) for i, th, text in rows}):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
        out[i if known else None, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(repr((i, *out[i, text])) for i, _, text in rows)


def _suffix_rows(found):
    rows = found.collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows)


@pytest.mark.parametrize("split", [2, 20_000])
def test_suffix_dedup(docs, split):
    assert _suffix_rows(suffix_dedup.dedup_bytes(docs, split)) == _suffix_brute_force(docs)


def test_suffix_dedup_of_hot_anchors(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 0.001)
    monkeypatch.setattr(suffix_dedup, "LEAST", 1)
    hashed = docs.filter("text is not null").selectExpr("doc_id", "xxhash64(text) as th", "text")
    assert len(suffix_dedup.hot_anchors(hashed, "doc_id long, th long, place long, anchor long, block long, flag byte", 1.0)) > 5
    assert _suffix_rows(suffix_dedup.dedup_bytes(docs, sample=1.0)) == _suffix_brute_force(docs)


def test_suffix_dedup_of_many_texts_under_one_id(spark):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = [text(130) for _ in range(20)]
    rows = [(1 if k % 2 else None, text(134) if k % 10 else text(20) + r.choice(shared) + text(20)) for k in range(30_000)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = _suffix_brute_force(docs)
    assert _suffix_rows(suffix_dedup.dedup_bytes(docs)) == want and sum(", 0, 0, " not in x for x in want) > 2000


def test_suffix_blocks_are_combined_over_slices(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    same = "".join(r.choice("abcdefgh") for _ in range(400))
    order = [5, 9, 4, 7, None, 8, 8, 2, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array([1] * len(order)), pa.array([same] * len(order))], names=["doc_id", "th", "text"])
    first = {}
    for out in suffix_dedup._blocks(iter([batch]), np.zeros(0, np.uint64)):
        for i, block, place, flag in zip(*[out.column(c).to_pylist() for c in (0, 4, 2, 5)]):
            if flag == suffix_dedup.PLAIN:
                first.setdefault((block, place), []).append(i)
            else:  # an earlier one of equal bytes came out before or comes out with it
                assert any(x is None or i is not None and x < i for x in first[block, place])
    assert all(None in x and len(x) < len(order) - 2 for x in first.values())


def test_previous_factors_of_suffixes():
    r = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        v = r.permutation(n)
        before = [next((k for k in range(i - 1, -1, -1) if v[k] < v[i]), -1) for i in range(n)]
        assert suffix_dedup.previous_smaller(v).tolist() == suffix_dedup.previous_smaller(v, 1).tolist() == before
        assert suffix_dedup.next_smaller(v).tolist() == [next((k for k in range(i + 1, n) if v[k] < v[i]), -1) for i in range(n)]
    for letters, period in ((1, 0), (2, 0), (3, 70), (2, 130)):
        data = r.integers(97, 97 + letters, 400).astype(np.uint8)
        data = np.tile(data[:period], 9)[:400] if period else data
        starts = np.sort(r.choice(301, 150, replace=False))
        body = data.tobytes()
        same = lambda s, t: next((k for k in range(100) if body[s + k] != body[t + k]), 100)
        want = [max((same(s, t) for t in starts[:k]), default=0) for k, s in enumerate(starts)]
        assert suffix_dedup.longest_previous_factors(data, starts).tolist() == want


@pytest.mark.parametrize("full", [False, True])
def test_decontamination(spark, docs, full, monkeypatch):
    if full:  # as if there were so many items that the map lets every window pass
        monkeypatch.setattr(decontaminate, "_fingerprint_map", lambda windows: np.full(1 << (decontaminate.MAP_BITS - 6), (1 << 64) - 1, np.uint64))
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    rows, want, clean = docs.selectExpr("doc_id", "text", "m['a'] as a").collect(), [], []
    for i, text, a in rows:
        w, hit, items = _words(text, ALNUM), set(), set()
        for item, passage in BENCHMARK:
            p = _words(passage, ALNUM)
            n = min(13, len(p))
            for x in range(len(p) - n + 1 if p else 0):
                for y in range(len(w) - n + 1):
                    if w[y : y + n] == p[x : x + n]:
                        hit |= set(range(y, y + n))
                        items.add("" if item is None else str(item))
        want.append(repr((i, text, a, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w))))
        clean += [] if hit and 20 * len(hit) >= len(w) else [repr((i, text, a))]
    got = decontaminate.find_contamination(docs, bench).collect()
    assert sorted(repr((r.doc_id, r.text, (r.m or {}).get("a"), r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated)) for r in got) == sorted(want)
    assert all(set().union(*[range(h.s, h.e) for h in r.hits] or [()]) and len(set().union(*[range(h.s, h.e) for h in r.hits])) == r.n_hit for r in got if r.n_hit)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(repr((r.doc_id, r.text, (r.m or {}).get("a"))) for r in kept.collect()) == sorted(clean)
    if not full:
        assert decontaminate.contamination(docs, bench).count() == len(rows)


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = sorted((repr(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in _rows(docs))
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_token_counts_join_beyond_the_head(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "HEAD", 5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = sorted((repr(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in _rows(docs))
    assert sorted((repr(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()) == want


def test_media_round_trip(docs):
    stored = mpeg.with_media(docs)
    want = sorted((repr(i), hashlib.sha256(mpeg.payload_of((t or "").encode())).hexdigest()) for i, t in _rows(docs))
    read = mpeg.read_media(stored).collect()
    assert sorted((repr(r.doc_id), hashlib.sha256(r.payload).hexdigest()) for r in read) == want
    for r in read:
        assert r.table_fits and r.n_broken == 0 and r.n_skipped == 0 and r.n_checked == r.n_frames == len(r.seek_offsets)
        assert r.samples == 1152 * r.n_frames and abs(r.duration_s - r.samples / 44100) < 1e-9 and len(r.payload) % 64 == 0


def test_media_survives_junk_and_damage():
    payload = bytes(range(1, 129)) * 40
    data = mpeg.write_file(payload)
    whole = mpeg.read_file(data)
    assert whole.ancillary[: len(payload)] == payload and whole.tags["payload_bytes"] == str(len(payload))
    junk = mpeg.read_file(data[: whole.offsets[2]] + b"\xff\xfb\x00junk\xff\xe0" + data[whole.offsets[2] :])
    assert junk.ancillary == whole.ancillary and junk.skipped == 9 and not junk.table_fits
    flipped = bytearray(data)
    flipped[whole.offsets[1] + 10] ^= 1
    assert mpeg.read_file(bytes(flipped)).broken == 1
    tail = mpeg.read_file(data + b"TAG" + b"name".ljust(125, b"\0"))
    assert tail.tags["title"] == "name" and tail.offsets == whole.offsets
    assert mpeg.read_file(None).offsets == [] and mpeg.read_file(b"no audio at all").offsets == []
    assert mpeg.parse_header(bytes([0xFF, 0xFB, 0x90, 0xC0])).length == 417 and mpeg.parse_header(bytes([0xFF, 0xFF, 0x90, 0xC0])).layer == 1


def test_media_keeps_a_payload_that_looks_like_a_tag():
    sizes, biggest, tried = mpeg._frames(), mpeg._frames()[-1][0], 0
    for room, _ in sizes:
        for full in (0, 1):
            n = full * biggest + room
            marked = [(b"x" * at + b"TAG").ljust(n, b"x") for at in range(n - 2)]
            payload = next((x for x in marked if mpeg.write_file(x)[-128:-125] == b"TAG"), None)
            if payload is None:
                continue  # in the smallest frames a header or no frame at all is there
            tried += 1
            plain, named = mpeg.write_file(payload), mpeg.write_file(payload) + b"TAG" + b"name".ljust(125, b"\0")
            for read in map(mpeg.read_file, (plain, named)):
                assert read.ancillary == payload and read.table_fits and read.broken == read.skipped == 0
            assert "title" not in mpeg.read_file(plain).tags and mpeg.read_file(named).tags["title"] == "name"
    assert tried == 2 * (len(sizes) - 2) + 1
    text = b"HTML TAG " + b"y" * 60
    assert mpeg.read_file(mpeg.write_file(mpeg.payload_of(text))).ancillary.startswith(text)
    assert mpeg.read_file(b"TAG" + b"name".ljust(125, b"\0")).tags == {"title": "name"}


def test_foreign_media_give_tables_checksums_and_durations():
    def frames(head, n, fill=b""):
        return (bytes(head) + fill).ljust(mpeg.parse_header(bytes(head)).length, b"\0") * n

    slow, fast = frames([0xFF, 0xFB, 0x50, 0xC0], 3), frames([0xFF, 0xFB, 0x54, 0xC0], 2)
    read = mpeg.read_file(slow + fast)
    assert read.samples == 5 * 1152 and read.seconds == pytest.approx(3 * 1152 / 44100 + 2 * 1152 / 48000) and mpeg.read_file(None).seconds == 0
    size = len(slow) // 3 + len(slow)
    table = b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + size.to_bytes(4) + (3).to_bytes(4) + b"\0\3\0\2\0\1\0\1" + bytes([52, 53, 54])
    read = mpeg.read_file(frames([0xFF, 0xFB, 0x50, 0xC0], 1, bytes(32) + table) + slow)
    assert len(read.offsets) == 3 and read.table_fits and read.table["entries"] == [104, 106, 108] and read.table["quality"] == 75
    # Layer I with a checksum: mono, stereo, joint stereo of bound 8
    for modes, covered in ((0xC0, 16), (0x00, 32), (0x50, 20)):
        head = bytes([0xFF, 0xFE, 0x50, modes])
        bits = bytes(range(covered))
        frame = frames(head, 1, mpeg.crc16(head[2:] + bits).to_bytes(2) + bits + b"\1")
        spoilt = bytearray(frame)
        spoilt[5 + covered] ^= 1
        read = mpeg.read_file(frame + bytes(spoilt) + frame)
        assert (read.checked, read.broken, len(read.offsets)) == (3, 1, 3)


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {model.id_to_piece(k): k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))}
    chance = np.random.default_rng(3).random((model.get_piece_size() + 1, 2)) / 1000
    forward = language_id.Forward(path, chance)

    def total(word, column):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            piece = ids.get(word[:n], len(chance) - 1 if n == 1 else None)
            if piece is not None and n <= language_id.longest_piece(path):
                out += chance[piece, column] * total(word[n:], column)
        return out

    words = ["▁the", "▁a", "▁straße", "▁՘x", "▁international"]
    want = np.log([[total(w, c) for c in range(2)] for w in words])
    assert np.allclose(forward.log_chances(words), want)
    long = "▁" + "international" * 700 + "straße՘" * 40  # against the plain recursion over its last characters, in logarithms
    log = [0.0]
    for j in range(1, len(long) + 1):
        ways = [(log[j - n] + np.log(chance[piece, 1])) for n in range(1, min(j, 16) + 1) if (piece := ids.get(long[j - n : j], len(chance) - 1 if n == 1 else None)) is not None]
        log.append(max(ways) + np.log(sum(np.exp(w - max(ways)) for w in ways)))
    assert np.isclose(forward.log_chances(["▁a", long])[1, 1], log[-1])
    middle = "▁" + "international" * 2  # 27 characters, summed side by side; the same one by one
    one, two = (np.zeros(len(forward.chance) * 2) for _ in range(2))
    forward._expected_long(middle, 1, 3.0, one)
    assert np.allclose(one.reshape(-1, 2)[:-1], forward.expected([middle], np.array([1]), np.array([3.0])))
    assert np.isclose(forward._long(middle, slice(None))[len(middle)], forward.log_chances([middle])[0]).all()
    share = forward.expected([long], np.array([0]), np.array([1.0]))
    assert np.isclose((share * np.array([[len(model.id_to_piece(k)) if k < model.get_piece_size() else 1] for k in range(len(share))])).sum(), len(long))
    once = forward.expected(["▁the"], np.array([0]), np.array([2.0]))
    assert np.isclose((once * np.array([[len(model.id_to_piece(k)) if k < model.get_piece_size() else 1] for k in range(len(once))])).sum(), 8)


def test_language_id(spark):
    r, rows = random.Random(5), []
    vocabulary = {"en": "the of and river stone light walk house".split(), "de": "der die und fluss stein licht gehen haus".split()}
    for i in range(300):
        lang = r.choice(["en", "de"])
        rows.append((i, " ".join(r.choice(vocabulary[lang]) for _ in range(r.randint(1, 30))), lang, "x"))
    rows += [(300, None, "en", None), (301, "", None, None), (302, "12 ½² !? ", "de", None), (None, "the river", "de", None), (303, "HOUSE light", None, None), (304, "der " * 3000, "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert model.languages == ["de", "en"]
    out = language_id.predict(docs, model).collect()
    assert len(out) == len(rows)
    right = [x.lang_pred == x.lang for x in out if x.doc_id is not None and x.doc_id < 300 and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert len(right) > 30 and np.mean(right) > 0.98
    by = {x.doc_id: x for x in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (300, 301, 302))
    assert by[303].lang_pred == by[None].lang_pred == "en" and by[304].lang_pred == "de" and all(0 <= x.score <= 1 for x in out)
    nothing = language_id.fit(docs.filter("false"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {x.lang_pred for x in language_id.predict(docs, nothing).collect()} == {"und"} and language_id.predict(docs.filter("false"), model).count() == 0


def test_toxicity_gradients():
    net = toxicity.Network(1)
    words = ["bad", "fine", "worse", "good"]
    net.gram_known[:] = net.word_known[:] = True
    net.grams[:] = np.random.default_rng(1).standard_normal(net.grams.shape) * 0.5
    rows, _ = net.inputs(words)
    ids, mask, _ = toxicity._windows(np.array([0, 1, 2, 3, 1]), np.array([0, 3, 5]), toxicity.WINDOW)
    run = lambda: net.forward(*[t[ids] for t in net.gate_table(rows)], mask)
    keep = {}
    net.forward(*[t[ids] for t in net.gate_table(rows)], mask, keep)
    g, *_ = net.backward(np.ones(2, np.float32), keep)
    for name in ("ub", "uf", "a", "v", "out", "cf"):
        at = (0,) * net.dense[name].ndim
        old = net.dense[name][at]
        net.dense[name][at] = old + 0.01
        up = run().sum()
        net.dense[name][at] = old - 0.01
        down = run().sum()
        net.dense[name][at] = old
        assert abs((up - down) / 0.02 - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def test_toxicity(spark):
    r, rows, labels = random.Random(8), [], []
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(150)]
    for i in range(240):
        w = [r.choice(words) for _ in range(r.randint(3, 200))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["vileone", "viletwo", "vilest", "vilely"]))
        rows.append((i, " ".join(w), float(i)))
        labels.append((i, int(bad)))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, "vileone viletwo", 0.0), (1002, "fine " * 5000 + "vilest vileone " + "fine " * 100, 0.0)]
    labels += [(1000, 1), (1001, None), (None, 1)]
    docs, labels_df = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(docs, labels_df)
    out = {x.doc_id: x.score for x in toxicity.score(docs, net, ["doc_id"]).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values()) and out[1000] == out[1001] == 0
    held = [(out[i] >= 0.5) == bool(y) for i, y in labels[:240] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.9 and out[None] > 0.5 and out[1002] > 0.5
    assert toxicity.fit(docs, labels_df.filter("toxic = 0")) is None
    assert {x.score for x in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}


def test_empty_tables(spark, docs):
    none, path = docs.filter("false"), public_tokenizers.path("byte_bpe_50k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_duplicates(none).count() == mixing.mix(none).count() == line_dedup.dedup_lines(none).count() == suffix_dedup.dedup_bytes(none).count() == 0
    assert token_counts.count_tokens(none, path).count() == mpeg.read_media(mpeg.with_media(none)).count() == decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench).agg({"n_hit": "sum"}).first()[0] == 0


def test_pretokens_are_the_librarys():
    from tokenizers import Tokenizer

    from tidewalk.llm.pretokens import pretokens

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for code in [*range(0x260), *range(0x500, 0x600), 0x1C, 0x2003, 0x2019, 0x2028, 0x3000, 0x4E2D, 0x1F600]:
        c = chr(code)
        for text in (f"a{c}b {c}{c} 1{c}  {c}\n{c}", f"it's{c}'ll {c}"):
            assert pretokens(text, tokenizer) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(code)


def _thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_long_words_over_two_letters_stay_apart(spark):
    """Words whose polynomials modulo 2**64 are equal, alone and inside texts."""
    around = "one two three four five six seven {} eight nine ten eleven twelve thirteen fourteen"
    rows, items = [], []
    for k, n in enumerate([128, 256, 1024, 4096]):
        a, b = _thue_morse(n)
        rows += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, around.format(a)), (10 * k + 3, around.format(b)), (10 * k + 4, a + "c" + b)]
        items += [(k, b), (100 + k, around.format(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_dedup.near_duplicates(docs, threshold=0.85)
    assert all(r.kept and r.component_id == r.doc_id for r in found.collect())
    hit = {r.doc_id: sorted(r["items"]) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k in range(4):
        assert hit[10 * k] == hit[10 * k + 2] == hit[10 * k + 4] == []
        assert hit[10 * k + 1] == [str(k)] and hit[10 * k + 3] == sorted([str(k), str(100 + k)])
    want, seen = {}, set()
    for i, text in rows:
        data, gone = text.encode(), np.zeros(len(text), bool)
        for s in range(len(data) - 99):
            gone[s : s + 100] |= data[s : s + 100] in seen
            seen.add(data[s : s + 100])
        want[i] = int(gone.sum())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(docs).collect()} == want


def test_a_window_of_many_items_meets_them_once_a_document(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x{i} {shared} y") for i in range(20)] + [(99, "own5 " + shared + " own5"), (100, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert all(len(out[i]["items"]) == 300 and out[i].n_hit == 40 for i in range(20)) and out[99].n_hit == 41 and len(out[99]["items"]) == 300 and out[100].n_hit == 0
