"""Media are written and read in pieces of bounded size."""

import pyarrow as pa

from tidewalk.llm import mpeg


def test_long_texts_make_small_pieces(monkeypatch):
    monkeypatch.setattr(mpeg, "TOGETHER", 1000)
    texts = ["x" * 600] * 5 + [None] + ["y" * 5000] + [""] * 1200 + ["z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(mpeg.pieces(batch, 1))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert all(p.num_rows <= 1000 and (p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 1000) for p in parts)
    assert list(mpeg.pieces(batch.slice(0, 0), 1)) == []
