"""Tasks work on parts of bounded text size."""

import pyarrow as pa

from valora.llm.common import in_parts


def test_parts_are_bounded_and_whole():
    texts = ["x" * 40] * 30 + [None, "", "é" * 300, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(in_parts([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)], 1, most=100))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    for p in parts:
        assert p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100
