"""Tasks on whole texts hold few of them at once and give their memory back."""

from __future__ import annotations

import pyarrow as pa

from quiescent.llm import blocks


def test_few_texts_at_once_and_memory_given_back(monkeypatch):
    b = pa.RecordBatch.from_pydict({"text": ["x"] * (3 * blocks.ROWS + 7)})
    got = [x.num_rows for x in blocks.sliced(iter([b, b.slice(0, 0)]))]
    assert got == [blocks.ROWS] * 3 + [7]
    said: list[str] = []
    monkeypatch.setattr(blocks, "give_back", lambda: said.append("back"))

    def run(batches):
        yield from batches
        said.append("ended")

    assert list(blocks.handed_back(run)(iter([b]))) == [b]
    assert said == ["ended", "back"]
