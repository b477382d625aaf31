"""Blocks of aligned texts: few in a file, their places in bytes, so that a task holds little of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quiescent.llm import alignment


def test_blocks_are_read_some_at_a_time(spark, monkeypatch):
    written = []
    real = alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda *a: written.append(real(*a)) or written[-1])
    monkeypatch.setattr(alignment, "SIZE", 300)
    docs = spark.range(80).selectExpr("id doc_id", "concat('text ', id, repeat(' more', 40 + cast(id % 3 as int))) text").coalesce(1)
    got = {r.doc_id: r for r in alignment.align(docs).collect()}
    files = [r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 2 * alignment.FILE_BLOCKS and max(files) <= alignment.FILE_BLOCKS
    assert {written[0].schema[c].dataType.simpleString() for c in ("stretches", "n_links", "links")} == {"binary"}
    monkeypatch.undo()
    whole = {r.doc_id: r for r in alignment.align(docs).collect()}
    assert got == whole and len(got) == 80 and all(r.n_links for r in got.values())


def test_places_are_packed_whole():
    for v in (np.zeros(0, np.int64), np.arange(5), np.array([0, 255, 256, 2**31 - 1, 65536, 7])):
        assert alignment.unpacked(alignment.packed(v)).tolist() == v.tolist()
    assert len(alignment.packed(np.arange(100_000) % 300)) < 40_000
