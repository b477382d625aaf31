"""Blocks of documents with what they hold of something counted over the whole corpus.

An operator that needs corpus-wide counts of the things in a text (words, pairs of
tokens) writes a row for each block of documents: the block's distinct things with
their counts, and the documents in terms of those. The counts are summed over all
blocks, looked up for the things of each block, and go back to it as one row. What is
shuffled are the distinct things of blocks, never a row for each occurrence.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Rows of an Arrow batch that are taken out of it at a time.
ROWS = 500


def block_ids() -> Iterator[int]:
    """Numbers that no other task gives."""
    return itertools.count(TaskContext.get().partitionId() << 33)  # type: ignore[union-attr]


def block_rows(batches: Iterator[pa.RecordBatch], columns: list[str], size: int = BLOCK_BYTES) -> Iterator[list[list]]:
    """Values of each column of a task's rows in blocks of about ``size`` characters; the first column is the text."""
    held: list[list] = [[] for _ in columns]
    n = 0
    for b in sliced(batches):
        got = [b[c].to_pylist() for c in columns]
        start = 0
        for i, text in enumerate(got[0]):
            n += len(text or "") + 1
            if n >= size:
                for h, g in zip(held, got, strict=True):
                    h.extend(g[start : i + 1])
                yield held
                held, n, start = [[] for _ in columns], 0, i + 1
        for h, g in zip(held, got, strict=True):
            h.extend(g[start:])
    if held[0]:
        yield held


def give_back() -> None:
    """At the end of a task, return what its batches took to the system: the worker stays for the next, and so would the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def handed_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of batches to batches, whose task gives its memory back when it has ended."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts some rows at a time, so that no more of them are Python strings at once."""
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def looked_up(blocks: DataFrame, things: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(block, found): for each block the structs ``(pos, *values)`` of those of its things that ``things(key, values)`` has.

    ``blocks(block, pos, *key)`` has a row for each distinct thing of a block, so what
    is gathered for one is bounded by the block.
    """
    got = blocks.join(things.select(*key, *values), key)
    return got.groupBy("block").agg(F.collect_list(F.struct("pos", *values)).alias("found"))
