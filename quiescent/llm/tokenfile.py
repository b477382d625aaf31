"""Token ids of documents as Parquet files in ascending order of id.

A folder holds ``tokens``, a row for each document, and ``parts``, a row for each
part of it. A part is a range of ids, sorted; ``at`` counts the ids of the part
before a document, and ``parts`` the ids before the part, so that every document and
every stretch of the stream of all ids can be found without reading others. The ids
are one list column, dictionary or delta encoded; row groups and pages are small
enough that the column and page indexes leave most of them unread.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .alignment import byte_of_char
from .blocks import ROWS
from .storage import broadcast_if_small, delete_at_end, scratch_path

#: Where the tokenizer is; a parameter of every function that reads one.
MODEL_PATH = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
#: Words whose ids a worker keeps, the longest that is kept, and the characters that are split at a time.
CACHE = 500_000
LONGEST = 64
CHUNK = 1 << 18
#: Marks that begin a new word of the tokenizer behind a letter; an apostrophe may not.
MARKS = ".,;:!?*$&"
#: Small Latin letters, which the tokenizer neither changes nor splits before its model.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "true", "parquet.enable.dictionary#ids.list.element": "false", "parquet.writer.version": "PARQUET_2_0"},
}


class Kept(dict):
    """Bytes by word. When full, the words used since it was last full are kept, and others as long as the next filling takes.

    Words that it does not know are noted in ``missing`` and read as None.
    """

    def __init__(self, most: int) -> None:
        self.most, self.old, self.missing = most, {}, []

    def __missing__(self, word: str) -> bytes | None:
        got = self.old.get(word)
        if got is None:
            self.missing.append(word)
        else:
            self[word] = got
        return got

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Ids of texts, from the ids of the words between spaces, each of which the tokenizer encodes once.

    That holds for tokenizers that read any white space as the end of a word, as the
    default one does; it takes no white space into a token and lower-cases by character.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known, self.tails = Kept(CACHE), {}
        self.spelled = {b: c for c, b in byte_of_char().items() if ord(c) != b}

    def _learn(self, words: Iterable[str]) -> None:
        """Ids of new words. Of a word of Latin letters, and marks behind it, the letters go to the model at once, for nothing about them is changed or split before."""
        odd: list[str] = []
        known, tokenize, letters = self.known, self.model.tokenize, LETTERS
        for w in words:
            core = w.rstrip(MARKS)
            if letters(core):
                raw = known.get(core) if core is not w else None
                if raw is None:
                    ids = [t.id for t in tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(self.spelled))]
                    raw = array("I", ids).tobytes()
                known[w] = raw + self._tail(w[len(core) :]) if core is not w else raw
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def _tail(self, marks: str) -> bytes:
        got = self.tails.get(marks)
        if got is None:
            ids = self.tokenizer.encode(marks, add_special_tokens=False).ids
            got = self.tails[marks] = array("I", ids).tobytes()
            if len(self.tails) > CACHE // 8:
                self.tails = {}
        return got

    def words(self, text: str) -> list[str]:
        """Words of a text, in lower case where that is one character for one; a text that may hold a special token is taken as it is written."""
        if "<" not in text:
            try:
                if not text.isascii():
                    text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def _chunk(self, texts: list[str]) -> list[bytes]:
        known = self.known
        known.turn()
        known.missing = []
        split = [self.words(t) for t in texts]
        rows = [list(map(known.__getitem__, words)) for words in split]
        new = list(dict.fromkeys(known.missing))
        if new:
            self._learn(new)
            for words, row in zip(split, rows, strict=True):
                i = -1
                for _ in range(row.count(None)):
                    i = row.index(None, i + 1)
                    row[i] = known[words[i]]
            for w in new:
                if len(w) > LONGEST:
                    del known[w]
        return [b"".join(row) for row in rows]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null and empty texts have none."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= CHUNK:
                out += self._chunk(held)
                held, size = [], 0
        return out + self._chunk(held)


@cache
def encoder_at(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def encode_sorted(docs: DataFrame, path: str = MODEL_PATH, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` to ``(part, doc_id, at, n_tokens, ids)``, dealt in ranges of ids and sorted.

    Rows of one id are ordered by their text's hash; rows equal in both are dealt by
    their place in the table, so that no part has all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = encoder_at(path), TaskContext.get().partitionId(), 0  # type: ignore[union-attr]
        end = np.array([end_id], "<u4").tobytes()
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = [r + end for r in encoder.encode(b["text"].to_pylist())]
            n = np.array([len(r) // 4 for r in rows], np.int64)
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b["doc_id"], pa.array(ends - n + at), pa.array(n), ids], ["part", "doc_id", "at", "n_tokens", "ids"])
            at += int(ends[-1]) if len(n) else 0

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h_"), F.monotonically_increasing_id().alias("r_"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h_"), F.col("r_")]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInArrow(run, f"part int, doc_id {dict(docs.dtypes)['doc_id']}, at long, n_tokens long, ids array<int>")


def write_tokens(
    docs: DataFrame, folder: str, path: str = MODEL_PATH, end_id: int = END_ID, encoding: str = "dictionary", row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES
) -> None:
    """Encode ``docs(doc_id, text)`` and write them below ``folder``, which must not exist.

    Null and empty texts have the end id alone. Null ids come first. Ids may repeat;
    extra columns are ignored; an empty table gives files without rows. ``encoding``
    is ``dictionary`` or ``delta``; ``row_group`` and ``page`` are bytes.
    """
    out = encode_sorted(docs, path, end_id).write.options(**ENCODINGS[encoding]).option("compression", "zstd")
    out.option("parquet.block.size", row_group).option("parquet.page.size", page).option("parquet.page.row.count.limit", 1000).parquet(f"{folder}/tokens")
    spark = docs.sparkSession
    parts = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # a row for each part of millions of ids
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts.withColumn("before", before).coalesce(1).write.parquet(f"{folder}/parts")


def _with_start(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/parts").select(F.col("part").alias("p_"), "before")
    return rows.join(broadcast_if_small(parts, parts.count()), F.col("part") == F.col("p_")).withColumn("start", F.col("before") + F.col("at"))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document. No ids are read."""
    return _with_start(spark, spark.read.parquet(f"{folder}/tokens").select("part", "doc_id", "at", "n_tokens"), folder).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents ``where`` holds; a bound on ``doc_id`` leaves other row groups and pages unread."""
    rows = spark.read.parquet(f"{folder}/tokens")
    return _with_start(spark, rows if where is None else rows.where(where), folder).select("doc_id", "start", "n_tokens", "ids")


def read_span(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids) of the stretch of all ids from ``start`` up to ``stop``, cut at its ends.

    The parts it touches are looked up first, then rows by their place in the part.
    """
    parts = spark.read.parquet(f"{folder}/parts").where((F.col("before") < stop) & (F.col("before") + F.col("n_tokens") > start)).agg(F.min("part"), F.max("part")).first()
    first, last = parts if parts is not None else (None, None)
    rows = spark.read.parquet(f"{folder}/tokens").where(F.col("part").between(F.lit(first), F.lit(last)))
    got = _with_start(spark, rows, folder).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    low = F.greatest(F.lit(start), F.col("start"))
    high = F.least(F.lit(stop), F.col("start") + F.col("n_tokens"))
    return got.select("doc_id", low.alias("start"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def checksums(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` to ``(doc_id, start, n_tokens, ids_crc32)``: the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["ids"]
            ends = np.asarray(lists.offsets)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).view("<u4"))).cast("B") if len(lists.values) else b""
            sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str = MODEL_PATH, **kw: object) -> DataFrame:
    """Write ``docs`` to the shared folder, read the files back, and digest each document's ids."""
    folder = scratch_path(docs.sparkSession, "tokenfile")
    delete_at_end(docs.sparkSession, folder)
    write_tokens(docs, folder, path, **kw)  # type: ignore[arg-type]
    return checksums(read_tokens(docs.sparkSession, folder))
