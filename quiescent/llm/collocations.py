"""Phrase collocations from suffix arrays of word ids.

Words are counted first. A word that is rarer than a phrase must be ends the phrases
around it like a punctuation mark does, which changes no candidate and no count of
one. Each shard then sorts its suffixes by their first words with prefix doubling;
neighbours that share their first ``n`` words are one interval, and its length is how
often that phrase of ``n`` words occurs in the shard. A task sums the counts of its shards and sends
them packed, sorted by phrase, to the parts that sum them all, those of three words only where both pairs in it may be frequent. Words have ids of their own in every language, so phrases of different
languages never meet.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import block_ids, block_rows, give_back
from .storage import broadcast_if_small, discard, materialize

LEAST = 10
TOP = 2000
#: Of a phrase's occurrences, the hundredths inside one longer candidate from which on it is dropped.
INSIDE = 50
NO_LANG = "und"
#: Bytes that end a piece, and those that end a word.
ENDS = b".,;:!?\n\v\f\r"
BLANKS = b" \t"
#: Every end of a piece becomes the first of them, blanks a space, and A-Z a-z.
TABLE = bytes(ENDS[0] if b in ENDS else 0x20 if b in BLANKS else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
MARK = ENDS[:1]
#: Characters of text in a shard.
SHARD = 5 << 20
#: Phrases that a task sums before it sends them, and words of the corpus to a part of the sums.
HELD, PART = 1 << 21, 1 << 21
#: Bits of the bitmap of frequent pairs, 8 MB whatever the input. More pairs than that make it let more phrases through, and lose none.
BITS = 1 << 26


def word_blocks(docs: DataFrame) -> DataFrame:
    """``docs(text, lang)`` to a row for each language of each block: its distinct words, how often each stands, and
    the words in order as places among them from 1 on, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = block_ids()
        for texts, langs in block_rows(batches, ["text", "lang"], SHARD):
            known: dict[str, defaultdict] = {}
            order: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(texts, langs, strict=True):
                if not text:
                    continue
                lang = NO_LANG if lang is None else lang
                if lang not in known:
                    known[lang] = defaultdict()
                    known[lang].default_factory = known[lang].__len__
                    known[lang][MARK]  # noqa: B018  the mark is 0
                    order[lang] = []
                words = text.encode().translate(TABLE).replace(MARK, b" . ").split(b" ")
                ids = list(map(known[lang].__getitem__, filter(None, words)))
                ids.append(0)
                order[lang].append(np.array(ids, np.int32))
            for lang, words in known.items():
                seq = np.concatenate(order[lang])
                n = np.bincount(seq, minlength=len(words))[1:]
                cols = [pa.array([next(ids_of)], pa.int64()), pa.array([lang]), pa.array([[w.decode() for w in words][1:]], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64())), pa.array([seq], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "lang", "words", "n", "seq"])

    return docs.select("text", "lang").mapInArrow(run, "block long, lang string, words array<string>, n array<long>, seq array<int>")


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``seq`` (ids from 0 on) in the order of their next ``depth`` ids or more, by prefix doubling."""
    rank = seq.astype(np.int32)
    order = np.argsort(rank, kind="stable").astype(np.int32) if depth <= 1 else np.zeros(0, np.int32)
    h = 1
    while h < depth:
        key = rank.astype(np.int64)
        key *= int(rank.max(initial=0)) + 2
        key[:-h] += rank[h:]
        key[:-h] += 1
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        rank[order[:1]] = 0
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
        h *= 2
    return order


def common_prefixes(seq: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order, up to ``depth``: how many ids each has before the first 0, and how many of those it shares with the one before."""
    padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
    length, shared = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)
    open_, same = np.ones(len(order), bool), np.ones(len(order), bool)
    for k in range(depth):
        word = padded[order + k]
        open_ &= word != 0
        same[1:] &= word[1:] == word[:-1]
        length += open_
        shared[1:] += (open_ & same)[1:]
    return length, shared


def phrase_counts(seq: np.ndarray, depth: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 2 to ``depth`` words: the places where each distinct phrase of ``seq`` first stands in suffix order, and how often it occurs.

    A phrase has no 0. Its suffixes are the interval of the suffix array between two
    places where the common prefix is shorter than the phrase.
    """
    order = suffix_array(seq, depth)
    length, shared = common_prefixes(seq, order, depth)
    out = []
    for n in range(2, depth + 1):
        inside = np.flatnonzero(length >= n)
        first = shared[inside] < n
        starts = np.flatnonzero(first)
        out.append((order[inside[starts]], np.diff(np.append(starts, len(inside)))))
    return out


def numbered(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``(seq)`` of each block in ids of frequent words from 1 on, 0 between phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                seq, got = np.asarray(b["seq"][r].values), b["found"][r].values
                to = np.zeros(int(seq.max(initial=0)) + 1, np.int32)
                to[np.asarray(got.field("pos")) + 1] = np.asarray(got.field("id")) + 1
                seq = to[seq]
                seq = seq[(seq != 0) | (np.diff(seq, prepend=1) != 0)]  # one end is as good as several
                yield pa.RecordBatch.from_arrays([pa.array([seq], pa.list_(pa.int32()))], ["seq"])

    return blocks.select("block", "seq").join(found, "block").mapInArrow(run, "seq array<int>")


def bit_of(k: np.ndarray) -> np.ndarray:
    """Place of a pair of ids in a bitmap of :data:`BITS` bits; :func:`bitmap_of` has the same rule."""
    return ((k >> 32) * 1_000_003 + (k & 0xFFFFFFFF) * 8_191) & (BITS - 1)


def bitmap_of(pairs: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bits of all ``pairs(k)`` set, so that pairs without their bit are not among them."""
    k = F.col("k")
    place = ((F.shiftright(k, 32) * 1_000_003) + k.bitwiseAND(F.lit((1 << 32) - 1)) * 8_191).bitwiseAND(F.lit(BITS - 1))
    words = pairs.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("b"))
    out = np.zeros(BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most BITS / 64 rows
        out[np.asarray(batch["w"])] = np.asarray(batch["b"])
    return out.view(np.uint8)


def packed(k: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Phrases sorted by ``k`` and their counts in few bytes: steps of ``k`` by planes of bytes, most of which are zeros."""
    planes = [np.diff(k, prepend=0).view(np.uint8).reshape(-1, 8), w.astype(np.int32).view(np.uint8).reshape(-1, 4), n.astype(np.int64).view(np.uint8).reshape(-1, 8)]
    return pa.compress(b"".join(p.T.tobytes() for p in planes), codec="zstd", asbytes=True)


def unpacked(body: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(body, 20 * rows, codec="zstd", asbytes=True), np.uint8).reshape(20, rows)
    plane = lambda i, j, kind: np.ascontiguousarray(raw[i:j].T).view(kind)[:, 0]
    return np.cumsum(plane(0, 8, np.int64)), plane(8, 12, np.int32), plane(12, 20, np.int64)


def summed(k: np.ndarray, w: np.ndarray, n: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Each phrase once, sorted (by ``first`` before all, where given), with the sum of its counts."""
    order = np.lexsort((w, k) if first is None else (w, k, first))
    k, w, n = k[order], w[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])[: len(k)])
    return k[at], w[at], np.add.reduceat(n, at) if len(at) else n


def part_of(k: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    h = (k.view(np.uint64) ^ (w.astype(np.uint64) << np.uint64(20))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def count_phrases(seqs: DataFrame, n: int, parts: int, least: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(k, w, a): the phrases of ``n`` words, two (``k`` is both ids, ``w`` -1) or three (``w`` is the third), that occur ``least`` times or more.

    With the bitmap of frequent pairs, phrases of three words with a pair outside it are left out: none of them is frequent.
    """
    spark = seqs.sparkSession
    sent = None if pairs is None else spark.sparkContext.broadcast(pairs)

    def shard(seq: np.ndarray) -> tuple[np.ndarray, ...]:
        # a shard's own ids, in the order of the words' ids
        back, seq = np.unique(seq, return_inverse=True)
        if len(back) and back[0] != 0:
            back, seq = np.concatenate([[0], back]), seq + 1
        back = back.astype(np.int64) - 1
        p, c = phrase_counts(seq.astype(np.int32), n)[n - 2]
        k = (back[seq[p]] << 32) | back[seq[p + 1]]
        if n == 2:
            return k, np.full(len(p), -1, np.int32), c
        third = back[seq[p + 2]]
        if sent is not None:
            bits = sent.value
            ok = np.ones(len(p), bool)
            for pair in (k, (k << 32) | third):
                place = bit_of(pair)
                ok &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0
            k, third, c = k[ok], third[ok], c[ok]
        return k, third.astype(np.int32), c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def give() -> Iterator[pa.RecordBatch]:
            k, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            k, w, c = summed(k, w, c, part_of(k, w, parts))
            part = part_of(k, w, parts)
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
            ends = [*at[1:], len(part)]
            bodies = [packed(k[i:j], w[i:j], c[i:j]) for i, j in zip(at, ends, strict=True)] if len(part) else []
            rows = np.diff([*at, len(part)]) if len(part) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(rows, pa.int64()), pa.array(bodies, pa.binary())], ["part", "rows", "body"])

        for b in batches:
            for r in range(b.num_rows):
                held.append(shard(np.asarray(b["seq"][r].values)))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from give()
        if held:
            yield from give()
        give_back()

    def total(group: pa.Table) -> pa.Table:
        got = [unpacked(body, rows) for body, rows in zip(group["body"].to_pylist(), group["rows"].to_pylist(), strict=True)]
        k, w, a = summed(*(np.concatenate(x) for x in zip(*got, strict=True)))
        ok = a >= least
        return pa.table({"k": k[ok], "w": w[ok], "a": a[ok]})

    return seqs.mapInArrow(run, "part int, rows long, body binary").groupBy("part").applyInArrow(total, "k long, w int, a long")


def frequent_words(words: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``words(block, pos, lang, word, n)`` to ``(id, lang, word, f)`` of those that stand ``least`` times or more, with small
    distinct ids, and for each block ``found``, its ``(pos, id)``. Words are dealt once, with the places that they stand at."""
    f = words.groupBy("lang", "word").agg(F.sum("n").alias("f"), F.collect_list(F.struct("block", "pos")).alias("at"))
    f = materialize(f.where(F.col("f") >= least), "words")
    # the row's place in its part and the part, interleaved
    row = F.monotonically_increasing_id()
    parts = f.rdd.getNumPartitions()
    out = materialize(f.select((row.bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright(row, 33)).alias("id"), "lang", "word", "f", "at"), "frequent")
    discard(f)
    top = out.agg(F.max("id")).first()[0]  # type: ignore[index]
    if top is not None and top >= 1 << 31:
        raise ValueError("more frequent words than 31 bits can number")
    places = out.select("id", F.explode("at").alias("at")).select("at.block", "at.pos", "id")
    return out.drop("at"), places.groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("found"))


def exact_score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits: exact for counts of up to 15 digits. It is at most 1000000."""
    d = "cast({} as decimal(15, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * ({d.format(a)} * {d.format(a)})) div ({d.format(left)} * {d.format(right)}) as long)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``docs(text, lang)`` to ``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two or three words.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the cut with the
    lowest score, ``n`` all words of the language. Null texts are empty, a null language
    is ``und`` and one with texts of that name. Repeated rows count as often as they
    stand; extra columns are ignored; an empty table gives an empty one.
    """
    blocks = materialize(word_blocks(docs), "words")
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "p")).select("block", "lang", "pos", F.col("p.words").alias("word"), F.col("p.n").alias("n"))
    sizes = materialize(blocks.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_")), "sizes")
    words, found = frequent_words(each, least)
    n_words = words.count()
    seqs = materialize(numbered(blocks, found), "numbered")
    discard(blocks)
    length = seqs.agg(F.sum(F.size("seq").cast("long"))).first()[0] or 0  # type: ignore[index]
    parts = 1 + length // PART
    two = materialize(count_phrases(seqs, 2, parts, least), "phrases").select("k", "a")
    three = materialize(count_phrases(seqs, 3, parts, least, bitmap_of(two)), "phrases")
    discard(seqs)

    second = F.col("k").bitwiseAND(F.lit((1 << 32) - 1))
    three = three.select("k", "w", "a", F.shiftright("k", 32).alias("w1"), second.alias("w2"))
    three = three.withColumn("k2", F.shiftleft("w2", 32).bitwiseOR(F.col("w").cast("long")))
    f = words.select("id", "f")

    def word(rows: DataFrame, at: str, name: str) -> DataFrame:
        return rows.join(broadcast_if_small(f.toDF("id_", name), n_words), F.col(at) == F.col("id_")).drop("id_")

    def pair(rows: DataFrame, at: str, name: str) -> DataFrame:
        return rows.join(two.toDF("k_", name), F.col(at) == F.col("k_")).drop("k_")

    three = word(word(pair(pair(three, "k", "ab"), "k2", "bc"), "w1", "fa"), "w", "fc")
    three = three.withColumns({"s1": exact_score("a", "fa", "bc"), "s2": exact_score("a", "ab", "fc")})
    three = materialize(three, "three")
    longer = three.select("k", "a").unionAll(three.select("k2", "a")).groupBy("k").agg(F.max("a").alias("longer"))
    kept = two.select("k", "a", F.shiftright("k", 32).alias("w1"), second.alias("w2")).join(longer, "k", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    kept = word(word(kept, "w1", "l"), "w2", "r").withColumn("score", exact_score("a", "l", "r"))
    first = F.col("s1") <= F.col("s2")
    of_three = three.select("w1", "w2", F.col("w").cast("long").alias("w3"), "a", F.when(first, F.col("fa")).otherwise(F.col("ab")).alias("l"), F.when(first, F.col("bc")).otherwise(F.col("fc")).alias("r"), F.least("s1", "s2").alias("score"))
    all_ = kept.select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", "score").unionByName(of_three)

    def named(rows: DataFrame, at: str, name: str) -> DataFrame:
        cols = words.select(F.col("id").alias("id_"), F.col("word").alias(name), *([F.col("lang")] if name == "p1" else []))
        return rows.join(broadcast_if_small(cols, n_words), F.col(at) == F.col("id_"), "left").drop("id_")

    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ranked = named(all_, "w1", "p1").withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank")  # with all ties of the last
    ranked = named(named(ranked, "w2", "p2"), "w3", "p3").withColumn("phrase", F.concat_ws(" ", "p1", "p2", "p3"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes.withColumnRenamed("lang", "lang_")), F.col("lang") == F.col("lang_")).select("lang", "rank", "phrase", "a", "l", "r", F.col("n_").alias("n"), "score")
