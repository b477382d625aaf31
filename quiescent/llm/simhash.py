"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles of equal population counts. Tile pairs
whose counts differ by more than the radius are never formed; the others are
compared whole, by numpy exclusive-or and bit counts. Each comparison gives back a
spanning forest of its links, and the forests are joined by :mod:`.components`.

A radius of a few bits leaves few tile pairs. At a similarity of 0.8 the radius is so
wide that counts of bits part almost none; there tiles are formed inside groups of
texts that share one of the shingles that all similar texts must share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import handed_back, sliced
from .components import components
from .storage import broadcast_if_small, discard, materialize

SEED = 42
#: Most fingerprints in a tile.
TILE = 4096
#: Partners of a fingerprint in a tile that are given by the end of each round; then all.
CHECKED = (8, 256)
#: Rows of a key that are compared without tiles, and pairs that are compared at once.
FEW, PAIRS = 256, 1 << 18
#: Bits of sets of fewer shingles say less, so all of them that may be links are checked against their texts.
SMALL = 64
#: One in so many texts is looked at for frequent shingles, those of so many of them, so many at most.
SHARE, SEVERAL, FREQUENT = 32, 3, 1 << 18
#: Shingles whose bits are counted at once.
BLOCK = 1 << 13


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included, A-Z lower-cased.

    Fewer words than ``width`` make one shingle of them all, no words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - width + 1
    if not words:
        return np.empty(0, np.uint64)
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes of each row ``(lane, n)`` have each bit set: ``(lane, 64)``.

    Bits are laid out so that 128 hashes fold to one in seven additions of whole
    arrays, with room for their counts in a byte.
    """
    lanes, n = h.shape
    k = -(-n // 128)
    full = np.zeros((lanes, k * 128), np.uint64)
    full[:, :n] = h
    rows = np.ascontiguousarray(full.reshape(lanes, k, 128).transpose(2, 0, 1)).view(np.uint8).reshape(128, -1)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    while len(bits) > 1:
        half = len(bits) // 2
        bits = bits[:half] + bits[half:]
    return bits.reshape(lanes, k, 64).sum(axis=1, dtype=np.int64)


def lanes_of(h: np.ndarray, lanes: int) -> np.ndarray:
    """Fingerprints of ``lanes`` independent mixes of the hashes; the first is of the hashes themselves.

    A bit is 1 if it is set in over half of them; without hashes all are 0.
    """
    step = (np.uint64(0x9E3779B97F4A7C15) * np.arange(lanes, dtype=np.uint64))[:, None]
    ones = np.zeros((lanes, 64), np.int64)
    for i in range(0, len(h), BLOCK):
        part = h[None, i : i + BLOCK]
        if lanes > 1:
            z = part + step
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            z[0] = part[0]
            part = z
        ones += bit_counts(part)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, node)``: the fingerprint of each whole text as a signed number; a null or wordless text has zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([lanes_of(shingle_hashes(t, width), 1)[0] for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(handed_back(run), "doc_id long, node long")


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that stand in many texts, sorted: those of several texts of a share of them all.

    They only order the shingles of a set, see :func:`set_prints`, so that their
    number and choice change no result. At most :data:`FREQUENT` are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for t in b["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, width)).view(np.int64))], ["shingle"])

    share = docs.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(SHARE)) == 0).select("text", F.xxhash64("text").alias("t_")).dropDuplicates(["t_"])
    count = share.select("text").mapInArrow(handed_back(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= SEVERAL)
    return np.sort(np.array([r[0] for r in count.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def set_prints(docs: DataFrame, width: int, similarity: float, lanes: int, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, t1, t2, fp, size, keys)`` of whole texts: hashes of the text, fingerprint and size of its set of shingles.

    ``keys`` are its first ``size - ceil(similarity * size) + 1`` shingles, in an
    order that is the same for all sets: two sets of the Jaccard similarity or more
    have at least ``ceil(similarity * size)`` shingles in common, so they share a
    key. Frequent shingles come last, so that few sets share a key by chance.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps, sizes, keys = [], [], []
            for t in b["text"].to_pylist():
                u = np.unique(shingle_hashes(t, width))
                fps.append(lanes_of(u, lanes))
                sizes.append(len(u))
                if len(u) and len(frequent):
                    often = frequent[np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)] == u
                    u = np.concatenate([u[~often], u[often]])
                keys.append(u[: len(u) - math.ceil(similarity * len(u) - 1e-9) + 1] if len(u) else u)
            offsets = pa.array(np.arange(0, len(fps) * lanes + 1, lanes, dtype=np.int32))
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            fp = pa.array(np.concatenate([*fps, np.empty(0, np.uint64)]).view(np.int64))
            key = pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64))
            cols = [pa.ListArray.from_arrays(offsets, fp), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, key)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["t1"], b["t2"], *cols], ["doc_id", "t1", "t2", "fp", "size", "keys"])

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    return own.mapInArrow(handed_back(run), f"doc_id {kind}, t1 long, t2 long, fp array<long>, size long, keys array<long>")


def _cell(segments: int) -> list:
    """Population counts of the first lane's ``segments`` equal parts."""
    width = 64 // segments
    mask = F.lit((1 << width) - 1 if width < 64 else -1)
    first = F.col("fp")[0]
    return [F.bit_count(F.shiftrightunsigned(first, width * i).bitwiseAND(mask)).cast("int") for i in range(segments)]


def _near_cells(segments: int, radius: int) -> list[list[int]]:
    """Count differences within the radius, in all: the half that comes after zero, and zero."""
    out = [[]]
    for _ in range(segments):
        out = [[*x, d] for x in out for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in out if x >= [0] * segments]


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class _Forest:
    """Links that join what was apart."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.root = ids, np.arange(len(ids))
        self.left: list[int] = []
        self.right: list[int] = []

    def join(self, i: int, js: np.ndarray) -> None:
        for t in np.unique(self.root[js]):
            if t != self.root[i]:
                self.left.append(int(self.ids[i]))
                self.right.append(int(self.ids[js[self.root[js] == t][0]]))
                self.root[self.root == t] = self.root[i]


def _neighbours(near: object, n_a: int, n_b: int, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of one tile with the rows of the other for which ``near(slice)`` holds, each pair once; blocks of a bounded size are compared at a time."""
    step = max(1, (1 << 20) // max(1, n_b))
    for s in range(0, n_a, step):
        got = near(slice(s, s + step))  # type: ignore[operator]
        if same:
            got &= np.arange(n_b)[None, :] > np.arange(s, s + len(got))[:, None]
        for r in got.any(axis=1).nonzero()[0]:
            yield s + int(r), got[r].nonzero()[0]


def _tile_pairs(rows: DataFrame, steps: list[list[int]], keep: list[str]) -> DataFrame:
    """``rows(cell, fp, keep...)`` packed into tiles, and the pairs of tiles whose cells are a step apart.

    A tile is ``(cell, part, fps, keep...)``, the other one's columns end in ``_a``.
    Which tiles meet is settled on their keys; then each side's rows are fetched.
    """
    size = rows.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    cells = rows.join(broadcast_if_small(size, size.count()), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = cells.groupBy("cell", "part").agg(F.collect_list(F.struct("fp", *keep)).alias("t"))
    tiles = materialize(tiles.select("cell", "part", F.flatten("t.fp").alias("fps"), *[F.col(f"t.{c}").alias(c) for c in keep]), "tiles")
    d = F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in y]) for y in steps]))
    keys = tiles.select("cell", "part", d.alias("d")).select(F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.zip_with("cell", "d", lambda x, y: x + y).alias("cell"))
    meet = keys.join(tiles.select("cell", "part"), "cell").where("cell_a <> cell or part_a <= part")
    pairs = meet.join(tiles.toDF(*[f"{c}_a" for c in tiles.columns]), ["cell_a", "part_a"]).join(tiles, ["cell", "part"])
    same = (F.col("cell") == F.col("cell_a")) & (F.col("part") == F.col("part_a"))
    return pairs.select("cell", same.alias("same"), *[f"{c}_a" for c in ("fps", *keep)], "fps", *keep)


def link_forest(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes(node)``, each fingerprint once, to ``(a, b)``: links of at most ``radius`` bits that span those of each tile pair."""
    segments = 4 if radius <= 3 else 1
    rows = nodes.select("node", F.array("node").alias("fp"))
    rows = rows.select("fp", "node", F.array(*[c.cast("long") for c in _cell(segments)]).alias("cell"))
    pairs = _tile_pairs(rows, _near_cells(segments, radius), ["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for k in range(len(batch)):
                na, nb = (batch[c][k].values.to_numpy() for c in ("node_a", "node"))
                same = batch["same"][k].as_py()
                forest = _Forest(na if same else np.concatenate([na, nb]))
                x, y = na.view(np.uint64), nb.view(np.uint64)
                for i, js in _neighbours(lambda r, x=x, y=y: np.bitwise_count(x[r, None] ^ y[None, :]) <= radius, len(x), len(y), same):
                    forest.join(i, js + (0 if same else len(na)))
                left += forest.left
                right += forest.right
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return pairs.mapInArrow(handed_back(run), "a long, b long")


def _pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of all pairs inside runs of rows of these sizes; runs are taken together up to a bounded number of pairs."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    block = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS
    for k in np.unique(block):
        runs = (block == k).nonzero()[0]
        lo, hi = first[runs[0]], first[runs[-1] + 1]
        end = np.repeat(first[runs + 1], sizes[runs])
        own = np.arange(lo, hi)
        more = end - own - 1  # rows of the run behind each one
        i = np.repeat(own, more)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
        yield i, j


def small_share(similarity: float) -> float:
    """The largest share of bits in which fingerprints of small sets of the similarity are expected to differ.

    Reckoned with for sets of ``c`` shingles in common and ``a`` and ``b`` of their
    own; larger sets come near to ``acos(2s / (1 + s)) / pi`` from above.
    """

    def over(need: int, n: int) -> float:  # more than need / 2 of n even bits are set
        return sum(math.comb(n, k) for k in range(max(0, need // 2 + 1), n + 1)) / 2.0**n if need >= 0 else 1.0

    worst = 0.0
    for c in range(1, SMALL // 2):
        for a in range(int(c / similarity - c + 1e-9) + 1):
            for b in range(a, int(c / similarity - c - a + 1e-9) + 1):
                p = 0.0
                for k in range(c + 1):
                    one, two = over(c + a - 2 * k, a), over(c + b - 2 * k, b)
                    p += math.comb(c, k) / 2.0**c * (one * (1 - two) + two * (1 - one))
                worst = max(worst, p)
    return worst


class _Judge:
    """Which pairs that share a key may be links, and which of them are given.

    Sizes must allow the similarity. Of sets of at least :data:`SMALL` shingles the
    first lanes must be within ``radius`` bits, all lanes within ``maybe``, of
    smaller ones all within ``wide``; within ``sure`` a pair of large sets is a link. A row ranks the partners that had another root at the
    start (``old``), nearest first; those ranked ``first`` to ``last`` whose ``root``
    still differs are given. A row with such partners behind ``last`` also gives
    itself with a null partner and the key.
    """

    names = ("a", "b", "sure", "key")
    schema = "a long, b long, sure boolean, key long"

    def __init__(self, similarity: float, lanes: int, first: int, last: int | None) -> None:
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        bits = 64 * lanes
        spread = math.sqrt(bits * p * (1 - p))
        self.similarity, self.lanes, self.first, self.last = similarity, lanes, first, last
        self.radius = math.ceil(64 * p + 6 * math.sqrt(64 * p * (1 - p)))
        self.sure, self.maybe = max(0, math.floor(bits * p - 5 * spread)), math.ceil(bits * p + 5 * spread)
        q = small_share(similarity)
        self.wide = math.ceil(bits * q + 6 * math.sqrt(bits * q * (1 - q)))

    def near(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.minimum(m, n) >= self.similarity * np.maximum(m, n) - 1e-9

    def few(self, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.minimum(m, n) < SMALL

    def give(self, key: np.ndarray, left: dict, right: dict, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """Of pairs of rows ``left[i]`` and ``right[j]`` whose sizes and roots were compared, those that are given."""
        few = self.few(left["size"][i], right["size"][j])
        x, y = left["fp"], right["fp"]
        ok = few | (np.bitwise_count(x[i, 0] ^ y[j, 0]) <= self.radius)
        i, j, few = i[ok], j[ok], few[ok]
        bits = _bits(x[i], y[j])
        ok = bits <= np.where(few, self.wide, self.maybe)
        i, j, few, bits = i[ok], j[ok], few[ok], bits[ok]
        order = np.lexsort((right["node"][j], bits, i))
        i, j, few, bits = i[order], j[order], few[order], bits[order]
        new = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) if len(i) else i
        open_ = left["root"][i] != right["root"][j]
        now = open_ & (rank >= self.first) & (rank < (self.last if self.last is not None else len(i)))
        behind = np.unique(i[open_ & (rank >= self.last)]) if self.last is not None else i[:0]
        n, m = int(now.sum()), len(behind)
        none = lambda k: pa.nulls(k, pa.int64())
        cols = [
            pa.array(np.concatenate([left["node"][i[now]], left["node"][behind]])), pa.concat_arrays([pa.array(right["node"][j[now]]), none(m)]),
            pa.array(np.concatenate([(bits <= self.sure)[now] & ~few[now], np.zeros(m, bool)])), pa.concat_arrays([none(n), pa.array(key[behind])]),
        ]
        return pa.RecordBatch.from_arrays(cols, list(self.names))


def _small_keys(rows: DataFrame, judge: _Judge) -> DataFrame:
    """Candidates of keys of at most :data:`FEW` rows, many keys at once; rows are sorted by key, and of one that goes on in the next batch no more are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g = {c: t[c].to_numpy() for c in ("key", "node", "size", "old", "root")}
            g["fp"] = t["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, judge.lanes)
            at = np.concatenate([[0], (g["key"][1:] != g["key"][:-1]).nonzero()[0] + 1, [t.num_rows]])
            for i, j in _pairs_of(np.diff(at)):
                ok = judge.near(g["size"][i], g["size"][j]) & (g["old"][i] != g["old"][j])
                yield judge.give(g["key"], g, g, i[ok], j[ok])

        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            held = t.slice(cut)
            if cut:
                yield from compare(t.slice(0, cut))
        if held is not None:
            yield from compare(held)

    cols = rows.select("key", "node", "size", "old", "root", "fp")
    return cols.repartition("key").sortWithinPartitions("key").mapInArrow(handed_back(run), judge.schema)


def _large_keys(rows: DataFrame, judge: _Judge) -> DataFrame:
    """Candidates of keys of more rows, by pairs of tiles."""
    # counts of bits in steps of more than the radius: tiles two or more steps apart never meet. Small sets are compared whatever their bits
    counts = F.floor(F.bit_count(F.col("fp")[0]) / (judge.radius + 1)).cast("long")
    large = F.when(F.col("size") >= SMALL, F.array("key", counts))
    small = F.when(F.col("size") * judge.similarity < SMALL, F.array(F.col("key"), F.lit(-9).cast("long")))
    cells = rows.withColumn("cell", F.explode(F.filter(F.array(large, small), lambda x: x.isNotNull()))).drop("key")
    pairs = _tile_pairs(cells, [[0, 0], [0, 1]], ["node", "size", "old", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                g = {c: batch[c][k].values.to_numpy() for c in batch.schema.names if c != "same"}
                left, right = ({c: g[c + e] for c in ("node", "size", "old", "root")} | {"fp": g["fps" + e].view(np.uint64).reshape(-1, judge.lanes)} for e in ("_a", ""))
                key, only_few = np.full(len(left["node"]), g["cell"][0]), g["cell"][1] < 0
                step, after = max(1, PAIRS // max(1, len(right["node"]))), batch["same"][k].as_py()
                for s in range(0, len(key), step):
                    r = slice(s, s + step)
                    m, n = left["size"][r, None], right["size"][None, :]
                    got = judge.near(m, n) & (left["old"][r, None] != right["old"][None, :]) & (judge.few(m, n) == only_few)
                    if after:
                        got &= np.arange(len(right["node"]))[None, :] > np.arange(s, s + len(got))[:, None]
                    i, j = got.nonzero()
                    yield judge.give(key, left, right, i + s, j)

    return pairs.mapInArrow(handed_back(run), judge.schema)


def _verified(doubt: DataFrame, prints: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links ``(a, b)`` whose texts' shingle sets have the Jaccard similarity asked for."""
    ids = materialize(doubt.select(F.col("a").alias("node")).union(doubt.select("b")).distinct(), "doubted")
    n = ids.count()
    rep = materialize(prints.select("node", "t1", "t2").join(broadcast_if_small(ids, n), "node", "left_semi").groupBy("node").agg(F.min(F.struct("t1", "t2")).alias("t")).select("node", "t.t1", "t.t2"), "doubted")
    text = docs.select("text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).join(broadcast_if_small(rep, n), ["t1", "t2"])
    text = materialize(text.select("node", "text").groupBy("node").agg(F.first("text").alias("text")), "doubted-texts")
    pairs = doubt.join(text.toDF("a", "ta"), "a").join(text.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok = []
            for x, y in zip(b["ta"].to_pylist(), b["tb"].to_pylist(), strict=True):
                u, v = np.unique(shingle_hashes(x, width)), np.unique(shingle_hashes(y, width))
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(both >= similarity * (len(u) + len(v) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = materialize(pairs.select("a", "b", "ta", "tb").mapInArrow(handed_back(run), "a long, b long"), "links")
    for x in (ids, rep, text):
        discard(x)
    return out


def _roots(links: DataFrame) -> DataFrame:
    """Components of links; a bound on their number decides whether they are broadcast."""
    c = components(links).withColumnRenamed("component", "c_")
    return broadcast_if_small(c, c.count())


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component of each node in ``root``."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("c_", "node")).drop("c_")


def _open_keys(rows: DataFrame) -> DataFrame:
    """``rows`` with ``many``, of keys whose nodes have more than one root: whether such a key has more than :data:`FEW` rows."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), (F.count("*") > FEW).alias("many")).where("lo <> hi").select("key", "many")
    mixed = materialize(mixed, "keys")
    return rows.join(broadcast_if_small(mixed, mixed.count()), "key")


def near_links(docs: DataFrame, width: int, similarity: float, lanes: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, t1, t2, node, ...)`` of each row, and links ``(a, b)`` of nodes that span all of the similarity or more.

    A node is the 64-bit hash of a fingerprint of ``64 * lanes`` bits; texts of equal
    fingerprints, wordless ones among them, are copies. Pairs that share a key of
    :func:`set_prints`, which all links do, are compared: first by the first key of
    each set alone, which joins most groups, then by all keys whose sets are not
    joined yet.

    At the similarity ``s`` fingerprints differ in a share ``p = acos(2s / (1 + s)) / pi``
    of their bits. Pairs of sets of :data:`SMALL` shingles or more five deviations
    below that are links, those five above are none (one in three million at ``s``
    itself is lost by that); all others, and smaller sets up to six deviations above
    what is expected of them, are checked against the texts, nearest first and in
    growing numbers, until their ends are joined or all have been checked: in a large
    group most need no check, and none is left out.
    """
    prints = set_prints(docs, width, similarity, lanes, frequent_shingles(docs, width))
    prints = materialize(prints.withColumn("node", F.xxhash64("fp")), "prints")
    links = prints.sparkSession.createDataFrame([], "a long, b long")
    tested, roots = links, _roots(links)
    for keys, steps in ((F.slice("keys", 1, 1), CHECKED[:1]), (F.col("keys"), (*CHECKED, None))):
        rows = prints.select("node", F.explode(keys).alias("key")).distinct()
        rows = materialize(_open_keys(_rooted(rows, roots)).select("key", "node", "many"), "open")
        nodes = materialize(rows.select("node").distinct(), "nodes")
        info = prints.select("node", "fp", "size").join(broadcast_if_small(nodes, nodes.count()), "node", "left_semi").dropDuplicates(["node"])
        state = materialize(_rooted(rows.join(info, "node"), roots).withColumn("old", F.col("root")), "open")
        discard(rows)
        discard(nodes)
        first = 0
        for last in steps:
            judge = _Judge(similarity, lanes, first, last)
            many = state.where("many")
            got = _small_keys(state.where("not many"), judge)
            got = materialize(got if many.isEmpty() else got.union(_large_keys(many, judge)), "doubt")
            pairs = got.where("b is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure"))
            doubt = materialize(pairs.where("not sure").select("a", "b").join(tested, ["a", "b"], "left_anti"), "doubt")
            new = pairs.where("sure").select("a", "b")
            if not doubt.isEmpty():
                tested = tested.union(doubt)
                new = new.union(_verified(doubt, prints, docs, width, similarity))
            links = materialize(links.union(new), "links")
            more = got.where("b is null").select("key").distinct()
            roots = _roots(links)
            if last is None or more.isEmpty():
                break
            # keys under which some row has partners left
            state = materialize(_rooted(state.drop("root").join(more, "key", "left_semi"), roots), "open")
            first = last
    return prints, links


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, lanes: int = 8) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, component_id)``: documents that reach each other by links of the similarity or more.

    The similarity is the Jaccard one of the sets of ``width``-word shingles, see
    :func:`near_links`. Null ids and repeated rows as in :func:`simhash_components`.
    """
    prints, links = near_links(docs, width, similarity, lanes)
    return _named(prints.select(F.col("doc_id").cast("long").alias("doc_id"), "node"), links).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all its columns.

    Of rows that share that id the one with the smallest hash of its text stays, of
    rows equal in id and text one of them; null ids come after all others. Texts
    without words, null ones among them, are copies of one another. Columns of any name
    stay as they are.
    """
    prints, links = near_links(docs, width, similarity, 8)
    rows = prints.groupBy("doc_id", "t1", "t2", "node").agg(F.count("*").alias("n"))
    rows = materialize(_rooted(rows, _roots(links)).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "n").alias("place")), "rows")
    first = materialize(rows.groupBy("root").agg(F.min("place").alias("f")), "kept")
    key = lambda c: [F.col(f"{c}.doc_id").alias("id_"), F.col(f"{c}.t1").alias("p1_"), F.col(f"{c}.t2").alias("p2_")]
    d = docs.alias("d")
    # sides are named, so that columns of these names in documents are no trouble
    here = F.col("d.doc_id").eqNullSafe(F.col("g.id_")) & (F.xxhash64("d.text") == F.col("g.p1_")) & (F.xxhash64(F.lit(1), "d.text") == F.col("g.p2_"))
    more = first.where("f.n > 1").select(*key("f"))
    n_more, n_first, n_rows = more.count(), first.count(), rows.count()
    # rows that stay are looked up, or those that go, whichever are fewer
    if n_rows - n_first < n_first:
        gone = rows.join(first, "root").where("place <> f").select(*key("place")).union(more)
        out = d.join(broadcast_if_small(gone, n_rows - n_first + n_more).alias("g"), here, "left_anti")
    else:
        out = d.join(broadcast_if_small(first.where("f.n = 1").select(*key("f")), n_first - n_more).alias("g"), here, "left_semi")
    if not n_more:
        return out
    again = d.join(broadcast_if_small(more, n_more).alias("g"), here)
    again = again.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row_"), "g.id_", "g.p1_", "g.p2_").dropDuplicates(["id_", "p1_", "p2_"])
    return out.unionByName(again.select("row_.*"))


def _named(prints: DataFrame, links: DataFrame) -> DataFrame:
    """``prints(doc_id, node)`` with ``component_id``, the smallest doc_id of the nodes that links join; null where none has one."""
    low = _rooted(prints.groupBy("node").agg(F.min("doc_id").alias("low")), _roots(links))
    low = materialize(low.select("node", "root", "low"), "nodes")
    name = low.groupBy("root").agg(F.min("low").alias("component_id"))
    of = low.join(name, "root").select("node", "component_id")
    return prints.join(of, "node")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fingerprint, component_id)``, a row for each row.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest doc_id reachable. Rows that repeat an id are told apart by their
    fingerprints, ids may be any number. Null, empty and wordless texts have
    fingerprint zero and link like any other. Rows with a null doc_id are linked but
    name no component; a component of such rows alone has a null id. Extra columns
    are ignored, an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    nodes = materialize(prints.select("node").distinct(), "nodes")
    out = _named(prints, materialize(link_forest(nodes, radius), "links"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")
