"""Nearest neighbours, exact and by one or two layers of locality-sensitive hashing."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.distance import DISTANCES, dot
from ..storage import broadcast_counted, checkpointed


class HashFamily(Protocol):
    """Makes the key of one table from a vector column."""

    def keys(self, vec: Column, m: int, tables: int, seed: int) -> list[Column]: ...


@dataclass(frozen=True)
class AxisHash:
    """Bits ``x[i] >= t`` with coordinates and thresholds drawn from the given ranges; for L1."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def parameters(self, m: int, tables: int, seed: int) -> list[list[tuple[int, float]]]:
        rng = np.random.default_rng(seed)
        out = []
        for _ in range(tables):
            at = rng.integers(0, len(self.low), m)
            out.append([(int(i), float(round(self.low[i] + u * (self.high[i] - self.low[i]), 6))) for i, u in zip(at, rng.random(m), strict=True)])
        return out

    def keys(self, vec: Column, m: int, tables: int, seed: int) -> list[Column]:
        return [F.concat(*[F.when(F.element_at(vec, i + 1) >= t, F.lit("1")).otherwise(F.lit("0")) for i, t in bits]) for bits in self.parameters(m, tables, seed)]


@dataclass(frozen=True)
class SignHash:
    """Bits ``<x, r> >= 0`` for normal r; for cosine distances."""

    dim: int

    def parameters(self, m: int, tables: int, seed: int) -> list[list[list[float]]]:
        rng = np.random.default_rng(seed)
        return [[[round(float(x), 6) for x in rng.standard_normal(self.dim)] for _ in range(m)] for _ in range(tables)]

    def keys(self, vec: Column, m: int, tables: int, seed: int) -> list[Column]:
        return [F.concat(*[F.when(dot(vec, F.lit(r)) >= 0, F.lit("1")).otherwise(F.lit("0")) for r in bits]) for bits in self.parameters(m, tables, seed)]


def probed(key: Column, m: int, probes: int) -> Column:
    """A key of ``m`` bits and, with one probe, those that differ from it in one bit: an array."""
    if probes not in (0, 1):
        raise ValueError("probes: 0 or 1")
    one = F.array(key)
    if not probes:
        return one
    flip = lambda i: F.concat(F.substring(key, 1, i - 1), F.when(F.substring(key, i, 1) == "1", "0").otherwise("1"), F.substring(key, i + 1, m))
    return F.concat(one, F.array(*[flip(i) for i in range(1, m + 1)]))


def buckets(points: DataFrame, family: HashFamily, m: int, tables: int, seed: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``(tbl, key, id, vec)``: each point once in each table."""
    keys = F.array(*family.keys(F.col(vec), m, tables, seed))
    return points.select(F.col(id_col), F.col(vec), F.posexplode(keys).alias("tbl", "key"))


def heavy_buckets(b: DataFrame, n: int, alpha: float) -> DataFrame:
    """``(tbl, key, n)`` of buckets that hold at least ``alpha * n`` points."""
    return b.groupBy("tbl", "key").agg(F.count("*").alias("n")).where(F.col("n") >= alpha * n)


def top_k(cand: DataFrame, k: int, query: str = "qid", dist: str = "dist", id_col: str = "id") -> DataFrame:
    """The k nearest candidates of each query, ties to the smaller id, nulls last; ranks from 1."""
    r = F.row_number().over(W.partitionBy(query).orderBy(F.col(dist).asc_nulls_last(), id_col))
    return cand.withColumn("rank", r).where(F.col("rank") <= k)


#: Points and queries that a task compares at once, and the rows of a matrix inside it.
POINTS, ASKED, MATRIX = 16_384, 4_096, 256


def _spread(points: DataFrame, queries: DataFrame, on: list[str], slices: int = 1) -> tuple[DataFrame, DataFrame]:
    """Points and queries of each key dealt to parts and blocks of bounded size, every part to every block of the key."""
    n = points.groupBy(*on).agg(F.ceil(F.count("*") / POINTS).cast("int").alias("np_"))
    m = queries.groupBy(*on).agg(F.greatest(F.ceil(F.count("*") / ASKED), F.lit(slices)).cast("int").alias("nq_"))
    size = checkpointed(n.join(m, on) if on else n.crossJoin(m), "sizes")
    rows = size.count()
    dealt = []
    for d, c, own, other, salt in ((points, "id", "p_", "b_", 1), (queries, "qid", "b_", "p_", 2)):
        mine, their = ("np_", "nq_") if own == "p_" else ("nq_", "np_")
        d = d.join(broadcast_counted(size, rows), on) if on else d.crossJoin(F.broadcast(size))
        part = F.pmod(F.xxhash64(c, F.lit(salt)), F.greatest(F.col(mine), F.lit(1))).cast("int")
        d = d.withColumn(own, part).withColumn(other, F.explode(F.when(F.col(their) > 0, F.sequence(F.lit(0), F.col(their) - 1))))
        dealt.append(d.drop("np_", "nq_"))
    return dealt[0], dealt[1]


def _matrix(vecs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and their lengths: -1 where a vector or one of its numbers is null."""
    v = vecs.combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, parent = v.flatten(), pc.list_parent_indices(v).to_numpy(zero_copy_only=False)
    m = np.zeros((len(v), max(0, int(size.max(initial=0)))))
    m[np.arange(m.shape[1]) < size[:, None]] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    size[parent[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return m, size


def _search(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], k: int, metric: str) -> tuple[np.ndarray, ...]:
    """Rows of ``y`` and ``x``, distances and whether these are null, of the ``k`` nearest rows of ``x`` to each of ``y``; both are vectors, lengths and ids as numbers."""
    (xv, nx, ic), (yv, ny, qc) = x, y
    at: list[tuple[np.ndarray, ...]] = []
    for q0 in range(0, len(yv), MATRIX):
        rows = slice(q0, q0 + MATRIX)
        best: list[tuple[np.ndarray, ...]] = []
        for p0 in range(0, len(xv), MATRIX):
            cols = slice(p0, p0 + MATRIX)
            d = K.tile_distances(yv[rows], xv[cols], metric)
            void = (ny[rows, None] != nx[None, cols]) | (ny[rows, None] < 0)
            if metric == "cosine":
                void |= K.lengths_product(yv[rows], xv[cols]) == 0
            own = qc[rows, None] == ic[None, cols]
            d[void | own] = np.nan
            i, j = K.smallest(d, k, void + 2 * own)
            ok = ~own[i, j]
            best.append((i[ok] + q0, j[ok] + p0, d[i, j][ok], void[i, j][ok]))
        if best:
            at.append(_first(*(np.concatenate(b) for b in zip(*best, strict=True)), k))
    if not at:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(b) for b in zip(*at, strict=True))


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, void: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each ``i`` by distance and ``j``; NaN goes after all numbers, null after NaN."""
    order = np.lexsort((j, d, void, i))
    i, j, d, void = i[order], j[order], d[order], void[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first], void[first]


def _bits(keys: pa.ChunkedArray) -> np.ndarray | None:
    """Arrays of keys as numbers, a row for each table; nothing where they are null."""
    flat = pc.list_flatten(keys)
    return flat.to_pandas().map(lambda x: int(x or "0", 2)).to_numpy(np.int64).reshape(len(keys), -1).T if len(flat) else None


def nearest_in_groups(points: DataFrame, queries: DataFrame, on: list[str], k: int, metric: str, slices: int = 1, probes: int = 0) -> DataFrame:
    """``(qid, id, dist)``: of each query ``queries(on, qid, qvec)`` the ``k`` nearest of the points ``points(on, id, vec)`` with the same key, in each part of the key's points.

    A key's points and queries meet as matrices of bounded size, spread over all
    tasks, and pairs leave a task only where they may be among the nearest. A point
    is not its query's neighbour where the ids are equal. Without numbers in every
    place of both vectors, or with other lengths, a distance is null, and comes last.
    Where both sides have ``in_``, arrays of keys that are not null, only those meet that
    share one of them at its place, or with one probe nearly.
    """
    if metric not in DISTANCES:
        raise ValueError(metric)
    kinds = {**dict(points.dtypes), **dict(queries.dtypes)}
    inner = ["in_"] if "in_" in points.columns else []
    p = points.where("id is not null").select(*on, "id", F.col("vec").cast("array<double>").alias("vec"), *inner)
    q = queries.where("qid is not null").select(*on, "qid", F.col("qvec").cast("array<double>").alias("qvec"), *inner)
    p, q = _spread(p, q, on, slices)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left["id"]))  # ties to the smaller id
        codes = {x: c for c, x in enumerate(dict.fromkeys(left["id"].to_pylist()))}
        ic, qc = (np.array([codes.get(v, -1) for v in t.to_pylist()], np.int64) for t in (left["id"], right["qid"]))
        (xv, nx), (yv, ny) = _matrix(left["vec"]), _matrix(right["qvec"])
        wide = max(xv.shape[1], yv.shape[1])
        x, y = ((np.pad(m, ((0, 0), (0, wide - m.shape[1]))), n, c) for m, n, c in ((xv, nx, ic), (yv, ny, qc)))
        bx, by = (_bits(left["in_"]), _bits(right["in_"])) if inner else (None, None)
        if bx is None or by is None:
            i, j, d, void = _search(x, y, k, metric)
        else:
            found = []
            for kx, ky in zip(bx, by, strict=True):
                for key in np.unique(kx):
                    off = ky ^ key
                    cols, rows = (kx == key).nonzero()[0], ((off == 0) | (probes > 0) & (off & (off - 1) == 0)).nonzero()[0]
                    if len(rows):
                        i, j, d, void = _search(tuple(a[cols] for a in x), tuple(a[rows] for a in y), k, metric)
                        found.append((rows[i], cols[j], d, void))
            i, j, d, void = (np.concatenate(b) for b in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            # found in several tables
            once = np.unique(i * max(1, len(x[0])) + j, return_index=True)[1]
            i, j, d, void = _first(i[once], j[once], d[once], void[once], k)
        return pa.Table.from_arrays([right["qid"].take(pa.array(i)), left["id"].take(pa.array(j)), pa.array(d, mask=void)], ["qid", "id", "dist"])

    by = [*on, "p_", "b_"]
    return p.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, dist double")


def exact_knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "l1", slices: int = 1, n_queries: int | None = None) -> DataFrame:
    """``points(id, vec)`` against a stated query set ``queries(qid, qvec)``: ``(qid, rank, id, dist)``.

    Every point meets every query: the work is the product of their numbers, a
    task's share of it is bounded. ``slices`` is the least number of blocks of
    queries; they are counted, so ``n_queries`` is no longer needed.
    """
    return top_k(nearest_in_groups(points, queries, [], k, metric, slices), k).select("qid", "rank", "id", "dist")


def nearest_of(pairs: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Exact distances of distinct candidate pairs."""
    c = pairs.select("qid", "id").distinct().where("qid <> id")
    j = c.join(points.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return top_k(j.select("qid", "id", DISTANCES[metric](F.col("vec"), F.col("qvec")).alias("dist")), k).select("qid", "rank", "id", "dist")


def lsh_candidates(points: DataFrame, queries: DataFrame, family: HashFamily, m: int, tables: int, seed: int, probes: int = 0) -> DataFrame:
    """``(qid, id, tbl)`` of points and queries that share a key; with a probe also those of queries whose key differs in one bit."""
    b = buckets(points, family, m, tables, seed).select("tbl", "key", "id")
    q = buckets(queries.select(F.col("qid"), F.col("qvec")), family, m, tables, seed, "qid", "qvec").select("tbl", F.explode(probed(F.col("key"), m, probes)).alias("key"), "qid")
    return q.join(b, ["tbl", "key"]).select("qid", "id", "tbl")


def nearest_found(found: DataFrame, k: int) -> DataFrame:
    """``(qid, rank, id, dist)``: the ``k`` nearest of what buckets have found, some in several."""
    return top_k(found.distinct(), k).select("qid", "rank", "id", "dist")


def lsh_knn(points: DataFrame, queries: DataFrame, family: HashFamily, m: int, tables: int, k: int, metric: str = "l1", seed: int = 7, probes: int = 0) -> DataFrame:
    """The ``k`` nearest of the points that share a key with a query. Each bucket is searched by itself, so no candidate pair leaves a task."""
    b = _hashed(points, "id", "vec", {"keys_": family.keys(F.col("vec"), m, tables, seed)})
    q = _hashed(queries, "qid", "qvec", {"keys_": family.keys(F.col("qvec"), m, tables, seed)})
    b = b.select("id", "vec", F.posexplode("keys_").alias("tbl", "key"))
    q = q.select("qid", "qvec", F.posexplode("keys_").alias("tbl", "k_")).select("qid", "qvec", "tbl", F.explode(probed(F.col("k_"), m, probes)).alias("key"))
    return nearest_found(nearest_in_groups(b, q, ["tbl", "key"], k, metric), k)


def _hashed(rows: DataFrame, id_col: str, vec: str, keys: dict[str, list[Column]]) -> DataFrame:
    """Ids, vectors and their keys, hashed once and written."""
    return checkpointed(rows.select(id_col, vec, *[F.array(*c).alias(n) for n, c in keys.items()]), "hashed")


@dataclass(frozen=True)
class TwoLayers:
    """An outer family, and the one by which the members of heavy buckets are hashed again.

    A bucket is heavy with a share of at least ``alpha`` of all points. ``probes`` is
    that of queries in the inner layer.
    """

    outer: HashFamily
    inner: HashFamily
    m_out: int
    l_out: int
    m_in: int
    l_in: int
    alpha: float
    seed: int = 7
    probes: int = 0

    def outer_keys(self, rows: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
        """``(id, vec, tbl, key)``"""
        return buckets(rows, self.outer, self.m_out, self.l_out, self.seed, id_col, vec)

    def inner_keys(self, rows: DataFrame, id_col: str = "id", vec: str = "vec", probes: int = 0) -> DataFrame:
        """``rows(id, vec, tbl, key)`` to ``(tbl, key, id, in_tbl, in_key)``."""
        keys = F.array(*self.inner.keys(F.col(vec), self.m_in, self.l_in, self.seed + 1))
        each = rows.select("tbl", "key", id_col, F.posexplode(keys).alias("in_tbl", "k_"))
        return each.select("tbl", "key", id_col, "in_tbl", F.explode(probed(F.col("k_"), self.m_in, probes)).alias("in_key"))


def slsh_candidates(points: DataFrame, queries: DataFrame, layers: TwoLayers, n: int | None = None) -> DataFrame:
    """``(qid, id)``: members of a heavy bucket are hashed again, and a query that falls into it meets those of its inner buckets alone."""
    n = points.count() if n is None else n
    b, q = layers.outer_keys(points), layers.outer_keys(queries, "qid", "qvec")
    # a heavy bucket holds a share alpha of all points, so there are at most l_out / alpha of them
    heavy = F.broadcast(heavy_buckets(b, n, layers.alpha).select("tbl", "key", F.lit(True).alias("heavy")))
    bh, qh = b.join(heavy, ["tbl", "key"], "left"), q.join(heavy, ["tbl", "key"], "left")
    light = qh.where("heavy is null").select("tbl", "key", "qid").join(bh.where("heavy is null").select("tbl", "key", "id"), ["tbl", "key"])
    deep = layers.inner_keys(qh.where("heavy"), "qid", "qvec", layers.probes).join(layers.inner_keys(bh.where("heavy")), ["tbl", "key", "in_tbl", "in_key"])
    return light.select("qid", "id").unionByName(deep.select("qid", "id")).distinct()


def slsh_knn(points: DataFrame, queries: DataFrame, layers: TwoLayers, k: int, metric: str = "l1") -> DataFrame:
    """The ``k`` nearest of :func:`slsh_candidates`. Each bucket is searched by itself, so no candidate pair leaves a task."""
    rows = []
    for d, c, v in ((points, "id", "vec"), (queries, "qid", "qvec")):
        keys = {"keys_": layers.outer.keys(F.col(v), layers.m_out, layers.l_out, layers.seed), "in_": layers.inner.keys(F.col(v), layers.m_in, layers.l_in, layers.seed + 1)}
        rows.append(_hashed(d, c, v, keys).select(c, v, "in_", F.posexplode("keys_").alias("tbl", "key")))
    heavy = heavy_buckets(rows[0], points.count(), layers.alpha).select("tbl", "key")
    heavy = checkpointed(heavy.withColumn("heavy", F.lit(True)), "heavy")  # at most l_out / alpha rows
    b, q = (d.join(F.broadcast(heavy), ["tbl", "key"], "left").withColumn("in_", F.when(F.col("heavy"), F.col("in_"))) for d in rows)
    return nearest_found(nearest_in_groups(b, q, ["tbl", "key"], k, metric, probes=layers.probes), k)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the pairs ``(qid, id)`` of ``true`` that ``found`` has."""
    n = true.count()
    return true.select("qid", "id").distinct().join(found.select("qid", "id").distinct(), ["qid", "id"]).count() / n if n else 1.0


def vote(neighbours: DataFrame, labels: DataFrame, positive_weight: int = 5) -> DataFrame:
    """``(qid, pred)``: 1 if the neighbours labelled 1, weighed, are at least as many as those labelled 0."""
    j = neighbours.join(labels, "id")
    return j.groupBy("qid").agg((F.sum(F.when(F.col("label") == 1, positive_weight).otherwise(0)) >= F.sum(F.when(F.col("label") == 0, 1).otherwise(0))).cast("int").alias("pred"))


def metrics(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """Accuracy, recall and Matthews correlation; -2 where one is undefined."""
    hit = lambda t, g: F.sum(((F.col(truth) == t) & (F.col(guess) == g)).cast("long"))
    c = pred.agg(hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        "tp", "tn", "fp", "fn", ((tp + tn) / F.nullif(tp + tn + fp + fn, F.lit(0.0))).alias("accuracy"),
        F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0.0))).otherwise(F.lit(-2.0)).alias("recall"),
        F.when(den > 0, (tp * tn - fp * fn) / F.nullif(den, F.lit(0.0))).otherwise(F.lit(-2.0)).alias("mcc"),
    )


def lsh_comparisons(points: DataFrame, queries: DataFrame, family: HashFamily, m: int, tables: int, seed: int = 7) -> DataFrame:
    """``(qid, comparisons)``: how many points each query shares a key with, itself left out, as :func:`comparison_counts` of :func:`lsh_candidates`.

    A pair counts in the first table that it shares a key in, so pairs are counted
    inside their buckets and none is kept. Of rows that share an id the pairs are made.
    """
    p = _hashed(points, "id", "vec", {"keys_": family.keys(F.col("vec"), m, tables, seed)}).select("id", "keys_").where("id is not null").distinct()
    q = _hashed(queries, "qid", "qvec", {"keys_": family.keys(F.col("qvec"), m, tables, seed)}).select("qid", "keys_").where("qid is not null").distinct()
    kind = dict(queries.dtypes)["qid"]
    one = [d.groupBy(c).agg(F.min("keys_").alias("keys_"), F.count("*").alias("n_")) for d, c in ((p, "id"), (q, "qid"))]
    one = [checkpointed(d, "counted") for d in one]
    each = [d.where("n_ = 1").select(c, "keys_", F.posexplode("keys_").alias("tbl", "key")) for d, c in zip(one, ("id", "qid"), strict=True)]
    b, a = _spread(*each, ["tbl", "key"])

    def keys(t: pa.Table) -> np.ndarray:
        """Keys as numbers, a row for each table."""
        return np.ascontiguousarray(_bits(t["keys_"]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_arrays([right["qid"][:0], pa.array([], pa.int64())], ["qid", "n_"])
        (x, y), t = (keys(left), keys(right)), left["tbl"][0].as_py()
        codes = {v: c for c, v in enumerate(dict.fromkeys(left["id"].to_pandas()))}
        own = right["qid"].to_pandas().map(codes).fillna(-1).to_numpy(np.int64)
        n = np.empty(len(right), np.int64)
        for r0 in range(0, len(right), MATRIX):
            rows = slice(r0, r0 + MATRIX)
            seen = own[rows, None] == np.arange(x.shape[1])[None, :]
            for j in range(t):
                seen |= y[j, rows, None] == x[j][None, :]
            n[rows] = x.shape[1] - seen.sum(axis=1)
        return pa.Table.from_arrays([right["qid"], pa.array(n)], ["qid", "n_"])

    by = ["tbl", "key", "p_", "b_"]
    found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(lambda qs, ps: run(ps, qs), f"qid {kind}, n_ long")
    many = [one[0].where("n_ > 1").select("id"), one[1].where("n_ > 1").select("qid")]
    first = lambda d, c: d.select(c, F.posexplode("keys_").alias("tbl", "key"))
    twice = first(q.join(many[1], "qid"), "qid").join(first(p, "id"), ["tbl", "key"]).select("qid", "id")
    twice = twice.unionByName(first(q.join(many[1], "qid", "left_anti"), "qid").join(first(p.join(many[0], "id"), "id"), ["tbl", "key"]).select("qid", "id"))
    found = found.unionByName(comparison_counts(twice.where("id <> qid")).withColumnRenamed("comparisons", "n_"))
    return found.groupBy("qid").agg(F.sum("n_").alias("comparisons")).where("comparisons > 0")


def comparison_counts(candidates: DataFrame, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Distinct candidates that each query is compared with."""
    return candidates.groupBy(*keys).agg(F.count_distinct("id").alias("comparisons"))
