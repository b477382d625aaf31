"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards of a bounded size. Each layer of a shard's graph is
built by adding its nodes in batches: a new node chooses its links among the nearest
of those added before, which in a shard are found by one matrix product. The graph
is stored as flat neighbour arrays. Blocks of queries go to every shard, where the
graph is searched side by side in numpy; the shards' nearest are merged. Distances
that are returned are computed anew on the original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

#: Rows of a shard, on average.
SHARD_ROWS = 8192
#: Links a node gets, twice as many in the lowest layer; candidates looked at to choose them, and in a search.
LINKS = 16
EF_BUILD = 32
EF_SEARCH = 64
#: Nodes or queries searched side by side, and nodes expanded in one step of each.
BATCH = 256
BEAM = 4
#: Blocks of queries that a task holds.
BLOCKS = 64
NONE = -1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of ``a[i]`` to ``b[i, j]``."""
    d = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def _search(vec: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ``ef`` nearest found by each row of ``q``, from its nodes ``start``; missing ones -1."""
    n, width = len(q), max(ef, start.shape[1])
    ids = np.full((n, width), NONE, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    ids[:, : start.shape[1]] = start
    dist[:, : start.shape[1]] = np.where(start >= 0, _distances(q, vec[start]), np.inf)
    seen = np.zeros((n, len(vec) + 1), bool)
    seen[np.arange(n)[:, None], start] = True  # the last place stands for -1
    seen[:, NONE] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1)[:, :ef], np.take_along_axis(dist, order, 1)[:, :ef]
    done = ids == NONE
    live = np.arange(n)
    while len(live):
        left = ~done[live]
        pick = np.argsort(~left, axis=1, kind="stable")[:, :BEAM]
        use = np.take_along_axis(left, pick, 1)
        done[live[:, None], pick] = True
        node = np.where(use, np.take_along_axis(ids[live], pick, 1), NONE)
        near = np.where(node[:, :, None] >= 0, links[node], NONE).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = NONE
        near[seen[live[:, None], near]] = NONE
        seen[live[:, None], near] = True
        d = np.where(near >= 0, _distances(q[live], vec[near]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, : ids.shape[1]]
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], axis=1), best, 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near == NONE], axis=1), best, 1)
        live = live[~done[live].all(axis=1)]
    return ids, dist


def _choose(vec: np.ndarray, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Diverse neighbours of nodes: a candidate, nearest first, stays if none chosen is nearer to it than the node itself; then the nearest passed by."""
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    v = vec[cand]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    valid = (cand >= 0) & np.isfinite(dist)
    taken = np.zeros(cand.shape, bool)
    full = np.zeros(len(cand), np.int64)
    closest = np.full(cand.shape, np.inf, dist.dtype)  # of each candidate to those chosen
    for j in range(cand.shape[1]):
        ok = (valid[:, j] & (full < most) & (closest[:, j] > dist[:, j])).nonzero()[0]
        taken[ok, j] = True
        full[ok] += 1
        closest[ok] = np.minimum(closest[ok], between[ok, j])
    pick = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((len(cand), most), NONE, np.int64)
    out[:, : pick.shape[1]] = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(cand, pick, 1), NONE)
    return out


def _nearest_of(vec: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the ``k`` rows of ``vec`` nearest to each row of ``q``, in no order."""
    d = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", vec, vec)[None, :] - 2 * (q @ vec.T)
    if k >= len(vec):
        return np.broadcast_to(np.arange(len(vec)), d.shape).copy(), d
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(d, at, 1)


def _layer(vec: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Links of one layer over the nodes ``order``, which are added in that order, each to the nearest before it."""
    links = np.full((len(vec), most), NONE, np.int64)
    at = 0
    while at < len(order):
        new = order[at : at + min(BATCH, max(32, at))]
        q = vec[new]
        # nodes of the same batch meet too; a node is no neighbour of its own
        old = order[: at + len(new)]
        near, dist = _nearest_of(vec[old], q, min(EF_BUILD, len(old)))
        ids = old[near]
        dist[ids == new[:, None]] = np.inf
        ids[ids == new[:, None]] = NONE
        if len(old) > 1:
            links[new, : min(LINKS, most)] = _choose(vec, ids, dist, min(LINKS, most))
            src = np.repeat(new, most)
            dst = links[new].reshape(-1)
            src, dst = src[dst >= 0], dst[dst >= 0]
            sort = np.argsort(dst, kind="stable")
            src, dst = src[sort], dst[sort]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            for s in range(0, len(to), BATCH):
                t, f, c = to[s : s + BATCH], first[s : s + BATCH], count[s : s + BATCH]
                back = np.full((len(t), int(c.max())), NONE, np.int64)
                slot = np.arange(int(c.max()))[None, :]
                inside = slot < c[:, None]
                back[inside] = src[(f[:, None] + slot)[inside]]
                both = np.concatenate([links[t], back], axis=1)
                both.sort(axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = NONE
                few = (both >= 0).sum(axis=1) <= most
                links[t[few]] = -np.sort(-both[few], axis=1)[:, :most]
                if (~few).any():
                    many = both[~few]
                    d = np.where(many >= 0, _distances(vec[t[~few]], vec[many]), np.inf)
                    links[t[~few]] = _choose(vec, many, d, most)
        at += len(new)
    return links


def build_graph(vec: np.ndarray, seed: int = 5) -> tuple[list[np.ndarray], int]:
    """Links by layer, the lowest first, and the node of the highest layer that searches enter by. ``vec`` must hold distinct rows."""
    rng = np.random.default_rng(seed)
    n = len(vec)
    level = np.floor(-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int)
    top = int(level.max()) if n else 0
    order = rng.permutation(n)
    # nodes of higher layers come first, so that the nodes of every layer have links into the one above
    order = order[np.argsort(-level[order], kind="stable")]
    layers = [_layer(vec, order[level[order] >= k], 2 * LINKS if k == 0 else LINKS) for k in range(top + 1)]
    return layers, int(order[0]) if n else 0


def search_graph(vec: np.ndarray, layers: list[np.ndarray], entry: int, q: np.ndarray, ef: int) -> np.ndarray:
    """Nodes that each row of ``q`` finds nearest, nearest first, -1 for missing ones."""
    start = np.full((len(q), 1), entry, np.int64)
    for k in range(len(layers) - 1, 0, -1):
        ids, _ = _search(vec, layers[k], q, start, 4)
        start = ids[:, :1]
    return _search(vec, layers[0], q, start, ef)[0]


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(row, vec_id, v array<double>, dim)`` without null ids and without null, empty, zero or non-finite vectors.

    ``row`` tells rows of one id apart; it is settled only once the table is written.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    out = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def build_index(vectors: DataFrame, n_rows: int) -> DataFrame:
    """One row for each shard and dimension: rows, ids, distinct vectors, which of them each row has, and the flat layers.

    Equal vectors of a shard are one node, so that many copies of one vector
    cannot fill each other's links.
    """
    shards = max(1, math.ceil(n_rows / SHARD_ROWS))
    binary = ("rows", "ids", "node_of", "vectors", "links")
    schema = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("entry", pa.int32()), *[(c, pa.binary()) for c in binary], ("n_layers", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        v = t["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        node, of = np.unique(v, axis=0, return_inverse=True)
        layers, entry = build_graph(node.astype(np.float32))
        flat = np.concatenate([x.reshape(-1) for x in layers]).astype(np.int32)
        cols = {"rows": t["row"].to_numpy(), "ids": t["vec_id"].to_numpy(), "node_of": of.reshape(-1).astype(np.int32), "vectors": node, "links": flat}
        row = {"shard": t["shard"][0].as_py(), "dim": dim, "entry": entry, "n_layers": len(layers)} | {k: x.tobytes() for k, x in cols.items()}
        return pa.Table.from_pylist([row], schema=schema)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard", "dim").applyInArrow(run, "shard int, dim int, entry int, rows binary, ids binary, node_of binary, vectors binary, links binary, n_layers int")
    return materialize(index, "hnsw")


class Shard:
    """One row of an index, ready for searches."""

    def __init__(self, row: dict) -> None:
        dim = row["dim"]
        self.entry, self.rows, self.ids = row["entry"], np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        of = np.frombuffer(row["node_of"], np.int32)
        self.node = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        self.small = self.node.astype(np.float32)
        flat, at = np.frombuffer(row["links"], np.int32), 0
        self.layers = []
        for j in range(row["n_layers"]):
            width = 2 * LINKS if j == 0 else LINKS
            self.layers.append(flat[at : at + len(self.node) * width].reshape(-1, width).astype(np.int64))
            at += len(self.node) * width
        # rows by node, smallest ids first; k and the query's own are enough of each
        self.sort = np.lexsort((self.rows, self.ids, of))
        self.first = np.searchsorted(of[self.sort], np.arange(len(self.node) + 1))

    def nearest(self, q_row: np.ndarray, q_id: np.ndarray, q: np.ndarray, k: int, ef: int) -> Iterator[tuple[int, int, int, float]]:
        """(query's row, its id, id, distance) of the ``k`` nearest of each query; a query's own row is no candidate."""
        found = search_graph(self.small, self.layers, self.entry, q.astype(np.float32), max(ef, k + 1))
        for own, name, x, near in zip(q_row.tolist(), q_id.tolist(), q, found, strict=True):
            near = near[near >= 0]
            d = np.sqrt(((self.node[near] - x) ** 2).sum(axis=1)).tolist()
            mine = []
            for dd, z in zip(d, near, strict=True):
                at = self.sort[self.first[z] : min(self.first[z + 1], self.first[z] + k + 1)]
                mine += [(dd, c) for c, r in zip(self.ids[at].tolist(), self.rows[at].tolist(), strict=True) if r != own]
            yield from ((own, name, c, dd) for dd, c in sorted(mine)[:k])


def search(index: DataFrame, queries: DataFrame, n_queries: int, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """``queries(row, vec_id, v, dim)`` to ``(query_id, rank, vec_id, score)``: Euclidean distances, nearest first, ties to the smaller id.

    A query's own row is no candidate. Queries go to every shard in blocks; a task
    holds one shard and at most :data:`BLOCKS` blocks, so only with more queries is
    a shard sent more than once.
    """
    blocks = max(1, math.ceil(n_queries / BATCH))
    part = F.pmod(F.xxhash64("row", F.lit(4)), F.lit(blocks)).cast("int")
    packed = queries.groupBy(part.alias("block"), "dim").agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("q"))
    packed = packed.select("block", "dim", F.col("q.row").alias("q_rows"), F.col("q.vec_id").alias("q_ids"), F.flatten("q.v").alias("q_vec"), F.floor(F.col("block") / BLOCKS).cast("int").alias("g"))
    groups = math.ceil(blocks / BLOCKS)
    sent = packed.join(index.select(F.col("shard").alias("to"), F.col("dim").alias("of")), F.col("dim") == F.col("of"))
    dealt = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if len(shard) and len(asked):
            s = Shard(shard.to_pylist()[0])
            for i in range(len(asked)):
                rows, ids, vec = (asked[c][i].values.to_numpy() for c in ("q_rows", "q_ids", "q_vec"))
                q = vec.reshape(len(rows), -1)
                for j in range(0, len(rows), BATCH):
                    out += s.nearest(rows[j : j + BATCH], ids[j : j + BATCH], q[j : j + BATCH], k, ef)
        cols = zip(*out, strict=True) if out else ((), (), (), ())
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["query_row", "query_id", "vec_id", "score"])

    near = dealt.groupBy("shard", "dim", "g").cogroup(sent.groupBy("to", "of", "g")).applyInArrow(run, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest of each row of ``(vec_id, embedding)`` whose id is divisible by ``every``, among all other rows.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part. Vectors of different lengths are not
    compared. Rows that repeat an id are candidates of each other, and a query each
    where the id is asked for. Ties go to the smaller id, of one shard or several.
    Extra columns are ignored, an empty table gives an empty one.
    """
    vectors = materialize(valid_vectors(rows), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0)
    n, n_q = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    return search(build_index(vectors, n), queries, n_q, k)
