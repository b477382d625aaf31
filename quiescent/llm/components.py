"""Connected components of a link table, without collecting links anywhere.

Alternating large-star and small-star rounds over DataFrames. Each round is a
min-aggregation by node and a join of the links with those minima, written to the
shared folder; a union-find inside each input split first turns its links into
stars, so that few rounds are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import handed_back
from .storage import discard, materialize


#: Links that one task joins.
SPLIT = 2_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for each node that is not the smallest."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(nodes))
    while True:
        m = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], m)
        np.minimum.at(new, root[v], m)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for x in batches:
        a, b = stars(np.concatenate([a, x["a"].to_numpy()]), np.concatenate([b, x["b"].to_numpy()]))
    yield pd.DataFrame({"a": a, "b": b})


def _star_round(cur: DataFrame) -> DataFrame:
    """One large-star and one small-star round."""
    both = cur.union(cur.select(F.col("b"), F.col("a"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # a star's own links point at its centre, which has no smaller neighbour to hand on
    large = large.union(both.join(low, "u").where("u > m").select("u", "m"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return small.union(least.select(F.col("u"), F.col("m"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long nodes to ``(node, component)``, component being the smallest node reachable.

    Only nodes that are not the smallest of their component have a row. Links
    with a null end and loops are ignored; repeated links do no harm; an empty
    table gives an empty one. Splits hold at most about :data:`SPLIT` links; where
    all fit one split the first union-find is the answer.
    """
    cur, mark = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "links"), None
    while True:
        parts = -(-cur.count() // SPLIT)
        star = materialize(cur.coalesce(max(1, parts)).mapInPandas(handed_back(_contract), "a long, b long"), "links")
        discard(cur)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) if parts > 1 else None
        if now == mark:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
        cur = materialize(_star_round(star), "links")
        discard(star)
