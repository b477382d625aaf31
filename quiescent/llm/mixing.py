"""Mixing sources to target weights by hash thresholds.

Every document has a 36-bit hash. Sizes are summed by source and hash bucket; a
source's budget falls into one bucket, which alone is split further by the next
bits, three times. What is left is one threshold for each source: documents whose
hash is below it are taken, so larger budgets contain smaller ones and no
document is ever sorted. Of the documents whose hash is the threshold, copies of one
another for the most part, as many are taken as come nearest to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import broadcast_if_small, materialize

#: Hash bits by level; together they are the hash.
LEVEL_BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_hash(doc_id: Column, text: Column, seed: int = 0) -> list[Column]:
    """36 bits ``h`` and the 60 after them ``t`` of the MD5 of id, seed and text. A null id hashes like the text ``null``, a null text like an empty one."""
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")))))
    first = LEVEL_BITS * LEVELS // 4
    return [F.conv(F.substring(key, 1, first), 16, 10).cast("long").alias("h"), F.conv(F.substring(key, first + 1, 15), 16, 10).cast("long").alias("t")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, target)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``cap`` times its source's size
    and the excess is shared again by weight until none is above: the level
    ``lambda`` for which ``sum(min(cap * size, lambda * weight))`` is the total.
    Sources are sorted by the level at which they fill up; the first level that
    fills no further source is the answer, and the levels after it only fall. One row for each source is sorted here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("long").alias("w")).withColumn("full", F.lit(cap) * F.col("source_size"))
    everything = W.partitionBy(F.lit(0))
    up_to = W.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.lit(share) * F.sum("source_size").over(everything),
        "filled": F.coalesce(F.sum("full").over(up_to), F.lit(0.0)),
        "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up_to), F.lit(0)),
    }).withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    s = s.withColumn("lam", F.max(F.when(F.col("level") * F.col("w") <= F.col("full"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("full"), F.coalesce(F.col("w") * F.col("lam"), F.col("full"))).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """``sized(source, size, h)`` and targets to ``(source, source_size, target, copies, cut, rest)``.

    Each document is taken ``copies`` times and once more if ``h < cut``; of those
    with ``h = cut`` so many that ``rest`` words more are taken. Three histograms of
    at most 4096 buckets for each source: the second and third hold the boundary
    bucket of the one before alone.
    """
    t = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumns({"left": F.col("target") - F.col("copies") * F.col("source_size"), "base": F.lit(0).cast("long"), "open": F.lit(True)})
    for level in range(LEVELS):
        width = 1 << (LEVEL_BITS * (LEVELS - 1 - level))
        state = t.select(F.col("source").alias("s_"), "base", "left", "open")
        inside = sized.join(broadcast_if_small(state, n_sources), F.col("source").eqNullSafe(F.col("s_")))
        inside = inside.where(F.col("open") & (F.col("h") >= F.col("base")) & (F.col("h") < F.col("base") + F.lit(width << LEVEL_BITS)))
        hist = inside.groupBy("source", F.floor((F.col("h") - F.col("base")) / width).cast("long").alias("b"), "base", "left").agg(F.sum("size").alias("n"))
        upto = W.partitionBy("source").orderBy("b")
        hist = hist.withColumn("cum", F.sum("n").over(upto))
        # the bucket in which the budget ends: the first whose running sum exceeds it
        edge = hist.where("cum > left").groupBy("source").agg(F.min(F.struct("b", "n", "cum", "base", "left")).alias("e")).select(F.col("source").alias("s_"), "e.*")
        edge = edge.select("s_", (F.col("base") + F.col("b") * width).alias("base2"), (F.col("left") - (F.col("cum") - F.col("n"))).alias("left2"))
        t = t.join(broadcast_if_small(edge, n_sources), F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
        # a source without words has no such bucket
        t = t.select("source", "source_size", "target", "copies", F.coalesce("left2", "left").alias("left"), F.coalesce("base2", "base").alias("base"), (F.col("open") & F.col("base2").isNotNull()).alias("open"))
        t = materialize(t, "cuts")
    return t.select("source", "source_size", "target", "copies", F.col("base").alias("cut"), F.when(F.col("open"), F.col("left")).otherwise(F.lit(0.0)).alias("rest"))


def size_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(row, doc_id, source, size, h, t), written once: the text is read for this alone."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), *mix_hash(F.col("doc_id"), F.col("text"), seed))
    return materialize(own, "sized")


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame, int]:
    """One row for each source with its copies and cut, what is taken of the documents at the cut, and the number of sources.

    The second is ``(s_, id_, t, cut, m, q)``: of ``m`` rows equal in id and text
    ``q`` are taken.
    """
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n = sizes.count()
    plan = thresholds(sized, source_targets(sizes, weights, share, cap), n)
    at = plan.where("rest > 0").select(F.col("source").alias("s_"), "cut", "rest")
    edge = sized.join(broadcast_if_small(at, n), F.col("source").eqNullSafe(F.col("s_")) & (F.col("h") == F.col("cut"))).where("size > 0")
    edge = edge.groupBy("s_", F.col("doc_id").alias("id_"), "t", "size", "cut", "rest").agg(F.count("*").alias("m"))
    before = W.partitionBy("s_").orderBy(F.col("id_").asc_nulls_first(), "t").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(before), F.lit(0)) - F.col("size") / 2
    q = F.least(F.col("m"), F.greatest(F.lit(0), F.ceil(left / F.col("size")))).cast("long")
    return plan, materialize(edge.withColumn("q", q).where("q > 0").select("s_", "id_", "t", "cut", "m", "q"), "edge"), n


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows equal in source, id and text numbered in ``k_`` from 1. Each written part counts its own; a group is never in one task."""
    rows = materialize(rows.withColumn("part_", F.shiftright("row", 33)), "numbered")
    group = ["s_", "id_", "t"]
    count = rows.groupBy(*group, "part_").agg(F.count("*").alias("c_"))
    before = W.partitionBy(*group).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    count = count.withColumn("o_", F.coalesce(F.sum("c_").over(before), F.lit(0))).toDF("s2_", "id2_", "t2_", "part2_", "c_", "o_")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("s_", "s2_"), ("id_", "id2_"), ("t", "t2_"), ("part_", "part2_"))]
    own = F.row_number().over(W.partitionBy(*group, "part_").orderBy("row"))
    return rows.join(count, same[0] & same[1] & same[2] & same[3]).withColumn("k_", own + F.col("o_"))


def _taken(rows: DataFrame, plan: DataFrame, edge: DataFrame, n_sources: int) -> DataFrame:
    """``rows(row, doc_id, source, size, h, t, ...)`` with the source's columns and ``copies``, how often each row is taken."""
    keep = [F.col(c) for c in rows.columns] + [F.col(c) for c in ("source_size", "target", "copies")]
    out = rows.join(broadcast_if_small(plan.withColumnRenamed("source", "p_"), n_sources), F.col("source").eqNullSafe(F.col("p_")))
    n = edge.count()
    at = edge.toDF("s_", "id_", "t_", "cut_", "m", "q")
    here = (F.col("h") == F.col("cut_")) & (F.col("t") == F.col("t_")) & F.col("source").eqNullSafe(F.col("s_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
    out = out.join(broadcast_if_small(at, n), here, "left").withColumn("more", ((F.col("h") < F.col("cut")) | F.coalesce(F.col("q") == F.col("m"), F.lit(False))).cast("long"))
    some = F.coalesce(F.col("q") < F.col("m"), F.lit(False))
    parts = [out] if edge.where("q < m").isEmpty() else [out.where(~some), _numbered(out.where(some)).withColumn("more", (F.col("k_") <= F.col("q")).cast("long"))]
    times = F.when(F.col("size") > 0, F.col("copies") + F.col("more")).otherwise(F.least(F.col("copies"), F.lit(1))).alias("copies")
    done = [p.select(*keep[:-1], times) for p in parts]
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document.

    Null texts and texts without words have size 0 and take 0 words. A null source
    is a source of its own, the last. Rows that repeat an id, or have none, are told
    apart by their texts; of rows equal in both as many are taken as come nearest
    to the target. Extra columns are ignored; an empty table gives an empty one.
    ``cap`` times a document's size is never exceeded, for ``copies`` is at most
    ``ceil(cap)`` and a target of exactly ``cap`` leaves nothing over.
    """
    sized = size_documents(docs, seed)
    out = _taken(sized, *plan_mix(sized, weights, share, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **kw: object) -> DataFrame:
    """The documents the mix takes, with all their columns, ``mix_copies`` and ``mix_taken``; columns of those names give way."""
    seed = int(kw.pop("seed", 0))  # type: ignore[call-overload]
    plan, edge, n = plan_mix(size_documents(docs, seed), **kw)  # type: ignore[arg-type]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_copies", "mix_taken")]
    row = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*own).alias("d_"), "doc_id", "source", word_count(F.col("text")).alias("size"), *mix_hash(F.col("doc_id"), F.col("text"), seed))
    out = _taken(row, plan, edge, n).where("copies > 0")
    return out.select("d_.*", F.col("copies").alias("mix_copies"), (F.col("copies") * F.col("size")).alias("mix_taken"))
