"""Exact order statistics of groups of any size, without sorting them.

Wanted ranks are found by refining histograms. A group's values are counted in bins
between its least and its largest; a rank falls into one bin, and only that bin's
values are counted again, between *its* least and largest. Bins of a few values are
sorted in the end, bins of one value need nothing more. Levels take bins of even width
and of even ratio in turn, so that values of one size and of many need few levels. Counts are summed before they
are shuffled, so a group that holds most rows costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import broadcast_counted, checkpointed

#: Bins of a histogram, and the values of a bin that are sorted as one array.
BINS = 1024
FEW = 4096
#: Parts that the rows of a group are joined in where its ranks are too many to be sent to all tasks.
SALTS = 32


def _bin(v: Column, lo: Column, hi: Column, bins: int, even: bool) -> Column:
    """Bin of a value between ``lo`` and ``hi``, of bins of even width or of even ratio.

    The two ends have bins of their own, so that every level makes headway, infinite
    ends or not. Widths tell apart values of one size, ratios those of many sizes.
    """
    # 745 is beyond the logarithm of the smallest double
    at = (lambda x: x / 2) if even else (lambda x: F.signum(x) * (F.coalesce(F.ln(F.abs(x)), F.lit(-745.0)) + 746))
    share = F.try_divide(at(v) - at(lo), at(hi) - at(lo))  # null where rounding leaves no width
    inner = F.when(F.isnan(share) | share.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins - 2), F.floor(share * (bins - 2)).cast("int") + 1)))
    return F.when(v == lo, F.lit(0)).when(v == hi, F.lit(bins - 1)).otherwise(inner)


def _inside(rows: DataFrame, spans: DataFrame, keys: list[str], n_spans: int) -> DataFrame:
    """Rows ``(keys, v)`` in the spans ``(s_i, lo, hi)`` of their group; spans of a group do not overlap."""
    names = [f"s_{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, names, strict=True)]
    on = F.lit(True)
    if n_spans > 200_000:  # beyond a broadcast
        rows = rows.withColumn("salt_", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        spans = spans.withColumn("salt2_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same.append(F.col("salt_") == F.col("salt2_"))
    for c in same:
        on = on & c
    return rows.join(broadcast_counted(spans, n_spans), on & F.col("v").between(F.col("lo"), F.col("hi")))


def _same(columns: list[str]) -> Column:
    """Whether the sides ``x`` and ``y`` of a join agree in all columns, nulls among them."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    return on


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]], bins: int = BINS, few: int = FEW) -> DataFrame:
    """``(keys, n, values)``: of each group the values at the ranks (from 1) that ``ranks`` gives for its size ``n``, as doubles.

    Ranks outside ``1..n`` have null. Values must not be null or NaN. Null keys are
    groups like others; without keys all rows are one group, and an empty table gives no
    row. The table is read once; what is read again are its keys and values, and after
    the first histogram the values around the ranks alone.
    """
    names = [f"s_{i}" for i in range(len(keys))]
    rows = checkpointed(df.select(*keys, F.col(value).cast("double").alias("v")), "values")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    sizes = checkpointed(sizes, "sizes")
    wanted = [r.cast("long") for r in ranks(F.col("n"))]
    ask = sizes.select(*[F.col(k).alias(s) for k, s in zip(keys, names, strict=True)], "lo", "hi", "n", F.posexplode(F.array(*wanted)).alias("j", "r"))
    ask = checkpointed(ask.where((F.col("r") >= 1) & (F.col("r") <= F.col("n"))), "ranks")
    found, level = [], 0
    while True:
        found.append(ask.where("lo = hi").select(*names, "j", F.col("lo").alias("v")))
        spans = ask.where("lo < hi").groupBy(*names, "lo", "hi").agg(F.first("n").alias("n"), F.collect_list(F.struct("j", "r")).alias("ask"))
        n_small, n_large = spans.agg(F.count_if(F.col("n") <= few), F.count_if(F.col("n") > few)).first()  # type: ignore[misc]
        if n_small:
            small = spans.where(F.col("n") <= few)
            each = _inside(rows, small.select(*names, "lo", "hi"), keys, n_small).groupBy(*names, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
            got = each.alias("x").join(small.alias("y"), _same([*names, "lo", "hi"])).select(*[F.col(f"x.{s}") for s in names], "sorted", F.explode("ask").alias("a"))
            got = got.select(*names, F.col("a.j").alias("j"), F.element_at("sorted", F.col("a.r").cast("int")).alias("v"))
            found.append(checkpointed(got, "found") if n_large else got)
        if not n_large:
            break
        large = checkpointed(spans.where(F.col("n") > few).drop("n"), "spans")
        inside = _inside(rows, large.drop("ask"), keys, n_large)
        if level:
            rows = checkpointed(inside.select(*keys, "v"), "values")
            inside = _inside(rows, large.drop("ask"), keys, n_large)
        hist = inside.groupBy(*names, "lo", "hi", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins, level % 2 == 0).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        upto = F.sum("c").over(W.partitionBy(*names, "lo", "hi").orderBy("bin"))  # as many rows as bins
        hist = hist.withColumn("before", upto - F.col("c"))
        open_ = hist.alias("x").join(broadcast_counted(large, n_large).alias("y"), _same([*names, "lo", "hi"])).select(*[F.col(f"x.{s}") for s in names], "lo2", "hi2", "c", "before", F.explode("ask").alias("a"))
        open_ = open_.where((F.col("a.r") > F.col("before")) & (F.col("a.r") <= F.col("before") + F.col("c")))
        ask = checkpointed(open_.select(*names, F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("c").alias("n"), F.col("a.j").alias("j"), (F.col("a.r") - F.col("before")).alias("r")), "ranks")
        level += 1
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    values = every.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    on = F.lit(True)
    for k, s in zip(keys, names, strict=True):
        on = on & F.col(f"z.{k}").eqNullSafe(F.col(f"w.{s}"))
    out = sizes.alias("z").join(values.alias("w"), on, "left")
    return out.select(*[F.col(f"z.{k}") for k in keys], "n", F.transform(F.sequence(F.lit(0), F.lit(len(wanted) - 1)), lambda j: F.try_element_at(F.coalesce("m", F.create_map().cast("map<int,double>")), j)).alias("values"))
