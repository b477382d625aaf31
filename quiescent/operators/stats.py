"""Statistics: moments, quantiles, tests, permutations and multiple comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .selection import order_statistics


def nan_mean(value: str) -> Column:
    return F.avg(F.when(~F.isnan(value), F.col(value)))


def nan_std(value: str) -> Column:
    return F.stddev_samp(F.when(~F.isnan(value), F.col(value)))


def rms(value: str) -> Column:
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


def peak(value: str) -> Column:
    """The value of largest magnitude; of equal ones the larger."""
    return F.max(F.struct(F.abs(value), F.col(value)))[value]


def amplitude_area(df: DataFrame, keys: list[str], idx: str, value: str, lo: int, hi: int, base: float = 0.0) -> DataFrame:
    """Trapezoid area over ``base`` of each key between two indices."""
    d = df.where(F.col(idx).between(lo, hi)).withColumn("next_", F.lead(value).over(W.partitionBy(*keys).orderBy(idx)))
    return d.groupBy(*keys).agg(F.sum((F.col(value) + F.col("next_")) / 2 - base).alias("area"))


def hazen_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """``(keys, p, q)`` with the k-th of n values at ``(k - 0.5) / n``, linear in between. Null and NaN do not count.

    The two ranks of each probability come from :func:`.selection.order_statistics`; no group is sorted.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    at = lambda n, p: F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(float(p)) * n + 0.5))
    got = order_statistics(d, keys, value, lambda n: [f(at(n, p)) for p in probs for f in (F.floor, F.ceil)])
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("values")[2 * i].alias("a"), F.col("values")[2 * i + 1].alias("b"), at(F.col("n"), p).alias("at")) for i, p in enumerate(probs)])
    g = got.select(*keys, F.explode(rows).alias("r"))
    return g.select(*keys, F.col("r.p").alias("p"), (F.col("r.a") + (F.col("r.b") - F.col("r.a")) * (F.col("r.at") - F.floor("r.at"))).alias("q"))


def median_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and the order statistics that bound it at 95 %, by ranks. Null does not count."""

    def ranks(n: Column) -> list[Column]:
        half = 1.96 * F.sqrt(n)
        lo = F.greatest(F.lit(0), F.floor((n - half) / 2)) + 1
        hi = F.least(n - 1, F.ceil(1 + (n + half) / 2)) + 1
        return [F.floor((n + 1) / 2), F.ceil((n + 1) / 2), lo, hi]

    got = order_statistics(df.where(F.col(value).isNotNull()), keys, value, ranks)
    v = F.col("values")
    return got.select(*keys, ((v[0] + v[1]) / 2).alias("median"), v[2].alias("lo"), v[3].alias("hi"), "n")


def signal_stats(df: DataFrame, keys: list[str], value: str, trim: float = 0.05) -> DataFrame:
    """Mean, deviation, skewness, kurtosis, quartiles, range and the mean between two percentiles."""
    lim = df.groupBy(*keys).agg(F.percentile(value, F.lit(trim)).alias("p_lo"), F.percentile(value, F.lit(1 - trim)).alias("p_hi"))
    j = df.join(lim, keys) if keys else df.join(F.broadcast(lim))
    return j.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"),
        F.min(value).alias("lo"), F.percentile(value, F.lit(0.25)).alias("q25"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.75)).alias("q75"), F.max(value).alias("hi"),
        F.avg(F.when(F.col(value).between(F.col("p_lo"), F.col("p_hi")), F.col(value))).alias("trimmed_mean"),
    )


def standardize(df: DataFrame, keys: list[str], value: str, population: bool = False, out: str = "z") -> DataFrame:
    """Standard scores inside each key; null without spread."""
    w = W.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w) if population else F.stddev_samp(value).over(w)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0)))


class Standardizer:
    """Fits centre and scale of valid samples once, by mean and deviation or by median and quartile range."""

    def __init__(self, robust: bool = False) -> None:
        self.robust = robust

    def fit(self, df: DataFrame, value: str, valid: Column | None = None) -> StandardizerModel:
        d = df.where(valid) if valid is not None else df
        if self.robust:
            c, s = F.percentile(value, F.lit(0.5)), F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))
        else:
            c, s = F.avg(value), F.stddev_pop(value)
        r = d.agg(c, s).first()
        return StandardizerModel(r[0], r[1])


class StandardizerModel:
    def __init__(self, centre: float | None, scale: float | None) -> None:
        self.centre, self.scale = centre, scale

    def transform(self, df: DataFrame, value: str, valid: Column | None = None, out: str = "z") -> DataFrame:
        """Adds the scores; samples that are not valid get 0."""
        z = (F.col(value) - F.lit(self.centre)) / F.nullif(F.lit(self.scale), F.lit(0.0))
        return df.withColumn(out, F.when(valid, z).otherwise(F.lit(0.0)) if valid is not None else z)


def covariance(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.covar_samp(x, y).alias("cov"), F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.corr(x, y).alias("r"))


def percent_variance(df: DataFrame, keys: list[str], data: str, model: str) -> DataFrame:
    """Share of the data's variance that a model accounts for, in percent."""
    return df.groupBy(*keys).agg((100 * (1 - F.var_samp(F.col(data) - F.col(model)) / F.nullif(F.var_samp(data), F.lit(0.0)))).alias("pvaf"))


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def paired_t(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = df.withColumn("d_", F.col(a) - F.col(b)).where("d_ is not null")
    n = F.count("d_")
    return d.groupBy(*keys).agg((F.avg("d_") / F.nullif(F.stddev_samp("d_"), F.lit(0.0)) * F.sqrt(n)).alias("t"), (n - 1).alias("df"))


def unpaired_t(df: DataFrame, keys: list[str], group: str, a: object, b: object, value: str, equal_variance: bool = True) -> DataFrame:
    """Student's t with a pooled variance, or Welch's."""

    def own(f: object, g: object) -> Column:
        return f(F.when(F.col(group) == g, F.col(value)))  # type: ignore[operator]

    s = df.where(F.col(group).isin(a, b)).groupBy(*keys).agg(*[own(f, g).alias(f"{n}{k}") for k, g in (("1", a), ("2", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2")
    if equal_variance:
        dof = n1 + n2 - 2
        se2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2)
    else:
        q1, q2 = v1 / n1, v2 / n2
        se2 = q1 + q2
        dof = se2 * se2 / (q1 * q1 / (n1 - 1) + q2 * q2 / (n2 - 1))
    ok = (n1 > 1) & (n2 > 1)
    return s.where(ok).select(*keys, ((F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(se2), F.lit(0.0))).alias("t"), dof.cast("double").alias("df"))


def anova1(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance by group sums."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    d1, d2 = F.col("k") - 1, F.col("n_all") - F.col("k")
    ssb = F.col("s2") - F.col("n_all") * F.col("gm") * F.col("gm")
    return t.where((F.col("k") > 1) & (F.col("n_all") > F.col("k"))).select(*keys, ((ssb / d1) / F.nullif(F.col("ssw") / d2, F.lit(0.0))).alias("f"), d1.alias("df1"), d2.alias("df2"))


def anova1_repeated(df: DataFrame, subject: str, condition: str, value: str) -> DataFrame:
    """One-way analysis with repeated measures: one value for each subject and condition."""
    c = df.select(subject, condition, F.col(value).cast("double").alias("v"))
    of = lambda k, n: c.groupBy(k).agg(F.avg("v").alias(n))
    d = c.join(of(subject, "ms_"), subject).join(of(condition, "mc_"), condition)
    tot = c.agg(F.avg("v").alias("gm"), F.count_distinct(subject).alias("s"), F.count_distinct(condition).alias("k"))
    r = d.join(F.broadcast(tot)).agg(
        F.sum(F.pow(F.col("mc_") - F.col("gm"), 2)).alias("ssc"), F.sum(F.pow(F.col("v") - F.col("ms_") - F.col("mc_") + F.col("gm"), 2)).alias("sse"), F.first("s").alias("s"), F.first("k").alias("k")
    )
    d1, d2 = F.col("k") - 1, (F.col("k") - 1) * (F.col("s") - 1)
    return r.select(((F.col("ssc") / d1) / (F.col("sse") / d2)).alias("f"), d1.alias("df1"), d2.alias("df2"))


def anova2(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Two-way analysis of cells, ``(effect, ss, df, f)`` for rows, columns and interaction; exact for balanced cells.

    Cell statistics leave the executors' rows behind; what is left is as large as
    the number of cells.
    """
    cell = df.where(F.col(value).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    every = W.partitionBy(F.lit(0))
    mean = lambda w: F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    c = cell.withColumns({"ma": mean(W.partitionBy(a)), "mb": mean(W.partitionBy(b)), "gm": mean(every)})
    s = c.agg(
        F.sum(F.col("n") * F.pow(F.col("ma") - F.col("gm"), 2)).alias("rows"), F.sum(F.col("n") * F.pow(F.col("mb") - F.col("gm"), 2)).alias("columns"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("ma") - F.col("mb") + F.col("gm"), 2)).alias("interaction"), F.sum(F.col("n") * F.col("v")).alias("error"),
        F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"), F.sum("n").alias("n"),
    )
    da, db = F.col("ka") - 1, F.col("kb") - 1
    de = F.col("n") - F.col("ka") * F.col("kb")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("effect"), F.col(n).alias("ss"), d.alias("df"), ((F.col(n) / d) / (F.col("error") / de)).alias("f")) for n, d in (("rows", da), ("columns", db), ("interaction", da * db))]))
    return s.select(rows.alias("r")).select("r.*")


def anova2_repeated(df: DataFrame, subject: str, a: str, b: str, value: str) -> DataFrame:
    """Two-way analysis with repeated measures, ``(effect, ss, df, df_error, f)``: one value for each subject and cell.

    Subjects without a value in every cell are left out. Each effect has its own
    error, its interaction with the subjects.
    """
    y = df.where(F.col(value).isNotNull()).select(F.col(subject).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).cast("double").alias("y"))
    size = y.agg((F.count_distinct("a") * F.count_distinct("b")).alias("cells"))
    full = y.groupBy("s").agg(F.count("*").alias("k")).join(F.broadcast(size)).where("k = cells").select("s")
    d = y.join(full, "s")
    for name, keys in (("ms", ["s"]), ("ma", ["a"]), ("mb", ["b"]), ("msa", ["s", "a"]), ("msb", ["s", "b"]), ("mab", ["a", "b"])):
        d = d.join(y.join(full, "s").groupBy(*keys).agg(F.avg("y").alias(name)), keys)
    d = d.join(F.broadcast(y.join(full, "s").agg(F.avg("y").alias("g"))))
    sq = lambda e: F.sum(F.pow(F.expr(e), 2))
    t = d.agg(
        F.count_distinct("s").alias("n"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), sq("ma - g").alias("rows"), sq("mb - g").alias("columns"), sq("mab - ma - mb + g").alias("interaction"),
        sq("msa - ms - ma + g").alias("rows_e"), sq("msb - ms - mb + g").alias("columns_e"), sq("y - msa - msb - mab + ms + ma + mb - g").alias("interaction_e"),
    )
    da, db = F.col("na") - 1, F.col("nb") - 1
    one = lambda k, dof: F.struct(F.lit(k).alias("effect"), F.col(k).alias("ss"), dof.alias("df"), (dof * (F.col("n") - 1)).alias("df_error"), ((F.col(k) / dof) / F.nullif(F.col(f"{k}_e") / (dof * (F.col("n") - 1)), F.lit(0.0))).alias("f"))
    return t.select(F.explode(F.array(one("rows", da), one("columns", db), one("interaction", da * db))).alias("r")).select("r.*")


def fdr(df: DataFrame, keys: list[str], p: str, q: float, dependent: bool = False, buckets: int = 4096) -> DataFrame:
    """Adds ``significant``: Benjamini-Hochberg, or with ``dependent`` Benjamini-Yekutieli.

    The number of values up to each one is counted by buckets of values: running
    sums over the buckets' totals, and inside a bucket over its distinct values.
    """
    d = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("c_")).withColumn("b_", F.floor(F.col(p) * buckets))
    tot = d.groupBy(*keys, "b_").agg(F.sum("c_").alias("t_"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("t_").over(part.orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tot = tot.withColumns({"before_": before, "m_": F.sum("t_").over(part)}).drop("t_")
    m = F.col("m_").cast("double")
    exact = F.aggregate(F.sequence(F.lit(1), F.least(F.col("m_"), F.lit(100)).cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / k)
    series = F.ln(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * F.pow(m, 4))
    c = F.when(F.col("m_") <= 100, exact).otherwise(series) if dependent else F.lit(1.0)
    j = d.join(tot, [*keys, "b_"])
    upto = F.col("before_") + F.sum("c_").over(W.partitionBy(*keys, "b_").orderBy(p))
    cut = j.withColumn("i_", upto).where(F.col(p) <= F.col("i_") / m * q / c).groupBy(*keys).agg(F.max(p).alias("cut_"))
    out = df.join(cut, keys, "left") if keys else df.join(F.broadcast(cut))
    return out.withColumn("significant", F.coalesce(F.col(p) <= F.col("cut_"), F.lit(False))).drop("cut_")


def seeded_order(key: Column, seed: int | Column) -> Column:
    """A sort key that any engine with MD5 computes alike."""
    return F.md5(F.concat_ws("|", key.cast("string"), (F.lit(seed) if isinstance(seed, int) else seed).cast("string")))


def ranked(df: DataFrame, keys: list[str], part: Column, order: list[Column | str], out: str) -> DataFrame:
    """Adds the place of a row among those of its keys, from 1. ``part`` must not fall where ``order`` rises; a part is sorted at a time.

    What is summed up in order is a row for each part.
    """
    d = df.withColumn("part_", part)
    size = d.groupBy(*keys, "part_").agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(size.select(*keys, "part_", before.alias("before_")), [*keys, "part_"])
    return d.withColumn(out, F.row_number().over(W.partitionBy(*keys, "part_").orderBy(*order)) + F.col("before_")).drop("part_", "before_")


def permuted_labels(df: DataFrame, id_col: str, label: str, replicates: int, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each replicate's rows with the labels dealt anew: ``(replicate, ..., label)``.

    The k-th row by id gets the label of the k-th by a hash of id and replicate, of
    which the first two digits part the rows, so that no replicate is sorted in one
    task. Ids are whole numbers.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    own = ["replicate", *keys]
    by_id = ranked(df, list(keys), F.floor(F.col(id_col) / 65536), [id_col], "k_").select("*", rep)
    mixed = df.select(*keys, id_col, F.col(label).alias("dealt_"), rep).withColumn("h_", seeded_order(F.col(id_col), F.col("replicate") + seed * 100003))
    mixed = ranked(mixed, own, F.substring("h_", 1, 2), ["h_"], "k_").select(*own, "k_", "dealt_")
    return by_id.join(mixed, [*own, "k_"]).drop("k_", label).withColumnRenamed("dealt_", label)


def permutation_test(df: DataFrame, keys: tuple[str, ...], id_col: str, label: str, a: object, b: object, value: str, replicates: int, seed: int = 0, tail: str = "both") -> DataFrame:
    """``(keys, observed, p)``: difference of two groups' means among those of permuted labels."""
    d = df.where(F.col(label).isin(a, b)).select(*keys, id_col, label, value)
    diff = F.avg(F.when(F.col(label) == a, F.col(value))) - F.avg(F.when(F.col(label) == b, F.col(value)))
    sur = permuted_labels(d, id_col, label, replicates, seed, keys).groupBy("replicate", *keys).agg(diff.alias("surrogate"))
    obs = d.groupBy(*keys).agg(diff.alias("observed"))
    j = sur.join(obs, list(keys)) if keys else sur.join(F.broadcast(obs))
    return surrogate_p(j, [*keys, "observed"], "observed", "surrogate", tail)


def bootstrap_rows(df: DataFrame, keys: list[str], id_col: str, replicates: int, seed: int = 0) -> DataFrame:
    """Each replicate draws as many rows as there are, with replacement, by hashed row numbers."""
    n = F.count("*").over(W.partitionBy(*keys))
    d = df.withColumns({"k_": F.row_number().over(W.partitionBy(*keys).orderBy(id_col)), "n_": n})
    draws = d.select(*keys, "k_", "n_", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    pick = F.pmod(F.xxhash64("k_", "replicate", F.lit(seed)), F.col("n_")) + 1
    draws = draws.select(*keys, "replicate", pick.alias("k_"))
    return draws.join(d.drop("n_"), [*keys, "k_"]).drop("k_")


#: Chance of 0, 1, 2 ... in a Poisson distribution of mean 1, summed.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))


def poisson_bootstrap(df: DataFrame, keys: list[str], value: str, row: list[str], replicates: int, seed: int = 11) -> DataFrame:
    """``(keys, replicate, n, mean)``: resampled means without resampling. Rows are read once and none is repeated.

    In a bootstrap of many rows each row is drawn about Poisson(1) times on its own, so
    a hash of ``row``, columns that tell rows apart, and the replicate gives its number,
    and a replicate is two sums. Null values do not count; a replicate that draws no row
    of a key has no mean. Against drawing exactly ``n`` rows, the spread of means differs by about ``1 / n`` of itself.
    """
    d = df.where(F.col(value).isNotNull())
    sums = []
    for r in range(replicates):
        u = (F.xxhash64(*row, F.lit(r), F.lit(seed)) / F.lit(2.0**64)) + 0.5
        times = F.lit(0)
        for p in POISSON:
            times = times + (u >= p).cast("int")
        sums += [F.sum(times).alias(f"n{r}"), F.sum(times * F.col(value)).alias(f"s{r}")]
    wide = d.groupBy(*keys).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(r + 1).alias("replicate"), F.col(f"n{r}").alias("n"), F.col(f"s{r}").alias("s")) for r in range(replicates)]))
    return wide.select(*keys, each.alias("r")).select(*keys, "r.replicate", "r.n", F.when(F.col("r.n") > 0, F.col("r.s") / F.nullif(F.col("r.n"), F.lit(0))).alias("mean"))


def surrogate_p(df: DataFrame, keys: list[str], observed: str, surrogate: str, tail: str = "both") -> DataFrame:
    """p of one observed value among surrogates: ``1 - (rank - 0.5) / n``, the observed one counted in and last among equals."""
    g = df.groupBy(*keys).agg(F.sum((F.col(surrogate) < F.col(observed)).cast("int")).alias("below"), F.sum((F.col(surrogate) == F.col(observed)).cast("int")).alias("equal"), F.count(surrogate).alias("m"))
    rank, n = F.col("below") + F.col("equal") + 1, F.col("m") + 1
    up = 1 - (rank - 0.5) / n
    p = {"right": up, "left": 1 - up, "both": 2 * F.least(up, 1 - up)}[tail]
    return g.select(*keys, p.alias("p"))


def fitted_surrogate_p(df: DataFrame, observed: str, surrogate: str) -> float | None:
    """p of one observed value in the tail of a distribution fitted to the surrogates' moments; None without spread."""
    from ..functions.kernels import lambda_fit, lambda_tail

    m, sd, sk, ku, x = df.agg(F.avg(surrogate), F.stddev_pop(surrogate), F.skewness(surrogate), F.kurtosis(surrogate) + 3, F.first(observed)).first()
    return lambda_tail(x, lambda_fit(m, sd, sk, ku)) if sd else None


def strongest_surrogate(df: DataFrame, replicate: str, statistic: str) -> DataFrame:
    """``(replicate, strongest)``: the largest statistic of all tests in each replicate, against which each test is corrected for their number."""
    return df.groupBy(replicate).agg(F.max(statistic).alias("strongest"))


def surrogate_interval(df: DataFrame, keys: list[str], surrogate: str, alpha: float) -> DataFrame:
    """Order statistics that leave ``round(alpha / 2 * n)`` of the ``n`` surrogates on each side. Null does not count."""

    def ranks(n: Column) -> list[Column]:
        out = F.round(F.lit(alpha / 2) * n)
        return [F.least(n, out + 1), F.greatest(F.lit(1), n - out)]

    got = order_statistics(df.where(F.col(surrogate).isNotNull()), keys, surrogate, ranks)
    return got.select(*keys, F.col("values")[0].alias("lo"), F.col("values")[1].alias("hi"))


def rank_sum(df: DataFrame, keys: list[str], group: str, a: object, b: object, value: str) -> DataFrame:
    """Wilcoxon rank sum with mid-ranks and the normal approximation: ``(keys, w, z)``."""
    d = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    w = W.partitionBy(*keys)
    mid = F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2
    ties = F.count("*").over(W.partitionBy(*keys, value))
    d = d.withColumns({"r_": mid, "t_": F.pow(ties, 2) - 1})
    g = d.groupBy(*keys).agg(F.sum(F.when(F.col(group) == a, F.col("r_"))).alias("w"), F.sum((F.col(group) == a).cast("int")).alias("n1"), F.sum((F.col(group) == b).cast("int")).alias("n2"), F.sum("t_").alias("t"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("t") / (n * (n - 1)))
    return g.where((n1 > 0) & (n2 > 0)).select(*keys, "w", ((F.col("w") - n1 * (n + 1) / 2.0) / F.nullif(F.sqrt(var), F.lit(0.0))).alias("z"))


def qq_points(df: DataFrame, group: str, a: object, b: object, value: str, probs: list[float]) -> DataFrame:
    """``(p, qa, qb)``: quantiles of two samples side by side."""
    q = lambda g, n: hazen_quantiles(df.where(F.col(group) == g), [], value, probs).withColumnRenamed("q", n)
    return q(a, "qa").join(q(b, "qb"), "p")


def inverse_normal(p: float) -> float:
    """Quantile of the standard normal distribution, by bisection of the error function."""
    lo, hi = -9.0, 9.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def d_prime(hits: int, misses: int, false_alarms: int, rejections: int) -> float:
    """Sensitivity, rates kept off 0 and 1 by half a trial."""
    return inverse_normal((hits + 0.5) / (hits + misses + 1)) - inverse_normal((false_alarms + 0.5) / (false_alarms + rejections + 1))


def deterministic_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Adds ``part`` by the hash of a key: the same rows on every run, whole keys together."""
    u = F.conv(F.substring(seeded_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    edge, part = 0.0, F.lit(list(shares)[-1])
    cuts = []
    for name, share in shares.items():
        edge += share
        cuts.append((name, edge))
    for name, e in reversed(cuts[:-1]):
        part = F.when(u < e, F.lit(name)).otherwise(part)
    return df.withColumn("part", part)


def sample_queries(df: DataFrame, key: str, n: int, label: str | None = None, positives: int = 0, seed: int = 0) -> DataFrame:
    """``n`` rows by hashed order, at least ``positives`` of them with label 1."""
    order = [seeded_order(F.col(key), seed), F.col(key)]
    if not label:
        return df.orderBy(*order).limit(n)
    pos = df.where(F.col(label) == 1).orderBy(*order).limit(positives)
    rest = df.join(pos.select(key), key, "left_anti").orderBy(*order).limit(n - positives)
    return pos.unionByName(rest)
