"""URL filtering: host and path rules first, a learned score where no rule fits.

The score is a logistic regression on hashed character trigrams of host and path.
It is trained by full-batch gradient descent from a small labelled table, inside
one row of SQL array functions; scoring is array functions too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ascii_lower

BUCKETS = 1024
STEPS = 150
RATE = 20.0
L2 = 0.0005
#: The labelled table must stay small: it is trained on as one row.
MAX_LABELLED = 10_000

#: (verdict, host, path); a rule is written host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: (url, 1 for block) the default model learns from.
LABELLED = (
    ("https://casino-bonus.example/play/slots", 1), ("http://free-pills.example/buy/cheap", 1), ("https://win-prize.example/click/claim", 1),
    ("http://adserver.example/banner/track", 1), ("https://www.hot-dating.example/join", 1), ("http://torrent-hub.example/download/crack", 1),
    ("https://loan-offer.example/apply/now", 1), ("http://track.pixel.example/ads/click", 1), ("https://betting.example/odds/live", 1),
    ("http://spam-links.example/seo/backlinks", 1), ("https://login-verify.example/account/update", 1), ("http://cheap-watches.example/replica/sale", 1),
    ("https://popunder.example/go/redirect", 1), ("http://xxx-cams.example/live", 1), ("https://crypto-double.example/invest", 1),
    ("http://m.thther.example.org/offer/promo", 1), ("https://clickbait.example/you-wont-believe", 1), ("http://doorway.example/keyword/keyword", 1),
    ("https://www.library.example/catalogue/books", 0), ("http://docs.project.example/guide/install", 0), ("https://news.city.example/local/council", 0),
    ("http://blog.garden.example/en/roses", 0), ("https://wiki.science.example/physics/optics", 0), ("http://www.museum.example/fr/exposition", 0),
    ("https://university.example/courses/history", 0), ("http://recipes.example/bread/sourdough", 0), ("https://www.therth.example.org/en/4251", 0),
    ("http://ththon.example.com/es/7198.html", 0), ("https://blog.tionble.example.com/en/36511", 0), ("http://weather.example/forecast/week", 0),
    ("https://archive.example/records/1901", 0), ("http://school.example/lessons/algebra", 0), ("https://health.gov.example/advice/sleep", 0),
    ("http://music.example/composers/bach", 0), ("https://travel.example/en/mountains", 0), ("http://forum.code.example/question/sorting", 0),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, ties to the smaller rule; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def grams(host: Column, path: Column) -> Column:
    """Buckets of the character trigrams of ``^host$`` and ``^path$``, repeats kept; the two do not share hashes."""

    def of(s: Column, salt: int) -> Column:
        code = F.transform(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), F.ascii)
        # of code points, so that any SQL engine computes the same buckets
        return F.transform(
            F.when(F.size(code) >= 3, F.sequence(F.lit(1), F.size(code) - 2)).otherwise(F.array().cast("array<int>")),
            lambda i: F.pmod(F.element_at(code, i) * 961 + F.element_at(code, i + 1) * 31 + F.element_at(code, i + 2) + salt, F.lit(BUCKETS)),
        )

    return F.concat(of(host, 0), of(path, 517))


def train(labelled: DataFrame) -> list[float]:
    """Weights of the buckets, then the bias, from ``labelled(url, label)``.

    Rows whose label is null are left out, a null url has no grams; an empty table
    gives zeros. The order of rows does not matter beyond rounding.
    """
    host, path = split_url(F.col("url"))
    g = labelled.where("label is not null").select(grams(host, path).alias("g"), F.col("label").cast("double").alias("y"))
    rows = g.agg(F.sort_array(F.collect_list(F.struct("y", "g"))).alias("ex"))
    n = g.count()
    if n > MAX_LABELLED:
        raise ValueError(f"a labelled table of at most {MAX_LABELLED} rows is asked for, not {n}")
    if not n:
        return [0.0] * (BUCKETS + 1)
    ex = rows.select("ex", F.posexplode("ex").alias("e", "x")).select("e", F.explode("x.g").alias("b"), F.size("x.g").alias("k"))
    share = ex.groupBy("b", "e").agg((F.count("*") / F.first("k")).alias("c"))
    lists = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(share, "b", "left")
    lists = lists.groupBy("b").agg(F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e", "c")))).alias("l"))
    both = rows.join(lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "l"))), lambda x: x["l"]).alias("inv")))
    fit = both.selectExpr(f"""
        aggregate(sequence(1, {2 * STEPS}),
          named_struct('w', array_repeat(0D, {BUCKETS}), 'b', 0D, 'r', array_repeat(0D, {n})),
          (s, i) -> if(i % 2 = 1,
            named_struct('w', s.w, 'b', s.b, 'r', transform(ex, x -> 1D / (1D + exp(-(s.b + aggregate(x.g, 0D, (t, j) -> t + element_at(s.w, j + 1)) / greatest(size(x.g), 1)))) - x.y)),
            named_struct('w', transform(s.w, (x, j) -> x - {RATE}D * (aggregate(element_at(inv, j + 1), 0D, (t, p) -> t + element_at(s.r, p.e + 1) * p.c) / {n} + {L2}D * x)),
                         'b', s.b - {RATE / 20}D * aggregate(s.r, 0D, (t, x) -> t + x) / {n}, 'r', s.r)),
          s -> concat(s.w, array(s.b))) AS model""")
    return list(fit.first()[0])


def score(host: Column, path: Column, model: list[float]) -> Column:
    """Log-odds of blocking."""
    w, g = F.lit(model[:-1]), grams(host, path)
    return F.lit(model[-1]) + F.aggregate(g, F.lit(0.0), lambda t, j: t + F.element_at(w, j + 1)) / F.greatest(F.size(g), F.lit(1))


def default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages(page_id, url)`` to ``(page_id, host, path, rule, verdict)``, a row for each row.

    A null url or one without ``://`` has an empty host and path, fits no rule and
    is judged by the bias alone. Extra columns are ignored.
    """
    model = train(labelled if labelled is not None else default_labelled(pages.sparkSession))
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(score(F.col("host"), F.col("path"), model) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
