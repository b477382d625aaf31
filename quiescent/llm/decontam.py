"""Benchmark decontamination by a positional inverted index.

The index is made for the terms of the given benchmark and not kept. It holds a posting ``(term, row, pos)`` for each document token that is a
benchmark term; ``row`` numbers the documents, so that rows without an id or with
the same one stay apart. A benchmark window is looked up from its three rarest terms: their
lists, each shifted by the term's offset in the item, are intersected on
(document, diagonal). On the diagonals that survive, every term of the item is
intersected in the same way, and runs of a window's length or more are the exact
occurrences. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import ascii_lower, broadcast_if_small, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists of a window's rarest terms that are intersected before all others.
ANCHORS = 3


def words(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def item_tokens(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, off, term, n)`` of each item that has words; equal ids stay apart by text."""
    t = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    t = t.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "w")).dropDuplicates(["item"])
    return t.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))


def build_index(docs: DataFrame, terms: DataFrame, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(term, row, pos, doc_id, print)`` for ``terms``, and one of the empty term at each document's end.

    The end posting's position is the document's word count; it alone has the
    document's id and a hash of its text.
    """
    end = F.concat(words(F.col(text_col)), F.array(F.lit("")))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id_"), F.xxhash64(text_col).alias("print_"), end.alias("w_"))
    post = d.select("row", "id_", "print_", F.posexplode("w_").alias("pos", "term"))
    known = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string"))
    last = F.col("term") == ""
    out = post.join(broadcast_if_small(known, n_terms), "term", "left_semi")
    return materialize(out.select("term", "row", "pos", F.when(last, F.col("id_")).alias("doc_id"), F.when(last, F.col("print_")).alias("print")), "postings")


def distinct_windows(tokens: DataFrame, window: int) -> DataFrame:
    """``(item, w, rep_item, rep_w)``: each window of each item, which starts at ``w``, and the first one of the same words."""
    item = tokens.groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("off", "term"))).alias("t"))
    w = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - window))).alias("w")
    own = item.select("item", "t", w).select("item", "w", F.array_join(F.slice("t.term", F.col("w") + 1, window), " ").alias("words"))
    own = own.select("item", "w", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))
    rep = own.groupBy("h1", "h2").agg(F.min(F.struct("item", "w")).alias("rep"))
    return materialize(own.join(rep, ["h1", "h2"]).select("item", "w", F.col("rep.item").alias("rep_item"), F.col("rep.w").alias("rep_w")), "windows")


def diagonals(postings: DataFrame, tokens: DataFrame, n_tokens: int, window: int) -> DataFrame:
    """``(item, row, diag)`` on which a window's rarest terms all stand at their offsets. A window that several items have is looked up once."""
    windows = distinct_windows(tokens, window)
    df = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    known = tokens.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    lag = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - window + 1), F.least(F.col("off"), F.greatest(F.col("n") - window, F.lit(0)))))
    by_window = known.select("item", "term", "off", "n", "df", lag.alias("w"))
    by_window = by_window.join(windows.where("item = rep_item and w = rep_w").select("item", "w"), ["item", "w"], "left_semi")
    rare = W.partitionBy("item", "w").orderBy("df", "off")
    by_window = by_window.withColumns({"rank": F.row_number().over(rare), "least": F.min("df").over(W.partitionBy("item", "w"))})
    anchors = by_window.where(f"rank <= {ANCHORS} and least > 0").select("item", "w", "term", "off", F.least(F.col("n"), F.lit(ANCHORS)).alias("need"))
    hits = postings.select("term", "row", "pos").join(broadcast_if_small(anchors, n_tokens * ANCHORS), "term").withColumn("diag", F.col("pos") - F.col("off"))
    both = hits.groupBy("item", "w", "row", "diag").agg(F.count("*").alias("got"), F.first("need").alias("need")).where("got >= need")
    found = both.select(F.col("item").alias("rep_item"), F.col("w").alias("rep_w"), "row", (F.col("diag") + F.col("w")).alias("start"))
    every = found.join(broadcast_if_small(windows, n_tokens), ["rep_item", "rep_w"])
    return every.select("item", "row", (F.col("start") - F.col("w")).alias("diag")).distinct()


def occurrences(postings: DataFrame, tokens: DataFrame, n_tokens: int, window: int = 10) -> DataFrame:
    """Exact runs ``(item_id, row, start, stop)`` of ``window`` or more words that document and item share.

    An item of fewer words occurs where all of it stands.
    """
    cand = materialize(diagonals(postings, tokens, n_tokens, window), "diagonals")
    hosts = cand.select("row").distinct()
    post = postings.where("term <> ''").select("term", "row", "pos").join(broadcast_if_small(hosts, hosts.count()), "row", "left_semi")
    probe = cand.join(broadcast_if_small(tokens, n_tokens), "item").withColumn("pos", F.col("diag") + F.col("off"))
    met = probe.join(post, ["row", "pos", "term"])
    island = F.col("off") - F.row_number().over(W.partitionBy("item", "row", "diag").orderBy("off"))
    runs = met.withColumn("island", island).groupBy("item", "item_id", "row", "diag", "island", "n").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= F.least(F.lit(window), F.col("n"))).select("item_id", "row", "start", "stop")


def named(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Matches by row with the document's id in the row's place."""
    ids = postings.where("term = ''").select("row", "doc_id")
    return found.join(ids, "row").select("item_id", "doc_id", "start", "stop")


def proximity(postings: DataFrame, tokens: DataFrame, n_tokens: int, slop: int) -> DataFrame:
    """``(item_id, doc_id, start, stop)``: places where all distinct terms of an item stand within ``slop`` more positions than it has words.

    A term that an item repeats is looked for once, so that ``a b a`` is near where
    ``a b`` is within its span; ``start`` is a term's place and ``stop`` stands
    behind the first place by which all have been seen. The rarest term's list is walked; each of its positions is joined with the
    lists of the other terms in the same document, bounded by position buckets.
    """
    df = postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    t = tokens.select("item", "item_id", "n", "term").distinct().join(df, "term")
    size = F.count("*").over(W.partitionBy("item"))
    rank = F.row_number().over(W.partitionBy("item").orderBy("df", "term"))
    t = t.withColumns({"kinds": size, "rank": rank})
    span = F.col("n") + slop
    first = postings.select("term", "row", "pos").join(broadcast_if_small(t.where("rank = 1"), n_tokens), "term").select("item", "item_id", "row", F.col("pos").alias("at"), "kinds", span.alias("span"))
    rest = postings.select("term", "row", "pos").join(broadcast_if_small(t.select("item", "term", span.alias("span")), n_tokens), "term").select("item", "row", "term", "pos", F.floor(F.col("pos") / F.col("span")).alias("b"))
    near = first.withColumn("b", F.explode(F.array(*[F.floor(F.col("at") / F.col("span")) + k for k in (-1, 0, 1)])))
    got = near.join(rest, ["item", "row", "b"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("span"))
    # every start from which one of each term is reached within the span
    starts = got.select("item", "item_id", "row", "at", "kinds", "span", F.col("pos").alias("start")).where("start <= at").distinct()
    full = starts.join(got.select("item", "row", "at", "term", "pos"), ["item", "row", "at"]).where("pos >= start and pos < start + span")
    first_each = full.groupBy("item", "item_id", "row", "at", "kinds", "start", "term").agg(F.min("pos").alias("pos"))
    done = first_each.groupBy("item", "item_id", "row", "kinds", "at", "start").agg(F.count("*").alias("k"), (F.max("pos") + 1).alias("stop")).where("k = kinds")
    return named(postings, done.select("item_id", "row", "start", "stop").distinct())


def judge(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """A row for each document: ``(doc_id, print, n_words, n_hit, ids)``, ids sorted as texts and null where there are none."""
    tokens = materialize(item_tokens(items), "items")
    n = tokens.count()
    terms = materialize(tokens.select("term").distinct(), "terms")
    postings = build_index(docs, terms, terms.count())
    found = materialize(occurrences(postings, tokens, n, window), "found")
    order = W.partitionBy("row").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    spans = found.select("row", "start", "stop").distinct().withColumn("seen", F.coalesce(F.max("stop").over(order), F.lit(0)))
    hit = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    ids = found.groupBy("row").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).alias("ids"))
    total = postings.where("term = ''").select("row", "doc_id", "print", F.col("pos").cast("long").alias("n_words"))
    return total.join(hit.join(ids, "row"), "row", "left").select("doc_id", "print", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "ids")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row for each row.

    Null and wordless texts have no words and no hits, so do all documents where
    ``items`` has no words; the digest of no items is that of the empty text. Each
    row is judged on its own, with or without an id. Extra columns are ignored.
    """
    j = judge(docs, items, window)
    sha = F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256)
    return j.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window occurs, with all their columns; told apart by id and text."""
    bad = materialize(judge(docs, items, window).where("n_hit > 0").select(F.col("doc_id").alias("id_"), F.col("print").alias("print_")).distinct(), "contaminated")
    d = docs.alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("b.id_")) & (F.xxhash64(F.col("d.text")) == F.col("b.print_"))
    return d.join(bad.alias("b"), on, "left_anti")
