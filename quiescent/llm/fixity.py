"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

A leaf is a record's digest, offset and length. Leaves are hashed together by
ranges of offsets, ranges by wider ranges, up to a root for each archive file. Two
replicas are compared root against root; only the branches of differing nodes are
descended, so that the records that get compared one by one are those in damaged
ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

#: Bytes of offsets under a node of the lowest level, and ranges under a node of the next.
RANGE_BYTES = 1 << 16
FANOUT = 16
#: Levels of ranges below the root.
LEVELS = 3
PAGES_PER_FILE = 1000


#: Headers whose content the tables do not hold.
DATE, CONTENT = "1970-01-01T00:00:00Z", "application/http; msgtype=response"
#: Bytes of a record that a damaged replica has behind its last one.
TWIN = "WARC/1.0 a record too many"


def to_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to WARC response records ``(file, page_id, record)``.

    A file holds the pages of a run of ids. Pages without an id are dealt to files
    -1, -2, ... by the hash of their record, about as many to each. Null urls and
    bodies are written empty. Extra columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    lines = (
        F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", F.lit(""))), F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {CONTENT}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")), F.lit(""), html, F.lit(""), F.lit(""),
    )
    spare = max(1, -(-pages.where("page_id is null").count() // PAGES_PER_FILE))
    out = pages.select("page_id", F.concat_ws("\r\n", *lines).alias("record"))
    dealt = -1 - F.conv(F.substring(F.sha2("record", 256), 1, 8), 16, 10).cast("long") % spare
    return out.select(F.coalesce(F.floor(F.col("page_id") / PAGES_PER_FILE).cast("long"), dealt).alias("file"), "page_id", "record")


def manifest(records: DataFrame) -> DataFrame:
    """``(file, offset, length, digest, page_id, last)`` of records' bytes, which are hashed here.

    Records of a file stand by page_id, then digest, or by a column ``mark`` if they
    have one; ``last`` is the last one.
    """
    mark = [c for c in records.columns if c == "mark"]
    m = records.select("file", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *mark)
    order = W.partitionBy("file").orderBy(*(mark or [F.col("page_id").asc_nulls_first(), "digest"]))
    before = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1))
    last = F.lead(F.lit(1)).over(order).isNull()
    return m.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "digest", "page_id", last.alias("last"))


@dataclass
class Tree:
    """Nodes ``(file, level, node, hash)``; level 0 is records, the root's level is ``LEVELS + 1`` and its node 0."""

    records: DataFrame
    nodes: DataFrame


def build(entries: DataFrame) -> Tree:
    """The trees of all files of a manifest, written once."""
    entries = materialize(entries, "manifest")
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    node = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
    cur = entries.select("file", node.alias("node"), F.struct("offset", leaf.alias("hash")).alias("c"))
    levels: list[DataFrame] = []
    for level in range(1, LEVELS + 2):
        hashes = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["hash"]), "")
        nodes = materialize(cur.groupBy("file", "node").agg(F.sha2(hashes, 256).alias("hash")).select("file", F.lit(level).alias("level"), "node", "hash"), "nodes")
        levels.append(nodes)
        up = F.floor(F.col("node") / FANOUT).cast("long") if level < LEVELS else F.lit(0).cast("long")
        cur = nodes.select("file", up.alias("node"), F.struct(F.col("node").alias("offset"), "hash").alias("c"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return Tree(entries, out)


def _differ(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys whose hashes are unlike or that one side lacks."""
    j = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), on, "full")
    return j.where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(a: Tree, b: Tree) -> DataFrame:
    """``(file, root_a, root_b, status, offset, length_a, length_b, digest_a, digest_b, page_id)``.

    A file whose roots agree has one row, ``intact``. Else there is a row for each
    record that is ``corrupt`` (another digest or length at the offset), ``missing``
    from b or ``extra`` in it. Empty manifests have no files.
    """

    def at(t: Tree, level: int) -> DataFrame:
        return t.nodes.where(F.col("level") == level).select("file", "node", "hash")

    roots = at(a, LEVELS + 1).select("file", F.col("hash").alias("root_a")).join(at(b, LEVELS + 1).select("file", F.col("hash").alias("root_b")), "file", "full")
    bad = materialize(_differ(at(a, LEVELS + 1), at(b, LEVELS + 1), ["file", "node"]).select("file", "node"), "branches")
    for level in range(LEVELS, 0, -1):
        up = F.floor(F.col("node") / FANOUT).cast("long") if level < LEVELS else F.lit(0).cast("long")
        under = bad.withColumnRenamed("node", "parent")
        left, right = ((at(t, level).withColumn("parent", up).join(under, ["file", "parent"], "left_semi").select("file", "node", "hash")) for t in (a, b))
        bad = materialize(_differ(left, right, ["file", "node"]).select("file", "node"), "branches")
    pick = [
        t.records.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(bad, ["file", "node"], "left_semi")
        .select("file", "offset", F.col("length").alias(f"length_{x}"), F.col("digest").alias(f"digest_{x}"), F.col("page_id").alias(f"page_{x}"))
        for t, x in ((a, "a"), (b, "b"))
    ]
    rec = pick[0].join(pick[1], ["file", "offset"], "full").where("not (digest_a <=> digest_b and length_a <=> length_b)")
    status = F.when(F.col("digest_b").isNull(), F.lit("missing")).when(F.col("digest_a").isNull(), F.lit("extra")).otherwise(F.lit("corrupt"))
    rec = rec.withColumn("status", status)
    out = roots.join(rec, "file", "left")
    return out.select(
        "file", "root_a", "root_b", F.coalesce("status", F.lit("intact")).alias("status"), "offset", "length_a", "length_b", "digest_a", "digest_b",
        F.coalesce("page_a", "page_b").alias("page_id"),
    )


def damaged_copy(records: DataFrame) -> DataFrame:
    """The manifest of a second replica with known damage, for tables that hold one copy. It is taken from the replica's own bytes.

    The first byte of a record whose digest starts with ``00`` is another one, one
    with ``01`` is overwritten by blanks. Of five files one has a record too many at
    its end and one has lost its last.
    """
    digest = F.sha2("record", 256)
    record = F.when(F.col("digest").startswith("00"), F.concat(F.lit("#"), F.expr("substring(record, 2)")))
    record = record.when(F.col("digest").startswith("01"), F.repeat(F.lit(" "), F.octet_length("record"))).otherwise(F.col("record"))
    own = records.withColumn("digest", digest).select("file", "page_id", record.alias("record"), F.struct(F.lit(0).alias("tail"), "page_id", "digest").alias("mark"))
    twin = records.where("file % 5 = 0").select("file").distinct().withColumn("page_id", F.lit(None).cast(own.schema["page_id"].dataType))
    twin = twin.select("file", "page_id", F.lit(TWIN).alias("record"), F.struct(F.lit(1).alias("tail"), "page_id", F.lit("").alias("digest")).alias("mark"))
    return manifest(own.unionByName(twin)).where("not (file % 5 = 1 and last)")
