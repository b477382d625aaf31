"""Near-duplicate lines by a segment-partition edit join.

A line is cut into ``tau + 1`` segments. Two lines within ``tau`` edits share a
segment, at positions that differ by no more than the edits to its left and right
allow. Each line is indexed under its own segments and probed with the substrings
that can match segments of lines up to ``tau`` characters shorter. Lines that meet
under a key are verified by a banded bit-parallel edit distance.

Equal lines are one line from the start, so copies never multiply pairs; keys under
which many different lines meet are verified tile by tile.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import handed_back
from .components import components, stars
from .storage import broadcast_if_small, discard, materialize

TAU = 2
#: By default shorter lines link only to equal ones: at this length the edits allowed are an eighth of it.
MIN_LENGTH = 8 * TAU
#: As ``min_length``: every line links.
ALL_LENGTHS = 1
#: Lines of a key that are verified together.
TILE = 256
#: What is not part of a line at its ends.
BLANK = " \t\r\x0b\x0c"
#: Seed of the hash that a line is known by, as the SQL function has it; a seed no segment has; a hash without its last bit; to signed.
SEED, CHARACTER, EVEN, HALF = 42, 1 << 62, (1 << 64) - 2, 1 << 63
#: Lines that a worker leaves out as seen, key plans it keeps, and keys it gives at once.
SEEN, PLANS, GIVE = 200_000, 5_000, 1 << 16


def edit_distance(a: str, b: str, tau: int) -> int:
    """Levenshtein distance where it is at most ``tau``, else ``tau + 1``.

    Bit b of the vectors is row ``j - tau + b`` of column j: only the band of
    ``2 tau + 1`` diagonals is kept, and it moves down one row with each column.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > tau:
        return tau + 1
    width = 2 * tau + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down = mask & ~((1 << tau) - 1), 0
    dist, most = min(tau, m), 2 * tau - (m - n)
    for j in range(1, n + 1):
        shift = j - 1 - tau
        same = at.get(b[j - 1], 0)
        same = (same >> shift if shift >= 0 else same << -shift) & mask
        diag = ((((same & up) + up) ^ up) | same | down) & mask
        plus, minus = (down | ~(diag | up)) & mask, diag & up
        if j + tau <= m:
            dist += not diag & top
            if dist > most:
                return tau + 1
        else:
            bit = 1 << (m - j + tau)
            dist += bool(plus & bit) - bool(minus & bit)
        up = (minus | ~((diag >> 1) | plus)) & mask
        down = (diag >> 1) & plus
    return min(dist, tau + 1)


def trimmed_distance(a: str, b: str, tau: int) -> int:
    """:func:`edit_distance` of what is left without the common start and end."""
    n = min(len(a), len(b))

    def shared(same: object) -> int:
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if same(mid) else (lo, mid - 1)  # type: ignore[operator]
        return lo

    p = shared(lambda k: a[:k] == b[:k])
    a, b, n = a[p:], b[p:], n - p
    s = shared(lambda k: not k or a[-k:] == b[-k:])
    return edit_distance(a[: len(a) - s], b[: len(b) - s], tau)


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, end) of the ``tau + 1`` segments of a line of ``length`` characters; longer ones last."""
    short, extra = divmod(length, tau + 1)
    starts = [i * short + max(0, i - (tau + 1 - extra)) for i in range(tau + 2)]
    return list(zip(starts, starts[1:], strict=False))


class Keys:
    """Keys of lines, the signed 64-bit hashes under which they meet. The last bit of a key is 0 where the line is indexed, 1 where it only probes."""

    def __init__(self, tau: int, min_length: int) -> None:
        self.tau, self.min_length = tau, min_length
        self.plans: dict[int, list[tuple[int, int, int, int]]] = {}

    def plan(self, length: int) -> list[tuple[int, int, int, int]]:
        """(seed, start, end, last bit) of the substrings of a line of ``length`` characters."""
        tau, out = self.tau, []
        if length > tau:
            out = [(length * (tau + 1) + i, s, e, 0) for i, (s, e) in enumerate(segments(length, tau))]
            for less in range(tau + 1):
                if length - less <= tau:  # those are met by their characters
                    break
                for i, (s, e) in enumerate(segments(length - less, tau)):
                    # fewer than i + 1 edits before the segment, so a shift of at most i; the rest after it
                    lo, hi = max(-i, less - (tau - i)), min(i, less + (tau - i))
                    out += [((length - less) * (tau + 1) + i, s + d, e + d, 1) for d in range(lo, hi + 1) if (less or d) and s + d >= 0 and e + d <= length]
        if length <= 2 * tau:  # a line of at most tau characters is near to others of its kind, and to longer ones only with a character in common
            out += [(CHARACTER, i, i + 1, int(length > tau)) for i in range(length)]
            out += [(CHARACTER, 0, 0, 0)] * (length <= tau)
        return out

    def of(self, line: str) -> list[int]:
        n = len(line)
        if n < self.min_length:
            return []
        plan = self.plans.get(n)
        if plan is None:
            if len(self.plans) > PLANS:
                self.plans.clear()
            plan = self.plans[n] = self.plan(n)
        hashed = xxhash.xxh64_intdigest
        raw = line.encode("utf-8", "surrogatepass")
        if len(raw) == n:
            return [(hashed(raw[s:e], seed) & EVEN | bit) - HALF for seed, s, e, bit in plan]
        return [(hashed(line[s:e].encode("utf-8", "surrogatepass"), seed) & EVEN | bit) - HALF for seed, s, e, bit in plan]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: str) -> Column:
    return F.btrim(line, F.lit(BLANK))


def key_rows(docs: DataFrame, tau: int, min_length: int) -> DataFrame:
    """``(key, line)``: the keys of all lines that are not blank. A line is known by the XXH64 of its text.

    A worker leaves out lines that it has seen lately, so repeats cost little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Keys(tau, min_length), set()
        out: list[int] = []
        line: list[int] = []
        count: list[int] = []

        def give() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(np.array(out, np.int64)), pa.array(np.repeat(np.array(line, np.uint64).view(np.int64), count))], ["key", "line"])
            out.clear(), line.clear(), count.clear()
            return got

        for b in batches:
            for text in b["text"].to_pylist():
                for x in (text or "").split("\n"):
                    x = x.strip(BLANK)
                    if not x:
                        continue
                    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED)
                    if h in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    k = set(keys.of(x))
                    if k:
                        out += k
                        line.append(h)
                        count.append(len(k))
                    if len(out) >= GIVE:
                        yield give()
        yield give()

    return docs.select("text").mapInArrow(handed_back(run), "key long, line long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, line)`` sorted by both, so that indexed lines come first, to those of keys under which different lines meet, one of them indexed.

    Of the key that may go on in the next batch no more is held than the rows of one line.
    """
    on, state = None, ""  # the key of the last row, and whether it is given, dropped or held so far
    held = (np.empty(0, np.int64), np.empty(0, np.int64))

    def give(key: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(line), pa.array(key & 1 == 0)], ["key", "line", "indexed"])

    for b in batches:
        key, line = b["key"].to_numpy(), b["line"].to_numpy()
        if state == "held":
            key, line = np.concatenate([held[0], key]), np.concatenate([held[1], line])
        elif state and len(key) and key[0] >> 1 == on:
            n = int(np.searchsorted(key >> 1, on, "right"))
            if state == "given":
                yield give(key[:n], line[:n])
            key, line = key[n:], line[n:]
        if not len(key):
            continue
        half = key >> 1
        new = np.concatenate([[True], half[1:] != half[:-1]])
        at, group = new.nonzero()[0], np.cumsum(new) - 1
        met = (key[at] & 1 == 0) & (np.minimum.reduceat(line, at) != np.maximum.reduceat(line, at))
        keep = met[group]
        if keep.any():
            yield give(key[keep], line[keep])
        on, state = half[-1], "given" if met[-1] else "dropped" if key[at[-1]] & 1 else "held"
        if state == "held":
            rest = key[at[-1] :]
            held = (np.unique(rest), np.repeat(line[-1], len(np.unique(rest))))


def _verify(tau: int, min_length: int) -> object:
    """Tile pairs sorted by key to ``(a, b, links)``: counts of verified links of line a (b null), and links that span them (links null)."""
    keys = Keys(tau, min_length)

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int | None, int | None]]:
        key, ta, tb = rows[0][:3]
        own = []  # (line, text, indexed here, keys, those it is indexed under)
        for _, _, _, tile, line, indexed, text in rows:
            k = keys.of(text)
            own.append((tile, line, text, indexed, {x >> 1 for x in k}, {x >> 1 for x in k if not x & 1}))
        one = [r for r in own if r[0] == ta]
        two = one if ta == tb else [r for r in own if r[0] == tb]
        links: dict[int, int] = {}
        a: list[int] = []
        b: list[int] = []
        indexed_two = [k for k, y in enumerate(two) if y[3]]
        for i, (_, line, text, indexed, every, index) in enumerate(one):
            after = i + 1 if ta == tb else 0
            for _, line2, text2, _, every2, index2 in two[after:] if indexed else [two[k] for k in indexed_two[bisect_left(indexed_two, after) :]]:
                if line == line2 or abs(len(text) - len(text2)) > tau:
                    continue
                # a pair that meets under several keys counts under the smallest
                if min((index & every2) | (index2 & every)) != key:
                    continue
                if trimmed_distance(text, text2, tau) <= tau:
                    links[line] = links.get(line, 0) + 1
                    links[line2] = links.get(line2, 0) + 1
                    a.append(line)
                    b.append(line2)
        for k, v in links.items():
            yield k, None, v
        if a:
            for k, v in zip(*stars(np.array(a), np.array(b)), strict=True):
                yield int(k), int(v), None

    def table(found: list[tuple]) -> pa.RecordBatch:
        cols = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and r[:3] != rows[0][:3]:
                    out += compare(rows)
                    rows = []
                rows.append(r)
            yield table(out)
        yield table(list(compare(rows)) if rows else [])

    return run


def edit_join(docs: DataFrame, tau: int, min_length: int) -> DataFrame:
    """``(a, b, links)`` of :func:`_verify` for all distinct lines within ``tau`` edits of each other.

    Only lines that meet another one are fetched from the documents again; a key's
    lines are compared by pairs of tiles, so that no task holds them all.
    """
    half = F.shiftright("key", 1)
    met = key_rows(docs, tau, min_length).repartition(half).sortWithinPartitions("key", "line").mapInArrow(handed_back(_meetings), "key long, line long, indexed boolean")
    met = materialize(met.groupBy("key", "line").agg(F.max("indexed").alias("indexed")), "meetings")
    size = met.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = met.join(size, "key").withColumn("tile", F.pmod(F.xxhash64("line"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = tiled.select("key", "line", "indexed", "tile", other.alias("o")).select("key", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"), "tile", "line", "indexed")
    ids = materialize(met.select(F.col("line").alias("id_")).distinct(), "candidates")
    text = docs.select(F.explode(split_lines(F.col("text"))).alias("text")).select(_trimmed("text").alias("text")).where("text <> ''").withColumn("line", F.xxhash64("text"))
    text = text.join(broadcast_if_small(ids, ids.count()), F.col("line") == F.col("id_"), "left_semi").groupBy("line").agg(F.first("text").alias("text"))
    full = tiled.join(text, "line").select("key", "ta", "tb", "tile", "line", "indexed", "text")
    out = materialize(full.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb").mapInArrow(handed_back(_verify(tau, min_length)), "a long, b long, links long"), "line-links")
    discard(met)
    discard(ids)
    return out


def _occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, line_no, h1, h2)`` of all lines that are not blank; ``print`` tells rows of one id apart by their texts."""
    line = docs.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    line = line.select("doc_id", "print", "line_no", _trimmed("line").alias("line")).where("line <> ''")
    return line.select("doc_id", "print", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _classes(docs: DataFrame, tau: int, min_length: int) -> DataFrame:
    """``(h1, h2, rep, class_size, n_links)`` of lines that stand more than once or have links; ``rep`` is the first place (doc_id, line_no, print)."""
    found = edit_join(docs, tau, min_length)
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "node")
    # every linked line has a count; the smallest of a component has no row in components
    linked = materialize(links.join(components(found.where("b is not null").select("a", "b")), "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("class")), "linked")
    discard(found)
    lines = _occurrences(docs).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "print")).alias("f"), F.count("*").alias("n"))
    of = lines.join(broadcast_if_small(linked, linked.count()), F.col("h1") == F.col("node"), "left").where("n > 1 or node is not null")
    of = materialize(of.select("h1", "h2", "n", "f", F.coalesce("class", "h1").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-classes")
    reps = of.groupBy("class").agg(F.min("f").alias("rep"), F.sum("n").alias("class_size"))
    out = materialize(of.join(reps, "class").select("h1", "h2", "rep", "class_size", "n_links"), "line-classes")
    discard(linked)
    discard(of)
    return out


def _is_first() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("line_no") == F.col("rep.line_no")) & (F.col("print") == F.col("rep.print"))


def line_classes(docs: DataFrame, tau: int = TAU, min_length: int | None = None) -> DataFrame:
    """A row for each line that is not blank: ``(doc_id, line_no, rep_doc_id, rep_line_no, n_links, class_size, kept)``.

    Lines are parted by line feeds and counted from 0. A class is all lines that
    reach each other through links of at most ``tau`` edits; its representative is
    its first line by (doc_id, line_no), the one line that is kept. ``n_links``
    counts the other different lines within ``tau`` edits, ``class_size`` the lines
    of the class with repeats. Lines of under ``min_length`` characters, 8 tau by
    default, link to none but equal ones. Null and blank texts have no rows. A null
    doc_id comes before all others. Rows that repeat an id are told apart by their
    texts (ties of their places go to the smaller hash); rows equal in both are one
    place, so that their lines are kept or not alike. In links a line is known by a
    64-bit hash, as equal by 128 bits.
    """
    min_length = 8 * tau if min_length is None else min_length
    docs = docs.select("doc_id", "text")
    known = _classes(docs, tau, min_length)
    out = _occurrences(docs).join(broadcast_if_small(known, known.count()), ["h1", "h2"], "left")
    alone = F.col("rep").isNull()
    return out.select(
        "doc_id", "line_no", F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("rep_doc_id"), F.coalesce("rep.line_no", "line_no").alias("rep_line_no"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | _is_first()).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, tau: int = TAU, min_docs: int = 2, copies: bool = True) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, where the class stands in ``min_docs`` documents or more.

    The first line of each class stays; with ``min_docs`` of 1 repeats inside one
    document go too. A document that had lines and loses them all is a copy of
    others and goes; all other documents stay, with all columns. With ``copies``
    False documents of equal text count as one and lose the same lines, so that they
    are left, as copies still, to who drops copies. Rows that repeat an id are told
    apart by their texts.
    """
    known = _classes(docs.select("doc_id", "text"), tau, 8 * tau)
    lines = _occurrences(docs.select("doc_id", "text")).join(broadcast_if_small(known, known.count()), ["h1", "h2"])
    if not copies:
        prints = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
        firsts = materialize(prints.groupBy("t1", "t2").agg(F.min(F.struct("doc_id")).alias("f"), F.count("*").alias("n")).select(F.col("f.doc_id").alias("first_"), "t1", "t2", "n"), "text-firsts")
        # a document whose text stands once is its own first
        again = firsts.where("n > 1").select("first_", "t1")
        lines = lines.join(broadcast_if_small(again, again.count()), F.col("print") == F.col("t1"), "left")
        lines = lines.where(F.col("t1").isNull() | F.col("doc_id").eqNullSafe(F.col("first_"))).drop("first_", "t1")
    if min_docs > 1:
        lines = materialize(lines.select("doc_id", "print", "line_no", "rep"), "line-decisions")
        spread = lines.select("rep", "doc_id", "print").distinct().groupBy("rep").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        spread = spread.select(F.col("rep.doc_id").alias("r1"), F.col("rep.line_no").alias("r2"), F.col("rep.print").alias("r3"))
        same = F.col("rep.doc_id").eqNullSafe(F.col("r1")) & (F.col("rep.line_no") == F.col("r2")) & (F.col("rep.print") == F.col("r3"))
        lines = lines.join(spread, same, "left_semi")
    drop = lines.where(~_is_first()).groupBy(F.col("doc_id").alias("of_"), F.col("print").alias("p_")).agg(F.collect_set("line_no").alias("drop_"))
    here = (F.xxhash64("d.text") == F.col("x.p_")) & F.col("d.doc_id").eqNullSafe(F.col("x.of_"))
    if not copies:
        drop = drop.join(firsts, F.col("of_").eqNullSafe(F.col("first_")) & (F.col("p_") == F.col("t1"))).select("t1", "t2", "drop_")
        here = (F.xxhash64("d.text") == F.col("x.t1")) & (F.xxhash64(F.lit(1), "d.text") == F.col("x.t2"))
    j = docs.alias("d").join(drop.alias("x"), here, "left")
    kept = F.filter(split_lines(F.col("d.text")), lambda x, i: ~F.array_contains(F.col("x.drop_"), i))
    text = F.when(F.col("x.drop_").isNull(), F.col("d.text")).otherwise(F.array_join(kept, "\n"))
    gone = F.col("x.drop_").isNotNull() & (F.btrim(text, F.lit(" \t\r\n\x0b\x0c")) == "")
    return j.where(~gone).select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
