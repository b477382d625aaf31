"""Alignment of two tokenizers' pieces over the bytes of texts.

Every byte has an owner in A and one in B: the token it belongs to. Repeating each
token's place once for each of its bytes gives two owner arrays of one length. Where
either owner changes, the pair of owners is a new overlap, a link; where both change,
a cut, at which both tokenizers end a token. Links are counted by their pair of ids
over the corpus, and each document gets the counts of its own.

Both tokenizers end a token before a single space, so the owner arrays are made once
for each distinct stretch between spaces that a worker sees, and documents are sums
over their stretches.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import block_ids, block_rows, give_back, looked_up
from .storage import materialize

#: Where the tokenizers are; parameters of every function that reads them.
PATH_A = "/opt/tokenizers/byte_bpe_50k.json"
PATH_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks that are a word of A behind letters; an apostrophe may not be.
MARKS = ".,;:!?*$&#%"
#: Stretches a worker keeps from block to block, and the characters that are split at a time.
CACHE = 150_000
CHUNK = 1 << 18
#: Characters of text in a block.
SIZE = 3 << 19
#: Blocks of a file, a row of about a MB each; a task that reads it holds them all at once.
FILE_BLOCKS = 16
#: A space that begins a new stretch where a text has runs of spaces: the one behind a character that is no white space.
#: The characters of the Unicode property White_Space.
WHITE = "\t\n\v\f\r \x85\xa0  -     　"
CUT = re.compile(f"(?<=[^{WHITE}])(?= )")


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Two tokenizers: ids and bytes of the tokens of stretches."""

    def __init__(self, path_a: str = PATH_A, path_b: str = PATH_B) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.model = self.a.model
        table = byte_of_char()
        self.spelled = {b: c for c, b in table.items() if ord(c) != b}
        self.blank = self.spelled[0x20]
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        # entries that are no bytes, which no text has
        self.bytes_a = [bytes(table[c] for c in t) if all(c in table for c in t) else b"" for t in (vocabulary.get(i, "") for i in range(max(vocabulary) + 1))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.lone = self.b.piece_to_id("▁")

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids in A and in B of stretches that begin with a space.

        A space with Latin letters is one word of A, and so are the marks behind them:
        both go to the model at once, each of them once.
        """
        a: list[list[int]] = []
        odd: list[int] = []
        tokenize, blank, known = self.model.tokenize, self.blank, {"": []}
        for k, s in enumerate(stretches):
            core = s[1:].rstrip(MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                ids = known.get(core)
                if ids is None:
                    text = blank + (core if core.isascii() else core.encode().decode("latin-1").translate(self.spelled))
                    ids = known[core] = [t.id for t in tokenize(text)]
                tail = s[len(core) + 1 :]
                if tail:
                    more = known.get(tail)  # marks are no letters, so none is a core
                    if more is None:
                        more = known[tail] = [t.id for t in tokenize(tail)]
                    ids = ids + more
                a.append(ids)
            else:
                odd.append(k)
                a.append([])
        for k, e in zip(odd, self.a.encode_batch_fast([stretches[k] for k in odd], add_special_tokens=False), strict=True):
            a[k] = e.ids
        b = [x if s != " " else [self.lone] for s, x in zip(stretches, self.b.encode([s[1:] for s in stretches], num_threads=1), strict=True)]
        return a, b


def owners(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as places in A and in B, and whether each begins a group, of two sequences of token lengths with one sum."""
    a = np.repeat(np.arange(len(lengths_a), dtype=np.int32), lengths_a)
    b = np.repeat(np.arange(len(lengths_b), dtype=np.int32), lengths_b)
    new_a, new_b = np.diff(a, prepend=-1) != 0, np.diff(b, prepend=-1) != 0
    at = np.flatnonzero(new_a | new_b)
    return a[at], b[at], (new_a & new_b)[at]


class Aligner:
    """Distinct stretches with their counts, groups and links, each aligned once."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.place: dict[str, int] = {}
        self.uses = np.zeros(0, np.int64)
        self.counts = array("i")  # tokens of A, of B, groups, links; all -1 where bytes differ
        self.groups: list[str] = []
        self.links: list[bytes] = []

    def used(self, places: np.ndarray, times: np.ndarray) -> None:
        """Count uses of stretches; once there are too many, forget all but those used twice since that was last so."""
        uses = np.zeros(len(self.groups), np.int64)
        uses[: len(self.uses)] = self.uses
        uses[places] += times
        self.uses = uses
        if len(uses) > CACHE:
            at = np.flatnonzero(uses > 1)[:CACHE]
            names, counts, groups, links = list(self.place), np.frombuffer(self.counts, np.int32).reshape(-1, 4)[at], self.groups, self.links
            at = at.tolist()
            self.place = {names[i]: k for k, i in enumerate(at)}
            self.counts, self.groups, self.links = array("i", counts.tobytes()), [groups[i] for i in at], [links[i] for i in at]
            self.uses = np.zeros(len(at), np.int64)

    def flat(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """Numbers of tokens, the tokens one after the other, and whether each stretch's are its bytes in A and in B.

        Bytes are compared as one run: where the runs are equal and the tokens of
        every stretch end where it ends, each of them is equal.
        """
        ends, run, same = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))), b"".join(raw), True
        counts, tokens = [], []
        for ids, own, lengths in ((a, self.pair.bytes_a, self.pair.len_a), (b, self.pair.bytes_b, self.pair.len_b)):
            n, every = np.fromiter(map(len, ids), np.int64, len(ids)), list(chain.from_iterable(ids))
            counts.append(n)
            tokens.append(np.array(every, np.int64))
            upto = np.concatenate([[0], np.cumsum(lengths[tokens[-1]])])
            same = same and np.array_equal(upto[np.cumsum(n)], ends) and b"".join(map(own.__getitem__, every)) == run
        return counts[0], counts[1], tokens[0], tokens[1], same

    def learn(self, new: list[str]) -> None:
        pair, raw = self.pair, [s.encode() for s in new]
        a, b = pair.encode(new)
        good = list(range(len(new)))
        n_a, n_b, ids_a, ids_b, same = self.flat(raw, a, b)
        if not same:
            good = [k for k, s in enumerate(raw) if b"".join([pair.bytes_a[i] for i in a[k]]) == s == b"".join([pair.bytes_b[i] for i in b[k]])]
            n_a, n_b, ids_a, ids_b, _ = self.flat([raw[k] for k in good], [a[k] for k in good], [b[k] for k in good])
        at_a, at_b, cut = owners(self.pair.len_a[ids_a], self.pair.len_b[ids_b])
        keys = (ids_a[at_a] << 32) | ids_b[at_b]
        # a stretch begins where its first token of A does
        first = np.searchsorted(at_a, np.cumsum(n_a) - n_a).tolist() + [len(at_a)]
        starts = np.flatnonzero(cut)
        group = np.searchsorted(starts, first).tolist()
        # tokens of a group are those that begin in it
        from_a, from_b = np.append(at_a[starts], len(ids_a)).tolist(), np.append(at_b[starts], len(ids_b)).tolist()
        text_a, text_b = list(map(pair.names.__getitem__, ids_a.tolist())), list(map(pair.names.__getitem__, ids_b.tolist()))
        said = [
            f"{text_a[i]}|{text_b[k]}" if j - i == 1 and m - k == 1 else f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}"
            for i, j, k, m in zip(from_a, from_a[1:], from_b, from_b[1:], strict=False)
        ]
        raw_keys = keys.tobytes()
        counts = np.full((len(new), 4), -1, np.int32)
        counts[good] = np.stack([n_a, n_b, np.diff(group), np.diff(first)], 1)
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.counts.frombytes(counts.tobytes())
        groups, links = [""] * len(new), [b""] * len(new)
        for k, i, j, m, n in zip(good, group, group[1:], first, first[1:], strict=False):
            groups[k] = ";".join(said[i:j])
            links[k] = raw_keys[8 * m : 8 * n]
        self.groups += groups
        self.links += links

    def split(self, text: str | None) -> list[str]:
        """Stretches of a space and the text. Joined they are the two; each begins with a space."""
        if not text:
            return []
        if text[0] != " " and "  " not in text:
            return [" " + w for w in text.split(" ")]
        return CUT.split(" " + text)

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """The stretches of each text by their place, good until some are forgotten."""
        out, held, size = [], [], 0
        for t in [*texts, ""]:
            held.append(t)
            size += len(t or "")
            if size >= CHUNK or len(out) + len(held) > len(texts):
                parts = [self.split(x) for x in held]
                new = set().union(*parts).difference(self.place)
                if new:
                    self.learn(list(new))
                out += [np.fromiter(map(self.place.__getitem__, p), np.int32, len(p)) for p in parts]
                held, size = [], 0
        return out[: len(texts)]


@cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(Pair(path_a, path_b))


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK = f"block long, docs array<struct<doc_id: {{id}}, n: int, {DOC.replace(' long', ': long').replace(' string', ': string')}>>, stretches binary, n_links binary, links binary, keys array<long>, n array<long>"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, their bytes of one place together. As arrays of Spark they would take a reader several times their size."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(body: bytes) -> np.ndarray:
    n = int.from_bytes(body[:8], "little")
    raw = np.frombuffer(pa.decompress(body[8:], 4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<i4").reshape(-1)


def align_blocks(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B) -> DataFrame:
    """A row for each block: its documents with their number of stretches, the stretches as places in the
    block's distinct ones, those as places in the block's distinct pairs of ids ``keys``, and their counts ``n``. Places are packed."""
    schema = BLOCK.format(id=dict(docs.dtypes)["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for block, (texts, ids) in zip(block_ids(), block_rows(batches, ["text", "doc_id"], SIZE)):  # noqa: B905
            parts = aligner.places(texts)
            lengths = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts)
            counts = np.frombuffer(aligner.counts, np.int32).reshape(-1, 4)[flat]
            of = np.repeat(np.arange(len(parts)), lengths)
            bad = np.bincount(of[counts[:, 0] < 0], minlength=len(parts)) > 0
            sums = np.stack([np.bincount(of, counts[:, c], len(parts)) for c in range(4)], 1).astype(np.int64)
            sums[bad] = 0
            sha = ["" if bad[d] or not len(p) else hashlib.sha256(";".join([aligner.groups[i] for i in p.tolist()]).encode()).hexdigest() for d, p in enumerate(parts)]
            lengths[bad] = 0
            flat = flat[~bad[of]]
            used, inside, times = np.unique(flat, return_inverse=True, return_counts=True)
            raw = [aligner.links[i] for i in used.tolist()]
            n_links = np.array([len(r) // 8 for r in raw], np.int64)
            aligner.used(used, times)
            keys, place = np.unique(np.frombuffer(b"".join(raw), np.int64), return_inverse=True)
            n = np.bincount(place, np.repeat(times, n_links), len(keys)).astype(np.int64)
            rows = [{"doc_id": i, "n": k, "n_a": s[0], "n_b": s[1], "n_groups": s[2], "n_links": s[3], "groups_sha256": h} for i, k, s, h in zip(ids, lengths.tolist(), sums.tolist(), sha, strict=True)]
            one = {"block": block, "docs": rows, "stretches": packed(inside), "n_links": packed(n_links), "links": packed(place), "keys": keys, "n": n}
            yield pa.RecordBatch.from_pylist([one], schema=kinds)
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pairs(key, n)`` to ``(key, a, b, n, best)``: links by pair of ids, and whether no other A of the same B has more."""
    total = pairs.groupBy("key").agg(F.sum("n").alias("n"))
    b = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    # a B id has at most as many partners as A has ids
    total = total.select("key", F.shiftright("key", 32).alias("a"), b.alias("b"), "n")
    return total.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b")))


def align(docs: DataFrame, path_a: str = PATH_A, path_b: str = PATH_B) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for each row.

    Texts that are null or empty, or whose joined tokens are not a space and the text in
    A or in B, have no tokens: all counts 0 and an empty digest. Ids may be null or
    repeat; extra columns are ignored; an empty table gives an empty one. Equal texts
    count as often as they stand.
    """
    base = materialize(align_blocks(docs, path_a, path_b), "aligned", FILE_BLOCKS)
    pairs = base.select("block", F.posexplode(F.arrays_zip("keys", "n")).alias("pos", "p")).select("block", "pos", F.col("p.keys").alias("key"), F.col("p.n").alias("own"))
    totals = materialize(pair_counts(pairs.select("key", F.col("own").alias("n"))), "pairs")
    found = looked_up(pairs, totals, ["key"], ["n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                col = {c: batch[c][r].values for c in ("docs", "found")}
                inside, n_links, links = (unpacked(batch[c][r].as_py()) for c in ("stretches", "n_links", "links"))
                out = [col["docs"].field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                size = 0 if col["found"] is None else len(col["found"])
                n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                if size:
                    pos = np.asarray(col["found"].field("pos"))
                    n[pos] = np.asarray(col["found"].field("n"))
                    best[pos] = np.asarray(col["found"].field("best").cast(pa.int64()))
                ends = np.concatenate([[0], np.cumsum(n_links, dtype=np.int64)])
                last = np.concatenate([[0], np.cumsum(np.asarray(col["docs"].field("n"), dtype=np.int64))])
                for values in (best, n):
                    upto = np.concatenate([[0], np.cumsum(values[links])])
                    own = upto[ends[1:]] - upto[ends[:-1]]
                    upto = np.concatenate([[0], np.cumsum(own[inside])]) if len(inside) else np.zeros(1, np.int64)
                    out.append(pa.array(upto[last[1:]] - upto[last[:-1]]))
                yield pa.RecordBatch.from_arrays([*out, col["docs"].field("groups_sha256")], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    joined = base.select("block", "docs", "stretches", "n_links", "links").join(found, "block", "left")
    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
