"""Token files, alignment and collocations against plain versions."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import struct
import tempfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiescent.llm import alignment, blocks, collocations, tokenfile
from quiescent.llm.oracles import ORACLES
from quiescent.llm.queries import QUERIES

ODD = ["", " ", "a", "don't, won't!", "  two  blanks ", "a\n\nb", "a \n b\t\tc", "ÄÖÜ straße, naïve…", "日本語 テキスト。", "x<|endoftext|>y <|ENDOFTEXT|> z", "1234,567.89", "a  b  c", "été ́x", "word▁word", "tab\tend ", "\x00\x01 b", "I'LL 'S 's' ''s", "<0x0A> [UNK]", "🙂🙂 ok", "a　  b c", "\r\n\r\n", "..." * 50 + "a" * 300, "ﬁne ½ ² ١٢٣", "﻿bom end"]
PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'s", "'", ".", ",,", "a", "Über", "the", "12", "é", "é", "日", " ", "▁", "<|endoftext|>", "🙂", "!?", " ", "Don't"]), max_size=14).map("".join)


# ---------------------------------------------------------------- 11


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.MODEL_PATH)


@pytest.fixture(scope="module")
def encoder():
    return tokenfile.WordEncoder(tokenfile.MODEL_PATH)


def plain_ids(tok, texts):
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_words_are_encoded_alone(word_bpe, encoder, spark, sf):
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]]
    assert encoder.encode(texts) == plain_ids(word_bpe, texts)
    assert encoder.encode([None, "", "a" * 200]) == [b"", b"", *plain_ids(word_bpe, ["a" * 200])]
    assert "a" * 200 not in encoder.known


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_any_words(word_bpe, encoder, text):
    assert encoder.encode([text]) == plain_ids(word_bpe, [text])


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file(spark, odd, word_bpe, encoding):
    folder = tempfile.mkdtemp() + "/f"
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")).repartition(5)
    tokenfile.write_tokens(docs, folder, encoding=encoding)
    got = tokenfile.read_tokens(spark, folder).orderBy("start").collect()
    rows = docs.collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    want = defaultdict(list)
    for r, e in zip(rows, word_bpe.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        want[r.doc_id].append([*e.ids, 2])
    have, at = defaultdict(list), 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        have[r.doc_id].append(r.ids)
        at += r.n_tokens
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    meta = tokenfile.read_metadata(spark, folder)
    assert sorted(meta.collect(), key=lambda r: r.start) == [r[:3] for r in got]
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    stream = [i for r in got for i in r.ids]
    for a, b in ((0, 1), (7, 7), (5, 900), (at - 3, at + 50), (at, at + 1)):
        span = tokenfile.read_span(spark, folder, a, b).orderBy("start").collect()
        assert [i for r in span for i in r.ids] == stream[a:b] and all(stream[r.start : r.start + len(r.ids)] == r.ids for r in span)
    some = tokenfile.read_tokens(spark, folder, F.col("doc_id") >= 110)
    assert some.count() == len(ODD) - 10 and "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,110)" in some._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(part), ", "")
    col = next(c for f in glob.glob(f"{folder}/tokens/*.parquet") for g in [pq.ParquetFile(f).metadata] if g.num_rows for c in [g.row_group(0).column(4)])
    assert ("DELTA_BINARY_PACKED" in col.encodings) == (encoding == "delta") and col.has_dictionary_page == (encoding == "dictionary") and col.has_column_index and col.has_offset_index


def test_row_groups_and_pages_are_bounded(spark):
    folder = tempfile.mkdtemp() + "/f"
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["sun", "moon", "rain", "wind", "snow"]) for _ in range(900))) for i in range(1500)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        tokenfile.write_tokens(docs, folder, encoding="delta", row_group=256 << 10, page=8 << 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    meta = pq.ParquetFile(glob.glob(f"{folder}/tokens/*.parquet")[0]).metadata
    assert meta.num_row_groups > 2 and max(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)) < 2 * (256 << 10)


def test_many_rows_of_one_id(spark):
    folder = tempfile.mkdtemp() + "/f"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_tokens(spark.range(4000).selectExpr("1L as doc_id", "'one and the same' as text").repartition(4), folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = spark.read.parquet(f"{folder}/tokens").groupBy("part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 3000
    assert tokenfile.read_metadata(spark, folder).agg(F.countDistinct("start"), F.max("start")).first()[:] == (4000, 3999 * 5)


def test_token_query(spark, sf, word_bpe, empty):
    got = {r.doc_id: r for r in QUERIES["op11_tokenfile"](spark, sf).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        raw = plain_ids(word_bpe, [r.text])[0] + struct.pack("<I", 2)
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert tokenfile.token_digests(empty).count() == 0


# ---------------------------------------------------------------- 12


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair()


def plain_tokens(pair, text):
    """Ids and bytes in A and B of a whole text; none where they do not spell it."""
    if not text:
        return [], []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    a, b = [(i, pair.bytes_a[i]) for i in a], [(i, pair.bytes_b[i]) for i in b]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def plain_alignment(pair, texts):
    docs, counts = [], Counter()
    for t in texts:
        spans = []
        for side in plain_tokens(pair, t):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(own)
        a, b = spans
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, s = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, x, _ in a if s <= x < e) + "|" + ",".join(str(i) for i, x, _ in b if s <= x < e))
            s = e
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        counts.update(links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(na, nb, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for na, nb, g, ls, sha in docs]


def as_rows(df):
    return sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment(spark, pair, monkeypatch):
    rnd = random.Random(12)
    texts = [*ODD, None, *["".join(rnd.choice(["ab", " ", "é", "Zeit", "the ", "\n", "12", ", ", "  "]) for _ in range(rnd.randrange(1, 60))) for _ in range(150)], "x" * 3000, "the end " * 500]
    texts += texts[:40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("key", F.lit(1)).withColumn("block", F.lit(2))
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df).collect()}
    want = plain_alignment(pair, texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) >= 4 and sum(w[0] > 0 for w in want) > 150


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_any_stretches(pair, text):
    a, b = plain_tokens(pair, text)
    x, y = pair.encode(alignment.Aligner(pair).split(text))
    if a:
        assert [i for s in x for i in s] == [i for i, _ in a] and [i for s in y for i in s] == [i for i, _ in b]


def test_owners():
    a, b, cut = alignment.owners(np.array([3, 1, 2]), np.array([1, 3, 2]))
    assert a.tolist() == [0, 0, 1, 2] and b.tolist() == [0, 1, 1, 2] and cut.tolist() == [True, False, False, True]
    assert [len(x) for x in alignment.owners(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_alignment_query(spark, sf, pair, odd, empty):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_alignment"](spark, sf).collect()}
    assert [got[r.doc_id] for r in rows] == plain_alignment(pair, [r.text for r in rows])
    assert as_rows(alignment.align(odd)) == sorted(plain_alignment(pair, [r.text for r in odd.collect()]))
    assert alignment.align(empty).count() == 0


def test_blocks_hold_all_rows(spark, monkeypatch):
    def sizes(batches):
        import pyarrow as pa

        for k, (texts, ids) in zip(blocks.block_ids(), blocks.block_rows(batches, ["text", "id"], 40)):  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(ids)), pa.array(ids), pa.array([sum(len(t or "") + 1 for t in texts[:-1])] * len(ids))], ["k", "id", "n"])

    df = spark.range(500, numPartitions=3).selectExpr("if(id % 7 = 0, null, repeat('x', int(id % 60))) as text", "id")
    got = df.mapInArrow(sizes, "k long, id long, n long").collect()
    assert sorted(r.id for r in got) == list(range(500)) and max(r.n for r in got) < 40 and len({r.k for r in got}) > 200


# ---------------------------------------------------------------- 13


def plain_collocations(rows, least=10, top=2000, most=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ",;:!?\n\v\f\r":
            low = low.replace(c, ".")
        for piece in low.split("."):
            w = piece.replace("\t", " ").split(" ")
            w = [x for x in w if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        over = any(100 * b >= 50 * a for (l2, q), b in cand.items() if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
        if not over:
            s, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_collocations(spark, seed):
    rnd = random.Random(seed)
    bits = ["aa", "Bb", "cc", "aa bb", "cc dd ee", ".", " ", "\t", "\n", "é", "É", "zz!", "q;q", "a b", "rare%d"]
    rows = [(" ".join(rnd.choice(bits).replace("%d", str(rnd.randrange(10**6))) for _ in range(rnd.randrange(40))), rnd.choice(["en", "en", "fr", None, "und", "xx"])) for _ in range(400)]
    rows += [(None, "en"), ("", None), ("xx " * 3000, "en"), ("ab ab ab", "only")] + [("Copy of one text", "fr")] * 50
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4).withColumn("n", F.lit(1)).withColumn("block", F.lit(1)).withColumn("id", F.lit(0))
    assert found(collocations.collocations(df)) == plain_collocations(rows)
    assert found(collocations.collocations(df, top=5)) == plain_collocations(rows, top=5)
    assert found(collocations.collocations(df, least=2)) == plain_collocations(rows, least=2)


def test_collocations_over_several_blocks(spark, monkeypatch):
    rows = [("one two three. two three four", "en")] * 7 + [("two three", "en")] * 9 + [("one two", "fr")] * 30
    df = spark.createDataFrame(rows, "text string, lang string").repartition(11)
    assert found(collocations.collocations(df)) == plain_collocations(rows)


def test_suffix_arrays():
    rnd = np.random.default_rng(4)
    for size in (0, 1, 2, 500):
        seq = rnd.integers(0, 4, size).astype(np.int32)
        order = collocations.suffix_array(seq, 4)
        assert sorted(order.tolist()) == list(range(size))
        keys = [tuple((seq[i : i + 4] + 1).tolist()) for i in order]
        assert keys == sorted(keys)
        want = Counter(tuple(seq[i : i + k].tolist()) for k in (2, 3) for i in range(size - k + 1) if 0 not in seq[i : i + k])
        got = {tuple(seq[a : a + k].tolist()): int(c) for k, (at, n) in enumerate(collocations.phrase_counts(seq), 2) for a, c in zip(at, n, strict=True)}
        assert got == want


def test_scores_are_exact(spark):
    for a, left, right in ((10, 10, 10), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_998 + 1), (123_456_789_012_345, 987_654_321_098_765, 555_555_555_555_555), (10**14, 10**15 - 1, 10**15 - 1), (3, 7, 11)):
        df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
        assert df.select(collocations.exact_score("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)


def test_collocations_awkward(spark, odd, empty):
    assert found(collocations.collocations(odd, least=2)) == plain_collocations([(r.text, r.lang) for r in odd.collect()], least=2)
    assert collocations.collocations(empty).count() == 0


def test_collocations_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert found(QUERIES["op13_collocations"](spark, sf)) == sorted(con.sql(ORACLES["op13_collocations"]).fetchall())
    assert os.path.exists(sf)


def test_stretches_are_tokenized_once_and_checked_together():
    pair = alignment.Pair()
    words = [" wort", " wort.", " wort###", " wort%%", " wort,", " émile.", " émile", " a#b", " don't", " it's.", " x\ny", "  ", " ", " 12,3"]
    a, b = pair.encode(words)
    assert a == [e.ids for e in pair.a.encode_batch_fast(words, add_special_tokens=False)]
    said = []

    class Counted:
        def tokenize(self, text):
            said.append(text)
            return model.tokenize(text)

    model, pair.model = pair.model, Counted()
    assert pair.encode(words) == (a, b)
    assert len(said) == len(set(said)) == 6
    pair.model = model
    # one stretch that differs leaves the others as they are
    aligner, alone = alignment.Aligner(pair), alignment.Aligner(pair)
    odd = [*words[:6], " ▁x", *words[6:]]
    aligner.learn(odd)
    for k, w in enumerate(odd):
        alone.learn([w])
        assert (aligner.counts[4 * k : 4 * k + 4], aligner.groups[k], aligner.links[k]) == (alone.counts[-4:], alone.groups[-1], alone.links[-1])
    assert aligner.counts[24] == -1 and aligner.counts[0] > 0
