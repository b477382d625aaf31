"""Each operator against a plain version, on made-up and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quiescent.llm import ann, components, decontam, fixity, langid, linededup, mixing, sampling, simhash, tokencount, toxicity, urlfilter
from quiescent.llm.queries import QUERIES

from .conftest import WORDS, prose

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rnd = random.Random(seed)
    n = 120
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(100, 119)] * (seed % 2)
    want = roots(n, links)
    df = spark.createDataFrame(links + links[:3] + [(None, 1)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {i: want[i] for i in range(n) if want[i] != i}
    assert components.components(df.where("false")).count() == 0


# ---------------------------------------------------------------- 1


def plain_print(text, width):
    w = (text or "").translate(LOW)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def plain_components(rows, width, radius):
    fp = [plain_print(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= radius]
    r = roots(len(fp), links)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[r[i]] = min(low.get(r[i], math.inf), math.inf if d is None else d)
    return sorted(((d, f"{fp[i]:016x}", None if low[r[i]] == math.inf else low[r[i]]) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_awkward(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(odd).collect()), key=str)
    assert got == plain_components(rows, 3, 2)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_simhash_near_texts(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rnd = random.Random(radius)
    rows = []
    for g in range(12):
        base = prose(rnd, 150).split()
        for _ in range(8):
            x = list(base)
            for _ in range(rnd.randrange(4)):
                x[rnd.randrange(len(x))] = rnd.choice(WORDS)
            rows.append((len(rows) * 3 + 1, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df, 3, radius).collect()), key=str)
    assert got == plain_components(rows, 3, radius)


@pytest.mark.parametrize(("n", "tile", "checked"), [(200, 4096, (4, 64)), (90, 8, (1, 2)), (12, 4096, (4, 64)), (30, 8, (2, 3))])
def test_near_duplicates_by_similarity(spark, n, tile, checked, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 256 if tile > 8 else 3)
    monkeypatch.setattr(simhash, "PAIRS", 1 << 20 if n != 30 else 50)
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "CHECKED", checked)
    monkeypatch.setattr(simhash, "SHARE", 2)
    rnd = random.Random(n)
    rows, common = [], prose(rnd, n // 3)
    for _ in range(30):
        base = (prose(rnd, n) + " " + common).split()
        rows.append((len(rows), " ".join(base)))
        for edits in (1, 3, n // 5):
            x = list(base)
            for k in rnd.sample(range(len(base)), edits):
                x[k] = rnd.choice(WORDS)
            rows.append((len(rows), " ".join(x)))
    rows += [(len(rows) + k, " ".join(rows[0][1].split()[: n - k])) for k in range(8)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    links = [(a, b) for a in range(len(rows)) for b in range(a) if j(a, b) >= 0.8]
    assert links
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [c for _, c in sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())]
    assert got == roots(len(rows), links)
    if n == 200:
        kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
        assert kept == set(roots(len(rows), links))


def test_simhash_of_large_and_repeated_ids(spark):
    rnd = random.Random(3)
    a, b, c = prose(rnd, 80), prose(rnd, 80), prose(rnd, 80)
    rows = [(1 << 62, a), ((1 << 63) - 1, b), (1, c), (1, a + " x"), (0, c), (-5, prose(rnd, 80)), (-(1 << 63), b), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for radius in (0, 2, 12):
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df, 3, radius).collect()), key=str)
        assert got == plain_components(rows, 3, radius)
    assert sorted(r.text for r in simhash.drop_near_duplicates(df).collect()) == sorted([a + " x", b, c, rows[5][1]])
    own = [(1 << 62, a), ((1 << 62) + 1, b), (3, c), (3, rows[5][1]), (3, c), (None, prose(rnd, 50)), (None, prose(rnd, 50))]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(own)], "doc_id long, text string, n int")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(df).collect()) == sorted((d or 0, t) for d, t in set(own))


def test_drop_near_duplicates_awkward(odd, empty):
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    # copies of a, texts nearly b, texts without words, x alone, one in two spellings
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 3, 7, 9]
    assert sorted(r.text for r in out.where("doc_id = 1").collect()) == sorted({t for d, t in rows if d == 1})
    assert simhash.drop_near_duplicates(empty).count() == 0


# ---------------------------------------------------------------- 2


def plain_hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        if w:
            n = min(window, len(w))
            for i in range(max(1, len(w) - window + 1)):
                wins[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, empty):
    rnd = random.Random(3)
    items = [(i, prose(rnd, n)) for i, n in enumerate((30, 12, 10, 5, 1, 25))] + [(6, None), (7, "..."), (8, "été"), (10, "Aa aa aa aa aa aa aa aa aa aa aa aa")]
    items += [(20 + k, f"own{k} " + items[0][1] + f" end{k}") for k in range(4)]  # a passage that several items have
    rows = []
    for i in range(60):
        t = prose(rnd, rnd.randint(0, 80)).split()
        if i % 3 == 0:
            w = items[rnd.randrange(6)][1].split()
            a = rnd.randrange(len(w))
            t[rnd.randint(0, len(t)) : 0] = w[a : a + rnd.randint(1, 30)]
        rows.append((i, " ".join(t).title() if i % 2 else ", ".join(t)))
    rows += [(60, "aa " * 25), (61, items[0][1] + " " + items[0][1]), (61, "other " + items[1][1]), (None, items[2][1])]
    rows += [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, pos string")
    got = sorted((tuple(r) for r in decontam.decontaminate(df, bench).collect()), key=str)
    assert got == plain_hits(rows, items)
    assert decontam.decontaminate(empty, bench).count() == 0
    none = decontam.decontaminate(odd, bench.where("false")).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)
    clean = decontam.drop_contaminated(df, bench)
    flagged = Counter((r[0], r[5]) for r in plain_hits(rows, items))
    assert Counter(r.doc_id for r in clean.collect()) == Counter({d: n for (d, bad), n in flagged.items() if not bad})


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a x x x x x x b c"), (3, "c b a"), (4, "a b")], "doc_id long, text string")
    tok = decontam.item_tokens(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    post = decontam.build_index(docs, tok.select("term").distinct(), 3)
    got = {r.doc_id for r in decontam.proximity(post, tok, 3, 2).collect()}
    assert got == {1, 3}


@pytest.mark.parametrize("slop", [0, 1, 4])
def test_proximity_equals_brute_force(spark, slop):
    rnd = random.Random(slop)
    rows = [(i, " ".join(rnd.choice("abcdx") for _ in range(rnd.randint(0, 14)))) for i in range(40)] + [(40, None), (None, "a b a b")]
    items = [(1, "a b a"), (2, "c d"), (3, "a a a"), (4, "b x c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tok = decontam.item_tokens(spark.createDataFrame(items, "item_id long, text string"))
    post = decontam.build_index(docs, tok.select("term").distinct(), 5)
    got = {(r.item_id, r.doc_id, r.start, r.stop) for r in decontam.proximity(post, tok, 12, slop).collect()}
    want = set()
    for item, t in items:
        terms, span = set(t.split()), len(t.split()) + slop
        for d, text in rows:
            w = (text or "").split()
            for s in range(len(w)):
                if w[s] in terms and terms <= set(w[s : s + span]):
                    want.add((item, d, s, s + 1 + max(w[s : s + span].index(x) for x in terms)))
    assert got == want


# ---------------------------------------------------------------- 3


def test_fixity(spark):
    rnd = random.Random(1)
    rows = [(i, f"http://h/{i}", prose(rnd, rnd.randint(1, 3000))) for i in range(2500)] + [(None, None, None), (5, "http://h/5", "again"), (5, "http://h/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(3))
    records = fixity.to_records(pages)
    a = fixity.build(fixity.manifest(records))
    entries = a.records.toPandas()
    for _, g in entries.groupby("file"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist()
    same = fixity.audit(a, fixity.build(a.records)).collect()
    assert {r.status for r in same} == {"intact"} and len(same) == entries.file.nunique()
    b = fixity.damaged_copy(records)
    heads = {r.record[:8] for r in records.collect()}
    assert heads == {"WARC/1.0"} and all(hashlib.sha256(r.record.encode()).hexdigest() in set(entries.digest) for r in records.limit(5).collect())
    got = sorted((r.file, r.offset, r.status) for r in fixity.audit(a, fixity.build(b)).where("status <> 'intact'").collect())
    left, right = ({(r.file, r.offset): (r.digest, r.length) for r in x.collect()} for x in (a.records, b))
    want = sorted((*k, "missing" if k not in right else "extra" if k not in left else "corrupt") for k in left.keys() | right.keys() if left.get(k) != right.get(k))
    assert got == want and len({s for *_, s in want}) == 3
    nameless = spark.range(5300).select(F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.when(F.col("id") == 7, F.repeat(F.lit("long "), 500_000)).alias("html"))
    sizes = [r["count"] for r in fixity.to_records(nameless).groupBy("file").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1200
    none = fixity.build(fixity.manifest(fixity.to_records(pages.where("false"))))
    assert fixity.audit(none, none).count() == 0


# ---------------------------------------------------------------- 4


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    v[100:160] = v[7]
    rows = [(i, [float(x) for x in v[i]]) for i in range(3000)]
    odd_rows = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] + [1.0] * 23), (None, rows[3][1]), (5400, [1.0, 2.0]), (5500, [])]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("shard", F.lit(2))
    got = ann.nearest(df).toPandas()
    d = v.astype(float)
    ok = 0
    for q in range(0, 3000, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        order = sorted((x, i) for i, x in enumerate(dist) if i != q)[:10]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11))
        assert np.allclose(g.score, dist[g.vec_id], atol=0) and g.score.is_monotonic_increasing
        ok += len({i for _, i in order} & set(g.vec_id)) / 10
    assert ok / 30 >= 0.9
    assert got[got.query_id == 100].vec_id.tolist() == [7, *range(101, 110)]
    assert set(got.query_id) == set(range(0, 3000, 100)) and ann.nearest(df.where("false")).count() == 0
    again = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.1]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0, 1.0])], "vec_id long, embedding array<float>")
    two = sorted((r["rank"], r.vec_id) for r in ann.nearest(again).collect())
    assert two == [(1, 100), (1, 100), (2, 3), (2, 3), (3, 3), (3, 3)]
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCKS", 1)
    monkeypatch.setattr(ann, "BATCH", 16)
    parts = ann.nearest(df).toPandas()
    assert parts.groupby("query_id").vec_id.count().tolist() == [10] * 30
    assert parts[parts.query_id == 100].vec_id.tolist() == [7, *range(101, 110)]
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


# ---------------------------------------------------------------- 5, 6

TEXTS = {
    "en": "the quick and the slow of that with this from which they were there is it on by",
    "de": "der schnelle und die langsame von dem mit diesem aus welchem sie waren dort ist es auf",
    "fr": "le rapide et la lente de cela avec celui dont ils étaient là est il sur par où",
    "es": "el rápido y la lenta de eso con este del cual ellos eran allí está él sobre por donde",
}


def corpus(n, seed, toxic=()):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        w = [rnd.choice(TEXTS[lang].split()) for _ in range(rnd.randint(20, 60))]
        bad = bool(toxic) and rnd.random() < 0.3
        for _ in range(2 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(toxic) + rnd.choice(("", "s", "ig"))
        out.append((i, " ".join(w), lang, int(bad)))
    return out


def test_language(spark, odd, empty):
    rows = corpus(400, 1)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.language_query(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i, *_ in rows)
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    und = langid.language_query(odd).collect()
    assert len(und) == odd.count() and {r.lang_pred for r in und if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.language_query(empty).count() == 0
    assert {r.lang_pred for r in langid.language_query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    m = langid.fit([(t, lang) for _, t, lang, _ in rows])
    assert m.predict(rows[0][1] * 9000)[0] == m.predict(rows[0][1])[0]
    for t in [r[1] for r in rows[:40]] + ["a", "é", "日本", "x × y", "the der le el"]:
        (a, p), (b, q) = m.predict(t), plain_language(m, t)
        assert a == b and abs(p - q) < 1e-4


def test_toxicity(spark, odd, empty):
    rows = corpus(1200, 2, ("scumbag", "worthless", "idiot"))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[3], 1) for r in rows] + [(None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.toxicity_query(docs, labels).collect()}
    truth = {r[0]: r[3] for r in rows}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    right = sum(got[i].predicted == truth[i] for i in held) / len(held)
    assert right >= 0.95
    again = {r.doc_id: r.score for r in toxicity.toxicity_query(docs.repartition(7), labels).collect()}
    assert again == {i: r.score for i, r in got.items()}
    model = toxicity.train(docs, labels, F.lit(True))
    cut = toxicity.clean_documents(docs, model)
    assert cut.columns == docs.columns
    left = {r.doc_id for r in cut.collect()}
    assert sum((i in left) == (not t) for i, t in truth.items()) >= 0.95 * len(truth)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.clean_documents(empty, model).count() == 0
    assert toxicity.toxicity_query(odd, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.toxicity_query(empty, labels.where("false")).count() == 0
    long = [w for _, t, *_ in rows[:40] for w in t.split()]
    whole = model.probability(long, toxicity.WordCache())
    old = toxicity.BLOCK, toxicity.GRAM_BLOCK
    try:
        toxicity.BLOCK, toxicity.GRAM_BLOCK = 7, 5
        assert abs(model.probability(long, toxicity.WordCache()) - whole) < 1e-5
        few = [(r[1], r[3]) for r in rows[:150]]
        blocks = toxicity.fit(few, None)
    finally:
        toxicity.BLOCK, toxicity.GRAM_BLOCK = old
    once = toxicity.fit(few, None)
    assert np.allclose(once.out, blocks.out, atol=1e-4) and abs(once.thresholds[""] - blocks.thresholds[""]) < 1e-4
    texts = [r[1] for r in rows[:25]] + ["", "scumbag", "x", "scum" * 3000, "é worthless 日本"]
    for t in texts:
        assert abs(model.probability(toxicity.words(t), toxicity.WordCache()) - plain_toxicity(model, t)) < 1e-4
    # what stands behind the start of a word without breaks counts
    base = [abs(plain_toxicity(model, "ab" * 200 + end) - plain_toxicity(model, "ab" * 200)) for end in ("", "scumbag" * 20)]
    assert base[0] == 0 and base[1] > 0


def test_toxicity_learns_from_texts_without_words():
    texts = ["you scumbag", "a fine day", "", "!?", None, "scumbag", "day"] * 6
    model = toxicity.fit([(t, t is not None and "scumbag" in t) for t in texts], None)
    assert all(0 <= model.score(t, toxicity.WordCache()) <= 1 for t in ("", None, "!?"))
    assert model.score("you scumbag", toxicity.WordCache()) > model.score("a fine day", toxicity.WordCache())


def plain_toxicity(model, text):
    """The network position by position and gram by gram."""
    emb = []
    for w in re.findall(r"\w+", (text or "").lower()):
        raw = w.encode()
        s = b"<" + raw + b">"
        rows = [xxhash.xxh64_intdigest(raw, 1)] + [xxhash.xxh64_intdigest(s[i : i + n], 2) for n in toxicity.GRAMS for i in range(len(s) - n + 1)]
        emb.append(sum(model.rows[r % toxicity.BUCKETS].astype(float) for r in rows) / len(rows))
    zero = [np.zeros(toxicity.DIM)] * 2
    x = [*zero, *emb, *zero]
    z = model.out_bias
    for k, f in enumerate(model.filters):
        for c in range(toxicity.FILTERS):
            best = max(sum(float(x[i + j] @ f[j][:, c]) for j in range(len(f))) for i in range(len(x) - len(f) + 1))
            z += max(0.0, best + model.bias[k * toxicity.FILTERS + c]) * model.out[k * toxicity.FILTERS + c]
    return 1 / (1 + math.exp(-z))


def plain_language(m, text):
    """Family by sums over trigrams, then votes of the pairs, one trigram at a time."""
    low = "".join(c if "a" <= c <= "z" or ("À" <= c and c not in "×÷") else " " for c in text.lower())
    low += " " * (3 - len(low))
    grams = []
    for i in range(len(low) - 2):
        h = sum(ord(c) * k for c, k in zip(low[i : i + 3], (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), strict=True)) % 2**32
        grams.append(((h ^ h >> 15) * 0x27D4EB2F) % 2**32 >> 19)
    mean = [sum(float(row[g]) for g in grams) / len(grams) for row in m.table]
    like = [x * min(len(grams), 60) for x in mean[: len(m.families)]]
    fam = like.index(max(like))
    p = 1 / sum(math.exp(x - max(like)) for x in like)
    votes = [[0, 0.0, -i] for i in range(len(m.members[fam]))]
    for q, (f, i, j) in enumerate(m.pairs):
        if f == fam:
            d = mean[len(m.families) + q] + m.bias[q]
            votes[i if d > 0 else j][0] += 1
            votes[i][1] += d
            votes[j][1] -= d
    best = -max(votes)[2]
    if len(votes) > 1:
        p /= 1 + math.exp(-4 * votes[best][1] / (len(votes) - 1))
    return m.members[fam][best], p


def test_many_labels_and_repeated_ids_in_samples(spark):
    rows = [(i, f"text {i}", f"l{i % 90}") for i in range(900)] + [(5, f"other text {k}", "l5") for k in range(300)] + [(None, "x", "l1"), (7, None, "l7"), (8, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most, n in ((3, 3), (50, 10)):
        got = sampling.bounded_sample(df, df, "lang", most)
        assert got == sampling.bounded_sample(df.repartition(5), df.repartition(3), "lang", most)
        assert set(Counter(x for _, x in got)) == {f"l{k}" for k in range(90)} and max(Counter(x for _, x in got).values()) <= n


# ---------------------------------------------------------------- 7


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def plain_lines(rows, tau, least):
    lines, occ = {}, []
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            x = x.strip(" \t\r\x0b\x0c")
            if x:
                lines.setdefault(x, []).append((d, k))
                occ.append((d, k, x))
    u = list(lines)
    near = Counter()
    links = []
    for i in range(len(u)):
        for j in range(i):
            if min(len(u[i]), len(u[j])) >= least and abs(len(u[i]) - len(u[j])) <= tau and lev(u[i], u[j]) <= tau:
                near[u[i]] += 1
                near[u[j]] += 1
                links.append((i, j))
    r = dict(zip(u, roots(len(u), links), strict=True))
    members = defaultdict(list)
    for x in u:
        members[r[x]] += lines[x]
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    out = []
    for d, k, x in occ:
        rep = min(members[r[x]], key=key)
        out.append((d, k, rep[0], rep[1], near[x], len(members[r[x]]), (d, k) == rep))
    return sorted(out, key=str)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_line_join(spark, tau, monkeypatch):
    monkeypatch.setattr(linededup, "TILE", 3)
    rnd = random.Random(tau)
    pool = [prose(rnd, rnd.randint(2, 9)) for _ in range(14)] + ["ab" * 12, "ab" * 13, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = []
    for i in range(45):
        t = []
        for _ in range(rnd.randint(0, 5)):
            x = list(rnd.choice(pool))
            for _ in range(rnd.choice((0, 0, 1, 2, 3, 4))):
                p = rnd.randrange(len(x))
                x[p : p + rnd.randint(0, 1)] = rnd.choice(("", "z", "é"))
            t.append("".join(x))
        rows.append((i, "\n".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in linededup.line_classes(df, tau).collect()), key=str)
    assert got == plain_lines(rows, tau, 8 * tau)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_lines_of_all_lengths(spark, tau, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "TILE", 5)
    rnd = random.Random(10 + tau)
    chars = "abcdefghijklmnopqrstuvwxyzé日😀"
    rows = [(i, "\n".join("".join(rnd.choice(chars) for _ in range(rnd.randint(0, 9))) for _ in range(4))) for i in range(40)]
    rows += [(40, "fifteen letters"), (41, "fifteen lettersX"), (42, "a\nbc\nbcd\nabcd\nxyzw")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in linededup.line_classes(df, tau, linededup.ALL_LENGTHS).collect()), key=str)
    assert got == plain_lines(rows, tau, 0)
    if tau == linededup.TAU:
        df.write.parquet(str(tmp_path / "documents.parquet"))
        assert sorted((tuple(r) for r in QUERIES["op7_linededup"](spark, str(tmp_path)).collect()), key=str) == got


def test_lines_awkward(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").distinct().collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in linededup.line_classes(df).collect()), key=str) == plain_lines(rows, 2, 16)
    assert linededup.line_classes(odd).count() == sum(1 for r in odd.collect() for x in (r.text or "").split("\n") if x.strip(" \t\r\x0b\x0c"))
    assert linededup.line_classes(empty).count() == 0 and linededup.drop_repeated_lines(empty).count() == 0


def test_repeated_lines_go(spark, odd):
    foot = "All rights are reserved by the owners."
    rows = [(i, f"{i * 104729} text of its own {'x' * (5 * i)}\n{foot}{'.' * (i % 3)}\n\nend {i * 7919}") for i in range(9)] + [(20, foot), (21, "alone"), (22, ""), (23, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drop_", F.lit(1)).withColumn("id_", F.lit(2))
    out = {r.doc_id: r.text for r in linededup.drop_repeated_lines(df, min_docs=7).collect()}
    assert out[0] == rows[0][1] and out[3] == f"{3 * 104729} text of its own {'x' * 15}\n\nend {3 * 7919}"
    assert set(out) == set(range(9)) | {21, 22, 23} and out[22] == "" and out[23] is None
    assert linededup.drop_repeated_lines(df, min_docs=20).count() == len(rows)
    assert linededup.drop_repeated_lines(odd).columns == odd.columns


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    foot = "All rights are reserved by the owners."
    rows = [(7, f"first text of all\n{foot}"), (8, f"text of the eighth, first row\n{foot}"), (8, "another text of number eight\nthis line stands nowhere else at all"), (8, f"third\n{foot}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([rows[0][1], "text of the eighth, first row", rows[2][1], "third"])
    for kw in ({}, {"min_docs": 1, "copies": False}):
        assert sorted(r.text for r in linededup.drop_repeated_lines(df, **kw).collect()) == want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_meetings_in_batches(size):
    rnd = random.Random(size)
    rows = sorted((rnd.randrange(40) * 2 + rnd.randrange(2), rnd.randrange(6)) for _ in range(120))
    rows = [r for r in rows if r[0] // 2 != 5] + [(10 + i % 2, 3) for i in range(9)]
    rows.sort()
    b = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["key", "line"]) for i in range(0, len(rows), size)]
    got = {tuple(r.values()) for x in linededup._meetings(iter(b)) for r in x.to_pylist()}
    of = defaultdict(set)
    for k, line in rows:
        of[k // 2].add((line, k % 2 == 0))
    assert got == {(k, *x) for k, v in of.items() if len({x for x, _ in v}) > 1 and any(i for _, i in v) for x in v}


def test_edit_distance():
    rnd = random.Random(4)
    for _ in range(4000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12)))
        b = "".join(c for c in a if rnd.random() > 0.15) + rnd.choice(("", "a", "bc"))
        for tau in (0, 1, 2, 3):
            want = min(lev(a, b), tau + 1)
            assert linededup.edit_distance(a, b, tau) == want and linededup.trimmed_distance(a, b, tau) == want


# ---------------------------------------------------------------- 8


def reference(pieces, fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def test_token_counts_equal_the_tokenizer(spark, sf, odd, empty):
    pieces, unk = tokencount.load_pieces()
    ref, mine = reference(pieces, True), tokencount.Counter(pieces, unk)
    rnd = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert all(a[1] > b[1] for a, b in zip(pieces[1:], pieces[2:], strict=False)) and abs(sum(math.exp(x) for _, x in pieces[1:]) - 1) < 1e-9
    texts += ["", " ", "  ", "▁", "▁▁a b", "x▁y", " a", "a ", "日本語", "😀😀 é", "<0x41><unk>", "a\nb\t c", "a" * 3000]
    texts += ["".join(rnd.choice("ab ▁éxyz😀\n<unk>0419") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    assert [mine.count(t) for t in texts] == [ref(t) for t in texts]
    assert [r.n_tokens for r in tokencount.count_tokens(odd).where("doc_id in (3, 4)").collect()] == [0, 0]
    assert tokencount.count_tokens(odd).count() == odd.count() and tokencount.count_tokens(empty).count() == 0


@pytest.mark.parametrize("splits", [True, False])
def test_token_ties_and_unknowns(splits):
    pieces = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("aba", -3.0), ("ba", -2.0), ("cc", -1.0)]
    pieces += [] if splits else [("b▁a", -2.0)]
    ref, mine = reference(pieces, False), tokencount.Counter(pieces)
    assert mine.splits == splits
    rnd = random.Random(7)
    for _ in range(3000):
        s = "".join(rnd.choice("abc dx") for _ in range(rnd.randint(0, 14)))
        assert mine.count(s) == ref(s), s


# ---------------------------------------------------------------- 9


def plain_url(u):
    rest = u.partition("://")[2] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOW), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.NET", "http://a.net/x?y#z", "https://x.Example.NET/en/a", "http://example.net/fr/", "http://notexample.com/de/", "http://m.example.com/de/q?u=://", "ftp://o.org/fr/", "http://o.org/en/", "http://net/", "http://é.org#/fr/", "http://a?b/c", "x://y://z.net/"] * 2
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urlfilter.filter_urls(df).collect()}
    from quiescent.llm.oracles import _grams, url_model

    model = url_model()
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        g = _grams(host, path)
        score = model[-1] + sum(model[j] for j in g) / max(1, len(g))
        want = (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else ("block" if score > 0 else "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, u
    assert urlfilter.filter_urls(df.where("false")).count() == 0


def test_url_training(spark):
    rnd = random.Random(8)
    bad, good = ("casino", "pills", "bet"), ("library", "museum", "school")
    url = lambda pool: f"http://{rnd.choice(pool)}{rnd.randrange(99)}.example/{rnd.choice(pool)}/{rnd.randrange(999)}"
    rows = [(url(bad), 1) for _ in range(30)] + [(url(good), 0) for _ in range(30)] + [(None, None), (None, 0)]
    m = urlfilter.train(spark.createDataFrame(rows, "url string, label int"))
    test = [(url(bad), 1) for _ in range(40)] + [(url(good), 0) for _ in range(40)]
    df = spark.createDataFrame(test, "url string, label int")
    h, p = urlfilter.split_url(F.col("url"))
    hits = df.where((urlfilter.score(h, p, m) > 0) == (F.col("label") == 1)).count()
    assert hits >= 76
    assert urlfilter.train(df.where("false")) == [0.0] * (urlfilter.BUCKETS + 1)


# ---------------------------------------------------------------- 10


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    t, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        share = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            t[s] += share * w[s]
            if t[s] >= 2 * sizes[s]:
                left += t[s] - 2 * sizes[s]
                t[s] = 2.0 * sizes[s]
                open_.discard(s)
    return t


def test_mixing(spark):
    rnd = random.Random(10)
    rows = [(i, prose(rnd, rnd.randint(0, 30)), rnd.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df).toPandas()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(dict(sizes))
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for s, g in out.groupby(out.source.fillna("-")):
        k = None if s == "-" else s
        assert g.source_size.iloc[0] == sizes[k] and abs(g.target.iloc[0] - want[k]) < 1e-6
        assert abs(g.taken.sum() - want[k]) <= 30
    again = mixing.mix(df.repartition(9)).toPandas()
    a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (out, again))
    assert a.equals(b[a.columns])
    small = mixing.mix(df, share=0.5).toPandas().set_index("doc_id")
    big = out.set_index("doc_id")
    assert (small.taken <= big.taken.reindex(small.index)).all()  # budgets are nested


def test_mixing_of_equal_and_null_ids(spark):
    rnd = random.Random(12)
    rows = [(None, prose(rnd, rnd.randint(1, 30)), "abc"[i % 3]) for i in range(3000)] + [(i % 7, prose(rnd, 17), "abc"[i % 3]) for i in range(600)]
    rows += [(None, "the same row again and again", "d")] * 900 + [(8, "another row", "d")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 30
    key = ["doc_id", "source", "size", "taken"]
    again = mixing.mix(df.repartition(3)).toPandas()
    assert Counter(map(str, again[key].itertuples(index=False, name=None))) == Counter(map(str, out[key].itertuples(index=False, name=None)))
    docs = mixing.mixed_documents(df).toPandas()
    assert docs.mix_taken.sum() == out.taken.sum() and docs.groupby("source").mix_taken.sum().to_dict() == out.groupby("source").taken.sum().to_dict()


def test_mixing_awkward(odd, empty):
    out = mixing.mix(odd).toPandas()
    assert len(out) == odd.count() and (out.taken <= 2 * out["size"]).all() and (out["size"] == 0).sum() == 4
    docs = mixing.mixed_documents(odd)
    assert set(docs.columns) == set(odd.columns) | {"mix_taken"}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
