"""Toxicity by a convolutional text classifier.

Words are embedded as the mean of hashed rows, one for the word and some for its
byte n-grams. Filters of three widths run over a text, the largest response of
each filter over the whole text goes to a logistic output. All of it is trained in
numpy, shard by shard from one start where there are many texts. Thresholds are then set for each predicted language, and scores are bent so
that every threshold lies at 0.3.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .blocks import ROWS, give_back, handed_back, sliced
from .sampling import fold
from .shards import UNIT, added, fixed, in_order, key, sharded, summed
from .storage import broadcast_if_small

BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
GRAMS = (4, 6)
EPOCHS = 6
BATCH = 32
#: Labelled texts that a task trains a network on; of more there are several shards, whose networks are averaged.
SHARD = 2000
#: Rows of the embedding that are averaged together, and steps of the probabilities that thresholds are looked for among.
PART, STEPS = 256, 1 << 14
#: Score at which a text is called toxic.
CUT = 0.3
#: Distinct words whose projections a worker keeps, words of a text looked at together, and new words projected together.
CACHE = 200_000
BLOCK = 1 << 16
TOGETHER = 1 << 9
#: Bytes of a word whose n-grams are looked up at once.
GRAM_BLOCK = 1 << 12
#: Probability that parts the classes where nothing else is known, as the classes weigh the same in training; it counts as so many toxic texts.
PRIOR, PRIOR_TEXTS = 0.5, 4
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def feature_blocks(word: str) -> Iterator[list[int]]:
    """Rows of a word, its own first, then those of its byte n-grams; of a long word some at a time."""
    w = word.encode("utf-8", "surrogatepass")
    s = b"<" + w + b">"
    hashed = xxhash.xxh64_intdigest
    rows = [hashed(w, 1) % BUCKETS]
    for a in range(0, len(s), GRAM_BLOCK):
        yield rows + [hashed(s[i : i + n], 2) % BUCKETS for n in GRAMS for i in range(a, min(a + GRAM_BLOCK, len(s) - n + 1))]
        rows = []


def features(word: str) -> np.ndarray:
    return np.concatenate([np.array(x, np.int32) for x in feature_blocks(word)])


#: The primes of XXH64.
P1, P2, P3, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, k: int) -> np.ndarray:
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k))


def gram_rows(b: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of the grams of ``n`` bytes, 4 to 7, that begin at ``at``: XXH64 with seed 2 of all of them at once."""
    h = np.full(len(at), np.uint64(2) + P5 + np.uint64(n))
    h ^= (b[at] | b[at + 1] << np.uint64(8) | b[at + 2] << np.uint64(16) | b[at + 3] << np.uint64(24)) * P1
    h = _turned(h, 23) * P2 + P3
    for j in range(4, n):
        h = _turned(h ^ b[at + j] * P5, 11) * P1
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return ((h ^ h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32)


def features_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`features` of some words one after the other, and how many each has."""
    if any(len(w) > GRAM_BLOCK // 4 for w in batch):
        each = [features(w) for w in batch]
        return np.concatenate(each), np.array([len(f) for f in each], np.int64)
    raw = [w.encode("utf-8", "surrogatepass") for w in batch]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    b = np.frombuffer(b"<" + b"><".join(raw) + b">", np.uint8).astype(np.uint64)
    start, place = np.cumsum(size) - size, np.arange(len(b))
    word = np.repeat(np.arange(len(raw)), size)
    inside = place - start[word]
    grams = [np.maximum(0, size - n + 1) for n in GRAMS]
    n = 1 + sum(grams)
    base = np.cumsum(n) - n
    flat = np.empty(int(n.sum()), np.int32)
    flat[base] = [xxhash.xxh64_intdigest(w, 1) % BUCKETS for w in raw]
    base = base + 1
    for k, g in zip(GRAMS, grams, strict=True):
        at = place[inside < g[word]]
        flat[base[word[at]] + inside[at]] = gram_rows(b, at, k)
        base = base + g
    return flat, n


def rows_of(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words one after the other, and where each word's begin, with the end of the last."""
    got = [features_of(vocab[i : i + TOGETHER]) for i in range(0, len(vocab), TOGETHER)]
    flat = np.concatenate([np.zeros(0, np.int32), *(f for f, _ in got)])
    return flat, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)]))]).astype(np.int64)


@dataclass
class ToxicityModel:
    rows: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: langid.LanguageModel | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def projections(self, batch: list[str]) -> np.ndarray:
        """For each word its products with every filter's every column."""
        more = []
        if any(len(w) > GRAM_BLOCK // 4 for w in batch):  # as bytes it may have several blocks
            flat, n = [], []
            for k, w in enumerate(batch):
                blocks = feature_blocks(w)
                f = next(blocks)
                flat += f
                n.append(len(f))
                more += [(k, self.rows[x].sum(axis=0), len(x)) for x in blocks]
        else:
            flat, n = features_of(batch)
        emb = np.add.reduceat(self.rows[flat], np.concatenate([[0], np.cumsum(n)[:-1]]))
        for k, x, m in more:
            emb[k] += x
            n[k] += m
        emb /= np.array(n, np.float32)[:, None]
        # one dimension after the other, so that a word has the same products whatever words are with it
        columns = np.concatenate([k for f in self.filters for k in f], axis=1)
        out = emb[:, :1] * columns[0]
        for j in range(1, DIM):
            out += emb[:, j : j + 1] * columns[j]
        return out

    def probability(self, tokens: list[str], cache: WordCache) -> float:
        best = np.full(len(self.bias), -np.inf, np.float32)
        reach = max(WIDTHS) - 1
        for i in range(0, max(1, len(tokens)), BLOCK):
            # a block starts with the words that a filter over its first one reaches back to
            p = cache.lookup(self, tokens[max(0, i - reach) : i + BLOCK])
            pad = np.zeros((reach, p.shape[1]), np.float32)
            p = np.concatenate([pad[: reach if i == 0 else 0], p, pad[: reach if i + BLOCK >= len(tokens) else 0]])
            at = 0
            for k, w in enumerate(WIDTHS):
                z = sum(p[j : len(p) - w + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(w))
                best[k * FILTERS : (k + 1) * FILTERS] = np.maximum(best[k * FILTERS : (k + 1) * FILTERS], z.max(axis=0))
                at += w * FILTERS
        z = float(np.maximum(best + self.bias, 0) @ self.out + self.out_bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[str | None], cache: WordCache) -> list[float]:
        """:meth:`score` of each text, whose words are looked up together."""
        tokens = [words(t) for t in texts]
        cache.learn(self, tokens)
        return [self.score(t, cache, w) for t, w in zip(texts, tokens, strict=True)]

    def score(self, text: str | None, cache: WordCache, tokens: list[str] | None = None) -> float:
        """Probability bent so that the threshold of the text's predicted language becomes ``CUT``."""
        p = self.probability(words(text) if tokens is None else tokens, cache)
        lang = self.languages.predict(text)[0] if self.languages and text else ""
        t = self.thresholds.get(lang, self.thresholds.get("", CUT))
        return float(CUT * p / t if p < t else CUT + (1 - CUT) * (p - t) / (1 - t))


class WordCache:
    """Projections of words seen so far, forgotten all at once when there are too many."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, 0), np.float32)

    def learn(self, model: ToxicityModel, texts: list[list[str]]) -> None:
        """The words of several texts, some at a time."""
        new = list(set().union(*texts).difference(self.index))
        if len(self.index) + len(new) > CACHE:
            self.index, new = {}, list(set().union(*texts))
        for i in range(0, min(len(new), CACHE), TOGETHER):
            self.lookup(model, new[i : i + TOGETHER])

    def lookup(self, model: ToxicityModel, tokens: list[str]) -> np.ndarray:
        width = sum(WIDTHS) * FILTERS
        if not tokens:
            return np.zeros((0, width), np.float32)
        try:
            return self.table[np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))]
        except KeyError:
            new = [w for w in dict.fromkeys(tokens) if w not in self.index]
            if len(self.index) + len(new) > CACHE:
                self.index, new = {}, list(dict.fromkeys(tokens))
            n = len(self.index)
            if len(self.table) < n + len(new) or self.table.shape[1] != width:
                grown = np.zeros((max(2 * n, n + len(new), 1024), width), np.float32)
                if n:
                    grown[:n] = self.table[:n]
                self.table = grown
            self.table[n : n + len(new)] = model.projections(new)
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
        return self.table[np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))]


def _padded(emb: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Embeddings of the places ``at`` of a text with zeros before and behind it."""
    k = at - (max(WIDTHS) - 1)
    if not len(own):
        return np.zeros((len(at), emb.shape[1]), np.float32)
    return np.where(((k >= 0) & (k < len(own)))[..., None], emb[own[np.clip(k, 0, len(own) - 1)]], np.float32(0))


def _largest(emb: np.ndarray, own: np.ndarray, filters: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The largest response of each filter over a whole text and where it stands, block by block."""
    n = len(own) + 2 * (max(WIDTHS) - 1)
    best = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
    top = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
    for s in range(0, n, BLOCK):
        x = _padded(emb, own, np.arange(s, min(n, s + BLOCK + max(WIDTHS) - 1)))
        for k, (w, fil) in enumerate(zip(WIDTHS, filters, strict=True)):
            m = min(BLOCK, len(x) - w + 1)
            if m < 1:
                continue
            z = sum(x[j : j + m] @ fil[j] for j in range(w))
            a = z.argmax(axis=0)
            got = z[a, np.arange(FILTERS)]
            more = got > best[k]
            best[k] = np.where(more, got, best[k])
            top[k] = np.where(more, a + s, top[k])
    return best, top


def _ragged(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stretches ``which`` one after the other, and their lengths."""
    n = start[which + 1] - start[which]
    return np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _odds(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-odds of each row between the classes by the texts of either that have it."""
    return np.log((pos / max(1, n1) + 0.02) / (neg / max(1, n0) + 0.02))


def _start(odds: np.ndarray, seed: int) -> tuple[ToxicityModel, np.random.Generator]:
    """The network that training starts from: the first dimension is each row's log-odds."""
    rng = np.random.default_rng(seed)
    rows = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    rows[:, 0] = odds
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :2] = 1.0
    return ToxicityModel(rows, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0), rng


class RowsOfTexts:
    """Counts, for each row, of the toxic and the other texts that have it."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, BUCKETS), np.int64)

    def add(self, texts: list[list[str]], toxic: list[bool]) -> None:
        vocab: dict[str, int] = {}
        ids = [np.array([vocab.setdefault(w, len(vocab)) for w in set(t)], np.int64) for t in texts]
        flat, start = rows_of(list(vocab))
        for own, k in zip(ids, toxic, strict=True):
            hit = np.zeros(BUCKETS, bool)
            hit[flat[_ragged(start, own)[0]]] = True
            self.counts[int(k)] += hit


def _largest_of_batch(emb: np.ndarray, seqs: list[np.ndarray], filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text and filter its largest response and where that stands in the laid out texts; and those, ``len(emb)`` for no word."""
    reach = max(WIDTHS) - 1
    pad = np.full(reach, len(emb), np.int64)
    lay = np.concatenate([x for q in seqs for x in (pad, q, pad)])
    wide = np.concatenate([emb, np.zeros((1, emb.shape[1]), np.float32)])
    ends = np.cumsum([len(q) + 2 * reach for q in seqs])
    best = np.zeros((len(seqs), len(WIDTHS) * FILTERS), np.float32)
    top = np.zeros(best.shape, np.int64)
    for k, (w, fil) in enumerate(zip(WIDTHS, filters, strict=True)):
        m = len(lay) - w + 1
        z = sum((wide @ fil[j])[lay[j : j + m]] for j in range(w))
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        for t, (q, e) in enumerate(zip(seqs, ends.tolist(), strict=True)):
            a = e - len(q) - 2 * reach
            zt = z[a : e - w + 1]
            at = zt.argmax(axis=0)
            best[t, own], top[t, own] = zt[at, np.arange(FILTERS)], at + a
    return best, top, lay


def _largest_by_text(emb: np.ndarray, seqs: list[np.ndarray], filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_largest_of_batch` for texts too long for that, block by block."""
    reach = max(WIDTHS) - 1
    pad = np.full(reach, len(emb), np.int64)
    lay = np.concatenate([x for q in seqs for x in (pad, q, pad)])
    got = [_largest(emb, q, filters) for q in seqs]
    starts = np.cumsum([0] + [len(q) + 2 * reach for q in seqs])[:-1]
    return np.array([np.concatenate(b) for b, _ in got]), np.array([np.concatenate(t) for _, t in got]) + starts[:, None], lay


def _fit_network(texts: list[list[str]], y: np.ndarray, seed: int, odds: np.ndarray | None = None) -> ToxicityModel:
    """Trained on token lists, from the log-odds of all texts where these are a shard."""
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in t], np.int64) for t in texts]
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    if odds is None:
        seen = RowsOfTexts()
        for i in range(0, len(texts), ROWS):
            seen.add(texts[i : i + ROWS], y[i : i + ROWS] == 1)
        odds = _odds(seen.counts[1], seen.counts[0], n1, n0)
    flat, start = rows_of(list(vocab))
    m, rng = _start(odds, seed)
    g2 = {"rows": np.full(BUCKETS, 0.1, np.float32), "bias": np.full_like(m.bias, 0.1), "out": np.full_like(m.out, 0.1)} | {k: np.full_like(f, 0.1) for k, f in enumerate(m.filters)}
    g2_out_bias = 0.1
    weight = np.where(y == 1, 0.5 * len(y) / n1, 0.5 * len(y) / n0)
    place = np.zeros(len(vocab), np.int64)
    for epoch in range(EPOCHS):
        rate = 0.1 / (1 + epoch / 2)
        order = rng.permutation(len(y))
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            seqs = [ids[i][rng.random(len(ids[i])) > 0.2] for i in part]
            mark = np.zeros(len(vocab), bool)
            for q in seqs:
                mark[q] = True
            used = np.flatnonzero(mark)
            if not len(used):
                continue
            place[used] = np.arange(len(used))
            f, n = _ragged(start, used)
            counts = n.astype(np.float32)
            emb = np.add.reduceat(m.rows[flat[f]], np.cumsum(n) - n) / counts[:, None]
            seqs = [place[q] for q in seqs]
            best, top, lay = (_largest_of_batch if sum(map(len, seqs)) <= BLOCK else _largest_by_text)(emb, seqs, m.filters)
            h = best + m.bias
            act = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m.out + m.out_bias, -30, 30)))
            err = ((p - y[part]) * weight[part] / len(part)).astype(np.float32)
            d_out, d_ob = err @ act, float(err.sum())
            d_h = np.where(h > 0, err[:, None] * m.out, 0).astype(np.float32)
            d_bias = d_h.sum(axis=0)
            d_filters = [np.zeros_like(x) for x in m.filters]
            d_emb = np.zeros((len(emb) + 1, DIM), np.float32)
            wide = np.concatenate([emb, np.zeros((1, DIM), np.float32)])
            for k, w in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                dz = d_h[:, own]
                for j in range(w):
                    word = lay[top[:, own] + j]
                    d_filters[k][j] = np.einsum("bfd,bf->df", wide[word], dz)
                    np.add.at(d_emb, word.ravel(), (m.filters[k][j].T * dz[:, :, None]).reshape(-1, DIM))
            d_emb = d_emb[:-1]
            hit = np.abs(d_emb).sum(axis=1).nonzero()[0]
            if len(hit):
                g = np.repeat(d_emb[hit] / counts[hit, None], n[hit], axis=0)
                uf, ui = np.unique(flat[_ragged(start, used[hit])[0]], return_inverse=True)
                gr = np.zeros((len(uf), DIM), np.float32)
                np.add.at(gr, ui, g)
                g2["rows"][uf] += (gr**2).mean(axis=1)
                m.rows[uf] -= rate * gr / np.sqrt(g2["rows"][uf])[:, None]
            for k in range(len(WIDTHS)):
                g2[k] += d_filters[k] ** 2
                m.filters[k] -= rate * d_filters[k] / np.sqrt(g2[k])
            g2["bias"] += d_bias**2
            m.bias -= rate * d_bias / np.sqrt(g2["bias"])
            g2["out"] += d_out**2
            m.out -= rate * d_out / np.sqrt(g2["out"])
            g2_out_bias += d_ob**2
            m.out_bias -= rate * d_ob / np.sqrt(g2_out_bias)
    return m


def _threshold(p: np.ndarray, y: np.ndarray, prior: float, size: np.ndarray | None = None) -> float:
    """The cut with the best F1, in the middle of the gap above the best one, drawn to ``prior`` where there are few toxic texts.

    ``size`` says of how many texts, ``y`` of how many toxic ones a row is the sum.
    """
    n = float(y.sum())
    if not n:
        return prior
    order = np.argsort(-p, kind="stable")
    tp = np.cumsum(y[order])
    f1 = 2 * tp / ((np.arange(1, len(p) + 1) if size is None else np.cumsum(size[order])) + n)
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    own = float(np.clip((p[order[k]] + below) / 2, 0.02, 0.98))
    return (n * own + PRIOR_TEXTS * prior) / (n + PRIOR_TEXTS)


def fit(sample: list[tuple[str, object]], languages: langid.LanguageModel | None, seed: int = 11) -> ToxicityModel | None:
    """A model of (text, toxic) rows; None unless both classes are there.

    Every fifth row of either class calibrates only: it sets the common threshold,
    starting from :data:`PRIOR`, and those of the languages, starting from that.
    """
    y = np.array([float(bool(k)) for _, k in sample])
    if not 0 < y.sum() < len(y):
        return None
    texts = [words(t) for t, _ in sample]
    # every fifth of either class, so that the part for calibration has both
    rank = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)).astype(int)
    held = rank % 5 == 0
    model = _fit_network([t for t, h in zip(texts, held, strict=True) if not h], y[~held], seed)
    model.languages = languages
    cache = WordCache()
    p = np.array([model.probability(t, cache) for t, h in zip(texts, held, strict=True) if h])
    common = _threshold(p, y[held], PRIOR)
    model.thresholds = {"": common}
    if languages:
        lang = np.array([languages.predict(t)[0] if t else "" for (t, _), h in zip(sample, held, strict=True) if h])
        model.thresholds |= {str(x): _threshold(p[lang == x], y[held][lang == x], common) for x in set(lang) - {""}}
    return model


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = RowsOfTexts()
    for b in sliced(batches):
        seen.add([words(t) for t in b["text"].to_pylist()], b["toxic"].to_pylist())
    if seen.counts.any():
        yield pa.RecordBatch.from_arrays([pa.array([False]), *(pa.array([x], pa.list_(pa.int64())) for x in seen.counts)], ["one", "other", "toxic"])


def _network(odds: np.ndarray, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Of a shard, what training changed: parts of the rows with which were changed, then all the rest."""

    def run(table: pa.Table) -> pa.Table:
        rows = in_order(table, "toxic")
        model = _fit_network([words(t) for t, _ in rows], np.array([float(k) for _, k in rows]), seed, odds)
        old, _ = _start(odds, seed)
        changed = (model.rows != old.rows).any(axis=1)
        both = np.concatenate([fixed(model.rows - old.rows), changed[:, None].astype(np.int32)], axis=1)
        parts = [k for k in range(BUCKETS // PART) if changed[k * PART : (k + 1) * PART].any()]
        values = [both[k * PART : (k + 1) * PART].tobytes() for k in parts]
        give_back()
        return pa.table({"part": pa.array([*parts, -1], pa.int32()), "value": pa.array([*values, fixed(_rest(model) - _rest(old)).tobytes()], pa.binary())})

    return run


def _rest(m: ToxicityModel) -> np.ndarray:
    return np.concatenate([*(f.ravel() for f in m.filters), m.bias, m.out, [m.out_bias]]).astype(np.float64)


def _averaged(odds: np.ndarray, seed: int, parts: list) -> ToxicityModel:
    """The start and the mean of what shards changed; of a row, of the shards that changed it."""
    m, _ = _start(odds, seed)
    for r in parts:
        got = np.frombuffer(r["value"], np.int64)
        if r["part"] >= 0:
            got = got.reshape(PART, DIM + 1)
            m.rows[r["part"] * PART : (r["part"] + 1) * PART] += (got[:, :DIM] / UNIT / np.maximum(1, got[:, DIM:])).astype(np.float32)
        else:
            rest = (_rest(m) + got / UNIT / r["n"]).astype(np.float32)
            at = 0
            for f in m.filters:
                f[...] = rest[at : at + f.size].reshape(f.shape)
                at += f.size
            n = len(m.bias)
            m.bias, m.out, m.out_bias = rest[at : at + n], rest[at + n : at + 2 * n], float(rest[-1])
    return m


def _calibrated(rows: DataFrame, model: ToxicityModel) -> dict[str, float]:
    """The thresholds by all of ``rows(text, toxic)``, whose probabilities are counted by steps of the :data:`STEPS`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for b in sliced(batches):
            texts = b["text"].to_pylist()
            tokens = [words(t) for t in texts]
            cache.learn(model, tokens)
            step = [int(model.probability(t, cache) * STEPS) for t in tokens]
            lang = [model.languages.predict(t)[0] if model.languages and t else "" for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(step, pa.int32()), b["toxic"]], ["lang", "step", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(handed_back(run), "lang string, step int, toxic boolean")
    got = got.groupBy("lang", "step").agg(F.sum(F.col("toxic").cast("int")).alias("y"), F.count("*").alias("n")).toArrow().sort_by([("lang", "ascending"), ("step", "ascending")])
    lang, p = got["lang"].to_numpy(), (got["step"].to_numpy() + 0.5) / STEPS
    y, n = got["y"].to_numpy().astype(float), got["n"].to_numpy().astype(float)
    steps, at = np.unique(p, return_inverse=True)
    common = _threshold(steps, np.bincount(at, y), PRIOR, np.bincount(at, n)) if len(p) else PRIOR
    return {"": common} | {str(x): _threshold(p[lang == x], y[lang == x], common, n[lang == x]) for x in set(lang) - {""}}


def train(docs: DataFrame, labels: DataFrame, keep: F.Column, seed: int = 11) -> ToxicityModel | None:
    """Learned from all texts of the labelled rows that ``keep`` holds for; None unless both classes are there.

    Up to :data:`SHARD` of them are fitted at once. Of more, a fifth by hash calibrates
    and the others train: rows are counted over all of them, a network is trained
    on each shard from the start that these counts give, and what the shards changed is averaged.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") != 0).alias("toxic")).where(keep).distinct()
    rows = docs.where(keep & F.col("text").isNotNull()).select("doc_id", "text").join(broadcast_if_small(own, own.count()), "doc_id")
    rows = rows.select("text", "toxic", key().alias("h_"), (F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(5)) == 0).alias("held"))
    got = rows.groupBy("held", "toxic").agg(F.count("*").alias("n")).collect()
    sizes = {k: sum(r["n"] for r in got if r["toxic"] == k) for k in (False, True)}
    if not all(sizes.values()):
        return None
    languages = langid.train(docs, keep)
    if sum(sizes.values()) <= SHARD:
        return fit(in_order(rows.toArrow(), "toxic"), languages, seed)
    ours = {r["toxic"]: r["n"] for r in got if not r["held"]}
    if len(ours) < 2:  # too few of a class for some to calibrate only
        rows, ours = rows.withColumn("held", F.lit(False)), sizes
    learned = rows.where(~F.col("held"))
    counts = summed(learned.select("text", "toxic").withColumn("one", F.lit(False)), handed_back(_row_counts), ["other", "toxic"], "one")
    by_class = np.zeros((2, BUCKETS))
    by_class[:, counts["pos"].to_numpy()] = counts["other"].to_numpy(), counts["toxic"].to_numpy()
    odds = _odds(by_class[1], by_class[0], ours[True], ours[False])
    shards, _ = sharded(learned.select("text", "toxic", "h_"), "toxic", ours, SHARD)
    parts = added(shards.groupBy("shard").applyInArrow(_network(odds, seed), "part int, value binary")).collect()
    model = _averaged(odds, seed, parts)
    model.languages = languages
    model.thresholds = _calibrated(rows.where(F.col("held")), model)
    return model


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, score)``, a row for each row.

    Null and empty texts are scored as texts without words. Without a model every
    score is 0. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for b in sliced(batches):
            texts = b["text"].to_pylist()
            s = model.scores(texts, cache) if model else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(handed_back(run), f"doc_id {kind}, score double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned where crc32(doc_id) mod 4 is not 2, null ids left out of learning."""
    model = train(docs, labels, fold(4) != 2)
    held = F.coalesce(fold(4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The documents whose score stays under the cut, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        for b in sliced(batches):
            ok = [model is None or s < CUT for s in (model.scores(b["text"].to_pylist(), cache) if model else [0.0] * b.num_rows)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(handed_back(run), docs.schema)
