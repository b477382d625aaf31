"""Hierarchical language identification.

A document's family is decided by mean log-likelihoods of hashed character
trigrams; inside the family, one-versus-one linear support vector machines on the
same trigrams vote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import handed_back, sliced
from .sampling import fold
from .shards import added, fixed, in_order, key, sharded, summed

BUCKETS = 1 << 13
#: Texts that a task fits machines on; of more there are several shards, whose machines are averaged.
SHARD = 1000
#: Fixed-point unit of a frequency, and languages whose sums a task holds before it hands them on.
FREQUENCY, HELD = 1 << 30, 64
EPOCHS = 12
#: Characters whose trigrams are looked up at once.
BLOCK = 1 << 18
UNKNOWN = "und"

#: Families of ISO 639-1 codes. A language of no listed family is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character trigrams of a lower-cased text, all but letters read as one space each."""
    low = text.lower()
    for i in range(0, len(low), BLOCK):
        part = low[max(0, i - 2) : i + BLOCK]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7)), c, 32).astype(np.uint32)
        if len(c) < 3:
            c = np.concatenate([c, np.full(3 - len(c), 32, np.uint32)])
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(19)).astype(np.int64)


def frequencies(text: str) -> np.ndarray:
    n = np.zeros(BUCKETS)
    for g in trigrams(text):
        n += np.bincount(g, minlength=BUCKETS)
    return (n / max(1.0, n.sum())).astype(np.float32)


@dataclass
class LanguageModel:
    """``table`` holds the families' log-probabilities, then the pairs' weights, by bucket."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[int, int, int]]
    table: np.ndarray
    bias: np.ndarray

    @cached_property
    def wide(self) -> np.ndarray:
        return self.table.astype(np.float64)

    def predict(self, text: str) -> tuple[str, float]:
        """(language, confidence) of a text that has a letter."""
        seen, n = np.zeros(BUCKETS), 0
        for g in trigrams(text):
            seen += np.bincount(g, minlength=BUCKETS)
            n += len(g)
        mean = self.wide @ seen / max(1, n)
        k = len(self.families)
        like = mean[:k] * min(n, 60)
        p = np.exp(like - like.max())
        f = int(p.argmax())
        langs = self.members[f]
        votes, margin, sure = np.zeros(len(langs)), np.zeros(len(langs)), float(p[f] / p.sum())
        for q, (fam, i, j) in enumerate(self.pairs):
            if fam == f:
                m = mean[k + q] + self.bias[q]
                votes[i if m > 0 else j] += 1
                margin[i] += m
                margin[j] -= m
        best = max(range(len(langs)), key=lambda i: (votes[i], margin[i]))
        if len(langs) > 1:
            sure *= float(1 / (1 + np.exp(-np.clip(4 * margin[best] / (len(langs) - 1), -30, 30))))
        return langs[best], sure


def _svm(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Linear SVM by averaged stochastic subgradients; y is +1 or -1."""
    rng, lam = np.random.default_rng(seed), 1e-4
    w, b, avg, avg_b, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1]), 0.0, 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1 / (lam * (t + 1000))
            w *= 1 - rate * lam
            if y[i] * (x[i] @ w + b) < 1:
                w += rate * y[i] * x[i]
                b += 0.01 * rate * lam * y[i]
        avg += w
        avg_b += b
    return avg / EPOCHS, avg_b / EPOCHS


def _log_odds(n: np.ndarray) -> np.ndarray:
    return np.log((n * 1000 + 0.1) / (n.sum() * 1000 + 0.1 * BUCKETS))


def _machine(x: np.ndarray, y: np.ndarray, scale: np.ndarray, q: int) -> tuple[np.ndarray, float]:
    """The machine of pair ``q`` on frequencies whose frequent trigrams ``scale`` evens out."""
    return _svm(x / scale * 10, y, 7 + q)


def _shape(langs: set[str]) -> tuple[list[str], list[list[str]], list[tuple[int, int, int]]]:
    families = sorted({family_of(lang) for lang in langs})
    members = [sorted(lang for lang in langs if family_of(lang) == f) for f in families]
    return families, members, [(f, i, j) for f, own in enumerate(members) for i, j in combinations(range(len(own)), 2)]


def fit(sample: list[tuple[str, object]]) -> LanguageModel | None:
    """A model of (text, language) rows; None where there are none."""
    if not sample:
        return None
    x, langs = np.array([frequencies(t) for t, _ in sample]), np.array([str(lang) for _, lang in sample])
    families, members, pairs = _shape(set(langs.tolist()))
    logs = [_log_odds(x[np.isin(langs, own)].sum(axis=0, dtype=np.float64)) for own in members]
    weights, bias = [], []
    for q, (f, i, j) in enumerate(pairs):
        own = (langs == members[f][i]) | (langs == members[f][j])
        scale = np.sqrt(x[own].mean(axis=0)) + np.float32(1e-3)
        w, b = _machine(x[own], np.where(langs[own] == members[f][i], 1.0, -1.0), scale, q)
        weights.append(w * 10 / scale)
        bias.append(b)
    return LanguageModel(families, members, pairs, np.array([*logs, *weights], np.float32), np.array(bias))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the frequencies of each language's texts."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.int64()))], ["lang", "n"])

    total: dict[str, np.ndarray] = {}
    for b in sliced(batches):
        for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
            if lang not in total and len(total) >= HELD:
                yield out()
                total = {}
            own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.rint(frequencies(t).astype(np.float64) * FREQUENCY).astype(np.int64)
    if total:
        yield out()


def train(docs: DataFrame, keep: F.Column) -> LanguageModel | None:
    """Fitted on all texts of the rows that ``keep`` holds for and that have an id and a language.

    Up to :data:`SHARD` of them are fitted at once. Of more, the families' frequencies
    are added over all texts, and the machines are fitted shard by shard and averaged.
    """
    rows = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", key().alias("h_"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= SHARD:
        return fit(in_order(rows.toArrow(), "lang"))
    families, members, pairs = _shape(set(sizes))
    sums = {lang: np.zeros(BUCKETS) for lang in sizes}
    got = summed(rows.select("lang", "text"), handed_back(_sums), ["n"], "lang").sort_by("lang")
    at, pos, n = got["lang"].to_numpy(), got["pos"].to_numpy(), got["n"].to_numpy() / FREQUENCY
    for lang, i, j in zip(*_runs(at), strict=True):
        sums[lang][pos[i:j]] = n[i:j]
    logs = [_log_odds(sum(sums[lang] for lang in own)) for own in members]
    ends = [(members[f][i], members[f][j]) for f, i, j in pairs]
    scales = [(np.sqrt((sums[a] + sums[b]) / (sizes[a] + sizes[b])) + 1e-3).astype(np.float32) for a, b in ends]
    weights, bias = [np.zeros(BUCKETS)] * len(pairs), np.zeros(len(pairs))
    paired = {lang: sizes[lang] for pair in ends for lang in pair}
    if paired:
        shards, _ = sharded(rows, "lang", paired, SHARD)
        for r in added(shards.groupBy("shard").applyInArrow(_machines(ends, scales), "part int, value binary")).collect():
            w = np.frombuffer(r["value"], np.int64) / (r["n"] * float(1 << 20))
            weights[r["part"]], bias[r["part"]] = w[:-1] * 10 / scales[r["part"]], w[-1]
    return LanguageModel(families, members, pairs, np.array([*logs, *weights], np.float32), bias)


def _runs(x: np.ndarray) -> tuple[list, list[int], list[int]]:
    """Values of a sorted array and where each begins and ends."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[start].tolist(), start.tolist(), [*start[1:].tolist(), len(x)] if len(x) else []


def _machines(ends: list[tuple[str, str]], scales: list[np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """Of a shard, the machine of each pair of languages that it has both of: weights, then the bias."""

    def run(table: pa.Table) -> pa.Table:
        rows = in_order(table, "lang")
        x, langs = np.empty((len(rows), BUCKETS), np.float32), np.array([lang for _, lang in rows])
        for k, (t, _) in enumerate(rows):
            x[k] = frequencies(t)
        parts, values = [], []
        for q, (a, b) in enumerate(ends):
            own = (langs == a) | (langs == b)
            if (langs == a).any() and (langs == b).any():
                w, bias = _machine(x[own], np.where(langs[own] == a, 1.0, -1.0), scales[q], q)
                parts.append(q)
                values.append(fixed(np.append(w, bias)).tobytes())
        return pa.table({"part": pa.array(parts, pa.int32()), "value": pa.array(values, pa.binary())})

    return run


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, lang_pred, score)``, a row for each row.

    ``und`` with score 0 where the text is null or has no letter, and where no
    model could be fitted. Extra columns are ignored.
    """
    d = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = [model.predict(t) if model and t else (UNKNOWN, 0.0) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned where crc32(doc_id) mod 5 is not 0, null ids left out of learning."""
    model = train(docs, fold(5) != 0)
    held = F.coalesce(fold(5) == 0, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
