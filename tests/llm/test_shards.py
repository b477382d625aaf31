"""Models learned from all labelled texts, shard by shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quiescent.llm import langid, shards, toxicity

from .test_ops import corpus


def test_all_labelled_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 150)
    monkeypatch.setattr(langid, "SHARD", 150)
    rows = corpus(900, 4, ("scumbag", "worthless", "idiot"))
    # a word that stands in one text alone is known too, whichever it is
    rows = [(i, f"{t} einmalig{i}", lang, k) for i, t, lang, k in rows]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    start, _ = toxicity._start(np.zeros(toxicity.BUCKETS), 11)
    own, _ = toxicity.rows_of([f"einmalig{i}" for i in range(900)])
    first = own[np.concatenate([[0], np.cumsum([toxicity.features_of([f"einmalig{i}"])[1][0] for i in range(899)])])]
    seen = model.rows[first, 0] != toxicity._odds(np.zeros(1), np.zeros(1), 1, 1)[0]
    assert seen.mean() > 0.75  # all but the fifth that calibrates
    assert sum((model.score(t, toxicity.WordCache()) >= toxicity.CUT) == bool(k) for _, t, _, k in rows) >= 0.95 * len(rows)
    again = toxicity.train(docs.repartition(7), labels.repartition(3), F.lit(True))
    assert np.array_equal(model.rows, again.rows) and model.thresholds == again.thresholds and np.array_equal(model.out, again.out)
    assert np.array_equal(model.languages.table, again.languages.table)
    assert sum(model.languages.predict(t)[0] == lang for _, t, lang, _ in rows) >= 0.98 * len(rows)


def test_every_row_is_in_a_shard(spark):
    rows = [(k, f"text {k}", "rare" if k % 300 == 0 else "often", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, h_ long").drop("doc_id")
    got, n = shards.sharded(df, "lang", {"rare": 10, "often": 2990}, 300)
    at = got.collect()
    assert n == 10 and {r.text for r in at} == {r[1] for r in rows}
    assert {sum(r.shard == k and r.lang == "rare" for r in at) for k in range(n)} == {10}
    assert sum(r.lang == "often" for r in at) == 2990
    parts = spark.createDataFrame([(k % 3, np.full(4, k, np.int32).tobytes()) for k in range(9)], "part int, value binary")
    assert {r.part: (r.n, np.frombuffer(r.value, np.int64).tolist()) for r in shards.added(parts).collect()} == {k: (3, [3 * k + 9] * 4) for k in range(3)}


def test_grams_are_hashed_as_one_by_one():
    words = ["a", "ab", "hello", "é日本", "x" * 50, "wort_12", "\ud800x"]
    flat, start = toxicity.rows_of(words)
    assert [flat[a:b].tolist() for a, b in zip(start, start[1:])] == [toxicity.features(w).tolist() for w in words]  # noqa: B905
