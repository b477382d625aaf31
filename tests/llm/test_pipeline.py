"""The pipeline's stages keep what they should, in order, and its queries are registered."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from quiescent.llm.oracles import ORACLES
from quiescent.llm.queries import QUERIES

from .conftest import prose
from .test_ops import plain_hits


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    bad = ["worthless", "scumbag", "pathetic"]
    items = [(i, prose(rnd, 20)) for i in range(5)]
    rows, toxic, kind = [], [], {}

    def add(text, what, source="s1"):
        kind[len(rows)] = what
        rows.append((len(rows), text, "en", source, len(text or "")))
        toxic.append(int(what == "toxic"))

    for i in range(160):
        w = prose(rnd, 80).split()
        if i % 4 == 0:
            for k in range(3):
                w[10 * k + 5] = rnd.choice(bad)
        add(" ".join(w), "toxic" if i % 4 == 0 else "clean", f"s{i % 3}")
    clean = [r for r in rows if kind[r[0]] == "clean"]
    for r in clean[:6]:
        add(r[1], "copy")
        w = r[1].split()
        w[40] = "changed"
        add(" ".join(w), "near")
    for i, t in items:
        add(prose(rnd, 40) + " " + t + " " + prose(rnd, 30), "leak")
    add(None, "null")
    add("", "blank")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, cur, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        cur = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in cur.select("doc_id").collect()}
    of = lambda ids, what: [i for i in ids if kind[i] == what]
    assert len(of(kept["toxicity"], "toxic")) <= 2 and len(of(kept["toxicity"], "clean")) >= 118
    assert kept["line_dedup"] == kept["toxicity"]
    assert not of(kept["near_dedup"], "copy") and not of(kept["near_dedup"], "near")
    assert len(of(kept["near_dedup"], "clean")) == len(of(kept["line_dedup"], "clean"))
    assert not of(kept["decontamination"], "leak") and of(kept["decontamination"], "clean") == of(kept["near_dedup"], "clean")
    hits = {r[0] for r in plain_hits([(r[0], r[1]) for r in rows if r[0] in kept["near_dedup"]], items) if r[5]}
    assert kept["near_dedup"] - kept["decontamination"] == hits
    assert kept["mixing"] <= kept["decontamination"]
    assert P.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == len(kept["mixing"])


def test_awkward_rows_pass_every_stage(spark, odd, empty, sf):
    for d in (odd, empty):
        cur = d
        for name, stage in P.STAGES:
            cur = stage(spark, cur, sf)
            assert cur.count() <= d.count(), name


def test_passages_of_few_documents_go(spark, tmp_path):
    rnd = random.Random(5)
    rows, want = [], []
    for n in (2, 3, 6):  # so many unrelated documents share a passage of 60 words
        passage = prose(rnd, 60)
        for k in range(n):
            own = [prose(rnd, 70), prose(rnd, 70)]
            rows.append((len(rows), "\n".join([own[0], passage, own[1]])))
            want.append("\n".join([own[0], passage, own[1]] if not k else own))
    again, own = prose(rnd, 20), prose(rnd, 70)
    rows += [(len(rows), f"{again}\n{own}\n{again}\n{again}"), (len(rows) + 1, rows[1][1])]  # repeats inside, a whole copy
    want += [f"{again}\n{own}", want[1]]
    rows.append((len(rows), f"{rows[0][1]}\n{again}"))  # put together of lines of others
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = P.drop_lines(spark, df, "")
    assert {r.doc_id: r.text for r in out.collect()} == dict(enumerate(want))
    left = {r.doc_id for r in P.drop_copies(spark, out, "").collect()}
    assert left == set(range(len(want) - 1))


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES) and P.ORACLE_SQL is None
