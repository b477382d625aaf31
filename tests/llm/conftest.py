"""Small tables that hold the awkward cases."""

from __future__ import annotations

import random

import pytest

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents: nulls in every column, empty, blank and long texts, repeated rows and ids, clashing columns."""
    rnd = random.Random(9)
    a, b = prose(rnd, 60), prose(rnd, 60)
    rows = [
        (1, a, "en", "s1", 1), (1, a, "en", "s1", 1), (2, a, "en", None, 2), (3, None, None, "s2", None), (4, "", "en", "s2", 0),
        (5, "  \t\n ", None, "s1", 4), (None, b, "fr", "s1", 3), (None, None, None, None, None), (6, b + " end", "fr", "s3", 5),
        (7, "x " * 40_000, "en", "s1", 6), (8, "été ÀÉ 日本 ß\n" + b, "fr", "s2", 7), (1, b, "en", "s1", 8), (9, "one", "en", "s9", 3), (10, "ONE", "en", "s9", 3),
    ]
    extra = "size long, h long, node long, fp string, diag int, line string, row long, score double, drop_ string, mix_copies long, source_size long, id_ long, p1_ long, p2_ string, d string, g string, row_ long"
    full = [(*r, r[0], 1, 1, "f", 1, "l", 1, 0.5, "d", 1, 1, 1, 1, "p", "d", "g", 1) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + extra)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
