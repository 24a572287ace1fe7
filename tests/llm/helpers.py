"""Small frames with every odd case, and the tables the queries run on."""

import os
import random

import pytest

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, line string, _did string, ids string"


def words(seed, n, syllables="ka lo mi re tu va ne so pi da".split()):
    r = random.Random(seed)
    return ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]


def odd_docs(spark, more=()):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing further columns."""
    base = " ".join(words(1, 300))
    rows = [(0, base, "xx", "s"), (1, base, "xx", "s"), (1, base, "xx", "s"), (1, "another text under one id", "xx", None), (2, None, None, None), (None, base, None, "s"), (None, None, "xx", "s"),
            (3, "", "xx", "s"), (4, "\n\n \t\n", "yy", "s"), (5, "123 456", "yy", "s"), (6, " ".join(words(2, 40_000)), "yy", "s"), (7, "a" * 5000, None, "s"), (8, "same line here\nsame line here\nx", "xx", "s")]
    rows += [(100 + k, t, "xx", "s") for k, t in enumerate(more)]
    return spark.createDataFrame([(*r, None, 0.5, "clash", "clash", "clash") for r in rows], SCHEMA)


def none_docs(spark):
    return spark.createDataFrame([], SCHEMA)
