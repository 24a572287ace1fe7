import re

import pytest

from panelwright.llm import license_scan as S
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in S.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i), labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_equals_brute_force(spark):
    docs = odd_docs(spark, ["The MIT License.\nand mit\nlicense", "mit licenses", "gnu General_Public License General Public license", "é mit license " * 2000, "Apache-License apache license", "MIT\x00License"])
    got = sorted(str(tuple(r)) for r in S.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == sorted(str((r.doc_id, *base(r.text))) for r in docs.collect())
    assert S.scan_licenses(none_docs(spark)).count() == 0


@pytest.mark.parametrize("text,labels,score", [
    ("Released under the MIT License.", "mit", 1.0),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0", 1.0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", 1.0),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 1.0),
    ("Copyright 2020 A B\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit", 1.0),
    ("Redistribution and use in source and binary forms with modification", "", None),
    ("mit license", "mit", 0.5),
    ("", "", 0.0),
])
def test_templates(text, labels, score):
    got = S.scanner(tuple(S.BASE), tuple(S.TEMPLATES)).scan(text)
    assert got[5] == labels and (got[6] == score if score is not None else 0 < got[6] < 1)


def test_regions():
    a = S.compile_template("x", "a [[b [[c]]]] {{1-2}} d")
    ok = lambda s: a.run([w.encode() for w in s.split()], 0)[0] >= 0
    assert ok("a q d") and ok("a b q d") and ok("a b c q q d") and ok("a b d d") and not ok("a d") and not ok("a b c") and not ok("a q q q q q d")
    with pytest.raises(ValueError):
        S.compile_template("x", "a [[b")
    with pytest.raises(ValueError):
        S.Scanner([], [("x", "[[b]]")])


@needs_data
def test_query_base_on_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:6] for r in S.scan_licenses(docs).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}
