"""License scans with template markup.

A template is wording with two kinds of regions: ``[[ ... ]]`` may be missing (regions nest), ``{{a-b}}`` stands for any
a to b words (a copyright line, a year, a name). It is compiled into an automaton over word tokens: states are token
positions, optional regions are skips, replaceable regions are counted wild steps. A text carries the template if the
automaton accepts from some word on, so all mandatory wording matched exactly. The base phrases are templates without
regions. Automata run only from words that can begin a template, and only in texts that hold its longest mandatory word.

Words are maximal runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters. Nulls and odd cases: a null or
empty text has no word and no label; whole texts are read, however long; rows are judged one by one, so repeated rows and
null ids pass through; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from panelwright.llm.common import column, map_slices, need, texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Public license wordings as templates.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "[[mit license]] [[copyright {{0-12}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license"),
    ("gpl-2.0", "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version {{1-2}}"),
    ("lgpl", "under the terms of the gnu [[lesser]] [[library]] general public license {{0-12}} version {{1-2}} of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "[[this source code form is]] subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc [[4 0]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] creative commons attribution noncommercial {{0-4}} license"),
    ("cc-by", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by-sa", "licensed under [[a]] [[the]] cc by sa [[4 0]]"),
    ("cc0", "[[dedicated to the public domain]] under cc0 [[1 0]]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")
ANY = b"*any*"


@dataclass
class Automaton:
    """``steps[s]``: (token or ANY, next state); ``skips[s]``: states reached without a word."""

    label: str
    steps: list[list[tuple[bytes, int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    final: int = 0
    mandatory: list[bytes] = field(default_factory=list)
    #: Mandatory words read on the way to a state.
    read: list[int] = field(default_factory=list)

    def state(self, read: int) -> int:
        self.steps.append([])
        self.skips.append([])
        self.read.append(read)
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def first(self) -> set[bytes]:
        return {t for s in self.closure({0}) for t, _ in self.steps[s]}

    def run(self, words: list[bytes], at: int) -> tuple[int, float]:
        """End of the shortest accepted run from word ``at`` (-1: none) and the share of mandatory words reached."""
        now, best = self.closure({0}), 0
        while True:
            best = max(best, max(self.read[s] for s in now))
            if self.final in now:
                return at, 1.0
            if at == len(words):
                break
            w = words[at]
            now = self.closure({n for s in now for t, n in self.steps[s] if t == w or t is ANY})
            at += 1
            if not now:
                break
        return -1, best / max(1, len(self.mandatory))


def compile_template(label: str, text: str) -> Automaton:
    a = Automaton(label)
    at, opened = a.state(0), []
    for m in _MARK.finditer(text):
        tok = m[0]
        if tok == "[[":
            opened.append((at, len(a.mandatory)))
        elif tok == "]]":
            begin, _ = opened.pop()
            a.skips[begin].append(at)
        elif m[1] is not None:
            low, high = int(m[1]), int(m[2])
            entries = []
            for k in range(high):
                if k >= low:
                    entries.append(at)
                nxt = a.state(len(a.mandatory))
                a.steps[at].append((ANY, nxt))
                at = nxt
            for e in entries:
                a.skips[e].append(at)
        else:
            word = tok.lower().encode()
            if not opened:
                a.mandatory.append(word)
            nxt = a.state(len(a.mandatory))
            a.steps[at].append((word, nxt))
            at = nxt
    if opened:
        raise ValueError(f"unclosed region in template of {label}")
    a.final = at
    return a


class Scanner:
    def __init__(self, base: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.base = [compile_template(label, phrase) for phrase, label in base]
        self.extra = [compile_template(label, text) for label, text in templates]
        for a in self.base + self.extra:
            if not a.mandatory:
                raise ValueError(f"the template of {a.label} has no mandatory word")
        self.plan = [(max(a.mandatory, key=len), a.first(), a, k < len(self.base)) for k, a in enumerate(self.base + self.extra)]

    def scan(self, text: str | None) -> tuple:
        low = (text or "").encode("utf-8", "replace").lower()
        words = WORD.findall(low)
        starts, base_labels, labels, score, spans = [], set(), set(), 0.0, []
        live = [x for x in self.plan if x[0] in low]
        if live:
            wanted = set().union(*(x[1] for x in live))
            for i in [i for i, w in enumerate(words) if w in wanted]:
                for _, first, a, is_base in live:
                    if words[i] not in first:
                        continue
                    end, share = a.run(words, i)
                    if end >= 0:
                        spans.append((i, end, a.label))
                        labels.add(a.label)
                        if is_base:
                            starts.append(i)
                            base_labels.add(a.label)
                    if not is_base:
                        score = max(score, share)
        if base_labels:
            score = max(score, 0.5)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


@lru_cache(maxsize=8)
def scanner(base: tuple, templates: tuple) -> Scanner:
    return Scanner(list(base), list(templates))


def scan_licenses(docs: DataFrame, base=tuple(BASE), templates=tuple(TEMPLATES)) -> DataFrame:
    """Per row: doc_id, n_words, base places (number, smallest, largest start), labels, score, and all accepted spans.

    ``score`` is the largest share of a template's mandatory words matched in order from its beginning (1: accepted), at
    least 0.5 where a base phrase stands."""
    base, templates = tuple(map(tuple, base)), tuple(map(tuple, templates))
    scanner(base, templates)  # a faulty template fails here, not in a task

    def run(batch):
        s = scanner(base, templates)
        rows = [s.scan(t) for t in texts(batch)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        out = {n: [r[k] for r in rows] for k, n in enumerate(names)}
        out["spans"] = [[{"first": i, "end": e, "label": x} for i, e, x in r[7]] for r in rows]
        return out | {"doc_id": column(batch, "doc_id")}

    return map_slices(need(docs, doc_id="long", text="string"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first: long, end: long, label: string>>")
