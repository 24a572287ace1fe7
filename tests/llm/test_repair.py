"""Conversation repair against every possible edit, and the query against SQL and a plain walk."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import product

import duckdb
import pytest

from panelwright.llm import repair
from tests.llm.helpers import DATA, needs_data

SCHEMA = "conv_id long, turn long, role string, text string, audit string, _c string, gaps int"
LEGAL = re.compile(r"(s?(ua)+)?")


def every_edit(rows):
    """(cost, audit, repaired lines) of the best of all edits of rows (role, text, must go, truncated)."""
    best = None
    options = []
    for role, text, go, cut in rows:
        options.append([("D", 3, None)] + ([] if go else [("K", int(cut), (role, text)), ("R", 2 + cut, ("user", text)), ("R", 2 + cut, ("assistant", text))]))
    fill = [()] + [p for n in (1, 2) for p in product(("user", "assistant"), repeat=n)]
    for picked in product(*options):
        for between in product(fill, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, ins in enumerate(between):
                for role in ins:
                    cost, audit = cost + 2, audit + "I"
                    out.append((role, ""))
                if k < len(rows):
                    letter, c, kept = picked[k]
                    cost, audit = cost + c, audit + letter
                    out += [kept] if kept else []
            if LEGAL.fullmatch("".join((r or "?")[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in out]
    return best


def plain(rows, best_of):
    """The report by plain loops over rows (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups[c].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text, turn))
    out = []
    for c, g in groups.items():
        g.sort()
        seen, judged, blank, dup, trunc = set(), [], 0, 0, 0
        for *_, role, _d, text, _t in g:
            body = text.rstrip(" \t\n\x0b\f\r")
            b = not body
            d = not b and (role, text) in seen
            t = not b and not d and body[-1] not in ".!?"
            seen.add((role, text))
            blank, dup, trunc = blank + b, dup + d, trunc + t
            judged.append((role, text, b or d, t))
        initials = [r[:1] for r, *_ in judged]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        turns = {x[-1] for x in g if x[0]}
        cost, audit, lines = best_of(judged)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, dup, trunc, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, 0 if x is None else x) for x in r)


def found(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=key)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA).repartition(parts)


def made_up(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(r.randint(1, most)):
            rows.append((c if c else None, r.choice([k, k, k, k + 2, None, 1]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["yes.", "no", "why? \n", "", None, "x" * 5 + "!", f"t{k}.", "é"])))
    return rows


def walk(rows):
    """Plain dynamic programme over the automaton of the grammar, in place of all edits; for longer conversations."""
    states = {"0": (0, "", ())}
    go = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def put(d, state, value):
        if state not in d or value[:2] < d[state][:2]:
            d[state] = value

    def closed(d):
        for _ in range(3):
            for s, (c, w, o) in list(d.items()):
                for t, role in (("u", "user"), ("a", "assistant")):
                    if (s, t) in go:
                        put(d, go[s, t], (c + 2, w + "I", (*o, f"{role}:")))
        return d

    for role, text, must, cut in rows:
        new: dict = {}
        for s, (c, w, o) in closed(dict(states)).items():
            put(new, s, (c + 3, w + "D", o))
            if not must:
                if (s, role[:1]) in go:
                    put(new, go[s, role[:1]], (c + cut, w + "K", (*o, f"{role}:{text}")))
                for t, other in (("u", "user"), ("a", "assistant")):
                    if (s, t) in go:
                        put(new, go[s, t], (c + 2 + cut, w + "R", (*o, f"{other}:{text}")))
        states = new
    return min(v for s, v in closed(dict(states)).items() if s in "0a")


def test_small_conversations_equal_all_edits(spark):
    rows = made_up(5, 60, 3)
    assert found(repair.report(frame(spark, rows))) == sorted(plain(rows, every_edit), key=key)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_and_ranges_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made_up(6, 25, 40) + made_up(7, 2, 300)
    assert found(repair.report(frame(spark, rows))) == sorted(plain(rows, walk), key=key)


def test_walks_agree():
    r = random.Random(4)
    for _ in range(300):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), f"{k}", r.random() < 0.2, r.random() < 0.3) for k in range(r.randint(0, 3))]
        cost, audit, lines = walk(rows)
        assert (cost, audit, list(lines)) == every_edit(rows)


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", ""), (2, 1, "system", "Be kind."), (2, 2, "user", "So?"), (2, 3, "assistant", "Yes.")]
    got = repair.repaired(frame(spark, rows)).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.edit, r.role, r.text) for r in got] == [
        (1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "Hi."), (1, 3, "I", "assistant", ""),
        (2, 0, "K", "system", "Be kind."), (2, 1, "K", "user", "So?"), (2, 2, "K", "assistant", "Yes."),
    ]


def test_long_texts_and_one_large_conversation(spark):
    rows = [(3, k, "user" if k % 2 else "assistant", "w " * 20_000 + "." if k == 5 else f"{k % 700}.") for k in range(3000)] + [(3, 9, "user", "same.")] * 400
    assert found(repair.report(frame(spark, rows, 8))) == plain(rows, walk)


def test_empty_tables_and_dropped_conversations(spark):
    empty = frame(spark, [])
    assert repair.report(empty).count() == 0 and repair.repaired(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(repair.report(empty, frame(spark, [(4, 1, "user", "a."), (None, None, None, None)]))) == [(4, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)]


def crc(row):
    import zlib

    c, t = (" " if x is None else x for x in row[:2])
    return zlib.crc32(f"{c}:{t}".encode()) % 20


def hurt(rows):
    for c, t, role, text in rows:
        role, text, k = role if role is not None else " ", text if text is not None else " ", crc((c, t))
        if k == 4:
            role = "user"
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        yield from [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def test_query_equals_loops_and_sql_on_odd_rows(spark):
    rows = [(c, t, r, x) for c, t, r, x in made_up(8, 150, 8)]
    docs = frame(spark, rows)
    got = found(repair.report(repair.damaged(docs), docs))
    left = plain(list(hurt(rows)), walk)
    gone = {r[0] for r in rows} - {r[0] for r in left}
    assert got == sorted(left + [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone], key=key)
    conversations = docs.select("conv_id", "turn", "role", "text").toArrow()  # noqa: F841
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert sorted(duckdb.sql(f"SELECT {names} FROM ({repair.SQL})").fetchall(), key=key) == got


@needs_data
def test_query_equals_sql(spark):
    conversations = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = found(repair.report(repair.damaged(conversations), conversations))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert sorted(con.sql(f"SELECT {names} FROM ({repair.SQL})").fetchall(), key=key) == got
