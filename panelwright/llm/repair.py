"""Conversation repair by a generalised LR parse over the role grammar.

A conversation's rows stand in order of (turn, nulls first; role; digest of the text). Each row's first fault counts: blank,
duplicate (role and text stand in an earlier row), truncated (last character that is not white space is none of ``.!?``).
Edits make the role initials a word of the grammar ``C = | T | s T;  T = N | T N;  N = u a``: keep costs 0, giving a row the
role user or assistant 2, delete 3 (the only edit for blank and duplicate rows), insert an empty user or assistant row 2; a
truncated row that stays adds 1. The cheapest edits are taken, of equal ones those with the smallest initials (D, I, K, R).

1. ``Stacks`` builds the LR states of the grammar and shares equal stacks: a stack is a node (state, node below), so equal
   tops over equal stacks are one node. The frontier holds a minimum (cost, audit) per node; every row offers shifts (keep,
   rerole), a pop-free delete, and inserts before it, and whatever reaches the same node merges by that minimum. Taking the
   smaller of two equal-cost audits is safe: neither is the beginning of the other, or their costs would differ. The grammar
   is left-recursive, so there are only a few stacks.
2. Rows without texts are dealt by range over (conversation, order), so that a conversation of any share of the rows is cut
   into blocks of at most BLOCK rows over many tasks. A block gives the minimum (cost, audit) from each stack that may be there
   at its begin to each at its end; the blocks of a conversation, one record each, are folded in order.
3. Texts meet the edits in one sorted pass per conversation, a row at a time. Its SHA-256 digest is sequential by nature; no
   more than one row and the conversation's edits are held.

Nulls and odd cases: a null role or text counts as one space; a null conv_id is a conversation of its own and comes back as
null; null turns come first; rows equal in all columns follow one another, the later ones duplicates; roles other than those of
the grammar can be changed or deleted; empty and very long texts are judged whole; further columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import NULL_ID, _arrow, column, id_or_last, need, written

#: Costs of the edits by initial, and what an undeleted truncated row adds.
COST, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
GRAMMAR = {"C": ["", "T", "sT"], "T": ["N", "TN"], "N": ["ua"]}
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a conversation that are parsed in one go; each costs a copy of the audit so far.
BLOCK = 512
WHITE = " \t\n\x0b\f\r"
ORDER = ["_c", "_known", "turn", "role", "_digest"]


class Stacks:
    """LR states of a grammar and its stacks as shared nodes."""

    def __init__(self, grammar: dict[str, list[str]], start: str):
        self.grammar, self.top = grammar, start
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.nodes: dict[tuple[int, int], int] = {}
        self.below: list[tuple[int, int]] = []
        self.start = self.node(self.state({(start, p, 0) for p in grammar[start]}), -1)
        self.next: list[dict[str, int]] = []
        while len(self.next) < len(self.below):
            self.next.append({t: self.shift(len(self.next), t) for t in "sua" if self.goto(self.below[len(self.next)][0], t) is not None})
        #: Stacks that can be there between two rows.
        self.tops = sorted({self.start, *(to for n in self.next for to in n.values())})
        self.accepts = [any(h == start and at == len(p) for h, p, at in self.items[state]) for state, _ in self.below]

    def state(self, items: set) -> int:
        """The number of a closed set of items (head, production, place)."""
        todo = list(items)
        while todo:
            _, p, at = todo.pop()
            if at < len(p) and p[at] in self.grammar:
                for new in ((p[at], q, 0) for q in self.grammar[p[at]]):
                    if new not in items:
                        items.add(new)
                        todo.append(new)
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
        return self.states[key]

    def goto(self, state: int, symbol: str) -> int | None:
        moved = {(h, p, at + 1) for h, p, at in self.items[state] if at < len(p) and p[at] == symbol}
        return self.state(moved) if moved else None

    def node(self, state: int, below: int) -> int:
        key = state, below
        if key not in self.nodes:
            self.nodes[key] = len(self.below)
            self.below.append(key)
        return self.nodes[key]

    def shift(self, node: int, symbol: str) -> int:
        """The stack after a symbol and the reductions that follow; the start symbol is reduced at the end only."""
        node = self.node(self.goto(self.below[node][0], symbol), node)
        done = [(h, p) for h, p, at in self.items[self.below[node][0]] if at == len(p) and h != self.top]
        if not done:
            return node
        (head, production), *more = done
        if more:
            raise ValueError("two reductions in one state")
        for _ in production:
            node = self.below[node][1]
        return self.shift(node, head)


STACKS = Stacks(GRAMMAR, "C")
Front = dict[int, tuple[int, str]]


def inserted(front: Front) -> Front:
    """The frontier with everything that inserted rows reach."""
    out, todo = dict(front), list(front)
    while todo:
        n = todo.pop()
        c, audit = out[n]
        for t in ROLES:
            if (to := STACKS.next[n].get(t)) is not None:
                new = c + COST["I"], audit + "I"
                if to not in out or new < out[to]:
                    out[to] = new
                    todo.append(to)
    return out


def step(front: Front, initial: str, must_go: bool, truncated: bool) -> Front:
    """The frontier after one more row."""
    front = inserted(front)
    out = {n: (c + COST["D"], audit + "D") for n, (c, audit) in front.items()}
    if must_go:
        return out
    more = TRUNCATED if truncated else 0
    for n, (c, audit) in front.items():
        for t, to in STACKS.next[n].items():
            edits = [(COST["K"], "K")] if t == initial else []
            if t in ROLES:
                edits.append((COST["R"], "R"))
            for cost, letter in edits:
                new = c + cost + more, audit + letter
                if to not in out or new < out[to]:
                    out[to] = new
    return out


def finish(front: Front) -> tuple[int, str]:
    """The minimum over stacks that are a whole word of the grammar, after closing inserts."""
    return min(v for n, v in inserted(front).items() if STACKS.accepts[n])


class Rope:
    """An audit as a chain of blocks, compared from where two chains part."""

    __slots__ = ("before", "text")

    def __init__(self, before: Rope | None, text: str):
        self.before, self.text = before, text

    def parts(self) -> Iterator[str]:
        at = self
        while at is not None:
            yield at.text
            at = at.before

    def whole(self) -> str:
        return "".join(reversed(list(self.parts())))


def less(a: Rope, b: Rope) -> bool:
    """Whether the first of two chains of equally many blocks comes first."""
    x, y, left, right = a, b, [], []
    while x is not y:
        left.append(x.text), right.append(y.text)
        x, y = x.before, y.before
    return "".join(reversed(left)) < "".join(reversed(right))


def join_block(front: dict[int, tuple[int, Rope | None]], table: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, Rope]]:
    """The frontier after a block, given as (from, to, cost, audit)."""
    out: dict[int, tuple[int, Rope]] = {}
    for a, b, cost, audit in table:
        if a in front:
            c, rope = front[a][0] + cost, Rope(front[a][1], audit)
            if b not in out or c < out[b][0] or (c == out[b][0] and less(rope, out[b][1])):
                out[b] = c, rope
    return out


def rows_of(conversations: DataFrame) -> DataFrame:
    """_c, _known (turn is not null), turn, role, text, _digest."""
    d = need(conversations, conv_id="long", turn="long", role="string", text="string")
    d = d.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    return d.select(id_or_last("conv_id").alias("_c"), F.col("turn").isNotNull().alias("_known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", F.sha2("text", 256).alias("_digest"))


def judged(rows: DataFrame) -> DataFrame:
    """Without texts: ORDER, _initial, _blank, _again (role and text stand at an earlier turn), _cut (truncated)."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    slim = rows.select(*ORDER, F.substring("role", 1, 1).alias("_initial"), (body == "").alias("_blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    first = slim.groupBy("_c", "role", "_digest").agg(F.min(F.struct("_known", "turn")).alias("_a"), F.max(F.struct("_known", "turn")).alias("_b"))
    first = first.where("_a <> _b").select("_c", "role", "_digest", "_a")
    joined = slim.join(first, ["_c", "role", "_digest"], "left")
    return joined.select(*ORDER, "_initial", "_blank", F.coalesce(F.struct("_known", "turn") > F.col("_a"), F.lit(False)).alias("_again"), "_cut")


BLOCKS = "_c long, _part int, _at long, _first string, _last string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, _table array<struct<a: int, b: int, cost: long, audit: string>>"
LEGAL = {"su", "ua", "au"}


class Block:
    """Rows of one conversation that follow one another, as the sorted stream gives them."""

    def __init__(self, c: int, whole: bool):
        #: The stacks that may be there at the begin: all, unless the conversation begins here.
        self.c, self.n, self.first, self.last = c, 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.fronts = {n: {n: (0, "")} for n in ([STACKS.start] if whole else STACKS.tops)}

    def add(self, initial: str, blank: bool, duplicate: bool, cut: bool) -> None:
        duplicate = duplicate and not blank
        cut = cut and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last, self.n = initial, self.n + 1
        self.fronts = {a: step(f, initial, blank or duplicate, cut) for a, f in self.fronts.items()}

    def row(self, part: int, at: int) -> tuple:
        table = [{"a": a, "b": b, "cost": c, "audit": s} for a, f in self.fronts.items() for b, (c, s) in f.items()]
        return self.c, part, at, self.first, self.last, self.blank, self.duplicate, self.truncated, self.illegal, table


def batched(rows: Iterator[tuple], schema: pa.Schema, weight=lambda r: 1, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches that weigh about ``most``."""
    held, total = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        total += weight(r)
        if total >= most:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def block_rows(batches) -> Iterator[tuple]:
    """The blocks of a sorted partition."""
    part, at, block, before = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        for key, *judgement in zip(zip(*(column(batch, c).to_pylist() for c in ORDER)), *(column(batch, c).to_pylist() for c in ("_initial", "_blank", "_again", "_cut"))):
            same = before is not None and key[0] == before[0]
            if block is not None and (not same or block.n >= BLOCK):
                yield block.row(part, at)
                at, block = at + 1, None
            if block is None:
                block = Block(key[0], whole=before is not None and not same)
            initial, blank, again, cut = judgement
            block.add(initial, blank, again or key == before, cut)
            before = key
    if block is not None:
        yield block.row(part, at)


FOUND = "_c long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def folded(batches) -> Iterator[tuple]:
    """One row per conversation from its blocks in order."""
    now, sums, front, last = None, None, None, None

    def close():
        # Chains are compared with the closing inserts added.
        best = None
        for n, (c, rope) in front.items():
            closing = [v for m, v in inserted({n: (0, "")}).items() if STACKS.accepts[m]]
            if closing:
                extra, letters = min(closing)
                new = c + extra, Rope(rope, letters)
                if best is None or new[0] < best[0] or (new[0] == best[0] and less(new[1], best[1])):
                    best = new
        return now, *sums, best[0], best[1].whole()

    names = ("_c", "_first", "_last", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "_table")
    for batch in batches:
        for c, first, end, *counts, table in zip(*(column(batch, n).to_pylist() for n in names)):
            if c != now:
                if now is not None:
                    yield close()
                now, sums, front = c, [0, 0, 0, 0], {STACKS.start: (0, None)}
            elif last + first not in LEGAL:
                sums[3] += 1
            sums = [s + n for s, n in zip(sums, counts)]
            front = join_block(front, [(r["a"], r["b"], r["cost"], r["audit"]) for r in table])
            last = end
    if now is not None:
        yield close()


def edits(conversations: DataFrame) -> DataFrame:
    """Per conversation: _c, blank, duplicate, truncated, illegal, cost, audit."""
    slim = judged(rows_of(conversations))
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks_type, found_type = T._parse_datatype_string(BLOCKS), T._parse_datatype_string(FOUND)
    blocks_schema, found_schema = _arrow(blocks_type), _arrow(found_type)
    dealt = slim.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    blocks = dealt.mapInArrow(lambda b: batched(block_rows(b), blocks_schema, lambda r: sum(len(t["audit"]) for t in r[-1]), 1 << 20), blocks_type)
    order = ["_c", "_part", "_at"]
    return blocks.repartition("_c").sortWithinPartitions(*order).mapInArrow(lambda b: batched(folded(b), found_schema, lambda r: len(r[-1]) + 100, 1 << 20), found_type)


def applied(batches) -> Iterator[tuple]:
    """(_c, position, edit, role, text) of every repaired row, then (_c, None, None, None, None) at a conversation's end; of a
    stream in which a conversation's audit comes before its rows."""
    now, audit, at, place, last = None, "", 0, 0, "a"

    def item(letter, role, text):
        nonlocal place, last
        if letter != "K":
            role = ROLES["a" if last == "u" else "u"]
        last = role[:1]
        place += 1
        return now, place - 1, letter, role, text

    def until_row():
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield item("I", None, "")

    for batch in batches:
        for c, kind, edits_, role, text in zip(*(column(batch, n).to_pylist() for n in ("_c", "_kind", "audit", "role", "text"))):
            if kind == 0:
                if now is not None:
                    yield from until_row()
                    yield now, None, None, None, None
                now, audit, at, place, last = c, edits_, 0, 0, "a"
                continue
            yield from until_row()
            letter, at = audit[at], at + 1
            if letter != "D":
                yield item(letter, role, text)
    if now is not None:
        yield from until_row()
        yield now, None, None, None, None


def digests(batches) -> Iterator[tuple]:
    """Digest of each conversation's repaired ``role:text`` lines."""
    h = None
    for c, _, edit, role, text in applied(batches):
        if edit is None:
            yield c, (h or hashlib.sha256()).hexdigest()
            h = None
        else:
            if h is None:
                h = hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode("utf-8", "replace"))


def _stream(conversations: DataFrame, found: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    heads = found.select("_c", F.lit(0).alias("_kind"), F.lit(False).alias("_known"), F.lit(0).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("_digest"), "audit")
    rows = rows_of(conversations).select("_c", F.lit(1).alias("_kind"), "_known", "turn", "role", "text", "_digest", none.alias("audit"))
    return heads.unionByName(rows).repartition("_c").sortWithinPartitions("_c", "_kind", "_known", "turn", "role", "_digest").select("_c", "_kind", "audit", "role", "text")


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position, edit (K, R or I), role, text."""
    kind = T._parse_datatype_string("conv_id long, position long, edit string, role string, text string")
    schema = _arrow(kind)

    def run(batches):
        rows = ((None if r[0] == NULL_ID else r[0], *r[1:]) for r in applied(batches) if r[2] is not None)
        return batched(rows, schema, lambda r: len(r[-1]) + 100, 1 << 22)

    return _stream(conversations, written(edits(conversations), "edits")).mapInArrow(run, kind)


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``ids`` (default: of the rows): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. A conversation of ``ids`` without rows has zeros, no edits and the digest of nothing."""
    found = written(edits(conversations), "edits")
    kind = T._parse_datatype_string("_c long, repaired_sha256 string")
    schema = _arrow(kind)
    sums = _stream(conversations, found).mapInArrow(lambda b: batched(digests(b), schema), kind)
    turns = need(conversations, conv_id="long", turn="long").groupBy(id_or_last("conv_id").alias("_c"), "turn").count()
    gaps = turns.groupBy("_c").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = need(conversations if ids is None else ids, conv_id="long").select(id_or_last("conv_id").alias("_c")).distinct()
    joined = every.join(found, "_c", "left").join(sums, "_c", "left").join(gaps, "_c", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    conv = F.when(F.col("_c") != NULL_ID, F.col("_c")).alias("conv_id")
    return joined.select(conv, *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with known faults, chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes
    out ``.!?``, 3 repeats it, 4 sets the role user. A null counts as one space."""
    d = need(conversations, conv_id="long", turn="long", role="string", text="string")
    space = F.lit(" ")
    k = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    d = d.withColumn("_k", k).where("_k <> 0")
    d = d.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), "_k")
    return d.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k", "_copy")


def _sql() -> str:
    """The query on ``conversations`` in DuckDB: the same automaton as four columns of a recursive walk, each holding the
    cost (eight digits) and the audit of the cheapest way to that state."""

    def add(x, cost, letter):
        return f"lpad(CAST(CAST({x}[1:8] AS INT) + {cost} AS VARCHAR), 8, '0') || {x}[9:] || '{letter}'"

    def shift(x, initial):
        kept = f"CASE WHEN NOT go AND r = '{initial}' THEN {add(x, 'cut', 'K')} END"
        return f"least({kept}, CASE WHEN NOT go THEN {add(x, '2 + cut', 'R')} END)"

    u = f"least(qu, {add('q0', 2, 'I')}, {add('qs', 2, 'I')}, {add('qa', 2, 'I')})"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS k
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE k <> 0),
o AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM d),
f AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS tail,
    lag(r) OVER (PARTITION BY conv_id ORDER BY n) AS r0 FROM o),
g AS (SELECT *, blank OR again AS go, CASE WHEN NOT blank AND NOT again AND tail THEN 1 ELSE 0 END AS cut FROM f),
walk AS (
  SELECT conv_id, 0 AS pos, max(n) AS last, '00000000' AS q0, NULL::VARCHAR AS qs, NULL::VARCHAR AS qu, NULL::VARCHAR AS qa FROM g GROUP BY conv_id
  UNION ALL
  SELECT w.conv_id, n, last, {add('q0', 3, 'D')}, least({add('qs', 3, 'D')}, CASE WHEN NOT go AND r = 's' THEN {add('q0', 'cut', 'K')} END),
    least({add('cu', 3, 'D')}, {shift('q0', 'u')}, {shift('qs', 'u')}, {shift('ca', 'u')}), least({add('ca', 3, 'D')}, {shift('cu', 'a')})
  FROM (SELECT *, least(qa, {add('cu', 2, 'I')}) AS ca FROM (SELECT *, {u} AS cu FROM walk)) w
  JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.pos + 1),
best AS (
  SELECT conv_id, least(q0, qa, {add('cu', 2, 'I')}) AS b FROM (SELECT *, {u} AS cu FROM walk) WHERE pos = last),
letters AS (
  SELECT conv_id, unnest(string_split(b[9:], '')) AS e, unnest(range(length(b) - 8)) AS j FROM best WHERE length(b) > 8),
placed AS (
  SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS n,
    sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS p FROM letters),
kept AS (
  SELECT p.conv_id, p.p, p.e, g.role, CASE WHEN p.e = 'I' THEN '' ELSE g.text END AS text,
    max(CASE WHEN p.p = 1 AND p.e = 'K' AND g.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s
  FROM placed p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.n = p.n WHERE p.e <> 'D'),
sums AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS h
  FROM kept GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (WHERE r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(b[1:8] AS BIGINT), 0) AS cost, coalesce(b[9:], '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM i.conv_id"""


SQL = _sql()
