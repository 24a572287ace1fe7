import random
import re
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import quality as Q
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs, words


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_counts_equal_brute_force(spark):
    r = random.Random(2)
    phrase = " ".join(words(1, 9))
    more = [" ".join(r.choice([phrase, "x", "\n", "# y", "é|ü", "\t", "line\nline\n"]) for _ in range(r.randint(0, 60))) for _ in range(80)] + ["a " * 30, "  x\x1cy \x85", "w" * 9000]
    docs = odd_docs(spark, more)
    got = sorted(str(tuple(x)) for x in Q.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == sorted(str((x.doc_id, *base(x.text))) for x in docs.collect())
    assert Q.quality(none_docs(spark)).count() == 0


def at_least_floor(cov):
    """No direction smaller than the floors' own."""
    f = np.diag(Q.FLOOR)
    w, v = np.linalg.eigh(np.linalg.inv(f) @ cov @ np.linalg.inv(f))
    return f @ v @ np.diag([max(x, 1.0) for x in w]) @ v.T @ f


def brute_mcd(x, share, steps, only=(0, 1, 2)):
    """All starts and their concentration steps in one array."""
    lo, m0, hi = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    scale = np.maximum((hi - lo) / 1.349, Q.FLOOR)
    z = (x - m0) / scale
    signs = np.array([row / np.linalg.norm(row) if row.any() else row for row in z])
    best = None
    for k, v in enumerate((np.eye(Q.DIMS), signs.T @ signs / len(x), np.cov(np.tanh(z).T, bias=True))):
        if k not in only:
            continue
        w, axes = np.linalg.eigh(v)
        v = axes @ np.diag(np.maximum(w, max(w.mean(), 1e-12) / 100)) @ axes.T
        m, inv = m0, np.linalg.inv(np.diag(scale) @ v @ np.diag(scale))
        for _ in range(steps):
            d = np.einsum("ni,ij,nj->n", x - m, inv, x - m)
            near = x[d <= np.quantile(d, share, method="inverted_cdf")]
            m = near.mean(axis=0)
            cov = at_least_floor((near.T @ near / len(near) - np.outer(m, m)) * Q.consistency(share))
            inv = np.linalg.inv(cov)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-12:
            best = det, np.einsum("ni,ij,nj->n", x - m, inv, x - m)
    return best[1]


def test_distances_equal_brute_force_and_outliers_go(spark):
    r = random.Random(3)
    rows = []
    for k in range(600):
        w = words(k, r.randint(30, 200))
        lang, source = ("xx", "big") if k < 400 else ("yy", f"s{k % 40}")  # yy: every source too small
        if k % 100 == 7:
            w = [x + "###$$$%%%" * 3 for x in w]
        rows.append((k, " ".join(w), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in Q.quality(docs).collect()}
    assert {k for k, x in got.items() if not x.kept} == {7, 107, 207, 307, 407, 507}
    for part in (range(400), range(400, 600)):
        x = []
        for k in part:
            n, chars, sym, dup, rep, _ = base(rows[k][1])
            x.append([np.log(n), chars / n, np.sqrt(sym / n), np.sqrt(dup / n), np.sqrt(rep / n)])
        assert [got[k].distance for k in part] == pytest.approx(list(brute_mcd(np.array(x), 0.75, 50)), rel=1e-6, abs=1e-9)


def test_too_few_rows_reject_nothing(spark):
    docs = spark.createDataFrame([(k, " ".join(words(k, 40)) + "#" * k, None, None) for k in range(30)], "doc_id long, text string, lang string, source string")
    assert {(x.kept, x.distance) for x in Q.quality(docs).collect()} == {(True, None)}


def test_chi_square_quantile():
    assert Q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


@needs_data
def test_query_counts_on_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {x.doc_id: tuple(x)[1:7] for x in Q.quality(docs).collect()}
    assert got == {x.doc_id: base(x.text) for x in docs.collect()}


def test_ranks_are_exact(spark):
    r = random.Random(4)
    rows = [(k % 3, r.choice([0.0, 1e-12, r.random(), 1.0 + r.random() * 1e-7, 3.0, 1e6 * r.random()])) for k in range(4000)]
    df = spark.createDataFrame([(g, k, 1, 1, v) for k, (g, v) in enumerate(rows)], "g int, doc_id long, n_words long, word_chars long, x double")
    got = {(x.g, x._q): x._v for x in Q.at_ranks(df, ["g"], df.x, [0.0, 0.25, 0.75, 1.0]).collect()}
    for g in range(3):
        want = np.quantile([v for h, v in rows if h == g], [0.0, 0.25, 0.75, 1.0], method="inverted_cdf")
        assert [got[g, q] for q in range(4)] == list(want)


def test_smallest_determinant_wins(spark):
    """A fifth of the rows is a tight far cluster along a correlated axis: the starts end in different places."""
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 5)) * [2, 3, 0.4, 0.3, 0.5] + [8, 12, 2, 2, 3]
    x[:, 1] += 1.5 * x[:, 0]
    x[:110] = r.normal(size=(110, 5)) * 0.1 + [12, 10, 3.2, 1, 4.5]
    x = np.abs(x)
    df = spark.createDataFrame([("g", k, 1, 1, *map(float, v)) for k, v in enumerate(x)], "_g string, doc_id long, n_words long, word_chars long, _x0 double, _x1 double, _x2 double, _x3 double, _x4 double")
    fit = Q.robust_fit(df, 0.75, 100).first()
    m, inv = np.array(fit._m), np.array(fit._i).reshape(5, 5)
    got = np.einsum("ni,ij,nj->n", x - m, inv, x - m)
    assert list(got) == pytest.approx(list(brute_mcd(x, 0.75, 100)), rel=1e-6, abs=1e-9)


def test_floor_is_a_lower_bound():
    wide = np.diag([4.0, 9.0, 1.0, 1.0, 1.0])
    assert Q.bounded(wide) == pytest.approx(wide)
    assert Q.bounded(np.zeros((5, 5))) == pytest.approx(np.diag(np.square(Q.FLOOR)))


def test_salted_join_changes_nothing(spark, monkeypatch):
    docs = odd_docs(spark, [" ".join(words(k, 30 + k)) for k in range(150)])
    one = sorted(map(str, Q.quality(docs).collect()))
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert sorted(map(str, Q.quality(docs).collect())) == one


def test_word_lists_and_repeated_lines_go(spark):
    """A symbol for every second word, or many short lines again and again, against clean prose of the same source."""
    r = random.Random(11)
    rows = [(k, " ".join(words(k, r.randint(60, 300)))) for k in range(300)]
    listed = words(900, 200)
    lines = [" ".join(words(1000 + k, 2)) for k in range(40)]
    rows += [(1000, " | ".join(" ".join(listed[k : k + 2]) for k in range(0, 200, 2))), (1001, "\n".join(r.choice(lines) for _ in range(100)))]
    got = {x.doc_id: x for x in Q.quality(spark.createDataFrame([(*x, "xx", "s") for x in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000].base_failed and not got[1001].base_failed
    assert {k for k, x in got.items() if not x.kept} == {1000, 1001}


def test_steps_run_until_the_kept_rows_are_stable(spark):
    """More steps than the bound of old change the estimate; the result is a fixed point of the concentration step."""
    r = random.Random(8)
    rows = [(k, " ".join(words(k, r.choice([25, 30, 40, 60, 150, 400, 900]))) + "#" * r.choice([0, 0, 0, 1, 2, 5, 9])) for k in range(500)]
    docs = spark.createDataFrame([(*x, "xx", "s") for x in rows], "doc_id long, text string, lang string, source string")
    x = []
    for _, t in rows:
        n, chars, sym, dup, rep, _ = base(t)
        x.append([np.log(n), chars / n, np.sqrt(sym / n), np.sqrt(dup / n), np.sqrt(rep / n)])
    got = {g.doc_id: g.distance for g in Q.quality(docs).collect()}
    few, many = (brute_mcd(np.array(x), 0.75, steps) for steps in (4, 60))
    assert few != pytest.approx(list(many), rel=1e-6, abs=1e-9)
    assert [got[k] for k in range(500)] == pytest.approx(list(many), rel=1e-6, abs=1e-9)
