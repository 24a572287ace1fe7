"""Token alignment against whole texts encoded by both libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from panelwright.llm import align, subwords
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs, words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["café naïve Ünïcödé 🐳🐳 x", " two  spaces and\n\n lines \t tab", "x▁y does not come back", "<s> </s> <unk> <|endoftext|> <0x41>", "日本語のテキスト と 한국어 é ​zero", "a\x00b \x1c c d   e",
       "🏳️‍🌈 ﬁ ｱ ½ " * 40, " ", "\n", "x" * 3000, "don't we'll I'm 'tis", "é" * 500]


def brute(texts):
    """What the contract says, from the libraries' ids and the tokens' bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    name = {i: t for t, i in a.get_vocab().items()}
    rows, holds = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [align.byte_level_bytes(name[i]) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            rows.append(None)
            continue
        links, groups, i, j, ea, eb = Counter(), [([], [])], 0, 0, len(ba[0]), len(bb[0])
        groups[-1][0].append(ia[0]), groups[-1][1].append(ib[0])
        while True:
            links[ia[i], ib[j]] += 1
            if ea == eb == len(raw):
                break
            step_a, step_b = ea <= eb, eb <= ea
            if step_a and step_b:
                groups.append(([], []))
            if step_a:
                i += 1
                ea += len(ba[i])
                groups[-1][0].append(ia[i])
            if step_b:
                j += 1
                eb += len(bb[j])
                groups[-1][1].append(ib[j])
        holds.update(set(links))
        rows.append((len(ia), len(ib), groups, links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = r
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if holds[p] == most[p[0]]), sum(n * holds[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def expected(docs):
    rows = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.select("doc_id", "text").collect()]
    return sorted((i, *got) for (i, _), got in zip(rows, brute([t for _, t in rows])))


@pytest.mark.parametrize("bound", [align.BOUND, 0])
def test_odd_texts_equal_brute_force(spark, bound):
    docs = odd_docs(spark, ODD)
    assert found(align.align(docs, A, B, bound)) == expected(docs)


@needs_data
def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(align.align(docs, A, B)) == expected(docs)


def test_same_with_a_small_table_of_pieces_and_with_whole_texts(monkeypatch):
    pair = align.Pair(subwords.read(A, True), subwords.read(B, True))
    docs = [*ODD, " ".join(words(3, 900)), None, ""]
    first = pair.documents(docs)
    monkeypatch.setattr(align, "KEPT", 3)
    again = [pair.documents([d]) for d in docs]
    pair.cuts = False
    pair.clear()
    whole = pair.documents(docs)
    for n in ("n_a", "n_b", "n_groups", "groups_sha256"):
        assert list(first[n]) == [x[n][0] for x in again] == list(whole[n])
    for n in ("_pairs", "_times"):
        assert [list(x) for x in first[n]] == [list(x[n][0]) for x in again] == [list(x) for x in whole[n]]


def test_empty_table(spark):
    assert align.align(none_docs(spark), A, B).count() == 0
