import gc
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from panelwright.llm import bpe as B
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = B.read_ranks(PATH)
    return B.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library_on_random_texts(pair):
    own, lib = pair
    r = random.Random(3)
    for _ in range(400):
        t = "".join(r.choice("abtheing ABé漢🙂 01\n\t'<|>") for _ in range(r.randint(0, 300)))
        assert own.encode(t) == lib.encode_ordinary(t) == own.ids(t).tolist()
        assert own.decode(own.encode(t)) == t.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, "é" * 5000, "", "<|endoftext|>", "thethethe" * 2000])
def test_long_pretokens(pair, text):
    own, lib = pair
    assert own.encode(text) == lib.encode_ordinary(text)


def test_table_turns_over(pair, monkeypatch):
    monkeypatch.setattr(B, "CACHED", 3)
    own = B.Codec(pair[0].ranks, P.PATTERN)
    t = "one two three four five one two three four five antidisestablishment " * 3
    assert own.ids(t).tolist() == pair[1].encode_ordinary(t) and len(own.table) <= 3


def digest(lib, t):
    ids = lib.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_odd_rows(spark, pair):
    docs = odd_docs(spark)
    got = sorted(str(tuple(r)) for r in B.token_digests(docs, PATH, P.PATTERN).collect())
    assert got == sorted(str((r.doc_id, *digest(pair[1], r.text))) for r in docs.collect())
    out = B.round_trips(docs, PATH, P.PATTERN)
    assert set(docs.columns) - {"ids"} < set(out.columns)
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in out.collect())
    assert B.token_digests(none_docs(spark), PATH, P.PATTERN).count() == B.round_trips(none_docs(spark), PATH, P.PATTERN).count() == 0


@needs_data
def test_query_equals_library(spark, pair):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in B.token_digests(docs, PATH, P.PATTERN).collect()}
    assert got == {r.doc_id: digest(pair[1], r.text) for r in docs.collect()}


def test_table_goes_with_its_broadcast(pair):
    class Sent:
        value = (pair[0].ranks, P.PATTERN)

    sent = Sent()
    assert B.codec_for(sent) is B.codec_for(sent) and len(B._codecs) == 1
    del sent
    gc.collect()
    assert not B._codecs


def test_calls_share_a_broadcast(spark):
    kept = [B.shared_codec(spark, PATH, P.PATTERN).__closure__[0].cell_contents for _ in range(2)]
    assert kept[0] is kept[1] and kept[0] is not B.shared_codec(spark, PATH, P.PATTERN + "|x").__closure__[0].cell_contents
