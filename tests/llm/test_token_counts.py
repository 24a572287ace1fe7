"""Token counts against the libraries on whole texts; what the cache saves."""

import public_tokenizers
import pytest

from panelwright.llm import subwords, token_counts
from panelwright.llm.common import new_path
from tests.llm.helpers import DATA, needs_data, none_docs, odd_docs
from tests.llm.test_align import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
MORE = [*ODD, "Σ ΣΑΣ Straße İstanbul", "<|endoftext|> a <|startoftext|>b<|endoftext|>", "  a\n b  ", "a b", "e ́x", "don 't it 's", "a\u0085b c"]


def library_counts(path, texts):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(m.encode(x or "")) for x in texts]


def check(df, docs, path):
    rows = docs.select("doc_id", "text").collect()
    n = library_counts(path, [r.text for r in rows])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    expected = sorted(((r.doc_id, len((r.text or "").encode()), k, k > 2048) for r, k in zip(rows, n)), key=key)
    assert sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=key) == expected


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_texts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    docs = odd_docs(spark, MORE)
    check(token_counts.count_tokens(docs, path), docs, path)


@needs_data
def test_table_equals_the_library(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check(token_counts.count_tokens(docs, WORDS), docs, WORDS)


def test_only_distinct_misses_are_added(spark):
    cache = new_path(spark, "cache")
    docs = odd_docs(spark, MORE)
    check(token_counts.count_tokens(docs, WORDS, cache), docs, WORDS)
    rows = spark.read.parquet(cache)
    first = rows.count()
    assert first == rows.select("digest").distinct().count() < docs.count()
    more = odd_docs(spark, [*MORE, "a  b", "one new text"])  # "a  b" has the content of "a b"
    check(token_counts.count_tokens(more, WORDS, cache), more, WORDS)
    assert spark.read.parquet(cache).count() == first + 1
    model = public_tokenizers.path("piece_bpe_32k.model")
    check(token_counts.count_tokens(docs, model, cache), docs, model)
    assert spark.read.parquet(cache).groupBy("version").count().count() == 2


def test_stored_counts_are_used(spark):
    cache = new_path(spark, "cache")
    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    token_counts.add_misses(docs, WORDS, cache)
    marked = spark.read.parquet(cache).withColumn("n_tokens", token_counts.F.lit(7).cast("long")).toArrow()
    other = new_path(spark, "cache")
    spark.createDataFrame(marked).write.parquet(other)
    assert {r.n_tokens for r in token_counts.count_tokens(docs, WORDS, other).collect()} == {7}


def test_files_that_may_be_cut():
    assert subwords.read(WORDS).cuts and subwords.read(WORDS).drops_spaces
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        assert subwords.read(public_tokenizers.path(name)).cuts and not subwords.read(public_tokenizers.path(name)).drops_spaces


def test_empty_table(spark):
    assert token_counts.count_tokens(none_docs(spark), WORDS).count() == 0
