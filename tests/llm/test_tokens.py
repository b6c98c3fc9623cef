"""Encoding and counts against the tokenizer itself."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuebound.llm import encode as N
from cuebound.llm import tokens as K
from cuebound.llm.bpe import TOKENIZER_DIR, TrieEncoder, load_ranks

tokenizers = pytest.importorskip("tokenizers")
JSON = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no tokenizer files")
ODD = [" ", "  ", "\n", "\t", "\r\n", "\xa0", "a", "é", "ế", "日", "の", "'s", "'", "12", "²", "-", "!", "😀", "́", "‍", "�", "<|endoftext|>", "　", "\x85", "\x1c", "ﬁ", "\x00", "word", "Người"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_encoder_equals_the_tokenizer(ranks, reference):
    texts = random_texts(4000)
    offsets, ids = N.CorpusEncoder(ranks).encode(texts)
    for i, want in enumerate(reference(texts)):
        assert list(ids[offsets[i] : offsets[i + 1]]) == want, texts[i]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_encoder_equals_the_tokenizer_on_any_text(texts):
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    texts = [x for x in texts if x.isascii() or all(ord(c) < 0x500 for c in x)]  # newer letters: the libraries' Unicode versions differ
    offsets, ids = N.CorpusEncoder(load_ranks(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")).encode(texts)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert list(ids[offsets[i] : offsets[i + 1]]) == e.ids


def test_trie_equals_plain_merging(ranks):
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abcdething \xe1\xba\xbf\xc3") for _ in range(rng.randint(1, 24))) for _ in range(600)})
    trie = TrieEncoder(ranks)
    for word, ids in zip(words, trie.encode_sorted(words), strict=True):
        assert ids == [ranks[t] for t in trie.merge(word)]


def test_kept_nodes_change_nothing(ranks, monkeypatch):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"abcdething \xe1\xba\xbf") for _ in range(rng.randint(1, 40))) for _ in range(900)]
    for limit in (0, 50, 500_000):
        monkeypatch.setattr("cuebound.llm.bpe.NODES", limit)
        trie = TrieEncoder(ranks)
        for at in range(0, 900, 100):
            part = sorted(set(words[at : at + 100]))
            for word, ids in zip(part, trie.encode_sorted(part), strict=True):
                assert ids == [ranks[t] for t in trie.merge(word)]


def test_a_full_cache_changes_nothing(ranks, reference, monkeypatch):
    monkeypatch.setattr(N, "CACHE_ENTRIES", 40)
    texts, encoder = random_texts(300, 2), N.CorpusEncoder(ranks)
    for at in range(0, 300, 30):
        offsets, ids = encoder.encode(texts[at : at + 30])
        for i, want in enumerate(reference(texts[at : at + 30])):
            assert list(ids[offsets[i] : offsets[i + 1]]) == want


def docs(spark):
    texts = [None, "", " ", "\n\n", "Xin chào các bạn", "Xin chào các bạn", "<|endoftext|>", "x" * 20_000, "日本語の文章" * 3000, *random_texts(300, 3)]
    rows = [(i, t, "s", "vi", None) for i, t in enumerate(texts)] + [(4, texts[4], "s", "vi", None), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, domain string").withColumn("piece", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(5))
    return df, rows


def test_corpus(spark, reference):
    df, rows = docs(spark)
    found = sorted(((r.doc_id if r.doc_id is not None else -1), r.ids) for r in N.encode_corpus(df).collect())
    want = sorted(((r[0] if r[0] is not None else -1), ids) for r, ids in zip(rows, reference([r[1] or "" for r in rows]), strict=True))
    assert found == want
    assert N.encode_corpus(df.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [(48 << 20, 250_000, 64), (0, 20, 64), (0, 250_000, 8)])
def test_counts(spark, reference, monkeypatch, limits):
    for name, limit in zip(("ALL_BYTES", "HOT_PIECES", "HOT_BYTES"), limits, strict=True):
        monkeypatch.setattr(K, name, limit)
    df, rows = docs(spark)
    found = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens) for r in K.count_tokens(df, "text", ["doc_id", "source"]).collect())
    want = sorted(((r[0] if r[0] is not None else -1), len(ids)) for r, ids in zip(rows, reference([r[1] or "" for r in rows]), strict=True))
    assert found == want
    assert K.count_tokens(df.limit(0), "text", ["doc_id"]).collect() == []


def test_other_tokenizers(spark):
    import base64

    import tiktoken

    path = f"{TOKENIZER_DIR}/byte_bpe_multi_50k.tiktoken"
    own = tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    texts = ["Người dẫn chuyện kể thêm", "昨日先生は", "plain words again and again", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert {r.id: r.n_tokens for r in K.count_tokens(df, "text", ["id"], "byte_bpe_multi_50k").collect()} == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        K.count_tokens(df, "text", ["id"], "word_bpe_49k")


def test_frequencies(spark):
    texts = ["a b a a  b", "", None, "x", "z z"]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", K.piece_frequencies(F.col("t")).alias("f")).collect()
    assert {r.id: sorted((x.piece, x.n) for x in r.f) for r in found} == {0: [(" ", 1), (" a", 2), (" b", 2), ("a", 1)], 1: [], 2: [], 3: [("x", 1)], 4: [(" z", 1), ("z", 1)]}


def test_language(spark):
    cases = {"vi": "vi", "vi-VN": "vi", "vi_VN": "vi", " VI ": "vi", "vie": "vi", "eng": "en", "pt-BR": "pt", "jpn": "ja", "und": None, "": None, None: None, "haw": "haw", "12": None, "english": None}
    df = spark.createDataFrame(list(cases.items()), "t string, w string").withColumn("l", K.language(F.col("t")))
    assert {r.t: r.l for r in df.collect()} == cases


def test_counts_of_rows_whose_order_changes_between_evaluations(spark, reference, monkeypatch):
    monkeypatch.setattr(K, "ALL_BYTES", 0)
    monkeypatch.setattr(K, "HOT_PIECES", 3)
    texts = random_texts(300, 8)

    def shuffled(batches):
        import os
        import random

        import pyarrow as pa

        for batch in batches:
            order = list(range(batch.num_rows))
            random.Random(os.urandom(8)).shuffle(order)
            yield batch.take(pa.array(order))

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2).mapInArrow(shuffled, "id int, text string")
    found = sorted((r.id, r.n_tokens) for r in K.count_tokens(df, "text", ["id"]).collect())
    assert found == [(i, len(ids)) for i, ids in enumerate(reference(texts))]
