import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from terralign.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", "a", " ", "  \n\t x", "I'll say it's Straße – naïve café!!", "日本語のテキスト 123 ４５", "x\x85y　z᠎w\x1cq", "🙂🙃 é", "https://a.b/c?d=e&f", "aaaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "same", "same"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def check(rows, library):
    for r in rows:
        want = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()


def test_texts_equal_the_library(spark, library):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefghij") for _ in range(3000))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, long, "word " * 50_000])], "doc_id long, text string, ids string")
    check(bpe.encode_texts(docs, PATH, PATTERN).join(docs.drop("ids"), "doc_id").collect(), library)
    assert bpe.encode_texts(docs.limit(0), PATH, PATTERN).count() == 0


def test_native_form_equals_the_library(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check(bpe.encode_native(docs, PATH, PATTERN).join(docs, "doc_id").collect(), library)


def test_heap_equals_fold(library):
    ranks, rnd = bpe.load_ranks(PATH), random.Random(2)
    for _ in range(300):
        word = bytes(rnd.choice(b"thein ger\xc3\xa9") for _ in range(rnd.randrange(1, 150)))
        if word not in ranks:
            assert bpe.fold_long(word, ranks) == bpe.fold(word, ranks)
