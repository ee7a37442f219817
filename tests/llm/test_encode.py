"""Token ids against the public library, and hostile texts."""

import base64
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm.encode import PATTERN, VOCABULARY, Contractor, encode_column, encode_documents, potentials, read_vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(VOCABULARY.replace(".json", ".tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids(spark, reference):
    rng = random.Random(2)
    letters = "abcdefghijklmnop eE'sT\n\t0123äßжї你好。ไทยहिन्दी🙂<|>"
    texts = ["", None, " ", "Hello world's", "<|endoftext|>", "aaaa" * 500, "ab" * 777, "x" * 3001, "  \n\n x  "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + ["the same"] * 3
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for row in encode_documents(df).collect():
        assert row.ids == reference(texts[row.doc_id] or ""), texts[row.doc_id]
    assert encode_documents(df.limit(0)).count() == 0
    assert dict(encode_column(df, "text").dtypes)["ids"] == "array<int>"


def test_decodes_back(spark):
    import tokenizers

    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    texts = ["Zoë's naïve café, 42!", "数字12と文字", "tab\there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in encode_documents(df).where(F.col("doc_id").isNotNull()).collect():
        assert model.decode(row.ids) == texts[row.doc_id]


@pytest.mark.parametrize("alphabet", ["acgt", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "a", "的一是不了人我在有他这中大来上国", "กขคงจฉชซญฐ"])
def test_long_words(reference, alphabet):
    """One word of a million bytes is contracted in time that grows with its length alone."""
    byte_ids, merges = read_vocabulary(VOCABULARY)
    worker = Contractor(byte_ids, np.array(merges, np.int32), np.array(potentials(merges), np.int32))
    rng = random.Random(3)
    took = []
    for size in (20_000, 1_000_000):
        word = "".join(rng.choice(alphabet) for _ in range(size // len(alphabet[0].encode())))
        began = time.time()
        worker.learn([word])
        took.append(time.time() - began)
        if size == 20_000 and len(set(alphabet)) > 1:
            assert worker.known[word] == reference(word)
        else:
            parts = [worker.known[word][0:40], worker.known[word][-40:]]
            assert all(parts)
    assert took[1] < 60


def test_contraction_against_single_steps(reference):
    """Words over few letters, with many ties and overlaps, all at once."""
    byte_ids, merges = read_vocabulary(VOCABULARY)
    worker = Contractor(byte_ids, np.array(merges, np.int32), np.array(potentials(merges), np.int32))
    rng = random.Random(4)
    words = sorted({"".join(rng.choice(rng.choice(["ab", "aet", "eaoinst", "....--==", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(rng.randrange(1, 90))) for _ in range(4000)})
    words = [w for w in words if w.isalpha() or not any(c.isalpha() for c in w)]
    worker.learn(words)
    assert all(worker.known[w] == reference(w) for w in words)
