"""Encoding against the tokenizer itself."""

import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm import bpe
from freshet.llm.common import tokenizer_json

TEXTS = [
    None,
    "",
    "   \n\t ",
    "Hello wörld  it's 42 <|endoftext|>x ÉΣΑΣ 'ΟΔΟΣ' áb c ́ x\x1fy e\u0085f​z İstanbul",
    "a<|startoftext|><|endoftext|>b  c",
    "one two three " * 5000,
    "x" * 20000,
    "same text",
    "same text",
    "日本語 text \U0001f600 naïve　wide",
]


def test_same_as_the_tokenizer(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    digests = {r.doc_id: r for r in bpe.unpacked(bpe.digests(docs.withColumn("n", F.col("doc_id") * 7), carry="n")).collect()}
    own = Tokenizer.from_str(tokenizer_json())
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        text = own.decode(ids, skip_special_tokens=False)
        assert got[i].text == text
        assert digests[i].n_tokens == len(ids) and list(digests[i].ids) == ids and digests[i].n == 7 * i
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_null_ids_and_small_blocks(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty)).collect() == []
    one = spark.createDataFrame([(None, "two words"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: len(r.ids) for r in bpe.encode(one).collect()} == {None: 2, 3: 0}


def test_unknown_ids_are_left_out(spark):
    rows = spark.createDataFrame([(1, [3306, -5, 99999999, 86])], "doc_id long, ids array<int>")
    assert bpe.decode(rows).first().text == "hello</w> w"
