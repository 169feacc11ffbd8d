"""Byte-level BPE against the tiktoken library."""

import base64
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from locusframe.llm.bpe import Vocabulary, encode

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts(spark):
    rng = random.Random(5)
    odd = ["", None, " ", "  a  b\n\n c", "<|endoftext|> it's we'll", "x" * 5000, "ab" * 900 + "!" * 700, "日本語 текст ß ½ 🙂🙂", "\t\x00\x1c 12345678", "The the"]
    texts = odd + ["".join(rng.choice("abcdeè ñ\n.,'st1") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).repartition(3)
    own = library()
    for r in encode(frame, PATH, P.PATTERN, decoded=True).collect():
        text = texts[r["id"]] or ""
        assert r["ids"] == own.encode_ordinary(text), text[:60]
        assert bytes(r["decoded"]) == text.encode()
    assert encode(frame.limit(0), PATH, P.PATTERN).count() == 0


def test_heap_and_matrix_agree():
    v, rng = Vocabulary(PATH), random.Random(3)
    words = [bytes(rng.choice(b"aeiounrst th") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    assert v.merge(words) == [v._heap(w) for w in words]
