import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plumeworks.llm import packing
from plumeworks.llm.queries import tokenizer_path
from plumeworks.llm.textnum import slices


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_equal_the_tokenizer(tokenizer):
    rng = random.Random(5)
    parts = ["a", "don", "'", "'s", "'ll", "'LL", "'ve", "'r", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "中文", "٣", "½", "12", ".", "!?", " ", " ", "​", "﻿", "é", "😀", "\x00", "\x7f", "<|endoftext|>", "<|", "_", "'t", "re"]
    texts = ["", " ", "  ", "\n\n", "'", "'s", " 's", "x's'", *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(4000))]
    pieces = packing.Pieces(tokenizer_path())
    for _, _, data, offsets in slices(pa.array(texts)):
        for text, ids in zip(texts, pieces.each(data, offsets), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_fit_together(spark, tokenizer):
    texts = ["", None, "word " * 3000, "b", "same", "same", "x y z" * 50]
    docs = spark.createDataFrame([(None if i == 5 else i % 5, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    rows = sorted(packing.pack(docs, tokenizer=tokenizer_path(), length=64, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 64 + r.offset == at and r.offset + r.length <= 64
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.length
    found, stream = [], []
    for r in rows:
        stream += r.ids
        if r.start + r.length == r.doc_tokens:
            assert len(stream) == r.doc_tokens
            found.append(tuple(stream))
            stream = []
    assert sorted(found) == sorted((*tokenizer.encode(t or "", add_special_tokens=False).ids, 1) for t in texts)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer=tokenizer_path()).count() == 0
