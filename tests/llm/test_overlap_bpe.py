"""Overlapping-chunk byte-level BPE against the library on whole texts."""
import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lectern.llm.common import tokenizer_path
from lectern.llm.overlap_bpe import decode, encode, round_trip

PATH = tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def hard_texts():
    """Long runs, contractions and white space of all kinds around chunk ends, and scripts without spaces."""
    rng = random.Random(5)
    parts = ["don't", "'s", "'ll'll", "  ", "\n\n \t", " ", "a" * 90, "12", "!?", "中文字", "é", " ", "\x1c", "\x85x", "😀", "'", "word", "́", "ĳ", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(250)]
    return texts + ["a" * 3000, " " * 3000 + "x", "'" * 2000, "'s" * 1500, "中" * 2500, "ab " * 2000, "\n" * 999 + "b" + " " * 999, "x" * 64, "x" * 65]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 32), (40, 7), (300, 299)])
def test_chunks_give_the_ids_of_whole_texts(spark, library, chunk, overlap):
    texts = hard_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in round_trip(docs, PATH, chunk, overlap).collect()}
    assert got == {i: expected(library, t) for i, t in enumerate(texts)}


def test_pieces_join_to_ids_and_bytes(spark, library):
    texts = ["some words in a row, " * 300, "short", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decode(encode(docs, PATH, 100, 50), PATH).orderBy("doc_id", "piece").collect()
    assert sum(r.doc_id == 0 for r in rows) > 50
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert b"".join(bytes(r.ids) for r in mine) == np.array(library.encode_ordinary(t), "<u4").tobytes()
        assert b"".join(bytes(r.raw) for r in mine) == t.encode()


def test_odd_rows(odd, none, library):
    for chunk in (32_768, 500):
        got = sorted(map(str, (tuple(r) for r in round_trip(odd, PATH, chunk, 200).collect())))
        assert got == sorted(str((r.doc_id, *expected(library, r.text))) for r in odd.collect())
    assert round_trip(none, PATH).collect() == []


def test_overlap_is_shorter_than_a_chunk(odd):
    with pytest.raises(ValueError):
        encode(odd, PATH, 10, 10)
