"""Work per token: known pre-tokens and blocks are handled many at a time."""
import sys

import numpy as np
import pytest

from lectern.llm import token_codec
from lectern.llm.chunk_encoder import ChunkEncoder
from lectern.llm.common import tokenizer_path
from lectern.llm.token_codec import canonical_codes, code_lengths, decoding_table, encode_ids, lane_starts

tokenizers = pytest.importorskip("tokenizers")
BYTES = tokenizer_path("byte_bpe_50k.json")


def calls(work):
    seen = []
    sys.setprofile(lambda frame, event, arg: seen.append(1) if event in ("call", "c_call") else None)
    try:
        got = work()
    finally:
        sys.setprofile(None)
    return got, len(seen)


def test_known_words_take_no_call_each():
    """Python ran once for each distinct word of a block, known or not."""
    text = " ".join(f"w{chr(97 + i % 26)}é{chr(97 + i // 26 % 26)} {i}" for i in range(20000))
    coder = ChunkEncoder(BYTES)
    first = coder.encode([text])
    again, n = calls(lambda: coder.encode([text]))
    assert again == first and n < 2000
    assert np.frombuffer(first[0], "<u4").tolist() == tokenizers.Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


def test_hashes_that_share_a_slot():
    coder = ChunkEncoder(BYTES)
    keys = np.array([0, 1 << 20, 3 << 40, 5, 5 + (1 << 30), 65535, 65535 + (1 << 16), 6], np.uint64)   # equal low bits, and the last slot
    rows = np.arange(len(keys), dtype=np.int32)
    coder._put(keys, rows)
    asked = np.concatenate([keys[::-1], keys, np.array([7 << 50, 1 << 16, 5 + (1 << 40), 9], np.uint64)])
    assert coder._rows(asked).tolist() == [*rows[::-1], *rows, -1, -1, -1, -1]


def test_words_stay_known_as_the_memory_grows():
    words = [f" {i:06d}" for i in range(70000)]
    coder = ChunkEncoder(BYTES)
    whole = coder.encode(["".join(words)])
    assert 2 * coder.count <= len(coder.slots) and coder.count == len(words)
    assert b"".join(coder.encode(words)) == whole[0] and coder.count == len(words)


def test_small_blocks_are_decoded_together(monkeypatch):
    """A call, and with it up to STRIDE steps, was made for each block."""
    rng = np.random.default_rng(1)
    counts = (1e6 / np.arange(1, 3001) ** 1.2).astype(int) + 1
    lengths = code_lengths(counts, 18)
    blocks, want = [], []
    for per_doc in ([1], [3000, 5], [1] * 40, [1024, 1025, 1], [7]):
        ids = rng.choice(len(counts), sum(per_doc), p=counts / counts.sum())
        payload, offsets = encode_ids(ids, lengths, canonical_codes(lengths))
        marks = offsets[lane_starts(np.array(per_doc))[0]].tolist()
        blocks.append({"counts": per_doc, "checkpoints": marks, "payload": payload})
        want.append(ids.tolist())
    made, plain = [], token_codec.decode_ids
    monkeypatch.setattr(token_codec, "decode_ids", lambda *a: made.append(1) or plain(*a))
    got = list(token_codec.decode_blocks(blocks, decoding_table(lengths)))
    assert [ids.tolist() for _, ids in got] == want and [b for b, _ in got] == blocks and len(made) == 1
    monkeypatch.setattr(token_codec, "TOGETHER", 2000)      # a larger block stands alone
    assert [ids.tolist() for _, ids in token_codec.decode_blocks(blocks, decoding_table(lengths))] == want and len(made) == 6
    assert list(token_codec.decode_blocks([], decoding_table(lengths))) == []
