"""Rare pieces are followed side by side and make few states; lists of whole characters are decoded at once."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from leafmill.llm import byte_pairs as B

from test_token_operators import PARTS, TEXTS, VOCABULARY, randoms

RANKS = B.read_ranks(VOCABULARY)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(packed):
    return [memoryview(p).cast("i").tolist() for p in packed]


def test_rare_pieces_make_few_states():
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdeinorst", k=draw.randrange(4, 12))) for _ in range(200)) for _ in range(50)]
    encoder, whole = B.Encoder(RANKS, P.PATTERN), library()
    got = [i for k in range(0, 50, 10) for i in ids_of(encoder.encode_all(texts[k : k + 10]))]
    assert got == [whole.encode_ordinary(t) for t in texts]
    assert len(encoder.known) > 8000 and len(encoder.transducer.states) < 1000  # 3006 where each second need made a move


def test_steps_needs_and_memories_give_the_same_ids():
    texts, whole = randoms(600, 6) + [t or "" for t in TEXTS] + ["".join(random.Random(7).choices(PARTS, k=4000))], library()
    expected = [whole.encode_ordinary(t) for t in texts]
    for needs, memory, most, bits in ((1, 50, 300, 2), (2, 400_000, 300, 20), (32, 50, 200_000, 4), (10**9, 50, 5, 20)):
        encoder = B.Encoder(RANKS, P.PATTERN, memory)
        encoder.transducer.needs, encoder.transducer.max_states = needs, most
        encoder.transducer.fits = B.Fits(encoder.transducer, bits)
        assert [i for k in range(0, len(texts), 100) for i in ids_of(encoder.encode_all(texts[k : k + 100]))] == expected
        assert len(encoder.known) + len(encoder.older) <= memory
    assert encoder.transducer.encode([]) == [] and encoder.encode_all([]) == [] and encoder.encode_all(["", ""]) == [b"", b""]
    short = encoder.transducer.encode([t.encode() for t in ("thing", "", "é" * 30)] * 50, step_bytes=7)
    assert ids_of(short) == [whole.encode_ordinary(t) for t in ("thing", "", "é" * 30)] * 50


def test_pairs_in_arrays_equal_pairs_one_by_one():
    transducer, draw = B.Transducer(RANKS), random.Random(8)
    left = [draw.randrange(len(RANKS) + 1) for _ in range(4000)] + [draw.randrange(600) for _ in range(4000)]
    right = [draw.randrange(len(RANKS)) for _ in range(4000)] + [draw.randrange(600) for _ in range(4000)]
    left, right = zip(*((a, b) for a, b in zip(left, right) if a == len(RANKS) or transducer.spines(a)))
    expected = [transducer.apart(None if a == len(RANKS) else a, b) for a, b in zip(left, right)]
    fits = B.Fits(transducer, bits=10)
    for _ in range(2):
        assert fits(np.array(left), np.array(right)).tolist() == expected
    assert not all(expected)


def test_decoded_at_once_equals_the_stream():
    decoder, whole = B.Decoder(RANKS), library()
    for text in randoms(300, 9) + ["漢字 \U0001f600 plain", "plain"]:
        ids = whole.encode_ordinary(text)
        assert decoder.decode(ids) == "".join(decoder.stream(ids)) == text
        broken = [i for i in ids if len(decoder.bytes_of[i]) > 1 or decoder.bytes_of[i] < b"\x90"]
        assert decoder.decode(broken) == b"".join(map(decoder.bytes_of.get, broken)).decode(errors="replace")
    assert decoder.decode([]) == ""
    assert all(decoder.bytes_of[i].decode(errors="replace") == t for i, t in decoder.whole.items())


def test_vocabularies_without_merges_or_without_a_byte():
    bare = {bytes([b]): b for b in range(256)}
    assert ids_of(B.Encoder(bare, P.PATTERN).encode_all(["some é", "so"])) == [[*"some é".encode()], [*b"so"]]
    lacking = {bytes([b]): b for b in range(122)} | {b"ab": 122}
    encoder = B.Encoder(lacking, P.PATTERN)
    assert ids_of(encoder.encode_all(["abab a"])) == [[122, 122, 32, 97]]
    for text in ("zab", "abzab", "abz"):
        with pytest.raises(ValueError, match="without a token"):
            encoder.encode_all([text])
