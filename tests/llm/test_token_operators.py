"""Byte pairs, token counts and packing against the tokenizer libraries."""

import base64
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from leafmill.llm import byte_pairs as B
from leafmill.llm import packing as K
from leafmill.llm import tokens as T

VOCABULARY, FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "the", "é", "ß", "漢字", "1", "99", "!", "--", "\x1c", "\x85", " ", "'s",
         "'", "aaaa", "=", "A", "\U0001f600", "\x00", "<|endoftext|>", "<|endof", "text|>"]
TEXTS = ["", None, "one", "Some words, and more words.\n\nIt's 2024!", "é" * 700, "a" * 5000, " " * 3000 + "x", "<|endoftext|>",
         "Some words, and more words.\n\nIt's 2024!"]


def randoms(n, seed, longest=40):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def documents(spark):
    # more columns, one of them with the name of a result
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 7), (3, TEXTS[3], "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_transducer_equals_library(library):
    encoder = B.Encoder(B.read_ranks(VOCABULARY), P.PATTERN, memory=50)
    encoder.transducer.max_states = 300  # thrown away often
    decoder = B.Decoder(encoder.transducer.ranks)
    for text in randoms(2000, 1) + [t or "" for t in TEXTS]:
        ids = memoryview(encoder.encode(text)).cast("i").tolist()
        assert ids == library.encode_ordinary(text)
        assert "".join(decoder.stream(ids)) == text


def test_broken_bytes_are_replaced():
    decoder, draw = B.Decoder(B.read_ranks(VOCABULARY)), random.Random(2)
    for _ in range(2000):
        ids = [draw.randrange(256) if draw.random() < 0.7 else draw.randrange(50000) for _ in range(12)]
        assert "".join(decoder.stream(ids)) == b"".join(decoder.bytes_of[i] for i in ids).decode(errors="replace")


def test_byte_pairs_of_a_table(spark, documents, library):
    got = B.decode(B.encode(documents, VOCABULARY), VOCABULARY).collect()
    assert len(got) == documents.count()
    texts = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    for row in got:
        assert row.ids == library.encode_ordinary(texts[row.doc_id]) and row.decoded == texts[row.doc_id]
    assert B.encode(documents.limit(0), VOCABULARY).count() == 0


def test_counts_from_chunks_equal_whole_texts():
    library, whole = T.Library(FILE), Tokenizer.from_file(FILE)
    assert library.fast is not None
    draw = random.Random(3)
    for text in randoms(2500, 4, 80) + ["a" * 3000, " " * 3000 + "b", "ab " * 2000]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert library.ids(text) == ids
        assert T.count_tokens(library, text, draw.choice([24, 40, 70]), draw.choice([4, 10])) == len(ids)


def test_counts_of_a_table(documents):
    whole = Tokenizer.from_file(FILE)
    got = T.token_counts(documents, FILE, chunk=500, overlap=20).collect()
    texts = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    assert len(got) == documents.count()
    for row in got:
        text = texts[row.doc_id]
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(whole.encode(text, add_special_tokens=False).ids))


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_files_go_to_the_library(name):
    library, whole = T.Library(P.path(name)), Tokenizer.from_file(P.path(name))
    assert library.fast is None
    assert T.count_tokens(library, "Some Words " * 50, chunk=20) == len(whole.encode("Some Words " * 50, add_special_tokens=False).ids)


def test_packing_round_trip(documents):
    whole = Tokenizer.from_file(FILE)
    pieces = K.digests(K.pack(documents.repartition(3), FILE, length=64)).collect()
    full = K.pack(documents.repartition(3), FILE, length=64).collect()
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for number, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or number == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    found = {}
    for r in full:
        found.setdefault(r.doc_id, []).append((r.start, memoryview(bytes(r.ids)).cast("I").tolist(), r.doc_tokens))
    texts = {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id"}
    for doc_id, text in texts.items():
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        got = [i for _, part, _ in sorted(found[doc_id]) for i in part]
        # the repeated row is packed twice, possibly cut at other places
        assert len(got) == len(ids) * (2 if doc_id == 3 else 1) and {n for _, _, n in found[doc_id]} == {len(ids)}
        if doc_id != 3:
            assert got == ids
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in pieces if r.doc_id == 5}
    ids = [*whole.encode(TEXTS[5], add_special_tokens=False).ids, 0]
    for r in pieces:
        if r.doc_id == 5:
            data = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
            assert crc[5, r.start] == zlib.crc32(data)
    assert K.pack(documents.limit(0), FILE).count() == 0


