"""Token ids by the vocabulary of a tokenizers file, and counts of huge texts from overlapping chunks.

The ids are those of the ``tokenizers`` library.  They are made from its JSON file: byte-level merges
whose ids follow the order of the merges go to a ``tiktoken`` encoding, which is about seven times as
fast (see README); any file of another kind goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, rows_of, table, text_steps

CHUNK = 1 << 16
OVERLAP = 1 << 10
LIMIT = 512


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies use for every byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Library:
    """Ids as ``tokenizers`` gives them, without tokens for begin and end; special strings inside texts keep their default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.fast = self._fast(spec)
        self.lengths = np.zeros(1 + max([*spec["model"]["vocab"].values(), *self.specials.values()]), dtype=np.int64)
        signs = _byte_signs()
        if self.fast:
            for token, i in spec["model"]["vocab"].items():
                self.lengths[i] = len(token) if set(token) <= signs.keys() else len(token.encode())
            for token, i in self.specials.items():
                self.lengths[i] = len(token.encode())
        self._split = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self._pieces = regex.compile(public_tokenizers.PATTERN)

    def _fast(self, spec: dict):
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = (
            model["type"] == "BPE" and not spec["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex")
            and not before.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not plain:
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        if len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        signs = _byte_signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def ids(self, text: str) -> list[int]:
        if self.fast is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def starts(self, text: str) -> np.ndarray:
        """Where the pieces of a text begin that are encoded by themselves, in code points."""
        out, at = [], 0
        for special in self._split.finditer(text) if self._split else ():
            out += [at + m.start() for m in self._pieces.finditer(text[at : special.start()])]
            out.append(special.start())
            at = special.end()
        out += [at + m.start() for m in self._pieces.finditer(text[at:])]
        return np.array(out, dtype=np.int64)


class Chunk:
    """A chunk that begins at code point ``begin``: its ids, and their offsets where asked for."""

    def __init__(self, library: Library, text: str, begin: int, end: int):
        self.begin, self.end, self.library = begin, min(end, len(text)), library
        self.text = text[begin : self.end]
        self.ids = np.array(library.ids(self.text), dtype=np.int64)

    def pieces(self) -> np.ndarray:
        return self.begin + self.library.starts(self.text)

    def tokens_before(self, place: int) -> int:
        """Ids that end at or before a boundary, from their byte offsets."""
        upto = len(self.text[: place - self.begin].encode())
        return int(np.searchsorted(np.cumsum(self.library.lengths[self.ids]), upto, side="right"))


def count_tokens(library: Library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of ids of a text, from chunks of about ``chunk`` code points.

    Neighbouring chunks overlap.  They are spliced at a place where a piece begins in both: the
    pieces of the left chunk are those of the whole text as long as they end before the chunk's
    last signs (the pattern looks one sign ahead, a special string is shorter than the margin),
    and what follows a beginning of a piece does not depend on what stands before it.  Where
    no such place is found, the overlap is doubled; where it would take the whole left chunk,
    the left chunk grows instead.
    """
    if len(text) <= chunk or library.fast is None:
        return len(library.ids(text))
    margin = 2 + max([0, *map(len, library.specials)])
    left, total, after = Chunk(library, text, 0, chunk), 0, 0
    while left.end < len(text):
        wide, sure = overlap, left.pieces()
        sure = sure[(sure > after) & (sure <= left.end - margin)]
        while True:
            if left.end - wide <= after:  # no place within the chunk: let it grow
                left = Chunk(library, text, left.begin, 2 * left.end - left.begin)
                break
            right = Chunk(library, text, left.end - wide, left.end - wide + chunk + wide)
            common = np.intersect1d(sure, right.pieces())
            if len(common):
                total += left.tokens_before(common[0]) - (left.tokens_before(after) if after > left.begin else 0)
                left, after = right, int(common[0])
                break
            wide *= 2
    return total + len(left.ids) - (left.tokens_before(after) if after > left.begin else 0)


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(documents: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text.

    Defined results: null is the empty text (0 bytes, 0 tokens).  Repeated rows stay; other columns
    are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(vocabulary)
        for rows, texts in text_steps(batches):
            counts = [count_tokens(library, t.decode(), chunk, overlap) for t in texts]
            yield rows_of(COUNTS, rows.column(0).cast(pa.int64()), [len(t) for t in texts], counts)

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )


@query("op5_token_counts")
def op5_token_counts(spark, folder):
    counts = token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
