"""Text expressions: tokens, query terms, passages, byte cuts, hashes, replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text model.
PASSAGE_LENGTH = 480
LABEL_LENGTH = 40

_HAN = r"\p{IsHan}"
# All characters from the first Han one on.
_MAYBE_HAN = r"[\x{2E80}-\x{10FFFF}]"
_RUNS = r"\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"
_BETWEEN_WORDS = r"[^\p{L}\p{Nd}]+"
_OTHER = r"[\p{L}\p{Nd}&&[^\p{IsHan}]]+"
_HAN_PAIR = r"(?=(\p{IsHan}{2}))"
_LONE_HAN = r"(?<!\p{IsHan})\p{IsHan}(?!\p{IsHan})"
_TERM = rf"(?=(\p{{IsHan}}{{2}}|{_LONE_HAN}|{_OTHER}))(?:\p{{IsHan}}|{_OTHER})"
_BLANK = r"\p{IsWhite_Space}"
# The same characters; both ends are cut without a look at what lies between.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _strings() -> Column:
    return F.array().cast("array<string>")


def lower(text: Column | str) -> Column:
    """Lower case character by character, without the special multi-character cases."""
    text = _col(text)
    special = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("Σ"))
    return F.lower(F.when(special, F.translate(text, "İΣ", "iσ")).otherwise(text))


def lines(content: Column | str) -> Column:
    return F.split(_col(content), "\n")


def trim(text: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(_col(text), F.lit(_BLANKS))


def is_blank(text: Column | str) -> Column:
    return ~_col(text).rlike(rf"[^{_BLANK}]")


def _bigrams(run: Column) -> Column:
    """Overlapping character pairs of a run; none for a single character."""
    return F.when(
        F.length(run) > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
            lambda i: F.substring(run, i, F.lit(2)),
        ),
    ).otherwise(_strings())


def tokens(text: Column | str) -> Column:
    """Array of index tokens in text order.

    Words are runs of letters and digits in lower case.  A Han run gives its
    characters and then its overlapping pairs.
    """
    folded = lower(text)
    runs = F.regexp_extract_all(folded, F.lit(_RUNS), F.lit(0))
    mixed = F.flatten(
        F.transform(
            runs,
            lambda run: F.when(
                run.rlike(_HAN), F.concat(F.filter(F.split(run, ""), lambda c: c != ""), _bigrams(run))
            ).otherwise(F.array(run)),
        )
    )
    return F.when(folded.rlike(_HAN), mixed).otherwise(_words(folded))


def _words(folded: Column) -> Column:
    """Words of a text without Han characters; splitting is the fastest way to get them."""
    return F.array_remove(F.split(folded, _BETWEEN_WORDS), "")


def token_bag(text: Column | str) -> Column:
    """The same tokens without their order: plain pattern matches only.

    Counting needs no order, and an argument without lambda functions lets Spark pass the
    array to a vectorised function directly.
    """
    return bag_of_lower(lower(text))


def bag_of_lower(folded: Column | str) -> Column:
    """Token bag of a text that is in lower case already."""
    folded = _col(folded)
    found = [
        F.regexp_extract_all(folded, F.lit(pattern), F.lit(group))
        for pattern, group in ((_OTHER, 0), (_HAN, 0), (_HAN_PAIR, 1))
    ]
    # the script of a character is looked up only in texts with characters that may be Han
    return F.when(folded.rlike(_MAYBE_HAN) & folded.rlike(_HAN), F.concat(*found)).otherwise(_words(folded))


def query_terms(query: Column | str, limit: int | None = None) -> Column:
    """Array of the different terms of a query, in order; ``limit`` keeps only the first ones.

    A Han run gives its overlapping pairs, or its character when it is alone.
    """
    terms = F.regexp_extract_all(lower(query), F.lit(_TERM), F.lit(1))
    different = F.array_distinct(terms)
    return different if limit is None else F.slice(different, 1, limit)


def run_starts(sorted_tokens: str) -> Column:
    """Positions (from 1) at which a new value starts in a sorted array column."""
    word = F.col(sorted_tokens)
    positions = F.when(F.size(word) > 0, F.sequence(F.lit(1), F.size(word))).otherwise(
        F.array().cast("array<int>")
    )
    return F.filter(positions, lambda i: (i == 1) | (F.get(word, i - 1) != F.get(word, i - 2)))


def run_lengths(sorted_tokens: str, starts: str) -> Column:
    """array<struct<lexeme, tf>> from a sorted array column and its run starts.

    Counting inside the row needs no shuffle.
    """
    word, at = F.col(sorted_tokens), F.col(starts)
    return F.transform(
        at,
        lambda start, i: F.struct(
            F.get(word, start - 1).alias("lexeme"),
            (F.coalesce(F.get(at, i + 1), F.size(word) + 1) - start).alias("tf"),
        ),
    )


def line_label(line: Column | str) -> Column:
    """The text to the first ``": "`` when that lies in the first characters of a line."""
    return F.regexp_extract(_col(line), rf"(?s)\A(.{{0,{LABEL_LENGTH - 2}}}?: )", 1)


def passages(content: Column | str, limit: int = PASSAGE_LENGTH) -> Column:
    """Array of the non-empty trimmed lines, long lines cut into marked parts.

    One expression describes a part: the rest of the line when it fits; else the
    longest piece in the second half of the limit that ends before white space; else
    exactly ``limit`` characters.
    """
    piece = (
        rf"(?s)(.{{1,{limit}}}\z|.{{{limit // 2 + 1},{limit}}}(?={_BLANK})|.{{{limit}}}){_BLANK}*"
    )

    def split_line(line: Column) -> Column:
        pieces = F.regexp_extract_all(line, F.lit(piece), F.lit(1))
        label = line_label(line)
        return F.transform(
            pieces,
            lambda part, i: F.concat(
                F.when(i > 0, F.concat(label, F.lit("... "))).otherwise(F.lit("")),
                F.regexp_replace(part, rf"{_BLANK}+\z", ""),
                F.when(i < F.size(pieces) - 1, F.lit(" ...")).otherwise(F.lit("")),
            ),
        )

    trimmed = F.filter(
        F.transform(lines(content), lambda line: trim(line)), lambda line: line != ""
    )
    return F.flatten(
        F.transform(
            trimmed,
            lambda line: F.when(F.length(line) > limit, split_line(line)).otherwise(F.array(line)),
        )
    )


def cut_bytes(text: Column | str, limit: int) -> Column:
    """The first ``limit`` bytes, without half of a character at the end."""
    text = _col(text)
    raw = F.substring(text.cast("binary"), 1, limit + 1)
    # Drop the byte after the limit and, when it continues a character, that
    # character's bytes before it.
    kept = F.regexp_replace(F.hex(raw), r"((?:[C-F].)(?:[89AB].){0,2})?[89AB].\z|..\z", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.decode(F.unhex(kept), "UTF-8")
    )


def cut_chars(text: Column | str, limit: int) -> Column:
    return F.substring(_col(text), 1, limit)


def content_hash(content: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(content).cast("binary"), 256))


def occurrences(text: Column | str, part: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty literal."""
    text = _col(text)
    cut = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (cut / F.length(part)).cast("int")).otherwise(F.lit(0))


def replace_first(text: Column | str, old: Column, new: Column) -> Column:
    text = _col(text)
    at = F.position(old, text)
    return F.when(at == 0, text).otherwise(
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            new,
            F.substring(text, at + F.length(old), F.length(text)),
        )
    )
