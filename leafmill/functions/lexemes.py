"""Lexemes: the form of a token that the index stores.

``zh`` keeps the lower-case token.  ``en`` drops stop words and applies the
published Porter2 (Snowball English) stemming rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("en", "zh")
# Tokens that a task stems in one step, and stems that it remembers between steps.
STEP_TOKENS, MOST_STEMS = 200_000, 100_000

# The Snowball English stop words (127 words).
STOP_WORDS = frozenset(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now
""".split()
)

# The tables of the Porter2 definition.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion", "al", "er", "ic",
)
_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


def _drop_inflection(word: str, r1: int) -> str:
    """Step 1b: the past and progressive endings."""
    end = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    stem = word[: len(word) - len(end)]
    if end.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else word
    if not end or not _VOWEL.search(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", stem):
        return stem[:-1]
    return stem + "e" if r1 >= len(stem) and _short_end(stem) else stem


def stem(word: str) -> str:
    """Porter2 stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else _after(word, 0)
    r2 = _after(word, r1)

    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    word = _drop_inflection(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _longest(word, _STEP2)
    base = word[: len(word) - len(end)]
    if end and len(base) >= r1:
        if end == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif end == "li":
            word = base if base[-1:] and base[-1] in "cdeghkmnrt" else word
        else:
            word = base + _STEP2[end]

    end = _longest(word, _STEP3)
    base = word[: len(word) - len(end)]
    if end and len(base) >= (r2 if end == "ative" else r1):
        word = base + _STEP3[end]

    end = _longest(word, _STEP4)
    base = word[: len(word) - len(end)]
    if end and len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
        word = base

    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_end(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _stems_of(rows: pa.ListArray, stems: dict[str, str | None]) -> pa.ListArray:
    """The stems of every row's tokens; each different token is looked at once."""
    counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    coded = rows.flatten().dictionary_encode()
    for token in coded.dictionary.to_pylist():
        if token not in stems:
            stems[token] = None if token in STOP_WORDS else stem(token)
    forms = pa.array([stems[t] for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    kept = np.r_[0, np.cumsum(forms.is_valid().to_numpy(zero_copy_only=False))]
    ends = kept[np.r_[0, np.cumsum(counts)]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), forms.drop_null(), mask=rows.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _english(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    stems: dict[str, str | None] = {}
    for rows in batches:
        parts, at = [], 0
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(), dtype=np.int64)
        while at < len(rows):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + STEP_TOKENS, side="right")))
            parts.append(_stems_of(rows.slice(at, end - at), stems))
            if len(stems) > MOST_STEMS:
                stems.clear()
            at = end
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def lexemes(tokens: Column, language: str) -> Column:
    """Map an array of tokens to its array of lexemes, in order."""
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}")
    return tokens if language == "zh" else _english(tokens)
