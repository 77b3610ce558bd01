"""Translation of user patterns into the Java regular expressions of ``rlike``.

All of this runs once on the driver, on the text of one pattern.
"""

from __future__ import annotations

import re

WORD = "[0-9A-Za-z_]"
_META = set(r"\.+*?{}()[]^$|&-#~ ")

# The meaning of the wildcards of a path glob.
PATH_WILDCARDS = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

# POSIX class names inside brackets and their Java names.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}


class PatternError(ValueError):
    """The pattern is malformed or uses a construct that is not supported."""


def quote(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


def path_glob(pattern: str) -> str:
    """Anchored expression for a whole path; ``**`` crosses directories."""
    if not pattern:
        raise PatternError("glob pattern cannot be empty")
    wanted = pattern.removeprefix("./").strip("/")
    if not wanted:
        return r"(?s)\A.*\z"
    body = "".join(
        PATH_WILDCARDS.get(piece) or quote(piece)
        for piece in re.findall(r"\*\*/|\*\*|.", wanted, re.S)
    )
    return rf"(?s)\A/?{body}\z"


_SHELL_ITEM = re.compile(
    r"""(?P<star>\*+) | (?P<any>\?)
      | \[(?P<negate>\^?)(?P<ranges>(?:(?:\\.|[^\]\\-])(?:-(?:\\.|[^\]\\-]))?)+)\]
      | \\(?P<escaped>.) | (?P<plain>[^\[\\])""",
    re.X | re.S,
)
_SHELL_RANGE = re.compile(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", re.S)


def shell_name(pattern: str) -> str:
    """Anchored expression for a base name: ``*``, ``?``, ``[a-z]``, ``[^a]``, ``\\``."""
    out, at = [], 0
    while at < len(pattern):
        item = _SHELL_ITEM.match(pattern, at)
        if item is None:
            raise PatternError(f"malformed name pattern: {pattern!r}")
        at = item.end()
        if item["star"]:
            out.append("[^/]*")
        elif item["any"]:
            out.append("[^/]")
        elif item["ranges"]:
            pairs = [
                (low[-1], (high or low)[-1]) for low, high in _SHELL_RANGE.findall(item["ranges"])
            ]
            inside = "".join(f"{quote(a)}-{quote(b)}" for a, b in pairs if a <= b)
            if inside:
                out.append(f"[{item['negate']}{inside}]")
            else:
                out.append("." if item["negate"] else r"[^\s\S]")
        else:
            out.append(quote(item["escaped"] or item["plain"]))
    return rf"(?s)\A{''.join(out)}\z"


_REGEX_ITEM = re.compile(
    r"""\\Q.*?(?:\\E|\Z) | \\[pP](?:\{[^}]*\}|.) | \\x\{[0-9A-Fa-f]+\} | \\. | \(\?[^)]
      | \[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\] | [*+?}]\+ | .""",
    re.X | re.S,
)
_BOUNDARY = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
_INSIDE = rf"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
_ESCAPES = {r"\b": _BOUNDARY, r"\B": _INSIDE, r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]", r"\v": r"\x0B"}


def _bracket(item: str) -> str:
    """A bracket expression in which ``[`` and ``&`` are plain characters."""

    def part(found: re.Match) -> str:
        text = found[0]
        if text.startswith("[:"):
            negate, key = text[2] == "^", text.strip("[:^]")
            if key not in POSIX:
                raise PatternError(f"unknown character class {text}")
            return f"[^{POSIX[key]}]" if negate else POSIX[key]
        return {r"\s": r"\t\n\f\r ", r"\v": r"\x0B", "[": r"\[", "&": r"\&"}.get(text, text)

    head = re.match(r"\[\^?\]?", item)[0].replace("]", r"\]")
    body = item[re.match(r"\[\^?\]?", item).end():-1]
    return head + re.sub(r"\\[pP]\{[^}]*\}|\\.|\[:\^?\w+:\]|.", part, body, flags=re.S) + "]"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A linear-time style expression (no back-references, no look-around) for ``rlike``.

    ``(?d)`` makes ``.``, ``^`` and ``$`` depend on ``\\n`` only; word boundaries are ASCII.
    """
    out = []
    for found in _REGEX_ITEM.finditer(pattern):
        item = found[0]
        if item.startswith("(?P<"):
            item = "(?<"
        elif item.startswith("(?") and item[2] in "=!>":
            raise PatternError("look-around and atomic groups are not supported")
        elif item == "(?<" and pattern[found.end():found.end() + 1] in ("=", "!"):
            raise PatternError("look-around and atomic groups are not supported")
        elif len(item) == 2 and item[1] == "+" and item[0] in "*+?}":
            raise PatternError("possessive repetition is not supported")
        elif item in _ESCAPES:
            item = _ESCAPES[item]
        elif re.fullmatch(r"\\[1-9kGZRXhHV]", item):
            raise PatternError(f"{item} is not supported")
        elif item[0] == "[" and len(item) > 1:
            item = _bracket(item)
        elif item == "[":
            raise PatternError("missing closing bracket")
        out.append(item)
    text = "".join(out).replace("(?P<", "(?<")
    return ("(?diu)" if ignore_case else "(?d)") + text


def whole_word(literal: str) -> str:
    """Expression for a literal between ASCII word boundaries.

    An end of the literal that is not a word character is always a boundary.
    """
    before = rf"(?<!{WORD})" if re.match(WORD, literal) else ""
    after = rf"(?!{WORD})" if literal and re.match(WORD, literal[-1]) else ""
    return f"(?s){before}{quote(literal)}{after}"


_SIGNS = frozenset("\\.^$*+?()[]{}|")


def required_literal(pattern: str, ignore_case: bool = False) -> str:
    """The longest text that every match of a linear-time expression has to contain; empty if none is certain.

    Looks at what stands outside of groups and brackets and is not optional.  With ``ignore_case`` only
    ASCII characters count, because the case of the others is not decided alike everywhere.
    """
    runs, run, depth, counting = [], "", 0, False
    for found in _REGEX_ITEM.finditer(pattern):
        item = found[0]
        if counting:
            counting = item != "}"
            continue
        if item == "|" and not depth or item[:2] == "(?" and item not in ("(?:", "(?P", "(?<"):
            return ""  # a choice, or flags that change the meaning of the rest
        if item[0] == "(":
            depth += 1
        elif item == ")":
            depth -= 1
        if re.fullmatch(r"\\[^\w\s]", item):
            plain = item[1:]
        else:
            plain = "" if item in _SIGNS else item
        if depth == 0 and len(plain) == 1 and (plain.isascii() or not ignore_case):
            run += plain
            continue
        if item in ("*", "?", "{"):
            run = run[:-1]
        counting = item == "{"
        runs.append(run)
        run = ""
    return max([*runs, run], key=len)
