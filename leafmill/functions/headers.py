"""Metadata headers of Markdown documents: a YAML block between two ``---`` lines."""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # Only documents that have a header need the decoder.
    yaml = None

# Keys with a required type, and keys that a document must not set.
TEXT_KEYS = ("title", "source")
LIST_KEYS = ("tags",)
RESERVED_KEYS = ("language", "source_hash", "generated_by", "status", "revision")

_OPENING = r"\A---\r?(?:\n|\z)"
_FENCE_LINE = r"(?dm)^---\r?(?:\n|\z)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_markdown(path: Column | str) -> Column:
    return _col(path).rlike(r"(?i)\.md\z")


def opens_header(path: Column | str, content: Column | str) -> Column:
    return is_markdown(path) & _col(content).rlike(_OPENING)


def _parts(content: Column | str) -> Column:
    """[empty, header, body] for a document that opens a header and closes it."""
    return F.split(_col(content), _FENCE_LINE, 3)


def header_text(path: Column | str, content: Column | str) -> Column:
    """Text between the fences; null without a complete header."""
    parts = _parts(content)
    return F.when(opens_header(path, content) & (F.size(parts) == 3), F.get(parts, F.lit(1)))


def body(path: Column | str, content: Column | str) -> Column:
    """The document without its complete header, byte for byte."""
    parts = _parts(content)
    return F.when(
        opens_header(path, content) & (F.size(parts) == 3), F.get(parts, F.lit(2))
    ).otherwise(_col(content))


if yaml is not None:

    class _Loader(yaml.SafeLoader):
        """Safe loader that rejects repeated keys; only true and false are booleans."""

    _Loader.yaml_implicit_resolvers = {
        first: [(tag, rule) for tag, rule in rules if tag != "tag:yaml.org,2002:bool"]
        for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    _Loader.add_implicit_resolver(
        "tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF")
    )

    def _mapping(loader, node, deep=False):
        keys = [loader.construct_object(key, deep=True) for key, _ in node.value]
        repeated = [k for i, k in enumerate(keys) if k in keys[:i]]
        if repeated:
            raise yaml.YAMLError(f"key {repeated[0]!r} occurs twice")
        loader.flatten_mapping(node)
        return {
            loader.construct_object(k, deep=True): loader.construct_object(v, deep=True)
            for k, v in node.value
        }

    _Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


def _plain(value):
    """A value that JSON can hold, or an error."""
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("header keys must be text")
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.isoformat() + ("" if value.tzinfo else "Z")
    if isinstance(value, datetime.date):
        return value.isoformat() + "T00:00:00Z"
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise ValueError("header numbers must be finite")
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    raise ValueError("header must be JSON-compatible")


def metadata_problem(metadata: dict) -> str | None:
    """First broken metadata rule of a header; None when all hold."""
    for key in TEXT_KEYS:
        if key in metadata and not isinstance(metadata[key], str):
            return f"RULE: {key} must be a string"
    for key in LIST_KEYS:
        entries = metadata.get(key, [])
        if not isinstance(entries, list) or not all(isinstance(e, str) for e in entries):
            return f"RULE: {key} must be a list of strings"
    reserved = [key for key in RESERVED_KEYS if key in metadata]
    return f"RULE: {reserved[0]} is reserved" if reserved else None


def decode_header(text: str) -> tuple[str | None, str | None]:
    """(metadata as JSON, error) of one header text."""
    if yaml is None:
        return None, "DECODER_MISSING: PyYAML is not installed"
    try:
        value = yaml.load(text, Loader=_Loader)
        if value is None:
            return None, None
        if not isinstance(value, dict):
            return None, "NOT_A_MAPPING: header must be a mapping"
        problem = metadata_problem(value)
        if problem:
            return None, problem
        return json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")), None
    except (yaml.YAMLError, ValueError, TypeError) as problem:
        return None, "INVALID_YAML: " + str(problem).split("\n")[0]


def document_problem(path: str, content: str) -> str | None:
    """Why one document (in a fold over writes) has a wrong header; None when it is right."""
    parts = re.split(r"(?m)^---\r?(?:\n|\Z)", content, maxsplit=2)
    if not path.lower().endswith(".md") or not re.match(r"---\r?(?:\n|\Z)", content):
        return None
    if len(parts) != 3:
        return "UNCLOSED: header has no closing line"
    return decode_header(parts[1])[1]


@F.pandas_udf(T.StructType().add("metadata", "string").add("error", "string"))
def _decode(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else decode_header(t) for t in texts]
    return pd.DataFrame(rows, columns=["metadata", "error"])


def parse_headers(files: DataFrame) -> DataFrame:
    """Add ``body``, ``metadata`` (JSON text) and ``metadata_error`` in one pass.

    The Python decoder sees only the header column, which is null for most rows; document
    bodies stay on the JVM side.  A document whose header is wrong keeps its raw content
    as body.
    """
    unclosed = opens_header("path", "content") & F.col("_header").isNull()
    error = F.col("metadata_error")
    return (
        files.withColumn("_header", header_text("path", "content"))
        .withColumn("_decoded", _decode("_header"))
        .withColumn(
            "metadata_error",
            F.when(unclosed, F.lit("UNCLOSED: header has no closing line")).otherwise(
                F.col("_decoded.error")
            ),
        )
        .select(
            *files.columns,
            F.when(error.isNull(), body("path", "content")).otherwise(F.col("content")).alias("body"),
            F.when(error.isNull(), F.col("_decoded.metadata")).alias("metadata"),
            "metadata_error",
        )
    )


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed files into the good table and the table of rejected headers."""
    bad = parsed.filter(F.col("metadata_error").isNotNull())
    return parsed.filter(F.col("metadata_error").isNull()), bad
