"""Path expressions.  All are built-in column functions (whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under a directory that hold its derived summaries.
SIDECARS = (".abstract.md", ".overview.md")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(path: Column | str) -> Column:
    """Absolute path without empty, ``.`` and ``..`` components; empty is the root."""
    path = _col(path)
    parts = F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(
            part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.array_append(kept, part)),
    )
    has_up = path.rlike(r"(^|/)\.\.(/|\z)")
    return F.concat(F.lit("/"), F.array_join(F.when(has_up, resolved).otherwise(parts), "/"))


def name(path: Column | str) -> Column:
    path = _col(path)
    return F.when(path == "/", F.lit("/")).otherwise(F.substring_index(path, "/", -1))


def parent(path: Column | str) -> Column:
    """Directory of a path; the root has the empty parent."""
    path = _col(path)
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return (
        F.when(path == "/", F.lit(""))
        .when(cut <= 0, F.lit("/"))
        .otherwise(F.substring(path, F.lit(1), cut))
    )


def ancestors(path: Column | str, include_self: bool = False) -> Column:
    """Array of the directories above a cleaned path, the root first."""
    path = _col(path)
    parts = F.split(path, "/")
    last = F.size(parts) - (0 if include_self else 1)
    below_root = F.when(
        (path != "/") & (last >= 2),
        F.transform(
            F.sequence(F.lit(2), F.greatest(last, F.lit(2))),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
    root = F.when(
        (path != "/") | F.lit(include_self), F.array(F.lit("/"))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(root, below_root)


def under(path: Column | str, scope: Column | str) -> Column:
    """True for the scope itself and everything below it; never a LIKE pattern.

    ``scope`` is a column, or a literal when given as text.
    """
    path = _col(path)
    if isinstance(scope, str):
        if scope in ("", "/"):
            return F.lit(True)
        return (path == scope) | path.startswith(scope + "/")
    return scope.isin("", "/") | (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def below(path: Column | str, root: str) -> Column:
    """True for everything strictly below ``root``."""
    path = _col(path)
    return path != "/" if root == "/" else path.startswith(root + "/")


def relative(path: Column | str, root: str) -> Column:
    path = _col(path)
    if root == "/":
        return F.substring(path, 2, 2**31 - 1)
    prefix = root + "/"
    return F.when(
        path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)
    ).otherwise(path)


def depth(path: Column | str, root: str = "/") -> Column:
    rel = relative(path, root)
    return F.when(rel == "", F.lit(0)).otherwise(
        F.length(rel) - F.length(F.replace(rel, F.lit("/"), F.lit(""))) + 1
    )


def hidden(path: Column | str, root: str = "/") -> Column:
    """True when a component below ``root`` starts with a dot."""
    return F.concat(F.lit("/"), relative(path, root)).contains("/.")


def reject_reason(path: Column | str) -> Column:
    """Why a raw path cannot name a document; null when it can."""
    path = _col(path)
    reserved = F.exists(F.split(path, "/"), lambda part: part.isin(*SIDECARS))
    return (
        F.when(path.contains("://") | F.contains(path, F.char(F.lit(0))), F.lit("INVALID_PATH"))
        .when(clean(path) == "/", F.lit("ROOT"))
        .when(reserved, F.lit("RESERVED_NAME"))
    )


def preorder(path: Column | str) -> Column:
    """Sort key that lists a directory before its content and in front of later names."""
    return F.split(_col(path), "/")
