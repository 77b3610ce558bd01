"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds.

The base patterns give certain spans.  Wider generators propose overlapping candidates of the same kinds;
each gets small whole-number features of its format and its context.  All candidates of the
table are counted per feature vector and per agreement with a base span: a table whose size is bounded by the
number of feature vectors, whatever the number of documents.  On these counts the driver fits
boosted trees (logistic loss, Newton leaves), one set of trees per kind, on the documents of
one hash half; the other half calibrates each kind's threshold, the lowest score at which the
wanted precision holds.  The trees become one SQL expression.  A candidate above its
threshold that meets no base span is added, the best score first, without overlaps.

What decides a base pattern alone (the plus sign of a phone, the exact separators of a card) is no
feature, so the trees carry over to other spellings; check sums and ranges are features.

Defined results: null is the empty text without spans.  Repeated rows are judged row by row; rows without ``doc_id`` too.
A table without any agreeing candidate gets no added spans.  Other columns are not looked at.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import query, table

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base spans.  The starts and the possessive repetitions only save the engine
# from trying again what must fail again; the matches are those of the plain patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Signs without which a text has no span of the kind.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}

# Groups of an IPv6 address, and what may follow its double colon.
_HEX = "[0-9A-Fa-f]{1,4}"
_TAIL = rf"(?:{_HEX}:){{0,5}}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}|{_HEX}(?::{_HEX}){{0,6}}"

WIDE = {
    "email": (
        r"[^\s@<>()\[\],;:\"']{1,64}+@[^\s@<>()\[\],;:\"']{2,255}+",
        r"(?i)[a-z0-9._%+-]{1,64}+\s?+[(\[]\s?+(?:at|@)\s?+[)\]]\s?+[a-z0-9-]{1,63}+(?:(?:\.|\s?+[(\[]\s?+dot\s?+[)\]]\s?+)[a-z0-9-]{1,63}+){1,5}+",
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
        rf"(?<![\p{{L}}\p{{N}}:.])(?:{_HEX}(?::{_HEX}){{0,6}}+::(?:{_TAIL})?+|::(?:{_TAIL}))(?![\p{{L}}\p{{N}}:])",
    ),
    "card": (r"(?<![\p{L}\p{N}])[0-9]{13,19}(?![\p{L}\p{N}])", r"(?<![\p{L}\p{N}])[0-9]{4}(?:[\x20._/-][0-9]{4}){3}(?![\p{L}\p{N}])"),
    "phone": (
        r"(?<![\p{L}\p{N}+])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}])\([0-9]{2,5}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}+])[0-9]{7,15}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}+])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![\p{L}\p{N}])",
    ),
}

# Words that announce personal data, or something else that has the same form.
_ANNOUNCE = r"(?i)\b(?:tel|phone|call|fax|mobile|mobil|cell|telefon|t[ée]l[ée]phone|tel[ée]fono|llame|mail|e-mail|contact|write to|card|visa|mastercard|karte|carte|tarjeta|ip|host|address|from)\b"
_OTHER = r"(?i)\b(?:version|v|release|order|invoice|isbn|token|password|key|id|ref|no|nr|sha|hash|build)\b"

FEATURES = ("digits", "groups", "paren", "dash", "dot", "space", "before", "after", "valid", "said")
CONTEXT = 24


@dataclass(frozen=True)
class Fit:
    """Parameters of the boosted trees and of the calibration."""

    rounds: int = 24
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0
    precision: float = 0.9


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): the non-overlapping matches from the left with their places.

    What stands between the matches comes from a split by the same pattern, so the places are sums of lengths.
    """
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("m")),
    )
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.aggregate(
        F.filter(pairs, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("e"), x["m"].alias("m")
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a short string of digits is right."""
    # fixed values: the digit sums of the doubled digits
    doubled = F.translate(digits, "0123456789", "0246813579")
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        lambda i: F.coalesce(
            F.when((F.length(digits) - i) % 2 == 1, F.substring(doubled, i, F.lit(1)))
            .otherwise(F.substring(digits, i, F.lit(1)))
            .try_cast("int"),
            F.lit(0),
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def parts_fit(text: Column) -> Column:
    """Whether all dotted parts are at most 255."""

    def fits(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(text, r"\."), fits)


def _holds(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    return {
        "email": F.lit(True),
        "ip": parts_fit(match),
        "card": n.between(14, 19) & luhn(digits_of(match)),
        "phone": n.between(10, 15),
    }[kind]


def base_spans(text: Column, kind: str) -> Column:
    """Array of (s, e) of the base spans of a kind."""
    found = F.filter(matches(text, BASE[kind]), lambda x: _holds(kind, x["m"]))
    spans = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(text.rlike(_NEEDS[kind]), spans).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _sign_class(sign: Column) -> Column:
    """0 space or edge, 1 closing or ending sign, 2 other sign, 3 letter or digit."""
    return (
        F.when((sign == "") | sign.rlike(r"\s"), 0)
        .when(sign.rlike(r"[.,;:!?)(\]\[]"), 1)
        .when(sign.rlike(r"[\p{L}\p{N}]"), 3)
        .otherwise(2)
    )


def candidates(text: Column, kind: str) -> Column:
    """Array of candidates of a kind: (kind, s, e, features...)."""

    def features(x: Column) -> Column:
        match, n = x["m"], F.length(digits_of(x["m"]))
        start = F.greatest(x["s"] - CONTEXT, F.lit(0))
        before = F.substring(text, start + 1, x["s"] - start)
        after = F.substring(text, x["e"] + 1, F.lit(1))
        groups = F.size(F.split(match, "[^0-9A-Za-z@]+"))
        valid = {
            "email": match.rlike(r"(?i)(?:\.|dot\s?[)\]]\s?)[a-z]{2,24}$"), "ip": ~match.contains(".") | parts_fit(F.regexp_replace(match, "^.*:", "")),
            "card": luhn(digits_of(match)), "phone": n.between(10, 15),
        }[kind]
        values = {
            "digits": F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 16, 4).when(n < 17, 5).otherwise(6),
            "groups": F.least(groups, F.lit(6)),
            "paren": match.rlike(r"[()\[\]]").cast("int"),
            "dash": match.contains("-").cast("int"),
            "dot": match.contains(".").cast("int"),
            "space": match.contains(" ").cast("int"),
            "before": _sign_class(F.right(before, F.lit(1))),
            "after": _sign_class(after),
            "valid": valid.cast("int"),
            "said": F.when(before.rlike(_ANNOUNCE), 2).when(before.rlike(_OTHER), 0).otherwise(1),
        }
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), *[values[f].cast("int").alias(f) for f in FEATURES]
        )

    wide = F.concat(*[matches(text, pattern) for pattern in WIDE[kind]])
    return F.transform(F.array_distinct(wide), features)


def found(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: row, doc_id, base (kind number, s, e) and wide (candidates with features)."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *keep,
    )
    text = F.col("text")
    marked = rows.withColumn("marked", text.rlike(r"[0-9@]|::|(?i:[(\[]\s?at\s?[)\]])"))
    base = marked.withColumns(
        {kind: F.when(F.col("marked"), base_spans(text, kind)).otherwise(F.array().cast("array<struct<s:int,e:int>>")) for kind in KINDS}
    )
    kinds = [_numbered(F.col(kind), i) for i, kind in enumerate(KINDS)]
    wide = F.when(F.col("marked"), F.concat(*[candidates(text, kind) for kind in KINDS]))
    return base.select("row", "doc_id", *keep, F.concat(*kinds).alias("base"), wide.alias("wide"))


def _numbered(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def count_of(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == number)).cast("long")


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def cells(rows: DataFrame) -> DataFrame:
    """Counts of candidates per kind, feature vector, agreement with a base span, and half."""
    each = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), "base", F.explode("wide").alias("c"))
    kind = F.element_at(F.create_map(*itertools.chain(*[(F.lit(k), F.lit(i)) for i, k in enumerate(KINDS)])), F.col("c.kind"))
    agrees = F.exists("base", lambda b: (b["k"] == kind) & overlaps(b, F.col("c")))
    return each.groupBy(F.col("c.kind").alias("kind"), *[F.col(f"c.{f}").alias(f) for f in FEATURES], agrees.alias("agrees"), "half").agg(
        F.count("*").alias("n")
    )


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray, fit: Fit) -> list[tuple]:
    """Trees (feature, threshold, low, high) or leaves, fitted to counts per row of ``x``."""
    score, trees = np.zeros(len(x)), []

    def grow(rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        leaf = float(fit.rate * g / (h + fit.ridge))
        best = None
        for f in range(x.shape[1]) if depth else ():
            for at in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= at
                gl, hl = gradient[rows[low]].sum(), hessian[rows[low]].sum()
                gain = gl**2 / (hl + fit.ridge) + (g - gl) ** 2 / (h - hl + fit.ridge) - g**2 / (h + fit.ridge)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, int(at), low)
        if best is None:
            return leaf
        _, f, at, low = best
        return (f, at, grow(rows[low], gradient, hessian, depth - 1), grow(rows[~low], gradient, hessian, depth - 1))

    for _ in range(fit.rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(x)), yes * (1 - p) - no * p, (yes + no) * p * (1 - p), fit.depth)
        score = score + apply(tree, x)
        trees.append(tree)
    return trees


def apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, at, low, high = tree
    return np.where(x[:, f] <= at, apply(low, x), apply(high, x))


def expression(tree, of) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, at, low, high = tree
    return F.when(of(FEATURES[f]) <= at, expression(low, of)).otherwise(expression(high, of))


def train(counts: DataFrame, fit: Fit) -> dict[str, tuple[list, float]]:
    """Per kind its trees and its threshold; a kind without agreeing candidates in both halves is left out."""
    by_kind: dict[str, list] = {}
    for row in counts.collect():  # bounded by the number of feature vectors
        by_kind.setdefault(row["kind"], []).append(row)
    models = {}
    for kind in KINDS:
        rows = sorted(by_kind.get(kind, []), key=lambda r: tuple(r[f] for f in FEATURES) + (r["agrees"], r["half"]))
        vectors = sorted({tuple(r[f] for f in FEATURES) for r in rows})
        at = {v: i for i, v in enumerate(vectors)}
        count = np.zeros((2, 2, len(vectors)))
        for r in rows:
            count[r["half"], int(r["agrees"]), at[tuple(r[f] for f in FEATURES)]] += r["n"]
        if not (count[0, 1].any() and count[1, 1].any()):
            continue
        x = np.array(vectors)
        trees = boost(x, count[0, 1], count[0, 0], fit)
        score = sum(apply(t, x) for t in trees)
        order = np.argsort(-score, kind="stable")
        held_yes, held_all = np.cumsum(count[1, 1][order]), np.cumsum(count[1].sum(axis=0)[order])
        last_of_score = np.r_[np.diff(score[order]) < 0, True]
        good = last_of_score & (held_all > 0) & (held_yes >= fit.precision * held_all)
        if good.any():
            models[kind] = (trees, float(score[order][np.flatnonzero(good)[-1]]))
    return models


def added_spans(rows: DataFrame, models: dict[str, tuple[list, float]]) -> DataFrame:
    """The rows with ``added``: candidates above their thresholds that meet no base span, best first, without overlaps."""
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    if not models:
        return rows.withColumn("added", none)

    def scored(c: Column) -> Column:
        score = F.lit(None).cast("double")
        for kind, (trees, threshold) in models.items():
            total = sum((expression(t, lambda f: c[f]) for t in trees[1:]), expression(trees[0], lambda f: c[f]))
            score = F.when(c["kind"] == kind, total - threshold).otherwise(score)
        number = F.element_at(F.create_map(*itertools.chain(*[(F.lit(k), F.lit(i)) for i, k in enumerate(KINDS)])), c["kind"])
        return F.struct((-score).alias("loss"), (c["s"] - c["e"]).alias("short"), c["s"].alias("s"), c["e"].alias("e"), number.alias("k"))

    new = F.filter("wide", lambda c: ~F.exists("base", lambda b: overlaps(b, c)))
    above = F.sort_array(F.filter(F.transform(new, scored), lambda c: c["loss"] <= 1e-9))
    rows = rows.withColumn("above", above)
    chosen = F.aggregate(
        "above",
        none,
        lambda out, c: F.when(F.exists(out, lambda o: overlaps(o, c)), out).otherwise(
            F.array_append(out, F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
        ),
    )
    return rows.withColumn("added", F.coalesce(chosen, none)).drop("above")


def personal_spans(documents: DataFrame, fit: Fit | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, base, added) per document, spans as arrays of (kind number, start, end); ``keep`` names columns to carry."""
    rows = durable(found(documents, keep), "found")
    return added_spans(rows, train(cells(rows), fit or Fit())).drop("wide")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, by start, then kind, joined by commas."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(documents: DataFrame, fit: Fit | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one.

    All columns stay; ``n_chars``, where there is one, is counted anew.  A null text stays null.
    """
    slots = [f"_{i}" for i in range(len(documents.columns))]
    kept = documents.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(documents.columns, slots, strict=True)])
    at = {c.lower(): s for c, s in zip(documents.columns, slots, strict=True)}
    named = kept.withColumns({"doc_id": F.col(at["doc_id"]), "text": F.col(at["text"])})
    rows = personal_spans(named, fit, tuple(slots))
    text, order = F.coalesce(F.col(at["text"]).cast("string"), F.lit("")), F.sort_array(
        F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    )
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    rows = rows.withColumn("_order", order)
    cut = F.aggregate(
        "_order",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                x["e"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(tags, x["k"])).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size("_order") == 0, F.col(at["text"])).otherwise(cut)
    rows = rows.withColumn("_clean", clean)
    values = {at["text"]: F.col("_clean")} | ({at["n_chars"]: F.length("_clean").cast("long")} if "n_chars" in at else {})
    return rows.select(*[values.get(s, F.col(s)).alias(c) for c, s in zip(documents.columns, slots, strict=True)])


@query("op7_personal_data")
def op7_personal_data(spark, folder):
    """The four counts are those of the base spans."""
    rows = personal_spans(table(spark, folder, "documents"))
    counts = [count_of(F.col("base"), i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
