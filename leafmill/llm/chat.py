"""Perspective rotation: every dialogue once per participant, with that speaker as the assistant.

For each participant of a conversation the turns are rendered in order: the participant's own
turns as the assistant's, all other speakers' as those of named users, and the narrators' (by default
``system``) under their own role.  The result is one segment per turn and perspective with its place in the rendered
dialogue, so that a dialogue of any length is a run of rows, never one value; joined by
``position`` the segments give the whole text.  The loss mask of a perspective is the content
and the closing sign of the assistant's segments, as a range of code points.

Places are running sums.  Rows are dealt into ranges of (conversation, turn), so that a long conversation lies
in many ranges; sums run inside a range and start from the totals of the ranges before it.

Defined results: a null conversation is a conversation of its own; a null turn comes first; a null text is empty; a
null role is an unnamed user and no participant; turns with equal numbers are ordered by role, then
text; repeated rows are repeated turns.  A conversation without participants has no
perspective and no rows.  Signs that open a marker inside texts and names are split by a space.  Columns other than the four
named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import query, table

NARRATORS = ("system",)
_KEYS = ["conv", "turn", "role", "text"]


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """Segments (conv_id, speaker, position, turn, role, name, segment, start, end, mask_start, mask_end).

    ``start`` and ``end`` are code points in the rendered dialogue of the perspective, ends exclusive; the mask is null
    where nothing is trained on.
    """
    given = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = durable(given.repartitionByRange(*_KEYS).withColumn("part", F.spark_partition_id()), "turns")
    speakers = durable(
        ordered.filter(F.col("role").isNotNull() & ~F.col("role").isin(list(narrators)))
        .select("conv", F.col("role").alias("speaker"))
        .distinct(),
        "speakers",
    )
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    narrated = F.coalesce(F.col("role").isin(list(narrators)), F.lit(False))
    rows = ordered.join(speakers, "conv").select(
        *_KEYS,
        "conv_id",
        "part",
        "speaker",
        F.when(own, "assistant").when(narrated, F.col("role")).otherwise("user").alias("as"),
        F.when(~own & ~narrated, F.col("role")).alias("name"),
    )
    head = F.concat(
        F.lit("<|"), F.col("as"), F.coalesce(F.concat(F.lit(" name="), _safe(F.col("name"))), F.lit("")), F.lit("|>\n")
    )
    body = F.concat(_safe(F.col("text")), F.lit("<|end|>\n"))
    rows = rows.withColumn("head", head).withColumn("body", body)
    size = F.length("head") + F.length("body")
    run = Window.partitionBy("conv", "speaker", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"upto": F.sum(size).over(run), "number": F.count("*").over(run)})
    totals = rows.groupBy("conv", "speaker", "part").agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    # a row per range that a dialogue lies in
    before = Window.partitionBy("conv", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "conv", "speaker", "part",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
    )
    out = local.join(bases, ["conv", "speaker", "part"])
    end = F.col("base") + F.col("upto")
    trained = F.col("as") == "assistant"
    return out.select(
        "conv_id",
        "speaker",
        (F.col("base_n") + F.col("number") - 1).alias("position"),
        "turn",
        F.col("as").alias("role"),
        "name",
        F.concat("head", "body").alias("segment"),
        (end - F.length("head") - F.length("body")).alias("start"),
        end.alias("end"),
        F.when(trained, end - F.length("body")).alias("mask_start"),
        F.when(trained, end - 1).alias("mask_end"),
    )


OP4_SQL = r"""
WITH given AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM given WHERE role <> 'system'),
rendered AS (
  SELECT g.conv_id, s.speaker, g.turn, g.role AS own_role, g.text,
         CASE WHEN g.role = s.speaker THEN 'assistant' WHEN g.role = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN g.role <> s.speaker AND g.role <> 'system' THEN g.role END AS name
  FROM given g JOIN speakers s ON s.conv_id = g.conv_id),
parts AS (
  SELECT *, '<|' || role || coalesce(' name=' || replace(name, '<|', '< |'), '') || '|>' || chr(10) AS head,
         replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body FROM rendered),
sums AS (
  SELECT *, row_number() OVER w - 1 AS position, sum(length(head) + length(body)) OVER w AS upto FROM parts
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn, own_role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, position::BIGINT AS position, turn, role, name, head || body AS segment,
       (upto - length(head) - length(body))::BIGINT AS start, upto::BIGINT AS "end",
       CASE WHEN role = 'assistant' THEN (upto - length(body))::BIGINT END AS mask_start,
       CASE WHEN role = 'assistant' THEN (upto - 1)::BIGINT END AS mask_end
FROM sums
"""


@query("op4_perspective_rotation", OP4_SQL)
def op4_perspective_rotation(spark, folder):
    return perspectives(table(spark, folder, "conversations"))
