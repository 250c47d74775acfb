"""Chat formatting by perspective rotation, in DataFrame functions only.

A dialogue is rendered once for every participant: that speaker's turns are the assistant's and
are learned from, all other speakers' are named users', system turns stay system turns. A
rendering is kept as its segments with their places, so that a conversation of any length never
meets in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a conversation whose places are added up in one group.
CHUNK = 1024
#: Speaker of turns without a role, and the role that is nobody's perspective.
NOBODY, SYSTEM = "unknown", "system"


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, segment, loss_mask, start, length) of (conv_id, turn, role, text).

    Segments of a rendering are gapless from 0, in order of turn, speaker and text; start and
    length are in characters; loss_mask is 1 for the perspective's own turns. A null role is the
    speaker "unknown", a null text is empty, a null conv_id is a conversation and a null turn
    comes first; rows that repeat are turns that repeat; a conversation of system turns alone has
    no perspective and no rows; other columns are ignored.
    """
    speaker = F.coalesce("role", F.lit(NOBODY))
    turns = conversations.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.where(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.lit(1).alias("_")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>")).otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>")))
    rendered = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "perspective", "turn", "speaker", F.concat(head, F.lit("\n"), F.col("text"), F.lit("<|end|>\n")).alias("segment"), own.cast("int").alias("loss_mask")
    ).withColumns({"length": F.length("segment").cast("long"), "_chunk": F.floor(F.col("turn") / CHUNK)})
    # Places: characters of earlier chunks, then of earlier turns of the chunk.
    key = ["conv_id", "perspective"]
    sums = rendered.groupBy(*key, "_chunk").agg(F.sum("length").alias("_n"))
    before = Window.partitionBy(*key).orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*key, "_chunk").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("_here", F.coalesce(F.sum("length").over(here), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & F.col("_chunk").eqNullSafe(F.col("_c"))
    return placed.join(sums, same).select(*key, "turn", "speaker", "segment", "loss_mask", (F.col("_before") + F.col("_here")).alias("start"), "length")


def op3_sql() -> str:
    """The same renderings in DuckDB."""
    return """
with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
r as (select t.conv_id, perspective, turn, speaker,
        case when speaker = perspective then '<|assistant|>' when speaker = 'system' then '<|system|>' else '<|user name=' || speaker || '|>' end || chr(10) || text || '<|end|>' || chr(10) as segment,
        cast(speaker = perspective as integer) as loss_mask
      from t join p on t.conv_id is not distinct from p.conv_id)
select conv_id, perspective, turn, speaker, segment, loss_mask,
       cast(coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, segment rows between unbounded preceding and 1 preceding), 0) as bigint) as start,
       cast(length(segment) as bigint) as length
from r
"""
