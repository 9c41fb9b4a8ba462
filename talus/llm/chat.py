"""Chat formatting by perspective rotation: each participant in turn is the assistant.

A dialogue of p participants gives p renderings. In each, the turns of one participant are the assistant's, and carry the
loss; the others are users with their names. Renderings are made turn by turn, so no dialogue is ever gathered in one row
or task: a turn's place in its rendering comes from sums over segments of SEGMENT turn numbers, which are summed first,
and then from running sums within a segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256
START, END = "<|im_start|>", "<|im_end|>\n"
#: What opens a control mark, and what stands for it in texts and names, so that neither can forge a turn.
OPEN, ESCAPED = "<|", "<\u200b|"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, rendered, start, end, mask_start and mask_end of each turn for each participant.

    start and end are code points in the whole rendering, in which turns follow by number, then speaker, then text.
    mask_start and mask_end bound what carries the loss (the assistant's text and its end mark); they are null in others'
    turns. In texts and names the two characters that open a control mark are held apart by a zero-width space, and line
    breaks in names become blanks, so that only the marks made here can be read as such. A null speaker is the participant 'unknown', a null text is empty, a null turn comes first; a null conversation
    is one of its own. Repeated turns stay, in the place that their order gives them. Other columns are ignored, and an
    empty table gives no rows.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(OPEN), F.lit(ESCAPED)).alias("text"))
    people = t.groupBy("conv_id", "speaker").agg(F.lit(1).alias("_")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    name = F.replace(F.translate("speaker", "\r\n", "  "), F.lit(OPEN), F.lit(ESCAPED))
    head = F.concat(F.lit(START), F.when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))
    r = t.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "perspective", "turn", "speaker", "text", head.alias("head"), own.alias("own"), F.floor(F.coalesce("turn", F.lit(-1)) / SEGMENT).alias("segment"))
    r = r.withColumn("rendered", F.concat("head", "text", F.lit(END))).withColumn("size", F.char_length("rendered").cast("long"))
    sums = r.groupBy("conv_id", "perspective", "segment").agg(F.sum("size").alias("all"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("segment").alias("_s"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    r = r.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("segment") == F.col("_s")))
    inner = Window.partitionBy("conv_id", "perspective", "segment").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("size").over(inner)
    r = r.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    mask = F.when(F.col("own"), F.col("start") + F.char_length("head"))
    return r.select("conv_id", "perspective", "turn", "speaker", "rendered", "start", "end", mask.alias("mask_start"), F.when(F.col("own"), F.col("end")).alias("mask_end"))


def oracle_sql(table: str = "conversations") -> str:
    """rotate() over a table in DuckDB's SQL, its texts as digests."""
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '{OPEN}', '{ESCAPED}') AS text FROM {table}),
    people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
    r AS (SELECT t.conv_id, perspective, turn, speaker, text, speaker = perspective AS own, '{START}' || CASE WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(translate(speaker, chr(13) || chr(10), '  '), '{OPEN}', '{ESCAPED}') END || chr(10) AS head
          FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id),
    q AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM r),
    s AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM q)
    SELECT conv_id, perspective, turn, speaker, sha256(rendered) AS rendered_sha256, e - length(rendered) AS "start", e AS "end", CASE WHEN own THEN e - length(rendered) + length(head) END AS mask_start, CASE WHEN own THEN e END AS mask_end FROM s
    """
