"""Chat formatting: one rendering of a dialogue for every participant, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "<|im_end|>"


def rotate_perspectives(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_role: str = "system",
) -> DataFrame:
    """A row for each dialogue and participant, with that participant as the assistant.

    conv_id, perspective, n_turns long, n_target_turns long, rendered string,
    turn_mask string (per turn ``1`` if it is trained on, else ``0``), loss_spans
    string (``start-end`` in code points of ``rendered``, comma separated): a target
    turn's span covers its text and end mark, never its header. Other participants are
    users named by their role; the system's turns stay the system's in every rendering.

    Turns order by turn (null last), then role and text, so ties and repeated rows
    come out alike on every run; repeated rows stay. Null or empty role: participant
    ``unknown``. Null text: empty. Marks that start with ``<|`` in a text are broken by
    a space, so that no text can open or close a turn. A dialogue of system turns only
    has no participant and so no row. Null conv_id: no dialogue is known, each
    distinct turn stands alone. Empty table: empty result; other columns are ignored.

    A dialogue is one value of the result, so it is gathered in one row and has to fit
    there; nothing else is gathered.
    """
    who = F.coalesce(F.nullif(F.col(role_col).cast("string"), F.lit("")), F.lit("unknown"))
    said = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))
    t = turns.select(
        F.col(conv_col).alias("conv"),
        F.when(F.col(conv_col).isNull(), F.xxhash64(turn_col, role_col, text_col)).otherwise(F.lit(0)).alias("alone"),
        F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), F.replace(who, F.lit("<|"), F.lit("< |")).alias("who"), said.alias("said")).alias("t"),
    )
    talk = t.groupBy("conv", "alone").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    seats = talk.select("conv", "ts", F.explode(F.array_sort(F.array_distinct(F.filter(F.transform("ts", lambda x: x["who"]), lambda w: w != system_role)))).alias("me"))

    def message(x):
        head = F.when(x["who"] == system_role, F.lit("system")).when(x["who"] == F.col("me"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), x["who"]))
        return F.struct(F.concat(F.lit("<|im_start|>"), head, F.lit("\n")).alias("head"), F.concat(x["said"], F.lit(END)).alias("body"), (x["who"] == F.col("me")).alias("mine"))

    rows = seats.select("conv", "me", F.transform("ts", message).alias("ms"))
    spans = F.aggregate(
        "ms",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["head"]) + F.length(m["body"]) + 1).alias("at"),
            F.when(
                m["mine"],
                F.concat(
                    acc["out"], F.when(acc["out"] == "", F.lit("")).otherwise(F.lit(",")),
                    (acc["at"] + F.length(m["head"])).cast("string"), F.lit("-"), (acc["at"] + F.length(m["head"]) + F.length(m["body"])).cast("string"),
                ),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return rows.select(
        F.col("conv").alias("conv_id"), F.col("me").alias("perspective"), F.size("ms").cast("long").alias("n_turns"),
        F.size(F.filter("ms", lambda m: m["mine"])).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.transform("ms", lambda m: F.when(m["mine"], F.lit("1")).otherwise(F.lit("0"))), "").alias("turn_mask"),
        spans.alias("loss_spans"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(CASE WHEN role IS NULL OR role = '' THEN 'unknown' ELSE role END, '<|', '< |') AS who,
         replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations
), seats AS (SELECT DISTINCT conv_id, who AS me FROM t WHERE who <> 'system'),
m AS (
  SELECT s.conv_id, s.me, t.who = s.me AS mine,
         row_number() OVER (PARTITION BY s.conv_id, s.me ORDER BY t.turn NULLS LAST, t.who, t.said) AS k,
         '<|im_start|>' || CASE WHEN t.who = 'system' THEN 'system' WHEN t.who = s.me THEN 'assistant' ELSE 'user name=' || t.who END || chr(10) AS head,
         t.said || '<|im_end|>' AS body
  FROM seats s JOIN t ON s.conv_id = t.conv_id
), p AS (
  SELECT *, length(head) AS nh, length(body) AS nb,
         coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, me ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM m
)
SELECT conv_id, me AS perspective, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_target_turns,
       string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
       string_agg(CASE WHEN mine THEN '1' ELSE '0' END, '' ORDER BY k) AS turn_mask,
       string_agg(CAST(CAST(begins + nh AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + nh + nb AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE mine) AS loss_spans
FROM p GROUP BY conv_id, me
"""
