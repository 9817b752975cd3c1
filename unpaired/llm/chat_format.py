"""Preference formatting with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered
once as the prompt; what is left of each becomes its completion, with the spans of
characters that a loss should see (assistant texts and their end mark).

Turns are ordered by turn number, ties by role and text. Turns are equal if role and
text are (nulls equal nulls). Defined results: a null role or text is rendered empty;
a pair with one side only has an empty prompt and a null completion for the other;
repeated rows are repeated turns; an empty table gives no pairs; other columns aren't
carried. The rows of one pair meet in one task, as they become one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import keep

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _empty(turn["role"]), F.lit("\n"), _empty(turn["text"]), F.lit(CLOSE + "\n"))


def _spans(turns: Column) -> Column:
    """Spans of trained characters in the rendering of ``turns``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = F.length(F.concat(F.lit(OPEN), _empty(turn["role"]), F.lit("\n")))
        body = F.length(_empty(turn["text"])) + len(CLOSE)
        begin = state["at"] + head
        span = F.array(F.struct(begin.alias("start"), (begin + body).alias("end")))
        trained = turn["role"].eqNullSafe(F.lit("assistant"))
        return F.struct((begin + body + 1).alias("at"), F.when(trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(turns: DataFrame, pair: str = "pair_id", chosen: str = "is_chosen", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair: prompt, completions and their trained spans."""
    own = turns.select(F.col(pair).alias("_pair"), F.col(chosen).alias("_chosen"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("_turn"))
    side = lambda wanted: F.array_sort(F.collect_list(F.when(F.col("_chosen") == wanted, F.col("_turn"))))
    return format_pairs(own.groupBy("_pair").agg(side(True).alias("_a"), side(False).alias("_b")), pair)


def format_pairs(both: DataFrame, pair: str = "pair_id") -> DataFrame:
    """:func:`format_preferences` of ``_pair`` and the ordered turns of both sides, ``_a`` (chosen) and ``_b`` (rejected)."""
    least = F.least(F.size("_a"), F.size("_b"))
    places = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
    a, b = (lambda i: F.col("_a")[i]), (lambda i: F.col("_b")[i])
    differs = F.filter(places, lambda i: ~(a(i)["role"].eqNullSafe(b(i)["role"]) & a(i)["text"].eqNullSafe(b(i)["text"])))
    both = both.withColumn("_n", F.coalesce(F.array_min(differs), least))
    rest = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    both = both.withColumn("_ra", rest("_a")).withColumn("_rb", rest("_b"))
    text_of = lambda c: F.array_join(F.transform(c, _render), "")
    completion = lambda side, left: F.when(F.size(side) > 0, text_of(left))
    return both.select(
        F.col("_pair").alias(pair),
        F.col("_n").alias("prompt_turns"),
        text_of(F.slice("_a", F.lit(1), F.col("_n"))).alias("prompt"),
        completion("_a", "_ra").alias("chosen"),
        completion("_b", "_rb").alias("rejected"),
        _spans(F.col("_ra")).alias("chosen_spans"),
        _spans(F.col("_rb")).alias("rejected_spans"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: ``_pair``, its turns ``_a``, and ``_b``: those before its last reply and another's last reply.

    The other reply is that of the conversation with the neighbouring id (2k and 2k + 1
    lend theirs to each other). Without an assistant's turn in both there is no ``_b``.
    """
    known = conversations.where("conv_id is not null")
    turns = known.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_a"))
    is_reply = lambda t: t["role"].eqNullSafe(F.lit("assistant"))
    places = F.filter(F.sequence(F.lit(1), F.size("_a")), lambda i: is_reply(F.col("_a")[i - 1]))
    own = keep(turns.withColumn("_last", F.array_max(places)), "conversations")
    other = own.where("_last is not null").select(F.col("conv_id").alias("_lender"), F.col("_a")[F.col("_last") - 1].alias("_reply"))
    neighbour = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1)
    both = own.join(other, neighbour == F.col("_lender"), "left")
    swapped = F.concat(F.slice("_a", F.lit(1), F.col("_last") - 1), F.array("_reply"))
    none = F.slice("_a", F.lit(1), F.lit(0))
    return both.select(F.col("conv_id").alias("_pair"), "_a", F.when(F.col("_last").isNotNull() & F.col("_lender").isNotNull(), swapped).otherwise(none).alias("_b"))


def conversation_preferences(conversations: DataFrame) -> DataFrame:
    """The op4 rows: spans as text ``start-end``, comma-joined."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return format_pairs(conversation_pairs(conversations)).select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", shown("chosen_spans"), shown("rejected_spans"))


ORACLE = """
WITH c AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(i) AS i FROM c WHERE role = 'assistant' GROUP BY conv_id),
p2 AS (SELECT l.conv_id, l.i AS last, c.text FROM l JOIN l o ON o.conv_id = CASE WHEN ((l.conv_id % 2) + 2) % 2 = 0 THEN l.conv_id + 1 ELSE l.conv_id - 1 END JOIN c ON c.conv_id = o.conv_id AND c.i = o.i),
every AS (
  SELECT conv_id AS pair_id, TRUE AS is_chosen, role, text, i FROM c
  UNION ALL SELECT c.conv_id, FALSE, c.role, c.text, c.i FROM c JOIN p2 ON p2.conv_id = c.conv_id AND c.i < last
  UNION ALL SELECT conv_id, FALSE, 'assistant', text, last FROM p2),
t AS (SELECT pair_id, is_chosen, coalesce(role, '') AS r, coalesce(text, '') AS x, role, text, i FROM every),
sides AS (SELECT pair_id, count(*) FILTER (WHERE is_chosen) AS na, count(*) FILTER (WHERE NOT is_chosen) AS nb FROM t GROUP BY pair_id),
apart AS (
  SELECT a.pair_id, min(a.i) AS i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.is_chosen AND NOT b.is_chosen
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
n AS (SELECT s.pair_id, na, nb, CAST(coalesce(apart.i, least(na, nb)) AS INTEGER) AS prompt_turns FROM sides s LEFT JOIN apart USING (pair_id)),
r AS (
  SELECT t.pair_id, is_chosen, i, i < prompt_turns AS shared, role, '<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10) AS shown,
         length('<|im_start|>' || r || chr(10)) AS head, length(x) + 10 AS body
  FROM t JOIN n USING (pair_id)),
p AS (SELECT *, coalesce(sum(head + body + 1) OVER (PARTITION BY pair_id, is_chosen, shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS begins FROM r)
SELECT n.pair_id, n.prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE shared AND is_chosen), '') AS prompt,
  CASE WHEN na > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT shared AND is_chosen), '') END AS chosen,
  CASE WHEN nb > 0 THEN coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT shared AND NOT is_chosen), '') END AS rejected,
  coalesce(string_agg(CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + body AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE NOT shared AND is_chosen AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + body AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE NOT shared AND NOT is_chosen AND role = 'assistant'), '') AS rejected_spans
FROM n LEFT JOIN p USING (pair_id) GROUP BY n.pair_id, n.prompt_turns, na, nb
"""
