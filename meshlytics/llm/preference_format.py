"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The turns of both sides of a pair are set side by side; their longest common prefix of turns (role and text, nulls
equal) is rendered once as the prompt, the rest of each side as its completion. Each completion has a mask: runs
``length:flag`` in code points, comma-joined, that cover it; 1 marks what is learnt, the texts and end marks of the
assistant's turns.

Defined results: turns are taken by number, then role, then text; a repeated row is one more turn; a null text or
role is rendered as empty; turns of no conversation (null id) are passed over; equal sides have empty completions; turns
that tie in all three come in any order, which makes no difference; very long texts are ordinary; an empty table gives no
rows; other columns of pairs stay, but for those named like the results. A conversation is one row, so the turns that
share an id must fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read_table, without

BEGIN, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"


def turns_of(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv`` and ``turns``, an array of (role, text) in order."""
    turn = F.struct("turn", "role", "text")
    rows = conversations.where(F.col(conv).isNotNull()).groupBy(conv).agg(F.sort_array(F.collect_list(turn)).alias("_t"))
    return rows.select(conv, F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    one = lambda x: F.concat(
        F.lit(BEGIN), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(END + "\n")
    )
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    def runs(x):
        head = F.length(F.coalesce(x["role"], F.lit(""))) + len(BEGIN) + 1
        body = F.length(F.coalesce(x["text"], F.lit(""))) + len(END)
        learnt = F.concat(head.cast("string"), F.lit(":0,"), body.cast("string"), F.lit(":1,1:0"))
        return F.when(F.coalesce(x["role"] == LEARNT, F.lit(False)), learnt).otherwise(
            F.concat((head + body + 1).cast("string"), F.lit(":0"))
        )

    return F.array_join(F.transform(turns, runs), ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with its two arrays of turns replaced by ``n_prompt_turns`` long, ``prompt``, ``chosen``, ``chosen_mask``,
    ``rejected`` and ``rejected_mask``. A null array is a conversation without turns."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    names = without(pairs, "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask", chosen, rejected)
    left, right = free_names(pairs.columns, "_a", "_b")
    rows = pairs.select(*names, F.coalesce(chosen, none).alias(left), F.coalesce(rejected, none).alias(right))
    shared = F.least(F.size(left), F.size(right))
    same = F.zip_with(left, right, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    at = F.array_position(same, False)
    # Where one side is longer, its rest is beside nulls; the prefix can't go on past the shorter side.
    rows = rows.withColumn("n_prompt_turns", F.least(F.when(at == 0, shared).otherwise(at - 1), shared).cast("long"))
    n = F.col("n_prompt_turns").cast("int")
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    out = {
        "prompt": _render(F.slice(F.col(left), F.lit(1), n)), "chosen": _render(rest(left)), "chosen_mask": _mask(rest(left)),
        "rejected": _render(rest(right)), "rejected_mask": _mask(rest(right))
    }
    return rows.withColumns(out).drop(left, right)


def stale_pairs(turns: DataFrame) -> DataFrame:
    """A pair of each conversation: as it is, and with its last assistant text replaced by the one before, or left out if
    there is none before. Turns that follow stay on both sides."""
    is_reply = lambda x: F.coalesce(x["role"] == LEARNT, F.lit(False))
    places = F.filter(F.transform("turns", lambda x, k: F.when(is_reply(x), k)), lambda k: k.isNotNull())
    rows = turns.withColumn("_p", places).withColumns(
        {"_last": F.try_element_at("_p", F.lit(-1)), "_prev": F.try_element_at("_p", F.lit(-2))}
    )
    stale = lambda x, k: F.when(
        (k == F.col("_last")) & F.col("_prev").isNotNull(),
        F.struct(x["role"].alias("role"), F.get("turns", F.col("_prev"))["text"].alias("text"))
    ).when(k == F.col("_last"), F.lit(None)).otherwise(x)
    worse = F.filter(F.transform("turns", stale), lambda x: x.isNotNull())
    return rows.select("conv_id", F.col("turns").alias("chosen"), worse.alias("rejected"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of each conversation: conv_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    return format_pairs(stale_pairs(turns_of(read_table(spark, sf_dir, "conversations"))))


def _sql_side(table: str, name: str) -> str:
    text = f"string_agg('{BEGIN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY k)"
    runs = f"""string_agg(CASE WHEN role = '{LEARNT}' THEN CAST(length(role) + {len(BEGIN) + 1} AS VARCHAR) || ':0,' || CAST(length(coalesce(text, '')) + {len(END)} AS VARCHAR) || ':1,1:0'
      ELSE CAST(length(coalesce(role, '')) + length(coalesce(text, '')) + {len(BEGIN) + len(END) + 2} AS VARCHAR) || ':0' END, ',' ORDER BY k)"""
    return f"""{name} AS (SELECT c.conv_id, coalesce({text} FILTER (k > n), '') AS t, coalesce({runs} FILTER (k > n), '') AS m, coalesce({text} FILTER (k <= n), '') AS p
  FROM {table} c JOIN common USING (conv_id) GROUP BY 1)"""


QUERIES = {"op7_preference_format": op7_preference_format}
ORACLES = {
    "op7_preference_format": f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), replies AS (SELECT conv_id, k, text, lag(k) OVER w AS before, lag(text) OVER w AS old, lead(k) OVER w AS later FROM t WHERE role = '{LEARNT}' WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
r0 AS (
  SELECT t.conv_id, t.role, CASE WHEN r.k IS NOT NULL THEN r.old ELSE t.text END AS text, t.k
  FROM t LEFT JOIN replies r ON t.conv_id = r.conv_id AND t.k = r.k AND r.later IS NULL WHERE r.k IS NULL OR r.before IS NOT NULL
), r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS k FROM r0),
sizes AS (SELECT conv_id, count(*) AS a FROM t GROUP BY 1),
diff AS (
  SELECT t.conv_id, min(t.k) AS k FROM t LEFT JOIN r ON t.conv_id = r.conv_id AND t.k = r.k
  WHERE r.k IS NULL OR t.role IS DISTINCT FROM r.role OR t.text IS DISTINCT FROM r.text GROUP BY 1
), common AS (SELECT conv_id, coalesce(diff.k - 1, a) AS n FROM sizes LEFT JOIN diff USING (conv_id)),
{_sql_side("t", "c")}, {_sql_side("r", "j")}
SELECT conv_id, n AS n_prompt_turns, c.p AS prompt, c.t AS chosen, c.m AS chosen_mask, coalesce(j.t, '') AS rejected, coalesce(j.m, '') AS rejected_mask
FROM common JOIN c USING (conv_id) LEFT JOIN j USING (conv_id)
"""
}
