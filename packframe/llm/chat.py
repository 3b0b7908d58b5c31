"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns (role and text alike) is rendered once, as the prompt; what follows is
rendered as two completions.  Each completion carries a mask: the character
ranges ``begin:end,...`` to train on, which are the assistant's texts with their
end marks; role headers and other roles' turns are context.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n``.  The marks' strings inside a
text are broken up by a zero-width space after ``<``, so that no text can close
its own turn.

Null roles and texts render as empty and compare as equal to empty; null or
empty conversations have no turns.  If one conversation is a prefix of the other
or both are equal, the shorter's completion is empty.  Turns that repeat a turn
number are ordered by role, then text.  Null conversation ids are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import ref

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


def safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<​|im_"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), safe(turn["role"]), F.lit("\n"), safe(turn["text"]), F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def same(a: Column, b: Column) -> Column:
    return (F.coalesce(a["role"], F.lit("")) == F.coalesce(b["role"], F.lit(""))) & (F.coalesce(a["text"], F.lit("")) == F.coalesce(b["text"], F.lit("")))


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix: the place before the first turn that differs."""
    most = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | ~F.coalesce(same(F.get(a, i), F.get(b, i)), F.lit(False)))
    return F.element_at(differ, 1)


def mask(turns: Column) -> Column:
    """begin:end of the parts of the rendered turns to train on."""
    state = "struct<at:int,out:array<string>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(held: Column, turn: Column) -> Column:
        head = held["at"] + F.length(safe(turn["role"])) + F.lit(len(START) + 1)
        end = head + F.length(safe(turn["text"])) + F.lit(len(END))
        span = F.concat(head.cast("string"), F.lit(":"), end.cast("string"))
        out = F.when(turn["role"] == "assistant", F.concat(held["out"], F.array(span))).otherwise(held["out"])
        return F.struct((end + 1).alias("at"), out.alias("out")).cast(state)

    return F.aggregate(turns, first, step, lambda held: F.array_join(held["out"], ","))


def preferences(pairs: DataFrame, pair_id: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask) of pairs of arrays of (role, text)."""
    none = F.array().cast(TURN)
    sides = pairs.select(ref(pairs, pair_id).alias("pair_id"), *[F.coalesce(ref(pairs, c).cast(TURN), none).alias(a) for c, a in ((chosen, "a"), (rejected, "b"))])
    cut = sides.withColumn("k", common_turns(F.col("a"), F.col("b")))
    rest = cut.select("pair_id", "k", F.slice("a", 1, F.col("k")).alias("p"), *[F.slice(c, F.col("k") + 1, F.greatest(F.lit(0), F.size(c) - F.col("k"))).alias(c) for c in ("a", "b")])
    return rest.select(
        "pair_id", F.col("k").cast("int").alias("prompt_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"), mask(F.col("a")).alias("chosen_mask"), render(F.col("b")).alias("rejected"), mask(F.col("b")).alias("rejected_mask"),
    )


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) of a table of turns."""
    row = F.struct(ref(turns, turn).alias("turn"), ref(turns, role).alias("role"), ref(turns, text).alias("text"))
    named = turns.select(ref(turns, conv_id).alias("conv_id"), row.alias("x")).filter("conv_id IS NOT NULL")
    grouped = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select("conv_id", F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) of every conversation with an assistant's turn.

    A table of plain conversations has no rejected answers; the rejected
    conversation is the chosen one with its last assistant's answer replaced by
    that of its neighbour (the id with the last bit flipped), or by an empty
    answer if that has none.  Turns after the last answer are cut.
    """
    convs = conversations(turns)
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    ended = convs.withColumn("k", at).filter("k IS NOT NULL").select("conv_id", F.slice("turns", 1, F.col("k")).alias("chosen"), F.slice("turns", 1, F.col("k") - 1).alias("before"), F.get("turns", F.col("k") - 1)["text"].alias("answer"))
    other = ended.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    joined = ended.join(other, "conv_id", "left")
    last = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text")))
    return joined.select(F.col("conv_id").alias("pair_id"), "chosen", F.concat("before", last).alias("rejected"))


def _sql_render(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '{START}' || t.role || chr(10) || t.text || '{END}' || chr(10)), ''), '')"


def _sql_mask(turns: str) -> str:
    lead = f"list_sum([0] || list_transform({turns}[:i - 1], lambda u: length(u.role) + length(u.text) + {len(START) + len(END) + 2}))::INT"
    return (
        f"array_to_string(list_filter(list_transform(range(1, len({turns}) + 1), lambda i: CASE WHEN {turns}[i].role = 'assistant' THEN "
        f"({lead} + length({turns}[i].role) + {len(START) + 1})::VARCHAR || ':' || ({lead} + length({turns}[i].role) + length({turns}[i].text) + {len(START) + 1 + len(END)})::VARCHAR END), lambda x: x IS NOT NULL), ',')"
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, ''), '<|im_', '<' || chr(8203) || '|im_') AS role, replace(coalesce(text, ''), '<|im_', '<' || chr(8203) || '|im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
k AS (SELECT conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant'))::INT AS k FROM c),
e AS (SELECT conv_id, turns[:k] AS a, turns[:k - 1] AS head, turns[k].text AS answer FROM k WHERE k IS NOT NULL),
p AS (SELECT e.conv_id AS pair_id, e.a, list_concat(e.head, [{{'role': 'assistant', 'text': coalesce(o.answer, '')}}]) AS b FROM e LEFT JOIN e AS o ON xor(e.conv_id, 1) = o.conv_id),
n AS (SELECT *, list_min(list_filter(range(0, least(len(a), len(b)) + 1), lambda i: i = least(len(a), len(b)) OR a[i + 1] IS DISTINCT FROM b[i + 1]))::INT AS n FROM p),
r AS (SELECT pair_id, n, a[:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM n)
SELECT pair_id, n AS prompt_turns, {_sql_render('p')} AS prompt, {_sql_render('a')} AS chosen, coalesce({_sql_mask('a')}, '') AS chosen_mask,
  {_sql_render('b')} AS rejected, coalesce({_sql_mask('b')}, '') AS rejected_mask FROM r
"""
