"""Preference formatting: one prompt and a pair of masked completions from two conversations.

The prompt is the longest common prefix of turns (same role and text) of the chosen and the rejected
conversation, rendered once. What follows in each is its completion, whose mask names the characters to
learn from: the texts of assistant turns with their end marks; role headers and other turns are masked.
If the conversations are the same throughout, both completions are empty and `identical` is true.

Defined cases: turns count in the order of their number, ties by role and text; a null text is empty, a
null role renders as `unknown` and is never learnt from; two nulls are the same role. Turns without a
conversation id are left out. A conversation without an assistant turn has nothing to prefer and gives no
row. Rows that repeat a turn are turns like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.common import cut, numbered, stored

START, END = "<|im_start|>", "<|im_end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def learn_spans(turns: Column) -> Column:
    """(begin, end) in characters of the rendered turns, of every assistant turn's text and end mark."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_header(t))
        end = begin + F.length(_body(t))
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        learnt = F.coalesce(t["role"] == "assistant", F.lit(False))
        return F.struct(end.alias("at"), F.when(learnt, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from the start on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x.eqNullSafe(y), F.lit(False)))
    first = F.array_position(same, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`pairs` with prompt_turns, identical, prompt, and both completions with their learn spans.

    chosen, rejected: arrays of (role, text). Columns of `pairs` with one of these names go on as input_<name>.
    """
    made = ["prompt_turns", "identical", "prompt", "chosen_completion", "rejected_completion", "chosen_spans", "rejected_spans"]
    pairs = pairs.withColumnsRenamed({c: f"input_{c}" for c in pairs.columns if c in made})
    a, b = (F.col(f"input_{c}" if c in made else c) for c in (chosen, rejected))
    shared = pairs.withColumn("prompt_turns", common_turns(a, b))
    n = F.col("prompt_turns")
    rest_a, rest_b = (F.slice(x, n + 1, F.size(x)) for x in (a, b))
    return shared.withColumns(
        {
            "identical": (n == F.size(a)) & (n == F.size(b)),
            "prompt": render(F.slice(a, 1, n)),
            "chosen_completion": render(rest_a),
            "rejected_completion": render(rest_b),
            "chosen_spans": learn_spans(rest_a),
            "rejected_spans": learn_spans(rest_b),
        }
    )


def conversation_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (role, text) in order)."""
    item = F.struct("turn", "role", "text")
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def swapped_answers(turns: DataFrame) -> DataFrame:
    """(conv_id, rejected_conv_id, chosen, rejected): each conversation up to its last assistant turn, against
    the same with the last assistant turn of the next conversation by id, the first after the last.

    The neighbour comes by an equi-join of consecutive numbers, so no turn or conversation that many rows
    share gathers them in one task.
    """
    is_answer = lambda t: F.coalesce(t["role"] == "assistant", F.lit(False))
    flags = F.transform("turns", is_answer)
    last = (F.size("turns") - F.array_position(F.reverse(flags), True) + 1).cast("int")
    own = stored(conversation_arrays(turns).where(F.exists("turns", is_answer)).select("conv_id", F.slice("turns", 1, last).alias("chosen")))
    # ids alone are numbered; the texts follow by joins
    ids = cut(numbered(own.select("conv_id"), [F.col("conv_id")], "place"))
    count = ids.count()
    after = ids.select(F.pmod(F.col("place") - 1, F.lit(max(count, 1))).alias("place"), F.col("conv_id").alias("rejected_conv_id"))
    pairs = ids.join(after, "place").drop("place")
    answers = own.select(F.col("conv_id").alias("rejected_conv_id"), F.element_at("chosen", -1).alias("other"))
    met = own.join(pairs.join(answers, "rejected_conv_id"), "conv_id")
    head = F.slice("chosen", 1, F.size("chosen") - 1)
    return met.select("conv_id", "rejected_conv_id", "chosen", F.concat(head, F.array("other")).alias("rejected"))
