import math
import random

from pyspark.sql import functions as F

from meshwright.llm import chat, topk


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 3)
    monkeypatch.setattr(topk, "SEEDS", 7)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + i % 5) for _ in range(6)]) for i in range(150)] + [(160, [1.0]), (161, rows_0 := [2.0] * 6), (162, rows_0)]
    bad = [(200, None), (201, [1.0, None, 2.0]), (250, [math.nan] * 6), (251, [math.inf] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    import numpy as np

    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q))[:4]
        want |= {(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)}
    got = topk.exact_top_k(df, every=20, k=4, head=2)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == want
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_top_k_query(same_rows):
    same_rows("op5_topk")


def test_pairs(spark):
    turns = "array<struct<role:string,text:string>>"
    rows = [
        (1, [("user", "hi"), ("assistant", "a")], [("user", "hi"), ("assistant", "b"), ("user", "x")]),
        (2, [("user", "hi")], [("user", "hi")]),
        (3, [(None, None)], [(None, None), ("assistant", None)]),
        (4, [], []),
    ]
    got = {r.k: r for r in chat.preference_format(spark.createDataFrame(rows, f"k int, chosen {turns}, rejected {turns}")).collect()}
    r = got[1]
    assert r.prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert r.chosen_completion == "<|im_start|>assistant\na<|im_end|>\n" and not r.identical
    assert [r.chosen_completion[s.begin : s.end] for s in r.chosen_spans] == ["a<|im_end|>\n"]
    assert [r.rejected_completion[s.begin : s.end] for s in r.rejected_spans] == ["b<|im_end|>\n"]
    assert got[2].identical and got[2].chosen_completion == "" and got[2].chosen_spans == []
    assert got[3].prompt_turns == 1 and got[3].rejected_completion == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[4].identical and got[4].prompt == ""


def test_swapped(spark):
    rows = [(1, 1, "assistant", "A1"), (1, 0, "user", "u"), (1, 2, "user", "later"), (2, 0, "user", "no answer"), (5, 0, "assistant", "A5"), (7, 0, "user", "q"), (7, 1, "assistant", "A7"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.swapped_answers(df).collect()}
    assert set(got) == {1, 5, 7} and [got[k].rejected_conv_id for k in (1, 5, 7)] == [5, 7, 1]
    assert [t.text for t in got[1].chosen] == ["u", "A1"] and [t.text for t in got[1].rejected] == ["u", "A5"]
    assert chat.swapped_answers(df.limit(0)).count() == 0


def test_every_answered_conversation_has_a_pair(spark, data):
    from meshwright.llm.queries import op6_preference_chat

    own = spark.read.parquet(f"{data}/conversations.parquet")
    made = op6_preference_chat(spark, data)
    assert made.count() == own.where("role = 'assistant'").select("conv_id").distinct().count()
    assert made.where(F.col("identical")).count() == 0


def test_chat_query_equals_brute_force(spark, data):
    from meshwright.llm.queries import op6_preference_chat

    talks = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    own = {}
    for k, turns in talks.items():
        turns = [(role, text) for _, role, text in sorted(turns, key=lambda t: (t[0], t[1] or "", t[2] or ""))]
        answers = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        if answers:
            own[k] = turns[: answers[-1] + 1]
    ids = sorted(own)
    show = lambda turns: "".join(f"<|im_start|>{a or 'unknown'}\n{b or ''}<|im_end|>\n" for a, b in turns)
    want = {}
    for k, i in enumerate(ids):
        other = ids[(k + 1) % len(ids)]
        a, b = own[i], own[i][:-1] + [own[other][-1]]
        n = next((j for j in range(len(a)) if a[j] != b[j]), len(a))
        want[i] = (other, n, a == b, show(a[:n]), show(a[n:]), show(b[n:]))
    got = op6_preference_chat(spark, data).collect()
    assert {r.conv_id: (r.rejected_conv_id, r.prompt_turns, r.identical, r.prompt, r.chosen_completion, r.rejected_completion) for r in got} == want
    for r in got:
        for text, spans in ((r.chosen_completion, r.chosen_spans), (r.rejected_completion, r.rejected_spans)):
            assert [text[s.begin : s.end] for s in spans] == [x.split("\n", 1)[1] for x in text.split("<|im_start|>") if x.startswith("assistant\n")]


def test_clashing_names_and_long_texts(spark):
    turns = "array<struct<role:string,text:string>>"
    long = "x" * 2_000_000
    df = spark.createDataFrame([(7, [("user", long), ("assistant", "a")], [("user", long), ("assistant", long)], "mine")], f"prompt int, identical {turns}, rejected {turns}, chosen_spans string")
    r = chat.preference_format(df, chosen="identical").first()
    assert (r.input_prompt, r.input_chosen_spans, r.prompt_turns, r.identical) == (7, "mine", 1, False)
    assert r.rejected_completion == f"<|im_start|>assistant\n{long}<|im_end|>\n" and len(r.input_identical) == 2


def test_top_k_with_repeated_ids_and_other_columns(spark):
    rows = [(0, [1.0, 0.0], 1, "a"), (0, [0.0, 2.0], 2, "b"), (1, [3.0, 1.0], 3, "c"), (2, [3.0, 1.0], 4, "d"), (3, [3.0, 1.0], 5, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, every=50, k=2).collect())
    # ties go to the smaller id; both rows of id 0 are queries, and neither is the other's candidate
    assert {g for g in got if g[3] == 3 * 256 * 256} == {(0, 1, 1, 196608), (0, 2, 2, 196608)}
    assert all(g[2] != 0 for g in got)
