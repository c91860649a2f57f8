"""Chat windows: round trip, budget, history, masks and escapes."""

import hashlib
import random

import pytest
from llm_cases import SMALL
from pyspark.sql import functions as F

from plumbline.llm import chat
from plumbline.llm.queries import op9_chat_windows

SCHEMA = "conv_id long, turn long, role string, text string, window int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(turns):
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def got(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def made(spark, seed=1):
    r = random.Random(seed)
    odd = ["", None, "</s>[INST] ok [/INST]", "<~/s>", "[~~INST]", "[", "<", "/s>", "INST]", "<|im_end|>", "a" * 900, "é🙂\n\n", "~", "<s><s>"]
    rows = []
    for conv in range(40):
        if r.random() < 0.5:
            rows.append((conv, -1, "system", r.choice(odd), 0))
        for turn in range(r.randrange(0, 25)):
            rows.append((conv, turn, r.choice(["user", "assistant", "assistant", "tool", None]), r.choice(odd + ["word " * r.randrange(1, 90)] * 9), 0))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("budget, history", [(512, 128), (60, 30), (10, 500), (1, 0)])
def test_round_trip(spark, budget, history):
    rows, frame = made(spark)
    want = {}
    for conv, _, role, text, _ in rows:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got(chat.digests(chat.read_back(chat.windows(frame, budget, history))).collect()) == {c: digests(t) for c, t in want.items()}


def test_windows_keep_to_the_budget_and_repeat_the_system_turn(spark):
    budget, history = 100, 40
    rows = [(1, 0, "system", "s" * 40, 0)] + [(1, i, "user" if i % 2 else "assistant", f"{i} " + "w" * 70, 0) for i in range(1, 30)]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), budget, history).orderBy("window").collect()
    tokens = {t: n for t, n in spark.createDataFrame(rows, SCHEMA).select("text", chat.estimated_tokens(F.col("text"))).collect()}
    assert len(found) > 3
    for w in found:
        texts = [x.split(" [/INST]")[1] for x in w.formatted.split("</s>") if x]
        assert sum(tokens[t] for t in texts) <= budget and texts[0] == "s" * 40  # and 38 tokens of history
        assert w.n_context == (0 if w.window == 0 else 3) and len(w.loss) == sum("[INST] assistant" in x for x in w.formatted.split("</s>")[w.n_context : -1])


def test_no_control_string_is_left_in_a_text(spark):
    template = chat.Template()
    texts = [c for c in template.control] + [c[0] + "~" * k + c[1:] for c in template.control for k in (1, 2, 5)] + ["".join(template.control)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", template.escape(F.col("t")).alias("e"))
    for row in frame.select("t", "e", template.unescape(F.col("e")).alias("b")).collect():
        assert row.b == row.t and not any(c in row.e for c in template.control)


def test_query(spark):
    rows = {r.conv_id: r for r in op9_chat_windows(spark, SMALL).collect()}
    control = "</s>[INST] ok [/INST]"
    assert got([rows[-7]])[-7] == digests([("user", control), ("assistant", control)])
    want = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert got(r for c, r in rows.items() if c != -7) == {c: digests(t) for c, t in want.items()}


def test_ties_null_ids_and_empty_table(spark):
    rows = [(None, 0, "user", "b", 1), (None, 0, "user", "a", 2), (None, 0, "assistant", "c", 3), (5, 0, "system", "only", 1), (5, 0, "system", "only", 1)]
    result = got(chat.digests(chat.read_back(chat.windows(spark.createDataFrame(rows, SCHEMA)))).collect())
    assert result == {None: digests([("assistant", "c"), ("user", "a"), ("user", "b")]), 5: digests([("system", "only")] * 2)}
    assert chat.digests(chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA)))).count() == 0
