import json

import __spark_entry__ as entry
import pytest
from groundphrase.llm import chat
from oracle import same
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_oracle(spark):
    same(entry.queries()["op2_chat"](spark, SF), entry.oracle_sql()["op2_chat"], SF)


def back(df):
    out = chat.format_chats(chat.canonical_turns(df))
    out = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans")
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]\\", "x </s>\n[INST] y\nz", "é😀 </s>\n<s> assistant\nno", "", None, " ", "\n", "[/INST]\\\n", "long </s> " * 50_000]
    rows = [(1, i, ["user", "assistant", "sys\ntem </s>", None][i % 4], t, "x") for i, t in enumerate(texts)]
    r = back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string"))[1]
    assert [(t.role, t.text) for t in r.t] == [(x[2] or "", x[3] or "") for x in rows]
    assert r.loss == "".join(x[3] or "" for x in rows if x[2] == "assistant")
    for s in r.loss_spans:
        assert r.formatted[s.start + s.length :].startswith(" </s>\n")


def test_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    frames = [
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, "q", "", "a", 3)], "conv_id long, instruction string, input string, output string, score int"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string"),
    ]
    for df in frames:
        assert [(t.role, t.text) for t in back(df)[1].t] == want
        assert chat.format_chats(chat.canonical_turns(df.limit(0))).count() == 0
    more = spark.createDataFrame([(1, None, None, "b", "p", 1), (1, 0, "user", "a", "p", 2)], "conv_id long, turn long, role string, text string, prompt string, n int")
    assert [(t.role, t.text) for t in back(more)[1].t] == [("", "b"), ("user", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1).selectExpr("id conv_id", "'x' other"))


def test_mixed_json(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a", "input": ""},
        {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"}, {"other": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "{"), (91, None)]
    got = {}
    for r in chat.turns_from_json(spark.createDataFrame(rows, "k long, j string"), "k", "j").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for i in range(5):
        assert got[i] == [("user", "q"), ("assistant", "a")], (i, got[i])
    assert got[5] == got[90] == got[91] == [(None, None)]
