"""Chat texts: shapes to layouts, reversible escapes, masks, and digests read back."""

import hashlib
import json
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadframes.llm import chat, layouts
from roadframes.llm.catalog import op11_chat_format

SF = "/root/testdata/sf0.001"
signs = st.text(alphabet=st.one_of(st.sampled_from("\\<>/[]|s \n"), st.sampled_from("aé🙂")), max_size=6)
texts = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "</SYS>>", "<|end", " </s", "[/INST"]), signs), max_size=6).map("".join)


@settings(max_examples=1500, deadline=None)
@given(turns=st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), texts), texts), max_size=6))
def test_turns_round_trip(turns):
    text, loss = "", []
    for role, own in turns:
        formatted, start, stop = chat.format_turn(role, own)
        if role == "assistant":
            loss.append(text.__len__() + start)
            assert chat.unescape(formatted[start:stop]) == own
        assert not any(c in chat.escape(own) for c in chat.CONTROLS)
        text += formatted
    assert list(chat.parse_turns(text)) == turns


def test_broken_text():
    with pytest.raises(ValueError):
        list(chat.parse_turns("[INST] never ends"))


def plain(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = set()
    for conv, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        points = sum(len(chat.format_turn(r, t)[0]) for _, r, t in turns)
        out.add((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), points))
    return out


ODD = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", None), (1, None, None, "no turn"), (None, 0, "user", "a"), (None, 1, "assistant", "b"),
       (2, 0, "tool\n", "<|end|>"), (2, 0, "tool\n", "<|end|>"), (2, 0, "assistant", ""), (3, 0, "assistant", "long " * 60_000), (3, 1, "user", "x" * 300_000),
       (4, -1, "system", "\\</SYS>> <</SYS>>\n"), *((5, k % 9, "assistant" if k % 2 else "user", f"t{k % 40}é") for k in range(3000))]


@pytest.mark.parametrize("points", [200, 1 << 18])
def test_digests_of_odd_rows(spark, tmp_path, points):
    df = spark.createDataFrame([(*r, "x", 1, True) for r in ODD], "conv_id long, turn int, role string, text string, layout string, place int, whole boolean")
    chat.write_chats(chat.chat_turns(df.repartition(3)), str(tmp_path / "c"), block_points=points)
    got = [tuple(r) for r in chat.read_chats(spark, str(tmp_path / "c")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(ODD)
    turns = chat.read_turns(spark, str(tmp_path / "c"))
    assert turns.count() == len(ODD)
    blocks = spark.read.parquet(str(tmp_path / "c"))
    assert blocks.where("conv_id = 5").count() > (20 if points == 200 else 0)
    assert blocks.where("conv_id = 5").agg(F.max(F.length("text"))).first()[0] <= points + 30
    assert blocks.where("whole").groupBy("conv_id").count().where("count > 1").isEmpty()


def test_query_and_twin(spark):
    import duckdb

    from roadframes.llm.twins import TWINS

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = op11_chat_format(spark, SF)
    names = sorted(got.columns)
    want = con.execute(TWINS["op11_chat_format"]).fetchdf()
    assert sorted(want.columns) == names
    rows = {tuple(r) for r in got.select(names).collect()}
    assert rows == set(want[names].itertuples(index=False, name=None))
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    data += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {tuple(r) for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()} == plain(data)


RECORDS = [
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"completion": "c", "prompt": "p", "system": "s"}, "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "system": None}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o", "history": [["a", "b"], ["c"]]}, "instruction",
     [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", ""), ("user", "i\n\nn"), ("assistant", "o")]),
    ({"id": 3, "messages": [{"role": "user", "content": "u"}, {"content": None, "role": "assistant"}]}, "messages", [("user", "u"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message_parts", [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]}, "speakers",
     [("user", "h"), ("assistant", "g"), ("tool", "t")]),
    ({"dialog": ["a", "b", "c"]}, "dialog", [("user", "a"), ("assistant", "b"), ("user", "c")]),
    ({"conv_id": 1, "turn": 2, "role": "user", "text": "t"}, "turn_row", [("user", "t")]),
    ({"conv_id": 1, "turn": 2, "role": "human", "text": None}, "turn_row", [("human", "")]),
    ({"prompt": "p", "completion": "c", "extra": {"a": 1}}, None, []), ([1, 2], None, []), ("text", None, []), (None, None, []),
    ({"messages": [{"role": "user", "content": 5}]}, "messages", [("user", "5")]), ({"a b": {"c.d": None}}, None, []),
]


def test_layouts_of_json(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(98, "{broken"), (99, None)]
    df = spark.createDataFrame([(k, r, "x", "y") for k, r in rows], "conv_id long, record string, layout string, turns string")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in layouts.with_turns(df, "record").collect()}
    want = {k: (name, turns) for k, (_, name, turns) in enumerate(RECORDS)} | {98: (None, []), 99: (None, [])}
    assert got == want


def test_layouts_of_structs(spark):
    kind = ("prompt string, completion string, instruction string, input string, output string, "
            "messages array<struct<content: string, role: string, weight: double>>, dialog array<string>, conversations array<struct<value: string, from: string>>")
    rows = [("p", "c", None, None, None, None, None, None), (None, None, "i", "n", "o", None, None, None),
            (None, None, None, None, None, None, ["a", "b"], None), (None, None, None, None, None, None, None, [("v", "human"), (None, "gpt")]),
            (None, None, None, None, None, [("c", "user", 1.0)], None, None), (None,) * 8, ("p", "c", "i", None, None, None, None, None)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"conv_id long, record struct<{kind}>")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in layouts.with_turns(df, "record").collect()}
    assert got == {
        0: ("prompt_completion", [("user", "p"), ("assistant", "c")]), 1: ("instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        2: ("dialog", [("user", "a"), ("assistant", "b")]), 3: ("speakers", [("user", "v"), ("assistant", "")]),
        4: (None, []), 5: ("turn_row", [("", "")]), 6: (None, [])}


def test_json_and_struct_shapes_agree(spark):
    """The fingerprint of a record does not depend on how it is stored."""
    record = {"id": 1, "messages": [{"role": "user", "content": "u"}], "tags": ["a"], "meta": {"x": 1.5, "y": {"z": True}}}
    df = spark.createDataFrame([(json.dumps(record),)], "record string")
    typed = df.select(F.from_json("record", "id long, messages array<struct<role: string, content: string>>, tags array<string>, "
                                            "meta struct<x: double, y: struct<z: boolean>>").alias("record"))
    one, two = (layouts.with_turns(x, "record").first()["fingerprint"] for x in (df, typed))
    assert one == two == layouts.fingerprint_of(["id", "messages[].role", "messages[].content", "tags[]", "meta.x", "meta.y.z"])


def test_chats_of_mixed_layouts(spark, tmp_path):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows + [(50, rows[0][1])] * 3, "id long, body string").repartition(3)
    chat.write_chats(chat.chat_turns(df, conv_id="id", turn=None, record="body"), str(tmp_path / "m"))
    got = defaultdict(list)
    for r in chat.read_turns(spark, str(tmp_path / "m")).orderBy("part", "block", "place").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {k: turns for k, (_, _, turns) in enumerate(RECORDS) if turns} | {50: RECORDS[0][2] * 3}


def test_layouts_that_clash():
    same = layouts.Layout("other", ("prompt", "completion"), ())
    with pytest.raises(ValueError):
        layouts.fingerprints((*layouts.LAYOUTS, same))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    chat.write_chats(chat.chat_turns(df), str(tmp_path / "e"))
    assert chat.read_chats(spark, str(tmp_path / "e")).count() == 0
