"""Templates with tools, prompt branches and history selection."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import chat, fixed
from corpusloom.operators import dialogue

MESSAGE = "role string, content string, tool_calls array<struct<name:string,arguments:string>>"


def render(spark, messages, **options):
    df = spark.createDataFrame([(messages,)], f"m array<struct<{MESSAGE.replace(' string', ':string').replace(' array', ':array')}>>")
    return df.select(chat.full_chat(F.col("m"), calls=True, **options)).first()[0]


def block(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_tools(spark):
    call = ("f", '{"x": 1}')
    messages = [
        ("user", "q", None), ("assistant", "", [call, ("g", "{}")]), ("tool", "r1", None), ("tool", "r2", None),
        ("assistant", "thinking", [call]), ("tool", "r3", None), ("assistant", "done", []),
    ]
    calls = '\n<tool_call>\n{"name": "f", "arguments": {"x": 1}}\n</tool_call>'
    want = (
        block("system", fixed.CHATML_DEFAULT_FULL) + block("user", "q")
        + "<|im_start|>assistant" + calls + '\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call><|im_end|>\n'
        + "<|im_start|>user\n<tool_response>\nr1\n</tool_response>\n<tool_response>\nr2\n</tool_response><|im_end|>\n"
        + "<|im_start|>assistant\nthinking" + calls + "<|im_end|>\n"
        + "<|im_start|>user\n<tool_response>\nr3\n</tool_response><|im_end|>\n" + block("assistant", "done")
    )
    assert render(spark, messages) == want
    assert render(spark, messages, open_answer=True) == want + "<|im_start|>assistant\n"
    tool = json.dumps({"name": "f"})
    listed = render(spark, [("system", "S", None), ("user", "q", None), ("system", "later", None)], tools=F.array(F.lit(tool)))
    head = "<|im_start|>system\nS" + fixed.TOOLS_LEAD + "\n" + tool + fixed.TOOLS_TAIL
    assert listed == head + block("user", "q") + block("system", "later")


def test_simple_template(spark):
    df = spark.createDataFrame([([("system", "S"), ("user", "q"), ("assistant", "a"), ("tool", "t")],)], "m array<struct<role:string,content:string>>")
    assert df.select(chat.simple_chat(F.col("m"))).first()[0] == block("system", "S") + block("user", "q") + "<|im_start|>assistant\na<|im_end|>\n"


def test_prompt_branches(spark):
    rows = spark.createDataFrame(
        [("q", "medical_question", "d" * 51), ("q", "medical_question", " " * 60 + "d" * 50), ("q", "medical_question", None), ("q", "chitchat", "d" * 99)],
        "question string, intent string, context string",
    )
    got = dialogue.prompts(rows).collect()
    assert [r.user_text for r in got] == [
        "Tài liệu y tế:\n" + "d" * 51 + "\n\nDựa vào tài liệu trên, trả lời câu hỏi: q",
        "Câu hỏi: q\n(Không tìm thấy tài liệu liên quan, trả lời theo kiến thức chung)",
        "Câu hỏi: q\n(Không tìm thấy tài liệu liên quan, trả lời theo kiến thức chung)",
        "q",
    ]
    assert [r.settings.max_tokens for r in got] == [2048, 2048, 2048, 150] and got[3].settings.stop == "\n\n"


def log(spark, rows, question):
    df = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(rows)], "session_id long, turn long, role string, content string")
    asked = spark.createDataFrame([(1, len(rows), question)], "session_id long, turn long, question string")
    return dialogue.earlier_messages(df, asked, block=4)


def shown(df):
    return [(m.role, m.content) for r in df.collect() for m in r.history]


def test_hybrid_history(spark):
    rows = [("user", "same"), ("assistant", "same"), ("user", "other"), ("assistant", "same"), ("user", "x" * 300), ("assistant", "last")]
    table = log(spark, rows, "?")
    hits = spark.createDataFrame(
        [(1, 0, "user", "same", 1.0, 1), (1, 1, "assistant", "same", 1.0, 2), (1, 2, "user", "other", 0.5, 3), (1, 5, "assistant", "last", 0.4, 4)],
        "session_id long, turn long, role string, content string, similarity double, rank int",
    )
    # recent: turns 3-5; "same" by the assistant and "last" are there already
    got = shown(dialogue.hybrid_history(table, hits))
    assert got == [("model", "same"), ("user", "x" * 250), ("model", "last"), ("user", "same"), ("user", "other")]
    # too many: back to the order of first occurrence, newest kept
    got = shown(dialogue.hybrid_history(table, hits, keep=4))
    assert got == [("model", "same"), ("user", "other"), ("user", "x" * 250), ("model", "last")]


def test_keyword_history(spark):
    rows = [("user", f"tôi bị ĐAU {i}") for i in range(9)] + [("assistant", "nghỉ đi"), ("user", "vâng"), ("assistant", "tạm biệt")]
    got = shown(dialogue.keyword_history(log(spark, rows, "Có đau không?")))
    assert [c for _, c in got] == [f"tôi bị ĐAU {i}" for i in range(4, 9)] + ["nghỉ đi", "vâng", "tạm biệt"]
    got = shown(dialogue.keyword_history(log(spark, rows, "Tên tôi?")))
    assert [c for _, c in got] == ["nghỉ đi", "vâng", "tạm biệt"]
    few = [("user", "tên là An"), ("assistant", "chào"), ("user", "a"), ("assistant", "b")]
    assert [c for _, c in shown(dialogue.keyword_history(log(spark, few, "tên gì")))] == ["chào", "a", "b", "tên là An"]


def test_contextual_query_and_answers(spark):
    df = spark.createDataFrame([("q", [("user", "u" * 101), ("assistant", "b")]), ("q", [])], "q string, before array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(dialogue.contextual_query(F.col("q"), F.col("before"))).collect()]
    assert got == ["Lịch sử:\nUser: " + "u" * 100 + "...\nBot: b...\n\nCâu hỏi mới: q", "q"]
    answers = spark.createDataFrame([(" \n",), (None,), ("ok",)], "a string").select(dialogue.checked_answer(F.col("a")))
    assert [r[0] for r in answers.collect()] == [fixed.EMPTY_ANSWER, fixed.EMPTY_ANSWER, "ok"]


def test_conversational_columns(spark):
    df = spark.createDataFrame([([("user", "q")], "plain")], "a array<struct<role:string,content:string>>, b string")
    out = chat.render_if_chat(df, ["a", "b", "missing"]).first()
    assert out.b == "plain" and out.a.endswith(block("user", "q"))


def test_nested_tool_calls(spark):
    calls = [
        ('[{"function": {"name": "f", "arguments": {"x":[1,2],"s":"a:b,c \\"d\\"","n":null}}}]', [("f", '{"x": [1, 2], "s": "a:b,c \\"d\\"", "n": null}')]),
        ('[{"name":"g","arguments":"k: \\"v\\", w"},{"name":"h"},{"name":"i","arguments":7}]', [("g", '"k: \\"v\\", w"'), ("h", "null"), ("i", "7")]),
        ('[{"type":"function","function":{"name":"é","arguments":{"z":{"b":{"a":[{}]}},"a":"ü"}}}]', [("é", '{"z": {"b": {"a": [{}]}}, "a": "ü"}')]),
        ("[]", []), (None, None), ("no json", None),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(calls)], "i int, c string")
    for r in rows.select("i", chat.json_calls(F.col("c")).alias("x")).collect():
        want = calls[r.i][1]
        assert (r.x and [(e.name, e.arguments) for e in r.x]) == (want or r.x and []) or (want == [] and r.x == [])


def test_calls_as_json_render_like_calls_in_fields(spark):
    fields = [("user", "q", None), ("assistant", "", [("f", '{"a": 1}')]), ("tool", "r", None), ("tool", "s", []), ("assistant", "end", None)]
    as_json = [(r, c, None if t is None else json.dumps([{"function": {"name": n, "arguments": json.loads(a)}} for n, a in t])) for r, c, t in fields]
    one = spark.createDataFrame([(fields,)], f"m array<struct<{MESSAGE.replace(' ', ':', 1).replace(', role ', ', role:').replace(', content ', ', content:').replace(', tool_calls ', ', tool_calls:')}>>")
    two = spark.createDataFrame([(as_json,)], "m array<struct<role:string,content:string,tool_calls:string>>")
    a, b = one.select(chat.full_chat(F.col("m"), True)).first()[0], two.select(chat.full_chat(F.col("m"), "json")).first()[0]
    assert a == b and '{"name": "f", "arguments": {"a": 1}}' in a
