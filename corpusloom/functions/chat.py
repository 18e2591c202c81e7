"""Chat rows and chat templates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import fixed

_START, _END = "<|im_start|>", "<|im_end|>\n"


def qa_messages(question: Column | str, answer: Column | str) -> Column:
    """Two-message chat of a question and its answer."""
    q = F.col(question) if isinstance(question, str) else question
    a = F.col(answer) if isinstance(answer, str) else answer
    return F.array(
        F.struct(F.lit("user").alias("role"), q.alias("content")),
        F.struct(F.lit("assistant").alias("role"), a.alias("content")),
    )


def tagged_text(question: Column, answer: Column, end: str, system: str = fixed.TAG_SYSTEM, newline: str = "\\n") -> Column:
    """Instruction-tag format. `newline` is a backslash and an n by default, as
    the data that models were tuned on has it."""
    head = F.lit(f"[INST] <<SYS>>{newline}{system}{newline}<</SYS>>{newline}{newline}")
    return F.concat(head, question, F.lit(" [/INST] "), answer, F.lit(end))


def _block(role: Column, content: Column) -> Column:
    return F.concat(F.lit(_START), role, F.lit("\n"), content, F.lit(_END))


def simple_piece(role: Column, content: Column, first: Column) -> Column:
    """Text that one message adds in the simple template: every user block opens
    the assistant's, assistant text closes it."""
    turn = (
        F.when(role == "user", F.concat(_block(role, content), F.lit(_START + "assistant\n")))
        .when(role == "assistant", F.concat(content, F.lit(_END)))
        .otherwise("")
    )
    system = _block(F.lit("system"), F.lit(fixed.CHATML_DEFAULT_SIMPLE))
    return F.when(first & (role == "system"), _block(role, content)).when(first, F.concat(system, turn)).otherwise(turn)


def simple_chat(messages: Column) -> Column:
    """Simple template over an array of messages."""
    return F.array_join(
        F.transform(messages, lambda m, i: simple_piece(m["role"], m["content"], i == 0)), ""
    )


def full_piece(
    role: Column, content: Column, first: Column, before: Column, behind: Column, calls: Column | None = None,
    tools: bool = False,
) -> Column:
    """Text that one message adds in the full template. `before` and `behind`
    are the neighbours' roles (NULL at the ends); runs of tool messages share
    one user block. `calls` is an array of (name, arguments as JSON)."""
    opens = F.coalesce(before != "tool", F.lit(True))
    closes = F.coalesce(behind != "tool", F.lit(True))
    tool = F.concat(
        F.when(opens, _START + "user").otherwise(""),
        F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"),
        F.when(closes, _END).otherwise(""),
    )
    turn = F.when((role == "user") | ((role == "system") & ~first), _block(role, content))
    if calls is None:
        turn = turn.when(role == "assistant", _block(role, content))
    else:
        lines = F.transform(
            calls,
            lambda c: F.concat(
                F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>")
            ),
        )
        with_calls = F.concat(
            F.lit(_START), role,
            F.when(F.length(content) > 0, F.concat(F.lit("\n"), content)).otherwise(""),
            F.array_join(lines, ""), F.lit(_END),
        )
        plain = F.coalesce(F.size(calls) <= 0, F.lit(True))
        turn = turn.when((role == "assistant") & plain, _block(role, content)).when(role == "assistant", with_calls)
    turn = turn.when(role == "tool", tool).otherwise("")
    if tools:  # the system text is written together with the tool list
        return F.coalesce(turn, F.lit(""))
    system = F.when(role == "system", content).otherwise(fixed.CHATML_DEFAULT_FULL)
    return F.when(first, F.concat(_block(F.lit("system"), system), turn)).otherwise(turn)


def spaced_json(text: Column) -> Column:
    """JSON on one line with a space behind each comma and colon, as templates write it;
    the order of keys stays."""
    parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]+'), F.lit(0))
    outside = lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", ""), "([,:])", "$1 ")
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), p).otherwise(outside(p))), "")


def json_calls(text: Column) -> Column:
    """A JSON array of tool calls -> array of (name, arguments as JSON), for `full_piece`.
    A call may stand in a field `function`. Arguments are any JSON value, nested to any
    depth; missing ones are null. What is no array of objects gives NULL."""
    calls = F.from_json(text, "array<string>")

    def one(call: Column) -> Column:
        inner = F.coalesce(F.get_json_object(call, "$.function"), call)
        plain = F.get_json_object(inner, "$.arguments")
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(inner), "$.arguments", "variant"))
        quoted = F.to_json(F.array(plain))
        value = F.when(kind == "STRING", F.substring(quoted, 2, F.length(quoted) - 2)).otherwise(spaced_json(plain))
        return F.struct(F.get_json_object(inner, "$.name").alias("name"), F.coalesce(value, F.lit("null")).alias("arguments"))

    return F.transform(calls, one)


def full_chat(
    messages: Column, calls: bool | str = False, tools: Column | None = None, open_answer: bool = False
) -> Column:
    """Full template over an array of messages. With `calls` the messages have a
    field tool_calls: an array of (name, arguments as JSON), or with calls="json" JSON text
    that `json_calls` reads; `tools` is an array of JSON texts."""

    def piece(m, i):
        return full_piece(
            m["role"], F.coalesce(m["content"], F.lit("")), i == 0,
            F.when(i > 0, F.get(messages, i - 1)["role"]), F.get(messages, i + 1)["role"],
            json_calls(m["tool_calls"]) if calls == "json" else m["tool_calls"] if calls else None, tools is not None,
        )

    text = F.array_join(F.transform(messages, piece), "")
    if tools is not None:
        first = F.get(messages, F.lit(0))
        system = F.when(first["role"] == "system", first["content"]).otherwise(fixed.CHATML_DEFAULT_FULL)
        listed = F.array_join(F.transform(tools, lambda t: F.concat(F.lit("\n"), spaced_json(t))), "")
        text = F.concat(
            F.lit(_START + "system\n"), system, F.lit(fixed.TOOLS_LEAD), listed, F.lit(fixed.TOOLS_TAIL), text
        )
    return F.concat(text, F.lit(_START + "assistant\n")) if open_answer else text


def is_conversational(kind: T.DataType) -> bool:
    """Arrays of (role, content, ...) are conversations."""
    return (
        isinstance(kind, T.ArrayType)
        and isinstance(kind.elementType, T.StructType)
        and {"role", "content"} <= set(kind.elementType.names)
    )


def render_if_chat(df: DataFrame, columns: list[str], template=full_chat) -> DataFrame:
    """Apply a template to those of the columns that hold conversations."""
    chats = [c for c in columns if c in df.columns and is_conversational(df.schema[c].dataType)]
    return df.withColumns({c: template(F.col(c)) for c in chats})
