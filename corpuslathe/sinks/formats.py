"""Samples as JSON lines in six chat formats, and fill-in-the-middle.

Rows become text with JVM functions; only samples with tool calls or tools pass
an Arrow function, for their JSON in other notations.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Roles by format, and what the Hub is told of the formats.
ROLES = {
    "OpenAI": {"system": "system", "user": "user", "assistant": "assistant", "tool": "tool", "ipython": "tool"},
    "ChatML": {"system": "system", "user": "user", "assistant": "assistant", "tool": "tool", "ipython": "tool"},
    "Llama4": {"system": "system", "user": "user", "assistant": "assistant", "tool": "ipython", "ipython": "ipython"},
    "ShareGPT": {"system": "system", "user": "human", "assistant": "gpt", "tool": "observation", "ipython": "observation"},
}
TOOL_SUPPORT = {"OpenAI": True, "ChatML": True, "Llama4": True, "Mistral": True, "ShareGPT": False, "Alpaca": False}


def compact(value) -> str:
    """JSON with sorted keys, without blanks, non-ASCII as it is."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def pythonic(arguments) -> str:
    """Arguments of a call in keyword form."""
    if not isinstance(arguments, dict):
        return compact(arguments)
    words = {True: "True", False: "False", None: "None"}

    def value(v) -> str:
        if isinstance(v, str):
            return f"'{v}'"
        return words[v] if v is None or isinstance(v, bool) else compact(v)

    return ", ".join(f"{k}={value(arguments[k])}" for k in sorted(arguments))


def _call(call, style: str) -> str:
    name, arguments = call["function_name"], json.loads(call["arguments"])
    if style == "ChatML":
        return "\n<tool_call>\n" + json.dumps({"arguments": arguments, "name": name}, ensure_ascii=False, indent=2, sort_keys=True) + "\n</tool_call>"
    if style == "Llama4":
        return f"{name}({pythonic(arguments)})"
    if style == "Mistral":
        return compact({"id": call["id"], "name": name, "arguments": arguments})
    if style == "ShareGPT":
        return f"\n\n[Called {name}: {compact(arguments)}]"
    return compact({"id": call["id"], "type": "function", "function": {"name": name, "arguments": compact(arguments)}})


def _calls(style: str):
    """Arrow function: each turn's calls in a format's notation ('' without calls)."""
    joined = {"ChatML": "{}", "ShareGPT": "{}", "Llama4": "\n[{}]", "Mistral": "\n[TOOL_CALLS] [{}]", "OpenAI": ',"tool_calls":[{}]'}[style]
    between = {"ChatML": "", "ShareGPT": "", "Llama4": ", ", "Mistral": ",", "OpenAI": ","}[style]

    @F.pandas_udf("array<string>")
    def run(turns: pd.Series) -> pd.Series:
        return pd.Series([[joined.format(between.join(_call(c, style) for c in calls)) if calls else "" for calls in json.loads(t)["a"]] for t in turns])

    return run


def _tool_lines(style: str):
    @F.pandas_udf("string")
    def run(tools: pd.Series) -> pd.Series:
        def line(t) -> str:
            d = {"name": t["name"], "description": t["description"], "parameters": json.loads(t["parameters"])}
            return compact(d if style == "Llama4" else {"type": "function", "function": d})

        listed = [None if t is None else json.loads(t) for t in tools]
        return pd.Series([None if t is None else (",".join(map(line, t)) if style == "OpenAI" else "".join(line(x) + "\n" for x in t)) for t in listed])

    return run


def _turns(conversation: Column, calls: Column, f) -> Column:
    return F.transform(F.arrays_zip(conversation.alias("t"), calls.alias("c")), lambda x: f(x["t"], x["c"]))


def _role(style: str, turn: Column) -> Column:
    pairs = [F.lit(x) for kv in ROLES[style].items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(turn["role"]))


def _openai(conversation: Column, tools: Column, calls: Column) -> Column:
    def message(t: Column, c: Column) -> Column:
        name = F.when(t["name"].isNotNull(), F.concat(F.lit(',"name":'), T.json_string(t["name"]))).otherwise("")
        call_id = F.when(t["tool_call_id"].isNotNull(), F.concat(F.lit(',"tool_call_id":'), T.json_string(t["tool_call_id"]))).otherwise("")
        return F.concat(F.lit('{"content":'), T.json_string(t["content"]), name, F.lit(',"role":"'), _role("OpenAI", t), F.lit('"'), call_id, c, F.lit("}"))

    said = F.array_join(_turns(conversation, calls, message), ",")
    return F.concat(F.lit('{"messages":['), said, F.lit("]"), F.coalesce(F.concat(F.lit(',"tools":['), tools, F.lit("]")), F.lit("")), F.lit("}"))


def _text_json(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))


def _chatml(conversation: Column, tools: Column, calls: Column) -> Column:
    def turn(t: Column, c: Column) -> Column:
        listed = F.when(t["role"] == "system", F.coalesce(F.concat(F.lit("\n\n<tools>\n"), tools, F.lit("</tools>")), F.lit(""))).otherwise("")
        return F.concat(F.lit("<|im_start|>"), _role("ChatML", t), F.lit("\n"), t["content"], listed, c, F.lit("<|im_end|>\n"))

    return _text_json(F.array_join(_turns(conversation, calls, turn), ""))


def _llama(conversation: Column, tools: Column, calls: Column) -> Column:
    def turn(t: Column, c: Column) -> Column:
        listed = F.when(t["role"] == "system", F.coalesce(F.concat(F.lit("\n\nYou have access to the following tools:\n\n"), tools), F.lit(""))).otherwise("")
        return F.concat(F.lit("<|start_header_id|>"), _role("Llama4", t), F.lit("<|end_header_id|>\n\n"), t["content"], listed, c, F.lit("<|eot_id|>\n"))

    return _text_json(F.concat(F.lit("<|begin_of_text|>"), F.array_join(_turns(conversation, calls, turn), "")))


def _mistral(conversation: Column, tools: Column, calls: Column) -> Column:
    system = F.get(F.filter(conversation, lambda t: t["role"] == "system"), F.lit(0))["content"]
    system = F.concat(system, F.coalesce(F.concat(F.lit("\n\nAvailable tools:\n"), tools), F.lit("")), F.lit("\n\n"))
    first_user = F.array_position(F.transform(conversation, lambda t: t["role"]), "user")
    zipped = F.arrays_zip(conversation.alias("t"), calls.alias("c"))

    def turn(x: Column, i: Column) -> Column:
        t, c = x["t"], x["c"]
        opened = F.when(i + 1 == first_user, F.coalesce(system, F.lit(""))).otherwise("")
        result = F.concat(F.lit('[TOOL_RESULTS] {"id": "'), F.coalesce(t["tool_call_id"], F.lit("unknown")), F.lit('", "content": '), T.json_string(t["content"]), F.lit("}[/TOOL_RESULTS]"))
        return (
            F.when(t["role"] == "system", "").when(t["role"] == "user", F.concat(F.lit("[INST] "), opened, t["content"], F.lit(" [/INST]")))
            .when(t["role"] == "assistant", F.concat(t["content"], c, F.lit("</s>"))).otherwise(result)
        )

    return _text_json(F.concat(F.lit("<s>"), F.array_join(F.transform(zipped, turn), "")))


def _sharegpt(conversation: Column, tools: Column, calls: Column) -> Column:
    turns = _turns(conversation, calls, lambda t, c: F.struct(_role("ShareGPT", t).alias("from"), F.concat(t["content"], c).alias("value")))
    return F.to_json(F.struct(turns.alias("conversations")))


def _alpaca(conversation: Column, tools: Column, calls: Column) -> Column:
    of = lambda role: F.transform(F.filter(conversation, lambda t: t["role"] == role), lambda t: t["content"])
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))

    def step(said: Column, t: Column) -> Column:
        user = F.when(said == "", t["content"]).otherwise(F.concat(said, F.lit("\n\n"), t["content"]))
        result = F.concat(said, F.lit("\n\n[Tool result: "), t["content"], F.lit("]"))
        return F.when(t["role"] == "user", user).when(t["role"].isin("tool", "ipython"), result).otherwise(said)

    given, system, output = F.aggregate(conversation, F.lit(""), step), last(of("system")), last(of("assistant"))
    bare = system == ""
    return F.to_json(F.struct(F.when(bare, "").otherwise(given).alias("input"), F.when(bare, given).otherwise(system).alias("instruction"), output.alias("output")))


def _fim(conversation: Column, style: str) -> Column:
    first = lambda role: F.coalesce(F.get(F.filter(conversation, lambda t: t["role"] == role), F.lit(0))["content"], F.lit(""))
    code = F.coalesce(T.code_block(first("user")), first("user"))
    fill = F.coalesce(T.code_block(first("assistant")), first("assistant"))
    parts = F.split(code, "<FILL>", 2)
    prefix, suffix = parts[0], F.get(parts, F.lit(1))
    plain = F.to_json(F.struct(fill.alias("middle"), prefix.alias("prefix"), F.coalesce(suffix, F.lit("")).alias("suffix")))
    marked = {
        "OpenAI": lambda: F.to_json(F.struct(fill.alias("completion"), T.template("<|fim_prefix|>{}<|fim_suffix|>{}<|fim_middle|>", prefix, suffix).alias("prompt"))),
        "ChatML": lambda: _text_json(T.template("<fim_prefix>{}<fim_suffix>{}<fim_middle>{}", prefix, suffix, fill)),
        "Llama4": lambda: _text_json(T.template("<PRE> {} <SUF>{} <MID> {}", prefix, suffix, fill)),
    }.get(style, lambda: plain)()
    return F.when(F.size(parts) == 2, marked).otherwise(plain)


_WRITERS = {"OpenAI": _openai, "ChatML": _chatml, "Llama4": _llama, "Mistral": _mistral, "ShareGPT": _sharegpt, "Alpaca": _alpaca}


def formatted(samples: DataFrame, style: str, with_tools: bool = True) -> DataFrame:
    """``samples`` with column line, a JSON object in the format ``style``. Without
    tools anywhere, ``with_tools=False`` saves the Arrow functions. Code completions
    are always fill-in-the-middle."""
    conversation = F.col("conversation")
    calls = F.transform(conversation, lambda t: F.lit(""))
    tools = F.lit(None).cast("string")
    if with_tools and style != "Alpaca":
        calls = _calls(style)(F.to_json(F.struct(F.transform(conversation, lambda t: t["tool_calls"]).alias("a")), {"ignoreNullFields": "false"}))
        if style != "ShareGPT":
            tools = _tool_lines(style)(F.to_json("tools"))
    own = samples.withColumns({"_calls": calls, "_tools": tools})
    line = _WRITERS[style](conversation, F.col("_tools"), F.col("_calls"))
    return own.withColumn("line", F.when(F.col("sample_type") == "CodeCompletion", _fim(conversation, style)).otherwise(line)).drop("_calls", "_tools")


# The catalogue of formats.
CATALOGUE = [
    ("OpenAI", "OpenAI Chat", "messages array with tool_calls. Universal standard.", ["GPT-OSS", "General"]),
    ("ChatML", "ChatML / Hermes", "im_start/im_end delimiters with <tools> XML tags.", ["Qwen3", "Qwen3.5", "Phi-4"]),
    ("Llama4", "Llama 4", "header_start/header_end tokens with pythonic tool calls.", ["Llama Scout", "Llama Maverick"]),
    ("Mistral", "Mistral", "INST control tokens with JSON tool_calls.", ["Mistral Small", "Mistral Large"]),
    ("ShareGPT", "ShareGPT", "Legacy conversations format for LlamaFactory/Unsloth.", ["LlamaFactory", "Unsloth"]),
    ("Alpaca", "Alpaca", "Simple instruction/input/output triplets.", ["Any instruction-tuned model"]),
]
# What a dataset card says of each format, and its columns (with the
# fields of their items, if they are lists).
BLURBS = {
    "OpenAI": "**OpenAI Chat** — `messages` array with `role`/`content` objects.",
    "ChatML": "**ChatML/Hermes** — `<|im_start|>`/`<|im_end|>` delimited text.",
    "Llama4": "**Llama 4** — Header token delimited conversation format.",
    "Mistral": "**Mistral** — `[INST]`/`[/INST]` control token format.",
    "ShareGPT": "**ShareGPT** — `conversations` array with `from`/`value` objects.",
    "Alpaca": "**Alpaca** — `instruction`/`input`/`output` triplets.",
}
FEATURES = {
    "OpenAI": {"messages": ["role", "content"]}, "ShareGPT": {"conversations": ["from", "value"]}, "Alpaca": {"instruction": [], "input": [], "output": []},
    "ChatML": {"text": []}, "Llama4": {"text": []}, "Mistral": {"text": []},
}


def catalogue(spark) -> DataFrame:
    """(format, name, description, models, supports_tools) of the six formats."""
    rows = [(*r, TOOL_SUPPORT[r[0]]) for r in CATALOGUE]
    return spark.createDataFrame(rows, "format string, name string, description string, models array<string>, supports_tools boolean")
