"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a table are hashed; the hash selects the declarative
mapping that turns the layout into canonical turns (conv_id, turns). Turns are
written as <|role|>, text, <|end|>; ``&`` and ``<`` inside roles and texts are
escaped, so no text can hold a control string, and reading undoes it.

Null role or text is empty. Turns are ordered by turn, role, text with null turns
first; repeated rows are separate turns. Null conv_id is one conversation. Extra
columns of turn tables change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "<|end|>"
TURN = "named_struct('role', coalesce(cast({0} as string), ''), 'text', coalesce(cast({1} as string), ''))"


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; [] stands for array elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(fields: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()


# Field paths of each layout and the expression of its turns.
LAYOUTS = {
    "messages": (["conv_id", "messages[].role", "messages[].content"], "transform(messages, m -> " + TURN.format("m.role", "m.content") + ")"),
    "conversations": (["conv_id", "conversations[].from", "conversations[].value"], "transform(conversations, m -> " + TURN.format("case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end", "m.value") + ")"),
    "prompt": (["conv_id", "prompt", "response"], "array(" + TURN.format("'user'", "prompt") + ", " + TURN.format("'assistant'", "response") + ")"),
    "instruction": (["conv_id", "instruction", "input", "output"], "array(" + TURN.format("'user'", "concat_ws('\n', instruction, nullif(input, ''))") + ", " + TURN.format("'assistant'", "output") + ")"),
    "turns": (["conv_id", "turn", "role", "text"], None),
}
BY_FINGERPRINT = {fingerprint(fields): turns for fields, turns in LAYOUTS.values()}


def canonical(df: DataFrame) -> DataFrame:
    """conv_id and turns (array of role, text) of a table in any known layout."""
    own, top = paths(df.schema), set(df.columns)
    mark = fingerprint(own)
    if mark not in BY_FINGERPRINT:
        # Extra columns: the layout with most fields that the table has all of.
        fits = [fields for fields, _ in LAYOUTS.values() if set(fields) <= set(own)]
        if not fits:
            raise ValueError(f"no mapping for the fields {sorted(top)}")
        mark = fingerprint(max(fits, key=len))
    turns = BY_FINGERPRINT[mark]
    if turns is not None:
        return df.select("conv_id", F.coalesce(F.expr(turns), F.expr("array()")).alias("turns"))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: spans (start from 1, length) of the assistants' texts."""
    head = lambda t: F.concat(F.lit("<|"), F.replace(escape(t["role"]), F.lit("|"), F.lit("&#124;")), F.lit("|>"))
    parts = turns.withColumn("parts", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    # Positions by a running sum over the turns.
    walked = F.expr(
        f"""aggregate(parts, named_struct('at', 1, 'spans', cast(array() as array<struct<start: int, length: int>>)), (s, p) -> named_struct(
            'at', s.at + length(p.head) + length(p.body) + {len(END)},
            'spans', case when p.role = 'assistant' then concat(s.spans, array(named_struct('start', s.at + length(p.head), 'length', length(p.body)))) else s.spans end),
            s -> s.spans)"""
    )
    return parts.select("conv_id", text.alias("formatted"), walked.alias("loss"))


def digests(output: DataFrame) -> DataFrame:
    """What is read back from the output alone."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p != "")
    role = lambda p: unescape(F.replace(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>", 1), F.lit("&#124;"), F.lit("|")))
    body = lambda p: unescape(F.regexp_replace(p, r"(?s)^<\|.*?\|>", ""))
    listed = F.array_join(F.transform("pieces", lambda p: F.concat(role(p), F.lit("\n"), body(p), F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr(s["start"], s["length"]))), "")
    return (
        output.withColumn("pieces", pieces)
        .withColumns({"listed": listed, "masked": masked})
        .select(
            "conv_id",
            F.size("pieces").cast("long").alias("n_turns"),
            F.sha2(F.col("listed").cast("binary"), 256).alias("turns_sha256"),
            F.length("masked").cast("long").alias("loss_chars"),
            F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
