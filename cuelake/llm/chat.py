"""Chat formatting from event logs.

A log row is (conv, seq, message, kind, role, text). ``open`` starts a message, ``delta`` appends text, ``edit``
replaces what the message said so far, ``regenerate`` empties it before new deltas. Logs are partitioned by conversation, put in
order of seq and folded into the final message of each; messages stand in the order of their first event.

The template marks a turn as START role \\n text END. Inside roles and texts ``\\``, ``<``, ``[`` (and the line feed of a role) are written
``\\\\``, ``\\l``, ``\\b``, ``\\n``, so no control string, of this or another template, can stand in a text, and reading back is exact.

Null texts and roles count as empty. Events of a message that no ``open`` started form a message without role. A null conversation
id is one conversation. An empty log gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import let

START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("edit", "regenerate")
#: Characters of texts and what stands for them after a backslash.
CODES = {"<": "l", "[": "b", "\n": "n"}


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c, code in CODES.items():
        out = F.replace(out, F.lit(c), F.lit("\\" + code)) if c != "\n" or role else out
    return out


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for c, code in CODES.items():
            part = F.replace(part, F.lit("\\" + code), F.lit(c))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The event log of a table (conv_id, turn, role, text): each row opens a message and streams its text in two deltas.

    Of every three turns, one has its first half edited in after a false start, one is regenerated after a false start.
    """
    n = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.row_number().over(n))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda i, kind, role, text: F.struct(F.struct("turn", "copy", F.lit(i).alias("i")).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    first, rest, wrong = F.left("text", half), F.substr("text", half + 1), F.lit("...")
    plain = [event(0, "open", F.col("role"), none), event(1, "delta", none, first), event(4, "delta", none, rest)]
    edited = [plain[0], event(1, "delta", none, wrong), event(2, "edit", none, first), plain[2]]
    again = [plain[0], event(1, "delta", none, wrong), event(2, "regenerate", none, none), event(3, "delta", none, first), plain[2]]
    turn = F.coalesce(F.pmod("turn", F.lit(3)), F.lit(0))
    events = F.when(turn == 1, F.array(*edited)).when(turn == 2, F.array(*again)).otherwise(F.array(*plain))
    return rows.select(F.col("conv_id").alias("conv"), F.struct("turn", "copy").alias("message"), F.inline(events))


def final_messages(log: DataFrame) -> DataFrame:
    """(conv, at, role, text): each message folded; ``at`` is its first seq."""
    events = log.groupBy("conv", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("e"))

    def said(e: Column) -> Column:
        reset = F.array_max(F.transform(F.filter(e, lambda x: x["kind"].isin(*RESETS)), lambda x: x["seq"]))
        return let(reset, lambda r: F.array_join(F.transform(F.filter(e, lambda x: r.isNull() | (x["seq"] >= r)), lambda x: F.coalesce(x["text"], F.lit(""))), ""))

    role = F.get(F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull()), 0)
    return events.select("conv", F.col("e")[0]["seq"].alias("at"), F.coalesce(role, F.lit("")).alias("role"), said(F.col("e")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv, formatted, loss): the text, and the spans (start from 1, length) that assistants said."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(START), escape(m["role"], role=True), F.lit("\n")).alias("head"), escape(m["text"]).alias("body")))
    turns = messages.groupBy("conv").agg(parts.alias("turns"))

    def spans(turns: Column) -> Column:
        lengths = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body")))
        return let(lengths, lambda n: F.aggregate(
            n,
            F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda acc, t: F.struct(
                (acc["at"] + t["head"] + t["body"] + len(END)).alias("at"),
                F.when(t["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length")))).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        ))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return turns.select("conv", text.alias("formatted"), spans(F.col("turns")).alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(turns, lambda t: let(F.position(F.lit("\n"), t), lambda i: F.struct(unescape(F.left(t, i - 1)).alias("role"), unescape(F.substr(t, i + 1)).alias("text"))))


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")
